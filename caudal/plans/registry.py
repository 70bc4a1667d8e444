"""A query: its Spark form, its checking SQL and the columns both must give.

``output`` lists ``name:type`` with types ``l`` whole number, ``d`` double, ``dN`` double
rounded half up to N digits, ``t`` text, ``f`` date, ``s`` time to the second as text. The
same casts close both forms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.functions.numeric import round_half_up
from caudal.sources.adapters import Bank, checker_tables


@dataclass(frozen=True)
class Query:
    output: str
    spark: Callable[[Bank], DataFrame]
    tables: str = ""
    sql: str | None = None

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(part.split(":")) for part in self.output.split()]  # type: ignore[misc]

    def run(self, spark, folder: str) -> DataFrame:
        df = self.spark(Bank(spark, folder))
        return df.select(*[_spark_cast(n, t).alias(n) for n, t in self.columns])

    def checking_sql(self) -> str | None:
        if self.sql is None:
            return None
        names = ", ".join(f'{_sql_cast(n, t)} as "{n}"' for n, t in self.columns)
        tables = checker_tables(*self.tables.split())
        return f"with {tables}\nselect {names} from ({self.sql}) as answer"


def _spark_cast(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "l":
        return c.cast("long")
    if kind == "t":
        return c.cast("string")
    if kind == "f":
        return c.cast("date")
    if kind == "s":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if kind == "d":
        return c.cast("double")
    return round_half_up(c, int(kind[1:]))


def _sql_cast(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "s":
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    if kind in ("l", "t", "f", "d"):
        target = {"l": "bigint", "t": "varchar", "f": "date", "d": "double"}[kind]
        return f"cast({c} as {target})"
    return f"floor(cast({c} as double)*1e{kind[1:]}+0.5e0)/1e{kind[1:]}"


def sql_pct(a: str, b: str) -> str:
    return (
        f"case when ({b})>0 then cast({a} as double)/cast({b} as double)*100e0 else 0e0 end"
    )


def sql_instalment(p: str = "monto_aprobado_usd", r: str = "tasa_interes_anual",
                   n: str = "plazo_meses") -> str:
    monthly = f"(cast({r} as double)/100e0/12e0)"
    return f"(cast({p} as double)*{monthly}/(1e0-pow(1e0+{monthly}, -cast({n} as double))))"
