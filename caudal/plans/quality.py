"""Queries on constraints, exports and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.operators import documents as D
from caudal.operators import export as E
from caudal.operators import quality as V
from caudal.operators.keys import offending_keys
from caudal.operators.support import new_folder, remove_folder
from caudal.plans import credit, ledger, treasury
from caudal.plans.registry import Query, sql_pct
from caudal.sources.adapters import Bank
from caudal.sources.schemas import SCHEMAS, TABLES
from caudal.sources.tables import append, load, load_csv, recreate

_ALL = " ".join(TABLES)
_WITH_ID = [name for name in TABLES if "id" in SCHEMAS[name].names]

def _csv_roundtrip(b: Bank) -> DataFrame:
    """Every table written as CSV to the shared folder and read back, column by column.

    The answer has a row per column, so it is fetched and the copy removed at once. All tables
    are summed up in one job.
    """
    folder = new_folder(b.spark, "csv")
    try:
        E.export_csv(b.tables, folder)
        found = []
        for name in TABLES:
            copy = load_csv(b.spark, folder, name)
            digests = [F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 8), 16, 10)
                       .cast("long") for c in copy.columns]
            found.append(copy.agg(
                F.lit(name), F.count("*"), F.array(*[F.count(c) for c in copy.columns]),
                F.array(*[F.sum(d) for d in digests]),
            ))
        rows = [
            (name, c, n, filled, total)
            for name, n, full, totals in reduce(DataFrame.unionAll, found).collect()
            for c, filled, total in zip(SCHEMAS[name].names, full, totals, strict=True)
        ]
    finally:
        remove_folder(b.spark, folder)
    return b.spark.createDataFrame(
        rows, "tabla string, columna string, filas long, llenas long, suma long"
    )


def _csv_sql(table: str) -> str:
    return _union([
        f"""select '{table}' tabla, '{c}' columna, count(*) filas, count({c}) llenas,
                   sum(cast('0x' || left(md5(cast({c} as varchar)), 8) as bigint)) suma
            from {table}"""
        for c in SCHEMAS[table].names
    ])


def _union(selects: list[str]) -> str:
    return " union all ".join(selects)


_CLIENT_COLUMNS = SCHEMAS["clientes"].names
_TX_COLUMNS = SCHEMAS["transacciones"].names
_KIND = {"bigint": "l", "int": "l", "double": "d", "date": "t", "timestamp_ntz": "t", "string": "t"}


def _upper(table: str) -> str:
    return " ".join(
        f"{f.name.upper()}:{_KIND.get(f.dataType.simpleString(), 'd')}" for f in SCHEMAS[table]
    )


def _row_sql(table: str) -> str:
    """The VALUES text of a row, column by column."""
    parts = []
    for f in SCHEMAS[table]:
        text = f"cast({f.name} as varchar)"
        if f.dataType.simpleString() in ("string", "date", "timestamp_ntz"):
            text = f"'''' || replace({text}, '''', '''''') || ''''"
        parts.append(f"coalesce({text}, 'NULL')")
    return "'(' || " + " || ', ' || ".join(parts) + " || ')'"


def _json_sql(**lists: str) -> str:
    """A document of named lists."""
    parts = " || ',' || ".join(f"'\"{name}\":' || ({text})" for name, text in lists.items())
    return f"select '{{' || {parts} || '}}' documento"


def _json_list(module, name: str, *order: str, drop: str = "", exact=(), keys=()) -> str:
    """The checking SQL of a report as the text of a JSON list; ``keys`` renames columns."""
    query = module.QUERIES[name]
    texts = []
    for column, kind in query.columns:
        if column in drop.split():
            continue
        value = f'"{column}"'
        if kind[0] == "d" and column not in exact and kind != "d":
            digits = kind[1:]
            value = f"(floor(cast({value} as double)*1e{digits}+0.5e0)/1e{digits})"
        elif column in exact:
            value = f"cast(floor(cast({value} as double)*1e2+0.5e0)/1e2 as decimal(22,2))"
        elif kind == "s":
            value = f"strftime({value}, '%Y-%m-%d %H:%M:%S')"
        value = f"cast({value} as varchar)"
        if kind in ("t", "f", "s"):
            value = f"'\"' || {value} || '\"'"
        texts.append(f"'\"{dict(keys).get(column, column)}\":' || {value}")
    row = "'{' || " + " || ',' || ".join(texts) + " || '}'"
    return (
        f"select '[' || string_agg({row}, ',' order by {', '.join(order)}) || ']' "
        f"from ({query.sql}) r"
    )


QUERIES: dict[str, Query] = {
    "dq_nulls": Query(
        "tabla:t columna:t nulos:l",
        lambda b: V.dq_nulls(b.tables),
        _ALL,
        _union([
            f"select '{t}' tabla, '{c}' columna, count(*)-count({c}) nulos from {t}"
            for t, table in TABLES.items() for c in table.required
        ]),
    ),
    "dq_domains": Query(
        "tabla:t columna:t fuera_de_dominio:l",
        lambda b: V.dq_domains(b.tables),
        _ALL,
        _union([
            f"select '{t}' tabla, '{c}' columna, count(*) fuera_de_dominio from {t} "
            f"where not list_contains({list(values)!r}, {c})"
            for t, table in TABLES.items() for c, values in table.domains.items()
        ]),
    ),
    "dq_unique": Query(
        "tabla:t columna:t claves_repetidas:l filas:l",
        lambda b: V.dq_unique(b.tables),
        _ALL,
        _union([
            f"select '{t}' tabla, '{c}' columna, count(distinct {c}) claves_repetidas, "
            f"count({c}) filas from (select {c}, count(*) over (partition by {c}) n from {t}) "
            "where n>1"
            for t, table in TABLES.items() for c in table.unique
        ]),
    ),
    "dq_orphans": Query(
        "tabla:t columna:t huerfanas:l",
        lambda b: V.dq_orphans(b.tables),
        _ALL,
        _union([
            f"select '{t}' tabla, '{c}' columna, count(*) huerfanas from {t} "
            f"left join {p} p on p.id={t}.{c} where p.id is null and {t}.{c} is not null"
            for t, table in TABLES.items() for c, p in table.references.items()
        ]),
    ),
    "dq_offending_keys": Query(
        "regla:t tabla:t columna:t clave:t filas:l",
        lambda b: offending_keys(b.tables),
        _ALL,
        _union([
            f"select 'repetida' regla, '{t}' tabla, '{c}' columna, cast({c} as varchar) clave, "
            f"count(*) filas from {t} where {c} is not null group by {c} having count(*)>1"
            for t, table in TABLES.items() for c in table.unique
        ] + [
            f"select 'huerfana', '{t}', '{c}', cast({t}.{c} as varchar), count(*) from {t} "
            f"left join {p} p on p.id={t}.{c} where p.id is null and {t}.{c} is not null "
            f"group by {t}.{c}"
            for t, table in TABLES.items() for c, p in table.references.items()
        ]),
    ),
    "row_counts": Query(
        "tabla:t filas:l",
        lambda b: V.row_counts(b.tables),
        _ALL,
        _union([f"select '{t}' tabla, count(*) filas from {t}" for t in TABLES]),
    ),
    "next_ids": Query(
        "tabla:t siguiente_id:l",
        lambda b: V.next_ids(b.tables),
        _ALL,
        _union([
            f"select '{t}' tabla, coalesce(max(id)+1, 1) siguiente_id from {t}" for t in _WITH_ID
        ]),
    ),
    "csv_roundtrip": Query(
        "tabla:t columna:t filas:l llenas:l suma:l",
        _csv_roundtrip,
        _ALL,
        _union([_csv_sql(name) for name in TABLES]),
    ),
    "warehouse_shape": Query(
        _upper("clientes"),
        lambda b: E.warehouse_shape(b.clientes),
        "clientes",
        "select " + ", ".join(f'{c} as "{c.upper()}"' for c in _CLIENT_COLUMNS) + " from clientes",
    ),
    "warehouse_ledger": Query(
        _upper("transacciones"),
        lambda b: E.warehouse_shape(b.transacciones),
        "transacciones",
        "select " + ", ".join(f'{c} as "{c.upper()}"' for c in _TX_COLUMNS)
        + " from transacciones",
    ),
    "sql_literals": Query(
        "fila:t",
        lambda b: E.row_literals(b.transacciones),
        "transacciones",
        f"select {_row_sql('transacciones')} fila from transacciones",
    ),
    "kpi_document": Query(
        "documento:t",
        lambda b: D.kpi_document(b.clientes, b.cuentas, b.creditos, b.transacciones),
        "clientes cuentas creditos transacciones",
        f"""select '{{"clientes":{{"total":' || c.n || ',"churn_rate_pct":'
                   || (floor(({sql_pct("c.gone", "c.n")})*1e2+0.5e0)/1e2)
                   || '}},"depositos":{{"VES":' || d.v || ',"USD":' || d.u
                   || '}},"creditos":{{"total_prestamos":' || k.n || ',"monto_total_usd":' || k.total
                   || ',"monto_default_usd":' || k.lost || ',"default_rate_pct":'
                   || (floor(({sql_pct("k.bad", "k.n")})*1e2+0.5e0)/1e2)
                   || '}},"operativo":{{"total_transacciones":' || o.n
                   || ',"cantidad_fraudes":' || o.f || ',"monto_fraude_usd":' || o.u
                   || ',"transacciones_fallidas":' || o.x || ',"tasa_falla_pct":'
                   || (floor(({sql_pct("o.x", "o.n")})*1e4+0.5e0)/1e4) || '}}}}' documento
            from (select count(*) n, count(*) filter (estado_cliente='Inactivo') gone
                  from clientes) c,
                 (select coalesce(sum(saldo_actual) filter (moneda='VES'), 0.00) v,
                         coalesce(sum(saldo_actual) filter (moneda='USD'), 0.00) u
                  from cuentas where estado_cuenta='Activa') d,
                 (select count(*) n, count(*) filter (estado in ('Vencido', 'En Litigio')) bad,
                         sum(monto_aprobado_usd) total,
                         sum(case when estado in ('Vencido', 'En Litigio')
                                  then saldo_pendiente_usd else 0 end) lost from creditos) k,
                 (select count(*) n, sum(es_fraude) f, sum(es_fraude*monto_usd) u,
                         count(*) filter (estado='Fallida') x from transacciones) o""",
    ),
    "macro_document": Query(
        "documento:t",
        lambda b: D.macro_document(b.indicadores_macro),
        "indicadores_macro",
        f"""select ({_json_list(treasury, "macro_monthly", "mes")}) documento""",
    ),
    "credit_document": Query(
        "documento:t",
        lambda b: D.credit_document(b.creditos, b.clientes, b.pagos_creditos),
        "creditos clientes pagos_creditos",
        _json_sql(
            scores=_json_list(credit, "default_by_score_band", "rango desc"),
            cartera_tipo=_json_list(credit, "portfolio_by_type_status", "tipo", "estado"),
            evolucion_morosidad=_json_list(
                credit, "delinquency_monthly", "mes", drop="mora_mayor_90 tasa_mora_mayor_90"
            ),
            actividad_economica=_json_list(
                credit, "default_by_activity", "actividad", keys={"total": "total_prestamos"}
            ),
        ),
    ),
    "operational_document": Query(
        "documento:t",
        lambda b: D.operational_document(b.transacciones, b.cuentas, b.clientes),
        "transacciones cuentas clientes",
        _json_sql(
            canales=_json_list(ledger, "tx_by_channel_status", "canal", "estado"),
            fraudes_canal=_json_list(ledger, "fraud_by_channel", "canal"),
            caidas_sistema=_json_list(ledger, "outage_days", "dia", drop="completadas"),
            listado_fraudes=_json_list(
                ledger, "top_frauds", "monto_usd desc", "id", drop="id"
            ),
        ),
    ),
    "liquidity_document": Query(
        "documento:t",
        lambda b: D.liquidity_document(b.resumen_liquidez_diario, b.operaciones_tesoreria),
        "resumen_liquidez_diario operaciones_tesoreria",
        _json_sql(
            evolucion=_json_list(
                treasury, "liquidity_weekly", "fecha", drop="semana", exact=D.LEVELS
            ),
            tesoreria=_json_list(treasury, "treasury_by_operation", "operacion"),
            flujo_mensual=_json_list(treasury, "treasury_monthly_flow", "mes"),
        ),
    ),
}


def _warehouse_query(table: str) -> Query:
    return Query(
        _upper(table),
        lambda b: E.warehouse_shape(b.tables[table]),
        table,
        "select " + ", ".join(f'{c} as "{c.upper()}"' for c in SCHEMAS[table].names)
        + f" from {table}",
    )


def _literals_query(table: str) -> Query:
    return Query(
        "fila:t",
        lambda b: E.row_literals(b.tables[table]),
        table,
        f"select {_row_sql(table)} fila from {table}",
    )


QUERIES |= {f"warehouse_{t}": _warehouse_query(t) for t in TABLES}
QUERIES |= {f"sql_literals_{t}": _literals_query(t) for t in TABLES}


def _statements(b: Bank) -> DataFrame:
    made = E.insert_statements(b.tables)
    return made.withColumn("huella", F.md5("sentencia")).drop("sentencia")


def _statements_sql(table: str) -> str:
    head = f"INSERT INTO {table} ({', '.join(SCHEMAS[table].names)}) VALUES"
    return f"""select '{table}' tabla, (n-1)//1000 numero, count(*) filas,
                      md5('{head}' || chr(10) || string_agg(fila, ',' || chr(10) order by n) || ';') huella
               from (select fila, row_number() over (order by k, fila) n
                     from (select {_row_sql(table)} fila, {TABLES[table].unique[0]} k from {table}))
               group by 2"""


QUERIES["sql_statements"] = Query(
    "tabla:t numero:l filas:l huella:t", _statements, _ALL,
    _union([f"select * from ({_statements_sql(t)})" for t in TABLES]),
)


# ---- writing ------------------------------------------------------------------------

_REWRITTEN = ("cuentas", "creditos")


def _rewritten(b: Bank) -> DataFrame:
    """Tables begun with a part, made anew as a whole, then appended to; read with their types.

    The answer has a row per table, so it is fetched and the tables removed at once.
    """
    folder = new_folder(b.spark, "tablas")
    rows = []
    try:
        for name in _REWRITTEN:
            df = b.tables[name]
            recreate(df.filter("id % 2 = 0"), folder, name)
            recreate(df, folder, name)
            append(df.filter("id % 3 = 0"), folder, name)
            found = load(b.spark, folder, name).agg(
                F.count("*"), F.countDistinct("id"), F.sum("id")
            ).first()
            rows.append((name, *found))
    finally:
        remove_folder(b.spark, folder)
    return b.spark.createDataFrame(rows, "tabla string, filas long, claves long, suma long")


def _surrogates(b: Bank) -> DataFrame:
    """Dense and merely unique ids of the ledger's rows, summed up."""
    rows = b.transacciones.drop("id")
    dense = E.with_dense_ids(rows).agg(
        F.lit("densos").alias("clase"), F.min("id").alias("menor"), F.max("id").alias("mayor"),
        F.countDistinct("id").alias("distintos"),
    )
    unique = E.with_unique_ids(rows).agg(
        F.lit("unicos").alias("clase"), F.lit(None).cast("long").alias("menor"),
        F.lit(None).cast("long").alias("mayor"), F.countDistinct("id").alias("distintos"),
    )
    return dense.unionByName(unique)


QUERIES |= {
    "tables_rewritten": Query(
        "tabla:t filas:l claves:l suma:l", _rewritten, " ".join(_REWRITTEN),
        _union([
            f"""select '{t}' tabla, count(*)+count(*) filter (id%3=0) filas,
                       count(distinct id) claves,
                       sum(id)+coalesce(sum(id) filter (id%3=0), 0) suma from {t}"""
            for t in _REWRITTEN
        ]),
    ),
    "surrogate_ids": Query(
        "clase:t menor:l mayor:l distintos:l", _surrogates, "transacciones",
        """select 'densos' clase, 1 menor, count(*) mayor, count(*) distintos from transacciones
           union all select 'unicos', null, null, count(*) from transacciones""",
    ),
}
