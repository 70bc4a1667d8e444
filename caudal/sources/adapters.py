"""The given star-schema tables seen as bank tables.

Each bank table is one SELECT. The text is plain SQL that Spark and the checking database
both accept, so that a comparison starts from equal rows; only adding days to a date is
spelt differently (``Dialect.plus_days``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "labels")


class Dialect:
    """How one engine adds days to a date."""

    def __init__(self, plus_days: Callable[[str, str], str]):
        self.plus_days = plus_days


SPARK = Dialect(lambda day, n: f"date_add({day}, cast({n} as int))")
CHECKER = Dialect(lambda day, n: f"cast({day} + cast({n} as int) as date)")


def official_rate(day: str) -> str:
    """Official USD/VES rate of a date: 27.20 and a cent more per day from 1995 on."""
    return _rate(day, "27.20", "0.01")


def parallel_rate(day: str) -> str:
    return _rate(day, "29.40", "0.011")


def _rate(day: str, start: str, step: str) -> str:
    days = f"(extract(year from {day})-1995)*365 + extract(doy from {day})"
    return (
        f"cast(cast({start} as decimal(12,4)) + cast({step} as decimal(12,4))"
        f"*cast({days} as decimal(8,0)) as decimal(12,4))"
    )


def _clientes(d: Dialect) -> str:
    joined = d.plus_days("date '1995-01-01'", "c_custkey%400")
    born = d.plus_days("date '1950-01-01'", "(c_custkey*131)%18000")
    left = d.plus_days("date '2024-02-01'", "c_custkey%28")
    score = "cast(300+(c_custkey*37)%551 as int)"
    return f"""
    select c_custkey as id,
           'Cliente' as nombre,
           c_name as apellido,
           'V' as tipo_documento,
           concat('V-', lpad(cast(c_custkey as varchar(20)), 8, '0')) as cedula,
           {born} as fecha_nacimiento,
           case when c_custkey%2=0 then 'F' else 'M' end as genero,
           case when c_custkey%4=0 then 'Soltero' when c_custkey%4=1 then 'Casado'
                when c_custkey%4=2 then 'Divorciado' else 'Viudo' end as estado_civil,
           concat('cliente.', cast(c_custkey as varchar(20)), '@gmail.com') as email,
           concat('0414-', lpad(cast(c_custkey%10000000 as varchar(20)), 7, '0')) as telefono,
           n_name as estado_residencia,
           {joined} as fecha_registro,
           case when c_custkey%20=7 then 'Inactivo' else 'Activo' end as estado_cliente,
           case when c_custkey%20=7 then {left} end as fecha_desafiliacion,
           {score} as score_credito,
           cast(greatest(c_acctbal, cast(0 as double)) as decimal(15,2)) as ingresos_mensuales_usd,
           c_mktsegment as actividad_economica,
           case when {score} > 700 and c_acctbal > 1000 then 'Bajo'
                when {score} < 500 or c_acctbal < 200 then 'Alto'
                else 'Medio' end as nivel_riesgo_interno
    from {{customer}} join {{nation}} on c_nationkey = n_nationkey"""


def _cuentas(d: Dialect) -> str:
    opened = d.plus_days("date '2024-01-01'", "c_custkey%20")
    shared = f"""c_custkey as cliente_id,
           concat('0105', lpad(cast(2*c_custkey+usd as varchar(20)), 16, '0')) as numero_cuenta,
           case when usd=1 or c_custkey%3=0 then 'Corriente' else 'Ahorros' end as tipo_cuenta,
           case when usd=1 then 'USD' else 'VES' end as moneda,
           {opened} as fecha_apertura,
           cast(abs(c_acctbal) as decimal(18,2)) as saldo_actual,
           case when c_custkey%20=7 then 'Cerrada' else 'Activa' end as estado_cuenta"""
    return f"""
    select 2*c_custkey+usd as id, {shared}
    from (select c_custkey, c_acctbal, 0 as usd from {{customer}}
          union all
          select c_custkey, c_acctbal, 1 as usd from {{customer}} where c_custkey%5<2) as openings"""


def _transacciones(d: Dialect) -> str:
    return f"""
    select event_id as id,
           cuenta_id,
           case when k%6=0 then 'Pago Movil' when k%6=1 then 'Compra Punto Venta'
                when k%6=2 then 'Transferencia' when k%6=3 then 'Retiro ATM'
                when k%6=4 then 'Deposito Taquilla' else 'Retiro Taquilla' end as tipo_transaccion,
           case when cuenta_id%2=0 then cast(v*tasa as decimal(18,2)) else v end as monto,
           v as monto_usd,
           tasa as tasa_cambio,
           ts as fecha_hora,
           case when k%6=0 then 'Pago Movil' when k%6=1 then 'Punto de Venta'
                when k%6=2 then 'Banca Movil' when k%6=3 then 'ATM' else 'Taquilla' end as canal,
           estado,
           case when estado='Fallida' then 'ERR_TIMEOUT'
                when estado='Rechazada' then 'ERR_FONDO_INSUFICIENTE' end as codigo_error,
           case when estado='Completada' and extract(hour from ts) between 1 and 4
                     and v>40 and k%6<3 then 1 else 0 end as es_fraude,
           cast(104806+(event_id*7919)%3001-1500 as double)/cast(10000 as double) as latitud,
           cast(-669036+(event_id*6151)%3001-1500 as double)/cast(10000 as double) as longitud,
           concat('DEV_', lpad(cast((user_id*7907 + case when event_id%9=0 then event_id else 0 end)
                                    %1000000 as varchar(10)), 6, '0')) as dispositivo_id
    from (select event_id, user_id, ts, k,
                 cast(value as decimal(18,2)) as v,
                 {official_rate("cast(ts as date)")} as tasa,
                 case when user_id%5<2 and event_id%4=0 then 2*user_id+1 else 2*user_id end
                     as cuenta_id,
                 case when event_type='error' and k<70 then 'Fallida'
                      when event_type='signup' and k<30 then 'Rechazada'
                      else 'Completada' end as estado
          from (select event_id, user_id, ts, event_type, value,
                       cast(substr(props, 7, length(props)-7) as int) as k
                from {{events}}) as parsed) as typed"""


def _creditos(d: Dialect) -> str:
    term = (
        "case when o_orderkey%4=0 then 12 when o_orderkey%4=1 then 18 "
        "when o_orderkey%4=2 then 24 else 36 end"
    )
    granted = "cast(o_orderdate as date)"
    return f"""
    select o_orderkey as id,
           o_custkey as cliente_id,
           cast(o_totalprice as decimal(15,2)) as monto_aprobado_usd,
           cast(33+o_orderkey%7 as decimal(5,2)) as tasa_interes_anual,
           {term} as plazo_meses,
           {granted} as fecha_otorgamiento,
           {d.plus_days(granted, f"30*({term})")} as fecha_vencimiento,
           case when o_orderpriority in ('1-URGENT', '5-LOW') then 'Consumo'
                when o_orderpriority = '2-HIGH' then 'Comercial'
                when o_orderpriority = '3-MEDIUM' then 'Microcredito'
                else 'Hipotecario' end as tipo_credito,
           case when o_orderstatus='F' then 'Pagado'
                when o_orderstatus='P' and o_orderkey%5=0 then 'Vencido'
                when o_orderstatus='P' and o_orderkey%5=1 then 'En Litigio'
                else 'Vigente' end as estado,
           cast(case when o_orderstatus='F' then 0 else o_totalprice end as decimal(15,2))
               as saldo_pendiente_usd,
           {term} as cuotas_totales,
           cast(case when o_orderstatus='F' then {term} else o_orderkey%12 end as int)
               as cuotas_pagadas
    from {{orders}}"""


def _pagos_creditos(d: Dialect) -> str:
    return """
    select id, credito_id, monto_pago_usd, fecha_pago, dias_atraso,
           case when dias_atraso=0 then 'A Tiempo' when dias_atraso>30 then 'No Pagado'
                else 'Atrasado' end as estado_pago
    from (select 8*l_orderkey+l_linenumber as id,
                 l_orderkey as credito_id,
                 cast(case when l_returnflag='N' then l_extendedprice else 0 end as decimal(15,2))
                     as monto_pago_usd,
                 cast(l_shipdate as date) as fecha_pago,
                 case when l_returnflag='N' then 0
                      when l_returnflag='A' then 15+cast(l_quantity as int)%16
                      else 29+2*cast(l_quantity as int) end as dias_atraso
          from {lineitem}) as graded"""


_DATE_COLUMNS = {"lineitem": "l_shipdate", "orders": "o_orderdate", "events": "ts"}


def _macro(tables: tuple[str, ...]) -> str:
    days = " union all ".join(
        f"select cast({_DATE_COLUMNS[t]} as date) as fecha from {{{t}}}" for t in tables
    )
    return f"""
    select fecha,
           {official_rate("fecha")} as tasa_bcv_usd_ves,
           {parallel_rate("fecha")} as tasa_paralela_usd_ves,
           cast(1+(extract(month from fecha)*13+extract(year from fecha)*7)%8 as decimal(5,2))
               as inflacion_mensual_pct,
           cast((extract(month from fecha)*5+extract(year from fecha)*3)%5-1 as decimal(5,2))
               as variacion_pib_mensual_pct,
           cast(30+extract(doy from fecha)%13 as decimal(5,2)) as tasa_activa_ves_anual,
           cast(10+extract(doy from fecha)%7 as decimal(5,2)) as tasa_pasiva_ves_anual
    from (select distinct fecha from ({days}) as seen) as calendar"""


def _indicadores_macro(d: Dialect) -> str:
    return _macro(("lineitem", "orders", "events"))


def _resumen_liquidez_diario(d: Dialect) -> str:
    def total(condition: str = "") -> str:
        part = f"case when {condition} then price else 0 end" if condition else "price"
        return f"cast(sum({part}) as decimal(20,2))"

    return f"""
    select fecha, total_depositos_ves, total_depositos_usd, total_creditos_ves,
           total_creditos_usd, disponible_caja_ves, encaje_legal_bcv_ves,
           cast(floor(cast(disponible_caja_ves as double)
                      /(cast(total_depositos_ves as double)+1e0)*1e4+0.5e0)/1e4 as decimal(8,4))
               as tasa_liquidez,
           cast(floor(cast(disponible_caja_ves-encaje_legal_bcv_ves as double)
                      /cast(tasa as double)*1e2+0.5e0)/1e2 as decimal(18,2))
               as brecha_liquidez_usd
    from (select sums.*,
                 cast(total_depositos_ves*cast(0.73 as decimal(3,2)) as decimal(20,2))
                     as encaje_legal_bcv_ves,
                 {official_rate("fecha")} as tasa
          from (select fecha,
                       {total()} as total_depositos_ves,
                       {total("l_returnflag='R'")} as total_depositos_usd,
                       {total("l_returnflag='A'")} as total_creditos_ves,
                       {total("l_returnflag='N'")} as total_creditos_usd,
                       {total("l_linestatus='F'")} as disponible_caja_ves
                from (select cast(l_shipdate as date) as fecha, l_returnflag, l_linestatus,
                             cast(l_extendedprice as decimal(18,2)) as price
                      from {{lineitem}}) as lines
                group by fecha) as sums) as daily"""


def _operaciones_tesoreria(d: Dialect) -> str:
    return """
    select o_orderkey as id,
           cast(o_orderdate as date) as fecha,
           case when o_orderstatus='F' then 'Colocacion Interbancaria'
                when o_orderstatus='O' then 'Compra Divisas BCV'
                when o_orderkey%2=0 then 'Inversion Corto Plazo'
                else 'Venta Divisas' end as tipo_operacion,
           cast(o_totalprice as decimal(15,2)) as monto_usd,
           cast(20+o_orderkey%20 as decimal(5,2)) as tasa_anual,
           cast(case when o_orderstatus='F' then 1 else 7*(1+o_orderkey%3) end as int)
               as plazo_dias,
           concat('Contraparte ', cast(o_orderkey%5 as varchar(10))) as contraparte
    from {orders}"""


def _flujos_entidad(d: Dialect) -> str:
    """Daily flows of several banks (the regions), input of the cash roll-forward."""
    return f"""
    select r_name as entidad,
           fecha,
           {official_rate("fecha")} as tasa_bcv_usd_ves,
           flujo_neto_usd, total_depositos_ves, total_depositos_usd
    from (select n_regionkey, fecha,
                 cast(sum(case when l_linestatus='F' then price else -price end)
                      as decimal(20,2)) as flujo_neto_usd,
                 cast(sum(price) as decimal(20,2)) as total_depositos_ves,
                 cast(sum(case when l_returnflag='R' then price else 0 end)
                      as decimal(20,2)) as total_depositos_usd
          from (select l_suppkey, cast(l_shipdate as date) as fecha, l_returnflag, l_linestatus,
                       cast(l_extendedprice as decimal(18,2)) as price
                from {{lineitem}}) as lines
               join {{supplier}} on l_suppkey = s_suppkey
               join {{nation}} on s_nationkey = n_nationkey
          group by n_regionkey, fecha) as sums
         join {{region}} on n_regionkey = r_regionkey"""


def _centroides(d: Dialect) -> str:
    """A point per state of residence (a parameter table of the distance feature)."""
    return """
    select n_name as estado_residencia,
           cast(10+n_nationkey%5 as double) as latitud_base,
           cast(-66-n_nationkey%7 as double) as longitud_base
    from {nation}"""


_TEXTS: dict[str, Callable[[Dialect], str]] = {
    "clientes": _clientes,
    "cuentas": _cuentas,
    "transacciones": _transacciones,
    "creditos": _creditos,
    "pagos_creditos": _pagos_creditos,
    "indicadores_macro": _indicadores_macro,
    "resumen_liquidez_diario": _resumen_liquidez_diario,
    "operaciones_tesoreria": _operaciones_tesoreria,
    "flujos_entidad": _flujos_entidad,
    "centroides": _centroides,
}


def checker_tables(*names: str) -> str:
    """A WITH list defining the named bank tables for the checking database."""
    bodies = []
    for name in names:
        text = _TEXTS[name](CHECKER).format(**{s: s for s in SOURCES})
        bodies.append(f"{name} as ({text})")
    return ",\n".join(bodies)


class Bank:
    """Bank tables over one folder of the given tables; nothing is read until used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def _table(self, text: str) -> DataFrame:
        used = {s: self.raw(s) for s in SOURCES if f"{{{s}}}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def clientes(self) -> DataFrame:
        return self._table(_clientes(SPARK))

    @cached_property
    def cuentas(self) -> DataFrame:
        return self._table(_cuentas(SPARK))

    @cached_property
    def transacciones(self) -> DataFrame:
        return self._table(_transacciones(SPARK))

    @cached_property
    def creditos(self) -> DataFrame:
        return self._table(_creditos(SPARK))

    @cached_property
    def pagos_creditos(self) -> DataFrame:
        return self._table(_pagos_creditos(SPARK))

    @cached_property
    def indicadores_macro(self) -> DataFrame:
        return self._table(_indicadores_macro(SPARK))

    def macro_for(self, *tables: str) -> DataFrame:
        """The macro rows of the dates in some tables: saves reading the other ones."""
        return self._table(_macro(tables))

    @cached_property
    def resumen_liquidez_diario(self) -> DataFrame:
        return self._table(_resumen_liquidez_diario(SPARK))

    @cached_property
    def operaciones_tesoreria(self) -> DataFrame:
        return self._table(_operaciones_tesoreria(SPARK))

    @cached_property
    def flujos_entidad(self) -> DataFrame:
        return self._table(_flujos_entidad(SPARK))

    @cached_property
    def centroides(self) -> DataFrame:
        return self._table(_centroides(SPARK))

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The eight bank tables by name."""
        from caudal.sources.schemas import TABLES

        return {name: getattr(self, name) for name in TABLES}
