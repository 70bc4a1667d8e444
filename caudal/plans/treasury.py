"""Queries on the macro series, daily liquidity and treasury."""

from __future__ import annotations

from pyspark.sql import functions as F

from caudal.functions.calendar import day_range
from caudal.operators import liquidity as Q
from caudal.operators.daily import daily_liquidity
from caudal.plans import credit, ledger
from caudal.plans.registry import Query

_DAILY = "resumen_liquidez_diario"


def _mean(column: str, factor: str = "1e0") -> str:
    return f"cast(sum({column}) as double)/count(*)*{factor}"


# The daily levels with gaps filled, as the checking database sees them.
_FILLED = """
    select dias.fecha, d.total_depositos_ves, d.total_depositos_usd, d.brecha_liquidez_usd
    from (select cast(unnest(generate_series(min(fecha)::timestamp, max(fecha)::timestamp,
                                             interval 1 day)) as date) fecha
          from resumen_liquidez_diario) dias
    asof join resumen_liquidez_diario d on dias.fecha>=d.fecha"""

_LAGS = ", ".join(
    f"lag({c}, {n}) over (order by fecha) {c}_t{n}"
    for c in ("total_depositos_ves", "total_depositos_usd")
    for n in (1, 7, 30)
)
_LAG_OUTPUT = " ".join(
    f"{c}_t{n}:d" for c in ("total_depositos_ves", "total_depositos_usd") for n in (1, 7, 30)
)

_ROLL = """
    with recursive filas as (
           select entidad, fecha, cast(tasa_bcv_usd_ves as double) tasa,
                  cast(flujo_neto_usd as double) flujo, cast(total_depositos_ves as double) ves,
                  cast(total_depositos_usd as double) usd,
                  row_number() over (partition by entidad order by fecha) k
           from flujos_entidad),
         pasos as (
           select entidad, cast(0 as bigint) k, null::date fecha, 20000000e0 caja, 0e0 encaje,
                  0e0 razon, 0e0 brecha, 0e0 fondeo, 0e0 inversion
           from filas where k=1
           union all
           select entidad, k, fecha,
                  case when brecha<0 then base + (abs(brecha)*1.1e0)*tasa
                       when brecha>usd*0.2e0 then base - (brecha*0.5e0)*tasa else base end,
                  encaje, razon, brecha,
                  case when brecha<0 then abs(brecha)*1.1e0 end,
                  case when brecha>=0 and brecha>usd*0.2e0 then brecha*0.5e0 end
           from (select *, base/(ves+1e0) razon, (base-encaje)/tasa brecha
                 from (select f.*, greatest(f.ves*0.05e0, p.caja + f.flujo*f.tasa) base,
                              f.ves*0.73e0 encaje
                       from pasos p join filas f on f.entidad=p.entidad and f.k=p.k+1)))"""

QUERIES: dict[str, Query] = {
    "macro_monthly": Query(
        "mes:t bcv:d2 paralela:d2 inflacion_pct:d2 pib_var_pct:d2 tasa_activa:d2 tasa_pasiva:d2",
        lambda b: Q.macro_monthly(b.indicadores_macro),
        "indicadores_macro",
        f"""select strftime(fecha, '%Y-%m') mes, {_mean("tasa_bcv_usd_ves")} bcv,
                   {_mean("tasa_paralela_usd_ves")} paralela,
                   {_mean("inflacion_mensual_pct")} inflacion_pct,
                   {_mean("variacion_pib_mensual_pct")} pib_var_pct,
                   {_mean("tasa_activa_ves_anual")} tasa_activa,
                   {_mean("tasa_pasiva_ves_anual")} tasa_pasiva
            from indicadores_macro group by 1""",
    ),
    "fx_spread": Query(
        "fecha:f brecha:d6",
        lambda b: Q.fx_spread(b.indicadores_macro),
        "indicadores_macro",
        """select fecha, cast(tasa_paralela_usd_ves as double)/cast(tasa_bcv_usd_ves as double)
                         - 1e0 brecha from indicadores_macro""",
    ),
    "fx_devaluation": Query(
        "fecha:f tasa_bcv_usd_ves:d cambio:d devaluacion_pct:d6 brecha:d6",
        lambda b: Q.fx_devaluation(b.indicadores_macro),
        "indicadores_macro",
        """select a.fecha, a.tasa_bcv_usd_ves, a.tasa_bcv_usd_ves-p.tasa_bcv_usd_ves cambio,
                  100e0*cast(a.tasa_bcv_usd_ves-p.tasa_bcv_usd_ves as double)
                       /cast(p.tasa_bcv_usd_ves as double) devaluacion_pct,
                  cast(a.tasa_paralela_usd_ves as double)/cast(a.tasa_bcv_usd_ves as double)-1e0
                      brecha
           from indicadores_macro a asof left join indicadores_macro p on a.fecha>p.fecha""",
    ),
    "month_rate_lookup": Query(
        "mes:t pagos:l inflacion_pct:d6 pib_var_pct:d6",
        lambda b: Q.month_rate_lookup(
            b.pagos_creditos.groupBy("fecha_pago").agg(F.count("*").alias("n")),
            "fecha_pago", b.indicadores_macro,
        ).groupBy("mes").agg(
            F.sum("n").alias("pagos"), F.max("inflacion_pct").alias("inflacion_pct"),
            F.max("pib_var_pct").alias("pib_var_pct"),
        ),
        "pagos_creditos indicadores_macro",
        """with meses as (select strftime(fecha, '%Y-%m') mes,
                                 avg(cast(inflacion_mensual_pct as double)) i,
                                 avg(cast(variacion_pib_mensual_pct as double)) g
                          from indicadores_macro group by 1)
           select p.mes, n pagos, coalesce(i, 2e0) inflacion_pct, coalesce(g, 0.5e0) pib_var_pct
           from (select strftime(fecha_pago, '%Y-%m') mes, count(*) n from pagos_creditos
                 group by 1) p left join meses m on m.mes=p.mes""",
    ),
    "calendar_features": Query(
        "fecha:f quincena:l diciembre:l fin_semana:l multiplicador:d actividad_ves:d "
        "actividad_usd:d",
        lambda b: Q.calendar_features(
            day_range(
                b.creditos.agg(
                    F.min("fecha_otorgamiento").alias("a"), F.max("fecha_otorgamiento").alias("z")
                ),
                "a", "z",
            )
        ),
        "creditos",
        """with dias as (select cast(unnest(generate_series(min(fecha_otorgamiento)::timestamp,
                           max(fecha_otorgamiento)::timestamp, interval 1 day)) as date) fecha
                         from creditos),
                marcas as (select fecha,
                             cast(day(fecha) in (15, 30) or strftime(fecha, '%m%d')='0228' as int) q,
                             cast(strftime(fecha, '%m')='12' as int) d,
                             cast(isodow(fecha)>5 as int) w from dias)
           select fecha, q quincena, d diciembre, w fin_semana, m multiplicador,
                  least(0.95e0, 0.22e0*m) actividad_ves, least(0.4e0, 0.08e0*m) actividad_usd
           from (select *, (1e0+q)*(1e0+d*1.8e0)*(case when w=1 then 1.2e0 else 1e0 end) m
                 from marcas)""",
    ),
    "liquidity_weekly": Query(
        "semana:t fecha:f depositos_ves:d2 depositos_usd:d2 disponible_ves:d2 encaje_ves:d2 "
        "tasa_liquidez:d2",
        lambda b: Q.liquidity_weekly(b.resumen_liquidez_diario),
        _DAILY,
        f"""select strftime(fecha, '%Y-%W') semana, min(fecha) fecha,
                   {_mean("total_depositos_ves")} depositos_ves,
                   {_mean("total_depositos_usd")} depositos_usd,
                   {_mean("disponible_caja_ves")} disponible_ves,
                   {_mean("encaje_legal_bcv_ves")} encaje_ves,
                   {_mean("tasa_liquidez", "100e0")} tasa_liquidez
            from resumen_liquidez_diario group by 1""",
    ),
    "liquidity_ratios": Query(
        "fecha:f encaje_ves:d4 caja_minima_ves:d4 tasa_liquidez:d6 brecha_usd:d4 "
        "depositos_utilizables_ves:d4 deficit:l",
        lambda b: Q.liquidity_ratios(b.resumen_liquidez_diario, b.macro_for("lineitem")),
        f"{_DAILY} indicadores_macro",
        """select fecha, v*0.73e0 encaje_ves, v*0.05e0 caja_minima_ves, c/(v+1e0) tasa_liquidez,
                  (c-v*0.73e0)/t brecha_usd, v-v*0.73e0 depositos_utilizables_ves,
                  cast(c<v*0.73e0 as int) deficit
           from (select fecha, cast(total_depositos_ves as double) v,
                        cast(disponible_caja_ves as double) c, cast(tasa_bcv_usd_ves as double) t
                 from resumen_liquidez_diario join indicadores_macro using (fecha))""",
    ),
    "liquidity_lags": Query(
        f"fecha:f total_depositos_ves:d total_depositos_usd:d {_LAG_OUTPUT}",
        lambda b: Q.liquidity_lags(
            b.resumen_liquidez_diario, ["total_depositos_ves", "total_depositos_usd"]
        ),
        _DAILY,
        f"""select fecha, total_depositos_ves, total_depositos_usd, {_LAGS} from ({_FILLED})""",
    ),
    "liquidity_features": Query(
        f"fecha:f {_LAG_OUTPUT} brecha:d6 quincena:l diciembre:l brecha_liquidez_usd:d",
        lambda b: Q.liquidity_features(b.resumen_liquidez_diario, b.indicadores_macro),
        f"{_DAILY} indicadores_macro",
        f"""select l.*, cast(tasa_paralela_usd_ves as double)/cast(tasa_bcv_usd_ves as double)
                        - 1e0 brecha,
                   cast(day(fecha) in (15, 30) or strftime(fecha, '%m%d')='0228' as int) quincena,
                   cast(month(fecha)=12 as int) diciembre
            from (select fecha, brecha_liquidez_usd, {_LAGS} from ({_FILLED})) l
                 join indicadores_macro using (fecha)""",
    ),
    "treasury_by_operation": Query(
        "operacion:t cantidad:l volumen_usd:d tasa_promedio:d2",
        lambda b: Q.treasury_by_operation(b.operaciones_tesoreria),
        "operaciones_tesoreria",
        f"""select tipo_operacion operacion, count(*) cantidad, sum(monto_usd) volumen_usd,
                   {_mean("tasa_anual")} tasa_promedio
            from operaciones_tesoreria group by 1""",
    ),
    "treasury_monthly_flow": Query(
        "mes:t fondeo_usd:d inversiones_usd:d",
        lambda b: Q.treasury_monthly_flow(b.operaciones_tesoreria),
        "operaciones_tesoreria",
        """select strftime(fecha, '%Y-%m') mes,
                  coalesce(sum(monto_usd) filter (tipo_operacion like 'Colocacion%'), 0) fondeo_usd,
                  coalesce(sum(monto_usd) filter (tipo_operacion like 'Compra%'
                                                  or tipo_operacion like 'Inversion%'), 0)
                      inversiones_usd
           from operaciones_tesoreria group by 1""",
    ),
    "cash_rollforward": Query(
        "entidad:t fecha:f disponible_caja_ves:d2 encaje_legal_bcv_ves:d2 tasa_liquidez:d4 "
        "brecha_liquidez_usd:d2 fondeo_usd:d2 inversion_usd:d2",
        lambda b: Q.cash_rollforward(b.flujos_entidad),
        "flujos_entidad",
        f"""{_ROLL}
            select entidad, fecha, caja disponible_caja_ves, encaje encaje_legal_bcv_ves,
                   razon tasa_liquidez, brecha brecha_liquidez_usd, fondeo fondeo_usd,
                   inversion inversion_usd
            from pasos where k>0""",
    ),
    "treasury_operations": Query(
        "entidad:t fecha:f tipo_operacion:t monto_usd:d2 tasa_anual:d2 plazo_dias:l",
        lambda b: Q.treasury_operations(
            Q.cash_rollforward(b.flujos_entidad), b.macro_for("lineitem")
        ),
        "flujos_entidad indicadores_macro",
        f"""{_ROLL}
            select entidad, fecha,
                   case when fondeo is not null then 'Colocacion Interbancaria'
                        else 'Inversion Corto Plazo' end tipo_operacion,
                   coalesce(fondeo, inversion) monto_usd,
                   case when fondeo is not null then cast(tasa_activa_ves_anual as double)*0.9e0
                        else cast(tasa_pasiva_ves_anual as double)*1.2e0 end tasa_anual,
                   case when fondeo is not null then 1 end plazo_dias
            from pasos join indicadores_macro using (fecha)
            where k>0 and coalesce(fondeo, inversion) is not null""",
    ),
}

# Levels of each day with a rate, as the checking database sees them.
_FLOWS = f"""(
    with depositos as ({ledger.QUERIES["daily_deposits"].sql}),
         dias as (select fecha, tasa_bcv_usd_ves from indicadores_macro
                  where fecha between (select min(fecha) from depositos)
                                  and (select max(fecha) from depositos)),
         flujo as ({ledger.QUERIES["daily_net_flow"].sql}),
         creditos_dia as (select fecha, total_creditos_usd
                          from ({credit.QUERIES["open_loan_balance"].sql}))
    select 'banco' entidad, m.fecha, tasa_bcv_usd_ves, coalesce(flujo_neto_usd, 0) flujo_neto_usd,
           coalesce((select arg_max(total_depositos, d.fecha) from depositos d
                     where moneda='VES' and d.fecha<=m.fecha), 0) total_depositos_ves,
           coalesce((select arg_max(total_depositos, d.fecha) from depositos d
                     where moneda='USD' and d.fecha<=m.fecha), 0) total_depositos_usd,
           coalesce((select arg_max(total_creditos_usd, c.fecha) from creditos_dia c
                     where c.fecha<=m.fecha), 0) total_creditos_usd
    from dias m left join flujo using (fecha))"""

QUERIES["daily_liquidity"] = Query(
    "fecha:f total_depositos_ves:d2 total_depositos_usd:d2 total_creditos_ves:d2 "
    "total_creditos_usd:d2 disponible_caja_ves:d2 encaje_legal_bcv_ves:d2 tasa_liquidez:d4 "
    "brecha_liquidez_usd:d2",
    lambda b: daily_liquidity(b.transacciones, b.cuentas, b.creditos, b.indicadores_macro),
    "transacciones cuentas creditos indicadores_macro",
    f"""{_ROLL.replace("flujos_entidad", _FLOWS)}
        select p.fecha, total_depositos_ves, total_depositos_usd,
               cast(total_creditos_usd as double)*cast(tasa_bcv_usd_ves as double)
                   total_creditos_ves,
               total_creditos_usd, caja disponible_caja_ves, encaje encaje_legal_bcv_ves,
               razon tasa_liquidez, brecha brecha_liquidez_usd
        from pasos p join {_FLOWS} f on f.fecha=p.fecha where k>0""",
)
