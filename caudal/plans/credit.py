"""Queries on clients, deposits, loans and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.operators import ledger as L
from caudal.operators import portfolio as P
from caudal.operators.support import new_folder
from caudal.plans.registry import Query, sql_instalment, sql_pct
from caudal.sources.adapters import Bank
from caudal.sources.keyed import load_keyed, store_keyed

BAD = "estado in ('Vencido', 'En Litigio')"
AS_OF = "2024-01-15"
DUE_DAY = "1999-05-15"
LOAN_DAY = "1995-09-15"  # early enough for clients without an open loan

_BALANCES = """select id, saldo_actual + coalesce(
                    (select sum(case when tipo_transaccion='Deposito Taquilla' then monto
                                     else -monto end)
                     from transacciones where cuenta_id=cuentas.id and estado='Completada'), 0)
                  saldo_actual
           from cuentas"""


def _balances_written(b: Bank) -> DataFrame:
    """Accounts stored by ranges of ids, updated in place, and read back with the ranges rewritten.

    The folder stays while the session lasts, as the answer is read from it.
    """
    folder = new_folder(b.spark, "cuentas")
    store_keyed(b.cuentas, folder, ids=1000)
    ranges = P.write_balances(
        b.spark, folder, L.closing_balances(b.transacciones, load_keyed(b.spark, folder))
    )
    return load_keyed(b.spark, folder).withColumn("rangos", F.lit(ranges))


QUERIES: dict[str, Query] = {
    "client_kpis": Query(
        "total_clientes:l clientes_inactivos:l churn_rate_pct:d2",
        lambda b: P.client_kpis(b.clientes),
        "clientes",
        f"""select n as total_clientes, gone as clientes_inactivos,
                   {sql_pct("gone", "n")} as churn_rate_pct
            from (select count(*) n, count(*) filter (estado_cliente='Inactivo') gone
                  from clientes)""",
    ),
    "deposits_by_currency": Query(
        "VES:d USD:d",
        lambda b: P.deposits_by_currency(b.cuentas),
        "cuentas",
        """select coalesce(sum(saldo_actual) filter (moneda='VES'), 0) as "VES",
                  coalesce(sum(saldo_actual) filter (moneda='USD'), 0) as "USD"
           from cuentas where estado_cuenta='Activa'""",
    ),
    "credit_kpis": Query(
        "total_prestamos:l prestamos_default:l monto_total_usd:d monto_default_usd:d "
        "default_rate_pct:d2",
        lambda b: P.credit_kpis(b.creditos),
        "creditos",
        f"""select n as total_prestamos, bad as prestamos_default, total as monto_total_usd,
                   lost as monto_default_usd, {sql_pct("bad", "n")} as default_rate_pct
            from (select count(*) n, count(*) filter ({BAD}) bad, sum(monto_aprobado_usd) total,
                         sum(saldo_pendiente_usd) filter ({BAD}) lost from creditos)""",
    ),
    "default_by_score_band": Query(
        "rango:t total:l defaults:l tasa_default:d2",
        lambda b: P.default_by_score_band(b.creditos, b.clientes),
        "creditos clientes",
        f"""select rango, n as total, bad as defaults, {sql_pct("bad", "n")} as tasa_default
            from (select lo.rango, count(*) n, count(*) filter (cr.{BAD}) bad
                  from creditos cr join clientes cl on cl.id=cr.cliente_id
                  join (values (750, 99999, '750+'), (680, 750, '680-749'), (600, 680, '600-679'),
                               (500, 600, '500-599'), (-1, 500, '300-499')) lo(a, z, rango)
                    on cl.score_credito>=lo.a and cl.score_credito<lo.z
                  group by lo.rango)""",
    ),
    "default_by_activity": Query(
        "actividad:t total:l defaults:l tasa_default:d2",
        lambda b: P.default_by_activity(b.creditos, b.clientes),
        "creditos clientes",
        f"""select actividad, n as total, bad as defaults, {sql_pct("bad", "n")} as tasa_default
            from (select actividad_economica actividad, count(*) n, count(*) filter ({BAD}) bad
                  from creditos join clientes on clientes.id=cliente_id group by all)""",
    ),
    "portfolio_by_type_status": Query(
        "tipo:t estado:t cantidad:l saldo_usd:d",
        lambda b: P.portfolio_by_type_status(b.creditos),
        "creditos",
        """select tipo_credito tipo, estado, count(*) cantidad, sum(saldo_pendiente_usd) saldo_usd
           from creditos group by all""",
    ),
    "delinquency_monthly": Query(
        "mes:t total_pagos:l impagos:l tasa_morosidad:d2 promedio_dias_atraso:d1 "
        "mora_mayor_90:l tasa_mora_mayor_90:d2",
        lambda b: P.delinquency_monthly(b.pagos_creditos),
        "pagos_creditos",
        f"""select mes, n as total_pagos, bad as impagos, {sql_pct("bad", "n")} tasa_morosidad,
                   cast(late as double)/cast(n as double) promedio_dias_atraso,
                   serious as mora_mayor_90, {sql_pct("serious", "n")} tasa_mora_mayor_90
            from (select strftime(fecha_pago, '%Y-%m') mes, count(*) n, sum(dias_atraso) late,
                         count(*) filter (estado_pago<>'A Tiempo') bad,
                         count(*) filter (dias_atraso>90) serious
                  from pagos_creditos group by 1)""",
    ),
    "delinquency_vs_inflation": Query(
        "mes:t tasa_morosidad:d2 tasa_mora_mayor_90:d2 inflacion_pct:d2",
        lambda b: P.delinquency_vs_inflation(b.pagos_creditos, b.indicadores_macro),
        "pagos_creditos indicadores_macro",
        f"""select mes, {sql_pct("bad", "n")} tasa_morosidad,
                   {sql_pct("serious", "n")} tasa_mora_mayor_90, inflacion_pct
            from (select strftime(fecha_pago, '%Y-%m') mes, count(*) n,
                         count(*) filter (dias_atraso>0) bad,
                         count(*) filter (dias_atraso>90) serious
                  from pagos_creditos group by 1)
            join (select strftime(fecha, '%Y-%m') mes,
                         cast(sum(inflacion_mensual_pct) as double)/count(*) inflacion_pct
                  from indicadores_macro group by 1) using (mes)""",
    ),
    "risk_profile": Query(
        "nivel_riesgo_interno:t clientes:l",
        lambda b: P.risk_profile(b.clientes),
        "clientes",
        "select nivel_riesgo_interno, count(*) clientes from clientes group by 1",
    ),
    "dollarization": Query(
        "depositos_ves:d depositos_usd:d tasa_bcv:d depositos_ves_en_usd:d2 "
        "indice_dolarizacion_pct:d2",
        lambda b: P.dollarization(b.cuentas, b.indicadores_macro),
        "cuentas indicadores_macro",
        """select v depositos_ves, u depositos_usd, t tasa_bcv,
                  cast(v as double)/cast(t as double) depositos_ves_en_usd,
                  100e0*cast(u as double)/(cast(u as double)+cast(v as double)/cast(t as double))
                      indice_dolarizacion_pct
           from (select sum(saldo_actual) filter (moneda='VES') v,
                        sum(saldo_actual) filter (moneda='USD') u
                 from cuentas where estado_cuenta='Activa'),
                (select tasa_bcv_usd_ves t from indicadores_macro order by fecha desc limit 1)""",
    ),
    "commercial_balance": Query(
        "depositos_totales_usd:d2 creditos_aprobados_usd:d creditos_abiertos_usd:d",
        lambda b: P.commercial_balance(b.cuentas, b.creditos, b.indicadores_macro),
        "cuentas creditos indicadores_macro",
        """select cast(sum(saldo_actual) filter (moneda='USD') as double)
                  + cast(sum(saldo_actual) filter (moneda='VES') as double)
                    /(select cast(tasa_bcv_usd_ves as double) from indicadores_macro
                      order by fecha desc limit 1) depositos_totales_usd,
                  (select sum(monto_aprobado_usd) from creditos) creditos_aprobados_usd,
                  (select sum(saldo_pendiente_usd) from creditos
                   where estado in ('Vigente', 'Vencido')) creditos_abiertos_usd
           from cuentas where estado_cuenta='Activa'""",
    ),
    "inflation_delay_corr": Query(
        "pagos:l correlacion:d6",
        lambda b: P.inflation_delay_corr(b.pagos_creditos, b.macro_for("lineitem")),
        "pagos_creditos indicadores_macro",
        """select count(*) pagos, corr(cast(inflacion_mensual_pct as double),
                                       cast(dias_atraso as double)) correlacion
           from pagos_creditos join indicadores_macro on fecha=fecha_pago""",
    ),
    "default_volatility": Query(
        "actividad:t meses:l volatilidad_pct:d6",
        lambda b: P.default_volatility(b.creditos, b.clientes, b.indicadores_macro),
        "creditos clientes indicadores_macro",
        f"""select actividad, count(*) meses, stddev_pop(tasa) volatilidad_pct
            from (select actividad_economica actividad, strftime(fecha_otorgamiento, '%Y-%m') mes,
                         100e0*avg(case when {BAD} then 1e0 else 0e0 end) tasa
                  from creditos join clientes on clientes.id=cliente_id
                  where strftime(fecha_otorgamiento, '%Y-%m') in
                    (select strftime(fecha, '%Y-%m') from indicadores_macro
                     group by 1 having avg(variacion_pib_mensual_pct)<0)
                  group by 1, 2)
            group by 1""",
    ),
    "open_loan_balance": Query(
        "fecha:f total_creditos_usd:d total_creditos_ves:d2",
        lambda b: P.open_loan_balance(b.creditos, b.indicadores_macro),
        "creditos indicadores_macro",
        """with vivos as (select fecha_otorgamiento f, sum(saldo_pendiente_usd) s from creditos
                          where estado='Vigente' or estado='Vencido' group by 1)
           select m.fecha, sum(s) total_creditos_usd,
                  cast(sum(s) as double)*cast(any_value(m.tasa_bcv_usd_ves) as double)
                      total_creditos_ves
           from indicadores_macro m join vivos on f<=m.fecha
           where m.fecha<=(select max(f) from vivos)
           group by m.fecha""",
    ),
    "risk_tier": Query(
        "id:l nivel_calculado:t nivel_riesgo_interno:t",
        lambda b: P.risk_tier(b.clientes),
        "clientes",
        """select id, case when score_credito<=700 or ingresos_mensuales_usd<=1000 then
                     case when score_credito<500 then 'Alto'
                          when ingresos_mensuales_usd<200 then 'Alto' else 'Medio' end
                   else 'Bajo' end nivel_calculado, nivel_riesgo_interno
           from clientes""",
    ),
    "loan_eligible": Query(
        "id:l score_credito:l",
        lambda b: P.loan_eligible(b.clientes, b.creditos, LOAN_DAY),
        "clientes creditos",
        f"""select id, score_credito from clientes c
            where estado_cliente='Activo' and score_credito>580
              and fecha_registro<=date '{LOAN_DAY}'
              and not exists (select 1 from creditos where cliente_id=c.id
                              and fecha_otorgamiento<=date '{LOAN_DAY}'
                              and estado not in ('Pagado', 'En Litigio'))""",
    ),
    "preferred_account": Query(
        "cliente_id:l cuenta_desembolso:l cuenta_cobro:l",
        lambda b: P.preferred_account(b.cuentas),
        "cuentas",
        """select cliente_id,
                  coalesce(min(id) filter (moneda='USD'), min(id)) cuenta_desembolso,
                  coalesce(min(id) filter (moneda='USD' and estado_cuenta='Activa'),
                           min(id) filter (estado_cuenta='Activa')) cuenta_cobro
           from cuentas group by 1""",
    ),
    "merge_balances": Query(
        "id:l saldo_actual:d",
        lambda b: P.merge_balances(
            b.cuentas, L.closing_balances(b.transacciones, b.cuentas)
        ),
        "cuentas transacciones",
        _BALANCES,
    ),
    "balances_written": Query(
        "id:l cliente_id:l saldo_actual:d rangos:l",
        _balances_written,
        "cuentas transacciones",
        f"""select m.id, cliente_id, m.saldo_actual,
                   (select count(distinct cuentas.id//1000) from cuentas
                    join transacciones on cuenta_id=cuentas.id) rangos
            from ({_BALANCES}) m join cuentas on cuentas.id=m.id""",
    ),
    "active_accounts_daily": Query(
        "moneda:t fecha:f cuentas_activas:l",
        lambda b: P.active_accounts_daily(b.cuentas),
        "cuentas",
        """with activas as (select * from cuentas where estado_cuenta='Activa'),
                dias as (select cast(unnest(generate_series(
                           (select min(fecha_apertura) from activas)::timestamp,
                           (select max(fecha_apertura) from activas)::timestamp,
                           interval 1 day)) as date) fecha)
           select moneda, fecha, count(*) cuentas_activas
           from dias join activas on fecha_apertura<=fecha group by all""",
    ),
    "loan_maturity": Query(
        "id:l fecha_otorgamiento:f fecha_vencimiento:f",
        lambda b: P.loan_maturity(b.creditos),
        "creditos",
        """select id, fecha_otorgamiento,
                  fecha_otorgamiento + cast(plazo_meses*30 as int) fecha_vencimiento
           from creditos""",
    ),
    "loan_macro_context": Query(
        "id:l fecha_otorgamiento:f inflacion_mensual_pct:d variacion_pib_mensual_pct:d "
        "tasa_bcv_usd_ves:d",
        lambda b: P.loan_macro_context(b.creditos, b.macro_for("orders")),
        "creditos indicadores_macro",
        """select c.id, fecha_otorgamiento, inflacion_mensual_pct, variacion_pib_mensual_pct,
                  tasa_bcv_usd_ves
           from creditos c, indicadores_macro m where m.fecha=c.fecha_otorgamiento""",
    ),
    "expected_default": Query(
        "id:l prob_default:d6",
        lambda b: P.expected_default(b.creditos, b.clientes, b.macro_for("orders")),
        "creditos clientes indicadores_macro",
        """select c.id, (case when inflacion_mensual_pct>3
                              then 0.05e0*cast(inflacion_mensual_pct as double)/3e0
                              else 0.05e0 end)
                        + (case when score_credito<500 then 0.2e0
                                when score_credito<600 then 0.08e0 else 0e0 end) prob_default
           from creditos c join clientes k on k.id=c.cliente_id
                join indicadores_macro on fecha=fecha_otorgamiento""",
    ),
    "instalments_due": Query(
        "credito_id:l cuota_no:l fecha_cuota:f",
        lambda b: P.instalments_due(b.creditos),
        "creditos",
        """select credito_id, row_number() over (partition by credito_id order by d) cuota_no,
                  d fecha_cuota
           from (select id credito_id, plazo_meses, fecha_otorgamiento f,
                        cast(unnest(generate_series(fecha_otorgamiento::timestamp,
                             fecha_otorgamiento::timestamp + to_months(2*plazo_meses),
                             interval 1 day)) as date) d
                 from (select distinct id, plazo_meses, fecha_otorgamiento from creditos))
           where day(d)=day(f) qualify cuota_no<=plazo_meses""",
    ),
    "instalments_due_on": Query(
        "credito_id:l cliente_id:l cuota_mensual:d6",
        lambda b: P.instalments_due_on(b.creditos, DUE_DAY),
        "creditos",
        f"""select id credito_id, cliente_id, {sql_instalment()} cuota_mensual from creditos
            where estado not in ('Pagado', 'En Litigio')
              and day(fecha_otorgamiento)=day(date '{DUE_DAY}')
              and fecha_otorgamiento<=date '{DUE_DAY}'""",
    ),
    "payment_class": Query(
        "estado_pago:t mora_mayor_90:l pagos:l min_dias:l max_dias:l",
        lambda b: P.payment_class(b.pagos_creditos),
        "pagos_creditos",
        """select case when dias_atraso>30 then 'No Pagado' when dias_atraso>0 then 'Atrasado'
                       else 'A Tiempo' end estado_pago,
                  cast(dias_atraso>90 as int) mora_mayor_90,
                  count(*) pagos, min(dias_atraso) min_dias, max(dias_atraso) max_dias
           from pagos_creditos group by 1, 2""",
    ),
    "french_instalment": Query(
        "id:l cuota_mensual:d6",
        lambda b: P.instalment(b.creditos),
        "creditos",
        f"select id, {sql_instalment()} cuota_mensual from creditos",
    ),
    "loan_balance_path": Query(
        "credito_id:l fecha_pago:f cuota_no:l saldo_usd:d4",
        lambda b: P.loan_balance_path(b.creditos, b.pagos_creditos),
        "creditos pagos_creditos",
        """select credito_id, fecha_pago, k cuota_no,
                  greatest(0e0, p - k*(p/n)) saldo_usd
           from (select credito_id, fecha_pago, cuotas_totales n,
                        cast(monto_aprobado_usd as double) p,
                        row_number() over (partition by credito_id order by fecha_pago) k
                 from pagos_creditos join creditos on creditos.id=credito_id
                 where estado_pago='A Tiempo')""",
    ),
    "late_surcharge": Query(
        "credito_id:l cuotas_impagas:l recargo_usd:d4",
        lambda b: P.late_surcharge(b.creditos, b.pagos_creditos),
        "creditos pagos_creditos",
        f"""select c.id credito_id, count(*) cuotas_impagas,
                   sum(0.05e0*{sql_instalment()}) recargo_usd
            from creditos c join pagos_creditos p on p.credito_id=c.id
            where p.estado_pago<>'A Tiempo' group by 1""",
    ),
    "loan_summary": Query(
        "credito_id:l cuotas_pagadas:l saldo_pendiente_usd:d4 estado:t",
        lambda b: P.loan_summary(b.creditos, b.pagos_creditos),
        "creditos pagos_creditos",
        f"""with pagadas as (select credito_id, count(*) k, max(fecha_pago) ultimo
                             from pagos_creditos where estado_pago='A Tiempo' group by 1),
                 impagas as (select p.credito_id, count(*) m
                             from pagos_creditos p left join pagadas g using (credito_id)
                             where estado_pago<>'A Tiempo'
                               and p.fecha_pago>coalesce(ultimo, date '0001-01-01') group by 1)
            select c.id credito_id, coalesce(k, 0) cuotas_pagadas,
                   case when coalesce(k, 0)>=cuotas_totales then 'Pagado' else estado end estado,
                   greatest(0e0, cast(monto_aprobado_usd as double)
                     - coalesce(k, 0)*(cast(monto_aprobado_usd as double)/cuotas_totales))
                   + coalesce(m, 0)*0.05e0*{sql_instalment()} saldo_pendiente_usd
            from creditos c left join pagadas on pagadas.credito_id=c.id
                 left join impagas on impagas.credito_id=c.id""",
    ),
}
