"""Queries on the transaction ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.operators import ledger as L
from caudal.operators.cube import append_to_cube, kept_cube
from caudal.operators.liquidity import with_last_known
from caudal.operators.replay import authorization_replay
from caudal.operators.support import new_folder
from caudal.plans.registry import Query, sql_instalment, sql_pct
from caudal.sources.adapters import Bank

FEE = 0.02
SALARIED = ("BUILDING", "MACHINERY", "HOUSEHOLD")
RETIREE = "HOUSEHOLD"

_SIGNED = "case when tipo_transaccion='Deposito Taquilla' then monto else -monto end"

_PAYROLL = """
    select cuenta_id, fecha, tasa, usd, cast(usd*tasa as decimal(18,2)) as ves
    from (select a.id cuenta_id, m.fecha, tasa_bcv_usd_ves tasa,
                 case when actividad_economica='HOUSEHOLD' then ingresos_mensuales_usd
                      else cast((cast(ingresos_mensuales_usd*100 as bigint)+1)//2 as decimal(18,2))
                           *cast(0.01 as decimal(3,2)) end as usd
          from cuentas a join clientes c on c.id=a.cliente_id
               join indicadores_macro m on m.fecha>=a.fecha_apertura
          where a.moneda='VES' and a.estado_cuenta='Activa'
            and actividad_economica in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
            and (day(m.fecha) in (15, 30) or strftime(m.fecha, '%m-%d')='02-28')
            and not (actividad_economica='HOUSEHOLD' and day(m.fecha)=30))"""


def _payroll(b: Bank) -> DataFrame:
    return L.payroll_run(b.cuentas, b.clientes, b.indicadores_macro, SALARIED, RETIREE)


def _union(b: Bank) -> DataFrame:
    """The whole ledger of four origins, summed up by origin."""
    parts = {
        "nomina": _payroll(b),
        "ledger": b.transacciones,
        "desembolso": L.loan_payouts(b.creditos, b.cuentas, b.macro_for("orders")),
        "cuota": L.instalment_charges(
            b.creditos, b.pagos_creditos, b.cuentas, b.macro_for("lineitem")
        ),
    }
    whole = L.ledger_union(*parts.values())
    return whole.groupBy("dispositivo_id", "tipo_transaccion", "canal").agg(
        F.count("*").alias("filas"), F.count("cuenta_id").alias("con_cuenta"),
        F.sum("monto_usd").alias("total_usd"), F.min("fecha_hora").alias("primera"),
    ).groupBy(
        F.when(F.col("dispositivo_id") == "SYSTEM", "banco").otherwise("cliente").alias("origen"),
        "tipo_transaccion", "canal",
    ).agg(
        F.sum("filas").alias("filas"), F.sum("con_cuenta").alias("con_cuenta"),
        F.sum("total_usd").alias("total_usd"), F.min("primera").alias("primera"),
    )


QUERIES: dict[str, Query] = {
    "operational_kpis": Query(
        "total_transacciones:l cantidad_fraudes:l monto_fraude_usd:d transacciones_fallidas:l "
        "tasa_falla_pct:d4",
        lambda b: L.operational_kpis(b.transacciones),
        "transacciones",
        f"""select n total_transacciones, f cantidad_fraudes, coalesce(u, 0) monto_fraude_usd,
                   x transacciones_fallidas, {sql_pct("x", "n")} tasa_falla_pct
            from (select count(*) n, count(*) filter (es_fraude=1) f,
                         sum(monto_usd) filter (es_fraude=1) u,
                         count(*) filter (estado='Fallida') x from transacciones)""",
    ),
    "tx_by_channel_status": Query(
        "canal:t estado:t cantidad:l total_usd:d",
        lambda b: L.tx_by_channel_status(b.transacciones),
        "transacciones",
        """select canal, estado, count(*) cantidad, sum(monto_usd) total_usd
           from transacciones group by all""",
    ),
    "fraud_by_channel": Query(
        "canal:t total_txs:l fraudes:l monto_fraude_usd:d tasa_fraude_pct:d4",
        lambda b: L.fraud_by_channel(b.transacciones),
        "transacciones",
        f"""select canal, n total_txs, f fraudes, coalesce(u, 0) monto_fraude_usd,
                   {sql_pct("f", "n")} tasa_fraude_pct
            from (select canal, count(*) n, count(*) filter (es_fraude=1) f,
                         sum(monto_usd) filter (es_fraude=1) u from transacciones group by 1)""",
    ),
    "outage_days": Query(
        "dia:f total_txs:l fallidas:l completadas:l tasa_falla_pct:d2",
        lambda b: L.outage_days(b.transacciones),
        "transacciones",
        f"""select dia, n total_txs, x fallidas, c completadas, {sql_pct("x", "n")} tasa_falla_pct
            from (select cast(fecha_hora as date) dia, count(*) n,
                         count(*) filter (estado='Fallida') x,
                         count(*) filter (estado='Completada') c from transacciones group by 1)
            where 20*x>3*n""",
    ),
    "outage_cost": Query(
        "dia:f fallidas:l volumen_fallido_usd:d costo_usd:d4",
        lambda b: L.outage_cost(b.transacciones, FEE),
        "transacciones",
        f"""select dia, count(*) fallidas, sum(monto_usd) volumen_fallido_usd,
                   cast(sum(monto_usd) as double)*{FEE}e0 costo_usd
            from (select *, cast(fecha_hora as date) dia from transacciones)
            where estado='Fallida' and dia in (
              select cast(fecha_hora as date) from transacciones group by 1
              having 20*count(*) filter (estado='Fallida')>3*count(*))
            group by 1""",
    ),
    "fraud_by_hour": Query(
        "hora:l total_txs:l fraudes:l monto_medio_fraude:d4 monto_medio_legitimo:d4",
        lambda b: L.fraud_by_hour(b.transacciones),
        "transacciones",
        """select hour(fecha_hora) hora, count(*) total_txs, sum(es_fraude) fraudes,
                  cast(sum(case when es_fraude=1 then monto_usd end) as double)
                    /nullif(sum(es_fraude), 0) monto_medio_fraude,
                  cast(sum(case when es_fraude=0 then monto_usd end) as double)
                    /nullif(sum(1-es_fraude), 0) monto_medio_legitimo
           from transacciones group by 1""",
    ),
    "ledger_cube": Query(
        "nivel:t canal:t estado:t dia:f total_txs:l total_usd:d fraudes:l monto_fraude_usd:d "
        "fallidas:l completadas:l",
        lambda b: L.ledger_cube(b.transacciones),
        "transacciones",
        """with t as (select *, cast(fecha_hora as date) d from transacciones),
                p as (select 'canal_estado' nivel, canal, estado, null::date dia, * exclude
                        (canal, estado) from t
                      union all by name select 'canal' nivel, canal, null estado,
                        null::date dia, * exclude (canal, estado), estado e from t
                      union all by name select 'dia' nivel, null canal, null estado, d dia,
                        * exclude (canal, estado), estado e from t
                      union all by name select 'total' nivel, null canal, null estado,
                        null::date dia, * exclude (canal, estado), estado e from t)
           select nivel, canal, estado, dia, count(*) total_txs, sum(monto_usd) total_usd,
                  sum(es_fraude) fraudes, sum(es_fraude*monto_usd) monto_fraude_usd,
                  count(*) filter (coalesce(estado, e)='Fallida') fallidas,
                  count(*) filter (coalesce(estado, e)='Completada') completadas
           from p group by 1, 2, 3, 4""",
    ),
    "daily_net_flow": Query(
        "fecha:f flujo_neto_usd:d",
        lambda b: L.daily_net_flow(b.transacciones),
        "transacciones",
        """select cast(fecha_hora as date) fecha,
                  coalesce(sum(monto_usd) filter (tipo_transaccion='Deposito Taquilla'), 0)
                  - coalesce(sum(monto_usd) filter (tipo_transaccion<>'Deposito Taquilla'), 0)
                  flujo_neto_usd
           from transacciones group by 1""",
    ),
    "top_frauds": Query(
        "id:l fecha_hora:s cedula:t cliente:t monto_usd:d tipo:t canal:t coords:t",
        lambda b: L.top_frauds(b.transacciones, b.cuentas, b.clientes),
        "transacciones cuentas clientes",
        """select t.id, fecha_hora, cedula, nombre || ' ' || apellido cliente, monto_usd,
                  tipo_transaccion tipo, canal, latitud || ', ' || longitud coords
           from transacciones t join cuentas a on a.id=cuenta_id join clientes c on c.id=cliente_id
           where es_fraude=1
           qualify row_number() over (order by monto_usd desc, t.id)<=10""",
    ),
    "fraud_rule": Query(
        "id:l cuenta_id:l monto_usd:d ingresos_mensuales_usd:d",
        lambda b: L.fraud_rule(b.transacciones, b.cuentas, b.clientes),
        "transacciones cuentas clientes",
        """select t.id, cuenta_id, monto_usd, ingresos_mensuales_usd
           from transacciones t join cuentas a on a.id=cuenta_id join clientes c on c.id=cliente_id
           where t.estado='Completada' and hour(fecha_hora) in (1, 2, 3, 4)
             and tipo_transaccion in ('Pago Movil', 'Compra Punto Venta', 'Transferencia')
             and monto_usd*10>ingresos_mensuales_usd*4""",
    ),
    "amount_vs_history": Query(
        "id:l cuenta_id:l monto_usd:d previas:l media_previa:d6 razon:d6",
        lambda b: L.amount_vs_history(b.transacciones),
        "transacciones",
        """select id, cuenta_id, monto_usd, previas, s/nullif(previas, 0) media_previa,
                  cast(monto_usd as double)/nullif(s/nullif(previas, 0), 0) razon
           from (select *, count(*) over w previas, cast(sum(monto_usd) over w as double) s
                 from transacciones
                 window w as (partition by cuenta_id order by fecha_hora, id
                              rows between unbounded preceding and 1 preceding))""",
    ),
    "new_device_flag": Query(
        "id:l cuenta_id:l dispositivo_id:t dispositivo_nuevo:l",
        lambda b: L.new_device_flag(b.transacciones),
        "transacciones",
        """select id, cuenta_id, dispositivo_id,
                  case when row_number() over (partition by cuenta_id, dispositivo_id
                                               order by fecha_hora, id)=1
                        and row_number() over (partition by cuenta_id order by fecha_hora, id)>1
                       then 1 else 0 end dispositivo_nuevo
           from transacciones""",
    ),
    "running_balance": Query(
        "id:l cuenta_id:l saldo:d",
        lambda b: L.running_balance(b.transacciones, b.cuentas),
        "transacciones cuentas",
        f"""select t.id, cuenta_id, saldo_actual
                   + sum(case when estado='Completada' then {_SIGNED} else 0 end)
                     over (partition by cuenta_id order by fecha_hora, t.id
                           rows between unbounded preceding and current row) saldo
            from transacciones t join cuentas a on a.id=cuenta_id""",
    ),
    "daily_deposits": Query(
        "moneda:t fecha:f total_depositos:d",
        lambda b: L.daily_deposits(b.transacciones, b.cuentas),
        "transacciones cuentas",
        f"""with activas as (select * from cuentas where estado_cuenta='Activa'),
                 cambios as (
                   select moneda, fecha_apertura fecha, saldo_actual x from activas
                   union all
                   select moneda, greatest(cast(fecha_hora as date), fecha_apertura), {_SIGNED}
                   from transacciones t join activas a on a.id=cuenta_id
                   where t.estado='Completada'),
                 dias as (select moneda, cast(unnest(generate_series(min(fecha)::timestamp,
                            max(fecha)::timestamp, interval 1 day)) as date) fecha
                          from cambios group by 1)
            select d.moneda, d.fecha, sum(x) total_depositos
            from dias d join cambios c on c.moneda=d.moneda and c.fecha<=d.fecha
            group by all""",
    ),
    "fx_normalize": Query(
        "id:l moneda:t monto:d tasa_cambio:d monto_usd:d en_ves:d2 en_usd:d2",
        lambda b: L.fx_normalize(b.transacciones, b.cuentas),
        "transacciones cuentas",
        """select t.id, moneda, monto, tasa_cambio, monto_usd,
                  case moneda when 'VES' then cast(monto as double)
                       else cast(monto as double)*cast(tasa_cambio as double) end en_ves,
                  case moneda when 'USD' then cast(monto as double)
                       else cast(monto as double)/cast(tasa_cambio as double) end en_usd
           from transacciones t join cuentas c on c.id=cuenta_id""",
    ),
    "clamped_amounts": Query(
        "id:l moneda:t monto_acotado_usd:d",
        lambda b: L.clamped_amounts(b.transacciones, b.cuentas),
        "transacciones cuentas",
        """select t.id, moneda,
                  case when moneda='USD' and monto_usd<5 then 5
                       when moneda='USD' and monto_usd>10000 then 10000
                       when moneda='VES' and monto_usd<1 then 1
                       when moneda='VES' and monto_usd>15000 then 15000
                       else monto_usd end monto_acotado_usd
           from transacciones t join cuentas a on a.id=cuenta_id""",
    ),
    "payroll_run": Query(
        "cuenta_id:l fecha_hora:s monto:d monto_usd:d tasa_cambio:d tipo_transaccion:t canal:t "
        "estado:t dispositivo_id:t",
        _payroll,
        "cuentas clientes indicadores_macro",
        f"""select cuenta_id, fecha + interval '8 hours 30 minutes' fecha_hora, ves monto,
                   usd monto_usd, tasa tasa_cambio, 'Deposito Taquilla' tipo_transaccion,
                   'Taquilla' canal, 'Completada' estado, 'SYSTEM' dispositivo_id
            from ({_PAYROLL})""",
    ),
    "ledger_union": Query(
        "origen:t tipo_transaccion:t canal:t filas:l con_cuenta:l total_usd:d primera:s",
        _union,
        "transacciones cuentas clientes creditos pagos_creditos indicadores_macro",
        f"""with preferida as (
                   select cliente_id,
                          coalesce(min(id) filter (moneda='USD'), min(id)) pago,
                          coalesce(min(id) filter (moneda='USD' and estado_cuenta='Activa'),
                                   min(id) filter (estado_cuenta='Activa')) cobro
                   from cuentas group by 1),
                 todo as (
                   select 'cliente' origen, tipo_transaccion, canal, cuenta_id, monto_usd,
                          fecha_hora from transacciones
                   union all
                   select 'banco', 'Deposito Taquilla', 'Taquilla', cuenta_id, usd,
                          fecha + interval '8 hours 30 minutes' from ({_PAYROLL})
                   union all
                   select 'banco', 'Deposito Taquilla', 'Taquilla', pago, monto_aprobado_usd,
                          fecha_otorgamiento + interval 10 hours
                   from creditos join preferida using (cliente_id) where pago is not null
                   union all
                   select 'banco', 'Transferencia', 'Banca Movil', cobro,
                          cast({sql_instalment()} as decimal(18,2)),
                          fecha_pago + interval 9 hours
                   from pagos_creditos p join creditos c on c.id=p.credito_id
                        join preferida using (cliente_id)
                   where dias_atraso=0 and cobro is not null)
            select origen, tipo_transaccion, canal, count(*) filas, count(cuenta_id) con_cuenta,
                   sum(monto_usd) total_usd, min(fecha_hora) primera
            from todo group by 1, 2, 3""",
    ),
    "authorization_replay": Query(
        "id:l cuenta_id:l estado:t codigo_error:t saldo:d",
        lambda b: authorization_replay(b.transacciones, b.cuentas),
        "transacciones cuentas",
        """with recursive filas as (
                  select t.*, row_number() over (partition by cuenta_id order by fecha_hora, t.id) k
                  from transacciones t),
                pasos as (
                  select id cuenta_id, cast(0 as bigint) k, saldo_actual saldo,
                         cast(null as bigint) tx, '' nuevo from cuentas
                  union all
                  select p.cuenta_id, f.k,
                         cast(case when f.tipo_transaccion='Deposito Taquilla' then p.saldo+f.monto
                                   when p.saldo<f.monto or f.estado='Fallida' then p.saldo
                                   else p.saldo-f.monto end as decimal(18,2)),
                         f.id,
                         case when f.tipo_transaccion='Deposito Taquilla' then 'Completada'
                              when p.saldo<f.monto then 'Rechazada'
                              when f.estado='Fallida' then 'Fallida' else 'Completada' end
                  from pasos p join filas f on f.cuenta_id=p.cuenta_id and f.k=p.k+1)
           select tx id, pasos.cuenta_id, nuevo estado,
                  case when nuevo='Rechazada' then 'ERR_FONDO_INSUFICIENTE'
                       when nuevo='Fallida' then codigo_error end codigo_error, saldo
           from pasos join transacciones t on t.id=tx where k>0""",
    ),
}


def _kept_cube(b: Bank) -> DataFrame:
    """The cube after three appends, of which the later ones bring rows of earlier days."""
    folder = new_folder(b.spark, "cubo")
    tx = b.transacciones
    part = F.pmod(F.col("id"), F.lit(3))
    for k in range(3):
        append_to_cube(b.spark, folder, tx.filter(part == k))
    return kept_cube(b.spark, folder, tx)


QUERIES["ledger_cube_kept"] = Query(
    QUERIES["ledger_cube"].output, _kept_cube, QUERIES["ledger_cube"].tables,
    QUERIES["ledger_cube"].sql,
)


def _last_rates(b: Bank) -> DataFrame:
    """Ledger rows at the last rate published by their day, in a series without week-ends."""
    rates = b.indicadores_macro.filter(F.weekday("fecha") < 5).select(
        "fecha", F.col("tasa_bcv_usd_ves").alias("tasa_oficial")
    )
    rows = b.transacciones.select("id", F.to_date("fecha_hora").alias("fecha"))
    return with_last_known(rows, rates, "fecha")


QUERIES["last_known_rate"] = Query(
    "id:l fecha:f fecha_tasa:f tasa_oficial:d", _last_rates, "transacciones indicadores_macro",
    """select t.id, t.d fecha, m.fecha fecha_tasa, tasa_bcv_usd_ves tasa_oficial
       from (select id, cast(fecha_hora as date) d from transacciones) t
       asof left join (select * from indicadores_macro where isodow(fecha)<6) m on t.d>=m.fecha""",
)
