"""Queries on features, preparation, model quality and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions.numeric import round_half_up
from caudal.functions.rules import default_target
from caudal.operators import forecast as W
from caudal.operators import features as X
from caudal.operators import metrics as M
from caudal.operators import models
from caudal.operators.bootstrap import metric_intervals, poisson_steps
from caudal.operators.isolation import isolation_scores
from caudal.operators.liquidity import gap_free, liquidity_features
from caudal.operators.support import materialize
from caudal.plans import ledger
from caudal.plans.credit import BAD
from caudal.plans.registry import Query
from caudal.sources.adapters import Bank

SCORE_CUT = 550
KNOWN = {
    "actividad_economica": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "tipo_credito": ["Consumo", "Comercial", "Microcredito", "Hipotecario"],
}

_KM = """
    2e0*6371e0*asin(sqrt(least(1e0,
      pow(sin(radians(latitud_base-latitud)/2e0), 2)
      + cos(radians(latitud))*cos(radians(latitud_base))
        *pow(sin(radians(longitud_base-longitud)/2e0), 2))))"""

_OWNED = """transacciones t join cuentas a on a.id=cuenta_id join clientes c on c.id=a.cliente_id
            join centroides z on z.estado_residencia=c.estado_residencia"""

_CREDIT = """
    select r.id, score_credito, ingresos_mensuales_usd, monto_aprobado_usd, tasa_interes_anual,
           plazo_meses, actividad_economica, nivel_riesgo_interno, tipo_credito,
           cast(monto_aprobado_usd as double)/plazo_meses
             /(cast(ingresos_mensuales_usd as double)+1e0) ratio_cuota_ingreso,
           cast(monto_aprobado_usd as double)
             /nullif(cast(ingresos_mensuales_usd as double)*plazo_meses, 0e0) deuda_ingreso,
           cast(r.estado in ('Vencido', 'En Litigio') as int) target_default,
           fecha_otorgamiento
    from creditos r join clientes c on c.id=r.cliente_id"""

_SCORED = """
    select cast(850-score_credito as double) s,
           cast(estado in ('Vencido', 'En Litigio') as int) y
    from creditos join clientes on clientes.id=cliente_id"""

_ERRORS = """
    select x, lag(x) over (order by fecha) p
    from (select dias.fecha, cast(d.brecha_liquidez_usd as double) x
          from (select cast(unnest(generate_series(min(fecha)::timestamp, max(fecha)::timestamp,
                                                   interval 1 day)) as date) fecha
                from resumen_liquidez_diario) dias
          asof join resumen_liquidez_diario d on dias.fecha>=d.fecha)"""


def _credit(b: Bank) -> DataFrame:
    return X.credit_features(b.creditos, b.clientes)


def _scored(b: Bank) -> DataFrame:
    """Default target, risk score (high is bad) and the prediction of a plain score cut."""
    people = b.clientes.select(F.col("id").alias("cliente_id"), "score_credito")
    score = F.col("score_credito")
    return b.creditos.join(people, "cliente_id").select(
        default_target(F.col("estado")).alias("y"),
        (850 - score).alias("riesgo"),
        (score < SCORE_CUT).cast("int").alias("p"),
    )


def _split(b: Bank) -> DataFrame:
    features = _credit(b)
    part = F.when(X.split_mark(F.col("id")), "test").otherwise("train")
    return features.select("id", X.TARGET, part.alias("parte"))


def _lag_forecast(b: Bank) -> DataFrame:
    daily = gap_free(b.resumen_liquidez_diario.select("fecha", "brecha_liquidez_usd"))
    previous = F.lag("brecha_liquidez_usd").over(Window.orderBy("fecha"))
    return M.forecast_error(daily.withColumn("p", previous), "brecha_liquidez_usd", "p")


def _model_scores(b: Bank, kind: str, trees: int) -> DataFrame:
    train, test = X.train_test_split(_credit(b))
    return models.score(models.fit_pd_model(train, kind, trees=trees), test)


def _fraud_scores(b: Bank) -> DataFrame:
    features = X.fraud_features(b.transacciones, b.cuentas, b.clientes, b.centroides)
    train, test = X.train_test_split(models.without_income(features))
    return models.score(models.fit_fraud_model(train), test, X.FRAUD_TARGET)


def _gap_forecast(b: Bank) -> DataFrame:
    """Fitted on the first four fifths of the days, given for the last fifth."""
    features = liquidity_features(b.resumen_liquidez_diario, b.indicadores_macro)
    features = materialize(features)  # one row per day, read by the fit and the forecast
    ends = features.agg(F.min("fecha").alias("a"), F.max("fecha").alias("z")).first()
    if ends["a"] is None:
        return features.select("fecha", "brecha_liquidez_usd", F.lit(0.0).alias("pronostico_usd"))
    cut = F.lit(ends["a"] + (ends["z"] - ends["a"]) * 4 / 5)
    model = models.fit_gap_forecast(features.filter(F.col("fecha") <= cut))
    return models.forecast_gap(model, features.filter(F.col("fecha") > cut))


def _forecast_quality(b: Bank) -> DataFrame:
    return M.forecast_error(_gap_forecast(b), "brecha_liquidez_usd", "pronostico_usd")


def _model_report(b: Bank) -> DataFrame:
    return M.classification_report(_model_scores(b, "rf", 100), X.TARGET, "prediccion")


def _model_auc(b: Bank) -> DataFrame:
    return M.auc_gini(_model_scores(b, "rf", 100), X.TARGET, "probabilidad")


def _fraud_pr_auc(b: Bank) -> DataFrame:
    return M.pr_auc(M.pr_curve(_fraud_scores(b), X.FRAUD_TARGET, "probabilidad"))


_SCORES = "id:l target_default:l prediccion:l probabilidad:d"

QUERIES: dict[str, Query] = {
    "credit_features": Query(
        "id:l score_credito:l ingresos_mensuales_usd:d monto_aprobado_usd:d tasa_interes_anual:d "
        "plazo_meses:l actividad_economica:t nivel_riesgo_interno:t tipo_credito:t "
        "inflacion_mensual_pct:d variacion_pib_mensual_pct:d ratio_cuota_ingreso:d6 "
        "deuda_ingreso:d6 target_default:l",
        lambda b: X.credit_features(b.creditos, b.clientes, b.macro_for("orders")),
        "creditos clientes indicadores_macro",
        f"""select f.*, inflacion_mensual_pct, variacion_pib_mensual_pct
            from ({_CREDIT}) f join indicadores_macro on fecha=fecha_otorgamiento""",
    ),
    "geo_deviation": Query(
        "id:l km_de_base:d4",
        lambda b: X.geo_deviation(b.transacciones, b.cuentas, b.clientes, b.centroides),
        "transacciones cuentas clientes centroides",
        f"select t.id, {_KM} km_de_base from {_OWNED}",
    ),
    "fraud_features": Query(
        "id:l monto_ingreso:d6 hora_seno:d6 hora_coseno:d6 km_de_base:d4 canal:t es_fraude:l",
        lambda b: X.fraud_features(b.transacciones, b.cuentas, b.clientes, b.centroides),
        "transacciones cuentas clientes centroides",
        f"""select t.id, cast(monto_usd as double)
                           /nullif(cast(ingresos_mensuales_usd as double), 0e0) monto_ingreso,
                   sin(radians(15e0*hour(fecha_hora))) hora_seno,
                   cos(radians(15e0*hour(fecha_hora))) hora_coseno,
                   {_KM} km_de_base, canal, es_fraude
            from {_OWNED}""",
    ),
    "client_normalize": Query(
        "id:l prefijo:t es_juridico:l email:t dispositivo_id:t",
        lambda b: X.client_normalize(b.clientes),
        "clientes",
        """select id, left(cedula, 1) prefijo, cast(cedula like 'J%' as int) es_juridico,
                  replace(lower(nombre), ' ', '') || '.' || lower(split_part(apellido, ' ', 1))
                    || '@gmail.com' email,
                  'DEV_' || lpad(cast(cast('0x' || left(md5(cedula), 8) as bigint)%1000000
                                      as varchar), 6, '0') dispositivo_id
           from clientes""",
    ),
    "train_test_split": Query(
        "id:l target_default:l parte:t",
        _split,
        "creditos clientes",
        f"""select id, target_default,
                   case when cast('0x' || left(md5(cast(id as varchar)), 8) as bigint)
                             >=0.8e0*4294967296e0 then 'test' else 'train' end parte
            from ({_CREDIT})""",
    ),
    "standardized": Query(
        "id:l " + " ".join(f"{c}:d6" for c in X.NUMERIC),
        lambda b: X.standardized(_credit(b), X.NUMERIC),
        "creditos clientes",
        "select id, "
        + ", ".join(
            f"(cast({c} as double)-avg(cast({c} as double)) over ())"
            f"/stddev_pop(cast({c} as double)) over () {c}" for c in X.NUMERIC
        )
        + f" from ({_CREDIT})",
    ),
    "one_hot": Query(
        "id:l " + " ".join(f"{c}={v}:l" for c, values in KNOWN.items() for v in values),
        lambda b: X.one_hot(_credit(b).select("id", *KNOWN), KNOWN),
        "creditos clientes",
        "select id, "
        + ", ".join(
            f"case {c} when '{v}' then 1 else 0 end \"{c}={v}\""
            for c, values in KNOWN.items() for v in values
        )
        + f" from ({_CREDIT})",
    ),
    "class_weights": Query(
        "target_default:l filas:l peso:d6",
        lambda b: X.class_weights(
            b.creditos.select(default_target(F.col("estado")).alias(X.TARGET)), X.TARGET
        ),
        "creditos",
        """with y as (select cast(estado in ('Vencido', 'En Litigio') as int) target_default
                      from creditos)
           select target_default, count(*) filas,
                  (select count(*) from y)*1e0
                    /((select count(distinct target_default) from y)*count(*)) peso
           from y group by 1""",
    ),
    "classification_report": Query(
        "clase:l precision:d6 recall:d6 f1:d6 soporte:l",
        lambda b: M.classification_report(_scored(b), "y", "p"),
        "creditos clientes",
        f"""with v as (select y, cast(s>850-{SCORE_CUT} as int) p from ({_SCORED})),
                 k as (select clase, count(*) filter (y=clase and p=clase)*1e0 ok,
                              count(*) filter (p=clase) np, count(*) filter (y=clase) ny
                       from v, (select distinct unnest([y, p]) clase from v) group by 1)
            select clase, coalesce(ok/nullif(np, 0), 0) "precision",
                   coalesce(ok/nullif(ny, 0), 0) recall,
                   2e0*ok/(np+ny) f1, ny soporte from k""",
    ),
    "auc_gini": Query(
        "positivos:l negativos:l auc:d6 gini:d6",
        lambda b: M.auc_gini(_scored(b), "y", "riesgo"),
        "creditos clientes",
        f"""with h as (select s, sum(y) p, sum(1-y) n from ({_SCORED}) group by 1),
                 pares as (select sum(a.p*b.n*case when a.s>b.s then 1e0 when a.s=b.s then 0.5e0
                                                   else 0e0 end)
                                  /sum(a.p*b.n*1e0) auc from h a, h b)
            select (select sum(p) from h) positivos, (select sum(n) from h) negativos,
                   auc, 2e0*auc-1e0 gini from pares""",
    ),
    "pr_curve": Query(
        "puntaje:d vp:l fp:l precision:d6 recall:d6",
        lambda b: M.pr_curve(_scored(b), "y", "riesgo"),
        "creditos clientes",
        f"""with h as (select s, sum(y) p, sum(1-y) n from ({_SCORED}) group by 1),
                 c as (select a.s, sum(b.p) vp, sum(b.n) fp from h a join h b on b.s>=a.s
                       group by 1)
            select s puntaje, vp, fp, vp*1e0/(vp+fp) "precision",
                   vp*1e0/(select sum(p) from h) recall from c""",
    ),
    "pr_auc": Query(
        "pr_auc:d6",
        lambda b: M.pr_auc(M.pr_curve(_scored(b), "y", "riesgo")),
        "creditos clientes",
        f"""with h as (select s, sum(y) p, sum(1-y) n from ({_SCORED}) group by 1),
                 c as (select a.s, sum(b.p)*1e0 vp, sum(b.n)*1e0 fp
                       from h a join h b on b.s>=a.s group by 1),
                 r as (select s, vp/(vp+fp) pr, vp/(select sum(p) from h) re from c)
            select sum((re-coalesce(antes, 0e0))*pr) pr_auc
            from (select *, lag(re) over (order by s desc) antes from r)""",
    ),
    "model_report": Query("clase:l precision:d6 recall:d6 f1:d6 soporte:l", _model_report),
    "model_auc": Query("positivos:l negativos:l auc:d6 gini:d6", _model_auc),
    "fraud_pr_auc": Query("pr_auc:d6", _fraud_pr_auc),
    "gap_forecast_error": Query("n:l mae:d4 rmse:d4", _forecast_quality),
    "forecast_error": Query(
        "n:l mae:d4 rmse:d4",
        _lag_forecast,
        "resumen_liquidez_diario",
        f"""select count(x-p) n, avg(abs(x-p)) mae, sqrt(avg((x-p)*(x-p))) rmse
            from ({_ERRORS})""",
    ),
    "rf_scores": Query(_SCORES, lambda b: _model_scores(b, "rf", 100)),
    "lr_scores": Query(_SCORES, lambda b: _model_scores(b, "lr", 0)),
    "gbt_scores": Query(_SCORES, lambda b: _model_scores(b, "gbt", 100)),
    "fraud_scores": Query(
        "id:l es_fraude:l prediccion:l probabilidad:d", _fraud_scores
    ),
    "gap_forecast": Query(
        "fecha:f brecha_liquidez_usd:d pronostico_usd:d", _gap_forecast
    ),
}

QUERIES["fraud_history_features"] = Query(
    QUERIES["fraud_features"].output
    + " previas:l media_previa:d6 razon:d6 dispositivo_nuevo:l",
    lambda b: X.fraud_history_features(b.transacciones, b.cuentas, b.clientes, b.centroides),
    QUERIES["fraud_features"].tables,
    f"""select f.*, previas, media_previa, razon, dispositivo_nuevo
        from ({QUERIES["fraud_features"].sql}) f
             join ({ledger.QUERIES["amount_vs_history"].sql}) h using (id)
             join ({ledger.QUERIES["new_device_flag"].sql}) d using (id)""",
)

# Each day from the days before it, by the one regressor that SQL can follow: the day before.
_WALK = f"""
    select fecha, x, p lagged,
           case when regr_count(x, p) over w >= 30
                then regr_intercept(x, p) over w + regr_slope(x, p) over w * p end p
    from ({_ERRORS.replace("select x, lag(x)", "select fecha, x, lag(x)")})
    window w as (order by fecha rows between unbounded preceding and 1 preceding)"""


def _walk(b: Bank) -> DataFrame:
    gap = "brecha_liquidez_usd"
    daily = gap_free(b.resumen_liquidez_diario.select("fecha", gap))
    before = F.lag(gap).over(Window.orderBy("fecha"))
    return W.walk_forward(daily.withColumn("ayer", before), gap, ["ayer"])


def _walk_errors(b: Bank) -> DataFrame:
    gap = "brecha_liquidez_usd"
    daily = gap_free(b.resumen_liquidez_diario.select("fecha", gap))
    return W.forecast_errors({"retardo": W.lagged(daily, gap), "regresion": _walk(b)}, gap)


def _seasonal_walk(b: Bank) -> DataFrame:
    """Deposits of 1, 7 and 30 days before, the rate spread and the season."""
    gap = "brecha_liquidez_usd"
    days = liquidity_features(b.resumen_liquidez_diario, b.indicadores_macro)
    days = days.withColumns(W.season(F.col("fecha")))
    inputs = [c for c in days.columns if c not in ("fecha", gap)]
    return W.walk_forward(days, gap, inputs, warmup=2 * len(inputs), ridge=1e-3)


QUERIES |= {
    "gap_walk_forward": Query(
        "fecha:f brecha_liquidez_usd:d pronostico:d1", _walk, "resumen_liquidez_diario",
        f"select fecha, x brecha_liquidez_usd, p pronostico from ({_WALK})",
    ),
    "gap_walk_forward_error": Query(
        "modelo:t n:l mae:d3 rmse:d3", _walk_errors, "resumen_liquidez_diario",
        f"""select modelo, count(e) n, avg(abs(e)) mae, sqrt(avg(e*e)) rmse
            from (select 'retardo' modelo, x-lagged e from ({_WALK}) where p is not null
                  union all select 'regresion', x-p from ({_WALK}) where p is not null)
            group by 1""",
    ),
    "gap_seasonal_forecast": Query(
        "fecha:f brecha_liquidez_usd:d pronostico:d", _seasonal_walk
    ),
}


# ---- isolation trees ----------------------------------------------------------------

ISOLATED = [*X.FRAUD_NUMERIC]


def _digest_sql(text: str) -> str:
    return f"((cast(cast('0x' || left(md5({text}), 8) as bigint) as double)+0.5e0)/4294967296e0)"


def _isolation_sql(features: str, columns: list[str], trees: int, size: int, depth: int) -> str:
    """The same trees and paths, a CTE per level."""
    d, seed = len(columns), K.SEED
    draw = lambda what: _digest_sql(f"'{seed}:' || tree || ':' || node || ':{what}'")
    x = ", ".join(
        f"coalesce(floor(cast({c} as double)*1e6+0.5e0)/1e6, 0e0)" for c in columns
    )
    ctes = [
        f"rasgos as (select id, es_fraude, [{x}] x from ({features}))",
        f"""g0 as (select tree, x, 0 node from (
              select tree, x, row_number() over (partition by tree order by marca, id) k
              from (select id, x, tree, {_digest_sql(f"'{seed}:' || tree || ':' || id")} marca
                    from rasgos, unnest(range({trees})) t(tree))) where k<={size})""",
    ]
    for k in range(depth):
        ctes.append(f"""v{k} as (
            select *, row_number() over (partition by tree, node order by f)-1 i,
                   count(*) over (partition by tree, node) m
            from (select tree, node, f, min(x[f+1]) lo, max(x[f+1]) hi
                  from g{k}, unnest(range({d})) t(f) where node>={2**k - 1} group by 1, 2, 3)
            where hi>lo)""")
        ctes.append(f"""s{k} as (
            select tree, node, f, corte from (
              select *, lo+{draw("cut")}*(hi-lo) corte from v{k}
              where i=cast(floor({draw("f")}*m) as bigint)) where corte>lo)""")
        ctes.append(f"""g{k + 1} as (
            select tree, x, case when f is null then node
                                 else 2*node+1+cast(x[f+1]>=corte as int) end node
            from g{k} left join s{k} using (tree, node))""")
    splits = " union all ".join(f"select * from s{k}" for k in range(depth))
    more = "2e0*(ln(n-1e0)+0.5772156649015329e0)-2e0*(n-1e0)/n"
    ctes.append(f"cortes as ({splits})")
    ctes.append(f"""hojas as (select tree, node, floor(log2(node+1))+case when n>2 then {more}
                                      when n=2 then 1e0 else 0e0 end largo
                   from (select tree, node, cast(count(*) as double) n
                         from g{depth} group by 1, 2))""")
    ctes.append(f"""baja as (
        select id, tree, x, 0 node from rasgos, unnest(range({trees})) t(tree)
        union all
        select id, tree, x, 2*node+1+cast(x[f+1]>=corte as int)
        from baja join cortes using (tree, node))""")
    return f"""
        with recursive {", ".join(ctes)}
        select id, es_fraude, camino, pow(2e0, -camino/(
                   select greatest(1e0, case when n>2 then {more} when n=2 then 1e0 else 0e0 end)
                   from (select cast(count(*) as double) n from g0 where tree=0))) anomalia
        from (select id, sum(largo)/{trees}e0 camino
              from (select id, tree, max(node) node from baja group by 1, 2)
                   join hojas using (tree, node) group by 1) join rasgos using (id)"""


def _isolation(b: Bank) -> DataFrame:
    # rounded, so that values which are equal but for their last bit are not cut apart
    features = X.fraud_features(b.transacciones, b.cuentas, b.clientes, b.centroides)
    return isolation_scores(
        features.withColumns({c: round_half_up(F.col(c), 6) for c in ISOLATED}), ISOLATED
    )


def _isolation_auc(b: Bank) -> DataFrame:
    """How well the scores, made without labels, find the marked frauds."""
    rounded = F.floor(F.col("anomalia") * 1000 + 0.5)
    return M.auc_gini(_isolation(b).withColumn("anomalia", rounded), "es_fraude", "anomalia")


_ISOLATION = _isolation_sql(QUERIES["fraud_features"].sql, ISOLATED, 50, 256, 8)
QUERIES |= {
    "fraud_isolation": Query(
        "id:l es_fraude:l camino:d6 anomalia:d6", _isolation,
        QUERIES["fraud_features"].tables, _ISOLATION,
    ),
    "fraud_isolation_auc": Query("positivos:l negativos:l auc:d6 gini:d6", _isolation_auc),
}


# ---- intervals of model quality -----------------------------------------------------


def _poisson_sql(share: str) -> str:
    steps = poisson_steps()
    whens = " ".join(f"when {share}<{c!r} then {k}" for k, c in enumerate(steps))
    return f"case {whens} else {len(steps)} end"


def _intervals(b: Bank) -> DataFrame:
    people = b.clientes.select(F.col("id").alias("cliente_id"), "score_credito")
    rows = b.creditos.join(people, "cliente_id").select(
        "id", default_target(F.col("estado")).alias("y"),
        (850 - F.col("score_credito")).alias("riesgo"),
    )
    return metric_intervals(rows, "y", "riesgo")


QUERIES["metric_intervals"] = Query(
    "metrica:t estimacion:d6 bajo:d6 alto:d6 replicas:l", _intervals, "creditos clientes",
    f"""with filas as (
          select c.id, 850-score_credito s, case when {BAD} then 1 else 0 end y
          from creditos c join clientes p on p.id=cliente_id),
        pesos as (
          select replica, s, y, case when replica=0 then 1 else {_poisson_sql("u")} end w
          from (select *, {_digest_sql(f"'{K.SEED}:' || replica || ':' || id")} u
                from filas, unnest(range(41)) r(replica))),
        cuentas_r as (select replica, s, sum(w*y) pos, sum(w*(1-y)) neg from pesos
                      where w>0 group by 1, 2),
        hasta as (select *, sum(pos) over w p, sum(neg) over w n,
                         cast(sum(pos) over r as double) tp, cast(sum(neg) over r as double) tn
                  from cuentas_r window w as (partition by replica order by s),
                                        r as (partition by replica)),
        medidas as (
          select replica, sum(pos*(n-neg+neg/2e0)/(tp*tn)) auc,
                 sum(pos/tp*(tp-p+pos)/((tp-p+pos)+(tn-n+neg))) pr_auc from hasta group by 1),
        largo as (select replica, 'auc' metrica, auc x from medidas
                  union all select replica, 'pr_auc', pr_auc from medidas)
        select metrica, max(x) filter (replica=0) estimacion,
               quantile_cont(x, 0.025) filter (replica>0) bajo,
               quantile_cont(x, 0.975) filter (replica>0) alto,
               count(x) filter (replica>0) replicas from largo group by 1""",
)


def _valid_scores(b: Bank) -> DataFrame:
    """What must hold for scores whatever the model: every test row once, with its label, a
    probability, and the class that follows from it."""
    parts = []
    for kind in ("lr", "rf"):
        scored = _model_scores(b, kind, 100)
        p = F.col("probabilidad")
        wrong = (F.col("prediccion") != (p > 0.5).cast("int")) & (p != 0.5)
        parts.append(scored.agg(
            F.lit(kind).alias("modelo"), F.countDistinct("id").alias("filas"),
            F.sum(X.TARGET).alias("positivos"),
            F.count(F.when(p.isNull() | ~p.between(0, 1), 1)).alias("fuera"),
            F.count(F.when(wrong, 1)).alias("contrarias"),
        ))
    return reduce(DataFrame.unionByName, parts)


QUERIES["model_scores_valid"] = Query(
    "modelo:t filas:l positivos:l fuera:l contrarias:l", _valid_scores,
    QUERIES["train_test_split"].tables,
    f"""select modelo, count(*) filas, sum(target_default) positivos, 0 fuera, 0 contrarias
        from ({QUERIES["train_test_split"].sql}), (values ('lr'), ('rf')) m(modelo)
        where parte='test' group by 1""",
)
