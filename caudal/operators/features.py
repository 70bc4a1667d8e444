"""Feature tables for the scoring, fraud and liquidity models, and their preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal import constants as K
from caudal.functions import rules
from caudal.functions.numeric import (
    amount_to_income, debt_to_income, double, haversine_km, instalment_to_income, num,
)
from caudal.functions.text import device_number, document_prefix, is_company, mail_address
from caudal.operators.ledger import account_owner, amount_vs_history, new_device_flag
from caudal.operators.support import join_small

NUMERIC = [
    "score_credito", "ingresos_mensuales_usd", "monto_aprobado_usd", "tasa_interes_anual",
    "plazo_meses", "ratio_cuota_ingreso",
]
CATEGORICAL = ["actividad_economica", "nivel_riesgo_interno", "tipo_credito"]
TARGET = "target_default"

FRAUD_NUMERIC = ["monto_ingreso", "hora_seno", "hora_coseno", "km_de_base"]
FRAUD_CATEGORICAL = ["canal"]
FRAUD_TARGET = "es_fraude"


def credit_features(
    loans: DataFrame, clients: DataFrame, macro: DataFrame | None = None
) -> DataFrame:
    """One row per loan: client and loan figures, both debt ratios, and the default target.

    With ``macro`` also the inflation and output of the day the loan was granted.
    """
    people = clients.select(
        F.col("id").alias("cliente_id"), "score_credito", "ingresos_mensuales_usd",
        "actividad_economica", "nivel_riesgo_interno",
    )
    amount, term, income = (
        F.col(c) for c in ("monto_aprobado_usd", "plazo_meses", "ingresos_mensuales_usd")
    )
    rows = loans.select(
        "id", "cliente_id", "fecha_otorgamiento", "monto_aprobado_usd", "tasa_interes_anual",
        "plazo_meses", "tipo_credito", rules.default_target(F.col("estado")).alias(TARGET),
    ).join(people, "cliente_id")
    context: list[str] = []
    if macro is not None:
        context = ["inflacion_mensual_pct", "variacion_pib_mensual_pct"]
        day = macro.select(F.col("fecha").alias("fecha_otorgamiento"), *context)
        rows = join_small(rows, day, "fecha_otorgamiento")
    return rows.select(
        "id", *[c for c in NUMERIC if c != "ratio_cuota_ingreso"], *CATEGORICAL, *context,
        instalment_to_income(amount, term, income).alias("ratio_cuota_ingreso"),
        debt_to_income(amount, term, income).alias("deuda_ingreso"),
        TARGET,
    )


def geo_deviation(
    tx: DataFrame, accounts: DataFrame, clients: DataFrame, centroids: DataFrame
) -> DataFrame:
    """Kilometres between each transaction and the client's state of residence."""
    home = clients.join(centroids, "estado_residencia")
    owner = account_owner(accounts, home, "latitud_base", "longitud_base")
    rows = tx.select("id", "cuenta_id", "latitud", "longitud").join(owner, "cuenta_id")
    return rows.select("id", _distance().alias("km_de_base"))


def _distance() -> Column:
    return haversine_km(*[F.col(c) for c in ("latitud", "longitud", "latitud_base", "longitud_base")])


def fraud_features(
    tx: DataFrame, accounts: DataFrame, clients: DataFrame, centroids: DataFrame
) -> DataFrame:
    """One row per transaction: amount over income, hour on a circle, distance, channel."""
    home = clients.join(centroids, "estado_residencia")
    owner = account_owner(
        accounts, home, "ingresos_mensuales_usd", "latitud_base", "longitud_base"
    )
    rows = tx.select(
        "id", "cuenta_id", "fecha_hora", "monto_usd", "canal", "latitud", "longitud", "es_fraude"
    ).join(owner, "cuenta_id")
    angle = num(2) * F.pi() * double(F.hour("fecha_hora")) / num(24)
    return rows.select(
        "id",
        amount_to_income(F.col("monto_usd"), F.col("ingresos_mensuales_usd"))
        .alias("monto_ingreso"),
        F.sin(angle).alias("hora_seno"),
        F.cos(angle).alias("hora_coseno"),
        _distance().alias("km_de_base"),
        "canal",
        F.coalesce("es_fraude", F.lit(0)).alias("es_fraude"),
    )


def fraud_history_features(
    tx: DataFrame, accounts: DataFrame, clients: DataFrame, centroids: DataFrame
) -> DataFrame:
    """The fraud features with the account's history: amount against its earlier mean, and
    whether the device is new."""
    history = amount_vs_history(tx).select("id", "previas", "media_previa", "razon")
    device = new_device_flag(tx).select("id", "dispositivo_nuevo")
    return (
        fraud_features(tx, accounts, clients, centroids)
        .join(history, "id").join(device, "id")
    )


def client_normalize(clients: DataFrame) -> DataFrame:
    """Document prefix, company mark, mail address and device id of each client."""
    document = F.col("cedula")
    return clients.select(
        "id",
        document_prefix(document).alias("prefijo"),
        is_company(document).cast("int").alias("es_juridico"),
        mail_address(F.col("nombre"), F.col("apellido")).alias("email"),
        device_number(document).alias("dispositivo_id"),
    )


# ---- preparation --------------------------------------------------------------------


def split_mark(key: Column, test_share: float = K.TEST_SHARE) -> Column:
    """True for the rows of the test part: a digest of the key decides, with no shuffle."""
    digest = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double")
    return digest >= num((1 - test_share) * 2**32)


def train_test_split(
    df: DataFrame, key: str = "id", test_share: float = K.TEST_SHARE
) -> tuple[DataFrame, DataFrame]:
    """A repeatable split; each class keeps its share but for chance."""
    test = split_mark(F.col(key), test_share)
    return df.filter(~test), df.filter(test)


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (0 where all are equal)."""
    stats = df.agg(
        *[
            F.struct(
                F.avg(double(F.col(c))).alias("media"), F.stddev_pop(double(F.col(c))).alias("desv")
            ).alias(c)
            for c in columns
        ]
    )
    rows = df.withColumn("_stats", stats.select(F.struct("*")).scalar())
    scaled = {}
    for c in columns:
        mean, deviation = F.col(f"_stats.{c}.media"), F.col(f"_stats.{c}.desv")
        scaled[c] = F.when(deviation == 0, num(0)).otherwise((double(F.col(c)) - mean) / deviation)
    return rows.withColumns(scaled).drop("_stats")


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """A 0/1 column per known category; an unknown value leaves all of them 0."""
    marks = {
        f"{c}={value}": F.coalesce((F.col(c) == value).cast("int"), F.lit(0))
        for c, values in categories.items()
        for value in values
    }
    return reduce(lambda d, c: d.drop(c), categories, df.withColumns(marks))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes * rows of the class) per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("filas"))
    whole = counts.agg(
        F.struct(F.sum("filas").alias("total"), F.count("*").alias("clases"))
    ).scalar()
    weight = double(whole["total"]) / (double(whole["clases"]) * double(F.col("filas")))
    return counts.withColumn("peso", weight)
