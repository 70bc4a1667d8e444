import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from caudal.sources.schemas import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


# One plain row of each table; tests name only the columns that matter to them.
DAY = dt.date(2024, 1, 10)
PLAIN = {
    "clientes": dict(
        id=1, nombre="Ana", apellido="Rivas Silva", tipo_documento="V", cedula="V-1",
        fecha_nacimiento=DAY, genero="F", estado_civil="Soltero", email="a@b", telefono="1",
        estado_residencia="Lara", fecha_registro=DAY, estado_cliente="Activo",
        fecha_desafiliacion=None, score_credito=650, ingresos_mensuales_usd=500,
        actividad_economica="Empleado Privado", nivel_riesgo_interno="Medio",
    ),
    "cuentas": dict(
        id=1, cliente_id=1, numero_cuenta="01", tipo_cuenta="Corriente", moneda="VES",
        fecha_apertura=DAY, saldo_actual=100, estado_cuenta="Activa",
    ),
    "transacciones": dict(
        id=1, cuenta_id=1, tipo_transaccion="Pago Movil", monto=10, monto_usd=10, tasa_cambio=1,
        fecha_hora=dt.datetime(2024, 1, 10, 12), canal="Pago Movil", estado="Completada",
        codigo_error=None, es_fraude=0, latitud=10.5, longitud=-66.9, dispositivo_id="D1",
    ),
    "creditos": dict(
        id=1, cliente_id=1, monto_aprobado_usd=1200, tasa_interes_anual=36, plazo_meses=12,
        fecha_otorgamiento=DAY, fecha_vencimiento=DAY, tipo_credito="Consumo", estado="Vigente",
        saldo_pendiente_usd=600, cuotas_totales=12, cuotas_pagadas=0,
    ),
    "pagos_creditos": dict(
        id=1, credito_id=1, monto_pago_usd=100, fecha_pago=DAY, dias_atraso=0,
        estado_pago="A Tiempo",
    ),
    "indicadores_macro": dict(
        fecha=DAY, tasa_bcv_usd_ves=10, tasa_paralela_usd_ves=11, inflacion_mensual_pct=3,
        variacion_pib_mensual_pct=1, tasa_activa_ves_anual=30, tasa_pasiva_ves_anual=10,
    ),
    "resumen_liquidez_diario": dict(
        fecha=DAY, total_depositos_ves=1000, total_depositos_usd=10, total_creditos_ves=0,
        total_creditos_usd=0, disponible_caja_ves=500, encaje_legal_bcv_ves=730,
        tasa_liquidez=0.4995, brecha_liquidez_usd=-23,
    ),
    "operaciones_tesoreria": dict(
        id=1, fecha=DAY, tipo_operacion="Venta Divisas", monto_usd=5, tasa_anual=20,
        plazo_dias=1, contraparte="X",
    ),
}


@pytest.fixture(scope="session")
def make(spark):
    """make("cuentas", {...}, {...}): a bank table with the given rows."""

    def build(table, *rows, nullable=False):
        schema = SCHEMAS[table]
        values = []
        for row in rows:
            merged = {**PLAIN[table], **row}
            values.append(tuple(
                Decimal(str(merged[f.name]))
                if f.dataType.typeName() == "decimal" and merged[f.name] is not None
                else merged[f.name]
                for f in schema
            ))
        if nullable:
            schema = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
        return spark.createDataFrame(values, schema)

    return build


def dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
