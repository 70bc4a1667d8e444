"""Declared schemas of the eight bank tables, with their keys and value domains.

Times carry no zone (wall-clock time of the bank), so reports do not depend on the
session's time zone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from caudal import constants as K

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "text": T.StringType(),
    "date": T.DateType(),
    "time": T.TimestampNTZType(),
    "double": T.DoubleType(),
}


def _column(spec: str) -> T.StructField:
    """``name type`` or ``name type!`` (not null); ``p.s`` stands for a decimal."""
    name, kind = spec.split()
    required = kind.endswith("!")
    kind = kind.rstrip("!")
    if "." in kind:
        precision, scale = (int(n) for n in kind.split("."))
        data_type: T.DataType = T.DecimalType(precision, scale)
    else:
        data_type = _TYPES[kind]
    return T.StructField(name, data_type, not required)


@dataclass(frozen=True)
class Table:
    """One bank table: columns, unique keys, value domains, references and export text."""

    schema: T.StructType
    unique: tuple[str, ...]
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable]


def _table(columns: str, unique: tuple[str, ...], domains=None, references=None) -> Table:
    fields = [_column(line) for line in columns.strip().split(", ")]
    return Table(T.StructType(fields), unique, domains or {}, references or {})


TABLES: dict[str, Table] = {
    "clientes": _table(
        "id long!, nombre text!, apellido text!, tipo_documento text!, cedula text!, "
        "fecha_nacimiento date!, genero text!, estado_civil text!, email text!, telefono text!, "
        "estado_residencia text!, fecha_registro date!, estado_cliente text!, "
        "fecha_desafiliacion date, score_credito int!, ingresos_mensuales_usd 15.2!, "
        "actividad_economica text!, nivel_riesgo_interno text!",
        ("id", "cedula"),
        {
            "tipo_documento": K.DOCUMENT_TYPES,
            "genero": K.GENDERS,
            "estado_civil": K.CIVIL_STATES,
            "estado_cliente": K.CLIENT_STATES,
            "nivel_riesgo_interno": K.RISK_TIERS,
        },
    ),
    "cuentas": _table(
        "id long!, cliente_id long!, numero_cuenta text!, tipo_cuenta text!, moneda text!, "
        "fecha_apertura date!, saldo_actual 18.2!, estado_cuenta text!",
        ("id", "numero_cuenta"),
        {
            "tipo_cuenta": K.ACCOUNT_TYPES,
            "moneda": K.CURRENCIES,
            "estado_cuenta": K.ACCOUNT_STATES,
        },
        {"cliente_id": "clientes"},
    ),
    "transacciones": _table(
        "id long!, cuenta_id long!, tipo_transaccion text!, monto 18.2!, monto_usd 18.2!, "
        "tasa_cambio 12.4!, fecha_hora time!, canal text!, estado text!, codigo_error text, "
        "es_fraude int, latitud double, longitud double, dispositivo_id text",
        ("id",),
        {"tipo_transaccion": K.TX_TYPES, "estado": K.TX_STATES},
        {"cuenta_id": "cuentas"},
    ),
    "creditos": _table(
        "id long!, cliente_id long!, monto_aprobado_usd 15.2!, tasa_interes_anual 5.2!, "
        "plazo_meses int!, fecha_otorgamiento date!, fecha_vencimiento date!, tipo_credito text!, "
        "estado text!, saldo_pendiente_usd 15.2!, cuotas_totales int!, cuotas_pagadas int!",
        ("id",),
        {"tipo_credito": K.LOAN_TYPES, "estado": K.LOAN_STATES},
        {"cliente_id": "clientes"},
    ),
    "pagos_creditos": _table(
        "id long!, credito_id long!, monto_pago_usd 15.2!, fecha_pago date!, dias_atraso int!, "
        "estado_pago text!",
        ("id",),
        {"estado_pago": K.PAYMENT_STATES},
        {"credito_id": "creditos"},
    ),
    "indicadores_macro": _table(
        "fecha date!, tasa_bcv_usd_ves 12.4!, tasa_paralela_usd_ves 12.4!, "
        "inflacion_mensual_pct 5.2!, variacion_pib_mensual_pct 5.2!, tasa_activa_ves_anual 5.2!, "
        "tasa_pasiva_ves_anual 5.2!",
        ("fecha",),
    ),
    "resumen_liquidez_diario": _table(
        "fecha date!, total_depositos_ves 20.2!, total_depositos_usd 20.2!, "
        "total_creditos_ves 20.2!, total_creditos_usd 20.2!, disponible_caja_ves 20.2!, "
        "encaje_legal_bcv_ves 20.2!, tasa_liquidez 8.4!, brecha_liquidez_usd 18.2!",
        ("fecha",),
    ),
    "operaciones_tesoreria": _table(
        "id long!, fecha date!, tipo_operacion text!, monto_usd 15.2!, tasa_anual 5.2!, "
        "plazo_dias int!, contraparte text!",
        ("id",),
        {"tipo_operacion": K.TREASURY_TYPES},
    ),
}

SCHEMAS: dict[str, T.StructType] = {name: table.schema for name, table in TABLES.items()}
