"""Names, identifiers and SQL literals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal import constants as K


def full_name(first: Column, last: Column) -> Column:
    """Null when either part is null."""
    return F.concat(first, F.lit(" "), last)


def coordinates(lat: Column, lon: Column) -> Column:
    return F.concat(lat.cast("string"), F.lit(", "), lon.cast("string"))


def document_prefix(document: Column) -> Column:
    return F.substring(document, 1, 1)


def is_company(document: Column) -> Column:
    return F.startswith(document, F.lit("J"))


def mail_address(first: Column, last: Column) -> Column:
    """First names run together, a dot, the first word of the surname."""
    name = F.regexp_replace(F.lower(first), " ", "")
    surname = F.lower(F.split(last, " ")[0])
    return F.concat(name, F.lit("."), surname, F.lit(K.MAIL_DOMAIN))


def device_number(document: Column) -> Column:
    """A repeatable six-digit device id taken from a digest of the document."""
    digest = F.conv(F.substring(F.md5(document), 1, 8), 16, 10).cast("long")
    return F.concat(F.lit("DEV_"), F.lpad((digest % 1000000).cast("string"), 6, "0"))


def quoted(text: Column) -> Column:
    """A single-quoted SQL string, with inner quotes doubled."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_literal(name: str, data_type: T.DataType) -> Column:
    """One value as SQL text: NULL, a bare number, or a quoted string."""
    value = F.col(f"`{name}`")
    text = value.cast("string")
    if not isinstance(data_type, T.NumericType):
        text = quoted(text)
    return F.coalesce(text, F.lit("NULL"))
