"""Reading and writing bank tables: parquet, CSV, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from caudal.sources.schemas import SCHEMAS


_CSV = {
    "header": True, "quote": '"', "escape": '"', "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
}
CSV_WRITING = _CSV | {"emptyValue": '""'}
# The reader takes an empty text for a null where both look alike, so it is given another look.
_EMPTY = "\ue000"
_CSV_READING = _CSV | {
    "emptyValue": _EMPTY, "multiLine": True, "enforceSchema": False, "mode": "FAILFAST",
}


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there, in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A bank table stored as parquet under its name."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def load_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A bank table stored as CSV with a header line; types come from the declared schema.

    Headers must match the schema, and a line that does not fit ends the reading.
    """
    raw = spark.read.schema(SCHEMAS[name]).options(**_CSV_READING).csv(f"{folder}/{name}")
    texts = [f.name for f in raw.schema if isinstance(f.dataType, StringType)]
    return raw.withColumns({
        c: F.when(F.col(c) == _EMPTY, F.lit("")).otherwise(F.col(c)) for c in texts
    })


def load_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A bank table of a database, in its declared types.

    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` make Spark read
    it in parallel ranges; without them one task reads the whole table.
    """
    raw = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return as_declared(raw, name)


def as_declared(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a bank table in order and type, whatever case their names have.

    A database gives days as texts or wider numbers; a value that does not fit ends the reading.
    """
    given = {c.lower(): c for c in df.columns}
    missing = [f.name for f in SCHEMAS[name] if f.name not in given]
    if missing:
        raise ValueError(f"{name}: no column {', '.join(missing)}")
    return df.select(*[
        F.col(f"`{given[f.name]}`").cast(f.dataType).alias(f.name) for f in SCHEMAS[name]
    ])


def append(df: DataFrame, folder: str, name: str, partition_by: str | None = None) -> None:
    _writer(df, "append", partition_by).parquet(f"{folder}/{name}")


def recreate(df: DataFrame, folder: str, name: str, partition_by: str | None = None) -> None:
    """Write a table from nothing, replacing what is there."""
    _writer(df, "overwrite", partition_by).parquet(f"{folder}/{name}")


LEDGER_DAY = "fecha"


def save_ledger(tx: DataFrame, folder: str, name: str = "transacciones") -> None:
    """Write the ledger in one folder per event date.

    Rebalancing gathers the rows of a date into files of even size: small dates share a task
    and a date with very many rows is split over several.
    """
    dated = tx.withColumn(LEDGER_DAY, F.to_date("fecha_hora")).hint("rebalance", LEDGER_DAY)
    dated.write.mode("overwrite").partitionBy(LEDGER_DAY).parquet(f"{folder}/{name}")


def load_ledger(
    spark: SparkSession, folder: str, first=None, last=None, name: str = "transacciones"
) -> DataFrame:
    """The ledger of some dates; only their folders are read."""
    columns = SCHEMAS["transacciones"].fields
    dated = StructType([*columns, StructField(LEDGER_DAY, DateType())])
    df = spark.read.schema(dated).parquet(f"{folder}/{name}")
    if first is not None:
        df = df.filter(F.col(LEDGER_DAY) >= F.lit(first).cast("date"))
    if last is not None:
        df = df.filter(F.col(LEDGER_DAY) <= F.lit(last).cast("date"))
    return df.drop(LEDGER_DAY)


def _writer(df: DataFrame, mode: str, partition_by: str | None):
    writer = df.write.mode(mode)
    return writer.partitionBy(partition_by) if partition_by else writer
