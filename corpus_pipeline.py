"""A corpus pipeline: quality rules, SimHash near-dedup, secret scans, mixing, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
A null, empty, repeated or very long text follows the rules of the operator of the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm.bpe import bpe_tokens
from caudal.llm.mixing import mix
from caudal.llm.quality import decide, ledger
from caudal.llm.queries import MIXING_KEEP, MIXING_TARGETS, mixing_dimensions
from caudal.llm.secrets import scan
from caudal.llm.simhash import keep_one
from caudal.operators.support import new_folder


def packed(docs: DataFrame) -> DataFrame:
    """Id and text, and the whole row in one column, out of the way of other names."""
    return docs.select("doc_id", "text", F.struct("*").alias("doc"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    book = decide(ledger(packed(docs), carry=("doc",)))
    return book.filter("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return keep_one(docs, shingle=4, distance=4)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; ``n_chars`` follows the text."""
    found = scan(packed(docs), carry=("doc",), mark="[secret]").select("doc", "found", "masked")
    changed = F.size("found") > 0
    text = F.when(changed, F.col("masked")).otherwise(F.col("doc.text"))
    fresh = found.withColumn("_text", text).withColumn(
        "_chars", F.when(changed, F.length("_text")).otherwise(F.col("doc.n_chars"))
    )
    columns = {"text": F.col("_text"), "n_chars": F.col("_chars").cast("long")}
    return fresh.select(*[columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target weights, with a stated share of the tokens kept."""
    drawn = mix(docs.select("*", F.struct("*").alias("_doc")), MIXING_TARGETS,
                mixing_dimensions(), keep=MIXING_KEEP, carry=("_doc",))
    return drawn.filter("sampled").select("_doc.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the decoded text."""
    return bpe_tokens(
        docs, public_tokenizers.path("word_bpe_49k.json"),
        outputs=("n_tokens", "ids", "decoded"), carry=("lang", "source"),
    )


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL cannot express SimHash, the trained models, raking or BPE: tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = new_folder(spark, name)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
