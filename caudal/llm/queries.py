"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm.bpe import bpe_tokens
from caudal.llm.checking_sql import merkle_sql, repair_sql
from caudal.llm.conversations import Repair, damaged
from caudal.llm.embedding_dedup import embedding_groups
from caudal.llm.maxent_lm import scores
from caudal.llm.merkle import folded, leaf_digest, manifest, proof_digest
from caudal.llm.mixing import kind_of_text, mix
from caudal.llm.packing import Packing
from caudal.llm.quality import decide, ledger
from caudal.llm.secrets import scan
from caudal.llm.sharding import shards
from caudal.llm.simhash import simhash_groups
from caudal.llm.substring_dedup import remove_repeats
from caudal.llm.token_counts import token_counts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), window=50)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"), shingle=4, distance=4)


def op3_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_groups(table(spark, folder, "embeddings"), cosine=0.93)


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards(table(spark, folder, "documents"), n_shards=8)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return decide(ledger(table(spark, folder, "documents")))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_tokens(
        table(spark, folder, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents")).drop("found")


#: Sources nearer to each other than they are, languages as wished, topics as they are.
MIXING_TARGETS = {
    "source": 0.5,
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "topic": 1.0,
}
#: Share of all tokens that the samples keep. Where a cell has too few tokens for its target even
#: with all its documents, it falls short; it does not thin the other cells.
MIXING_KEEP = 0.5


def mixing_dimensions() -> dict[str, Column]:
    return {
        "source": F.col("source"), "lang": F.col("lang"), "topic": kind_of_text(F.col("text")),
    }


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mix(docs, MIXING_TARGETS, mixing_dimensions(), keep=MIXING_KEEP)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, folder, "documents"), model, limit=4096)


def op10_maxent(spark: SparkSession, folder: str) -> DataFrame:
    return scores(table(spark, folder, "documents"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return Packing(table(spark, folder, "documents"), vocabulary, end_id=2, window=4096).pieces


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return Repair(damaged(table(spark, folder, "conversations")), gone_col="gone").report()


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = leaf_digest(*[lowered if c == "text" else F.col(c) for c in LEAF_FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)
    proved = manifest(table(spark, folder, "documents"), LEAF_FIELDS, carry={"tampered": tampered})
    return proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_simhash": op2_simhash,
    "op3_embeddings": op3_embeddings,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_maxent": op10_maxent,
    "op11_packing": op11_packing,
    "op12_repair": op12_repair,
    "op13_merkle": op13_merkle,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_substrings": f"""
        with w as (select doc_id, {_WORDS} ws from documents),
             win as (select doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) h
                     from w, unnest(range(1, len(ws)-48)) r(i)),
             least as (select h, min(doc_id) m from win group by h),
             gone as (select distinct doc_id, i+j pos
                      from win join least using (h), range(50) g(j) where m<doc_id),
             kept as (select w.doc_id, string_agg(ws[i], ' ' order by i) k, count(*) n
                      from w, unnest(range(1, len(ws)+1)) r(i)
                      where not exists (select 1 from gone
                                        where gone.doc_id=w.doc_id and pos=i) group by 1)
        select w.doc_id, cast(len(ws) as bigint) n_words,
               cast(len(ws)-coalesce(n, 0) as bigint) n_removed,
               sha256(coalesce(k, '')) kept_sha256
        from w left join kept using (doc_id)""",
    "op5_quality": f"""
        with t as (select doc_id, coalesce(text, '') t, {_WORDS} ws from documents),
             win as (select doc_id, i, array_to_string(ws[i:i+4], ' ') h
                     from t, unnest(range(1, len(ws)-3)) r(i)),
             twice as (select doc_id, i from win
                       qualify count(*) over (partition by doc_id, h)>1),
             covered as (select doc_id, count(distinct i+j) n from twice, range(5) g(j) group by 1),
             lines as (select doc_id, list_filter(string_split(t, chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from t),
             m as (select doc_id, cast(len(ws) as bigint) n_words,
                          cast(length(array_to_string(ws, '')) as bigint) word_chars,
                          cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
                          cast(len(ls)-len(list_distinct(ls)) as bigint) n_dup_lines,
                          coalesce(n, 0) n_repeat_words, cast(len(ls) as bigint) n_lines,
                          cast(length(regexp_replace(t, '[^!]', '', 'g')) as bigint) n_exclamations
                   from t join lines using (doc_id) left join covered using (doc_id)),
             b as (select *, cast(case when n_words<10 then 1 else 0 end
                        + case when 100*n_repeat_words>20*n_words then 2 else 0 end
                        + case when 100*n_symbols>30*n_words then 4 else 0 end
                        + case when n_exclamations>n_words then 8 else 0 end
                        + case when 100*n_dup_lines>60*n_lines then 16 else 0 end
                        + case when word_chars>40*n_words or 10*word_chars<12*n_words
                               then 32 else 0 end as bigint) fail_bits from m)
        select *, fail_bits&3<>0 base_failed, fail_bits=0 kept from b""",
    "op12_repair": repair_sql(),
    "op13_merkle": merkle_sql(),
}
