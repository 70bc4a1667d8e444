"""SimHash near-dedup by a positional byte index with count filtering (op 2)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from caudal.llm.blocks import LOWER, blocks, ragged, text_bytes, words
from caudal.llm.components import components
from caudal.llm.storage import join_shuffled, stored

HASH_SEED = 42
N_BYTES = 8


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The 64-bit SimHash of every text of a block."""
    n_docs = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    prints = np.zeros(n_docs, np.uint64)
    if not len(starts):
        return prints
    # the words of the block, lower-cased and joined by one space
    sizes = ends - starts
    joined = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    at = np.cumsum(sizes + 1) - sizes - 1
    joined[ragged(at, sizes)] = LOWER[data[ragged(starts, sizes)]]
    raw = joined.tobytes()
    counts = np.diff(first)
    per_doc = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    begin = ragged(first[:-1], per_doc)
    last = np.minimum(begin + shingle, np.repeat(first[1:], per_doc)) - 1
    pairs = zip(at[begin].tolist(), (at[last] + sizes[last]).tolist(), strict=True)
    hashes = np.fromiter(
        (xxh64_intdigest(raw[i:j], HASH_SEED) for i, j in pairs), np.uint64, len(begin)
    )
    some = np.flatnonzero(per_doc)
    edges = np.cumsum(per_doc)[some] - per_doc[some]
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    majority = 2 * ones > per_doc[some][:, None]
    packed = np.packbits(majority, axis=1, bitorder="little")
    prints[some] = packed.view("<u8").ravel()
    return prints


def fingerprints(
    docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id and ``print`` (64 bits in a long)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            prints = fingerprints_of(*text_bytes(block["text"]), shingle)
            yield pa.RecordBatch.from_arrays(
                [block["id"], pa.array(prints.view(np.int64))], ["id", "print"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(compute, f"id {kind}, print long")
        .withColumnRenamed("id", id_col)
    )


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    same = [
        (a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(255 << 8 * i))) == 0).cast("int")
        for i in range(N_BYTES)
    ]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def positional_index(prints: DataFrame, matches: int) -> DataFrame:
    """Postings of different fingerprints: for every choice of ``matches`` byte positions, the
    chosen positions and their bytes as one key."""
    keys = []
    for k, chosen in enumerate(combinations(range(N_BYTES), matches)):
        mask = sum(255 << 8 * i for i in chosen)
        keys.append(
            F.struct(
                F.lit(k).cast("short").alias("choice"),
                F.col("print").bitwiseAND(F.lit(_signed(mask))).alias("bytes"),
            )
        )
    return prints.select("print", F.explode(F.array(*keys)).alias("p")).select(
        "print", "p.choice", "p.bytes"
    )


def first_choice(a: Column, b: Column, matches: int) -> Column:
    """The number of the first choice of positions on which two fingerprints agree."""
    out = F.lit(None).cast("short")
    for k, chosen in reversed(list(enumerate(combinations(range(N_BYTES), matches)))):
        mask = _signed(sum(255 << 8 * i for i in chosen))
        agree = a.bitwiseXOR(b).bitwiseAND(F.lit(mask)) == 0
        out = F.when(agree, F.lit(k).cast("short")).otherwise(out)
    return out


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints at ``distance`` or fewer differing bits.

    Bits that differ touch at most ``distance`` of the eight bytes, so linked fingerprints share
    at least ``8 - distance`` positional bytes: the guaranteed number of matches. The index is
    kept by that many positions at once, which is where a pair's tally reaches the number;
    a pair with more shared bytes is taken only under its first choice of positions. Tally and
    distance are conditions of the join, so only links come out, each once. The index has a row
    per choice of positions (70 at four) for each print; Spark's size for it does not count them.
    """
    if not 0 <= distance < N_BYTES:
        raise ValueError("the byte index needs a distance of 0 to 7 bits")
    matches = N_BYTES - distance
    index = positional_index(prints.select("print").distinct(), matches)
    a, b = index.alias("a"), index.alias("b")
    pa_, pb = F.col("a.print"), F.col("b.print")
    near = F.bit_count(pa_.bitwiseXOR(pb)) <= distance
    return join_shuffled(
        a,
        b,
        (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.bytes") == F.col("b.bytes"))
        & (pa_ < pb)
        & near
        & (shared_bytes(pa_, pb) >= matches)
        & (first_choice(pa_, pb, matches) == F.col("a.choice")),
    ).select(pa_.alias("a"), pb.alias("b"))


def simhash_groups(
    docs: DataFrame,
    shingle: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    A-Z are lower-cased, words are runs outside ``\\x20`` and ``\\x09-\\x0D``, shingles are runs
    of ``shingle`` words with repeats; a text with fewer words is one shingle, and a null, empty
    or blank text has fingerprint zero, linked like any other. ``component_id`` is the smallest
    id reachable over links of ``distance`` or fewer differing bits. Rows with a null id are
    grouped too, but give no component their id; a component of such rows only has a null id.
    Repeated rows come back as often as they came; an empty table gives an empty result; other
    columns are not carried.

    Copies meet in one fingerprint before anything is compared, so a group of equal texts costs
    one posting whatever its size.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "prints")
    nodes = prints.groupBy("print").agg(F.min(id_col).alias("least"))
    found = components(links(prints, distance), "a", "b")
    rooted = join_shuffled(nodes, found, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    labels = stored(
        join_shuffled(rooted, least, "root").select("print", "component_id"), "labels"
    )
    return join_shuffled(prints, labels, "print").select(
        id_col, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    shingle: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with one of each group: the smallest id, rows without an id last.

    Rows are told apart by their id and a hash of all columns, so repeated rows end as one.
    """
    ident = F.col(f"`{id_col}`")
    key = F.struct(
        ident.isNull().alias("none"),
        F.coalesce(ident, F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"),
    )
    keyed = docs.select(F.struct("*").alias("doc"), F.col(f"`{text_col}`").alias("text"),
                        key.alias("key"))
    groups = simhash_groups(keyed, shingle, distance, "key", "text")
    kept = stored(groups.filter("key = component_id").select("key").distinct(), "kept")
    return (
        join_shuffled(keyed, kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
    )
