"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables (op 3).

A rotation learned from a bounded sample (Gong and Lazebnik, 2011) turns unit vectors into
balanced binary codes. Codes are cut into substrings, one hash table each; vectors of a label
that share a substring meet in a bucket (Norouzi et al., 2012) and are reranked there with the
original vectors. Buckets are worked off in blocks, so a large bucket is spread over tasks; a
block returns counts and a spanning set of its links, never its pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.components import components
from caudal.llm.storage import stored

FIT_ROWS = 20_000  # bound of the sample that fits the rotation
FIT_ROUNDS = 50
SLOTS = 1 << 30
TABLE_BITS = 8
CHUNK_ROWS = 256  # a block compares at most two chunks
CELL_ROWS = 4_000  # rows of the blocks that one call works off


@dataclass(frozen=True)
class Quantiser:
    """64-bit code of a unit vector: signs of ``x @ planes``."""

    planes: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        signs = unit @ self.planes > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()


def fit(sample: np.ndarray, seed: int = 3) -> Quantiser:
    """Principal directions of the sample, then the rotation that brings it nearest to signs.

    The sample is not centred: links go by the angle at the origin, and around the mean of a
    large group of near copies signs would tell nothing but their noise apart.
    Short vectors get several rotations from different starts, so that codes have 64 bits.
    """
    bits = min(64, sample.shape[1])
    _, directions = np.linalg.eigh(sample.T @ sample)
    directions = directions[:, ::-1][:, :bits]
    projected = sample @ directions
    planes = []
    for start in range(-(-64 // bits)):
        random = np.random.default_rng(seed + start).standard_normal((bits, bits))
        rotation = np.linalg.qr(random)[0]
        for _ in range(FIT_ROUNDS):
            signs = np.where(projected @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ projected)
            rotation = (left @ right).T
        planes.append(directions @ rotation)
    return Quantiser(np.hstack(planes)[:, :64])


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of length one, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def block_links(
    unit: np.ndarray, codes: np.ndarray, weight: np.ndarray, right: np.ndarray,
    table: int, cosine: float, within: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of a block: the weight of its linked rows, and the least row linked to it
    over links of the block. Pairs that an earlier table has too are left to that table.

    ``right`` tells the two chunks apart; ``within`` is for a chunk compared with itself.
    """
    n = len(unit)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    if not within:
        near &= right[:, None] != right[None, :]
    if table and near.any():
        i, j = np.nonzero(near)
        differ = codes[i] ^ codes[j]
        early = np.zeros(len(i), bool)
        for t in range(table):
            mask = np.uint64(((1 << TABLE_BITS) - 1) << t * TABLE_BITS)
            early |= (differ & mask) == 0
        near[i[early], j[early]] = False
    linked = near @ weight
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(near, root[None, :], n).min(axis=1, initial=n))
        least = np.minimum(least, least[least])
        if (least == root).all():
            return linked, root
        root = least


def _blocks_of(cosine: float):
    def work(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        block = np.array(cell["block"].to_pylist(), np.int64)
        order = np.lexsort((cell["row"].to_numpy(), block))
        cell = cell.take(pa.array(order))
        block = block[order]
        rows = cell["row"].to_numpy()
        codes = cell["code"].to_numpy().view(np.uint64)
        weight = cell["weight"].to_numpy()
        right = cell["right"].to_numpy(zero_copy_only=False).astype(bool)
        tables = cell["tab"].to_numpy()
        within = cell["within"].to_numpy(zero_copy_only=False).astype(bool)
        ids = list(zip(*(cell[c].to_pylist() for c in ("label", "dim", "tab", "sub", "lo", "hi")),
                       strict=True))
        cuts = [k for k in range(1, len(ids)) if ids[k] != ids[k - 1]]
        out_row, out_n, out_root = [], [], []
        vectors = cell["embedding"].combine_chunks()
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if b - a < 2:
                continue
            unit = unit_rows(vectors.slice(a, b - a))
            n, root = block_links(unit, codes[a:b], weight[a:b], right[a:b], int(tables[a]),
                                  cosine, bool(within[a]))
            some = n > 0
            out_row.append(rows[a:b][some])
            out_n.append(n[some])
            out_root.append(rows[a:b][root[some]])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({
            "row": pa.array(join(out_row), pa.int64()), "n": pa.array(join(out_n), pa.int64()),
            "root": pa.array(join(out_root), pa.int64()),
        })

    return work


def links(vectors: DataFrame, cosine: float, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``row``, ``n`` (weight of linked rows), ``root`` (a row it is linked to over some links,
    or itself) from different vectors: ``row``, ``label``, ``embedding``, ``weight``.

    One row of ``vectors`` comes back once per block in which it has links.
    """
    part = math.ceil(SLOTS * min(1.0, fit_rows / max(1, vectors.count())))
    sample = vectors.filter(F.pmod(F.xxhash64("row"), F.lit(SLOTS)) < part)
    sampled = sample.select("embedding").toArrow()["embedding"].combine_chunks()
    sizes = np.array([len(v) for v in sampled.to_pylist()], np.int64)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    model = fit(unit_rows(sampled.filter(pa.array(sizes == dim)))) if dim else None

    def code(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            fits = np.array([n == dim for n in batch["dim"].to_pylist()], bool)
            if fits.any():
                found[fits] = model.codes(unit_rows(batch["embedding"].filter(pa.array(fits))))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["label"], batch["dim"], pa.array(found.view(np.int64))],
                ["row", "label", "dim", "code"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    coded = stored(
        vectors.select("row", "label", F.size("embedding").alias("dim"), "embedding")
        .mapInArrow(code, f"row long, label {kind}, dim int, code long"),
        "codes",
    )
    n_tables = 64 // TABLE_BITS
    mask = (1 << TABLE_BITS) - 1
    postings = coded.select("*", F.explode(F.array(*[F.lit(t) for t in range(n_tables)])).alias("tab"))
    postings = postings.withColumn(
        "sub", F.expr(f"shiftrightunsigned(code, tab * {TABLE_BITS}) & {mask}L")
    )
    key = ["label", "dim", "tab", "sub"]
    buckets = postings.groupBy(*key).count().filter("count > 1").select(
        *key, F.ceil(F.col("count") / CHUNK_ROWS).alias("chunks")
    )
    placed = postings.join(stored(buckets, "buckets"), key).withColumn(
        "chunk", F.pmod(F.xxhash64("row"), F.col("chunks"))
    )
    blocks = stored(
        placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o"))
        .select(
            "row", "code", *key,
            F.least("chunk", "o").alias("lo"), F.greatest("chunk", "o").alias("hi"),
            (F.col("chunk") > F.col("o")).alias("right"), (F.col("chunk") == F.col("o")).alias("within"),
        )
        .withColumn("block", F.xxhash64(*key, "lo", "hi")),
        "blocks",
    )
    cells = blocks.count() // CELL_ROWS + 1
    met = blocks.join(vectors.select("row", "embedding", "weight"), "row").withColumn(
        "cell", F.pmod(F.col("block"), F.lit(cells))
    )
    return met.groupBy("cell").applyInArrow(_blocks_of(cosine), "row long, n long, root long")


def embedding_groups(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked if their labels are equal and not null and their cosine, in double
    precision, is ``cosine`` or more; no pair below it is linked, and pairs whose codes differ
    in every substring are missed. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label, have no links and are components of their own.
    Vectors of different lengths are never linked; lengths other than the usual one are compared
    without codes. ``component_id`` is the smallest id reachable, ``kept`` is true where it is
    the row's own id (false for a null id). Equal vectors are compared as one and linked to each
    other; an empty table gives an empty result; other columns are not carried.
    """
    values = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = (
        F.col("label").isNotNull() & F.coalesce(F.size(values) > 0, F.lit(False))
        & F.forall(values, finite) & F.exists(values, lambda x: x != 0)
    )
    rows = stored(
        vectors.select(
            F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
            F.col(f"`{vector_col}`").alias("embedding"),
        ).withColumns({
            "own": F.monotonically_increasing_id(), "good": F.coalesce(good, F.lit(False)),
        }),
        "vectors",
    )
    classes = stored(
        rows.filter("good").groupBy("label", "embedding")
        .agg(F.min("own").alias("row"), F.count("*").alias("weight")),
        "classes",
    )
    found = stored(links(classes, cosine, fit_rows), "found")
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    roots = components(found, "row", "root").withColumnsRenamed({"node": "row"})
    known = stored(
        classes.join(counts, "row", "left").join(roots, "row", "left").select(
            "label", "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "row").alias("root"),
        ),
        "known",
    )
    joined = stored(
        rows.filter("good").join(known, ["label", "embedding"]).select("id", "n_links", "root"),
        "joined",
    )
    least = stored(joined.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    linked = joined.join(least, "root").select("id", "n_links", "component_id")
    alone = rows.filter("not good").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
