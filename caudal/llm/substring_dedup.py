"""Substring dedup by a compacted De Bruijn graph over words (op 1).

Edges of the graph are windows of ``window`` consecutive words. They are never listed one by
one: consecutive windows of a text that share their least ``k``-word anchor form one run
(minimiser partitioning, Roberts et al., 2004; Chikhi et al., 2016). Runs meet by their anchor.
An anchor whose runs are all alike is an unbranched path and is settled as a whole. Only where
different runs share an anchor, once per different run, are the windows themselves compared.
Joined paths carry the source's place, and the source's words are compared before anything goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.blocks import Runs, blocks, ragged, text_bytes, word_hashes, words
from caudal.llm.storage import stored

WINDOW = 50
ANCHOR = 8


def runs_of(
    data: np.ndarray, offsets: np.ndarray, window: int, k: int
) -> tuple[np.ndarray, ...]:
    """All runs of a block: text index, anchor hash, run hash, first word, number of windows."""
    starts, ends, first = words(data, offsets)
    n = len(starts)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    hashed = Runs(word_hashes(data, starts, ends))
    at = np.arange(n - k + 1)
    anchors = hashed.of(at, at + k)
    width = window - k + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    begin = np.flatnonzero(np.arange(n - window + 1) + window <= first[text[: n - window + 1] + 1])
    if not len(begin):
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    view = np.lib.stride_tricks.sliding_window_view(anchors, width)
    least = view.argmin(axis=1)[begin] + begin
    new = np.ones(len(begin), bool)
    new[1:] = (least[1:] != least[:-1]) | (begin[1:] != begin[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(begin)))
    start = begin[head]
    run = hashed.of(start, start + count - 1 + window)
    owner = text[start]
    return owner, anchors[least[head]], run, start - first[owner], count


def _runs(window: int, k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            owner, anchor, run, start, count = runs_of(*text_bytes(block["text"]), window, k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)),
                    block["id"].take(pa.array(owner)), block["key"].take(pa.array(owner)),
                    pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                ],
                ["anchor", "run", "id", "key", "start", "n"],
            )

    return emit


def _words(text: str | None) -> list[bytes]:
    # bytes.split() cuts at \x20 and \x09-\x0D
    return (text or "").encode().split()


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish the texts without shared anchors; pass the others on."""
    for block in blocks(batches, "text"):
        counts, digests, texts = [], [], []
        for text, shared in zip(block["text"].to_pylist(), block["hit"].to_pylist(), strict=True):
            found = [] if shared else _words(text)
            counts.append(None if shared else len(found))
            digests.append(None if shared else _digest(found))
            texts.append(text if shared else None)
        yield pa.RecordBatch.from_arrays(
            [block["id"], block["key"], pa.array(texts, pa.string()), block["listed"],
             pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
            ["id", "key", "text", "listed", "n_words", "kept_sha256"],
        )


def _windows(window: int):
    """Every window of the listed runs: its hash and where it stands."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = text_bytes(block["text"])
            starts, ends, first = words(data, offsets)
            hashed = Runs(word_hashes(data, starts, ends))
            listed = block["listed"].to_pylist()
            owner = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
            column = lambda name: np.array([r[name] for x in listed for r in x], np.int64)
            start, n = column("start"), column("n")
            at = ragged(start, n)
            offset = at - np.repeat(start, n)
            base = np.repeat(first[owner], n)
            whole = hashed.of(base + at, base + at + window)
            owner_of = pa.array(np.repeat(owner, n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(whole.view(np.int64)), pa.array(np.repeat(column("anchor"), n)),
                    pa.array(np.repeat(column("run"), n)), pa.array(offset.astype(np.int32)),
                    block["id"].take(owner_of), block["key"].take(owner_of),
                    pa.array(at.astype(np.int32)),
                ],
                ["hash", "anchor", "run", "offset", "id", "key", "at"],
            )

    return emit


def _proofs(window: int):
    """The digest of the words at every listed place of a source."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            keys, places, sizes, digests = [], [], [], []
            rows = zip(block["key"].to_pylist(), block["text"].to_pylist(),
                       block["listed"].to_pylist(), strict=True)
            for key, text, listed in rows:
                found = _words(text)
                for r in listed:
                    keys.append(key)
                    places.append(r["src_at"])
                    sizes.append(r["n"])
                    digests.append(_digest(found[r["src_at"] : r["src_at"] + r["n"] - 1 + window]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(places, pa.int32()),
                 pa.array(sizes, pa.int32()), pa.array(digests, pa.string())],
                ["src_key", "src_at", "n", "proof"],
            )

    return emit


def _remove(window: int):
    """Take out the words of proven spans."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            counts, removed, digests = [], [], []
            for text, listed in zip(
                block["text"].to_pylist(), block["listed"].to_pylist(), strict=True
            ):
                found = _words(text)
                gone = np.zeros(len(found), bool)
                for r in listed or []:
                    end = r["at"] + r["n"] - 1 + window
                    if _digest(found[r["at"] : end]) == r["proof"]:
                        gone[r["at"] : end] = True
                counts.append(len(found))
                removed.append(int(gone.sum()))
                digests.append(_digest([w for w, g in zip(found, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays(
                [block["id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256"],
            )

    return emit


def _joined_up(claims: DataFrame, owner: list[str], at: str) -> DataFrame:
    """Join claims that follow each other in the text and in their source."""
    path = [*owner, "src_id", "src_key", "_diagonal"]
    ahead = Window.partitionBy(*path).orderBy(at)
    reach = F.max(F.col(at) + F.col("n")).over(
        ahead.rowsBetween(Window.unboundedPreceding, -1)
    )
    marked = claims.withColumn("_diagonal", F.col("src_at") - F.col(at)).withColumn(
        "_new", F.when(F.col(at) <= reach, 0).otherwise(1)
    )
    numbered = marked.withColumn("_path", F.sum("_new").over(ahead))
    return numbered.groupBy(*path, "_path").agg(
        F.min(at).alias(at), F.min("src_at").alias("src_at"),
        (F.max(F.col(at) + F.col("n")) - F.min(at)).cast("int").alias("n"),
    ).drop("_path", "_diagonal")


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller id; all windows are judged on the input. Words are runs outside ``\\x20`` and
    ``\\x09-\\x0D``, unchanged. A null or blank text has no words and the digest of an empty
    text; texts shorter than a window stay whole. Rows with a null id neither give nor lose
    words. Repeated rows have equal ids, so they do not take from each other. An empty table
    gives an empty result; other columns are not carried.

    Hashes are 64 bits and only propose: a span goes if its words have the SHA-256 digest of the
    words at the source's place. The texts are shuffled once; after that only the texts with a
    shared anchor are read. Hot passages are pre-aggregated per anchor and run, and joins back to
    their many places run against stored tables, where Spark can split them.
    """
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    read = read.withColumn("key", F.xxhash64("id", "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    runs = stored(
        read.filter("id is not null and text is not null").mapInArrow(
            _runs(window, anchor),
            f"anchor long, run long, id {kind}, key long, start int, n int",
        ),
        "runs",
    )
    shared = stored(
        runs.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        .filter("a < b").select("anchor"),
        "anchors",
    )
    hits = stored(runs.join(shared, "anchor"), "hits")
    alike = hits.groupBy("anchor").agg((F.min("run") < F.max("run")).alias("branches"))
    kinds = hits.groupBy("anchor", "run").agg(
        F.min(F.struct("id", "key", "start")).alias("src"), F.first("n").alias("n")
    )
    kinds = stored(kinds.join(stored(alike, "branches"), "anchor"), "kinds")

    listed = (
        kinds.filter("branches").groupBy(F.col("src.key").alias("key"))
        .agg(F.collect_list(F.struct("anchor", "run", F.col("src.start").alias("start"), "n"))
             .alias("listed"))
    )
    marks = stored(
        hits.groupBy("key").agg(F.lit(True).alias("hit")).join(listed, "key", "left"), "marks"
    )
    entry = "struct<anchor: long, run: long, start: int, n: int>"
    texts = stored(
        read.join(marks, "key", "left").select(
            "id", "key", "text", F.coalesce("hit", F.lit(False)).alias("hit"), "listed"
        ).mapInArrow(
            _sort_out,
            f"id {kind}, key long, text string, listed array<{entry}>, n_words long,"
            " kept_sha256 string",
        ),
        "texts",
    )
    affected = texts.filter("n_words is null")

    # windows of runs that branch, each different run once
    single = stored(
        affected.filter("listed is not null").dropDuplicates(["key"]).mapInArrow(
            _windows(window),
            f"hash long, anchor long, run long, offset int, id {kind}, key long, at int",
        ),
        "windows",
    )
    first = single.groupBy("hash").agg(
        F.min(F.struct("id", "key", "at")).alias("src"), F.count("*").alias("c")
    ).filter("c > 1")
    met = single.join(stored(first.drop("c"), "sources"), "hash")
    own = kinds.filter("branches").select(
        "anchor", "run", F.lit(0).alias("offset"), "n", F.col("src.id").alias("src_id"),
        F.col("src.key").alias("src_key"), F.col("src.start").alias("src_at"),
    )
    branched = met.select(
        "anchor", "run", "offset", F.lit(1).alias("n"), F.col("src.id").alias("src_id"),
        F.col("src.key").alias("src_key"), F.col("src.at").alias("src_at"),
    )
    plain = own.unionByName(
        kinds.filter("not branches").select(
            "anchor", "run", F.lit(0).alias("offset"), "n", F.col("src.id").alias("src_id"),
            F.col("src.key").alias("src_key"), F.col("src.start").alias("src_at"),
        )
    )
    paths = stored(
        _joined_up(branched, ["anchor", "run"], "offset").unionByName(plain), "paths"
    )
    claims = hits.select("anchor", "run", "id", "key", "start").join(paths, ["anchor", "run"]).filter(
        "id > src_id"
    ).select("key", (F.col("start") + F.col("offset")).alias("at"), "n", "src_id", "src_key", "src_at")
    spans = stored(_joined_up(claims.distinct(), ["key"], "at"), "spans")

    wanted = spans.select("src_key", "src_at", "n").distinct().groupBy(
        F.col("src_key").alias("key")
    ).agg(F.collect_list(F.struct("src_at", "n")).alias("listed"))
    proofs = stored(
        affected.select("key", "text").dropDuplicates(["key"]).join(wanted, "key").mapInArrow(
            _proofs(window), "src_key long, src_at int, n int, proof string"
        ),
        "proofs",
    )
    proven = spans.join(proofs, ["src_key", "src_at", "n"]).groupBy("key").agg(
        F.collect_list(F.struct("at", "n", "proof")).alias("listed")
    )
    shortened = affected.select("id", "key", "text").join(proven, "key", "left").mapInArrow(
        _remove(window), f"id {kind}, n_words long, n_removed long, kept_sha256 string"
    )
    whole = texts.filter("n_words is not null").select(
        "id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"
    )
    return shortened.unionByName(whole).withColumnRenamed("id", id_col)
