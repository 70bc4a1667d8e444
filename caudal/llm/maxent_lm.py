"""Language-model scores from a hashed maximum-entropy model (op 10).

The probability of a word is that of its class in its context times that of the word in its
class. Classes follow the ends of words. The first factor is a softmax over classes with hashed
features: the word before, the one before that (skip), and the ends of both (n-gram); the second
has a bias per word, whose fit is the word's smoothed share of its class. The first is trained by
gradient updates inside the partitions, whose weights are averaged between rounds (McDonald et
al., 2010); word counts are gathered over all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.blocks import LOWER, blocks, mix, text_bytes, word_hashes, words
from caudal.llm.storage import stored

CLASSES = 32
FEATURE_BITS = 12
ROWS = 1 << FEATURE_BITS
ROUNDS = 2
TRAIN_TASKS = 1024  # at most so many tasks return weights
RATE = 0.3
STEP_BYTES = 1 << 18
COUNT_WORDS = 1 << 20
TOP_WORDS = 1 << 17  # most frequent words that are sent to every executor
END = np.uint64(0x51AFD7ED558CCD6D)  # the hash of the end token


def held_out(id_col: str) -> Column:
    part = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7
    return F.coalesce(part == 2, F.lit(False))


@dataclass
class Tokens:
    """The tokens of a block: words and one end for every text."""

    hashes: np.ndarray
    classes: np.ndarray
    features: np.ndarray  # rows of weights, one column per feature
    edges: np.ndarray  # first token of every text, and the end of the last


def tokens(column: pa.Array) -> Tokens:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    n_texts = len(offsets) - 1
    edges = first + np.arange(n_texts + 1)
    total = int(edges[-1])
    last = edges[1:] - 1
    is_word = np.ones(total, bool)
    is_word[last] = False
    hashes = np.full(total, END, np.uint64)
    hashes[is_word] = word_hashes(data, starts, ends)
    tail = np.zeros(len(starts), np.uint64)
    if len(starts):
        tail = data[ends - 1].astype(np.uint64)
        longer = ends - starts > 1
        tail[longer] |= data[ends[longer] - 2].astype(np.uint64) << np.uint64(8)
    classes = np.zeros(total, np.int64)
    classes[is_word] = (mix(tail + np.uint64(1)) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    # what stands one and two tokens before; in front of a text stand its boundary marks
    one, two = np.full(total, 1, np.uint64), np.full(total, 2, np.uint64)
    end_one, end_two = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    place = np.arange(total) - np.repeat(edges[:-1], np.diff(edges))
    kinds = classes.astype(np.uint64)
    later, third = np.flatnonzero(place > 0), np.flatnonzero(place > 1)
    one[later], end_one[later] = hashes[later - 1], kinds[later - 1]
    two[third], end_two[third] = hashes[third - 2], kinds[third - 2]
    mask = np.uint64(ROWS - 1)
    features = np.stack([
        mix(one) & mask,
        mix(two ^ np.uint64(0x5BF03635)) & mask,
        mix(end_one * np.uint64(977) + end_two + np.uint64(0x9E3779B1)) & mask,
    ], axis=1).astype(np.int64)
    features += np.arange(3) * ROWS
    return Tokens(hashes, classes, features, edges)


def log_classes(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural logarithms of the class probabilities of every token (the last row is a bias)."""
    z = weights[features[:, 0]]
    z += weights[features[:, 1]]
    z += weights[features[:, 2]]
    z += weights[-1]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def update(weights: np.ndarray, squares: np.ndarray, seen: Tokens) -> None:
    """One gradient step on a block, scaled per weight by its past gradients."""
    error = np.exp(log_classes(weights, seen.features))
    error[np.arange(len(error)), seen.classes] -= 1
    for column in range(seen.features.shape[1]):
        rows = seen.features[:, column]
        order = np.argsort((rows & (ROWS - 1)).astype(np.uint16), kind="stable")
        ranked = rows[order]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        _step(weights, squares, ranked[heads], np.add.reduceat(error[order], heads, axis=0))
    _step(weights, squares, np.array([len(weights) - 1]), error.sum(axis=0, keepdims=True))


def _step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray):
    squares[rows] += gradient * gradient
    weights[rows] -= RATE * gradient / np.sqrt(squares[rows] + 1e-6)


def train_classes(docs: DataFrame, text_col: str) -> np.ndarray:
    """Weights of the class model from the documents given, one pass in ``ROUNDS`` rounds.

    A round takes the documents whose text hash falls to it. Each task starts from the common
    weights, updates them block by block and returns its change, one row per feature row;
    changes are averaged by tokens. The weights have a fixed size.
    """
    weights = np.zeros((3 * ROWS + 1, CLASSES), np.float32)
    names = [f"c{k}" for k in range(CLASSES)]
    for part in range(ROUNDS):
        start = weights

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, squares, n = start.copy(), np.zeros_like(start), 0
            for block in blocks(batches, "text", STEP_BYTES):
                seen = tokens(block["text"])
                update(own, squares, seen)
                n += len(seen.classes)
            if n:
                change = (own - start).astype(np.float64) * n
                used = np.flatnonzero(np.abs(change).max(axis=1) > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(used, -1)), pa.array(np.append(np.zeros(len(used)), n)),
                     *(pa.array(np.append(change[used, k], 0.0)) for k in range(CLASSES))],
                    ["row", "n", *names],
                )

        chosen = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)) == part)
        changes = (
            chosen.select(F.col(text_col).alias("text")).coalesce(TRAIN_TASKS)
            .mapInArrow(learn, ", ".join(["row long", "n double", *(f"{c} double" for c in names)]))
            .groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
        ).toArrow()  # at most one row per feature row
        rows = changes["row"].to_numpy()
        total = changes["n"].to_numpy()[rows == -1].sum()
        if total:
            moved = np.stack([changes[c].to_numpy() for c in names], axis=1) / total
            weights = weights.copy()
            weights[rows[rows >= 0]] += moved[rows >= 0].astype(np.float32)
    return weights


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``hash``, ``class`` and ``c`` of every different token, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            hashes, at, n = np.unique(
                np.concatenate([h for h, _ in parts]), return_index=True, return_counts=True
            )
            kinds = np.concatenate([k for _, k in parts])[at]
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(kinds.astype(np.int32)), pa.array(n)],
                ["hash", "class", "n"],
            )

        parts, size = [], 0
        for block in blocks(batches, "text"):
            seen = tokens(block["text"])
            parts.append((seen.hashes, seen.classes))
            size += len(seen.hashes)
            if size > COUNT_WORDS:
                yield summed(parts)
                parts, size = [], 0
        if parts:
            yield summed(parts)

    return (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(count, "hash long, class int, n long")
        .groupBy("hash").agg(F.first("class").alias("class"), F.sum("n").alias("c"))
    )


def frequent(counts: DataFrame, most: int = TOP_WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """A count from which on there are at most ``most`` words, and those words' hashes (sorted)
    and counts."""
    level = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    sizes = {r["level"]: r["count"] for r in
             counts.groupBy(level.alias("level")).count().collect()}  # at most 64 rows
    room, least = most, 1 << 62
    for k in sorted(sizes, reverse=True):
        if sizes[k] > room:
            break
        room -= sizes[k]
        least = 1 << k
    top = counts.filter(F.col("c") >= least).select("hash", "c").toArrow()
    hashes = top["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return least, hashes[order], top["c"].to_numpy()[order]


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    top_words: int = TOP_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``.

    Tokens are the words of the text with A-Z lower-cased, then one end; a null text counts as
    empty, its only token is the end. Documents whose crc32 of the id as text leaves 2 modulo 7
    are held out; rows with a null id are not. ``base_score`` sums log10((c + 1) / (N + V + 1))
    over the tokens (c, N, V: count of the token, of all, and of different training tokens);
    ``score`` is the model's log10 probability. Repeated rows come back as often as they came; an
    empty table gives an empty result; other columns are not carried.

    Tokens are told apart by 64-bit hashes. The most frequent words (at most ``top_words``) go to
    every executor; the others meet their counts in a join on the hash.
    """
    read = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
        held_out(id_col).alias("held_out"),
    )
    training = read.filter("not held_out")
    counts = stored(word_counts(training, "text"), "counts")
    classes = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    total = sum(r["n"] for r in classes)
    different = sum(r["v"] for r in classes)
    in_class = np.zeros(CLASSES)
    for r in classes:  # one row per class
        in_class[r["class"]] = r["n"] + r["v"]
    log_class = np.log10(in_class + 1)
    least, top, top_count = frequent(counts, top_words)
    top_log = np.log10(top_count + 1.0)
    weights = train_classes(training, "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            seen = tokens(block["text"])
            n = len(seen.hashes)
            at = np.minimum(np.searchsorted(top, seen.hashes), max(len(top) - 1, 0))
            known = top[at] == seen.hashes if len(top) else np.zeros(n, bool)
            logs = np.zeros(n)
            logs[known] = top_log[at[known]]
            likely = np.empty(n)
            for a in range(0, n, 1 << 15):
                part = slice(a, a + (1 << 15))
                found = log_classes(weights, seen.features[part])
                likely[part] = found[np.arange(len(found)), seen.classes[part]]
            likely = likely / np.log(10) - log_class[seen.classes]
            begin = seen.edges[:-1]
            # the rest: one entry per text and word
            owner = np.repeat(np.arange(len(begin)), np.diff(seen.edges))[~known]
            rest = seen.hashes[~known]
            order = np.lexsort((rest, owner))
            owner, rest = owner[order], rest[order]
            new = np.ones(len(rest), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (rest[1:] != rest[:-1])
            heads = np.flatnonzero(new)
            times = np.diff(np.append(heads, len(rest)))
            cuts = np.searchsorted(owner[heads], np.arange(len(begin) + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(
                pa.array(cuts),
                pa.StructArray.from_arrays(
                    [pa.array(rest[heads].view(np.int64)), pa.array(times)], ["hash", "n"]
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    block["id"], block["held_out"], pa.array(np.diff(seen.edges)),
                    pa.array(np.add.reduceat(known.astype(np.int64), begin)),
                    pa.array(np.add.reduceat(logs, begin)),
                    pa.array(np.add.reduceat(likely, begin)), listed,
                ],
                ["id", "held_out", "n_tokens", "known", "logs", "likely", "rest"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    read_once = read.mapInArrow(
        score,
        f"id {kind}, held_out boolean, n_tokens long, known long, logs double, likely double,"
        " rest array<struct<hash: long, n: long>>",
    ).withColumn("row", F.monotonically_increasing_id())
    scored = stored(read_once, "scored")
    rare = scored.select("row", F.explode("rest").alias("r")).select("row", "r.hash", "r.n")
    met = rare.join(counts.filter(F.col("c") < least).select("hash", "c"), "hash")
    rest = met.groupBy("row").agg(
        F.sum("n").alias("rest_known"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rest_logs"),
    )
    whole = scored.drop("rest").join(rest, "row", "left")
    logs = F.col("logs") + F.coalesce("rest_logs", F.lit(0.0))
    every = float(np.log10(total + different + 1.0))
    return whole.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        (logs + F.col("likely")).alias("score"),
    )
