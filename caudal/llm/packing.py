"""Packing token sequences by non-negative least squares (op 11).

Documents are encoded once. What fills whole windows stands alone; the rest of each document, its
item, is counted by length class. All combinations of up to ``depth`` classes that add up to one
window are enumerated, the numbers of their repeats are the non-negative least squares solution
against the histogram, rounded down. Items take the slots of the combinations by their rank in
their class. The residual items, in order, fill what these sequences leave open and then further
sequences, cut where one is full; the very end goes to sequences whose lengths are powers of two,
which need no padding. So no sequence is padded.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.blocks import blocks
from caudal.llm.bpe import encode_words, load_vocabulary, split_chunks
from caudal.llm.positions import prefix
from caudal.llm.storage import stored

BLOCK_BYTES = 8 << 20
MEMO_CHUNKS = 400_000
#: A word of its own between two chunks, and four bytes that no two neighbouring ids hold.
MARK = "\0"
BETWEEN = f" {MARK} "
MARK_BYTES = b"\xff" * 4
STOPS = ".,;:!?"
#: Tokens per cell in which open places and residual items are laid side by side.
CELL = 1 << 16


# ---- encoding -----------------------------------------------------------------------


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the library gives them.

    Texts are cut at the white space that no token crosses, chunks into the vocabulary's words.
    Chunks and words met before are looked up, each new word is encoded once, all new ones of a
    block together. Full memos (``MEMO_CHUNKS``) are emptied. A Python worker keeps its encoder
    from task to task.
    """

    def __init__(self, path: str) -> None:
        self.vocab = load_vocabulary(path)
        self.special = {
            name: np.array([i], "<u4").tobytes() for name, i in self.vocab.special.items()
        }
        self.chunks = dict(self.special)
        self.words: dict[str, bytes] = {MARK: MARK_BYTES}
        self.null = encode_words(self.vocab, [MARK.encode()])[0].astype("<u4").tobytes()
        self.letters = all(
            self.vocab.word.findall(f"az s{x} b{x}") == ["az", "s", x, "b", x] for x in STOPS
        )
        self.marked = self.vocab.word.findall(f"a{BETWEEN}b") == ["a", MARK, "b"]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > MEMO_CHUNKS:
            self.chunks = dict(self.special)
        if len(self.words) > MEMO_CHUNKS:
            self.words = {MARK: MARK_BYTES}
        cut = [split_chunks(self.vocab, text) for text in texts]
        fresh = set().union(*cut).difference(self.chunks)
        alone, ended, plain, odd = self._sorted(fresh)
        low, heads = [c.lower() for c in alone], [c[:-1].lower() for c in ended]
        words = self._words(BETWEEN.join(plain))
        self._learn({*words, *low, *heads, *STOPS})
        of = self.words.__getitem__
        self.chunks.update(zip(alone, map(of, low), strict=True))
        self.chunks.update((c, of(h) + of(c[-1])) for c, h in zip(ended, heads, strict=True))
        raw = b"".join(map(of, words))
        self.chunks.update(zip(plain, raw.split(MARK_BYTES), strict=bool(plain)))
        for chunk in odd:
            words = self._words(chunk)
            self._learn(set(words))
            self.chunks[chunk] = b"".join(
                self.null if w == MARK else self.words[w] for w in words
            )
        known = self.chunks.__getitem__
        return [b"".join(map(known, chunks)) for chunks in cut]

    def _sorted(self, fresh: set[str]) -> tuple[list[str], ...]:
        """Chunks that are one word of letters, such with a stop behind, others, and the odd ones
        that hold the mark."""
        alone, ended, plain, odd = [], [], [], []
        for c in fresh:
            if self.letters and c.isascii():
                if c.isalpha():
                    alone.append(c)
                    continue
                if c[-1] in STOPS and c[:-1].isalpha():
                    ended.append(c)
                    continue
            (plain if self.marked and MARK not in c else odd).append(c)
        return alone, ended, plain, odd

    def _words(self, text: str) -> list[str]:
        """The words of one chunk, or of many with a mark between them."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.vocab.word.findall(text.lower())

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        ids, sizes = encode_words(self.vocab, [w.encode() for w in new])
        raw, at = ids.astype("<u4").tobytes(), 0
        for word, end in zip(new, (np.cumsum(sizes) * 4).tolist(), strict=True):
            self.words[word] = raw[at:end]
            at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_ITEM = (
    "part long, row long, doc_tokens long, windows_before long, item int, class int, "
    "rank long, item_crc long, window_crcs array<long>, ids binary"
)


def items_of(
    docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, window: int,
    unit: int,
) -> DataFrame:
    """One row per document: its ids with the end, and its item (what is left of whole windows).

    ``part`` and ``row`` name a document for the steps that follow, ``rank`` counts the items of
    a class and ``windows_before`` the whole windows within a part. The rows must be stored: a part
    is what one task has seen.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, full = TaskContext.get().partitionId(), 0, 0
        ranks: dict[int, int] = {}
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = pc.fill_null(block["text"], "").to_pylist()
            rows = []
            for raw in encoder(vocabulary).encode(texts):
                ids = memoryview(raw + end)
                n = len(ids) // 4
                windows, item = divmod(n, window)
                level = -(-item // unit)
                rank = ranks.get(level, 0)
                ranks[level] = rank + 1
                crcs = [zlib.crc32(ids[k * window * 4 : (k + 1) * window * 4])
                        for k in range(windows)]
                rows.append((part, row, n, full, item, level, rank,
                             zlib.crc32(ids[windows * window * 4 :]), crcs, bytes(ids)))
                row += 1
                full += windows
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 2
            types += [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [block["id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["id", *(f.split()[0] for f in _ITEM.split(", "))],
            )

    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(encode, f"id {kind}, {_ITEM}")


# ---- the plan, from counts per length class -----------------------------------------


def combinations(classes: int, depth: int) -> np.ndarray:
    """Column per combination of at most ``depth`` classes (1 to ``classes``) of that sum."""
    found: list[tuple[int, ...]] = []

    def extend(taken: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(taken)
        elif len(taken) < depth:
            least = -(-left // (depth - len(taken)))
            for c in range(min(most, left), least - 1, -1):
                extend((*taken, c), left - c, c)

    extend((), classes, classes)
    out = np.zeros((classes, len(found)))
    for k, taken in enumerate(found):
        for c in taken:
            out[c - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by the active sets of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    passive: list[int] = []
    for _ in range(3 * a.shape[1]):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance:
            break
        passive.append(best)
        while True:
            solved = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[passive] = solved
                break
            now = x[passive]
            low = solved <= 0
            step = np.min(now[low] / np.maximum(now[low] - solved[low], 1e-300))
            now = now + step * (solved - now)
            now[low & (now <= tolerance * 1e-3)] = 0
            if not (now == 0).any():
                now[np.argmin(np.where(low, now, np.inf))] = 0
            x[:] = 0
            x[passive] = now
            passive = [p for p, v in zip(passive, now, strict=True) if v > 0]
            if not passive:
                break
    return x


def repeats(counts: np.ndarray, unit: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations in use (a column each) and how often each is repeated.

    Rounded down so that no class is used beyond its count, and scaled back until the shortest
    tokens that the residual items can have cover the most that the sequences can leave open.
    """
    a = combinations(len(counts), depth)
    total = counts.sum()
    if not total:
        return a[:, :0], np.zeros(0, np.int64)
    weight = np.arange(1, len(counts) + 1) / len(counts)
    x = nnls(a * weight[:, None], counts / total * weight) * total
    use = np.flatnonzero(x >= 1)
    a, x = a[:, use].astype(np.int64), np.floor(x[use]).astype(np.int64)
    for c in range(len(counts)):
        over = int(a[c] @ x - counts[c])
        for k in np.flatnonzero(a[c]):
            if over > 0:
                less = min(int(x[k]), -(-over // int(a[c, k])))
                x[k] -= less
                over -= less * int(a[c, k])
    shortest = np.arange(len(counts)) * unit + 1

    def covered(times: np.ndarray) -> bool:
        used = a @ times
        return (counts - used) @ shortest >= used.sum() * (unit - 1)

    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2 if not covered(x) else high
        if covered(np.floor(x * middle).astype(np.int64)):
            low = middle
        else:
            high = middle
        if low == high:
            break
    x = np.floor(x * low).astype(np.int64)
    return a[:, x > 0], x[x > 0]


def slots_of(a: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of a class go by rank: (class, from, to, per sequence, sequence, slot)."""
    out = []
    taken = np.zeros(len(a), np.int64)
    sequence = 0
    for k, times in enumerate(x.tolist()):
        slot = 0
        for c in np.flatnonzero(a[:, k])[::-1].tolist():
            per = int(a[c, k])
            out.append((c + 1, int(taken[c]), int(taken[c]) + per * times, per, sequence, slot))
            taken[c] += per * times
            slot += per
        sequence += times
    return out


# ---- the pieces ---------------------------------------------------------------------


def _fill(residual: DataFrame, open_: DataFrame, total: int) -> DataFrame:
    """Residual tokens 0 to ``total`` laid over the open places of the sequences.

    Both are runs of one line of tokens. Within a cell of the line the starts of both are put in
    order, and every step from one start to the next belongs to the last item and the last place
    begun: no pairs are formed.
    """
    def cells(df: DataFrame, start: str, size: str) -> DataFrame:
        first = F.floor(F.col(start) / F.lit(CELL)).cast("long")
        last = F.floor((F.least(F.col(start) + F.col(size), F.lit(total)) - 1) / F.lit(CELL))
        cut = df.filter((F.col(start) < total) & (F.col(size) > 0))
        return cut.withColumn("cell", F.explode(F.sequence(first, last.cast("long")))).withColumn(
            "at", F.greatest(F.col(start), F.col("cell") * CELL)
        )

    item = F.struct("part", "row", F.col("t").alias("t"), F.col("item").alias("item"))
    place = F.struct("sequence_id", F.col("s").alias("s"), F.col("filled").alias("filled"))
    items = cells(residual, "t", "item").select(
        "cell", "at", item.alias("i"), F.lit(None).alias("p")
    )
    places = cells(open_, "s", "open").select(
        "cell", "at", F.lit(None).alias("i"), place.alias("p")
    )
    line = Window.partitionBy("cell").orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    cell_end = F.least((F.col("cell") + 1) * CELL, F.lit(total))
    steps = items.unionByName(places).select(
        "at", F.last("i", ignorenulls=True).over(upto).alias("i"),
        F.last("p", ignorenulls=True).over(upto).alias("p"),
        F.coalesce(F.lead("at").over(line), cell_end).alias("to"),
    ).filter("to > at")
    return steps.groupBy(
        F.col("i.part").alias("part"), F.col("i.row").alias("row"),
        F.col("p.sequence_id").alias("sequence_id"),
    ).agg(
        F.min(F.col("at") - F.col("i.t")).alias("at"),
        F.sum(F.col("to") - F.col("at")).alias("length"),
        F.min(F.col("p.filled") + F.col("at") - F.col("p.s")).alias("offset"),
    )


def _further(residual: DataFrame, total: int, tokens: int, window: int, first: int) -> DataFrame:
    """Residual tokens from ``total`` on, window after window, the end in powers of two."""
    whole, rest = divmod(tokens - total, window)
    tails, at = [], whole * window
    for bit in range(window.bit_length(), -1, -1):
        if rest >> bit & 1:
            number = first + whole + len(tails)
            tails.append(F.struct(F.lit(at).cast("long").alias("lo"),
                                  F.lit(at + (1 << bit)).cast("long").alias("hi"),
                                  F.lit(number).cast("long").alias("sequence_id")))
            at += 1 << bit
    kind = "array<struct<lo:bigint,hi:bigint,sequence_id:bigint>>"
    ends = F.array(*tails).cast(kind)
    begin = F.greatest(F.col("t"), F.lit(total)) - total
    stop = F.col("t") + F.col("item") - total
    windows = F.sequence(
        F.floor(begin / F.lit(window)).cast("long"), F.floor((stop - 1) / F.lit(window)).cast("long")
    )
    places = F.flatten(F.transform(windows, lambda w: F.when(
        w < whole,
        F.array(F.struct((w * window).alias("lo"), ((w + 1) * window).alias("hi"),
                         (w + first).alias("sequence_id"))).cast(kind),
    ).otherwise(ends)))
    cut = residual.filter(F.col("t") + F.col("item") > total).select(
        "part", "row", "t", begin.alias("b"), stop.alias("e"), F.explode(places).alias("p")
    )
    lo, hi = F.greatest("b", "p.lo"), F.least("e", "p.hi")
    return cut.select(
        "part", "row", "p.sequence_id", (lo + total - F.col("t")).alias("at"),
        (hi - lo).alias("length"), (lo - F.col("p.lo")).alias("offset"),
    ).filter("length > 0")


_PIECE = ("part", "row", "id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packing:
    """Documents packed into sequences of at most ``window`` tokens, none of them padded.

    ``pieces``: one row per piece with the document's id, ``start`` (ids of its document before
    it), ``length``, ``ids_crc32`` (unsigned, of its ids as little-endian unsigned 32-bit integers),
    ``doc_tokens`` (with the end id), ``sequence_id`` (gapless from 0) and ``offset`` in it.
    ``sequences()`` gives the ids themselves.

    A null or empty text is its end id alone. Repeated rows and null ids are documents like any
    other; an empty table gives no pieces; other columns are not read, so their names cannot
    clash. A very long text stands alone in its block and is cut into whole windows.

    The ids are stored once with the input's partitions; what is shuffled besides are lengths and
    places, a short row per item, and the ids of the documents for the join with residual items.
    Only the histogram (``classes`` numbers) reaches the driver, only the slots of the
    combinations in use (at most ``classes * depth`` rows) are broadcast.
    """

    def __init__(
        self, docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = 4096,
        id_col: str = "doc_id", text_col: str = "text", classes: int = 128, depth: int = 4,
    ) -> None:
        if window % classes:
            raise ValueError("classes must divide the window")
        self.id_col, self.window = id_col, window
        spark, unit = docs.sparkSession, window // classes
        self.tokens = stored(
            items_of(docs, vocabulary, end_id, id_col, text_col, window, unit), "tokens"
        )
        counts = np.zeros(classes, np.int64)
        for row in self.tokens.filter("item > 0").groupBy("class").count().collect():
            counts[row["class"] - 1] = row["count"]
        self.combinations, self.repeats = repeats(counts, unit, depth)
        slots = spark.createDataFrame(
            slots_of(self.combinations, self.repeats),
            "class int, lo long, hi long, per long, sequence long, slot long",
        )
        made = int(self.repeats.sum())
        parts = self.tokens.groupBy("part").agg(
            F.sum(F.size("window_crcs").cast("long")).alias("windows")
        )
        self._pieces = self._place(slots, parts, made)
        self.pieces = self._pieces.select(F.col("id").alias(id_col), *_PIECE[3:])

    def _place(self, slots: DataFrame, parts: DataFrame, made: int) -> DataFrame:
        by_class = Window.partitionBy("class").orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1
        )
        before = self.tokens.groupBy("part", "class").agg(F.count("*").alias("_n")).select(
            "part", "class", F.coalesce(F.sum("_n").over(by_class), F.lit(0)).alias("before")
        )
        rank = F.col("rank") + F.col("before")
        items = self.tokens.drop("ids", "window_crcs", "windows_before").filter("item > 0")
        ranked = items.join(before, ["part", "class"]).withColumn("rank", rank)
        near = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        near &= ranked["class"] == slots["class"]
        placed = stored(
            ranked.join(F.broadcast(slots), near, "left").select(
                "part", "row", "id", "item", "item_crc", "doc_tokens",
                (F.col("sequence") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
                .cast("long").alias("sequence_id"),
                (F.col("slot") + (F.col("rank") - F.col("lo")) % F.col("per")).alias("slot"),
            ),
            "slots",
        )
        chosen = placed.filter("sequence_id is not null")
        in_order = Window.partitionBy("sequence_id").orderBy("slot")
        whole = chosen.select(
            "part", "row", "id", (F.col("doc_tokens") - F.col("item")).alias("start"),
            F.col("item").cast("long").alias("length"), F.col("item_crc").alias("ids_crc32"),
            "doc_tokens", "sequence_id",
            (F.sum("item").over(in_order) - F.col("item")).alias("offset"),
        )
        windows, full = self._windows(parts, made)
        return whole.unionByName(windows).unionByName(
            self._residual(placed.filter("sequence_id is null"), chosen, made, made + full)
        )

    def _windows(self, parts: DataFrame, first: int) -> tuple[DataFrame, int]:
        """Whole windows of long documents, a sequence each, and how many there are."""
        full = parts.agg(F.sum("windows")).first()[0] or 0
        long = self.tokens.filter(F.size("window_crcs") > 0).select(
            "part", "row", "id", "doc_tokens", "windows_before",
            F.posexplode("window_crcs").alias("k", "ids_crc32"),
        )
        placed = long.join(prefix(parts, "part", "windows", "before").drop("windows"), "part")
        return placed.select(
            "part", "row", "id", (F.col("k").cast("long") * self.window).alias("start"),
            F.lit(self.window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
            (F.col("before") + F.col("windows_before") + F.col("k") + first).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        ), full

    def _residual(self, left: DataFrame, chosen: DataFrame, made: int, first: int) -> DataFrame:
        """The pieces of all items without a slot, in the order of their documents."""
        open_ = chosen.groupBy("sequence_id").agg(
            F.sum(F.col("item").cast("long")).alias("filled")
        ).withColumn("open", self.window - F.col("filled"))
        gaps = prefix(open_.select("sequence_id", "open"), "sequence_id", "open", "s")
        open_ = gaps.withColumn("filled", self.window - F.col("open"))
        total = gaps.agg(F.sum("open")).first()[0] or 0
        sums = left.groupBy("part").agg(F.sum(F.col("item").cast("long")).alias("items"))
        tokens = sums.agg(F.sum("items")).first()[0] or 0
        if total > tokens:
            raise RuntimeError("the residual items do not fill the open places")
        in_part = Window.partitionBy("part").orderBy("row")
        line = left.withColumn("_in", F.sum("item").over(in_part) - F.col("item")).join(
            prefix(sums, "part", "items", "before").drop("items"), "part"
        ).select("part", "row", "item", (F.col("_in") + F.col("before")).alias("t"))
        line = stored(line, "residual")
        laid = stored(
            _fill(line, open_, total).unionByName(
                _further(line, total, tokens, self.window, first)
            ),
            "laid",
        )
        known = left.select("part", "row", "id", "doc_tokens", "item", "item_crc")
        start = F.col("doc_tokens") - F.col("item") + F.col("at")
        there = laid.join(known, ["part", "row"]).select(
            "part", "row", "id", start.alias("start"), "length", "item_crc", "doc_tokens",
            "sequence_id", "offset", (F.col("length") < F.col("item")).alias("cut"),
        )
        place = ["part", "row", "id", "start", "length"]
        whole = there.filter("not cut").select(
            *place, F.col("item_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
        )
        begin, size = (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")
        texts = self.tokens.filter("item > 0").select("part", "row", "ids")
        parted = there.filter("cut").join(texts, ["part", "row"]).select(
            *place, F.crc32(F.substring("ids", begin, size)).alias("ids_crc32"), "doc_tokens",
            "sequence_id", "offset",
        )
        return whole.unionByName(parted)

    def sequences(self) -> DataFrame:
        """``sequence_id`` and ``ids`` (array<int>) of every sequence, at most a window each."""
        texts = self.tokens.select("part", "row", "ids")
        at, size = (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")
        cut = self._pieces.join(texts, ["part", "row"]).select(
            "sequence_id", F.struct("offset", F.substring("ids", at, size).alias("ids")).alias("p")
        )
        joined = F.aggregate(
            F.sort_array(F.collect_list("p")), F.lit(b""), lambda a, p: F.concat(a, p["ids"])
        )

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch["sequence_id"], pa.array(ids, pa.list_(pa.int32()))],
                    ["sequence_id", "ids"],
                )

        return cut.groupBy("sequence_id").agg(joined.alias("ids")).mapInArrow(
            unpack, "sequence_id long, ids array<int>"
        )
