"""BPE encoding and decoding by a pair occurrence index (op 6).

Texts are cut into chunks at white space, and every different chunk of a block is encoded once.
The chunks' words stand side by side in one array of symbols, linked to their neighbours. An
index maps each pair of symbols with a rank to all its positions in the block; active ranks are
taken in ascending order from a heap, all positions of a rank are merged together, and only
the lists of the pairs that arise around them are extended. Stale positions are recognised when
their rank is taken.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.blocks import blocks, ragged

BLOCK_BYTES = 2 << 20
#: Separators that Python's ``str.split`` takes for white space and the vocabulary's ``\\s`` does not.
OTHER_SEPARATORS = regex.compile("[\x1c-\x1f]")
WHITE_SPACE = regex.compile(r"\s+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary file: its symbols, ranked merges and added tokens.

    Built for files whose normaliser is NFC, white space to one space, lower case, whose words
    come from one pattern and are written as bytes. Other kinds are refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        steps = [s["type"] for s in config["normalizer"]["normalizers"]]
        split, byte_level = config["pre_tokenizer"]["pretokenizers"]
        usable = (
            model["type"] == "BPE"
            and steps == ["NFC", "Replace", "Lowercase"]
            and (split["type"], byte_level["type"]) == ("Split", "ByteLevel")
            and split["invert"] and split["behavior"] == "Removed"
            and not byte_level["add_prefix_space"] and not byte_level["use_regex"]
            and not model.get("ignore_merges") and config["decoder"] is None
        )
        if not usable:
            raise ValueError("not a lower-case byte-level vocabulary with word ends")
        self.word = regex.compile(split["pattern"]["Regex"])
        end = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in (ids | self.special).items():
            self.tokens[i] = token.encode()
        letters = byte_alphabet()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.left, self.right = left, right
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.marks = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special
            else None
        )

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of every pair, -1 for pairs that do not merge."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Positions of every mergeable pair of a block, by rank."""

    def __init__(self) -> None:
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks >= 0
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), len(ranks)]
        firsts = ranks[edges[:-1]].tolist()
        for rank, (i, j) in zip(firsts, pairwise(edges), strict=True):
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.active, rank)
            self.lists[rank].append(positions[i:j])

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        found = self.lists.pop(rank)
        return rank, np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def encode_words(vocab: Vocabulary, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words, one word after another, and how many each word has."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    symbols = np.frombuffer(b"".join(found), np.uint8)
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), sizes
    word = np.repeat(np.arange(len(found)), sizes)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    ends = np.cumsum(sizes)
    sym = vocab.inner[symbols]
    sym[ends - 1] = vocab.last[symbols[ends - 1]]
    after[ends - 1] = -1
    before[ends - sizes] = -1
    index = PairIndex()
    pairs = np.flatnonzero(after >= 0)
    index.add(vocab.ranks(sym[pairs], sym[pairs + 1]), pairs)
    while index.active:
        rank, at = index.pop()
        at = at[sym[at] == vocab.left[rank]]
        nxt = after[at]
        fits = (nxt >= 0) & (sym[nxt] == vocab.right[rank])
        at = np.sort(at[fits])
        if not len(at):
            continue
        if len(at) > 1:  # leftmost first within a word; what remains comes round again
            later = np.zeros(len(at), bool)
            later[1:] = word[at[1:]] == word[at[:-1]]
            if later.any():
                index.add(np.full(int(later.sum()), rank), at[later])
                at = at[~later]
        gone = after[at]
        sym[at] = vocab.merged[rank]
        sym[gone] = -1
        follow = after[gone]
        after[at] = follow
        before[follow[follow >= 0]] = at[follow >= 0]
        left = before[at]
        left = left[left >= 0]
        right = at[follow >= 0]
        start = np.concatenate([left, right])
        index.add(vocab.ranks(sym[start], sym[after[start]]), start)
    alive = sym >= 0
    return sym[alive], np.bincount(word[alive], minlength=len(found))


def split_chunks(vocab: Vocabulary, text: str) -> list[str]:
    """Chunks that encode on their own: added tokens, and what white space separates."""
    if vocab.marks is not None and "<" in text and vocab.marks.search(text):
        out: list[str] = []
        for k, part in enumerate(vocab.marks.split(text)):
            out += [part] if k % 2 else [c for c in split_chunks(vocab, part)]
        return out
    if OTHER_SEPARATORS.search(text):
        return [c for c in WHITE_SPACE.split(text) if c]
    return text.split()


def chunk_words(vocab: Vocabulary, chunk: str) -> list[bytes]:
    """The words of a chunk: NFC, lower case letter by letter, cut by the pattern."""
    if chunk.isascii():
        lower = chunk.lower()
    else:
        lower = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
    return [w.encode() for w in vocab.word.findall(lower)]


def encode_chunks(vocab: Vocabulary, chunks: list[str]) -> list[np.ndarray]:
    """Token ids of every chunk."""
    found: dict[bytes, int] = {}
    rows: list[list[int]] = []
    for chunk in chunks:
        if chunk in vocab.special:
            rows.append([-1 - vocab.special[chunk]])
        else:
            rows.append([found.setdefault(w, len(found)) for w in chunk_words(vocab, chunk)])
    ids, sizes = encode_words(vocab, list(found))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # one gather for all chunks; an added token is a run of one at the end of the array
    special = sorted(vocab.special.values())
    ids = np.concatenate([ids, np.array(special, np.int64)])
    base = len(ids) - len(special)
    flat = np.array([w for row in rows for w in row], np.int64)
    if not len(flat):
        return [flat] * len(rows)
    mark = flat < 0
    begin = np.where(mark, base + np.searchsorted(special, -1 - flat),
                     starts[np.where(mark, 0, flat)] if len(starts) else 0)
    size = np.where(mark, 1, sizes[np.where(mark, 0, flat)] if len(sizes) else 0)
    tokens = ids[ragged(begin, size)]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    upto = np.concatenate([[0], np.cumsum(size)])
    cuts = upto[np.cumsum(counts)]
    return np.split(tokens, cuts[:-1])


def encode_block(vocab: Vocabulary, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Of every text: its ids as little-endian 32-bit integers, and its decoded text in UTF-8."""
    known: dict[str, int] = {}
    rows = [[known.setdefault(c, len(known)) for c in split_chunks(vocab, t)] for t in texts]
    encoded = encode_chunks(vocab, list(known))
    raw = [ids.astype("<u4").tobytes() for ids in encoded]
    names = vocab.tokens
    plain = [b" ".join([names[i] for i in ids.tolist()]) for ids in encoded]
    empty = {k for k, x in enumerate(raw) if not x}
    if empty:
        rows = [[k for k in row if k not in empty] for row in rows]
    return (
        [b"".join(map(raw.__getitem__, row)) for row in rows],
        [b" ".join(map(plain.__getitem__, row)) for row in rows],
    )


def bpe_tokens(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document with its tokens under a word-end BPE vocabulary file.

    ``outputs`` picks from ``n_tokens``, ``ids`` (array<int>), ``decoded`` (tokens joined by one
    space, the decoding of vocabularies without a decoder), ``ids_sha256`` (of little-endian
    unsigned 32-bit ids) and ``decoded_sha256`` (of UTF-8). Added tokens in a text are encoded
    as themselves; none are added; nothing is cut or padded. ``carry`` names further columns to
    keep; others are dropped, so clashing names do no harm.

    A null text counts as empty: no tokens, empty decoding. Repeated rows and null ids come back
    as they are; an empty table gives an empty result. There is no shuffle; a block of about
    ``BLOCK_BYTES`` text bytes bounds the memory of a task, a longer text stands alone.
    """
    kinds = {
        "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(),
        "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
    }
    names = {
        "n_tokens": "long", "ids": "array<int>", "decoded": "string",
        "ids_sha256": "string", "decoded_sha256": "string",
    }

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load_vocabulary(vocabulary)
        for block in blocks(batches, text_col, BLOCK_BYTES):
            ids, decoded = encode_block(vocab, pc.fill_null(block[text_col], "").to_pylist())
            made = {
                "n_tokens": lambda: [len(x) // 4 for x in ids],
                "ids": lambda: [np.frombuffer(x, "<u4").astype(np.int32) for x in ids],
                "decoded": lambda: [x.decode() for x in decoded],
                "ids_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in decoded],
            }
            kept = [block[c] for c in (id_col, *carry)]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(made[o](), kinds[o]) for o in outputs)],
                [id_col, *carry, *outputs],
            )

    read = list(dict.fromkeys((id_col, *carry, text_col)))
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry)]
    schema = ", ".join([*kept, *(f"{o} {names[o]}" for o in outputs)])
    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(encode, schema)
