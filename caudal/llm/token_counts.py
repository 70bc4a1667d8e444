"""Token counts of whole texts (op 9): batch encoding in Arrow, lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.blocks import blocks

#: A single space between two other characters. No piece of a model that passes
#: ``splits_at_spaces`` holds a space mark behind another character, so no token crosses it.
SAFE_BOUNDARY = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")

BLOCK_BYTES = 4 << 20
MEMO_PIECES = 500_000


@lru_cache(maxsize=2)
def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_spaces(model) -> bool:
    """Whether texts may be cut at ``SAFE_BOUNDARY`` under this model.

    Asks that no piece has a space mark behind another character, that texts get a leading
    mark, and that runs of spaces are kept and no characters rewritten.
    """
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            return False
    probes = ("a  b ", "Ａ ﬁ", "a b")
    return [model.decode(model.encode(p)) for p in probes] == list(probes) and model.encode(
        "a"
    ) == model.encode("b a")[-1:]


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries."""
    if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
        return SAFE_BOUNDARY.split(text)
    return text.split(" ")


def count_block(model, texts: list[str], known: dict[str, int]) -> np.ndarray:
    """Tokens of every text, cut at safe boundaries. Pieces not yet ``known`` are encoded in one
    batch, each once; a full memo (``MEMO_PIECES``) is emptied first."""
    if len(known) > MEMO_PIECES:
        known.clear()
    cut = [pieces(text) if text else [] for text in texts]
    fresh = list({p for parts in cut for p in parts if p not in known})
    known.update(zip(fresh, map(len, model.encode(fresh, num_threads=1)), strict=True))
    return np.array([sum(map(known.__getitem__, parts)) for parts in cut], np.int64)


def token_counts(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (above ``limit``).

    No begin, end or added special tokens; special strings inside a text are ordinary text, as
    is the library's default. A null or empty text has no bytes and no tokens. Repeated rows and
    null ids come back as they are; an empty table gives an empty result; other columns of the
    input are not carried, so their names cannot clash.

    There is no shuffle. A batch is cut into blocks of about ``BLOCK_BYTES`` bytes, a longer text
    stands alone and is cut at safe boundaries like any other, and only lengths leave the task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        split, known = splits_at_spaces(model), {}
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = pc.fill_null(block["text"], "").to_pylist()
            if split:
                tokens = count_block(model, texts, known)
            else:
                tokens = np.array([len(x) for x in model.encode(texts, num_threads=1)], np.int64)
            sizes = pc.fill_null(pc.binary_length(block["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block["id"], sizes, pa.array(tokens), pa.array(tokens > limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
    return counted.withColumnRenamed("id", id_col)
