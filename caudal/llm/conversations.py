"""Repair of conversation structure at the least cost of edits (op 12).

Rows are range-partitioned by conversation and turn, each once, and cut into pieces: the rows of
one conversation in one range, at most ``piece_rows``. Nearly all conversations are one piece and
are settled by the auction in their task. One that goes on in further pieces, however long, is
settled piece by piece: each gives its least costs from state to state, these few numbers are
chained from the end to prices behind every piece, with which the pieces run their auctions at the
same time; their exits are chained from the front. Only its repaired text, of which the query asks
one digest, is read in order by one task, piece after piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from caudal.llm import auction
from caudal.llm.storage import stored

PIECE_ROWS = 8192
PIECE_BYTES = 1 << 20
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

_SPAN = (
    "first_turn long, last_turn long, turns long, first_initial string, last_initial string, "
    "illegal long"
)
_PIECE = (
    "key string, id {id}, piece long, edge boolean, codes binary, roles array<string>, "
    f"texts array<string>, {_SPAN}, firsts array<struct<i:int,digest:string>>"
)
_SOLVED = (
    "key string, id {id}, piece long, edge boolean, codes binary, entry int, cost long, "
    f"audit string, repaired array<struct<role:string,text:string>>, {_SPAN}"
)
_REPORT = (
    "id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
_LEGAL = ("su", "ua", "au")


def damaged(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", gone_col: str = "gone",
) -> DataFrame:
    """The rows with damage that their id and turn decide; nulls count as one space.

    By crc32 of ``id:turn`` modulo 20: 0 drops the row (it stays, marked in ``gone_col``, so that
    its conversation is not forgotten), 1 empties the text, 2 takes ``. ! ?`` out of it, 3 doubles
    the row, 4 makes the role ``user``.
    """
    space = F.lit(" ")
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), space)
    kind = F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col))) % 20
    text = said(text_col)
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        F.col(f"`{id_col}`").alias(id_col), F.col(f"`{turn_col}`").alias(turn_col),
        F.when(kind == 4, "user").otherwise(said(role_col)).alias(role_col),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ENDS, ""))
        .otherwise(text).alias(text_col),
        (kind == 0).alias(gone_col), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _writer(schema: str) -> Callable[[list[dict]], pa.RecordBatch]:
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return lambda rows: pa.RecordBatch.from_pylist(rows, arrow)


class _Piece:
    """Rows of one conversation, in order, until its task ends it."""

    def __init__(self, key: str, value) -> None:
        self.key, self.id, self.edge = key, value, False
        self.codes, self.roles, self.texts = bytearray(), [], []
        self.digests: dict[str, int] = {}
        self.turns, self.illegal, self.size = 0, 0, 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, digest: str) -> None:
        said = text.rstrip(SPACE)
        if not said:
            fault = auction.BLANK
        elif digest in self.digests:
            fault = auction.DUPLICATE
        else:
            self.digests[digest] = len(self.codes)
            fault = 0 if said[-1] in ENDS else auction.TRUNCATED
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.codes.append(auction.code(role[:1], fault))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)

    def full(self, most: int) -> bool:
        return len(self.codes) >= most or self.size >= PIECE_BYTES

    def row(self, number: int, edge: bool) -> dict:
        firsts = [{"i": i, "digest": d} for d, i in self.digests.items()] if edge else []
        return {
            "key": self.key, "id": self.id, "piece": number, "edge": edge,
            "codes": bytes(self.codes), "roles": self.roles, "texts": self.texts,
            "first_turn": self.first, "last_turn": self.last, "turns": self.turns,
            "first_initial": self.roles[0][:1] if self.roles else None,
            "last_initial": self.roles[-1][:1] if self.roles else None,
            "illegal": self.illegal, "firsts": firsts,
        }


def _cutter(schema: str, most: int):
    """Cut sorted rows into pieces of at most ``most`` rows; a piece whose conversation may have
    further pieces is an ``edge``."""

    write = _writer(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = cut_key = now = None
        number = 0

        for batch in batches:
            done = []
            for key, value, turn, role, text, digest, gone, part in zip(
                *(batch[c].to_pylist()
                  for c in ("key", "id", "turn", "role", "text", "digest", "gone", "part")),
                strict=True,
            ):
                if not number:
                    first_key, number = key, part << 32
                if now is None or key != now.key or now.full(most):
                    if now is not None:
                        if key == now.key:
                            cut_key = key
                        number += 1
                        done.append(now.row(number, now.key in (first_key, cut_key)))
                    now = _Piece(key, value)
                if not gone:
                    now.add(turn, role, text, digest)
            if done:
                yield write(done)
        if now is not None:
            yield write([now.row(number + 1, True)])

    return cut


def _span(row: dict) -> dict:
    return {name.split()[0]: row[name.split()[0]] for name in _SPAN.split(", ")}


def _solved(row: dict, codes: bytes, entry: int, cost: int, audit: str) -> dict:
    """A piece with its audit; roles and texts give way to the rows that the audit leaves."""
    repaired, _ = auction.edited(audit, entry, row["roles"], row["texts"])
    return {
        "key": row["key"], "id": row["id"], "piece": row["piece"], "edge": row["edge"],
        "codes": codes, "entry": entry, "cost": cost, "audit": audit, "repaired": repaired,
        **_span(row),
    }


def _whole(schema: str):
    """Settle conversations that are one piece."""

    write = _writer(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                codes = row["codes"]
                price = auction.settle(codes, auction.END_PRICES, (auction.NOTHING,))
                audit, state = auction.trace(codes, price, auction.NOTHING)
                audit += auction.END_LETTERS[state]
                rows.append(_solved(row, codes, auction.NOTHING, price[0], audit))
            yield write(rows)

    return solve


# ---- conversations of several pieces ------------------------------------------------

_COSTS = "key string, piece long, codes binary, costs array<long>"
_PRICES = "piece long, ends array<long>, last boolean"
_RUNS = "key string, piece long, exits array<int>, audits array<string>, costs array<long>"
_ENTRIES = "piece long, entry int, cost long"


def _measure():
    """Put in duplicates of earlier pieces; least costs from state to state of every piece."""
    write = _writer(_COSTS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                codes = bytearray(row["codes"])
                for i in row["again"] or []:
                    codes[i] = codes[i] & 3 | auction.DUPLICATE << 2
                costs = [c for line in auction.exits(codes) for c in line]
                rows.append({"key": row["key"], "piece": row["piece"], "codes": bytes(codes),
                             "costs": costs})
            yield write(rows)

    return each


def _ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """Prices behind every piece of one conversation, from its end."""
    pieces = pieces.sort_values("piece", ascending=False)
    now, out = list(auction.END_PRICES), []
    for k, (piece, costs) in enumerate(zip(pieces["piece"], pieces["costs"], strict=True)):
        out.append((piece, now, k == 0))
        now = [min(int(costs[4 * a + b]) + now[b] for b in auction.STATES) for a in auction.STATES]
    return pd.DataFrame(out, columns=["piece", "ends", "last"])


def _run():
    """Every piece's auction and audits, from each state that it may be entered in."""
    write = _writer(_RUNS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                codes, last = row["codes"], row["last"]
                price = auction.settle(codes, row["ends"], auction.STATES)
                dead: set[int] = set()
                traced = [auction.trace(codes, price, state, dead) for state in auction.STATES]
                rows.append({
                    "key": row["key"], "piece": row["piece"], "exits": [q for _, q in traced],
                    "audits": [a + (auction.END_LETTERS[q] if last else "") for a, q in traced],
                    "costs": price[:4],
                })
            yield write(rows)

    return each


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece of one conversation is entered, from its front."""
    pieces = pieces.sort_values("piece")
    state, out = auction.NOTHING, []
    for piece, exits, costs in zip(
        pieces["piece"], pieces["exits"], pieces["costs"], strict=True
    ):
        out.append((piece, state, int(costs[state])))
        state = int(exits[state])
    return pd.DataFrame(out, columns=["piece", "entry", "cost"])


def _chained(edges: DataFrame, schema: str) -> DataFrame:
    """Settle conversations that may lie in several pieces."""
    held = edges.filter(F.octet_length("codes") > 0)
    seen = held.select("key", "piece", F.inline("firsts"))
    first = seen.groupBy("key", "digest").agg(F.min("piece").alias("_at"))
    again = (
        seen.join(first, ["key", "digest"]).filter("piece > _at")
        .groupBy("piece").agg(F.collect_list("i").alias("again"))
    )
    spec = held.select("key", "piece", "codes").join(again, "piece", "left")
    measured = stored(spec.mapInArrow(_measure(), _COSTS), "piece-costs")
    ends = measured.select("key", "piece", "costs").groupBy("key").applyInPandas(_ends, _PRICES)
    runs = stored(
        measured.select("key", "piece", "codes").join(ends, "piece").mapInArrow(_run(), _RUNS),
        "piece-audits",
    )
    entries = runs.select("key", "piece", "exits", "costs").groupBy("key").applyInPandas(
        _entries, _ENTRIES
    )
    chosen = runs.select("piece", "audits").join(entries, "piece").select(
        "piece", "entry", "cost", F.element_at("audits", F.col("entry") + 1).alias("audit")
    )

    write = _writer(schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield write([
                _solved(r, r["new"] or b"", r["entry"] or 0, r["cost"] or 0, r["audit"] or "")
                for r in batch.to_pylist()
            ])

    return (
        edges.drop("codes", "firsts")
        .join(measured.select("piece", F.col("codes").alias("new")), "piece", "left")
        .join(chosen, "piece", "left")
        .mapInArrow(finish, schema)
    )


# ---- results ------------------------------------------------------------------------


class _Tally:
    """Figures of one conversation, taken up piece after piece."""

    def __init__(self, key: str, value) -> None:
        self.key, self.id = key, value
        self.faults = [0] * 4
        self.first = self.last = self.initial = self.cost = None
        self.turns = self.illegal = self.lines = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def add(self, row: dict) -> None:
        for c in row["codes"]:
            self.faults[c >> 2] += 1
        if row["first_turn"] is not None:
            self.turns += row["turns"] - (row["first_turn"] == self.last)
            self.first = row["first_turn"] if self.first is None else self.first
            self.last = row["last_turn"]
        if row["first_initial"] is not None:
            joint = (self.initial or "") + row["first_initial"]
            self.illegal += row["illegal"]
            self.illegal += self.initial is not None and joint not in _LEGAL
            self.initial = row["last_initial"]
            self.cost = row["cost"] if self.cost is None else self.cost
        self.audit.append(row["audit"])
        for line in row["repaired"]:
            self.hash.update((b"\n" if self.lines else b"") + line["role"].encode() + b":")
            self.hash.update(line["text"].encode())
            self.lines += 1

    def row(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        _, blank, duplicate, truncated = self.faults
        return {
            "id": self.id, "gaps": gaps, "blank": blank, "duplicate": duplicate,
            "truncated": truncated, "illegal": self.illegal, "cost": self.cost or 0,
            "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest(),
        }


def _reporter(schema: str):
    write = _writer(schema)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or row["key"] != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = _Tally(row["key"], row["id"])
                now.add(row)
            if done:
                yield write(done)
        if now is not None:
            yield write([now.row()])

    return report


class Repair:
    """Conversations repaired to the role pattern ``(s?(ua)+)?`` at the least cost.

    Rows of a conversation stand by turn (null first), rows of one turn by the SHA-256 of role and
    text. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (last
    visible character not ``. ! ?``). Edits: keep costs 0, recast as user or assistant 3, remove 4
    (required for blank and duplicate rows), add an empty row 3; a truncated row that stays adds 3.
    Of the cheapest edit sequences the one with the least audit (initials D I K R) is taken.

    ``report()`` gives one row per conversation: the id, ``gaps`` (turn numbers missing between
    the least and the greatest), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbouring
    initials other than su, ua, au), ``cost``, ``audit`` and ``repaired_sha256`` (``role:text`` by
    lines). ``messages()`` gives the repaired rows. Rows marked in ``gone_col`` only keep their
    conversation in the result, with zeros, an empty audit and the digest of nothing.

    Null roles and texts count as one space, null ids are one conversation, repeated rows are
    duplicates, an empty table gives nothing; other columns are not read. A text is never cut; a
    very long one makes a piece of its own.
    """

    def __init__(
        self, rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
        role_col: str = "role", text_col: str = "text", gone_col: str | None = None,
        piece_rows: int = PIECE_ROWS,
    ) -> None:
        self.id_col = id_col
        self.kind = rows.schema[id_col].dataType.simpleString()
        pick = lambda c: F.col(f"`{c}`")
        key = F.when(pick(id_col).isNull(), F.lit("")).otherwise(
            F.concat(F.lit("="), pick(id_col).cast("string"))
        )
        role = F.coalesce(pick(role_col), F.lit(" "))
        text = F.coalesce(pick(text_col), F.lit(" "))
        gone = pick(gone_col) if gone_col else F.lit(False)
        chosen = rows.select(
            key.alias("key"), pick(id_col).alias("id"), pick(turn_col).cast("long").alias("turn"),
            role.alias("role"), text.alias("text"), gone.alias("gone"),
            F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
            .alias("digest"), F.monotonically_increasing_id().alias("tie"),
        )
        order = ["key", "turn", "digest", "tie"]
        ranged = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
        schema = _PIECE.format(id=self.kind)
        pieces = stored(
            ranged.withColumn("part", F.spark_partition_id().cast("long"))
            .mapInArrow(_cutter(schema, piece_rows), schema),
            "pieces",
        )
        solved = _SOLVED.format(id=self.kind)
        self.whole = pieces.filter("not edge").mapInArrow(_whole(solved), solved)
        self.chained = _chained(pieces.filter("edge"), solved)

    def report(self) -> DataFrame:
        schema = _REPORT.format(id=self.kind)
        in_order = self.chained.repartition("key").sortWithinPartitions("key", "piece")
        return (
            self.whole.mapInArrow(_reporter(schema), schema)
            .unionByName(in_order.mapInArrow(_reporter(schema), schema))
            .withColumnRenamed("id", self.id_col)
        )

    def messages(self) -> DataFrame:
        """Repaired rows: id, ``piece`` and ``at`` (their order), ``role`` and ``text``."""
        both = self.whole.unionByName(self.chained)
        return both.select(
            F.col("id").alias(self.id_col), "piece", F.posexplode("repaired").alias("at", "_r")
        ).select(self.id_col, "piece", "at", "_r.role", "_r.text")
