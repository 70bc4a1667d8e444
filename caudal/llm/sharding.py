"""Even shards that keep equal texts together, by balanced label propagation (op 4).

Documents with equal texts are neighbours. Every document starts in a shard by its rank, so the
counts are at most one apart. In each round a document wants the shard where most of its
neighbours are. Moves between two shards are let through in equal numbers: documents that want
to cross change places, and documents without neighbours fill what is left (Ugander and
Backstrom, 2013, with exchange quotas in place of a linear programme). DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.storage import stored

BUCKET_ROWS = 20_000
ROUNDS = 24
MENDS = 24  # at most so many further rounds of even exchanges


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str) -> DataFrame:
    """Add ``rank``, gapless from 0 within each group, in the order of ``_b1``, ``_b2``, ``order``.

    Rows are numbered within small buckets; the buckets' sizes, summed in order, give each its
    first number. No task holds a whole group.
    """
    keys = [*group, "_b1", "_b2"]
    inside = Window.partitionBy(*keys).orderBy(*order)
    before = (
        Window.partitionBy(*group).orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    )
    first = df.groupBy(*keys).count().select(
        *keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first")
    )
    numbered = df.withColumn("_in", F.row_number().over(inside))
    return numbered.join(first, keys).withColumn(
        rank, F.col("_first") + F.col("_in") - 1
    ).drop("_in", "_first")


def _lookup(table: dict[tuple[int, int], int], a: Column, b: Column) -> Column:
    """The value of a pair of shards, 0 where there is none; at most one entry per pair."""
    out = F.lit(0)
    for (i, j), value in table.items():
        out = F.when((a == i) & (b == j), F.lit(value)).otherwise(out)
    return out


def exchange(
    wishes: dict[tuple[int, int], int], free: dict[int, int]
) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Quotas of linked and of free documents per pair of shards that keep all counts.

    ``wishes`` counts linked documents by (where they are, where they want to be), ``free`` the
    documents without neighbours by shard.
    """
    left = dict(free)
    linked: dict[tuple[int, int], int] = {}
    fill: dict[tuple[int, int], int] = {}
    for (i, j), n in sorted(wishes.items()):
        back = wishes.get((j, i), 0)
        if n < back or (n == back and i > j):
            continue
        extra = min(n - back, left.get(j, 0))
        left[j] = left.get(j, 0) - extra
        for key, value, into in (
            ((i, j), back + extra, linked), ((j, i), back, linked), ((j, i), extra, fill),
        ):
            if value:
                into[key] = value
    rest = {k: n - linked.get(k, 0) for k, n in wishes.items() if n > linked.get(k, 0)}
    while path := _cycle(rest):
        n = min(rest[pair] for pair in path)
        for pair in path:
            linked[pair] = linked.get(pair, 0) + n
            rest[pair] -= n
            if not rest[pair]:
                del rest[pair]
    return linked, fill


def _cycle(wishes: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The pairs of a shortest cycle through some shards, none if there is none."""
    found: list[tuple[int, int]] = []
    for first in sorted({i for i, _ in wishes}):
        came: dict[int, int] = {}
        todo = [first]
        while todo and first not in came:
            i = todo.pop(0)
            for a, j in sorted(wishes):
                if a == i and j not in came:
                    came[j] = i
                    todo.append(j)
        if first in came:
            path, at = [(came[first], first)], came[first]
            while at != first:
                path.append((came[at], at))
                at = came[at]
            if not found or len(path) < len(found):
                found = path
    return found


def _cuts(at: DataFrame, room: int) -> int:
    """Shards beyond the first of every group that fits one, summed."""
    parts = at.filter(F.col("linked") & (F.col("n") <= room)).groupBy("key", "shard").count()
    return parts.groupBy("key").count().agg(F.sum(F.col("count") - 1)).first()[0] or 0


def _round(
    at: DataFrame, closed: list[int], salt: int = 0, room: int | None = None
) -> tuple[DataFrame, list[int], bool]:
    """One round: the new places, the shards that have no free document left, whether any moved."""
    open_ = at.filter(F.col("linked") & ~F.col("shard").isin(closed))
    if room is not None:  # larger groups stay as they are
        open_ = open_.filter(F.col("n") <= room)
    counts = open_.groupBy("key", "shard").count()
    # most neighbours first; ties go by a hash, so that no shard draws them all
    want = stored(
        counts.groupBy("key").agg(
            F.max_by("shard", F.struct("count", F.xxhash64("key", "shard", F.lit(salt)))).alias("want")
        ),
        "want",
    )
    moving = open_.join(want, "key").filter("want != shard")
    wishes = {(r["shard"], r["want"]): r["count"] for r in
              moving.groupBy("shard", "want").count().collect()}  # at most shards ** 2 rows
    free = {r["shard"]: r["count"] for r in
            at.filter(~F.col("linked")).groupBy("shard").count().collect()}
    linked, fill = exchange(wishes, free)
    now_free = {s: free.get(s, 0) - sum(n for (i, _), n in fill.items() if i == s)
                + sum(n for (_, j), n in fill.items() if j == s) for s in free}
    full = {j for (i, j), n in wishes.items() if now_free.get(j, 0) <= 0}
    closed = sorted({*closed, *full})
    if not linked:
        return at, closed, bool(full)
    movers = ranked(
        moving.select("row", "shard", "want", "_b1", "_b2"), ["shard", "want"], ["row"], "rank"
    ).filter(F.col("rank") < _lookup(linked, F.col("shard"), F.col("want")))
    goes = movers.select("row", F.col("want").alias("goes"))
    if fill:
        givers = sorted({i for i, _ in fill})
        fillers = ranked(
            at.filter(~F.col("linked") & F.col("shard").isin(givers))
            .select("row", "shard", "_b1", "_b2"), ["shard"], ["row"], "rank",
        )
        to = F.lit(None).cast("int")
        upto: dict[int, int] = {}
        for (i, j), n in sorted(fill.items()):
            low = upto.get(i, 0)
            upto[i] = low + n
            inside = (F.col("shard") == i) & (F.col("rank") >= low) & (F.col("rank") < low + n)
            to = F.when(inside, F.lit(j)).otherwise(to)
        goes = goes.unionByName(
            fillers.select("row", to.alias("goes")).filter(F.col("goes").isNotNull())
        )
    moved = at.join(goes, "row", "left").withColumn("shard", F.coalesce("goes", "shard"))
    return stored(moved.drop("goes"), "places"), closed, True


def shards(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``,
    ``law`` ('rows': counts at most one apart), ``shard`` (0 to ``n_shards`` - 1), ``slot``
    (gapless from 0 in a shard), ``grown_shard`` (null under this law), ``n_copies`` (documents
    with this text, itself included).

    A null text counts as empty in ``size`` and ``text_crc32`` and has no neighbours. Repeated
    rows and null ids are rows like any other; an empty table gives an empty result; other
    columns are not carried. Texts with equal 64-bit hashes count as equal, which can only make
    neighbours of strangers. A group larger than a shard fills one and gathers in the next.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.when(F.col(f"`{text_col}`").isNotNull(), F.xxhash64(text, F.octet_length(text)))
            .alias("key"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    total = rows.count()
    buckets = total // BUCKET_ROWS + 1
    copies = stored(
        rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n")), "copies"
    )
    places = rows.select("row", "key").join(copies, "key", "left").select(
        "row", F.coalesce("key", F.xxhash64("row")).alias("key"),
        F.coalesce("n", F.lit(1)).alias("n"),
        (F.coalesce("n", F.lit(1)) > 1).alias("linked"),
    )
    # buckets follow the text, so a group stays together in every order; large groups have several
    spread = F.ceil(F.col("n") / BUCKET_ROWS)
    places = places.withColumns({
        "_b1": F.pmod(F.xxhash64("key"), F.lit(buckets)),
        "_b2": F.pmod(F.xxhash64("row"), spread),
    })
    whole = ranked(places.withColumn("_all", F.lit(0)), ["_all"], ["key", "row"], "rank")
    # copies stand next to each other: runs of ranks cut a group at the ends of shards only
    run = F.expr(f"cast(rank * {n_shards} div {max(total, 1)} as int)")
    at = stored(whole.withColumn("shard", run).drop("rank", "_all"), "places")
    closed: list[int] = []
    for _ in range(ROUNDS):
        at, closed, more = _round(at, closed)
        if not more or len(closed) >= n_shards:
            break
    # closed shards too exchange evenly, ties drawn anew, until rounds no longer lower the cuts
    room = -(-total // n_shards)
    cuts, idle = _cuts(at, room), 0
    for salt in range(1, MENDS + 1):
        if not cuts or idle >= 3:
            break
        tried, _, _ = _round(at, [], salt, room)
        left = _cuts(tried, room)
        idle = 0 if left < cuts else idle + 1
        if left < cuts:
            at, cuts = tried, left
    slots = ranked(at, ["shard"], ["key", "row"], "slot")
    return rows.drop("key").join(slots, "row").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("n").alias("n_copies"),
    )
