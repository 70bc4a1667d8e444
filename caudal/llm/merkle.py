"""Merkle manifest of a data set with a proof for every row (op 13): checkpoint and recompute.

Rows are leaves of one tree per group, and the groups' roots are the leaves of a tree of their
own. Of a tree only every ``levels``-th level is stored, as blocks of the nodes below one node of
the next stored level (an aligned subtree of ``arity ** levels`` nodes). Proofs are made from the
top down: a block regenerates its missing interior nodes from its stored nodes, emits the siblings
of every one of them, adds what was emitted above, and the regenerated nodes are gone with the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.positions import numbered
from caudal.llm.storage import stored

PROOF = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over all fields: UTF-8 byte count, ``:`` and value of each, ``-`` for a null."""
    texts = [c.cast("string") for c in fields]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level from below, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s.left, s.right)), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s.left, d, s.right), 256))


def _parents(level: Column, arity: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / F.lit(arity)).cast("int"))
    return F.transform(
        runs, lambda r: F.sha2(F.array_join(F.slice(level, r * arity + 1, arity), ""), 256)
    )


def _regenerated(nodes: Column, arity: int, levels: int, use: Callable[..., Column]) -> Column:
    """``use(level 0, level 1, ...)`` over a block's nodes and those regenerated above them.

    Every level is the one element of an array, which ``transform`` binds: it is computed once
    a block, however often ``use`` names it.
    """
    def bind(known: list[Column]) -> Column:
        if len(known) > levels:
            return use(*known)
        return F.element_at(
            F.transform(F.array(_parents(known[-1], arity)), lambda up: bind([*known, up])), 1
        )

    return F.element_at(F.transform(F.array(nodes), lambda level: bind([level])), 1)


def _height(n: Column, arity: int, levels: int) -> Column:
    """Levels of a block above its stored nodes, of which the whole tree has ``n``."""
    height = F.when(n <= 1, 0)
    for k in range(1, levels):
        height = height.when(n <= arity**k, k)
    return height.otherwise(levels)


def _siblings(known: tuple[Column, ...], at: Column, height: Column, arity: int) -> Column:
    """The others of each run on the way up from node ``at`` of a block."""
    steps = []
    for k, level in enumerate(known[:-1]):
        here = F.floor(at / F.lit(arity**k)).cast("int")
        first = F.floor(here / F.lit(arity)).cast("int") * arity
        steps.append(F.struct(
            F.array_join(F.slice(level, first + 1, here - first), "").alias("left"),
            F.array_join(F.slice(level, here + 2, first + arity - 1 - here), "").alias("right"),
        ))
    return F.slice(F.array(*steps), F.lit(1), height)


class Tree:
    """Stored levels of one tree per ``tree`` value, over rows (tree, pos, n, digest, data)."""

    def __init__(self, nodes: DataFrame, arity: int, levels: int) -> None:
        self.arity, self.levels, self.width = arity, levels, arity**levels
        self.stores: list[DataFrame] = []
        height = _height(F.col("n"), arity, levels)
        while True:
            block = F.floor(F.col("pos") / F.lit(self.width)).cast("long")
            store = stored(
                nodes.groupBy("tree", block.alias("block")).agg(
                    F.sort_array(F.collect_list(F.struct("pos", "digest", "data"))).alias("nodes"),
                    F.first("n").alias("n"),
                ),
                "merkle-level",
            )
            self.stores.append(store)
            top = _regenerated(
                F.col("nodes.digest"), arity, levels,
                lambda *known: F.element_at(F.element_at(F.array(*known), height + 1), 1),
            )
            up = store.select("tree", F.col("block").alias("pos"), "n", top.alias("digest"))
            # in a step of its own: within one select, the lambdas above would see the new n
            nodes = up.withColumn("n", F.ceil(F.col("n") / F.lit(self.width)).cast("long"))
            nodes = nodes.withColumn("data", F.lit(None).cast("string"))
            if (store.agg(F.max("n")).first()[0] or 0) <= self.width:
                self.roots = stored(nodes.select("tree", F.col("digest").alias("root")), "roots")
                return

    def proofs(self, tops: DataFrame) -> DataFrame:
        """Every leaf's (tree, digest, data, proof) with the columns of ``tops``.

        ``tops`` has one row per tree: ``tree``, ``above`` (proof of its root) and others to hand
        down. Blocks of a level meet what was emitted above them by one row each.
        """
        handed = [c for c in tops.columns if c not in ("tree", "above")]
        state = tops.withColumn("block", F.lit(0).cast("long"))
        height = _height(F.col("n"), self.arity, self.levels)
        for store in reversed(self.stores):
            met = store.join(state, ["tree", "block"])
            emitted = _regenerated(
                F.col("nodes.digest"), self.arity, self.levels,
                lambda *known: F.transform(
                    F.col("nodes"),
                    lambda x, i: F.struct(
                        x.pos.alias("pos"), x.digest.alias("digest"), x.data.alias("data"),
                        F.concat(_siblings(known, i, height, self.arity), F.col("above"))
                        .cast(PROOF).alias("proof"),
                    ),
                ),
            )
            state = met.select("tree", *handed, F.explode(emitted).alias("node")).select(
                "tree", F.col("node.pos").alias("block"), F.col("node.digest").alias("digest"),
                F.col("node.data").alias("data"), F.col("node.proof").alias("above"), *handed,
            )
            below = state.drop("digest", "data")
            leaves, state = state, below
        return leaves.withColumnRenamed("above", "proof").drop("block")


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    carry: dict[str, Column] | None = None,
    arity: int = 8,
    levels: int = 3,
) -> DataFrame:
    """One row per document: id, ``leaf``, ``subroot``, ``root``, ``proof`` and the carried ones.

    A leaf is ``leaf_digest`` of ``fields``. Within a group leaves ascend by id (null first, then
    by digest); while several nodes remain, every ``arity`` consecutive ones become the SHA-256 of
    their joined hex digests, the last run with what is left, even one. A lone leaf is its own
    subroot. Subroots, ordered by group (null first, then by UTF-8 bytes), lead likewise to
    ``root``. ``proof`` lists the others of each run (joined left and right of the node) from the
    leaf to the root; ``folded(leaf, proof)`` gives the root again. Nothing else of the input is
    returned, so other columns cannot clash; ``carry`` adds expressions over it.

    Repeated rows are leaves like any other, side by side; a null id or group counts as stated; a
    very long text is hashed once, as a whole, and does not travel; an empty table gives no rows.
    Only digests are shuffled. A block holds at most ``arity ** levels`` nodes; a group of any
    size is cut into blocks, and joins between levels meet one row with one row.
    """
    carried = carry or {}
    group = F.col(f"`{group_col}`").cast("string")
    tree = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))
    leaves = stored(
        docs.select(
            tree.alias("tree"), F.col(f"`{id_col}`").alias("id"),
            leaf_digest(*[F.col(f"`{c}`") for c in fields]).alias("digest"),
            F.struct(F.col(f"`{id_col}`").alias("id"), *[c.alias(k) for k, c in carried.items()])
            .alias("data"),
        ),
        "leaves",
    )
    below = Tree(
        numbered(leaves, "tree", ["id", "digest"]).select("tree", "pos", "n", "digest", "data"),
        arity, levels,
    )
    subroots = below.roots.select(
        F.lit("").alias("all"), F.col("root").alias("digest"), F.col("tree").alias("data")
    )
    above = Tree(
        numbered(subroots, "all", ["data"])
        .select(F.col("all").alias("tree"), "pos", "n", "digest", "data"),
        arity, levels,
    )
    nothing = F.array().cast(PROOF)
    groups = above.proofs(above.roots.withColumn("above", nothing)).select(
        F.col("data").alias("tree"), F.col("digest").alias("subroot"), "root",
        F.col("proof").alias("above"),
    )
    return below.proofs(groups).select(
        F.col("data.id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "proof",
        *[F.col(f"data.{k}").alias(k) for k in carried],
    )
