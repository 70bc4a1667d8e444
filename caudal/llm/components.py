"""Connected components of a graph given as links, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.storage import join_shuffled, stored

ROUNDS = 60


def _with_least(links: DataFrame) -> DataFrame:
    """Every link (u, v) with ``m``, the least node among u and all its v.

    The minima are stored before they are joined back: both sides are then plain shuffles, and
    the rows of a hub can be split over tasks.
    """
    least = stored(
        links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least"
    )
    return join_shuffled(links, least, "u")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node with a link.

    Links run both ways; repeated links and links to oneself do no harm, links with a null end
    are left out. Each round replaces the links by stars around least neighbours until nothing
    changes; the number of rounds grows with the logarithm of the longest path.
    """
    now = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .filter("u != v").distinct(),
        "links",
    )
    seen = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(
            _with_least(both).filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large-star",
        )
        starred = _with_least(large)
        now = stored(
            starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(starred.select("u", F.col("m").alias("v")))
            .filter("u != v").distinct(),
            "small-star",
        )
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
