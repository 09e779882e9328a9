"""One group for all records linked directly or through others (problem 5).

Alternating star rewrites (Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii:
Connected Components in MapReduce and Beyond, SoCC 2014). A large-star links each
node's larger neighbours to the smallest node it sees, a small-star its smaller
ones; repeated until nothing changes, every node hangs on its component's minimum.

A star is a grouped minimum (partial before the shuffle, so a node with a third of
all edges sends one row per task) and a join of the edges with it. The minima are
written as a table of their own, so that both sides of the join start at an exchange
and adaptive execution can split a hot node's edges. What a round leaves is written
too, so a lost executor costs no earlier round; tables of earlier rounds are removed.

Defined cases: null ends, self-pairs and pairs below the weight are no link; pairs
may come repeatedly and in either direction; records without a link are not in the
result; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored

MAX_ROUNDS = 100


def links(edges: DataFrame, min_weight: int = 2, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """Distinct links (u, v), v the smaller node."""
    kept = edges.filter((F.col(weight) >= min_weight) & F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return kept.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def minima(around: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours."""
    return around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def rewired(around: DataFrame, least: DataFrame) -> DataFrame:
    """Large-star on edges seen from both ends: larger neighbours linked to the minimum of ``least``."""
    return around.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def hung(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Small-star on edges seen from the larger end: smaller neighbours, and the node itself, linked to the minimum of ``least``."""
    moved = pairs.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _starred(edges: DataFrame, star) -> Stored:
    least = Stored(minima(edges))
    after = Stored(star(edges, least.df))
    least.drop()
    return after


def _print_of(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """Groups of ``links``: (node, root), root being the smallest node (binary order) of the group."""
    now = Stored(pairs)
    before = _print_of(now.df)
    for _ in range(MAX_ROUNDS):
        large = _starred(_both(now.df), rewired)
        now.drop()
        now = _starred(large.df, hung)
        large.drop()
        after = _print_of(now.df)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = now.df.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
