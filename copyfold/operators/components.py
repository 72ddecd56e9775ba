"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed, compacted
from copyfold.skew import join_groups

#: Edges up to which a node with all of them is no burden for one task, so that steps join plainly.
PLAIN_EDGES = 1_000_000
#: Edges of a part in which they are written between steps.
PART_EDGES = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _link(pairs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges (b, least of a) for the pairs (a, b), the larger end first, each once; ``least`` (a, m, n) counts the pairs of a in n."""
    if total > PLAIN_EDGES and dict(pairs.dtypes)["a"] in ("string", "binary", "bigint"):
        linked = join_groups(pairs, least, "a", "n", F.col("b"), total)
    else:
        linked = pairs.join(least, "a")
    linked = linked.select(F.col("b").alias("_b"), "m").filter("_b <> m")
    return linked.select(F.greatest("_b", "m").alias("a"), F.least("_b", "m").alias("b")).distinct()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _link(both.filter("b > a"), least, 2 * total)


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these; edges come with the larger end first."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    own = least.select("a", F.col("a").alias("b"))
    return _link(edges.select("a", "b").unionByName(own), least, 2 * total)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of one orderable type to (node, root): root is the least node of its component.

    Both steps keep the components; they are alternated until every edge leads
    to a root, which takes about log n turns. Each turn is checkpointed. No
    neighbourhood is gathered: a node's neighbours stay rows, and only their
    minimum is taken, which beyond PLAIN_EDGES comes back to them by ``join_groups``. Loops and repeated edges do no harm.
    """
    now, total = compacted(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), PART_EDGES)
    while True:
        large = checkpointed(_large_star(now, total)) if total > PLAIN_EDGES else _large_star(now, total)
        following, total = compacted(_small_star(large, total), PART_EDGES)
        unsettled = following.join(following.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        doubled = following.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if unsettled.isEmpty() and doubled.isEmpty():
            break
        now = following
    roots = following.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return following.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
