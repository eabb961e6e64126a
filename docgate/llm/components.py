"""Connected components over a table of links, by alternating large and small stars.

Each round rewrites the links so that nodes hang on smaller ones, until every node hangs on the smallest of its
component; links that do so from the start need no round. Links stay in tables; the driver sees two numbers a round. A
node with very many links is one key of an aggregate with map-side combining, and of a join that either gets a bounded
list as a broadcast or whose large side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgate.llm.common import written

#: Links up to which the least neighbours (16 bytes a node, two nodes a link) are broadcast, so that a round shuffles for its aggregates alone, in fewer stages and tasks for the driver to keep.
FEW = 100_000


def _state(links: DataFrame) -> tuple[int, int]:
    """The number of links, and of nodes that hang on several roots or have nodes hanging on them."""
    ends = links.select(F.col("node").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(links.select(F.col("root").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    each = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    row = each.agg(F.sum("hangs"), F.count_if((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0)))).first()
    return row[0] or 0, row[1]


def _least(links: DataFrame, few: bool) -> DataFrame:
    least = links.groupBy("node").agg(F.min("root").alias("least"))
    return F.broadcast(least) if few else least


def _large_star(links: DataFrame, few: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    found = both.join(_least(both, few), "node").filter(F.col("root") > F.col("node"))
    return found.select(F.col("root").alias("node"), F.least("node", "least").alias("root")).distinct()


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    # a link to the least neighbour stays, any other hangs its root there
    found = links.join(_least(links, few), "node")
    return found.select(F.when(F.col("root") == F.col("least"), F.col("node")).otherwise(F.col("root")).alias("node"), F.col("least").alias("root")).distinct()


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links: (a, b), in any order and number. Returns (node, root) for every node but the smallest of its component."""
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    now = written(pairs, "links")
    count, unsettled = _state(now)
    while unsettled:
        bounded = count <= few
        now = written(_small_star(_large_star(now, bounded), bounded), "links")
        count, unsettled = _state(now)
    return now
