"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregate and a join on the edge table, written to the shared folder; no
links or components reach the driver, only two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them (``b < a`` in all rows)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links between integers -> ``(a, root)``, one row per node that is not the
    smallest of its component; ``root`` is that smallest node.

    Self links and repeated links are allowed; no rows give no rows.  The number of rounds
    grows with the logarithm of the longest path.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, seen = shared_table(current, "links"), None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if mark == seen or mark[0] == 0:
            return current.select("a", F.col("b").alias("root"))
        current, seen = shared_table(_small_star(_large_star(current)), "links"), mark
