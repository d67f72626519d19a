"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a minimum per node followed by a join, so a node with any number
of links costs partial aggregates and a join that adaptive execution can split.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthbook.llm._store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """links (a, b) of any orderable type -> (node, root), root the smallest node of the component.

    Only nodes with a link to another node appear.  Null ends and self links are ignored.
    """
    edges = scratch.keep(f"{name}-0", links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    turn = 0
    while not _stars(edges):
        turn += 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = scratch.keep(f"{name}-{turn}", small)
        scratch.drop(f"{name}-{turn - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none: then that node is its component's smallest."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("top")), F.struct(F.col("v").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("top")))).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or (low = 1 and top = 1)").isEmpty()
