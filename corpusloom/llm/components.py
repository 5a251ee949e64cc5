"""Connected components of an edge table by alternating large and small stars; labels stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(low, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root that is less and has none itself, so that nothing is left to do."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"), (F.col("a") < F.col("b")).alias("wrong"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"), F.lit(False).alias("wrong")))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.max("wrong").alias("wrong"))
    return found.where("wrong or up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one orderable type. Returns node, root for every node of an edge; root is the component's least node.

    Self loops and repeated edges do no harm, rows with a null are ignored. The rounds grow with the logarithm of the
    longest path; each is written to the shared folder.
    """
    now = materialize(edges.select("a", "b").dropna().where("a <> b").distinct(), "edges")
    while not _stars(now):
        now = materialize(_star(_star(now, True), False).distinct(), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
