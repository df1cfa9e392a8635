"""Connected components of an edge table, without gathering edges or components anywhere.

Large-star and small-star steps alternate until the edges are stars: every node points at the
smallest node of its component. Each round is an aggregation and a join on the node, and is written to the
shared folder. A node with more than a thousandth of all edges, of which there are at most two thousand, is
dealt to the join in ``PIECES`` pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.session import discard, written_at

PIECES = 64
FEW = 1000  # edges that are not worth a split


def _with_least(edges: DataFrame, total: int, least: F.Column) -> DataFrame:
    """Edges (a, b) with ``m``, an aggregate over all edges of their a."""
    heavy = F.col("n") > max(FEW, total // 1000)
    nodes = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), least.alias("m"))
    marks = nodes.where(heavy).select("a", F.lit(True).alias("heavy"))
    dealt = edges.join(F.broadcast(marks), "a", "left").withColumn(
        "piece", F.when(F.col("heavy"), F.pmod(F.xxhash64("b"), F.lit(PIECES)).cast("int")).otherwise(0)
    )
    pieces = F.when(heavy, F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(nodes.select("a", "m", F.explode(pieces).alias("piece")), ["a", "piece"]).select("a", "b", "m")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    placed = _with_least(both, 2 * total, F.least(F.min("b"), F.first("a")))
    return placed.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    placed = _with_least(down, total, F.min("b"))
    moved = placed.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(placed.where("b = m").select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; ``edges`` has long columns a, b.

    root is the smallest node of the component. Loops and repeated edges are allowed; a null end
    makes the edge void. An empty table has no components.
    """
    spark = edges.sparkSession
    state, path = written_at(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        print_ = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == before:
            break
        before = print_
        total = print_[0]
        state, new_path = written_at(_small_star(_large_star(state, total), total), "edges")
        discard(spark, path)
        path = new_path
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
