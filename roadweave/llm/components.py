"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.withColumnRenamed("m", "v")).where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, root) for every node of an edge, root being the least node of its component.

    Edges are undirected; repeated edges and loops are allowed, edges with a null end are ignored. An empty
    edge list gives an empty result. Every round is a few shuffles of at most the edge list and is written to
    the shared folder; the number of rounds grows with the logarithm of the size of a component.
    """
    pairs = edges.select(F.least(left, right).alias("v"), F.greatest(left, right).alias("u"))
    now = settle(pairs.where("u <> v").select("u", "v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = settle(_small_star(_large_star(now)), "edges")
        seen, mark = mark, _mark(after)
        forget(now)
        now = after
        if mark == seen:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return (
        now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        .unionByName(roots.withColumn("root", F.col("node")))
    )
