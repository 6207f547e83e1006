"""Trajectories, a street grid and matches derived from the tables events and part."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import bearing, distance
from ..operators.roadnet import directed_edges, number_edges
from ..operators.trajectory import kinematics, ordinal


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of their user's trajectory, in one of three neighbouring blocks of 500 metres."""
    e = _table(spark, sf_dir, "events")
    y = 5.0 * F.regexp_extract("props", "([0-9]+)", 1).cast("double") + 500.0 * (F.col("user_id") % 3)
    return e.select(F.col("user_id").cast("bigint").alias("trajectory_id"), F.col("event_id").alias("point_id"), "ts", F.col("value").cast("double").alias("x"), y.alias("y"), "event_type")


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal(points(spark, sf_dir), "ts", "point_id")


@lru_cache(maxsize=8)
def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points a second apart, with kinematics: the times of the events themselves are days apart."""
    t = trajectory(spark, sf_dir)
    apart = t.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t")))
    return kinematics(apart.drop("t"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets of a grid of six columns, 100 metres apart and as long as the parts go: even parts run across, odd ones along."""
    p = _table(spark, sf_dir, "part")
    k, key = F.col("k"), F.col("link_id")
    g = p.select(F.col("p_partkey").cast("bigint").alias("link_id"), "p_type", "p_size", "p_brand", F.floor(F.col("p_partkey") / 2).cast("bigint").alias("k"))
    across = key % 2 == 0
    u = F.when(across, F.floor(k / 5) * 6 + k % 5).otherwise(F.floor(k / 6) * 6 + k % 6).cast("bigint")
    g = g.withColumn("u", u).withColumn("v", F.when(across, F.col("u") + 1).otherwise(F.col("u") + 6))
    oneway = F.when(key % 7 == 0, "yes").otherwise("no")
    return g.select("link_id", F.col("p_type").alias("highway"), (F.col("p_size").cast("double") + 20).alias("maxspeed"), oneway.alias("oneway"), F.col("p_brand").alias("osm_way_id"), "u", "v")


@lru_cache(maxsize=8)  # of the plan, so that its numbering is prepared once
def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges of the grid, numbered by link and direction; a two-way link has two."""
    base = links(spark, sf_dir).withColumn("dir", F.explode(F.when(F.col("oneway") == "yes", F.array(F.lit("fwd"))).otherwise(F.array(F.lit("fwd"), F.lit("rev")))))
    rev = F.col("dir") == "rev"
    turned = base.withColumns({"a": F.when(rev, F.col("v")).otherwise(F.col("u")), "b": F.when(rev, F.col("u")).otherwise(F.col("v"))})
    xy = {f"{c}{i}": f(F.col(n)) for n, i in (("a", 1), ("b", 2)) for c, f in (("x", lambda n: 100.0 * (n % 6)), ("y", lambda n: 100.0 * F.floor(n / 6)))}
    placed = turned.withColumns(xy)
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    out = placed.select(
        F.concat_ws(":", F.col("link_id").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), "dir").alias("edge_id"), "link_id", "osm_way_id",
        F.col("highway").alias("road_class"), "maxspeed", (F.col("oneway") == "yes").cast("int").alias("oneway"), rev.cast("int").alias("is_reverse"), F.col("dir").alias("direction"),
        F.col("a").alias("u"), F.col("b").alias("v"), "x1", "y1", "x2", "y2", distance(*ends).alias("length_m"), bearing(*ends).alias("bearing_rad"),
    )
    return number_edges(out, "link_id", "direction")


def bent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's streets as lines of two segments: each bends in its middle, across its direction, by up to 20 metres."""
    g = links(spark, sf_dir)
    at = lambda n: (100.0 * (F.col(n) % 6), 100.0 * F.floor(F.col(n) / 6))
    (x1, y1), (x2, y2) = at("u"), at("v")
    bend, across = 10.0 * (F.col("link_id") % 5 - 2), F.col("link_id") % 2 == 0
    middle = ((x1 + x2) / 2 + F.when(across, 0.0).otherwise(bend), (y1 + y2) / 2 + F.when(across, bend).otherwise(0.0))
    vertices = [F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), middle, (x2, y2))]
    return g.withColumns({"line": F.array(*vertices), "bridge": F.when(F.col("link_id") % 9 == 0, "yes"), "tunnel": F.lit(None).cast("string")})


@lru_cache(maxsize=8)  # of the plan, so that its numbering is prepared once
def bent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bent streets as directed edges of every class."""
    return directed_edges(bent_links(spark, sf_dir), classes=None)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of two segments through the block of each trajectory, as its true route."""
    y = 500.0 * (F.col("trajectory_id") % 3) + 100.0 * (F.col("trajectory_id") % 5)
    vertices = [F.struct(F.lit(x).alias("x"), (y + dy).alias("y")) for x, dy in ((0.0, 0.0), (250.0, 40.0), (500.0, 0.0))]
    return points(spark, sf_dir).select("trajectory_id").distinct().where("trajectory_id % 7 <> 0").select("trajectory_id", F.array(*vertices).alias("line"))


@lru_cache(maxsize=8)
def classed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road edges with the number of their class in order of names."""
    from pyspark.sql import Window

    e = road_edges(spark, sf_dir)
    ids = e.select("road_class").distinct().withColumn("road_class_id", (F.row_number().over(Window.orderBy("road_class")) - 1).cast("bigint"))
    return e.join(F.broadcast(ids), "road_class")  # a row for each road class


def gt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places a few metres off the points, whose nearest edge counts as the true one."""
    t = trajectory(spark, sf_dir)
    return t.select("trajectory_id", "t", (F.col("x") + 8.0 * (F.col("point_id") % 5 - 2)).alias("x"), (F.col("y") + 6.0 * (F.col("point_id") % 3 - 1)).alias("y"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match table with about three of four points right, and some labels and places missing."""
    t = trajectory(spark, sf_dir)
    p = F.col("point_id")
    own = (F.floor(F.col("x") / 10).cast("bigint") + 2 * F.floor(F.col("y") / 100).cast("bigint"))
    known = p % 17 != 0
    return t.select(
        "trajectory_id", "t", (own % 100).cast("bigint").alias("pred_edge_idx"),
        F.when(p % 11 == 0, -1).when(p % 4 == 0, (own + 1) % 100).otherwise(own % 100).cast("bigint").alias("gt_edge_idx"),
        F.col("x").alias("pred_proj_x"), F.col("y").alias("pred_proj_y"), F.when(known, F.col("x") + p % 13).alias("gt_proj_x"), F.when(known, F.col("y")).alias("gt_proj_y"),
        ((p % 100) / 100.0).cast("double").alias("confidence"), F.when((p % 11 == 0) | (p % 9 == 0), -1).otherwise(p % 4).cast("bigint").alias("gt_candidate_pos"),
    )
