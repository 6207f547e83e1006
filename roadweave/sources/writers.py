"""Tables and reports to files."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators.spatial import recall_at
from .readers import _FORMATS, DEFAULT_CRS, read_document


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A table by the suffix of its path, replacing what is there."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in _FORMATS:
        raise ValueError(f"unknown table format: {path}")
    df.write.format(_FORMATS[suffix]).option("header", True).mode("overwrite").partitionBy(*partition_by).save(path)


def write_splits(candidates: DataFrame, splits: DataFrame, path: str) -> None:
    """Candidates in one folder for each split of their trajectory; an error if a trajectory is in two splits."""
    if not splits.groupBy("trajectory_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty():
        raise ValueError("splits share trajectories")
    write_table(candidates.join(splits.select("trajectory_id", "split"), "trajectory_id"), path, ("split",))


def write_ids(ids: DataFrame, path: str) -> None:
    """One trajectory_id a line."""
    ids.select(F.col("trajectory_id").cast("string")).write.mode("overwrite").text(path)


def features(df: DataFrame, line: str = "line") -> DataFrame:
    """GeoJSON features, one text a row: the line's points and all other columns as properties."""
    others = [c for c in df.columns if c != line]
    shape = F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*others).alias("properties"))).alias("value"))


def write_geojson_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """GeoJSON features as text, one a line, which readers of newline-delimited GeoJSON take and which has any size."""
    features(df, line).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, crs: str = DEFAULT_CRS, line: str = "line") -> None:
    """One GeoJSON collection with its reference system, for tables that one reader takes at once; larger ones go as lines."""
    name = json.dumps({"type": "name", "properties": {"name": f"urn:ogc:def:crs:{crs.replace(':', '::')}"}})
    whole = features(df, line).agg(F.array_join(F.sort_array(F.collect_list("value")), ",\n").alias("f"))
    whole.select(F.concat(F.lit(f'{{"type": "FeatureCollection", "crs": {name}, "features": [\n'), F.col("f"), F.lit("\n]}")).alias("value")).write.mode("overwrite").text(path)


def write_document(spark: SparkSession, values: dict, path: str) -> None:
    """A small JSON object, to any file system that Spark writes."""
    spark.createDataFrame([(json.dumps(values, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_metrics(row: DataFrame, path: str, **notes: object) -> dict:
    """A one-row table of metrics as a JSON object, with notes beside it."""
    values = row.first().asDict(recursive=True) | notes
    write_document(row.sparkSession, values, path)
    return values


def write_candidates(candidates: DataFrame, labelled: DataFrame, path: str, report_path: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> dict:
    """Candidates as a table and their recall as a JSON report; labelled has the points that count."""
    write_table(candidates, path)
    return write_metrics(recall_at(candidates, labelled, ks), report_path, table=path)


def write_lattices(lattice: DataFrame, path: str) -> None:
    """Lattices of trajectories (decode.collect_lattice) as nested columns, a trajectory's blocks beside each other."""
    lattice.repartition("trajectory_id").sortWithinPartitions("trajectory_id", "block").write.mode("overwrite").parquet(path)


def write_schema(df: DataFrame, path: str) -> None:
    """The header of a table as CSV without rows, and its types as JSON beside it."""
    df.limit(0).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    write_document(df.sparkSession, json.loads(df.schema.json()), f"{path.rstrip('/')}.schema.json")


def write_state(spark: SparkSession, weights: dict[str, list[float]], metrics: dict[str, float], path: str, monitor: str, higher: bool = True) -> bool:
    """A model's weights and metrics as the last state, and as the best one where the monitored metric is strictly better."""
    state = {"weights": weights, "metrics": metrics}
    write_document(spark, state, f"{path}/last.json")
    try:
        best = read_document(spark, f"{path}/best.json")["metrics"][monitor]
    except AnalysisException:  # no best state yet
        best = None
    better = best is None or (metrics[monitor] > best if higher else metrics[monitor] < best)
    if better:
        write_document(spark, state, f"{path}/best.json")
    return better


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """Lines as text in a table."""
    write_table(df.withColumn("geometry_wkt", geometry.line_text(F.col(line))).drop(line), path)


def first_position(points: DataFrame) -> dict:
    """Origin of a recording: its earliest point."""
    return points.agg(F.min_by(F.struct("x", "y", "lon", "lat"), "ts").alias("o")).first()["o"].asDict()


def less_origin(df: DataFrame, x0: float, y0: float) -> DataFrame:
    """All columns that hold places, moved by an origin."""
    moved = {c: F.col(c) - (x0 if c.endswith("x") else y0) for c in df.columns if c in ("x", "y") or c.endswith(("_x", "_y"))}
    return df.withColumns(moved)
