"""Tables from files, with the columns they must have."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, projection
from ..functions.tags import DRIVEABLE
from ..operators.metrics import require

#: Of texts that no column says the system of: longitude and latitude.
DEFAULT_CRS = "EPSG:4326"
_FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}


def read_table(spark: SparkSession, path: str, schema: str | None = None, documents: bool = False) -> DataFrame:
    """A table by the suffix of its path: parquet, csv (with header), json or orc; an error for any other.

    JSON is one object a line, or with documents an array (or one object) a file.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in _FORMATS:
        raise ValueError(f"unknown table format: {path}")
    reader = spark.read.format(_FORMATS[suffix])
    if suffix == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
        if schema is None:
            reader = reader.option("inferSchema", True)
    if documents:
        reader = reader.option("multiLine", True)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


def conformed(df: DataFrame, types: dict[str, str], *order: str) -> DataFrame:
    """df with the required columns in the given types, sorted if an order is given; other columns stay behind them.

    A missing column is an error, and so is a value that its type can't hold.
    """
    require(df, *types)
    typed = df.withColumns({c: F.col(c).cast(kind) for c, kind in types.items()}).select(*types, *[c for c in df.columns if c not in types])
    return typed.orderBy(*order) if order else typed


def read_document(spark: SparkSession, path: str) -> dict:
    """A small JSON object of settings or metrics, from any file system that Spark reads."""
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def read_projected_routes(spark: SparkSession, path: str) -> DataFrame:
    """True routes as they were written after projection: trajectory_id and gt_wkt_projected, read back as lines."""
    raw = require(read_table(spark, path), "trajectory_id", "gt_wkt_projected")
    line = geometry.join_parts(geometry.parse_lines(F.col("gt_wkt_projected")))
    found = raw.withColumn("trajectory_id", F.col("trajectory_id").cast("bigint")).withColumn("line", line).where("size(line) >= 2")
    return found.withColumn("gt_length_m", geometry.line_length(F.col("line")))


def read_lattices(spark: SparkSession, path: str) -> DataFrame:
    """Lattices of trajectories as writers.write_lattices leaves them; an error without steps."""
    return require(spark.read.parquet(path), "trajectory_id", "block", "steps")


def one_trajectory(df: DataFrame, name: object) -> DataFrame:
    """The rows of the trajectory whose id reads like the given one; an error if there are none."""
    found = df.where(F.col("trajectory_id").cast("string") == str(name))
    if found.isEmpty():
        raise ValueError(f"no trajectory {name}")
    return found


def read_points(spark: SparkSession, path: str, zone: int | None = None) -> DataFrame:
    """GPS points from CSV (id, time, geometry as POINT text), projected to UTM if a zone is given.

    A time or a point that can't be read is an error. Points of one time keep the order of the file: ordinal.
    """
    raw = require(spark.read.option("header", True).csv(path), "id", "time", "geometry")
    lon, lat = geometry.point_xy(F.col("geometry"))
    bad = F.raise_error(F.concat(F.lit("not a point: "), F.col("geometry"))).cast("double")
    out = raw.withColumns({"lon": F.coalesce(lon, bad), "lat": F.coalesce(lat, bad), "point_id": F.monotonically_increasing_id()}).select(
        F.col("id").cast("bigint").alias("trajectory_id"), F.to_timestamp("time").alias("ts"), "lon", "lat", F.col("geometry").alias("source_geometry_wkt"), "point_id"
    )
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), zone) if zone else (F.col("lon"), F.col("lat"))
    return out.withColumns({"x": x, "y": y})


def read_routes(spark: SparkSession, path: str, zone: int | None = None) -> DataFrame:
    """True routes from CSV (id, WKT): trajectory_id, line (array of points), gt_length_m, gt_bounds as JSON."""
    raw = require(spark.read.option("header", True).option("quote", '"').csv(path), "id", "WKT")
    line = geometry.join_parts(geometry.parse_lines(F.col("WKT")))

    def projected(p):
        x, y = projection.to_utm(p["x"], p["y"], zone) if zone else (p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    out = raw.select(F.col("id").cast("bigint").alias("trajectory_id"), F.col("WKT").alias("gt_wkt_lonlat"), F.transform(line, projected).alias("line"))
    side = lambda f, c: f(F.transform("line", lambda p: p[c]))
    bounds = F.struct(side(F.array_min, "x").alias("min_x"), side(F.array_min, "y").alias("min_y"), side(F.array_max, "x").alias("max_x"), side(F.array_max, "y").alias("max_y"))
    return out.withColumns({"gt_length_m": geometry.line_length(F.col("line")), "gt_bounds": F.to_json(bounds), "gt_wkt_projected": geometry.line_text(F.col("line"))})


def read_links(spark: SparkSession, path: str, classes: tuple[str, ...] | None = DRIVEABLE) -> DataFrame:
    """Road links from a table with geometry_wkt, of driveable classes; an error if none is left."""
    raw = read_table(spark, path)
    out = raw.withColumn("line", geometry.join_parts(geometry.parse_lines(F.col("geometry_wkt")))).where("size(line) >= 2")
    if classes is not None:
        out = out.where(F.col("highway").isin(*classes))
    if out.isEmpty():
        raise ValueError(f"no road links in {path}")
    return out


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON collection: properties and line (points of a LineString)."""
    doc = spark.read.option("multiLine", True).json(path)
    if "features" not in doc.columns:
        raise ValueError(f"no features in {path}")
    doc = doc.select(F.explode("features").alias("f"))
    point = lambda c: F.struct(c[0].cast("double").alias("x"), c[1].cast("double").alias("y"))
    return doc.select("f.properties.*", F.transform(F.col("f.geometry.coordinates"), point).alias("line"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One trajectory_id a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("v")).where("length(v) > 0").select(F.col("v").cast("bigint").alias("trajectory_id"))


def read_match_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """All match tables of a folder (*_matches.parquet), with model: the table's name without that ending.

    A table is a single file, or a folder of part files as writers.write_table leaves it; with recursive also below
    other folders. Columns that only some tables have are null in the others. No table is an error.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    found, waiting = [], [root]
    while waiting:
        for status in fs.listStatus(waiting.pop()):
            name = status.getPath().getName()
            if name.endswith("_matches.parquet"):
                found.append(status.getPath().toString())
            elif recursive and status.isDirectory() and not name.startswith((".", "_")):
                waiting.append(status.getPath())
    if not found:
        raise ValueError(f"no match tables in {folder}")
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*sorted(found))
    return rows.withColumn("model", F.regexp_extract(F.input_file_name(), r"([^/]+?)_matches\.parquet(/[^/]*)?$", 1))


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows of any of several layouts; missing optional columns get their defaults.

    is_valid is edge_idx >= 0 unless given; gt_candidate_pos may be named gt_pos.
    """
    df = read_table(spark, path)
    if "gt_candidate_pos" not in df.columns:
        df = df.withColumn("gt_candidate_pos", F.col("gt_pos") if "gt_pos" in df.columns else F.lit(-1))
    return df if "is_valid" in df.columns else df.withColumn("is_valid", F.col("edge_idx") >= 0)


def episode_summary(candidates: DataFrame) -> DataFrame:
    """One row: episodes, points, labelled points, lengths and the largest number of candidates."""
    steps = candidates.groupBy("trajectory_id", "t").agg(F.count("*").alias("k"), F.max("gt_candidate_pos").alias("g"))
    own = steps.groupBy("trajectory_id").agg(F.count("*").alias("n"), F.count_if(F.col("g") >= 0).alias("labelled"), F.max("k").alias("k"))
    return own.agg(
        F.count("*").alias("episodes"), F.sum("n").alias("points"), F.sum("labelled").alias("labelled_points"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.max("k").alias("max_candidates")
    )


def as_points(bag: DataFrame) -> DataFrame:
    """Rows of an extracted recording (timestamp in seconds, latitude, longitude) in the layout of read_points."""
    w = Window.partitionBy("trajectory_id").orderBy("timestamp")
    return bag.select(
        F.col("trajectory_id"), F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint")).alias("ts"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "x", "y",
        F.row_number().over(w).cast("bigint").alias("point_id"),
    )
