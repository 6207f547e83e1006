"""Directed road edges, their degrees and features, and the line graph of legal transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import between, turn, wrap
from ..functions.geometry import curvature, line_bearing, line_length, reverse_line
from ..functions.tags import CLASS_ORDER, DRIVEABLE, first_value, flag, runs_backwards, says_oneway
from .ranks import quantiles, range_of


def directed_edges(links: DataFrame, library: bool = False, min_length_m: float = 0.5, classes: tuple[str, ...] | None = DRIVEABLE) -> DataFrame:
    """Links (osm_way_id, u, v, line, highway, oneway, bridge, tunnel, ...) to directed edges with numbered edge_idx.

    A two-way link gives a second edge with the line reversed. The stages keep the digitised direction of a one-way
    road of value -1; the library reverses it. edge_idx follows (link_id, direction).
    """
    kept = links.withColumns({"road_class": first_value(F.col("highway")), "one": says_oneway(F.col("oneway"), library)})
    if classes is not None:
        kept = kept.where(F.col("road_class").isin(*classes))
    back = F.lit(False) if not library else F.col("one") & runs_backwards(F.col("oneway"))
    both = kept.withColumn("direction", F.explode(F.when(back, F.array(F.lit("rev"))).when(F.col("one"), F.array(F.lit("fwd"))).otherwise(F.array(F.lit("fwd"), F.lit("rev")))))
    rev = F.col("direction") == "rev"
    turned = both.withColumns({
        "is_reverse": rev.cast("int"), "from": F.when(rev, F.col("v")).otherwise(F.col("u")), "to": F.when(rev, F.col("u")).otherwise(F.col("v")),
        "line": F.when(rev, reverse_line(F.col("line"))).otherwise(F.col("line")),
    }).withColumns({"u": F.col("from"), "v": F.col("to")}).drop("from", "to")
    measured = turned.withColumns({
        "length_m": line_length(F.col("line")), "bearing_rad": line_bearing(F.col("line")), "curvature": curvature(F.col("line")),
        "edge_id": F.concat_ws(":", F.col("osm_way_id").cast("string"), F.col("u").cast("string"), F.col("v").cast("string"), F.col("direction")),
        "bridge": flag(F.col("bridge")), "tunnel": flag(F.col("tunnel")), "oneway": F.col("one").cast("int"),
    }).where(F.col("length_m") >= min_length_m).drop("one")
    return number_edges(measured, "link_id", "direction")


def number_edges(edges: DataFrame, *order: str, ranges: int = 64, sample: int = 4096) -> DataFrame:
    """Adds edge_idx from 0 in the given order.

    A row's range follows from its first value alone, by boundaries from a sample of values (those with the least
    hashes, so the same ones each time). Ranges are numbered on their own and shifted by the counts before them, so no
    task sees all edges and nothing hangs on how Spark deals rows out. Null values go first.
    """
    first = F.col(order[0])
    some = edges.select(first.alias("v")).where("v IS NOT NULL").distinct().orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    values = sorted(r["v"] for r in some)
    bounds = sorted({values[len(values) * i // ranges] for i in range(1, ranges)}) if values else []
    own = edges.withColumn("_range", F.when(first.isNull(), F.lit(0)).otherwise(range_of(first, bounds)))
    counts = own.groupBy("_range").agg(F.count("*").alias("_n"))
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = own.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    out = numbered.join(F.broadcast(shift.drop("_n")), "_range")  # a row for each range
    return out.withColumn("edge_idx", F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before")


def clean_edges(edges: DataFrame, min_length_m: float = 0.5) -> DataFrame:
    """Edges with a line of two vertices or more and the least length, length and bearing taken from it; of rows with
    one edge_id that with the smallest edge_idx. edges has edge_idx, edge_id and line."""
    valid = edges.where(F.size("line") >= 2).withColumn("length_m", line_length(F.col("line"))).where(F.col("length_m") >= min_length_m)
    return dedup_edges(valid.withColumn("bearing_rad", wrap(line_bearing(F.col("line")))), "edge_id")


def nodes_in_use(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes at which an edge begins or ends; nodes has node."""
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_semi")


def segment_features(edges: DataFrame, standard: bool = True) -> DataFrame:
    """Eleven numeric features of every edge, standardised if asked for, and the id of its road class in a fixed order.

    edges has edge_idx, edge_id, bearing_rad, length_m, curvature, road_class and degrees(); maxspeed in km/h, or m/s up to 5.
    in_degree counts the edges that lead to where this one begins, out_degree those that begin where it ends.
    """
    number = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d))
    limit = F.col("maxspeed").cast("double")
    ids = F.create_map(*[x for i, name in enumerate(CLASS_ORDER) for x in (F.lit(name), F.lit(i))])
    raw = edges.select(
        "edge_idx", "edge_id", F.log1p(F.greatest(number("length_m", 0.0), F.lit(0.0))).alias("log_length_m"), F.sin(number("bearing_rad", 0.0)).alias("sin_bearing"),
        F.cos(number("bearing_rad", 0.0)).alias("cos_bearing"), F.coalesce(F.when(limit > 5, limit / 3.6).otherwise(limit), F.lit(13.89)).alias("maxspeed_mps"),
        number("lanes", 1.0).alias("lanes_norm_raw"), number("curvature", 0.0).alias("curvature"), number("predecessors", 0.0).alias("in_degree"),
        number("successors", 0.0).alias("out_degree"), number("bridge", 0.0).alias("bridge_flag"), number("tunnel", 0.0).alias("tunnel_flag"),
        number("oneway", 0.0).alias("oneway_flag"), F.coalesce(ids[F.coalesce("road_class", F.lit("unknown"))], F.lit(len(CLASS_ORDER) - 1)).alias("road_class_id"),
    )
    if not standard:
        return raw
    names = [c for c in raw.columns if c not in ("edge_idx", "edge_id", "road_class_id")]
    scaled = standardise(raw, "edge_idx", *names)
    return raw.select("edge_idx", "edge_id", "road_class_id").join(scaled.withColumnsRenamed({f"{n}_z": n for n in names}), "edge_idx")


def degrees(edges: DataFrame) -> DataFrame:
    """Adds out_degree_u and in_degree_v (the edge's own ends) and successors and predecessors (where it leads and comes from)."""
    out = edges.groupBy("u").agg(F.count("*").alias("n"))
    into = edges.groupBy("v").agg(F.count("*").alias("n"))
    sides = [("out_degree_u", out, "u", "u"), ("in_degree_v", into, "v", "v"), ("successors", out, "u", "v"), ("predecessors", into, "v", "u")]
    for name, counts, key, on in sides:
        side = counts.select(F.col(key).alias("_node"), F.col("n").alias(name))
        edges = edges.join(side.hint("merge"), edges[on] == side["_node"], "left").drop("_node").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))
    return edges


def node_table(edges: DataFrame) -> DataFrame:
    """Every end of an edge once, with the coordinates its first edge gives it."""
    a = edges.select(F.col("u").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y"), "edge_idx")
    b = edges.select(F.col("v").alias("node"), F.col("x2").alias("x"), F.col("y2").alias("y"), "edge_idx")
    first = a.unionByName(b).groupBy("node").agg(F.min_by(F.struct("x", "y"), F.struct("edge_idx", "x", "y")).alias("p"))
    return first.select("node", "p.x", "p.y")


def dedup_edges(edges: DataFrame, key: str = "edge_id") -> DataFrame:
    """Of edges with one key, that with the smallest edge_idx."""
    w = Window.partitionBy(key).orderBy("edge_idx")
    return edges.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def road_features(edges: DataFrame) -> DataFrame:
    """Twelve features clipped and scaled to about [0, 1]; classes are numbered in order of their names."""
    classes = edges.select(F.coalesce("road_class", F.lit("unknown")).alias("class")).distinct()
    numbered = classes.withColumn("id", F.row_number().over(Window.orderBy("class")) - 1)  # a row for each road class
    scale = quantiles(edges, "length_m", [0.95]).select(F.greatest(F.get("q", F.lit(0)), F.lit(1.0)).alias("long"))
    n = classes.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("last"))
    named = edges.withColumn("class", F.coalesce("road_class", F.lit("unknown"))).join(F.broadcast(numbered), "class")
    scaled = named.crossJoin(F.broadcast(scale)).crossJoin(F.broadcast(n))  # single rows
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    or_ = lambda c, d: F.coalesce(F.col(c), F.lit(d)).cast("double")
    return scaled.select(
        "edge_idx", (F.least(F.greatest("length_m", F.lit(0.0)), F.col("long")) / F.col("long")).alias("length_norm"),
        F.sin("bearing_rad").alias("sin_bearing"), F.cos("bearing_rad").alias("cos_bearing"), (F.col("id") / F.col("last")).alias("road_class_id_norm"),
        or_("oneway", 0).alias("oneway"), (clip(or_("maxspeed", 50.0), 1.0, 160.0) / 160).alias("maxspeed_norm"), (clip(or_("lanes", 1.0), 1.0, 10.0) / 10).alias("lanes_norm"),
        (clip(or_("curvature", 1.0), 1.0, 5.0) / 5).alias("curvature"), (clip(or_("in_degree_v", 0), 0.0, 10.0) / 10).alias("in_degree_norm"),
        (clip(or_("out_degree_u", 0), 0.0, 10.0) / 10).alias("out_degree_norm"), or_("bridge", 0).alias("bridge"), or_("tunnel", 0).alias("tunnel"),
    )


def standardise(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key and each column less its mean, over its population deviation (1 where that is nearly 0)."""
    about = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    wide = df.crossJoin(F.broadcast(about))  # a single row
    score = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}"))
    return wide.select(key, *[score(c).alias(f"{c}_z") for c in columns])


def transitions(edges: DataFrame, uturn: str = "back", uturn_angle_deg: float = 160.0, allow_uturns: bool = False, self_loops: bool = True) -> DataFrame:
    """Pairs of edges that follow each other: (prev_edge_idx, curr_edge_idx, is_self, is_uturn, turn_angle_rad).

    A U-turn ends where its predecessor began; by uturn="angle" a turn of 160 degrees or more is one as well.
    """
    a = edges.select(F.col("edge_idx").alias("prev_edge_idx"), F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("bearing_rad").alias("pb"))
    b = edges.select(F.col("edge_idx").alias("curr_edge_idx"), F.col("u").alias("cu"), F.col("v").alias("cv"), F.col("bearing_rad").alias("cb"))
    pairs = a.join(b.hint("merge"), F.col("pv") == F.col("cu"))  # all roads: their file's size says little of theirs
    back = F.col("cv") == F.col("pu")
    if uturn == "angle":
        back = back | (between(F.col("pb"), F.col("cb")) >= F.radians(F.lit(uturn_angle_deg)))
    own = F.col("prev_edge_idx") == F.col("curr_edge_idx")
    out = pairs.select(
        "prev_edge_idx", "curr_edge_idx", own.cast("int").alias("is_self"), (back & (~own if uturn == "angle" else F.lit(True))).cast("int").alias("is_uturn"),
        turn(F.col("pb"), F.col("cb")).alias("turn_angle_rad"),
    )
    if not allow_uturns:
        out = out.where("is_uturn = 0")
    if self_loops:
        loops = edges.select(F.col("edge_idx").alias("prev_edge_idx"), F.col("edge_idx").alias("curr_edge_idx"), F.lit(1).alias("is_self"), F.lit(0).alias("is_uturn"), F.lit(0.0).alias("turn_angle_rad"))
        out = loops.unionByName(out)
    return out


def graph_report(edges: DataFrame) -> DataFrame:
    """Edges by road class with their lengths."""
    return edges.groupBy("road_class").agg(
        F.count("*").alias("edges"), F.min("length_m").alias("min_m"), F.percentile("length_m", F.lit(0.5)).alias("median_m"),
        F.avg("length_m").alias("mean_m"), F.max("length_m").alias("max_m"),
    )


def neighbour_mean(features: DataFrame, pairs: DataFrame, key: str, *columns: str) -> DataFrame:
    """Mean of the predecessors' features for every edge: the gathering step of a mean-aggregating graph layer."""
    source = features.select(F.col(key).alias("prev_edge_idx"), *columns)
    return pairs.join(source, "prev_edge_idx").groupBy("curr_edge_idx").agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
