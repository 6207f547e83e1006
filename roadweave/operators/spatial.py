"""Joins by place and time without comparing everything with everything.

A box join puts each right-hand box, grown by the radius, into the grid cells it covers and each left-hand point into
the one cell it is in: an equi-join on the cell, with no pair twice. The cell should be at least as wide as the radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import between
from ..functions.geometry import line_text, nearest_on, project_to_line, project_to_segments, segments


def box_join(points: DataFrame, boxes: DataFrame, radius: float, cell: float = 100.0) -> DataFrame:
    """Pairs of a point (x, y) and a box (min_x, min_y, max_x, max_y) whose radius-grown box holds the point."""
    grown = [F.floor((F.col(c) + s * radius) / cell).cast("bigint") for c, s in (("min_x", -1), ("max_x", 1), ("min_y", -1), ("max_y", 1))]
    celled = boxes.withColumn("_cx", F.explode(F.sequence(grown[0], grown[1]))).withColumn("_cy", F.explode(F.sequence(grown[2], grown[3])))
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell).cast("bigint"), "_cy": F.floor(F.col("y") / cell).cast("bigint")})
    inside = (
        (F.col("min_x") - radius <= F.col("x")) & (F.col("x") <= F.col("max_x") + radius)
        & (F.col("min_y") - radius <= F.col("y")) & (F.col("y") <= F.col("max_y") + radius)
    )
    # Never by a broadcast: Spark takes the boxes for as small as the file they come from, not for what the cells make of them.
    return placed.join(celled.hint("merge"), ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def with_boxes(edges: DataFrame) -> DataFrame:
    """Adds the bounding box of edges: of the column line where there is one, else of x1, y1, x2, y2."""
    if "line" in edges.columns:
        of = lambda end, axis: end(F.transform("line", lambda p: p[axis]))
        return edges.withColumns({f"{name}_{axis}": of(end, axis) for name, end in (("min", F.array_min), ("max", F.array_max)) for axis in ("x", "y")})
    return edges.withColumns({"min_x": F.least("x1", "x2"), "max_x": F.greatest("x1", "x2"), "min_y": F.least("y1", "y2"), "max_y": F.greatest("y1", "y2")})


def _nearest(edges: DataFrame) -> Column:
    """Struct (near, seg_no, distance, x, y, offset) of a point (x, y) on an edge, be it a line (with its segments) or straight."""
    x, y = F.col("x"), F.col("y")
    if "line" in edges.columns:
        return project_to_segments(x, y, F.col("_segments"))
    return nearest_on(x, y, *[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0), F.lit(0.0))


def _prepared(edges: DataFrame) -> DataFrame:
    """Edges with boxes, and lines with their segments, which are cut once and not for each point that comes near."""
    boxed = with_boxes(edges)
    return boxed.withColumn("_segments", segments(F.col("line"))) if "line" in edges.columns else boxed


def probe(points: DataFrame, edges: DataFrame, radius: float, key: list[str], cell: float = 100.0, strict: bool = False) -> DataFrame:
    """box_join with the radius, and for points without a hit once more with twice the radius."""
    edges = _prepared(edges)
    near = box_join(points, edges, radius, cell)
    missed = points.join(near.select(*key).distinct(), key, "left_anti")
    found = near.unionByName(box_join(missed, edges, 2 * radius, cell))
    return found.where(_nearest(edges)["distance"] <= radius) if strict else found


def candidates(points: DataFrame, edges: DataFrame, radius: float = 50.0, k: int = 10, cell: float = 100.0, strict: bool = False) -> DataFrame:
    """The k nearest edges of every point, ranked by distance, then heading, then edge_idx.

    Points have trajectory_id, t, x, y, yaw, speed_mps; edges edge_idx, line (or x1, y1, x2, y2 of straight ones),
    length_m, bearing_rad, maxspeed (km/h). The radius is that of a box; strict=True also asks for the distance. Points without any edge in
    the doubled box have no rows.
    """
    hits = probe(points, edges, radius, ["trajectory_id", "t"], cell, strict)
    p = F.col("_p")
    limit = F.coalesce(F.col("maxspeed"), F.lit(50.0)) / 3.6
    measured = hits.withColumn("_p", _nearest(edges)).withColumns({
        "distance_m": p["distance"], "proj_x": p["x"], "proj_y": p["y"], "offset_m": p["offset"], "offset_ratio": p["offset"] / F.greatest("length_m", F.lit(1e-9)),
        "yaw_diff_rad": between(F.col("yaw"), F.col("bearing_rad")), "speed_consistency": F.abs(F.col("speed_mps") - limit) / F.greatest(limit, F.lit(1.0)),
    })
    # Rounded, so that ties don't hang on the last bit of the arithmetic.
    order = Window.partitionBy("trajectory_id", "t").orderBy(F.round("distance_m", 9), F.round("yaw_diff_rad", 9), "edge_idx")
    ranked = measured.withColumn("candidate_rank", (F.row_number().over(order) - 1).cast("bigint"))
    return ranked.where(F.col("candidate_rank") < k).drop("_p", "_segments", "min_x", "max_x", "min_y", "max_y")


def with_geometry(rows: DataFrame, edges: DataFrame, edge: str = "edge_idx") -> DataFrame:
    """rows with geometry_wkt, the text of their edge's line; null for an edge that edges doesn't have."""
    line = F.col("line") if "line" in edges.columns else F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)])
    known = edges.select(F.col("edge_idx").alias(edge), line_text(line).alias("geometry_wkt")).dropDuplicates([edge])
    return rows.join(known.hint("merge"), edge, "left")  # texts of all roads, which no task should hold


def nearest_edge(points: DataFrame, edges: DataFrame, radius: float = 30.0, cell: float = 100.0) -> DataFrame:
    """The nearest edge of every point within the box (or the doubled one): gt_edge_idx and gt_edge_dist_m, null where none is."""
    hits = probe(points, edges, radius, ["trajectory_id", "t"], cell)
    best = hits.withColumn("d", _nearest(edges)["distance"]).groupBy("trajectory_id", "t").agg(
        F.min_by(F.struct("edge_idx", "d"), F.struct(F.round("d", 9), F.col("edge_idx"))).alias("best")
    )
    out = points.select("trajectory_id", "t").join(best, ["trajectory_id", "t"], "left")
    return out.select("trajectory_id", "t", F.col("best.edge_idx").alias("gt_edge_idx"), F.col("best.d").alias("gt_edge_dist_m"))


def nearest_edge_by_route(points: DataFrame, routes: DataFrame, edges: DataFrame, radius: float = 30.0, cell: float = 100.0) -> DataFrame:
    """nearest_edge of the place on a trajectory's route that is nearest to the point, with that place as gt_x and gt_y.

    routes has trajectory_id and line; points of trajectories without a route have nulls.
    """
    on = points.join(routes.select("trajectory_id", F.col("line").alias("_route")), "trajectory_id", "left")
    on = on.withColumn("_p", project_to_line(F.col("x"), F.col("y"), F.col("_route"))).select("trajectory_id", "t", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    near = nearest_edge(on.where("x IS NOT NULL"), edges, radius, cell)
    placed = on.withColumnsRenamed({"x": "gt_x", "y": "gt_y"})
    return placed.join(near, ["trajectory_id", "t"], "left")


def asof_nearest(left: DataFrame, right: DataFrame, by: str, at: str, value: str, tolerance: float) -> DataFrame:
    """left with the value of the right row nearest in time within the tolerance; of two as near, the earlier.

    Both sides go through one sorted pass over each key; rows of one time on the right give their smallest value.
    """
    one = right.groupBy(by, at).agg(F.min(value).alias("_v"))
    tagged = left.withColumn("_v", F.lit(None).cast(one.schema["_v"].dataType)).withColumn("_r", F.lit(1))
    both = tagged.unionByName(one.withColumn("_r", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_r")
    own = F.when(F.col("_r") == 0, F.struct(F.col(at).alias("t"), F.col("_v").alias("v")))
    before = F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumns({"_b": before, "_a": after}).where("_r = 1")
    gap_b, gap_a = F.col(at) - F.col("_b.t"), F.col("_a.t") - F.col(at)
    pick = F.when(gap_b <= F.coalesce(gap_a, gap_b), F.col("_b")).otherwise(F.coalesce("_a", "_b"))
    near = F.coalesce(F.least(gap_b, gap_a) <= tolerance, F.lit(False))
    return seen.withColumn(value, F.when(near, pick["v"])).drop("_v", "_r", "_b", "_a")


def recall_at(candidates_: DataFrame, labelled: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: for each k the share of the given points (trajectory_id, t) whose own edge is among the first k."""
    best = candidates_.groupBy("trajectory_id", "t").agg(F.min(F.when(F.col("is_gt") == 1, F.col("candidate_rank"))).alias("r"))
    joined = labelled.select("trajectory_id", "t").join(best, ["trajectory_id", "t"], "left")
    n = F.count("*")
    share = lambda k: F.when(n > 0, F.count_if(F.col("r") < k) / n)
    return joined.agg(n.alias("points"), *[share(k).alias(f"recall_at_{k}") for k in ks])


def recall_by_trajectory(candidates_: DataFrame, labelled: DataFrame, worst: int | None = 20) -> DataFrame:
    """Share of each trajectory's points whose own edge is a candidate, the worst first."""
    hit = candidates_.groupBy("trajectory_id", "t").agg(F.max("is_gt").alias("hit"))
    joined = labelled.select("trajectory_id", "t").join(hit, ["trajectory_id", "t"], "left")
    out = joined.groupBy("trajectory_id").agg(F.count("*").alias("points"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
    return out.orderBy("recall", "trajectory_id").limit(worst) if worst else out


def crop(edges: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, buffer: float = 150.0) -> DataFrame:
    """Edges whose box meets a focus box grown by the buffer."""
    e = with_boxes(edges)
    meets: Column = (F.col("max_x") >= min_x - buffer) & (F.col("min_x") <= max_x + buffer) & (F.col("max_y") >= min_y - buffer) & (F.col("min_y") <= max_y + buffer)
    return e.where(meets).drop("min_x", "max_x", "min_y", "max_y")
