"""Route overlap: how much of one route's length lies within a tolerance of another.

Routes are segment rows. The part of a segment within a tolerance of another one is a single interval in closed form
(two discs and a strip); a segment's intervals are then merged and summed. Segments meet by grid cell within their
trajectory, so long routes aren't compared segment by segment.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import distance
from ..functions.geometry import parse_lines, segments

_ENDS = ("x1", "y1", "x2", "y2")


def route_from_points(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Segments (keys, seg_no, x1, y1, x2, y2, length_m) through the known points in order of t, without repeats."""
    clean = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    w = Window.partitionBy(*keys).orderBy("t")
    ended = clean.select(*keys, F.row_number().over(w).alias("seg_no"), F.col(x).alias("x1"), F.col(y).alias("y1"), F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2"))
    moved = ended.where(F.col("x2").isNotNull() & ((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))))
    return moved.withColumn("length_m", distance(*[F.col(c) for c in _ENDS]))


def route_from_edges(matches: DataFrame, edges: DataFrame, edge: str, *keys: str) -> DataFrame:
    """Segments of the distinct edges that each trajectory uses; unknown edges are left out, shared parts count once."""
    used = matches.select(*keys, F.col(edge).alias("edge_idx")).distinct()
    return used.join(edges.select("edge_idx", *_ENDS), "edge_idx").select(*keys, F.col("edge_idx").alias("seg_no"), *_ENDS, distance(*[F.col(c) for c in _ENDS]).alias("length_m"))


def route_from_texts(matches: DataFrame, text: str, *keys: str) -> DataFrame:
    """Segments of the distinct line texts of each trajectory; texts that aren't lines are left out, shared segments count once."""
    lines = matches.select(*keys, F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    parts = lines.select(*keys, F.explode(parse_lines(F.col("_text"))).alias("_line"))
    found = parts.select(*keys, F.explode(segments(F.col("_line"))).alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in _ENDS])
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    turned = found.select(*keys, *[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]).distinct()
    whole = turned.withColumn("length_m", distance(*[F.col(c) for c in _ENDS])).where("length_m > 0")
    return whole.withColumn("seg_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*_ENDS)))


def route_by_source(matches: DataFrame, edges: DataFrame | None, text: str | None, edge: str | None, x: str, y: str, *keys: str, points: bool = True) -> DataFrame:
    """Segments of each trajectory's route with their source: its line texts (wkt), else its edges (edge_geometry), else,
    if allowed, its points (projected_points). Trajectories without any have no rows and count as missing."""
    found = None
    columns = [*keys, "seg_no", *_ENDS, "length_m"]
    sources = [("wkt", lambda: route_from_texts(matches, text, *keys)) if text else None, ("edge_geometry", lambda: route_from_edges(matches, edges, edge, *keys)) if edges is not None and edge else None,
               ("projected_points", lambda: route_from_points(matches, x, y, *keys)) if points else None]
    for source in sources:
        if source is None:
            continue
        own = source[1]().where("length_m > 0").select(*columns).withColumn("source", F.lit(source[0]))
        found = own if found is None else found.unionByName(own.join(found.select(*keys).distinct(), list(keys), "left_anti"))
    if found is None:
        raise ValueError("no source of routes is given")
    return found


#: Radians and metres up to which segments lie on one carrier line.
ANGLE, ASIDE = 1e-7, 1e-2


def dissolve(segments_: DataFrame, *keys: str) -> DataFrame:
    """Segments (keys, seg_no, x1, y1, x2, y2, length_m) that cover what the given ones do, every part of it once.

    Segments of one key are put on carrier lines by direction, then by distance from a common origin; on each line they
    are intervals, and what overlaps or touches becomes one. Segments without length are left out. Directions are
    compared by neighbours in order, so that no two near ones fall apart at the edge of a bucket.
    """
    c = F.col
    whole = Window.partitionBy(*keys)
    raw = F.atan2(c("y2") - c("y1"), c("x2") - c("x1"))
    # Both ways of a line have one angle, from just below 0 to just below a half turn.
    angle = F.when(raw < -ANGLE, raw + F.pi()).when(raw >= F.pi() - ANGLE, raw - F.pi()).otherwise(raw)
    df = segments_.select(*keys, *_ENDS).withColumns({"_size": distance(*[c(e) for e in _ENDS])}).where("_size > 0").withColumns({
        "_angle": angle, "_ox": F.min(F.least("x1", "x2")).over(whole), "_oy": F.min(F.least("y1", "y2")).over(whole),
    })

    def grouped(df: DataFrame, name: str, within: list[str], value: str, most: float) -> DataFrame:
        """Adds a number that grows where a value is more than so much above the one before it."""
        w = Window.partitionBy(*within).orderBy(value)
        df = df.withColumn("_new", F.coalesce((c(value) - F.lag(value).over(w) > most).cast("int"), F.lit(0)))
        upto = Window.partitionBy(*within).orderBy(value, c("_new").desc()).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum("_new").over(upto)).drop("_new")

    df = grouped(df, "_way", [*keys], "_angle", ANGLE)
    longest = F.max(F.struct("_size", "_angle")).over(Window.partitionBy(*keys, "_way"))
    df = df.withColumn("_ref", longest["_angle"]).withColumns({"_cos": F.cos("_ref"), "_sin": F.sin("_ref")})
    along = lambda k: (c(f"x{k}") - c("_ox")) * c("_cos") + (c(f"y{k}") - c("_oy")) * c("_sin")
    off = ((c("y1") + c("y2")) / 2 - c("_oy")) * c("_cos") - ((c("x1") + c("x2")) / 2 - c("_ox")) * c("_sin")
    df = df.withColumns({"_off": off, "_a": along("1"), "_b": along("2")}).withColumns({"_lo": F.least("_a", "_b"), "_hi": F.greatest("_a", "_b")})
    df = grouped(df, "_line", [*keys, "_way"], "_off", ASIDE)
    on = [*keys, "_way", "_line"]
    before = Window.partitionBy(*on).orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_upto", F.max("_hi").over(before)).withColumn("_new", F.coalesce((c("_lo") > c("_upto") + 1e-9).cast("int"), F.lit(0)))
    df = df.withColumn("_part", F.sum("_new").over(Window.partitionBy(*on).orderBy("_lo", "_hi", c("_new").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    merged = df.groupBy(*on, "_part").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max(F.struct("_size", "_off", "_cos", "_sin", "_ox", "_oy")).alias("m"))
    at = {f"{axis}{k}": c(f"m._o{axis}") + c(s) * c(f"m.{along_}") + sign * c("m._off") * c(f"m.{across}") for k, s in (("1", "_lo"), ("2", "_hi")) for axis, along_, sign, across in (("x", "_cos", -1, "_sin"), ("y", "_sin", 1, "_cos"))}
    placed = merged.select(*keys, *[v.alias(n) for n, v in at.items()], (c("_hi") - c("_lo")).alias("length_m"))
    return placed.withColumn("seg_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*_ENDS))).select(*keys, "seg_no", *_ENDS, "length_m")


def merge_lines(segments_: DataFrame, *keys: str) -> DataFrame:
    """Lines (keys, line_no, line, length_m) of segments that follow each other where exactly two meet.

    Ends within a micrometre are one. A ring begins at its least end. A task holds the segments of one key, of which
    there are no more than roads that its route uses.
    """
    schema = segments_.select(*keys).schema.simpleString()[7:-1] + ", line_no int, line array<struct<x:double,y:double>>, length_m double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ends = [tuple(sorted(((round(a, 6), round(b, 6)), (round(x, 6), round(y, 6))))) for a, b, x, y in part[list(_ENDS)].itertuples(index=False)]
        at: dict[tuple, list[int]] = {}
        for i, pair in enumerate(ends):
            for p in pair:
                at.setdefault(p, []).append(i)
        used, rows = set(), []
        # Lines begin where other than two meet; what is left then are rings.
        for start in [*sorted(p for p in at if len(at[p]) != 2), *sorted(p for p in at if len(at[p]) == 2)]:
            for i in sorted(at[start], key=lambda k: ends[k]):
                if i in used:
                    continue
                line, here = [start], start
                while i is not None:
                    used.add(i)
                    here = ends[i][1] if ends[i][0] == here else ends[i][0]
                    line.append(here)
                    i = next((k for k in at[here] if k not in used), None) if len(at[here]) == 2 else None
                length = float(sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False)))
                rows.append((*part[list(keys)].iloc[0], len(rows), [{"x": x, "y": y} for x, y in line], length))
        return pd.DataFrame(rows, columns=[*keys, "line_no", "line", "length_m"])

    return segments_.where("length_m > 0").select(*keys, *_ENDS).groupBy(*keys).applyInPandas(run, schema)


def _intervals(pairs: DataFrame, r: float) -> DataFrame:
    """Adds s and e, as shares of segment 1-2: from and to of what lies within r of segment q; null where nothing does.

    Step by step in columns of their own, as one nested expression would repeat the roots many times over.
    """
    c, work = F.col, []

    def add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        work.extend(columns)
        return df.withColumns(columns)

    df = add(pairs, {"_dx": c("x2") - c("x1"), "_dy": c("y2") - c("y1"), "_ex": c("q_x2") - c("q_x1"), "_ey": c("q_y2") - c("q_y1")})
    df = add(df, {"_a": c("_dx") * c("_dx") + c("_dy") * c("_dy"), "_size": F.sqrt(c("_ex") * c("_ex") + c("_ey") * c("_ey"))})
    for k in ("1", "2"):  # the discs at both ends of q
        df = add(df, {f"_fx{k}": c("x1") - c(f"q_x{k}"), f"_fy{k}": c("y1") - c(f"q_y{k}")})
        df = add(df, {f"_b{k}": c("_dx") * c(f"_fx{k}") + c("_dy") * c(f"_fy{k}")})
        df = add(df, {f"_r{k}": c(f"_b{k}") * c(f"_b{k}") - c("_a") * (c(f"_fx{k}") * c(f"_fx{k}") + c(f"_fy{k}") * c(f"_fy{k}") - r * r)})
        root = F.when(c(f"_r{k}") >= 0, F.sqrt(c(f"_r{k}")))
        df = add(df, {f"_s{k}": (-c(f"_b{k}") - root) / c("_a"), f"_e{k}": (-c(f"_b{k}") + root) / c("_a")})
    # The strip along q between its ends, and within r across it.
    df = add(df, {"_ux": c("_ex") / c("_size"), "_uy": c("_ey") / c("_size")})
    df = add(df, {
        "_l0": c("_fx1") * c("_ux") + c("_fy1") * c("_uy"), "_l": c("_dx") * c("_ux") + c("_dy") * c("_uy"),
        "_c0": c("_fy1") * c("_ux") - c("_fx1") * c("_uy"), "_c": c("_dy") * c("_ux") - c("_dx") * c("_uy"),
    })
    for at, step, lo, hi in (("_l0", "_l", F.lit(0.0), c("_size")), ("_c0", "_c", F.lit(-r), F.lit(r))):
        df = add(df, {f"{step}1": (lo - c(at)) / F.nullif(c(step), F.lit(0.0)), f"{step}2": (hi - c(at)) / F.nullif(c(step), F.lit(0.0))})
        flat = F.abs(step) < 1e-12
        inside = (c(at) >= lo) & (c(at) <= hi)
        df = add(df, {
            f"{step}s": F.when(flat, F.when(inside, F.lit(float("-inf")))).otherwise(F.least(f"{step}1", f"{step}2")),
            f"{step}e": F.when(flat, F.when(inside, F.lit(float("inf")))).otherwise(F.greatest(f"{step}1", f"{step}2")),
        })
    both = c("_ls").isNotNull() & c("_cs").isNotNull()
    df = add(df, {"_lo": F.when(both, F.greatest("_ls", "_cs")), "_hi": F.when(both, F.least("_le", "_ce"))})
    met = c("_lo") <= c("_hi")
    df = add(df, {"_s3": F.when(met, c("_lo")), "_e3": F.when(met, c("_hi"))})
    df = add(df, {"_from": F.least("_s1", "_s2", "_s3"), "_to": F.greatest("_e1", "_e2", "_e3")})
    found = c("_from").isNotNull()
    ends = {"s": F.when(found, F.greatest(c("_from"), F.lit(0.0))), "e": F.when(found, F.least(c("_to"), F.lit(1.0)))}
    return df.withColumns(ends).drop(*work)


def overlap_length(route: DataFrame, other: DataFrame, tolerance_m: float, *keys: str, cell: float = 200.0, once: bool = False) -> DataFrame:
    """For each key of route: length_m, and overlap_m, what of it lies within the tolerance of the other route.

    Parts of a route that repeat count as often as they do; with once they count once in overlap_m, and still as often
    as they repeat in length_m, so that a route that runs back over itself overlaps itself by less than its length.
    A route without the other has no overlap.
    """
    c = F.col
    every = route
    if once:
        route, other = dissolve(route, *keys), dissolve(other, *keys)

    def celled(df: DataFrame, grow: float) -> DataFrame:
        low, high = (lambda a, b: F.floor((F.least(a, b) - grow) / cell).cast("bigint")), (lambda a, b: F.floor((F.greatest(a, b) + grow) / cell).cast("bigint"))
        return df.withColumn("_cx", F.explode(F.sequence(low(c("x1"), c("x2")), high(c("x1"), c("x2"))))).withColumn("_cy", F.explode(F.sequence(low(c("y1"), c("y2")), high(c("y1"), c("y2")))))

    q = celled(other, tolerance_m).select(*keys, "_cx", "_cy", *[c(e).alias(f"q_{e}") for e in _ENDS])
    met = celled(route, 0.0).join(q, [*keys, "_cx", "_cy"]).drop("_cx", "_cy").distinct()
    parts = _intervals(met, tolerance_m)
    w = Window.partitionBy(*keys, "seg_no").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    # No filter on s <= e before the window: Spark would push it down with all the arithmetic written out in it.
    holds = c("s") <= c("e")
    covered = parts.withColumn("upto", F.max(F.when(holds, c("e"))).over(w))
    new = F.when(holds, F.greatest(c("e") - F.greatest(c("s"), F.coalesce(c("upto"), F.lit(float("-inf")))), F.lit(0.0))).otherwise(0.0)
    own = covered.groupBy(*keys).agg(F.sum(new * c("length_m")).alias("overlap_m"))
    whole = every.groupBy(*keys).agg(F.sum("length_m").alias("length_m"))
    return whole.join(own, list(keys), "left").withColumn("overlap_m", F.least(F.coalesce("overlap_m", F.lit(0.0)), "length_m"))


def route_overlap(pred: DataFrame, truth: DataFrame, tolerance_m: float, *keys: str, once: bool = False) -> DataFrame:
    """Correct, extra and missed fractions, F1 and an IoU-like ratio for each route, by overlap both ways (see overlap_length for once)."""
    p = overlap_length(pred, truth, tolerance_m, *keys, once=once).withColumnsRenamed({"length_m": "pred_length_m", "overlap_m": "pred_overlap_m"})
    t = overlap_length(truth, pred, tolerance_m, *keys, once=once).withColumnsRenamed({"length_m": "gt_length_m", "overlap_m": "gt_overlap_m"})
    both = p.join(t, list(keys), "full").fillna(0.0)
    c = F.col
    part = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    out = both.withColumns({"precision": part("pred_overlap_m", "pred_length_m"), "correct_fraction": part("gt_overlap_m", "gt_length_m")})
    both_ways = c("precision") + c("correct_fraction")
    common = F.least("pred_overlap_m", "gt_overlap_m")
    joint = c("pred_length_m") + c("gt_length_m") - common
    return out.withColumns({
        "f1": F.when(both_ways > 0, 2 * c("precision") * c("correct_fraction") / both_ways).otherwise(0.0), "iou_like": F.when(joint > 0, common / joint).otherwise(0.0),
        "extra_fraction": F.when(c("pred_length_m") > 0, 1 - c("precision")).otherwise(1.0), "missed_fraction": F.when(c("gt_length_m") > 0, 1 - c("correct_fraction")).otherwise(1.0),
    })


def overlap_summary(rows: DataFrame, success_at: float = 0.9) -> DataFrame:
    """One row: means and length-weighted means of route_overlap, and the share of routes that succeed."""
    c = F.col
    return rows.agg(
        F.count("*").alias("trajectories"), F.avg("correct_fraction").alias("mean_correct_fraction"), (F.sum("gt_overlap_m") / F.sum("gt_length_m")).alias("weighted_mean_correct_fraction"),
        (F.sum(c("f1") * c("gt_length_m")) / F.sum("gt_length_m")).alias("weighted_f1"), (1 - F.sum("pred_overlap_m") / F.sum("pred_length_m")).alias("weighted_extra_fraction"),
        (1 - F.sum("gt_overlap_m") / F.sum("gt_length_m")).alias("weighted_missed_fraction"), F.avg((c("correct_fraction") >= success_at).cast("double")).alias("trajectory_success_rate"),
    )
