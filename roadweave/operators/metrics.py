"""Evaluation of match tables: rows (trajectory_id, t, pred_edge_idx, gt_edge_idx, projections, confidence, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import distance, known
from ..functions.tags import threshold_name
from .ranks import quantiles

# Names that a column may have in tables of other origin, the first present counting.
ALIASES = {
    "trajectory_id": ("trajectory_id", "traj_id", "track_id", "id"),
    "t": ("t", "step", "point_idx", "idx", "time_idx"),
    "pred_edge_idx": ("pred_edge_idx", "pred_edge_id", "matched_edge_idx", "matched_edge_id"),
    "gt_edge_idx": ("gt_edge_idx", "gt_edge_id", "true_edge_idx", "true_edge_id"),
    "gt_candidate_pos": ("gt_candidate_pos", "gt_action", "target", "gt_candidate"),
    "pred_route_wkt": ("pred_route_wkt", "pred_geometry_wkt", "matched_route_wkt"),
    "gt_route_wkt": ("gt_route_wkt", "gt_geometry_wkt", "true_route_wkt"),
    "pred_proj_x": ("pred_proj_x", "matched_x", "proj_x", "x_pred", "pred_x"),
    "pred_proj_y": ("pred_proj_y", "matched_y", "proj_y", "y_pred", "pred_y"),
    "gt_proj_x": ("gt_proj_x", "true_proj_x", "gt_x", "x_gt"),
    "gt_proj_y": ("gt_proj_y", "true_proj_y", "gt_y", "y_gt"),
}

# Names of an edge's number and of its id in candidate tables, the first present counting.
EDGE_NUMBERS = ("edge_idx", "segment_idx", "road_segment_idx")
EDGE_NAMES = ("edge_id", "osm_edge_id", "segment_id")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the missing columns in order."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def canonical(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns under their first present alias get the canonical name; a missing t counts rows in their order."""
    for name, others in aliases.items():
        found = next((c for c in others if c in df.columns), None)
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    if "t" not in df.columns:
        w = Window.partitionBy("trajectory_id").orderBy("_seq")
        df = df.withColumn("_seq", F.monotonically_increasing_id()).withColumn("t", (F.row_number().over(w) - 1).cast("bigint")).drop("_seq")
    return df


def canonical_candidates(df: DataFrame) -> DataFrame:
    """A candidate table with edge_idx, edge_id, candidate_rank, is_gt and the sines and cosines of its angles, filled in where absent.

    Ranks follow the distance where there is one, then edge_idx; edge ids are the numbers as texts; is_gt is false.
    """
    require(df, "trajectory_id", "t")
    if "edge_idx" not in df.columns:
        found = next((c for c in EDGE_NUMBERS if c in df.columns), None)
        if found is None:
            raise ValueError("missing columns: edge_idx")
        df = df.withColumn("edge_idx", F.col(found))
    df = df.withColumns({c: F.col(c).cast("bigint") for c in ("trajectory_id", "t", "edge_idx")})
    added = {}
    if "edge_id" not in df.columns:
        named = next((c for c in EDGE_NAMES if c in df.columns), None)
        added["edge_id"] = F.col(named) if named else F.col("edge_idx").cast("string")
    if "candidate_rank" not in df.columns:
        order = [F.col(c) for c in ("distance_m", "edge_idx") if c in df.columns]
        added["candidate_rank"] = F.row_number().over(Window.partitionBy("trajectory_id", "t").orderBy(*order)) - 1
    if "is_gt" not in df.columns:
        added["is_gt"] = F.lit(False)
    for angle, name in (("yaw", "yaw"), ("segment_bearing_rad", "segment_bearing")):
        if angle in df.columns:
            added |= {f"{f}_{name}": g(F.col(angle).cast("double")) for f, g in (("sin", F.sin), ("cos", F.cos)) if f"{f}_{name}" not in df.columns}
    return df.withColumns(added) if added else df


def join_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with the truth of the same trajectory and t (or timestamp); columns of truth that clash end in _gt."""
    keys = next((k for k in (["trajectory_id", "t"], ["trajectory_id", "timestamp"]) if set(k) <= set(pred.columns) & set(truth.columns)), None)
    if keys is None:
        raise ValueError("neither trajectory_id and t nor trajectory_id and timestamp are in both tables")
    renamed = truth.withColumnsRenamed({c: f"{c}_gt" for c in truth.columns if c in pred.columns and c not in keys})
    return pred.join(renamed, keys)


def labelled(matches: DataFrame, need_candidate: bool = False) -> DataFrame:
    """Rows with a true edge, and if asked for a true candidate."""
    out = matches.where("gt_edge_idx IS NOT NULL AND gt_edge_idx >= 0")
    return out.where("gt_candidate_pos IS NOT NULL AND gt_candidate_pos >= 0") if need_candidate else out


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def judged(matches: DataFrame, threshold_m: float = 10.0, low_confidence: float = 0.35) -> DataFrame:
    """Adds edge_correct, projection_error_m and the kinds of error as booleans; unknown errors are within nothing.

    edge_correct compares edges; a table without them has its candidates' places compared, and without those it is false.
    """
    col = F.col
    ways = [("pred_edge_idx", "gt_edge_idx"), ("pred_candidate_pos", "gt_candidate_pos")]
    right = next((col(p) == col(g) for p, g in ways if {p, g} <= set(matches.columns)), F.lit(False))
    error = distance(col("pred_proj_x"), col("pred_proj_y"), col("gt_proj_x"), col("gt_proj_y"))
    out = matches.withColumns({"edge_correct": right, "projection_error_m": known(error)})
    out = out.withColumns({f"within_{r}m": _holds(col("projection_error_m") <= r) for r in (2, 5, 10)} | {"projection_success": _holds(col("projection_error_m") <= threshold_m)})
    wrong = ~col("edge_correct")
    return out.withColumns({"near_but_wrong_edge": wrong & col("within_5m"), "severe_error": wrong & ~col("within_10m"), "low_confidence": _holds(known(col("confidence")) < low_confidence)})


def share(flag: str, where: Column | None = None) -> Column:
    """Mean of a boolean column, of rows where a condition holds."""
    value = F.col(flag).cast("double")
    return F.avg(value if where is None else F.when(where, value))


def edge_taxonomy(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds same_osm_way, same_road_class, reverse_pair and same_undirected_uv of the predicted and the true edge."""
    attributes = ("osm_way_id", "road_class", "u", "v")
    for side in ("pred", "gt"):
        look = edges.select(F.col("edge_idx").alias(f"{side}_edge_idx"), *[F.col(c).alias(f"_{side}_{c}") for c in attributes])
        matches = matches.join(look, f"{side}_edge_idx", "left")
    p, g = (lambda c, s=s: F.col(f"_{s}_{c}") for s in ("pred", "gt"))
    same = (p("u") == g("u")) & (p("v") == g("v"))
    reverse = (p("u") == g("v")) & (p("v") == g("u"))
    out = matches.withColumns({
        "same_osm_way": _holds(p("osm_way_id") == g("osm_way_id")), "same_road_class": _holds(p("road_class") == g("road_class")),
        "reverse_pair": _holds(reverse), "same_undirected_uv": _holds(same | reverse),
    })
    return out.drop(*[f"_{s}_{c}" for s in ("pred", "gt") for c in attributes])


def transition_diagnostics(matches: DataFrame, transitions: DataFrame) -> DataFrame:
    """Adds pred_transition_legal and gt_transition_legal: whether the step from the row before is in the line graph.

    The row before is that of the given rows, so filter first. First rows and steps to the same edge are legal.
    """
    w = Window.partitionBy("trajectory_id").orderBy("t")
    legal = transitions.select("prev_edge_idx", "curr_edge_idx").distinct()
    for side in ("pred", "gt"):
        edge, before = f"{side}_edge_idx", f"_{side}_before"
        matches = matches.withColumn(before, F.lag(edge).over(w))
    for side in ("pred", "gt"):
        edge, before = f"{side}_edge_idx", f"_{side}_before"
        look = legal.select(F.col("prev_edge_idx").alias(before), F.col("curr_edge_idx").alias(edge), F.lit(True).alias("_ok"))
        matches = matches.join(look, [before, edge], "left")
        free = F.col(before).isNull() | (F.col(before) == F.col(edge))
        matches = matches.withColumn(f"{side}_transition_legal", free | F.col("_ok").isNotNull()).drop("_ok")
    return matches.drop("_pred_before", "_gt_before")


def policy_metrics(decisions: DataFrame) -> DataFrame:
    """One row: how often a policy took the true candidate and the true edge, stepped legally, and how far off it was.

    decisions has trajectory_id, t, pred_candidate_pos, gt_candidate_pos (-1 for none), pred_edge_idx, gt_edge_idx (-1 for
    none), transition_legal and projection_error_m. Legality is of steps after a trajectory's first (1 without any); all
    other figures are 0 without rows.
    """
    error, hit = F.col("projection_error_m"), lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    shares = quantiles(decisions, "projection_error_m", [0.5, 0.9]).select(*[F.coalesce(F.get("q", F.lit(i)), F.lit(0.0)).alias(f"{n}_projection_error_m") for i, n in enumerate(("median", "p90"))])
    row = decisions.agg(
        F.count("*").alias("num_points"), F.countDistinct("trajectory_id").alias("num_trajectories"),
        *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in (
            ("point_action_accuracy", hit("pred_candidate_pos", "gt_candidate_pos")), ("point_edge_accuracy", hit("pred_edge_idx", "gt_edge_idx")),
            ("mean_projection_error_m", F.avg(error)), ("within_5m_rate", F.avg((error <= 5).cast("double"))),
        )],
        F.coalesce(F.avg(F.when(F.col("t") > 0, F.col("transition_legal").cast("double"))), F.lit(1.0)).alias("legal_transition_rate"),
    )
    return row.crossJoin(F.broadcast(shares))  # single rows


def point_metrics(judged_rows: DataFrame) -> DataFrame:
    """One row of rates, means and quantiles of all judged points; error rates are of wrong points, 0 if there are none."""
    wrong = ~F.col("edge_correct")
    or_0 = lambda c: F.coalesce(c, F.lit(0.0))
    error = F.col("projection_error_m")
    shares = quantiles(judged_rows, "projection_error_m", [0.5, 0.9]).select(F.get("q", F.lit(0)).alias("median_projection_error_m"), F.get("q", F.lit(1)).alias("p90_projection_error_m"))
    row = judged_rows.agg(
        F.count("*").alias("num_labelled_points"), F.countDistinct("trajectory_id").alias("num_trajectories"), share("edge_correct").alias("point_edge_accuracy"),
        F.avg(error).alias("mean_projection_error_m"),
        *[share(f"within_{r}m").alias(f"within_{r}m_rate") for r in (2, 5, 10)], share("projection_success").alias("projection_success_rate"),
        F.avg(known(F.col("confidence"))).alias("mean_confidence"), F.count_if(wrong).alias("num_error_points"),
        or_0(share("near_but_wrong_edge", wrong)).alias("error_near_but_wrong_edge_rate"), or_0(share("severe_error", wrong)).alias("error_severe_rate"),
        or_0(share("low_confidence", wrong)).alias("low_confidence_error_rate"),
    )
    return row.crossJoin(shares)  # single rows


def quality_metrics(matches: DataFrame, edges: DataFrame, transitions: DataFrame, need_candidate: bool = False, success_at: float = 0.9) -> DataFrame:
    """One row of what point_metrics leaves out: labels, choices, kinds of wrong edges, legality, sequences and confidences.

    Rates of wrong points are 0 without any, those of steps after the first 1. entropy, margin and pred_candidate_pos
    may be missing; their means are null then.
    """
    rows = judged(labelled(matches, need_candidate))
    rows = transition_diagnostics(edge_taxonomy(rows, edges), transitions)
    wrong, later = ~F.col("edge_correct"), F.col("t") > 0
    optional = lambda name: F.avg(known(F.col(name).cast("double"))) if name in matches.columns else F.lit(None).cast("double")
    chosen = (F.col("pred_candidate_pos") == F.col("gt_candidate_pos")) if "pred_candidate_pos" in matches.columns else F.col("edge_correct")
    or_else = lambda c, d: F.coalesce(c, F.lit(d))
    points = rows.agg(
        F.count("*").alias("num_labelled_points"), F.avg(chosen.cast("double")).alias("point_action_accuracy"), optional("entropy").alias("mean_entropy"), optional("margin").alias("mean_margin"),
        *[share(c).alias(f"{c}_accuracy") for c in ("same_osm_way", "same_road_class", "same_undirected_uv")],
        *[or_else(share(f"{side}_transition_legal", later), 1.0).alias(f"{side}_transition_legal_rate") for side in ("pred", "gt")],
        or_else(share("same_osm_way", wrong), 0.0).alias("error_same_way_rate"), or_else(share("reverse_pair", wrong), 0.0).alias("error_reverse_edge_rate"), share("low_confidence").alias("low_confidence_rate"),
    )
    paths = sequence_metrics(rows.select("trajectory_id", "t", "pred_edge_idx", "gt_edge_idx"))
    edits = paths.agg(F.avg("path_edit_distance").alias("path_edit_distance_mean"), F.avg("normalised_edit_distance").alias("normalised_edit_distance_mean"))
    median = quantiles(paths, "path_edit_distance", [0.5]).select(F.get("q", F.lit(0)).alias("path_edit_distance_median"))
    spread = quantiles(rows.select(known(F.col("confidence")).alias("c")), "c", [0.1, 0.5, 0.9]).select(*[F.get("q", F.lit(i)).alias(f"confidence_{n}") for i, n in enumerate(("p10", "median", "p90"))])
    success = rows.groupBy("trajectory_id").agg(share("edge_correct").alias("acc")).agg(F.avg((F.col("acc") >= success_at).cast("double")).alias("trajectory_success_rate"))
    whole = matches.agg(F.count("*").alias("num_points")).crossJoin(points).withColumn("num_unlabelled_points", F.col("num_points") - F.col("num_labelled_points"))
    return whole.crossJoin(edits).crossJoin(median).crossJoin(spread).crossJoin(success)  # single rows


def projection_summary(judged_rows: DataFrame) -> DataFrame:
    """One row: mean, quantiles and maximum of the known projection errors."""
    error = F.col("projection_error_m")
    q = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    row = judged_rows.agg(F.count(error).alias("points"), F.avg(error).alias("mean_m"), F.max(error).alias("max_m"))
    shares = quantiles(judged_rows, "projection_error_m", list(q.values())).select(*[F.get("q", F.lit(i)).alias(f"{k}_m") for i, k in enumerate(q)])
    return row.crossJoin(shares)  # single rows


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of two arrays of ids of any number."""

    @F.pandas_udf("bigint")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p: np.ndarray, q: np.ndarray) -> int:
            row = np.arange(len(q) + 1)
            for i, x in enumerate(p, 1):
                best = np.minimum(row[1:] + 1, row[:-1] + (q != x))
                # An insertion carries the value on from the left: a running minimum of value less place.
                new = np.concatenate([[i], best])
                place = np.arange(len(new))
                row = np.minimum.accumulate(new - place) + place
            return int(row[-1])

        return pd.Series([one(np.asarray(p), np.asarray(q)) for p, q in zip(a, b, strict=True)], dtype="int64")

    return of(left, right)


def sequences(matches: DataFrame, compress: bool = False) -> DataFrame:
    """One row a trajectory: the predicted and true edges as arrays in order, runs of one edge as one if compressed."""
    rows = matches.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("t", "pred_edge_idx", "gt_edge_idx"))).alias("s"))
    out = rows.select("trajectory_id", F.col("s.pred_edge_idx").alias("pred"), F.col("s.gt_edge_idx").alias("gt"))
    if compress:
        first = lambda name: F.filter(F.col(name), lambda x, i: (i == 0) | (x != F.get(F.col(name), i - 1)))
        out = out.select("trajectory_id", first("pred").alias("pred"), first("gt").alias("gt"))
    return out


def sequence_metrics(matches: DataFrame, compress: bool = False) -> DataFrame:
    """Edit distance of each trajectory's edge sequences, plain and over the longer one's length."""
    s = sequences(matches, compress)
    scored = s.withColumn("path_edit_distance", edit_distance(F.col("pred"), F.col("gt")))
    longer = F.greatest(F.size("pred"), F.size("gt"), F.lit(1))
    return scored.select("trajectory_id", F.size("pred").alias("pred_length"), F.size("gt").alias("gt_length"), "path_edit_distance", (F.col("path_edit_distance") / longer).alias("normalised_edit_distance"))


def trajectory_metrics(judged_rows: DataFrame, success_at: float = 0.9) -> DataFrame:
    """Points, accuracy, mean error and success of every trajectory."""
    accuracy = share("edge_correct")
    return judged_rows.groupBy("trajectory_id").agg(
        F.count("*").alias("points"), accuracy.alias("edge_accuracy"), share("within_5m").alias("within_5m_rate"), F.avg("projection_error_m").alias("mean_projection_error_m"),
        F.avg(known(F.col("confidence"))).alias("mean_confidence"), (accuracy >= success_at).alias("success"),
    )


def error_cases(judged_rows: DataFrame, low_confidence: float = 0.5, large_error_m: float = 15.0) -> DataFrame:
    """Rows with a wrong edge (compared as text), a low confidence or a large error, with the three flags."""
    flagged = judged_rows.withColumns({
        "edge_mismatch": _holds(F.col("pred_edge_idx").cast("string") != F.col("gt_edge_idx").cast("string")), "low_confidence": _holds(known(F.col("confidence")) < low_confidence),
        "large_projection_error": _holds(F.col("projection_error_m") > large_error_m),
    })
    return flagged.where(F.col("edge_mismatch") | F.col("low_confidence") | F.col("large_projection_error"))


def most_errors(cases: DataFrame, n: int = 20) -> DataFrame:
    """The n trajectories with most error cases, by id on ties."""
    return cases.groupBy("trajectory_id").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "trajectory_id").limit(n)


def point_weights(matches: DataFrame) -> DataFrame:
    """Adds segment_to_next_m and weight_m: half of the true route's way to both neighbours.

    A single point weighs 1; so do all points of a trajectory with an unknown place or without any way.
    """
    w = Window.partitionBy("trajectory_id").orderBy("t")
    whole = Window.partitionBy("trajectory_id")
    x, y = known(F.col("gt_proj_x")), known(F.col("gt_proj_y"))
    ahead = distance(x, y, F.lead(x).over(w), F.lead(y).over(w))
    out = matches.withColumn("segment_to_next_m", ahead).withColumn("_n", F.count("*").over(whole)).withColumn("_gap", F.max((x.isNull() | y.isNull()).cast("int")).over(whole))
    half = 0.5 * (F.coalesce("segment_to_next_m", F.lit(0.0)) + F.coalesce(F.lag("segment_to_next_m").over(w), F.lit(0.0)))
    out = out.withColumn("_half", half).withColumn("_sum", F.sum("_half").over(whole))
    plain = (F.col("_n") == 1) | (F.col("_gap") == 1) | (F.col("_sum") <= 0)
    return out.withColumn("weight_m", F.when(plain, 1.0).otherwise(F.col("_half"))).drop("_n", "_gap", "_half", "_sum")


def criteria(matches: DataFrame, thresholds_m: tuple[float, ...] = (2, 5, 10)) -> tuple[DataFrame, list[str]]:
    """Adds a boolean for each criterion: the edge, the geometry within each threshold, and either of them."""
    names = ["edge_correct"]
    for m in thresholds_m:
        near = _holds(F.col("projection_error_m") <= m)
        k = threshold_name(m)
        matches = matches.withColumns({f"geometry_correct_{k}m": near, f"combined_correct_{k}m": F.col("edge_correct") | near})
        names += [f"geometry_correct_{k}m", f"combined_correct_{k}m"]
    return matches, names


def criteria_by_trajectory(weighted: DataFrame, names: list[str], success_at: float = 0.9) -> DataFrame:
    """Fraction, weighted fraction and success of every criterion for each trajectory."""
    total = F.sum("weight_m")
    columns = [F.count("*").alias("num_points"), total.alias("route_weight_m")]
    for n in names:
        hit = F.col(n).cast("double")
        part = F.when(total > 0, F.sum(F.col("weight_m") * hit) / total).otherwise(F.avg(hit))
        columns += [F.avg(hit).alias(f"{n}_fraction"), part.alias(f"{n}_weighted_fraction"), (part >= success_at).alias(f"{n}_success")]
    return weighted.groupBy("trajectory_id").agg(*columns)


def criteria_summary(weighted: DataFrame, names: list[str], success_at: float = 0.9) -> DataFrame:
    """One row for each criterion: mean and weighted mean correct fractions, trajectory success rate and route weights."""
    each = weighted.select("trajectory_id", "weight_m", F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(n).cast("double").alias("hit")) for n in names])).alias("c"))
    each = each.select("trajectory_id", "weight_m", "c.criterion", "c.hit")
    total = F.sum("weight_m")
    own = each.groupBy("criterion", "trajectory_id").agg(
        F.count("*").alias("n"), F.avg("hit").alias("fraction"), total.alias("den"), F.sum(F.col("weight_m") * F.col("hit")).alias("num"), F.sum("hit").alias("hits")
    )
    own = own.withColumn("weighted", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("fraction")))
    return own.groupBy("criterion").agg(
        F.sum("n").alias("num_points"), F.count("*").alias("num_trajectories"), F.avg("fraction").alias("mean_correct_fraction"),
        F.when(F.sum("den") > 0, F.sum("num") / F.sum("den")).otherwise(F.sum("hits") / F.sum("n")).alias("weighted_mean_correct_fraction"),
        F.avg("weighted").alias("mean_trajectory_weighted_correct_fraction"), F.avg((F.col("weighted") >= success_at).cast("double")).alias("trajectory_success_rate"),
        F.sum("den").alias("total_route_weight_m"), F.sum("num").alias("correct_route_weight_m"),
    )


def continuity_breaks(matches: DataFrame, transitions: DataFrame, edge: str = "pred_edge_idx") -> DataFrame:
    """Steps of each trajectory between different edges that the line graph doesn't join."""
    w = Window.partitionBy("trajectory_id").orderBy("t")
    steps = matches.select("trajectory_id", F.lag(edge).over(w).alias("prev_edge_idx"), F.col(edge).alias("curr_edge_idx"))
    moved = F.col("prev_edge_idx").isNotNull() & (F.col("prev_edge_idx") != F.col("curr_edge_idx"))
    known_steps = transitions.select("prev_edge_idx", "curr_edge_idx", F.lit(1).alias("ok")).distinct()
    joined = steps.join(known_steps, ["prev_edge_idx", "curr_edge_idx"], "left")
    return joined.groupBy("trajectory_id").agg(F.count_if(moved & F.col("ok").isNull()).alias("breaks"))


def columns_then(parts: Iterator[DataFrame]) -> DataFrame:
    """Union of tables by name; columns that one lacks are null in its rows."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first


def compare_workflows(tables: dict[str, DataFrame], success_at: float = 0.9) -> DataFrame:
    """Point accuracy and success rate of several workflows' judged rows, in one pass."""
    tagged = columns_then(df.withColumn("workflow", F.lit(name)) for name, df in tables.items())
    own = tagged.groupBy("workflow", "trajectory_id").agg(F.count("*").alias("n"), share("edge_correct").alias("acc"), F.sum(F.col("edge_correct").cast("int")).alias("hits"))
    return own.groupBy("workflow").agg(
        F.sum("n").alias("points"), F.count("*").alias("trajectories"), (F.sum("hits") / F.sum("n")).alias("point_edge_accuracy"),
        F.avg("acc").alias("mean_trajectory_accuracy"), F.avg((F.col("acc") >= success_at).cast("double")).alias("trajectory_success_rate"),
    )
