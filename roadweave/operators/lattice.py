"""The lattice between consecutive steps: features of candidates and of pairs of candidates, kept as rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import between, distance
from .trajectory import seconds_between


def steps(candidates: DataFrame) -> DataFrame:
    """Adds step: the position among the trajectory's points that have candidates, so that points without are skipped."""
    w = Window.partitionBy("trajectory_id").orderBy("t")
    return candidates.withColumn("step", (F.dense_rank().over(w) - 1).cast("bigint"))


def emission_features(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Sixteen features of every candidate, keyed (trajectory_id, t, candidate_rank)."""
    col = F.col
    limit = F.coalesce(col("maxspeed"), F.lit(50.0)) / 3.6
    low = lambda c, top: F.least(c, F.lit(top))
    return candidates.select(
        "trajectory_id", "t", "candidate_rank", "edge_idx",
        (low(col("distance_m"), 100.0) / 50).alias("distance_norm"), (F.log1p(F.greatest("distance_m", F.lit(0.0))) / math.log(101)).alias("log_distance_norm"),
        (col("yaw_diff_rad") / math.pi).alias("yaw_diff_norm"), (F.abs("yaw_diff_rad") / math.pi).alias("abs_yaw_diff_norm"), "offset_ratio",
        (low(col("speed_mps"), 50.0) / 30).alias("speed_norm"), F.sin("yaw").alias("sin_yaw"), F.cos("yaw").alias("cos_yaw"),
        F.sin("bearing_rad").alias("sin_segment_bearing"), F.cos("bearing_rad").alias("cos_segment_bearing"),
        (col("candidate_rank") / max(k - 1, 1)).alias("candidate_rank_norm"), (F.abs(col("speed_mps") - limit) / F.greatest(limit, F.lit(1.0))).alias("speed_consistency"),
        col("oneway").cast("double").alias("oneway"), (col("road_class_id") / 20).alias("road_class_id_norm"),
        (F.log1p(F.greatest("length_m", F.lit(0.0))) / math.log(1001)).alias("edge_length_log_norm"),
        F.least(F.greatest(col("speed_mps") / 5, F.lit(0.0)), F.lit(1.0)).alias("yaw_reliability"),
    )


def pairs(candidates: DataFrame) -> DataFrame:
    """All pairs of candidates of consecutive steps: columns p_* and c_*, keyed (trajectory_id, step of c).

    A step has at most k candidates, so this is an equi-join that gives up to k times k rows a step.
    """
    stepped = steps(candidates)
    before = stepped.select("trajectory_id", (F.col("step") + 1).alias("step"), *[F.col(c).alias(f"p_{c}") for c in stepped.columns if c not in ("trajectory_id", "step")])
    after = stepped.select("trajectory_id", "step", *[F.col(c).alias(f"c_{c}") for c in stepped.columns if c not in ("trajectory_id", "step")])
    return before.join(after, ["trajectory_id", "step"])


def transition_features(candidates: DataFrame, transitions: DataFrame, k: int = 10, margin_m: float = 30.0) -> DataFrame:
    """Twenty features of every pair of candidates of consecutive steps."""
    legal = transitions.select(F.col("prev_edge_idx").alias("p_edge_idx"), F.col("curr_edge_idx").alias("c_edge_idx"), F.lit(1).alias("in_graph")).distinct()
    joined = pairs(candidates).join(legal, ["p_edge_idx", "c_edge_idx"], "left")
    col = F.col
    limit = F.coalesce(col("c_maxspeed"), F.lit(50.0)) / 3.6
    raw = seconds_between(col("p_ts"), col("c_ts"))
    base = joined.withColumns({
        "gps": distance(col("p_x"), col("p_y"), col("c_x"), col("c_y")), "dt": F.coalesce(F.when(raw > 0, raw), F.lit(1.0)),
        "same": (col("p_edge_idx") == col("c_edge_idx")).cast("int"), "connected": F.coalesce(col("in_graph"), F.lit(0)), "ms": limit,
    })
    same, linked = col("same") == 1, col("connected") == 1
    route = (
        F.when(same, col("gps")).when(linked, F.greatest(col("gps"), F.least("c_length_m", F.lit(100.0)))).otherwise(F.abs(col("c_length_m") - col("p_length_m")))
    )
    base = base.withColumn("route", route).withColumn("feasible", ((col("route") <= col("ms") * col("dt") + margin_m) | same).cast("int"))
    low = lambda c, top: F.least(c, F.lit(top))
    equal = lambda name: (F.coalesce(col(f"p_{name}") == col(f"c_{name}"), F.lit(False)) & (col(f"c_{name}") != "")).cast("int")
    return base.select(
        "trajectory_id", "step", col("p_candidate_rank").alias("prev_rank"), col("c_candidate_rank").alias("curr_rank"), "p_edge_idx", "c_edge_idx",
        (low(col("gps"), 200.0) / 100).alias("gps_dist_norm"), (low(col("dt"), 60.0) / 10).alias("dt_norm"),
        (low(col("gps") / F.greatest("dt", F.lit(1e-3)), 60.0) / 30).alias("observed_speed_norm"), (low(col("route"), 500.0) / 100).alias("route_dist_norm"),
        (low(F.abs(col("route") - col("gps")), 500.0) / 100).alias("route_minus_gps_norm"), (low(col("route") / F.greatest("gps", F.lit(1.0)), 10.0) / 10).alias("route_gps_ratio_norm"),
        (between(col("p_bearing_rad"), col("c_bearing_rad")) / math.pi).alias("turn_norm"), (between(col("p_yaw"), col("c_yaw")) / math.pi).alias("yaw_change_norm"),
        (F.abs(col("c_speed_mps") - col("ms")) / F.greatest("ms", F.lit(1.0))).alias("speed_consistency"), "connected",
        F.greatest("connected", "same").alias("legal"), col("same").alias("same_edge"), equal("osm_way_id").alias("same_osm_way"), equal("road_class").alias("same_road_class"),
        F.abs(col("c_is_reverse") - col("p_is_reverse")).alias("direction_change"), (F.abs(col("c_candidate_rank") - col("p_candidate_rank")) / max(k - 1, 1)).alias("candidate_rank_delta_norm"),
        (low(col("p_distance_m"), 100.0) / 50).alias("prev_distance_norm"), (low(col("c_distance_m"), 100.0) / 50).alias("curr_distance_norm"),
        (low(F.abs(col("c_distance_m") - col("p_distance_m")), 100.0) / 50).alias("distance_delta_norm"), col("feasible").alias("time_feasible"),
    )


def allowed(features: DataFrame, mode: str = "legal") -> DataFrame:
    """Adds allowed: every pair (all), legal pairs (legal), or legal pairs within reach in the time (speed)."""
    rule = {"all": F.lit(True), "legal": F.col("legal") == 1, "speed": (F.col("legal") == 1) & (F.col("time_feasible") == 1)}[mode]
    return features.withColumn("allowed", rule)


def mask_density(features: DataFrame, k: int = 10) -> DataFrame:
    """One row: the share of allowed pairs in the padded k times k lattice, averaged by trajectory first."""
    own = features.groupBy("trajectory_id").agg(F.count_if("allowed").alias("n"), F.countDistinct("step").alias("steps"))
    return own.agg(F.count("*").alias("trajectories"), F.avg(F.col("n") / (F.col("steps") * k * k)).alias("mask_density"))


def negatives(candidates: DataFrame, n: int = 5, seed: int = 42, hard: bool = False) -> DataFrame:
    """Up to n candidates of every labelled point that aren't its own edge: drawn by a seeded hash, or the best ranked if hard."""
    draw = F.md5(F.concat_ws(":", *[x.cast("string") for x in (F.lit(seed), F.col("trajectory_id"), F.col("t"), F.col("edge_idx"))]))
    w = Window.partitionBy("trajectory_id", "t").orderBy(F.col("candidate_rank") if hard else draw, "edge_idx")
    others = candidates.where("gt_edge_idx >= 0 AND edge_idx <> gt_edge_idx")
    return others.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < n)


def padded_negatives(candidates: DataFrame, n: int = 5, seed: int = 42, hard: bool = False) -> DataFrame:
    """negatives as one array of candidate ranks for each labelled point, -1 in the slots that are left over."""
    drawn = negatives(candidates, n, seed, hard).groupBy("trajectory_id", "t").agg(F.array_sort(F.collect_list(F.struct("slot", "candidate_rank"))).alias("s"))
    points = candidates.where("gt_edge_idx >= 0").select("trajectory_id", "t").distinct().join(drawn, ["trajectory_id", "t"], "left")
    ranks = F.coalesce(F.transform("s", lambda x: x["candidate_rank"].cast("bigint")), F.array().cast("array<bigint>"))
    return points.select("trajectory_id", "t", F.slice(F.concat(ranks, F.array_repeat(F.lit(-1).cast("bigint"), n)), 1, n).alias("negatives"))


def hints(candidates: DataFrame, transitions: DataFrame, k: int = 10, cap_m: float = 50.0) -> DataFrame:
    """What the truth says of every candidate: whether it is the true one, how far its rank and its place are from it,
    whether it is on the same edge, and whether it may follow the true candidate before and lead to the true one after.

    Candidates have gt_edge_idx and the true place (gt_x, gt_y); points without a true candidate have rank distance 1.
    """
    stepped = steps(candidates)
    own = F.min(F.when(F.col("edge_idx") == F.col("gt_edge_idx"), F.col("candidate_rank"))).over(Window.partitionBy("trajectory_id", "t"))
    ranked = stepped.withColumn("gt_rank", own)
    true = ranked.where("candidate_rank = gt_rank").select("trajectory_id", F.col("step").alias("_step"), F.col("edge_idx").alias("_edge"))
    pairs_ = transitions.select(F.col("prev_edge_idx").alias("_p"), F.col("curr_edge_idx").alias("_c"), F.lit(1.0).alias("_ok")).distinct()
    for name, shift in (("before", 1), ("after", -1)):
        side = true.select("trajectory_id", (F.col("_step") + shift).alias("step"), F.col("_edge").alias(f"_{name}"))
        ranked = ranked.join(side, ["trajectory_id", "step"], "left")
        p, c = (f"_{name}", "edge_idx") if shift == 1 else ("edge_idx", f"_{name}")
        legal = pairs_.withColumnsRenamed({"_p": f"_p{name}", "_c": f"_c{name}", "_ok": f"_ok{name}"})
        ranked = ranked.join(legal, (F.col(p) == legal[f"_p{name}"]) & (F.col(c) == legal[f"_c{name}"]), "left")
    reach = lambda name: F.when(F.col(f"_{name}").isNull() | (F.col(f"_{name}") == F.col("edge_idx")), 1.0).otherwise(F.coalesce(f"_ok{name}", F.lit(0.0)))
    far = F.least(distance(F.col("proj_x"), F.col("proj_y"), F.col("gt_x"), F.col("gt_y")), F.lit(cap_m)) / cap_m
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return ranked.select(
        "trajectory_id", "t", "candidate_rank", flag(F.col("candidate_rank") == F.col("gt_rank")).alias("is_true"),
        F.coalesce(F.abs(F.col("candidate_rank") - F.col("gt_rank")) / max(k - 1, 1), F.lit(1.0)).alias("rank_distance"),
        flag(F.col("gt_rank").isNotNull() & (F.col("edge_idx") == F.col("gt_edge_idx"))).alias("same_edge"), reach("before").alias("from_previous"), reach("after").alias("to_next"),
        F.coalesce(far, F.lit(0.0)).alias("place_distance"), F.lit(1.0).alias("valid"),
    )


def observations(features: DataFrame, names: tuple[str, ...], k: int = 10) -> DataFrame:
    """One vector for each step: its candidates' features in order of rank, padded to k, the mask of slots, and the share of the way.

    The previous choice is the caller's to append, as it isn't known before a policy has run.
    """
    by = features.groupBy("trajectory_id", "t").agg(F.array_sort(F.collect_list(F.struct("candidate_rank", F.array(*[F.col(n).cast("double") for n in names]).alias("f")))).alias("c"))
    w = Window.partitionBy("trajectory_id")
    step, last = F.row_number().over(w.orderBy("t")) - 1, F.count("*").over(w) - 1
    many = F.least(F.size("c"), F.lit(k))
    flat = F.flatten(F.transform(F.slice("c", F.lit(1), many), lambda x: x["f"]))
    pad = lambda n: F.array_repeat(F.lit(0.0), n)
    mask = F.concat(F.array_repeat(F.lit(1.0), many), pad(k - many))
    return by.select("trajectory_id", "t", F.concat(flat, pad((k - many) * len(names)), mask, F.array(step / F.greatest(last, F.lit(1)))).alias("observation"))


def raw_transition_features(candidates: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """Thirteen unscaled features of every pair of candidates of consecutive steps, as the library variant has them.

    Legal is what the line graph joins, a candidate's own edge included only if it is in there; without a line graph
    every pair is. Unknown distances and angles count as 0.
    """
    both = pairs(candidates)
    if transitions is None:
        both = both.withColumn("is_connected", F.lit(1.0))
    else:
        legal = transitions.select(F.col("prev_edge_idx").alias("p_edge_idx"), F.col("curr_edge_idx").alias("c_edge_idx"), F.lit(1.0).alias("is_connected")).distinct()
        both = both.join(legal, ["p_edge_idx", "c_edge_idx"], "left").withColumn("is_connected", F.coalesce("is_connected", F.lit(0.0)))
    val = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    rank = {side: val(f"{side}_candidate_rank") for side in ("p", "c")}
    return both.select(
        "trajectory_id", "step", F.col("p_candidate_rank").alias("prev_rank"), F.col("c_candidate_rank").alias("curr_rank"), (F.col("p_edge_idx") == F.col("c_edge_idx")).cast("double").alias("same_edge"),
        "is_connected", F.col("is_connected").alias("is_legal"), rank["p"].alias("prev_candidate_rank"), rank["c"].alias("curr_candidate_rank"), F.abs(rank["p"] - rank["c"]).alias("rank_abs_diff"),
        val("p_distance_m").alias("prev_distance_m"), val("c_distance_m").alias("curr_distance_m"), (val("c_distance_m") - val("p_distance_m")).alias("distance_delta_m"),
        val("p_yaw_diff_rad").alias("prev_yaw_diff_rad"), val("c_yaw_diff_rad").alias("curr_yaw_diff_rad"), (val("c_yaw_diff_rad") - val("p_yaw_diff_rad")).alias("yaw_diff_delta_rad"),
        distance(val("p_proj_x"), val("p_proj_y"), val("c_proj_x"), val("c_proj_y")).alias("projection_distance_m"),
    )
