"""Queries that train the composed road model on the given tables and score with the weights it learned, and that judge
what is decided as a policy's choices are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import distance
from ..operators import metrics, roadmodel, roadnet
from ..sources.shared import settle
from . import views
from .catalog import _FEATURES, _candidates, _decoded, _emissions, _featured, _labelled_candidates, query

_CANDIDATE = ("distance_norm", "abs_yaw_diff_norm", "candidate_rank_norm", "speed_consistency")
_WIDTH, _EPOCHS = 8, 2


def _values(*names: str):
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])


def _data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Roads with their features, pairs that follow each other, candidates, and candidates after a step's true one."""
    roads = settle(roadnet.road_features(_featured(spark, sf_dir)).select("edge_idx", _values(*_FEATURES).alias("x")), "roads")
    pairs = settle(roadnet.transitions(views.road_edges(spark, sf_dir)).select("prev_edge_idx", "curr_edge_idx"), "pairs")
    labels = _labelled_candidates(spark, sf_dir).select("trajectory_id", "t", "candidate_rank", "is_gt")
    rows = _emissions(spark, sf_dir).join(labels, ["trajectory_id", "t", "candidate_rank"])
    candidates = settle(rows.select("trajectory_id", "t", "candidate_rank", "edge_idx", _values(*_CANDIDATE).alias("x"), "is_gt"), "candidates")
    # The step before is the last one with candidates; its true candidate may be missing.
    w = Window.partitionBy("trajectory_id").orderBy("t")
    steps = candidates.groupBy("trajectory_id", "t").agg(F.max(F.when(F.col("is_gt") == 1, F.col("edge_idx"))).alias("true_idx"))
    steps = steps.select("trajectory_id", "t", F.lag("true_idx").over(w).alias("prev_edge_idx")).where("prev_edge_idx IS NOT NULL")
    after = candidates.join(steps, ["trajectory_id", "t"])
    linked = pairs.withColumnRenamed("curr_edge_idx", "edge_idx").distinct().withColumn("linked", F.lit(1.0))
    moves = after.join(linked, ["prev_edge_idx", "edge_idx"], "left").withColumn("x", F.array(F.coalesce("linked", F.lit(0.0)))).drop("linked")
    return roads, pairs, candidates, settle(moves, "moves")


@query()
def road_model_scores(spark, sf_dir):
    """Every candidate's score by the trained model, over its road's embedding and its own features."""
    roads, pairs, candidates, moves = _data(spark, sf_dir)
    start = roadmodel.seeded_model(len(_FEATURES), _WIDTH, len(_CANDIDATE), 1)
    model, _ = roadmodel.train(start, roads, pairs, candidates, moves, epochs=_EPOCHS)
    embeddings, _ = roadmodel.encode(roads, pairs, model)
    return roadmodel.head_scores(candidates, embeddings, model.emission, "edge_idx").select("trajectory_id", "t", "candidate_rank", "edge_idx", "is_gt", "score")


@query("""SELECT count(*) AS num_points, count(DISTINCT trajectory_id) AS num_trajectories, avg(CAST(candidate_rank = gt_pos AS INT)) AS point_action_accuracy, avg(CAST(pred_edge_idx = gt_edge AS INT)) AS point_edge_accuracy,
    coalesce(avg(transition_legal) FILTER (t > 0), 1.0) AS legal_transition_rate, avg(err) AS mean_projection_error_m, quantile_cont(err, 0.5) AS median_projection_error_m, quantile_cont(err, 0.9) AS p90_projection_error_m,
    avg(CAST(err <= 5 AS INT)) AS within_5m_rate FROM (
        SELECT d.*, coalesce(g.r, -1) AS gt_pos, coalesce(g.e, -1) AS gt_edge, sqrt((d.pred_proj_x - p.x) ** 2 + (d.pred_proj_y - p.y) ** 2) AS err FROM decoded d JOIN gt_points p USING (trajectory_id, t)
        LEFT JOIN (SELECT trajectory_id, t, max(candidate_rank) AS r, max(edge_idx) AS e FROM cand_gt WHERE is_gt = 1 GROUP BY ALL) g USING (trajectory_id, t)) x""",
       "point_action_accuracy", "point_edge_accuracy", "legal_transition_rate", "mean_projection_error_m", "median_projection_error_m", "p90_projection_error_m", "within_5m_rate", views_=("decoded", "gt_points", "cand_gt"))
def policy_evaluation(spark, sf_dir):
    """The decoded candidates as decisions, against the true ones."""
    found = settle(_candidates(spark, sf_dir), "candidates")
    true = _labelled_candidates(spark, sf_dir, found=found).where("is_gt = 1").groupBy("trajectory_id", "t").agg(F.max("candidate_rank").alias("gt_candidate_pos"), F.max("edge_idx").alias("gt_edge_idx"))
    places = views.gt_points(spark, sf_dir).select("trajectory_id", "t", F.col("x").alias("_x"), F.col("y").alias("_y"))
    rows = _decoded(spark, sf_dir, found).withColumnRenamed("candidate_rank", "pred_candidate_pos").join(places, ["trajectory_id", "t"]).join(true, ["trajectory_id", "t"], "left")
    error = distance(F.col("pred_proj_x"), F.col("pred_proj_y"), F.col("_x"), F.col("_y"))
    known = {c: F.coalesce(c, F.lit(-1)) for c in ("gt_candidate_pos", "gt_edge_idx")}
    return metrics.policy_metrics(settle(rows.withColumns({**known, "projection_error_m": error}), "decisions"))
