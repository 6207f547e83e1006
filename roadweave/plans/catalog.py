"""Queries over the given tables for the library's own operators, with the SQL that checks them.

Doubles are rounded to six digits on both sides. Candidates and their recall are searched in boxes of 50 metres, ten
for each point; lattices have five, in boxes of 20 metres.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, projection
from ..operators import calibration, decode, lattice, learn, metrics, overlap, roadnet, spatial, trajectory
from ..sources.shared import settle
from ..streaming import windows
from . import views
from .views_sql import with_views, wrap

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
RADIUS, K = 20.0, 5
WIDE_RADIUS, WIDE_K = 50.0, 10


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(sql: str | None = None, *doubles: str, views_: tuple[str, ...] = ()):
    """Registers a query under its function's name, with its SQL and the names of its double columns."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql:
            replaced = ", ".join(f"round({d}, 6) + 0 AS {d}" for d in doubles)
            _SQL[f.__name__] = with_views(f"SELECT * REPLACE ({replaced}) FROM ({sql}) q" if doubles else sql, *views_)
        return f

    return register


# Trajectories


@query("SELECT trajectory_id, t, point_id, dt_prev_s, dt_next_s, step_prev_m, step_next_m, yaw, degrees(yaw) AS yaw_deg, speed_mps FROM kin",
       "dt_prev_s", "dt_next_s", "step_prev_m", "step_next_m", "yaw", "yaw_deg", "speed_mps", views_=("kin",))
def traj_kinematics(spark, sf_dir):
    return trajectory.kinematics(views.points(spark, sf_dir)).drop("ts", "x", "y", "event_type")


@query(f"""SELECT trajectory_id, t, yaw, coalesce({wrap('yaw - lag(yaw) OVER w')}, 0.0) AS yaw_change FROM (
    SELECT trajectory_id, t, {wrap('''CASE WHEN pb IS NULL AND pa IS NULL THEN 0.0 WHEN pa IS NULL OR t - pb <= pa - t THEN yaw_back ELSE yaw_ahead END''')} AS yaw FROM (
        SELECT *, max(CASE WHEN yaw_raw IS NOT NULL THEN t END) OVER (PARTITION BY trajectory_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS pb,
            min(CASE WHEN yaw_raw IS NOT NULL THEN t END) OVER (PARTITION BY trajectory_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pa
        FROM kin_raw) a) b WINDOW w AS (PARTITION BY trajectory_id ORDER BY t)""", "yaw", "yaw_change", views_=("kin_raw",))  # fmt: skip
def traj_yaw_nearest(spark, sf_dir):
    k = trajectory.kinematics(views.points(spark, sf_dir), fill="nearest")
    return trajectory.yaw_changes(k).select("trajectory_id", "t", "yaw", "yaw_change")


@query("""SELECT trajectory_id, t, step_m, sum(step_m) OVER (PARTITION BY trajectory_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum_m FROM (
    SELECT trajectory_id, t, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0) AS step_m FROM trajectory WINDOW w AS (PARTITION BY trajectory_id ORDER BY t)) a""",
       "step_m", "cum_m", views_=("trajectory",))
def traj_path_length(spark, sf_dir):
    return trajectory.path_lengths(views.trajectory(spark, sf_dir)).select("trajectory_id", "t", "step_m", "cum_m")


@query("""SELECT trajectory_id, t, CASE WHEN abs(dx) < 1e-9 AND abs(dy) < 1e-9 THEN 0.0 ELSE coalesce(atan2(dy, dx), 0.0) END AS course FROM (
    SELECT trajectory_id, t, CASE WHEN t = 0 THEN lead(x) OVER w - x ELSE x - lag(x) OVER w END AS dx, CASE WHEN t = 0 THEN lead(y) OVER w - y ELSE y - lag(y) OVER w END AS dy
    FROM trajectory WINDOW w AS (PARTITION BY trajectory_id ORDER BY t)) a""", "course", views_=("trajectory",))  # fmt: skip
def traj_course(spark, sf_dir):
    return trajectory.course_over_ground(views.trajectory(spark, sf_dir)).select("trajectory_id", "t", "course")


@query("""SELECT * FROM (SELECT count(*) AS trajectories, min(n) AS min_points, quantile_cont(n, 0.5) AS median_points, avg(n) AS mean_points, max(n) AS max_points
    FROM (SELECT trajectory_id, count(*) AS n FROM kin GROUP BY 1) a) b, (SELECT count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
    count(*) FILTER (dt_prev_s <= 0) AS stalled, avg(speed_mps) AS mean_speed, quantile_cont(speed_mps, 0.5) AS median_speed, quantile_cont(speed_mps, 0.95) AS p95_speed,
    max(speed_mps) AS max_speed FROM kin) c""", "median_points", "mean_points", "min_x", "max_x", "min_y", "max_y", "mean_speed", "median_speed", "p95_speed", "max_speed", views_=("kin",))  # fmt: skip
def traj_report(spark, sf_dir):
    return trajectory.report(trajectory.kinematics(views.points(spark, sf_dir)))


@query("""SELECT event_type, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY trajectory_id ORDER BY t) AS before FROM trajectory) a
    WHERE before IS NULL OR before <> event_type GROUP BY event_type""", views_=("trajectory",))  # fmt: skip
def traj_without_repeats(spark, sf_dir):
    kept = trajectory.drop_repeats(views.trajectory(spark, sf_dir), "event_type")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN u < 0.7e0 THEN 'train' WHEN u < 0.7e0 + 0.15e0 THEN 'val' ELSE 'test' END AS split, count(*) AS trajectories FROM (
    SELECT DISTINCT trajectory_id, CAST('0x' || substr(md5('42:' || trajectory_id), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM points) a GROUP BY 1""", views_=("points",))  # fmt: skip
def split_hash(spark, sf_dir):
    ids = views.points(spark, sf_dir).select("trajectory_id").distinct()
    return trajectory.split_by_hash(ids).groupBy("split").agg(F.count("*").alias("trajectories"))


# Roads


@query("SELECT edge_idx, edge_id, link_id, osm_way_id, road_class, maxspeed, oneway, is_reverse, direction, u, v, x1, y1, x2, y2, length_m, bearing_rad FROM road_edges",
       "maxspeed", "x1", "y1", "x2", "y2", "length_m", "bearing_rad", views_=("road_edges",))
def road_edges_directed(spark, sf_dir):
    return views.road_edges(spark, sf_dir)


@query("""SELECT edge_idx, (SELECT count(*) FROM road_edges o WHERE o.u = e.u) AS out_degree_u, (SELECT count(*) FROM road_edges o WHERE o.v = e.v) AS in_degree_v,
    (SELECT count(*) FROM road_edges o WHERE o.u = e.v) AS successors, (SELECT count(*) FROM road_edges o WHERE o.v = e.u) AS predecessors FROM road_edges e""", views_=("road_edges",))  # fmt: skip
def road_degrees(spark, sf_dir):
    return roadnet.degrees(views.road_edges(spark, sf_dir)).select("edge_idx", "out_degree_u", "in_degree_v", "successors", "predecessors")


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roadnet.degrees(views.road_edges(spark, sf_dir))
    return e.withColumns({"lanes": F.when(F.col("edge_idx") % 3 == 0, None).otherwise(F.col("edge_idx") % 4).cast("double"), "curvature": F.lit(1.0), "bridge": F.lit(0), "tunnel": F.lit(0)})


_FEATURES = ("length_norm", "sin_bearing", "cos_bearing", "road_class_id_norm", "oneway", "maxspeed_norm", "lanes_norm", "curvature", "in_degree_norm", "out_degree_norm", "bridge", "tunnel")


@query("""SELECT edge_idx, least(length_m, g) / g AS length_norm, sin(bearing_rad) AS sin_bearing, cos(bearing_rad) AS cos_bearing,
    road_class_id / CAST(greatest((SELECT max(road_class_id) FROM classed), 1) AS DOUBLE) AS road_class_id_norm, CAST(oneway AS DOUBLE) AS oneway,
    greatest(least(maxspeed, 160.0), 1.0) / 160 AS maxspeed_norm, greatest(least(coalesce(CASE WHEN edge_idx % 3 = 0 THEN NULL ELSE CAST(edge_idx % 4 AS DOUBLE) END, 1.0), 10.0), 1.0) / 10 AS lanes_norm,
    CAST(0.2 AS DOUBLE) AS curvature, least((SELECT count(*) FROM road_edges o WHERE o.v = e.v), 10) / CAST(10 AS DOUBLE) AS in_degree_norm,
    least((SELECT count(*) FROM road_edges o WHERE o.u = e.u), 10) / CAST(10 AS DOUBLE) AS out_degree_norm, CAST(0 AS DOUBLE) AS bridge, CAST(0 AS DOUBLE) AS tunnel
    FROM classed e, (SELECT greatest(quantile_cont(length_m, 0.95), 1.0) AS g FROM road_edges) p""", *_FEATURES, views_=("classed",))  # fmt: skip
def road_features(spark, sf_dir):
    return roadnet.road_features(_featured(spark, sf_dir))


@query("""SELECT edge_idx, (maxspeed - m) / CASE WHEN s < 1e-8 THEN 1.0 ELSE s END AS maxspeed_z, (length_m - ml) / CASE WHEN sl < 1e-8 THEN 1.0 ELSE sl END AS length_m_z
    FROM road_edges, (SELECT avg(maxspeed) AS m, stddev_pop(maxspeed) AS s, avg(length_m) AS ml, stddev_pop(length_m) AS sl FROM road_edges) a""", "maxspeed_z", "length_m_z", views_=("road_edges",))  # fmt: skip
def road_features_zscore(spark, sf_dir):
    return roadnet.standardise(views.road_edges(spark, sf_dir), "edge_idx", "maxspeed", "length_m")


@query("""SELECT road_class, count(*) AS edges, min(length_m) AS min_m, quantile_cont(length_m, 0.5) AS median_m, avg(length_m) AS mean_m, max(length_m) AS max_m
    FROM road_edges GROUP BY road_class""", "min_m", "median_m", "mean_m", "max_m", views_=("road_edges",))  # fmt: skip
def road_report(spark, sf_dir):
    return roadnet.graph_report(views.road_edges(spark, sf_dir))


@query("SELECT prev_edge_idx, curr_edge_idx, is_self, is_uturn, turn_angle_rad FROM transitions", "turn_angle_rad", views_=("transitions",))
def line_graph_transitions(spark, sf_dir):
    return roadnet.transitions(views.road_edges(spark, sf_dir))


@query(f"""SELECT edge_idx AS prev_edge_idx, edge_idx AS curr_edge_idx, 1 AS is_self, 0 AS is_uturn, 0.0 AS turn_angle_rad FROM road_edges UNION ALL
    SELECT a.edge_idx, b.edge_idx, 0, 0, {wrap('b.bearing_rad - a.bearing_rad')} FROM road_edges a JOIN road_edges b ON a.v = b.u
    WHERE b.v <> a.u AND abs({wrap('b.bearing_rad - a.bearing_rad')}) < radians(160)""", "turn_angle_rad", views_=("road_edges",))  # fmt: skip
def line_graph_angle(spark, sf_dir):
    return roadnet.transitions(views.road_edges(spark, sf_dir), uturn="angle")


@query("""SELECT node, x, y FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY edge_idx, x, y) AS r FROM (
    SELECT u AS node, x1 AS x, y1 AS y, edge_idx FROM road_edges UNION ALL SELECT v, x2, y2, edge_idx FROM road_edges) a) b WHERE r = 1""", "x", "y", views_=("road_edges",))  # fmt: skip
def node_table(spark, sf_dir):
    return roadnet.node_table(views.road_edges(spark, sf_dir))


@query("""SELECT osm_way_id, min(edge_idx) AS edge_idx FROM road_edges GROUP BY osm_way_id""", views_=("road_edges",))
def dedup_edges(spark, sf_dir):
    return roadnet.dedup_edges(views.road_edges(spark, sf_dir), "osm_way_id").select("osm_way_id", "edge_idx")


@query("SELECT edge_idx FROM road_edges WHERE greatest(x1, x2) >= 60 AND least(x1, x2) <= 190 AND greatest(y1, y2) >= 60 AND least(y1, y2) <= 190", views_=("road_edges",))
def cropped_edges(spark, sf_dir):
    return spatial.crop(views.road_edges(spark, sf_dir), 110, 110, 140, 140, 50).select("edge_idx")


@query("SELECT curr_edge_idx, avg(e.maxspeed) AS maxspeed_mean, avg(e.length_m) AS length_m_mean FROM transitions t JOIN road_edges e ON e.edge_idx = t.prev_edge_idx GROUP BY curr_edge_idx",
       "maxspeed_mean", "length_m_mean", views_=("transitions",))
def sage_layer(spark, sf_dir):
    e = views.road_edges(spark, sf_dir)
    return roadnet.neighbour_mean(e, roadnet.transitions(e), "edge_idx", "maxspeed", "length_m")


# Candidates


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.candidates(views.moving(spark, sf_dir), views.classed_edges(spark, sf_dir), RADIUS, K)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_edge(views.gt_points(spark, sf_dir), views.road_edges(spark, sf_dir))


def _wide_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.candidates(views.moving(spark, sf_dir), views.classed_edges(spark, sf_dir), WIDE_RADIUS, WIDE_K)


def _labelled_candidates(spark: SparkSession, sf_dir: str, wide: bool = False, found: DataFrame | None = None) -> DataFrame:
    c = ((_wide_candidates if wide else _candidates)(spark, sf_dir) if found is None else found).join(_truth(spark, sf_dir), ["trajectory_id", "t"])
    return c.withColumn("is_gt", F.coalesce((F.col("edge_idx") == F.col("gt_edge_idx")).cast("int"), F.lit(0)))


_MEASURES = ("distance_m", "yaw_diff_rad", "proj_x", "proj_y", "offset_m", "offset_ratio", "speed_consistency")


@query(f"SELECT trajectory_id, t, candidate_rank, edge_idx, {', '.join(_MEASURES)} FROM wide_cand", *_MEASURES, views_=("wide_cand",))
def candidates_topk(spark, sf_dir):
    return _wide_candidates(spark, sf_dir).select("trajectory_id", "t", "candidate_rank", "edge_idx", *_MEASURES)


@query(f"SELECT trajectory_id, t, candidate_rank, edge_idx, {', '.join(_MEASURES)} FROM cand", *_MEASURES, views_=("cand",))
def candidates_retried(spark, sf_dir):
    """In small boxes, where many points find no road before the box is doubled."""
    return _candidates(spark, sf_dir).select("trajectory_id", "t", "candidate_rank", "edge_idx", *_MEASURES)


@query("SELECT trajectory_id, t, gt_edge_idx, gt_edge_dist_m FROM gt_near", "gt_edge_dist_m", views_=("gt_near",))
def gt_nearest_edge(spark, sf_dir):
    return _truth(spark, sf_dir)


_RECALL = ", ".join(f"count(*) FILTER (r < {k}) / CAST(count(*) AS DOUBLE) AS recall_at_{k}" for k in (1, 3, 5, 10))
_RECALLS = tuple(f"recall_at_{k}" for k in (1, 3, 5, 10))


@query(f"""SELECT count(*) AS points, {_RECALL} FROM gt_near g LEFT JOIN (SELECT trajectory_id, t, min(candidate_rank) AS r FROM wide_gt WHERE is_gt = 1 GROUP BY ALL) c
    USING (trajectory_id, t) WHERE g.gt_edge_idx IS NOT NULL""", *_RECALLS, views_=("wide_gt",))  # fmt: skip
def candidate_recall(spark, sf_dir):
    return spatial.recall_at(_labelled_candidates(spark, sf_dir, True), _truth(spark, sf_dir).where("gt_edge_idx IS NOT NULL"))


@query(f"""SELECT count(*) AS points, {_RECALL} FROM gt_near g LEFT JOIN (SELECT trajectory_id, t, min(candidate_rank) AS r FROM wide_gt WHERE is_gt = 1 GROUP BY ALL) c
    USING (trajectory_id, t)""", *_RECALLS, views_=("wide_gt",))  # fmt: skip
def candidate_recall_all_points(spark, sf_dir):
    return spatial.recall_at(_labelled_candidates(spark, sf_dir, True), _truth(spark, sf_dir))


@query("""SELECT trajectory_id, count(*) AS points, avg(CAST(coalesce(hit, 0) AS DOUBLE)) AS recall FROM gt_near LEFT JOIN (
    SELECT trajectory_id, t, max(is_gt) AS hit FROM cand_gt GROUP BY ALL) c USING (trajectory_id, t) GROUP BY trajectory_id ORDER BY recall, trajectory_id LIMIT 20""", "recall", views_=("cand_gt",))  # fmt: skip
def candidate_recall_by_traj(spark, sf_dir):
    return spatial.recall_by_trajectory(_labelled_candidates(spark, sf_dir), _truth(spark, sf_dir))


@query("""SELECT * FROM (SELECT trajectory_id, t, edge_idx, row_number() OVER (PARTITION BY trajectory_id, t ORDER BY md5('42:' || trajectory_id || ':' || t || ':' || edge_idx), edge_idx) - 1 AS slot
    FROM cand_gt WHERE gt_edge_idx >= 0 AND edge_idx <> gt_edge_idx) a WHERE slot < 3""", views_=("cand_gt",))  # fmt: skip
def candidate_negatives(spark, sf_dir):
    return lattice.negatives(_labelled_candidates(spark, sf_dir), 3).select("trajectory_id", "t", "edge_idx", "slot")


@query("""SELECT l.trajectory_id, l.t, n.y AS y_near FROM even_points l LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY trajectory_id, t ORDER BY gap, sec, y) AS k FROM (
        SELECT l.trajectory_id, l.t, r.sec, r.y, abs(r.sec - l.sec) AS gap FROM even_points l JOIN odd_points r ON r.trajectory_id = l.trajectory_id WHERE abs(r.sec - l.sec) <= 259200) a) n
    ON n.trajectory_id = l.trajectory_id AND n.t = l.t AND n.k = 1""", "y_near", views_=("even_points", "odd_points"))  # fmt: skip
def asof_nearest(spark, sf_dir):
    t = views.trajectory(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = t.where("t % 2 = 0").select("trajectory_id", "t", "at")
    right = t.where("t % 2 = 1").select("trajectory_id", "at", F.col("y").alias("y_near"))
    return spatial.asof_nearest(left, right, "trajectory_id", "at", "y_near", 259200.0).select("trajectory_id", "t", "y_near")


# Lattice and decoding


def _emissions(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    return lattice.emission_features(_candidates(spark, sf_dir) if found is None else found, K)


def _transitions(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Pairs of candidates; these are written first, as a step's meet those before and those after them."""
    legal = roadnet.transitions(views.road_edges(spark, sf_dir))
    return lattice.allowed(lattice.transition_features(settle(_candidates(spark, sf_dir), "candidates") if found is None else found, legal, K))


def _lattice(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """The lattice of candidates that are found once and written."""
    found = settle(_candidates(spark, sf_dir), "candidates") if found is None else found
    return decode.collect_lattice(decode.emission_scores(_emissions(spark, sf_dir, found), k=K), decode.transition_scores(_transitions(spark, sf_dir, found)))


_EM = ("distance_norm", "log_distance_norm", "yaw_diff_norm", "abs_yaw_diff_norm", "offset_ratio", "speed_norm", "sin_yaw", "cos_yaw", "sin_segment_bearing", "cos_segment_bearing",
       "candidate_rank_norm", "speed_consistency", "oneway", "road_class_id_norm", "edge_length_log_norm", "yaw_reliability")
_TR = ("gps_dist_norm", "dt_norm", "observed_speed_norm", "route_dist_norm", "route_minus_gps_norm", "route_gps_ratio_norm", "turn_norm", "yaw_change_norm", "speed_consistency",
       "candidate_rank_delta_norm", "prev_distance_norm", "curr_distance_norm", "distance_delta_norm")


@query("SELECT * FROM em", *_EM, views_=("em",))
def lattice_emission(spark, sf_dir):
    return _emissions(spark, sf_dir)


@query("SELECT * FROM tr", *_TR, views_=("tr",))
def lattice_transition(spark, sf_dir):
    return _transitions(spark, sf_dir).drop("allowed")


@query("""SELECT count(*) AS trajectories, avg(n / CAST(steps * 25 AS DOUBLE)) AS mask_density FROM (
    SELECT trajectory_id, count(*) FILTER (legal = 1) AS n, count(DISTINCT step) AS steps FROM tr GROUP BY trajectory_id) a""", "mask_density", views_=("tr",))  # fmt: skip
def transition_mask_density(spark, sf_dir):
    return lattice.mask_density(_transitions(spark, sf_dir), K)


@query("SELECT trajectory_id, t, candidate_rank, sigma, emission FROM es", "sigma", "emission", views_=("es",))
def hmm_emission(spark, sf_dir):
    return decode.emission_scores(_emissions(spark, sf_dir), k=K).select("trajectory_id", "t", "candidate_rank", "sigma", "emission")


@query("SELECT trajectory_id, step, prev_rank, curr_rank, transition FROM ts", "transition", views_=("ts",))
def hmm_transition(spark, sf_dir):
    return decode.transition_scores(_transitions(spark, sf_dir)).select("trajectory_id", "step", "prev_rank", "curr_rank", "transition")


@query("SELECT trajectory_id, max(total_score) AS total_score FROM vit GROUP BY 1", "total_score", views_=("vit",))
def viterbi_score(spark, sf_dir):
    return decode.viterbi(_lattice(spark, sf_dir), K).groupBy("trajectory_id").agg(F.max("total_score").alias("total_score"))


@query("SELECT trajectory_id, t, step, candidate_rank, path_score, total_score FROM vit", "path_score", "total_score", views_=("vit",))
def viterbi_path(spark, sf_dir):
    return decode.viterbi(_lattice(spark, sf_dir), K)


@query("""SELECT trajectory_id, t, step, c AS candidate_rank, score AS path_score, 1 / sum_ AS confidence FROM (
    SELECT d.*, e.t, row_number() OVER (PARTITION BY d.trajectory_id, d.step ORDER BY d.score DESC, d.c) AS r, sum(exp(d.score - top)) OVER (PARTITION BY d.trajectory_id, d.step) AS sum_
    FROM (SELECT *, max(score) OVER (PARTITION BY trajectory_id, step) AS top FROM lag_dp) d JOIN vit_e e USING (trajectory_id, step, c)) x WHERE r = 1""", "path_score", "confidence", views_=("lag_dp",))  # fmt: skip
def viterbi_fixed_lag(spark, sf_dir):
    return decode.decode(_lattice(spark, sf_dir), mode="fixed_lag", lag=5, k=K).select("trajectory_id", "t", "step", "candidate_rank", "path_score", "confidence")


@query("""SELECT v.trajectory_id, v.t, v.step, v.candidate_rank, p.p AS confidence, h.entropy, v.emission, v.path_score FROM vit v JOIN vit_post p ON p.trajectory_id = v.trajectory_id AND p.step = v.step AND p.c = v.candidate_rank
    JOIN (SELECT trajectory_id, step, -sum(p * ln(greatest(p, 1e-12))) AS entropy FROM vit_post GROUP BY ALL) h ON h.trajectory_id = v.trajectory_id AND h.step = v.step""",
       "confidence", "entropy", "emission", "path_score", views_=("vit", "vit_post"))
def posterior_conf(spark, sf_dir):
    return decode.decode(_lattice(spark, sf_dir), k=K).select("trajectory_id", "t", "step", "candidate_rank", "confidence", "entropy", "emission", "path_score")


@query()
def viterbi_beam_offroad(spark, sf_dir):
    return decode.decode(_lattice(spark, sf_dir), confidence="softmax", beam=3, offroad=decode.Params(), k=K)


@query("""SELECT trajectory_id, t, candidate_rank, w / sum(w) OVER (PARTITION BY trajectory_id, t) AS confidence FROM (
    SELECT *, exp(emission - max(emission) OVER (PARTITION BY trajectory_id, t)) AS w FROM es) a""", "confidence", views_=("es",))  # fmt: skip
def softmax_confidence(spark, sf_dir):
    return decode.softmax_confidence(decode.emission_scores(_emissions(spark, sf_dir), k=K)).select("trajectory_id", "t", "candidate_rank", "confidence")


@query("SELECT trajectory_id, t, candidate_rank, pred_edge_idx, pred_proj_x, pred_proj_y, path_score, transition_legal FROM decoded", "pred_proj_x", "pred_proj_y", "path_score", views_=("decoded",))
def match_table(spark, sf_dir):
    return _decoded(spark, sf_dir).select("trajectory_id", "t", "candidate_rank", "pred_edge_idx", "pred_proj_x", "pred_proj_y", "path_score", "transition_legal")


def _decoded(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    legal = roadnet.transitions(views.road_edges(spark, sf_dir))
    found = settle(_candidates(spark, sf_dir), "candidates") if found is None else found
    return decode.match_table(decode.viterbi(_lattice(spark, sf_dir, found), K), found, legal)


@query("""SELECT count(*) AS points, count(DISTINCT trajectory_id) AS trajectories, avg(CAST(pred_edge_idx = gt_edge_idx AS INT)) AS point_edge_accuracy, avg(sqrt((pred_proj_x - x) ** 2 + (pred_proj_y - y) ** 2)) AS mean_error_m,
    avg(CAST(transition_legal AS DOUBLE)) AS legal_rate FROM decoded JOIN gt_near USING (trajectory_id, t) JOIN gt_points USING (trajectory_id, t) WHERE gt_edge_idx IS NOT NULL""",
       "point_edge_accuracy", "mean_error_m", "legal_rate", views_=("decoded", "gt_near"))
def decoded_metrics(spark, sf_dir):
    """Accuracy of the decoded matches against the edges nearest to the true places."""
    truth = _truth(spark, sf_dir).join(views.gt_points(spark, sf_dir).select("trajectory_id", "t", F.col("x").alias("gt_proj_x"), F.col("y").alias("gt_proj_y")), ["trajectory_id", "t"])
    rows = metrics.labelled(metrics.join_truth(_decoded(spark, sf_dir), truth)).withColumn("gt_candidate_pos", F.lit(0)).withColumn("confidence", F.lit(None).cast("double"))
    j = metrics.judged(rows)
    return j.agg(F.count("*").alias("points"), F.countDistinct("trajectory_id").alias("trajectories"), F.avg(F.col("edge_correct").cast("double")).alias("point_edge_accuracy"), F.avg("projection_error_m").alias("mean_error_m"), F.avg(F.col("transition_legal").cast("double")).alias("legal_rate"))


# Evaluation


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judged(metrics.labelled(views.matches(spark, sf_dir)))


@query("""SELECT count(*) AS num_labelled_points, count(DISTINCT trajectory_id) AS num_trajectories, avg(CAST(edge_correct AS INT)) AS point_edge_accuracy,
    avg(projection_error_m) AS mean_projection_error_m, quantile_cont(projection_error_m, 0.5) AS median_projection_error_m, quantile_cont(projection_error_m, 0.9) AS p90_projection_error_m,
    avg(CAST(within_2m AS INT)) AS within_2m_rate, avg(CAST(within_5m AS INT)) AS within_5m_rate, avg(CAST(within_10m AS INT)) AS within_10m_rate, avg(CAST(within_10m AS INT)) AS projection_success_rate,
    avg(confidence) AS mean_confidence, count(*) FILTER (NOT edge_correct) AS num_error_points, coalesce(avg(CAST(within_5m AS INT)) FILTER (NOT edge_correct), 0) AS error_near_but_wrong_edge_rate,
    coalesce(avg(CAST(NOT within_10m AS INT)) FILTER (NOT edge_correct), 0) AS error_severe_rate, coalesce(avg(CAST(low_confidence AS INT)) FILTER (NOT edge_correct), 0) AS low_confidence_error_rate FROM jud""",
       "point_edge_accuracy", "mean_projection_error_m", "median_projection_error_m", "p90_projection_error_m", "within_2m_rate", "within_5m_rate", "within_10m_rate", "projection_success_rate",
       "mean_confidence", "error_near_but_wrong_edge_rate", "error_severe_rate", "low_confidence_error_rate", views_=("jud",))
def point_metrics(spark, sf_dir):
    return metrics.point_metrics(_judged(spark, sf_dir))


@query("""SELECT trajectory_id, count(*) AS points, avg(CAST(edge_correct AS INT)) AS edge_accuracy, avg(CAST(within_5m AS INT)) AS within_5m_rate, avg(projection_error_m) AS mean_projection_error_m,
    avg(confidence) AS mean_confidence, avg(CAST(edge_correct AS INT)) >= 0.9 AS success FROM jud GROUP BY trajectory_id""",
       "edge_accuracy", "within_5m_rate", "mean_projection_error_m", "mean_confidence", views_=("jud",))
def traj_metrics(spark, sf_dir):
    return metrics.trajectory_metrics(_judged(spark, sf_dir))


@query("""SELECT count(projection_error_m) AS points, avg(projection_error_m) AS mean_m, quantile_cont(projection_error_m, 0.5) AS median_m, quantile_cont(projection_error_m, 0.9) AS p90_m,
    quantile_cont(projection_error_m, 0.95) AS p95_m, quantile_cont(projection_error_m, 0.99) AS p99_m, max(projection_error_m) AS max_m FROM jud""",
       "mean_m", "median_m", "p90_m", "p95_m", "p99_m", "max_m", views_=("jud",))
def projection_summary(spark, sf_dir):
    return metrics.projection_summary(_judged(spark, sf_dir))


@query("""SELECT l.trajectory_id, l.t, coalesce(p.osm_way_id = g.osm_way_id, false) AS same_osm_way, coalesce(p.road_class = g.road_class, false) AS same_road_class,
    coalesce(p.u = g.v AND p.v = g.u, false) AS reverse_pair, coalesce((p.u = g.v AND p.v = g.u) OR (p.u = g.u AND p.v = g.v), false) AS same_undirected_uv
    FROM lab l LEFT JOIN road_edges p ON p.edge_idx = l.pred_edge_idx LEFT JOIN road_edges g ON g.edge_idx = l.gt_edge_idx""", views_=("lab", "road_edges"))  # fmt: skip
def edge_taxonomy(spark, sf_dir):
    out = metrics.edge_taxonomy(_judged(spark, sf_dir), views.road_edges(spark, sf_dir))
    return out.select("trajectory_id", "t", "same_osm_way", "same_road_class", "reverse_pair", "same_undirected_uv")


@query("""SELECT s.trajectory_id, s.t, pb IS NULL OR pb = pred_edge_idx OR p.prev_edge_idx IS NOT NULL AS pred_transition_legal, gb IS NULL OR gb = gt_edge_idx OR g.prev_edge_idx IS NOT NULL AS gt_transition_legal
    FROM (SELECT *, lag(pred_edge_idx) OVER w AS pb, lag(gt_edge_idx) OVER w AS gb FROM lab WINDOW w AS (PARTITION BY trajectory_id ORDER BY t)) s
    LEFT JOIN transitions p ON p.prev_edge_idx = pb AND p.curr_edge_idx = pred_edge_idx LEFT JOIN transitions g ON g.prev_edge_idx = gb AND g.curr_edge_idx = gt_edge_idx""", views_=("lab", "transitions"))  # fmt: skip
def transition_diagnostics(spark, sf_dir):
    out = metrics.transition_diagnostics(_judged(spark, sf_dir), roadnet.transitions(views.road_edges(spark, sf_dir)))
    return out.select("trajectory_id", "t", "pred_transition_legal", "gt_transition_legal")


@query("""SELECT trajectory_id, count(*) FILTER (b IS NOT NULL AND b <> pred_edge_idx AND p.prev_edge_idx IS NULL) AS breaks FROM (
    SELECT *, lag(pred_edge_idx) OVER (PARTITION BY trajectory_id ORDER BY t) AS b FROM matches) s LEFT JOIN transitions p ON p.prev_edge_idx = b AND p.curr_edge_idx = pred_edge_idx
    GROUP BY trajectory_id""", views_=("matches", "transitions"))  # fmt: skip
def continuity_breaks(spark, sf_dir):
    return metrics.continuity_breaks(views.matches(spark, sf_dir), roadnet.transitions(views.road_edges(spark, sf_dir)))


@query("""SELECT trajectory_id, t, NOT edge_correct AS edge_mismatch, confidence < 0.5 AS low_confidence, coalesce(projection_error_m > 15, false) AS large_projection_error
    FROM jud WHERE NOT edge_correct OR confidence < 0.5 OR coalesce(projection_error_m > 15, false)""", views_=("jud",))  # fmt: skip
def error_cases(spark, sf_dir):
    return metrics.error_cases(_judged(spark, sf_dir)).select("trajectory_id", "t", "edge_mismatch", "low_confidence", "large_projection_error")


@query("""SELECT trajectory_id, count(*) AS errors FROM jud WHERE NOT edge_correct OR confidence < 0.5 OR coalesce(projection_error_m > 15, false)
    GROUP BY trajectory_id ORDER BY errors DESC, trajectory_id LIMIT 20""", views_=("jud",))  # fmt: skip
def top_error_trajectories(spark, sf_dir):
    return metrics.most_errors(metrics.error_cases(_judged(spark, sf_dir)))


@query("""SELECT trajectory_id, CAST(count(*) AS INT) AS pred_length, CAST(count(*) AS INT) AS gt_length,
    levenshtein(string_agg(chr(CAST(27 + pred_edge_idx AS INT)), '' ORDER BY t), string_agg(chr(CAST(27 + gt_edge_idx AS INT)), '' ORDER BY t)) AS path_edit_distance,
    levenshtein(string_agg(chr(CAST(27 + pred_edge_idx AS INT)), '' ORDER BY t), string_agg(chr(CAST(27 + gt_edge_idx AS INT)), '' ORDER BY t)) / CAST(count(*) AS DOUBLE) AS normalised_edit_distance
    FROM lab GROUP BY trajectory_id""", "normalised_edit_distance", views_=("lab",))  # fmt: skip
def path_edit_distance(spark, sf_dir):
    return metrics.sequence_metrics(metrics.labelled(views.matches(spark, sf_dir)))


@query("SELECT trajectory_id, t, seg AS segment_to_next_m, weight_m FROM wt", "segment_to_next_m", "weight_m", views_=("wt",))
def mm2_point_weights(spark, sf_dir):
    return metrics.point_weights(_judged(spark, sf_dir)).select("trajectory_id", "t", "segment_to_next_m", "weight_m")


_HIT = {"edge_correct": "edge_correct"} | {f"{a}_correct_{m}m": (f"within_{m}m" if a == "geometry" else f"(edge_correct OR within_{m}m)") for m in (2, 5, 10) for a in ("geometry", "combined")}
_EACH = " UNION ALL ".join(f"SELECT '{n}' AS criterion, trajectory_id, weight_m, CAST({x} AS DOUBLE) AS hit FROM wt" for n, x in _HIT.items())
_SUMMARY = ("mean_correct_fraction", "weighted_mean_correct_fraction", "mean_trajectory_weighted_correct_fraction", "trajectory_success_rate", "total_route_weight_m", "correct_route_weight_m")


@query(f"""SELECT criterion, CAST(sum(n) AS BIGINT) AS num_points, count(*) AS num_trajectories, avg(fraction) AS mean_correct_fraction, sum(num) / sum(den) AS weighted_mean_correct_fraction,
    avg(num / den) AS mean_trajectory_weighted_correct_fraction, avg(CAST(num / den >= 0.9 AS INT)) AS trajectory_success_rate, sum(den) AS total_route_weight_m, sum(num) AS correct_route_weight_m
    FROM (SELECT criterion, trajectory_id, count(*) AS n, avg(hit) AS fraction, sum(weight_m) AS den, sum(weight_m * hit) AS num FROM ({_EACH}) e GROUP BY ALL) o GROUP BY criterion""", *_SUMMARY, views_=("wt",))  # fmt: skip
def mm2_criteria(spark, sf_dir):
    marked, names = metrics.criteria(metrics.point_weights(_judged(spark, sf_dir)))
    return metrics.criteria_summary(marked, names)


@query("""SELECT trajectory_id, count(*) AS num_points, sum(weight_m) AS route_weight_m, avg(CAST(edge_correct AS INT)) AS edge_correct_fraction,
    sum(weight_m * CAST(edge_correct AS INT)) / sum(weight_m) AS edge_correct_weighted_fraction, sum(weight_m * CAST(edge_correct AS INT)) / sum(weight_m) >= 0.9 AS edge_correct_success FROM wt GROUP BY trajectory_id""",
       "route_weight_m", "edge_correct_fraction", "edge_correct_weighted_fraction", views_=("wt",))
def mm2_by_trajectory(spark, sf_dir):
    return metrics.criteria_by_trajectory(metrics.point_weights(_judged(spark, sf_dir)), ["edge_correct"])


@query("""SELECT workflow, CAST(sum(n) AS BIGINT) AS points, count(*) AS trajectories, sum(hits) / CAST(sum(n) AS DOUBLE) AS point_edge_accuracy, avg(acc) AS mean_trajectory_accuracy,
    avg(CAST(acc >= 0.9 AS INT)) AS trajectory_success_rate FROM (
    SELECT workflow, trajectory_id, count(*) AS n, sum(CAST(edge_correct AS INT)) AS hits, avg(CAST(edge_correct AS INT)) AS acc FROM (
        SELECT 'all labelled' AS workflow, * FROM jud UNION ALL SELECT 'true candidate', * FROM jud WHERE gt_candidate_pos >= 0) a GROUP BY ALL) b GROUP BY workflow""",
       "point_edge_accuracy", "mean_trajectory_accuracy", "trajectory_success_rate", views_=("jud",))
def workflow_compare(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    return metrics.compare_workflows({"all labelled": metrics.judged(metrics.labelled(m)), "true candidate": metrics.judged(metrics.labelled(m, True))})


@query("""SELECT sum(n * abs(conf - acc)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS points FROM (
    SELECT greatest(ceil(confidence * 10), 1) AS bin, count(*) AS n, avg(confidence) AS conf, avg(CAST(edge_correct AS INT)) AS acc FROM jud GROUP BY 1) a""", "ece", views_=("jud",))  # fmt: skip
def confidence_ece(spark, sf_dir):
    return calibration.expected_calibration_error(_judged(spark, sf_dir))


@query("""SELECT CAST(bin AS INT) AS bin, e[bin + 1] AS lo, e[bin + 2] AS hi, count(*) AS count, avg(confidence) AS mean_value, avg(CAST(edge_correct AS INT)) AS accuracy FROM (
    SELECT *, greatest(len([x for x in e[1:10] if x < confidence]) - 1, 0) AS bin FROM jud,
        (SELECT [quantile_cont(confidence, 0.0), quantile_cont(confidence, 0.1), quantile_cont(confidence, 0.2), quantile_cont(confidence, 0.3), quantile_cont(confidence, 0.4), quantile_cont(confidence, 0.5),
            quantile_cont(confidence, 0.6), quantile_cont(confidence, 0.7), quantile_cont(confidence, 0.8), quantile_cont(confidence, 0.9), quantile_cont(confidence, 1.0)] AS e FROM jud) q) a GROUP BY bin, e""",
       "lo", "hi", "mean_value", "accuracy", views_=("jud",))
def confidence_bins(spark, sf_dir):
    return calibration.quantile_bins(_judged(spark, sf_dir))


@query("""SELECT target_precision, th AS threshold, good / CAST(kept AS DOUBLE) AS precision, kept / CAST(all_ AS DOUBLE) AS coverage, CAST(kept AS BIGINT) AS kept_points FROM (
    SELECT *, row_number() OVER (PARTITION BY target_precision ORDER BY kept DESC) AS r FROM (
        SELECT th, sum(n) OVER (ORDER BY th DESC) AS kept, sum(hits) OVER (ORDER BY th DESC) AS good, sum(n) OVER () AS all_ FROM (
            SELECT round(confidence, 2) AS th, count(*) AS n, sum(CAST(edge_correct AS INT)) AS hits FROM jud GROUP BY 1) a) b,
        (SELECT unnest([CAST(0.6 AS DOUBLE), 0.7, 0.8, 0.9]) AS target_precision) t WHERE good / CAST(kept AS DOUBLE) >= target_precision) c WHERE r = 1""",
       "target_precision", "threshold", "precision", "coverage", views_=("jud",))
def threshold_coverage(spark, sf_dir):
    return calibration.threshold_coverage(_judged(spark, sf_dir))


@query()
def route_overlap(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    pred = overlap.route_from_points(m, "pred_proj_x", "pred_proj_y", "trajectory_id")
    true = overlap.route_from_points(m, "gt_proj_x", "gt_proj_y", "trajectory_id")
    return overlap.route_overlap(pred, true, 5.0, "trajectory_id")


# Learning


@query("""SELECT CAST(v.trajectory_id % 4 AS INT) AS trial, count(*) AS points, avg(CAST(v.candidate_rank = g.r AS INT)) AS accuracy,
    CASE CAST(v.trajectory_id % 4 AS INT) WHEN 0 THEN 'distance_weight=1; transition_scale=0.35' WHEN 1 THEN 'distance_weight=1; transition_scale=1' WHEN 2 THEN 'distance_weight=3; transition_scale=0.35'
    ELSE 'distance_weight=3; transition_scale=1' END AS parameters FROM grid_vit v JOIN (SELECT trajectory_id, t, max(candidate_rank) FILTER (is_gt = 1) AS r FROM cand_gt GROUP BY ALL) g
    ON g.trajectory_id = v.trajectory_id // 4 AND g.t = v.t WHERE g.r >= 0 GROUP BY ALL""", "accuracy", views_=("grid_vit", "cand_gt"))  # fmt: skip
def hmm_grid_search(spark, sf_dir):
    found = settle(_candidates(spark, sf_dir), "candidates")
    c = _labelled_candidates(spark, sf_dir, found=found)
    truth = c.groupBy("trajectory_id", "t").agg(F.coalesce(F.max(F.when(F.col("is_gt") == 1, F.col("candidate_rank"))), F.lit(-1)).alias("gt_rank"))
    return learn.grid_search(_emissions(spark, sf_dir, found), _transitions(spark, sf_dir, found), truth, {"distance_weight": [1.0, 3.0], "transition_scale": [0.35, 1.0]}, k=K)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.transition_diagnostics(_judged(spark, sf_dir), roadnet.transitions(views.road_edges(spark, sf_dir)))
    return d.select("trajectory_id", "t", "edge_correct", F.col("pred_transition_legal").alias("transition_legal"), "projection_error_m", (F.col("gt_candidate_pos") >= 0).alias("is_valid"))


_STEP_SQL = """SELECT s.trajectory_id, s.t, CASE WHEN gt_candidate_pos < 0 THEN CAST(-2.0 AS DOUBLE) ELSE CASE WHEN edge_correct THEN 1.0 ELSE -1.0 END
    + CASE WHEN pb IS NULL OR pb = pred_edge_idx OR p.prev_edge_idx IS NOT NULL THEN 0.2 ELSE -0.2 END - 0.02 * least(coalesce(projection_error_m, 0), 25) END AS reward
    FROM (SELECT *, lag(pred_edge_idx) OVER (PARTITION BY trajectory_id ORDER BY t) AS pb FROM jud) s LEFT JOIN transitions p ON p.prev_edge_idx = pb AND p.curr_edge_idx = pred_edge_idx"""


@query(_STEP_SQL, "reward", views_=("jud", "transitions"))
def step_rewards(spark, sf_dir):
    return learn.step_rewards(_steps(spark, sf_dir)).select("trajectory_id", "t", "reward")


@query("""SELECT trajectory_id, acc + CASE WHEN acc >= 0.9 THEN 2.0 ELSE 0.0 END - 0.2 * bad AS terminal_reward FROM (
    SELECT s.trajectory_id, avg(CAST(edge_correct AS INT)) AS acc, count(*) FILTER (NOT (pb IS NULL OR pb = pred_edge_idx OR p.prev_edge_idx IS NOT NULL)) AS bad
    FROM (SELECT *, lag(pred_edge_idx) OVER (PARTITION BY trajectory_id ORDER BY t) AS pb FROM jud) s LEFT JOIN transitions p ON p.prev_edge_idx = pb AND p.curr_edge_idx = pred_edge_idx
    GROUP BY s.trajectory_id) a""", "terminal_reward", views_=("jud", "transitions"))  # fmt: skip
def terminal_rewards(spark, sf_dir):
    return learn.terminal_rewards(_steps(spark, sf_dir))


@query(f"""SELECT trajectory_id, t, adv AS advantage, adv + v AS target FROM (
    WITH RECURSIVE r AS MATERIALIZED (SELECT trajectory_id, t, reward, (t % 7) / CAST(3 AS DOUBLE) AS v, row_number() OVER (PARTITION BY trajectory_id ORDER BY t DESC) AS k FROM ({_STEP_SQL}) s),
    g AS (SELECT trajectory_id, t, k, v, reward - v AS adv FROM r WHERE k = 1 UNION ALL
        SELECT r.trajectory_id, r.t, r.k, r.v, r.reward + 0.99 * g.v - r.v + 0.99 * 0.95 * g.adv FROM g JOIN r ON r.trajectory_id = g.trajectory_id AND r.k = g.k + 1)
    SELECT * FROM g) x""", "advantage", "target", views_=("jud", "transitions"))  # fmt: skip
def gae_advantages(spark, sf_dir):
    s = learn.step_rewards(_steps(spark, sf_dir)).withColumn("value", (F.col("t") % 7) / 3)
    return learn.advantages(s.select("trajectory_id", "t", "reward", "value"))


@query()
def mlp_scores(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return learn.layer_scores(e.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", learn.seeded_layers((64, 32, 1))).select("vec_id", "score")


_RAW = ("same_edge", "is_connected", "is_legal", "prev_candidate_rank", "curr_candidate_rank", "rank_abs_diff", "prev_distance_m", "curr_distance_m", "distance_delta_m",
        "prev_yaw_diff_rad", "curr_yaw_diff_rad", "yaw_diff_delta_rad", "projection_distance_m")


@query("""SELECT p.trajectory_id, c.step, p.candidate_rank AS prev_rank, c.candidate_rank AS curr_rank, CAST(p.edge_idx = c.edge_idx AS DOUBLE) AS same_edge,
    CASE WHEN tr.prev_edge_idx IS NULL THEN 0.0 ELSE 1.0 END AS is_connected, CASE WHEN tr.prev_edge_idx IS NULL THEN 0.0 ELSE 1.0 END AS is_legal,
    CAST(p.candidate_rank AS DOUBLE) AS prev_candidate_rank, CAST(c.candidate_rank AS DOUBLE) AS curr_candidate_rank, CAST(abs(p.candidate_rank - c.candidate_rank) AS DOUBLE) AS rank_abs_diff,
    p.distance_m AS prev_distance_m, c.distance_m AS curr_distance_m, c.distance_m - p.distance_m AS distance_delta_m, p.yaw_diff_rad AS prev_yaw_diff_rad, c.yaw_diff_rad AS curr_yaw_diff_rad,
    c.yaw_diff_rad - p.yaw_diff_rad AS yaw_diff_delta_rad, sqrt((c.proj_x - p.proj_x) ** 2 + (c.proj_y - p.proj_y) ** 2) AS projection_distance_m
    FROM stepped p JOIN stepped c ON p.trajectory_id = c.trajectory_id AND c.step = p.step + 1 LEFT JOIN transitions tr ON tr.prev_edge_idx = p.edge_idx AND tr.curr_edge_idx = c.edge_idx""",
       *_RAW, views_=("stepped", "transitions"))
def lattice_transition_raw(spark, sf_dir):
    return lattice.raw_transition_features(_candidates(spark, sf_dir), roadnet.transitions(views.road_edges(spark, sf_dir)))


@query()
def scorer_training(spark, sf_dir):
    """Weights of a candidate scorer trained on the labelled steps, and its accuracy there."""
    names = ("distance_norm", "abs_yaw_diff_norm", "candidate_rank_norm", "speed_consistency", "oneway")
    labels = _labelled_candidates(spark, sf_dir).select("trajectory_id", "t", "candidate_rank", "is_gt")
    rows = _emissions(spark, sf_dir).join(labels, ["trajectory_id", "t", "candidate_rank"])
    steps = learn.labelled_steps(rows, names).persist()
    w, losses = learn.train_scorer(steps, len(names), epochs=5)
    steps.unpersist()
    best = learn.linear_scores(rows, names, w).groupBy("trajectory_id", "t").agg(F.max_by("is_gt", "score").alias("hit"), F.max("is_gt").alias("labelled")).where("labelled = 1")
    return best.agg(F.count("*").alias("steps"), F.avg(F.col("hit").cast("double")).alias("accuracy"), F.lit(losses[0]).alias("first_loss"), F.lit(losses[-1]).alias("last_loss"))


# Geometry


@query("""SELECT link_id, round(500000 + 0.9996e0 * r * (e + a1 * cos(2 * x) * sinh(2 * e) + a2 * cos(4 * x) * sinh(4 * e) + a3 * cos(6 * x) * sinh(6 * e) + a4 * cos(8 * x) * sinh(8 * e)), 3) AS easting,
        round(0.9996e0 * r * (x + a1 * sin(2 * x) * cosh(2 * e) + a2 * sin(4 * x) * cosh(4 * e) + a3 * sin(6 * x) * cosh(6 * e) + a4 * sin(8 * x) * cosh(8 * e)), 3) AS northing FROM (
    SELECT *, atan2(tau, cos(lam)) AS x, asinh(sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam))) AS e FROM (
        SELECT *, sinh(atanh(sin(phi)) - ec * atanh(ec * sin(phi))) AS tau FROM (
            SELECT link_id, radians(50.3e0 + 0.001e0 * v) AS phi, radians(11.9e0 + 0.001e0 * u - 9) AS lam, 6367449.145823415e0 AS r, 0.081819190842621486e0 AS ec,
                8.377318206244698e-4 AS a1, 7.608527773572307e-7 AS a2, 1.1976455033294527e-9 AS a3, 2.4291706072013587e-12 AS a4 FROM links) a) b) c""", "easting", "northing", views_=("links",))  # fmt: skip
def utm_project(spark, sf_dir):
    east, north = projection.to_utm(11.9 + 0.001 * F.col("u"), 50.3 + 0.001 * F.col("v"), 32)
    return views.links(spark, sf_dir).select("link_id", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query("""SELECT edge_idx, 2 * 100.0 + abs(y2 - y1) + abs(x2 - x1) AS length_m, CASE WHEN x1 = x2 AND y1 = y2 THEN 1.0 ELSE 3.0 END AS curvature FROM road_edges""", "length_m", "curvature", views_=("road_edges",))
def wkt_parse_length(spark, sf_dir):
    """Lines there, back and there again, written as text and parsed."""
    e = views.road_edges(spark, sf_dir)
    pair = lambda n: F.concat_ws(" ", F.col(f"x{n}").cast("string"), F.col(f"y{n}").cast("string"))
    text = F.concat(F.lit("MULTILINESTRING (("), pair(1), F.lit(", "), pair(2), F.lit("), ("), pair(2), F.lit(", "), pair(1), F.lit(", "), pair(2), F.lit("))"))
    line = e.select("edge_idx", geometry.join_parts(geometry.parse_lines(text)).alias("line"))
    return line.select("edge_idx", geometry.line_length(F.col("line")).alias("length_m"), geometry.curvature(F.col("line")).alias("curvature"))


# Windows over time, as the streaming jobs have them


@query("""SELECT event_type, CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS window_start_us, count(*) AS events, avg(value) AS mean_value FROM events GROUP BY ALL""", "mean_value")
def extra_daily_windows(spark, sf_dir):
    return windows.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 day", "event_type", "value")


def _load() -> None:
    """Registers the queries of the modules that build on this one."""
    from . import journeys, models, more  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
