"""Further queries over the given tables: bent roads, features and labels for learning, calibration, tables of other origin.

Candidates on bent roads are searched in boxes of 50 metres, ten for each point.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, tags
from ..operators import calibration, decode, lattice, learn, metrics, overlap, roadnet, spatial, trajectory
from . import views
from .catalog import _STEP_SQL, K, _candidates, _emissions, _judged, _labelled_candidates, _steps, query
from .views_sql import wrap

# Bent roads


@query("""SELECT edge_idx, link_id, concat_ws(':', osm_way_id, CAST(u AS VARCHAR), CAST(v AS VARCHAR), direction) AS edge_id, road_class, direction, is_reverse, u, v, bent_m AS length_m, bearing_rad,
    bent_m / 100 AS curvature, CASE WHEN link_id % 9 = 0 THEN 1 ELSE 0 END AS bridge, oneway FROM bent""", "length_m", "bearing_rad", "curvature", views_=("bent",))  # fmt: skip
def bent_edges_directed(spark, sf_dir):
    return views.bent_edges(spark, sf_dir).select("edge_idx", "link_id", "edge_id", "road_class", "direction", "is_reverse", "u", "v", "length_m", "bearing_rad", "curvature", "bridge", "oneway")


_PLACED = ("distance_m", "yaw_diff_rad", "proj_x", "proj_y", "offset_m", "offset_ratio")


@query(f"SELECT trajectory_id, t, candidate_rank, edge_idx, {', '.join(_PLACED)} FROM bent_cand", *_PLACED, views_=("bent_cand",))
def bent_candidates(spark, sf_dir):
    found = spatial.candidates(views.moving(spark, sf_dir), views.bent_edges(spark, sf_dir))
    return found.select("trajectory_id", "t", "candidate_rank", "edge_idx", *_PLACED)


_RECALL = ", ".join(f"count(*) FILTER (r < {k}) / CAST(count(*) AS DOUBLE) AS recall_at_{k}" for k in (1, 3, 5, 10))


@query(f"""SELECT count(*) AS points, {_RECALL} FROM gt_bent g LEFT JOIN (SELECT c.trajectory_id, c.t, min(candidate_rank) AS r FROM bent_cand c JOIN gt_bent x ON x.trajectory_id = c.trajectory_id AND x.t = c.t
    AND x.gt_edge_idx = c.edge_idx GROUP BY ALL) c USING (trajectory_id, t)""", "recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", views_=("gt_bent", "bent_cand"))  # fmt: skip
def bent_recall(spark, sf_dir):
    edges = views.bent_edges(spark, sf_dir)
    truth = spatial.nearest_edge(views.gt_points(spark, sf_dir), edges).where("gt_edge_idx IS NOT NULL")
    found = spatial.candidates(views.moving(spark, sf_dir), edges).join(truth, ["trajectory_id", "t"])
    return spatial.recall_at(found.withColumn("is_gt", (F.col("edge_idx") == F.col("gt_edge_idx")).cast("int")), truth)


def _at(s: str) -> tuple[str, str]:
    """x and y at an offset along a bent edge."""
    first = f"({s}) <= l1"
    return tuple(f"CASE WHEN {first} THEN {c}1 + ({s}) / l1 * (m{c} - {c}1) ELSE m{c} + (({s}) - l1) / l2 * ({c}2 - m{c}) END" for c in ("x", "y"))


_BACK, _ON = _at("greatest(k * bent_m - 5, 0)"), _at("least(k * bent_m + 5, bent_m)")


@query(f"""SELECT edge_idx, atan2({_ON[1]} - ({_BACK[1]}), {_ON[0]} - ({_BACK[0]})) AS bearing FROM (SELECT *, (edge_idx % 11) / CAST(10 AS DOUBLE) AS k FROM bent) b""", "bearing", views_=("bent",))
def bent_bearings(spark, sf_dir):
    e = views.bent_edges(spark, sf_dir)
    return e.select("edge_idx", geometry.bearing_at(F.col("line"), (F.col("edge_idx") % 11) / 10 * F.col("length_m")).alias("bearing"))


_NEAR = """SELECT *, row_number() OVER (PARTITION BY trajectory_id, t ORDER BY round(d, 9), edge_idx) AS r FROM (
    SELECT *, sqrt((x - (x1 + s * (x2 - x1))) ** 2 + (y - (y1 + s * (y2 - y1))) ** 2) AS d FROM (
        SELECT *, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / 10000.0)) AS s FROM more_) a) b"""


@query(f"""WITH p AS (SELECT * FROM routed_points WHERE trajectory_id % 7 <> 0),
    near_ AS (SELECT p.trajectory_id, p.t, p.x, p.y, e.edge_idx, x1, y1, x2, y2 FROM p JOIN road_edges e ON p.x BETWEEN least(x1, x2) - 30 AND greatest(x1, x2) + 30 AND p.y BETWEEN least(y1, y2) - 30 AND greatest(y1, y2) + 30),
    more_ AS (SELECT * FROM near_ UNION ALL SELECT p.trajectory_id, p.t, p.x, p.y, e.edge_idx, x1, y1, x2, y2 FROM p JOIN road_edges e
        ON p.x BETWEEN least(x1, x2) - 60 AND greatest(x1, x2) + 60 AND p.y BETWEEN least(y1, y2) - 60 AND greatest(y1, y2) + 60 WHERE NOT EXISTS (SELECT 1 FROM near_ h WHERE h.trajectory_id = p.trajectory_id AND h.t = p.t))
    SELECT g.trajectory_id, g.t, p.x AS gt_x, p.y AS gt_y, n.edge_idx AS gt_edge_idx, n.d AS gt_edge_dist_m FROM gt_points g LEFT JOIN p ON p.trajectory_id = g.trajectory_id AND p.t = g.t
    LEFT JOIN ({_NEAR}) n ON n.trajectory_id = g.trajectory_id AND n.t = g.t AND n.r = 1""", "gt_x", "gt_y", "gt_edge_dist_m", views_=("routed_points", "road_edges"))  # fmt: skip
def gt_edge_by_route(spark, sf_dir):
    return spatial.nearest_edge_by_route(views.gt_points(spark, sf_dir), views.routes(spark, sf_dir), views.road_edges(spark, sf_dir))


# Cleaning and features of edges


def _dirty(spark, sf_dir):
    """Bent edges, some of them without a line or with a single vertex, named by their way, so that names repeat."""
    e, n = views.bent_edges(spark, sf_dir), F.col("edge_idx")
    line = F.when(n % 10 == 3, None).when(n % 10 == 6, F.slice("line", 1, 1)).when(n % 10 == 8, F.array(F.col("line")[0], F.col("line")[0])).otherwise(F.col("line"))
    return e.select("edge_idx", "u", "v", F.col("osm_way_id").alias("edge_id"), line.alias("line"))


_CLEAN = """SELECT * FROM (SELECT edge_idx, osm_way_id AS edge_id, u, v, bent_m AS length_m, bearing_rad, row_number() OVER (PARTITION BY osm_way_id ORDER BY edge_idx) AS r
    FROM bent WHERE edge_idx % 10 NOT IN (3, 6, 8)) c WHERE r = 1"""


@query(f"SELECT edge_idx, edge_id, length_m, {wrap('bearing_rad')} AS bearing_rad FROM ({_CLEAN}) x", "length_m", "bearing_rad", views_=("bent",))
def edges_cleaned(spark, sf_dir):
    return roadnet.clean_edges(_dirty(spark, sf_dir)).select("edge_idx", "edge_id", "length_m", "bearing_rad")


@query(f"SELECT DISTINCT node FROM (SELECT u AS node FROM ({_CLEAN}) a UNION ALL SELECT v FROM ({_CLEAN}) b) n", views_=("bent",))
def nodes_cleaned(spark, sf_dir):
    return roadnet.nodes_in_use(roadnet.node_table(views.road_edges(spark, sf_dir)), roadnet.clean_edges(_dirty(spark, sf_dir))).select("node")


_ELEVEN = ("log_length_m", "sin_bearing", "cos_bearing", "maxspeed_mps", "lanes_norm_raw", "curvature", "in_degree", "out_degree", "bridge_flag", "tunnel_flag", "oneway_flag")
_Z = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-8 THEN 1.0 ELSE stddev_pop({c}) OVER () END AS {c}" for c in _ELEVEN)


@query(f"""SELECT edge_idx, road_class_id, {_Z} FROM (SELECT edge_idx, CASE edge_idx % 4 WHEN 0 THEN 0 WHEN 1 THEN 11 WHEN 2 THEN 13 ELSE 15 END AS road_class_id, ln(1 + bent_m) AS log_length_m,
    sin(bearing_rad) AS sin_bearing, cos(bearing_rad) AS cos_bearing, CASE WHEN edge_idx % 6 = 0 THEN 13.89e0 WHEN maxspeed > 5 THEN maxspeed / 3.6e0 ELSE maxspeed END AS maxspeed_mps, 1e0 AS lanes_norm_raw, bent_m / 100 AS curvature,
    CAST((SELECT count(*) FROM road_edges o WHERE o.v = e.u) AS DOUBLE) AS in_degree, CAST((SELECT count(*) FROM road_edges o WHERE o.u = e.v) AS DOUBLE) AS out_degree,
    CASE WHEN link_id % 9 = 0 THEN 1e0 ELSE 0e0 END AS bridge_flag, 0e0 AS tunnel_flag, CAST(oneway AS DOUBLE) AS oneway_flag FROM bent e) f""", *_ELEVEN, views_=("bent",))  # fmt: skip
def segment_features(spark, sf_dir):
    n = F.col("edge_idx") % 4
    named = F.when(n == 0, "motorway").when(n == 1, "residential").when(n == 2, "living_street")
    e = roadnet.degrees(views.bent_edges(spark, sf_dir)).withColumns({"road_class": named, "lanes": F.lit(None).cast("double"), "maxspeed": F.when(F.col("edge_idx") % 6 != 0, F.col("maxspeed"))})
    return roadnet.segment_features(e).drop("edge_id")


@query("""SELECT p_partkey AS key, CASE WHEN k = 0 THEN 13.89e0 WHEN k = 1 THEN p_size * 0.44704e0 WHEN k = 2 THEN p_size / 3.6e0 WHEN k = 3 THEN 13.89e0 ELSE p_size / 3.6e0 END AS from_text,
    CASE WHEN k = 0 THEN 13.89e0 WHEN p_size > 5 THEN p_size / 3.6e0 ELSE p_size END AS from_number, 'e_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name FROM (SELECT *, p_partkey % 5 AS k FROM part) p""",
       "from_text", "from_number")
def speed_tags(spark, sf_dir):
    p, k, n = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 1, F.concat(n, F.lit(" mph"))).when(k == 2, F.concat(F.lit("about "), n, F.lit("; 99"))).when(k == 3, F.lit("walk")).when(k == 4, n)
    number = F.when(k != 0, F.col("p_size").cast("double"))
    return p.select(F.col("p_partkey").alias("key"), tags.speed_mps(text).alias("from_text"), tags.speed_mps(number, numeric=True).alias("from_number"), tags.edge_name(F.col("p_partkey")).alias("name"))


@query("""SELECT CASE WHEN link_id % 3 = 0 THEN 'MultiLineString' ELSE 'LineString' END AS geometry_type, count(*) AS n, min(bent_m) AS min_m, quantile_cont(bent_m, 0.5) AS median_m, avg(bent_m) AS mean_m, max(bent_m) AS max_m
    FROM bent WHERE link_id % 4 <> 0 GROUP BY ALL""", "min_m", "median_m", "mean_m", "max_m", views_=("bent",))  # fmt: skip
def route_report(spark, sf_dir):
    e = views.bent_edges(spark, sf_dir)
    body = F.substring_index(geometry.line_text(F.col("line")), "LINESTRING ", -1)
    text = F.when(F.col("link_id") % 4 == 0, "POINT (1 2)").when(F.col("link_id") % 3 == 0, F.concat(F.lit("MULTILINESTRING ("), body, F.lit(")"))).otherwise(geometry.line_text(F.col("line")))
    typed = e.select(text.alias("text")).withColumn("geometry_type", geometry.geometry_type(F.col("text"))).where("geometry_type IS NOT NULL")
    size = typed.withColumn("length_m", geometry.line_length(geometry.join_parts(geometry.parse_lines(F.col("text")))))
    return size.groupBy("geometry_type").agg(F.count("*").alias("n"), F.min("length_m").alias("min_m"), F.percentile("length_m", F.lit(0.5)).alias("median_m"), F.avg("length_m").alias("mean_m"), F.max("length_m").alias("max_m"))


# Trajectories


@query(f"""SELECT trajectory_id, t, {wrap('coalesce(CASE WHEN pa IS NULL OR t - pb <= pa - t THEN before ELSE after END, 0.0)')} AS bearing FROM (
    SELECT *, max(CASE WHEN b IS NOT NULL THEN t END) OVER w AS pb, last_value(b IGNORE NULLS) OVER w AS before,
        min(CASE WHEN b IS NOT NULL THEN t END) OVER v AS pa, first_value(b IGNORE NULLS) OVER v AS after FROM (
        SELECT trajectory_id, t, CASE WHEN lead(t) OVER o IS NULL THEN lag(b) OVER o ELSE b END AS b FROM (
            SELECT trajectory_id, t, CASE WHEN sqrt((lead(x) OVER o - x) ** 2 + (lead(y) OVER o - y) ** 2) >= 60 THEN atan2(lead(y) OVER o - y, lead(x) OVER o - x) END AS b
            FROM trajectory WINDOW o AS (PARTITION BY trajectory_id ORDER BY t)) a WINDOW o AS (PARTITION BY trajectory_id ORDER BY t)) c
    WINDOW w AS (PARTITION BY trajectory_id ORDER BY t ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY trajectory_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) d""",
       "bearing", views_=("trajectory",))
def forward_bearings(spark, sf_dir):
    return trajectory.forward_bearings(views.trajectory(spark, sf_dir), 60.0).select("trajectory_id", "t", "bearing")


@query("SELECT trajectory_id, min(point_id) AS first_seen FROM points GROUP BY 1 ORDER BY 2, 1 LIMIT 12", views_=("points",))
def first_trajectories(spark, sf_dir):
    return trajectory.first_ids(views.points(spark, sf_dir), "trajectory_id", "point_id")


@query("SELECT CAST(0 AS BIGINT) AS shared, (SELECT count(DISTINCT trajectory_id) FROM points) AS trajectories", views_=("points",))
def splits_disjoint(spark, sf_dir):
    parts = trajectory.split_by_hash(views.points(spark, sf_dir).select("trajectory_id").distinct())
    train, rest = parts.where("split = 'train'"), parts.where("split <> 'train'")
    shared = trajectory.overlap_of(train, rest, "trajectory_id").agg(F.count("*").alias("shared"))
    return shared.crossJoin(parts.agg(F.count("*").alias("trajectories")))  # single rows


# Tables of other origin


@query("""SELECT trajectory_id, t, pred_edge_idx, gt_edge_idx, gt_candidate_pos, pred_proj_x, pred_proj_y, gt_proj_x, gt_proj_y, confidence FROM matches""", "pred_proj_x", "pred_proj_y", "gt_proj_x", "gt_proj_y", "confidence", views_=("matches",))
def canonical_matches(spark, sf_dir):
    other = {"trajectory_id": "traj_id", "t": "point_idx", "pred_edge_idx": "matched_edge_id", "gt_edge_idx": "true_edge_idx", "gt_candidate_pos": "gt_action", "pred_proj_x": "matched_x", "pred_proj_y": "y_pred", "gt_proj_x": "true_proj_x", "gt_proj_y": "gt_y"}
    return metrics.canonical(views.matches(spark, sf_dir).withColumnsRenamed(other))


_ANGLES = ("distance_m", "sin_yaw", "cos_yaw", "sin_segment_bearing", "cos_segment_bearing")


@query("""SELECT trajectory_id, t, edge_idx, CAST(edge_idx AS VARCHAR) AS edge_id, row_number() OVER (PARTITION BY trajectory_id, t ORDER BY round(distance_m, 9), edge_idx) - 1 AS candidate_rank, false AS is_gt,
    distance_m, sin(yaw) AS sin_yaw, cos(yaw) AS cos_yaw, sin(bearing_rad) AS sin_segment_bearing, cos(bearing_rad) AS cos_segment_bearing FROM cand""", *_ANGLES, views_=("cand",))  # fmt: skip
def canonical_candidates(spark, sf_dir):
    bare = _candidates(spark, sf_dir).select("trajectory_id", "t", F.col("edge_idx").alias("segment_idx"), F.round("distance_m", 9).alias("distance_m"), "yaw", F.col("bearing_rad").alias("segment_bearing_rad"))
    return metrics.canonical_candidates(bare).select("trajectory_id", "t", "edge_idx", "edge_id", "candidate_rank", "is_gt", *_ANGLES)


_LINE = "trajectory_id % 4"


@query("""WITH used AS (SELECT DISTINCT trajectory_id, pred_edge_idx AS edge_idx FROM matches),
    text_ AS (SELECT DISTINCT trajectory_id, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2 FROM used JOIN road_edges USING (edge_idx) WHERE trajectory_id % 4 = 0),
    edge_ AS (SELECT trajectory_id, x1, y1, x2, y2 FROM used JOIN road_edges USING (edge_idx) WHERE trajectory_id % 4 IN (1, 2) AND edge_idx < 40),
    point_ AS (SELECT * FROM (SELECT trajectory_id, pred_proj_x AS x1, pred_proj_y AS y1, lead(pred_proj_x) OVER w AS x2, lead(pred_proj_y) OVER w AS y2 FROM matches
        WHERE trajectory_id NOT IN (SELECT trajectory_id FROM text_ UNION ALL SELECT trajectory_id FROM edge_) WINDOW w AS (PARTITION BY trajectory_id ORDER BY t)) p WHERE x2 IS NOT NULL AND (x1 <> x2 OR y1 <> y2))
    SELECT source, trajectory_id, count(*) AS segments, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS length_m FROM (
        SELECT 'wkt' AS source, * FROM text_ UNION ALL SELECT 'edge_geometry', * FROM edge_ UNION ALL SELECT 'projected_points', * FROM point_) r GROUP BY ALL""", "length_m", views_=("matches", "road_edges"))  # fmt: skip
def route_sources(spark, sf_dir):
    """A quarter of the trajectories has line texts, half of them edges (some unknown), the others points alone."""
    e, m = views.road_edges(spark, sf_dir), views.matches(spark, sf_dir)
    pair = lambda k: F.concat_ws(" ", F.col(f"x{k}").cast("string"), F.col(f"y{k}").cast("string"))
    lines = e.select(F.col("edge_idx").alias("pred_edge_idx"), F.concat(F.lit("LINESTRING ("), pair(1), F.lit(", "), pair(2), F.lit(")")).alias("line_text"))
    kind = F.col("trajectory_id") % 4
    told = m.join(lines, "pred_edge_idx", "left").withColumn("pred_route_wkt", F.when(kind == 0, F.col("line_text")).otherwise("not a line"))
    told = told.withColumn("pred_edge_idx", F.when(kind.isin(1, 2), F.col("pred_edge_idx")).otherwise(-1))
    r = overlap.route_by_source(told, e.where("edge_idx < 40"), "pred_route_wkt", "pred_edge_idx", "pred_proj_x", "pred_proj_y", "trajectory_id")
    return r.groupBy("source", "trajectory_id").agg(F.count("*").alias("segments"), F.sum("length_m").alias("length_m"))


# Scores and decoding


@query("""SELECT trajectory_id, t, candidate_rank, 0.5e0 - 3.0 * distance_norm - 0.8 * log_distance_norm - 1.2 * abs_yaw_diff_norm * (0.35 + 0.65 * yaw_reliability) - 1.2 * candidate_rank_norm
    - 0.15 * speed_consistency + 0.05 * oneway AS emission FROM em""", "emission", views_=("em",))  # fmt: skip
def hmm_emission_basic(spark, sf_dir):
    return decode.basic_emission_scores(_emissions(spark, sf_dir), bias=0.5).select("trajectory_id", "t", "candidate_rank", "emission")


@query("SELECT trajectory_id, t, candidate_rank, emission + 0.4 * (edge_idx % 3) AS emission FROM es", "emission", views_=("es",))
def hmm_emission_prior(spark, sf_dir):
    e = _emissions(spark, sf_dir).withColumn("road_class_prior", (F.col("edge_idx") % 3).cast("double"))
    return decode.emission_scores(e, decode.Params(road_class_prior_weight=0.4), K).select("trajectory_id", "t", "candidate_rank", "emission")


@query("""SELECT trajectory_id, step, prev_rank, curr_rank, ok AS mask, CASE WHEN ok THEN -0.01 * far - 0.1 * prev_rank ELSE -1e9 END AS constrained FROM (
    SELECT *, connected = 1 AND far <= 120 AND far <= dt * 70 AS ok FROM (
        SELECT p.trajectory_id, c.step, p.candidate_rank AS prev_rank, c.candidate_rank AS curr_rank, CASE WHEN tr.prev_edge_idx IS NULL THEN 0 ELSE 1 END AS connected,
            sqrt((c.proj_x - p.proj_x) ** 2 + (c.proj_y - p.proj_y) ** 2) AS far, CAST(1 + c.step % 3 AS DOUBLE) AS dt
        FROM stepped p JOIN stepped c ON p.trajectory_id = c.trajectory_id AND c.step = p.step + 1 LEFT JOIN transitions tr ON tr.prev_edge_idx = p.edge_idx AND tr.curr_edge_idx = c.edge_idx) a) b""",
       "constrained", views_=("stepped", "transitions"))
def transitions_constrained(spark, sf_dir):
    raw = lattice.raw_transition_features(_candidates(spark, sf_dir), roadnet.transitions(views.road_edges(spark, sf_dir)))
    scored = raw.withColumns({"score": -0.01 * F.col("projection_distance_m"), "penalty": -0.1 * F.col("prev_rank"), "dt": (1 + F.col("step") % 3).cast("double")})
    out = decode.constrained(scored, "score", "penalty", "dt", max_route_m=120.0)
    return out.select("trajectory_id", "step", "prev_rank", "curr_rank", "mask", "constrained")


# Learning


@query(f"""SELECT trajectory_id, t, (adv - avg(adv) OVER ()) / (stddev_pop(adv) OVER () + 1e-8) AS advantage FROM (
    WITH RECURSIVE r AS MATERIALIZED (SELECT trajectory_id, t, reward, (t % 7) / CAST(3 AS DOUBLE) AS v, row_number() OVER (PARTITION BY trajectory_id ORDER BY t DESC) AS k FROM ({_STEP_SQL}) s),
    g AS (SELECT trajectory_id, t, k, v, reward - v AS adv FROM r WHERE k = 1 UNION ALL
        SELECT r.trajectory_id, r.t, r.k, r.v, r.reward + 0.99 * g.v - r.v + 0.99 * 0.95 * g.adv FROM g JOIN r ON r.trajectory_id = g.trajectory_id AND r.k = g.k + 1)
    SELECT * FROM g) x""", "advantage", views_=("jud", "transitions"))  # fmt: skip
def gae_standardised(spark, sf_dir):
    s = learn.step_rewards(_steps(spark, sf_dir)).withColumn("value", (F.col("t") % 7) / 3)
    return learn.standardised(learn.advantages(s.select("trajectory_id", "t", "reward", "value"))).select("trajectory_id", "t", "advantage")


@query("""SELECT trajectory_id, t, ln(sum(exp(emission - top))) + any_value(top) - (0.9e0 * max(emission) FILTER (is_gt = 1) + 0.1e0 * avg(emission)) AS cross_entropy,
    coalesce(greatest(1.0 - (max(emission) FILTER (is_gt = 1) - max(emission) FILTER (is_gt = 0)), 0), 0) AS hinge,
    CASE WHEN coalesce(max(emission) FILTER (is_gt = 1) >= max(emission) FILTER (is_gt = 0), true) THEN 1 ELSE 0 END AS correct
    FROM (SELECT e.*, is_gt, max(emission) OVER (PARTITION BY e.trajectory_id, e.t) AS top FROM es e JOIN cand_gt c USING (trajectory_id, t, candidate_rank)) a
    GROUP BY trajectory_id, t HAVING max(is_gt) = 1""", "cross_entropy", "hinge", views_=("es", "cand_gt"))  # fmt: skip
def emission_losses(spark, sf_dir):
    labels = _labelled_candidates(spark, sf_dir).select("trajectory_id", "t", "candidate_rank", "is_gt")
    scored = decode.emission_scores(_emissions(spark, sf_dir), k=K).join(labels, ["trajectory_id", "t", "candidate_rank"])
    return learn.emission_losses(scored, "emission", smoothing=0.1)


@query("""SELECT event_type AS epoch, sum(value * (event_id % 4)) / greatest(sum(event_id % 4), 1) AS mean, CAST(sum(event_id % 4) AS BIGINT) AS weight FROM events GROUP BY 1""", "mean")
def epoch_averages(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("epoch"), "value", (F.col("event_id") % 4).alias("weight"))
    return learn.running_mean(e, "value", "weight", "epoch")


def _slots(order: str) -> str:
    return f"""SELECT trajectory_id, t, list_resize(coalesce(list(candidate_rank ORDER BY slot) FILTER (slot < 3), []), 3, -1)::VARCHAR AS negatives FROM (
        SELECT g.trajectory_id, g.t, c.candidate_rank, row_number() OVER (PARTITION BY g.trajectory_id, g.t ORDER BY {order}, c.edge_idx) - 1 AS slot, c.edge_idx FROM
        (SELECT DISTINCT trajectory_id, t FROM cand_gt WHERE gt_edge_idx >= 0) g LEFT JOIN (SELECT * FROM cand_gt WHERE gt_edge_idx >= 0 AND edge_idx <> gt_edge_idx) c USING (trajectory_id, t)) a
        WHERE edge_idx IS NOT NULL OR slot = 0 GROUP BY ALL"""


def _as_text(df):
    return df.withColumn("negatives", F.concat(F.lit("["), F.concat_ws(", ", F.col("negatives").cast("array<string>")), F.lit("]")))


@query(_slots("md5('42:' || g.trajectory_id || ':' || g.t || ':' || c.edge_idx)").replace("FILTER (slot < 3)", "FILTER (slot < 3 AND candidate_rank IS NOT NULL)"), views_=("cand_gt",))
def negatives_drawn(spark, sf_dir):
    return _as_text(lattice.padded_negatives(_labelled_candidates(spark, sf_dir), 3))


@query(_slots("c.candidate_rank").replace("FILTER (slot < 3)", "FILTER (slot < 3 AND candidate_rank IS NOT NULL)"), views_=("cand_gt",))
def negatives_hard(spark, sf_dir):
    return _as_text(lattice.padded_negatives(_labelled_candidates(spark, sf_dir), 3, hard=True))


@query("""WITH r AS (SELECT s.*, x.gt_edge_idx, x.gt_rank, p.x AS gt_x, p.y AS gt_y FROM stepped s JOIN gt_points p USING (trajectory_id, t)
        JOIN (SELECT trajectory_id, t, min(gt_edge_idx) AS gt_edge_idx, min(candidate_rank) FILTER (is_gt = 1) AS gt_rank FROM cand_gt GROUP BY ALL) x USING (trajectory_id, t)),
    g AS (SELECT trajectory_id, step, edge_idx FROM r WHERE candidate_rank = gt_rank)
    SELECT r.trajectory_id, r.t, r.candidate_rank, CASE WHEN r.candidate_rank = gt_rank THEN 1e0 ELSE 0e0 END AS is_true, coalesce(abs(r.candidate_rank - gt_rank) / 4e0, 1e0) AS rank_distance,
        CASE WHEN gt_rank IS NOT NULL AND r.edge_idx = gt_edge_idx THEN 1e0 ELSE 0e0 END AS same_edge,
        CASE WHEN b.edge_idx IS NULL OR b.edge_idx = r.edge_idx OR EXISTS (SELECT 1 FROM transitions x WHERE x.prev_edge_idx = b.edge_idx AND x.curr_edge_idx = r.edge_idx) THEN 1e0 ELSE 0e0 END AS from_previous,
        CASE WHEN a.edge_idx IS NULL OR a.edge_idx = r.edge_idx OR EXISTS (SELECT 1 FROM transitions x WHERE x.prev_edge_idx = r.edge_idx AND x.curr_edge_idx = a.edge_idx) THEN 1e0 ELSE 0e0 END AS to_next,
        least(sqrt((proj_x - gt_x) ** 2 + (proj_y - gt_y) ** 2), 50) / 50 AS place_distance, 1e0 AS valid
    FROM r LEFT JOIN g b ON b.trajectory_id = r.trajectory_id AND b.step = r.step - 1 LEFT JOIN g a ON a.trajectory_id = r.trajectory_id AND a.step = r.step + 1""",
       "is_true", "rank_distance", "same_edge", "from_previous", "to_next", "place_distance", "valid", views_=("stepped", "cand_gt", "gt_points", "transitions"))
def candidate_hints(spark, sf_dir):
    places = views.gt_points(spark, sf_dir).select("trajectory_id", "t", F.col("x").alias("gt_x"), F.col("y").alias("gt_y"))
    c = _labelled_candidates(spark, sf_dir).join(places, ["trajectory_id", "t"])
    return lattice.hints(c, roadnet.transitions(views.road_edges(spark, sf_dir)), K)


@query("""SELECT trajectory_id, t, len(f) AS size, list_sum(f) AS total, f[1] AS first_feature, f[len(f)] AS share FROM (
    SELECT trajectory_id, t, list_concat(list_resize(list_resize(flatten(list([distance_norm, speed_consistency] ORDER BY candidate_rank)), 10, 0e0), 10, 0e0),
        list_resize(list(1e0 ORDER BY candidate_rank), 5, 0e0), [(row_number() OVER (PARTITION BY trajectory_id ORDER BY t) - 1) / CAST(greatest(count(*) OVER (PARTITION BY trajectory_id) - 1, 1) AS DOUBLE)]) AS f
    FROM em GROUP BY trajectory_id, t) a""", "total", "first_feature", "share", views_=("em",))  # fmt: skip
def policy_observations(spark, sf_dir):
    o = lattice.observations(_emissions(spark, sf_dir), ("distance_norm", "speed_consistency"), K)
    v = F.col("observation")
    return o.select("trajectory_id", "t", F.size(v).cast("bigint").alias("size"), F.aggregate(v, F.lit(0.0), lambda a, b: a + b).alias("total"), v[0].alias("first_feature"), F.element_at(v, -1).alias("share"))


# Calibration by other values than the confidence


_QUALITY = ("point_action_accuracy", "mean_entropy", "mean_margin", "same_osm_way_accuracy", "same_road_class_accuracy", "same_undirected_uv_accuracy", "pred_transition_legal_rate", "gt_transition_legal_rate",
            "error_same_way_rate", "error_reverse_edge_rate", "low_confidence_rate", "path_edit_distance_mean", "normalised_edit_distance_mean", "path_edit_distance_median", "confidence_p10", "confidence_median",
            "confidence_p90", "trajectory_success_rate")


@query("""WITH d AS (SELECT j.*, t % 4 AS pos, t * 13 % 89 / CAST(50 AS DOUBLE) AS entropy, lag(pred_edge_idx) OVER w AS pb, lag(gt_edge_idx) OVER w AS gb FROM jud j WINDOW w AS (PARTITION BY trajectory_id ORDER BY t)),
    x AS (SELECT d.*, coalesce(p.osm_way_id = g.osm_way_id, false) AS way, coalesce(p.road_class = g.road_class, false) AS cls, coalesce(p.u = g.v AND p.v = g.u, false) AS rev,
        coalesce((p.u = g.v AND p.v = g.u) OR (p.u = g.u AND p.v = g.v), false) AS und, pb IS NULL OR pb = pred_edge_idx OR EXISTS (SELECT 1 FROM transitions t WHERE t.prev_edge_idx = pb AND t.curr_edge_idx = pred_edge_idx) AS pl,
        gb IS NULL OR gb = gt_edge_idx OR EXISTS (SELECT 1 FROM transitions t WHERE t.prev_edge_idx = gb AND t.curr_edge_idx = gt_edge_idx) AS gl
        FROM d LEFT JOIN road_edges p ON p.edge_idx = pred_edge_idx LEFT JOIN road_edges g ON g.edge_idx = gt_edge_idx),
    e AS (SELECT trajectory_id, levenshtein(string_agg(chr(CAST(27 + pred_edge_idx AS INT)), '' ORDER BY t), string_agg(chr(CAST(27 + gt_edge_idx AS INT)), '' ORDER BY t)) AS d, count(*) AS n, avg(CAST(edge_correct AS INT)) AS acc FROM jud GROUP BY 1)
    SELECT (SELECT count(*) FROM matches) AS num_points, count(*) AS num_labelled_points, avg(CAST(pos = gt_candidate_pos AS INT)) AS point_action_accuracy, avg(entropy) AS mean_entropy, CAST(NULL AS DOUBLE) AS mean_margin,
        avg(CAST(way AS INT)) AS same_osm_way_accuracy, avg(CAST(cls AS INT)) AS same_road_class_accuracy, avg(CAST(und AS INT)) AS same_undirected_uv_accuracy,
        avg(CAST(pl AS INT)) FILTER (t > 0) AS pred_transition_legal_rate, avg(CAST(gl AS INT)) FILTER (t > 0) AS gt_transition_legal_rate, avg(CAST(way AS INT)) FILTER (NOT edge_correct) AS error_same_way_rate,
        avg(CAST(rev AS INT)) FILTER (NOT edge_correct) AS error_reverse_edge_rate, avg(CAST(low_confidence AS INT)) AS low_confidence_rate, (SELECT count(*) FROM matches) - count(*) AS num_unlabelled_points,
        (SELECT avg(d) FROM e) AS path_edit_distance_mean, (SELECT avg(d / CAST(n AS DOUBLE)) FROM e) AS normalised_edit_distance_mean, (SELECT quantile_cont(d, 0.5) FROM e) AS path_edit_distance_median,
        quantile_cont(confidence, 0.1) AS confidence_p10, quantile_cont(confidence, 0.5) AS confidence_median, quantile_cont(confidence, 0.9) AS confidence_p90, (SELECT avg(CAST(acc >= 0.9 AS INT)) FROM e) AS trajectory_success_rate FROM x""",
       *_QUALITY, views_=("jud", "transitions"))
def quality_metrics(spark, sf_dir):
    m = views.matches(spark, sf_dir).withColumns({"pred_candidate_pos": F.col("t") % 4, "entropy": ((F.col("t") * 13) % 89) / 50})
    e = views.road_edges(spark, sf_dir)
    return metrics.quality_metrics(m, e, roadnet.transitions(e))


def _valued(spark, sf_dir):
    return _judged(spark, sf_dir).withColumns({"margin": ((F.col("trajectory_id") * 31 + F.col("t") * 17) % 997) / 100, "entropy": ((F.col("t") * 13) % 89) / 50})


_VALUED = "(SELECT *, (trajectory_id * 31 + t * 17) % 997 / CAST(100 AS DOUBLE) AS margin, t * 13 % 89 / CAST(50 AS DOUBLE) AS entropy FROM jud) v"
_SHARES = ", ".join(repr(i / 199) + "e0" if "e" not in repr(i / 199) else repr(i / 199) for i in range(200))


def _thresholds(values: str, column: str, keeps: str, lower_first: str = "th") -> str:
    return f"""WITH v AS MATERIALIZED (SELECT round({column}, 9) AS v, CAST(edge_correct AS INT) AS hit FROM {_VALUED}), ths AS (SELECT DISTINCT round(unnest(x), 9) AS th FROM ({values}) y),
        each_ AS (SELECT target_precision, th, count(*) AS kept, sum(hit) AS good FROM (SELECT unnest([CAST(0.6 AS DOUBLE), 0.7, 0.8, 0.9]) AS target_precision) p, ths JOIN v ON v.v {keeps} ths.th GROUP BY ALL)
        SELECT target_precision, th AS threshold, good / CAST(kept AS DOUBLE) AS precision, kept / CAST((SELECT count(*) FROM v) AS DOUBLE) AS coverage, kept AS kept_points FROM (
            SELECT *, row_number() OVER (PARTITION BY target_precision ORDER BY kept DESC, {lower_first}) AS r FROM each_ WHERE good / CAST(kept AS DOUBLE) >= target_precision) c WHERE r = 1"""


_CURVE = ("target_precision", "threshold", "precision", "coverage")


@query(_thresholds(f"SELECT quantile_cont(v, [{_SHARES}]) AS x FROM v", "margin", ">="), *_CURVE, views_=("jud",))
def threshold_margin(spark, sf_dir):
    return calibration.threshold_coverage(_valued(spark, sf_dir), "margin")


@query(_thresholds("SELECT list(DISTINCT v) AS x FROM v", "entropy", "<="), *_CURVE, views_=("jud",))
def threshold_entropy(spark, sf_dir):
    return calibration.threshold_coverage(_valued(spark, sf_dir), "entropy", higher=False)


def _bins(column: str) -> str:
    edges = ", ".join(f"quantile_cont({column}, {i / 10})" for i in range(11))
    return f"""SELECT CAST(bin AS INT) AS bin, e[bin + 1] AS lo, e[bin + 2] AS hi, count(*) AS count, avg({column}) AS mean_value, avg(CAST(edge_correct AS INT)) AS accuracy FROM (
        SELECT *, greatest(len([x for x in e[1:10] if x < {column}]) - 1, 0) AS bin FROM {_VALUED}, (SELECT [{edges}] AS e FROM {_VALUED}) q) a GROUP BY bin, e"""


_BINS = ("lo", "hi", "mean_value", "accuracy")


@query(_bins("margin"), *_BINS, views_=("jud",))
def margin_bins(spark, sf_dir):
    return calibration.quantile_bins(_valued(spark, sf_dir), "margin")


@query(_bins("entropy"), *_BINS, views_=("jud",))
def entropy_bins(spark, sf_dir):
    return calibration.quantile_bins(_valued(spark, sf_dir), "entropy")
