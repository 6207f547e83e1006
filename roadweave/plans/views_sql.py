"""The derived tables and the steps that build on them as DuckDB common table expressions, written on their own."""

from __future__ import annotations

WRAP = "((({0}) + pi()) - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi())"


def wrap(x: str) -> str:
    return WRAP.format(x)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "points": ((), """SELECT CAST(user_id AS BIGINT) AS trajectory_id, event_id AS point_id, ts, CAST(value AS DOUBLE) AS x,
        CAST(5.0 * CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS DOUBLE) + CAST(500 * (user_id % 3) AS DOUBLE) AS y, event_type FROM events"""),
    "trajectory": (("points",), """SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY ts, point_id) - 1 AS BIGINT) AS t,
        point_id, ts, x, y, event_type FROM points"""),
    "grid_links": ((), """SELECT CAST(p_partkey AS BIGINT) AS link_id, p_type, p_size, p_brand, CAST(floor(p_partkey / 2) AS BIGINT) AS k,
        CASE WHEN p_partkey % 2 = 0 THEN 'h' ELSE 'v' END AS orient FROM part"""),
    "links": (("grid_links",), """SELECT link_id, p_type AS highway, CAST(p_size AS DOUBLE) + 20.0 AS maxspeed, CASE WHEN link_id % 7 = 0 THEN 'yes' ELSE 'no' END AS oneway,
        p_brand AS osm_way_id, CASE WHEN orient = 'h' THEN CAST(floor(k / 5) * 6 + k % 5 AS BIGINT) ELSE CAST(floor(k / 6) * 6 + k % 6 AS BIGINT) END AS u,
        CASE WHEN orient = 'h' THEN CAST(floor(k / 5) * 6 + k % 5 + 1 AS BIGINT) ELSE CAST(floor(k / 6) * 6 + k % 6 + 6 AS BIGINT) END AS v FROM grid_links"""),
    "road_edges": (("links",), """SELECT CAST(row_number() OVER (ORDER BY link_id, dir) - 1 AS BIGINT) AS edge_idx,
        concat_ws(':', CAST(link_id AS VARCHAR), CAST(u AS VARCHAR), CAST(v AS VARCHAR), dir) AS edge_id, link_id, osm_way_id, highway AS road_class, maxspeed,
        CASE WHEN oneway = 'yes' THEN 1 ELSE 0 END AS oneway, CASE WHEN dir = 'rev' THEN 1 ELSE 0 END AS is_reverse, dir AS direction, u, v,
        CAST(100.0 AS DOUBLE) * (u % 6) AS x1, CAST(100.0 AS DOUBLE) * floor(u / 6) AS y1, CAST(100.0 AS DOUBLE) * (v % 6) AS x2, CAST(100.0 AS DOUBLE) * floor(v / 6) AS y2,
        CAST(100.0 AS DOUBLE) AS length_m,
        atan2(CAST(100.0 AS DOUBLE) * floor(v / 6) - CAST(100.0 AS DOUBLE) * floor(u / 6), CAST(100.0 AS DOUBLE) * (v % 6) - CAST(100.0 AS DOUBLE) * (u % 6)) AS bearing_rad
        FROM (SELECT link_id, highway, maxspeed, oneway, osm_way_id, u, v, 'fwd' AS dir FROM links
              UNION ALL SELECT link_id, highway, maxspeed, oneway, osm_way_id, v, u, 'rev' FROM links WHERE oneway <> 'yes') d"""),
    "classed": (("road_edges",), "SELECT e.*, CAST(dense_rank() OVER (ORDER BY road_class) - 1 AS BIGINT) AS road_class_id FROM road_edges e"),
    "bent": (("road_edges",), """SELECT *, l1 + l2 AS bent_m FROM (SELECT *, sqrt((mx - x1) ** 2 + (my - y1) ** 2) AS l1, sqrt((x2 - mx) ** 2 + (y2 - my) ** 2) AS l2 FROM (
        SELECT *, (x1 + x2) / 2 + CASE WHEN link_id % 2 = 0 THEN 0 ELSE 10 * (link_id % 5 - 2) END AS mx, (y1 + y2) / 2 + CASE WHEN link_id % 2 = 0 THEN 10 * (link_id % 5 - 2) ELSE 0 END AS my FROM road_edges) a) b"""),
    "bent_hits": (("moving", "bent"), """SELECT m.trajectory_id, m.t, m.x, m.y, m.yaw, m.speed_mps, e.* FROM moving m JOIN bent e
        ON m.x BETWEEN least(x1, mx, x2) - 50 AND greatest(x1, mx, x2) + 50 AND m.y BETWEEN least(y1, my, y2) - 50 AND greatest(y1, my, y2) + 50"""),
    "bent_all": (("bent_hits",), """SELECT * FROM bent_hits UNION ALL SELECT m.trajectory_id, m.t, m.x, m.y, m.yaw, m.speed_mps, e.* FROM moving m JOIN bent e
        ON m.x BETWEEN least(x1, mx, x2) - 100 AND greatest(x1, mx, x2) + 100 AND m.y BETWEEN least(y1, my, y2) - 100 AND greatest(y1, my, y2) + 100
        WHERE NOT EXISTS (SELECT 1 FROM bent_hits h WHERE h.trajectory_id = m.trajectory_id AND h.t = m.t)"""),
    "bent_on": (("bent_all",), """SELECT *, CASE WHEN round(d1, 9) <= round(d2, 9) THEN d1 ELSE d2 END AS distance_m, CASE WHEN round(d1, 9) <= round(d2, 9) THEN px1 ELSE px2 END AS proj_x,
            CASE WHEN round(d1, 9) <= round(d2, 9) THEN py1 ELSE py2 END AS proj_y, CASE WHEN round(d1, 9) <= round(d2, 9) THEN s1 * l1 ELSE l1 + s2 * l2 END AS offset_m FROM (
        SELECT *, sqrt((x - px1) ** 2 + (y - py1) ** 2) AS d1, sqrt((x - px2) ** 2 + (y - py2) ** 2) AS d2 FROM (
            SELECT *, x1 + s1 * (mx - x1) AS px1, y1 + s1 * (my - y1) AS py1, mx + s2 * (x2 - mx) AS px2, my + s2 * (y2 - my) AS py2 FROM (
                SELECT *, greatest(0.0, least(1.0, ((x - x1) * (mx - x1) + (y - y1) * (my - y1)) / (l1 * l1))) AS s1,
                    greatest(0.0, least(1.0, ((x - mx) * (x2 - mx) + (y - my) * (y2 - my)) / (l2 * l2))) AS s2 FROM bent_all) a) b) c"""),
    "bent_cand": (("bent_on",), f"""SELECT *, r AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id, t ORDER BY round(distance_m, 9), round(yaw_diff_rad, 9), edge_idx) - 1 AS r FROM (
        SELECT *, abs({wrap('yaw - bearing_rad')}) AS yaw_diff_rad, offset_m / bent_m AS offset_ratio FROM bent_on) a) b WHERE r < 10"""),
    "gt_bent": (("gt_points", "bent"), """SELECT trajectory_id, t, edge_idx AS gt_edge_idx FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id, t ORDER BY round(least(
            sqrt((x - (x1 + s1 * (mx - x1))) ** 2 + (y - (y1 + s1 * (my - y1))) ** 2), sqrt((x - (mx + s2 * (x2 - mx))) ** 2 + (y - (my + s2 * (y2 - my))) ** 2)), 9), edge_idx) AS r FROM (
        SELECT *, greatest(0.0, least(1.0, ((x - x1) * (mx - x1) + (y - y1) * (my - y1)) / (l1 * l1))) AS s1, greatest(0.0, least(1.0, ((x - mx) * (x2 - mx) + (y - my) * (y2 - my)) / (l2 * l2))) AS s2 FROM (
            WITH n AS (SELECT g.*, e.* FROM gt_points g JOIN bent e ON g.x BETWEEN least(x1, mx, x2) - 30 AND greatest(x1, mx, x2) + 30 AND g.y BETWEEN least(y1, my, y2) - 30 AND greatest(y1, my, y2) + 30)
            SELECT * FROM n UNION ALL SELECT g.*, e.* FROM gt_points g JOIN bent e ON g.x BETWEEN least(x1, mx, x2) - 60 AND greatest(x1, mx, x2) + 60 AND g.y BETWEEN least(y1, my, y2) - 60 AND greatest(y1, my, y2) + 60
            WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.trajectory_id = g.trajectory_id AND n.t = g.t)) a) b) c WHERE r = 1"""),
    "routed_points": (("gt_points",), """SELECT trajectory_id, t, CASE WHEN round(d1, 9) <= round(d2, 9) THEN px1 ELSE px2 END AS x, CASE WHEN round(d1, 9) <= round(d2, 9) THEN py1 ELSE py2 END AS y FROM (
        SELECT *, sqrt((x - px1) ** 2 + (y - py1) ** 2) AS d1, sqrt((x - px2) ** 2 + (y - py2) ** 2) AS d2 FROM (
            SELECT *, 250 * s1 AS px1, b + 40 * s1 AS py1, 250 + 250 * s2 AS px2, b + 40 - 40 * s2 AS py2 FROM (
                SELECT *, greatest(0.0, least(1.0, (x * 250 + (y - b) * 40) / 64100.0)) AS s1, greatest(0.0, least(1.0, ((x - 250) * 250 - (y - b - 40) * 40) / 64100.0)) AS s2 FROM (
                    SELECT *, CAST(500 * (trajectory_id % 3) + 100 * (trajectory_id % 5) AS DOUBLE) AS b FROM gt_points) a) c) d) e"""),
    "gt_points": (("trajectory",), "SELECT trajectory_id, t, x + 8.0 * (point_id % 5 - 2) AS x, y + 6.0 * (point_id % 3 - 1) AS y FROM trajectory"),
    "even_points": (("trajectory",), "SELECT trajectory_id, t, epoch_us(ts) / 1e6 AS sec FROM trajectory WHERE t % 2 = 0"),
    "odd_points": (("trajectory",), "SELECT trajectory_id, y, epoch_us(ts) / 1e6 AS sec FROM trajectory WHERE t % 2 = 1"),
    "matches": (("trajectory",), """SELECT trajectory_id, t, CAST((CAST(floor(x / 10) AS BIGINT) + 2 * CAST(floor(y / 100) AS BIGINT)) % 100 AS BIGINT) AS pred_edge_idx,
        CAST(CASE WHEN point_id % 11 = 0 THEN -1 WHEN point_id % 4 = 0 THEN (CAST(floor(x / 10) AS BIGINT) + 2 * CAST(floor(y / 100) AS BIGINT) + 1) % 100
             ELSE (CAST(floor(x / 10) AS BIGINT) + 2 * CAST(floor(y / 100) AS BIGINT)) % 100 END AS BIGINT) AS gt_edge_idx,
        x AS pred_proj_x, y AS pred_proj_y, CASE WHEN point_id % 17 = 0 THEN NULL ELSE x + (point_id % 13) END AS gt_proj_x, CASE WHEN point_id % 17 = 0 THEN NULL ELSE y END AS gt_proj_y,
        CAST((point_id % 100) / 100.0 AS DOUBLE) AS confidence, CAST(CASE WHEN point_id % 11 = 0 OR point_id % 9 = 0 THEN -1 ELSE point_id % 4 END AS BIGINT) AS gt_candidate_pos FROM trajectory"""),
    # Kinematics: of the events' own times, and of points a second apart.
    **{name: (("trajectory",), f"""SELECT *, last_value(yaw_raw IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS yaw_back,
            first_value(yaw_raw IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS yaw_ahead,
            last_value(speed_raw IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS speed_back,
            first_value(speed_raw IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS speed_ahead
        FROM (SELECT *, CASE WHEN dt_next_s > 0 AND step_next_m >= 0.25 THEN b_next WHEN dt_prev_s > 0 AND step_prev_m >= 0.25 THEN b_prev END AS yaw_raw,
                CASE WHEN dt_next_s > 0 THEN step_next_m / dt_next_s WHEN dt_prev_s > 0 THEN step_prev_m / dt_prev_s END AS speed_raw
            FROM (SELECT trajectory_id, t, point_id, ts, x, y, {dt.format('lag')} AS dt_prev_s, {dt.format('lead')} AS dt_next_s,
                    sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step_prev_m, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS step_next_m,
                    atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS b_prev, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS b_next
                FROM trajectory WINDOW w AS (PARTITION BY trajectory_id ORDER BY t)) a) b""")
       for name, dt in (("kin_raw", "abs(epoch_us(ts) - epoch_us({0}(ts) OVER w)) / 1e6"), ("mov_raw", "CAST(abs(t - {0}(t) OVER w) AS DOUBLE)"))},
    **{name: ((raw,), f"""SELECT trajectory_id, t, point_id, ts, x, y, dt_prev_s, dt_next_s, step_prev_m, step_next_m,
            {wrap('coalesce(yaw_back, yaw_ahead, 0)')} AS yaw, coalesce(speed_back, speed_ahead, 0) AS speed_mps FROM {raw}""")
       for name, raw in (("kin", "kin_raw"), ("moving", "mov_raw"))},
    "transitions": (("road_edges",), f"""SELECT edge_idx AS prev_edge_idx, edge_idx AS curr_edge_idx, 1 AS is_self, 0 AS is_uturn, CAST(0 AS DOUBLE) AS turn_angle_rad FROM road_edges
        UNION ALL SELECT a.edge_idx, b.edge_idx, 0, 0, {wrap('b.bearing_rad - a.bearing_rad')} FROM road_edges a JOIN road_edges b ON a.v = b.u AND b.v <> a.u"""),
    "hits": (("moving", "classed"), """SELECT m.trajectory_id, m.t, m.x, m.y, m.yaw, m.speed_mps, e.* FROM moving m JOIN classed e
        ON m.x BETWEEN least(x1, x2) - 20 AND greatest(x1, x2) + 20 AND m.y BETWEEN least(y1, y2) - 20 AND greatest(y1, y2) + 20"""),
    "all_hits": (("hits",), """SELECT * FROM hits UNION ALL SELECT m.trajectory_id, m.t, m.x, m.y, m.yaw, m.speed_mps, e.* FROM moving m JOIN classed e
        ON m.x BETWEEN least(x1, x2) - 40 AND greatest(x1, x2) + 40 AND m.y BETWEEN least(y1, y2) - 40 AND greatest(y1, y2) + 40
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.trajectory_id = m.trajectory_id AND h.t = m.t)"""),
    "cand": (("all_hits",), f"""SELECT *, rank_ AS candidate_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY trajectory_id, t ORDER BY round(distance_m, 9), round(yaw_diff_rad, 9), edge_idx) - 1 AS rank_ FROM (
            SELECT *, sqrt((x - proj_x) ** 2 + (y - proj_y) ** 2) AS distance_m, abs({wrap('yaw - bearing_rad')}) AS yaw_diff_rad,
                abs(speed_mps - maxspeed / 3.6) / greatest(maxspeed / 3.6, 1.0) AS speed_consistency, offset_ratio * 100.0 AS offset_m FROM (
                SELECT *, x1 + offset_ratio * (x2 - x1) AS proj_x, y1 + offset_ratio * (y2 - y1) AS proj_y FROM (
                    SELECT *, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / 10000.0)) AS offset_ratio FROM all_hits) a) b) c) d
        WHERE rank_ < 5"""),
    "gt_hits": (("gt_points", "road_edges"), """SELECT g.trajectory_id, g.t, g.x, g.y, e.edge_idx, x1, y1, x2, y2 FROM gt_points g JOIN road_edges e
        ON g.x BETWEEN least(x1, x2) - 30 AND greatest(x1, x2) + 30 AND g.y BETWEEN least(y1, y2) - 30 AND greatest(y1, y2) + 30"""),
    "gt_more": (("gt_hits",), """SELECT * FROM gt_hits UNION ALL SELECT g.trajectory_id, g.t, g.x, g.y, e.edge_idx, x1, y1, x2, y2 FROM gt_points g JOIN road_edges e
        ON g.x BETWEEN least(x1, x2) - 60 AND greatest(x1, x2) + 60 AND g.y BETWEEN least(y1, y2) - 60 AND greatest(y1, y2) + 60
        WHERE NOT EXISTS (SELECT 1 FROM gt_hits h WHERE h.trajectory_id = g.trajectory_id AND h.t = g.t)"""),
    "gt_near": (("gt_more",), """SELECT g.trajectory_id, g.t, n.edge_idx AS gt_edge_idx, n.d AS gt_edge_dist_m FROM gt_points g LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY trajectory_id, t ORDER BY round(d, 9), edge_idx) AS r FROM (
            SELECT *, sqrt((x - (x1 + s * (x2 - x1))) ** 2 + (y - (y1 + s * (y2 - y1))) ** 2) AS d FROM (
                SELECT *, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / 10000.0)) AS s FROM gt_more) a) b) n
        ON n.trajectory_id = g.trajectory_id AND n.t = g.t AND n.r = 1"""),
    "cand_gt": (("cand", "gt_near"), "SELECT c.*, g.gt_edge_idx, CASE WHEN c.edge_idx = g.gt_edge_idx THEN 1 ELSE 0 END AS is_gt FROM cand c JOIN gt_near g USING (trajectory_id, t)"),
    "em": (("cand",), """SELECT trajectory_id, t, candidate_rank, edge_idx, least(distance_m, 100.0) / 50 AS distance_norm, ln(1 + greatest(distance_m, 0.0)) / ln(101.0) AS log_distance_norm,
        yaw_diff_rad / pi() AS yaw_diff_norm, abs(yaw_diff_rad) / pi() AS abs_yaw_diff_norm, offset_ratio, least(speed_mps, 50.0) / 30 AS speed_norm, sin(yaw) AS sin_yaw, cos(yaw) AS cos_yaw,
        sin(bearing_rad) AS sin_segment_bearing, cos(bearing_rad) AS cos_segment_bearing, candidate_rank / CAST(4 AS DOUBLE) AS candidate_rank_norm, speed_consistency,
        CAST(oneway AS DOUBLE) AS oneway, road_class_id / CAST(20 AS DOUBLE) AS road_class_id_norm, ln(101.0) / ln(1001.0) AS edge_length_log_norm,
        least(greatest(speed_mps / 5, 0.0), 1.0) AS yaw_reliability FROM cand"""),
    "stepped": (("cand",), "SELECT *, CAST(dense_rank() OVER (PARTITION BY trajectory_id ORDER BY t) - 1 AS BIGINT) AS step FROM cand"),
    "pair": (("stepped", "transitions"), """SELECT p.trajectory_id, c.step, p.candidate_rank AS prev_rank, c.candidate_rank AS curr_rank, p.edge_idx AS p_edge_idx, c.edge_idx AS c_edge_idx,
        sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2) AS gps, CAST(CASE WHEN c.t - p.t > 0 THEN c.t - p.t ELSE 1 END AS DOUBLE) AS dt, CASE WHEN p.edge_idx = c.edge_idx THEN 1 ELSE 0 END AS same,
        CASE WHEN tr.prev_edge_idx IS NULL THEN 0 ELSE 1 END AS connected, c.maxspeed / 3.6 AS ms, p.bearing_rad AS pb, c.bearing_rad AS cb, p.yaw AS py, c.yaw AS cy, c.speed_mps AS cs,
        p.osm_way_id AS pw, c.osm_way_id AS cw, p.road_class AS pc, c.road_class AS cc, p.is_reverse AS pr, c.is_reverse AS cr, p.distance_m AS pd, c.distance_m AS cd
        FROM stepped p JOIN stepped c ON p.trajectory_id = c.trajectory_id AND c.step = p.step + 1
        LEFT JOIN transitions tr ON tr.prev_edge_idx = p.edge_idx AND tr.curr_edge_idx = c.edge_idx"""),
    "routed": (("pair",), """SELECT *, CASE WHEN route <= ms * dt + 30 OR same = 1 THEN 1 ELSE 0 END AS feasible FROM (
        SELECT *, CASE WHEN same = 1 THEN gps WHEN connected = 1 THEN greatest(gps, 100.0) ELSE 0.0 END AS route FROM pair) a"""),
    "tr": (("routed",), f"""SELECT trajectory_id, step, prev_rank, curr_rank, p_edge_idx, c_edge_idx, least(gps, 200.0) / 100 AS gps_dist_norm, least(dt, 60.0) / 10 AS dt_norm,
        least(gps / greatest(dt, 0.001), 60.0) / 30 AS observed_speed_norm, least(route, 500.0) / 100 AS route_dist_norm, least(abs(route - gps), 500.0) / 100 AS route_minus_gps_norm,
        least(route / greatest(gps, 1.0), 10.0) / 10 AS route_gps_ratio_norm, abs({wrap('pb - cb')}) / pi() AS turn_norm, abs({wrap('py - cy')}) / pi() AS yaw_change_norm,
        abs(cs - ms) / greatest(ms, 1.0) AS speed_consistency, connected, greatest(connected, same) AS legal, same AS same_edge, CASE WHEN pw = cw AND cw <> '' THEN 1 ELSE 0 END AS same_osm_way,
        CASE WHEN pc = cc AND cc <> '' THEN 1 ELSE 0 END AS same_road_class, abs(cr - pr) AS direction_change, abs(curr_rank - prev_rank) / CAST(4 AS DOUBLE) AS candidate_rank_delta_norm,
        least(pd, 100.0) / 50 AS prev_distance_norm, least(cd, 100.0) / 50 AS curr_distance_norm, least(abs(cd - pd), 100.0) / 50 AS distance_delta_norm, feasible AS time_feasible FROM routed"""),
    "es": (("em",), """SELECT *, 1.0 * (3.0 * (-0.5 * power(distance_norm / sigma, 2) - ln(sigma)) - 0.8 * log_distance_norm
            - 1.2 * abs_yaw_diff_norm * (0.35 + 0.65 * yaw_reliability) * (0.25 + 0.75 * least(greatest(speed_norm, 0), 1))
            - 1.2 * candidate_rank_norm - 0.15 * speed_consistency + 0.05 * oneway - 0.10 * (n_candidates / CAST(5 AS DOUBLE))) AS emission FROM (
        SELECT *, count(*) OVER w AS n_candidates, least(greatest(0.35 + 0.30 * (1 - least(greatest(sum(speed_norm) OVER w / 5, 0), 1)) + 0.40 * (count(*) OVER w / CAST(5 AS DOUBLE))
            + 0.30 * (1 - sum(yaw_reliability) OVER w / 5), 0.20), 2.50) AS sigma FROM em WINDOW w AS (PARTITION BY trajectory_id, t)) a"""),
    "ts": (("tr",), """SELECT *, 0.35 * (0.35 * ok_ + 0.35 * same_edge + 0.15 * same_osm_way + 0.05 * same_road_class + 0.10 * time_feasible - 2.0 * (1 - ok_) - 0.50 * (1 - time_feasible)
            - 0.25 * route_dist_norm - 0.15 * route_minus_gps_norm - 0.10 * route_gps_ratio_norm - 0.10 * turn_norm - 0.05 * yaw_change_norm - 0.50 * (CASE WHEN turn_norm > 0.85 THEN 1 ELSE 0 END)
            - 0.25 * (CASE WHEN turn_norm > 0.65 THEN 1 ELSE 0 END) * time_feasible - 0.05 * candidate_rank_delta_norm - 0.05 * distance_delta_norm)
            - CASE WHEN legal = 1 THEN 0.0 ELSE 0.35 * 2.0 END AS transition FROM (SELECT *, CASE WHEN legal = 1 THEN 1 ELSE 0 END AS ok_ FROM tr) a"""),
    # The best sequences, their states and sums carried along; and the probabilities of all states.
    "vit_e": (("es",), "SELECT trajectory_id, t, CAST(dense_rank() OVER (PARTITION BY trajectory_id ORDER BY t) - 1 AS BIGINT) AS step, candidate_rank AS c, round(emission, 9) AS emission FROM es"),
    "vit_a": (("ts",), "SELECT trajectory_id, step, prev_rank AS p, curr_rank AS c, round(transition, 9) AS transition FROM ts"),
    "vit": (("vit_e", "vit_a"), """SELECT v.*, e.t, e.emission FROM (SELECT trajectory_id, unnest(range(0, len(path))) AS step, unnest(path) AS candidate_rank, unnest(scores) AS path_score, score AS total_score FROM (
        WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM vit_e), a AS MATERIALIZED (SELECT * FROM vit_a),
        dp AS (
            SELECT trajectory_id, step, c, emission AS score, [c] AS path, [emission] AS scores FROM e WHERE step = 0
            UNION ALL
            SELECT trajectory_id, step, c, score, list_append(path, c), list_append(scores, score) FROM (
                SELECT e.trajectory_id, e.step, e.c, round(max(round(d.score + a.transition, 9)) + any_value(e.emission), 9) AS score,
                    arg_max(d.path, [round(d.score + a.transition, 9), -d.c]) AS path, arg_max(d.scores, [round(d.score + a.transition, 9), -d.c]) AS scores
                FROM dp d JOIN a ON a.trajectory_id = d.trajectory_id AND a.step = d.step + 1 AND a.p = d.c
                JOIN e ON e.trajectory_id = a.trajectory_id AND e.step = a.step AND e.c = a.c GROUP BY e.trajectory_id, e.step, e.c) n)
        SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.trajectory_id ORDER BY d.score DESC, d.c) AS r FROM dp d
            JOIN (SELECT trajectory_id, max(step) AS step FROM e GROUP BY trajectory_id) l USING (trajectory_id, step)) f WHERE r = 1) g) v
        JOIN vit_e e ON e.trajectory_id = v.trajectory_id AND e.step = v.step AND e.c = v.candidate_rank"""),
    "vit_post": (("vit_e", "vit_a"), """SELECT trajectory_id, step, c, exp(lp - max(lp) OVER w) / sum(exp(lp - top)) OVER w AS p FROM (SELECT *, max(lp) OVER (PARTITION BY trajectory_id, step) AS top FROM (
        WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM vit_e), a AS MATERIALIZED (SELECT * FROM vit_a), l AS MATERIALIZED (SELECT trajectory_id, max(step) AS step FROM vit_e GROUP BY ALL),
        f AS (
            SELECT trajectory_id, step, c, emission AS s FROM e WHERE step = 0
            UNION ALL
            SELECT trajectory_id, step, c, emission + list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) FROM (
                SELECT e.trajectory_id, e.step, e.c, any_value(e.emission) AS emission, list(f.s + a.transition) AS x FROM f JOIN a ON a.trajectory_id = f.trajectory_id AND a.step = f.step + 1 AND a.p = f.c
                JOIN e ON e.trajectory_id = a.trajectory_id AND e.step = a.step AND e.c = a.c GROUP BY ALL) n),
        b AS (
            SELECT e.trajectory_id, e.step, e.c, CAST(0 AS DOUBLE) AS s FROM e JOIN l USING (trajectory_id, step)
            UNION ALL
            SELECT trajectory_id, step, c, list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) FROM (
                SELECT a.trajectory_id, a.step - 1 AS step, a.p AS c, list(a.transition + e.emission + b.s) AS x FROM b JOIN e ON e.trajectory_id = b.trajectory_id AND e.step = b.step AND e.c = b.c
                JOIN a ON a.trajectory_id = b.trajectory_id AND a.step = b.step AND a.c = b.c GROUP BY ALL) n)
        SELECT trajectory_id, step, c, f.s + b.s AS lp FROM f JOIN b USING (trajectory_id, step, c)) x) y WINDOW w AS (PARTITION BY trajectory_id, step)"""),
    "lag_dp": (("vit_e", "vit_a"), """WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM vit_e), a AS MATERIALIZED (SELECT * FROM vit_a),
        dp AS (
            SELECT trajectory_id, step AS start, step, c, emission AS score FROM e
            UNION ALL
            SELECT e.trajectory_id, d.start, e.step, e.c, round(max(round(d.score + a.transition, 9)) + any_value(e.emission), 9)
            FROM dp d JOIN a ON a.trajectory_id = d.trajectory_id AND a.step = d.step + 1 AND a.p = d.c JOIN e ON e.trajectory_id = a.trajectory_id AND e.step = a.step AND e.c = a.c
            WHERE d.step - d.start < 4 GROUP BY e.trajectory_id, d.start, e.step, e.c)
        SELECT * FROM dp WHERE start = greatest(step - 4, 0)"""),
    "decoded": (("vit", "cand", "transitions"), """SELECT s.*, CASE WHEN b IS NULL OR b = pred_edge_idx OR x.prev_edge_idx IS NOT NULL THEN 1 ELSE 0 END AS transition_legal FROM (
        SELECT v.*, c.edge_idx AS pred_edge_idx, c.proj_x AS pred_proj_x, c.proj_y AS pred_proj_y, lag(c.edge_idx) OVER (PARTITION BY v.trajectory_id ORDER BY v.t) AS b
        FROM vit v JOIN cand c ON c.trajectory_id = v.trajectory_id AND c.t = v.t AND c.candidate_rank = v.candidate_rank) s
        LEFT JOIN transitions x ON x.prev_edge_idx = b AND x.curr_edge_idx = pred_edge_idx"""),
    "lab": (("matches",), """SELECT *, pred_edge_idx = gt_edge_idx AS edge_correct, sqrt((pred_proj_x - gt_proj_x) ** 2 + (pred_proj_y - gt_proj_y) ** 2) AS projection_error_m
        FROM matches WHERE gt_edge_idx >= 0"""),
    "jud": (("lab",), """SELECT *, coalesce(projection_error_m <= 2, false) AS within_2m, coalesce(projection_error_m <= 5, false) AS within_5m, coalesce(projection_error_m <= 10, false) AS within_10m,
        coalesce(confidence < 0.35, false) AS low_confidence FROM lab"""),
    "wt": (("jud",), """SELECT *, CASE WHEN n = 1 OR gap = 1 OR total <= 0 THEN 1.0 ELSE half END AS weight_m FROM (
        SELECT *, sum(half) OVER (PARTITION BY trajectory_id) AS total FROM (
            SELECT *, 0.5 * (coalesce(seg, 0) + coalesce(lag(seg) OVER (PARTITION BY trajectory_id ORDER BY t), 0)) AS half FROM (
                SELECT *, sqrt((lead(gt_proj_x) OVER w - gt_proj_x) ** 2 + (lead(gt_proj_y) OVER w - gt_proj_y) ** 2) AS seg, count(*) OVER (PARTITION BY trajectory_id) AS n,
                    max(CASE WHEN gt_proj_x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id) AS gap FROM jud WINDOW w AS (PARTITION BY trajectory_id ORDER BY t)) a) b) c"""),
}

# Trials of a parameter grid: distances of weight 1 and 3, transitions scaled by 0.35 and 1, as sequences of their own.
VIEWS["grid_e"] = (("es",), """SELECT trajectory_id * 4 + trial AS trajectory_id, t, CAST(dense_rank() OVER (PARTITION BY trajectory_id, trial ORDER BY t) - 1 AS BIGINT) AS step, candidate_rank AS c,
    round(emission + (CASE WHEN trial < 2 THEN -2 ELSE 0 END) * (-0.5 * power(distance_norm / sigma, 2) - ln(sigma)), 9) AS emission FROM es, (SELECT unnest(range(4)) AS trial) x""")
VIEWS["grid_a"] = (("ts",), """SELECT trajectory_id * 4 + trial AS trajectory_id, step, prev_rank AS p, curr_rank AS c, round(transition / 0.35 * (CASE WHEN trial % 2 = 0 THEN 0.35 ELSE 1 END), 9) AS transition
    FROM ts, (SELECT unnest(range(4)) AS trial) x""")
# Candidates in boxes of 50 metres, ten for each point.
VIEWS["wide_hits"] = (VIEWS["hits"][0], VIEWS["hits"][1].replace(" 20", " 50"))
VIEWS["wide_all"] = (("wide_hits",), VIEWS["all_hits"][1].replace("FROM hits", "FROM wide_hits").replace(" 40", " 100"))
VIEWS["wide_cand"] = (("wide_all",), VIEWS["cand"][1].replace("all_hits", "wide_all").replace("rank_ < 5", "rank_ < 10"))
VIEWS["wide_gt"] = (("wide_cand", "gt_near"), VIEWS["cand_gt"][1].replace("FROM cand c", "FROM wide_cand c"))
VIEWS["grid_vit"] = (("grid_e", "grid_a"), VIEWS["vit"][1].replace("vit_e", "grid_e").replace("vit_a", "grid_a"))


def with_views(select: str, *names: str) -> str:
    """A query over the named views, with all that they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in VIEWS[name][0]:
                add(other)
            order.append(name)

    for n in names:
        add(n)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + select
