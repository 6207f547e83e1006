import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.operators import calibration, decode, lattice, learn, metrics, overlap, roadnet, spatial, trajectory

EDGE = "edge_idx bigint, u bigint, v bigint, x1 double, y1 double, x2 double, y2 double, length_m double, bearing_rad double, maxspeed double, oneway int, road_class string, road_class_id bigint, osm_way_id string, is_reverse int"


def edges(spark, rows):
    out = []
    for i, (u, v, x1, y1, x2, y2) in enumerate(rows):
        out.append((i, u, v, *map(float, (x1, y1, x2, y2)), math.hypot(x2 - x1, y2 - y1), math.atan2(y2 - y1, x2 - x1), 50.0, 0, "road", 0, f"w{i}", 0))
    return spark.createDataFrame(out, EDGE)


def points(spark, rows, kind="trajectory_id bigint, point_id bigint, s double, x double, y double"):
    return spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))).drop("s")


def test_yaw_and_speed_of_a_straight_walk(spark):
    rows = trajectory.kinematics(points(spark, [(1, i, float(i), float(i), 0.0) for i in range(3)]), 0.01).orderBy("t").collect()
    assert [(r["yaw"], r["speed_mps"]) for r in rows] == [(0.0, 1.0)] * 3


def test_gaps_repeated_times_and_single_points(spark):
    df = points(spark, [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.1, 0.0), (1, 2, 1.0, 5.0, 5.0), (1, 3, 2.0, 5.0, 9.0), (2, 9, 5.0, 1.0, 1.0)])
    rows = {(r["trajectory_id"], r["t"]): r for r in trajectory.kinematics(df).collect()}
    # Steps under a quarter metre have no yaw; the first known one fills backwards. Speed has no such limit.
    assert rows[1, 0]["yaw"] == pytest.approx(rows[1, 2]["yaw"]) == pytest.approx(math.pi / 2)
    assert rows[1, 0]["speed_mps"] == pytest.approx(0.1) and rows[1, 1]["speed_mps"] == pytest.approx(0.1)
    assert (rows[2, 0]["yaw"], rows[2, 0]["speed_mps"], rows[2, 0]["dt_prev_s"]) == (0.0, 0.0, None)


def test_fill_methods(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([None, 1.0, None, None, 4.0, None])], "trajectory_id bigint, t bigint, v double")
    got = {m: [r[0] for r in df.withColumn("f", trajectory.fill_gaps("v", m)).orderBy("t").select("f").collect()] for m in ("zero", "ffill_bfill", "nearest")}
    assert got == {"zero": [0, 1, 0, 0, 4, 0], "ffill_bfill": [1, 1, 1, 1, 4, 4], "nearest": [1, 1, 1, 4, 4, 4]}


def test_path_length_and_splits(spark):
    df = spark.createDataFrame([(1, t, 3.0 * t, 4.0 * t) for t in range(3)], "trajectory_id bigint, t bigint, x double, y double")
    assert [r["cum_m"] for r in trajectory.path_lengths(df).orderBy("t").collect()] == [0, 5, 10]
    split = trajectory.split_exact(list(range(40)))
    assert [list(split.values()).count(s) for s in ("train", "val", "test")] == [28, 6, 6]


def test_line_graph_of_a_chain(spark):
    e = edges(spark, [(0, 1, 0, 0, 1, 0), (1, 2, 1, 0, 2, 0), (2, 3, 2, 0, 3, 0), (1, 0, 1, 0, 0, 0)])
    got = {(r[0], r[1]) for r in roadnet.transitions(e).select("prev_edge_idx", "curr_edge_idx").collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 1), (1, 2)}
    allowed = {(r[0], r[1]) for r in roadnet.transitions(e, allow_uturns=True, self_loops=False).where("is_uturn = 1").select("prev_edge_idx", "curr_edge_idx").collect()}
    assert allowed == {(0, 3), (3, 0)}


def test_directed_edges_of_tagged_links(spark):
    links = spark.createDataFrame(
        [(1, "w1", 10, 11, "residential;x", "no", "yes", None, [(0.0, 0.0), (3.0, 4.0)]), (2, "w2", 11, 12, "primary", "-1", None, None, [(0.0, 0.0), (0.0, 2.0)]), (3, "w3", 12, 13, "footway", "yes", None, None, [(0.0, 0.0), (9.0, 9.0)]), (4, "w4", 13, 14, "road", "yes", None, None, [(0.0, 0.0), (0.1, 0.0)])],
        "link_id bigint, osm_way_id string, u bigint, v bigint, highway string, oneway string, bridge string, tunnel string, line array<struct<x:double,y:double>>",
    )
    got = {r["edge_id"]: r for r in roadnet.directed_edges(links).collect()}
    assert sorted(got) == ["w1:10:11:fwd", "w1:11:10:rev", "w2:11:12:fwd"]
    assert [got[k]["edge_idx"] for k in sorted(got)] == [0, 1, 2] and got["w1:11:10:rev"]["line"][0]["x"] == 3.0 and got["w1:10:11:fwd"]["bridge"] == 1
    library = roadnet.directed_edges(links, library=True).where("osm_way_id = 'w2'").first()
    assert (library["u"], library["v"], library["bearing_rad"]) == (12, 11, pytest.approx(-math.pi / 2))


POINT = "trajectory_id bigint, t bigint, x double, y double, yaw double, speed_mps double"


def test_candidates_of_parallel_edges(spark):
    e = edges(spark, [(0, 1, 0, 0, 10, 0), (2, 3, 0, 10, 10, 10)])
    p = spark.createDataFrame([(0, 0, 5.0, 1.0, 0.0, 1.0), (0, 1, 5.0, 19.0, 0.0, 1.0), (0, 2, 500.0, 500.0, 0.0, 1.0)], POINT)
    rows = {(r["t"], r["candidate_rank"]): r for r in spatial.candidates(p, e, 5.0, 10, cell=7.0).collect()}
    assert set(rows) == {(0, 0), (1, 0)}  # the second is found in the doubled box only, the third nowhere
    assert (rows[0, 0]["edge_idx"], rows[0, 0]["distance_m"], rows[1, 0]["edge_idx"], rows[1, 0]["distance_m"]) == (0, 1.0, 1, 9.0)
    assert spatial.candidates(p, e, 5.0, 10, strict=True).count() == 1


def test_box_join_against_brute_force(spark):
    r = random.Random(2)
    pts = [(0, i, r.uniform(-50, 50), r.uniform(-50, 50), 0.0, 0.0) for i in range(80)]
    segs = [(0, 0, *(r.uniform(-60, 60) for _ in range(4))) for _ in range(40)]
    e, p = edges(spark, segs), spark.createDataFrame(pts, POINT)
    want = {(i, j) for _, i, x, y, *_ in pts for j, (_, _, a, b, c, d) in enumerate(segs) if min(a, c) - 6 <= x <= max(a, c) + 6 and min(b, d) - 6 <= y <= max(b, d) + 6}
    for cell in (6.0, 25.0):
        rows = spatial.box_join(p, spatial.with_boxes(e), 6.0, cell).select("t", "edge_idx").collect()
        assert len(rows) == len(want) and {tuple(x) for x in rows} == want


def test_recall(spark):
    c = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 1), (1, 0, 0, 1), (1, 0, 1, 0)], "trajectory_id bigint, t bigint, candidate_rank bigint, is_gt int")
    points_ = c.select("trajectory_id", "t").distinct()
    got = spatial.recall_at(c, points_, (1, 2)).first()
    assert (got["recall_at_1"], got["recall_at_2"]) == (0.5, 1.0)
    assert spatial.recall_at(c, points_.limit(0), (1,)).first()["recall_at_1"] is None


def test_asof_against_brute_force(spark):
    r = random.Random(4)
    left = [(k, r.randrange(60) / 2) for k in (1, 2, 3) for _ in range(30)]
    right = [(k, r.randrange(60) / 2, float(r.randrange(100))) for k in (1, 2) for _ in range(8)]
    got = spatial.asof_nearest(spark.createDataFrame(left, "k bigint, at double"), spark.createDataFrame(right, "k bigint, at double, v double"), "k", "at", "v", 2.0).collect()
    want = []
    for k, at in left:
        near = [(abs(b - at), b, v) for kk, b, v in right if kk == k and abs(b - at) <= 2.0]
        want.append((k, at, min(near)[2] if near else None))
    key = lambda x: (x[0], x[1], x[2] is None, x[2] or 0)
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)


GOLDEN_E = np.array([[5.0, 0], [0, 5], [0, 5]])
GOLDEN_A = np.array([[[0.0, 3], [0, 0]], [[0, 0], [0, 3]]])


def test_golden_paths():
    path, scores = decode.best_path(GOLDEN_E, GOLDEN_A)
    assert path == [0, 1, 1] and scores[-1].max() == 21
    assert decode.best_path(np.array([[10.0, -1e9]]), np.zeros((0, 2, 2)))[0] == [0]
    assert decode.best_path(np.array([[2.0, 0], [0, 2], [0, 2]]), np.array([[[2.0, -3], [-3, 2]]] * 2))[0] == [1, 1, 1]
    assert decode.best_path(np.zeros((0, 2)), np.zeros((0, 2, 2)))[0] == []


def random_lattice(r, steps, states):
    return r.normal(size=(steps, states)), r.normal(size=(max(steps - 1, 0), states, states))


def score_of(e, a, path):
    return sum(e[t, s] for t, s in enumerate(path)) + sum(a[t, p, q] for t, (p, q) in enumerate(zip(path, path[1:], strict=False)))


@pytest.mark.parametrize("seed", range(8))
def test_sequences_against_brute_force(seed):
    r = np.random.default_rng(seed)
    e, a = random_lattice(r, int(r.integers(1, 6)), int(r.integers(1, 4)))
    every = {p: score_of(e, a, p) for p in itertools.product(range(e.shape[1]), repeat=len(e))}
    best = max(every, key=every.get)
    path, _ = decode.best_path(e, a)
    assert tuple(path) == best
    weights = {p: math.exp(s) for p, s in every.items()}
    want = np.array([[sum(w for p, w in weights.items() if p[t] == s) for s in range(e.shape[1])] for t in range(len(e))]) / sum(weights.values())
    assert np.allclose(decode.posteriors(e, a), want)
    assert decode.lagged_path(e, a, len(e))[0][-1] == best[-1]
    assert decode.best_path(e, a, beam=e.shape[1])[0] == path


def lattice_rows(spark, lattices, block=decode.BLOCK):
    em, tr = [], []
    for tid, (e, a) in lattices.items():
        em += [(tid, 10 * t, s, float(e[t, s])) for t in range(len(e)) for s in range(e.shape[1])]
        tr += [(tid, t + 1, p, q, float(a[t, p, q])) for t in range(len(a)) for p in range(e.shape[1]) for q in range(e.shape[1])]
    return decode.collect_lattice(
        spark.createDataFrame(em, "trajectory_id bigint, t bigint, candidate_rank bigint, emission double"), spark.createDataFrame(tr, "trajectory_id bigint, step bigint, prev_rank bigint, curr_rank bigint, transition double"), block
    )


@pytest.mark.parametrize("block", [decode.BLOCK, 3, 1])
def test_blocks_and_kernel_agree(spark, block):
    r = np.random.default_rng(1)
    lattices = {i: random_lattice(r, int(r.integers(1, 9)), int(r.integers(1, 5))) for i in range(12)} | {99: (GOLDEN_E, GOLDEN_A)}
    rows = lattice_rows(spark, lattices, block)
    fold, kernel = decode.viterbi(rows).collect(), decode.decode(rows).collect()
    for tid, (e, a) in lattices.items():
        e, a = np.round(e, 9), np.round(a, 9)
        path, scores = decode.best_path(e, a, digits=9)
        f = sorted((x for x in fold if x["trajectory_id"] == tid), key=lambda x: x["t"])
        k = sorted((x for x in kernel if x["trajectory_id"] == tid), key=lambda x: x["t"])
        assert [x["candidate_rank"] for x in f] == [x["candidate_rank"] for x in k] == path and [x["t"] for x in f] == [10 * t for t in range(len(e))]
        assert [x["path_score"] for x in f] == pytest.approx([scores[t, s] for t, s in enumerate(path)])
        assert [x["confidence"] for x in k] == pytest.approx([decode.posteriors(e, a)[t, s] for t, s in enumerate(path)])
    away = decode.decode(lattice_rows(spark, {1: (np.full((3, 2), -50.0), np.zeros((2, 2, 2)))}), confidence="softmax", offroad=decode.Params()).collect()
    assert {(x["candidate_rank"], x["offroad"]) for x in away} == {(-1, 1)}


def test_transition_modes(spark):
    names = ["legal", "same_edge", "connected", "time_feasible", "turn_norm", "same_osm_way", "same_road_class", "route_dist_norm", "route_minus_gps_norm", "route_gps_ratio_norm", "yaw_change_norm", "candidate_rank_delta_norm", "distance_delta_norm"]
    df = spark.createDataFrame([(0.0,) * 13 + (False,), (1.0,) * 4 + (0.0,) * 9 + (True,)], ", ".join(f"{n} double" for n in names) + ", allowed boolean")
    got = {m: sorted(r["transition"] for r in decode.transition_scores(df, mode=m).collect()) for m in ("none", "soft", "hard")}
    assert got["none"] == pytest.approx([0.35 * -2.5, 0.35 * 0.8]) and got["soft"][0] == pytest.approx(0.35 * -2.5 - 0.7) and got["hard"][0] == -1e9
    with pytest.raises(ValueError):
        decode.transition_scores(df, mode="other")


def test_negatives_are_never_the_true_edge(spark):
    c = spark.createDataFrame([(0, 0, i, 1) for i in range(3)], "trajectory_id bigint, t bigint, edge_idx bigint, gt_edge_idx bigint")
    assert {r["edge_idx"] for r in lattice.negatives(c, 5).collect()} == {0, 2}


def test_edit_distance_against_the_plain_recurrence(spark):
    r = random.Random(0)
    pairs = [([r.randrange(4) for _ in range(r.randrange(9))], [r.randrange(4) for _ in range(r.randrange(9))]) for _ in range(60)]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>").select(metrics.edit_distance(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in got] == [plain(a, b) for a, b in pairs]


MATCH = "trajectory_id bigint, t bigint, pred_edge_idx bigint, gt_edge_idx bigint, pred_proj_x double, pred_proj_y double, gt_proj_x double, gt_proj_y double, confidence double"


def test_unknown_places_are_within_nothing_and_weigh_one(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0, 5, 5, 0.0, 0.0, nan, 0.0, nan), (1, 1, 5, 6, 0.0, 0.0, 3.0, 4.0, 0.2), (2, 0, 1, 1, 0.0, 0.0, 0.0, 0.0, 0.9), (2, 1, 1, 1, 9.0, 0.0, 6.0, 8.0, 0.9)], MATCH)
    j = metrics.judged(df)
    rows = {(r["trajectory_id"], r["t"]): r for r in metrics.point_weights(j).collect()}
    assert rows[1, 0]["within_10m"] is False and rows[1, 0]["low_confidence"] is False and rows[1, 0]["projection_error_m"] is None
    assert rows[1, 1]["within_5m"] and rows[1, 1]["near_but_wrong_edge"] and rows[1, 1]["low_confidence"]
    assert [rows[k]["weight_m"] for k in sorted(rows)] == [1.0, 1.0, 5.0, 5.0]
    assert metrics.point_metrics(j).first()["mean_confidence"] == pytest.approx(2 / 3)


def test_columns_by_their_aliases(spark):
    df = spark.createDataFrame([(1, 7), (1, 8)], "traj_id bigint, matched_edge_idx bigint")
    assert metrics.canonical(df).columns == ["trajectory_id", "pred_edge_idx", "t"]
    with pytest.raises(ValueError, match="a, b"):
        metrics.require(df, "b", "a")
    truth = spark.createDataFrame([(1, 0, 5)], "trajectory_id bigint, t bigint, edge bigint")
    assert metrics.join_truth(truth, truth).columns == ["trajectory_id", "t", "edge", "edge_gt"]


def test_calibration(spark):
    df = spark.createDataFrame([(c, k) for c in (0.05, 0.1, 0.95) for k in (True, False)] + [(float("nan"), True)], "confidence double, edge_correct boolean")
    got = calibration.expected_calibration_error(df).first()
    assert got["points"] == 6 and got["ece"] == pytest.approx((4 * abs(0.075 - 0.5) + 2 * 0.45) / 6)
    assert calibration.quantile_bins(df.where("confidence = 0.1")).count() == 1
    best = {r["target_precision"]: r["threshold"] for r in calibration.threshold_coverage(spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True)], "confidence double, edge_correct boolean")).collect()}
    assert best == {0.6: 0.6, 0.7: 0.6, 0.8: 0.8, 0.9: 0.8}


SEG = "k bigint, seg_no bigint, x1 double, y1 double, x2 double, y2 double, length_m double"


def test_overlap_in_closed_form_and_by_sampling(spark):
    def route(rows):
        return spark.createDataFrame([(1, i, *map(float, s), math.hypot(s[2] - s[0], s[3] - s[1])) for i, s in enumerate(rows)], SEG)

    straight, aside = route([(0, 0, 100, 0)]), route([(20, 3, 60, 3)])
    got = overlap.overlap_length(straight, aside, 5.0, "k").first()
    assert got["overlap_m"] == pytest.approx(40 + 2 * 4)  # the strip, and what the discs at its ends add
    r = random.Random(7)
    for cell in (15.0, 200.0):
        a = [tuple(r.uniform(0, 60) for _ in range(4)) for _ in range(6)]
        b = [tuple(r.uniform(0, 60) for _ in range(4)) for _ in range(5)]
        got = overlap.overlap_length(route(a), route(b), 4.0, "k", cell=cell).first()["overlap_m"]
        want = 0.0
        for x1, y1, x2, y2 in a:
            s = np.linspace(0, 1, 4001)
            px, py = x1 + s * (x2 - x1), y1 + s * (y2 - y1)
            near = np.zeros(len(s), dtype=bool)
            for qx, qy, rx, ry in b:
                t = np.clip(((px - qx) * (rx - qx) + (py - qy) * (ry - qy)) / ((rx - qx) ** 2 + (ry - qy) ** 2), 0, 1)
                near |= np.hypot(px - qx - t * (rx - qx), py - qy - t * (ry - qy)) <= 4.0
            want += near.mean() * math.hypot(x2 - x1, y2 - y1)
        assert got == pytest.approx(want, abs=0.2)
    same = overlap.route_overlap(straight, straight, 1.0, "k").first()
    assert (same["f1"], same["iou_like"], same["extra_fraction"]) == pytest.approx((1, 1, 0))
    alone = overlap.route_overlap(straight, aside.limit(0), 1.0, "k").first()
    assert (alone["correct_fraction"], alone["missed_fraction"], alone["extra_fraction"]) == (0, 1, 1)


def test_routes_from_points_and_edges(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, None, 1.0), (1, 4, 3.0, 5.0)], "k bigint, t bigint, x double, y double")
    assert sorted(r["length_m"] for r in overlap.route_from_points(df, "x", "y", "k").collect()) == [1.0, 5.0]
    used = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 77)], "k bigint, pred_edge_idx bigint")
    e = edges(spark, [(0, 1, 0, 0, 10, 0), (1, 2, 10, 0, 10, 5)])
    assert sorted(r["length_m"] for r in overlap.route_from_edges(used, e, "pred_edge_idx", "k").collect()) == [5.0, 10.0]


def test_advantages_against_the_plain_recurrence(spark):
    rewards, values = [1.0, -1.0, 0.5, 2.0], [0.1, 0.2, 0.3, 0.4]
    df = spark.createDataFrame([(1, t, r, v) for t, (r, v) in enumerate(zip(rewards, values, strict=True))], "trajectory_id bigint, t bigint, reward double, value double")
    adv, after, want = 0.0, 0.0, []
    for r, v in reversed(list(zip(rewards, values, strict=True))):
        adv = r + 0.99 * after - v + 0.99 * 0.95 * adv
        after = v
        want.append(adv)
    assert [x["advantage"] for x in learn.advantages(df).orderBy("t").collect()] == pytest.approx(want[::-1])


def test_layers(spark):
    layers = learn.seeded_layers((3, 4, 1))
    x = [[1.0, 2.0, 3.0], [0.0, 0.0, 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i bigint, x array<double>")
    assert [r["score"] for r in learn.layer_scores(df, "x", layers).orderBy("i").collect()] == pytest.approx(learn.forward(np.array(x), layers)[:, 0])
    f = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "edge_idx bigint, x array<double>")
    p = spark.createDataFrame([(0, 1), (1, 1)], "prev_edge_idx bigint, curr_edge_idx bigint")
    out = {r["edge_idx"]: r["x"] for r in learn.gather_layer(f, p, np.eye(2), np.eye(2), np.zeros(2)).collect()}
    assert out[1] == pytest.approx(list(np.maximum(learn.layer_norm(np.array([0.5, 1.5])), 0)), rel=1e-6)
    sure = spark.createDataFrame([(0, 0, 5.0, 1), (0, 0, -5.0, 0)], "trajectory_id bigint, t bigint, score double, is_gt int")
    assert learn.cross_entropy(sure).first()["loss"] < 0.01


def test_scorer_and_policy_learn_the_nearest_candidate(spark):
    r = np.random.default_rng(5)
    rows = []
    for tid in range(20):
        for t in range(6):
            d = r.uniform(0, 1, 4)
            rows += [(tid, t, k, float(d[k]), float(r.uniform()), int(k == d.argmin())) for k in range(4)]
    df = spark.createDataFrame(rows, "trajectory_id bigint, t bigint, candidate_rank bigint, d double, noise double, is_gt int")
    steps = learn.labelled_steps(df, ("d", "noise"))
    w, losses = learn.train_scorer(steps, 2, epochs=30, rate=0.5)
    assert losses[0] == pytest.approx(math.log(4)) and losses[-1] < 0.5 * losses[0] and w[0] < -3 * abs(w[1])
    best = learn.linear_scores(df, ("d", "noise"), w).groupBy("trajectory_id", "t").agg(F.max_by("is_gt", "score").alias("hit"))
    assert best.agg(F.avg(F.col("hit").cast("double"))).first()[0] > 0.9
    better = learn.improve_policy(steps, np.zeros(2), epochs=4, rate=2.0)
    assert better[0] < -0.1
    drawn = learn.rollouts(steps, w, seed=1).agg(F.avg(F.col("is_right").cast("double"))).first()[0]
    assert drawn > learn.rollouts(steps, np.zeros(2), seed=1).agg(F.avg(F.col("is_right").cast("double"))).first()[0]


def _joins(df):
    return [line.split("Join")[0].split()[-1] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line]


def test_roads_are_never_broadcast(spark, tmp_path):
    """Spark takes a small file for small whatever cells and pairs make of it, and gathers a broadcast in the driver."""
    kept = lambda df, name: (df.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    e = kept(edges(spark, [(0, 1, 0, 0, 100, 0), (1, 2, 100, 0, 200, 0)]), "edges")
    p = kept(spark.createDataFrame([(1, 0, 10.0, 5.0, 0)], "trajectory_id bigint, t bigint, x double, y double, edge_idx bigint"), "points")
    near = spatial.box_join(p.drop("edge_idx"), spatial.with_boxes(e), 20.0)
    for df, n in ((near, 1), (spatial.with_geometry(p, e), 1), (roadnet.transitions(e), 1), (roadnet.degrees(e), 4)):
        assert _joins(df) == ["SortMerge"] * n
