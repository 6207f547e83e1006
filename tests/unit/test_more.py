"""Blocks of long trajectories, lines, and tables of other origin."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from roadweave.functions import geometry, projection, tags
from roadweave.operators import decode, learn, metrics, roadnet

from .test_operators import lattice_rows, random_lattice


def test_fixed_lag_over_blocks(spark):
    r = np.random.default_rng(5)
    lattices = {i: random_lattice(r, 11, 3) for i in range(3)}
    got = [sorted(map(tuple, decode.decode(lattice_rows(spark, lattices, b), mode="fixed_lag", lag=4).select("trajectory_id", "step", "candidate_rank").collect())) for b in (decode.BLOCK, 5)]
    assert got[0] == got[1] and len(got[0]) == 33


def test_advantages_over_blocks(spark):
    r = np.random.default_rng(6)
    rows = [(i, t, float(r.normal()), float(r.normal())) for i in range(4) for t in range(1 + 7 * i)]
    df = spark.createDataFrame(rows, "trajectory_id bigint, t bigint, reward double, value double")
    want = {}
    for i in range(4):
        own, last, after = [x for x in rows if x[0] == i], 0.0, 0.0
        for _, t, reward, value in reversed(own):
            last = reward + 0.99 * after - value + 0.99 * 0.95 * last
            after, want[i, t] = value, (last, last + value)
    for block in (4096, 3):
        got = {(x["trajectory_id"], x["t"]): (x["advantage"], x["target"]) for x in learn.advantages(df, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_lines(spark):
    points = [(0.0, 0.0), (4.0, 3.0), (4.0, 10.0), (9.0, 10.0)]
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])
    got = spark.range(1).select(
        geometry.project_to_line(F.lit(5.0), F.lit(8.0), line).alias("p"), geometry.bearing_at(line, F.lit(8.5), 1.0).alias("b"), geometry.bearing_at(F.slice(line, 1, 1), F.lit(0.0)).alias("none"),
        geometry.simplify(line, 100.0).alias("ends"), geometry.simplify(line, 0.0).alias("all"), geometry.geometry_type(F.lit("multilinestring ((0 0, 1 1))")).alias("type"), geometry.geometry_type(F.lit("POINT (0 0)")).alias("point"),
    ).first()
    assert (got["p"]["distance"], got["p"]["seg_no"], got["p"]["x"], got["p"]["y"], got["p"]["offset"]) == pytest.approx((1.0, 1, 4.0, 8.0, 10.0))
    assert got["b"] == pytest.approx(np.pi / 2) and got["none"] == 0
    assert [tuple(p) for p in got["ends"]] == [points[0], points[-1]] and len(got["all"]) == 4 and (got["type"], got["point"]) == ("MultiLineString", None)


def test_speeds_and_names(spark):
    row = spark.range(1).select(
        tags.speed_mps(F.lit("signals 30 mph")).alias("mph"), tags.speed_mps(F.lit("36;50")).alias("kmh"), tags.speed_mps(F.lit(4.0), numeric=True).alias("mps"), tags.speed_mps(F.lit(36.0), numeric=True).alias("number"),
        tags.speed_mps(F.lit(None).cast("double"), numeric=True).alias("none"), tags.edge_name(F.lit(7)).alias("name"),
    ).first()
    assert tuple(row) == (pytest.approx(13.4112), pytest.approx(10.0), 4.0, pytest.approx(10.0), 13.89, "e_000000007")


def test_candidates_of_other_origin(spark):
    df = spark.createDataFrame([(1, 0, 7, 2.0, 0.0), (1, 0, 5, 1.0, 0.0), (1, 1, 5, 1.0, 0.0)], "trajectory_id int, t int, road_segment_idx int, distance_m double, yaw double")
    got = sorted((r["t"], r["candidate_rank"], r["edge_idx"], r["edge_id"], r["is_gt"], r["cos_yaw"]) for r in metrics.canonical_candidates(df).collect())
    assert got == [(0, 0, 5, "5", False, 1.0), (0, 1, 7, "7", False, 1.0), (1, 0, 5, "5", False, 1.0)]
    with pytest.raises(ValueError, match="edge_idx"):
        metrics.canonical_candidates(df.drop("road_segment_idx"))


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_numbers_follow_the_order(spark, kind):
    df = spark.range(300).select((F.col("id") * 7919 % 300).cast(kind).alias("k"), F.lit("a").alias("d")).repartition(7)
    got = [r["k"] for r in roadnet.number_edges(df, "k", "d", ranges=5).orderBy("edge_idx").collect()]
    assert got == sorted(got) and len(got) == 300


def test_documents_states_and_lattices(spark, tmp_path):
    from roadweave.sources import readers, writers

    df = spark.createDataFrame([(1, 0, 0, 1, 7), (1, 0, 1, 0, 8), (1, 1, 0, 0, 9)], "trajectory_id bigint, t bigint, candidate_rank bigint, is_gt int, edge_idx bigint")
    report = writers.write_candidates(df, df.select("trajectory_id", "t").distinct(), f"{tmp_path}/c.parquet", f"{tmp_path}/r.json")
    assert report["recall_at_1"] == 0.5 and readers.read_document(spark, f"{tmp_path}/r.json")["recall_at_3"] == 0.5
    assert readers.read_table(spark, f"{tmp_path}/c.parquet").count() == 3
    assert [writers.write_state(spark, {"w": [1.0]}, {"accuracy": a}, f"{tmp_path}/m", "accuracy") for a in (0.5, 0.5, 0.7)] == [True, False, True]
    assert readers.read_document(spark, f"{tmp_path}/m/best.json")["metrics"] == {"accuracy": 0.7}
    lattice = lattice_rows(spark, {1: random_lattice(np.random.default_rng(1), 5, 2)}, 2)
    writers.write_lattices(lattice, f"{tmp_path}/l.parquet")
    back = readers.read_lattices(spark, f"{tmp_path}/l.parquet")
    assert sorted(map(tuple, decode.viterbi(back).collect())) == sorted(map(tuple, decode.viterbi(lattice).collect()))
    writers.write_schema(df, f"{tmp_path}/s.csv")
    assert readers.read_table(spark, f"{tmp_path}/s.csv").count() == 0 and readers.read_document(spark, f"{tmp_path}/s.csv.schema.json")["fields"][0]["name"] == "trajectory_id"
    with pytest.raises(ValueError, match="missing"):
        readers.conformed(df, {"nothing": "int"})
    assert readers.conformed(df, {"edge_idx": "string"}, "edge_idx").first()["edge_idx"] == "7"
    assert readers.one_trajectory(df, "1").count() == 3
    with pytest.raises(ValueError, match="no trajectory"):
        readers.one_trajectory(df, 2)
    two = spark.createDataFrame([(1, "train"), (1, "test")], "trajectory_id bigint, split string")
    with pytest.raises(ValueError, match="share"):
        writers.write_splits(df, two, f"{tmp_path}/x.parquet")


def test_geojson_there_and_back(spark, tmp_path):
    from roadweave.sources import readers, writers

    line = [(0.0, 0.0), (1.0, 2.0)]
    df = spark.createDataFrame([(3, line)], f"edge_idx bigint, line array<{geometry.POINT}>")
    writers.write_geojson(df, f"{tmp_path}/g.geojson")
    back = readers.read_geojson(spark, f"{tmp_path}/g.geojson").first()
    assert back["edge_idx"] == 3 and [tuple(p) for p in back["line"]] == line


def test_geodesic_bearings(spark):
    """Known azimuths: along a meridian and the equator, and Flinders Peak to Buninyong (306 52' 05.37\")."""
    dms = lambda d, m, s: (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)
    rows = [(11.0, 50.0, 11.0, 51.0), (11.0, 50.0, 11.0, 49.0), (10.0, 0.0, 11.0, 0.0), (10.0, 0.0, 9.0, 0.0), (dms(144, 25, 29.52440), dms(-37, 57, 3.72030), dms(143, 55, 35.38390), dms(-37, 39, 10.15610)), (5.0, 5.0, 5.0, 5.0), (0.0, 0.1, 179.9, -0.05)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    got = [r["x"] for r in df.orderBy("i").select(projection.geodesic_bearing(*ends).alias("x")).collect()]
    assert got[:4] == pytest.approx([math.pi / 2, -math.pi / 2, 0.0, -math.pi], abs=1e-9)
    assert got[4] == pytest.approx(math.radians(90 - dms(306, 52, 5.37) + 360), abs=5e-8) and got[5] == 0.0 and got[6] is None


def test_edges_are_judged_by_places_where_there_are_no_edges(spark):
    rows = [(1, 2, 2, 0.0, 0.0, 3.0, 4.0, 0.9), (1, 1, 2, 0.0, 0.0, 0.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "trajectory_id bigint, pred_candidate_pos bigint, gt_candidate_pos bigint, pred_proj_x double, pred_proj_y double, gt_proj_x double, gt_proj_y double, confidence double")
    assert [r["edge_correct"] for r in metrics.judged(df).collect()] == [True, False]
    assert [r["edge_correct"] for r in metrics.judged(df.drop("gt_candidate_pos")).collect()] == [False, False]
    assert [r["edge_correct"] for r in metrics.judged(df.withColumns({"pred_edge_idx": F.lit(1), "gt_edge_idx": F.lit(1)})).collect()] == [True, True]


def test_constrained_decoding_and_scores_by_step(spark):
    e = spark.createDataFrame([(1, 0, 0, 5.0, True), (1, 0, 1, 9.0, False), (1, 1, 0, 0.0, True), (1, 1, 1, 1.0, None), (1, 2, 0, 0.0, True), (1, 2, 1, 2.0, True)], "trajectory_id bigint, t bigint, candidate_rank bigint, emission double, ok boolean")
    a = spark.createDataFrame([(1, s, p, c, 0.1 * (2 * p + c), not (s == 2 and c == 1)) for s in (1, 2) for p in (0, 1) for c in (0, 1)], "trajectory_id bigint, step bigint, prev_rank bigint, curr_rank bigint, transition double, legal boolean")
    path = lambda e, a: [r["candidate_rank"] for r in decode.viterbi(decode.collect_lattice(e, a), 2).orderBy("t").collect()]
    assert path(e, a) == [1, 1, 1]
    held, moves = decode.constrain(e, a, "ok", "legal")
    assert path(held, moves) == [0, 0, 0] and path(*decode.constrain(e, a, valid="ok")) == [0, 0, 1] and path(*decode.constrain(e, a, mask="legal")) == [1, 1, 0]
    rows = decode.with_transition_scores(decode.viterbi(decode.collect_lattice(e, a), 2), a).orderBy("t").collect()
    assert [r["transition_score"] for r in rows] == [None, pytest.approx(0.3), pytest.approx(0.3)]


def test_scores_by_step_are_those_that_the_path_adds_up(spark):
    e = spark.createDataFrame([(1, t, 0, x) for t, x in enumerate((-1.1531624996, 2.0000000014, -6.9018814999))], "trajectory_id bigint, t bigint, candidate_rank bigint, emission double")
    a = spark.createDataFrame([(1, 1, 0, 0, -1.5270724999999996), (1, 2, 0, 0, 0.1234567894)], "trajectory_id bigint, step bigint, prev_rank bigint, curr_rank bigint, transition double")
    path = decode.viterbi(decode.collect_lattice(e, a), 1)
    rows = decode.with_emissions(decode.with_transition_scores(path, a), e).orderBy("t").collect()
    assert [r["emission"] for r in rows] == [-1.1531625, 2.000000001, -6.9018815]
    assert [r["transition_score"] for r in rows] == [None, -1.5270725, 0.123456789]
    assert rows[-1]["path_score"] == rows[-1]["total_score"] == pytest.approx(sum(r["emission"] + (r["transition_score"] or 0) for r in rows), abs=1e-12)
