"""Degrees, names and numbers of edges."""

import random

from pyspark.sql import functions as F

from roadweave.functions import tags
from roadweave.operators import ranks, roadnet

EDGES = "edge_idx bigint, edge_id string, u string, v string, bearing_rad double, length_m double, curvature double, road_class string, maxspeed double, lanes double, bridge int, tunnel int, oneway int"


def test_segment_degrees_count_predecessors_and_successors(spark):
    rows = [(i, f"e{i}", u, v, 0.0, 10.0, 1.0, "residential", 50.0, 1.0, 0, 0, 0) for i, (u, v) in enumerate([("a", "b"), ("b", "c"), ("c", "d"), ("x", "b"), ("y", "b"), ("c", "z")])]
    got = {r["edge_idx"]: (r["in_degree"], r["out_degree"]) for r in roadnet.segment_features(roadnet.degrees(spark.createDataFrame(rows, EDGES)), standard=False).collect()}
    assert got == {0: (0.0, 1.0), 1: (3.0, 2.0), 2: (1.0, 0.0), 3: (0.0, 1.0), 4: (0.0, 1.0), 5: (1.0, 0.0)}


def test_names_of_large_numbers_differ(spark):
    df = spark.createDataFrame([(7,), (123456789,), (1234567890,), (1234567891,)], "n bigint").select(tags.edge_name(F.col("n")).alias("name"))
    assert [r["name"] for r in df.collect()] == ["e_000000007", "e_123456789", "e_1234567890", "e_1234567891"]


def test_text_keys_with_one_beginning_are_dealt_to_many_ranges(spark):
    ids = [f"way/1{i:05d}" for i in range(2000)] + [None, "", "é"]
    shuffled = random.Random(1).sample(ids, len(ids))
    df = spark.createDataFrame([(i, d) for i in shuffled for d in ("rev", "fwd")], "link_id string, direction string")
    numbered = roadnet.number_edges(df, "link_id", "direction", ranges=16)
    got = {(r["link_id"], r["direction"]): r["edge_idx"] for r in numbered.collect()}
    order = sorted(got, key=lambda k: (k[0] is not None, (k[0] or "").encode(), k[1]))
    assert [got[k] for k in order] == list(range(2 * len(ids)))
    values = [i for i in ids if i is not None]
    bounds = sorted(values)[125::125]
    spread = spark.createDataFrame([(v,) for v in values], "v string").groupBy(ranks.range_of(F.col("v"), bounds).alias("r")).count().collect()
    assert max(r["count"] for r in spread) < 200


def test_edges_without_rows_have_no_numbers(spark):
    assert roadnet.number_edges(spark.createDataFrame([], "link_id bigint, direction string"), "link_id", "direction").count() == 0


def test_quantiles_of_few_and_of_many_are_the_same(spark):
    r = random.Random(2)
    values = [r.choice([r.gauss(0, 5), 3.0, -1.0]) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    one, many = ranks.quantiles(df, "v", shares).first()["q"], ranks.quantiles(df, "v", shares, ranges=16, few=100).first()["q"]
    assert [round(x, 9) for x in one] == [round(x, 9) for x in many]
    assert ranks.quantiles(df.limit(0), "v", shares).first()["q"] == []
