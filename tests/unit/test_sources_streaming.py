import glob
import os
import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from roadweave.operators import decode
from roadweave.plans import catalog
from roadweave.sources import readers, writers
from roadweave.streaming import matcher, windows

DATA = "/root/testdata/sf0.001"


def test_points_and_routes_from_csv(spark, tmp_path):
    (tmp_path / "points.csv").write_text("id,time,geometry\n1,2024-01-01T00:00:00Z,POINT (11.925816 50.301888)\n")
    r = readers.read_points(spark, f"{tmp_path}/points.csv", 32).first()
    assert (r["trajectory_id"], r["x"], r["y"]) == (1, pytest.approx(708352.1323, abs=1e-3), pytest.approx(5576291.6269, abs=1e-3))
    (tmp_path / "bad.csv").write_text("id,time,geometry\n1,2024-01-01T00:00:00Z,LINE\n")
    with pytest.raises(Exception, match="not a point"):
        readers.read_points(spark, f"{tmp_path}/bad.csv").collect()
    (tmp_path / "less.csv").write_text("id,time\n1,2\n")
    with pytest.raises(ValueError, match="geometry"):
        readers.read_points(spark, f"{tmp_path}/less.csv")
    (tmp_path / "gt.csv").write_text('id,WKT\n4,"LINESTRING (0 0, 3 4, 3 5)"\n')
    route = readers.read_routes(spark, f"{tmp_path}/gt.csv").first()
    assert route["gt_length_m"] == 6.0 and '"max_y":5.0' in route["gt_bounds"]


def test_tables_ids_matches_and_shapes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 7), (2, 0, 8)], "trajectory_id bigint, t bigint, edge_idx bigint")
    for kind in ("parquet", "csv", "jsonl"):
        writers.write_table(df, f"{tmp_path}/t.{kind}")
        assert sorted(map(tuple, readers.read_table(spark, f"{tmp_path}/t.{kind}").select(*df.columns).collect())) == [(1, 0, 7), (2, 0, 8)]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.pickle")
    (tmp_path / "ids.txt").write_text("3\n\n 4 \n")
    assert sorted(r[0] for r in readers.read_ids(spark, f"{tmp_path}/ids.txt").collect()) == [3, 4]
    os.makedirs(f"{tmp_path}/m")
    df.coalesce(1).toPandas().to_parquet(f"{tmp_path}/m/hmm_matches.parquet")
    assert {r["model"] for r in readers.read_match_files(spark, f"{tmp_path}/m").collect()} == {"hmm"}
    writers.write_table(df.repartition(2), f"{tmp_path}/m/gnn_matches.parquet")
    writers.write_table(df.withColumn("confidence", F.lit(0.5)), f"{tmp_path}/m/deeper/sac_matches.parquet")
    tables = lambda **o: sorted(map(tuple, readers.read_match_files(spark, f"{tmp_path}/m", **o).groupBy("model").agg(F.count("*"), F.count("trajectory_id")).collect()))
    assert tables() == [("gnn", 2, 2), ("hmm", 2, 2)] and tables(recursive=True) == [("gnn", 2, 2), ("hmm", 2, 2), ("sac", 2, 2)]
    with pytest.raises(ValueError, match="no match tables"):
        readers.read_match_files(spark, f"{tmp_path}/m/deeper/sac_matches.parquet")
    summary = readers.episode_summary(readers.read_episodes(spark, f"{tmp_path}/t.parquet")).first()
    assert (summary["episodes"], summary["labelled_points"], summary["max_candidates"]) == (2, 0, 1)
    lines = spark.createDataFrame([(5, [(0.0, 1.0), (2.0, 3.0)])], "edge_idx bigint, line array<struct<x:double,y:double>>")
    feature = writers.features(lines).first()[0]
    (tmp_path / "c.json").write_text('{"type": "FeatureCollection", "features": [' + feature + "]}")
    back = readers.read_geojson(spark, f"{tmp_path}/c.json").first()
    assert back["edge_idx"] == 5 and [(p["x"], p["y"]) for p in back["line"]] == [(0.0, 1.0), (2.0, 3.0)]
    assert writers.write_metrics(df.agg(F.count("*").alias("n")), f"{tmp_path}/m.json", workflow="hmm") == {"n": 2, "workflow": "hmm"}


STREAM = "trajectory_id bigint, t bigint, ts timestamp, candidate_rank bigint, edge_idx bigint, emission double"


def streamed(spark, tmp_path, batches, transitions, lag, late):
    """What the matcher gives of batches of rows, one file each and in that order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, STREAM).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = []
    matcher.publish(matcher.match_stream(stream, transitions, lag, late), lambda df, i: seen.extend(df.collect()), f"{tmp_path}/cp").awaitTermination(240)
    return seen


def test_stream_in_any_order_gives_the_lagged_path(spark, tmp_path):
    r = random.Random(3)
    edges, pairs, lag, n = [10, 11, 12, 13], [(10, 11), (11, 12), (12, 10), (13, 11)], 4, 12
    at = lambda t: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)
    rows, emissions, moves = [], [], []
    for tid in (7, 8):
        before = None
        for t in range(n):
            some = r.sample(edges, r.randint(1, 4))
            for k, e in enumerate(some):
                score = round(r.gauss(0, 2), 6)
                rows.append((tid, t, at(t), k, e, score))
                emissions.append((tid, t, k, score))
            if before is not None:
                moves += [(tid, t, p, q, 0.35 if a == b or (a, b) in pairs else -0.7) for p, a in enumerate(before) for q, b in enumerate(some)]
            before = some
    lattice = decode.collect_lattice(spark.createDataFrame(emissions, "trajectory_id bigint, t bigint, candidate_rank bigint, emission double"), spark.createDataFrame(moves, "trajectory_id bigint, step bigint, prev_rank bigint, curr_rank bigint, transition double"))
    want = sorted((x["trajectory_id"], x["t"], x["candidate_rank"], round(x["path_score"], 6)) for x in decode.decode(lattice, mode="fixed_lag", lag=lag, k=4).collect())
    r.shuffle(rows)
    close = [(99, 0, at(1000), 0, 10, 0.0)]  # a later time, by which all steps are decided
    late = [(7, 3, at(3), 0, 10, 50.0), (7, 50, at(2), 0, 10, 50.0)]  # behind the watermark
    odd = [(None, 1, at(1), 0, 10, 1.0), (7, 1, None, 0, 10, 1.0), (7, 1, at(1), 0, None, 9.0)]
    transitions = spark.createDataFrame(pairs, "prev_edge_idx bigint, curr_edge_idx bigint")
    got = streamed(spark, tmp_path, [rows[:25] + odd, rows[25:], close, late], transitions, lag, "1 minute")
    assert sorted((x["trajectory_id"], x["t"], x["candidate_rank"], round(x["path_score"], 6)) for x in got) == want
    own = {(x[0], x[1], x[3]): x[4] for x in rows}
    assert all(x["edge_idx"] == own[x["trajectory_id"], x["t"], x["candidate_rank"]] and x["ts"].replace(tzinfo=timezone.utc) == at(x["t"]) for x in got)


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type", "value", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "ts", "1 day", "event_type", "value", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, windows.tumbling(events, "ts", "1 day", "event_type", "value").collect()))
    assert windows.sessions(events, "ts", "1 hour", "user_id").agg(F.sum("events")).first()[0] == events.count()


def test_entry_names_and_columns(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(3).count() == 3


CHEAP = ["traj_kinematics", "road_degrees", "line_graph_transitions", "candidates_topk", "candidate_recall", "hmm_emission", "point_metrics", "mm2_criteria", "threshold_coverage", "asof_nearest",
         "bent_candidates", "bent_bearings", "edges_cleaned", "segment_features", "speed_tags", "route_report", "route_sources", "forward_bearings", "first_trajectories", "canonical_matches",
         "candidates_retried", "osm_extract_roads", "route_dissolved", "stream_fixed_lag", "match_scores", "geodesic_links", "candidates_geometry", "policy_evaluation",
         "threshold_margin", "threshold_entropy", "margin_bins", "viterbi_path", "posterior_conf", "viterbi_fixed_lag"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", CHEAP)
def test_queries_equal_their_sql(spark, db, name):
    found = catalog.queries()[name](spark, DATA)
    want = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    near = lambda rows: sorted(tuple(None if v is None else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert sorted(names) == sorted(found.columns)
    filled = lambda rows: [tuple(-1 if v is None else v for v in r) for r in rows]  # noqa: E731  # nulls of any type
    assert str(near(filled(found.select(*names).collect()))) == str(near(filled(want.fetchall())))


def test_match_scores_equal_their_sql_to_six_digits(spark, db):
    found = catalog.queries()["match_scores"](spark, DATA)
    want = db.execute(catalog.oracle_sql()["match_scores"])
    names = [d[0] for d in want.description]
    by_step = lambda rows: {(r[0], r[1]): tuple(r) for r in rows}
    got, wanted = by_step(found.select(*names).collect()), by_step(want.fetchall())
    assert got == wanted and len(got) > 900
