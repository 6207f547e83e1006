import math

import pytest
from pyspark.sql import functions as F

from roadweave.functions import angles, geometry, projection, tags


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_angles_wrap_into_their_range(spark):
    rows = spark.createDataFrame([(x * math.pi,) for x in (-4.0, -1.0, 0.0, 1.0, 4.0, 0.999)], "a double").select(angles.wrap(F.col("a"))).collect()
    assert all(-math.pi <= r[0] < math.pi for r in rows)
    assert rows[3][0] == pytest.approx(-math.pi)
    lit = lambda d: F.lit(math.radians(d))
    got = one(spark, angles.between(lit(359.0), lit(1.0)), angles.turn(lit(350.0), lit(10.0)), angles.quaternion_yaw(*[F.lit(v) for v in (0.0, 0.0, math.sin(0.4), math.cos(0.4))]))
    assert [math.degrees(got[0]), math.degrees(got[1]), got[2]] == pytest.approx([2, 20, 0.8])


def test_unknown_values_are_null(spark):
    nan, inf = float("nan"), float("inf")
    got = spark.createDataFrame([(1.0,), (nan,), (inf,), (-inf,), (None,)], "v double").select(angles.known(F.col("v"))).collect()
    assert [r[0] for r in got] == [1.0, None, None, None, None]


def test_point_on_a_line(spark):
    p = geometry.project_to_segment(*[F.lit(float(v)) for v in (5, 3, 0, 0, 10, 0)])
    got = one(spark, p["distance"], p["x"], p["y"], p["share"])
    assert tuple(got) == (3.0, 5.0, 0.0, 0.5)
    point = geometry.project_to_segment(*[F.lit(float(v)) for v in (5, 3, 1, 0, 1, 0)])
    assert one(spark, point["distance"])[0] == 5.0


def test_lines_as_text(spark):
    text = F.lit("MULTILINESTRING ((0 0, 3 4), (3 4, 6 8), (7 8, 7 9))")
    line = geometry.join_parts(geometry.parse_lines(text))
    got = one(spark, geometry.line_length(line), F.size(line), geometry.line_text(line), geometry.line_bearing(line), geometry.curvature(line), geometry.curvature(line, True))
    assert got[0] == pytest.approx(12.0) and got[1] == 5 and got[2].startswith("LINESTRING (0.0 0.0, 3.0 4.0")
    assert got[4] == pytest.approx(12 / math.hypot(7, 9)) and got[5] == pytest.approx(got[4] - 1)
    odd = one(spark, geometry.parse_lines(F.lit("POINT (1 2)")), geometry.parse_lines(F.lit(None).cast("string")), *geometry.point_xy(F.lit("POINT (11.5 -50.25)")), *geometry.point_xy(F.lit("nothing")))
    assert tuple(odd) == (None, None, 11.5, -50.25, None, None)


def test_interpolation_and_sampling(spark):
    line = geometry.join_parts(geometry.parse_lines(F.lit("LINESTRING (0 0, 10 0, 10 10)")))
    df = spark.range(1).select(line.alias("l"))
    got = df.select(*[geometry.interpolate(F.col("l"), F.lit(float(o))).alias(f"p{i}") for i, o in enumerate((-1, 4, 10, 15, 99))]).first()
    assert [(p["x"], p["y"]) for p in got] == [(0, 0), (4, 0), (10, 0), (10, 5), (10, 10)]
    assert one(spark, geometry.sample_offsets(F.lit(10.0), 5.0), geometry.sample_offsets(F.lit(0.0), 5.0), geometry.sample_offsets(F.lit(11.0), 5.0, False)) == ([0, 5, 10], [], [0, 5, 10])
    with pytest.raises(ValueError):
        geometry.sample_offsets(F.lit(1.0), 0)


def test_utm(spark):
    lon, lat = F.lit(11.925816), F.lit(50.301888)
    x, y = projection.to_utm(lon, lat, 32)
    df = spark.range(1).select(x.alias("x"), y.alias("y"))
    back = projection.from_utm(F.col("x"), F.col("y"), 32)
    got = df.select("x", "y", *back).first()
    assert tuple(got) == pytest.approx((708352.1323, 5576291.6269, 11.925816, 50.301888), abs=1e-4)
    assert abs(got[2] - 11.925816) < 1e-9 and abs(got[3] - 50.301888) < 1e-9
    assert tuple(one(spark, projection.utm_code(F.lit(11.9), F.lit(50.3)), projection.utm_code(F.lit(-180.0), F.lit(-1.0)), projection.utm_zone(F.lit(180.0)))) == ("EPSG:32632", "EPSG:32701", 60)


def test_geodesic_distance(spark):
    # One degree of latitude at the equator, and of longitude along it, on the ellipsoid.
    got = one(spark, projection.geodesic_m(*[F.lit(float(v)) for v in (0, 0, 0, 1)]), projection.geodesic_m(*[F.lit(float(v)) for v in (0, 0, 1, 0)]), projection.geodesic_m(*[F.lit(float(v)) for v in (5, 5, 5, 5)]))
    assert tuple(got) == pytest.approx((110574.3886, 111319.4908, 0.0), abs=1e-3)


def test_tags(spark):
    text = ["yes", "-1", "no", None, "Reversible ", "roundabout"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    rows = df.select(tags.says_oneway(F.col("t")), tags.says_oneway(F.col("t"), True), tags.runs_backwards(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(True, True, False), (True, True, True), (False, False, False), (False, False, False), (True, False, False), (False, True, False)]
    got = one(spark, tags.first_value(F.lit("primary;service")), tags.first_value(F.lit(None).cast("string")), tags.first_number(F.lit("50 mph")), tags.first_number(F.lit("x"), 1.0), tags.speed_mps(F.lit("30 mph")), tags.speed_mps(F.lit("36")), tags.speed_mps(F.lit("walk")), tags.flag(F.lit("True")))
    assert tuple(got) == pytest.approx(("primary", "unknown", 50.0, 1.0, 13.4112, 10.0, 13.89, 1))
    assert [tags.threshold_name(v) for v in (5.0, 2.5)] == ["5", "2p5"]


def _text(spark, column):
    row = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, [(0.0, 0.0), (10.0, 0.0)])], f"a double, b double, c double, d double, line array<{geometry.POINT}>")
    return row.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_geodesics_work_out_their_steps_once(spark):
    ends = [F.col(c) for c in "abcd"]
    for column in (projection.geodesic_m(*ends), projection.geodesic_bearing(*ends)):
        assert _text(spark, column).count("tan(") <= 4  # two latitudes, a round and the end; over 700 when each use had its own


def test_lines_are_cut_and_measured_once(spark):
    line, at = F.col("line"), F.col("a")
    assert _text(spark, geometry.interpolate(line, at)).count("sqrt(") <= 4  # 78 when each use cut the line again
    assert _text(spark, geometry.bearing_at(line, at)).count("sqrt(") <= 6  # 184


def test_points_are_placed_on_a_segment_once(spark):
    assert _text(spark, geometry.project_to_line(F.col("a"), F.col("b"), F.col("line"))).count("least(1.0") == 1  # a share along each segment
