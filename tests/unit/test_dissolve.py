"""Routes that run back over themselves, against unit steps of a grid counted one by one."""

import math
import random

import pytest

from roadweave.operators import overlap

KIND = "k int, seg_no bigint, x1 double, y1 double, x2 double, y2 double, length_m double"


def walk(r, n):
    """A walk along a grid, in runs of 1 to 6 units, which often turns back."""
    x = y = 0
    out = []
    for _ in range(n):
        dx, dy = r.choice([(1, 0), (-1, 0), (0, 1), (0, -1)])
        run = r.randint(1, 6)
        out.append((x, y, x + dx * run, y + dy * run))
        x, y = x + dx * run, y + dy * run
    return out


def units(segments):
    found = set()
    for x1, y1, x2, y2 in segments:
        n = abs(x2 - x1) + abs(y2 - y1)
        sx, sy = (x2 - x1) // n, (y2 - y1) // n
        for i in range(n):
            found.add(tuple(sorted(((x1 + sx * i, y1 + sy * i), (x1 + sx * (i + 1), y1 + sy * (i + 1))))))
    return found


def turned(x, y, angle):
    """Places of a map: turned, and millions of metres from the origin."""
    return 700_000 + x * math.cos(angle) - y * math.sin(angle), 5_500_000 + x * math.sin(angle) + y * math.cos(angle)


def frame(spark, routes, angle):
    rows = []
    for k, segs in routes.items():
        for i, (x1, y1, x2, y2) in enumerate(segs):
            a, b = turned(x1, y1, angle), turned(x2, y2, angle)
            rows.append((k, i, *a, *b, math.dist(a, b)))
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("angle", [0.0, 0.3, math.pi / 2, 2.9])
def test_every_part_counts_once(spark, angle):
    r = random.Random(7)
    routes = {k: walk(r, 40) for k in range(4)} | {9: [(0, 0, 5, 0), (3, 0, 8, 0), (8, 0, 2, 0), (10, 0, 12, 0)]}
    got = overlap.dissolve(frame(spark, routes, angle), "k").collect()
    length = {k: sum(x["length_m"] for x in got if x["k"] == k) for k in routes}
    assert length == {k: pytest.approx(len(units(s)), abs=1e-5) for k, s in routes.items()}
    assert all(x["length_m"] == pytest.approx(math.dist((x["x1"], x["y1"]), (x["x2"], x["y2"])), abs=1e-6) for x in got)
    assert sorted(round(x["length_m"], 5) for x in got if x["k"] == 9) == [2.0, 8.0]
    assert overlap.dissolve(frame(spark, routes, angle).limit(0), "k").count() == 0


def test_overlap_of_routes_that_run_back(spark):
    r = random.Random(11)
    one, two = {k: walk(r, 30) for k in range(3)}, {k: walk(r, 30) for k in range(3)}
    a, b = frame(spark, one, 0.4), frame(spark, two, 0.4)
    got = {x["k"]: x for x in overlap.route_overlap(a, b, 0.25, "k", once=True).collect()}
    for k in one:
        p, t = units(one[k]), units(two[k])
        whole = lambda segs: sum(abs(c - e) + abs(d - f) for c, d, e, f in segs)
        assert got[k]["pred_length_m"] == pytest.approx(whole(one[k])) and got[k]["gt_length_m"] == pytest.approx(whole(two[k]))
        # A shared unit lies within the tolerance as a whole, and a quarter of any other from each end that the other route passes.
        for own, other, name in ((p, t, "pred_overlap_m"), (t, p, "gt_overlap_m")):
            passed = {e for u in other for e in u}
            want = sum(1 if u in other else 0.25 * sum(e in passed for e in u) for u in own)
            assert got[k][name] == pytest.approx(want, abs=1e-4)
    back = frame(spark, {1: [(0, 0, 10, 0), (10, 0, 0, 0)]}, 0.0)
    assert overlap.route_overlap(back, back, 1.0, "k").first()["correct_fraction"] == 1.0
    assert overlap.route_overlap(back, back, 1.0, "k", once=True).first()["correct_fraction"] == 0.5


def test_lines_are_merged_where_two_meet(spark):
    segs = {1: [(0, 0, 1, 0), (2, 0, 1, 0), (2, 0, 2, 5), (2, 0, 9, 0), (9, 0, 9, 9)], 2: [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)]}
    got = overlap.merge_lines(frame(spark, segs, 0.0), "k").collect()
    shape = lambda line: [(round(p["x"] - 700_000), round(p["y"] - 5_500_000)) for p in line]
    lines = sorted((x["k"], min(shape(x["line"]), shape(x["line"])[::-1])) for x in got)
    assert lines == [(1, [(0, 0), (1, 0), (2, 0)]), (1, [(2, 0), (2, 5)]), (1, [(2, 0), (9, 0), (9, 9)]), (2, [(0, 0), (1, 0), (1, 1), (0, 0)])]
    assert sum(x["length_m"] for x in got if x["k"] == 1) == pytest.approx(1 + 1 + 5 + 7 + 9)
