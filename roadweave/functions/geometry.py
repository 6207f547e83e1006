"""Lines as columns: arrays of structs (x, y), and the text form they are stored in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once however often it stands in it: in a lambda Spark shares nothing by itself."""
    return F.transform(F.array(value), of)[0]


def point_xy(text: Column) -> tuple[Column, Column]:
    """x and y of a POINT text; null where it isn't one."""
    pattern = rf"(?i)^\s*POINT\s*Z?\s*\(\s*({_NUMBER})\s+({_NUMBER})"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    return part(1), part(2)


def _vertices(text: Column) -> Column:
    pairs = F.split(text, r"\s*,\s*")
    return F.transform(pairs, lambda p: F.struct(
        F.regexp_extract(p, rf"({_NUMBER})\s+({_NUMBER})", 1).try_cast("double").alias("x"),
        F.regexp_extract(p, rf"({_NUMBER})\s+({_NUMBER})", 2).try_cast("double").alias("y"),
    ))


def parse_lines(text: Column) -> Column:
    """Parts of a LINESTRING or MULTILINESTRING text, as array<array<struct<x,y>>>; null for anything else."""
    bare = F.regexp_replace(text, r"(?i)^\s*(MULTI)?LINESTRING\s*Z?\s*\(+|\)+\s*$", "")
    parts = F.transform(F.split(bare, r"\)\s*,\s*\("), _vertices)
    return F.when(F.regexp_like(text, F.lit(r"(?i)^\s*(MULTI)?LINESTRING\s*Z?\s*\(.*\)\s*$")), parts)


def join_parts(parts: Column) -> Column:
    """One line of all parts in order; a part's first vertex is left out where it repeats the last one's end."""

    def add(line: Column, part: Column) -> Column:
        meets = (F.size(line) > 0) & (F.element_at(line, -1) == part[0])
        return F.concat(line, F.when(meets, F.slice(part, F.lit(2), F.size(part))).otherwise(part))

    return F.aggregate(parts, F.array().cast(f"array<{POINT}>"), add)


def _over_segments(line: Column, of: Callable[[Column, Column], Column]) -> Column:
    """An array with one value for each pair of neighbouring vertices."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), of)


def _step(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(b["x"] - a["x"], F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2)))


def line_length(line: Column) -> Column:
    """Length; 0 for a null or single vertex."""
    return F.coalesce(F.aggregate(_over_segments(line, _step), F.lit(0.0), lambda s, d: s + d), F.lit(0.0))


def chord(line: Column) -> Column:
    """Distance from first to last vertex."""
    return _step(line[0], F.element_at(line, -1))


def line_bearing(line: Column) -> Column:
    """Direction from first to last vertex; 0 under two vertices."""
    a, b = line[0], F.element_at(line, -1)
    return F.when(F.size(line) < 2, 0.0).otherwise(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def curvature(line: Column, excess: bool = False) -> Column:
    """Length over chord, 1 for closed lines; or what it exceeds 1 by, 0 for closed lines."""
    straight = chord(line)
    if excess:
        return F.when((F.size(line) < 3) | (straight <= 1e-9), 0.0).otherwise(F.greatest(line_length(line) / straight - 1, F.lit(0.0)))
    return F.when(straight <= 1e-9, 1.0).otherwise(line_length(line) / straight)


def reverse_line(line: Column) -> Column:
    return F.reverse(line)


def line_text(line: Column) -> Column:
    """The LINESTRING text of a line."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, pair), ", "), F.lit(")"))


def segments(line: Column) -> Column:
    """Array of structs (seg_no, x1, y1, x2, y2, cum): cum is the length before the segment."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"), _step(a, b).alias("d")))
    # One pass: each length is the last one's and its own segment's.
    grown = lambda upto, p: F.concat(upto, F.array(F.element_at(upto, -1) + p["d"]))
    cums = F.aggregate(pairs, F.array(F.lit(0.0)).cast("array<double>"), grown)
    return F.zip_with(F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), F.slice(cums, F.lit(1), n), lambda s, cum: F.struct(
        s["i"].alias("seg_no"), s["p"]["a"]["x"].alias("x1"), s["p"]["a"]["y"].alias("y1"), s["p"]["b"]["x"].alias("x2"), s["p"]["b"]["y"].alias("y2"), cum.alias("cum"),
    ))


def interpolate(line: Column, offset: Column) -> Column:
    """The point at an offset along the line, clamped to its ends."""
    return once(F.struct(segments(line).alias("parts"), line_length(line).alias("size")), lambda v: _point_at(v["parts"], v["size"], offset))


def _point_at(parts: Column, size: Column, offset: Column) -> Column:
    """interpolate for a line whose segments() and length are known already."""

    def between(v: Column) -> Column:
        at, hit = v["at"], v["hit"]
        length = F.sqrt(F.pow(hit["x2"] - hit["x1"], F.lit(2)) + F.pow(hit["y2"] - hit["y1"], F.lit(2)))
        share = once(length, lambda n: F.when(n > 0, F.least((at - hit["cum"]) / n, F.lit(1.0))).otherwise(0.0))
        return once(share, lambda k: F.struct((hit["x1"] + k * (hit["x2"] - hit["x1"])).alias("x"), (hit["y1"] + k * (hit["y2"] - hit["y1"])).alias("y")))

    last = lambda at: F.element_at(F.filter(parts, lambda s: s["cum"] <= at), -1)
    clamped = F.greatest(F.least(offset, size), F.lit(0.0))
    return once(clamped, lambda at: once(F.struct(at.alias("at"), last(at).alias("hit")), between))


def sample_offsets(length: Column, spacing: float, include_end: bool = True) -> Column:
    """Offsets every so far along a line, and its end; none for a line without length."""
    if spacing <= 0:
        raise ValueError("spacing must be positive")
    n = F.ceil(length / spacing).cast("int")
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(float(spacing)))
    whole = F.concat(steps, F.array(length)) if include_end else steps
    return F.when(length > 0, whole).otherwise(F.array().cast("array<double>"))


def project_to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Share along the segment, clamped to [0, 1], nearest point, and distance to it."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    share = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(0.0)
    x, y = x1 + share * dx, y1 + share * dy
    return {"share": share, "x": x, "y": y, "distance": F.sqrt((px - x) * (px - x) + (py - y) * (py - y))}


def nearest_on(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, seg_no: Column, cum: Column) -> Column:
    """Struct (near, seg_no, distance, x, y, offset) of the nearest point of a segment that begins at cum of its line."""
    p = project_to_segment(px, py, x1, y1, x2, y2)
    size = F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    found = [p["distance"].alias("distance"), p["x"].alias("x"), p["y"].alias("y"), (cum + p["share"] * size).alias("offset")]
    return F.struct(F.round(p["distance"], 9).alias("near"), seg_no.alias("seg_no"), *found)


def project_to_segments(px: Column, py: Column, parts: Column) -> Column:
    """project_to_line for a line whose segments() are known already, as for a road that many points meet."""

    def nearest(s: Column) -> Column:
        """nearest_on of a segment, each of its steps worked out once."""
        x1, y1, dx, dy = s["x1"], s["y1"], s["x2"] - s["x1"], s["y2"] - s["y1"]
        share = once(dx * dx + dy * dy, lambda n: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / n))).otherwise(0.0))
        place = lambda k: F.struct((x1 + k * dx).alias("x"), (y1 + k * dy).alias("y"), (s["cum"] + k * F.sqrt(dx * dx + dy * dy)).alias("offset"))
        far = lambda p: F.sqrt((px - p["x"]) * (px - p["x"]) + (py - p["y"]) * (py - p["y"]))
        found = lambda p, d: F.struct(F.round(d, 9).alias("near"), s["seg_no"].alias("seg_no"), d.alias("distance"), *[p[c].alias(c) for c in ("x", "y", "offset")])
        return once(once(share, place), lambda p: once(far(p), lambda d: found(p, d)))

    return F.array_min(F.transform(parts, nearest))


def project_to_line(px: Column, py: Column, line: Column) -> Column:
    """Struct (distance, seg_no, x, y, offset): the nearest point of a line, of the first segment that is as near.

    Null for a line without segments.
    """
    return project_to_segments(px, py, segments(line))


def bearing_at(line: Column, offset: Column, window: float = 5.0) -> Column:
    """Direction of a line around an offset, from so far before it to so far after it; the whole line's where it is too short."""

    def around(v: Column) -> Column:
        size, lo, hi = v["size"], v["lo"], v["hi"]
        ends = F.struct(*[_point_at(v["parts"], size, at).alias(name) for name, at in (("a", lo), ("b", hi))])
        local = once(ends, lambda e: F.atan2(e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"]))
        return F.when(size <= 0, 0.0).when(F.abs(hi - lo) < 1e-6, line_bearing(line)).otherwise(local)

    reach = lambda size: F.struct(
        segments(line).alias("parts"), size.alias("size"), F.greatest(offset - window, F.lit(0.0)).alias("lo"), F.least(offset + window, size).alias("hi"),
    )
    return once(once(line_length(line), reach), around)


def geometry_type(text: Column) -> Column:
    """LineString or MultiLineString as a text says, null for anything else."""
    name = F.upper(F.regexp_extract(text, r"(?i)^\s*((?:MULTI)?LINESTRING)\s*Z?\s*\(", 1))
    return F.when(name == "LINESTRING", "LineString").when(name == "MULTILINESTRING", "MultiLineString")


def simplify(line: Column, tolerance: float) -> Column:
    """The line without vertices that lie within the tolerance of what is left (Douglas and Peucker); ends always stay."""

    @F.pandas_udf(f"array<{POINT}>")
    def of(lines: pd.Series) -> pd.Series:
        return lines.map(lambda v: None if v is None else [v[i] for i in _kept_vertices(np.array([(p["x"], p["y"]) for p in v], dtype=float), tolerance)])

    return of(line)


def _kept_vertices(xy: np.ndarray, tolerance: float) -> list[int]:
    if len(xy) < 3:
        return list(range(len(xy)))
    keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        d = xy[hi] - xy[lo]
        rest = xy[lo + 1 : hi] - xy[lo]
        share = np.clip(rest @ d / max(d @ d, 1e-300), 0, 1)
        far = np.hypot(*(rest - share[:, None] * d).T)
        worst = int(far.argmax())
        if far[worst] > tolerance:
            at = lo + 1 + worst
            keep.add(at)
            todo += [(lo, at), (at, hi)]
    return sorted(keep)
