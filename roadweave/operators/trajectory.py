"""Points in time order: kinematics, gap fills, path lengths and reports.

Every window is over one trajectory, so all of them share one shuffle by trajectory_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import bearing, distance, wrap
from .ranks import quantiles

ID = "trajectory_id"


def seconds_between(before: Column, after: Column) -> Column:
    """Seconds with microseconds, which differences of unix_timestamp lose."""
    return (F.unix_micros(after.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6


def ordinal(points: DataFrame, *order: str, name: str = "t") -> DataFrame:
    """Position within the trajectory, from 0."""
    w = Window.partitionBy(ID).orderBy(*order)
    return points.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))


def fill_gaps(value: str, method: str = "ffill_bfill", order: str = "t", fallback: float = 0.0) -> Column:
    """Fills nulls of a column in trajectory order.

    ffill_bfill takes the last known value, else the next; nearest takes the closer by position, the earlier if both
    are as close; zero takes the fallback, which also serves trajectories without any value.
    """
    w = Window.partitionBy(ID).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    c = F.col(value)
    before, after = F.last(c, True).over(back), F.first(c, True).over(ahead)
    if method == "zero":
        return F.coalesce(c, F.lit(fallback))
    if method == "ffill_bfill":
        return F.coalesce(before, after, F.lit(fallback))
    if method == "nearest":
        place = F.when(c.isNotNull(), F.col(order))
        gap_before = F.col(order) - F.last(place, True).over(back)
        gap_after = F.first(place, True).over(ahead) - F.col(order)
        return F.coalesce(F.when(gap_before <= F.coalesce(gap_after, gap_before), before).otherwise(F.coalesce(after, before)), after, F.lit(fallback))
    raise ValueError(f"unknown fill method {method}")


def kinematics(points: DataFrame, min_step_m: float = 0.25, fill: str = "ffill_bfill", max_speed: float | None = None, tie: str = "point_id") -> DataFrame:
    """Adds t, steps and times to both neighbours, yaw and speed.

    Yaw looks ahead where the next point is later and at least min_step_m away, else back; speed looks ahead where the
    next point is later, however near. What is then unknown is filled in trajectory order. Points of one time keep the
    order of the tie column.
    """
    w = Window.partitionBy(ID).orderBy("ts", tie)
    lag = lambda c: F.lag(c).over(w)
    lead = lambda c: F.lead(c).over(w)
    x, y, ts = F.col("x"), F.col("y"), F.col("ts")
    steps = points.withColumns({
        "t": (F.row_number().over(w) - 1).cast("bigint"),
        "dt_prev_s": seconds_between(lag("ts"), ts), "dt_next_s": seconds_between(ts, lead("ts")),
        "step_prev_m": distance(lag("x"), lag("y"), x, y), "step_next_m": distance(x, y, lead("x"), lead("y")),
        "bearing_prev": bearing(lag("x"), lag("y"), x, y), "bearing_next": bearing(x, y, lead("x"), lead("y")),
    })
    moves = lambda side: (F.col(f"dt_{side}_s") > 0) & (F.col(f"step_{side}_m") >= min_step_m)
    rate = lambda side: F.when(F.col(f"dt_{side}_s") > 0, F.col(f"step_{side}_m") / F.col(f"dt_{side}_s"))
    raw = steps.withColumns({
        "yaw": F.coalesce(F.when(moves("next"), F.col("bearing_next")), F.when(moves("prev"), F.col("bearing_prev"))),
        "speed_mps": F.coalesce(rate("next"), rate("prev")),
    })
    filled = raw.withColumns({"yaw": wrap(fill_gaps("yaw", fill)), "speed_mps": fill_gaps("speed_mps", fill)})
    if max_speed is not None:
        filled = filled.withColumn("speed_mps", F.least(F.greatest(F.col("speed_mps"), F.lit(0.0)), F.lit(max_speed)))
    return filled.withColumn("yaw_deg", F.degrees("yaw")).drop("bearing_prev", "bearing_next")


def yaw_changes(points: DataFrame) -> DataFrame:
    """Adds yaw_change: the wrapped turn since the point before, 0 for the first."""
    w = Window.partitionBy(ID).orderBy("t")
    return points.withColumn("yaw_change", F.coalesce(wrap(F.col("yaw") - F.lag("yaw").over(w)), F.lit(0.0)))


def path_lengths(points: DataFrame) -> DataFrame:
    """Adds step_m and cum_m, the way travelled so far."""
    w = Window.partitionBy(ID).orderBy("t")
    step = F.coalesce(distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")), F.lit(0.0))
    stepped = points.withColumn("step_m", step)
    return stepped.withColumn("cum_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def course_over_ground(points: DataFrame, still: float = 1e-9) -> DataFrame:
    """Adds course: the bearing from the point before (for the first point, to the next); 0 where nothing moved."""
    w = Window.partitionBy(ID).orderBy("t")
    first = F.col("t") == 0
    dx = F.when(first, F.lead("x").over(w) - F.col("x")).otherwise(F.col("x") - F.lag("x").over(w))
    dy = F.when(first, F.lead("y").over(w) - F.col("y")).otherwise(F.col("y") - F.lag("y").over(w))
    still_there = (F.abs(dx) < still) & (F.abs(dy) < still)
    return points.withColumn("course", F.coalesce(F.when(~still_there, F.atan2(dy, dx)), F.lit(0.0)))


def drop_repeats(points: DataFrame, column: str) -> DataFrame:
    """Rows whose value differs from that of the row before in the trajectory."""
    w = Window.partitionBy(ID).orderBy("t")
    before = F.lag(column).over(w)
    return points.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(column))).drop("_before")


def report(points: DataFrame) -> DataFrame:
    """One row: counts, lengths of trajectories, coordinate ranges, times that don't advance, and speeds."""
    sizes = points.groupBy(ID).agg(F.count("*").alias("n"))
    lengths = sizes.agg(
        F.count("*").alias("trajectories"), F.min("n").alias("min_points"), F.percentile("n", F.lit(0.5)).alias("median_points"),
        F.avg("n").alias("mean_points"), F.max("n").alias("max_points"),
    )
    whole = points.agg(
        F.count("*").alias("points"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.count_if((F.col("dt_prev_s") <= 0)).alias("stalled"), F.avg("speed_mps").alias("mean_speed"),
        F.max("speed_mps").alias("max_speed"),
    )
    speeds = quantiles(points, "speed_mps", [0.5, 0.95]).select(F.get("q", F.lit(0)).alias("median_speed"), F.get("q", F.lit(1)).alias("p95_speed"))
    return lengths.crossJoin(whole).crossJoin(speeds)  # single rows


def split_by_hash(ids: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Assigns every trajectory to train, val or test by a seeded hash, which stays the same however many there are."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ID).cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / 2**32
    return ids.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def split_exact(ids: list[int], train: float = 0.7, val: float = 0.15, seed: int = 42) -> dict[int, str]:
    """Assigns sorted ids by numpy's seeded shuffle and half-even rounding; for id lists that fit on the driver."""
    import numpy as np

    order = np.array(sorted(ids))
    np.random.default_rng(seed).shuffle(order)
    a = int(round(len(order) * train))
    b = a + int(round(len(order) * val))
    return {int(i): "train" if k < a else "val" if k < b else "test" for k, i in enumerate(order)}


def forward_bearings(points: DataFrame, min_step_m: float = 0.0) -> DataFrame:
    """Adds bearing: the direction to the next point, the last one having that of the one before it.

    Steps shorter than the least one have none and take the nearest point's that has one, the earlier of two as near;
    without any the bearing is 0. points has trajectory_id, t (from 0 without gaps), x and y.
    """
    w = Window.partitionBy("trajectory_id").orderBy("t")
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    own = F.when(F.sqrt(dx * dx + dy * dy) >= min_step_m, F.atan2(dy, dx))
    first = points.withColumn("_b", own).withColumn("_last", F.lead("x").over(w).isNull())
    first = first.withColumn("_b", F.when(F.col("_last"), F.lag("_b").over(w)).otherwise(F.col("_b")))
    seen = F.when(F.col("_b").isNotNull(), F.struct("t", "_b"))
    sides = first.withColumns({
        "_before": F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first(seen, True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    back, ahead = F.col("t") - F.col("_before.t"), F.col("_after.t") - F.col("t")
    near = F.when(ahead.isNull() | (back <= ahead), F.col("_before._b")).otherwise(F.col("_after._b"))
    return sides.withColumn("bearing", wrap(F.coalesce(near, F.lit(0.0)))).drop("_b", "_last", "_before", "_after")


def first_ids(points: DataFrame, by: str, order: str, n: int = 12) -> DataFrame:
    """The first n distinct values of a column in the order in which they appear, with the place of each."""
    return points.groupBy(by).agg(F.min(order).alias("first_seen")).orderBy("first_seen", by).limit(n)


def overlap_of(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The keys that two splits share: none, if they are disjoint."""
    return one.select(key).intersect(other.select(key))
