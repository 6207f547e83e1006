"""Exact quantiles without gathering all values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle


#: Values that one task may gather (a few ten megabytes); more are dealt to ranges.
FEW = 500_000


def range_of(value: Column, bounds: list, lo: int = 0) -> Column:
    """The number of bounds below a value, by a choice that halves them at each step."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    return F.when(value > F.lit(bounds[mid]), range_of(value, bounds[mid + 1 :], lo + mid + 1)).otherwise(range_of(value, bounds[:mid], lo))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], ranges: int = 64, few: int = FEW) -> DataFrame:
    """One row with q, the values' quantiles at the shares, interpolated between neighbours; null values don't count.

    The values are written and counted. Up to ``few`` of them are put in order by one task. More are dealt to ranges by
    approximate quantiles of their own, counted within each range, and shifted by the counts of the ranges before: a
    task sees one range, and only the counts of ranges meet. Without values q is empty.
    """
    known = settle(df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), "values")
    if known.count() <= few:
        wanted = F.array(*[F.lit(float(s)) for s in shares])
        return known.agg(F.coalesce(F.percentile("v", wanted), F.array().cast("array<double>")).alias("q"))
    found = known.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("b")).first()["b"]
    placed = known.select("v", range_of(F.col("v"), sorted(set(found))).alias("range"))
    counted = placed.groupBy("range", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    sizes = counted.groupBy("range").agg(F.sum("n").alias("size"))  # a row for each range
    whole = Window.orderBy("range")
    before = F.coalesce(F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shift = sizes.select("range", before.alias("before"), total.alias("total"))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(shift), "range")
    last = F.col("before") + F.col("upto") - 1
    exact = lambda s: s * (F.col("total") - 1)
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    places = [F.transform(wanted, lambda s, i: F.struct(i.alias("i"), F.lit(side).alias("side"), end(exact(s)).cast("bigint").alias("place"), (exact(s) - F.floor(exact(s))).alias("part"))) for side, end in ((0, F.floor), (1, F.ceil))]
    own = F.filter(F.concat(*places), lambda x: (x["place"] > last - F.col("n")) & (x["place"] <= last))
    hit = ranked.select("v", F.explode(own).alias("x")).groupBy("x.i")  # a row for each share and side
    ends = hit.agg(F.max(F.when(F.col("x.side") == 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("x.side") == 1, F.col("v"))).alias("hi"), F.max("x.part").alias("part"))
    each = ends.select(F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q")).alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("q"))
