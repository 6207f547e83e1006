"""How far confidences can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import known
from ..sources.shared import settle
from .ranks import quantiles


def _clean(rows: DataFrame, value: str) -> DataFrame:
    return rows.select(known(F.col(value).cast("double")).alias("v"), F.col("edge_correct").cast("double").alias("hit")).where("v IS NOT NULL AND hit IS NOT NULL")


def expected_calibration_error(rows: DataFrame, value: str = "confidence", bins: int = 10) -> DataFrame:
    """One row: the mean gap between confidence and accuracy over bins (a, b] of equal width, the lowest with its lower end."""
    clean = _clean(rows, value).withColumn("bin", F.greatest(F.ceil(F.col("v") * bins), F.lit(1)))
    own = clean.groupBy("bin").agg(F.count("*").alias("n"), F.avg("v").alias("conf"), F.avg("hit").alias("acc"))
    gap = F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")
    return own.agg(gap.alias("ece"), F.sum("n").alias("points"))


def quantile_bins(rows: DataFrame, value: str = "confidence", bins: int = 10) -> DataFrame:
    """Bins between quantiles of the value, equal edges being one: lo, hi, count, mean and accuracy of each.

    With one distinct value there is one bin. A bin holds (lo, hi], the first its lower end as well.
    """
    clean = _clean(rows, value)
    n = min(bins, clean.select("v").distinct().limit(bins).count())
    if n == 0:
        return clean.limit(0).select(F.lit(0).alias("bin"), F.col("v").alias("lo"), F.col("v").alias("hi"), F.lit(0).cast("bigint").alias("count"), F.col("v").alias("mean_value"), F.col("hit").alias("accuracy"))
    edges = quantiles(clean, "v", [i / n for i in range(n + 1)]).first()["q"]  # bins + 1 numbers
    edges = sorted(set(edges))
    if len(edges) == 1:
        edges = edges * 2
    number: Column = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        number = F.when(F.col("v") > e, i).otherwise(number)
    lo, hi = F.array(*[F.lit(e) for e in edges[:-1]]), F.array(*[F.lit(e) for e in edges[1:]])
    placed = clean.withColumn("bin", number)
    out = placed.groupBy("bin").agg(F.count("*").alias("count"), F.avg("v").alias("mean_value"), F.avg("hit").alias("accuracy"))
    return out.select("bin", lo[F.col("bin")].alias("lo"), hi[F.col("bin")].alias("hi"), "count", "mean_value", "accuracy")


def threshold_coverage(rows: DataFrame, value: str = "confidence", targets: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9), higher: bool = True, most: int = 200) -> DataFrame:
    """For each target precision the threshold that keeps most rows while their accuracy reaches it, the lower one of equals.

    Thresholds are the distinct values, or where there are more than ``most`` as many evenly spaced quantiles; so their
    number is bounded, and every row counts for the nearest threshold that keeps it. Values and thresholds are rounded
    to nine digits. Targets that nothing reaches have no row.
    """
    clean = settle(_clean(rows, value).select(F.round("v", 9).alias("v"), "hit"), "judged")  # gone through three times
    if clean.select("v").distinct().limit(most + 1).count() <= most:
        shares = clean.agg(F.sort_array(F.collect_set("v")).alias("th"))  # at most so many values
    else:
        shares = quantiles(clean, "v", [i / (most - 1) for i in range(most)]).withColumnRenamed("q", "th")
    listed = shares.select(F.array_distinct(F.transform("th", lambda x: F.round(x, 9))).alias("ths"))
    valued = clean.groupBy("v").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    placed = valued.crossJoin(F.broadcast(listed))  # a single row
    kept_by = F.filter("ths", lambda x: x <= F.col("v") if higher else x >= F.col("v"))
    own = placed.select((F.array_max(kept_by) if higher else F.array_min(kept_by)).alias("th"), "n", "hits").groupBy("th").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    every = listed.select(F.explode("ths").alias("th")).join(own, "th", "left").na.fill(0, ["n", "hits"])
    w = Window.orderBy(F.col("th").desc() if higher else F.col("th").asc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = every.select("th", F.sum("n").over(w).alias("kept"), F.sum("hits").over(w).alias("good"), F.sum("n").over(whole).alias("all")).where("kept > 0")
    each = running.withColumn("target_precision", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    fit = each.where(F.col("good") / F.col("kept") >= F.col("target_precision"))
    best = fit.groupBy("target_precision").agg(F.min_by(F.struct("th", "kept", "good", "all"), F.struct(-F.col("kept"), F.col("th"))).alias("b"))
    return best.select("target_precision", F.col("b.th").alias("threshold"), (F.col("b.good") / F.col("b.kept")).alias("precision"), (F.col("b.kept") / F.col("b.all")).alias("coverage"), F.col("b.kept").alias("kept_points"))
