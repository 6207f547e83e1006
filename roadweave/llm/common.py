"""What the operators of this subpackage share: tables, written cuts of lineage, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of our own, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/roadweave-{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, kind)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # the table stands for its shuffles from here on
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, as an array without empty entries."""
    cut = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_remove(cut, "")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Working column names that clash with none of columns."""
    taken = set(columns)
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def numbered(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """df, written, with its rows numbered from 0 in the given order as column.

    Rows are sorted in ranges, so no task holds more than a range; only the sizes of the ranges meet, as many numbers
    as there are ranges. Rows that are equal in order are numbered in any order.
    """
    place, part, start = fresh([*df.columns, column], "place", "part", "start")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(ranged.withColumn(place, F.monotonically_increasing_id()), "ordered")
    number = F.shiftright(place, 33).alias(part)  # of the range; the other bits count the rows within it
    sizes = rows.groupBy(number).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    rows = rows.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(starts), part)
    return rows.withColumn(column, F.col(start) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop(part, place, start)
