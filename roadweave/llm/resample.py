"""Importance resampling towards a target distribution.

Texts are bags of hashed word n-grams. A bucket's gain is the logarithm of how much likelier the target texts make it
than the documents do; a document's weight is the sum of its features' gains, and a seeded Gumbel number added to it
makes the highest scores a draw without replacement in proportion to the weights.

Features are counted batch by batch: a batch's texts are joined with a separator that no word has, one pass of a
pattern finds the words of all, and the documents' offsets say by binary search whose each word is, so that n-grams
over the end of a document are masked before they are counted. A bucket is a CRC-32, which goes on from an n-gram's
value to that of the n-gram with one word more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle, text_of

#: Bytes of text that are joined at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 22
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEPARATOR = b"\x00"
#: Words: digits, letters a to z, and all that is not ASCII, in UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Features(NamedTuple):
    """Of a batch: the document's place and the bucket of every feature, and every document's number of words."""

    doc: np.ndarray
    bucket: np.ndarray
    n_words: np.ndarray


def features(texts: list[bytes], n_min: int, n_max: int, buckets: int) -> Features:
    """All runs of n_min to n_max words of every text, joined by a space, repeats included."""
    joined = _SEPARATOR.join(texts).translate(_LOWER)
    words, starts = [], []
    for m in _WORD.finditer(joined):
        words.append(m[0])
        starts.append(m.start())
    offsets = np.cumsum([0, *(len(t) + len(_SEPARATOR) for t in texts[:-1])])
    doc = np.searchsorted(offsets, np.array(starts, dtype=np.int64), side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    docs, found = [], []
    values = list(map(crc32, words))
    following = [b" " + w for w in words] if n_max > 1 else []
    for n in range(1, n_max + 1):
        if n > 1:
            values = list(map(crc32, following[n - 1 :], values[: len(following) - n + 1]))
        if n >= n_min:
            own = doc[: len(values)]
            within = own == doc[n - 1 : n - 1 + len(values)]
            docs.append(own[within])
            found.append(np.array(values, dtype=np.int64)[within] % buckets)
    return Features(np.concatenate(docs), np.concatenate(found), n_words)


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Place of the first text and the texts of each part of a column, of bounded bytes or one text."""
    held, size, first = [], 0, 0
    for at, text in enumerate(column.cast(pa.large_binary())):
        text = text.as_py()
        if held and size + len(text) > BATCH_BYTES:
            yield first, held
            held, size, first = [], 0, at
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _counts(n_min: int, n_max: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in _batches(batch.column(0)):
                total += np.bincount(features(texts, n_min, n_max, buckets).bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", n_min: int = 1, n_max: int = 1, buckets: int = 10_000) -> DataFrame:
    """Rows (bucket, n) of the features of all texts; a task gives one row a bucket at most."""
    each = texts.select(text_of(text_col).alias("text")).mapInArrow(_counts(n_min, n_max, buckets), "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", n_min: int = 1, n_max: int = 1, buckets: int = 10_000) -> DataFrame:
    """Rows (bucket, gain), one for each of the buckets: floor(1000 ln of the ratio of both smoothed shares)."""
    raw = bucket_counts(docs, text_col, n_min, n_max, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    wanted = bucket_counts(target, target_col, n_min, n_max, buckets).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    n = settle(raw.unionByName(wanted).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    all_s, all_t = n.agg(F.sum("s"), F.sum("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    return n.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


_WEIGHED = "id bigint, n_words bigint, n_features bigint, weight bigint"


def _weights(gain: np.ndarray, n_min: int, n_max: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _batches(batch.column(1)):
                found = features(texts, n_min, n_max, len(gain))
                n = np.bincount(found.doc, minlength=len(texts))
                weight = np.bincount(found.doc, weights=gain[found.bucket], minlength=len(texts))  # whole numbers: exact
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in (found.n_words, n, weight))], names=["id", "n_words", "n_features", "weight"])

    return run


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    n_min: int = 1, n_max: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """Rows (id, n_features, weight, score, rank), one for each row of docs.

    Features of docs and of target are counted over all their rows. Of the N documents with min_words words or more
    the floor(percent * N / 100) highest scores are drawn, ties to the smaller id; rank counts them from 1 and is null
    for others. Null texts have no features and weight 0. Rows that repeat an id are judged each by its own text and
    have the same random number; a null id counts as the empty string there and is last among ties. Only the gains,
    one number for each of the buckets, are sent to all tasks. Other columns are ignored; an empty table gives no
    rows, and without target texts all gains follow from the documents' counts alone.
    """  # noqa: D205
    table = gains(docs, target, text_col, target_col, n_min, n_max, buckets)
    gain = np.zeros(buckets, dtype=np.int64)
    for r in table.collect():  # one row a bucket, whatever the input
        gain[r["bucket"]] = r["gain"]
    weighed = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(_weights(gain, n_min, n_max), _WEIGHED)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("bigint")
    drawn = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = settle(weighed.withColumn("score", F.col("weight") + drawn), "scored")
    eligible = F.col("n_words") >= min_words
    ordered = numbered(scored.where(eligible), "number", F.col("score").desc(), F.col("id").asc_nulls_last())
    most = scored.where(eligible).count() * percent // 100
    rank = F.when(F.col("number") < most, F.col("number") + 1)
    out = ["id", "n_features", "weight", "score"]
    rows = ordered.select(*out, rank.alias("rank")).unionByName(scored.where(~eligible).select(*out, F.lit(None).cast("bigint").alias("rank")))
    return rows.withColumnRenamed("id", id_col)
