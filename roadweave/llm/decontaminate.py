"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The short side is sketched and the long side is not: an item's sketch is the bottom-k of its word shingles under
one hash permutation, and a document probes the sketches with every shingle it has. Items are partitioned by size
in powers of two, and k follows from the largest size of the partition, so that a document which holds the wanted
share of an item's shingles must hold one of its k lowest. So no pair is lost however long the document, where
signatures of both sides would need a band for each shingle. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_of, words

#: Rows of a sketch or of the items' shingles that may be broadcast (about 40 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 500_000


def padded(found: Column, n: int) -> Column:
    """A word array brought to n entries by empty words, so that a shorter text has its whole sequence as one shingle."""
    short = (F.size(found) > 0) & (F.size(found) < n)
    return F.when(short, F.concat(found, F.array_repeat(F.lit(""), n - F.size(found)))).otherwise(found)


def shingled(df: DataFrame, column: str, n: int, *keep: str) -> DataFrame:
    """One row for each n-word shingle of a word array: the kept columns and w0 to w(n-1).

    The outer form of inline, and a filter after it: for the inner form Spark would split every text twice, once
    in a filter of its own on the array's size.
    """
    many = F.greatest(F.size(column) - (n - 1), F.lit(0))
    slices = [F.slice(column, k + 1, many).alias(f"w{k}") for k in range(n)]
    rows = df.select(*keep, F.inline_outer(F.arrays_zip(*slices))).toDF(*keep, *[f"w{k}" for k in range(n)])
    return rows.where("w0 is not null")


def _bounded(df: DataFrame) -> DataFrame:
    """df, with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    n_words: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """Rows (id, item_id, n_shared, n_item, containment) of all pairs whose containment reaches the threshold.

    containment is the share of the item's distinct n-word shingles that the document has anywhere. Words are
    lower-case runs of letters and digits; a text of fewer words has its whole sequence as its one shingle. Null
    and empty texts have no shingle and match nothing. Rows that share an id, or all rows without one, count as
    one document (item) with the shingles of all; each pair comes once. Empty tables give an empty result, and
    other columns are ignored, so their names can't clash.
    """
    names = [f"w{k}" for k in range(n_words)]
    d = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    q = items.select(F.col(item_id_col).alias("item"), text_of(item_text_col).alias("text"))
    item_words = q.select("item", words(F.col("text")).alias("w")).select("item", padded(F.col("w"), n_words).alias("w"))
    parts = shingled(item_words, "w", n_words, "item").distinct().withColumn("h", F.xxhash64(*names))
    sizes = parts.groupBy("item").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_list("h")).alias("hs"))
    # The size partition's upper bound, and as many lowest hashes as it needs.
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item")))
    k = F.least(upper - F.ceil(threshold * upper - 1e-9) + 1, F.col("n_item")).cast("int")
    sketch = _bounded(settle(sizes.select("item", F.explode(F.slice("hs", F.lit(1), k)).alias("h")).distinct(), "sketch"))
    doc_words = d.select("id", words(F.col("text")).alias("w")).select("id", padded(F.col("w"), n_words).alias("w"))
    probes = shingled(doc_words, "w", n_words, "id").select("id", F.xxhash64(*names).alias("h"))
    candidates = settle(probes.join(sketch, "h").select("id", "item").distinct(), "candidates")
    # Exact containment, of the candidates' documents only.
    hit = candidates.select(F.col("id").alias("hit")).distinct()
    texts = d.join(hit, d["id"].eqNullSafe(hit["hit"]), "left_semi")
    full = texts.select("id", words(F.col("text")).alias("w")).select("id", padded(F.col("w"), n_words).alias("w"))
    found = shingled(full, "w", n_words, "id")
    own = _bounded(settle(parts.select("item", *names), "shingles"))
    shared = found.join(own, names).groupBy("id", "item", *names).agg(F.count("*").alias("times"))
    counted = shared.groupBy("id", "item").agg(F.count("*").alias("n_shared"))
    of = sizes.select(F.col("item").alias("of"), "n_item")
    scored = counted.join(of, counted["item"].eqNullSafe(of["of"])).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    pairs = candidates.select(F.col("id").alias("c_id"), F.col("item").alias("c_item"))
    scored = scored.where(F.col("containment") >= threshold)
    scored = scored.join(pairs, scored["id"].eqNullSafe(pairs["c_id"]) & scored["item"].eqNullSafe(pairs["c_item"]), "left_semi")
    return scored.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "n_shared", "n_item", "containment")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that contain an item; columns as they came."""
    bad = contained_items(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("bad_id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]), "left_anti")
