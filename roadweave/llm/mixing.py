"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree (domain, language, source). Among siblings it is shared by weight; a node that has
fewer tokens than its share gives the rest back to its siblings, and only what a whole family can't use goes to the
family's own siblings. Each leaf then takes whole epochs, if its share exceeds what it has, and of the next epoch's
seeded order the longest prefix that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, settle, text_of

#: Buckets of a leaf's order, as hex digits of its hash; only the bucket in which the share ends is ordered by row.
DIGITS = 3


def count_tokens(text: Column) -> Column:
    """Words between spaces, tabs and line ends."""
    return F.size(F.array_remove(F.split(text, "[ \t\n\r]+"), "")).cast("bigint")


def _weight(level: str, weights: dict[str, float]) -> Column:
    """The weight of a node by its name; 1 where none is given."""
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def share_out(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """leaves (levels, capacity) with their share of the budget, level by level from the root."""
    parents = None
    for depth, level in enumerate(levels):
        path, up = levels[: depth + 1], levels[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").cast("double").alias("cap"))
        nodes = nodes.withColumn("w", _weight(level, weights.get(level, {}))).where("w > 0")
        nodes = nodes.join(parents, up) if parents is not None else nodes.withColumn("given", F.lit(float(budget)))
        family = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
        order = family.orderBy(F.col("cap") / F.col("w"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        nodes = nodes.withColumn("w_left", F.sum("w").over(onward))
        nodes = nodes.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("given") - F.col("used")))
        taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(family)
        rest = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(family)
        nodes = nodes.withColumn("taken", taken).withColumn("rest", rest)
        share = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * (F.col("given") - F.col("taken")) / F.col("rest"))
        parents = nodes.select(*path, share.alias("given"))
    return leaves.join(parents.withColumnRenamed("given", "share"), levels)


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, float]],
    part: float = 0.6,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float | None = None,
) -> DataFrame:
    """Rows (id, text hash, levels, n_tokens, copies), one for each distinct id and text of each leaf.

    copies is how often the document is taken, 0 for never. The budget is a number of tokens or a part of all the
    documents'. Null levels count as "(none)"; null texts have no tokens. Nodes of weight 0 take nothing and their
    documents have 0 copies. Rows that repeat an id and text in a leaf count once. Ties in the seeded order go by id,
    then text hash. An empty table gives an empty result.
    """
    names = list(levels)
    path = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in levels.items()]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("t"), *path, count_tokens(text_of(text_col)).alias("n_tokens"))
    rows = settle(rows.distinct(), "tokens")
    if budget is None:
        budget = part * (rows.agg(F.sum("n_tokens")).first()[0] or 0)
    # A row for each leaf, and one for each bucket of a leaf: written once, where every use would else plan the tree again.
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * max_epochs)
    leaves = settle(leaves, "leaves")
    shares = share_out(leaves, names, weights, budget).select(*names, "tokens", F.floor("share").alias("quota"))
    shares = shares.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0))
    shares = settle(shares.withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens")), "shares")
    placed = rows.join(shares, names, "left")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    placed = placed.withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = placed.where("full is not null").groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("own"), F.first("rest").alias("r"))
    upto = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("own").over(upto))
    last = settle(sums.select(*names, "bucket", (F.col("end") - F.col("own")).alias("start"), "end"), "buckets")
    placed = placed.join(last, [*names, "bucket"], "left")
    whole = F.coalesce(F.col("full"), F.lit(0))
    sure = F.col("full").isNull() | (F.col("end") <= F.col("rest")) | (F.col("start") > F.col("rest"))
    inside = F.coalesce(F.col("end") <= F.col("rest"), F.lit(False))
    settled = placed.where(sure).withColumn("copies", whole + inside.cast("bigint"))
    cut = placed.where(~sure)
    running = Window.partitionBy(*names, "bucket").orderBy("key", "id", "t").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("copies", whole + (F.col("start") + F.sum("n_tokens").over(running) <= F.col("rest")).cast("bigint"))
    out = ["id", "t", *names, "n_tokens", "copies"]
    both = settled.select(*out).unionByName(cut.select(*out))
    return both.withColumnRenamed("id", id_col)


def take(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The chosen rows of docs with their columns, and copies (underscores before it if docs has the name)."""
    picked = mix(docs, levels, weights, id_col=id_col, text_col=text_col, **options).where("copies > 0")
    work = fresh(docs.columns, "p_id", "p_t", *[f"p_{n}" for n in levels], "copies")
    p_id, p_t, copies = work[0], work[1], work[-1]
    picked = picked.select(F.col(id_col).alias(p_id), F.col("t").alias(p_t), *[F.col(n).alias(w) for n, w in zip(levels, work[2:-1], strict=True)], F.col("copies").alias(copies))
    same = docs[id_col].eqNullSafe(picked[p_id]) & (F.xxhash64(text_of(text_col)) == picked[p_t])
    for (_, c), w in zip(levels.items(), work[2:-1], strict=True):
        same = same & (F.coalesce(c.cast("string"), F.lit("(none)")) == picked[w])
    return docs.join(picked, same).select(*[docs[c] for c in docs.columns], copies)
