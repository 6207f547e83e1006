"""Toxicity by class-conditional Kneser-Ney models.

A model gives the probability of a word's characters, each from the ``ORDER`` - 1 characters before it, for toxic and
for ordinary text. At the longest order the discounted counts (documents that hold the word) are the class's own; what
the discount frees goes to shorter contexts, whose continuation counts both classes share, so that an expression that
is rare in both scores alike in both. A document's evidence is its log-likelihood ratio for each word, the mean ratio
of its strongest few words, and the logarithm of its number of different words, by which the strongest of many must be
judged; a logistic curve, fitted on rows that its counts have not seen, turns them into a score.

The counts are tables of n-grams as they are, without cells to share and without a bound, made by Spark from a table
of words. What both classes say of an n-gram comes down to one number, so a scorer needs a key and a ratio for each
n-gram and context. Those are broadcast while their counted number is within a bound; beyond it the documents' words
are joined to them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import forget, settle, text_of

ORDER = 8
DISCOUNT = 0.75
#: Pseudo-counts of the shared probabilities at the longest order.
MASS = 4.0
#: Words whose mean ratio is the second part of a document's evidence.
PEAKS = 3
#: Labelled rows, at most, on which the logistic curve is fitted (chosen by hash). The counts take all rows.
CURVE_ROWS = 20_000
#: Labels that may be broadcast to the documents (16 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: n-grams and contexts that may be broadcast (16 bytes each); more are joined to the documents' words.
BROADCAST_GRAMS = 12_000_000
#: Words whose ratios a task keeps, and words that it looks up or counts at once.
_WORDS_KEPT = 400_000
_WORDS_AT_ONCE = 20_000
_STRIPPED = ".,;:!?\"'()[]{}<>*%$#&|-_"
_START, _END = "\x01", "\x02"


def tokens(text: str | None) -> list[str]:
    """Lower-case words without surrounding punctuation."""
    return [w for w in (x.strip(_STRIPPED) for x in (text or "").lower().split()) if w]


def _padded(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words between their marks, the places of predicted characters, and each one's word."""
    flat = "".join(f"{_START * (ORDER - 1)}{w}{_END}" for w in found)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 1 for w in found), dtype=np.int64, count=len(found))
    owner = np.repeat(np.arange(len(found)), lengths)
    return codes, np.arange(len(owner)) + (owner + 1) * (ORDER - 1), owner


def _keyed(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the contexts before the places and of the n-grams that end there."""
    h = np.full(len(at), 0xCBF29CE484222325, dtype=np.uint64)
    context = h
    with np.errstate(over="ignore"):
        for back in range(ORDER - 1, -1, -1):
            context = h
            h = (h ^ codes[at - back]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return context.view(np.int64), h.view(np.int64)


@F.pandas_udf(LongType())
def _gram_key(grams: pd.Series) -> pd.Series:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return pd.Series(_keyed(codes, np.arange(len(grams)) * ORDER + ORDER - 1)[1])


@F.pandas_udf(LongType())
def _context_key(contexts: pd.Series) -> pd.Series:
    codes = np.frombuffer("".join(c + _END for c in contexts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return pd.Series(_keyed(codes, np.arange(len(contexts)) * ORDER + ORDER - 1)[0])


_COUNTS = ["fit0", "fit1", "all0", "all1"]


def _count_words(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents each word is, by class: of those that don't fit the curve, and of all."""
    counts: dict[str, list[int]] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame.from_dict(counts, orient="index", columns=_COUNTS).rename_axis("word").reset_index()
        counts.clear()
        return out

    for part in parts:
        for text, toxic, curve in zip(part["text"], part["toxic"], part["curve"], strict=True):
            for w in set(tokens(text)):
                own = counts.setdefault(w, [0, 0, 0, 0])
                own[2 + toxic] += 1
                own[toxic] += not curve
            if len(counts) > _WORDS_AT_ONCE:
                yield flush()
    if counts:
        yield flush()


def _count_grams(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words to those of their longest n-grams."""
    for part in parts:
        for lo in range(0, len(part), _WORDS_AT_ONCE):
            some = part.iloc[lo : lo + _WORDS_AT_ONCE]
            grams: list[str] = []
            for w in some["word"]:
                padded = f"{_START * (ORDER - 1)}{w}{_END}"
                grams.extend(padded[i : i + ORDER] for i in range(len(w) + 1))
            owner = np.repeat(np.arange(len(some)), some["word"].str.len().to_numpy() + 1)
            rows = some[_COUNTS].take(owner)
            rows.insert(0, "gram", grams)
            yield rows.groupby("gram", as_index=False, sort=False).sum()


def _shared(grams: DataFrame) -> DataFrame:
    """Rows (low, p): Kneser-Ney probabilities, from both classes' words alike, of the n-grams one shorter than grams.

    Each level is written, which keeps every plan to a join or two.
    """
    levels = {ORDER: grams.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = settle(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), "level")
    below = None
    for k in range(1, ORDER):
        own = levels[k].select("gram", "c", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("low"))
        of = own.groupBy("context").agg(F.sum("c").alias("t"), F.count("*").alias("kinds"))
        own = own.join(of, "context")
        own = own.join(below, "low") if below is not None else own.withColumn("p", F.lit(1 / 256))
        p = (F.col("c") - DISCOUNT) / F.col("t") + F.least(F.lit(1.0), DISCOUNT * F.col("kinds") / F.col("t")) * F.col("p")
        above = settle(own.select(F.col("gram").alias("low"), p.alias("p")), "shared")
        for done in (levels[k], below):
            if done is not None:
                forget(done)
        below = above
    return below


def _log_ratio(name: str, seen: bool) -> Column:
    """What toxic over ordinary says of an n-gram, or of one that its known context was never followed by.

    Both classes leave the same share to shorter contexts, so that what neither has seen speaks for neither.
    """
    t0, t1, k0, k1 = (F.col(f"{kind}_{name}{c}") for kind in ("t", "kinds") for c in (0, 1))
    rest = F.least(F.lit(1.0), F.greatest(F.lit(1e-6), (MASS + DISCOUNT * F.greatest(k0, k1)) / (t0 + t1 + MASS)))

    def q(c: int, t: Column, kinds: Column) -> Column:
        if not seen:
            return F.when(t > 0, rest).otherwise(1.0)
        own = F.greatest(F.col(f"{name}{c}") - DISCOUNT, F.lit(0.0)) / F.greatest(t - DISCOUNT * kinds, F.lit(DISCOUNT))
        return F.greatest(F.when(t > 0, (1 - rest) * own + rest * F.col("p")).otherwise(F.col("p")), F.lit(1e-12))

    return F.log(q(1, t1, k1) / q(0, t0, k0)).cast("float")


def ratio_table(words: DataFrame) -> DataFrame:
    """Rows (is_context, key, fit, all) from rows (word, counts): log ratios by the counts without the curve's rows, and by all."""
    counted = words.mapInPandas(_count_grams, "gram string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    grams = settle(counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "grams")
    own = grams.withColumn("context", F.substring("gram", 1, ORDER - 1))
    sums = [F.sum(c).alias(f"t_{c}") for c in _COUNTS] + [F.sum((F.col(c) > 0).cast("bigint")).alias(f"kinds_{c}") for c in _COUNTS]
    contexts = settle(own.groupBy("context").agg(*sums), "contexts")
    shared = _shared(grams)
    known = own.withColumn("low", F.substring("gram", 2, ORDER - 1)).join(shared, "low").join(contexts, "context")
    names = ["fit", "all"]
    both = known.select(F.lit(False).alias("is_context"), _gram_key("gram").alias("key"), *[_log_ratio(n, True).alias(n) for n in names])
    other = contexts.select("context", *[_log_ratio(n, False).alias(n) for n in names]).where("fit <> 0 or all <> 0")
    other = other.select(F.lit(True).alias("is_context"), _context_key("context").alias("key"), *names)
    found = settle(both.unionByName(other), "ratios")
    for done in (grams, contexts, shared):
        forget(done)
    return found


class Ratios:
    """Sorted keys of n-grams and of contexts, and their ratios."""

    def __init__(self, grams: np.ndarray, gram_ratios: np.ndarray, contexts: np.ndarray, context_ratios: np.ndarray):
        self.sides = ((contexts, context_ratios), (grams, gram_ratios))

    def of(self, found: list[str]) -> np.ndarray:
        """Log-likelihood ratio, toxic over ordinary, of each word."""
        if not found:
            return np.zeros(0)
        codes, at, owner = _padded(found)
        out = np.zeros(len(at))
        for keys, (known, ratios) in zip(_keyed(codes, at), self.sides, strict=True):
            if len(known):
                order = np.argsort(keys)
                place = np.minimum(np.searchsorted(known, keys[order]), len(known) - 1)
                hit = known[place] == keys[order]
                out[order[hit]] = ratios[place[hit]]
        return np.bincount(owner, out, minlength=len(found))

    def evidence(self, texts: Iterable[str | None], known: dict[str, float]) -> np.ndarray:
        """[texts, 3]: the mean ratio of all words, that of the strongest, and log(1 + different words)."""
        split = [tokens(t) for t in texts]
        if len(known) > _WORDS_KEPT:
            known.clear()
        new = list({w for ws in split for w in ws} - known.keys())
        for i in range(0, len(new), _WORDS_AT_ONCE):
            part = new[i : i + _WORDS_AT_ONCE]
            known.update(zip(part, self.of(part).tolist(), strict=True))
        out = np.zeros((len(split), 3))
        for i, ws in enumerate(split):
            if ws:
                different = set(ws)
                strongest = heapq.nlargest(PEAKS, (known[w] for w in different))
                out[i] = sum(known[w] for w in ws) / len(ws), sum(strongest) / PEAKS, np.log1p(len(different))
        return out


@dataclass
class Model:
    """The ratios as a table, and broadcast where they are few enough; the logistic curve's intercept and weights."""

    table: DataFrame
    shared: Any
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)


def _collected(table: DataFrame, which: str):
    """Broadcast of Ratios' arguments; the table's rows have been counted. They come in parts, one side after the other."""
    out = []
    for side in ("not is_context", "is_context"):
        rows = table.where(side).select("key", which).toArrow()
        keys, ratios = (rows.column(c).to_numpy() for c in ("key", which))
        del rows
        order = np.argsort(keys)
        out += [keys[order], ratios[order]]
        del keys, ratios, order
    shared = table.sparkSession.sparkContext.broadcast(tuple(out))
    del out
    pa.default_memory_pool().release_unused()
    return shared


_EVIDENCE = ["mean", "peak", "size"]


def _evidence_by_lookup(shared, texts: Column) -> Column:
    """Column of structs of evidence; shared is a broadcast of Ratios' arguments."""

    @F.pandas_udf("mean double, peak double, size double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        own = Ratios(*shared.value)
        for texts in batches:
            parts = [own.evidence(texts[i : i + 256], known) for i in range(0, len(texts), 256)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 3)), columns=_EVIDENCE)

    return of(texts)


def _words_of(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for u, text in zip(part["u"], part["text"], strict=True):
            found = pd.Series(tokens(text), dtype=object).value_counts()
            yield pd.DataFrame({"u": u, "word": found.index, "n": found.to_numpy()})


def _keys_of(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for lo in range(0, len(part), _WORDS_AT_ONCE):
            some = part["word"].iloc[lo : lo + _WORDS_AT_ONCE].tolist()
            codes, at, owner = _padded(some)
            contexts, grams = _keyed(codes, at)
            yield pd.DataFrame({"word": np.array(some, dtype=object)[owner], "context": contexts, "gram": grams})


def evidence_by_join(texts: DataFrame, table: DataFrame, which: str) -> DataFrame:
    """Rows (u, mean, peak, size) of rows (u, text) with words, u being the text's own: every step is a join or a sum."""
    pairs = texts.mapInPandas(_words_of, "u string, word string, n bigint")
    keys = pairs.select("word").distinct().mapInPandas(_keys_of, "word string, context bigint, gram bigint")
    grams = table.where("not is_context").select(F.col("key").alias("gram"), F.col(which).cast("double").alias("g"))
    contexts = table.where("is_context").select(F.col("key").alias("context"), F.col(which).cast("double").alias("c"))
    found = keys.join(grams, "gram", "left").join(contexts, "context", "left")
    ratios = found.groupBy("word").agg(F.sum(F.coalesce("g", "c", F.lit(0.0))).alias("r"))
    of = pairs.join(settle(ratios, "words"), "word").groupBy("u")
    strongest = F.slice(F.sort_array(F.collect_list("r"), asc=False), 1, PEAKS)  # of one document's different words
    peak = F.aggregate(strongest, F.lit(0.0), lambda a, b: a + b) / PEAKS
    return of.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("mean"), peak.alias("peak"), F.log1p(F.count("*")).alias("size"))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge: intercept and weights."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, 1.0, 1.0, -1.0
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        d = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0))


def _text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def _with_evidence(rows: DataFrame, table: DataFrame, shared, which: str, text_col: str, name: str) -> DataFrame:
    """rows with a column of evidence: looked up, or joined where the table is not broadcast."""
    text = text_of(text_col)
    if shared is not None:
        return rows.withColumn(name, _evidence_by_lookup(shared, text))
    texts = rows.select(_text_key(text).alias("u"), text.alias("text")).dropDuplicates(["u"])
    found = evidence_by_join(texts, table, which).select(F.col("u").alias("e_u"), F.struct(*_EVIDENCE).alias("e_found"))
    joined = rows.join(settle(found, "evidence"), _text_key(text) == F.col("e_u"), "left")
    none = F.struct(*[F.lit(0.0).alias(e) for e in _EVIDENCE])
    return joined.select(*[rows[c] for c in rows.columns], F.coalesce("e_found", none).alias(name))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = BROADCAST_GRAMS) -> Model:
    """A model of the labelled rows outside fold 0. The curve is fitted on fold 1 by the counts of folds 2 to 4; then fold 1 is counted too.

    Rows with a null label are no labels; of rows that repeat an id, all count. Without usable rows of both classes
    the model says 0.5 for every text. ``bound`` is the number of n-grams and contexts that may be broadcast.
    """
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = known.where(fold("l_id") != 0)
    marked = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    marked = marked.where(fold("id") != 0)
    n_known, n_curve, n_toxic = known.agg(F.count("*"), F.count(F.when(fold("l_id") == 1, 1)), F.sum("toxic")).first()
    side = F.broadcast(known) if n_known <= BROADCAST_LABELS else known
    rows = marked.join(side, marked["id"] == side["l_id"]).select("id", "text", "toxic")
    counted = rows.select("text", "toxic", (fold("id") == 1).alias("curve")).mapInPandas(_count_words, "word string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    words = settle(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "words")
    seen = words.agg(*[F.sum(c).alias(c) for c in _COUNTS]).first()
    table = ratio_table(words)
    forget(words)
    if not n_toxic or n_toxic == n_known or not seen["all0"] or not seen["all1"]:
        return Model(table.limit(0), _collected(table.limit(0), "all"))
    small = table.count() <= bound
    shared = _collected(table, "fit") if small else None
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * min(1, CURVE_ROWS / max(n_curve, 1)))
    some = rows.where((fold("id") == 1) & share).select("text", "toxic")
    curve = _with_evidence(some, table, shared, "fit", "text", "e").select("toxic", "e.*").toPandas()
    fitted = _fit_curve(curve[_EVIDENCE].to_numpy(), curve["toxic"].to_numpy().astype(float))
    if shared is not None:
        shared.destroy()
    return Model(table, _collected(table, "all") if small else None, fitted)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a toxicity score from 0 to 1; null and empty texts get the score of no evidence."""
    columns = [c for c in docs.columns if c != name]
    work = "evidence"
    while work in docs.columns:
        work = "_" + work
    found = _with_evidence(docs, model.table, model.shared, "all", text_col, work)
    start, *weights = model.curve
    line = F.lit(start)
    for w, e in zip(weights, _EVIDENCE, strict=True):
        line = line + F.lit(w) * F.col(work)[e]
    line = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))
    return found.select(*columns, (1 / (1 + F.exp(-line))).alias(name))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs that score under the threshold; columns as they came."""
    columns = docs.columns
    name = "score"
    while name in columns:
        name = "_" + name
    scored = score(docs, train(docs, labels, id_col, text_col), text_col, name)
    return scored.where(F.col(name) < threshold).select(*columns)
