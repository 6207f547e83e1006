"""Document fingerprints by MinHash.

Each of ``N_HASHES`` universal hash functions of the multiply-add-shift kind orders all word shingles; a fingerprint
has the low 16 bits of the least value of each. The share of equal values estimates the Jaccard similarity of two shingle sets. Bands
of a fingerprint are joined in Spark to find near duplicates, and the true Jaccard similarity decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, text_of
from .components import connected_components

N_HASHES = 128
N_WORDS = 5
_random = np.random.default_rng(20240229)
_A = _random.integers(1, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
_AT_ONCE = 512
#: Value of every slot for a text without words.
_NONE = np.full(N_HASHES, 0xFFFFFFFF, dtype=np.uint32)


def shingle_hashes(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """32-bit hashes of a text's word shingles (lower case, words between white space); shorter texts are one shingle."""
    found = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter(map(digest, found), dtype=np.uint64, count=len(found))
    n = max(1, len(codes) - n_words + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, len(codes) if len(codes) < n_words else n_words, dtype=np.uint64)
        for k in range(min(n_words, len(codes))):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h >> np.uint64(32)


def signature(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """The low 16 bits of a text's MinHash values; equal texts have equal ones."""
    hashes = shingle_hashes(text, n_words)
    low = _NONE
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), _AT_ONCE):
            values = (hashes[at : at + _AT_ONCE, None] * _A + _B) >> np.uint64(32)
            low = np.minimum(low, values.min(axis=0).astype(np.uint32))
    return low.astype(np.uint16)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal values, 0 to 1."""
    return float(np.count_nonzero(one == other)) / N_HASHES


def edited(text: str, following: str) -> str:
    """text with its last third of code points replaced by as many of the following text's first."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def _compared(doc: int | None, text: str, own: np.ndarray, after: str, other: np.ndarray) -> tuple:
    new = edited(text, after)
    values = signature(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc, len(text), digest, own.tobytes(), values.tobytes(), likeness(own, values), likeness(own, other))


_FIELDS = [
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_RESULT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGES = ", range int, place int, text string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _within_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row of a sorted range with the row after it; gives the range's first and last row as they are."""
    schema = pa.schema([*_FIELDS, ("range", pa.int32()), ("place", pa.int32()), ("text", pa.string())])
    number = TaskContext.get().partitionId()
    nothing = (None,) * 6
    held = None
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            own = signature(text)
            if held is None:
                rows.append((doc, *nothing, number, 0, text))
            else:
                rows.append((*_compared(*held, text, own), None, None, None))
            held = (doc, text, own)
            if len(rows) >= 500:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)
    if held is not None:
        yield _batch([(held[0], *nothing, number, 1, held[1])], schema)


def _with_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_FIELDS)
    for batch in batches:
        for doc, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield _batch([_compared(doc, text, signature(text), after, signature(after))], schema)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, beside those of its edited text and of the next document.

    The next document has the next smaller id; after the last comes the first, so that a single document is its own
    next. Null ids come last, equal ids in descending text hash. Null texts are empty. Rows are sorted in ranges of
    ids, each of which a task goes through row by row; only the first and last row of each range meet those of the
    next range, as many rows as there are ranges. Other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text").desc()]
    ranged = rows.repartitionByRange(*order[:1]).sortWithinPartitions(*order)
    found = settle(ranged.mapInArrow(_within_range, _RESULT + _EDGES), "ranges")
    ends = found.where("place is not null").select("id", "text", "range", "place")
    ring = Window.orderBy("range", "place")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("text").over(ring), F.first("text").over(whole))
    met = ends.withColumn("after", after).where("place = 1").select("id", "text", "after")
    names = [name for name, _ in _FIELDS]
    out = found.where("place is null").select(*names).unionByName(met.mapInArrow(_with_after, _RESULT))
    return out.withColumnRenamed("id", id_col)


def _near_pairs(floor: int, whole: bool):
    """Streams rows (band, value, i, j, node, sign, root) sorted by bucket; gives pairs with at least floor equal values:
    all those whose roots differ if whole, else one for each node that has any. Holds one bucket's two chunks at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, signs, roots = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            k, m, r = np.array(nodes), np.stack(signs), np.array(roots)
            linked = np.zeros(len(k), dtype=bool)
            for i in range(len(k) - 1):
                rest = np.arange(i + 1, len(k))
                rest = rest[r[rest] != r[i]] if whole else rest[~linked[rest]]
                near = rest[(m[rest] == m[i]).sum(axis=1) >= floor]
                near = near[k[near] != k[i]]
                linked[near] = True
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[i], k[near])), pa.array(np.maximum(k[i], k[near]))], schema=schema)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for *bucket, node, sign, root in zip(*cols, strict=True):
                if bucket != at and at is not None:
                    if len(nodes) > 1:
                        yield from close()
                    nodes, signs, roots = [], [], []
                at = bucket
                nodes.append(node)
                signs.append(np.frombuffer(sign, dtype=np.uint16))
                roots.append(root)
        if len(nodes) > 1:
            yield from close()

    return run


def _candidates(nodes: DataFrame, whole: bool, floor: int, rows: int, chunk: int) -> DataFrame:
    """Pairs (a, b) of rows (node, sign, root) that share a band and agree in floor values."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.substring("sign", 2 * rows * i + 1, 2 * rows)).alias("value")) for i in range(N_HASHES // rows)])
    each = nodes.select("node", "root", F.explode(bands).alias("k")).select("node", "root", "k.*")
    sizes = each.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 1 AND lo <> hi")
    each = each.join(sizes, ["band", "value"]).withColumn("parts", F.ceil(F.col("n") / chunk)).withColumn("c", F.pmod(F.xxhash64("node"), "parts"))
    dealt = each.select("node", "band", "value", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("d"))
    by = ["band", "value", "i", "j"]
    dealt = dealt.select("band", "value", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "node").join(nodes, "node")
    sorted_ = dealt.select(*by, "node", "sign", "root").repartition(*by).sortWithinPartitions(*by)
    return settle(sorted_.mapInArrow(_near_pairs(floor, whole), "a bigint, b bigint").distinct(), "pairs")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, jaccard) of the pairs that reach the threshold; texts has node and text."""
    hashes = F.pandas_udf(lambda s: s.map(lambda t: np.unique(shingle_hashes(t)).astype(np.int64).tolist()), "array<bigint>")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", hashes("text").alias("s"))
    sets = settle(sets, "shingles")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    jaccard = common / (F.size("sa") + F.size("sb") - common)
    return settle(both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, rows: int = 4, chunk: int = 1024) -> DataFrame:
    """Rows (id, class_id, component_id, n_links), one for each row of docs.

    Equal texts are one class, named by its smallest id; classes whose five-word shingle sets have Jaccard similarity
    of threshold or more are linked, and component_id is the smallest id that links reach. Bands of ``rows`` values are
    joined in Spark, a bucket of over ``chunk`` members as pairs of chunks. One candidate for each text is verified
    first, then every candidate pair that this left apart: n_links counts a class's verified links of both, which
    connect a group but are not all of its pairs. Texts without words are a class of their own without links; rows
    with a null id count by their text and have null or the class's smallest id. Other columns take no part.
    """
    sign = F.pandas_udf(lambda s: s.map(lambda t: signature(t).tobytes()), "binary")
    known = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).withColumn("node", F.xxhash64("text"))
    least = settle(known.groupBy("node").agg(F.min("id").alias("class_id")), "classes")
    texts = known.where("trim(text) <> ''").select("node", "text")
    nodes = settle(texts.dropDuplicates(["node"]).select("node", sign("text").alias("sign")), "signatures")
    floor = int(N_HASHES * (threshold - 0.2))
    first = _verified(_candidates(nodes.withColumn("root", F.col("node")), False, floor, rows, chunk), texts, threshold)
    placed = nodes.join(connected_components(first, "a", "b"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = first.unionByName(_verified(_candidates(settle(placed, "placed"), True, floor, rows, chunk), texts, threshold))
    counted = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    rooted = least.join(connected_components(links, "a", "b"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    about = settle(rooted.join(named, "root").join(counted, "node", "left").select("node", "class_id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "members")
    return known.select("id", "node").join(about, "node").select(F.col("id").alias(id_col), "class_id", "component_id", "n_links")
