"""Near-duplicates by min-max hashing.

Under each of ``N_HASHES`` universal hash functions a document's shingle set keeps its least and its greatest value, so
that a signature of 128 values costs 64 evaluations a shingle; each value of two signatures agrees with the
probability of the sets' Jaccard similarity, and both ends of one function agree no more often together than two
functions would. Bands of five values, nearly all of the least or of the greatest alone, are joined in Spark. Of two
sets at the threshold of 0.85, all 25 bands differ once in two million cases. Size, a sketch of parities and the number of equal values
rule most candidates out where they meet, and the full sets decide about the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, text_of
from .components import connected_components
from .simhash import parity_sketch

N_HASHES = 64
N_WORDS = 3
#: Values of a band, and bands.
ROWS = 5
BANDS = 2 * N_HASHES // ROWS
#: Of the bands, every so many serve for the first forest.
FIRST_STEP = 4
#: Members of a bucket that one task compares at once; larger buckets are dealt to pairs of chunks.
CHUNK = 1024
#: Equal values of 128 that a candidate needs: at a similarity of 0.85 fewer are found once in 10^10 cases.
FLOOR = 76
#: Candidates' keys that are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000
_random = np.random.default_rng(20250117)
_A = _random.integers(1, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
_AT_ONCE = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z are lower-cased, words are runs without ASCII white
    space, fewer words than n_words are one shingle, and a text without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    wide = min(n_words, len(codes))
    n = len(codes) - wide + 1
    h = np.full(n, wide, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(wide):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least, then of the greatest value of a set under each function."""
    low = np.full(N_HASHES, 0xFFFFFFFF, dtype=np.uint64)
    high = np.zeros(N_HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), _AT_ONCE):
            values = (hashes[at : at + _AT_ONCE, None] * _A + _B) >> np.uint64(32)
            low = np.minimum(low, values.min(axis=0))
            high = np.maximum(high, values.max(axis=0))
    return np.concatenate([low, high]).astype(np.uint16)


def set_key(hashes: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; nothing for the empty one."""
    return hashlib.sha256(hashes.tobytes()).digest()[:16] if len(hashes) else None


_SIGNED = "id bigint, n bigint, key binary, sign binary, sketch binary"
_SIGNED_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sign", pa.binary()), ("sketch", pa.binary())])


def _signed(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), n_words)
                key = set_key(hashes)
                rows.append((len(hashes), key, signature(hashes).tobytes() if key else None, parity_sketch(hashes) if key else None))
            columns = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SIGNED_SCHEMA)[1:], strict=True))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(columns, schema=_SIGNED_SCHEMA)

    return run


def _sets(n_words: int):
    """Sets of (text, wanted keys): a row for each text whose own key is the wanted one."""
    schema = pa.schema([("key", pa.binary()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                hashes = shingle_set(text.as_py(), n_words)
                key = set_key(hashes)
                if key == wanted.as_py():
                    keys.append(key)
                    sets.append(hashes.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def _near_pairs(whole: bool, percent: int, floor: int):
    """Streams rows (bucket, i, j, no, c, key, n, sign, sketch, root) sorted by bucket and key; gives pairs of keys that
    neither size nor sketch rules out and that have floor equal values: all those whose roots differ if whole, each in
    the first band alone in which it meets, else one for each key that has any. Holds one bucket's two chunks (c is
    either of i and j) at a time."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    apart = (100 - percent) / (100 + percent) + 1e-9  # of both sizes, what is in one set only

    def meet_first(m: np.ndarray, i: int, near: np.ndarray, no: int) -> np.ndarray:
        """Of the places near, those that no band before this one brings together with place i."""
        same = (m[near, : ROWS * no] == m[i, : ROWS * no]).reshape(len(near), no, ROWS)
        return near[~same.all(axis=2).any(axis=1)]

    def close(rows: list[tuple], bucket: list) -> Iterator[pa.RecordBatch]:
        numbers, chunks, keys, sizes, signs, sketches, roots = zip(*rows, strict=True)
        no, c, apart_only = numbers[0], np.array(chunks), bucket[1] != bucket[2]
        n = np.array(sizes, dtype=np.int64)
        m = np.frombuffer(b"".join(signs), dtype=np.uint16).reshape(len(n), -1)
        sketch = np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(n), -1)
        _, root = np.unique(np.array(roots, dtype="S16"), return_inverse=True)
        linked = np.zeros(len(n), dtype=bool)
        for i in range(len(n) - 1):
            rest = np.arange(i + 1, len(n))
            rest = rest[root[rest] != root[i]] if whole else rest[~linked[rest]]
            if whole and apart_only:  # pairs within a chunk are another task's
                rest = rest[c[rest] != c[i]]
            rest = rest[np.abs(n[rest] - n[i]) <= apart * (n[rest] + n[i])]
            if len(rest):
                rest = rest[np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1) <= apart * (n[rest] + n[i])]
                near = rest[(m[rest] == m[i]).sum(axis=1) >= floor]
                near = meet_first(m, i, near, no) if whole and no else near
                linked[near] = True
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array([min(keys[i], keys[k]) for k in near], pa.binary()), pa.array([max(keys[i], keys[k]) for k in near], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for *bucket, no, c, key, n, sign, sketch, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    if len(rows) > 1:
                        yield from close(rows, at)
                    at, rows = bucket, []
                rows.append((no, c, key, n, sign, sketch, root))
        if len(rows) > 1:
            yield from close(rows, at)

    return run


def _candidates(nodes: DataFrame, whole: bool, percent: int, chunk: int, floor: int) -> DataFrame:
    """Pairs (a, b) of the keys of nodes (key, n, sign, sketch, root) that share a band: some from every so many bands, or all with two roots."""
    numbers = range(0, BANDS, 1 if whole else FIRST_STEP)
    bands = F.array(*[F.struct(F.lit(i).alias("no"), F.xxhash64(F.lit(i), F.substring("sign", 2 * ROWS * i + 1, 2 * ROWS)).alias("bucket")) for i in numbers])
    # Eight bytes stand for a key while buckets are counted; two keys of one code would only be compared once more.
    nodes = nodes.withColumn("code", F.xxhash64("key"))
    each = nodes.select("code", F.xxhash64("root").alias("of"), F.explode(bands).alias("b")).select("code", "of", "b.no", "b.bucket")
    sizes = each.groupBy("bucket").agg(F.count("*").alias("held"), F.min("of").alias("lo"), F.max("of").alias("hi")).where("held > 1 AND lo <> hi")
    each = each.join(sizes.select("bucket", F.ceil(F.col("held") / chunk).alias("parts")), "bucket")
    each = each.withColumn("c", F.pmod("code", "parts"))
    dealt = each.select("code", "bucket", "no", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("d"))
    by = ["bucket", "i", "j"]
    dealt = dealt.select("code", "bucket", "no", "c", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j")).join(nodes, "code")
    ordered = dealt.select(*by, "no", "c", "key", "n", "sign", "sketch", "root").repartition(*by).sortWithinPartitions(*by, "key")
    return settle(ordered.mapInArrow(_near_pairs(whole, percent, floor), "a binary, b binary").distinct(), "pairs")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, n_words: int) -> DataFrame:
    """The pairs whose full sets reach the threshold; nodes has key and least (an id of it), docs has id and text."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = settle(nodes.select("key", "least").join(wanted, "key", "left_semi"), "wanted")
    small = wanted.count() <= BROADCAST_KEYS  # then texts need not be shuffled to find those of candidates
    texts = docs.join(F.broadcast(wanted) if small else wanted, docs["id"].eqNullSafe(wanted["least"])).select("text", "key")
    sets = settle(texts.mapInArrow(_sets(n_words), "key binary, s array<bigint>").dropDuplicates(["key"]), "sets")
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = settle(both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "links")
    forget(wanted)
    forget(sets)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = 85, chunk: int = CHUNK, floor: int = FLOOR
) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of docs.

    Texts are linked if 100 * intersection >= percent * union of their sets of n_words-word shingles; component_id is
    the smallest id that links reach, the row's own included, and kept says whether it is the row's own. Equal sets
    are one class throughout. A forest from a quarter of the bands is verified first, which joins groups of copies by
    as many pairs as they have members; then all candidates of all bands that it left apart are. A text without words
    (null, empty, white space) has 0 shingles and is linked with nothing. Rows that repeat an id stay, each with its
    own text's component; a null id gets the component's smallest id that is not null, or null, and is kept if that
    is null. Other columns are ignored; an empty table gives an empty result.
    """
    known = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    rows = settle(known.mapInArrow(_signed(n_words), _SIGNED), "signatures")
    member = F.struct("n", "sign", "sketch")
    # min takes no null where there is another id, and any member of the class has the same struct
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.first(member).alias("m")).select("key", "least", "m.*")
    nodes = settle(nodes, "classes")
    first = _verified(_candidates(nodes.withColumn("root", F.col("key")), False, percent, chunk, floor), nodes, known, percent, n_words)
    roots = connected_components(first, "a", "b")
    placed = settle(nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    others = _verified(_candidates(placed, True, percent, chunk, floor), nodes, known, percent, n_words)
    of = placed.select("key", "root")
    ends = others.join(of.select(F.col("key").alias("a"), F.col("root").alias("u")), "a").join(of.select(F.col("key").alias("b"), F.col("root").alias("v")), "b")
    joined = connected_components(ends, "u", "v").select(F.col("node").alias("root"), F.col("root").alias("top"))
    topped = placed.select("key", "least", "root").join(joined, "root", "left").withColumn("top", F.coalesce("top", "root"))
    topped = settle(topped, "topped")
    named = topped.join(topped.groupBy("top").agg(F.min("least").alias("component_id")), "top").select("key", "component_id")
    alone = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    found = rows.select("id", "n", "key").join(named, "key", "left").select("id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
