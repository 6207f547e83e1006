"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints that differ in at most ``radius`` of 64 bits are linked, and none of these links is missed: bit i
gets a vector phi(i) of radius + 1 bits, and each non-zero vector v of as many bits makes a table that keeps the
bits with an odd <phi(i), v>. The at most ``radius`` vectors of the bits in which two fingerprints differ leave
some v orthogonal to all of them, and in the table of that v the two fingerprints have the same key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, text_of
from .components import connected_components

BITS = 64
#: Members of a table's bucket that one task compares at once; larger buckets are dealt to pairs of chunks.
CHUNK = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHES_AT_ONCE = 1 << 15


def _shingles(text: str | None, n_words: int) -> list[bytes]:
    """A text's word shingles in order, repeats included; nothing for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return []
    if len(found) <= n_words:
        return [b" ".join(found)]
    return list(map(b" ".join, zip(*(found[i:] for i in range(n_words)))))


def _digests(text: str | None, n_words: int) -> list[int]:
    """XXH64 with seed 42 of every shingle."""
    digest = xxhash.xxh64_intdigest
    return [digest(s, 42) for s in _shingles(text, n_words)]


def text_fingerprint(text: str | None, n_words: int = 3) -> int:
    """The signed 64-bit SimHash of a text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of n_words words (repeats included)
    are joined by one space and hashed by XXH64 with seed 42. With fewer words the whole sequence is the one
    shingle; a text without words (null, empty, white space) has fingerprint zero.
    """
    return _majority(np.array(_digests(text, n_words), dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number; zero without hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[at : at + _HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, n_words: int = 3) -> Column:
    """Column of SimHash fingerprints (bigint)."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text_fingerprint(t, n_words)).astype("int64")

    return of(text)


def masks(radius: int) -> list[int]:
    """Signed masks of the 2^(radius+1) - 1 covering tables."""
    n = 2 ** (radius + 1) - 1
    phi = [1 + i % n for i in range(BITS)]
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _spread(run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a forest that connects what links of the run connect. Only for one bucket or pair of chunks."""
    edges = []
    rest = run
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(np.bitwise_xor(rest, x).view(np.uint64)) <= radius  # of signed numbers it counts the magnitude's
            if near.any():
                found = rest[near]
                rest = rest[~near]
                edges.extend((int(x), int(y)) for y in found)
                queue.extend(found)
    return edges


def _links(radius: int):
    """Streams rows sorted by bucket and gives the forest edges of each; holds one bucket's chunk at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept = None, []

        def close() -> list[tuple[int, int]]:
            return _spread(np.unique(np.concatenate(kept)), radius) if kept else []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            fps = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                key = tuple(keys[lo])
                if key != kept_key:
                    edges += close()
                    kept_key, kept = key, []
                kept.append(fps[lo:hi])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=schema)
        if edges := close():
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=schema)

    return run


def fingerprint_links(fps: DataFrame, column: str, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links within ``radius`` connect.

    Buckets of one fingerprint go at once; a bucket of more than ``chunk`` distinct fingerprints is dealt to all
    pairs of its chunks, so that no task holds more than about two chunks and no pair goes uncompared. Of a
    bucket's links a spanning forest is given, never all pairs.
    """
    one = fps.select(F.col(column).alias("fp")).where("fp is not null").distinct()
    tables = F.array(*[
        F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))
    ])
    rows = one.select("fp", F.explode(tables).alias("t")).select("fp", "t.no", "t.key")
    sizes = rows.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["no", "key"])
    parts = F.ceil(F.col("n") / chunk)
    rows = rows.withColumn("parts", parts).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("parts")))
    dealt = rows.select("no", "key", "fp", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("d"))
    dealt = dealt.select("no", "key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "fp")
    by = ["no", "key", "i", "j"]
    found = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links(radius), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3, radius: int = 3
) -> DataFrame:
    """Rows (id, fingerprint bigint, component_id), one for each row of docs.

    component_id is the smallest id that links reach, its own included. Null and empty texts have fingerprint
    zero and are linked like any other. Rows that repeat an id stay, each with its own text's component; null
    ids get the component's smallest id that is not null, or null. Other columns of docs are ignored, so their
    names can't clash. An empty table gives an empty result.
    """
    rows = settle(docs.select(F.col(id_col).alias("id"), fingerprint(text_of(text_col), n_words).alias("fp")), "fingerprints")
    roots = connected_components(fingerprint_links(rows, "fp", radius), "a", "b")
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = settle(placed, "placed")
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(component, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


#: The three blocks of the wide tables: of 14 differing bits, one block has 4 at most.
WIDE_RADIUS = 14
_BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Vectors of 5 bits for a block's bits, such that each of its 31 tables keeps 10 bits or more.
_PHI = (22, 31, 20, 29, 14, 8, 26, 25, 24, 27, 21, 3, 5, 18, 10, 19, 2, 15, 30, 4, 9, 28)
#: Members of a wide bucket that one task compares at once; its keys are short, so buckets are larger.
WIDE_CHUNK = 8192
_ROWS_AT_ONCE = 128
#: Members of a bucket up to which it is compared together with others.
_SMALL = 64
#: More than the chunks of any bucket.
_CHUNKS = 1 << 32
#: Of the wide tables, every so many serve for the first forest.
_FIRST_STEP = 8


def wide_masks() -> list[int]:
    """Signed masks of the 93 tables in one of which any two fingerprints within WIDE_RADIUS have the same key."""
    out = []
    for lo, hi in _BLOCKS:
        for v in range(1, 32):
            m = sum(1 << i for i in range(lo, hi) if (_PHI[i - lo] & v).bit_count() % 2)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


#: Bits of the parity sketch that goes with a fingerprint into the wide tables.
SKETCH_BITS = 256


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Bits that are 1 where an odd number of the set's hashes falls: two sketches differ in at most as many bits as
    the sets have members that the other lacks, so that it can rule a pair out and never rules out a true one."""
    ones = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((ones & 1).astype(bool)).tobytes()


def _sketched(n_words: int):
    """Column of structs (fp, n, sketch): SimHash, size and parity sketch of a text's shingles."""

    @F.pandas_udf("fp bigint, n int, sketch binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = np.array(_digests(text, n_words), dtype="<u8")
            distinct = np.unique(hashes)
            rows.append((_majority(hashes), len(distinct), parity_sketch(distinct)))
        fps, sizes, sketches = zip(*rows, strict=True) if rows else ((), (), ())
        return pd.DataFrame({"fp": np.array(fps, dtype=np.int64), "n": np.array(sizes, dtype=np.int32), "sketch": sketches})

    return of


def _wide_pairs(radius: int, whole: bool, threshold: float, tables: list[int]):
    """Streams rows (bucket, i, j, node, fp, n, sketch, root) sorted by bucket, i having the table's number as well. Pairs
    of nodes that are within radius and that neither size nor sketch rules out, each in the first table alone in which
    it meets: all those whose roots differ if whole, else one for each node that has any. Holds one bucket's two
    chunks at a time; small buckets are compared many at once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    masks = np.array(tables, dtype=np.int64)
    # Of sets with Jaccard similarity t, at most (1 - t) / (1 + t) of both sizes together are in one set only.
    apart = (1 - threshold) / (1 + threshold) + 1e-9

    def likely(own: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs of places (x, y) can have the wanted similarity, two roots if whole, and meet here first."""
        n = own["n"]
        out = np.abs(n[x] - n[y]) <= apart * (n[x] + n[y])
        if whole:
            out &= own["root"][x] != own["root"][y]
        at = np.flatnonzero(out)
        differ = np.bitwise_count(own["sketch"][x[at]] ^ own["sketch"][y[at]]).sum(axis=1)
        out[at] = differ <= apart * (n[x[at]] + n[y[at]])
        at = np.flatnonzero(out)
        for lo in range(0, len(at), 1 << 14):
            some = at[lo : lo + (1 << 14)]
            meets = ((own["fp"][x[some]] ^ own["fp"][y[some]])[:, None] & masks) == 0
            out[some] = meets.argmax(axis=1) == own["keys"][x[some], 1] // _CHUNKS
        return out

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count((a ^ b).view(np.uint64)) <= radius

    def pairs(own: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs, of rows that are whole buckets."""
        keys, fps = own["keys"], own["fp"]
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(fps)))
        left = np.repeat(starts + sizes, sizes) - np.arange(len(fps)) - 1  # rows of the bucket after each
        small = np.repeat(sizes <= _SMALL, sizes)
        for step in range(1, min(int(sizes.max()), _SMALL)):
            x = np.flatnonzero(small & (left >= step))
            x = x[near(fps[x], fps[x + step])]
            yield x, x + step
        for lo, size in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
            for at in range(lo, lo + size, _ROWS_AT_ONCE):
                block = np.arange(at, min(at + _ROWS_AT_ONCE, lo + size))
                x, y = np.nonzero(near(fps[block, None], fps[None, at + 1 : lo + size]))
                x, y = x + at, y + at + 1
                yield x[x < y], y[x < y]

    def found(own: dict) -> Iterator[pa.RecordBatch]:
        linked = np.zeros(len(own["fp"]), dtype=bool)
        for x, y in pairs(own):
            good = likely(own, x, y)
            x, y = x[good], y[good]
            if not whole:
                y, first = np.unique(y, return_index=True)
                x, y = x[first][~linked[y]], y[~linked[y]]
                linked[y] = True
            if len(x):
                a, b = own["node"][x], own["node"][y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, name in ((3, "node"), (4, "fp"), (5, "n"), (7, "root"))}
            col["keys"] = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            col["sketch"] = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
            same = (col["keys"] == col["keys"][-1]).all(axis=1)
            last = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if last or held and (held[-1]["keys"][-1] != col["keys"][0]).any():
                held.append({name: c[:last] for name, c in col.items()})
                yield from found({name: np.concatenate([h[name] for h in held]) for name in col})
                held = []
            held.append({name: c[last:] for name, c in col.items()})
        if held:
            yield from found({name: np.concatenate([h[name] for h in held]) for name in held[0]})

    return run


def _wide_candidates(nodes: DataFrame, whole: bool, chunk: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows (node, fp, n, sketch, root) within WIDE_RADIUS: some from every so many tables, or all with two roots."""
    tables = wide_masks()[:: 1 if whole else _FIRST_STEP]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(tables)])
    member = ["node", "fp", "n", "sketch", "root"]
    # Keys have 16 bits at most, so there are never more large buckets than a broadcast can hold.
    large = nodes.select(F.explode(keys).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("held")).where(F.col("held") > chunk)
    large = large.select("bucket", F.ceil(F.col("held") / chunk).alias("parts"))
    rows = nodes.select(*member, F.posexplode(keys).alias("no", "bucket"))
    rows = rows.join(F.broadcast(large), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = rows.select("bucket", "no", *member, "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("d"))
    first = F.least("c", "d") + F.col("no") * F.lit(_CHUNKS)
    dealt = dealt.select("bucket", first.alias("i"), F.greatest("c", "d").alias("j"), *member)
    by = ["bucket", "i", "j"]
    found = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_wide_pairs(WIDE_RADIUS, whole, threshold, tables), "a bigint, b bigint")
    return found.distinct()


def _verified(pairs: DataFrame, texts: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """The pairs whose texts' shingle sets have Jaccard similarity of threshold or more; texts has node and text."""

    @F.pandas_udf("array<bigint>")
    def shingle_set(column: pd.Series) -> pd.Series:
        return column.map(lambda t: np.array(list(set(_digests(t, n_words))), dtype="<u8").view("<i8"))

    pairs = settle(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = texts.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = settle(sets.select("node", shingle_set("text").alias("s")), "shingles")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return settle(both.where((union == 0) | (common >= threshold * union)).select("a", "b"), "links")


def verified_links(docs: DataFrame, text_col: str = "text", n_words: int = 5, threshold: float = 0.8, chunk: int = WIDE_CHUNK) -> DataFrame:
    """Edges (a, b) between XXH64s of texts that connect exactly what near copies connect.

    Near copies are texts whose fingerprints on n_words words are within WIDE_RADIUS and whose shingle sets have
    Jaccard similarity of threshold or more. Sizes and parity sketches rule most other pairs out where they meet, and
    no true ones. One candidate for each text, from some of the tables, is verified first, which joins groups of near
    copies by as many pairs as they have members; then all candidates of all tables that it left apart are.
    """
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("node"), text_of(text_col).alias("text"))
    sketched = texts.select("node", _sketched(n_words)(F.col("text")).alias("s")).select("node", "s.*")
    nodes = settle(sketched.distinct(), "fingerprints")
    first = _verified(_wide_candidates(nodes.withColumn("root", F.col("node")), False, chunk, threshold), texts, n_words, threshold)
    placed = nodes.join(connected_components(first, "a", "b"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    others = _verified(_wide_candidates(settle(placed, "placed"), True, chunk, threshold), texts, n_words, threshold)
    return first.unionByName(others)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: float = 0.8
) -> DataFrame:
    """docs without the documents that are near copies (see verified_links) of one with a smaller id; columns as they came.

    Links are followed from copy to copy. Rows with a null id stay, and so do rows of a group that repeat its kept
    id. Rows that share an id are judged each by its own text.
    """
    roots = connected_components(verified_links(docs, text_col, n_words, threshold), "a", "b")
    node, gone_id = fresh(docs.columns, "node", "gone_id")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("node")).distinct()
    rows = settle(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rows.groupBy("root").agg(F.min("id").alias("least"))
    gone = rows.join(least, "root").where(F.col("id") > F.col("least")).select(F.col("id").alias(gone_id), F.col("node").alias(node))
    gone = settle(gone, "gone")
    return docs.join(gone, (docs[id_col] == gone[gone_id]) & (F.xxhash64(text_of(text_col)) == gone[node]), "left_anti")
