"""Removal of long byte strings that earlier documents hold too, by run-length indexes of repetitive text.

Every string of ``LENGTH`` bytes has an anchor: the least hash among its 20-byte substrings. Equal strings have equal
anchors, so only anchors that stand in more than one text can matter. A text's neighbouring strings with one anchor
form a region; the regions of shared anchors, about as much text as the corpus repeats, are brought together by anchor,
equal regions being merged first. Where an anchor has several different regions, a task orders their suffixes by the
first LENGTH bytes. The bytes before the suffixes, compressed to runs (cut where neighbouring suffixes share fewer than
LENGTH bytes), carry the smallest document id of each run as a sample, and a region's bytes are marked wherever the
runs of a string have a smaller id than its own.

This is less than a run-length index: the order itself is kept while a task works, and equal strings are found in it by
their ranks, without backward search or streamed matching statistics. Those need the order of whole suffixes, which
takes as many sorts again, where this operator already spends most of its time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle, text_of

LENGTH = 50
#: Bytes that an anchor covers; shorter ones make fewer anchors, but more of them are shared by chance.
GRAM = 20
#: Texts, at most, in which very common anchors are looked for beforehand, and the share of them that makes one so.
COMMON_TEXTS = 20_000
COMMON_SHARE = 0.002
#: Bytes of different regions of one anchor, up to which one task indexes them; beyond, their strings are grouped by Spark.
ANCHOR_BYTES = 4_000_000
#: Bytes of regions that a task puts into one index.
INDEX_BYTES = 1_000_000
_NO_ID = (1 << 63) - 1


def _mix(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x * np.uint64(0xD6E8FEB86659FD93 + 2 * k)) ^ y
        z *= np.uint64(0xFF51AFD7ED558CCD)
        return z ^ (z >> np.uint64(29))


def _table() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64), np.arange(1, 257, dtype=np.uint64), 99)


_BYTES = _table()


def regions(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, starts and ends (in bytes) of a text's regions; together they hold every string of LENGTH bytes once."""
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h, size = _BYTES[data], 1
    while size * 2 <= GRAM:
        h = _mix(h[:-size], h[size:], size)
        size *= 2
    if size < GRAM:  # two that overlap cover what is left
        h = _mix(h[: len(h) - (GRAM - size)], h[GRAM - size :], size)
    wide, size = LENGTH - GRAM + 1, 1
    while size * 2 <= wide:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < wide:
        h = np.minimum(h[: len(h) - (wide - size)], h[wide - size :])
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.concatenate([first[1:], [len(h)]]) - 1
    return h[first].view(np.int64), first, last + LENGTH


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _anchors(common):
    """(text hash, text) to the distinct anchors of each text but the common ones, which are known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = common.value
        for batch in batches:
            us = batch.column(0).to_pylist()
            for lo in range(0, len(us), 500):
                found = [np.unique(regions(_bytes_of(t.as_py()))[0]) for t in batch.column(1).slice(lo, 500)]
                anchors = np.concatenate(found)
                owners = np.repeat(np.array(us[lo : lo + 500], dtype=np.int64), [len(f) for f in found])
                keep = ~np.isin(anchors, left_out)
                yield pa.RecordBatch.from_arrays([pa.array(anchors[keep]), pa.array(owners[keep])], names=["anchor", "u"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and text, without those of anchors that stand in one text only; keeps one row at a time."""
    at, first, given = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        anchors, owners = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        begins = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        firsts = owners[begins]
        goes_on = anchors[0] == at
        if goes_on:
            firsts[0] = first
        differs = owners != np.repeat(firsts, np.diff(np.append(begins, len(anchors))))
        several = np.logical_or.reduceat(differs, begins)
        new = several.copy()
        if goes_on and given:
            new[0] = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([anchors[differs], anchors[begins[new]]])), pa.array(np.concatenate([owners[differs], firsts[new]]))], names=["anchor", "u"]
        )
        given = bool(several[-1]) or (given and goes_on and len(begins) == 1)
        at, first = anchors[-1], firsts[-1]


def _common(rows: DataFrame):
    """Broadcast of the anchors in many of a bounded number of texts: at most those of 1 / COMMON_SHARE texts.

    Such an anchor stands in several texts, which is all that the others are dealt out by anchor to learn.
    """
    n = rows.select("u").agg(F.count("*")).first()[0]
    some = rows.where(F.pmod(F.xxhash64("u"), F.lit(1_000_000)) < int(1e6 * min(1, COMMON_TEXTS / max(n, 1))) + 1)
    spark = rows.sparkSession
    none = spark.sparkContext.broadcast(np.zeros(0, dtype=np.int64))
    anchors = some.select("u", "text").mapInArrow(_anchors(none), "anchor bigint, u bigint")
    least = max(2, int(COMMON_SHARE * min(n, COMMON_TEXTS)))
    found = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi")).where((F.col("n") >= least) & (F.col("lo") != F.col("hi")))
    return spark.sparkContext.broadcast(np.array([r[0] for r in found.select("anchor").collect()], dtype=np.int64))


def _cut(common):
    """(id, text hash, shared anchors, text) to the regions of shared and of common anchors with their bytes."""
    names = ["anchor", "d", "u", "start", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = frozenset(common.value.tolist())
        rows: list[list] = [[], [], [], [], []]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=names)
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            for d, u, shared, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                own = frozenset(shared.as_py() or ())
                found = zip(*(x.tolist() for x in regions(np.frombuffer(data, dtype=np.uint8))), strict=True)
                for anchor, start, end in found:
                    if anchor in own or anchor in sure:
                        rows[0].append(anchor)
                        rows[1].append(d)
                        rows[2].append(u)
                        rows[3].append(start)
                        rows[4].append(data[start:end])
                if len(rows[0]) >= 5000:
                    yield flush()
        if rows[0]:
            yield flush()

    return run


class RunIndex:
    """Ordered suffixes of regions with ids, and the runs of the bytes before them with the smallest id of each: which
    strings of LENGTH bytes stand in a region with a smaller id."""

    def __init__(self, pieces: list[bytes], ids: np.ndarray):
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.owner = np.repeat(np.arange(len(pieces)), lengths)
        self.start = np.cumsum(lengths) - lengths
        place = np.arange(len(data)) - self.start[self.owner]
        whole = np.flatnonzero(place + LENGTH <= lengths[self.owner])  # suffixes of LENGTH bytes or more
        order, cut = self._suffixes(data, whole)
        before = np.where(place[order] > 0, data[order - 1], 256)  # the transform: the byte before each suffix
        runs = np.flatnonzero(cut | np.concatenate([[True], before[1:] != before[:-1]])) if len(order) else order
        self.samples = np.minimum.reduceat(ids[self.owner[order]], runs) if len(runs) else runs  # smallest id of each run
        self.order, self.cut, self.runs, self.ids, self.place = order, cut, runs, ids, place

    @staticmethod
    def _suffixes(data: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order of their first LENGTH bytes, and where a new string begins in that order."""
        padded = np.concatenate([data, np.zeros(64, dtype=np.uint8)]).astype(np.uint64)
        rank, size = padded, 1
        for size in (1, 2, 4):
            rank = (rank[:-size] << np.uint64(8 * size)) | rank[size:]
        size = 8
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        for step in (8, 16, LENGTH - 32):
            n = len(rank) - step
            pair = (rank[:n] << 32) | rank[step:]
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        own = rank[whole]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        return whole[order], np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(own) else np.zeros(0, dtype=bool)

    def matches(self) -> list[tuple[int, np.ndarray]]:
        """For each region with any: starts within it of strings that a smaller id has too."""
        if not len(self.order):
            return []
        strings = np.flatnonzero(self.cut)
        least = np.minimum.reduceat(self.samples, np.searchsorted(self.runs, strings))
        found = self.order[np.repeat(least, np.diff(np.append(strings, len(self.order)))) < self.ids[self.owner[self.order]]]
        found.sort()
        owner = self.owner[found]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(found) else found
        return [(int(o), self.place[part]) for o, part in zip(owner[cuts], np.split(found, cuts[1:]), strict=True)] if len(found) else []


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal ones, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


_OWN = "anchor bigint, rid bigint, starts array<int>, ends array<int>"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, rid, id, bytes) sorted by anchor to the spans of each region that smaller ids have too."""
    keys: list[tuple[int, int]] = []
    pieces: list[bytes] = []
    ids: list[int] = []
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        # An anchor is in every string of its regions, so strings of different anchors never meet in the index.
        found = RunIndex(pieces, np.array(ids, dtype=np.int64)).matches()
        if found:
            spans = [_merged(at, at + LENGTH) for _, at in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[o][0] for o, _ in found], pa.int64()), pa.array([keys[o][1] for o, _ in found], pa.int64()),
                 pa.array([s.tolist() for s, _ in spans], pa.list_(pa.int32())), pa.array([e.tolist() for _, e in spans], pa.list_(pa.int32()))],
                names=["anchor", "rid", "starts", "ends"],
            )

    for batch in batches:
        for anchor, rid, d, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size > INDEX_BYTES and anchor != keys[-1][0]:
                yield from close()
                keys, pieces, ids, size = [], [], [], 0
            keys.append((anchor, rid))
            pieces.append(data)
            ids.append(d)
            size += len(data)
    if pieces:
        yield from close()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, rid, id, bytes) to all strings of LENGTH bytes with their places."""
    for batch in batches:
        for anchor, rid, d, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for lo in range(0, len(data) - LENGTH + 1, 10_000):
                hi = min(lo + 10_000, len(data) - LENGTH + 1)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array([rid] * n, pa.int64()), pa.array([d] * n, pa.int64()),
                     pa.array(range(lo, hi), pa.int32()), pa.array([data[i : i + LENGTH] for i in range(lo, hi)], pa.binary())],
                    names=["anchor", "rid", "d", "at", "string"],
                )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text hash, lists of starts and ends) to maximal spans."""
    for batch in batches:
        out = [_merged(s.values.to_numpy(zero_copy_only=False), e.values.to_numpy(zero_copy_only=False)) for s, e in zip(batch.column(1), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s.tolist() for s, _ in out], pa.list_(pa.int32())), pa.array([e.tolist() for _, e in out], pa.list_(pa.int32()))],
            names=["u", "starts", "ends"],
        )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with starts and ends (arrays of byte offsets into the UTF-8 text): the maximal runs of repeated bytes.

    A byte is repeated if a string of 50 bytes over it also starts in a document with a smaller id. Null texts are
    empty; a null id is larger than all others, and equal ids are not smaller than each other. Rows with equal texts
    are one text with its smallest id; of the others all bytes are repeated, if there are 50. If docs has columns
    starts or ends, they are replaced.
    """
    kept = [c for c in docs.columns if c not in ("starts", "ends")]
    text = text_of(text_col)
    d = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID))
    rows = docs.select(d.alias("d"), F.xxhash64(text).alias("u"), text.alias("text"))
    first = settle(rows.groupBy("u").agg(F.min("d").alias("d")), "texts")
    common = _common(rows)
    dealt = rows.select("u", "text").mapInArrow(_anchors(common), "anchor bigint, u bigint")
    shared = dealt.repartition("anchor").sortWithinPartitions("anchor", "u").mapInArrow(_shared, "anchor bigint, u bigint")
    lists = shared.groupBy("u").agg(F.collect_set("anchor").alias("anchors"))
    wanted = settle(first.join(lists, "u", "left"), "anchors")
    texts = rows.join(wanted, ["d", "u"]).select("d", "u", "anchors", "text")
    cut = texts.mapInArrow(_cut(common), "anchor bigint, d bigint, u bigint, start int, bytes binary")
    found = settle(cut.withColumn("rid", F.xxhash64("bytes")), "regions")
    # Of equal regions the smallest id; only anchors with different regions need an index.
    distinct = found.groupBy("anchor", "rid", "bytes").agg(F.min("d").alias("lo"))
    distinct = settle(distinct, "distinct")
    places = settle(found.select("anchor", "rid", "d", "u", "start", F.length("bytes").alias("n")), "places")
    forget(found)
    of = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.length("bytes")).alias("size")).where("n > 1")
    several = distinct.join(of, "anchor")
    small = several.where(F.col("size") <= ANCHOR_BYTES).select("anchor", "rid", "lo", "bytes")
    own = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_indexed, _OWN)
    large = several.where(F.col("size") > ANCHOR_BYTES).select("anchor", "rid", "lo", "bytes")
    strings = large.mapInArrow(_strings, "anchor bigint, rid bigint, d bigint, at int, string binary")
    least = strings.groupBy("string").agg(F.min("d").alias("least"))
    hits = strings.join(least, "string").where("least < d").groupBy("anchor", "rid").agg(F.collect_list("at").alias("starts"))
    hits = hits.withColumn("ends", F.transform("starts", lambda s: s + LENGTH))
    known = distinct.select("anchor", "rid", "lo").join(own.unionByName(hits), ["anchor", "rid"], "left")
    placed = places.join(known, ["anchor", "rid"])
    whole = F.col("d") > F.col("lo")
    shift = lambda c: F.transform(c, lambda x: x + F.col("start"))
    placed = placed.where(whole | F.col("starts").isNotNull()).select(
        "u",
        F.when(whole, F.array("start")).otherwise(shift("starts")).alias("starts"),
        F.when(whole, F.array(F.col("start") + F.col("n"))).otherwise(shift("ends")).alias("ends"),
    )
    lists = placed.groupBy("u").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    spans = settle(lists.mapInArrow(_joined, "u bigint, starts array<int>, ends array<int>"), "spans")
    about = first.withColumnRenamed("d", "r_d").withColumnRenamed("u", "r_u").join(
        spans.select(F.col("u").alias("r_u"), F.col("starts").alias("r_s"), F.col("ends").alias("r_e")), "r_u", "left"
    )
    full = docs.select(*kept).join(about, F.xxhash64(text) == F.col("r_u"))
    later, n_bytes = d > F.col("r_d"), F.octet_length(text)
    none = F.array().cast("array<int>")
    all_of = F.when(n_bytes >= LENGTH, F.array(F.lit(0))).otherwise(none)
    end_of = F.when(n_bytes >= LENGTH, F.array(n_bytes)).otherwise(none)
    return full.select(
        *kept,
        F.when(later, all_of).otherwise(F.coalesce("r_s", none)).alias("starts"),
        F.when(later, end_of).otherwise(F.coalesce("r_e", none)).alias("ends"),
    )


def kept_bytes(text, starts, ends):
    """Column of what is left of a text, as binary: the bytes before, between and after its repeated spans."""
    froms = F.concat(F.array(F.lit(0)), ends)
    tos = F.concat(starts, F.array(F.octet_length(text)))
    piece = lambda a, b: F.substring(F.encode(text, "UTF-8"), a + 1, b - a).cast("string")
    return F.array_join(F.zip_with(froms, tos, piece), "").cast("binary")
