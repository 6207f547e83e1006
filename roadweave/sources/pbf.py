"""Road extracts in the PBF format of OpenStreetMap, as a splittable source and a sink, and their road links.

A file is a chain of blocks, each with a small header. A split is a range of bytes: its task looks for the first block
that begins in the range and reads on until a block begins beyond it, so planning looks at no file's content and a
planet file is read by as many tasks as it has splits. Blocks are decoded column by column: a packed field is one
vectorised pass over its bytes. Elements are rows; nodes meet ways in Spark.

Files are opened by pyarrow's file systems (local paths, s3, gs, hdfs and others by address).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import projection
from ..functions.tags import DRIVEABLE, first_number, first_value

SCHEMA = "kind string, id bigint, lon double, lat double, tags map<string,string>, refs array<bigint>"
_ARROW = pa.schema([
    ("kind", pa.string()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())),
])
#: Bytes of a split, unless the option split_bytes says otherwise.
SPLIT_BYTES = 64 << 20
# Fixed values of the format: how a block's header begins, its largest sizes, and the default step of coordinates.
_MARK = b"\x0a\x07OSMData"
_MOST_HEADER, _MOST_BLOCK = 64 << 10, 32 << 20
_GRANULARITY = 100
#: Elements of a written block.
_IN_BLOCK = 8000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields: numbers as they are, all else as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """The unsigned numbers of a packed field."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return ((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).view(np.int64)


def _signed_one(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _int64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _content(block: bytes) -> bytes:
    """A block without its compression."""
    for number, value in _fields(block):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
        if number in (4, 5, 6, 7):
            raise ValueError("a block is compressed by another method than zlib")
    return b""


class _Block:
    """One block's elements as columns."""

    def __init__(self, data: bytes, kinds: frozenset[str]):
        self.texts: list[str] = []
        self.step, self.lon0, self.lat0 = _GRANULARITY, 0, 0
        groups = []
        for number, value in _fields(data):
            if number == 1:
                self.texts = [v.decode("utf-8", "replace") for n, v in _fields(value) if n == 1]
            elif number == 2:
                groups.append(value)
            elif number == 17:
                self.step = value
            elif number == 19:
                self.lat0 = _int64(value)
            elif number == 20:
                self.lon0 = _int64(value)
        self.kinds, self.groups = kinds, groups

    def batches(self) -> Iterator[pa.RecordBatch]:
        for group in self.groups:
            nodes, ways = [], []
            for number, value in _fields(group):
                if number == 1 and "node" in self.kinds:
                    nodes.append(self._node(value))
                elif number == 2 and "node" in self.kinds:
                    yield self._dense(value)
                elif number == 3 and "way" in self.kinds:
                    ways.append(self._way(value))
            if nodes:
                ids, lons, lats, tags = zip(*nodes, strict=True)
                yield self._rows("node", np.array(ids, dtype=np.int64), tags, self._degrees(np.array(lons), self.lon0), self._degrees(np.array(lats), self.lat0))
            if ways:
                ids, tags, refs = zip(*ways, strict=True)
                yield self._rows("way", np.array(ids, dtype=np.int64), tags, refs=refs)

    def _degrees(self, values: np.ndarray, origin: int) -> np.ndarray:
        return (origin + self.step * values.astype(np.int64)) / 1e9

    def _rows(self, kind: str, ids: np.ndarray, tags, lon: np.ndarray | None = None, lat: np.ndarray | None = None, refs=None) -> pa.RecordBatch:
        n = len(ids)
        number = lambda c: pa.nulls(n, pa.float64()) if c is None else pa.array(c)
        lists = pa.nulls(n, _ARROW.field("refs").type) if refs is None else pa.array(refs, _ARROW.field("refs").type)
        named = pa.nulls(n, _ARROW.field("tags").type) if tags is None else pa.array(tags, _ARROW.field("tags").type)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(ids), number(lon), number(lat), named, lists], schema=_ARROW)

    def _tags(self, keys: bytes, values: bytes) -> list[tuple[str, str]]:
        return [(self.texts[k], self.texts[v]) for k, v in zip(packed(keys), packed(values), strict=True)]

    def _node(self, data: bytes) -> tuple:
        f = dict(_fields(data))
        return _signed_one(f[1]), _signed_one(f[9]), _signed_one(f[8]), self._tags(f.get(2, b""), f.get(3, b""))

    def _way(self, data: bytes) -> tuple:
        f = dict(_fields(data))
        return _int64(f[1]), self._tags(f.get(2, b""), f.get(3, b"")), np.cumsum(signed(packed(f.get(8, b""))))

    def _dense(self, data: bytes) -> pa.RecordBatch:
        f = dict(_fields(data))
        ids, lats, lons = (np.cumsum(signed(packed(f.get(k, b"")))) for k in (1, 8, 9))
        tags, words = None, packed(f.get(10, b""))
        if len(words):  # pairs of each node, closed by a zero
            ends = np.flatnonzero(words == 0)
            if len(ends) != len(ids):  # a value may be text 0 of a careless writer: then walk from pair to pair
                ends, at = [], 0
                while at < len(words):
                    at += 2 if words[at] else 1
                    if not words[at - 1] and (not ends or at - 1 > ends[-1]):
                        ends.append(at - 1)
                ends = np.array(ends[: len(ids)])
            starts = np.concatenate([[0], ends[:-1] + 1])
            tags = [[(self.texts[words[k]], self.texts[words[k + 1]]) for k in range(a, z, 2)] if z > a else [] for a, z in zip(starts, ends, strict=True)]
        return self._rows("node", ids, tags, self._degrees(lons, self.lon0), self._degrees(lats, self.lat0))


def _header(file: pa.NativeFile, at: int, size: int) -> tuple[str, int, int] | None:
    """Kind, place and size of the block whose header is at a place; nothing if there is none."""
    if at + 4 > size:
        return None
    file.seek(at)
    n = int.from_bytes(file.read(4), "big")
    if not 0 < n <= _MOST_HEADER or at + 4 + n > size:
        return None
    try:
        f = dict(_fields(file.read(n)))
        kind, length = f[1].decode("ascii"), f[3]
    except (KeyError, IndexError, ValueError, AttributeError):
        return None
    return (kind, at + 4 + n, length) if isinstance(length, int) and 0 <= length <= _MOST_BLOCK and at + 4 + n + length <= size else None


def _first_block(file: pa.NativeFile, lo: int, hi: int, size: int) -> int | None:
    """Where the first block in [lo, hi) begins; its end must be another block's begin or the file's end."""
    if lo == 0:
        return 0
    at, window = lo, 1 << 20
    while at < hi:
        file.seek(at)
        piece = file.read(min(window, hi - at) + 4 + len(_MARK))
        found = piece.find(_MARK, 4)
        while found >= 0:
            start = at + found - 4
            if start >= hi:
                return None
            known = _header(file, start, size)
            if known and (known[1] + known[2] == size or _header(file, known[1] + known[2], size)):
                return start
            found = piece.find(_MARK, found + 1)
        at += window
    return None


def _blocks(file: pa.NativeFile, lo: int, hi: int, size: int) -> Iterator[tuple[str, bytes]]:
    at = _first_block(file, lo, hi, size)
    while at is not None and at < min(hi, size):
        known = _header(file, at, size)
        if known is None:
            raise ValueError(f"no block at byte {at}")
        kind, start, length = known
        file.seek(start)
        yield kind, file.read(length)
        at = start + length


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


@dataclass
class _Range(InputPartition):
    path: str
    lo: int
    hi: int
    size: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)))
        self.kinds = frozenset(options.get("kinds", "node,way").split(","))

    def partitions(self) -> list[_Range]:
        fs, path = _opened(self.path)
        about = fs.get_file_info(path)
        if about.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [about] if about.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.path.endswith(".pbf") and not f.base_name.startswith((".", "_"))]
        return [_Range(f.path, lo, min(lo + self.split, f.size), f.size) for f in sorted(files, key=lambda f: f.path) for lo in range(0, f.size, self.split)] or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with _opened(self.path)[0].open_input_file(part.path) as file:
            for kind, block in _blocks(file, part.lo, part.hi, part.size):
                if kind == "OSMData":
                    yield from _Block(_content(block), self.kinds).batches()


def _number(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _zigzag(value: int) -> bytes:
    return _number((value << 1) ^ (value >> 63))


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def _deltas(values: list[int]) -> bytes:
    return b"".join(_zigzag(b - a) for a, b in zip([0, *values[:-1]], values, strict=True))


def _framed(kind: bytes, content: bytes) -> bytes:
    block = _field(2, len(content)) + _field(3, zlib.compress(content))
    head = _field(1, kind) + _field(3, len(block))
    return struct.pack(">I", len(head)) + head + block


def _written_block(kind: str, rows: list[dict]) -> bytes:
    texts: dict[str, int] = {"": 0}
    place = lambda t: texts.setdefault(t, len(texts))
    tagged = [[(place(k), place(v)) for k, v in r["tags"] or []] for r in rows]
    if kind == "node":
        units = lambda c: [round(r[c] * 1e9 / _GRANULARITY) for r in rows]
        pairs = b"".join(b"".join(_number(k) + _number(v) for k, v in t) + b"\x00" for t in tagged)
        dense = _field(1, _deltas([r["id"] for r in rows])) + _field(8, _deltas(units("lat"))) + _field(9, _deltas(units("lon"))) + _field(10, pairs)
        group = _field(2, dense)
    else:
        group = b"".join(
            _field(3, _field(1, r["id"]) + _field(2, b"".join(_number(k) for k, _ in t)) + _field(3, b"".join(_number(v) for _, v in t)) + _field(8, _deltas(r["refs"] or [])))
            for r, t in zip(rows, tagged, strict=True)
        )
    return _framed(b"OSMData", _field(1, b"".join(_field(1, t.encode()) for t in texts)) + _field(2, group))


@dataclass
class _Written(WriterCommitMessage):
    path: str
    final: str


class _Writer(DataSourceArrowWriter):
    """A file for each task, under a hidden name until the whole write is committed."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = _opened(self.path)
        fs.create_dir(path, recursive=True)
        name = f"{self.run}-{task.partitionId():05d}"
        hidden = f"{path}/.{name}-{task.taskAttemptId()}"
        with fs.open_output_stream(hidden) as file:
            file.write(_framed(b"OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes")))
            for batch in batches:
                for at in range(0, batch.num_rows, _IN_BLOCK):
                    rows = batch.slice(at, _IN_BLOCK).to_pylist()
                    for kind in ("node", "way"):
                        if own := [r for r in rows if r["kind"] == kind]:
                            file.write(_written_block(kind, own))
        return _Written(hidden, f"{path}/part-{name}.osm.pbf")

    def commit(self, messages: list[_Written | None]) -> None:
        fs, path = _opened(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                if f.base_name.endswith(".pbf"):
                    fs.delete_file(f.path)
        for m in filter(None, messages):
            fs.move(m.path, m.final)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = _opened(self.path)
        for m in filter(None, messages):
            fs.delete_file(m.path)


class PbfSource(DataSource):
    """Format osm_pbf. Options: path, kinds (node, way or both), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def read_pbf(spark: SparkSession, path: str, kinds: str = "node,way", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Elements of a PBF file, or of all in a folder: kind (node or way), id, lon and lat of nodes, tags, refs of ways.

    Null tags are those of nodes in a block without any. Relations aren't read. A missing path is an error.
    """
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").option("kinds", kinds).option("split_bytes", split_bytes).load(path)


def write_pbf(elements: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Elements (kind, id, lon, lat, tags, refs) as PBF files in a folder, one a task; coordinates to 10^-7 degrees."""
    elements.sparkSession.dataSource.register(PbfSource)
    typed = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")]
    elements.select(*typed).write.format("osm_pbf").mode(mode).save(path)


def _tag(name: str) -> Column:
    return F.element_at("tags", name).alias(name)


def network_links(elements: DataFrame, classes: tuple[str, ...] | None = DRIVEABLE, split: str = "segment", zone: int | None = None) -> DataFrame:
    """Road links (link_id, osm_way_id, u, v, line, highway, oneway, maxspeed, lanes, bridge, tunnel) of ways with a
    highway tag of the classes, as directed_edges takes them.

    split="segment" gives a link for each two neighbouring nodes of a way, "junction" one from junction to junction: a
    way's ends and the nodes that are on ways more than once. Lines are in degrees, or in metres of a UTM zone. A way
    is cut where a node is missing from the extract (as at its border), and a node that follows itself counts once.
    Elements given twice count once. link_id is the way's id and the place of the link's first node in it.
    """
    if split not in ("segment", "junction"):
        raise ValueError(f"no way to split ways: {split}")
    ways = elements.where((F.col("kind") == "way") & F.element_at("tags", "highway").isNotNull())
    if classes is not None:
        ways = ways.where(first_value(F.element_at("tags", "highway")).isin(*classes))
    ways = ways.dropDuplicates(["id"])
    about = ways.select(F.col("id").alias("osm_way_id"), *[_tag(t) for t in ("highway", "oneway", "bridge", "tunnel")], *[first_number(F.element_at("tags", t)).alias(t) for t in ("maxspeed", "lanes")])
    whole = F.when(F.size("refs") <= 1 << 16, F.col("refs")).otherwise(F.raise_error(F.lit("a way has more nodes than the format allows")).cast("array<bigint>"))
    once = F.filter(whole, lambda r, i: (i == 0) | (r != F.get(whole, i - 1)))
    placed = ways.select(F.col("id").alias("osm_way_id"), F.posexplode(once).alias("pos", "node"))
    nodes = elements.where("kind = 'node'").select(F.col("id").alias("node"), "lon", "lat").dropDuplicates(["node"])
    located = placed.join(nodes, "node")
    way = Window.partitionBy("osm_way_id").orderBy("pos")
    if split == "segment":
        cut = F.lit(True)
    else:
        shared = placed.groupBy("node").agg(F.count("*").alias("uses"))
        located = located.join(shared, "node")
        cut = F.col("uses") > 1
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), zone) if zone else (F.col("lon"), F.col("lat"))
    located = located.withColumns({"x": x, "y": y, "before": F.lag("pos").over(way), "after": F.lead("pos").over(way)})
    # The first node behind a gap begins a part, as the last before it ends one; inner cuts do both.
    begins = F.col("before").isNull() | (F.col("before") < F.col("pos") - 1)
    ends = F.col("after").isNull() | (F.col("after") > F.col("pos") + 1)
    located = located.withColumns({"begins": begins, "cuts": cut & ~begins & ~ends})
    part = F.sum((F.col("begins") | F.col("cuts")).cast("int")).over(way)
    located = located.withColumn("part", part)
    member = located.withColumn("part", F.explode(F.when(F.col("cuts"), F.array(F.col("part") - 1, "part")).otherwise(F.array("part"))))
    point = F.struct("pos", "node", F.struct("x", "y").alias("p"))
    grouped = member.groupBy("osm_way_id", "part").agg(F.array_sort(F.collect_list(point)).alias("all"))
    kept = grouped.where("size(all) >= 2")
    first, last = F.element_at("all", 1), F.element_at("all", -1)
    lines = kept.select(
        (F.shiftleft("osm_way_id", 16) + first["pos"]).alias("link_id"), "osm_way_id", first["node"].alias("u"), last["node"].alias("v"), F.transform("all", lambda s: s["p"]).alias("line")
    )
    return lines.join(about, "osm_way_id").select("link_id", "osm_way_id", "u", "v", "line", "highway", "oneway", "maxspeed", "lanes", "bridge", "tunnel")


def read_network(spark: SparkSession, path: str, classes: tuple[str, ...] | None = DRIVEABLE, split: str = "segment", zone: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Road links of PBF files (see network_links); an error if there is none."""
    links = network_links(read_pbf(spark, path, split_bytes=split_bytes), classes, split, zone)
    if links.isEmpty():
        raise ValueError(f"no road links in {path}")
    return links
