"""Road extracts: files made byte by byte here, and files that the library's sink writes."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from roadweave.operators import roadnet
from roadweave.sources import pbf


def varint(n):
    out = b""
    n &= 2**64 - 1
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def zigzag(n):
    return varint(2 * n if n >= 0 else -2 * n - 1)


def number(field, n):
    return varint(field << 3) + varint(n)


def part(field, data):
    return varint(field << 3 | 2) + varint(len(data)) + data


def deltas(values):
    return b"".join(zigzag(b - a) for a, b in zip([0, *values], values))


def block(content, kind=b"OSMData", raw=False):
    body = part(1, content) if raw else number(2, len(content)) + part(3, zlib.compress(content))
    head = part(1, kind) + number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def data(texts, *groups, more=b""):
    return part(1, b"".join(part(1, t.encode()) for t in texts)) + b"".join(part(2, g) for g in groups) + more


def way(i, tags, refs):
    return part(3, number(1, i) + part(2, b"".join(varint(k) for k, _ in tags)) + part(3, b"".join(varint(v) for _, v in tags)) + part(8, deltas(refs)))


TEXTS = ["", "highway", "residential", "oneway", "yes", "maxspeed", "30 mph", "footway", "name", "Straße", "primary"]
#: Nodes n at (n / 1000, 50 + n / 1000) degrees.
IDS = [1, 2, 3, 7, 5, 10**10]


def made_file():
    dense = part(1, deltas(IDS)) + part(8, deltas([50 * 10**7 + n % 1000 * 10**4 for n in IDS])) + part(9, deltas([n % 1000 * 10**4 for n in IDS]))
    dense += part(10, b"\0" + varint(8) + varint(9) + b"\0" * 5)
    # A second block has plain nodes, steps of a microdegree's tenth and an origin of its own.
    plain = part(1, number(1, 2 * 8) + number(8, 2 * 800) + number(9, 2 * 800)) + part(1, number(1, 2 * 9) + part(2, varint(8)) + part(3, varint(9)) + number(8, 2 * 900) + number(9, 2 * 900))
    scaled = number(17, 10_000 * 100 // 1000) + number(19, 50 * 10**9) + number(20, 0)
    ways = way(100, [(1, 2), (3, 4), (5, 6)], [1, 2, 3]) + way(101, [(1, 10)], [7, 2, 5, 10**10]) + way(102, [(1, 7)], [1, 7]) + way(103, [(1, 2)], [3, 3, 4444, 5, 8]) + way(104, [(8, 9)], [1, 2])
    return block(part(4, b"OsmSchema-V0.6"), b"OSMHeader") + block(data(TEXTS, part(2, dense))) + block(data(TEXTS, plain, more=scaled), raw=True) + block(data(TEXTS, ways))


def test_elements_are_the_same_in_any_number_of_splits(spark, tmp_path):
    made = made_file()
    (tmp_path / "a.osm.pbf").write_bytes(made)
    rows = None
    for split in (1 << 20, len(made) // 3, 50, 7):
        df = pbf.read_pbf(spark, f"{tmp_path}/a.osm.pbf", split_bytes=split)
        assert df.rdd.getNumPartitions() == -(-len(made) // split)
        got = sorted((r["kind"], r["id"], None if r["lon"] is None else round(r["lon"], 9), None if r["lat"] is None else round(r["lat"], 9), sorted((r["tags"] or {}).items()), r["refs"]) for r in df.collect())
        assert rows is None or got == rows
        rows = got
    nodes = {r[1]: r for r in rows if r[0] == "node"}
    assert sorted(nodes) == sorted([*IDS, 8, 9]) and len(rows) == 13
    assert all(nodes[n][2:4] == (round(n % 1000 / 1000, 9), round(50 + n % 1000 / 1000, 9)) for n in IDS)
    assert nodes[2][4] == nodes[9][4] == [("name", "Straße")] and nodes[1][4] == []
    assert nodes[8][2:4] == (0.0008, 50.0008)
    assert [r[1:] for r in rows if r[0] == "way"][0] == (100, None, None, [("highway", "residential"), ("maxspeed", "30 mph"), ("oneway", "yes")], [1, 2, 3])
    assert pbf.read_pbf(spark, f"{tmp_path}/a.osm.pbf", kinds="way").count() == 5


def test_links_by_segment_and_by_junction(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.osm.pbf").write_bytes(made_file())
    segments = pbf.read_network(spark, f"{tmp_path}/in", split_bytes=60)
    got = sorted((r["osm_way_id"], r["u"], r["v"], r["highway"], r["oneway"], r["maxspeed"]) for r in segments.collect())
    far = 10**10
    # Way 103 begins with a node twice and has one that the extract lacks; 102 isn't for driving, 104 no road.
    assert got == [
        (100, 1, 2, "residential", "yes", 30.0), (100, 2, 3, "residential", "yes", 30.0), (101, 2, 5, "primary", None, None), (101, 5, far, "primary", None, None),
        (101, 7, 2, "primary", None, None), (103, 5, 8, "residential", None, None),
    ]
    joined = pbf.read_network(spark, f"{tmp_path}/in", split="junction")
    # Nodes 2, 3 and 5 are on two ways.
    assert sorted((r["osm_way_id"], r["u"], r["v"], len(r["line"])) for r in joined.collect()) == [(100, 1, 2, 2), (100, 2, 3, 2), (101, 2, 5, 2), (101, 5, far, 2), (101, 7, 2, 2), (103, 5, 8, 2)]
    assert joined.select("link_id").distinct().count() == 6
    edges = roadnet.directed_edges(pbf.read_network(spark, f"{tmp_path}/in", zone=31), min_length_m=0.0)
    assert edges.count() == 2 + 2 * 4 and edges.where("length_m > 0").count() == 10
    with pytest.raises(ValueError, match="no road links"):
        pbf.read_network(spark, f"{tmp_path}/in", classes=("motorway",))
    with pytest.raises(ValueError, match="split"):
        pbf.network_links(segments, split="block")


def test_a_way_between_junctions_keeps_its_shape(spark):
    at = lambda n: ("node", n, n / 10, n % 3 / 10, None, None)
    rows = [at(n) for n in range(1, 10)] + [("way", 1, None, None, {"highway": "road"}, [1, 2, 3, 4, 5]), ("way", 2, None, None, {"highway": "road"}, [6, 3, 7]), ("way", 3, None, None, {"highway": "road"}, [8, 9, 8])]
    found = pbf.network_links(spark.createDataFrame(rows, pbf.SCHEMA), split="junction")
    got = sorted((r["osm_way_id"], r["u"], r["v"], [round(p["x"] * 10) for p in r["line"]]) for r in found.collect())
    assert got == [(1, 1, 3, [1, 2, 3]), (1, 3, 5, [3, 4, 5]), (2, 3, 7, [3, 7]), (2, 6, 3, [6, 3]), (3, 8, 8, [8, 9, 8])]
    assert pbf.network_links(spark.createDataFrame([], pbf.SCHEMA)).count() == 0


def test_what_the_sink_writes_is_read_back(spark, tmp_path):
    rows = [("node", i * 7 - 300, i / 997 - 0.5, -i / 1009, {"name": f"é{i}"} if i % 5 == 0 else None, None) for i in range(3000)]
    rows += [("way", i, None, None, {"highway": "road", "ref": str(i)}, [i * 7 - 300, (3 * i % 3000) * 7 - 300]) for i in range(500)]
    df = spark.createDataFrame(rows, pbf.SCHEMA).repartition(3)
    for _ in range(2):  # the second write takes the first one's place
        pbf.write_pbf(df, f"{tmp_path}/out")
    assert len([f for f in (tmp_path / "out").iterdir()]) == 3
    got = sorted((r["kind"], r["id"], r["lon"] and round(r["lon"], 7), r["lat"] and round(r["lat"], 7), r["tags"] or {}, r["refs"]) for r in pbf.read_pbf(spark, f"{tmp_path}/out", split_bytes=5000).collect())
    assert got == sorted((k, i, x and round(x, 7), y and round(y, 7), t or {}, r) for k, i, x, y, t, r in rows)
    with pytest.raises(Exception, match="other method|no block|byte"):
        (tmp_path / "bad.osm.pbf").write_bytes(b"\0\0\0\x05hello" * 9)
        pbf.read_pbf(spark, f"{tmp_path}/bad.osm.pbf").collect()
    with pytest.raises(Exception, match="missing.pbf"):
        pbf.read_pbf(spark, f"{tmp_path}/missing.pbf").count()


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1]
    assert pbf.packed(b"".join(map(varint, values))).tolist() == values
    signed = [0, -1, 1, -64, 2**62, -(2**63)]
    assert pbf.signed(pbf.packed(b"".join(map(zigzag, signed)))).tolist() == signed


def test_tags_of_numbers(spark):
    rows = [("node", 1, 0.0, 0.0, None, None), ("node", 2, 1.0, 0.0, None, None), ("way", 5, None, None, {"highway": "primary;secondary", "maxspeed": "walk", "lanes": "2;3"}, [1, 2])]
    r = pbf.network_links(spark.createDataFrame(rows, pbf.SCHEMA)).select("link_id", "maxspeed", "lanes", F.size("line").alias("n")).first()
    assert tuple(r) == (5 << 16, None, 2.0, 2)
