import random

import xxhash

from roadweave.llm import simhash
from roadweave.llm.components import connected_components

from .conftest import ODD, documents


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """Smallest id reachable, by brute force over (id, fingerprint)."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in fps:
        for b, y in fps:
            if a < b and (x ^ y).bit_count() <= radius:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i, _ in fps}


def test_whole_table_against_brute_force(spark, docs):
    found = {r["doc_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: f for i, (f, _) in found.items()} == fps
    assert {i: c for i, (_, c) in found.items()} == components(sorted(fps.items()))


def test_links_of_chains_and_dense_groups_survive_small_chunks(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(40)} | {0}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "f bigint")
    for chunk in (2048, 5):
        roots = {row["node"]: row["root"] for row in connected_components(simhash.fingerprint_links(df, "f", 3, chunk), "a", "b").collect()}
        groups = {}
        for (f,) in signed:
            groups.setdefault(roots.get(f, f), set()).add(f % 2**64)
        want = {}
        for f, c in components([(f, f) for f in sorted(fps)]).items():
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(200)] + [(5, 5), (None, 3), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_odd_rows(spark):
    df = documents(spark, ODD)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["fingerprint"] == by[3][0]["fingerprint"] == by[4][0]["fingerprint"] == 0
    assert {by[i][0]["component_id"] for i in (2, 3, 4)} == {2}
    assert by[6][0]["component_id"] == 1 and len(by[7]) == 2 and by[7][0]["component_id"] == 7
    assert {5, 2} <= {r["component_id"] for r in by[None]}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 2, 5, 7, 7, 8, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
