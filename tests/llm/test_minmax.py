import random

import numpy as np
import pytest

from roadweave.llm import minmax

from .conftest import ODD, documents


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_components(texts):
    """doc_id to (n_shingles, component_id) by comparison of all pairs that share a shingle."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in texts}


def found(df, **options):
    rows = minmax.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_whole_table_against_brute_force(spark, docs):
    assert found(docs) == plain_components({r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("chunk", [1024, 4])
def test_pairs_just_at_the_threshold_and_groups_of_copies(spark, chunk, monkeypatch):
    """Sets of n shingles whose last words differ: 17 of 20 of the union shared is linked, one less is not."""
    texts, at = {}, 0
    for n in (17, 34, 51, 170):
        for less in (0, 1):
            base = [f"n{n}l{less}w{i}" for i in range(n + 2)]
            more = [f"x{n}l{less}w{i}" for i in range(3 * n // 17 + less)]
            texts[at], texts[at + 1] = " ".join(base), " ".join(base + more)
            at += 2
    r = random.Random(4)
    common = [f"c{i}" for i in range(120)]
    for i in range(60):  # a large group of near copies, each with two words changed
        words = list(common)
        for _ in range(2):
            words[r.randrange(120)] = f"new{i}"
        texts[1000 + i] = " ".join(words)
    if chunk == 4:
        monkeypatch.setattr(minmax, "BROADCAST_KEYS", 0)  # the way for many candidates
    want = plain_components(texts)
    assert [want[i][1] for i in range(0, at, 2)] == list(range(0, at, 2))
    assert [want[i][1] - i for i in range(1, at, 2)] == [-1, 0] * 4
    assert found(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), chunk=chunk) == want


def test_odd_rows(spark):
    df = documents(spark, ODD)
    rows = minmax.near_duplicates(df).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (2, 3, 4):
        assert (by[i][0]["n_shingles"], by[i][0]["component_id"], by[i][0]["kept"]) == (0, i, True)
    assert by[6][0]["component_id"] == 1 and not by[6][0]["kept"] and len(by[7]) == 2 and by[7][0]["kept"]
    assert sorted((r["component_id"] or -1, r["kept"]) for r in by[None]) == [(-1, True), (-1, True), (5, False)]
    assert minmax.near_duplicates(df.limit(0)).count() == 0


def test_both_ends_of_a_function_are_unbiased():
    r = np.random.default_rng(8)
    whole = r.integers(0, 1 << 63, 1200, dtype=np.uint64)
    agree = [np.mean(minmax.signature(whole[k : k + 850]) == minmax.signature(whole[k : k + 1000])) for k in range(0, 200, 5)]
    assert abs(np.mean(agree) - 0.85) < 0.02
