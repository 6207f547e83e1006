"""The corpus stage's near copies against brute force."""

import random

import corpus_pipeline
import pytest
from roadweave.llm import simhash
from roadweave.llm.components import connected_components

from .conftest import ODD, documents


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots_of(rows):
    """Smallest place reachable over near copies."""
    fps, sets, root = [simhash.text_fingerprint(t, 5) for _, t in rows], [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= simhash.WIDE_RADIUS and len(sets[a] & sets[b]) >= 0.8 * union:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    return root


def made():
    """Groups of copies that change words near the threshold, ids falling so that kept rows come anywhere."""
    r = random.Random(8)
    words, rows = [f"w{i}" for i in range(500)], []
    for _ in range(15):
        base = [r.choice(words) for _ in range(r.randrange(40, 160))]
        for _ in range(8):
            new = list(base)
            for _ in range(r.randrange(0, 6)):
                new[r.randrange(len(new))] = r.choice(words)
            rows.append(" ".join(new))
    rows += ["", None, " \n", "one", "ONE", "two words", rows[0]]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_every_mask_table_covers_the_radius():
    r = random.Random(1)
    masks = [m % 2**64 for m in simhash.wide_masks()]
    assert len(masks) == 93
    for _ in range(20000):
        diff = sum(1 << i for i in r.sample(range(64), simhash.WIDE_RADIUS))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("chunk", [simhash.WIDE_CHUNK, 5])
def test_links_connect_what_brute_force_connects(spark, chunk):
    rows = made()
    root = roots_of(rows)
    links = simhash.verified_links(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=chunk)
    found = {x["node"]: x["root"] for x in connected_components(links, "a", "b").collect()}
    node = {x["text"]: x["n"] for x in spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("text", "xxhash64(coalesce(text, '')) n").collect()}
    groups = [found.get(node[t], node[t]) for _, t in rows]
    assert len(set(zip(groups, root))) == len(set(groups)) == len(set(root))


def test_stage_drops_near_copies_and_nothing_else(spark):
    rows = made()
    root = roots_of(rows)
    df = documents(spark, rows)
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert {x["doc_id"] for x in kept.select("doc_id").collect()} == {i for i, _ in rows if root[i] == i}


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    r = random.Random(3)
    base = " ".join(f"a{r.randrange(1000)}" for _ in range(100))
    rows = [(1, base), (2, base + " more"), (2, " ".join(f"b{r.randrange(1000)}" for _ in range(100))), (None, base)]
    kept = simhash.keep_one(documents(spark, rows))
    assert sorted((x["doc_id"] or 0, x["text"]) for x in kept.collect()) == sorted((i or 0, t) for i, t in [rows[0], rows[2], rows[3]])
    assert simhash.keep_one(documents(spark, ODD).limit(0)).count() == 0
