import hashlib
import random

import pytest

from roadweave.llm import minhash, tokens

from .conftest import ODD, documents


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_of_a_table(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in minhash.compare_with_next(docs).collect()}
    assert len(got) == len(rows)
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(r["text"]) // 3
        new = r["text"][: len(r["text"]) - n] + after["text"][:n]
        g = got[r["doc_id"]]
        assert g["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and g["n_chars"] == len(r["text"])
        a, b, c = shingles(r["text"]), shingles(new), shingles(after["text"])
        assert abs(g["near_edited"] - len(a & b) / len(a | b)) < 0.25 and abs(g["near_next"] - len(a & c) / len(a | c)) < 0.25
        assert g["fingerprint"] == minhash.signature(r["text"]).tobytes()


def test_odd_rows(spark):
    rows = minhash.compare_with_next(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["fingerprint"] == by[6][0]["fingerprint"] and by[2][0]["fingerprint"] == by[3][0]["fingerprint"]
    assert by[3][0]["near_next"] == 1.0  # an empty text before a null one
    one = minhash.compare_with_next(documents(spark, [(1, "alone in the table")])).collect()
    assert one[0]["near_next"] == 1.0
    assert minhash.compare_with_next(documents(spark, [])).count() == 0


def test_pairs_against_brute_force(spark, docs):
    rows, classes = docs.collect(), {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        classes.setdefault(r["text"], r["doc_id"])
    sets = [(i, shingles(t)) for t, i in classes.items()]
    words = " ".join(f"word{i}" for i in range(60))
    near = [(10_001, words), (10_002, words + " more"), (10_003, words + " other"), (10_004, words)]
    sets += [(i, shingles(t)) for i, t in near[:3]]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) >= 0.8 * len(x | y)}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id bigint, text string"))
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in want:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    class_of = classes | {t: i for i, t in reversed(near)}
    expected = {i: (class_of[t], top(class_of[t])) for i, t in [*((r["doc_id"], r["text"]) for r in rows), *near]}
    for chunk in (1024, 1):
        got = minhash.near_duplicates(df, chunk=chunk).collect()
        assert {r["doc_id"]: (r["class_id"], r["component_id"]) for r in got} == expected
        assert {r["class_id"] for r in got if r["n_links"]} == {i for pair in want for i in pair}
        assert sum({r["class_id"]: r["n_links"] for r in got}.values()) <= 2 * len(want)
    assert want >= {(10_001, 10_002), (10_002, 10_003)}


def test_near_duplicates_of_odd_rows_and_of_a_group(spark):
    got = [tuple(r) for r in minhash.near_duplicates(documents(spark, ODD)).collect()]
    assert len(got) == len(ODD)
    by = {i: (c, k, n) for i, c, k, n in got if i is not None}
    assert by[6] == (1, 1, 0) and by[2] == by[3] == (2, 2, 0) and by[4] == (4, 4, 0) and by[5][1] == 5
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    words = [f"word{i}" for i in range(100)]
    group = [(i, " ".join([*words[:50], f"own{i}", *words[50:]])) for i in range(150)]
    rows = minhash.near_duplicates(spark.createDataFrame(group, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in rows} == {0} and sum(r["n_links"] for r in rows) < 150 * 40


def greedy(pieces, word):
    n = i = 0
    longest = max(map(len, pieces), default=1)
    while i < len(word):
        fits = [k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces]
        i += fits[0] if fits else 1
        n += 1
    return n


@pytest.mark.parametrize("seed", range(20))
def test_automaton_against_greedy_matching(seed):
    r = random.Random(seed)
    pieces = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 12))}
    a = tokens.Automaton(pieces)
    for _ in range(200):
        word = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 20)))
        assert a.count(word) == greedy(pieces, word), (pieces, word)


def test_counts_of_odd_rows(spark):
    pieces = tokens.read_vocabulary()
    known = set(pieces)
    rows = tokens.count_tokens(documents(spark, ODD), pieces).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        words = (r["text"] or "").encode().split()
        assert r["n_words"] == len(words)
        if len(words) < 1000:
            assert r["n_tokens"] == sum(greedy(known, b" " + w) for w in words)
    assert tokens.count_tokens(documents(spark, []), pieces).count() == 0
