import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from roadweave.llm import resample

from .conftest import DATA, ODD, documents


def plain_features(text, n_min, n_max):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), Counter(crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(n_min, n_max + 1) for i in range(len(words) - n + 1))


def plain_resample(texts, target, n_min=1, n_max=1):
    feats = [plain_features(t, n_min, n_max) for _, t in texts]
    s, t = Counter(), Counter()
    for _, f in feats:
        s.update(f)
    for x in target:
        t.update(plain_features(x, n_min, n_max)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    rows = []
    for (i, _), (n_words, f) in zip(texts, feats):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * n for b, n in f.items())
        rows.append((i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[: 10 * len(order) // 100])}
    return sorted((-1 if r[0] is None else r[0], *r[1:4], rank.get(id(r), 0)) for r in rows)


def rows_of(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((-1 if r[0] is None else r[0], *r[1:4], r[4] or 0) for r in df.collect())


@pytest.mark.parametrize("n", [(1, 1), (1, 3), (2, 2)])
def test_whole_table_against_brute_force(spark, docs, n, monkeypatch):
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], *n)
    assert rows_of(resample.resample(docs, target, n_min=n[0], n_max=n[1])) == want


def test_features_do_not_cross_documents():
    texts = ["One, two THREE.".encode(), b"", "été 4".encode(), b"...", b"a b"]
    got = resample.features(texts, 1, 3, 10_000)
    assert got.n_words.tolist() == [3, 0, 2, 0, 2]
    for i, t in enumerate(texts):
        assert Counter(got.bucket[got.doc == i].tolist()) == plain_features(t.decode(), 1, 3)[1]


def test_odd_rows(spark, monkeypatch):
    df = documents(spark, ODD)
    items = spark.createDataFrame([(1, "the quick brown fox"), (2, None), (3, "")], "item_id bigint, text string")
    assert rows_of(resample.resample(df, items)) == plain_resample([(i, t) for i, t in ODD], ["the quick brown fox", None, ""])
    assert rows_of(resample.resample(df, items.limit(0))) == plain_resample([(i, t) for i, t in ODD], [])
    assert resample.resample(df.limit(0), items).count() == 0
    monkeypatch.setattr(resample, "BATCH_BYTES", 10)
    assert resample.features([b"a"], 1, 1, 10).n_words.tolist() == [1]
