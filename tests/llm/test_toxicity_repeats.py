import hashlib
import random
import zlib

from roadweave.llm import queries, repeats, toxicity
from roadweave.llm.common import table

from .conftest import DATA, ODD, documents


def made_corpus(n=600, seed=3):
    """Texts of invented words, every fifth with words of a toxic stem."""
    r = random.Random(seed)
    parts = ["ka", "lo", "mi", "ren", "tu", "sa", "vor", "pel", "dim", "ost"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        toxic = int(i % 5 == 2)
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "grumz" + r.choice(parts) + r.choice(parts))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made_corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    held = [(r["score"], dict(labels)[r["doc_id"]]) for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 80
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.97
    kept = {r["doc_id"] for r in toxicity.reject_toxic(docs, marks).collect()}
    assert len([i for i, y in labels if y and i in kept]) < 6 and len([i for i, y in labels if not y and i not in kept]) < 6


def test_labels_of_fold_0_are_not_learnt(spark):
    rows, labels = made_corpus(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(x, "doc_id bigint, toxic int"))).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_toxicity_of_odd_rows(spark):
    rows, labels = made_corpus(200)
    marks = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    odd = documents(spark, ODD)
    out = toxicity.score(odd, toxicity.train(docs, marks), name="how_toxic")
    got = out.collect()
    assert len(got) == len(ODD) and all(0 <= r["how_toxic"] <= 1 for r in got)
    assert toxicity.reject_toxic(odd, marks).columns == odd.columns
    none = toxicity.score(odd, toxicity.train(odd, marks.limit(0)), name="s").collect()
    assert {r["s"] for r in none} == {0.5}
    assert toxicity.reject_toxic(odd.limit(0), marks).count() == 0


def brute_repeats(rows):
    """(n_bytes, n_removed, n_spans, sha256 of what is left) by a dictionary of all strings of 50 bytes; null ids are the largest."""
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            least[s] = min(least.get(s, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < key(i):
                hit[k : k + 50] = b"\1" * 50
        left = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        spans = sum(hit[k] and (k == 0 or not hit[k - 1]) for k in range(len(b)))
        out.append((str(i), len(b), sum(hit), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def found_repeats(df):
    from pyspark.sql import functions as F

    out = repeats.repeated_spans(df).withColumn("text", F.coalesce("text", F.lit("")))
    left = repeats.kept_bytes(F.col("text"), F.col("starts"), F.col("ends"))
    rows = out.select("doc_id", F.octet_length("text").alias("n"), "starts", "ends", F.sha2(left, 256).alias("h")).collect()
    return sorted((str(r["doc_id"]), r["n"], sum(r["ends"]) - sum(r["starts"]), len(r["starts"]), r["h"]) for r in rows)


def test_repeats_of_a_table(spark, docs):
    got = {r["doc_id"]: r for r in queries.op8_repeats(spark, DATA).collect()}
    for i, n, removed, spans, left in brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()]):
        r = got[int(i)]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, left)
    assert len(got) == table(spark, DATA, "documents").count()


def test_repeats_of_odd_rows(spark):
    rows = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in ODD]
    rows += [(20, "ab" * 200), (21, "ab" * 100 + "c"), (22, "x" * 49), (23, "x" * 49), (24, "x" * 50), (25, "x" * 51), (26, "é" * 40), (27, "zz" + "é" * 40)]
    assert found_repeats(documents(spark, rows)) == brute_repeats(rows)
    assert repeats.repeated_spans(documents(spark, [])).count() == 0


def test_repeats_when_regions_are_grouped_by_spark(spark, monkeypatch):
    r = random.Random(1)
    passage = "".join(r.choice("abcd ") for _ in range(400))
    rows = [(i, "".join(r.choice("abcd ") for _ in range(r.randint(0, 200))) + passage[r.randint(0, 100) : r.randint(200, 400)]) for i in range(60)]
    for size in (repeats.ANCHOR_BYTES, 0):
        monkeypatch.setattr(repeats, "ANCHOR_BYTES", size)
        assert found_repeats(documents(spark, rows)) == brute_repeats(rows)
