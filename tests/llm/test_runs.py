"""Line runs of the corpus stage against brute force."""

import random

import corpus_pipeline
import pytest
from roadweave.llm import linededup

from .conftest import ODD, documents


def brute(rows):
    """What stays of (id, text) with ids that differ, None first."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, gone = (text or "").split("\n"), set()
        for p in range(len(lines) - 1):
            at = first.setdefault((lines[p], lines[p + 1]), (i, p))
            if at != (i, p):
                gone |= {p + 1} if at == (i, p - 1) else {p, p + 1}
        out[i] = (None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


def made():
    r = random.Random(4)
    pool = [f"line number {i} of the pool" for i in range(60)] + ["", "", "x"]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.6 else f"own {r.random()}" for _ in range(r.randrange(1, 20))) for _ in range(120)]
    texts += [texts[3], texts[5] + "\nend", "a\na\na\na\na", "a\na", None, "", "one", "one"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bits", [64, 5])
def test_equals_brute_force_whatever_the_hashes_share(spark, bits):
    rows = made()
    out = linededup.dedup_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), bits=bits).collect()
    assert {x["doc_id"]: (x["text"], x["n_removed"]) for x in out} == brute(rows)


def test_short_passages_leave_the_corpus_whole(spark):
    """Every shared run of two, three and four lines goes, wherever the chunks' cuts fall; single lines stay."""
    runs = [[f"shared {k} {j} some words" for j in range(2 + k % 3)] for k in range(30)]
    first = [(k, "\n".join([f"a{k}", *run, f"b{k}"])) for k, run in enumerate(runs)]
    again = [(100 + k, "\n".join([f"c{k}", *run, f"d{k}"])) for k, run in enumerate(runs)]
    single = [(200, f"e\n{runs[0][0]}\nf")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in first + again + single], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {x["doc_id"]: x for x in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert all(out[i]["text"] == t for i, t in first + single)
    assert all(out[100 + k]["text"] == f"c{k}\nd{k}" and out[100 + k]["n_chars"] == len(f"c{k}\nd{k}") for k in range(30))


def test_odd_rows(spark):
    df = documents(spark, ODD)
    out = linededup.dedup_runs(df)
    assert out.columns[: len(df.columns)] == df.columns and out.count() == len(ODD)
    assert linededup.dedup_runs(df.limit(0)).count() == 0
