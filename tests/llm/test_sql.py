"""Operators that SQL can express: held against their SQL by DuckDB."""

import glob
import os

import duckdb
import pytest

from roadweave.llm import decontaminate, linededup, mixing, queries

from .conftest import DATA, ODD, documents


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    found = queries.queries()[name](spark, DATA)
    want = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())


def test_line_chunks_on_odd_rows(spark):
    df = documents(spark, ODD)
    out = linededup.dedup_lines(df)
    assert [c for c in out.columns if c in df.columns] == df.columns and len(out.columns) == len(df.columns) + 2
    rows = out.collect()
    assert len(rows) == len(ODD)
    texts = [(r["doc_id"], r["text"]) for r in rows]
    assert (2, None) in texts and (3, "") in texts and texts.count((7, "one")) == 2
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_passages_of_lines_go_wherever_they_stand(spark):
    passage = [f"line {i} of the passage that all share" for i in range(40)]
    texts = [(i, "\n".join([f"own {i} {k}" for k in range(i)] + passage + [f"end {i}"])) for i in range(1, 6)]
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert rows[1]["n_removed"] == 0 and rows[1]["text"] == texts[0][1]
    for i in range(2, 6):
        assert rows[i]["n_removed"] > 25 and rows[i]["text"].startswith(f"own {i} 0\n") and rows[i]["text"].endswith(f"end {i}")


def test_containment_on_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, "The quick, brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, "two words"), (5, " ".join(f"w{i}" for i in range(390, 400)) + " w0 w1"), (5, None), (None, "one")],
        "item_id bigint, text string",
    )
    df = documents(spark, ODD)
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained_items(df, items).collect()}
    assert got == {(1, 1): 1.0, (6, 1): 1.0, (8, 4): 1.0, (5, 5): 1.0, (None, 5): 1.0, (7, None): 1.0}
    kept = decontaminate.remove_contaminated(df, items)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 9}
    assert decontaminate.contained_items(df.limit(0), items).count() == decontaminate.contained_items(df, items.limit(0)).count() == 0


def test_every_share_of_a_size_partition_is_found(spark):
    """Items of many sizes, held at just the threshold by a document that has the rest of the shingles changed."""
    items, docs = [], []
    for n in (1, 2, 3, 5, 8, 9, 16, 17, 40):
        words = [f"a{n}x{i}" for i in range(n + 4)]
        keep = -(-8 * n // 10)
        items.append((n, " ".join(words)))
        docs.append((n, " ".join(words[: keep + 4])))
        docs.append((100 + n, " ".join(words[: keep + 3])))
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [n for n, _ in items]


def test_mixing_shares_shortages_among_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 50), ("b", "y", 60)], "p string, q string, capacity bigint")
    got = {(r["p"], r["q"]): r["share"] for r in mixing.share_out(leaves, ["p", "q"], {}, 600).collect()}
    # b can't use its 300: it takes all of its 110, and a the other 490, of which x has but 10.
    assert got == {("a", "x"): 10.0, ("a", "y"): 480.0, ("b", "x"): 50.0, ("b", "y"): 60.0}


def test_mixing_on_odd_rows(spark):
    df = documents(spark, ODD)
    rows = mixing.mix(df, queries.levels(), queries.WEIGHTS).collect()
    assert len(rows) == len(ODD) - 1  # the repeated row counts once
    chosen = mixing.take(df, queries.levels(), queries.WEIGHTS)
    assert chosen.columns == [*df.columns, "_copies"]
    assert mixing.mix(df.limit(0), queries.levels(), queries.WEIGHTS).count() == 0
    total, taken = sum(r["n_tokens"] for r in rows), sum(r["n_tokens"] * r["copies"] for r in rows)
    assert taken <= 0.6 * total
