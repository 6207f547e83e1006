"""The pipeline's stages on a fixture whose answers are known."""

import random

import corpus_pipeline
from roadweave.llm.common import table

from .conftest import COLUMNS, DATA, ODD, documents
from .test_toxicity_repeats import made_corpus


def prose(r, n=120):
    return "\n".join(" ".join(f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.randrange(1000)}" for _ in range(12)) for _ in range(n // 12))


def test_stages_on_planted_cases(spark, tmp_path):
    r = random.Random(9)
    rows, labels = made_corpus(300)
    clean = [(1000 + i, prose(r)) for i in range(40)]
    copies = [(2000 + i, clean[i][1]) for i in range(5)]
    item = " ".join(f"question{i}" for i in range(30))
    leaks = [(3000 + i, prose(r) + "\n" + item + "\n" + prose(r)) for i in range(3)]
    toxic = {i for i, y in labels if y}
    full = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in [*rows, *clean, *copies, *leaks]]
    folder = str(tmp_path)
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = table(spark, folder, "documents"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        path = f"{folder}/stage{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({x["doc_id"]: x["text"] for x in docs.collect()})
    detoxed, lined, single, clear, mixed = seen
    assert len(toxic & set(detoxed)) <= 3 and {i for i, _ in clean + copies + leaks} <= set(detoxed)
    assert set(lined) == set(detoxed) and all(len(lined[i]) < len(detoxed[i]) for i, _ in copies)
    assert {i for i, _ in clean} <= set(single)
    assert {i for i, _ in leaks} & set(clear) == set() and {i for i, _ in clean} <= set(clear)
    assert set(mixed) <= set(clear) and mixed


def test_run_on_the_given_tables(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    assert out.count() > 0 and out.where("copies < 1").count() == 0


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    rows, labels = made_corpus(60)
    folder = str(tmp_path)
    spark.createDataFrame([*[(i, 1, y) for i, y in labels], (None, 1, 1), (1, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "question " * 3), (1, None), (None, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    odd = documents(spark, [*ODD, *[(100 + i, t) for i, t in rows], (160, "one"), (None, None)])
    for docs in (odd, odd.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            path = f"{folder}/{docs.isEmpty()}{i}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    kept = corpus_pipeline.drop_near_copies(spark, odd, folder).select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in kept]
    assert {1, 2, 5, 7, 8, 9} <= set(ids) and not {3, 4, 6, 160} & set(ids) and ids.count(7) == 2
    assert sum(i is None for i in ids) == 4
    lined = corpus_pipeline.drop_repeated_lines(spark, odd, folder)
    assert lined.count() == odd.count() and lined.where("doc_id = 2").first()["text"] is None
