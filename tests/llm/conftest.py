import pytest

from roadweave.llm.common import table

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside.
EXTRA = "id string, u string, d string, t string, fp string, anchor string, w0 string, score string, copies string, starts string, lines string, n_removed string"


def documents(spark, rows):
    """Documents of (doc_id, text) with columns whose names clash with those operators use."""
    full = [(i, t, "en" if i is None or i % 2 else None, None if i == 3 else f"src{(i or 0) % 3}", None if t is None else len(t), *["x"] * 12) for i, t in rows]
    return spark.createDataFrame(full, f"{COLUMNS}, {EXTRA}")


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, DATA, "documents")


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS * 30)
#: Nulls, empty and very long texts, ties, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog\nand then it sleeps under the old tree all day long"), (2, None), (3, ""), (4, " \n\t "), (5, LONG),
    (6, "the quick brown fox jumps over the lazy dog\nand then it sleeps under the old tree all day long"), (7, "one"), (7, "one"), (8, "two words"), (None, None), (None, LONG),
    (None, "a text without an id that has some words in it"), (9, "Ünïcode — ßtraße 日本語 😀 " * 20),
]
