import hashlib
import random
import zlib

from pyspark.sql import functions as F

from roadweave.llm import trie

from .conftest import DATA

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, number bigint, place string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    """Brute force over (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    nodes = {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 6
        turns = convs.get(c - c % 100, [])[:h] + convs[c][h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children.get(k, [])) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children.get(k, []))
    return sorted(
        (nodes[k][0][0], len(k), nodes[k[:-1]][0][0] if k else -1, len(nodes[k]), len(children.get(k, [])), leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c, end in nodes[k] if end).encode()).hexdigest()) for k in nodes
    )


def rows_of(df):
    assert df.columns == FIELDS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_whole_table_by_long_lists_and_small_blocks(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = plain_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(trie.prefix_trie(table)) == want
    assert rows_of(trie.prefix_trie(table, sparse=4, whole=60, block=7)) == want


def test_odd_conversations(spark):
    rows = [(c, t, "user", "hello") for c in range(300, 340) for t in range(7)]  # a large group of equal ones
    rows += [(400, 0, "user", "a"), (400, 1, None, "b" * 50_000), (401, 0, "user", "a"), (401, 1, "", "b" * 50_000), (402, None, "user", "ü😀"), (402, 0, "user", "a"), (402, 0, "user", "a")]
    rows += [(507, 0, "u", "base is absent"), (None, 0, "user", "no id"), (508, 1, None, None), (508, 1, None, None), (509, 3, "us", "er"), (510, 3, "u", "ser")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert rows_of(trie.prefix_trie(df)) == plain_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_lists_are_ranked_at_every_length(spark):
    r = random.Random(3)
    for n in (1, 2, 40, 500):
        order = list(range(n))
        r.shuffle(order)
        rows = [(a, b, 1 + a % 3) for a, b in zip(order, [*order[1:], None])]
        want, at = {}, 0
        for a, _, step in reversed(rows):
            at += step
            want[a] = at
        df = spark.createDataFrame(rows, "arc bigint, nxt bigint, step bigint")
        for whole in (1000, 12):
            assert {x["arc"]: x["rank"] for x in trie.list_rank(df, n, 4, whole).collect()} == want


def test_prefix_sums_over_levels_of_blocks(spark):
    df = spark.range(100).select(F.col("id").alias("position"), (F.col("id") * 7 % 11).alias("v"))
    got = {r["position"]: r["v"] for r in trie.prefix_sums(df, 100, ["v"], 3).collect()}
    assert got == {i: sum(k * 7 % 11 for k in range(i + 1)) for i in range(100)}
