"""Prefix tries of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Its key is a SHA-256 over the turns' own digests, so that texts never
meet in a join. Nodes are numbered in the order of (parent's key, key), which puts siblings side by side; every node
has an enter and an exit arc, each of which names the arc after it on the tour through the trie. The tour is a linked
list over all tasks. ``list_rank`` numbers it: arcs run to the next of some randomly chosen ones by doubling, the
chosen ones are a list a sixteenth as long that is ranked the same way, and the rest follow. What lies in a node's
subtree is then a difference of two prefix sums, at its exit arc and at its enter arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, numbered, settle, text_of

#: One of so many arcs is chosen for the shorter list.
SPARSE = 16
#: Arcs of a list that one task ranks (24 bytes each).
WHOLE = 200_000
#: Rows of a block of positions or numbers.
BLOCK = 1 << 13
#: Ids that are joined to one string before a node's are hashed one after another.
IDS = 1 << 10
_ROOT = hashlib.sha256(b"").digest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 (hex) of a turn; the role's length keeps role and text apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, digest, size) with place, from 0, in the order of turn (null first; ties by digest)."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.withColumn("place", F.row_number().over(order) - 1)


def shared_openings(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Rows (conv, depth, digest, size) of rebuilt conversations, and (conv, 0) of each.

    turns has (conv, place, digest, size). Conversation c takes the first h turns of conversation c - c % group, all if
    it has fewer and none if there is none, then its own after its first h; h is the CRC-32 of c's decimal digits modulo most.
    """
    heads = turns.select("conv").distinct().withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int"))
    heads = settle(heads.withColumn("base", F.col("conv") - F.col("conv") % group), "heads")
    opening = turns.where((F.col("conv") % group == 0) & (F.col("place") < most - 1))
    opening = opening.select(F.col("conv").alias("base"), "place", "digest", "size").join(heads, "base").where(F.col("place") < F.col("h"))
    own = turns.join(heads.select("conv", "h"), "conv").where(F.col("place") >= F.col("h"))
    # The base's turns go before the conversation's own, whose places may leave a gap if the base is short.
    both = opening.select("conv", F.lit(0).alias("part"), "place", "digest", "size").unionByName(own.select("conv", F.lit(1).alias("part"), "place", "digest", "size"))
    roots = heads.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("bigint").alias("size"))
    return roots.unionByName(both)


_PREFIX = "conv bigint, depth bigint, key binary, parent binary, size bigint, ends boolean"
_PREFIX_NAMES = ["conv", "depth", "key", "parent", "size", "ends"]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of all prefixes of conversations whose rows (conv, digest, size) come in order, the root's first. Holds one row."""
    held, state, depth, key = None, hashlib.sha256(), 0, _ROOT

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_PREFIX_NAMES)

    for batch in batches:
        rows = []
        for conv, digest, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None:
                rows.append((*held, digest is None))
            if digest is None:
                state, depth, key = hashlib.sha256(), 0, _ROOT
                held = (conv, 0, _ROOT, None, 0)
            else:
                state.update(bytes.fromhex(digest))
                parent, key, depth = key, state.digest(), depth + 1
                held = (conv, depth, key, parent, size)
        if rows:
            yield batch_of(rows)
    if held is not None:
        yield batch_of([(*held, True)])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings (key, ids), which come in order, joined by commas. Holds one string."""
    at, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                if at is not None:
                    done.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["key", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def ends_digest(prefixes: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256) of the nodes where conversations end: the SHA-256 of their ids, ascending, joined by commas."""
    ends = prefixes.where("ends").select("key", "conv", F.floor(F.col("conv") / IDS).alias("part"))
    parts = ends.groupBy("key", "part").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))
    return parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(_listed, "key binary, ends_sha256 string")


def _rank_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks a list of at most WHOLE arcs (arc, nxt, step) by doubling."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    arc, nxt, step = (np.concatenate([b.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for i in range(3))
    order = np.argsort(arc)
    arc, nxt, rank = arc[order], nxt[order], step[order]
    at = np.where(nxt < 0, len(arc), np.searchsorted(arc, nxt))
    at, rank = np.append(at, len(arc)), np.append(rank, 0)  # the end follows itself
    while (at[:-1] < len(arc)).any():
        rank, at = rank + rank[at], at[at]
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(rank[:-1])], names=["arc", "rank"])


def list_rank(arcs: DataFrame, n: int, sparse: int = SPARSE, whole: int = WHOLE, seed: int = 0) -> DataFrame:
    """Rows (arc, rank) of a linked list of n arcs (arc, nxt, step), settled: the sum of steps from an arc to the list's end.

    nxt is null at the end. Lists of up to ``whole`` arcs are ranked by one task, which holds no more than that.
    Of longer ones one of ``sparse`` is chosen by a hash; every arc runs on to the next chosen one or the end, doubling
    its reach in each round (so a round or two more than the logarithm of sparse for most, and few remain after that);
    the chosen arcs are a list of their own.
    """
    if n <= whole:
        return settle(arcs.select("arc", "nxt", "step").coalesce(1).mapInArrow(_rank_whole, "arc bigint, rank bigint"), "ranks")
    chosen = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(sparse)) == 0
    over = lambda c: F.col(c).isNull() | chosen(F.col(c))
    now = settle(arcs.select("arc", "nxt", "step", over("nxt").alias("over")), "jumps")
    while not now.where("NOT over").isEmpty():
        to = now.select(F.col("arc").alias("nxt"), F.col("nxt").alias("n2"), F.col("step").alias("s2"), F.col("over").alias("o2"))
        moved = now.where("NOT over").join(to, "nxt").select("arc", F.col("n2").alias("nxt"), (F.col("step") + F.col("s2")).alias("step"), F.col("o2").alias("over"))
        after = settle(now.where("over").unionByName(moved), "jumps")
        forget(now)
        now = after
    few = settle(now.where(chosen(F.col("arc"))), "chosen")
    ranked = list_rank(few, few.count(), sparse, whole, seed + 1)
    after = now.where("nxt IS NOT NULL").join(ranked.select(F.col("arc").alias("nxt"), "rank"), "nxt").select("arc", (F.col("step") + F.col("rank")).alias("rank"))
    out = settle(after.unionByName(now.where("nxt IS NULL").select("arc", F.col("step").alias("rank"))), "ranks")
    for done in (now, few, ranked):
        forget(done)
    return out


def prefix_sums(rows: DataFrame, n: int, columns: list[str], block: int = BLOCK) -> DataFrame:
    """rows with each of columns replaced by its sum up to the row's position; positions are 0 to n - 1.

    Blocks of positions are summed first, their totals in the same way while they are many, and each block goes on from its own.
    """
    inside = Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    blocked = rows.withColumn("block", F.floor(F.col("position") / block))
    if n <= block:
        return blocked.withColumns({c: F.sum(c).over(inside) for c in columns}).drop("block")
    totals = blocked.groupBy(F.col("block").alias("position")).agg(*[F.sum(c).alias(c) for c in columns])
    upto = prefix_sums(totals, -(-n // block), columns, block).select((F.col("position") + 1).alias("block"), *[F.col(c).alias(f"before_{c}") for c in columns])
    summed = blocked.join(upto, "block", "left").withColumns({c: F.sum(c).over(inside) + F.coalesce(F.col(f"before_{c}"), F.lit(0)) for c in columns})
    return summed.drop("block", *[f"before_{c}" for c in columns])


def tour(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """Arcs (arc, nxt, step): 2i enters node i and 2i + 1 leaves it; the root's exit is the last.

    nodes has (number, parent_last, parent_number): its family's last number and its parent's number, null for the
    root. families has (number, first) of nodes with children.
    """
    enter = nodes.select("number").join(families.select("number", "first"), "number", "left")
    enter = enter.select((2 * F.col("number")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("number") + 1).alias("nxt"))
    leave = F.when(F.col("number") < F.col("parent_last"), 2 * F.col("number") + 2).otherwise(2 * F.col("parent_number") + 1)
    leave = nodes.select((2 * F.col("number") + 1).alias("arc"), leave.alias("nxt"))
    return enter.unionByName(leave).withColumn("step", F.lit(1).cast("bigint"))


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    group: int = 100, most: int = 6, sparse: int = SPARSE, whole: int = WHOLE, block: int = BLOCK,
) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one for each node.

    Conversations are rebuilt first (see shared_openings). A depth-d node is a distinct sequence of first d turns (role
    and text, null as empty), the root has none; its members are the conversations that start with it, and conv_id is
    the smallest. n_leaves counts childless nodes of its subtree, its own included; saved_tokens sums (n_convs - 1)
    times the code points of the last text over the subtree. Turns are ordered with null first, ties by their digest;
    repeated rows are turns of their own. Rows without a conversation id are ignored, and so are other columns. Without
    rows there is no node. A conversation's turns are ordered and hashed by one task, as a stream.
    """
    role, text = text_of(role_col), text_of(text_col)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), turn_digest(role, text).alias("digest"), F.char_length(text).cast("bigint").alias("size")
    )
    turns = settle(_placed(rows).drop("turn"), "turns")
    rebuilt = shared_openings(turns, group, most).repartition("conv").sortWithinPartitions("conv", "part", "place")
    prefixes = settle(rebuilt.select("conv", "digest", "size").mapInArrow(_chained, _PREFIX), "prefixes")
    counted = prefixes.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size")
    )
    nodes = settle(numbered(counted, "number", F.col("parent").asc_nulls_first(), F.col("key")), "nodes")
    n = nodes.count()
    # One row for each node with children, and one for each block of numbers that its children lie in: no key is hot.
    families = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("n_children"))
    families = settle(families.join(nodes.select("key", "number", "conv_id"), "key"), "families")
    blocks = families.select(
        F.col("key").alias("parent"), F.col("last").alias("parent_last"), F.col("number").alias("parent_number"), F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("block"),
    )
    own = nodes.withColumn("block", F.floor(F.col("number") / block)).join(blocks, ["parent", "block"], "left").drop("block", "parent")
    own = own.join(families.select("number", "n_children"), "number", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = settle(own, "placed")
    ranks = list_rank(tour(own, families), 2 * n, sparse, whole)
    arcs = ranks.select(F.floor(F.col("arc") / 2).alias("number"), (F.col("arc") % 2 == 0).alias("enters"), (F.lit(2 * n) - F.col("rank")).alias("position"))
    leaf = (F.col("n_children") == 0).cast("bigint")
    saving = (F.col("n_convs") - 1) * F.col("size")
    weights = own.select("number", leaf.alias("leaves"), saving.alias("saved"))
    weighed = arcs.join(weights, "number")
    weighed = weighed.withColumns({c: F.when(F.col("enters"), F.col(c)).otherwise(F.lit(0).cast("bigint")) for c in ("leaves", "saved")})
    summed = prefix_sums(weighed, 2 * n, ["leaves", "saved"], block)
    at = lambda c, enters: F.max(F.when(F.col("enters") == enters, F.col(c)))
    below = summed.groupBy("number").agg(*[(at(c, False) - at(c, True)).alias(c) for c in ("leaves", "saved")])  # without the node's own
    out = own.join(below, "number").withColumn("n_leaves", F.col("leaves") + leaf).withColumn("saved_tokens", F.col("saved") + saving)
    ended = out.join(ends_digest(prefixes), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
