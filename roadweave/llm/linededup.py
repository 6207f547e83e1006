"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last few lines closes a chunk where it is divisible by a number. The cuts
depend on nearby lines only, so a passage that moves within a document or into another is cut alike. Chunks of
several lines that occur more than once in all documents are removed but for their first occurrence, after their
bytes have been compared. Native: DataFrame functions only.

dedup_runs() is the corpus stage's form: most shared passages hold no whole chunk of several lines, so it looks at
the pair of lines at every place instead of at the cuts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, text_of

WINDOW = 2
DIVISOR = 3
#: Multiplier of the rolling hash; line hashes have 32 bits, so the sum over a short window stays in 63.
BASE = 10007


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5, as a bigint."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _ends(hashes: str, window: int, divisor: int) -> Column:
    """Positions (from 1) of the last lines of chunks; missing lines before the first count as zero."""

    def rolled(i: Column) -> Column:
        terms = [F.coalesce(F.get(hashes, i - (1 + k)), F.lit(0)) * F.lit(BASE**k) for k in range(window)]
        return sum(terms[1:], terms[0])

    cut = lambda i: (F.pmod(rolled(i), F.lit(divisor)) == 0) | (i == F.size(hashes))
    return F.filter(F.sequence(F.lit(1), F.size(hashes)), cut)


def chunked(df: DataFrame, text: Column, keep: list[str], window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """The kept columns, lines (array of strings) and chunks (array of structs first, n: positions from 1)."""
    lined = df.select(*keep, F.split(text, "\n", -1).alias("lines"))
    hashed = lined.select(*keep, "lines", F.transform("lines", line_hash).alias("hashes"))
    ended = hashed.select(*keep, "lines", _ends("hashes", window, divisor).alias("ends"))
    firsts = F.concat(F.array(F.lit(1)), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: e + 1))
    zipped = F.zip_with(firsts, F.col("ends"), lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))
    return ended.select(*keep, "lines", zipped.alias("chunks"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR
) -> DataFrame:
    """docs with repeated chunks of two lines or more taken out of the text; other columns as they came.

    Adds n_lines and n_removed (lines; underscores are put before these names if docs has them). The first
    occurrence, by smallest id (null before all) and then place in the text, stays. Null texts stay null and
    have no lines; an empty text is one empty line. Rows with equal id and text count as one document and are
    treated alike. A document that loses all lines keeps an empty text.
    """
    k_id, k_text, lines, chunks, gone, n_lines, n_removed = fresh(docs.columns, "k_id", "k_text", "lines", "chunks", "gone", "n_lines", "n_removed")
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))
    # The outer form of explode: for the inner one Spark puts a filter with the whole chunking in it below.
    cut = chunked(keyed, F.col("text"), ["i", "t"], window, divisor)
    rows = cut.select("i", "t", "lines", F.posexplode_outer("chunks").alias("no", "c")).where("c.n > 1")
    chunk = F.array_join(F.slice("lines", F.col("c.first"), F.col("c.n")), "\n")
    place = F.struct("i", "t", "no")
    hashed = rows.select("i", "t", "no", F.xxhash64(chunk).alias("hash"))
    twice = hashed.groupBy("hash").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("hash")
    listed = hashed.join(twice, "hash").groupBy("i", "t").agg(F.collect_set("no").alias("nos"))
    # Equal hashes only say where to look: the bytes of these chunks decide.
    l_i, l_t = listed["i"].alias("l_i"), listed["t"].alias("l_t")
    wanted = settle(listed.select(l_i, l_t, "nos"), "repeated")
    texts = keyed.join(wanted.hint("merge"), keyed["i"].eqNullSafe(F.col("l_i")) & (keyed["t"] == F.col("l_t")))
    again = chunked(texts, F.col("text"), ["i", "t", "nos"], window, divisor)
    again = again.select("i", "t", "nos", "lines", F.posexplode_outer("chunks").alias("no", "c")).where("array_contains(nos, no)")
    again = again.select("i", "t", "no", chunk.alias("chunk"), F.col("c.first").alias("first"), F.col("c.n").alias("n"))
    first = again.groupBy("chunk").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi")
    later = again.join(first.select("chunk", "lo"), "chunk").where(~place.eqNullSafe(F.col("lo")))
    removed = later.groupBy("i", "t").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    removed = removed.select(F.col("i").alias(k_id), F.col("t").alias(k_text), F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1))).alias(gone))
    # Written first, which frees the shuffles so far; the hints keep the joins by shuffle at every size.
    removed = settle(removed, "removed").hint("merge")
    joined = docs.join(removed, docs[id_col].eqNullSafe(removed[k_id]) & (F.xxhash64(text) == removed[k_text]), "left")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i + 1))
    whole = joined.withColumn(lines, F.split(text, "\n", -1))
    columns = [
        F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col) if c == text_col else F.col(c)
        for c in docs.columns
    ]
    return whole.select(
        *columns,
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias(n_lines),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias(n_removed),
    )


def _pair_hashes(lines: str, bits: int) -> Column:
    """Hashes of each line with the next; nothing for a single line."""
    whole = lambda p: F.xxhash64(F.get(lines, p - 1), F.get(lines, p))
    hashed = F.transform(F.sequence(F.lit(1), F.size(lines) - 1), lambda p: F.shiftrightunsigned(whole(p), 64 - bits) if bits < 64 else whole(p))
    return F.when(F.size(lines) > 1, hashed)


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """docs without the runs of two or more lines that stand earlier in the corpus; other columns as they came.

    Two neighbouring lines are removed if the same two stand next to each other at an earlier place, so a repeated
    run goes from its first line to its last wherever it lies; whatever dedup_lines removes is among it. Earlier
    is by id (null before all), then place in the text, in the texts as they came: the first occurrence of a
    line always stays, and a pair that overlaps its own first occurrence (equal lines in a row) leaves that whole.
    A single repeated line between others that are new stays. Columns, nulls and equal rows as for dedup_lines.
    ``bits`` is the width of the pairs' hashes; hashes that different pairs share are told apart by the bytes.
    """
    k_id, k_text, lines, gone, n_lines, n_removed = fresh(docs.columns, "k_id", "k_text", "lines", "gone", "n_lines", "n_removed")
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))
    lined = keyed.select("i", "t", F.split("text", "\n", -1).alias("lines"))
    place = F.struct("i", "t", "no")
    # The outer form of explode, as above.
    rows = lined.select("i", "t", F.posexplode_outer(_pair_hashes("lines", bits)).alias("no", "hash")).where("hash is not null")
    twice = rows.groupBy("hash").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("hash", "lo")
    overlaps = F.col("lo.i").eqNullSafe(F.col("i")) & (F.col("lo.t") == F.col("t")) & (F.col("lo.no") == F.col("no") - 1)
    marked = rows.join(twice, "hash").select("i", "t", F.struct("no", "hash", place.eqNullSafe(F.col("lo")).alias("first"), overlaps.alias("overlaps")).alias("pair"))
    wanted = marked.groupBy("i", "t").agg(F.collect_set("pair").alias("pairs"))
    wanted = settle(wanted.select(F.col("i").alias("l_i"), F.col("t").alias("l_t"), "pairs"), "repeated")
    # Equal hashes only say where to look: different bytes under one hash are found here, and dealt by their bytes.
    texts = keyed.join(wanted.hint("merge"), keyed["i"].eqNullSafe(F.col("l_i")) & (keyed["t"] == F.col("l_t")))
    texts = texts.select("i", "t", F.split("text", "\n", -1).alias("lines"), "pairs")
    both = F.transform("pairs", lambda p: F.struct(p["no"].alias("no"), p["hash"].alias("hash"), F.concat_ws("\n", F.slice("lines", p["no"] + 1, F.lit(2))).alias("bytes")))
    exact = texts.select("i", "t", F.explode_outer(both).alias("p")).select("i", "t", "p.no", "p.hash", "p.bytes")
    mixed = settle(exact.select("hash", "bytes").distinct().groupBy("hash").count().where("count > 1").select("hash"), "mixed")
    later = wanted.select(F.col("l_i").alias("i"), F.col("l_t").alias("t"), F.filter("pairs", lambda p: ~p["first"]).alias("pairs"))
    if not mixed.isEmpty():
        among = exact.join(mixed, "hash")
        lows = among.groupBy("bytes").agg(F.min(place).alias("lo"))
        told = among.join(lows, "bytes").where(~place.eqNullSafe(F.col("lo"))).select("i", "t", "no", overlaps.alias("overlaps"))
        plain = later.select("i", "t", F.explode_outer("pairs").alias("p")).where("p is not null").select("i", "t", "p.no", "p.hash", "p.overlaps")
        plain = plain.join(mixed, "hash", "left_anti").select("i", "t", "no", "overlaps")
        later = plain.unionByName(told).groupBy("i", "t").agg(F.collect_set(F.struct("no", "overlaps")).alias("pairs"))
    seconds = F.transform("pairs", lambda p: p["no"] + 2)
    firsts = F.transform(F.filter("pairs", lambda p: ~p["overlaps"]), lambda p: p["no"] + 1)
    removed = later.where(F.size("pairs") > 0).select(F.col("i").alias(k_id), F.col("t").alias(k_text), F.array_union(seconds, firsts).alias(gone))
    removed = settle(removed, "removed").hint("merge")
    joined = docs.join(removed, docs[id_col].eqNullSafe(removed[k_id]) & (F.xxhash64(text) == removed[k_text]), "left")
    whole = joined.withColumn(lines, F.split(text, "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col(gone)), lambda p: F.get(lines, p - 1))
    columns = [
        F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col) if c == text_col else F.col(c)
        for c in docs.columns
    ]
    return whole.select(
        *columns,
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias(n_lines),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias(n_removed),
    )
