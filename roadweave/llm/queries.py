"""Queries over the given tables, one for each operator, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, linededup, minhash, minmax, mixing, repeats, resample, simhash, tokens, toxicity, trie, warc
from .common import table

SQL: dict[str, str] = {}


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and to the next document."""
    found = minhash.compare_with_next(table(spark, sf_dir, "documents"))
    digits = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(digits)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokens.read_vocabulary()).drop("text")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points."""
    found = html.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, removed lines, and the length and SHA-256 of what line dedup keeps."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


SQL["op4_lines"] = """
WITH lined AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM lined),
hashed AS (
    SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM line),
rolled AS (
    SELECT *, h + 10007 * coalesce(lag(h) OVER w, 0) AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (
    SELECT *, coalesce(sum(CASE WHEN r % 3 = 0 THEN 1 ELSE 0 END) OVER (
        PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM rolled),
chunk AS (
    SELECT doc_id, no, string_agg(line, chr(10) ORDER BY pos) AS chunk, count(*) AS n FROM numbered GROUP BY doc_id, no),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, no) AS rank FROM chunk),
kept AS (
    SELECT doc_id, no, n, chunk, n > 1 AND rank > 1 AS gone FROM (
        SELECT doc_id, no, n, chunk, row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, no) AS rank FROM chunk) x)
SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines,
    CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS INTEGER) AS n_removed,
    CAST(length(coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS INTEGER) AS n_chars,
    sha256(coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item of whose five-word shingles it holds 0.8 or more."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op10_decontaminate"] = r"""
WITH w AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS w FROM documents
    UNION ALL
    SELECT 'i', item_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') FROM benchmark),
f AS (SELECT kind, id, [x for x in w if x <> ''] AS w FROM w),
p AS (SELECT kind, id, CASE WHEN len(w) BETWEEN 1 AND 4 THEN list_concat(w, ['' for x in range(5 - len(w))]) ELSE w END AS w FROM f),
s AS (
    SELECT DISTINCT kind, id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] for i in range(1, len(w) - 3)]) AS s
    FROM p WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.s = i.s WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY d.id, i.id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / CAST(n_item AS DOUBLE) AS containment
FROM c JOIN n ON n.id = c.item_id WHERE n_shared / CAST(n_item AS DOUBLE) >= 0.8
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted label of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", predicted)


#: Weights of the mix: three domains by the number in a source's name, four languages, sources alike.
WEIGHTS = {"domain": {"domain0": 3, "domain1": 2, "domain2": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def levels() -> dict[str, Column]:
    """The tree's levels as columns of documents."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("bigint") % 3
    domain = F.concat(F.lit("domain"), F.coalesce(number, F.lit(0)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives: payload length and digest, record type, and the response it refers to."""
    return warc.convert_pages(table(spark, sf_dir, "pages"))


# SHA-1 has 40 hex digits; each of 32 letters is five bits of two neighbouring ones.
SQL["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(x, 5 * i // 4 + 1, 2) AS INTEGER) >> (3 - 5 * i % 4)) % 32 + 1, 1) for i in range(32)], '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document, how many of them smaller doc_ids hold in strings of 50, and the hash of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.repeated_spans(docs).withColumn("text", F.coalesce("text", F.lit("")))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return found.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2(repeats.kept_bytes(F.col("text"), F.col("starts"), F.col("ends")), 256).alias("kept_sha256"),
    )


SQL["op8_repeats"] = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n_bytes FROM b),
blocks AS (SELECT doc_id, o, substr(h, 2 * o + 1, 698) AS part FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49, 300)) AS o FROM n WHERE n_bytes >= 50) u),
g AS (SELECT doc_id, o + i AS k, substr(part, 2 * i + 1, 100) AS s FROM (SELECT doc_id, o, part, unnest(range(0, len(part) // 2 - 49)) AS i FROM blocks) u),
m AS (SELECT s, min(doc_id) AS lo FROM g GROUP BY s),
hit AS (SELECT doc_id, k FROM g JOIN m USING (s) WHERE lo < doc_id),
marked AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM hit),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM grouped GROUP BY doc_id, span),
pieces AS (
    SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
    UNION ALL SELECT n.doc_id, coalesce(max(s.z), 0), any_value(n.n_bytes) FROM n LEFT JOIN spans s ON s.doc_id = n.doc_id GROUP BY n.doc_id),
kept AS (
    SELECT p.doc_id, sha256(unhex(string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY a, z))) AS kept_sha256 FROM pieces p JOIN n ON n.doc_id = p.doc_id GROUP BY p.doc_id),
c AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT n.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM n JOIN kept ON kept.doc_id = n.doc_id LEFT JOIN c ON c.doc_id = n.doc_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, tokens and copies in a mix of 0.6 of all tokens."""
    found = mixing.mix(table(spark, sf_dir, "documents"), levels(), WEIGHTS)
    return found.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level_sql(name: str, path: str, up: str, parents: str, weight: str) -> str:
    """SQL of one level of the tree: nodes, which of them are full, and their shares."""
    join = f"JOIN {parents} USING ({up})" if up else f"CROSS JOIN {parents}"
    family = f"PARTITION BY {up}" if up else ""
    return f"""
{name}_n AS (
    SELECT *, coalesce(sum(cap) OVER ({family} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
        sum(w) OVER ({family} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
    FROM (SELECT {path}, CAST(sum(capacity) AS DOUBLE) AS cap, CAST({weight} AS DOUBLE) AS w FROM leaf GROUP BY {path}) n {join}),
{name}_f AS (SELECT *, cap * w_left <= w * (given - used) AS full_up FROM {name}_n),
{name}_s AS (
    SELECT {path}, CASE WHEN full_up THEN cap ELSE w * (given - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({family}))
        / sum(CASE WHEN full_up THEN 0 ELSE w END) OVER ({family}) END AS given
    FROM {name}_f),"""


SQL["op9_mixing"] = (
    """
WITH tokens AS (
    SELECT doc_id, 'domain' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3, 0) AS domain,
        coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
        CAST(len([x for x in regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+') if x <> '']) AS BIGINT) AS n_tokens
    FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * 3 AS capacity FROM tokens GROUP BY ALL),
root AS (SELECT CAST(0.6 AS DOUBLE) * CAST(sum(n_tokens) AS DOUBLE) AS given FROM tokens),"""
    + _level_sql("domain", "domain", "", "root", "CASE domain WHEN 'domain0' THEN 3 WHEN 'domain1' THEN 2 ELSE 1 END")
    + _level_sql("lang", "domain, lang", "domain", "domain_s", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")
    + _level_sql("source", "domain, lang, source", "domain, lang", "lang_s", "1")
    + """
quota AS (SELECT l.*, CAST(floor(given) AS BIGINT) AS quota FROM leaf l JOIN source_s USING (domain, lang, source)),
epochs AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(quota / CAST(tokens AS DOUBLE)) AS BIGINT) ELSE 0 END AS whole FROM quota),
ordered AS (
    SELECT t.*, whole, quota - whole * tokens AS rest, sum(n_tokens) OVER (
        PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS running
    FROM tokens t JOIN epochs USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, whole + CASE WHEN running <= rest THEN 1 ELSE 0 END AS copies FROM ordered
"""
)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations with its subtree's leaves and savings."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def _crc32_sql(values: str) -> str:
    """CRC-32 of a list of bytes."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for k in range(8)]),"
        " lambda u, v: CASE WHEN u % 2 = 1 THEN xor(u >> 1, 3988292384::BIGINT) ELSE u >> 1 END)), 4294967295::BIGINT)"
    )


SQL["op11_trie"] = f"""
WITH turns AS (
    SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS size, turn
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY turn NULLS FIRST, t) AS ts, list(size ORDER BY turn NULLS FIRST, t) AS sizes FROM turns GROUP BY c),
heads AS (SELECT *, {_crc32_sql("[CAST(ascii(x) AS BIGINT) for x in string_split(CAST(c AS VARCHAR), '')]")} % 6 AS h FROM own),
rebuilt AS (
    SELECT a.c, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts, list_concat(coalesce(b.sizes[1:a.h], []), a.sizes[a.h + 1:]) AS sizes
    FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 100),
prefix AS (SELECT c, d, array_to_string(ts[1:d], '') AS key, CASE WHEN d = 0 THEN NULL ELSE array_to_string(ts[1:d - 1], '') END AS up, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, d = len(ts) AS ends
    FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt) x),
node AS (
    SELECT key, any_value(up) AS up, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM prefix GROUP BY key),
full_node AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM node n LEFT JOIN (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up) k ON k.up = n.key),
below AS (
    SELECT a AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
    FROM (SELECT substr(key, 1, CAST(64 * e AS BIGINT)) AS a, n_children, n_convs, size FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_node) x) y GROUP BY a)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN below b ON b.key = n.key LEFT JOIN node p ON p.key = n.up
"""


def op12_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles, the smallest doc_id that links reach, and whether that is its own."""
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op12_minmax"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s
    FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, w.doc_id) AS component_id, coalesce(l.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least l ON l.doc_id = w.doc_id
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, its score, and its rank among the tenth that is drawn."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_resample"] = rf"""
WITH words AS (
    SELECT kind, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark) x),
hashed AS (
    SELECT w, {_crc32_sql("[CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT) for i in range(octet_length(encode(w)))]")} % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM words) x),
counted AS (SELECT kind, id, bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY kind, id, bucket),
total AS (SELECT CAST(coalesce(sum(n) FILTER (kind = 'd'), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(n) FILTER (kind = 'b'), 0) AS DOUBLE) AS t_all FROM counted),
gain AS (
    SELECT bucket, CAST(floor(CAST(1000 AS DOUBLE) * ln(
        (CAST(coalesce(sum(n) FILTER (kind = 'b'), 0) AS DOUBLE) + 1) * (any_value(s_all) + 10000) / ((CAST(coalesce(sum(n) FILTER (kind = 'd'), 0) AS DOUBLE) + 1) * (any_value(t_all) + 10000)))) AS BIGINT) AS gain
    FROM counted, total GROUP BY bucket),
weight AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(CAST(-1000 AS DOUBLE) * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
    FROM documents LEFT JOIN weight ON id = doc_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, sum(CASE WHEN n_features >= 20 THEN 1 ELSE 0 END) OVER () AS n_all FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= CAST(n_all AS BIGINT) * 10 // 100 THEN r END AS rank FROM ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_tokens": op2_tokens, "op3_html": op3_html, "op4_lines": op4_lines, "op5_toxicity": op5_toxicity, "op6_warc": op6_warc, "op7_simhash": op7_simhash, "op8_repeats": op8_repeats, "op9_mixing": op9_mixing, "op10_decontaminate": op10_decontaminate, "op11_trie": op11_trie, "op12_minmax": op12_minmax, "op13_resample": op13_resample}


def oracle_sql() -> dict[str, str]:
    return SQL
