"""One query per corpus operator, over its whole table with production parameters, and oracles where SQL can state one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import conversation_trie, decontaminate, filter_audit, language, licences, lines, mixing, order_minhash, personal, secret_scan, simhash, suffixes, wrappers


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.fit(docs))
    return found.select(
        "doc_id", F.array_join("families", ",").alias("families"), F.array_join("confirmed", ",").alias("confirmed_families"),
        F.col("n_pieces").alias("n_paragraphs"), (F.size("confirmed") > 0).alias("confirmed"), "probability",
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.k = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(personal.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(personal.as_text(F.col("base")), 256).alias("base_sha256"),
        personal.as_text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, lines.build(docs)).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, F.col("size"))
    return mixed.select(
        "doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("size") * F.col("_mix_copies")).alias("taken"), F.col("_mix_copies").alias("copies"),
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return named.select("doc_id", language.held_out().alias("held_out"), "language.lang_pred", "language.score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _read(spark, sf_dir, "benchmark"))
    ids = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.neighbour_likeness(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return filter_audit.audit(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_trie.prefix_trie(turns)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in secret_scan.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.as_text("base"), 256).alias("base_sha256"),
        secret_scan.as_text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_html_extraction, op3_pii, op4_line_dedup, op5_source_mixing, op6_simhash_near_dedup, op7_language_id, op8_decontamination, op9_order_minhash, op10_suffix_array_dedup,
        op11_filter_interaction_audit, op12_conversation_prefix_trie, op13_secret_scan,
    )
}

_LINES = """
SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
"""

_TRIE = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT conv_id, list_reduce(range(0, 8 * length(CAST(conv_id AS VARCHAR))), lambda c, i: (
           xor(CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INT), 1)) AS BIGINT)) ELSE c END >> 1,
               CASE WHEN CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INT), 1)) AS BIGINT)) ELSE c END & 1 = 1
                    THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS BIGINT)) AS c
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
head AS (SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h, conv_id - conv_id % 5 AS base FROM crc),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT head.conv_id, t.pos, t.role, t.text FROM head JOIN t ON t.conv_id = head.base WHERE t.pos <= h
      UNION ALL SELECT head.conv_id, t.pos + 1000000000, t.role, t.text FROM head JOIN t ON t.conv_id = head.conv_id WHERE t.pos > h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS pos, sha256(sha256(role) || sha256(text)) AS turn,
             strlen(text) AS bytes FROM r),
w(conv_id, depth, node, bytes) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM head
  UNION ALL SELECT w.conv_id, w.depth + 1, sha256(w.node || q.turn), q.bytes FROM w JOIN q ON q.conv_id = w.conv_id AND q.pos = w.depth + 1),
up AS (SELECT w.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS last FROM w),
n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256 FROM up GROUP BY node),
k AS (SELECT n.node, count(c.node) AS n_children FROM n LEFT JOIN n c ON c.parent = n.node GROUP BY n.node),
above AS (SELECT DISTINCT a.node AS top, b.node FROM up b JOIN up a ON a.conv_id = b.conv_id AND a.depth <= b.depth),
s AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
      FROM above JOIN n ON n.node = above.node JOIN k ON k.node = n.node GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN k ON k.node = n.node JOIN s ON s.top = n.node LEFT JOIN n p ON p.node = n.parent
"""

ORACLES = {
    "op11_filter_interaction_audit": """
WITH RECURSIVE o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS INT), 1) AS f, substr(filter_order, 1, CAST(step - 1 AS INT)) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
             CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < w.doc_id THEN 'E' ELSE '' END AS failed
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, failed, good, toxic, count(*) AS n FROM x GROUP BY ALL),
e AS (SELECT c.*, s.*, contains(failed, f) AS fails, length(translate(failed, before, '')) < length(failed) AS earlier FROM c, s),
a AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT earlier), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE fails AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (WHERE failed = f), 0) AS unique_fails,
             coalesce(sum(n) FILTER (WHERE fails AND NOT earlier AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE fails AND NOT earlier AND toxic), 0) AS toxic_lost
      FROM e GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM a
""",
    "op12_conversation_prefix_trie": _TRIE,
    "op4_line_dedup": f"""
WITH l AS ({_LINES}),
k AS (SELECT key, max(doc_id) AS holder FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.holder AS dropped FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op8_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
g AS (SELECT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: list_slice(w, i, i + 12))) AS gram FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM g),
t AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, ks WHERE len(w) >= k),
h AS (SELECT t.doc_id, t.s, t.k, g.item_id FROM t JOIN g ON g.k = t.k AND g.gram = list_slice(t.w, t.s, t.s + t.k - 1)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
""",
}
