"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import chat, fill_middle, line_dedup, media, mixing, near_dup, packing, passage_dedup, pii, quality_model, quality_rules, token_align, toxicity
from quillspan.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perspective of every conversation; masks as comma-joined start:end."""
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    return out.select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.col("n_turns").cast("long"),
        F.col("n_assistant").cast("long"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
        F.length("rendered").cast("long").alias("n_chars"),
        F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",").alias("mask_spans"),
    )


ORACLE["op1_chat_rotation"] = """
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         CAST(floor(coalesce(turn, -1) / 256.0) AS BIGINT) AS part
  FROM conversations),
r AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, text) - 1) // 4096 AS piece FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
s AS (
  SELECT r.conv_id, p.perspective, r.part, r.piece, r.turn, r.role, r.text, r.role = p.perspective AS own,
         CASE WHEN r.role = 'system' THEN '<|system|>' || chr(10)
              WHEN r.role = p.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || regexp_replace(r.role, '[^A-Za-z0-9_-]', '_', 'g') || '|>' || chr(10) END AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (
      PARTITION BY conv_id, perspective, part, piece ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head_at
  FROM s)
SELECT conv_id, perspective, part, piece, count(*) AS n_turns, count(*) FILTER (own) AS n_assistant,
       sha256(string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text)) AS rendered_sha256,
       CAST(sum(length(head) + length(text) + 8) AS BIGINT) AS n_chars,
       coalesce(string_agg(CAST(CAST(head_at + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(head_at + length(head) + length(text) + 7 AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (own), '') AS mask_spans
FROM o GROUP BY conv_id, perspective, part, piece
"""


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE["op5_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT k, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + o AS p FROM dup, (VALUES (0), (1), (2)) AS v(o)) GROUP BY k),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)}], lower(x)))) AS n_stop,
         length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_cap, length(regexp_replace(text, '[^!]', '', 'g')) AS n_excl
  FROM d LEFT JOIN cov USING (k)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_words > 1000000 OR word_chars / n_words NOT BETWEEN 2 AND 15 OR n_symbols / n_words > 0.10
    OR n_stop / n_words < 0.03 OR n_dup_lines / n_lines > 0.30 OR n_repeat_words / n_words > 0.50
    OR n_cap / word_chars > 0.40 OR n_excl / n_words > 0.10) AS kept
FROM j
"""


@_query
def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Rows only: rounding follows hashes that SQL engines don't share."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


@_query
def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles. The SQL pairs documents by shared shingles and follows links."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


ORACLE["op9_lsh_forest"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM w),
u AS (SELECT k, len(g) AS n, unnest(g) AS x FROM s WHERE doc_id IS NOT NULL),
i AS (SELECT a.k AS a, b.k AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k),
e AS (SELECT a, b FROM i WHERE 100 * m >= 80 * (na + nb - m)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(k, o) AS (SELECT k, k FROM s WHERE k IN (SELECT a FROM both_ways) UNION SELECT r.k, t.b FROM r JOIN both_ways t ON t.a = r.o),
c AS (SELECT r.k, min(s.doc_id) AS component_id FROM r JOIN s ON s.k = r.o GROUP BY r.k)
SELECT s.doc_id, len(g) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(s.doc_id = coalesce(c.component_id, s.doc_id), false) AS kept
FROM s LEFT JOIN c USING (k)
"""


@_query
def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and batch of every piece of every document. The boundaries are tested against brute force."""
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op7_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once lines on ten sites or more are gone from all but their first document."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_left"), F.sha2("text", 256).alias("text_sha256"))


ORACLE["op7_site_spread_lines"] = r"""
WITH l AS (
  SELECT doc_id, source, u.pos AS pos, u.line AS line,
         regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS h,
         regexp_matches(u.line, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+') AS long_enough
  FROM documents, (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) AS u),
b AS (SELECT h, min(doc_id) AS first_doc FROM l WHERE long_enough GROUP BY h HAVING count(DISTINCT coalesce(source, chr(0))) >= 10),
j AS (SELECT l.*, long_enough AND b.h IS NOT NULL AND l.doc_id <> b.first_doc AS gone FROM l LEFT JOIN b USING (h)),
t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM j GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS n_left, sha256(text) AS text_sha256 FROM t
"""


@_query
def op10_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every text stored as lossless WebP and read back. Tested by exact round trips."""
    return media.describe(media.store_texts(table(spark, sf_dir, "documents")))


@_query
def op3_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document. Tested by held-out accuracy."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_model.classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


@_query
def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document. Tested by held-out accuracy."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.grade(docs.select("doc_id", "text"), labels).select("doc_id", "severity", "grade", "toxic", "kept")


@_query
def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document. Base spans are tested against the plain patterns."""
    return pii.find(table(spark, sf_dir, "documents"))


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and the text rebuilt from it."""
    out = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE["op12_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
u AS (
  SELECT *, len(lines) - CAST(lines[-1] = '' AS INT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
v AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT *, CASE WHEN low = 0 THEN 0 WHEN low = n THEN length(text) ELSE length(array_to_string(lines[1:low], chr(10))) + 1 END AS a,
            CASE WHEN high = 0 THEN 0 WHEN high = n THEN length(text) ELSE length(array_to_string(lines[1:high], chr(10))) + 1 END AS b FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
                   WHEN 'spm' THEN '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a)
                   ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""


@_query
def op13_token_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document. Tested against brute force."""
    return token_align.align(table(spark, sf_dir, "documents"))[0]


@_query
def op11_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of documents with smaller ids. Tested against brute force."""
    out = passage_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
