"""Queries of the ranking metrics: users as queries, events as scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import ranking_metrics as M
from quillspan.plans.registry import query

_SCENE = "user_id AS query_id, event_type AS video_id, event_id AS scene_id"
CAND = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, scene_id) AS rank FROM (
  SELECT {_SCENE}, event_id * 1000 AS start_ms, event_id * 1000 + 1500 AS end_ms, 'bm25' AS method, value AS score FROM {{events}}
  UNION ALL SELECT {_SCENE}, event_id * 1000 AS start_ms, event_id * 1000 + 900 AS end_ms, 'visual' AS method, value * (event_id % 13 + 1) AS score FROM {{events}}) AS u) AS w WHERE rank <= 20"""
QRELS = f"SELECT {_SCENE}, event_id * 1000 + 500 AS start_ms, event_id * 1000 + 2000 AS end_ms FROM {{events}} WHERE event_id % 11 = 0 AND user_id % 9 <> 0"
GOLD = """SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'action' WHEN query_id % 3 = 1 THEN 'entity' ELSE 'speech' END AS query_type,
  CASE WHEN query_id % 5 = 0 THEN 'same_text_different_scene' WHEN query_id % 5 = 1 THEN 'visually_similar_distractor' END AS hard_category, query_id % 7 <> 0 AS evidence_available
  FROM (SELECT DISTINCT user_id AS query_id FROM {events}) AS u"""

METRICS = f"""
cand AS ({CAND}), qrels AS ({QRELS}), gold AS ({GOLD}),
hits AS (SELECT c.*, q.scene_id IS NOT NULL AS rel FROM cand c LEFT JOIN (SELECT DISTINCT query_id, video_id, scene_id FROM qrels) q USING (query_id, video_id, scene_id)),
nrel AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, video_id, scene_id FROM qrels) GROUP BY 1),
top AS (SELECT query_id, method, coalesce(max(greatest(0, least(h.end_ms, q.end_ms) - greatest(h.start_ms, q.start_ms)) / (greatest(h.end_ms, q.end_ms) - least(h.start_ms, q.start_ms))) FILTER (q.start_ms IS NOT NULL), 0) AS iou
  FROM (SELECT * FROM hits WHERE rank = 1) h LEFT JOIN qrels q USING (query_id, video_id) GROUP BY ALL),
per AS (SELECT query_id, method, min(rank) FILTER (rel) AS first_rank, coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 10), 0) AS gain FROM hits GROUP BY ALL),
mx AS (SELECT g.query_id, m.method, query_type, hard_category, coalesce(first_rank <= 1, false)::INT::DOUBLE AS hit_1, coalesce(first_rank <= 5, false)::INT::DOUBLE AS hit_5, coalesce(first_rank <= 10, false)::INT::DOUBLE AS hit_10,
  coalesce(1 / first_rank, 0) AS rr, CASE WHEN n > 0 THEN coalesce(gain, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n) ELSE 0 END AS ndcg_10, coalesce(iou, 0) AS iou, evidence_available
  FROM gold g CROSS JOIN (SELECT DISTINCT method FROM cand) m LEFT JOIN per USING (query_id, method) LEFT JOIN nrel USING (query_id) LEFT JOIN top USING (query_id, method)),
met AS (SELECT *, CASE WHEN rr > 0 THEN NULL WHEN NOT evidence_available THEN 'perception_failure' WHEN hard_category IS NOT NULL THEN 'hard_negative_confusion' WHEN query_type = 'action' THEN 'action_confusion'
  WHEN query_type = 'entity' AND method = 'visual' THEN 'wrong_visual_entity' WHEN method = 'bm25' THEN 'lexical_mismatch' ELSE 'semantic_confusion' END AS failure FROM mx)"""
R9 = lambda c: F.round(c, 9).alias(c)


def metrics(get):
    return M.query_metrics(get(CAND), get(QRELS), get(GOLD))


@query("a1_query_metrics", f"WITH {METRICS} SELECT query_id, method, hit_1, hit_5, hit_10, round(rr, 9) AS rr, round(ndcg_10, 9) AS ndcg_10, round(iou, 9) AS iou FROM met")
def a1(get):
    return metrics(get).select("query_id", "method", "hit_1", "hit_5", "hit_10", R9("rr"), R9("ndcg_10"), R9("iou"))


PRED = "SELECT event_id, user_id, event_type AS video_id, event_id * 10 AS start_ms, event_id * 10 + 400 AS end_ms FROM {events}"
TRUE = "SELECT user_id, event_type AS video_id, event_id * 10 + event_id % 7 * 90 AS start_ms, event_id * 10 + event_id % 7 * 90 + 250 AS end_ms FROM {events}"


@query(
    "a2_best_temporal_match",
    f"""SELECT p.event_id, round(coalesce(max(greatest(0, least(p.end_ms, g.end_ms) - greatest(p.start_ms, g.start_ms)) / (greatest(p.end_ms, g.end_ms) - least(p.start_ms, g.start_ms))) FILTER (g.start_ms IS NOT NULL), 0), 9) AS iou
    FROM ({PRED}) p LEFT JOIN ({TRUE}) g USING (user_id, video_id) GROUP BY 1""",
)
def a2(get):
    return M.best_match(get(PRED), get(TRUE), ["user_id", "video_id"]).select("event_id", R9("iou"))


_MEANS = ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("hit_1", "hit_5", "hit_10", "rr", "ndcg_10", "iou"))


@query(
    "a3_metric_summary",
    f"""WITH {METRICS}, lat AS (SELECT *, query_id * 7 % 101 AS latency FROM met)
    SELECT 'all' AS level, method, NULL AS query_type, NULL AS hard_category, count(*) AS n, {_MEANS}, median(latency) AS p50, quantile_disc(latency, 0.95) AS p95 FROM lat GROUP BY method
    UNION ALL SELECT 'query_type', method, query_type, NULL, count(*), {_MEANS}, median(latency), quantile_disc(latency, 0.95) FROM lat GROUP BY method, query_type
    UNION ALL SELECT 'hard_category', method, NULL, hard_category, count(*), {_MEANS}, median(latency), quantile_disc(latency, 0.95) FROM lat WHERE hard_category IS NOT NULL GROUP BY method, hard_category""",
)
def a3(get):
    s = M.summarize(metrics(get).withColumn("latency", F.col("query_id") * 7 % 101), "latency")
    return s.select("level", "method", "query_type", "hard_category", "n", *[R9(c) for c in ("hit_1", "hit_5", "hit_10", "rr", "ndcg_10", "iou")], "p50", "p95")


@query("a4_miss_reasons", f"WITH {METRICS} SELECT method, failure, count(*) AS n FROM met GROUP BY ALL")
def a4(get):
    return metrics(get).groupBy("method", "failure").agg(F.count(F.lit(1)).alias("n"))


_STAGE_ROWS = " UNION ALL ".join(
    f"SELECT query_id, '{s}' AS stage, CASE WHEN query_id % {k} = 0 THEN 0 ELSE 1 END AS hit_10, CASE WHEN query_id % {k} = 0 OR query_id % {k + 1} < 2 THEN 0 ELSE 1 END AS hit_1, CASE WHEN query_id % 4 = 0 THEN 0.25 ELSE 0.75 END AS iou FROM (SELECT DISTINCT user_id AS query_id FROM {{events}}) AS u{i}"
    for i, (s, k) in enumerate((("uniform", 5), ("routed", 3), ("reranked", 4), ("final", 7)))
)
VERIFIED = "SELECT query_id, query_id % 4 = 1 AS supports_wrong FROM (SELECT DISTINCT user_id AS query_id FROM {events}) AS v WHERE query_id % 2 = 1"


@query(
    "a5_stage_attribution",
    f"""WITH s AS ({_STAGE_ROWS}), gold AS ({GOLD}),
    p AS (SELECT query_id, max(hit_10) FILTER (stage = 'uniform') AS u10, max(hit_1) FILTER (stage = 'routed') AS r1, max(hit_10) FILTER (stage = 'routed') AS r10, max(hit_1) FILTER (stage = 'reranked') AS e1,
      max(hit_1) FILTER (stage = 'final') AS f1, max(iou) FILTER (stage = 'final') AS iou FROM s GROUP BY 1),
    j AS (SELECT p.*, evidence_available, hard_category, v.query_id IS NOT NULL AS v, coalesce(supports_wrong, false) AS w FROM p JOIN gold USING (query_id) LEFT JOIN ({VERIFIED}) v USING (query_id))
    SELECT query_id, CASE WHEN v AND e1 = 1 AND f1 = 0 THEN CASE WHEN w THEN 'native_verifier_hallucination' ELSE 'native_verifier_failure' END WHEN NOT evidence_available THEN 'upstream_evidence_absent'
      WHEN u10 = 1 AND r10 = 0 THEN 'router_wrong_channel_mix' WHEN r10 = 0 THEN 'candidate_generation_miss' WHEN r1 = 1 AND e1 = 0 THEN 'reranker_reorder_error' WHEN f1 = 1 AND iou < 0.5 THEN 'scene_boundary_failure'
      WHEN v AND w THEN 'native_verifier_hallucination' WHEN v THEN 'native_verifier_failure' WHEN hard_category IS NOT NULL THEN 'hard_negative_ambiguity' ELSE 'reranker_reorder_error' END AS cause
    FROM j WHERE NOT (f1 = 1 AND iou >= 0.5)""",
)
def a5(get):
    return M.attribute_stages(get(_STAGE_ROWS), get(GOLD), get(VERIFIED))


PAIRS = "SELECT event_type AS expected, CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END AS observed FROM {events}"


@query("a6_router_confusion", f"SELECT expected, observed, count(*) AS n, (SELECT round(avg((expected = observed)::INT), 9) FROM ({PAIRS})) AS accuracy FROM ({PAIRS}) GROUP BY ALL")
def a6(get):
    counts, accuracy = M.confusion(get(PAIRS))
    return counts.join(F.broadcast(accuracy.select(R9("accuracy"))))  # one row


@query(
    "a7_verification_effect",
    f"""WITH {METRICS}, j AS (SELECT b.hit_1 AS b, a.hit_1 AS a FROM ({VERIFIED}) v JOIN met b ON b.query_id = v.query_id AND b.method = 'bm25' JOIN met a ON a.query_id = v.query_id AND a.method = 'visual')
    SELECT count(*) AS invoked, count(*) FILTER (b = 0 AND a = 1) AS corrected, count(*) FILTER (b = 1 AND a = 0) AS harmed, count(*) FILTER (a = b) AS no_effect FROM j""",
)
def a7(get):
    m = metrics(get)
    hit = lambda name: m.filter(F.col("method") == name).select("query_id", F.col("hit_1").alias("hit"))
    return M.effect(hit("bm25"), hit("visual"), get(VERIFIED))


CALLS = f"SELECT {_SCENE}, CASE WHEN event_id % 3 = 0 THEN 'supports' WHEN event_id % 3 = 1 THEN 'contradicts' ELSE 'uncertain' END AS status, event_id % 2 = 0 AS cache_hit, event_id % 97 AS latency_ms FROM {{events}}"


@query(
    "a8_verdict_quality",
    f"""SELECT CASE WHEN status = 'uncertain' THEN 'uncertain' WHEN status = 'supports' AND q.query_id IS NOT NULL THEN 'correct_support' WHEN status = 'contradicts' AND q.query_id IS NULL THEN 'correct_contradiction'
      WHEN status = 'supports' THEN 'hallucinated_support' ELSE 'false_contradiction' END AS outcome, count(*) AS calls, count(*) FILTER (cache_hit) AS cache_hits, round(avg(latency_ms), 9) AS mean_latency, sum(latency_ms)::BIGINT AS total_latency
    FROM ({CALLS}) c LEFT JOIN (SELECT DISTINCT query_id, video_id, scene_id FROM ({QRELS})) q USING (query_id, video_id, scene_id) GROUP BY 1""",
)
def a8(get):
    return M.verdict_quality(get(CALLS), get(QRELS)).withColumn("mean_latency", F.round("mean_latency", 9))


LEFT = "SELECT user_id * 1000 + event_id % 97 AS k FROM {events} WHERE event_id % 2 = 0"
RIGHT = "SELECT user_id * 1000 + event_id % 97 AS k FROM {events} WHERE event_id % 2 = 1"


@query(
    "j6_key_sets",
    f"""WITH j AS (SELECT k, nl, nr FROM (SELECT k, count(*) AS nl FROM ({LEFT}) GROUP BY k) FULL JOIN (SELECT k, count(*) AS nr FROM ({RIGHT}) GROUP BY k) USING (k))
    SELECT k, 'missing_left' AS problem FROM j WHERE nl IS NULL UNION ALL SELECT k, 'missing_right' FROM j WHERE nr IS NULL
    UNION ALL SELECT k, 'duplicate_left' FROM j WHERE nl > 1 UNION ALL SELECT k, 'duplicate_right' FROM j WHERE nr > 1""",
)
def j6(get):
    return M.key_set_errors(get(LEFT), get(RIGHT), "k")
