"""Ranking metrics and failure attribution.

candidates: query_id, method, video_id, scene_id, start_ms, end_ms, rank. qrels: query_id, video_id, scene_id, start_ms,
end_ms. gold: query_id, query_type, hard_category, evidence_available. A recall here is *any hit* within k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.intervals import iou
from quillspan.operators.intervals import overlap_join

SCENE = ["query_id", "video_id", "scene_id"]


def best_match(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """A2: each predicted interval with the best IoU among the gold intervals of its video (0 without one). Equal rows are one.

    Only intervals that overlap have an IoU above 0, so pairs come from the bucket join of intervals and not from all pairs of a key."""
    key = F.struct(*keys).alias("__key")
    by = predicted.columns
    pairs = overlap_join(predicted.select(*by, key), gold.select(key, "start_ms", "end_ms"), "__key")
    pairs = pairs.select(*by, iou(F.col("start_ms"), F.col("end_ms"), F.col("scene_start_ms"), F.col("scene_end_ms")).cast("double").alias("iou"))
    return pairs.unionByName(predicted.select(*by, F.lit(0.0).alias("iou"))).groupBy(*by).agg(F.max("iou").alias("iou"))


def query_metrics(candidates: DataFrame, qrels: DataFrame, gold: DataFrame, mrr_depth: int | None = None) -> DataFrame:
    """A1, A4: one row a (method, query) of the gold set: hits, reciprocal rank, nDCG@10, top-1 IoU, failure.

    ``mrr_depth`` cuts the rankings first (10 in the stricter protocol). Queries that a method left out get a row of zeros."""
    cut = candidates if mrr_depth is None else candidates.filter(F.col("rank") <= mrr_depth)
    rel = qrels.select(*SCENE).distinct().withColumn("relevant", F.lit(1))
    n_rel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = cut.join(rel, SCENE, "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    top = best_match(hits.filter("rank = 1").select("query_id", "method", "video_id", "start_ms", "end_ms"), qrels, ["query_id", "video_id"])
    gain = F.when((F.col("relevant") == 1) & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = hits.groupBy("query_id", "method").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first_rank"), F.sum(gain).alias("gain"))
    every = gold.join(candidates.select("method").distinct())
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    j = (
        every.join(per, ["query_id", "method"], "left")
        .join(n_rel, "query_id", "left")
        .join(top.select("query_id", "method", "iou"), ["query_id", "method"], "left")
    )
    hit = lambda k: F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)
    out = j.select(
        "query_id",
        "method",
        "query_type",
        "hard_category",
        hit(1).alias("hit_1"),
        hit(5).alias("hit_5"),
        hit(10).alias("hit_10"),
        F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        F.when(F.col("n_relevant") > 0, F.coalesce("gain", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg_10"),
        F.coalesce("iou", F.lit(0.0)).alias("iou"),
        "evidence_available",
    )
    return out.withColumn("failure", miss_reason())


def miss_reason(lexical: str = "bm25") -> Column:
    """A4: the first rule that fits; null for a hit."""
    return (
        F.when(F.col("rr") > 0, F.lit(None).cast("string"))
        .when(~F.col("evidence_available"), "perception_failure")
        .when(F.col("hard_category").isNotNull(), "hard_negative_confusion")
        .when(F.col("query_type") == "action", "action_confusion")
        .when((F.col("query_type") == "entity") & (F.col("method") == "visual"), "wrong_visual_entity")
        .when(F.col("method") == lexical, "lexical_mismatch")
        .otherwise("semantic_confusion")
    )


def summarize(metrics: DataFrame, latency: str | None = None) -> DataFrame:
    """A3: means per method, and by query type and by hard-negative category, in one pass of grouping sets.

    p50 is the median, p95 the nearest rank."""
    m = ["hit_1", "hit_5", "hit_10", "rr", "ndcg_10", "iou"]
    sets = metrics.groupingSets([[F.col("method")], [F.col("method"), F.col("query_type")], [F.col("method"), F.col("hard_category")]], "method", "query_type", "hard_category")
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in m], F.grouping_id().alias("g")]
    if latency:
        aggs += [F.median(latency).alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})").alias("p95")]
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "query_type").otherwise("hard_category")
    return sets.agg(*aggs).withColumn("level", level).filter("level <> 'hard_category' OR hard_category IS NOT NULL").drop("g")


def attribute_stages(stages: DataFrame, gold: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A5: query_id, cause of every query whose final top-1 is wrong or misplaced.

    stages: query_id, stage (uniform, routed, reranked, final), hit_1, hit_10, iou. verdicts: query_id, supports_wrong (one row
    a verified query)."""
    flag = lambda s, c: F.max(F.when(F.col("stage") == s, F.col(c)))
    p = stages.groupBy("query_id").agg(
        flag("uniform", "hit_10").alias("u10"),
        flag("routed", "hit_1").alias("r1"),
        flag("routed", "hit_10").alias("r10"),
        flag("reranked", "hit_1").alias("e1"),
        flag("final", "hit_1").alias("f1"),
        flag("final", "iou").alias("iou"),
    )
    j = p.join(gold, "query_id").join(verdicts.withColumn("verified", F.lit(True)), "query_id", "left").fillna(False, ["verified", "supports_wrong"])
    v, wrong = F.col("verified"), F.col("supports_wrong")
    cause = (
        F.when(v & (F.col("e1") == 1) & (F.col("f1") == 0), F.when(wrong, "native_verifier_hallucination").otherwise("native_verifier_failure"))
        .when(~F.col("evidence_available"), "upstream_evidence_absent")
        .when((F.col("u10") == 1) & (F.col("r10") == 0), "router_wrong_channel_mix")
        .when(F.col("r10") == 0, "candidate_generation_miss")
        .when((F.col("r1") == 1) & (F.col("e1") == 0), "reranker_reorder_error")
        .when((F.col("f1") == 1) & (F.col("iou") < 0.5), "scene_boundary_failure")
        .when(v & wrong, "native_verifier_hallucination")
        .when(v, "native_verifier_failure")
        .when(F.col("hard_category").isNotNull(), "hard_negative_ambiguity")
        .otherwise("reranker_reorder_error")
    )
    return j.filter(~((F.col("f1") == 1) & (F.col("iou") >= 0.5))).select("query_id", cause.alias("cause"))


def confusion(pairs: DataFrame, expected: str = "expected", observed: str = "observed") -> tuple[DataFrame, DataFrame]:
    """Counts of expected x observed, and the accuracy."""
    return (
        pairs.groupBy(expected, observed).agg(F.count(F.lit(1)).alias("n")),
        pairs.agg(F.avg((F.col(expected) == F.col(observed)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")),
    )


def effect(before: DataFrame, after: DataFrame, verified: DataFrame) -> DataFrame:
    """Corrected, harmed, unchanged top-1 of the verified queries; before, after: query_id, hit."""
    j = verified.select("query_id").distinct().join(before.withColumnRenamed("hit", "b"), "query_id").join(after.withColumnRenamed("hit", "a"), "query_id")
    return j.agg(
        F.count(F.lit(1)).alias("invoked"),
        F.count_if((F.col("b") == 0) & (F.col("a") == 1)).alias("corrected"),
        F.count_if((F.col("b") == 1) & (F.col("a") == 0)).alias("harmed"),
        F.count_if(F.col("b") == F.col("a")).alias("no_effect"),
    )


def verdict_quality(calls: DataFrame, qrels: DataFrame) -> DataFrame:
    """Outcome -> calls, cache hits, mean latency; calls: query_id, video_id, scene_id, status, cache_hit, latency_ms."""
    j = calls.join(qrels.select(*SCENE).distinct().withColumn("rel", F.lit(True)), SCENE, "left").fillna(False, ["rel"])
    s = F.col("status")
    outcome = (
        F.when(s == "uncertain", "uncertain")
        .when((s == "supports") & F.col("rel"), "correct_support")
        .when((s == "contradicts") & ~F.col("rel"), "correct_contradiction")
        .when(s == "supports", "hallucinated_support")
        .otherwise("false_contradiction")
    )
    return j.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.avg("latency_ms").alias("mean_latency"), F.sum("latency_ms").alias("total_latency")
    )


def key_set_errors(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Key, problem: keys that are missing on a side or occur twice. Empty if both sides may be evaluated together."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("nl"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("nr"))
    j = a.join(b, key, "full_outer")
    problems = F.array_compact(
        F.array(
            F.when(F.col("nl").isNull(), F.lit("missing_left")),
            F.when(F.col("nr").isNull(), F.lit("missing_right")),
            F.when(F.col("nl") > 1, F.lit("duplicate_left")),
            F.when(F.col("nr") > 1, F.lit("duplicate_right")),
        )
    )
    return j.select(key, F.explode(problems).alias("problem"))
