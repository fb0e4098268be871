"""Queries of interval joins and integrity checks: events as spans, users as videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import intervals as I
from quillspan.plans.registry import query

SPANS = "SELECT user_id AS video_id, event_id AS span_id, event_id * 37 % 500000 AS start_ms, event_id * 37 % 500000 + 1 + event_id * 7 % 90000 AS end_ms FROM {events}"
SCENES = "SELECT user_id AS video_id, event_id AS scene_id, event_id * 53 % 500000 AS start_ms, event_id * 53 % 500000 + 1000 + event_id % 12000 AS end_ms FROM {events}"


@query("j1_overlap_join", f"SELECT a.video_id, a.span_id, b.scene_id FROM ({SPANS}) a JOIN ({SCENES}) b ON a.video_id = b.video_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms")
def j1(get):
    return I.overlap_join(get(SPANS), get(SCENES), "video_id").select("video_id", "span_id", "scene_id")


PART = "SELECT user_id AS video_id, event_id % 6 AS scene_id, event_id AS pos, event_type AS value FROM {{events}} WHERE event_id % 7 % 2 = {0}"
KEYS = "SELECT DISTINCT user_id AS video_id, event_id % 6 AS scene_id FROM {events}"


def _list(i: int) -> str:
    return f"(SELECT video_id, scene_id, string_agg(value, ',' ORDER BY pos) AS l, string_agg(value, ' | ' ORDER BY pos) AS s FROM ({PART.format(i)}) GROUP BY ALL)"


@query(
    "j2_scene_assembly",
    f"""SELECT k.video_id, k.scene_id, coalesce(a.l, '') AS spans, coalesce(b.l, '') AS ocr, concat_ws(' | ', a.s, b.s) AS summary
    FROM ({KEYS}) k LEFT JOIN {_list(0)} a USING (video_id, scene_id) LEFT JOIN {_list(1)} b USING (video_id, scene_id)""",
)
def j2(get):
    out = I.assemble_scenes(get(KEYS), {"spans": get(PART.format(0)), "ocr": get(PART.format(1))})
    return out.select("video_id", "scene_id", F.array_join("spans", ",").alias("spans"), F.array_join("ocr", ",").alias("ocr"), "summary")


NOMINAL = "SELECT user_id AS video_id, event_id AS nominal_id, event_id * 37 % 500000 AS start_ms, event_id * 37 % 500000 + 5000 AS end_ms FROM {events}"


@query(
    "j3_midpoint_scene",
    f"""SELECT nominal_id, count(b.scene_id) AS n_scenes, CASE WHEN count(b.scene_id) = 1 THEN min(b.scene_id) END AS scene_id
    FROM ({NOMINAL}) a LEFT JOIN ({SCENES}) b ON a.video_id = b.video_id AND b.start_ms <= (a.start_ms + a.end_ms) // 2 AND (a.start_ms + a.end_ms) // 2 < b.end_ms GROUP BY nominal_id""",
)
def j3(get):
    return I.midpoint_scene(get(NOMINAL), get(SCENES), "video_id")


CLAIMS = """SELECT event_id AS claim_id, user_id AS artifact_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN event_id % 4 END AS segment_id,
  CASE WHEN event_id % 2 = 0 THEN event_id * 10 END AS at_ms, CASE WHEN event_id % 2 = 1 THEN event_id * 10 END AS start_ms, CASE WHEN event_id % 2 = 1 THEN event_id * 10 + 100 END AS end_ms FROM {events}"""
CATALOG = """SELECT user_id AS artifact_id, event_type AS kind, CASE WHEN event_id % 4 = 0 THEN event_id % 4 END AS segment_id,
  CASE WHEN event_id % 7 = 0 THEN event_id * 10 END AS at_ms, CASE WHEN event_id % 7 <> 0 THEN event_id * 10 - 20000 END AS start_ms, CASE WHEN event_id % 7 <> 0 THEN event_id * 10 + 5000 END AS end_ms FROM {events} WHERE event_id % 3 = 1"""


@query(
    "j4_uncovered_claims",
    f"""SELECT claim_id, kind FROM ({CLAIMS}) c WHERE NOT EXISTS (SELECT 1 FROM ({CATALOG}) k WHERE k.artifact_id = c.artifact_id AND k.kind = c.kind AND (k.segment_id IS NULL OR k.segment_id IS NOT DISTINCT FROM c.segment_id)
      AND (c.at_ms IS NULL OR k.at_ms = c.at_ms OR (k.start_ms <= c.at_ms AND c.at_ms < k.end_ms)) AND (c.start_ms IS NULL OR (k.start_ms <= c.start_ms AND c.end_ms <= k.end_ms)))""",
)
def j4(get):
    return I.uncovered_claims(get(CLAIMS), get(CATALOG)).select("claim_id", "kind")


TILES = "SELECT user_id AS video_id, event_id AS scene_id, (event_id - event_id % 150) AS start_ms, event_id - event_id % 150 + CASE WHEN event_id % 17 = 0 THEN 140 WHEN event_id % 19 = 0 THEN 400 ELSE 150 END AS end_ms FROM {events}"
DURATIONS = "SELECT user_id AS video_id, max(event_id) AS duration_ms FROM {events} GROUP BY user_id"


@query(
    "j5_timeline_contiguity",
    f"""WITH s AS (SELECT *, lag(end_ms) OVER w AS b, lead(start_ms) OVER w IS NULL AS last FROM ({TILES}) WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, scene_id)),
    p AS (SELECT video_id, scene_id, CASE WHEN b IS NULL AND start_ms <> 0 THEN 'start' WHEN b < start_ms THEN 'gap' WHEN b > start_ms THEN 'overlap' WHEN last AND end_ms <> duration_ms THEN 'end' END AS problem FROM s JOIN ({DURATIONS}) USING (video_id))
    SELECT * FROM p WHERE problem IS NOT NULL""",
)
def j5(get):
    return I.contiguity_errors(get(TILES), get(DURATIONS))


REQUESTS = "SELECT event_id, user_id AS task_id FROM {events}"
REGISTRY = "SELECT DISTINCT user_id AS task_id, CASE WHEN user_id % 3 = 0 THEN 'train' WHEN user_id % 3 = 1 THEN 'test' ELSE 'validation' END AS split FROM {events} WHERE user_id % 10 <> 0"


@query(
    "j7_train_only_access",
    f"SELECT event_id, CASE WHEN split = 'train' THEN 'granted' ELSE 'denied' END AS outcome, CASE WHEN split = 'train' THEN NULL ELSE coalesce(split, 'unknown') END AS reason FROM ({REQUESTS}) r LEFT JOIN ({REGISTRY}) g USING (task_id)",
)
def j7(get):
    ok, audit = I.train_only(get(REQUESTS), get(REGISTRY), "task_id")
    return ok.select("event_id", F.lit("granted").alias("outcome"), F.lit(None).cast("string").alias("reason")).union(audit.select("event_id", F.lit("denied"), "reason"))


REFS = "SELECT user_id AS k FROM {events}"
ASSETS = "SELECT user_id AS k, md5(CASE WHEN user_id % 4 = 0 THEN event_type ELSE 'x' END) AS sha FROM {events} WHERE user_id % 5 <> 0"


@query(
    "j11_required_assets",
    f"""SELECT DISTINCT k, 'missing' AS problem FROM ({REFS}) WHERE k NOT IN (SELECT k FROM ({ASSETS})) UNION ALL SELECT k, 'conflict' FROM ({ASSETS}) GROUP BY k HAVING min(sha) <> max(sha)""",
)
def j11(get):
    return I.missing_assets(get(REFS), get(ASSETS), "k")


LABELS = "SELECT event_id AS scene_id, concat(event_type, '-', CAST(event_id % 700 AS STRING)) AS label, event_id % 4 = 0 AS has_evidence FROM {events}"


@query(
    "j12_relevance_sets",
    f"""SELECT trim(regexp_replace(lower(label), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', ' ', 'g')) AS label, string_agg(DISTINCT CAST(scene_id AS VARCHAR), ',' ORDER BY CAST(scene_id AS VARCHAR)) AS scenes, count(DISTINCT scene_id) AS n_scenes, bool_or(has_evidence) AS evidence_available
    FROM ({LABELS}) GROUP BY 1 HAVING count(DISTINCT scene_id) >= 2""",
)
def j12(get):
    out = I.relevance_sets(get(LABELS))
    return out.select("label", F.array_join(F.array_sort(F.transform("scenes", lambda x: x.cast("string"))), ",").alias("scenes"), F.col("n_scenes").cast("long"), "evidence_available")


RUN_A = "SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS user_id FROM {events} WHERE event_id % 10 <> 3"
RUN_B = "SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'other' ELSE event_type END AS event_type, user_id FROM {events} WHERE event_id % 10 <> 4"


@query(
    "j13_run_differences",
    f"""WITH j AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, a.event_id IS NOT NULL AS l, b.event_id IS NOT NULL AS r, a.event_type AS t1, b.event_type AS t2, a.user_id AS u1, b.user_id AS u2 FROM ({RUN_A}) a FULL JOIN ({RUN_B}) b ON a.event_id = b.event_id)
    SELECT event_id, '*' AS "column", CASE WHEN l THEN 'present' END AS first, CASE WHEN r THEN 'present' END AS second FROM j WHERE NOT (l AND r)
    UNION ALL SELECT event_id, 'event_type', t1, t2 FROM j WHERE l AND r AND t1 IS DISTINCT FROM t2 UNION ALL SELECT event_id, 'user_id', CAST(u1 AS VARCHAR), CAST(u2 AS VARCHAR) FROM j WHERE l AND r AND u1 IS DISTINCT FROM u2""",
)
def j13(get):
    return I.differences(get(RUN_A), get(RUN_B), ["event_id"])


ALIASED = "SELECT event_id AS claim_id, event_type AS a1, CAST(event_id % 7 AS STRING) AS a2, event_id % 13 = 0 AS none FROM {events}"
AVAILABLE = "SELECT DISTINCT event_type AS alias, user_id % 1 + length(event_type) AS evidence_id FROM {events} WHERE event_type <> 'view' UNION SELECT CAST(event_id % 5 AS STRING) AS alias, event_id % 5 AS evidence_id FROM {events}"


@query(
    "j14_alias_resolution",
    f"""WITH c AS ({ALIASED}), e AS (SELECT claim_id, a1 AS alias FROM c WHERE NOT none UNION ALL SELECT claim_id, a2 FROM c WHERE NOT none UNION ALL SELECT claim_id, NULL FROM c WHERE none), v AS ({AVAILABLE})
    SELECT claim_id, coalesce(alias, '') AS alias, CAST(evidence_id AS BIGINT) AS evidence_id, CASE WHEN alias IS NULL THEN 'empty' WHEN evidence_id IS NULL THEN 'unknown' END AS problem FROM e LEFT JOIN v USING (alias)""",
)
def j14(get):
    claims = get(ALIASED).withColumn("aliases", F.when(F.col("none"), F.array().cast("array<string>")).otherwise(F.array("a1", "a2")))
    ok, errors = I.resolve_aliases(claims, get(AVAILABLE))
    return ok.select("claim_id", "alias", F.col("evidence_id").cast("long"), F.lit(None).cast("string").alias("problem")).union(errors.select("claim_id", "alias", F.lit(None).cast("long"), "problem"))


TICKS = "SELECT event_id, event_id * 7919 % 100003 - 50000 AS pts, user_id AS origin, event_id % 3 + 1 AS num, event_id % 89 * 2 + 1 AS den, user_id * 100 AS duration FROM {events}"


@query(
    "p4_timebase",
    f"""WITH t AS (SELECT *, (pts - origin) * num * 1000 AS n FROM ({TICKS})), q AS (SELECT *, CAST(floor(n / CAST(den AS DOUBLE)) AS BIGINT) AS lo FROM t), z AS (SELECT *, n - lo * den AS rest FROM q)
    SELECT event_id, lo AS floor_ms, lo + (rest > 0)::INT AS ceil_ms, lo + (2 * rest > den OR (2 * rest = den AND n > 0))::INT AS nearest_ms,
      CASE WHEN greatest(0, lo) < least(duration, lo + 5000) THEN greatest(0, lo) END AS clip_start, CASE WHEN greatest(0, lo) < least(duration, lo + 5000) THEN least(duration, lo + 5000) END AS clip_end FROM z""",
)
def p4(get):
    t = get(TICKS)
    ms = lambda r: I.ticks_to_ms(F.col("pts"), F.col("origin"), F.col("num"), F.col("den"), r)
    t = t.select("event_id", "duration", ms("floor").alias("floor_ms"), ms("ceil").alias("ceil_ms"), ms("nearest").alias("nearest_ms"))
    c = I.clip_range(F.col("floor_ms"), F.col("floor_ms") + 5000, F.col("duration"))
    return t.select("event_id", "floor_ms", "ceil_ms", "nearest_ms", c["start_ms"].alias("clip_start"), c["end_ms"].alias("clip_end"))


@query(
    "p4_inverse",
    f"""WITH t AS (SELECT *, (event_id % 100000 - 50000) * den AS n, num * 1000 AS d FROM ({TICKS})), q AS (SELECT *, CAST(floor(n / CAST(d AS DOUBLE)) AS BIGINT) AS lo FROM t), z AS (SELECT *, n - lo * d AS rest FROM q)
    SELECT event_id, origin + lo AS floor_ticks, origin + lo + (rest > 0)::INT AS ceil_ticks, origin + lo + (2 * rest > d OR (2 * rest = d AND n > 0))::INT AS nearest_ticks FROM z""",
)
def p4_inverse(get):
    t = get(TICKS)
    back = lambda r: I.ms_to_ticks(F.col("event_id") % 100000 - 50000, F.col("origin"), F.col("num"), F.col("den"), r)
    return t.select("event_id", *[back(r).alias(f"{r}_ticks") for r in ("floor", "ceil", "nearest")])


CHUNKS = """SELECT user_id AS video_id, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE concat(' ', event_type) END AS text, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 500 AS DECIMAL(18,6)) / 8 END AS start_s,
  CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 700 AS DECIMAL(18,6)) / 8 END AS end_s, event_id % 3 * 1000 AS offset_ms, 50000 AS duration_ms FROM {events}"""


@query(
    "p5_clean_chunks",
    f"""WITH c AS (SELECT *, CAST(floor(start_s * 1000 + 0.5) AS BIGINT) + offset_ms AS s, CAST(floor(end_s * 1000 + 0.5) AS BIGINT) + offset_ms AS e FROM ({CHUNKS}) WHERE trim(text) <> '' AND start_s IS NOT NULL AND end_s IS NOT NULL),
    d AS (SELECT *, greatest(0, least(s, duration_ms - 1)) AS start_ms FROM c), f AS (SELECT *, least(duration_ms, greatest(e, start_ms + 1)) AS end_ms FROM d)
    SELECT video_id, pos, trim(text) AS text, start_ms, end_ms, sha256(concat_ws('|', video_id, pos, start_ms, end_ms, trim(text))) AS span_id FROM f""",
)
def p5(get):
    return I.clean_chunks(get(CHUNKS))


SEEN = "SELECT user_id AS video_id, event_id % 4 AS scene_id, event_type AS text, event_id % 3 AS at_ms FROM {events}"


@query(
    "p6_ocr_spans",
    f"""SELECT video_id, scene_id, text, CASE WHEN count(DISTINCT at_ms) = 1 THEN min(at_ms) END AS observed_ms, CASE WHEN count(DISTINCT at_ms) <> 1 THEN scene_id * 1000 END AS start_ms, CASE WHEN count(DISTINCT at_ms) <> 1 THEN scene_id * 1000 + 1000 END AS end_ms
    FROM ({SEEN}) GROUP BY video_id, scene_id, text""",
)
def p6(get):
    o = get(SEEN).withColumns({"start_ms": F.col("scene_id") * 1000, "end_ms": F.col("scene_id") * 1000 + 1000})
    return I.ocr_spans(o.select("video_id", "scene_id", "start_ms", "end_ms", F.array(F.struct("text", "at_ms")).alias("texts")))


@query("p7_sample_times", f"SELECT span_id, i, least(end_ms - 1, start_ms + (2 * i + 1) * (end_ms - start_ms) // 6) AS at_ms FROM ({SPANS}), range(3) t(i)")
def p7(get):
    return I.sample_times(get(SPANS), 3).select("span_id", F.col("i").cast("long").alias("i"), "at_ms")


CUTS = "SELECT user_id AS video_id, event_id * 31 % 9000 AS boundary_ms FROM {events}"
LENGTHS = "SELECT DISTINCT user_id AS video_id, CAST(8000 AS BIGINT) AS duration_ms FROM {events}"


@query(
    "p8_merge_boundaries",
    f"""WITH RECURSIVE b AS (SELECT DISTINCT video_id, boundary_ms AS b FROM ({CUTS}) WHERE boundary_ms > 0 AND boundary_ms < 8000), v AS (SELECT video_id FROM ({LENGTHS})),
    k AS (SELECT video_id, 0::BIGINT AS s FROM v UNION ALL SELECT k.video_id, (SELECT min(b) FROM b WHERE b.video_id = k.video_id AND b.b - k.s >= 700) AS s FROM k WHERE k.s IS NOT NULL),
    t AS (SELECT *, lead(s) OVER (PARTITION BY video_id ORDER BY s) IS NULL AND s > 0 AND 8000 - s < 700 AS short FROM k WHERE s IS NOT NULL)
    SELECT video_id, (row_number() OVER w - 1)::INT AS n, s AS start_ms, coalesce(lead(s) OVER w, 8000) AS end_ms FROM t WHERE NOT short WINDOW w AS (PARTITION BY video_id ORDER BY s)""",
)
def p8(get):
    return I.merge_boundaries(get(CUTS), get(LENGTHS), 700)
