"""Queries of sampling, leak scans, split governance and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import governance as G
from quillspan.plans.registry import query
from quillspan.sources import records as S

R9 = lambda c: F.round(c, 9).alias(c)
ROWS = "SELECT event_id, value, user_id, event_type FROM {events}"


@query("l2_even_sample", f"WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM ({ROWS})) SELECT event_id FROM n WHERE i IN (SELECT round_even(k * (SELECT max(n) - 1 FROM n) / 49.0, 0)::BIGINT FROM range(50) t(k))")
def l2(get):
    return G.even_sample(get(ROWS), 50, "event_id").select("event_id")


@query(
    "l3_mixed_sample",
    f"""WITH t AS (SELECT event_id FROM ({ROWS}) ORDER BY value DESC, event_id LIMIT 10), r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () // 40 AS step FROM ({ROWS}) WHERE event_id NOT IN (SELECT event_id FROM t))
    SELECT event_id, 'best' AS part FROM t UNION ALL SELECT event_id, 'spread' FROM r WHERE i % step = 0 AND i // step < 40""",
)
def l3(get):
    return G.mixed_sample(get(ROWS), 10, 50, "value", "event_id").select("event_id", "part")


SPLIT_ROWS = "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'train' WHEN user_id % 3 = 1 THEN 'dev' ELSE 'test' END AS split FROM {events}"


@query("l4_first_packet", f"SELECT event_id, split FROM ({SPLIT_ROWS}) WHERE split IN ('train', 'dev') ORDER BY event_id LIMIT 25")
def l4(get):
    return G.first_packet(get(SPLIT_ROWS), ["train", "dev"], 25, "event_id")


DOCS = "SELECT doc_id, source, lang, text FROM {documents}"


@query("l5_group_holdout", f"SELECT doc_id, source, CASE WHEN source IN (SELECT DISTINCT source FROM ({DOCS}) ORDER BY source DESC LIMIT 2) THEN 'holdout' ELSE 'train' END AS subsplit FROM ({DOCS})")
def l5(get):
    out = G.group_holdout(get(DOCS), "source")
    return out.select("doc_id", "source", "subsplit")


@query("l5_group_overlap", f"SELECT source FROM ({DOCS}) GROUP BY source HAVING count(DISTINCT CASE WHEN lang = 'es' THEN 'dev' ELSE 'train' END) > 1")
def l5b(get):
    return G.group_overlap(get(DOCS).withColumn("sub", F.when(F.col("lang") == "es", "dev").otherwise("train")), "source", "sub")


@query("l6_exact_duplicates", f"SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM ({DOCS})")
def l6(get):
    return G.exact_duplicates(get(DOCS), ["text"])


PAGES = "SELECT page_id, html, regexp_replace(url, '^[a-z]+://', '') AS name FROM {pages}"
TOKENS = "SELECT 'license' AS token UNION ALL SELECT 'the' AS token UNION ALL SELECT 'Token =' AS token UNION ALL SELECT '' AS token"
_SEEN = "SELECT page_id, '{1}' AS location, '{2}' AS finding, '' AS detail FROM p WHERE regexp_matches({0}, '{3}')"
_SCAN = " UNION ALL ".join(
    [_SEEN.format(c, place, "path", 'file://|["\\s](/home|/root|/users|/data|/mnt)/|/(home|root|users)/') for c, place in (("t", "content"), ("u", "filename"))]
    + [_SEEN.format(c, place, "windows_path", "[a-z]:[\\\\/]") for c, place in (("t", "content"), ("u", "filename"))]
    + [f"SELECT page_id, '{place}', 'token', token FROM p JOIN ({TOKENS}) k ON token <> '' AND contains({c}, lower(token))" for c, place in (("t", "content"), ("u", "filename"))]
)


@query(
    "p3_leak_scan",
    f"""WITH p AS (SELECT page_id, lower(html) AS t, lower(name) AS u FROM ({PAGES})) {_SCAN}
    UNION ALL SELECT page_id, 'content', 'private_key', 'gold' FROM p WHERE regexp_matches(replace(t, '\\"', ''), '"gold"\\s*:') UNION ALL SELECT page_id, 'content', 'hidden_html', '' FROM p WHERE regexp_matches(t, '<!--|<script|\\sdata-[a-z]')""",
)
def p3(get):
    return G.leak_scan(get(PAGES), "page_id", "html", get(TOKENS), ["gold"], "name")


HASH_SPLIT = "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'test' END"
VALUES = f"SELECT 'source' AS kind, source AS value, {HASH_SPLIT} AS split FROM {{documents}} UNION ALL SELECT 'content' AS kind, md5(text) AS value, {HASH_SPLIT} AS split FROM {{documents}}"


@query("g1_cross_split", f"SELECT kind, value, count(DISTINCT split) AS n_splits FROM ({VALUES}) WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1")
def g1(get):
    return G.cross_split(get(VALUES))


DERIVED = f"SELECT doc_id AS source_id, {HASH_SPLIT} AS split, CASE WHEN doc_id % 4 = 0 THEN doc_id * 2 END AS derivative_of FROM {{documents}}"


@query(
    "g2_derivative_leaks",
    f"""WITH s AS ({DERIVED}) SELECT a.source_id, CASE WHEN b.source_id IS NULL THEN 'missing_parent' ELSE 'other_split' END AS problem FROM s a LEFT JOIN s b ON a.derivative_of = b.source_id WHERE a.derivative_of IS NOT NULL AND (b.split IS NULL OR b.split <> a.split)""",
)
def g2(get):
    return G.derivative_leaks(get(DERIVED))


TASKS = f"SELECT CAST(doc_id AS STRING) AS task_id, concat(text, CASE WHEN doc_id % 50 = 0 THEN CAST(doc_id AS STRING) ELSE '' END) AS instruction, lang AS answer, {HASH_SPLIT} AS split FROM {{documents}}"


@query(
    "g3_prompt_collisions",
    f"""WITH t AS ({TASKS}) SELECT 'collision' AS finding, count(*) AS n FROM (SELECT 1 FROM t GROUP BY trim(lower(instruction)), answer HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT 'own_id', count(*) FROM t WHERE contains(lower(instruction), lower(task_id))""",
)
def g3(get):
    return G.prompt_collisions(get(TASKS)).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


RECORDED = f"""SELECT task_id, concat('see ', task_id, CASE WHEN lang = 'en' THEN ' and 3 or 17' ELSE ' alone' END) AS instruction, concat('{{{{"task_id":1,', CASE WHEN split = 'dev' THEN '"difficulty":2' ELSE '"title":"x"' END, '}}}}') AS record FROM (SELECT CAST(doc_id AS STRING) AS task_id, lang, {HASH_SPLIT} AS split FROM {{documents}}) AS d"""


@query(
    "g3_public_leaks",
    f"""WITH t AS ({RECORDED.replace("STRING", "VARCHAR")}) SELECT 'private_field' AS finding, task_id AS value FROM t WHERE contains(record, '"difficulty"')
    UNION ALL SELECT DISTINCT 'foreign_id', t.task_id FROM t JOIN t AS o ON o.task_id IN ('3', '17') AND contains(t.instruction, ' and 3 or 17') AND o.task_id <> t.task_id""",
)
def g3_public(get):
    return G.public_leaks(get(RECORDED))


@query(
    "g4_leakage_report",
    f"""WITH r AS (SELECT 'cross_split' AS "check", count(*) AS n_findings FROM (SELECT 1 FROM ({VALUES}) WHERE value IS NOT NULL GROUP BY kind, value HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT 'derivatives', count(*) FROM ({DERIVED}) a LEFT JOIN ({DERIVED}) b ON a.derivative_of = b.source_id WHERE a.derivative_of IS NOT NULL AND (b.split IS NULL OR b.split <> a.split))
    SELECT *, sum(n_findings) OVER () = 0 AS passed FROM r""",
)
def g4(get):
    return G.leakage_report({"cross_split": G.cross_split(get(VALUES)), "derivatives": G.derivative_leaks(get(DERIVED))})


CASES = f"""SELECT doc_id, {HASH_SPLIT} AS split, lang AS family, doc_id % 4 AS n_tools, doc_id % 3 AS n_scenes, doc_id % 5 AS n_constraints, doc_id % 6 = 0 AS hard, doc_id % 8 = 0 AS recovery, doc_id % 9 = 0 AS impossible FROM {{documents}}"""
_GRADE = "CASE WHEN s <= 3 THEN 'L1' WHEN s <= 6 THEN 'L2' WHEN s <= 9 THEN 'L3' ELSE 'L4' END"
GRADED = f"SELECT *, {_GRADE} AS grade FROM (SELECT *, n_tools + n_scenes + n_constraints + CASE WHEN hard THEN 2 ELSE 0 END + CASE WHEN recovery THEN 3 ELSE 0 END AS s FROM ({CASES}))"
_HEALTH = "count(*) AS n, round(avg(n_tools), 9) AS mean_tools, round(avg(n_constraints), 9) AS mean_constraints, round(avg((grade IN ('L3', 'L4'))::INT), 9) AS share_hard, round(avg(impossible::INT), 9) AS share_impossible, round(avg(recovery::INT), 9) AS share_recovery"


def graded(get):
    c = get(CASES)
    return c.withColumn("difficulty", G.difficulty(F.col("n_tools"), F.col("n_scenes"), F.col("n_constraints"), F.col("hard"), F.col("recovery"))).withColumn("difficulty_grade", F.col("difficulty"))


@query(
    "g5_health",
    f"""WITH g AS ({GRADED}) SELECT 'all' AS level, NULL AS value, {_HEALTH} FROM g UNION ALL SELECT 'split', split, {_HEALTH} FROM g GROUP BY split UNION ALL SELECT 'family', family, {_HEALTH} FROM g GROUP BY family
    UNION ALL SELECT 'difficulty', grade, {_HEALTH} FROM g GROUP BY grade""",
)
def g5(get):
    return G.health(graded(get)).select("level", "value", "n", *[R9(c) for c in ("mean_tools", "mean_constraints", "share_hard", "share_impossible", "share_recovery")])


TRIVIAL = "SELECT CASE WHEN doc_id % 9 = 0 THEN 'impossible' ELSE lang END AS family, CASE WHEN doc_id % 9 = 0 THEN 'CANNOT_COMPLETE' ELSE 'SUCCESS' END AS expected_terminal, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 * 1000 END AS first_start_ms, CASE WHEN doc_id % 4 = 0 THEN 'speed' ELSE 'duration' END AS one FROM {documents}"


@query(
    "g5_trivial_policies",
    f"WITH t AS ({TRIVIAL}) SELECT 'always_refuse' AS baseline, round(avg((family = 'impossible')::INT), 9) AS success FROM t UNION ALL SELECT 'unchanged_source', 0 UNION ALL SELECT 'first_scene', round(avg((expected_terminal = 'SUCCESS' AND coalesce(first_start_ms = 0, false) AND one <> 'speed')::INT), 9) FROM t UNION ALL SELECT 'oracle', 1",
)
def g5_trivial(get):
    return G.trivial_policies(get(TRIVIAL).withColumn("constraint_types", F.array("one"))).select("baseline", R9("success"))


@query("g6_difficulty", f"SELECT doc_id, grade AS difficulty FROM ({GRADED})")
def g6(get):
    return graded(get).select("doc_id", "difficulty")


@query("g7_hash_assignment", "SELECT doc_id, 'task_' || left(sha256(source || '|' || lang || '|' || CAST(doc_id AS VARCHAR)), 16) AS opaque, ('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 1))::INT % 2 AS side FROM documents")
def g7(get):
    d = get("SELECT doc_id, source, lang FROM {documents}")
    return d.select("doc_id", G.opaque_id("source", "lang", "doc_id").alias("opaque"), G.parity("doc_id").alias("side"))


_MANIFEST = """count(*) AS n_rows, count(DISTINCT source) AS n_groups,
  sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(('0x' || left(d, 15))::HUGEINT) AS VARCHAR), min(d), max(d))) AS digest"""
_DIGEST = "SELECT *, sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), text)) AS d, " + HASH_SPLIT + " AS split FROM documents"


@query("s5_manifest", f"SELECT {_MANIFEST} FROM ({_DIGEST})")
def s5(get):
    return S.manifest(get(DOCS), ["doc_id", "text"], "source")


_PAIRED = "concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(('0x' || left({0}, 15))::HUGEINT) AS VARCHAR), min({0}), max({0}))"
_GROUP = "doc_id % 10"


@query(
    "g8_split_manifest",
    f"""WITH d AS (SELECT *, sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), lang)) AS e, {_GROUP} AS g FROM ({_DIGEST})), m AS (SELECT split, count(*) AS n_rows, count(DISTINCT g) AS n_groups, sha256({_PAIRED.format("d")}) AS public_digest, sha256({_PAIRED.format("e")}) AS private_digest FROM d GROUP BY split)
    SELECT *, (SELECT sum(n_rows) FROM m) = (SELECT count(*) FROM d) AND (SELECT sum(n_groups) FROM m) = (SELECT count(DISTINCT g) FROM d) AS adds_up FROM m""",
)
def g8(get):
    d = get(f"SELECT doc_id, lang, text, {_GROUP} AS grp, {HASH_SPLIT} AS split FROM {{documents}}")
    return G.split_manifest(d, ["doc_id", "text"], ["doc_id", "lang"], "grp", "split")


MEDIA = "SELECT user_id AS source_id, CASE WHEN user_id % 40 = 3 THEN ' ' ELSE 'cc' END AS license, event_id % 3000 AS clip_id, event_id % 17 - 1 AS start_ms, event_id % 19 AS end_ms FROM {events} WHERE event_id % 3 = 0"


@query(
    "s6_media_manifest",
    f"""WITH c AS ({MEDIA}) SELECT CAST(clip_id AS VARCHAR) AS key, 'interval' AS rule FROM c WHERE NOT (start_ms >= 0 AND start_ms < end_ms) UNION ALL SELECT CAST(clip_id AS VARCHAR), 'duplicate_clip' FROM c GROUP BY clip_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT CAST(source_id AS VARCHAR), 'license' FROM c WHERE trim(license) = '' UNION ALL SELECT 'manifest', 'clip_count' FROM c HAVING count(*) NOT BETWEEN 15 AND 30""",
)
def s6(get):
    nested = get(MEDIA).groupBy("source_id", "license").agg(F.collect_list(F.struct(F.col("clip_id").cast("string").alias("clip_id"), "start_ms", "end_ms")).alias("clips"))
    return S.media_manifest(nested.withColumn("source_id", F.col("source_id").cast("string")))[1]


REQ = "SELECT event_id AS access_id, event_type AS split, user_id % 5 AS model, md5(event_type) AS config_sha256 FROM {events} WHERE event_id % 10 <> 1"
REC = "SELECT event_id AS access_id, CASE WHEN event_id % 30 = 0 THEN 'x' ELSE event_type END AS split, user_id % 5 AS model, md5(event_type) AS config_sha256, CASE WHEN event_id % 21 = 0 THEN 'started' ELSE 'complete' END AS status FROM {events} WHERE event_id % 10 <> 2"


@query(
    "g9_access_ledger",
    f"""WITH j AS (SELECT coalesce(q.access_id, r.access_id) AS k, q.split AS s1, q.model AS m1, q.config_sha256 AS c1, r.split AS s2, r.model AS m2, r.config_sha256 AS c2, status FROM ({REQ}) q FULL JOIN ({REC}) r ON q.access_id = r.access_id),
    p AS (SELECT CAST(k AS VARCHAR) AS key, CASE WHEN status IS NULL THEN 'no_record' WHEN s1 IS NULL THEN 'no_request' WHEN status <> 'complete' THEN 'incomplete' WHEN s1 <> s2 OR m1 <> m2 OR c1 <> c2 THEN 'mismatch' END AS problem FROM j)
    SELECT * FROM p WHERE problem IS NOT NULL UNION ALL SELECT split || ':' || CAST(model AS VARCHAR), 'run_count' FROM ({REC}) GROUP BY split, model HAVING count(*) <> 1""",
)
def g9(get):
    return G.ledger_errors(get(REQ), get(REC))


RATINGS = "SELECT concat('r', CAST(event_id % 2 AS STRING)) AS rater_id, user_id AS case_id, CASE WHEN event_id % 50 = 0 THEN 'model' ELSE 'human' END AS rater_type, CASE WHEN event_id % 60 = 0 THEN 'v0' ELSE 'v1' END AS packet_version, event_type AS task_success, CASE WHEN event_id % 70 = 0 THEN NULL ELSE 'yes' END AS confidence FROM {events}"
ALL_CASES = "SELECT DISTINCT user_id AS case_id FROM {events}"


@query(
    "g10_rating_checks",
    f"""WITH r AS ({RATINGS}) SELECT rater_id, case_id, 'human' AS rule FROM r WHERE rater_type <> 'human' UNION ALL SELECT rater_id, case_id, 'packet' FROM r WHERE packet_version <> 'v1' UNION ALL SELECT rater_id, case_id, 'domain_task_success' FROM r WHERE task_success NOT IN ('view', 'click', 'error')
    UNION ALL SELECT rater_id, case_id, 'domain_confidence' FROM r WHERE confidence IS NULL UNION ALL SELECT rater_id, case_id, 'duplicate' FROM r GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT x.rater_id, c.case_id, 'missing' FROM (SELECT DISTINCT rater_id FROM r) x, ({ALL_CASES}) c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rater_id = x.rater_id AND r.case_id = c.case_id)""",
)
def g10(get):
    return G.rating_errors(get(RATINGS), get(ALL_CASES), {"task_success": ["view", "click", "error"], "confidence": ["yes", "no"]}, "v1")


FILES = "SELECT user_id % 12 AS file, CASE WHEN user_id % 12 = 3 THEN concat('rater ', CAST(event_id % 2 AS STRING)) WHEN user_id % 12 = 4 THEN 'Some GPT' WHEN user_id % 12 IN (5, 6) THEN concat(CASE WHEN user_id % 12 = 5 THEN 'Ann' ELSE ' ann' END, ' Lee') WHEN user_id % 12 = 7 THEN 'x' ELSE concat('rater of ', CAST(user_id % 12 AS STRING)) END AS rater_id, CASE WHEN user_id % 12 IN (8, 9) THEN 'same' ELSE CAST(event_id AS STRING) END AS answer FROM {events}"


@query(
    "g10_submissions",
    f"""WITH f AS ({FILES.replace("STRING", "VARCHAR")}), c AS (SELECT file, string_agg(answer, ',' ORDER BY answer) AS body FROM f GROUP BY 1)
    SELECT file, 'several_raters' AS rule FROM f GROUP BY file HAVING count(DISTINCT lower(trim(rater_id))) > 1 UNION ALL SELECT DISTINCT file, 'no_person' FROM f WHERE length(trim(rater_id)) < 2 OR contains(lower(rater_id), 'gpt')
    UNION ALL SELECT DISTINCT a.file, 'same_rater' FROM f a JOIN (SELECT DISTINCT file, lower(trim(rater_id)) AS r FROM f) b ON b.r = lower(trim(a.rater_id)) AND b.file <> a.file
    UNION ALL SELECT file, 'same_file' FROM c WHERE body IN (SELECT body FROM c GROUP BY body HAVING count(*) > 1)""",
)
def g10_files(get):
    return G.submission_errors(get(FILES), ["answer"])


PAIR = "SELECT 'quality' AS field, doc_id AS case_id, CAST(quality AS STRING) AS a, CAST(CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS STRING) AS b FROM {labels} UNION ALL SELECT 'toxic' AS field, doc_id AS case_id, CAST(toxic AS STRING) AS a, CAST(CASE WHEN doc_id % 11 = 0 THEN 1 - toxic ELSE toxic END AS STRING) AS b FROM {labels} UNION ALL SELECT 'same' AS field, doc_id AS case_id, 'x' AS a, 'x' AS b FROM {labels}"


@query(
    "g11_agreement",
    f"""WITH p AS ({PAIR}), t AS (SELECT field, count(*) AS n, avg((a = b)::INT) AS agreement FROM p GROUP BY field), c AS (SELECT field, sum(na * nb) AS x FROM (SELECT field, a AS l, count(*) AS na FROM p GROUP BY ALL) JOIN (SELECT field, b AS l, count(*) AS nb FROM p GROUP BY ALL) USING (field, l) GROUP BY field)
    SELECT field, n, round(agreement, 9) AS agreement, round(CASE WHEN x / (n * n) < 1 THEN (agreement - x / (n * n)) / (1 - x / (n * n)) WHEN agreement = 1 THEN 1 END, 9) AS kappa FROM t JOIN c USING (field)""",
)
def g11(get):
    return G.agreement(get(PAIR)).select("field", "n", R9("agreement"), R9("kappa"))


DECISIONS = "SELECT 'quality' AS field, doc_id AS case_id, '1' AS decision FROM {labels} WHERE doc_id % 7 = 0 AND doc_id % 14 <> 0 UNION ALL SELECT 'toxic' AS field, doc_id * 100000 AS case_id, '0' AS decision FROM {labels} WHERE doc_id % 29 = 1 UNION ALL SELECT 'same' AS field, doc_id AS case_id, 'x' AS decision FROM {labels} WHERE doc_id % 31 = 2"


@query(
    "g12_adjudication",
    f"""SELECT field, case_id, CASE WHEN a = b THEN a ELSE decision END AS label, CASE WHEN a IS NULL THEN 'unknown_case' WHEN a = b AND decision IS NOT NULL THEN 'not_disputed' WHEN a <> b AND decision IS NULL THEN 'undecided' END AS problem
    FROM ({PAIR}) p FULL JOIN ({DECISIONS}) d USING (field, case_id)""",
)
def g12(get):
    return G.adjudicate(get(PAIR), get(DECISIONS))


OUTCOMES = "SELECT event_id AS task_id, user_id AS source_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS base, CASE WHEN event_type IN ('view', 'click', 'error') THEN 1 ELSE 0 END AS other FROM {events}"


@query("g13_paired_bootstrap")
def g13(get):
    """Rows only: the draws are a hash that SQL engines don't share; exact cases are tested."""
    return G.paired_bootstrap(get(OUTCOMES), 1000, 20240922)


EVALS = "SELECT event_id AS task_id, event_type AS arm, event_id % 3 = 0 AS success FROM {events}"
TASK_SOURCES = "SELECT event_id AS task_id, user_id AS source_id FROM {events} WHERE event_id % 500 <> 3"
STORED = "SELECT event_type AS arm, avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) + CASE WHEN event_type = 'view' THEN 0.01 ELSE 0 END AS stored_rate FROM {events} GROUP BY event_type"


@query(
    "g14_outcome_checks",
    f"""SELECT 'no_source' AS problem, CAST(task_id AS VARCHAR) AS key FROM ({EVALS}) WHERE task_id NOT IN (SELECT task_id FROM ({TASK_SOURCES})) UNION ALL SELECT 'rate', arm FROM (SELECT arm, avg(success::INT) AS rate FROM ({EVALS}) GROUP BY arm) FULL JOIN ({STORED}) USING (arm) WHERE NOT coalesce(abs(rate - stored_rate) <= 1e-4, false)""",
)
def g14(get):
    return G.outcome_errors(get(EVALS), get(TASK_SOURCES), get(STORED).withColumn("stored_rate", F.col("stored_rate").cast("double")), 1e-4)


ARMS = "SELECT CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'new' END AS arm, event_type AS family, user_id % 3 AS difficulty, event_id % 5 < 2 AS success FROM {events}"
_ARM = "round(avg(success::INT) FILTER (arm = 'base'), 9) AS base, round(avg(success::INT) FILTER (arm = 'new'), 9) AS new, round(avg(success::INT) FILTER (arm = 'new') - avg(success::INT) FILTER (arm = 'base'), 9) AS delta"


@query("g15_compare_arms", f"SELECT 'all' AS level, 'all' AS value, {_ARM} FROM ({ARMS}) UNION ALL SELECT 'family', family, {_ARM} FROM ({ARMS}) GROUP BY family UNION ALL SELECT 'difficulty', CAST(difficulty AS VARCHAR), {_ARM} FROM ({ARMS}) GROUP BY difficulty")
def g15(get):
    return G.compare_arms(get(ARMS), "base", "new", ["family", "difficulty"]).select("level", "value", R9("base"), R9("new"), R9("delta"))
