"""Queries of trajectory evaluation: users as runs and tasks, events as tool rows and search candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import claims as C
from quillspan.operators import trajectories as T
from quillspan.operators.event_log import ancestors, unknown_citations
from quillspan.plans.registry import query
from quillspan.plans.scratch import materialize

R9 = lambda c: F.round(c, 9).alias(c)
_U = "(SELECT DISTINCT user_id FROM {events}) AS u"
_TOOL = "CASE event_id % 5 WHEN 0 THEN 'search_video' WHEN 1 THEN 'trim_video' WHEN 2 THEN 'concat_videos' WHEN 3 THEN 'add_subtitles' ELSE 'change_speed' END"
RUNS = f"""SELECT user_id AS run_id, user_id % 40 AS task_id, CASE WHEN user_id % 11 = 0 THEN 'BUDGET_EXHAUSTED' WHEN user_id % 13 = 0 THEN 'LOOP_DETECTED' WHEN user_id % 17 = 0 THEN 'MODEL_OUTPUT_FAILURE' WHEN user_id % 5 = 0 THEN 'CANNOT_COMPLETE' ELSE 'SUCCESS' END AS terminal_reason,
  's' AS source_artifact_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 7 = 0 THEN 's' ELSE 'f' END AS final_artifact_id, user_id * 100 AS duration_ms, 640 AS width, 360 AS height, true AS has_video, user_id % 2 = 0 AS has_audio FROM {_U}"""
TOOLS = f"""SELECT user_id AS run_id, event_id AS pos, {_TOOL} AS tool_name, CASE WHEN user_id % 3 = 0 AND event_id % 97 = 0 THEN 'invalid' WHEN user_id % 3 = 1 AND event_id % 89 = 0 THEN 'error' ELSE 'success' END AS status,
  event_id % 8 AS output_artifact_id, event_id % 9 * 1000 AS start_ms, event_id % 9 * 1000 + 1000 AS end_ms, event_type AS text, event_id % 4 / 2.0 AS speed, event_id % 300 AS latency_ms, event_id % 3 AS arguments FROM {{events}}"""
CANDS = "SELECT user_id AS run_id, event_type AS video_id, event_id % 50 AS scene_id, event_id % 9 * 1000 + 200 AS start_ms, event_id % 9 * 1000 + 1200 AS end_ms, event_id % 10 + 1 AS rank FROM {events}"
GOLD = f"SELECT DISTINCT user_id % 40 AS task_id, CASE WHEN user_id % 40 % 4 = 0 THEN 'impossible' ELSE 'edit' END AS family, CASE WHEN user_id % 40 % 4 = 0 THEN 'CANNOT_COMPLETE' ELSE 'SUCCESS' END AS expected_terminal, user_id % 40 % 3 AS need, 'planning_error' AS unsolved_cause FROM {_U}"
SCENES = f"SELECT DISTINCT user_id % 40 AS task_id, p.pos AS pos, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END AS video_id, (user_id % 40 + p.pos) % 50 AS scene_id, (user_id % 40 + p.pos) % 9 * 1000 AS start_ms, (user_id % 40 + p.pos) % 9 * 1000 + 1000 AS end_ms FROM {_U} CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 AS pos) AS p WHERE user_id % 4 <> 3"
_TYPES = ["grounding", "duration", "resolution", "subtitle", "scene_order", "speed", "streams", "derived_artifact", "absence"]
CONSTRAINTS = f"""SELECT DISTINCT user_id % 40 AS task_id, t.pos AS pos, t.type AS type, user_id % 40 % (t.pos + 2) = 0 AS mandatory, user_id % 40 * 100 AS target_ms, 5000 AS tolerance_ms, CASE WHEN user_id % 40 % 6 = 5 THEN 1280 ELSE 640 END AS width, 360 AS height,
  'view' AS text, user_id % 40 % 9 * 1000 AS start_ms, user_id % 40 % 9 * 1000 + 1000 AS end_ms, 1.5 AS speed, true AS require_video, user_id % 40 % 2 = 1 AS require_audio FROM {_U} CROSS JOIN ({" UNION ALL ".join(f"SELECT {i} AS pos, '{t}' AS type" for i, t in enumerate(_TYPES))}) AS t"""

IOU = "greatest(0, least({0}_e, {1}_e) - greatest({0}_s, {1}_s)) / (greatest({0}_e, {1}_e) - least({0}_s, {1}_s))"
TOOLS2 = f"SELECT *, output_artifact_id AS in0, (output_artifact_id + 1) % 8 AS in1 FROM ({TOOLS})"
BASE = f"""
runs AS ({RUNS}), tools AS ({TOOLS2}), cands AS ({CANDS}), gold AS ({GOLD}), scenes AS ({SCENES}), cons AS ({CONSTRAINTS}),
gs AS (SELECT r.run_id, s.pos AS gp, s.scene_id AS gsc, s.start_ms AS g_s, s.end_ms AS g_e FROM runs r JOIN scenes s USING (task_id)),
vids AS (SELECT DISTINCT r.run_id, s.video_id FROM runs r JOIN scenes s USING (task_id)),
cx AS (SELECT gs.run_id, gp, c.rank, c.scene_id = gsc AS same, {IOU.format("c", "g")} AS x FROM gs JOIN (SELECT run_id, video_id, scene_id, rank, start_ms AS c_s, end_ms AS c_e FROM cands) c ON c.run_id = gs.run_id JOIN vids v ON v.run_id = gs.run_id AND v.video_id = c.video_id),
pe AS (SELECT gs.run_id, gs.gp, min(rank) FILTER (same OR x >= 0.5) AS best, coalesce(max(x) FILTER (rank = 1), 0) AS top FROM gs LEFT JOIN cx ON cx.run_id = gs.run_id AND cx.gp = gs.gp GROUP BY ALL),
e1 AS (SELECT run_id, count(*) AS n_scenes, avg(coalesce((best = 1)::INT, 0)) AS recall_1, avg(coalesce((best <= 5)::INT, 0)) AS recall_5, avg(coalesce(1 / best, 0)) AS mrr, avg(top) AS iou FROM pe GROUP BY 1),
ok AS (SELECT * FROM tools WHERE status = 'success'),
gr AS (SELECT run_id, min(b) >= 0.9 AS grounded FROM (SELECT gs.run_id, gp, coalesce(max({IOU.format("t", "g")}) FILTER (t_s IS NOT NULL), 0) AS b FROM gs LEFT JOIN (SELECT run_id, start_ms AS t_s, end_ms AS t_e FROM ok WHERE tool_name = 'trim_video') t ON t.run_id = gs.run_id GROUP BY ALL) GROUP BY 1),
tr AS (SELECT run_id, output_artifact_id AS input, arg_max(start_ms, pos) AS t_s, arg_max(end_ms, pos) AS t_e FROM ok WHERE tool_name = 'trim_video' GROUP BY ALL),
cc AS (SELECT run_id, pos AS call, 0 AS i, in0 AS input FROM ok WHERE tool_name = 'concat_videos' UNION ALL SELECT run_id, pos, 1, in1 FROM ok WHERE tool_name = 'concat_videos'),
od AS (SELECT DISTINCT run_id FROM (SELECT cc.run_id, call FROM cc JOIN tr USING (run_id, input) JOIN gs ON gs.run_id = cc.run_id AND gs.gp = cc.i WHERE {IOU.format("t", "g")} >= 0.9 GROUP BY ALL HAVING count(*) = 2)),
e2 AS (SELECT r.run_id, c.pos, c.type, c.mandatory, coalesce(CASE c.type WHEN 'grounding' THEN coalesce(grounded, true) WHEN 'duration' THEN abs(r.duration_ms - c.target_ms) <= c.tolerance_ms WHEN 'resolution' THEN r.width = c.width AND r.height = c.height
   WHEN 'subtitle' THEN EXISTS (SELECT 1 FROM ok k WHERE k.run_id = r.run_id AND k.tool_name = 'add_subtitles' AND k.text = c.text AND k.start_ms = c.start_ms AND k.end_ms = c.end_ms) WHEN 'scene_order' THEN r.run_id IN (SELECT run_id FROM od)
   WHEN 'speed' THEN EXISTS (SELECT 1 FROM ok k WHERE k.run_id = r.run_id AND k.tool_name = 'change_speed' AND k.speed = c.speed) WHEN 'streams' THEN (NOT require_video OR has_video) AND (NOT require_audio OR has_audio)
   WHEN 'derived_artifact' THEN final_artifact_id IS NOT NULL AND final_artifact_id <> source_artifact_id WHEN 'absence' THEN terminal_reason = 'CANNOT_COMPLETE' END, false) AS satisfied FROM runs r JOIN cons c USING (task_id) LEFT JOIN gr ON gr.run_id = r.run_id),
cm AS (SELECT run_id, avg(satisfied::INT) AS satisfaction, bool_and(satisfied) AS am, list(type) FILTER (NOT satisfied) AS broken FROM e2 WHERE mandatory GROUP BY 1),
pt AS (SELECT run_id, list(DISTINCT tool_name) FILTER (status = 'success') AS used, count(*) AS n_tools, count(*) FILTER (status = 'invalid') AS n_invalid, count(*) FILTER (status <> 'success') AS n_failed, count(*) FILTER (tool_name = 'search_video') AS n_search FROM tools GROUP BY 1),
rq AS (SELECT *, CASE need WHEN 0 THEN ['search_video', 'trim_video'] WHEN 1 THEN ['trim_video'] ELSE ['search_video', 'export'] END AS required FROM gold),
f AS (SELECT r.*, family, expected_terminal, unsolved_cause, used, n_tools, n_invalid, n_failed, n_search, satisfaction, coalesce(am, true) AS am, coalesce(broken, []) AS broken, required, coalesce(n_scenes, 0) AS n_scenes, coalesce(recall_1, 0) AS recall_1, coalesce(recall_5, 0) AS recall_5, coalesce(mrr, 0) AS mrr, coalesce(iou, 0) AS iou,
   terminal_reason = expected_terminal AS ct, expected_terminal = 'CANNOT_COMPLETE' AS refuse, len(list_intersect(required, used)) = len(required) AS ts,
   len(list_intersect(required, used)) / len(list_distinct(list_concat(required, used))) AS tool_selection, (n_tools - n_invalid) / n_tools AS argument_validity FROM runs r JOIN rq USING (task_id) JOIN pt ON pt.run_id = r.run_id LEFT JOIN cm ON cm.run_id = r.run_id LEFT JOIN e1 ON e1.run_id = r.run_id),
g AS (SELECT *, CASE WHEN refuse THEN final_artifact_id IS NULL ELSE final_artifact_id IS NOT NULL END AS ca, refuse AND terminal_reason = 'CANNOT_COMPLETE' AND final_artifact_id IS NULL AS cr FROM f),
h AS (SELECT *, am AND ts AND CASE WHEN refuse THEN cr ELSE ct AND ca END AS success FROM g),
ev AS (SELECT *, CASE WHEN success THEN NULL WHEN terminal_reason = 'MODEL_OUTPUT_FAILURE' THEN 'model_format_error' WHEN terminal_reason = 'BUDGET_EXHAUSTED' THEN 'budget_exhaustion' WHEN terminal_reason = 'LOOP_DETECTED' THEN 'loop_stagnation' WHEN n_invalid > 0 THEN 'invalid_arguments' WHEN n_failed > 0 THEN 'tool_execution_failure'
   WHEN terminal_reason = 'CANNOT_COMPLETE' AND expected_terminal = 'SUCCESS' THEN 'premature_refusal' WHEN terminal_reason = 'SUCCESS' AND expected_terminal <> 'SUCCESS' THEN 'premature_finish' WHEN NOT ts THEN 'wrong_tool' WHEN n_scenes > 0 AND recall_5 < 1 THEN 'retrieval_error' WHEN list_contains(broken, 'grounding') THEN 'retrieval_error'
   WHEN NOT ca THEN 'handoff_error' WHEN len(list_intersect(broken, ['duration', 'resolution', 'subtitle', 'scene_order', 'speed'])) > 0 THEN 'invalid_arguments' WHEN NOT ct THEN unsolved_cause ELSE 'verification_error' END AS cause FROM h)"""


def parts(get):
    tools = get(TOOLS).withColumn("inputs", F.array("output_artifact_id", (F.col("output_artifact_id") + 1) % 8)).withColumn("speed", F.col("speed").cast("double"))
    pick = lambda *x: F.array(*[F.lit(t) for t in x])
    gold = get(GOLD).withColumn("required_tools", F.when(F.col("need") == 0, pick("search_video", "trim_video")).when(F.col("need") == 1, pick("trim_video")).otherwise(pick("search_video", "export")))
    return get(RUNS), tools, get(CANDS), gold, get(SCENES), get(CONSTRAINTS).withColumn("speed", F.col("speed").cast("double"))


def evaluated(get):
    return T.evaluate(*parts(get))


@query("e1_run_retrieval", f"WITH {BASE} SELECT r.run_id, coalesce(n_scenes, 0) AS n_scenes, round(coalesce(recall_1, 0), 9) AS recall_1, round(coalesce(recall_5, 0), 9) AS recall_5, round(coalesce(mrr, 0), 9) AS mrr, round(coalesce(iou, 0), 9) AS iou FROM runs r LEFT JOIN e1 USING (run_id)")
def e1(get):
    runs, _, c, _, s, _ = parts(get)
    return T.retrieval_metrics(runs, c, s).select("run_id", "n_scenes", R9("recall_1"), R9("recall_5"), R9("mrr"), R9("iou"))


@query("e2_constraint_results", f"WITH {BASE} SELECT run_id, pos, type, mandatory, satisfied FROM e2")
def e2(get):
    runs, t, _, _, s, k = parts(get)
    return T.constraint_results(runs, t, s, k)


@query("e3_scene_order", f"WITH {BASE} SELECT run_id FROM od")
def e3(get):
    runs, t, _, _, s, _ = parts(get)
    return T.order_satisfied(runs, t, s)


@query(
    "e4_task_evaluation",
    f"WITH {BASE} SELECT run_id, success AS task_success, round(satisfaction, 9) AS satisfaction, am AS all_mandatory, ct AS correct_termination, cr AS correct_refusal, ca AS correct_artifact, ts AS tools_satisfied, round(tool_selection, 9) AS tool_selection, round(argument_validity, 9) AS argument_validity, n_failed > 0 AS recovery_opportunity FROM ev",
)
def e4(get):
    return evaluated(get).select(
        "run_id", "task_success", R9("satisfaction"), "all_mandatory", "correct_termination", "correct_refusal", "correct_artifact", "tools_satisfied", R9("tool_selection"), R9("argument_validity"), "recovery_opportunity"
    )


@query("e5_failure_causes", f"WITH {BASE} SELECT run_id, cause AS primary_failure, CASE WHEN NOT success AND cause = 'invalid_arguments' AND n_invalid > 0 AND terminal_reason = 'CANNOT_COMPLETE' THEN 'premature_refusal' END AS secondary_failure FROM ev")
def e5(get):
    return evaluated(get).select("run_id", "primary_failure", "secondary_failure")


_COLS = {"task_success": "success::INT", "satisfaction": "satisfaction", "correct_artifact": "ca::INT", "recall_1": "recall_1", "recall_5": "recall_5", "mrr": "mrr", "iou": "iou", "tool_selection": "tool_selection", "argument_validity": "argument_validity", "n_tools": "n_tools", "n_search": "n_search", "correct_termination": "ct::INT"}


@query(
    "e6_benchmark_summary",
    f"""WITH {BASE} {" UNION ALL ".join(f"SELECT '{k}' AS metric, round(avg({v}), 8) AS value FROM ev" for k, v in _COLS.items())}
    UNION ALL SELECT 'impossible_refusal', round(avg(cr::INT), 8) FROM ev WHERE family = 'impossible' UNION ALL SELECT 'recovery_success', round(avg(success::INT), 8) FROM ev WHERE n_failed > 0 UNION ALL SELECT 'recovery_opportunities', count(*) FROM ev WHERE n_failed > 0
    UNION ALL SELECT 'family:' || family, round(avg(success::INT), 8) FROM ev GROUP BY family UNION ALL SELECT 'failure:' || cause, count(*) FROM ev WHERE cause IS NOT NULL GROUP BY cause""",
)
def e6(get):
    return T.summarize(evaluated(get)).withColumn("value", F.round("value", 8))


HITS = f"SELECT user_id AS run_id, event_id AS pos, h.rank AS rank, event_id % 9 * 1000 + event_id % 3 * 40 + h.rank * 7000 - 7000 AS start_ms, event_id % 9 * 1000 + event_id % 3 * 40 + h.rank * 7000 - 6000 AS end_ms FROM {{events}} CROSS JOIN (SELECT 1 AS rank UNION ALL SELECT 2 AS rank) AS h WHERE {_TOOL} = 'search_video' AND props NOT LIKE '%7%'"
STEPS = "SELECT user_id AS run_id, event_id AS step, CASE WHEN event_id % 12 = 3 THEN 'replan' WHEN event_id % 12 = 7 THEN 'recover' ELSE 'act' END AS operation, CASE WHEN event_id % 12 IN (3, 7) THEN NULL ELSE event_id END AS call_pos, event_id % 13 <> 0 AS valid, CASE WHEN event_id % 12 = 3 THEN event_id % 8 = 3 END AS accepted, event_id % 50 AS latency_ms, event_id % 17 % 2 AS repairs FROM {events}"
_NEAR = "EXISTS (SELECT 1 FROM gs WHERE gs.run_id = t.run_id AND {0} >= 0.9)".format("(greatest(0, least({0}.end_ms, g_e) - greatest({0}.start_ms, g_s)) / (greatest({0}.end_ms, g_e) - least({0}.start_ms, g_s)))")
ERR = f"""hits AS ({HITS}), steps AS ({STEPS}), err AS (SELECT t.run_id, t.pos, CASE WHEN status = 'invalid' THEN 'invalid_arguments' WHEN status <> 'success' THEN 'tool_execution_failure'
   WHEN tool_name = 'search_video' AND t.run_id IN (SELECT run_id FROM gs) AND h.run_id IS NULL THEN 'upstream_perception_error' WHEN tool_name = 'search_video' AND t.run_id IN (SELECT run_id FROM gs) AND NOT {_NEAR.format("h")} THEN 'retrieval_error'
   WHEN tool_name = 'trim_video' AND t.run_id IN (SELECT run_id FROM gs) AND NOT {_NEAR.format("t")} THEN 'invalid_arguments' WHEN tool_name <> 'search_video' AND NOT list_contains(required, tool_name) THEN 'wrong_tool' END AS cause
   FROM tools t JOIN runs r USING (run_id) JOIN rq USING (task_id) LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h ON h.run_id = t.run_id AND h.pos = t.pos),
fe AS (SELECT run_id, min(pos) AS pos, arg_min(cause, pos) AS cause FROM err WHERE cause IS NOT NULL GROUP BY 1),
tries AS (SELECT run_id, count(*) FILTER (operation <> 'act') AS attempts, count(*) FILTER (operation <> 'act' AND valid) AS nv, count(*) FILTER (operation <> 'act' AND valid AND accepted) AS na, count(*) FILTER (operation <> 'act' AND valid AND NOT accepted) AS n_rejected FROM steps GROUP BY 1),
lt AS (SELECT fe.run_id, count(*) AS n, sum(latency_ms) AS ms FROM fe JOIN tools t ON t.run_id = fe.run_id AND t.pos > fe.pos GROUP BY 1),
fs AS (SELECT fe.run_id, min(step) AS first_step FROM fe JOIN steps x ON x.run_id = fe.run_id AND x.call_pos = fe.pos AND x.valid GROUP BY 1),
ls AS (SELECT fs.run_id, count(*) AS n, sum(latency_ms) AS ms FROM fs JOIN steps x ON x.run_id = fs.run_id AND x.step > first_step GROUP BY 1),
rec AS (SELECT *, opportunity AND (attempts > 0 OR later > 0) AS attempted FROM (SELECT ev.run_id, ev.family, ev.success, ev.terminal_reason, ev.expected_terminal, ev.cause AS base_cause, fe.cause AS first_error, fe.pos IS NOT NULL AND ev.task_id % 3 <> 1 AND ev.expected_terminal = 'SUCCESS' AS opportunity, coalesce(attempts, 0) AS attempts, coalesce(nv, 0) AS nv, coalesce(na, 0) AS na, coalesce(n_rejected, 0) AS n_rejected,
   coalesce(lt.n, 0) AS later, coalesce(ls.n, 0) AS ls_n, coalesce(lt.ms, 0) + coalesce(ls.ms, 0) AS ms FROM ev LEFT JOIN fe ON fe.run_id = ev.run_id LEFT JOIN tries ON tries.run_id = ev.run_id LEFT JOIN lt ON lt.run_id = ev.run_id LEFT JOIN ls ON ls.run_id = ev.run_id)),
atr AS (SELECT *, CASE WHEN success THEN NULL WHEN terminal_reason = 'MODEL_OUTPUT_FAILURE' THEN 'model_format_error' WHEN terminal_reason = 'BUDGET_EXHAUSTED' THEN 'budget_exhaustion' WHEN terminal_reason = 'LOOP_DETECTED' THEN CASE WHEN run_id % 26 = 0 THEN 'handoff_error' ELSE 'loop_stagnation' END WHEN terminal_reason = 'CANNOT_COMPLETE' AND expected_terminal = 'SUCCESS' THEN 'premature_refusal'
   WHEN terminal_reason = 'SUCCESS' AND expected_terminal <> 'SUCCESS' THEN 'premature_success' WHEN n_rejected > 0 THEN 'recovery_patch_error' WHEN first_error IS NOT NULL THEN first_error WHEN base_cause IN ('verification_error', 'wrong_tool') THEN base_cause ELSE 'planning_error' END AS failure FROM rec)"""


def errors(get):
    runs, t, _, gold, scenes, _ = parts(get)
    return t, T.first_error(t, runs, gold, scenes, get(HITS))


def recoveries(get):
    ev = evaluated(get).withColumns({"designed": F.col("task_id") % 3 != 1, "repeated_editor": F.col("run_id") % 26 == 0})
    return T.attributed(T.recovery(ev, *errors(get), get(STEPS)))


@query("e8_first_error", f"WITH {BASE}, {ERR} SELECT run_id, pos, cause FROM fe")
def e8(get):
    return errors(get)[1]


@query(
    "e9_recovery",
    f"""WITH {BASE}, {ERR} SELECT run_id, first_error, opportunity, attempted, attempted AND success AS succeeded, attempts, round(nv / nullif(attempts, 0), 9) AS decision_validity, round(na / nullif(nv, 0), 9) AS patch_acceptance, n_rejected,
    CASE WHEN attempted THEN ls_n END AS extra_steps, CASE WHEN attempted THEN ms::BIGINT END AS extra_latency, failure FROM atr""",
)
def e9(get):
    return recoveries(get).select("run_id", "first_error", "opportunity", "attempted", "succeeded", "attempts", R9("decision_validity"), R9("patch_acceptance"), "n_rejected", "extra_steps", "extra_latency", "failure")


_ORIGINS = " UNION ALL ".join(f"SELECT 'origin:{o}', round(count(*) FILTER (failure IN ({', '.join(repr(c) for c in cs)})) / greatest(count(failure), 1), 8) FROM atr" for o, cs in T.ORIGINS.items())


@query(
    "e10_recovery_summary",
    f"""WITH {BASE}, {ERR} SELECT 'opportunities' AS metric, (count(*) FILTER (opportunity))::DOUBLE AS value FROM atr UNION ALL SELECT 'attempt_rate', round(avg(attempted::INT), 8) FROM atr WHERE opportunity UNION ALL SELECT 'success_rate', round(avg((attempted AND success)::INT), 8) FROM atr WHERE opportunity
    UNION ALL SELECT 'conditional_success', round(avg(success::INT), 8) FROM atr WHERE attempted UNION ALL SELECT 'decision_validity', round(avg(nv / attempts), 8) FROM atr WHERE attempts > 0 UNION ALL SELECT 'patch_acceptance', round(avg(na / nv), 8) FROM atr WHERE nv > 0
    UNION ALL SELECT 'median_extra_steps', median(ls_n) FROM atr WHERE attempted UNION ALL SELECT 'median_extra_latency', median(ms) FROM atr WHERE attempted UNION ALL {_ORIGINS}
    UNION ALL SELECT 'category:' || family, round(avg(success::INT), 8) FROM atr GROUP BY family""",
)
def e10(get):
    return T.recovery_summary(recoveries(get)).withColumn("value", F.round("value", 8))


EDITS = f"SELECT user_id AS run_id, event_id AS pos, {_TOOL} AS tool_name, event_id % 3 AS arguments, event_id % 2 AS parents FROM {{events}} WHERE event_id % 5 <> 0"


@query("e11_repeated_edits", f"SELECT run_id, round(avg((n > 1)::INT), 9) AS repeated_rate, count(*) AS edits FROM (SELECT *, row_number() OVER (PARTITION BY run_id, tool_name, arguments, parents ORDER BY pos) AS n FROM ({EDITS})) GROUP BY 1")
def e11(get):
    return T.repeated_edit_rate(get(EDITS)).withColumn("repeated_rate", F.round("repeated_rate", 9))


FUNNEL = """SELECT event_id AS run_id, event_type AS failure_type, event_id % 7 <> 0 AS triggered, CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS n_format_errors, event_id % 2 = 0 AS decided, CASE WHEN event_id % 4 <> 0 THEN event_id % 10 <> 6 END AS appropriate, CASE WHEN event_id % 6 <> 0 THEN event_id % 22 <> 2 END AS accepted,
  event_id % 3 <> 0 AS executable, event_id % 3 <> 0 AS attempted, CASE WHEN event_id % 14 = 4 THEN 'BUDGET_EXHAUSTED' ELSE 'SUCCESS' END AS terminal_reason, event_id % 5 <> 0 AS useful, event_id % 11 <> 0 AS repaired, event_id % 13 <> 0 AS task_success FROM {events}"""
_STAGES = ["triggered", "decided", "executable", "useful", "repaired"]
_LEVEL = "CASE " + " ".join(f"WHEN {' AND '.join(_STAGES[:k])} THEN {k}" for k in range(len(_STAGES), 0, -1)) + " ELSE 0 END"


@query(
    "e12_recovery_funnel",
    f"""SELECT run_id, {_LEVEL} AS level, CASE WHEN NOT triggered THEN 'recovery_not_triggered' WHEN n_format_errors > 0 THEN 'recovery_format_error' WHEN NOT decided THEN 'recovery_not_triggered' WHEN NOT appropriate THEN 'recovery_wrong_operation' WHEN NOT accepted THEN 'recovery_invalid_patch'
    WHEN NOT executable OR NOT attempted THEN 'recovery_no_state_change' WHEN terminal_reason = 'BUDGET_EXHAUSTED' THEN 'recovery_budget_exhaustion' WHEN NOT useful THEN 'recovery_wrong_tool_after_patch' WHEN NOT repaired THEN 'recovery_repeat_failure' WHEN NOT task_success THEN 'recovery_success_but_task_failed_later' END AS recovery_failure FROM ({FUNNEL})""",
)
def e12(get):
    return T.recovery_failure(T.funnel(get(FUNNEL), _STAGES)).select("run_id", "level", "recovery_failure")


_FS = ", ".join([f"count(*) FILTER (level >= {k}) AS at_least_{k}" for k in range(1, 6)] + [f"count(*) FILTER (level = {k}) AS highest_{k}" for k in range(6)])
_FR = ", ".join(f"round(at_least_{k} / {'n' if k == 1 else f'nullif(at_least_{k - 1}, 0)'}, 9) AS rate_{k}" for k in range(1, 6))


@query(
    "e13_funnel_summary",
    f"WITH l AS (SELECT failure_type, {_LEVEL} AS level FROM ({FUNNEL})), a AS (SELECT 'all' AS failure_type, count(*) AS n, {_FS} FROM l UNION ALL SELECT failure_type, count(*), {_FS} FROM l GROUP BY 1) SELECT *, {_FR} FROM a",
)
def e13(get):
    out = T.funnel_summary(T.funnel(get(FUNNEL), _STAGES), 5, "failure_type")
    return out.withColumns({f"rate_{k}": F.round(f"rate_{k}", 9) for k in range(1, 6)})


TCASES = "SELECT event_type AS tool, CASE WHEN event_id % 6 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'success' END AS expected, event_id % 251 AS error_ms, event_id % 997 AS latency_ms FROM {events}"


@query(
    "e14_tool_cases",
    f"SELECT tool, count(*) AS n, round(avg((status = 'success')::INT), 9) AS success, round(avg((status = expected)::INT), 9) AS as_expected, median(error_ms) AS error_median, quantile_disc(error_ms, 0.95) AS error_p95, median(latency_ms) AS latency_median, quantile_disc(latency_ms, 0.95) AS latency_p95 FROM ({TCASES}) GROUP BY 1",
)
def e14(get):
    return T.tool_cases(get(TCASES)).withColumns({c: F.round(c, 9) for c in ("success", "as_expected")})


PERF = "SELECT event_type AS variant, event_id AS run_id, event_id % 1009 AS latency_ms, event_id % 503 AS policy_ms, event_id % 3 AS recovery_policy_ms, event_id % 101 AS retrieval_ms, event_id % 211 AS editing_ms, event_id % 5 AS verification_ms FROM {events}"
PSTEPS = "SELECT event_type AS variant, event_id % 9 <> 0 AS valid, event_id % 77 AS latency_ms, event_id % 4096 AS input_tokens, event_id % 300 AS output_tokens, event_id % 60000 AS peak_allocated, event_id % 60000 + 1000 AS peak_reserved FROM {events}"
PTOOLS = "SELECT event_type AS variant, event_id % 3 = 0 AS cache_hit FROM {events}"
_TIMES = ", ".join(f"sum({c})::BIGINT AS total_{c}" for c in T.STAGE_TIMES)


@query(
    "e15_run_performance",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY latency_ms, run_id) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM ({PERF})),
    a AS (SELECT variant, count(*) AS runs, max(latency_ms) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50, max(latency_ms) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95, sum(latency_ms)::BIGINT AS total, round(avg(latency_ms), 9) AS mean, {_TIMES} FROM r GROUP BY 1),
    b AS (SELECT variant, round(avg(latency_ms), 9) AS mean_inference_ms, round(avg(input_tokens) FILTER (valid), 9) AS mean_input_tokens, round(avg(output_tokens) FILTER (valid), 9) AS mean_output_tokens, max(peak_allocated) FILTER (valid) AS peak_allocated, max(peak_reserved) FILTER (valid) AS peak_reserved FROM ({PSTEPS}) GROUP BY 1),
    c AS (SELECT variant, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cache_misses FROM ({PTOOLS}) GROUP BY 1) SELECT * FROM a JOIN b USING (variant) JOIN c USING (variant)""",
)
def e15(get):
    out = T.run_performance(get(PERF), get(PSTEPS), get(PTOOLS))
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "mean_inference_ms", "mean_input_tokens", "mean_output_tokens")})


WINS = "SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, event_type AS category, event_id % 3 = 0 AS success FROM {events}"


@query("e17_success_table", f'SELECT variant, {", ".join(f"sum(success::INT) FILTER (category = {c!r})::BIGINT AS {chr(34)}{c}{chr(34)}" for c in ("view", "click", "error"))} FROM ({WINS}) GROUP BY 1')
def e17(get):
    return T.success_table(get(WINS), ["view", "click", "error"])


SEEN = "SELECT user_id AS run_id, event_id AS seq, event_type AS kind, props AS summary, event_id % 4 AS part FROM {events}"
FRAMES = "SELECT user_id AS run_id, event_id AS seq, 'frame' AS kind, concat('frame ', CAST(event_id % 6 AS STRING)) AS summary FROM {events}"


@query(
    "p2_public_view",
    f"""WITH o AS ({SEEN}), f AS (SELECT run_id, max(seq) AS seq, kind, summary FROM ({FRAMES.replace("STRING", "VARCHAR")}) GROUP BY ALL), u AS (SELECT run_id, CASE part WHEN 1 THEN 'verification' WHEN 2 THEN 'scene' ELSE 'observation' END AS part, seq, kind, summary FROM o UNION ALL SELECT run_id, 'keyframe', seq, kind, summary FROM f)
    SELECT run_id, part, row_number() OVER (PARTITION BY run_id, part ORDER BY CASE WHEN part = 'scene' THEN seq ELSE -seq END, summary) AS n, seq, kind, summary FROM u QUALIFY n <= CASE part WHEN 'scene' THEN 5 WHEN 'keyframe' THEN 4 ELSE 8 END""",
)
def p2(get):
    o = get(SEEN)
    return T.public_view(o.filter("part IN (0, 3)"), o.filter("part = 1"), o.filter("part = 2"), get(FRAMES))


FACTS = """SELECT user_id AS run_id, event_id AS pos, event_id % 9 * 1000 AS start_ms, event_id % 9 * 1000 + 1000 AS end_ms, CASE WHEN event_id % 5 = 0 THEN 'search_video' ELSE 'trim_video' END AS tool_name, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, event_id % 11 = 3 AS broken FROM {events}"""


def records(get):
    """Runs with their tool records as one JSON text; some records name no tool, some candidates have no range or an empty one."""
    span = F.struct("start_ms", "end_ms")
    good = F.struct(F.lit("v").alias("video_id"), F.concat(F.lit("s"), F.col("pos")).alias("scene_id"), span.alias("time_range"))
    bad = F.struct(F.lit("v").alias("video_id"), F.concat(F.lit("s"), F.col("pos")).alias("scene_id"), F.struct(F.col("end_ms").alias("start_ms"), F.col("end_ms")).alias("time_range"))
    details = F.struct(F.struct(F.array(F.when(F.col("broken"), bad).otherwise(good), bad, good).alias("candidates")).alias("response"))
    record = F.to_json(F.struct(F.when(~F.col("broken") | (F.col("tool_name") == "search_video"), F.col("tool_name")).alias("tool_name"), "status", F.struct(span.alias("time_range")).alias("arguments"), details.alias("details")))
    r = get(FACTS).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", record.alias("x")))).alias("rs"))
    return r.select("run_id", F.concat(F.lit("["), F.array_join(F.transform("rs", lambda x: x["x"]), ","), F.lit("]")).alias("records"))


_FACTS = f"f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS n FROM ({FACTS}))"


@query("p9_tool_facts", f"WITH {_FACTS} SELECT run_id, n AS pos, tool_name, status, start_ms, end_ms FROM f WHERE tool_name = 'search_video' OR NOT broken")
def p9_tools(get):
    return T.tool_facts(records(get))


@query("p9_search_candidates", f"WITH {_FACTS} SELECT run_id, n AS pos, c.r AS rank, 'v' AS video_id, 's' || CAST(pos AS VARCHAR) AS scene_id, start_ms, end_ms FROM f, (SELECT unnest([1, 2]) AS r) AS c WHERE tool_name = 'search_video' AND status = 'success' AND (r = 1 OR NOT broken)")
def p9_candidates(get):
    return T.search_candidates(records(get))


VALID = "SELECT user_id AS run_id, event_id AS pos, event_type AS artifact_id, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'success' END AS status, props AS details FROM {events}"
FINALS = f"SELECT user_id AS run_id, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END AS final_artifact_id FROM {_U}"


@query("p9_final_media", f"SELECT v.run_id, arg_max(details, pos) AS details FROM ({VALID}) v JOIN ({FINALS}) r ON r.run_id = v.run_id AND r.final_artifact_id = v.artifact_id WHERE status = 'success' GROUP BY 1")
def p9(get):
    return T.final_media(get(VALID), get(FINALS))


DIAG = "SELECT user_id AS run_id, CASE WHEN event_id % 9 = 1 THEN 'identical_tool_call' WHEN event_id % 9 = 2 THEN 'no_information_gain' ELSE 'other' END AS kind FROM {events}"


@query(
    "e7_earlier_protocol",
    f"""WITH {BASE.replace("list(DISTINCT tool_name) FILTER (status = 'success') AS used", "list(DISTINCT tool_name) AS used")}, {ERR},
    ps AS (SELECT run_id, count(*) AS n, count(*) FILTER (valid) AS v, count(*) FILTER (repairs > 0) AS rp FROM steps GROUP BY 1), dg AS (SELECT run_id, count(*) FILTER (kind <> 'other') AS n FROM ({DIAG}) GROUP BY 1),
    l7 AS (SELECT fe.run_id, count(*) AS n, sum(latency_ms) AS ms FROM fe LEFT JOIN fs ON fs.run_id = fe.run_id JOIN steps x ON x.run_id = fe.run_id AND x.step > coalesce(first_step, -1) WHERE EXISTS (SELECT 1 FROM steps y WHERE y.run_id = fe.run_id AND y.valid) GROUP BY 1)
    SELECT ev.run_id, success AS task_success, ts AS tools_satisfied, ev.cause AS primary_failure, round(ps.v / ps.n, 9) AS structured_validity, round(rp / ps.n, 9) AS repair_rate, round(dg.n / greatest(ps.v, 1), 9) AS repeated_rate, lt.n AS extra_calls, CASE WHEN lt.n IS NOT NULL THEN coalesce(l7.n, 0) END AS extra_steps, (lt.ms + coalesce(l7.ms, 0))::BIGINT AS extra_latency
    FROM ev JOIN ps ON ps.run_id = ev.run_id LEFT JOIN dg ON dg.run_id = ev.run_id LEFT JOIN lt ON lt.run_id = ev.run_id LEFT JOIN l7 ON l7.run_id = ev.run_id""",
)
def e7(get):
    ev = T.evaluate(*parts(get), all_calls=True).select("run_id", "task_success", "tools_satisfied", "primary_failure")
    rates = T.protocol_rates(get(STEPS), get(DIAG), *errors(get))
    return ev.join(rates, "run_id").withColumns({c: F.round(c, 9) for c in ("structured_validity", "repair_rate", "repeated_rate")})


EDIT_TOOLS = TOOLS.replace("event_id % 8 AS output_artifact_id", "CASE WHEN event_id % 2 = 0 THEN 'f' ELSE 'g' END AS output_artifact_id, CASE WHEN event_id % 3 = 0 THEN 's' ELSE 'x' END AS parent")
EDIT_CASES = f"SELECT DISTINCT user_id % 40 AS task_id, CASE WHEN user_id % 40 % 4 = 0 THEN 'impossible' ELSE 'edit' END AS category, user_id % 40 * 100 AS want_ms, user_id % 40 % 9 * 1000 + 100 AS start_ms, user_id % 40 % 9 * 1000 + 1100 AS end_ms, user_id % 40 % 2 = 0 AS requires_retrieval FROM {_U}"


@query(
    "e16_edit_scores",
    f"""WITH r AS (SELECT r.*, category, want_ms, c.start_ms AS xs, c.end_ms AS xe, requires_retrieval FROM ({RUNS}) r JOIN ({EDIT_CASES}) c USING (task_id)), t AS (SELECT * FROM ({EDIT_TOOLS}) WHERE status = 'success'),
    x AS (SELECT r.*, (SELECT max(pos) FROM t WHERE t.run_id = r.run_id AND tool_name = 'trim_video' AND output_artifact_id = final_artifact_id AND parent = source_artifact_id AND abs(t.start_ms - xs) <= 125 AND abs(t.end_ms - xe) <= 125) AS trimmed, (SELECT min(pos) FROM t WHERE t.run_id = r.run_id AND tool_name = 'search_video') AS searched FROM r),
    y AS (SELECT *, final_artifact_id IS NOT NULL AND abs(duration_ms - want_ms) <= 250 AS media_ok, trimmed IS NOT NULL AS lineage_ok, coalesce(searched < trimmed, false) AS retrieval_used FROM x)
    SELECT run_id, category, media_ok, lineage_ok, retrieval_used, category <> 'impossible' AND terminal_reason = 'SUCCESS' AND media_ok AND lineage_ok AND (retrieval_used OR NOT requires_retrieval) AS edit_success, category = 'impossible' AND terminal_reason = 'CANNOT_COMPLETE' AND final_artifact_id IS NULL AS correct_refusal FROM y""",
)
def e16(get):
    return T.score_edits(get(RUNS), get(EDIT_TOOLS), get(EDIT_CASES))


FINISHED = f"SELECT user_id AS run_id, CASE WHEN user_id % 7 <> 0 THEN user_id * 10 + 3 END AS final_artifact_id FROM {_U}"
CHECKED = "SELECT user_id AS run_id, event_id % 5 + user_id * 10 AS artifact_id, event_id AS pos, event_id % 900 AS duration_ms, 640 AS width, event_id % 2 * 360 AS height FROM {events}"
WISHES = f"SELECT user_id AS run_id, t.type AS type, 100 AS lo, 700 AS hi, 16 AS width, 9 AS height, CASE WHEN t.type = 'tool' THEN 'add_subtitles' END AS tool FROM {_U} CROSS JOIN (SELECT 'duration' AS type UNION ALL SELECT 'aspect' AS type UNION ALL SELECT 'tool' AS type UNION ALL SELECT 'semantic' AS type) AS t WHERE NOT (t.type = 'semantic' AND user_id % 2 = 0) AND NOT (t.type IN ('tool', 'aspect') AND user_id % 3 = 0)"
PARENTS = f"SELECT user_id * 10 + 3 AS child, user_id * 10 + 2 AS parent FROM {_U} UNION ALL SELECT user_id * 10 + 2 AS child, user_id * 10 + 1 AS parent FROM {_U} WHERE user_id % 4 <> 0"
MAKERS = f"SELECT user_id * 10 + 1 AS node, 'add_subtitles' AS tool FROM {_U}"
CITES = f"SELECT user_id AS run_id, user_id % 9 AS evidence_id FROM {_U}"
KNOWN = f"SELECT user_id AS run_id, user_id % 8 AS evidence_id FROM {_U}"


@query(
    "e18_completion_check",
    f"""WITH r AS ({FINISHED}), m AS (SELECT c.run_id, arg_max(duration_ms, pos) AS d, arg_max(width, pos) AS w, arg_max(height, pos) AS h FROM ({CHECKED}) c JOIN r ON r.run_id = c.run_id AND r.final_artifact_id = c.artifact_id GROUP BY 1),
    k AS (SELECT run_id, final_artifact_id IS NOT NULL AS passed, true AS conclusive FROM r UNION ALL SELECT r.run_id, m.run_id IS NOT NULL, true FROM r LEFT JOIN m USING (run_id)
      UNION ALL SELECT w.run_id, coalesce(CASE w.type WHEN 'duration' THEN d BETWEEN lo AND hi WHEN 'aspect' THEN m.w * w.height = m.h * w.width WHEN 'tool' THEN r.final_artifact_id IS NOT NULL AND w.run_id % 4 <> 0 ELSE true END, false), w.type <> 'semantic' FROM ({WISHES}) w JOIN r USING (run_id) LEFT JOIN m USING (run_id)
      UNION ALL SELECT c.run_id, EXISTS (SELECT 1 FROM ({KNOWN}) n WHERE n.run_id = c.run_id AND n.evidence_id = c.evidence_id), true FROM ({CITES}) c)
    SELECT run_id, CASE WHEN bool_or(conclusive AND NOT passed) THEN 'failed' WHEN bool_or(NOT conclusive) THEN 'inconclusive' ELSE 'passed' END AS status, count(*) FILTER (conclusive AND NOT passed) AS n_failed FROM k GROUP BY 1""",
)
def e18(get):
    runs = get(FINISHED)
    closure = ancestors(get(PARENTS), runs.filter("final_artifact_id IS NOT NULL").select(F.col("final_artifact_id").alias("start")))
    tools = closure.join(get(MAKERS), "node").join(runs, F.col("start") == F.col("final_artifact_id")).select("run_id", "tool")
    bad = unknown_citations(get(CITES), [get(KNOWN)])
    return T.completion_status(T.completion_checks(runs, get(CHECKED), get(WISHES), tools, bad))


_E6 = f"""{" UNION ALL ".join(f"SELECT '{k}' AS metric, round(avg({v}), 8) AS value FROM ev" for k, v in _COLS.items())}
  UNION ALL SELECT 'impossible_refusal', round(avg(cr::INT), 8) FROM ev WHERE family = 'impossible' UNION ALL SELECT 'recovery_success', round(avg(success::INT), 8) FROM ev WHERE n_failed > 0 UNION ALL SELECT 'recovery_opportunities', count(*) FROM ev WHERE n_failed > 0
  UNION ALL SELECT 'family:' || family, round(avg(success::INT), 8) FROM ev GROUP BY family UNION ALL SELECT 'failure:' || cause, count(*) FROM ev WHERE cause IS NOT NULL GROUP BY cause"""


_DIGEST = "sum(('0x' || left(sha256(concat_ws('|', run_id, terminal_reason, coalesce(final_artifact_id, '-'), duration_ms)), 8))::BIGINT)::BIGINT"


@query("e19_recomputed_summary", f"WITH {BASE}, s AS ({_E6}) SELECT metric, 'value' AS \"column\", (SELECT {_DIGEST} FROM runs) AS input_digest FROM s WHERE metric LIKE 'family:%'")
def e19(get):
    """A summary was stored by an earlier evaluator, here one whose family rates are off by one; what the recomputation changes, with a digest of
    the runs that it read."""
    stored = T.summarize(evaluated(get))
    off = F.when(F.col("metric").startswith("family:"), F.col("value") + 1).otherwise(F.col("value"))
    stored = materialize(stored.withColumn("value", F.round(off, 8)), "stored-summary")
    now = T.summarize(evaluated(get)).withColumn("value", F.round("value", 8))
    return T.recomputed(now, stored, get(RUNS), ["run_id", "terminal_reason", "final_artifact_id", "duration_ms"])


_X = f"[{', '.join(repr(m) for m in T.MUTATIONS)}][run_id % {len(T.MUTATIONS)} + 1]"
_GONE = "x IN ('false_refusal', 'loop', 'invalid_arguments', 'recovery_failure')"
_MUT_RUNS = f"""SELECT * REPLACE (CASE WHEN x IN ('false_refusal', 'invalid_arguments') THEN 'CANNOT_COMPLETE' WHEN x = 'loop' THEN 'LOOP_DETECTED' WHEN x = 'recovery_failure' THEN 'BUDGET_EXHAUSTED' WHEN x = 'premature_finish' THEN 'SUCCESS' ELSE terminal_reason END AS terminal_reason,
  CASE WHEN {_GONE} THEN NULL WHEN x = 'premature_finish' THEN 'calibration-final' ELSE final_artifact_id END AS final_artifact_id, CASE WHEN x = 'wrong_duration' THEN 99000 WHEN {_GONE} THEN NULL WHEN x = 'premature_finish' THEN 3000 ELSE duration_ms END AS duration_ms,
  CASE WHEN x = 'wrong_aspect_ratio' THEN 640 WHEN {_GONE} THEN NULL WHEN x = 'premature_finish' THEN 384 ELSE width END AS width, CASE WHEN x = 'wrong_aspect_ratio' THEN 360 WHEN {_GONE} THEN NULL WHEN x = 'premature_finish' THEN 256 ELSE height END AS height) FROM (SELECT *, {_X} AS x FROM ({RUNS}))"""
_OF = f"(SELECT r.run_id, {_X} AS x, starts, list_filter([0, 3000, 6000, 9000, 12000], lambda v: NOT list_contains(starts, v))[1] AS free FROM ({RUNS}) r LEFT JOIN (SELECT task_id, list(DISTINCT start_ms) AS starts FROM ({SCENES}) GROUP BY 1) USING (task_id))"
_MOVED = "x IN ('wrong_scene', 'partial_constraints') AND starts IS NOT NULL"
_MUT_TOOLS = f"""SELECT t.* REPLACE (CASE WHEN {_MOVED} AND tool_name = 'trim_video' THEN free WHEN x = 'wrong_subtitle' AND tool_name = 'add_subtitles' THEN 0 ELSE start_ms END AS start_ms, CASE WHEN {_MOVED} AND tool_name = 'trim_video' THEN free + 3000 WHEN x = 'wrong_subtitle' AND tool_name = 'add_subtitles' THEN 1000 ELSE end_ms END AS end_ms,
  CASE WHEN x = 'wrong_subtitle' AND tool_name = 'add_subtitles' THEN 'WRONG' ELSE text END AS text, CASE WHEN x = 'wrong_order' AND tool_name = 'concat_videos' THEN in1 ELSE in0 END AS in0, CASE WHEN x = 'wrong_order' AND tool_name = 'concat_videos' THEN in0 ELSE in1 END AS in1,
  CASE WHEN x = 'invalid_arguments' AND pos = first_pos THEN 'invalid' ELSE status END AS status) FROM ({TOOLS2}) t JOIN {_OF} o ON o.run_id = t.run_id JOIN (SELECT run_id, min(pos) AS first_pos FROM ({TOOLS2}) GROUP BY 1) f ON f.run_id = t.run_id
  UNION ALL SELECT t.* REPLACE (pos - 1 AS pos, 'trim_video' AS tool_name, 'error' AS status) FROM ({TOOLS2}) t JOIN {_OF} o ON o.run_id = t.run_id WHERE x IN ('recovery_success', 'recovery_failure') AND pos = (SELECT min(pos) FROM ({TOOLS2}) u WHERE u.run_id = t.run_id)"""
_MUT_CANDS = f"SELECT c.* FROM ({CANDS}) c JOIN {_OF} o ON o.run_id = c.run_id WHERE NOT ({_MOVED})"
_PASSING = ", ".join(repr(m) for m in T.PASSING)


@query(
    "e20_calibration",
    f"WITH {BASE.replace(f'runs AS ({RUNS})', f'runs AS ({_MUT_RUNS})').replace(f'tools AS ({TOOLS2})', f'tools AS ({_MUT_TOOLS})').replace(f'cands AS ({CANDS})', f'cands AS ({_MUT_CANDS})')} SELECT x AS mutation, count(*) AS n, count(*) FILTER (success) AS n_passed, round(avg((success = (x IN ({_PASSING})))::INT), 9) AS agreement FROM ev GROUP BY 1",
)
def e20(get):
    runs, tools, cands, gold, scenes, cons = parts(get)
    mutated, tools, cands = T.mutate(runs, tools, cands, scenes, "run_id")
    ev = T.evaluate(mutated, tools, cands, gold, scenes, cons).withColumn("expected_pass", F.col("mutation").isin(*T.PASSING))
    return T.calibration(ev).withColumn("agreement", F.round("agreement", 9))


VGOLD = f"""SELECT user_id AS case_id, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'moves_right' ELSE 'view' END AS action, 'SALE view' AS visible_text,
  CASE WHEN user_id % 4 <> 0 THEN user_id * 10 END AS event_start, CASE WHEN user_id % 4 <> 0 THEN user_id * 10 + 400 END AS event_end FROM {_U}"""
VENT = "SELECT user_id AS case_id, concat('a ', event_type) AS text FROM {events} WHERE event_id % 7 <> 0"
VACT = """SELECT user_id AS case_id, CASE WHEN event_id % 9 = 0 THEN 'Ball moves to the right' WHEN event_id % 9 = 1 THEN 'sphere goes right' ELSE concat('does ', event_type) END AS text
  FROM {events} WHERE user_id % 10 <> 0"""
VTXT = """SELECT user_id AS case_id, concat('sale ', event_type) AS text, event_id % 3 AS segment_id, CASE WHEN event_id % 2 = 0 THEN event_id % 100 END AS observed_ms,
  CASE WHEN event_id % 2 = 1 THEN event_id % 100 END AS start_ms, CASE WHEN event_id % 2 = 1 THEN event_id % 100 + 20 END AS end_ms,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 4 END AS r_segment, CASE WHEN event_id % 11 < 4 THEN event_id % 90 END AS r_observed,
  CASE WHEN event_id % 11 > 5 THEN event_id % 110 END AS r_start, CASE WHEN event_id % 11 > 5 THEN event_id % 110 + 40 END AS r_end FROM {events}"""
VEVT = "SELECT user_id AS case_id, event_id AS start_ms, event_id + 300 AS end_ms FROM {events} WHERE user_id % 8 <> 0"
VREF = "SELECT user_id AS case_id, event_id % 40 AS artifact_id FROM {events} WHERE user_id % 9 <> 0"
VCAT = "SELECT DISTINCT user_id AS case_id, event_id % 40 AS artifact_id FROM {events} WHERE user_id % 6 <> 0 OR event_id % 40 > 3"
VISUAL = f"""v AS (SELECT g.*, coalesce((SELECT bool_or(text = 'a view') FROM ({VENT}) e WHERE e.case_id = g.case_id), false) AS entity_correct, (SELECT count(*) FILTER (text NOT IN ('a view', 'a click')) FROM ({VENT}) e WHERE e.case_id = g.case_id) AS n_hallucinated, (SELECT count(*) FROM ({VENT}) e WHERE e.case_id = g.case_id) AS n_entities,
  CASE WHEN action IS NULL THEN NOT EXISTS (SELECT 1 FROM ({VACT}) a WHERE a.case_id = g.case_id)
    ELSE coalesce((SELECT bool_or(CASE WHEN action = 'moves_right' THEN contains(text, 'move') AND contains(text, 'right') ELSE contains(replace(text, ' ', ''), action) END) FROM ({VACT}) a WHERE a.case_id = g.case_id), false) END AS action_correct,
  false AS text_exact, coalesce((SELECT bool_or(text = 'sale view') FROM ({VTXT}) t WHERE t.case_id = g.case_id), false) AS text_normalized,
  coalesce((SELECT min(levenshtein('saleview', replace(text, ' ', '')) / 8) FROM ({VTXT}) t WHERE t.case_id = g.case_id), 1) AS text_cer,
  EXISTS (SELECT 1 FROM ({VTXT}) t WHERE t.case_id = g.case_id AND text = 'sale view' AND (r_segment IS NULL OR r_segment = segment_id)
    AND (r_observed = observed_ms OR (r_observed >= start_ms AND r_observed < end_ms) OR (r_start <= start_ms AND r_end >= end_ms))) AS text_evidence_correct,
  NOT EXISTS (SELECT 1 FROM ({VREF}) r WHERE r.case_id = g.case_id AND (r.case_id, r.artifact_id) NOT IN (SELECT (case_id, artifact_id) FROM ({VCAT}))) AS evidence_integrity,
  CASE WHEN event_start IS NULL THEN NOT EXISTS (SELECT 1 FROM ({VEVT}) e WHERE e.case_id = g.case_id) ELSE coalesce((SELECT max(greatest(0, least(end_ms, event_end) - greatest(start_ms, event_start)) / (greatest(end_ms, event_end) - least(start_ms, event_start))) >= 0.5 FROM ({VEVT}) e WHERE e.case_id = g.case_id), false) END AS event_correct FROM ({VGOLD}) g)"""


def visual(get):
    gold = get(VGOLD).withColumn("entities", F.array(F.lit("view"), F.lit("a click")))
    ref = F.struct(*[F.col(c).alias(a) for c, a in (("r_segment", "segment_id"), ("r_observed", "observed_ms"), ("r_start", "start_ms"), ("r_end", "end_ms"))])
    return C.visual_metrics(gold, get(VENT), get(VACT), get(VTXT).withColumn("refs", F.array(ref)), get(VEVT), get(VREF), get(VCAT))


@query(
    "a11_visual_claims",
    f"WITH {VISUAL} SELECT case_id, entity_correct, n_hallucinated, n_entities, action_correct, text_exact, text_normalized, round(text_cer, 9) AS text_cer, text_evidence_correct, event_correct, evidence_integrity FROM v",
)
def a11(get):
    return visual(get).withColumn("text_cer", F.round("text_cer", 9))


_VR = ", ".join(f"round(avg({c}::INT), 8) AS {c}" for c in ("entity_correct", "action_correct", "text_exact", "text_normalized", "event_correct"))


@query("a12_visual_summary", f"WITH {VISUAL} SELECT {_VR}, round(avg(text_cer), 8) AS text_cer, round(sum(n_hallucinated) / sum(n_entities), 8) AS hallucination_rate, count(*) AS n, (SELECT count(*) FROM events) AS n_attempted, round(count(*) / (SELECT count(*) FROM events), 8) AS validity FROM v")
def a12(get):
    s = C.visual_summary(visual(get), get("SELECT event_id FROM {events}"))
    return s.withColumns({c: F.round(c, 8) for c, t in s.dtypes if t == "double"})


CALLS = "SELECT user_id AS clip_id, CASE WHEN event_id % 4 = 0 THEN 'transcribe' ELSE concat('visual_', event_type) END AS operation, event_id % 700 AS latency_ms, event_id % 9 AS frames, CASE WHEN event_id % 5 <> 0 THEN event_id % 3000 END AS input_tokens, CASE WHEN event_id % 6 <> 0 THEN event_id % 90000 END AS peak_allocated, event_id % 95000 AS peak_reserved FROM {events}"


@query("a12_clip_costs", f"SELECT clip_id, sum(latency_ms)::BIGINT AS latency_ms, sum(frames)::BIGINT AS frames, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(max(peak_allocated), 0) AS peak_allocated, max(peak_reserved) AS peak_reserved FROM ({CALLS}) WHERE starts_with(operation, 'visual') GROUP BY 1")
def a12_costs(get):
    return C.clip_costs(get(CALLS), "visual")


@query("a12_claim_counts", "SELECT user_id AS clip_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def a12_counts(get):
    return C.claim_counts(get("SELECT user_id AS clip_id, event_type AS kind FROM {events}"))


MGOLD = f"""SELECT user_id AS case_id, CASE user_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'away' END AS direction, CASE WHEN user_id % 2 = 0 THEN 'ball' END AS first_actor,
  CASE WHEN user_id % 2 = 0 THEN 'box' END AS second_actor, CASE WHEN user_id % 4 = 1 THEN 'shadow|wall' END AS supported FROM {_U}"""
MENT = f"SELECT user_id AS case_id, 'ball|sphere' AS labels FROM {_U} UNION ALL SELECT user_id AS case_id, 'box|crate' AS labels FROM {_U} WHERE user_id % 3 <> 0"
MEXP = f"""SELECT user_id AS case_id, 0 AS n, 'ball|sphere' AS actors, 'move_left' AS action, user_id * 20 AS start_ms, user_id * 20 + 500 AS end_ms FROM {_U} WHERE user_id % 5 <> 0
  UNION ALL SELECT user_id AS case_id, 1 AS n, 'box|crate' AS actors, 'disappear' AS action, user_id * 10 AS start_ms, user_id * 10 + 300 AS end_ms FROM {_U} WHERE user_id % 5 = 2"""
MCLAIM = """SELECT user_id AS case_id, event_id AS claim_id, CASE WHEN user_id % 15 = 5 AND event_id % 3 = 0 THEN 'the wall vanishes' WHEN user_id % 15 = 5 THEN 'Ball at rest' WHEN event_id % 7 = 0 THEN 'the ball is moving left' WHEN event_id % 7 = 1 THEN 'the CRATE will vanish' WHEN event_id % 7 = 2 THEN 'Ball_halts'
  WHEN event_id % 7 = 3 THEN 'a sphere  moves to the left' WHEN event_id % 7 = 4 THEN 'nothing of note' WHEN event_id % 7 = 5 THEN 'box farther off' ELSE 'a shadow leftward' END AS text,
  CASE WHEN event_id % 4 <> 0 THEN event_id END AS start_ms, CASE WHEN event_id % 4 <> 0 THEN event_id + 450 END AS end_ms FROM {events} WHERE user_id % 50 <> 7"""
MPRED = "SELECT user_id AS case_id, CASE event_id % 5 WHEN 0 THEN 'red Ball' WHEN 1 THEN 'crate' WHEN 2 THEN 'long shadow' WHEN 3 THEN 'sph' ELSE 'dog' END AS label FROM {events} WHERE event_id % 3 = user_id % 3"
_PATTERNS = ", ".join(f"('{code}', {list(p)})" for code, patterns in C.ACTION_PATTERNS.items() for p in patterns)
_NAMES = "list_bool_or(list_transform(string_split({1}, '|'), lambda a: contains({0}, a) OR contains(a, {0})))"
MOTION = f"""pat AS (SELECT * FROM (VALUES {_PATTERNS}) p(code, terms)), mt AS (SELECT *, trim(regexp_replace(lower(replace(text, '_', ' ')), '\\s+', ' ', 'g')) AS t FROM ({MCLAIM})),
md AS (SELECT t, list(DISTINCT code) AS codes FROM (SELECT DISTINCT t FROM mt) JOIN pat ON list_bool_and(list_transform(terms, lambda w: contains(t, w))) GROUP BY 1),
mc AS (SELECT mt.*, coalesce(codes, []) AS codes FROM mt LEFT JOIN md USING (t)),
me AS (SELECT x.case_id, x.n, c.claim_id, x.start_ms AS xs, x.end_ms AS xe, c.start_ms AS cs, c.end_ms AS ce FROM ({MEXP}) x JOIN mc c ON c.case_id = x.case_id AND list_contains(c.codes, x.action) AND {_NAMES.format("c.t", "x.actors")}),
mf AS (SELECT case_id, n, min((abs(xs - cs) + abs(xe - ce)) / 2) AS err, max(greatest(0, least(xe, ce) - greatest(xs, cs)) / (greatest(xe, ce) - least(xs, cs))) FILTER (cs IS NOT NULL) AS best FROM me GROUP BY ALL),
mp AS (SELECT x.case_id, bool_and(f.n IS NOT NULL) AS hit, bool_and(coalesce(best >= 0.3, false)) AS timely, avg(err) AS err FROM ({MEXP}) x LEFT JOIN mf f ON f.case_id = x.case_id AND f.n = x.n GROUP BY 1),
mb AS (SELECT case_id, count(DISTINCT claim_id) AS n_backed FROM me GROUP BY 1),
ma AS (SELECT DISTINCT c.case_id FROM mc c JOIN ({MENT}) e ON e.case_id = c.case_id AND len(codes) > 0 AND {_NAMES.format("c.t", "e.labels")}),
mn AS (SELECT case_id, count(*) AS n, count(start_ms) AS nt, min(start_ms) FILTER (contains(t, 'ball')) AS s1, min(start_ms) FILTER (contains(t, 'box')) AS s2, bool_or(list_contains(codes, 'move_left')) AS to_left, bool_or(list_contains(codes, 'move_away')) AS off FROM mc GROUP BY 1),
mr AS (SELECT case_id, lower(label) AS t FROM ({MPRED})),
mh AS (SELECT r.case_id, count(*) AS n, count(*) FILTER (NOT coalesce({_NAMES.format("r.t", "e.labels")}, false) AND NOT coalesce({_NAMES.format("r.t", "g.supported")}, false)) AS bad
   FROM mr r JOIN (SELECT case_id, string_agg(labels, '|') AS labels FROM ({MENT}) GROUP BY 1) e ON e.case_id = r.case_id JOIN ({MGOLD}) g ON g.case_id = r.case_id GROUP BY 1),
ms AS (SELECT case_id, avg(found::INT) AS score FROM (SELECT e.case_id, e.labels, coalesce(bool_or({_NAMES.format("r.t", "e.labels")}), false) AS found FROM ({MENT}) e LEFT JOIN mr r ON r.case_id = e.case_id GROUP BY 1, 2) GROUP BY 1),
mo AS (SELECT g.case_id, coalesce(score, 0) AS entity_correctness, coalesce(hit, ma.case_id IS NULL) AS action_correct, coalesce(timely, coalesce(nt, 0) = 0) AS temporal_correct, err AS localisation_error, coalesce(bad, 0) AS n_hallucinated,
   (coalesce(bad, 0) + coalesce(mn.n, 0) - coalesce(n_backed, 0)) / greatest(1, coalesce(mh.n, 0) + coalesce(mn.n, 0)) AS unsupported_rate,
   CASE direction WHEN 'left' THEN coalesce(to_left, false) WHEN 'away' THEN coalesce(off, false) END AS direction_correct, CASE WHEN first_actor IS NOT NULL THEN coalesce(s1 < s2, false) END AS order_correct
   FROM ({MGOLD}) g LEFT JOIN mp USING (case_id) LEFT JOIN mb USING (case_id) LEFT JOIN mn USING (case_id) LEFT JOIN mh USING (case_id) LEFT JOIN ms USING (case_id) LEFT JOIN ma ON ma.case_id = g.case_id)"""


def motion(get):
    terms = lambda sql, c: get(sql).withColumn(c, F.split(c, "[|]"))
    return C.motion_metrics(terms(MGOLD, "supported"), terms(MENT, "labels"), terms(MEXP, "actors"), get(MCLAIM), get(MPRED))


@query(
    "a13_motion_claims",
    f"WITH {MOTION} SELECT case_id, round(entity_correctness, 9) AS entity_correctness, action_correct, temporal_correct, round(localisation_error, 9) AS localisation_error, n_hallucinated, round(unsupported_rate, 9) AS unsupported_rate, direction_correct, order_correct FROM mo",
)
def a13(get):
    return motion(get).withColumns({c: F.round(c, 9) for c in ("entity_correctness", "localisation_error", "unsupported_rate")})


_FLAGS = ["action_correct", "temporal_correct", "direction_correct", "order_correct"]


@query("a14_failure_matrix", f"WITH {MOTION} {' UNION ALL '.join(f"SELECT case_id % 2 AS task_type, case_id % 3 AS variant, '{f}' AS failure, count(*) FILTER (NOT {f}) AS n_failed, count(*) AS n FROM mo WHERE {f} IS NOT NULL GROUP BY ALL" for f in _FLAGS)}")
def a14(get):
    return C.failure_matrix(motion(get).withColumns({"task_type": F.col("case_id") % 2, "variant": F.col("case_id") % 3}), _FLAGS)
