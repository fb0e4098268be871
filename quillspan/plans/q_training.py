"""Queries of post-training data: user and assistant turns of conversations as prompts and targets, events as rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import contracts as C
from quillspan.operators import training_data as T
from quillspan.plans.registry import query
from quillspan.plans.scratch import dealt, materialize

R9 = lambda c: F.round(c, 9).alias(c)
STEPS = """SELECT trajectory_id, pos, operation, decision, prompt, target FROM (SELECT conv_id AS trajectory_id, turn AS pos, CASE WHEN turn % 5 = 4 THEN 'plan' WHEN turn % 2 = 0 THEN 'decide' ELSE 'recover' END AS operation, CASE WHEN conv_id % 4 = 1 THEN 'tool' WHEN conv_id % 4 = 2 THEN 'finish' WHEN conv_id % 4 = 3 THEN 'cannot_complete' ELSE 'replan' END AS decision, role, text AS prompt,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations}) AS s WHERE role = 'user' AND next_role = 'assistant'"""
RUNS = "SELECT DISTINCT conv_id AS trajectory_id, CASE WHEN conv_id % 4 = 0 THEN 'BUDGET' ELSE 'SUCCESS' END AS terminal, 'SUCCESS' AS expected FROM {conversations}"
RECORDS = f"SELECT s.* FROM ({STEPS}) AS s JOIN ({RUNS}) AS r ON s.trajectory_id = r.trajectory_id WHERE r.terminal = r.expected AND s.operation <> 'plan' AND s.target IS NOT NULL"
RID = "sha256(concat_ws('|', trajectory_id, pos, prompt, target))"


def records(get):
    steps = get(STEPS).withColumn("verification_ids", F.transform(F.sequence(F.lit(0), F.col("pos").cast("int")), lambda i: F.concat(F.lit("v"), F.floor(i / 2))))
    return T.sft_records(steps, get(RUNS))


_SOURCE = "CASE WHEN operation = 'recover' THEN 'observable_recovery' WHEN decision = 'finish' THEN 'valid_finish' WHEN decision = 'cannot_complete' THEN 'correct_cannot_complete' WHEN decision = 'tool' THEN 'executed_oracle' ELSE 'verified_repair' END"


@query("t1_sft_records", f"SELECT {RID} AS record_id, trajectory_id, pos, operation, sha256(target) AS target_sha, {_SOURCE} AS target_source, (SELECT string_agg('v' || CAST(i AS VARCHAR), ',' ORDER BY i) FROM (SELECT DISTINCT j // 2 AS i FROM range(0, 1000) t(j) WHERE j <= pos AND j > pos - 3)) AS evidence FROM ({RECORDS})")
def t1(get):
    return records(get).select("record_id", "trajectory_id", "pos", "operation", F.sha2("target", 256).alias("target_sha"), "target_source", F.array_join("evidence_ids", ",").alias("evidence"))


@query("t1_repeated_ids", f"SELECT id AS record_id, count(*) AS n FROM (SELECT {RID.replace('pos, prompt', "'0', prompt")} AS id FROM ({RECORDS})) GROUP BY 1 HAVING count(*) > 1")
def t1_ids(get):
    """Ids that leave the position out: turns that repeat in a trajectory collide."""
    r = records(get).withColumn("record_id", F.sha2(F.concat_ws("|", "trajectory_id", F.lit("0"), "prompt", "target"), 256))
    return T.repeated_ids(r, "record_id")


TARGETS = """SELECT event_id AS record_id, event_type AS tool, CASE WHEN event_id % 7 = 0 THEN 'observation' ELSE 'decide' END AS operation, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE props END AS target, CASE WHEN event_id % 13 = 0 THEN 'x' WHEN event_id % 11 = 0 THEN ' ' ELSE props END AS content,
  CASE WHEN event_id % 17 = 0 THEN 'open FILE:///tmp' ELSE 'go on' END AS prompt, CASE WHEN event_id % 19 = 0 THEN 'system' ELSE 'user' END AS first_role, CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'assistant' END AS second_role FROM {events}"""


@query(
    "t2_target_validity",
    f"""WITH t AS ({TARGETS}) SELECT record_id, 'unknown_tool' AS rule FROM t WHERE tool NOT IN ('view', 'click') UNION ALL SELECT record_id, 'observation_target' FROM t WHERE operation = 'observation' UNION ALL SELECT record_id, 'empty_target' FROM t WHERE trim(target) = ''
    UNION ALL SELECT record_id, 'message_roles' FROM t WHERE first_role <> 'user' OR second_role IS NULL UNION ALL SELECT record_id, 'not_canonical' FROM t WHERE content <> target UNION ALL SELECT record_id, 'private_prompt' FROM t WHERE contains(lower(prompt), 'file://')""",
)
def t2(get):
    t = get(TARGETS).withColumn("roles", F.array("first_role", "second_role"))
    return T.target_errors(t, get("SELECT DISTINCT event_type AS tool FROM {events} WHERE event_type IN ('view', 'click')"))


_AUDIT = "count(*) AS n, count(DISTINCT prompt || chr(31) || target) AS n_distinct, min(length(target)) AS len_min, median(length(target)) AS len_median, round(quantile_cont(length(target), 0.95), 9) AS len_p95, max(length(target)) AS len_max"


@query("t3_sft_audit", f"WITH r AS ({RECORDS}) SELECT 'all' AS level, 'all' AS value, {_AUDIT} FROM r UNION ALL SELECT 'operation', operation, {_AUDIT} FROM r GROUP BY operation")
def t3(get):
    return T.sft_audit(records(get), ["operation"]).withColumn("len_p95", F.round("len_p95", 9))


@query("t3_sft_leaks", f"SELECT {RID} AS record_id, m AS marker FROM ({RECORDS}), (SELECT unnest(['tion', 'about', 'ß']) AS m) WHERE contains(lower(prompt || chr(31) || target), m)")
def t3_leaks(get):
    return T.sft_leaks(records(get), ("tion", "about", "ß"))


def _braced(sql: str) -> str:
    """« and » are the braces of JSON texts, doubled as table names stand in single ones."""
    return sql.replace("«", "{{").replace("»", "}}")


def _tool(name: str, arguments: str, more: str = "") -> str:
    """SQL of the canonical text of a tool decision; ``more`` is a first field."""
    return f"""concat('«{more}"decision_type":"tool","expected_observation":"e","rationale":"r","schema_version":"1.0","success_condition":"s","tool_call":«"arguments":', {arguments}, ',"schema_version":"1.0","tool_call_id":"c1","tool_name":"{name}"»»')"""


def _times(start: str, length: str) -> str:
    return f"""'«"end_ms":', CAST({start} + {length} AS STRING), ',"schema_version":"1.0","start_ms":', CAST({start} AS STRING), '»'"""


_ID = "CAST(event_id AS STRING)"
_STYLE = '«"alignment":"bottom","font_size":24,"outline_color":"black","schema_version":"1.0","text_color":"white"»'
_CUE = lambda i, times: f"""'«"cue_id":"c{i}","schema_version":"1.0","text":"line {i}","time_range":', {times}, '»'"""
# arguments made of the columns of events
ARGUMENTS = {
    "search_video": """concat('«"approximate_time_range":null,"query":"find ', event_type, '","required_evidence_types":["ocr"],"schema_version":"1.0","top_k":', CAST(event_id % 20 + 1 AS STRING), ',"video_id":null»')""",
    "trim_video": f"""concat('«"input_artifact_id":"a', {_ID}, '","schema_version":"1.0","time_range":', {_times("event_id % 997", "1 + event_id % 40")}, '»')""",
    "concat_videos": f"""concat('«"input_artifact_ids":["a', {_ID}, '","b', {_ID}, '"],"schema_version":"1.0"»')""",
    "change_speed": f"""concat('«"input_artifact_id":"a', {_ID}, '","schema_version":"1.0","speed_factor":', CAST(event_id % 4 AS STRING), '.5»')""",
    "add_subtitles": f"""concat('«"cues":[', {_CUE(1, _times("event_id % 50", "10"))}, ',', {_CUE(2, _times("event_id % 50 + 10", "5"))}, '],"input_artifact_id":"a', {_ID}, '","schema_version":"1.0","style":{_STYLE}»')""",
    "reframe_video": f"""concat('«"fit":"crop","height":', CAST(64 + 2 * (event_id % 90) AS STRING), ',"input_artifact_id":"a', {_ID}, '","schema_version":"1.0","width":640»')""",
    "validate_media": f"""concat('«"decode_entire_video":true,"input_artifact_id":"a', {_ID}, '","require_audio":', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, ',"schema_version":"1.0"»')""",
}
_FINISH = f"""concat('«"completion_summary":"done","decision_type":"finish","evidence_ids":["e1"],"output_artifact_id":"o', {_ID}, '","schema_version":"1.0"»')"""
_GIVE_UP = """'«"attempted_action_ids":[],"decision_type":"cannot_complete","missing_evidence_or_capability":["sound"],"reason":"no sound","schema_version":"1.0"»'"""
_RETRY = f"""concat('«"node_id":"n', {_ID}, '","preferred_capability":null,"reason":"again","recovery_type":"retry_current_node","schema_version":"1.0"»')"""
_NO_RECOVERY = """'«"missing_evidence_or_capability":["none demonstrated"],"reason":"Refuse recovery although the observed failure is retryable.","recovery_type":"cannot_recover","schema_version":"1.0"»'"""
_TARGETS = " ".join(f"WHEN event_id % 10 = {k} THEN {_tool(name, a)}" for k, (name, a) in enumerate(ARGUMENTS.items()))
PAIRED = _braced(
    f"""SELECT event_id AS record_id, CASE WHEN event_id % 10 = 8 THEN 'recover' ELSE 'decide' END AS operation, concat('p', CAST(user_id AS STRING)) AS prompt,
  CASE {_TARGETS} WHEN event_id % 10 = 7 THEN {_FINISH} WHEN event_id % 20 = 8 THEN {_RETRY} WHEN event_id % 10 = 8 THEN {_NO_RECOVERY} ELSE {_GIVE_UP} END AS target FROM {{events}}"""
)
# the rejections, built from what a JSON reader finds in the chosen text
_A = "chosen->>'$.tool_call.arguments."
_INPUT = f"{_A}input_artifact_id'"
_AGAIN = lambda times: f"""'«"end_ms":' || ({times}end_ms')::VARCHAR || ',"schema_version":"1.0","start_ms":' || ({times}start_ms')::VARCHAR || '»'"""
_WRONG = f"""CASE chosen->>'$.tool_call.tool_name'
  WHEN 'search_video' THEN '«"approximate_time_range":null,"query":"unrelated observable scene with a different entity and action","required_evidence_types":["ocr"],"schema_version":"1.0","top_k":1,"video_id":null»'
  WHEN 'trim_video' THEN '«"input_artifact_id":"' || ({_INPUT}) || '","schema_version":"1.0","time_range":«"end_ms":' || (({_A}time_range.start_ms')::BIGINT + greatest(1, (({_A}time_range.end_ms')::BIGINT - ({_A}time_range.start_ms')::BIGINT) // 2))::VARCHAR
    || ',"schema_version":"1.0","start_ms":' || ({_A}time_range.start_ms') || '»»'
  WHEN 'concat_videos' THEN '«"input_artifact_ids":["' || ({_A}input_artifact_ids[1]') || '","' || ({_A}input_artifact_ids[0]') || '"],"schema_version":"1.0"»'
  WHEN 'change_speed' THEN '«"input_artifact_id":"' || ({_INPUT}) || '","schema_version":"1.0","speed_factor":' || CASE WHEN ({_A}speed_factor')::DOUBLE >= 1 THEN '0.5' ELSE '2.0' END || '»'
  WHEN 'add_subtitles' THEN '«"cues":[«"cue_id":"c1","schema_version":"1.0","text":"incorrect controlled subtitle","time_range":' || {_AGAIN(f"{_A}cues[0].time_range.")} || '»,«"cue_id":"c2","schema_version":"1.0","text":"line 2","time_range":'
    || {_AGAIN(f"{_A}cues[1].time_range.")} || '»],"input_artifact_id":"' || ({_INPUT}) || '","schema_version":"1.0","style":{_STYLE}»'
  WHEN 'reframe_video' THEN '«"fit":"crop","height":' || ({_A}width') || ',"input_artifact_id":"' || ({_INPUT}) || '","schema_version":"1.0","width":' || ({_A}height') || '»'
  ELSE '«"decode_entire_video":true,"input_artifact_id":"' || ({_INPUT}) || '","require_audio":' || CASE {_A}require_audio' WHEN 'true' THEN 'false' ELSE 'true' END || ',"schema_version":"1.0"»' END"""
_WRONG_TOOL = f"""'«"decision_type":"tool","expected_observation":"A real ToolObservation for the wrong behavior.","rationale":"Controlled schema-valid action that violates an observable task constraint.","schema_version":"1.0","success_condition":"The unrelated or altered constraint is applied.","tool_call":«"arguments":'
  || ({_WRONG}) || ',"schema_version":"1.0","tool_call_id":"c1","tool_name":"' || (chosen->>'$.tool_call.tool_name') || '"»»'"""
_REFUSAL = """'«"attempted_action_ids":[],"decision_type":"cannot_complete","missing_evidence_or_capability":["none established by observable state"],"reason":"Stop despite an executable public plan and available typed tools; this is a controlled premature refusal rather than a missing-capability conclusion.","schema_version":"1.0"»'"""
_EARLY = """'«"completion_summary":"Claim completion before the required observable editing and validation criteria have been satisfied.","decision_type":"finish","evidence_ids":["unsupported-premature-evidence"],"output_artifact_id":"unverified-premature-artifact","schema_version":"1.0"»'"""
_REPEATED = """'«"decision_type":"tool","expected_observation":"The same observable validation result repeats.","rationale":"Repeat a completed validation even though runtime completion criteria are already satisfied and no new evidence can be gained.","schema_version":"1.0","success_condition":"No new completion evidence is added.","tool_call":«"arguments":«"decode_entire_video":true,"input_artifact_id":"'
  || (chosen->>'$.output_artifact_id') || '","require_audio":false,"schema_version":"1.0"»,"schema_version":"1.0","tool_call_id":"controlled-repeat-validation","tool_name":"validate_media"»»'"""
_UNRELATED = """'«"node_id":"unrelated-' || coalesce(chosen->>'$.node_id', chosen->>'$.affected_node_id', 'active-node') || '","preferred_capability":null,"reason":"Retry an unrelated node and produce no useful local state change.","recovery_type":"retry_current_node","schema_version":"1.0"»'"""
PREF = _braced(
    f"""
b AS (SELECT record_id, prompt, target AS chosen, operation FROM ({PAIRED})),
o AS (SELECT *, unnest(CASE WHEN operation = 'recover' THEN ['invalid_recovery 0', 'invalid_recovery 1'] WHEN chosen->>'$.decision_type' = 'tool' THEN ['premature_refusal 0', 'premature_finish 1', 'wrong_tool_or_arguments 2']
  WHEN chosen->>'$.decision_type' = 'finish' THEN ['premature_refusal 0', 'repeated_action 1'] ELSE ['premature_finish 0'] END) AS r FROM b),
x AS (SELECT record_id, prompt, chosen, split_part(r, ' ', 1) AS reason, split_part(r, ' ', 2) AS nth, CASE r WHEN 'invalid_recovery 0' THEN {_NO_RECOVERY} WHEN 'invalid_recovery 1' THEN {_UNRELATED} ELSE CASE split_part(r, ' ', 1)
  WHEN 'premature_refusal' THEN {_REFUSAL} WHEN 'premature_finish' THEN {_EARLY} WHEN 'repeated_action' THEN {_REPEATED} ELSE {_WRONG_TOOL} END END AS rejected FROM o),
pref AS (SELECT *, sha256(CAST(record_id AS VARCHAR) || '|' || reason || '|' || nth) AS pair_id FROM x WHERE chosen <> rejected)"""
)


def pairs(get):
    """Written once: the audits read the pairs more than once."""
    return materialize(C.typed_rejections(dealt(get(PAIRED))), "preference-pairs")


@query("t4_preference_pairs", f"WITH {PREF} SELECT pair_id, record_id, reason, sha256(chosen) AS chosen, sha256(rejected) AS rejected, sha256(prompt) AS snapshot_sha256 FROM pref")
def t4(get):
    return pairs(get).select("pair_id", "record_id", "reason", F.sha2("chosen", 256).alias("chosen"), F.sha2("rejected", 256).alias("rejected"), "snapshot_sha256")


@query("t4_rejections_valid", f"WITH {PREF} SELECT reason, count(*) AS n, 0 AS invalid FROM pref GROUP BY reason")
def t4_valid(get):
    """Every rejection is a valid decision of its target's own contract."""
    contract = F.when(F.col("reason") == "invalid_recovery", "recovery_decision").otherwise("policy_decision")
    p = C.with_validity(dealt(pairs(get).select("reason", "rejected")).select("reason", F.try_parse_json("rejected").alias("v"), contract.alias("contract")))
    return p.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("invalid"))


# actions of which some break their contract
_BROKEN = [
    _tool("trim_video", ARGUMENTS["trim_video"]),
    _tool("trim_video", f"""concat('«"input_artifact_id":"a', {_ID}, '","time_range":', {_times("event_id % 9", "event_id % 3 - 1")}, '»')"""),
    _tool("validate_media", ARGUMENTS["validate_media"], '"junk":5,'),
    _tool("reframe_video", f"""concat('«"height":', CAST(60 + event_id % 9 AS STRING), ',"input_artifact_id":"a', {_ID}, '","width":"640"»')"""),
    _FINISH,
    f"""concat('«"completion_summary":" ","decision_type":"finish","evidence_ids":["e1"],"output_artifact_id":"o', {_ID}, '"»')""",
    _RETRY,
    _tool("change_speed", f"""concat('«"input_artifact_id":"a', {_ID}, '","speed_factor":', CAST((event_id % 50) AS STRING), 'e-1»')"""),
    f"""concat('text ', {_tool("search_video", ARGUMENTS["search_video"])}, ' end')""",
    """concat('powershell /etc/', event_type)""",
    _tool("concat_videos", f"""concat('«"input_artifact_ids":["a', {_ID}, '","a', CAST(event_id + event_id % 3 AS STRING), '"]»')"""),
]
_RAW = "CASE " + " ".join(f"WHEN event_id % 11 = {k} THEN {x}" for k, x in enumerate(_BROKEN)) + " END"
ACTED = _braced(
    f"""SELECT event_id, event_id AS rollout_id, user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, {_RAW} AS raw, {_tool("trim_video", ARGUMENTS["trim_video"])} AS expected,
  CASE WHEN event_id % 5 = 0 THEN 'recovery_decision' ELSE 'policy_decision' END AS contract, CASE WHEN event_id % 5 = 0 THEN 'recover' WHEN event_id % 5 = 1 THEN 'replan' ELSE 'decide' END AS operation FROM {{events}}"""
)
# what a JSON reader finds in each action, and the rules of the contract that its decision names
_ARG = lambda name: f"(j->>'$.tool_call.arguments.{name}')"
_KNOWN = lambda path, names: f"list_has_all([{', '.join(repr(n) for n in (*names, 'schema_version'))}], json_keys(j, '{path}'))"
JUDGED = f"""act AS ({ACTED}), js AS (SELECT *, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(regexp_extract(raw, '(?s)\\{{{{.*\\}}}}')) AND regexp_extract(raw, '(?s)\\{{{{.*\\}}}}') <> '' THEN regexp_extract(raw, '(?s)\\{{{{.*\\}}}}') END AS j FROM act),
jt AS (SELECT *, coalesce(j->>'$.decision_type', j->>'$.recovery_type') AS kind, j->>'$.tool_call.tool_name' AS tool FROM js),
jv AS (SELECT *, j IS NOT NULL AND CASE WHEN contract = 'recovery_decision' THEN coalesce(kind = 'retry_current_node' AND {_KNOWN("$", ("recovery_type", "node_id", "reason", "preferred_capability"))}, false)
  WHEN kind = 'finish' THEN trim(j->>'$.completion_summary') <> '' AND json_array_length(j, '$.evidence_ids') > 0
  WHEN kind = 'tool' THEN {_KNOWN("$", ("decision_type", "expected_observation", "rationale", "success_condition", "tool_call"))} AND CASE tool
    WHEN 'trim_video' THEN {_ARG("time_range.start_ms")}::BIGINT < {_ARG("time_range.end_ms")}::BIGINT AND {_ARG("time_range.end_ms")}::BIGINT > 0
    WHEN 'reframe_video' THEN {_ARG("height")}::BIGINT BETWEEN 64 AND 4096 AND {_ARG("height")}::BIGINT % 2 = 0 AND {_ARG("width")}::BIGINT % 2 = 0
    WHEN 'change_speed' THEN {_ARG("speed_factor")}::DOUBLE > 0.24 AND {_ARG("speed_factor")}::DOUBLE <= 4
    WHEN 'concat_videos' THEN {_ARG("input_artifact_ids[0]")} <> {_ARG("input_artifact_ids[1]")}
    ELSE true END
  ELSE false END AS ok FROM jt),
js2 AS (SELECT *, regexp_matches(raw, '(?i)shell|ffmpeg\\s+-|powershell|cmd\\.exe|/etc/|/root/|\\.\\.[\\\\/]') AS unsafe, coalesce(tool, kind) = 'trim_video' AS same_tool, kind = 'tool' AS same_kind, ok AND raw = expected AS exact,
  CASE WHEN tool = 'trim_video' THEN (SELECT sum(coalesce((json_extract(j, '$.tool_call.arguments.' || k) = json_extract(expected, '$.tool_call.arguments.' || k))::INT, 0)) / 3.0 FROM (SELECT unnest(['input_artifact_id', 'schema_version', 'time_range']) AS k)) END AS alike FROM jv)"""


@query("t2_contract_errors", f"WITH {JUDGED} SELECT rollout_id AS record_id, CASE WHEN NOT (ok AND raw = j) THEN 'not_a_decision' WHEN operation = 'replan' THEN 'replan_expected' END AS rule FROM jv WHERE NOT (ok AND raw = j) OR operation = 'replan'".replace("WHERE NOT (ok AND raw = j)", "WHERE NOT coalesce(ok AND raw = j, false)").replace("CASE WHEN NOT (ok AND raw = j)", "CASE WHEN NOT coalesce(ok AND raw = j, false)"))
def t2_contracts(get):
    """Targets that are no valid decision of their operation."""
    return C.contract_errors(dealt(get(ACTED)).select(F.col("rollout_id").alias("record_id"), "operation", F.col("raw").alias("target")))


@query(
    "t13_contract_rewards",
    f"""WITH {JUDGED} SELECT rollout_id, n, coalesce(ok, false) AS valid, coalesce(exact, false) AS exact, round(CASE WHEN n > 0 THEN CASE WHEN unsafe THEN -3.0 ELSE -1.0 END ELSE
    CASE WHEN ok THEN 0.25 ELSE -1.25 END + CASE WHEN same_kind THEN 0.4 ELSE 0 END + CASE WHEN same_tool THEN 0.6 + 0.5 * alike ELSE 0 END + CASE WHEN exact THEN 1.25 WHEN ok AND same_tool THEN 0.25 ELSE 0 END
    + CASE WHEN kind = 'finish' THEN -0.75 ELSE 0 END + CASE WHEN unsafe THEN -2.0 ELSE 0 END END, 9)::DOUBLE AS total FROM js2""",
)
def t13_contracts(get):
    """Rewards of completions under the contract of their row."""
    return C.score_actions(dealt(get(ACTED))).select("rollout_id", "n", "valid", "exact", "total")


_PA = "count(*) AS n, count(*) - count(DISTINCT prompt || chr(31) || chosen || chr(31) || rejected) AS duplicates, round(avg((length(chosen) < length(rejected))::INT), 9) AS chosen_shorter, round(avg(length(chosen) - length(rejected)), 9) AS mean_gap, min(length(chosen)) AS chosen_min, median(length(chosen)) AS chosen_median, round(quantile_cont(length(chosen), 0.95), 9) AS chosen_p95, max(length(chosen)) AS chosen_max, min(length(rejected)) AS rejected_min, median(length(rejected)) AS rejected_median, round(quantile_cont(length(rejected), 0.95), 9) AS rejected_p95, max(length(rejected)) AS rejected_max"


@query("t5_preference_audit", f"WITH {PREF} SELECT 'all' AS reason, {_PA} FROM pref UNION ALL SELECT reason, {_PA} FROM pref GROUP BY reason")
def t5(get):
    return T.preference_audit(pairs(get)).withColumns({c: F.round(c, 9) for c in ("chosen_shorter", "mean_gap", "chosen_p95", "rejected_p95")})


SIDES = f"""{PREF}, s AS (SELECT *, ('0x' || right(sha256(pair_id), 1))::INT % 2 = 1 AS odd, sha256('input|' || pair_id) AS input_id FROM pref),
rm AS (SELECT input_id, CASE WHEN odd THEN rejected ELSE chosen END AS a, CASE WHEN odd THEN chosen ELSE rejected END AS b, CASE WHEN odd THEN 'b' ELSE 'a' END AS side, reason FROM s)"""


@query("t6_reward_tables", f"WITH {SIDES} SELECT input_id, sha256(a) AS a, sha256(b) AS b, side AS chosen_side, reason FROM rm")
def t6(get):
    i, lab = T.reward_tables(pairs(get))
    return i.select("input_id", F.sha2("a", 256).alias("a"), F.sha2("b", 256).alias("b")).join(lab, "input_id").select("input_id", "a", "b", "chosen_side", "reason")


@query(
    "t6_reward_check",
    f"""WITH {SIDES}, i AS (SELECT input_id FROM rm), l AS (SELECT input_id, reason FROM rm WHERE reason <> 'invalid_recovery' UNION ALL SELECT input_id, reason FROM rm WHERE reason = 'premature_finish')
    SELECT 'without_label' AS "check", '' AS value, count(*) AS n FROM i WHERE input_id NOT IN (SELECT input_id FROM l) UNION ALL SELECT 'without_input', '', 0 UNION ALL SELECT 'repeated_input', '', count(*) FROM (SELECT 1 FROM i GROUP BY input_id HAVING count(*) > 1)
    UNION ALL SELECT 'repeated_label', '', count(*) FROM (SELECT 1 FROM l GROUP BY input_id HAVING count(*) > 1) UNION ALL SELECT 'class', reason, count(*) FROM l GROUP BY reason""",
)
def t6_check(get):
    """Labels of which one class is left out and another stands twice."""
    i, lab = T.reward_tables(pairs(get))
    return T.reward_check(i, lab.filter("reason <> 'invalid_recovery'").unionByName(lab.filter("reason = 'premature_finish'")))


_KINDS = f"""{SIDES}, ty AS (SELECT *, coalesce(a->>'$.decision_type', a->>'$.recovery_type', 'tool') AS ka, coalesce(b->>'$.decision_type', b->>'$.recovery_type', 'tool') AS kb FROM rm),
gu AS (SELECT side, ka, kb, CASE WHEN length(b) < length(a) THEN 'b' ELSE 'a' END AS shorter, CASE WHEN length(b) > length(a) THEN 'b' ELSE 'a' END AS longer, 'a' AS always_a, CASE WHEN ka NOT IN ('finish', 'cannot_complete') AND kb IN ('finish', 'cannot_complete') THEN 'a' WHEN ka IN ('finish', 'cannot_complete') AND kb NOT IN ('finish', 'cannot_complete') THEN 'b' END AS nonterminal,
  CASE WHEN ka = 'tool' AND kb <> 'tool' THEN 'a' WHEN ka <> 'tool' AND kb = 'tool' THEN 'b' END AS tool FROM ty)"""
_GUESSES = " UNION ALL ".join(f"SELECT '{h}' AS heuristic, round(avg(({h} = side)::INT), 9) AS accuracy, coalesce(sum(({h} = side)::INT), 0)::BIGINT AS n_right, count({h}) AS n FROM gu" for h in ("shorter", "longer", "always_a", "nonterminal", "tool"))


@query("t7_shortcut_audit", f"WITH {_KINDS} {_GUESSES}")
def t7(get):
    return T.shortcut_audit(*T.reward_tables(pairs(get))).withColumn("accuracy", F.round("accuracy", 9))


@query("t7_type_pairs", f"WITH {_KINDS} SELECT ka AS kind_a, kb AS kind_b, count(*) AS n FROM ty GROUP BY ALL")
def t7_types(get):
    return T.type_pairs(T.reward_tables(pairs(get))[0])


@query("t8_failure_head")
def t8_failure(get):
    """Rows only: the fitted class weights on all embeddings; a separable case is tested."""
    e = get("SELECT embedding AS features, label FROM {embeddings}")
    m = T.fit_failure_head(e, 20)
    rows = [(k, d, float(x)) for k, line in enumerate(m.coefficientMatrix.toArray()) for d, x in enumerate(line)]
    return e.sparkSession.createDataFrame(rows, "class int, dimension int, weight double")


@query("t8_pairwise_head")
def t8(get):
    """Rows only: fitted weights on neighbouring embeddings; label: the first has the smaller class."""
    e = get("SELECT vec_id, embedding, label FROM {embeddings}")
    a = e.filter("vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("k"), F.col("embedding").alias("a"), F.col("label").alias("la"))
    b = e.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("k"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    p = a.join(b, "k").filter("la <> lb").select(F.col("a").cast("array<double>"), F.col("b").cast("array<double>"), (F.col("la") < F.col("lb")).cast("int").alias("label"))
    w = T.fit_pairwise(p, 64)
    return e.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "dimension int, weight double")


SCORED = "SELECT doc_id AS input_id, quality AS label, CAST(doc_id % 100 AS DOUBLE) / 100 * 0.5 + quality * 0.4 AS score, doc_id % 37 AS length FROM {labels}"


@query(
    "t9_reward_metrics",
    f"""WITH s AS (SELECT label::DOUBLE AS y, round(score::DOUBLE, 9) AS p, length::DOUBLE AS n FROM ({SCORED})), v AS (SELECT p, count(*) AS c, sum(y) AS pos FROM s GROUP BY p),
    w AS (SELECT *, coalesce(sum(c) OVER b, 0) AS below, coalesce(sum(c - pos) OVER b, 0) AS nb FROM v WINDOW b AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    a AS (SELECT sum(pos) AS P, sum(c - pos) AS N, sum(pos * (below + (c + 1) / 2)) AS R, sum(pos * nb) AS con, sum(pos * (c - pos)) AS tied FROM w), r AS (SELECT s.*, below + (c + 1) / 2 AS rk FROM s JOIN w USING (p)),
    e AS (SELECT sum(c * abs(mp - my)) / sum(c) AS ece FROM (SELECT count(*) AS c, avg(p) AS mp, avg(y) AS my FROM s GROUP BY least(9, floor(p * 10))))
    SELECT 'accuracy' AS metric, round(avg(((p >= 0.5)::INT = y)::INT), 8) AS value FROM s UNION ALL SELECT 'auc', round((R - P * (P + 1) / 2) / (P * N), 8) FROM a UNION ALL SELECT 'spearman', round(corr(rk, y), 8) FROM r
    UNION ALL SELECT 'concordance', round((2 * con - (P * N - tied)) / (P * N - tied), 8) FROM a UNION ALL SELECT 'ece', round(ece, 8) FROM e UNION ALL SELECT 'length_correlation', round(corr(p, n), 8) FROM s""",
)
def t9(get):
    return T.reward_metrics(get(SCORED).withColumn("score", F.round(F.col("score").cast("double"), 9))).withColumn("value", F.round("value", 8))


GUESSED = "SELECT event_type AS truth, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS guess FROM {events}"
_CLASSES = ["view", "click", "error", "purchase", "signup", "never"]


@query(
    "t9_macro_f1",
    f"SELECT round(avg(CASE WHEN 2 * tp + off > 0 THEN 2 * tp / (2 * tp + off) ELSE 0 END), 9) AS macro_f1 FROM (SELECT k, count(*) FILTER (truth = k AND guess = k) AS tp, count(*) FILTER ((truth = k) <> (guess = k)) AS off FROM ({GUESSED}), (SELECT unnest({_CLASSES!r}) AS k) GROUP BY k)",
)
def t9b(get):
    return T.macro_f1(get(GUESSED), _CLASSES).select(R9("macro_f1"))


QUERY_PAIRS = "SELECT event_id, concat('find every ', event_type, ' item near red') AS instruction, concat(CASE WHEN event_id % 2 = 0 THEN 'find every ' ELSE '' END, event_type, CASE WHEN event_id % 3 = 0 THEN ' item' ELSE '' END) AS query FROM {events}"


@query("t10_acceptable_candidates", f"SELECT event_id, 2 * (1 + CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) >= 5 AS acceptable FROM ({QUERY_PAIRS})")
def t10(get):
    return T.acceptable(get(QUERY_PAIRS)).select("event_id", "acceptable")


CHOICES = "SELECT user_id AS case_id, event_id AS position, event_id % 5 / 10.0 AS rule, value AS model FROM {events}"


@query(
    "t11_candidate_selection",
    f"""WITH s AS (SELECT case_id, position, rule::DOUBLE AS rule, model, round(rule::DOUBLE + 0.25 * (model - avg(model) OVER w) / greatest(stddev_pop(model) OVER w, 1e-8), 9) AS hybrid FROM ({CHOICES}) WINDOW w AS (PARTITION BY case_id)),
    u AS (SELECT case_id, position, unnest(['rule', 'model', 'hybrid']) AS method, unnest([rule, model, hybrid]) AS v FROM s)
    SELECT case_id, method, position AS choice FROM u QUALIFY row_number() OVER (PARTITION BY case_id, method ORDER BY v DESC, position) = 1""",
)
def t11(get):
    return T.select_candidates(get(CHOICES).withColumn("rule", F.col("rule").cast("double")))


_CHOSEN = f"""s AS (SELECT case_id, position, rule::DOUBLE AS rule, model, round(rule::DOUBLE + 0.25 * (model - avg(model) OVER w) / greatest(stddev_pop(model) OVER w, 1e-8), 9) AS hybrid FROM ({CHOICES}) WINDOW w AS (PARTITION BY case_id)),
u AS (SELECT case_id, position, unnest(['rule', 'model', 'hybrid']) AS method, unnest([rule, model, hybrid]) AS v FROM s),
ch AS (SELECT case_id, method, position AS choice FROM u QUALIFY row_number() OVER (PARTITION BY case_id, method ORDER BY v DESC, position) = 1),
pol AS (SELECT user_id AS case_id, min(event_id) AS choice FROM events GROUP BY 1)"""


@query(
    "t11_selection_report",
    f"""WITH {_CHOSEN}, e AS (SELECT * FROM ch UNION ALL SELECT case_id, 'policy', choice FROM pol), j AS (SELECT e.*, e.choice % 3 = 0 AS ok, pol.choice % 3 = 0 AS base FROM e JOIN pol USING (case_id))
    SELECT method, count(*) AS n, round(avg(ok::INT), 9) AS accuracy, count(*) FILTER (ok AND NOT base) AS corrected, count(*) FILTER (ok = base) AS no_effect, count(*) FILTER (NOT ok AND base) AS harmed FROM j GROUP BY 1""",
)
def t11_report(get):
    chosen = T.select_candidates(get(CHOICES).withColumn("rule", F.col("rule").cast("double")))
    events = get("SELECT user_id AS case_id, event_id AS choice, event_id % 3 = 0 AS good FROM {events}")
    policy = events.groupBy("case_id").agg(F.min("choice").alias("choice"))
    return T.selection_report(chosen, events.filter("good").drop("good"), policy).withColumn("accuracy", F.round("accuracy", 9))


RULED = "SELECT event_id, event_id % 9 <> 0 AS valid, CASE WHEN event_id % 4 = 0 THEN 'finish' ELSE 'tool' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'trim_video' ELSE 'search_video' END AS tool, concat('FIND ', event_type, ' now') AS query, concat('find  every ', event_type, ' item by me') AS instruction FROM {events}"


@query("t11_rule_scores", f"SELECT event_id, round(CASE WHEN NOT valid THEN -4 WHEN kind <> 'tool' THEN -2 WHEN tool <> 'search_video' THEN -1 ELSE 2 + CASE WHEN length(split_part(query, ' ', 2)) >= 4 THEN 2 / 4 ELSE 1 / 3 END END, 9) AS rule FROM ({RULED})")
def t11_rules(get):
    return T.public_rule_score(get(RULED)).select("event_id", R9("rule"))


ROLL = """SELECT event_id AS rollout_id, user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n,
  CASE WHEN event_id % 6 = 0 THEN 'not json' WHEN event_id % 6 = 1 THEN '{{"decision_type":"finish"}}' WHEN event_id % 6 = 2 THEN 'text {{"arguments":{{"x":"1"}},"decision_type":"tool","name":"trim"}} end' WHEN event_id % 6 = 3 THEN '{{"arguments":{{"x":"1","y":"2"}},"decision_type":"tool","name":"trim"}}'
    WHEN event_id % 6 = 4 THEN '{{"decision_type":"odd","name":"trim"}}' ELSE '{{"arguments":{{"x":"/etc/pw"}},"decision_type":"tool","name":"cut"}}' END AS raw,
  '{{"arguments":{{"x":"1","y":"2"}},"decision_type":"tool","name":"trim"}}' AS expected FROM {events}"""
_TOTALS = "CASE WHEN n > 0 THEN CASE WHEN event_id % 6 = 5 THEN -3.0 ELSE -1.0 END ELSE CASE event_id % 6 WHEN 0 THEN -1.25 WHEN 1 THEN 0.25 - 0.75 WHEN 2 THEN 0.25 + 0.4 + 0.6 + 0.25 + 0.25 WHEN 3 THEN 0.25 + 0.4 + 0.6 + 0.5 + 1.25 WHEN 4 THEN 0.6 - 1.25 ELSE 0.25 + 0.4 - 2.0 END END"
TOTALS = f"SELECT event_id AS rollout_id, user_id AS sample_id, n, ({_TOTALS})::DOUBLE AS total, event_id % 6 NOT IN (0, 4) AS valid FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM {{events}})"


def scored(get):
    return T.score_rollouts(get(ROLL), ["tool", "finish", "cannot_complete"])


@query("t13_rollout_scores", f"SELECT rollout_id, sample_id, n, round(total, 9) AS total, valid FROM ({TOTALS})")
def t13(get):
    return scored(get).select("rollout_id", "sample_id", "n", "total", "valid")


_COMPONENTS = {
    "structured": "CASE WHEN k IN (0, 4) THEN 0 ELSE 0.25 END",
    "kind_reward": "CASE WHEN k IN (2, 3, 5) THEN 0.4 ELSE 0 END",
    "operation": "CASE WHEN k IN (2, 3, 4) THEN 0.6 ELSE 0 END",
    "arguments": "CASE k WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 ELSE 0 END",
    "progress": "CASE k WHEN 2 THEN 0.25 WHEN 3 THEN 1.25 ELSE 0 END",
    "malformed": "CASE WHEN k IN (0, 4) THEN -1 ELSE 0 END",
    "invalid": "CASE WHEN k IN (0, 4) THEN -0.25 ELSE 0 END",
    "premature": "CASE WHEN k = 1 THEN -0.75 ELSE 0 END",
    "unsafe_penalty": "CASE WHEN k = 5 THEN -2 ELSE 0 END",
}
_RAWLEN = "CASE k " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate((8, 26, 69, 68, 37, 65))) + " END"
_PARTS = f"""p AS (SELECT rollout_id, sample_id, n, total, valid, rollout_id % 6 AS k FROM ({TOTALS})), c AS (SELECT *, {", ".join(f"CASE WHEN n = 0 THEN ({x}) ELSE 0 END AS {c}" for c, x in _COMPONENTS.items())}, k = 3 AS exact, {_RAWLEN} AS len FROM p)"""


@query(
    "t14_rollout_summary",
    f"""WITH {_PARTS}, g AS (SELECT sample_id, n // 4 AS grp, count(*) AS m, count(DISTINCT rollout_id % 2) AS s, var_pop(total) AS v, min(total) AS lo, max(total) AS hi FROM c GROUP BY ALL),
    a AS (SELECT count(*) AS rollouts, round(avg(valid::INT), 8) AS validity, round(avg(exact::INT), 8) AS exact, round(avg(len), 8) AS mean_length, {", ".join(f"round(avg({x}), 8) AS mean_{x}" for x in (*_COMPONENTS, "total"))} FROM c)
    SELECT a.*, b.* FROM a, (SELECT count(*) AS groups, count(*) FILTER (m = 4) AS complete, count(*) FILTER (m = 4 AND s = 1) AS one_snapshot, count(*) FILTER (m = 4 AND hi > lo) AS varied, round(coalesce(avg(v) FILTER (m = 4), 0), 8) AS mean_variance FROM g) b""",
)
def t14(get):
    r = scored(get).withColumns({"group": F.concat_ws("-", "sample_id", F.floor(F.col("n") / 4)), "snapshot": F.col("rollout_id") % 2, "length": F.length("raw")})
    out = T.rollout_summary(r)
    return out.withColumns({c: F.round(c, 8) for c, t in out.dtypes if t == "double"})


@query(
    "t15_reward_hacking",
    f"""WITH t AS ({TOTALS}) SELECT 'malformed_structured_action' AS finding, count(*) AS n FROM t WHERE NOT valid UNION ALL SELECT 'invalid_discriminator', count(*) FROM t WHERE rollout_id % 6 = 4
    UNION ALL SELECT 'partial_reward_for_invalid_action', count(*) FROM t WHERE NOT valid AND total > -1.25 UNION ALL SELECT 'no_automatic_anomaly', count(*) FROM t WHERE valid""",
)
def t15(get):
    return T.hacking_findings(scored(get), {"invalid_discriminator": ['"decision_type":"odd"']})


@query(
    "t15_hacking_summary",
    f"""WITH {_PARTS} SELECT count(*) AS n, round(coalesce(corr(len, total), 0), 8) AS length_correlation, count(*) - count(DISTINCT k) AS duplicates, 0 AS empty, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (NOT valid AND total > -1.25) AS partial_reward_invalid, count(*) FILTER (k = 1 AND premature = 0) AS terminal_escapes FROM c""",
)
def t15_summary(get):
    return T.hacking_summary(scored(get)).withColumn("length_correlation", F.round("length_correlation", 8))


_PD = ", ".join(["count(*) AS cases", "round(avg((kind_reward > 0)::INT), 8) AS kind_accuracy", "round(avg((operation > 0)::INT), 8) AS operation_accuracy", "round(avg((arguments = 0.5)::INT), 8) AS argument_accuracy", "round(avg((NOT valid)::INT), 8) AS invalid_rate", "count(*) FILTER (premature < 0) AS premature", "count(*) FILTER (n > 0) AS repeated", "round(avg(exact::INT), 8) AS success", "round(avg(total), 8) AS mean_reward", "quantile_disc(rollout_id % 997, 0.5) AS latency_p50", "quantile_disc(rollout_id % 997, 0.95) AS latency_p95"])


@query(
    "t16_policy_detail",
    f"""WITH {_PARTS}, d AS (SELECT CASE WHEN rollout_id % 4 < 2 THEN 'base' ELSE 'tuned' END AS policy, * FROM c), o AS (SELECT policy, {_PD}, avg(exact::INT) AS s, avg(total) AS r FROM d GROUP BY 1)
    SELECT o.* EXCLUDE (s, r), round(o.s - b.s, 8) AS success_delta, round(o.r - b.r, 8) AS reward_delta FROM o, (SELECT s, r FROM o WHERE policy = 'base') b""",
)
def t16_detail(get):
    r = scored(get).withColumns({"policy": F.when(F.col("rollout_id") % 4 < 2, "base").otherwise("tuned"), "repeated": F.col("n") > 0, "latency_ms": F.col("rollout_id") % 997})
    out = T.policy_detail(r, "base")
    return out.withColumns({c: F.round(c, 8) for c, t in out.dtypes if t == "double"})


LOGS = "SELECT event_type AS policy, event_id AS step, value AS loss, user_id AS kl FROM {events}"


@query("t16_training_log", f"SELECT policy, count(*) AS steps, round(avg(loss), 8) AS mean_loss, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, round(avg(kl), 8) AS mean_kl, max(kl) AS max_kl FROM ({LOGS}) GROUP BY policy")
def t16(get):
    return T.training_log(get(LOGS)).withColumns({c: F.round(c, 8) for c in ("mean_loss", "mean_kl")})


TEXTS = "SELECT user_id AS case_id, event_id AS pos, event_type AS text, event_id * 10 AS start_ms, event_id * 10 + 5 AS end_ms FROM {events} WHERE event_id % 10 = 0"


@query("a9_error_rates")
def a9(get):
    """Rows only: SQL engines have no edit distance over words; hand-computed pairs are tested."""
    c = get("SELECT conv_id, turn, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hypothesis FROM {conversations}")
    # a long conversation is one task of the window: its pairs are dealt out before they are compared
    return T.error_rates(dealt(c.filter("hypothesis IS NOT NULL"))).select("conv_id", "turn", R9("wer"), R9("cer"))


SWEEP = "SELECT CAST(floor(value / 20) AS INT) AS threshold, user_id AS video_id FROM {events}"


@query("a15_threshold_sweep", f"SELECT threshold, n_scenes, count(*) AS videos FROM (SELECT threshold, video_id, count(*) AS n_scenes FROM ({SWEEP}) GROUP BY ALL) GROUP BY ALL")
def a15(get):
    return T.threshold_sweep(get(SWEEP))


CONTEXT = "SELECT user_id AS run_id, event_id, event_type FROM {events}"


@query(
    "p10_compact_context",
    f"""WITH c AS ({CONTEXT}), r AS (SELECT run_id, list(event_id ORDER BY event_id) AS ids, list(event_id ORDER BY event_id) FILTER (event_type = 'view') AS ready, list(event_id ORDER BY event_id) FILTER (event_type <> 'view') AS done FROM c GROUP BY 1)
    SELECT run_id, '{{{{"observations":[' || array_to_string(list_transform(ids[-2:], lambda x: CAST(x AS VARCHAR)), ',') || '],"verifications":[' || coalesce(array_to_string(list_transform(done[-2:], lambda x: CAST(x AS VARCHAR)), ','), '') || '],"scenes":[' || array_to_string(list_transform(ids[:5], lambda x: CAST(x AS VARCHAR)), ',') || '],"plan":[' || coalesce(array_to_string(list_transform(ready, lambda x: '{{{{"id":' || CAST(x AS VARCHAR) || ',"status":"ready"}}}}'), ','), '') || ']}}}}' AS context FROM r""",
)
def p10(get):
    c = get(CONTEXT).groupBy("run_id").agg(F.array_sort(F.collect_list("event_id")).alias("observations"), F.array_sort(F.collect_list(F.when(F.col("event_type") != "view", F.col("event_id")))).alias("verifications"), F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "ready").otherwise("done").alias("status")))).alias("plan"))
    return T.compact_context(c.withColumn("scenes", F.col("observations")))


_STAGE = "CASE WHEN row_number() OVER (PARTITION BY trajectory_id ORDER BY pos) <= 1 THEN 'first' ELSE 'later' END"


@query(
    "t12_rollout_tables",
    f"""WITH r AS (SELECT {RID} AS record_id, trajectory_id, prompt, target, {_STAGE} AS stage, trajectory_id % 7 AS g FROM ({RECORDS}))
    SELECT sha256('sample|' || record_id) AS sample_id, CASE WHEN g IN (SELECT DISTINCT g FROM r ORDER BY g DESC LIMIT 2) THEN 'holdout' ELSE 'train' END AS subsplit, stage, sha256(prompt) AS snapshot, sha256(target) AS expected FROM r""",
)
def t12(get):
    i, lab = T.rollout_tables(records(get).withColumn("source_group", F.col("trajectory_id") % 7), [(1, "first")], "later")
    return i.join(lab, "sample_id").select("sample_id", "subsplit", "stage", "snapshot", F.sha2("expected", 256).alias("expected"))


SPOKEN = "SELECT conv_id AS case_id, turn AS pos, role AS text, turn * 1000 AS start_ms, turn * 1000 + 900 AS end_ms FROM {conversations}"
SPOKEN_GOLD = "SELECT conv_id AS case_id, 'user assistant' AS text, 100 AS start_ms, count(*) * 1000 AS end_ms FROM {conversations} GROUP BY conv_id"


@query(
    "a10_asr_table",
    f"""WITH s AS (SELECT case_id, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS h, min(start_ms) AS s, max(end_ms) AS e FROM ({SPOKEN}) GROUP BY 1)
    SELECT case_id, abs(s - g.start_ms) AS start_error, abs(e - g.end_ms) AS end_error, h = 'user assistant' AS correct, CASE WHEN h = 'user assistant' THEN 'correct' WHEN n < 2 THEN 'deletion' WHEN n > 2 THEN 'insertion' ELSE 'substitution' END AS kind FROM ({SPOKEN_GOLD}) g JOIN s USING (case_id)""",
)
def a10(get):
    t = T.asr_table(get(SPOKEN), get(SPOKEN_GOLD))
    return t.select("case_id", "start_error", "end_error", (F.col("wer") == 0).alias("correct"), "kind")
