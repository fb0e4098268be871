"""Action contracts by hand: what is valid, what the controlled edits make of it, what it earns."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillspan.operators import contracts


def call(tool, more=None, **arguments):
    return {
        "schema_version": "1.0",
        "decision_type": "tool",
        "tool_call": {"schema_version": "1.0", "tool_call_id": "c-1", "tool_name": tool, "arguments": {"schema_version": "1.0", **arguments}},
        "rationale": "r",
        "expected_observation": "e",
        "success_condition": "s",
        **(more or {}),
    }


def span(start, end):
    return {"start_ms": start, "end_ms": end}


CHECK = call("validate_media", input_artifact_id="artifact-1", decode_entire_video=True, require_audio=False)
CUES = [{"cue_id": "c1", "time_range": span(0, 5), "text": "t"}, {"cue_id": "c2", "time_range": span(5, 9), "text": "u"}]
STEPS = [{"step_id": "s1", "description": "d"}, {"node_id": "s2", "subgoal": "g", "dependencies": ["s1"], "status": "done"}]
FINISH = {"decision_type": "finish", "output_artifact_id": "o", "completion_summary": "s", "evidence_ids": ["e"]}


def replan(steps):
    return {"decision_type": "replan", "reason": "r", "affected_plan_nodes": ["a"], "requested_patch": {"revision": 1, "reason": "q", "steps": steps}}


GOOD = [
    CHECK,
    call("trim_video", input_artifact_id="a", time_range=span(10, "21")),  # digits in quotes
    call("add_subtitles", input_artifact_id="a", cues=CUES),
    call("concat_videos", input_artifact_ids=["a", " b "]),
    call("change_speed", input_artifact_id="a", speed_factor=0.25),
    call("change_speed", input_artifact_id="a", speed_factor=4),
    call("search_video", query=" q ", required_evidence_types=["ocr"], video_id=None),
    call("normalize_audio", input_artifact_id="a", true_peak_db=0),
    call("inspect_media", input_artifact_id="a:b.c-d_e"),
    call("reframe_video", input_artifact_id="a", width=64.0, height=4096),
    replan(STEPS),
    FINISH,
    {"decision_type": "cannot_complete", "reason": "x", "missing_evidence_or_capability": ["y"]},
]
BAD = [
    {**CHECK, "junk": 5},
    {k: v for k, v in CHECK.items() if k != "rationale"},
    {**CHECK, "schema_version": "2.0"},
    call("trim_video", input_artifact_id="a", time_range=span(30, 21)),
    call("trim_video", input_artifact_id="a", time_range={**span(1, 2), "unit": "ms"}),
    call("trim_video", input_artifact_id="a", time_range=span(1.5, 3)),
    call("add_subtitles", input_artifact_id="a", cues=[CUES[0], {**CUES[1], "time_range": span(4, 9)}]),
    call("add_subtitles", input_artifact_id="a", cues=[CUES[0], {**CUES[1], "cue_id": "c1"}]),
    call("add_subtitles", input_artifact_id="a", cues=[]),
    call("concat_videos", input_artifact_ids=["a", " a"]),
    call("concat_videos", input_artifact_ids=["a"]),
    call("change_speed", input_artifact_id="a", speed_factor=0.24),
    call("change_speed", input_artifact_id="a", speed_factor="fast"),
    call("search_video", query="  "),
    call("search_video", query="q", top_k=None),
    call("search_video", query="q", required_evidence_types=["smell"]),
    call("reframe_video", input_artifact_id="a", width=65, height=64),
    call("inspect_media", input_artifact_id="-a"),
    call("inspect_media", input_artifact_id=7),
    call("delete_media", input_artifact_id="a"),
    replan([STEPS[1]]),
    replan([{**STEPS[0], "node_id": "s1"}]),
    replan([{**STEPS[0], "dependencies": ["s1"]}]),
    {**FINISH, "evidence_ids": []},
    {"decision_type": "odd"},
    {"recovery_type": "skip_blocked_node", "node_id": "n", "reason": "x"},
    [1],
]
RECOVERY = [
    ({"recovery_type": "skip_blocked_node", "node_id": "n", "reason": "x"}, True),
    ({"recovery_type": "retry_current_node", "node_id": "n", "reason": "x", "preferred_capability": None}, True),
    ({"recovery_type": "modify_current_node", "node_id": "n", "reason": "x", "revised_subgoal": "g", "revised_completion_criteria": ["c"] * 8}, True),
    ({"recovery_type": "modify_current_node", "node_id": "n", "reason": "x", "revised_subgoal": "g", "revised_completion_criteria": ["c"] * 9}, False),
    ({"recovery_type": "insert_recovery_node", "node_id": "n", "reason": "x", "recovery_subgoal": "g", "completion_criteria": ["c"]}, False),
    (CHECK, False),
]


def test_which_actions_are_valid(spark):
    cases = [(a, "policy_decision", True) for a in GOOD] + [(a, "policy_decision", False) for a in BAD] + [(a, "recovery_decision", ok) for a, ok in RECOVERY]
    rows = [(i, json.dumps(a), c) for i, (a, c, _) in enumerate(cases)] + [(900, "{", "policy_decision"), (901, None, "policy_decision"), (902, json.dumps(CHECK), "other"), (903, json.dumps(CHECK), None)]
    df = spark.createDataFrame(rows, "i int, raw string, contract string").withColumn("v", F.try_parse_json("raw"))
    got = {r["i"]: r["valid"] for r in contracts.with_validity(df).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: ok for i, (_, _, ok) in enumerate(cases)}
    assert not any(got[i] for i in (900, 901, 902, 903))


def test_rejections_by_tool(spark):
    records = [(i, "decide", "p", json.dumps(a)) for i, a in enumerate(GOOD)] + [(100, "recover", "p", json.dumps(RECOVERY[0][0])), (101, "decide", "p", json.dumps(BAD[0]))]
    pairs = contracts.typed_rejections(spark.createDataFrame(records, "record_id int, operation string, prompt string, target string")).collect()
    by = {}
    for r in pairs:
        by.setdefault(r["record_id"], {}).setdefault(r["reason"], []).append(json.loads(r["rejected"]))
        assert r["rejected"] == json.dumps(json.loads(r["rejected"]), ensure_ascii=False, sort_keys=True, separators=(",", ":")) and len(r["pair_id"]) == 64
    edited = lambda i: by[i]["wrong_tool_or_arguments"][0]["tool_call"]["arguments"]
    assert 101 not in by and set(by[0]) == {"premature_refusal", "premature_finish", "wrong_tool_or_arguments"}
    assert edited(0)["require_audio"] is True and edited(1)["time_range"] == {"schema_version": "1.0", "start_ms": 10, "end_ms": 15}
    assert [c["text"] for c in edited(2)["cues"]] == ["incorrect controlled subtitle", "u"] and edited(2)["style"]["font_size"] == 24
    assert edited(3)["input_artifact_ids"] == ["b", "a"] and edited(4)["speed_factor"] == 2.0 and edited(5)["speed_factor"] == 0.5
    assert edited(6) == {"approximate_time_range": None, "query": contracts.OTHER_QUERY, "required_evidence_types": ["ocr"], "schema_version": "1.0", "top_k": 1, "video_id": None}
    assert "wrong_tool_or_arguments" not in by[7] and "wrong_tool_or_arguments" not in by[8]  # no edit for these tools
    assert (edited(9)["width"], edited(9)["height"]) == (4096, 64)
    assert set(by[10]) == set(by[12]) == {"premature_finish"} and set(by[11]) == {"premature_refusal", "repeated_action"}
    assert by[11]["repeated_action"][0]["tool_call"]["arguments"]["input_artifact_id"] == "o"
    assert [x["recovery_type"] for x in by[100]["invalid_recovery"]] == ["cannot_recover", "retry_current_node"] and by[100]["invalid_recovery"][1]["node_id"] == "unrelated-n"


def test_rewards_under_a_contract(spark):
    want = json.dumps(CHECK)
    other = call("validate_media", input_artifact_id="artifact-2", decode_entire_video=True, require_audio=False)
    raws = [
        (want, 0, 3.0, True),  # 0.25 + 0.4 + 0.6 + 0.5 + 1.25
        (f"I choose {want}.", 0, 3.0, True),
        ("not JSON", 0, -1.25, False),
        (want, 1, -1.0, True),
        (json.dumps(other), 0, 0.25 + 0.4 + 0.6 + 0.5 * 3 / 4 + 0.25, True),
        (json.dumps({**CHECK, "junk": 1}), 0, 0.4 + 0.6 + 0.5 - 1.25, False),
        (json.dumps(FINISH), 0, 0.25 - 0.75, True),
        (json.dumps({**FINISH, "completion_summary": "see /etc/passwd"}), 0, 0.25 - 0.75 - 2, True),
        ("powershell /etc/passwd", 0, -3.25, False),
        ("powershell", 2, -3.0, False),
        (None, 0, -1.25, False),
    ]
    df = spark.createDataFrame([(i, i, n, raw, want, "policy_decision") for i, (raw, n, _, _) in enumerate(raws)], "rollout_id int, sample_id int, n int, raw string, expected string, contract string")
    got = {r["rollout_id"]: (r["total"], r["valid"]) for r in contracts.score_actions(df).collect()}
    assert got == {i: (round(total, 9), ok) for i, (_, _, total, ok) in enumerate(raws)}


def test_targets_that_their_operation_does_not_allow(spark):
    rows = [(1, "decide", CHECK), (2, "replan", CHECK), (3, "replan", replan(STEPS)), (4, "decide", replan(STEPS)), (5, "recover", RECOVERY[0][0]), (6, "recover", CHECK), (7, "decide", BAD[0])]
    df = spark.createDataFrame([(i, o, json.dumps(t)) for i, o, t in rows], "record_id int, operation string, target string")
    assert {(r["record_id"], r["rule"]) for r in contracts.contract_errors(df).collect()} == {(2, "replan_expected"), (4, "replan_unexpected"), (6, "not_a_decision"), (7, "not_a_decision")}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_checks_of_a_target_are_planned_once(spark):
    rows = spark.createDataFrame([(1, "decide", "p", json.dumps(CHECK))], "record_id long, operation string, prompt string, target string")
    plan = optimized(contracts.typed_rejections(rows))
    assert "Filter" not in plan
