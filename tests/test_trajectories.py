"""Hand-computed cases of trajectory evaluation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspan.operators import trajectories as T

RUN = "run_id int, task_id int, terminal_reason string, source_artifact_id string, final_artifact_id string, duration_ms long, width int, height int, has_video boolean, has_audio boolean"
TOOL = "run_id int, pos int, tool_name string, status string, output_artifact_id string, inputs array<string>, start_ms long, end_ms long, text string, speed double, latency_ms long"
CAND = "run_id int, video_id string, scene_id int, start_ms long, end_ms long, rank int"
GOLD = "task_id int, family string, expected_terminal string, required_tools array<string>, unsolved_cause string"
SCENE = "task_id int, pos int, video_id string, scene_id int, start_ms long, end_ms long"
CONS = "task_id int, pos int, type string, mandatory boolean, target_ms long, tolerance_ms long, width int, height int, text string, start_ms long, end_ms long, speed double, require_video boolean, require_audio boolean"


def run(i, reason="SUCCESS", final="f", task=1, duration=2000):
    return (i, task, reason, "s", final, duration, 640, 360, True, True)


def tool(i, pos, name, status="success", start=None, end=None, out=None, inputs=None, text=None):
    return (i, pos, name, status, out, inputs, start, end, text, None, 10)


@pytest.fixture()
def one(spark):
    def make(runs, tools, cands=((1, "v", 7, 0, 2000, 1),)):
        gold = spark.createDataFrame([(1, "edit", "SUCCESS", ["search_video", "trim_video"], "planning_error")], GOLD)
        scenes = spark.createDataFrame([(1, 0, "v", 7, 0, 2000)], SCENE)
        none = (None,) * 9
        cons = spark.createDataFrame([(1, 0, "grounding", True, *none[:2], None, None, None, None, None, None, None, None), (1, 1, "duration", True, 2000, 100, None, None, None, None, None, None, None, None)], CONS)
        return spark.createDataFrame(runs, RUN), spark.createDataFrame(tools, TOOL), spark.createDataFrame(list(cands), CAND), gold, scenes, cons

    return make


def good(i):
    return [tool(i, 0, "search_video"), tool(i, 1, "trim_video", start=0, end=2000, out="f")]


def test_primary_and_secondary_causes(one):
    runs = [run(1), run(2, "CANNOT_COMPLETE", None), run(3, "CANNOT_COMPLETE", None), run(4, "MODEL_OUTPUT_FAILURE"), run(5), run(6), run(7, duration=9000)]
    tools = good(1) + [tool(2, 0, "trim_video", "invalid")] + good(3) + good(4) + [tool(5, 0, "search_video", "error"), *good(5)[1:]] + [tool(6, 0, "search_video")] + good(7)
    cands = [(i, "v", 7, 0, 2000, 1) for i in range(1, 8)]
    got = {r["run_id"]: (r["primary_failure"], r["secondary_failure"]) for r in T.evaluate(*one(runs, tools, cands)).collect()}
    assert got == {
        1: (None, None),
        2: ("invalid_arguments", "premature_refusal"),
        3: ("premature_refusal", None),
        4: ("model_format_error", None),
        5: ("tool_execution_failure", None),
        6: ("wrong_tool", None),
        7: ("invalid_arguments", None),
    }


def test_a_run_without_trims_is_not_grounded(one):
    runs, tools, _, _, scenes, cons = one([run(1), run(2)], good(1) + [tool(2, 0, "search_video")])
    assert {(r["run_id"], r["type"]): r["satisfied"] for r in T.constraint_results(runs, tools, scenes, cons).collect()} == {(1, "grounding"): True, (1, "duration"): True, (2, "grounding"): False, (2, "duration"): True}


def test_first_errors(spark, one):
    tools = (
        good(1)
        + [tool(2, 0, "search_video"), tool(2, 1, "trim_video", start=0, end=2000)]  # no hit
        + [tool(3, 0, "search_video"), tool(3, 1, "trim_video", start=0, end=2000)]  # first hit is far off
        + [tool(4, 0, "search_video"), tool(4, 1, "trim_video", start=0, end=1500)]  # IoU 0.75
        + [tool(5, 0, "search_video"), tool(5, 1, "trim_video")]  # no range
        + [tool(6, 0, "search_video"), tool(6, 1, "inspect_scene"), tool(6, 2, "validate_output"), tool(6, 3, "change_speed")]  # only editing tools can be wrong
        + [tool(7, 0, "search_video", "invalid")]
        + [tool(8, 0, "search_video", "timeout")]
        + [tool(9, 0, "inspect_scene"), tool(9, 1, "validate_output")]
    )
    hits = [(i, 0, 1, 0, 2000) for i in (1, 4, 5, 6)] + [(3, 0, 1, 5000, 7000), (3, 0, 2, 0, 2000)]
    runs, t, _, gold, scenes, _ = one([run(i) for i in range(1, 10)], tools)
    got = {r["run_id"]: (r["pos"], r["cause"]) for r in T.first_error(t, runs, gold, scenes, spark.createDataFrame(hits, "run_id int, pos int, rank int, start_ms long, end_ms long")).collect()}
    assert got == {
        2: (0, "upstream_perception_error"),
        3: (0, "retrieval_error"),
        4: (1, "invalid_arguments"),
        5: (1, "invalid_arguments"),
        6: (3, "wrong_tool"),
        7: (0, "invalid_arguments"),
        8: (0, "tool_execution_failure"),
    }


def test_recovery_counts_and_medians_over_attempts(spark):
    ev = spark.createDataFrame(
        [(1, True, "SUCCESS", True, "SUCCESS", None, False, "a"), (2, False, "SUCCESS", True, "SUCCESS", "wrong_tool", False, "a"), (3, False, "SUCCESS", False, "LOOP_DETECTED", None, True, "b"), (4, True, "SUCCESS", True, "SUCCESS", None, False, "b")],
        "run_id int, task_success boolean, expected_terminal string, designed boolean, terminal_reason string, primary_failure string, repeated_editor boolean, family string",
    )
    tools = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (1, 2, 9), (2, 0, 5), (3, 0, 5), (3, 1, 5)], "run_id int, pos int, latency_ms long")
    errors = spark.createDataFrame([(1, 0, "retrieval_error"), (2, 0, "invalid_arguments"), (3, 0, "wrong_tool")], "run_id int, pos int, cause string")
    steps = spark.createDataFrame(
        [(1, 10, "act", 0, True, None, 1), (1, 11, "replan", None, True, True, 2), (1, 12, "recover", None, False, None, 4), (1, 13, "act", 1, True, None, 8), (2, 1, "act", 0, True, None, 1)],
        "run_id int, step int, operation string, call_pos int, valid boolean, accepted boolean, latency_ms long",
    )
    rec = T.attributed(T.recovery(ev, tools, errors, steps))
    got = {r["run_id"]: r for r in rec.collect()}
    r = got[1]
    assert (r["opportunity"], r["attempted"], r["succeeded"], r["attempts"], r["decision_validity"], r["patch_acceptance"], r["extra_steps"], r["extra_latency"]) == (True, True, True, 2, 0.5, 1.0, 3, 14 + 16)
    assert (got[2]["opportunity"], got[2]["attempted"], got[2]["extra_steps"], got[2]["failure"]) == (True, False, None, "invalid_arguments")
    assert (got[3]["opportunity"], got[3]["failure"]) == (False, "handoff_error") and (got[4]["opportunity"], got[4]["failure"]) == (False, None)
    s = {x["metric"]: x["value"] for x in T.recovery_summary(rec).collect()}
    assert (s["opportunities"], s["attempt_rate"], s["success_rate"], s["conditional_success"]) == (2, 0.5, 0.5, 1.0)
    assert (s["median_extra_steps"], s["median_extra_latency"], s["origin:policy"], s["origin:protocol"], s["origin:upstream"]) == (3, 30, 0.5, 0.5, 0)
    assert (s["category:a"], s["category:b"]) == (0.5, 0.5)


def test_recovery_failures_in_order(spark):
    base = {"triggered": True, "n_format_errors": 0, "decided": True, "appropriate": None, "accepted": None, "executable": True, "attempted": True, "terminal_reason": "SUCCESS", "useful": True, "repaired": True, "task_success": True}
    changes = [
        ({}, None),
        ({"triggered": False, "n_format_errors": 1}, "recovery_not_triggered"),
        ({"n_format_errors": 2, "decided": False}, "recovery_format_error"),
        ({"decided": False}, "recovery_not_triggered"),
        ({"appropriate": False, "accepted": False}, "recovery_wrong_operation"),
        ({"accepted": False}, "recovery_invalid_patch"),
        ({"executable": False}, "recovery_no_state_change"),
        ({"attempted": False, "terminal_reason": "BUDGET_EXHAUSTED"}, "recovery_no_state_change"),
        ({"terminal_reason": "BUDGET_EXHAUSTED"}, "recovery_budget_exhaustion"),
        ({"useful": False}, "recovery_wrong_tool_after_patch"),
        ({"repaired": False}, "recovery_repeat_failure"),
        ({"task_success": False}, "recovery_success_but_task_failed_later"),
    ]
    schema = "i int, triggered boolean, n_format_errors int, decided boolean, appropriate boolean, accepted boolean, executable boolean, attempted boolean, terminal_reason string, useful boolean, repaired boolean, task_success boolean"
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(changes)], schema)
    got = {r["i"]: r["recovery_failure"] for r in T.recovery_failure(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(changes)}
    levels = spark.createDataFrame([("x", 0), ("x", 2), ("y", 2), ("y", 1)], "failure_type string, level int")
    s = {r["failure_type"]: r for r in T.funnel_summary(levels, 2, "failure_type").collect()}
    assert (s["all"]["at_least_1"], s["all"]["highest_0"], s["all"]["highest_1"], s["all"]["highest_2"], s["y"]["highest_2"], s["all"]["rate_2"]) == (3, 1, 1, 2, 1, 2 / 3)


def test_known_faults_are_told_from_success(spark, one):
    n = len(T.MUTATIONS)
    runs, tools, cands, gold, scenes, cons = one([run(i) for i in range(n)], sum((good(i) for i in range(n)), []), [(i, "v", 7, 0, 2000, 1) for i in range(n)])
    r, t, c = T.mutate(runs, tools, cands, scenes, "run_id")
    ev = T.evaluate(r, t, c, gold, scenes, cons).withColumn("expected_pass", F.col("mutation").isin(*T.PASSING))
    got = {x["mutation"]: (x["n_passed"], x["agreement"]) for x in T.calibration(ev).collect()}
    # faults in what this task does not ask for (size, captions, order) can't be seen
    unseen = {"wrong_aspect_ratio", "wrong_subtitle", "wrong_order"}
    assert {m: a for m, (_, a) in got.items() if m not in unseen} == {m: 1.0 for m in T.MUTATIONS if m not in unseen}
    causes = {x["mutation"]: x["primary_failure"] for x in ev.collect()}
    assert causes["wrong_scene"] == "retrieval_error" and causes["loop"] == "loop_stagnation" and causes["false_refusal"] == "premature_refusal" and causes["recovery_failure"] == "budget_exhaustion"
    assert t.filter("run_id = 11 AND status = 'error'").count() == 1 and [x["start_ms"] for x in t.filter("run_id = 1 AND tool_name = 'trim_video'").collect()] == [3000]


def test_known_faults_are_written_once(spark, one):
    """The evaluator reads tables, not the joins that made them: else all its joins by run lie in the same tasks, each with its own memory."""
    runs, tools, cands, _, scenes, _ = one([run(i) for i in range(3)], sum((good(i) for i in range(3)), []), [(i, "v", 7, 0, 2000, 1) for i in range(3)])
    for before, after in zip((tools, cands), T.mutate(runs, tools, cands, scenes, "run_id")[1:], strict=True):
        plan = after._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        assert after.columns == before.columns


def test_public_view_and_facts(spark):
    rows = lambda part, n: spark.createDataFrame([(1, i, "k", f"{part} {i}") for i in range(n)], "run_id int, seq int, kind string, summary string")
    frames = spark.createDataFrame([(1, i, "k", f"frame {i % 5}") for i in range(20)], "run_id int, seq int, kind string, summary string")
    got = {}
    for r in T.public_view(rows("o", 20), rows("v", 3), rows("s", 9), frames).orderBy("part", "n").collect():
        got.setdefault(r["part"], []).append(r["seq"])
    assert got == {"observation": list(range(19, 11, -1)), "verification": [2, 1, 0], "scene": [0, 1, 2, 3, 4], "keyframe": [19, 18, 17, 16]}
    text = """[{"tool_name": "search_video", "status": "success", "details": {"response": {"candidates": [{"scene_id": "a", "time_range": {"start_ms": 0, "end_ms": 5}}, {"scene_id": "b"}, 7, {"scene_id": "c", "time_range": {"start_ms": 5, "end_ms": 5}}, {"scene_id": "d", "time_range": {"start_ms": 1, "end_ms": 2}}]}}}, 3, {"tool_name": "trim_video", "status": "error", "arguments": {"time_range": {"start_ms": 4, "end_ms": "x"}}}]"""
    runs = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (4, "[]")], "run_id int, records string")
    assert [(r["run_id"], r["pos"], r["tool_name"], r["start_ms"], r["end_ms"]) for r in T.tool_facts(runs).orderBy("pos").collect()] == [(1, 0, "search_video", None, None), (1, 2, "trim_video", 4, None)]
    assert [(r["pos"], r["scene_id"], r["rank"]) for r in T.search_candidates(runs).orderBy("rank").collect()] == [(0, "a", 1), (0, "d", 2)]
