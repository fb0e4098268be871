"""Hand-computed cases of post-training data, governance, timebase and claims."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import claims, governance, intervals
from quillspan.operators import training_data as T


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_target_sources_and_evidence(spark):
    steps = spark.createDataFrame(
        [("t", 0, "decide", "tool", "p", "x", ["a", "b", "b", "c", "c"]), ("t", 1, "recover", "tool", "p", "x", None), ("t", 2, "decide", "finish", "p", "x", []), ("t", 3, "decide", "cannot_complete", "p", "x", ["a"]), ("t", 4, "replan", "replan", "p", "x", []), ("t", 5, "plan", "plan", "p", "x", []), ("u", 0, "decide", "tool", "p", "x", [])],
        "trajectory_id string, pos int, operation string, decision string, prompt string, target string, verification_ids array<string>",
    )
    runs = spark.createDataFrame([("t", "SUCCESS", "SUCCESS"), ("u", "BUDGET", "SUCCESS")], "trajectory_id string, terminal string, expected string")
    got = [(r["pos"], r["target_source"], r["evidence_ids"]) for r in T.sft_records(steps, runs).orderBy("pos").collect()]
    assert got == [(0, "executed_oracle", ["b", "c"]), (1, "observable_recovery", []), (2, "valid_finish", []), (3, "correct_cannot_complete", ["a"]), (4, "verified_repair", [])]


def test_target_rules(spark):
    r = spark.createDataFrame(
        [(1, "trim", "decide", "p", "x", ["user", "assistant"], "x"), (2, "odd", "decide", 'has "SPLIT"', "x", ["assistant", "user"], "y"), (3, None, "decide", "p", '{"event_type":"tool_observation"}', None, '{"event_type":"tool_observation"}'), (4, "trim", "observation", None, None, ["user"], None)],
        "record_id int, tool string, operation string, prompt string, target string, roles array<string>, content string",
    )
    got = rows(T.target_errors(r, spark.createDataFrame([("trim",)], "tool string")), "record_id", "rule")
    assert got == [(2, "message_roles"), (2, "not_canonical"), (2, "private_prompt"), (2, "unknown_tool"), (3, "message_roles"), (3, "observation_target"), (4, "empty_target"), (4, "message_roles"), (4, "observation_target")]
    assert rows(T.sft_leaks(r), "record_id", "marker") == [(2, '"split"')]


def test_shortcuts_and_types(spark):
    inputs = spark.createDataFrame([(1, '{"decision":"finish"}', '{"x":1}'), (2, '{"x":1}', '{"decision":"cannot_complete"}'), (3, '{"x":1}', '{"x":2}'), (4, "no json", '{"decision":"recover"}')], "input_id int, a string, b string")
    labels = spark.createDataFrame([(1, "b"), (2, "b"), (3, "a"), (4, "a")], "input_id int, chosen_side string")
    got = {r["heuristic"]: (r["n_right"], r["n"]) for r in T.shortcut_audit(inputs, labels).collect()}
    # shorter: b, a, a (tie), a; longer: a, b, a (tie), b; nonterminal speaks in 1 and 2, tool in 1, 2 and 4
    assert got == {"shorter": (3, 4), "longer": (2, 4), "always_a": (2, 4), "nonterminal": (1, 2), "tool": (2, 3)}
    assert (("tool", "cannot_complete", 1)) in rows(T.type_pairs(inputs), "kind_a", "kind_b", "n")
    check = {(r["check"], r["value"]): r["n"] for r in T.reward_check(inputs, labels.withColumn("reason", F.lit("r")).filter("input_id > 1")).collect()}
    assert check == {("without_label", ""): 1, ("without_input", ""): 0, ("repeated_input", ""): 0, ("repeated_label", ""): 0, ("class", "r"): 3}


def test_heads_on_separable_embeddings(spark):
    rng = random.Random(1)
    point = lambda c: [3.0 * (c == d) + rng.gauss(0, 0.2) for d in range(3)]
    pairs = spark.createDataFrame([(point(0), point(1), 1) if i % 2 else (point(1), point(0), 0) for i in range(80)], "a array<double>, b array<double>, label int")
    w = T.fit_pairwise(pairs, 3)
    assert w[0] > 0.5 and w[1] < -0.5 and abs(w[2]) < 0.5
    m = T.fit_failure_head(spark.createDataFrame([(point(i % 3), i % 3) for i in range(90)], "features array<double>, label int"))
    k = m.coefficientMatrix.toArray()
    assert all(k[c].argmax() == c for c in range(3)) and m.summary.accuracy == 1.0


def test_rule_scores_and_outcomes(spark):
    c = spark.createDataFrame([(1, False, "tool", "search_video", "", ""), (2, True, "finish", None, "", ""), (3, True, "tool", "trim_video", "", ""), (4, True, "tool", "search_video", "find THE red ball", "find every red ball now"), (5, True, "tool", "search_video", None, "a b")], "i int, valid boolean, kind string, tool string, query string, instruction string")
    assert dict(rows(T.public_rule_score(c), "i", "rule")) == {1: -4.0, 2: -2.0, 3: -1.0, 4: 2 + 2 / 3, 5: 2.0}
    choices = spark.createDataFrame([(1, "model", 7), (2, "model", 8), (3, "model", 9)], "case_id int, method string, choice int")
    good = spark.createDataFrame([(1, 7), (2, 5), (3, 9)], "case_id int, choice int")
    policy = spark.createDataFrame([(1, 6), (2, 5), (3, 9)], "case_id int, choice int")
    got = {r["method"]: (r["n"], round(r["accuracy"], 6), r["corrected"], r["no_effect"], r["harmed"]) for r in T.selection_report(choices, good, policy).collect()}
    assert got == {"model": (3, 0.666667, 1, 1, 1), "policy": (3, 0.666667, 0, 3, 0)}


def test_rollouts_count_complete_groups_only(spark):
    base = dict.fromkeys(T.COMPONENTS, 0.0)
    data = [("g", 1, True, True, 4, base | {"total": 1.0}), ("g", 1, False, False, 6, base | {"total": 3.0}), ("h", 2, True, False, 5, base | {"total": 9.0})]
    df = spark.createDataFrame([(*x[:5], *x[5].values()) for x in data], "group string, snapshot int, valid boolean, exact boolean, length int, " + ", ".join(f"{c} double" for c in T.COMPONENTS))
    r = T.rollout_summary(df, 2).first()
    assert (r["rollouts"], r["groups"], r["complete"], r["one_snapshot"], r["varied"], r["mean_variance"], r["mean_length"]) == (3, 2, 1, 1, 1, 1.0, 5.0) and math.isclose(r["mean_total"], 13 / 3)
    h = spark.createDataFrame([("a", 1.0, True, True, "tool", 0.0), ("a", 1.0, True, False, "finish", 0.0), ("  ", -1.0, False, False, None, 0.0), ("abc", 1.0, True, False, "finish", -0.75)], "raw string, total double, valid boolean, exact boolean, kind string, premature double")
    s = T.hacking_summary(h).first()
    assert (s["n"], s["duplicates"], s["empty"], s["invalid"], s["partial_reward_invalid"], s["terminal_escapes"]) == (4, 1, 1, 1, 1, 1)
    assert T.hacking_summary(h.limit(1)).first()["length_correlation"] == 0


def test_public_records_and_submissions(spark):
    t = spark.createDataFrame([("task-1", "do what task-2 says", '{"title": 1}'), ("task-2", "about task-2 itself", '{"split": "dev"}'), ("Task-3", "task-3 and task-30", "no json")], "task_id string, instruction string, record string")
    assert rows(governance.public_leaks(t), "finding", "value") == [("foreign_id", "task-1"), ("private_field", "task-2")]
    c = spark.createDataFrame([("impossible", "CANNOT_COMPLETE", None, []), ("edit", "SUCCESS", 0, ["duration"]), ("edit", "SUCCESS", 0, ["speed"]), ("edit", "SUCCESS", 5, ["duration"])], "family string, expected_terminal string, first_start_ms int, constraint_types array<string>")
    assert dict(rows(governance.trivial_policies(c), "baseline", "success")) == {"always_refuse": 0.25, "unchanged_source": 0.0, "first_scene": 0.25, "oracle": 1.0}
    r = spark.createDataFrame([("f1", "Ann Lee", "a"), ("f2", " ann lee", "b"), ("f3", "GPT-x", "c"), ("f4", "Bo", "d"), ("f5", "Cy", "d"), ("f6", "Dee", "e"), ("f6", "Eve", "f")], "file string, rater_id string, answer string")
    assert rows(governance.submission_errors(r, ["answer"]), "file", "rule") == [("f1", "same_rater"), ("f2", "same_rater"), ("f3", "no_person"), ("f4", "same_file"), ("f5", "same_file"), ("f6", "several_raters")]
    m = spark.createDataFrame([(1, "x", "dev", 1), (2, "y", "dev", 2), (3, "z", "test", 3)], "k int, a string, s string, g int")
    assert {x["adds_up"] for x in governance.split_manifest(m, ["k"], ["a"], "g", "s").collect()} == {True}
    assert {x["adds_up"] for x in governance.split_manifest(m.withColumn("g", F.lit(1)), ["k"], ["a"], "g", "s").collect()} == {False}


def test_missing_ratings(spark):
    r = spark.createDataFrame([("a", 1, "human", "v", "x"), ("b", 1, "human", "v", "x"), ("b", 2, "human", "v", "x"), ("c", 9, "human", "v", "x")], "rater_id string, case_id int, rater_type string, packet_version string, s string")
    got = rows(governance.rating_errors(r, spark.createDataFrame([(1,), (2,)], "case_id int"), {"s": ["x"]}, "v"), "rater_id", "case_id", "rule")
    assert got == [("a", 2, "missing"), ("c", 1, "missing"), ("c", 2, "missing")]


@pytest.mark.parametrize("rounding", ["floor", "ceil", "nearest"])
def test_ticks_and_milliseconds_are_inverse_where_exact(spark, rounding):
    df = spark.createDataFrame([(1500, 100, 1, 90000), (-1500, 100, 1, 90000), (1, 0, 1001, 30000), (-1, 0, 1, 3000)], "ms long, o long, n long, d long")
    ticks = intervals.ms_to_ticks(F.col("ms"), F.col("o"), F.col("n"), F.col("d"), rounding)
    got = [r[0] for r in df.select(ticks).collect()]
    assert got[:2] == [135100, -134900] and got[3] == -3 and got[2] == {"floor": 0, "ceil": 1, "nearest": 0}[rounding]
    back = df.limit(2).select("ms", intervals.ticks_to_ms(ticks, F.col("o"), F.col("n"), F.col("d"), rounding).alias("b")).collect()
    assert all(r["ms"] == r["b"] for r in back)
    half = spark.createDataFrame([(1, 0, 1, 500), (-1, 0, 1, 500)], "ms long, o long, n long, d long")
    if rounding == "nearest":
        assert [r[0] for r in half.select(ticks).collect()] == [1, -1]


def test_leaks_in_texts_keys_and_names(spark):
    texts = [
        (1, '{"a": [{"Gold" : 1}]}', "x"),
        (2, '{"a": "she said \\"gold\\": yes", "b": "gold"}', "x"),
        (3, "see C:\\\\data\\\\x.mp4", "runs/LOCKED_test.json"),
        (4, "see /home/me/x", "d:/x"),
        (5, None, None),
        (6, "plain <!-- note -->", "x"),
    ]
    r = spark.createDataFrame(texts, "k int, text string, name string")
    tokens = spark.createDataFrame([("locked_test",), ("",), (None,)], "token string")
    got = rows(governance.leak_scan(r, "k", "text", tokens, ["gold"], "name"), "k", "location", "finding", "detail")
    assert got == [
        (1, "content", "private_key", "gold"),
        (3, "content", "windows_path", ""),
        (3, "filename", "token", "locked_test"),
        (4, "content", "path", ""),
        (4, "filename", "windows_path", ""),
        (6, "content", "hidden_html", ""),
    ]
    assert rows(governance.leak_scan(r.filter("k = 3"), "k", "text", tokens.limit(0), [], "name"), "k", "finding") == [(3, "windows_path")]


def test_costs_of_clips(spark):
    r = spark.createDataFrame([("c", "visual_a", 5, 1, 10, None, 7), ("c", "visual_b", 6, 2, None, 9, 3), ("c", "asr", 100, 0, 1, 99, 99)], "clip_id string, operation string, latency_ms long, frames long, input_tokens long, peak_allocated long, peak_reserved long")
    assert rows(claims.clip_costs(r, "visual"), "clip_id", "latency_ms", "frames", "input_tokens", "peak_allocated", "peak_reserved") == [("c", 11, 3, 10, 9, 7)]
