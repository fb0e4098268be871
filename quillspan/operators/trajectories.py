"""Trajectory evaluation: facts, constraints, failure causes, recovery.

Tables: runs (run_id, task_id, variant, terminal_reason, source_artifact_id, final_artifact_id, duration_ms, width, height, has_video, has_audio);
tools (run_id, pos, tool_name, status, output_artifact_id, inputs array, start_ms, end_ms, text, speed); candidates (run_id, video_id, scene_id, start_ms, end_ms, rank);
gold (task_id, family, expected_terminal, required_tools array, unsolved_cause); gold_scenes (task_id, pos, video_id, scene_id, start_ms, end_ms);
constraints (task_id, pos, type, mandatory, target_ms, tolerance_ms, width, height, text, start_ms, end_ms, speed, require_video, require_audio).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.intervals import iou
from quillspan.operators.intervals import differences
from quillspan.plans.scratch import materialize


def _iou(a: str, b: str) -> Column:
    return iou(F.col(f"{a}_start"), F.col(f"{a}_end"), F.col(f"{b}_start"), F.col(f"{b}_end"))


def public_view(observations: DataFrame, verifications: DataFrame, scenes: DataFrame, keyframes: DataFrame, last: int = 8, first_scenes: int = 5, frames: int = 4) -> DataFrame:
    """What a policy may see of each run: run_id, part, n, seq, kind, summary; only public columns.

    The last ``last`` observations and verifications, newest first; the first ``first_scenes`` retrieved scenes; up to ``frames`` distinct key frames,
    newest first. All four tables: run_id, seq, kind, summary; a key frame's summary names it."""
    newest, oldest = F.col("seq").desc(), F.col("seq").asc()
    once = keyframes.groupBy("run_id", "summary").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"))

    def cut(df: DataFrame, part: str, order: Column, most: int) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("run_id").orderBy(order, "summary"))
        return df.select("run_id", F.lit(part).alias("part"), n.alias("n"), "seq", "kind", "summary").filter(F.col("n") <= most)

    parts = cut(observations, "observation", newest, last).unionByName(cut(verifications, "verification", newest, last))
    return parts.unionByName(cut(scenes, "scene", oldest, first_scenes)).unionByName(cut(once, "keyframe", newest, frames))


def tool_facts(runs: DataFrame) -> DataFrame:
    """One row a tool record of run_id, records (JSON text of an array): pos, tool_name, status, start_ms, end_ms; records
    that are no objects or name no tool are skipped, and so are fields of another type."""
    r = runs.select("run_id", F.posexplode(F.try_parse_json("records").cast("array<variant>")).alias("pos", "v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return r.select("run_id", "pos", get("$.tool_name", "string").alias("tool_name"), get("$.status", "string").alias("status"), get("$.arguments.time_range.start_ms", "long").alias("start_ms"), get("$.arguments.time_range.end_ms", "long").alias("end_ms")).filter("tool_name IS NOT NULL")


def search_candidates(runs: DataFrame) -> DataFrame:
    """One row a candidate of the successful searches of run_id, records: pos, rank (from 1, over the well-formed ones of all searches of the
    call), video_id, scene_id, start_ms, end_ms; candidates without a scene or a range that holds something are skipped."""
    r = runs.select("run_id", F.posexplode(F.try_parse_json("records").cast("array<variant>")).alias("pos", "v"))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    s = r.filter((get("v", "$.tool_name", "string") == "search_video") & (get("v", "$.status", "string") == "success"))
    c = s.select("run_id", "pos", F.posexplode(get("v", "$.details.response.candidates", "array<variant>")).alias("i", "c"))
    c = c.select("run_id", "pos", "i", get("c", "$.video_id", "string").alias("video_id"), get("c", "$.scene_id", "string").alias("scene_id"), get("c", "$.time_range.start_ms", "long").alias("start_ms"), get("c", "$.time_range.end_ms", "long").alias("end_ms"))
    good = c.filter("scene_id IS NOT NULL AND start_ms < end_ms")
    return good.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "pos").orderBy("i"))).drop("i")


def final_media(validations: DataFrame, runs: DataFrame) -> DataFrame:
    """Media details of the last successful validation that names the final artifact of a run."""
    j = validations.filter("status = 'success'").join(runs.select("run_id", F.col("final_artifact_id").alias("artifact_id")), ["run_id", "artifact_id"])
    return j.groupBy("run_id").agg(F.max_by("details", "pos").alias("details"))


def retrieval_metrics(runs: DataFrame, candidates: DataFrame, gold_scenes: DataFrame) -> DataFrame:
    """run_id, n_scenes, recall_1, recall_5 (fractions of relevant scenes), mrr, iou (mean best top-1)."""
    g = gold_scenes.select("task_id", F.col("pos").alias("g_pos"), F.col("scene_id").alias("g_scene"), F.col("start_ms").alias("g_start"), F.col("end_ms").alias("g_end"))
    videos = gold_scenes.groupBy("task_id").agg(F.collect_set("video_id").alias("videos"))
    need = runs.select("run_id", "task_id").join(g, "task_id")
    c = candidates.select("run_id", F.col("video_id"), "scene_id", "rank", F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"))
    j = need.join(videos, "task_id").join(c, "run_id", "left").withColumn("x", F.coalesce(_iou("c", "g"), F.lit(0.0))).withColumn("in", F.coalesce(F.array_contains("videos", F.col("video_id")), F.lit(False)))
    match = F.col("in") & ((F.col("scene_id") == F.col("g_scene")) | (F.col("x") >= 0.5))
    per = j.groupBy("run_id", "g_pos").agg(F.min(F.when(match, F.col("rank"))).alias("best"), F.coalesce(F.max(F.when(F.col("in") & (F.col("rank") == 1), F.col("x"))), F.lit(0.0)).alias("top"))
    avg = per.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.avg(F.coalesce((F.col("best") == 1).cast("double"), F.lit(0.0))).alias("recall_1"),
        F.avg(F.coalesce((F.col("best") <= 5).cast("double"), F.lit(0.0))).alias("recall_5"),
        F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"),
        F.avg("top").alias("iou"),
    )
    return runs.select("run_id").join(avg, "run_id", "left").fillna(0).fillna(0.0)


def order_satisfied(runs: DataFrame, tools: DataFrame, gold_scenes: DataFrame) -> DataFrame:
    """run_id of runs with a successful concat whose inputs, through their trims, match the gold scenes in order at IoU >= 0.9."""
    ok = tools.filter("status = 'success'")
    trims = ok.filter("tool_name = 'trim_video'").select("run_id", F.col("output_artifact_id").alias("input"), F.struct("pos", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).alias("t"))
    trims = trims.groupBy("run_id", "input").agg(F.max("t").alias("t")).select("run_id", "input", F.col("t.s").alias("t_start"), F.col("t.e").alias("t_end"))
    concat = ok.filter("tool_name = 'concat_videos'").select("run_id", F.col("pos").alias("call"), F.size("inputs").alias("n"), F.posexplode("inputs").alias("i", "input"))
    gold = runs.select("run_id", "task_id").join(gold_scenes.select("task_id", F.col("pos").alias("i"), F.col("start_ms").alias("g_start"), F.col("end_ms").alias("g_end")), "task_id")
    wanted = gold.groupBy("run_id").agg(F.count(F.lit(1)).alias("wanted"))
    j = concat.join(trims, ["run_id", "input"]).join(gold, ["run_id", "i"]).filter(_iou("t", "g") >= 0.9)
    hits = j.groupBy("run_id", "call", "n").agg(F.count(F.lit(1)).alias("hits")).join(wanted, "run_id")
    return hits.filter((F.col("hits") == F.col("n")) & (F.col("n") == F.col("wanted"))).select("run_id").distinct()


def constraint_results(runs: DataFrame, tools: DataFrame, gold_scenes: DataFrame, constraints: DataFrame) -> DataFrame:
    """run_id, pos, type, mandatory, satisfied."""
    c = runs.join(constraints.select("task_id", *[F.col(x).alias(f"c_{x}") for x in constraints.columns if x != "task_id"]), "task_id")
    ok = tools.filter("status = 'success'")
    trims = ok.filter("tool_name = 'trim_video'").select("run_id", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"))
    g = runs.select("run_id", "task_id").join(gold_scenes.select("task_id", F.col("pos").alias("gp"), F.col("start_ms").alias("g_start"), F.col("end_ms").alias("g_end")), "task_id")
    per = g.join(trims, "run_id", "left").groupBy("run_id", "gp").agg(F.coalesce(F.max(_iou("t", "g")), F.lit(0.0)).alias("best"))
    grounded = per.groupBy("run_id").agg((F.min("best") >= 0.9).alias("grounded"))
    subs = ok.filter("tool_name = 'add_subtitles'").select("run_id", F.struct("text", "start_ms", "end_ms").alias("cue")).groupBy("run_id").agg(F.collect_set("cue").alias("cues"))
    speeds = ok.filter("tool_name = 'change_speed'").groupBy("run_id").agg(F.collect_set("speed").alias("speeds"))
    order = order_satisfied(runs, tools, gold_scenes).withColumn("ordered", F.lit(True))
    j = c.join(grounded, "run_id", "left").join(subs, "run_id", "left").join(speeds, "run_id", "left").join(order, "run_id", "left")
    t = F.col("c_type")
    satisfied = (
        F.when(t == "grounding", F.coalesce("grounded", F.lit(True)))
        .when(t == "duration", F.abs(F.col("duration_ms") - F.col("c_target_ms")) <= F.col("c_tolerance_ms"))
        .when(t == "resolution", (F.col("width") == F.col("c_width")) & (F.col("height") == F.col("c_height")))
        .when(t == "subtitle", F.array_contains("cues", F.struct(F.col("c_text").alias("text"), F.col("c_start_ms").alias("start_ms"), F.col("c_end_ms").alias("end_ms"))))
        .when(t == "scene_order", F.col("ordered"))
        .when(t == "speed", F.array_contains("speeds", F.col("c_speed")))
        .when(t == "streams", (~F.col("c_require_video") | F.col("has_video")) & (~F.col("c_require_audio") | F.col("has_audio")))
        .when(t == "derived_artifact", F.col("final_artifact_id").isNotNull() & ~F.col("final_artifact_id").eqNullSafe(F.col("source_artifact_id")))
        .when(t == "absence", F.col("terminal_reason") == "CANNOT_COMPLETE")
    )
    return j.select("run_id", F.col("c_pos").alias("pos"), t.alias("type"), F.col("c_mandatory").alias("mandatory"), F.coalesce(satisfied, F.lit(False)).alias("satisfied"))


def evaluate(runs: DataFrame, tools: DataFrame, candidates: DataFrame, gold: DataFrame, gold_scenes: DataFrame, constraints: DataFrame, all_calls: bool = False) -> DataFrame:
    """One row a run with its rates, flags, task success, primary failure cause and, beside invalid arguments, a premature
    refusal as the secondary one.

    ``all_calls`` is the earlier protocol (E7): required tools may be met by calls that failed."""
    ok = F.col("status") == "success"
    per = tools.groupBy("run_id").agg(
        F.collect_set(F.col("tool_name") if all_calls else F.when(ok, F.col("tool_name"))).alias("used"),
        F.count(F.lit(1)).alias("n_tools"),
        F.count_if(F.col("status") == "invalid").alias("n_invalid"),
        F.count_if(~ok).alias("n_failed"),
        F.count_if(F.col("tool_name") == "search_video").alias("n_search"),
        F.min(F.when(~ok, F.col("pos"))).alias("first_failure"),
        F.max(F.when(ok, F.col("pos"))).alias("last_success"),
    )
    cons = constraint_results(runs, tools, gold_scenes, constraints).filter("mandatory").groupBy("run_id").agg(
        F.avg(F.col("satisfied").cast("double")).alias("satisfaction"), F.min("satisfied").alias("all_mandatory"), F.collect_set(F.when(~F.col("satisfied"), F.col("type"))).alias("broken")
    )
    none = F.array().cast("array<string>")
    j = (
        runs.join(gold, "task_id").join(per, "run_id", "left").join(cons, "run_id", "left").join(retrieval_metrics(runs, candidates, gold_scenes), "run_id")
        .fillna(0, ["n_tools", "n_invalid", "n_failed", "n_search"])
        .withColumns({"used": F.coalesce("used", none), "broken": F.coalesce("broken", none), "all_mandatory": F.coalesce("all_mandatory", F.lit(True))})
    )
    refuse = F.col("expected_terminal") == "CANNOT_COMPLETE"
    reason = F.coalesce("terminal_reason", F.lit(""))
    both, either = F.array_intersect("required_tools", "used"), F.array_union("required_tools", "used")
    j = j.withColumns(
        {
            "correct_termination": reason == F.col("expected_terminal"),
            "correct_refusal": refuse & (reason == "CANNOT_COMPLETE") & F.col("final_artifact_id").isNull(),
            "correct_artifact": F.when(refuse, F.col("final_artifact_id").isNull()).otherwise(F.col("final_artifact_id").isNotNull() & F.col("duration_ms").isNotNull()),
            "tools_satisfied": F.size(F.array_except("required_tools", "used")) == 0,
            "tool_selection": F.size(both) / F.greatest(F.size(either), F.lit(1)),
            "argument_validity": (F.col("n_tools") - F.col("n_invalid")) / F.greatest("n_tools", F.lit(1)),
            "recovery_opportunity": F.col("n_failed") > 0,
            "later_success": F.coalesce(F.col("last_success") > F.col("first_failure"), F.lit(False)),
        }
    )
    base = F.col("all_mandatory") & F.col("tools_satisfied")
    j = j.withColumn("task_success", F.when(refuse, F.col("correct_refusal") & base).otherwise(F.col("correct_termination") & F.col("correct_artifact") & base))
    has = lambda *ts: F.arrays_overlap("broken", F.array(*[F.lit(t) for t in ts]))
    cause = (
        F.when(F.col("task_success"), F.lit(None).cast("string"))
        .when(reason == "MODEL_OUTPUT_FAILURE", "model_format_error")
        .when(reason == "BUDGET_EXHAUSTED", "budget_exhaustion")
        .when(reason == "LOOP_DETECTED", "loop_stagnation")
        .when(F.col("n_invalid") > 0, "invalid_arguments")
        .when(F.col("n_failed") > 0, "tool_execution_failure")
        .when((reason == "CANNOT_COMPLETE") & (F.col("expected_terminal") == "SUCCESS"), "premature_refusal")
        .when((reason == "SUCCESS") & (F.col("expected_terminal") != "SUCCESS"), "premature_finish")
        .when(~F.col("tools_satisfied"), "wrong_tool")
        .when((F.col("n_scenes") > 0) & (F.col("recall_5") < 1), "retrieval_error")
        .when(has("grounding"), "retrieval_error")
        .when(~F.col("correct_artifact"), "handoff_error")
        .when(has("duration", "resolution", "subtitle", "scene_order", "speed"), "invalid_arguments")
        .when(~F.col("correct_termination"), F.col("unsolved_cause"))
        .otherwise("verification_error")
    )
    refused = ~F.col("task_success") & (cause == "invalid_arguments") & (F.col("n_invalid") > 0) & (reason == "CANNOT_COMPLETE")
    return j.withColumns({"primary_failure": cause, "secondary_failure": F.when(refused, "premature_refusal")})


def summarize(evaluations: DataFrame) -> DataFrame:
    """Metric, value: means over all, conditional means (null without base rows), success by family, failure counts."""
    d = lambda c: F.col(c).cast("double")
    means = {c: F.avg(d(c)) for c in ("task_success", "satisfaction", "correct_artifact", "recall_1", "recall_5", "mrr", "iou", "tool_selection", "argument_validity", "n_tools", "n_search", "correct_termination")}
    means["impossible_refusal"] = F.avg(F.when(F.col("family") == "impossible", d("correct_refusal")))
    means["recovery_success"] = F.avg(F.when(F.col("recovery_opportunity"), d("task_success")))
    means["recovery_opportunities"] = F.count_if("recovery_opportunity").cast("double")
    one = evaluations.agg(*[v.alias(k) for k, v in means.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in means])).alias("x")).select("x.*")
    family = evaluations.groupBy("family").agg(F.avg(d("task_success")).alias("value")).select(F.concat(F.lit("family:"), "family").alias("metric"), "value")
    failures = evaluations.filter("primary_failure IS NOT NULL").groupBy("primary_failure").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rows.unionByName(family).unionByName(failures.select(F.concat(F.lit("failure:"), "primary_failure").alias("metric"), "value"))


# The tools that change media, and whose fault each failure cause is.
EDITING = ("trim_video", "concat_videos", "change_speed", "add_subtitles", "reframe_video", "normalize_audio")
ORIGINS = {
    "protocol": ("handoff_error", "recovery_patch_error", "verification_error", "system_error"),
    "policy": ("planning_error", "wrong_tool", "invalid_arguments", "recovery_decision_error", "premature_success", "premature_refusal", "loop_stagnation", "budget_exhaustion", "model_format_error", "tool_execution_failure"),
    "upstream": ("retrieval_error", "upstream_perception_error"),
}


def first_error(tools: DataFrame, runs: DataFrame, gold: DataFrame, gold_scenes: DataFrame, hits: DataFrame) -> DataFrame:
    """run_id, pos, cause of the first observable error of each run that has one. In this order a call counts as an error if it
    failed; if it is a search without a hit, or whose first hit meets no relevant range at IoU 0.9; if it is a trim without a range or
    whose range meets none; if it is an editing tool that the task does not require. Tasks without relevant ranges skip the range rules.

    hits: run_id, pos (of the search), rank, start_ms, end_ms."""
    ranges = gold_scenes.groupBy("task_id").agg(F.collect_set(F.struct("start_ms", "end_ms")).alias("ranges"))  # scenes of one task
    top = hits.groupBy("run_id", "pos").agg(F.min_by(F.struct("start_ms", "end_ms"), "rank").alias("top"))
    t = tools.join(runs.select("run_id", "task_id"), "run_id").join(gold.select("task_id", "required_tools"), "task_id").join(ranges, "task_id", "left").join(top, ["run_id", "pos"], "left")
    own = F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), F.struct("start_ms", "end_ms"))
    tool, wanted = F.col("tool_name"), F.col("ranges").isNotNull()
    meets = lambda x: F.exists("ranges", lambda g: iou(x["start_ms"], x["end_ms"], g["start_ms"], g["end_ms"]) >= 0.9)
    cause = F.coalesce(
        F.when(F.col("status") == "invalid", "invalid_arguments").when(F.col("status") != "success", "tool_execution_failure"),
        F.when((tool == "search_video") & wanted, F.when(F.col("top").isNull(), "upstream_perception_error").when(~meets(F.col("top")), "retrieval_error")),
        F.when((tool == "trim_video") & wanted & F.coalesce(~meets(own), F.lit(True)), "invalid_arguments"),
        F.when(tool.isin(*EDITING) & ~F.array_contains("required_tools", tool), "wrong_tool"),
    )
    return t.withColumn("cause", cause).filter("cause IS NOT NULL").groupBy("run_id").agg(F.min("pos").alias("pos"), F.min_by("cause", "pos").alias("cause"))


def recovery(evaluations: DataFrame, tools: DataFrame, errors: DataFrame, steps: DataFrame) -> DataFrame:
    """The evaluations with first_error, opportunity, attempted, succeeded, attempts, decision_validity, patch_acceptance, n_rejected, and extra_steps
    and extra_latency after the first error (null where no recovery was attempted).

    evaluations: run_id, task_success, expected_terminal, designed (the task offers a recovery); steps: run_id, step, operation, call_pos (the
    tool call that it made), valid (false for a policy failure), accepted (of its patch, else null), latency_ms. A recovery is attempted where
    the policy replans or recovers, or calls a tool after the error."""
    again = F.col("operation").isin("replan", "recover")
    tries = steps.groupBy("run_id").agg(
        F.count_if(again).alias("attempts"),
        F.count_if(again & F.col("valid")).alias("n_valid"),
        F.count_if(again & F.col("valid") & F.coalesce("accepted", F.lit(False))).alias("n_accepted"),
        F.count_if(again & F.col("valid") & ~F.coalesce("accepted", F.lit(True))).alias("n_rejected"),
    )
    at = errors.select("run_id", F.col("pos").alias("at"), F.col("cause").alias("first_error"))
    later_tools = tools.join(at, "run_id").filter("pos > at").groupBy("run_id").agg(F.count(F.lit(1)).alias("later_tools"), F.sum("latency_ms").alias("tool_ms"))
    first = steps.filter("valid").join(at, "run_id").filter("call_pos = at").groupBy("run_id").agg(F.min("step").alias("first_step"))
    later = steps.join(first, "run_id").filter("step > first_step").groupBy("run_id").agg(F.count(F.lit(1)).alias("later_steps"), F.sum("latency_ms").alias("step_ms"))
    j = evaluations.join(at, "run_id", "left").join(tries, "run_id", "left").join(later_tools, "run_id", "left").join(later, "run_id", "left")
    j = j.fillna(0, ["attempts", "n_valid", "n_accepted", "n_rejected", "later_tools", "tool_ms", "later_steps", "step_ms"])
    opportunity = F.col("at").isNotNull() & F.col("designed") & (F.col("expected_terminal") == "SUCCESS")
    attempted = opportunity & ((F.col("attempts") > 0) | (F.col("later_tools") > 0))
    return j.withColumns(
        {
            "opportunity": opportunity,
            "attempted": attempted,
            "succeeded": attempted & F.col("task_success"),
            "decision_validity": F.when(F.col("attempts") > 0, F.col("n_valid") / F.col("attempts")),
            "patch_acceptance": F.when(F.col("n_valid") > 0, F.col("n_accepted") / F.col("n_valid")),
            "extra_steps": F.when(attempted, F.col("later_steps")),
            "extra_latency": F.when(attempted, F.col("step_ms") + F.col("tool_ms")),
        }
    ).drop("at", "n_valid", "n_accepted", "later_tools", "tool_ms", "later_steps", "step_ms")


def attributed(recoveries: DataFrame) -> DataFrame:
    """Recoveries with failure, the primary cause by ordered rules; needs terminal_reason, primary_failure (E5) and repeated_editor."""
    reason = F.coalesce("terminal_reason", F.lit(""))
    cause = (
        F.when(F.col("task_success"), F.lit(None).cast("string"))
        .when(reason == "MODEL_OUTPUT_FAILURE", "model_format_error")
        .when(reason == "SYSTEM_ERROR", "system_error")
        .when(reason == "BUDGET_EXHAUSTED", "budget_exhaustion")
        .when(reason == "LOOP_DETECTED", F.when(F.col("repeated_editor"), "handoff_error").otherwise("loop_stagnation"))
        .when((reason == "CANNOT_COMPLETE") & (F.col("expected_terminal") == "SUCCESS"), "premature_refusal")
        .when((reason == "SUCCESS") & (F.col("expected_terminal") != "SUCCESS"), "premature_success")
        .when(F.col("n_rejected") > 0, "recovery_patch_error")
        .when(F.col("first_error").isNotNull(), F.col("first_error"))
        .when(F.col("primary_failure").isin("verification_error", "wrong_tool"), F.col("primary_failure"))
        .otherwise("planning_error")
    )
    return recoveries.withColumn("failure", cause)


def recovery_summary(recoveries: DataFrame) -> DataFrame:
    """Metric, value of attributed recoveries: rates over opportunities and over attempts, medians over attempted rows, means of validity
    and acceptance where there are any, the share of each origin among the failures, successes by category (``family``)."""
    d = lambda c: F.col(c).cast("double")
    rates = {
        "opportunities": F.count_if("opportunity").cast("double"),
        "attempt_rate": F.avg(F.when(F.col("opportunity"), d("attempted"))),
        "success_rate": F.avg(F.when(F.col("opportunity"), d("succeeded"))),
        "conditional_success": F.avg(F.when(F.col("attempted"), d("succeeded"))),
        "decision_validity": F.avg("decision_validity"),
        "patch_acceptance": F.avg("patch_acceptance"),
        "median_extra_steps": F.median(F.when(F.col("attempted"), F.col("extra_steps"))),
        "median_extra_latency": F.median(F.when(F.col("attempted"), F.col("extra_latency"))),
    }
    for origin, causes in ORIGINS.items():
        rates[f"origin:{origin}"] = F.count_if(F.col("failure").isin(*causes)) / F.greatest(F.count("failure"), F.lit(1))
    one = recoveries.agg(*[v.alias(k) for k, v in rates.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in rates])).alias("x")).select("x.*")
    category = recoveries.groupBy("family").agg(F.avg(d("task_success")).alias("value")).select(F.concat(F.lit("category:"), "family").alias("metric"), "value")
    return rows.unionByName(category)


def protocol_rates(steps: DataFrame, diagnostics: DataFrame, tools: DataFrame, errors: DataFrame) -> DataFrame:
    """Per run of the earlier protocol: structured_validity (valid steps of all inferences), repair_rate (inferences that were repaired),
    repeated_rate (repeat diagnostics by valid step), and after the first error the further tool calls, steps and latency.

    steps: as in E9 with repairs; diagnostics: run_id, kind."""
    per = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("inferences"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("repairs") > 0).alias("repaired"))
    repeats = diagnostics.filter(F.col("kind").isin("identical_tool_call", "no_information_gain")).groupBy("run_id").agg(F.count(F.lit(1)).alias("repeats"))
    at = errors.select("run_id", F.col("pos").alias("at"))
    later_tools = tools.join(at, "run_id").filter("pos > at").groupBy("run_id").agg(F.count(F.lit(1)).alias("extra_calls"), F.sum("latency_ms").alias("tool_ms"))
    first = steps.filter("valid").join(at, "run_id").groupBy("run_id").agg(F.min(F.when(F.col("call_pos") == F.col("at"), F.col("step"))).alias("first_step"))
    # without the step that made the call, all steps count as later ones
    later = steps.join(first, "run_id").filter("step > coalesce(first_step, -1)").groupBy("run_id").agg(F.count(F.lit(1)).alias("extra_steps"), F.sum("latency_ms").alias("step_ms"))
    j = per.join(repeats, "run_id", "left").join(later_tools, "run_id", "left").join(later, "run_id", "left")
    tail = F.col("extra_calls").isNotNull()
    return j.select(
        "run_id",
        (F.col("n_valid") / F.greatest("inferences", F.lit(1))).alias("structured_validity"),
        (F.col("repaired") / F.greatest("inferences", F.lit(1))).alias("repair_rate"),
        (F.coalesce("repeats", F.lit(0)) / F.greatest("n_valid", F.lit(1))).alias("repeated_rate"),
        "extra_calls",
        F.when(tail, F.coalesce("extra_steps", F.lit(0))).alias("extra_steps"),
        F.when(tail, F.col("tool_ms") + F.coalesce("step_ms", F.lit(0))).alias("extra_latency"),
    )


def repeated_edit_rate(edits: DataFrame) -> DataFrame:
    """Per run: share of edits equal (tool, arguments, parents) to an earlier one."""
    w = Window.partitionBy("run_id", "tool_name", "arguments", "parents").orderBy("pos")
    return edits.withColumn("n", F.row_number().over(w)).groupBy("run_id").agg(F.avg((F.col("n") > 1).cast("double")).alias("repeated_rate"), F.count(F.lit(1)).alias("edits"))


def funnel(stages: DataFrame, names: list[str]) -> DataFrame:
    """Highest level reached: stages are boolean columns in order, a level counts only if all before it hold."""
    level, all_before = F.lit(0), F.lit(True)
    for i, n in enumerate(names, 1):
        all_before = all_before & F.coalesce(F.col(n), F.lit(False))
        level = F.when(all_before, i).otherwise(level)
    return stages.withColumn("level", level)


def recovery_failure(runs: DataFrame) -> DataFrame:
    """Runs with recovery_failure, the first of these that holds, else null.

    runs: triggered, n_format_errors, decided, appropriate and accepted (null if unknown), executable, attempted, terminal_reason, useful,
    repaired, task_success."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    wrong = lambda c: ~F.coalesce(c, F.lit(True))
    cause = (
        F.when(no("triggered"), "recovery_not_triggered")
        .when(F.coalesce("n_format_errors", F.lit(0)) > 0, "recovery_format_error")
        .when(no("decided"), "recovery_not_triggered")
        .when(wrong("appropriate"), "recovery_wrong_operation")
        .when(wrong("accepted"), "recovery_invalid_patch")
        .when(no("executable") | no("attempted"), "recovery_no_state_change")
        .when(F.col("terminal_reason") == "BUDGET_EXHAUSTED", "recovery_budget_exhaustion")
        .when(no("useful"), "recovery_wrong_tool_after_patch")
        .when(no("repaired"), "recovery_repeat_failure")
        .when(no("task_success"), "recovery_success_but_task_failed_later")
    )
    return runs.withColumn("recovery_failure", cause)


def funnel_summary(levels: DataFrame, top: int, by: str) -> DataFrame:
    """Per group and over all: runs, cumulative counts of each level, runs whose highest level it is, and rates given the level before."""
    c = [F.count_if(F.col("level") >= k).alias(f"at_least_{k}") for k in range(1, top + 1)]
    h = [F.count_if(F.col("level") == k).alias(f"highest_{k}") for k in range(top + 1)]
    out = levels.groupingSets([[], [F.col(by)]], by).agg(F.count(F.lit(1)).alias("n"), *c, *h).withColumn(by, F.coalesce(by, F.lit("all")))
    rates = {f"rate_{k}": F.when(F.col("n" if k == 1 else f"at_least_{k - 1}") > 0, F.col(f"at_least_{k}") / F.col("n" if k == 1 else f"at_least_{k - 1}")) for k in range(1, top + 1)}
    return out.withColumns(rates)


def tool_cases(cases: DataFrame) -> DataFrame:
    """Per tool: cases, success and expected-outcome rates, error median and p95 (nearest rank), latency median and p95."""
    p95 = lambda c: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")
    return cases.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("status") == "success").cast("double")).alias("success"),
        F.avg((F.col("status") == F.col("expected")).cast("double")).alias("as_expected"),
        F.median("error_ms").alias("error_median"),
        p95("error_ms").alias("error_p95"),
        F.median("latency_ms").alias("latency_median"),
        p95("latency_ms").alias("latency_p95"),
    )


STAGE_TIMES = ("policy_ms", "recovery_policy_ms", "retrieval_ms", "editing_ms", "verification_ms")


def run_performance(runs: DataFrame, steps: DataFrame, tools: DataFrame) -> DataFrame:
    """Per variant: p50 and p95 of the run latency at index ``round((n - 1) q)`` (halves to even), total and mean, totals of each stage,
    latency an inference, tokens a valid step, memory peaks of valid steps, cache hits and misses of tools.

    runs: variant, run_id, latency_ms, STAGE_TIMES; steps: variant, valid, latency_ms, input_tokens, output_tokens, peak_allocated, peak_reserved; tools:
    variant, cache_hit."""
    w = Window.partitionBy("variant").orderBy("latency_ms", "run_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("variant"))
    r = runs.withColumns({"i": F.row_number().over(w) - 1, "n": n})
    at = lambda q: F.max(F.when(F.col("i") == F.bround((F.col("n") - 1) * q, 0).cast("int"), F.col("latency_ms")))
    times = [F.sum(c).alias(f"total_{c}") for c in STAGE_TIMES]
    per_run = r.groupBy("variant").agg(F.count(F.lit(1)).alias("runs"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.sum("latency_ms").alias("total"), F.avg("latency_ms").alias("mean"), *times)
    ok = lambda c: F.when(F.col("valid"), F.col(c))
    per_step = steps.groupBy("variant").agg(
        F.avg("latency_ms").alias("mean_inference_ms"),
        F.avg(ok("input_tokens")).alias("mean_input_tokens"),
        F.avg(ok("output_tokens")).alias("mean_output_tokens"),
        F.max(ok("peak_allocated")).alias("peak_allocated"),
        F.max(ok("peak_reserved")).alias("peak_reserved"),
    )
    per_tool = tools.groupBy("variant").agg(F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"))
    j = per_run.join(per_step, "variant", "left").join(per_tool, "variant", "left")
    return j.fillna(0, ["mean_inference_ms", "mean_input_tokens", "mean_output_tokens", "peak_allocated", "peak_reserved", "cache_hits", "cache_misses"])


def success_table(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Variant x category successes."""
    return rows.groupBy("variant").pivot("category", categories).agg(F.sum(F.col("success").cast("int"))).fillna(0)


def score_edits(runs: DataFrame, tools: DataFrame, cases: DataFrame) -> DataFrame:
    """Independent scores of edits: duration within 250 ms, a direct trim of the source to the final artifact with both ends
    within 125 ms, and a successful search before it where the case needs one; refusals are kept apart.

    cases: task_id, category, want_ms, start_ms, end_ms, requires_retrieval."""
    c = cases.select("task_id", "category", "want_ms", F.col("start_ms").alias("xs"), F.col("end_ms").alias("xe"), "requires_retrieval")
    r = runs.join(c, "task_id")
    ok = tools.filter("status = 'success'")
    searched = ok.filter("tool_name = 'search_video'").groupBy("run_id").agg(F.min("pos").alias("searched"))
    trims = ok.filter("tool_name = 'trim_video'").select("run_id", "pos", "output_artifact_id", "parent", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"))
    t = r.join(trims, "run_id").filter((F.col("output_artifact_id") == F.col("final_artifact_id")) & (F.col("parent") == F.col("source_artifact_id")))
    t = t.filter((F.abs(F.col("ts") - F.col("xs")) <= 125) & (F.abs(F.col("te") - F.col("xe")) <= 125)).groupBy("run_id").agg(F.max("pos").alias("trimmed"))
    j = r.join(t, "run_id", "left").join(searched, "run_id", "left")
    j = j.withColumns(
        {
            "media_ok": F.coalesce(F.col("final_artifact_id").isNotNull() & (F.abs(F.col("duration_ms") - F.col("want_ms")) <= 250), F.lit(False)),
            "lineage_ok": F.col("trimmed").isNotNull(),
            "retrieval_used": F.coalesce(F.col("searched") < F.col("trimmed"), F.lit(False)),
        }
    )
    success = (F.col("category") != "impossible") & (F.col("terminal_reason") == "SUCCESS") & F.col("media_ok") & F.col("lineage_ok") & (F.col("retrieval_used") | ~F.col("requires_retrieval"))
    refusal = (F.col("category") == "impossible") & (F.col("terminal_reason") == "CANNOT_COMPLETE") & F.col("final_artifact_id").isNull()
    return j.select("run_id", "category", "media_ok", "lineage_ok", "retrieval_used", success.alias("edit_success"), refusal.alias("correct_refusal"))


def completion_status(checks: DataFrame) -> DataFrame:
    """run_id, status of (run_id, check, passed, conclusive): failed if a conclusive check fails, else inconclusive if any is open, else passed."""
    return checks.groupBy("run_id").agg(
        F.when(F.max(F.col("conclusive") & ~F.col("passed")), "failed").when(F.max(~F.col("conclusive")), "inconclusive").otherwise("passed").alias("status"),
        F.count_if(F.col("conclusive") & ~F.col("passed")).alias("n_failed"),
    )


def completion_checks(runs: DataFrame, validations: DataFrame, wishes: DataFrame, lineage_tools: DataFrame, unknown: DataFrame) -> DataFrame:
    """The checks of finished runs.

    runs: run_id, final_artifact_id; validations: run_id, artifact_id, pos, duration_ms, width, height (successful ones); wishes: run_id, type
    (duration, aspect, tool, semantic), lo, hi, width, height, tool; lineage_tools: run_id, tool (J8); unknown: run_id (J9)."""
    v = validations.join(runs.select("run_id", F.col("final_artifact_id").alias("artifact_id")), ["run_id", "artifact_id"])
    v = v.groupBy("run_id").agg(F.max_by(F.struct("duration_ms", "width", "height"), "pos").alias("m"))
    exists = runs.select("run_id", F.lit("output_exists").alias("check"), F.col("final_artifact_id").isNotNull().alias("passed"), F.lit(True).alias("conclusive"))
    valid = runs.join(v, "run_id", "left").select("run_id", F.lit("output_validated").alias("check"), F.col("m").isNotNull().alias("passed"), F.lit(True).alias("conclusive"))
    used = lineage_tools.select("run_id", "tool").distinct().withColumn("used", F.lit(True))
    w = wishes.join(v, "run_id", "left").join(used, ["run_id", "tool"], "left")
    passed = (
        F.when(F.col("type") == "duration", F.col("m.duration_ms").between(F.col("lo"), F.col("hi")))
        .when(F.col("type") == "aspect", F.col("m.width") * F.col("height") == F.col("m.height") * F.col("width"))
        .when(F.col("type") == "tool", F.col("used"))
        .otherwise(F.lit(True))
    )
    wished = w.select("run_id", F.col("type").alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), (F.col("type") != "semantic").alias("conclusive"))
    known = runs.join(unknown.select("run_id").distinct().withColumn("bad", F.lit(True)), "run_id", "left").select("run_id", F.lit("evidence_known").alias("check"), F.col("bad").isNull().alias("passed"), F.lit(True).alias("conclusive"))
    return exists.unionByName(valid).unionByName(wished).unionByName(known)


def recomputed(summary: DataFrame, stored: DataFrame, inputs: DataFrame, columns: list[str]) -> DataFrame:
    """Metric, column, input_digest: where a recomputed summary (metric, value) differs from the stored one, and a digest of the input rows
    that does not depend on their order."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)
    digest = inputs.agg(F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")).alias("input_digest"))  # one row
    return differences(summary, stored, ["metric"]).select("metric", "column").join(F.broadcast(digest))


# The known faults in their order, and those that an evaluator must let pass.
MUTATIONS = (
    "exact_success", "wrong_scene", "wrong_duration", "wrong_aspect_ratio", "wrong_subtitle", "wrong_order", "partial_constraints",
    "false_refusal", "premature_finish", "loop", "invalid_arguments", "recovery_success", "recovery_failure",
)
PASSING = ("exact_success", "correct_refusal", "recovery_success")


def mutate(runs: DataFrame, tools: DataFrame, candidates: DataFrame, gold_scenes: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs (with mutation), tools and candidates with a known fault each, chosen by the key modulo the number of faults.

    Wrong scenes move every trim to the first stretch of 3 s (of 0 to 12 s) at which no relevant scene begins, and take the hits away."""
    m = F.element_at(F.array(*[F.lit(x) for x in MUTATIONS]), (F.pmod(F.col(key), F.lit(len(MUTATIONS))) + 1).cast("int"))
    r = runs.withColumn("mutation", m)
    x = F.col("mutation")
    gone = x.isin("false_refusal", "loop", "invalid_arguments", "recovery_failure")
    end = x == "premature_finish"
    put = lambda c, v: F.when(end, v).otherwise(F.col(c))
    changed = r.withColumns(
        {
            "terminal_reason": F.when(x.isin("false_refusal", "invalid_arguments"), "CANNOT_COMPLETE").when(x == "loop", "LOOP_DETECTED").when(x == "recovery_failure", "BUDGET_EXHAUSTED").when(end, "SUCCESS").otherwise(F.col("terminal_reason")),
            "final_artifact_id": F.when(~gone, put("final_artifact_id", F.lit("calibration-final"))),
            "duration_ms": F.when(x == "wrong_duration", 99_000).when(~gone, put("duration_ms", F.lit(3000))),
            "width": F.when(x == "wrong_aspect_ratio", 640).when(~gone, put("width", F.lit(384))),
            "height": F.when(x == "wrong_aspect_ratio", 360).when(~gone, put("height", F.lit(256))),
        }
    )
    starts = gold_scenes.groupBy("task_id").agg(F.collect_set("start_ms").alias("starts"))  # scenes of one task
    free = F.element_at(F.array_except(F.sequence(F.lit(0), F.lit(12_000), F.lit(3000)).cast("array<long>"), F.col("starts").cast("array<long>")), 1)
    of = r.join(starts, "task_id", "left").select("run_id", "mutation", free.alias("free"), "starts")
    t = tools.join(of, "run_id")
    moved = x.isin("wrong_scene", "partial_constraints") & F.col("starts").isNotNull()
    trim, cue = moved & (F.col("tool_name") == "trim_video"), (x == "wrong_subtitle") & (F.col("tool_name") == "add_subtitles")
    first = tools.groupBy("run_id").agg(F.min("pos").alias("first_pos"))
    t = t.join(first, "run_id").withColumns(
        {
            "start_ms": F.when(trim, F.col("free")).when(cue, 0).otherwise(F.col("start_ms")),
            "end_ms": F.when(trim, F.col("free") + 3000).when(cue, 1000).otherwise(F.col("end_ms")),
            "text": F.when(cue, "WRONG").otherwise(F.col("text")),
            "inputs": F.when((x == "wrong_order") & (F.col("tool_name") == "concat_videos"), F.reverse("inputs")).otherwise(F.col("inputs")),
            "status": F.when((x == "invalid_arguments") & (F.col("pos") == F.col("first_pos")), "invalid").otherwise(F.col("status")),
        }
    )
    # a failed call before all others
    failed = t.filter(x.isin("recovery_success", "recovery_failure") & (F.col("pos") == F.col("first_pos")))
    failed = failed.withColumns({"pos": F.col("pos") - 1, "tool_name": F.lit("trim_video"), "status": F.lit("error")})
    hits = candidates.join(of, "run_id").filter(~moved)
    # written once: the evaluator reads them many times, by run; joined anew each time, all its joins and sums would lie in the tasks of these joins
    return changed, materialize(t.unionByName(failed).select(tools.columns), "mutated-tools"), materialize(hits.select(candidates.columns), "mutated-candidates")


def calibration(evaluations: DataFrame) -> DataFrame:
    """Mutation -> runs, passes, and how often the evaluator's verdict equals ``expected_pass``."""
    return evaluations.groupBy("mutation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("task_success").alias("n_passed"), F.avg((F.col("task_success") == F.col("expected_pass")).cast("double")).alias("agreement")
    )
