"""Claims of visual and motion models against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.intervals import iou
from quillspan.functions.text import casefold, character_error_rate, squeeze, words

# An action is claimed if all terms of one of its patterns occur.
ACTION_PATTERNS = {
    "move_left": (("move", "left"), ("moving", "left"), ("leftward",), ("向左",)),
    "move_right": (("move", "right"), ("moving", "right"), ("rightward",), ("向右",)),
    "move_up": (("move", "up"), ("moving", "up"), ("upward",), ("向上",)),
    "move_down": (("move", "down"), ("moving", "down"), ("downward",), ("向下",)),
    "appear": (("appear",), ("becomes visible",), ("出现",)),
    "disappear": (("disappear",), ("vanish",), ("no longer visible",), ("消失",)),
    "enter_frame": (("enter", "frame"), ("comes into", "view"), ("进入", "画面")),
    "exit_frame": (("exit", "frame"), ("leave", "frame"), ("leaves", "view"), ("离开", "画面")),
    "approach": (("approach",), ("closer",), ("toward", "camera"), ("接近",)),
    "move_away": (("move", "away"), ("farther",), ("recede",), ("远离",)),
    "start_moving": (("start", "mov"), ("begin", "mov"), ("resume", "mov"), ("开始", "移动")),
    "stop_moving": (("stop", "mov"), ("becomes stationary",), ("halts",), ("停止", "移动")),
}


# The action that stands for a direction.
DIRECTIONS = {"left": "move_left", "right": "move_right", "up": "move_up", "down": "move_down", "toward": "approach", "away": "move_away"}


def _plain(x: Column) -> Column:
    return squeeze(F.regexp_replace(casefold(F.coalesce(x, F.lit(""))), "_", " "))


def _norm(x: Column) -> Column:
    """Letters and digits only, case-folded."""
    return F.array_join(words(x), "")


def _units(x: Column) -> Column:
    return F.regexp_extract_all(casefold(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+|[\\x{3400}-\\x{9fff}]+"), 0)


def _subset(a: Column, b: Column) -> Column:
    """All words of a (one at least) occur in b."""
    return (F.size(_units(a)) > 0) & (F.size(F.array_except(_units(a), _units(b))) == 0)


def claimed_actions(text: Column) -> Column:
    """The codes of all actions that a normalised text claims; the patterns are data, one small constant array."""
    table = F.array(*[F.struct(F.lit(code).alias("code"), F.lit([list(p) for p in patterns]).alias("patterns")) for code, patterns in ACTION_PATTERNS.items()])
    held = F.filter(table, lambda a: F.exists(a["patterns"], lambda p: F.forall(p, lambda t: text.contains(t))))
    return F.transform(held, lambda a: a["code"])


def _names(text: Column, terms: Column) -> Column:
    """A term of the array occurs in the normalised text, or the text in a term."""
    return F.exists(terms, lambda a: text.contains(_plain(a)) | _plain(a).contains(text))


def _action_said(text: Column, action: Column) -> Column:
    said = casefold(F.coalesce(text, F.lit("")))
    right = (said.contains("move") & said.contains("right")) | said.contains("向右")
    return F.when(action == "moves_right", right).otherwise(_norm(text).contains(_norm(action)))


def _text_evidence(refs: Column) -> Column:
    """A reference of the span's own segment (or of none) saw it: at its time, inside its range, or over all of its range."""

    def seen(r: Column) -> Column:
        inside = (F.col("start_ms") <= r["observed_ms"]) & (r["observed_ms"] < F.col("end_ms"))
        over = (r["start_ms"] <= F.col("start_ms")) & (r["end_ms"] >= F.col("end_ms"))
        yes = lambda c: F.coalesce(c, F.lit(False))
        return (r["segment_id"].isNull() | r["segment_id"].eqNullSafe(F.col("segment_id"))) & (yes(r["observed_ms"] == F.col("observed_ms")) | yes(inside) | yes(over))

    return F.coalesce(F.exists(refs, seen), F.lit(False))


def visual_metrics(gold: DataFrame, entities: DataFrame, actions: DataFrame, texts: DataFrame, events: DataFrame, references: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a case.

    gold: case_id, entities array (the first is the main one), action (or null), visible_text, event_start, event_end (or null);
    entities, actions: case_id, text (of an action: subject, action and object); texts: case_id, text, segment_id, observed_ms, start_ms, end_ms and
    refs, an array of struct(segment_id, observed_ms, start_ms, end_ms); events: case_id, start_ms, end_ms; references and catalog: case_id,
    artifact_id. A predicted entity is hallucinated if it and no gold entity hold each other's words. A text's evidence is right if a span
    of the expected text has a reference that fits its time; evidence is whole if the catalog of the case has all references."""
    e = entities.join(gold.select("case_id", F.col("entities").alias("g")), "case_id")
    supported = F.exists("g", lambda x: _subset(x, F.col("text")) | _subset(F.col("text"), x))
    e = e.groupBy("case_id").agg(F.max(_subset(F.element_at("g", 1), F.col("text"))).alias("hit"), F.count_if(~supported).alias("n_hallucinated"), F.count(F.lit(1)).alias("n_entities"))
    a = actions.join(gold.select("case_id", "action"), "case_id").groupBy("case_id").agg(F.max(_action_said(F.col("text"), F.col("action"))).alias("act"), F.lit(True).alias("some"))
    same = _norm(F.col("text")) == _norm(F.col("visible_text"))
    t = texts.join(gold.select("case_id", "visible_text"), "case_id").groupBy("case_id").agg(
        F.max(F.col("text") == F.col("visible_text")).alias("exact"),
        F.max(same).alias("same"),
        F.min(character_error_rate(F.col("visible_text"), F.col("text"))).alias("cer"),
        F.max(same & _text_evidence(F.col("refs"))).alias("evidence"),
    )
    v = events.join(gold.select("case_id", "event_start", "event_end"), "case_id").groupBy("case_id").agg(
        F.max(iou(F.col("start_ms"), F.col("end_ms"), F.col("event_start"), F.col("event_end"))).alias("x"), F.count(F.lit(1)).alias("n_events")
    )
    known = catalog.select("case_id", "artifact_id").distinct()
    broken = references.select("case_id", "artifact_id").distinct().join(known, ["case_id", "artifact_id"], "left_anti").groupBy("case_id").agg(F.lit(True).alias("broken"))
    j = gold.select("case_id", "action", "event_start")
    for part in (e, a, t, v, broken):
        j = j.join(part, "case_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select(
        "case_id",
        no(F.col("hit")).alias("entity_correct"),
        F.coalesce("n_hallucinated", F.lit(0)).alias("n_hallucinated"),
        F.coalesce("n_entities", F.lit(0)).alias("n_entities"),
        F.when(F.col("action").isNull(), F.col("some").isNull()).otherwise(no(F.col("act"))).alias("action_correct"),
        no(F.col("exact")).alias("text_exact"),
        no(F.col("same")).alias("text_normalized"),
        F.coalesce("cer", F.lit(1.0)).alias("text_cer"),
        no(F.col("evidence")).alias("text_evidence_correct"),
        F.when(F.col("event_start").isNull(), F.col("n_events").isNull()).otherwise(no(F.col("x") >= 0.5)).alias("event_correct"),
        F.col("broken").isNull().alias("evidence_integrity"),
    )


def visual_summary(metrics: DataFrame, attempted: DataFrame) -> DataFrame:
    """Rates over evaluated cases, validity over attempted ones, hallucination as one ratio of sums."""
    d = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    m = metrics.agg(
        *[d(c) for c in ("entity_correct", "action_correct", "text_exact", "text_normalized", "text_cer", "event_correct")],
        F.when(F.sum("n_entities") > 0, F.sum("n_hallucinated") / F.sum("n_entities")).otherwise(0.0).alias("hallucination_rate"),
        F.count(F.lit(1)).alias("n"),
    )
    return m.join(attempted.agg(F.count(F.lit(1)).alias("n_attempted"))).withColumn("validity", F.when(F.col("n_attempted") > 0, F.col("n") / F.col("n_attempted")).otherwise(0.0))


def claim_counts(claims: DataFrame) -> DataFrame:
    """clip_id, kind, n of (clip_id, kind)."""
    return claims.groupBy("clip_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def clip_costs(records: DataFrame, prefix: str) -> DataFrame:
    """Per clip, over the model calls whose operation begins with ``prefix``: latency, frames and tokens in all, peaks of memory.

    records: clip_id, operation, latency_ms, frames, input_tokens, peak_allocated, peak_reserved; what is unknown counts as 0."""
    r = records.filter(F.col("operation").startswith(prefix)).fillna(0, ["input_tokens", "peak_allocated", "peak_reserved"])
    return r.groupBy("clip_id").agg(
        F.sum("latency_ms").alias("latency_ms"), F.sum("frames").alias("frames"), F.sum("input_tokens").alias("input_tokens"), F.max("peak_allocated").alias("peak_allocated"), F.max("peak_reserved").alias("peak_reserved")
    )


def motion_metrics(gold: DataFrame, entities: DataFrame, expected: DataFrame, claims: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row a case: entity score, actions, times, localisation error, unsupported rate, direction and order.

    gold: case_id, direction (a key of DIRECTIONS or null), first_actor, second_actor (or null), supported (an array of more terms that may be
    named, or null); entities: case_id, labels (a label and its aliases); expected: case_id, n, actors (an actor and its aliases), action,
    start_ms, end_ms; claims: case_id, claim_id, text, start_ms, end_ms (null bounds: an action claim without a time); predicted: case_id, label.
    Of a case without expected events the actions are right unless a claim names one of its entities together with any action. The unsupported
    rate counts claims that no expected event backs and entities that no term supports. Gold is an annotation, so its rows of one case
    are few and travel as arrays; claims and predictions of a case may be many and are only summed."""
    events = expected.groupBy("case_id").agg(F.collect_list(F.struct("n", "actors", "action", F.col("start_ms").alias("xs"), F.col("end_ms").alias("xe"))).alias("events"))
    labels = entities.groupBy("case_id").agg(F.collect_list("labels").alias("labels"))
    g = gold.select("case_id", "direction", "first_actor", "second_actor", "supported").join(events, "case_id", "left").join(labels, "case_id", "left")
    g = g.withColumns({"labels": F.coalesce("labels", F.expr("CAST(array() AS array<array<string>>)")), "supported": F.coalesce("supported", F.expr("CAST(array() AS array<string>)"))})
    t, timed = F.col("t"), F.col("start_ms").isNotNull()
    code = F.lit(None).cast("string")
    for word, action in DIRECTIONS.items():
        code = F.when(F.col("direction") == word, action).otherwise(code)

    c = claims.select("case_id", "start_ms", "end_ms", _plain(F.col("text")).alias("t")).withColumn("codes", claimed_actions(t)).join(g, "case_id")
    backs = F.transform("events", lambda e: F.array_contains("codes", e["action"]) & _names(t, e["actors"]))
    c = c.withColumn("backs", F.coalesce(backs, F.expr("CAST(array() AS array<boolean>)")))
    said = c.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.count_if(~F.array_contains("backs", True)).alias("n_unbacked"),
        F.count_if(timed).alias("n_timed"),
        F.max((F.size("codes") > 0) & F.exists("labels", lambda x: _names(t, x))).alias("named"),
        F.max(F.array_contains("codes", code)).alias("dir"),
        F.min(F.when(_names(t, F.array("first_actor")), F.col("start_ms"))).alias("s1"),
        F.min(F.when(_names(t, F.array("second_actor")), F.col("start_ms"))).alias("s2"),
    )
    pair = c.select("case_id", "start_ms", "end_ms", F.explode(F.arrays_zip("events", "backs")).alias("p")).filter("p.backs")
    pair = pair.select("case_id", "start_ms", "end_ms", "p.events.n", "p.events.xs", "p.events.xe")
    err = (F.abs(F.col("xs") - F.col("start_ms")) + F.abs(F.col("xe") - F.col("end_ms"))) / 2
    met = pair.groupBy("case_id", "n").agg(F.lit(True).alias("hit"), F.min(err).alias("err"), F.max(iou(F.col("xs"), F.col("xe"), F.col("start_ms"), F.col("end_ms"))).alias("best"))
    met = expected.select("case_id", "n").join(met, ["case_id", "n"], "left").groupBy("case_id").agg(
        F.min(F.col("hit").isNotNull()).alias("hit"), F.min(F.coalesce(F.col("best") >= 0.3, F.lit(False))).alias("time_hit"), F.avg("err").alias("localisation_error")
    )

    p = predicted.select("case_id", _plain(F.col("label")).alias("t")).join(g.select("case_id", "labels", "supported"), "case_id")
    p = p.withColumn("is", F.transform("labels", lambda x: _names(t, x)))
    seen = p.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_predicted"), F.count_if(~F.array_contains("is", True) & ~_names(t, F.col("supported"))).alias("n_hallucinated"))
    found = p.select("case_id", F.posexplode("is").alias("pos", "found")).groupBy("case_id", "pos").agg(F.max("found").alias("found")).groupBy("case_id").agg(F.avg(F.col("found").cast("int")).alias("score"))

    j = g
    for part in (met, said, seen, found):
        j = j.join(part, "case_id", "left")
    n = lambda x: F.coalesce(x, F.lit(0))
    no = lambda x: F.coalesce(x, F.lit(False))
    return j.select(
        "case_id",
        F.coalesce("score", F.lit(0.0)).alias("entity_correctness"),
        F.coalesce("hit", ~no(F.col("named"))).alias("action_correct"),
        F.coalesce("time_hit", n("n_timed") == 0).alias("temporal_correct"),
        "localisation_error",
        n("n_hallucinated").alias("n_hallucinated"),
        ((n("n_hallucinated") + n("n_unbacked")) / F.greatest(F.lit(1), n("n_predicted") + n("n_claims"))).alias("unsupported_rate"),
        F.when(F.col("direction").isNotNull(), no(F.col("dir"))).alias("direction_correct"),
        F.when(F.col("first_actor").isNotNull(), no(F.col("s1") < F.col("s2"))).alias("order_correct"),
    )


def failure_matrix(rows: DataFrame, flags: list[str]) -> DataFrame:
    """task_type, variant, failure, n of false flags (null flags do not apply), and the rows behind them."""
    e = rows.select("task_type", "variant", F.explode(F.array(*[F.struct(F.lit(f).alias("failure"), F.col(f).alias("ok")) for f in flags])).alias("x"))
    return e.select("task_type", "variant", "x.*").filter("ok IS NOT NULL").groupBy("task_type", "variant", "failure").agg(F.count_if(~F.col("ok")).alias("n_failed"), F.count(F.lit(1)).alias("n"))
