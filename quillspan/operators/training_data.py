"""Post-training data: records, preference pairs, reward inputs, rollouts, and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import casefold, character_error_rate, word_error_rate, words
from quillspan.operators.governance import sums_before


def digest(*columns: Column | str) -> Column:
    """Digest of values, nulls told apart from texts."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def sft_records(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """record_id, trajectory_id, pos, operation, prompt, target, target_source, evidence_ids of the steps of runs that ended as expected.

    steps: trajectory_id, pos, operation, decision, prompt, target, verification_ids; plans are not targets; the last three ids stay, each once."""
    ok = runs.filter(F.col("terminal").eqNullSafe(F.col("expected"))).select("trajectory_id")
    s = steps.filter("operation <> 'plan' AND target IS NOT NULL").join(ok, "trajectory_id", "left_semi")
    ids = F.coalesce("verification_ids", F.array().cast("array<string>"))
    source = (
        F.when(F.col("operation") == "recover", "observable_recovery")
        .when(F.col("decision") == "finish", "valid_finish")
        .when(F.col("decision") == "cannot_complete", "correct_cannot_complete")
        .when(F.col("decision") == "tool", "executed_oracle")
        .otherwise("verified_repair")
    )
    return s.select(
        F.sha2(F.concat_ws("|", "trajectory_id", "pos", "prompt", "target"), 256).alias("record_id"),
        "trajectory_id",
        "pos",
        "operation",
        "prompt",
        "target",
        source.alias("target_source"),
        F.array_distinct(F.slice(ids, F.greatest(F.lit(1), F.size(ids) - 2), 3)).alias("evidence_ids"),
    )


def repeated_ids(records: DataFrame, key: str) -> DataFrame:
    """Key, n of the ids that stand on more than one row."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# What no prompt may hold, and what tells an observation from a decision.
PRIVATE_MARKERS = ("benchmarkgold", "benchmark_gold", '"split"', "source_group_id", "ground_truth", "evaluator_metadata", '"uri"', '"sha256"', "file://")
OBSERVATION_MARKER = '"event_type":"tool_observation"'


def _holds(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.coalesce(F.lower(text).contains(m), F.lit(False))
    return out


def target_errors(records: DataFrame, tools: DataFrame) -> DataFrame:
    """record_id, rule: a tool that is not in the manifest; an observation or nothing as target; message roles other than user, then
    assistant; an assistant message that is not the target's text; private names in the prompt.

    records: record_id, tool, operation, prompt, target (canonical text), roles array, content (of the assistant message)."""
    j = records.join(tools.select("tool").distinct().withColumn("known", F.lit(True)), "tool", "left")
    target = F.coalesce("target", F.lit(""))
    rules = F.array_compact(
        F.array(
            F.when(F.col("tool").isNotNull() & F.col("known").isNull(), F.lit("unknown_tool")),
            F.when((F.col("operation") == "observation") | _holds(target, (OBSERVATION_MARKER,)), F.lit("observation_target")),
            F.when(F.trim(target) == "", F.lit("empty_target")),
            F.when(~F.col("roles").eqNullSafe(F.array(F.lit("user"), F.lit("assistant"))), F.lit("message_roles")),
            F.when(~F.col("content").eqNullSafe(F.col("target")), F.lit("not_canonical")),
            F.when(_holds(F.col("prompt"), PRIVATE_MARKERS), F.lit("private_prompt")),
        )
    )
    return j.select("record_id", F.explode(rules).alias("rule"))


def sft_leaks(records: DataFrame, markers: tuple[str, ...] = PRIVATE_MARKERS) -> DataFrame:
    """record_id, marker of the prompts and targets that hold a private marker."""
    text = F.lower(F.concat_ws("\x1f", "prompt", "target"))
    found = F.array_compact(F.array(*[F.when(text.contains(m), F.lit(m)) for m in markers]))
    return records.select("record_id", F.explode(found).alias("marker"))


def sft_audit(records: DataFrame, by: list[str]) -> DataFrame:
    """Level, value, n, n_distinct, length min / median / p95 (linear) / max, over all and by each column."""
    long = records.select(
        F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in by])).alias("g"),
        F.sha2(F.concat_ws("\x1f", "prompt", "target"), 256).alias("h"),
        F.length("target").alias("len"),
    )
    return long.select("g.*", "h", "len").groupBy("level", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("h").alias("n_distinct"),
        F.min("len").alias("len_min"),
        F.median("len").alias("len_median"),
        F.percentile("len", 0.95).alias("len_p95"),
        F.max("len").alias("len_max"),
    )


def preference_audit(pairs: DataFrame) -> DataFrame:
    """T5: reason ('all' for all), n, duplicates, share of shorter chosen texts, mean length gap, and the least, median, 95 % (linear) and
    greatest length of chosen and of rejected texts."""
    h = F.sha2(F.concat_ws("\x1f", "prompt", "chosen", "rejected"), 256)
    p = pairs.select("reason", h.alias("h"), F.length("chosen").alias("c"), F.length("rejected").alias("r"))
    return p.groupingSets([[], [F.col("reason")]], "reason").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - F.count_distinct("h")).alias("duplicates"),
        F.avg((F.col("c") < F.col("r")).cast("double")).alias("chosen_shorter"),
        F.avg(F.col("c") - F.col("r")).alias("mean_gap"),
        *[
            f.alias(f"{name}_{label}")
            for name, c in (("chosen", "c"), ("rejected", "r"))
            for label, f in (("min", F.min(c)), ("median", F.median(c)), ("p95", F.percentile(c, 0.95)), ("max", F.max(c)))
        ],
    ).withColumn("reason", F.coalesce("reason", F.lit("all")))


def reward_tables(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs (input_id, prompt, a, b) and labels (input_id, chosen_side, reason): sides by the parity of a digest, labels apart."""
    odd = (F.conv(F.substring(F.sha2("pair_id", 256), 64, 1), 16, 10).cast("int") % 2) == 1
    ids = F.sha2(F.concat(F.lit("input|"), F.col("pair_id")), 256).alias("input_id")
    inputs = pairs.select(ids, "prompt", F.when(odd, F.col("rejected")).otherwise(F.col("chosen")).alias("a"), F.when(odd, F.col("chosen")).otherwise(F.col("rejected")).alias("b"))
    return inputs, pairs.select(ids, F.when(odd, "b").otherwise("a").alias("chosen_side"), "reason")


def reward_check(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """Check, value, n: inputs without a label, labels without an input, ids on several rows (all should be 0), and the
    labels by reason."""
    i, lab = inputs.select("input_id").withColumn("i", F.lit(1)), labels.select("input_id").withColumn("l", F.lit(1))
    apart = i.join(lab, "input_id", "full_outer").agg(F.count_if(F.col("l").isNull()).alias("without_label"), F.count_if(F.col("i").isNull()).alias("without_input"))
    apart = apart.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("without_label", "without_input")])).alias("x")).select("x.*")
    twice = lambda df, name: repeated_ids(df, "input_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    one = apart.unionByName(twice(inputs, "repeated_input")).unionByName(twice(labels, "repeated_label")).select("check", F.lit("").alias("value"), "n")
    classes = labels.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("class").alias("check"), F.col("reason").alias("value"), "n")
    return one.unionByName(classes)


TERMINAL_KINDS = ("finish", "cannot_complete")


def decision_kind(text: Column) -> Column:
    """The decision or recovery type of a candidate's JSON text, or its ``decision``; candidates without one are tool calls."""
    return F.coalesce(*[F.get_json_object(text, f"$.{c}") for c in ("decision_type", "recovery_type", "decision")], F.lit("tool"))


def shortcut_audit(inputs: DataFrame, labels: DataFrame) -> DataFrame:
    """Heuristic, accuracy, n_right, n: how well length alone tells the chosen side (ties count as side a), and, over the pairs where exactly one
    side is terminal, or a tool call, how often the other, or that, is the chosen one."""
    # the texts stay behind: the join moves kinds and lengths
    seen = inputs.select("input_id", decision_kind(F.col("a")).alias("ka"), decision_kind(F.col("b")).alias("kb"), F.length("a").alias("la"), F.length("b").alias("lb"))
    j = seen.join(labels, "input_id")
    la, lb, side = F.col("la"), F.col("lb"), F.col("chosen_side")
    ta, tb = F.col("ka").isin(*TERMINAL_KINDS), F.col("kb").isin(*TERMINAL_KINDS)
    tool_a, tool_b = F.col("ka") == "tool", F.col("kb") == "tool"
    guesses = {
        "shorter": F.when(lb < la, "b").otherwise("a"),
        "longer": F.when(lb > la, "b").otherwise("a"),
        "always_a": F.lit("a"),
        "nonterminal": F.when(~ta & tb, "a").when(ta & ~tb, "b"),
        "tool": F.when(tool_a & ~tool_b, "a").when(~tool_a & tool_b, "b"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("heuristic"), (g == side).cast("int").alias("hit")) for n, g in guesses.items()])).alias("x")
    return j.select(rows).groupBy("x.heuristic").agg(F.avg("x.hit").alias("accuracy"), F.coalesce(F.sum("x.hit"), F.lit(0)).alias("n_right"), F.count("x.hit").alias("n"))


def type_pairs(inputs: DataFrame) -> DataFrame:
    """Kind of a, kind of b, n."""
    return inputs.groupBy(decision_kind(F.col("a")).alias("kind_a"), decision_kind(F.col("b")).alias("kind_b")).agg(F.count(F.lit(1)).alias("n"))


def fit_failure_head(rows: DataFrame, iterations: int = 50, l2: float = 1e-3):
    """Failure head: multinomial logistic regression of the class ``label`` (0, 1, ..) on ``features`` (array), both candidates of a pair
    one row each. Returns the fitted model: ``coefficientMatrix`` and ``interceptVector`` are its weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=iterations, regParam=l2).fit(data)


def fit_pairwise(pairs: DataFrame, dims: int, iterations: int = 50, l2: float = 1e-3):
    """Ranking head on embeddings a, b (label 1 if a is chosen): logistic regression on differences in both signs, without
    an intercept. Returns the weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    d = F.zip_with("a", "b", lambda x, y: x - y)
    both = pairs.select(array_to_vector(d).alias("features"), F.col("label").cast("double").alias("label")).unionByName(
        pairs.select(array_to_vector(F.transform(d, lambda x: -x)).alias("features"), (1 - F.col("label")).cast("double").alias("label"))
    )
    return LogisticRegression(fitIntercept=False, maxIter=iterations, regParam=l2).fit(both).coefficients.toArray()[:dims]


def reward_metrics(scores: DataFrame) -> DataFrame:
    """Metric, value of (input_id, label 0/1, score, length): accuracy at 0.5, AUC and Spearman with average ranks, concordance
    without ties, ECE of ten bins, correlation with length (0 for a constant)."""
    s = scores.select(F.col("label").cast("double").alias("y"), F.col("score").cast("double").alias("p"), F.col("length").cast("double").alias("n"))
    # ranks from counts of distinct values, summed over ranges of values
    values = s.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("pos"))
    v = sums_before(values, "p", ["c", "pos"]).withColumnRenamed("c_before", "below")
    v = v.withColumns({"neg_below": F.col("below") - F.col("pos_before"), "rank": F.col("below") + (F.col("c") + 1) / 2})
    auc = v.agg(F.sum("pos").alias("P"), F.sum(F.col("c") - F.col("pos")).alias("N"), F.sum(F.col("pos") * F.col("rank")).alias("R"), F.sum(F.col("pos") * F.col("neg_below")).alias("concordant"), F.sum("c").alias("m"))
    auc = auc.withColumn("discordant", F.col("P") * F.col("N") - F.col("concordant"))
    ties = v.agg(F.sum(F.col("pos") * (F.col("c") - F.col("pos"))).alias("tied"))
    area = (F.col("R") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * F.col("N"))
    ranks = s.join(v.select("p", "rank"), "p")
    spread = ranks.agg(F.var_pop("rank").alias("vr"), F.var_pop("y").alias("vy"), F.var_pop("n").alias("vn"), F.var_pop("p").alias("vp"), F.covar_pop("rank", "y").alias("cry"), F.covar_pop("p", "n").alias("cpn"), F.avg(((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("double")).alias("accuracy"))
    bins = s.withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10))).groupBy("bin").agg(F.count(F.lit(1)).alias("c"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    ece = bins.agg((F.sum(F.col("c") * F.abs(F.col("mp") - F.col("my"))) / F.sum("c")).alias("ece"))
    one = auc.join(ties).join(spread).join(ece)  # one row each
    safe = lambda c, a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(c) / F.sqrt(F.col(a) * F.col(b))).otherwise(0.0)
    live = F.col("P") * F.col("N") - F.col("tied")
    rows = {
        "accuracy": F.col("accuracy"),
        "auc": F.when(F.col("P") * F.col("N") > 0, area),
        "spearman": safe("cry", "vr", "vy"),
        "concordance": F.when(live > 0, (2 * F.col("concordant") - live) / live).otherwise(0.0),
        "ece": F.col("ece"),
        "length_correlation": safe("cpn", "vp", "vn"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows.items()])).alias("x")).select("x.*")


def macro_f1(pairs: DataFrame, classes: list) -> DataFrame:
    """Macro F1 over all classes, seen or not, of (truth, guess)."""
    rows = [F.struct(F.lit(c).alias("k"), F.when((F.col("truth") == c) & (F.col("guess") == c), 1).otherwise(0).alias("tp"), F.when((F.col("truth") == c) != (F.col("guess") == c), 1).otherwise(0).alias("off")) for c in classes]
    t = pairs.select(F.explode(F.array(*rows)).alias("x")).groupBy("x.k").agg(F.sum("x.tp").alias("tp"), F.sum("x.off").alias("off"))
    f1 = F.when(2 * F.col("tp") + F.col("off") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("off"))).otherwise(0.0)
    return t.agg(F.avg(f1).alias("macro_f1"))


def acceptable(candidates: DataFrame) -> DataFrame:
    """Candidates whose query holds at least half of the instruction's terms of four letters or more."""
    terms = F.filter(F.array_distinct(words(F.col("instruction"))), lambda t: F.length(t) >= 4)
    held = F.size(F.array_intersect(terms, words(F.col("query"))))
    return candidates.withColumn("acceptable", (F.size(terms) > 0) & (2 * held >= F.size(terms)))


def select_candidates(scores: DataFrame) -> DataFrame:
    """case_id, method, choice: argmax of rule, model and hybrid = rule + z(model) / 4; the first candidate wins ties.

    scores: case_id, position, rule, model."""
    w = Window.partitionBy("case_id")
    sd = F.greatest(F.stddev_pop("model").over(w), F.lit(1e-8))
    s = scores.withColumn("hybrid", F.round(F.col("rule") + 0.25 * (F.col("model") - F.avg("model").over(w)) / sd, 9))
    best = lambda c: F.max_by("position", F.struct(c, -F.col("position")))
    g = s.groupBy("case_id").agg(*[best(c).alias(c) for c in ("rule", "model", "hybrid")])
    return g.select("case_id", F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("choice")) for c in ("rule", "model", "hybrid")])).alias("x")).select("case_id", "x.*")


def public_rule_score(candidates: DataFrame) -> DataFrame:
    """Candidates with rule: -4 for an invalid decision, -2 for one that calls no tool, -1 for another tool than the search, else 2 + the
    share of the instruction's terms (four letters or more) that the query holds.

    candidates: valid, kind, tool, query, instruction; terms are separated by white space and folded."""
    split = lambda c: F.array_distinct(F.array_remove(F.split(casefold(F.coalesce(c, F.lit(""))), "\\s+"), ""))
    wanted = F.filter(split("instruction"), lambda t: F.length(t) >= 4)
    share = F.size(F.array_intersect(wanted, split("query"))) / F.greatest(F.size(wanted), F.lit(1))
    score = F.when(~F.coalesce("valid", F.lit(False)), -4.0).when(F.col("kind") != "tool", -2.0).when(F.col("tool") != "search_video", -1.0).otherwise(2.0 + share)
    return candidates.withColumn("rule", score)


def selection_report(choices: DataFrame, acceptable: DataFrame, policy: DataFrame) -> DataFrame:
    """Method, n, accuracy, and against the policy's own choice: corrected, no_effect, harmed.

    choices: case_id, method, choice; acceptable: case_id, choice; policy: case_id, choice."""
    good = acceptable.select("case_id", "choice").distinct().withColumn("good", F.lit(True))
    right = F.coalesce("good", F.lit(False))
    base = policy.join(good, ["case_id", "choice"], "left").select("case_id", right.alias("base"))
    every = choices.unionByName(policy.select("case_id", F.lit("policy").alias("method"), "choice"))
    j = every.join(good, ["case_id", "choice"], "left").select("case_id", "method", right.alias("right")).join(base, "case_id")
    return j.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("right").cast("double")).alias("accuracy"),
        F.count_if(F.col("right") & ~F.col("base")).alias("corrected"),
        F.count_if(F.col("right") == F.col("base")).alias("no_effect"),
        F.count_if(~F.col("right") & F.col("base")).alias("harmed"),
    )


def compact_context(runs: DataFrame, last: int = 2, scenes: int = 5) -> DataFrame:
    """P10: the last observations and verifications, the first scenes and the active plan nodes of a context, as JSON text."""
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - last + 1), last)
    active = F.filter("plan", lambda n: n["status"].isin("ready", "running"))
    parts = F.struct(tail("observations").alias("observations"), tail("verifications").alias("verifications"), F.slice("scenes", 1, scenes).alias("scenes"), active.alias("plan"))
    return runs.select("run_id", F.to_json(parts, {"ignoreNullFields": "false"}).alias("context"))


def json_object(raw: Column) -> Column:
    """The completion as a variant, or else its outermost braces; null if neither parses to an object."""
    first = F.try_parse_json(raw)
    second = F.try_parse_json(F.regexp_extract(raw, "(?s)\\{.*\\}", 0))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.coalesce(F.when(is_object(first), first), F.when(is_object(second), second))


# Texts that no action may hold.
UNSAFE = r"(?i)shell|ffmpeg\s+-|powershell|cmd\.exe|/etc/|/root/|\.\.[\\/]"


def score_rollouts(rollouts: DataFrame, kinds: list[str], terminal: tuple[str, ...] = ("finish", "cannot_complete", "cannot_recover")) -> DataFrame:
    """Rewards of (rollout_id, sample_id, n, raw, expected): n is the occurrence of the sample, later ones are repeats.

    An action is ``{"decision_type": k, "name": tool, "arguments": {..}}`` with string arguments; it is valid if its decision type is a known kind."""
    r = rollouts.withColumns({"v": json_object(F.coalesce("raw", F.lit(""))), "e": F.try_parse_json("expected"), "unsafe": F.coalesce(F.col("raw"), F.lit("")).rlike(UNSAFE)})
    get = lambda c, p: F.try_variant_get(c, p, "string")
    args = lambda c: F.coalesce(F.try_variant_get(c, "$.arguments", "map<string,string>"), F.create_map().cast("map<string,string>"))
    r = r.withColumns({"kind": get("v", "$.decision_type"), "want": get("e", "$.decision_type"), "tool": get("v", "$.name"), "want_tool": get("e", "$.name"), "a": args("v"), "b": args("e")})
    keys = F.array_union(F.map_keys("a"), F.map_keys("b"))
    equal = F.size(F.filter(keys, lambda k: F.coalesce(F.element_at("a", k) == F.element_at("b", k), F.lit(False))))
    parsed = F.col("v").isNotNull()
    r = r.withColumns(
        {
            "valid": parsed & F.coalesce(F.col("kind").isin(kinds), F.lit(False)),
            "kind_match": parsed & F.col("kind").eqNullSafe(F.col("want")),
            "operation_match": parsed & F.col("tool").eqNullSafe(F.col("want_tool")),
            "similarity": F.when(F.size(keys) > 0, equal / F.size(keys)).otherwise(1.0),
        }
    )
    r = r.withColumn("exact", F.col("valid") & (F.to_json("v") == F.to_json("e")))
    pay = lambda cond, x, y=0.0: F.when(cond, x).otherwise(y)
    parts = {
        "structured": pay(F.col("valid"), 0.25),
        "kind_reward": pay(F.col("kind_match"), 0.4),
        "operation": pay(F.col("operation_match"), 0.6),
        "arguments": pay(F.col("operation_match"), 0.5 * F.col("similarity")),
        "progress": pay(F.col("exact"), 1.25, pay(F.col("valid") & F.col("operation_match"), 0.25)),
        "malformed": pay(F.col("valid"), 0.0, -1.0),
        "invalid": pay(F.col("valid"), 0.0, -0.25),
        "premature": pay(parsed & F.col("kind").isin(*terminal) & ~F.col("kind_match"), -0.75),
        "unsafe_penalty": pay(F.col("unsafe"), -2.0),
    }
    first = F.col("n") == 0
    total = F.lit(0.0)
    for p in parts.values():
        total = total + p
    repeat = F.when(F.col("unsafe"), -3.0).otherwise(-1.0)
    return r.withColumns({k: F.when(first, p).otherwise(0.0) for k, p in parts.items()} | {"total": F.round(F.when(first, total).otherwise(repeat), 9)}).drop("v", "e", "a", "b")


COMPONENTS = ("structured", "kind_reward", "operation", "arguments", "progress", "malformed", "invalid", "premature", "unsafe_penalty", "total")


def rollout_summary(rollouts: DataFrame, k: int = 4) -> DataFrame:
    """Rollouts, groups, complete groups; of the complete ones, those of one snapshot, those whose rewards differ, and the mean population
    variance (0 without any); over all rollouts, validity, exact matches, mean length and the mean of each reward component.

    rollouts: group, snapshot, valid, exact, length, and COMPONENTS."""
    means = [F.sum(c).alias(f"s_{c}") for c in COMPONENTS]
    g = rollouts.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("snapshot").alias("s"), F.var_pop("total").alias("v"), F.min("total").alias("lo"), F.max("total").alias("hi"),
        F.count_if("valid").alias("valid"), F.count_if("exact").alias("exact"), F.sum("length").alias("len"), *means,
    )
    full = F.col("n") == k
    return g.agg(
        F.sum("n").alias("rollouts"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(full).alias("complete"),
        F.count_if(full & (F.col("s") == 1)).alias("one_snapshot"),
        F.count_if(full & (F.col("hi") > F.col("lo"))).alias("varied"),
        F.coalesce(F.avg(F.when(full, F.col("v"))), F.lit(0.0)).alias("mean_variance"),
        (F.sum("valid") / F.sum("n")).alias("validity"),
        (F.sum("exact") / F.sum("n")).alias("exact"),
        (F.sum("len") / F.sum("n")).alias("mean_length"),
        *[(F.sum(f"s_{c}") / F.sum("n")).alias(f"mean_{c}") for c in COMPONENTS],
    )


def hacking_summary(rollouts: DataFrame) -> DataFrame:
    """One row: rollouts, correlation of length and reward (0 for a constant), exact duplicates, empty and invalid outputs, partial rewards of
    invalid ones, and terminal actions that are neither right nor punished. rollouts: raw, total, valid, exact, kind, premature."""
    raw = F.coalesce(F.col("raw"), F.lit(""))
    r = rollouts.withColumns({"h": F.sha2(raw, 256), "len": F.length(raw).cast("double"), "blank": F.trim(raw) == ""})
    flat = (F.coalesce(F.var_pop("len"), F.lit(0.0)) == 0) | (F.coalesce(F.var_pop("total"), F.lit(0.0)) == 0)
    escape = (F.col("premature") == 0) & F.coalesce(F.col("kind").isin(*TERMINAL_KINDS), F.lit(False)) & ~F.col("exact")
    return r.agg(
        F.count(F.lit(1)).alias("n"),
        F.when(flat, 0.0).otherwise(F.covar_pop("len", "total") / (F.stddev_pop("len") * F.stddev_pop("total"))).alias("length_correlation"),
        (F.count(F.lit(1)) - F.count_distinct("h")).alias("duplicates"),
        F.count_if("blank").alias("empty"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if((F.col("total") > -1.25) & ~F.col("valid")).alias("partial_reward_invalid"),
        F.count_if(escape).alias("terminal_escapes"),
    )


def hacking_findings(rollouts: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """Finding -> rollouts, from text markers, invalid rows, partial rewards of them, empty outputs.

    rollouts: raw, valid, total."""
    raw = F.coalesce(F.col("raw"), F.lit(""))
    flags = {"malformed_structured_action": ~F.col("valid")}
    for name, texts in markers.items():
        hit = F.lit(False)
        for t in texts:
            hit = hit | raw.contains(t)
        flags[name] = hit
    flags["partial_reward_for_invalid_action"] = (F.col("total") > -1.25) & ~F.col("valid")
    flags["empty_output"] = F.trim(raw) == ""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    found = F.when(F.size(found) == 0, F.array(F.lit("no_automatic_anomaly"))).otherwise(found)
    return rollouts.select(F.explode(found).alias("finding")).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


def training_log(log: DataFrame) -> DataFrame:
    """Policy, steps, mean / first / last loss, mean and largest divergence of (policy, step, loss, kl)."""
    return log.groupBy("policy").agg(
        F.count(F.lit(1)).alias("steps"), F.avg("loss").alias("mean_loss"), F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), F.avg("kl").alias("mean_kl"), F.max("kl").alias("max_kl")
    )


def policy_detail(scores: DataFrame, base: str) -> DataFrame:
    """Per policy: cases, accuracies of kind, operation and arguments, invalid rate, premature and repeated actions, exact success, mean
    reward, p50 and p95 of the latency (nearest rank), and success and reward less those of the policy ``base``.

    scores: policy, valid, exact, kind_reward, operation, arguments, premature, repeated, total, latency_ms."""
    share = lambda c: F.avg(c.cast("double"))
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)")
    out = scores.groupBy("policy").agg(
        F.count(F.lit(1)).alias("cases"),
        share(F.col("kind_reward") > 0).alias("kind_accuracy"),
        share(F.col("operation") > 0).alias("operation_accuracy"),
        share(F.col("arguments") == 0.5).alias("argument_accuracy"),
        share(~F.col("valid")).alias("invalid_rate"),
        F.count_if(F.col("premature") < 0).alias("premature"),
        F.count_if("repeated").alias("repeated"),
        share(F.col("exact")).alias("success"),
        F.avg("total").alias("mean_reward"),
        disc(0.5).alias("latency_p50"),
        disc(0.95).alias("latency_p95"),
    )
    one = out.filter(F.col("policy") == base).select(F.col("success").alias("s"), F.col("mean_reward").alias("r"))  # one row
    j = out.join(F.broadcast(one), how="left")
    return j.withColumns({"success_delta": F.col("success") - F.col("s"), "reward_delta": F.col("mean_reward") - F.col("r")}).drop("s", "r")


def error_rates(pairs: DataFrame) -> DataFrame:
    """Word and character error rates of (reference, hypothesis)."""
    return pairs.withColumns({"wer": word_error_rate(F.col("reference"), F.col("hypothesis")), "cer": character_error_rate(F.col("reference"), F.col("hypothesis"))})


def asr_table(spans: DataFrame, gold: DataFrame) -> DataFrame:
    """A10: case_id, wer, cer, start and end errors, error kind by word counts.

    spans: case_id, pos, text, start_ms, end_ms; gold: case_id, text, start_ms, end_ms."""
    joined = spans.groupBy("case_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("hypothesis"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e")
    )
    j = gold.withColumnRenamed("text", "reference").join(joined, "case_id", "left").withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))
    a, b = F.size(words(F.col("reference"))), F.size(words(F.col("hypothesis")))
    out = error_rates(j).withColumn("kind", F.when(F.col("wer") == 0, "correct").when(b < a, "deletion").when(b > a, "insertion").otherwise("substitution"))
    return out.select("case_id", "wer", "cer", F.abs(F.col("s") - F.col("start_ms")).alias("start_error"), F.abs(F.col("e") - F.col("end_ms")).alias("end_error"), "kind")


def threshold_sweep(scenes: DataFrame) -> DataFrame:
    """Threshold, n_scenes, videos: how many videos have how many scenes at a threshold; scenes: threshold, video_id."""
    return scenes.groupBy("threshold", "video_id").agg(F.count(F.lit(1)).alias("n_scenes")).groupBy("threshold", "n_scenes").agg(F.count(F.lit(1)).alias("videos"))



def rollout_tables(records: DataFrame, cuts: list[tuple[int, str]], rest: str, holdout: int = 2) -> tuple[DataFrame, DataFrame]:
    """Inputs (sample_id, subsplit, stage, prompt, snapshot) and labels (sample_id, expected), one to one; the last source groups are
    held out, the stage follows the position in the trajectory.

    records: record_id, trajectory_id, pos, source_group, prompt, target."""
    from quillspan.operators.event_log import stages
    from quillspan.operators.governance import group_holdout

    r = group_holdout(stages(records, "trajectory_id", "pos", cuts, rest), "source_group", holdout)
    sample = F.sha2(F.concat(F.lit("sample|"), F.col("record_id")), 256).alias("sample_id")
    return r.select(sample, "subsplit", "stage", "prompt", F.sha2("prompt", 256).alias("snapshot")), r.select(sample, F.col("target").alias("expected"))
