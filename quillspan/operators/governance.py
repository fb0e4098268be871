"""Sampling, leak scans, split governance and statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.plans.scratch import dealt, materialize
from quillspan.sources.records import manifest

PIECE = 1 << 16  # draws that are made from one row
SENT = 1 << 20  # sources whose sums (four numbers each) are sent to all tasks


def numbered(rows: DataFrame, order: list[str], name: str = "__n") -> DataFrame:
    """Positions from 0 in a total order without a single-partition sort of wide rows: rows are range partitioned and sorted,
    counted per partition, and offsets of partitions (one row each) are added. The sorted rows are written once, because a
    second sampling of the ranges could place rows otherwise."""
    s = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    s = materialize(s, "numbered")
    first = s.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__i").alias("__first"))
    offsets = first.withColumn("__off", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.join(F.broadcast(offsets.select("__p", "__off", "__first")), "__p").withColumn(name, F.col("__off") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__off", "__first")


def sums_before(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``<column>_before``: the sum of each column over all rows before the row in the order of a column without ties. Rows are range
    partitioned and summed per partition; what stands before a partition is one row each, so no task sees all rows."""
    s = materialize(rows.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ranges")
    by = s.groupBy("__p").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by.select("__p", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns])
    here = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = s.join(F.broadcast(offsets), "__p")
    return out.withColumns({f"{c}_before": F.col(f"__{c}") + F.coalesce(F.sum(c).over(here), F.lit(0)) for c in columns}).drop("__p", *[f"__{c}" for c in columns])


def even_sample(rows: DataFrame, m: int, order: str) -> DataFrame:
    """L2: rows at the positions ``round(i * (n - 1) / max(m - 1, 1))``, halves to even, each once."""
    n = numbered(rows.select(order), [order])
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    at = rows.sparkSession.range(m).select(F.col("id").alias("i")).join(F.broadcast(total)).select(F.bround(F.col("i") * (F.col("n") - 1) / max(m - 1, 1), 0).cast("long").alias("__n")).distinct()
    return rows.join(n.join(F.broadcast(at), "__n").select(order), order, "left_semi")


def mixed_sample(rows: DataFrame, best: int, total: int, score: str, key: str) -> DataFrame:
    """L3: the ``best`` rows by score (ties by key), and of the rest, in key order, every (rest div need)-th."""
    top = rows.orderBy(F.col(score).desc(), key).limit(best)
    rest = numbered(rows.join(top.select(key), key, "left_anti"), [key])
    need = total - best
    step = rows.agg(F.greatest(F.lit(1), F.floor((F.count(F.lit(1)) - best) / need)).alias("__step"))
    picked = rest.join(F.broadcast(step)).filter((F.col("__n") % F.col("__step") == 0) & (F.col("__n") / F.col("__step") < need)).drop("__n", "__step")
    return top.withColumn("part", F.lit("best")).unionByName(picked.withColumn("part", F.lit("spread")))


def first_packet(rows: DataFrame, allowed: list[str], n: int, order: str) -> DataFrame:
    """L4: the first n rows of allowed splits."""
    return rows.filter(F.col("split").isin(allowed)).orderBy(order).limit(n)


def group_holdout(rows: DataFrame, group: str, n: int = 2) -> DataFrame:
    """The last n groups in sort order are held out; one row a group is ranked, then joined back."""
    groups = rows.select(group).distinct().orderBy(F.col(group).desc()).limit(n)
    return rows.join(groups.withColumn("__h", F.lit(True)), group, "left").withColumn("subsplit", F.when(F.col("__h"), "holdout").otherwise("train")).drop("__h")


def group_overlap(rows: DataFrame, group: str, subsplit: str) -> DataFrame:
    """Groups that occur in several subsplits."""
    return rows.groupBy(group).agg(F.min(subsplit).alias("lo"), F.max(subsplit).alias("hi")).filter("lo <> hi").select(group)


def exact_duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, n_distinct, n_duplicates by the digest of columns."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    return rows.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("h").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


# What counts as a path of a machine and as hidden content of a page. The drive pattern also takes the end of a URL's scheme.
PATHS = {"path": 'file://|["\\s](/home|/root|/users|/data|/mnt)/|/(home|root|users)/', "windows_path": "[a-z]:[\\\\/]"}
HIDDEN = {"hidden_html": "<!--|<script|\\sdata-[a-z]"}


def leak_scan(rows: DataFrame, key: str, text: str, tokens: DataFrame, private_keys: list[str], name: str | None = None) -> DataFrame:
    """Key, location, finding, detail: forbidden tokens in case-folded text, private keys of nested JSON, paths, hidden HTML; with
    ``name``, tokens and paths in that column too (location "filename").

    tokens: a table (token) of the dataset, a list written by hand; it travels as one row. Empty and null tokens find nothing. A private key
    is found at any depth, where a quoted name stands before a colon; inside a string value quotes are escaped, so a value is no key."""
    listed = tokens.filter("token <> ''").agg(F.array_sort(F.collect_set("token")).alias("__tokens"))
    finding = lambda f, d: F.struct(F.lit(f).alias("finding"), F.lit(d).alias("detail"))

    def found(column: str, location: str, keys: list[str], patterns: dict[str, str]) -> Column:
        t = F.lower(F.coalesce(F.col(column), F.lit("")))
        flags = [F.when(t.rlike(f'(?<!\\\\)"{re.escape(k.lower())}"\\s*:'), finding("private_key", k)) for k in keys]
        flags += [F.when(t.rlike(p), finding(f, "")) for f, p in patterns.items()]
        said = F.transform(F.filter("__tokens", lambda x: t.contains(F.lower(x))), lambda x: F.struct(F.lit("token").alias("finding"), x.alias("detail")))
        every = F.concat(said, F.array_compact(F.array(*flags)))
        return F.transform(every, lambda x: F.struct(F.lit(location).alias("location"), x["finding"].alias("finding"), x["detail"].alias("detail")))

    parts = [found(text, "content", private_keys, PATHS | HIDDEN)] + ([found(name, "filename", [], PATHS)] if name else [])
    return rows.join(F.broadcast(listed)).select(key, F.explode(F.concat(*parts)).alias("f")).select(key, "f.*")


def cross_split(values: DataFrame) -> DataFrame:
    """G1: kind, value of (kind, value, split) seen in more than one split."""
    return values.filter(F.col("value").isNotNull()).groupBy("kind", "value").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def derivative_leaks(sources: DataFrame) -> DataFrame:
    """source_id, problem: the parent of a derivative is missing, or in another split."""
    p = sources.select(F.col("source_id").alias("derivative_of"), F.col("split").alias("parent_split"))
    j = sources.filter(F.col("derivative_of").isNotNull()).join(p, "derivative_of", "left")
    problem = F.when(F.col("parent_split").isNull(), "missing_parent").when(F.col("parent_split") != F.col("split"), "other_split")
    return j.select("source_id", problem.alias("problem")).filter("problem IS NOT NULL")


def prompt_collisions(tasks: DataFrame) -> DataFrame:
    """Finding, value: instruction and answer shared by splits (digest), task id inside its own prompt."""
    h = F.sha2(F.to_json(F.struct(F.trim(F.lower("instruction")).alias("i"), F.col("answer").alias("a")), {"ignoreNullFields": "false"}), 256)
    shared = tasks.select(h.alias("value"), "split").groupBy("value").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("collision").alias("finding"), "value")
    own = tasks.filter(F.expr("contains(lower(instruction), lower(task_id))")).select(F.lit("own_id").alias("finding"), F.col("task_id").alias("value"))
    return shared.unionByName(own)


# Names that no public record may have.
PRIVATE_FIELDS = ("split", "source_group_id", "difficulty", "ground_truth", "benchmark_gold", "evaluator_metadata", "failure_injection")


def public_leaks(tasks: DataFrame, names: tuple[str, ...] = PRIVATE_FIELDS) -> DataFrame:
    """Finding, value: private field names in the public record of a task, and task ids of others in its instruction.

    tasks: task_id, instruction, record (JSON text). Ids are met as whole tokens, by an equi join on the token."""
    keys = F.coalesce(F.json_object_keys("record"), F.array().cast("array<string>"))
    fields = tasks.filter(F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))).select(F.lit("private_field").alias("finding"), F.col("task_id").alias("value"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("instruction", F.lit(""))), F.lit("[a-z0-9_-]+"), 0))
    said = tasks.select("task_id", F.explode(tokens).alias("token"))
    ids = tasks.select(F.lower("task_id").alias("token")).distinct()
    foreign = said.join(ids, "token").filter(F.col("token") != F.lower("task_id")).select(F.lit("foreign_id").alias("finding"), F.col("task_id").alias("value")).distinct()
    return fields.unionByName(foreign)


def leakage_report(findings: dict[str, DataFrame]) -> DataFrame:
    """One row a check with its number of findings; ``passed`` is over all checks."""
    out = None
    for name, f in findings.items():
        row = f.agg(F.count(F.lit(1)).alias("n_findings")).withColumn("check", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.sum("n_findings").over(Window.partitionBy(F.lit(1))) == 0)


def health(cases: DataFrame) -> DataFrame:
    """Per (level, value): cases, mean tools and constraints, share of hard, impossible and recovery cases."""
    sets = cases.groupingSets([[], [F.col("split")], [F.col("family")], [F.col("difficulty")]], "split", "family", "difficulty")
    out = sets.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("n_tools").alias("mean_tools"),
        F.avg("n_constraints").alias("mean_constraints"),
        F.avg(F.col("difficulty_grade").isin("L3", "L4").cast("double")).alias("share_hard"),
        F.avg(F.col("impossible").cast("double")).alias("share_impossible"),
        F.avg(F.col("recovery").cast("double")).alias("share_recovery"),
        F.grouping_id().alias("g"),
    )
    level = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "split").when(F.col("g") == 5, "family").otherwise("difficulty")
    return out.select(level.alias("level"), F.coalesce("split", "family", "difficulty").alias("value"), "n", "mean_tools", "mean_constraints", "share_hard", "share_impossible", "share_recovery")


def trivial_policies(cases: DataFrame) -> DataFrame:
    """Baseline, success: what always refusing, returning the source, always taking the first scene (an upper bound) and the evaluator's own
    answers would reach.

    cases: family, expected_terminal, first_start_ms (of the first acceptable range, null without one), constraint_types array."""
    special = F.arrays_overlap("constraint_types", F.array(*[F.lit(x) for x in ("resolution", "subtitle", "scene_order", "speed")]))
    first = (F.col("expected_terminal") == "SUCCESS") & F.coalesce(F.col("first_start_ms") == 0, F.lit(False)) & ~special
    one = cases.agg(F.avg((F.col("family") == "impossible").cast("double")).alias("always_refuse"), F.lit(0.0).alias("unchanged_source"), F.avg(first.cast("double")).alias("first_scene"), F.lit(1.0).alias("oracle"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("baseline"), F.col(c).alias("success")) for c in one.columns])).alias("x")).select("x.*")


def split_manifest(cases: DataFrame, public: list[str], private: list[str], group: str, split: str) -> DataFrame:
    """Per split: tasks, groups, digests of the public and of the private columns; and whether the splits add up to all tasks and groups
    (a group in two splits is counted twice and breaks the sum)."""
    one = manifest(cases, public, group, [split]).withColumnRenamed("digest", "public_digest")
    two = manifest(cases, private, group, [split]).select(split, F.col("digest").alias("private_digest"))
    total = cases.agg(F.count(F.lit(1)).alias("__rows"), F.count_distinct(F.col(group)).alias("__groups"))  # one row
    sums = one.agg(F.sum("n_rows").alias("__r"), F.sum("n_groups").alias("__g"))  # one row
    j = one.join(two, split).join(F.broadcast(total)).join(F.broadcast(sums))
    return j.withColumn("adds_up", (F.col("__r") == F.col("__rows")) & (F.col("__g") == F.col("__groups"))).drop("__rows", "__groups", "__r", "__g")


def difficulty(n_tools: Column, n_scenes: Column, n_constraints: Column, hard: Column, recovery: Column) -> Column:
    """Grade of the sum of counts, +2 for hard negatives, +3 for recovery: up to 3 L1, 6 L2, 9 L3, else L4."""
    s = n_tools + n_scenes + n_constraints + F.when(hard, 2).otherwise(0) + F.when(recovery, 3).otherwise(0)
    return F.when(s <= 3, "L1").when(s <= 6, "L2").when(s <= 9, "L3").otherwise("L4")


def opaque_id(*columns: str, prefix: str = "task") -> Column:
    """An id from a digest; equal for equal values, whatever the row order."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16))


def parity(column: str) -> Column:
    """0 or 1 from the last hex digit of a digest."""
    return (F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 64, 1), 16, 10).cast("int") % 2).cast("int")


def ledger_errors(requests: DataFrame, records: DataFrame) -> DataFrame:
    """access_id or (split, model), problem: incomplete or differing records, records without request, not exactly one run."""
    r = records.select("access_id", F.col("split").alias("s2"), F.col("model").alias("m2"), F.col("config_sha256").alias("c2"), "status")
    j = requests.join(r, "access_id", "full_outer")
    problem = (
        F.when(F.col("status").isNull(), "no_record")
        .when(F.col("split").isNull(), "no_request")
        .when(F.col("status") != "complete", "incomplete")
        .when((F.col("split") != F.col("s2")) | (F.col("model") != F.col("m2")) | (F.col("config_sha256") != F.col("c2")), "mismatch")
    )
    rows = j.select(F.col("access_id").cast("string").alias("key"), problem.alias("problem")).filter("problem IS NOT NULL")
    runs = records.groupBy("split", "model").agg(F.count(F.lit(1)).alias("n")).filter("n <> 1").select(F.concat_ws(":", "split", "model").alias("key"), F.lit("run_count").alias("problem"))
    return rows.unionByName(runs)


def rating_errors(ratings: DataFrame, cases: DataFrame, domains: dict[str, list[str]], packet: str) -> DataFrame:
    """rater_id, case_id, rule of every broken rule of rater submissions."""
    checks = {"human": F.col("rater_type") != "human", "packet": F.col("packet_version") != packet} | {
        f"domain_{c}": F.col(c).isNull() | ~F.col(c).isin(v) for c, v in domains.items()
    }
    rows = ratings.select("rater_id", "case_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()]))).alias("rule"))
    n = ratings.groupBy("rater_id", "case_id").agg(F.count(F.lit(1)).alias("n"))
    twice = n.filter("n > 1").select("rater_id", "case_id", F.lit("duplicate").alias("rule"))
    # only raters who rated fewer of the cases than there are meet the list of cases
    known = cases.select("case_id").distinct()
    rated = n.join(known, "case_id").groupBy("rater_id").agg(F.count(F.lit(1)).alias("rated"))
    total = known.agg(F.count(F.lit(1)).alias("total"))
    short = ratings.select("rater_id").distinct().join(rated, "rater_id", "left").join(F.broadcast(total)).filter("coalesce(rated, 0) < total").select("rater_id")
    missing = short.crossJoin(known).join(n, ["rater_id", "case_id"], "left_anti").select("rater_id", "case_id", F.lit("missing").alias("rule"))
    return rows.unionByName(twice).unionByName(missing)


# Parts of names that no person has.
MODEL_NAMES = ("gpt", "claude", "llm", "qwen", "gemini", "codex", "model", "bot")


def submission_errors(ratings: DataFrame, columns: list[str], markers: tuple[str, ...] = MODEL_NAMES) -> DataFrame:
    """File, rule: more than one rater in a file; a rater whose name is too short or a model's; a rater of two files; two files with the
    same rows. ratings: file, rater_id, and ``columns``, which make a row."""
    name = F.lower(F.trim("rater_id"))
    machine = F.coalesce(F.length(name), F.lit(0)) < 2
    for m in markers:
        machine = machine | F.coalesce(name.contains(m), F.lit(False))
    per = manifest(ratings.withColumn("__g", name), columns, "__g", ["file"]).select("file", "n_groups", "digest")
    several = per.filter("n_groups > 1").select("file", F.lit("several_raters").alias("rule"))
    unfit = ratings.filter(machine).select("file", F.lit("no_person").alias("rule")).distinct()
    owners = ratings.select("file", name.alias("rater")).distinct()
    twice = owners.groupBy("rater").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rater")
    same_rater = owners.join(twice, "rater").select("file", F.lit("same_rater").alias("rule")).distinct()
    copies = per.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    same_file = per.join(copies, "digest").select("file", F.lit("same_file").alias("rule"))
    return several.unionByName(unfit).unionByName(same_rater).unionByName(same_file)


def agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Field, n, agreement, kappa of (field, a, b). Where expected agreement is 1 kappa is 1 if all agree, else null."""
    total = pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))
    left = pairs.groupBy("field", F.col(a).alias("label")).agg(F.count(F.lit(1)).alias("na"))
    right = pairs.groupBy("field", F.col(b).alias("label")).agg(F.count(F.lit(1)).alias("nb"))
    chance = left.join(right, ["field", "label"]).groupBy("field").agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    j = total.join(chance, "field", "left").withColumn("e", F.coalesce("x", F.lit(0)) / (F.col("n") * F.col("n")))
    kappa = F.when(F.col("e") < 1, (F.col("agreement") - F.col("e")) / (1 - F.col("e"))).when(F.col("agreement") == 1, 1.0)
    return j.select("field", "n", "agreement", kappa.alias("kappa"))


def adjudicate(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Field, case_id, label, problem: agreed labels, decided labels, disagreements without a decision, decisions without
    a disagreement."""
    d = decisions.select("field", "case_id", "decision")
    j = pairs.join(d, ["field", "case_id"], "full_outer")
    agreed = F.col("a") == F.col("b")
    problem = F.when(F.col("a").isNull(), "unknown_case").when(agreed & F.col("decision").isNotNull(), "not_disputed").when(~agreed & F.col("decision").isNull(), "undecided")
    return j.select("field", "case_id", F.when(agreed, F.col("a")).otherwise(F.col("decision")).alias("label"), problem.alias("problem"))


def paired_bootstrap(outcomes: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Arm rates and their difference with 2.5 and 97.5 % limits (linear interpolation) over resampled sources.

    outcomes: task_id, source_id, base (0/1), other (0/1). Tasks are summed per source first, so the work is resamples x sources;
    draws come from a hash of (seed, resample, draw), so that reruns agree. Draws are made in pieces and summed where they are made: the sums of
    the sources go to them, up to ``SENT`` sources; more sources meet the draws by position. Spark takes the draws for one row a piece, so the side
    that is held in memory is named here."""
    per = outcomes.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("base").alias("b"), F.sum("other").alias("o"))
    per = materialize(numbered(per, ["source_id"], "at").select("at", "n", "b", "o"), "sources")
    total = per.agg(F.count(F.lit(1)).alias("sources"))
    pieces = outcomes.sparkSession.range(resamples).select(F.col("id").alias("r")).join(F.broadcast(total)).filter("sources > 0")
    pieces = dealt(pieces.select("r", "sources", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sources") - 1, F.lit(PIECE).cast("long"))).alias("first")))
    draws = pieces.select("r", "sources", F.explode(F.sequence("first", F.least(F.col("first") + PIECE, F.col("sources")) - 1)).alias("i"))
    draws = draws.select("r", F.pmod(F.xxhash64(F.lit(seed), "r", "i"), F.col("sources")).alias("at"))
    held = F.broadcast(per) if per.count() <= SENT else per.hint("shuffle_hash")
    rates = draws.join(held, "at").groupBy("r").agg((F.sum("b") / F.sum("n")).alias("base"), (F.sum("o") / F.sum("n")).alias("other")).withColumn("difference", F.col("other") - F.col("base"))
    point = outcomes.agg(F.avg("base").alias("base"), F.avg("other").alias("other")).withColumn("difference", F.col("other") - F.col("base"))
    names = ["base", "other", "difference"]
    limits = rates.agg(*[F.percentile(c, q).alias(f"{c}_{n}") for c in names for n, q in (("lo", 0.025), ("hi", 0.975))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).alias("value"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")) for c in names])).alias("x")
    return point.join(limits).select(rows).select("x.*")  # one row on each side


def outcome_errors(evaluations: DataFrame, sources: DataFrame, stored: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Problem, key: tasks without a source, arms whose recomputed rate differs from the stored one."""
    lost = evaluations.join(sources, "task_id", "left_anti").select(F.lit("no_source").alias("problem"), F.col("task_id").cast("string").alias("key"))
    rate = evaluations.groupBy("arm").agg(F.avg(F.col("success").cast("double")).alias("rate"))
    off = rate.join(stored, "arm", "full_outer").filter(~F.coalesce(F.abs(F.col("rate") - F.col("stored_rate")) <= tolerance, F.lit(False))).select(F.lit("rate").alias("problem"), F.col("arm").alias("key"))
    return lost.unionByName(off)


def compare_arms(rows: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """Success rate of two arms and their difference, over all and by each column of ``by``."""
    long = rows.select("arm", "success", F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in by])).alias("g"))
    p = long.select("g.*", "arm", F.col("success").cast("double").alias("s")).groupBy("level", "value").pivot("arm", [first, second]).agg(F.avg("s"))
    return p.withColumn("delta", F.col(second) - F.col(first))
