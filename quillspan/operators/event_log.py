"""Event logs of runs: order audits, folds, repeats, lineage.

Windows run per run; a run is bounded by its step budget. Every function names its order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.plans.scratch import materialize


def fingerprint(*columns: str) -> Column:
    """Digest of the values of columns, nulls told apart from texts."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def audit_log(events: DataFrame, budget: int) -> DataFrame:
    """The first violation of each run: run_id, sequence_no, violation.

    events: run_id, task_id, run_task, event_id, sequence_no, parent_version, kind, revision, delta. Checks in order: task,
    duplicate id, sequence gap, parent version, event after terminal, plan revision, budget. Positions follow the arrival order
    ``arrival``.
    """
    w = Window.partitionBy("run_id").orderBy("arrival")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumns(
        {
            "n": F.row_number().over(w),
            "copy": F.row_number().over(Window.partitionBy("run_id", "event_id").orderBy("arrival")),
            "expected": F.coalesce(F.max("sequence_no").over(before), F.lit(0)) + 1,
            "ended": F.coalesce(F.max(F.col("kind") == "terminal").over(before), F.lit(False)),
            "revised": F.count_if(F.col("kind") == "plan").over(so_far),
            "used": F.sum(F.when(F.col("kind") == "budget", F.col("delta")).otherwise(0)).over(so_far),
        }
    )
    violation = (
        F.when(F.col("task_id") != F.col("run_task"), "task_mismatch")
        .when(F.col("copy") > 1, "duplicate_event")
        .when(F.col("sequence_no") != F.col("expected"), "sequence")
        .when(F.col("parent_version") != F.col("sequence_no") - 1, "parent_version")
        .when(F.col("ended"), "after_terminal")
        .when((F.col("kind") == "plan") & (F.col("revision") != F.col("revised")), "plan_revision")
        .when((F.col("kind") == "budget") & (F.col("used") > budget), "budget")
    )
    bad = e.withColumn("violation", violation).filter("violation IS NOT NULL")
    return bad.groupBy("run_id").agg(F.min_by(F.struct("sequence_no", "violation"), "arrival").alias("v")).select("run_id", "v.sequence_no", "v.violation")


def fold_state(events: DataFrame) -> DataFrame:
    """Final state of each run: budget used, last plan revision, working artifact, terminal reason, number of events.

    One hash aggregate: the latest value of a field is the one of the largest sequence number that sets it."""
    last = lambda c, cond: F.max_by(c, F.when(cond, F.col("sequence_no")))
    k = F.col("kind")
    return events.groupBy("run_id").agg(
        F.sum(F.when(k == "budget", F.col("delta")).otherwise(0)).alias("used"),
        last("revision", k == "plan").alias("plan_revision"),
        last("artifact_id", (k == "edit") & F.col("succeeded")).alias("working_artifact"),
        last("reason", k == "terminal").alias("terminal_reason"),
        F.max("sequence_no").alias("last_sequence"),
        F.count(F.lit(1)).alias("n_events"),
    )


def nth_repeat(rows: DataFrame, columns: list[str], order: str, limit: int, run: str = "run_id") -> DataFrame:
    """Occurrence number of each row among the equal rows of its run, and whether it exceeds the limit."""
    w = Window.partitionBy(run, "fingerprint").orderBy(order)
    return rows.withColumn("fingerprint", fingerprint(*columns)).withColumn("occurrence", F.row_number().over(w)).withColumn("alert", F.col("occurrence") > limit)


def no_gain_repeats(calls: DataFrame, columns: list[str], version: str, order: str, limit: int, run: str = "run_id") -> DataFrame:
    """Number of consecutive equal edits without a higher information version; a gain starts anew at 0."""
    w = Window.partitionBy(run, "fingerprint").orderBy(order)
    c = calls.withColumn("fingerprint", fingerprint(*columns))
    c = c.withColumn("gain", F.lag(version).over(w).isNull() | (F.col(version) > F.lag(version).over(w)))
    c = c.withColumn("island", F.sum(F.col("gain").cast("int")).over(w))
    inside = Window.partitionBy(run, "fingerprint", "island").orderBy(order)
    return c.withColumn("no_gain", F.row_number().over(inside) - 1).withColumn("alert", F.col("no_gain") >= limit).drop("gain", "island")


def information_version(rows: DataFrame, order: str, artifact: str, verification: str, run: str = "run_id") -> DataFrame:
    """The version that W4 compares: distinct artifacts and distinct verifications seen so far in the run."""
    first = lambda c: (F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy(run, c).orderBy(order)) == 1)).cast("int")
    marked = rows.withColumns({"__a": first(artifact), "__v": first(verification)})
    return marked.withColumn("version", F.sum(F.col("__a") + F.col("__v")).over(Window.partitionBy(run).orderBy(order))).drop("__a", "__v")


def unchanged_plans(plans: DataFrame, columns: list[str], order: str, run: str = "run_id") -> DataFrame:
    """Plans equal to the one before."""
    w = Window.partitionBy(run).orderBy(order)
    p = plans.withColumn("fingerprint", fingerprint(*columns))
    return p.withColumn("unchanged", F.coalesce(F.lag("fingerprint").over(w) == F.col("fingerprint"), F.lit(False)))


def stages(records: DataFrame, run: str, order: str, cuts: list[tuple[int, str]], rest: str) -> DataFrame:
    """Position in the trajectory (from 0) -> curriculum stage: the first cut that it is below."""
    p = records.withColumn("position", F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1)
    stage = F.lit(rest)
    for bound, name in reversed(cuts):
        stage = F.when(F.col("position") < bound, name).otherwise(stage)
    return p.withColumn("stage", stage)


def rollout_groups(rollouts: DataFrame, sample: str, order: str, k: int = 4) -> DataFrame:
    """The n-th rollout of a sample is number ``n mod k`` of its group ``n div k``."""
    n = F.row_number().over(Window.partitionBy(sample).orderBy(order)) - 1
    return rollouts.withColumn("__n", n).withColumns({"group": F.floor(F.col("__n") / k).cast("long"), "place": (F.col("__n") % k).cast("long")}).drop("__n")


#: Rounds of single steps in ``ancestors`` before steps are joined to longer ones.
SINGLE_STEPS = 16


def _doubled(jumps: DataFrame, most: int) -> DataFrame | None:
    """(child, parent) of two jumps in a row; None if the join has more than ``most`` rows."""
    here = jumps.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    out = here.join(jumps.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n_out")), "node")
    if (out.agg(F.sum(F.col("n_in").cast("double") * F.col("n_out"))).first()[0] or 0) > most:
        return None
    up = jumps.select(F.col("child").alias("middle"), F.col("parent").alias("next"))
    return materialize(jumps.join(up, F.col("parent") == F.col("middle")).select("child", F.col("next").alias("parent")).distinct(), "jumps")


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) for all nodes that are reached from a start over child -> parent edges; cycles do no harm.

    Each round joins only the newly found pairs to the edges and drops the known ones, until nothing is new. Where that
    takes more than ``SINGLE_STEPS`` rounds, edges give way to jumps of 2, 4, 8, ... steps, so that a long chain takes
    rounds in its logarithm; jumps grow no further once they would be more than twice the edges.

    With all pairs of fewer than ``reach`` steps known, one round adds those of fewer than ``reach + length`` (the length
    of a jump, ``reach`` at most). A round without a new pair ends the search: the shortest path to a farther node would
    pass one.
    """
    jumps = edges.filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("child", "parent").distinct()
    known = materialize(starts.select("start", F.col("start").alias("node")).distinct(), "reached")
    new, reach, length, most = known, 1, 1, None
    growing = True
    while True:
        if growing and reach > SINGLE_STEPS:
            if most is None:
                jumps = materialize(jumps, "jumps")
                most = 2 * jumps.count()
            while growing and 2 * length <= reach:
                longer = _doubled(jumps, most)
                if longer is None:
                    growing = False
                else:
                    jumps, length, new = longer, 2 * length, known
        step = new.join(jumps, F.col("node") == F.col("child")).select("start", F.col("parent").alias("node")).distinct()
        new = materialize(step.join(known, ["start", "node"], "left_anti"), "frontier")
        if new.isEmpty():
            return known
        known = materialize(known.unionByName(new), "reached")
        reach += length


def unknown_citations(citations: DataFrame, observed: list[DataFrame]) -> DataFrame:
    """Cited (run_id, evidence_id) that no observation table of the run holds."""
    seen = observed[0].select("run_id", "evidence_id")
    for o in observed[1:]:
        seen = seen.unionByName(o.select("run_id", "evidence_id"))
    return citations.join(seen, ["run_id", "evidence_id"], "left_anti")


def first_after(chain: list[DataFrame], order: str = "seq", run: str = "run_id") -> DataFrame:
    """For the first event of the first table, the first event of each next table after the one before it.

    Returns run_id, seq_0, seq_1, ...; null from the first step without a match."""
    out = chain[0].groupBy(run).agg(F.min(order).alias("seq_0"))
    for i, step in enumerate(chain[1:], 1):
        found = out.join(step.select(run, F.col(order).alias("__s")), run).filter(F.col("__s") > F.col(f"seq_{i - 1}")).groupBy(run).agg(F.min("__s").alias(f"seq_{i}"))
        out = out.join(found, run, "left")
    return out
