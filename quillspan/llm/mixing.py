"""Mixing sources to target weights by entropy balancing.

Every document gets a rate in [0, 2] (the expected number of copies). Per source the rates are those of largest
(bounded) entropy whose expected tokens meet the source's target: ``rate = 2 / (1 + exp(-lambda_s * size / mean_s))``,
an exponential tilt of the odds ``rate / (2 - rate)`` by the token count. ``lambda_s`` minimises a convex dual, one
number a source, found by safeguarded Newton steps: each step is one distributed aggregation of gradient and Hessian
over the (source, size) histogram, for all sources at once. Rates are rounded into 0, 1 or 2 copies with the error
carried from large to small documents inside bounded groups, so that each group meets its own expected tokens, as far as
its smaller documents can make up for a very long one.

Definitions that hold for every row:

* size is the number of words of the text; null or empty texts have size 0 and are never taken;
* a null source is a source of its own, ranked last; sources rank by code point and get ``weights`` in turn;
* a target never exceeds ``max_copies`` times the size of its source, the excess goes to the others by weight;
* repeated rows are separate candidates, told apart by a number; null or repeated ``doc_id`` only take part in a hash;
* a target that the duals don't meet raises an error;
* an empty table, or one without words, gives targets of 0 and takes nothing;
* reruns agree: all choices come from hashes of the row and total orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.text import spread, word_count
from quillspan.plans.scratch import discard, materialize

#: Documents of one rounding group, about; the group is folded in one row, so this bounds its memory. What a very long document gets too
#: much or too little by is made up for by the others of its group, as far as they can.
GROUP = 256
MAX_COPIES = 2


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """source, source_size, target of a table (source, source_size), one row a source.

    Water filling: target = min(2 * size, level * weight). In the order of ``2 * size / weight`` the sources below
    the level come first, so that running sums give the level in one pass over the one-row-a-source table.
    """
    nulls_last = [F.col("source").isNull().asc(), F.col("source").asc()]
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(*nulls_last)) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.lit(float(MAX_COPIES)) * F.col("source_size"))
        .withColumn("fill", F.col("cap") / F.col("weight"))
    )
    by_fill = Window.orderBy("fill", "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranked.withColumn("wanted", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level_here", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        # the first source that does not fill up sets the level of all after it
        .withColumn("level", F.min(F.when(F.col("level_here") <= F.col("fill"), F.struct("fill", "rank", "level_here"))).over(everything)["level_here"])
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))
    )


def _group() -> Column:
    return F.pmod(F.xxhash64("doc_id", "size", "h", "nth", F.lit(17)), F.ceil(F.col("n_docs") / GROUP))


def _rate(x: Column, lam: Column) -> Column:
    return F.lit(float(MAX_COPIES)) / (1 + F.exp(-lam * x))


def solve_duals(hist: DataFrame, goals: DataFrame, steps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """source, mean, lambda of hist (source, size, n) and goals (source, target, source_size, mean).

    Newton in ``lambda`` inside a bracket that shrinks with the sign of the gradient (which rises in ``lambda``). A
    bracket is open at first; while it is, a step goes no further than to twice the distance from 0, so that it finds the sign change
    however far out a skewed source has it. A step that leaves a closed bracket is replaced by its middle. One aggregation and
    one small written table a step. A dual that is not met after ``steps`` steps is an error, not a result.
    """
    open_ = goals.filter((F.col("target") > 0) & (F.col("target") < MAX_COPIES * F.col("source_size") * (1 - 1e-12)))
    nothing = F.lit(None).cast("double")
    state = open_.select("source", "target", "mean", F.lit(0.0).alias("lam"), nothing.alias("lo"), nothing.alias("hi"), F.lit(1.0).alias("off"))
    state = materialize(state, "dual")
    for _ in range(steps):
        both = hist.join(state, hist["source"].eqNullSafe(state["source"])).select(
            state["source"], "target", "mean", "lam", "lo", "hi", "size", "n", (F.col("size") / F.col("mean")).alias("x")
        )
        r = _rate(F.col("x"), F.col("lam"))
        sums = both.groupBy("source", "target", "mean", "lam", "lo", "hi").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"),
            F.sum(F.col("n") * F.col("size") * F.col("x") * r * (1 - r / MAX_COPIES)).alias("slope"),
        )
        gap, lam = F.col("got") - F.col("target"), F.col("lam")
        lo, hi = F.when(gap < 0, lam).otherwise(F.col("lo")), F.when(gap > 0, lam).otherwise(F.col("hi"))
        newton = lam - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        stepped = sums.select("source", "target", "mean", lo.alias("lo"), hi.alias("hi"), newton.alias("newton"), (F.abs(gap) / F.col("target")).alias("off"), "lam")
        reach = F.greatest(F.lit(4.0), 2 * F.abs(lam))
        inside = F.greatest(lam - reach, F.least(lam + reach, F.col("newton")))
        stepped = stepped.select(
            "source",
            "target",
            "mean",
            F.when(F.col("off") < tolerance, lam)
            .when(F.col("lo").isNull() | F.col("hi").isNull(), inside)
            .when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton"))
            .otherwise((F.col("lo") + F.col("hi")) / 2)
            .alias("lam"),
            "lo",
            "hi",
            "off",
        )
        before, state = state, materialize(stepped, "dual")
        discard(before)
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < tolerance:
            return state.select("source", "mean", "lam")
    raise RuntimeError(f"the duals are off by a share of {worst} of their targets after {steps} steps")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, rate, copies, taken (copies * size)."""
    return _mix(docs, weights, share, doc_id, source, text).drop("h")


def _mix(docs: DataFrame, weights: tuple[float, ...], share: float, doc_id: str, source: str, text: str) -> DataFrame:
    """``mix`` with h, the hash of the text. Rows that agree in id, source, size and h are counted, and told apart by a number."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("h"))
    counted = materialize(rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n")), "sized")
    hist = materialize(counted.groupBy("source", "size").agg(F.sum("n").alias("n")), "size-histogram")
    sized = spread(counted)
    per_source = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")
    ).withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
    goals = materialize(
        targets(per_source.select("source", "source_size"), weights, share)
        .withColumnRenamed("source", "goal_source")
        .join(per_source.drop("source_size"), F.col("goal_source").eqNullSafe(F.col("source")))
        .drop("goal_source"),
        "goals",
    )
    duals = solve_duals(hist, goals)
    plan = materialize(
        goals.join(duals.select(F.col("source").alias("dual_source"), "lam"), F.col("source").eqNullSafe(F.col("dual_source")), "left").select(
            F.col("source").alias("plan_source"), "source_size", "target", "mean", "n_docs", "lam"
        ),
        "mix-plan",
    )
    full = F.col("lam").isNull()  # no dual: all of the source is taken twice, or nothing is wanted
    rated = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn(
        "rate",
        F.when(full, F.when(F.col("target") > 0, F.lit(float(MAX_COPIES))).otherwise(F.lit(0.0))).otherwise(_rate(F.col("size") / F.col("mean"), F.col("lam"))),
    )
    # groups of a bounded size: as many a source as its documents need, dealt by a hash that differs between any two rows
    groups = rated.withColumn("group", _group()).groupBy("source", "group", "source_size", "target").agg(
        F.sort_array(F.collect_list(F.struct("size", F.xxhash64("doc_id").alias("k"), "doc_id", "h", "nth", "rate")), asc=False).alias("docs")
    )
    copies = F.aggregate(
        "docs",
        F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("copies")),
        lambda a, d: F.struct(
            (a["owed"] + d["rate"] * d["size"] - _copies(a["owed"], d) * d["size"]).alias("owed"),
            F.concat(a["copies"], F.array(_copies(a["owed"], d))).alias("copies"),
        ),
        lambda a: a["copies"],
    )
    dealt = groups.select("source", "source_size", "target", F.explode(F.arrays_zip(F.col("docs").alias("d"), copies.alias("c"))).alias("z"))
    return dealt.select(
        F.col("z.d.doc_id").alias("doc_id"),
        F.col("z.d.h").alias("h"),
        "source",
        F.col("z.d.size").alias("size"),
        "source_size",
        "target",
        F.col("z.d.rate").alias("rate"),
        F.col("z.c").alias("copies"),
        (F.col("z.c") * F.col("z.d.size")).cast("long").alias("taken"),
    )


def take(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it (0, 1 or 2 times).

    Copies are looked up by document, source and hash of the text: texts are shuffled once, against a table of numbers. Rows that agree
    in all three take the copies of their kind in turn, by their number among them; only where such rows exist are texts
    read a second time. That number comes from counts of the parts of the input, so no group of rows meets in one task.
    """
    plan = _mix(docs, weights, share, doc_id, source, text).groupBy("doc_id", "source", "h").agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows"))
    plan = plan.filter("__all > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("h").alias("__hash"), "__all", "__rows")
    plan = materialize(plan, "taken")
    keyed = docs.withColumn("__h", F.xxhash64(text))
    on = F.col(doc_id).eqNullSafe(F.col("__id")) & F.col(source).cast("string").eqNullSafe(F.col("__source")) & (F.col("__h") == F.col("__hash"))
    dealt = keyed.join(plan.filter("__rows = 1").hint("shuffle_hash"), on).withColumn("__copies", F.col("__all")).select(*docs.columns, "__copies")
    several = plan.filter("__rows > 1")
    if not several.isEmpty():
        parts = keyed.withColumn("__part", F.spark_partition_id())
        key = ["__id", "__source", "__hash"]
        held = materialize(parts.join(several.hint("shuffle_hash"), on).select(*docs.columns, *key, "__part", "__all", "__rows"), "repeated-rows")
        before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        counts = held.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__n"))
        starts = counts.select(*[F.col(c).alias(f"{c}2") for c in [*key, "__part"]], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
        same = F.lit(True)
        for c in (*key, "__part"):
            same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
        at = F.row_number().over(Window.partitionBy(*key, "__part").orderBy("__part")) - 1 + F.col("__start")
        numbered = held.join(starts, same).withColumn("__at", at)
        share_of = lambda i: F.floor(i * F.col("__all") / F.col("__rows"))
        dealt = dealt.unionByName(numbered.withColumn("__copies", share_of(F.col("__at") + 1) - share_of(F.col("__at"))).select(*docs.columns, "__copies"))
    dealt = dealt.filter("__copies > 0")
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))).select(docs.columns)


def _copies(owed: Column, d: Column) -> Column:
    """Copies that bring the group nearest to what it is owed with this document included; none of an empty one."""
    wish = F.floor((owed + d["rate"] * d["size"]) / F.greatest(d["size"], F.lit(1)) + 0.5)
    return F.when(d["size"] == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(MAX_COPIES), wish)).cast("int"))
