"""Interval joins, scene assembly and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.intervals import overlaps
from quillspan.operators.governance import numbered
from quillspan.plans.scratch import discard, materialize

BUCKET_MS = 60_000


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width)))


def overlap_join(spans: DataFrame, scenes: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """All (span, scene) pairs of a key with ``a.start < b.end and b.start < a.end``.

    Both sides are cut into fixed time buckets, so the join is an equi join on (key, bucket), which Spark can split where a key is hot. A pair
    is reported in the bucket in which the later of the two starts, hence once: no distinct is needed. Span columns keep their
    names, scene columns get the prefix ``scene_``.
    """
    s = scenes.select(*[F.col(c).alias(c if c in (key, "scene_id") else f"scene_{c}") for c in scenes.columns])
    a = spans.withColumn("__b", _buckets(F.col("start_ms"), F.col("end_ms"), bucket_ms))
    b = s.withColumn("__b", _buckets(F.col("scene_start_ms"), F.col("scene_end_ms"), bucket_ms))
    j = a.join(b, [key, "__b"])
    home = F.floor(F.greatest("start_ms", "scene_start_ms") / bucket_ms)
    return j.filter(overlaps(F.col("start_ms"), F.col("end_ms"), F.col("scene_start_ms"), F.col("scene_end_ms")) & (F.col("__b") == home)).drop("__b")


def assemble_scenes(scenes: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row a scene with an ordered list a part table (video_id, scene_id, pos, value), and a summary of all, joined by " | "."""
    out = scenes
    for name, part in parts.items():
        agg = part.groupBy("video_id", "scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(name))
        out = out.join(agg, ["video_id", "scene_id"], "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({n: F.coalesce(n, empty) for n in parts})
    return out.withColumn("summary", F.array_join(F.flatten(F.array(*parts)), " | "))


def midpoint_scene(nominal: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """nominal_id, n_scenes, scene_id: the detected scene that holds the middle of a nominal one; an error unless n_scenes is 1."""
    n = nominal.withColumn("middle", F.floor((F.col("start_ms") + F.col("end_ms")) / 2)).withColumn("end_ms", F.col("middle") + 1).withColumn("start_ms", F.col("middle"))
    j = overlap_join(n, detected, key)
    found = j.groupBy("nominal_id").agg(F.count(F.lit(1)).alias("n_scenes"), F.min("scene_id").alias("scene_id"))
    return nominal.select("nominal_id").join(found, "nominal_id", "left").select("nominal_id", F.coalesce("n_scenes", F.lit(0)).alias("n_scenes"), F.when(F.col("n_scenes") == 1, F.col("scene_id")).alias("scene_id"))


def uncovered_claims(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """Claims without a catalogue entry that covers them.

    claims: claim_id, artifact_id, kind, segment_id, at_ms, start_ms, end_ms (a point or a range or neither). An entry covers
    a claim of its artifact and kind if its segment is equal or null, and its point equals or its range holds the
    claim's; a point entry never covers a range.
    """
    c = catalog.select("artifact_id", "kind", F.col("segment_id").alias("cs"), F.col("at_ms").alias("ca"), F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1"))
    segment = F.col("cs").isNull() | F.col("segment_id").eqNullSafe(F.col("cs"))
    point = F.col("at_ms").isNull() | (F.col("ca") == F.col("at_ms")) | ((F.col("c0") <= F.col("at_ms")) & (F.col("at_ms") < F.col("c1"))) | (F.col("ca").isNull() & F.col("c0").isNull())
    span = F.col("start_ms").isNull() | ((F.col("c0") <= F.col("start_ms")) & (F.col("end_ms") <= F.col("c1"))) | (F.col("ca").isNull() & F.col("c0").isNull())
    covered = claims.join(c, ["artifact_id", "kind"]).filter(segment & F.coalesce(point, F.lit(False)) & F.coalesce(span, F.lit(False))).select("claim_id").distinct()
    return claims.join(covered, "claim_id", "left_anti")


def contiguity_errors(scenes: DataFrame, durations: DataFrame) -> DataFrame:
    """video_id, scene_id, problem (start, gap, overlap, end) of scenes that do not tile [0, duration)."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "scene_id")
    s = scenes.withColumns({"before": F.lag("end_ms").over(w), "last": F.lead("start_ms").over(w).isNull()}).join(durations, "video_id")
    problem = (
        F.when(F.col("before").isNull() & (F.col("start_ms") != 0), "start")
        .when(F.col("before") < F.col("start_ms"), "gap")
        .when(F.col("before") > F.col("start_ms"), "overlap")
        .when(F.col("last") & (F.col("end_ms") != F.col("duration_ms")), "end")
    )
    return s.select("video_id", "scene_id", problem.alias("problem")).filter("problem IS NOT NULL")


def train_only(requests: DataFrame, registry: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may be read (split train), and an audit row for each other request (its split, or unknown)."""
    j = requests.join(registry.select(key, "split"), key, "left")
    return j.filter("split = 'train'").drop("split"), j.filter("split IS NULL OR split <> 'train'").withColumn("reason", F.coalesce("split", F.lit("unknown")))


def missing_assets(references: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Key, problem: referenced but absent (missing), or present with two contents (conflict)."""
    wanted = references.select(key).distinct()
    missing = wanted.join(assets, key, "left_anti").withColumn("problem", F.lit("missing"))
    twice = assets.join(wanted, key, "left_semi").groupBy(key).agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).filter("lo <> hi").select(key, F.lit("conflict").alias("problem"))
    return missing.unionByName(twice)


def relevance_sets(labels: DataFrame, min_scenes: int = 2) -> DataFrame:
    """Normalised label -> its scenes (sorted), their number, and whether the evidence is held anywhere. Letters and digits of every script count."""
    norm = F.trim(F.regexp_replace(F.lower("label"), "[^\\p{L}\\p{N}]+", " "))
    g = labels.groupBy(norm.alias("label")).agg(F.array_sort(F.collect_set("scene_id")).alias("scenes"), F.max("has_evidence").alias("evidence_available"))
    return g.withColumn("n_scenes", F.size("scenes")).filter(F.col("n_scenes") >= min_scenes)


def differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key and column whose values differ (nulls are values), or whose key is on one side only."""
    values = [c for c in first.columns if c not in keys]
    a = first.select(*keys, F.struct(*values).alias("a"))
    b = second.select(*keys, F.struct(*values).alias("b"))
    j = a.join(b, keys, "full_outer")
    text = lambda s, c: F.col(s)[c].cast("string")
    rows = F.array(
        *[F.when(~F.col("a")[c].eqNullSafe(F.col("b")[c]), F.struct(F.lit(c).alias("column"), text("a", c).alias("first"), text("b", c).alias("second"))) for c in values]
    )
    whole = F.array(F.struct(F.lit("*").alias("column"), F.when(F.col("a").isNotNull(), F.lit("present")).alias("first"), F.when(F.col("b").isNotNull(), F.lit("present")).alias("second")))
    one_side = F.col("a").isNull() | F.col("b").isNull()
    return j.select(*keys, F.explode(F.when(one_side, whole).otherwise(F.array_compact(rows))).alias("d")).select(*keys, "d.*")


def resolve_aliases(claims: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (claim_id, aliases) against available (alias, evidence_id): resolved ids, and errors (unknown alias, or none)."""
    every = claims.select("claim_id", F.explode_outer("aliases").alias("alias")).join(available, "alias", "left")
    errors = every.filter("evidence_id IS NULL").select("claim_id", F.coalesce("alias", F.lit("")).alias("alias"), F.when(F.col("alias").isNull(), "empty").otherwise("unknown").alias("problem"))
    return every.filter("evidence_id IS NOT NULL").select("claim_id", "alias", "evidence_id"), errors


def _divide(n: Column, d: Column, rounding: str) -> Column:
    """Whole quotient of decimals, ``d`` above 0; nearest rounds halves away from zero."""
    rest = F.pmod(n, d)  # in [0, den)
    low = ((n - rest) / d).cast("decimal(38,0)")
    if rounding == "floor":
        out = low
    elif rounding == "ceil":
        out = low + (rest > 0).cast("int")
    else:
        twice = rest * 2
        out = low + F.when((twice > d) | ((twice == d) & (n > 0)), 1).otherwise(0)
    return out.cast("long")


def ticks_to_ms(pts: Column, origin: Column, num: Column, den: Column, rounding: str = "nearest") -> Column:
    """(pts - origin) * num * 1000 / den in whole milliseconds; nearest rounds halves away from zero."""
    wide = (pts - origin).cast("decimal(20,0)") * num.cast("decimal(9,0)") * F.lit(1000).cast("decimal(4,0)")
    return _divide(wide.cast("decimal(38,0)"), den.cast("decimal(18,0)"), rounding)


def ms_to_ticks(ms: Column, origin: Column, num: Column, den: Column, rounding: str = "nearest") -> Column:
    """Origin + ms * den / (num * 1000), the inverse mapping."""
    wide = ms.cast("decimal(20,0)") * den.cast("decimal(9,0)")
    return origin.cast("long") + _divide(wide.cast("decimal(38,0)"), (num * 1000).cast("decimal(18,0)"), rounding)


def clip_range(start: Column, end: Column, duration: Column) -> Column:
    """struct(start, end) inside [0, duration), null if nothing is left."""
    s, e = F.greatest(F.lit(0), start), F.least(duration, end)
    return F.when(s < e, F.struct(s.alias("start_ms"), e.alias("end_ms")))


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """P5: (video_id, pos, text, start_s, end_s, offset_ms, duration_ms) -> spans with a text and both bounds.

    Seconds become milliseconds half up; starts are clipped to [0, duration - 1], ends to [start + 1, duration]."""
    c = chunks.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("start_s").isNotNull() & F.col("end_s").isNotNull())
    ms = lambda s: F.floor(F.col(s).cast("decimal(18,6)") * 1000 + F.lit(0.5).cast("decimal(2,1)")).cast("long") + F.col("offset_ms")
    c = c.withColumn("start_ms", F.greatest(F.lit(0), F.least(ms("start_s"), F.col("duration_ms") - 1)))
    c = c.withColumn("end_ms", F.least(F.col("duration_ms"), F.greatest(ms("end_s"), F.col("start_ms") + 1)))
    span = F.sha2(F.concat_ws("|", "video_id", "pos", "start_ms", "end_ms", F.trim("text")), 256)
    return c.select("video_id", "pos", F.trim("text").alias("text"), "start_ms", "end_ms", span.alias("span_id"))


def ocr_spans(observations: DataFrame) -> DataFrame:
    """(video_id, scene_id, start_ms, end_ms, texts array<struct<text, at_ms>>) -> one span a text of a scene;
    observed_ms only where the text was seen at exactly one time, else the scene's range."""
    e = observations.select("video_id", "scene_id", "start_ms", "end_ms", F.explode("texts").alias("t"))
    g = e.groupBy("video_id", "scene_id", "start_ms", "end_ms", F.trim("t.text").alias("text")).agg(F.array_sort(F.collect_set("t.at_ms")).alias("times"))
    one = F.size("times") == 1
    return g.filter("text <> ''").select(
        "video_id",
        "scene_id",
        "text",
        F.when(one, F.element_at("times", 1)).alias("observed_ms"),
        F.when(~one, F.col("start_ms")).alias("start_ms"),
        F.when(~one, F.col("end_ms")).alias("end_ms"),
    )


def sample_times(scenes: DataFrame, k: int) -> DataFrame:
    """K interior times of each interval: ``start + (2i + 1) * length div 2k``, at most end - 1."""
    d = F.col("end_ms") - F.col("start_ms")
    e = scenes.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    return e.withColumn("at_ms", F.least(F.col("end_ms") - 1, F.col("start_ms") + F.floor((2 * F.col("i") + 1) * d / (2 * k))).cast("long"))


def _successors(points: DataFrame, least_ms: int) -> DataFrame:
    """(video_id, ms, p) with p a position over (video_id, ms) -> p, next: the position of the first point of the video ``least_ms`` or more away.

    Points are cut into buckets as wide as the gap, so the point looked for is in the next bucket or is the first one after it; a
    bucket holds at most ``least_ms`` points, and no step sees a whole video."""
    t = points.withColumn("k", F.floor(F.col("ms") / least_ms))
    b = t.groupBy("video_id", "k").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.array_sort(F.collect_list("ms")).alias("ms_of"))
    ahead = b.select("video_id", (F.col("k") - 1).alias("k"), F.col("first").alias("first_ahead"), F.col("last").alias("last_ahead"), "ms_of")
    final = t.groupBy("video_id").agg(F.max("p").alias("final"))
    j = t.join(b.select("video_id", "k", "last"), ["video_id", "k"]).join(ahead, ["video_id", "k"], "left").join(final, "video_id")
    nearer = F.size(F.filter("ms_of", lambda m: m < F.col("ms") + least_ms))
    n = F.when(F.col("ms_of").isNull(), F.col("last") + 1).otherwise(F.col("first_ahead") + nearer)
    return j.withColumn("next", n).filter(F.col("next") <= F.col("final")).select("p", "next")


def _reached(start: DataFrame, steps: DataFrame) -> DataFrame:
    """All p that the steps (p, next) lead to from those of ``start``: steps double in length each round, so n points take log n rounds."""
    found = materialize(start, "reached")
    steps = materialize(steps, "steps")
    while True:
        new = materialize(found.join(steps, "p").select(F.col("next").alias("p")), "reached-new")
        if new.isEmpty():
            discard(new, steps)
            return found
        longer = materialize(steps.join(steps.select(F.col("p").alias("next"), F.col("next").alias("far")), "next").select("p", F.col("far").alias("next")), "steps")
        both = materialize(found.unionByName(new), "reached")
        discard(new, found, steps)
        found, steps = both, longer


def merge_boundaries(boundaries: DataFrame, durations: DataFrame, least_ms: int) -> DataFrame:
    """video_id, n, start_ms, end_ms: boundaries kept if ``least_ms`` or more after the last kept one; a short tail joins
    its predecessor. Rows without a video_id are left out.

    Which boundary follows a kept one depends on that one alone, so the kept ones are what successor steps reach from 0; a video of any
    number of boundaries is spread over ranges of (video, time), and no row or window holds one."""
    durations = durations.filter(F.col("video_id").isNotNull())
    b = boundaries.join(durations, "video_id").filter((F.col("boundary_ms") > 0) & (F.col("boundary_ms") < F.col("duration_ms")))
    points = b.select("video_id", F.col("boundary_ms").cast("bigint").alias("ms")).unionByName(durations.select("video_id", F.lit(0).cast("bigint").alias("ms"))).distinct()
    points = materialize(numbered(points, ["video_id", "ms"], "p"), "points")
    kept = points.join(_reached(points.filter("ms = 0").select("p"), _successors(points, least_ms)), "p")
    kept = materialize(numbered(kept.select("video_id", "ms"), ["video_id", "ms"], "i"), "kept")
    ends = kept.groupBy("video_id").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("ms").alias("tail_ms")).join(durations.select("video_id", "duration_ms"), "video_id")
    short = (F.col("last") > F.col("first")) & (F.col("duration_ms") - F.col("tail_ms") < least_ms)
    ends = ends.withColumn("last", F.when(short, F.col("last") - 1).otherwise(F.col("last")))
    following = kept.select((F.col("i") - 1).alias("i"), F.col("ms").alias("next_ms"))
    j = kept.join(ends, "video_id").filter(F.col("i") <= F.col("last")).join(following, "i", "left")
    return j.select("video_id", (F.col("i") - F.col("first")).cast("int").alias("n"), F.col("ms").alias("start_ms"), F.when(F.col("i") == F.col("last"), F.col("duration_ms")).otherwise(F.col("next_ms")).alias("end_ms"))
