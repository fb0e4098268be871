"""Line deduplication by distinct-site spread.

A line that many sites share is boilerplate. The spread of a line (its number of distinct sites) is estimated by a
HyperLogLog sketch per line hash; sketches of parts of the input merge by aggregation, with the hot lines salted.
Lines whose estimate lies near the threshold get an exact distinct count. Boilerplate stays in its first document (the smallest id) and goes
everywhere else, so that no content leaves the corpus altogether.

A line is hashed (64 bits) as it stands without surrounding white space. Lines of one site, as shown by an equal
minimum and maximum of the site hash, have spread 1 exactly and need no sketch; this leaves few lines to sketch.

Definitions that hold for every row: a null text stays null and has no lines; a null site is a site of its own; lines
with fewer than ``min_words`` words are never boilerplate; blank lines stay; repeated lines of a document go or stay
alike; rows that share an id keep a line where that id is its first document and lose it elsewhere, each by its own text; rows
with a null id count as sites but never as a first document, and lose boilerplate that some document with an id holds; an empty
table gives an empty result; extra columns pass through, but for ``n_lines`` and ``n_removed``, which are replaced
(names starting with ``__line_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.text import SPACE
from quillspan.plans.scratch import materialize

SALTS = 16
#: log2 of the sketch size; the relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE}|{SPACE}$", "")


def line_hash(line: Column, min_words: int) -> Column:
    """64-bit hash of a line, null for lines that are too short to be boilerplate."""
    long_enough = "[^\\x20\\x09-\\x0D]+" + "[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+" * (min_words - 1)
    return F.when(line.rlike(long_enough), F.xxhash64(_trimmed(line)))


def boilerplate(docs: DataFrame, min_sites: int = 10, min_words: int = 4, doc_id: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """h, first_doc, spread of the lines that ``min_sites`` distinct sites or more share."""
    occurrences = docs.select(
        F.col(doc_id).alias("doc"),
        F.coalesce(F.xxhash64(F.concat(F.lit("s"), F.col(site).cast("string"))), F.lit(0).cast("long")).alias("site"),
        F.explode(F.split(F.col(text), "\n")).alias("line"),
    ).select("doc", "site", line_hash(F.col("line"), min_words).alias("h")).filter(F.col("h").isNotNull())
    # the site of a null source must not collide with the hash of null itself: see the "s" prefix above
    spans = occurrences.groupBy("h").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    shared = materialize(spans.filter((F.col("lo") != F.col("hi")) & (F.col("n") >= min_sites)).select("h", "first_doc"), "shared-lines")
    met = materialize(
        occurrences.join(shared.select("h"), "h", "left_semi").groupBy("h", F.pmod(F.xxhash64("site", "doc"), F.lit(SALTS)).alias("salt"), "site").agg(F.count(F.lit(1)).alias("n")).select("h", "salt", "site"),
        "line-sites",
    )
    sketches = met.groupBy("h", "salt").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"))
    spread = sketches.groupBy("h").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("estimate"))
    margin = max(2.0, 4 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = materialize(spread, "line-spread")
    near = spread.filter(F.abs(F.col("estimate") - min_sites) <= margin)
    exact = met.join(near.select("h"), "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("exact"))
    judged = spread.join(exact, "h", "left").withColumn("spread", F.coalesce("exact", "estimate"))
    return materialize(judged.filter(F.col("spread") >= min_sites).join(shared, "h").select("h", "first_doc", "spread"), "boilerplate")


def dedup_lines(
    docs: DataFrame,
    min_sites: int = 10,
    min_words: int = 4,
    drop_emptied: bool = False,
    doc_id: str = "doc_id",
    site: str = "source",
    text: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines, n_removed.

    ``drop_emptied`` leaves out documents that lost lines and have no word left. The lines that go from a text are looked up by
    (id, hash of the text): texts are shuffled once, whatever the size of either side, and a list holds lines of one text only.
    """
    lines = boilerplate(docs, min_sites, min_words, doc_id, site, text)
    held = docs.select(
        F.col(doc_id).alias("__line_doc"),
        F.xxhash64(text).alias("__line_text"),
        F.explode(F.array_distinct(F.transform(F.split(F.col(text), "\n"), lambda x: line_hash(x, min_words)))).alias("h"),
    )
    going = (
        held.join(lines, "h")
        .filter(F.col("first_doc").isNotNull() & ~F.col("__line_doc").eqNullSafe(F.col("first_doc")))
        .groupBy("__line_doc", "__line_text")
        .agg(F.collect_set("h").alias("__line_gone"))
    )
    going = materialize(going, "lines-to-remove")
    on = F.col(doc_id).eqNullSafe(F.col("__line_doc")) & (F.col("__line_hash") == F.col("__line_text"))
    joined = docs.withColumn("__line_hash", F.xxhash64(text)).join(going.hint("shuffle_hash"), on, "left")
    all_lines = F.split(F.col(text), "\n")
    kept = F.when(
        F.col("__line_gone").isNotNull(),
        F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(F.col("__line_gone"), line_hash(x, min_words)), F.lit(False))),
    ).otherwise(all_lines)
    out = joined.withColumn("__line_kept", kept).withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines)).cast("long"),
            "n_removed": F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines) - F.size("__line_kept")).cast("long"),
            text: F.array_join("__line_kept", "\n"),
        }
    )
    if drop_emptied:
        out = out.filter((F.col("n_removed") == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    return out.drop("__line_doc", "__line_text", "__line_hash", "__line_gone", "__line_kept")
