"""Retrieval and ranking: inverted index, exact search, fusion, routing, evidence rules.

Tables are keyed by ``query_id`` and the pair (``video_id``, ``scene_id``). Ranks are consecutive from 1, by score down, then video and
scene up. Scores are rounded to 9 digits before they are compared, so that the order of float sums is not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.intervals import overlaps
from quillspan.functions.text import casefold, squeeze, tokens, tokens_of
from quillspan.plans.scratch import discard, materialize

def small(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows of the batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


K1, B = 1.5, 0.75
RRF = 60
DEPTH = 100
SENT_TERMS = 500_000  # asked terms that go to the tasks that read texts; where queries use more, all terms are kept
UNITS, QUERIES, HITS = 1024, 256, 200_000  # rows of a block of documents or queries, and terms in a block, about, at most
SENT_BLOCKS = 8  # of queries that go to the tasks that pack documents; more of them are joined
PLACES = 1024  # rows of one repeated key that lie in one unit, about
EXPANDED = 500_000  # products of one step


def scene_documents(parts: DataFrame) -> DataFrame:
    """(video_id, scene_id, pos, kind, text, inferred) -> one text a kind, and a combined text with headers.

    Inferred times are not indexed; empty parts leave no header."""
    said = parts.filter(~F.coalesce("inferred", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    kinds = {"transcript": "[TRANSCRIPT]", "ocr": "[OCR]", "semantic": "[SEMANTIC]"}
    joined = {
        k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "text")))), lambda x: x["text"]), "\n") for k in kinds
    }
    keys = parts.select("video_id", "scene_id").distinct()
    texts = said.groupBy("video_id", "scene_id").agg(*[v.alias(f"{k}_text") for k, v in joined.items()])
    full = keys.join(texts, ["video_id", "scene_id"], "left").fillna("", [f"{k}_text" for k in kinds])
    combined = F.concat_ws("\n", *[F.when(F.col(f"{k}_text") != "", F.concat(F.lit(h + "\n"), F.col(f"{k}_text"))) for k, h in kinds.items()])
    return full.withColumn("combined_text", combined)


def bm25_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """R2: term, video_id, scene_id, tf, length, df, n_docs, mean_length. Empty documents count in the means. Texts are split once and postings
    counted once; both are written, as totals and document frequencies read them again."""
    split = materialize(docs.select("video_id", "scene_id", tokens(F.col(text)).alias("terms")), "terms").withColumn("length", F.size("terms").cast("long"))
    totals = split.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    postings = (
        split.select("video_id", "scene_id", "length", F.explode("terms").alias("term"))
        .groupBy("term", "video_id", "scene_id", "length")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    postings = materialize(postings, "postings")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row of totals
    return postings.join(df, "term").join(F.broadcast(totals))


class Postings(NamedTuple):
    """What queries need of a corpus: postings (term, video_id, scene_id, length, tf) of the terms asked for; one row of totals (n_docs,
    mean_length); asked (query_id, term, qtf)."""

    postings: DataFrame
    totals: DataFrame
    asked: DataFrame


def postings(docs: DataFrame, queries: DataFrame, text: str = "text") -> Postings:
    """One pass over the texts. Every token is looked up among the terms that queries use where it stands (Spark sends these to the tasks if
    they are few); those that are not used go at once, but for the first place of a document, which carries its length. What is left is written,
    so that totals, document frequencies and all channels read a table of hits, not the texts."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    used = asked.select(F.col("term").alias("used")).distinct()
    split = docs.select("video_id", "scene_id", tokens(F.col(text)).alias("terms")).withColumn("length", F.size("terms").cast("long"))
    placed = split.select("video_id", "scene_id", "length", F.posexplode_outer("terms").alias("pos", "term"))
    found = placed.join(used, F.col("term") == F.col("used"), "left").filter(F.col("used").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    found = materialize(found.select("video_id", "scene_id", "length", (F.coalesce("pos", F.lit(0)) == 0).alias("first"), "used"), "term-hits")
    totals = found.filter("first").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))
    counted = found.filter("used IS NOT NULL").groupBy(F.col("used").alias("term"), "video_id", "scene_id", "length").agg(F.count(F.lit(1)).alias("tf"))
    return Postings(materialize(counted, "postings"), totals, asked)


def bm25_scores(docs: DataFrame, queries: DataFrame, text: str = "text", found: Postings | None = None) -> DataFrame:
    """query_id, video_id, scene_id, score > 0 of all documents that share a term with a query."""
    held, totals, asked = found or postings(docs, queries, text)
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(df, "term").join(F.broadcast(totals)).select(
        "query_id", "term", (F.col("qtf") * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"), "mean_length"
    )
    tf = F.col("tf")
    part = F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest("mean_length", F.lit(1e-9))))
    return (
        held.join(weighted, "term")
        .groupBy("query_id", "video_id", "scene_id")
        .agg(F.round(F.sum(part), 9).alias("score"))
        .filter("score > 0")
    )


def shared_terms(found: Postings) -> DataFrame:
    """query_id, video_id, scene_id, score: the number of distinct terms that a document shares with a query."""
    return found.postings.join(found.asked, "term").groupBy("query_id", "video_id", "scene_id").agg(F.count(F.lit(1)).cast("double").alias("score"))


def _filters(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("video_id").alias("qv"), F.col("start_ms").alias("qs"), F.col("end_ms").alias("qe"), "required_evidence_types")


def _permits() -> Column:
    held = F.forall(F.coalesce("required_evidence_types", F.array().cast("array<string>")), lambda t: F.array_contains("evidence_types", t))
    return (
        (F.col("qv").isNull() | (F.col("qv") == F.col("video_id")))
        & (F.col("qs").isNull() | overlaps(F.col("start_ms"), F.col("end_ms"), F.col("qs"), F.col("qe")))
        & held
    )


def allowed(pairs: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """P1 inside a search: the (query_id, video_id, scene_id, ..) rows that the filters of the query permit. Two equi joins, whatever the
    filters; no scene meets a query that did not score it."""
    d = docs.select("video_id", "scene_id", "start_ms", "end_ms", "evidence_types")
    return pairs.join(d, ["video_id", "scene_id"]).join(_filters(queries), "query_id").filter(_permits()).select(pairs.columns)


def eligible(docs: DataFrame, queries: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """P1 as a table: all (query_id, video_id, scene_id) that a query's own filters permit: same video, overlap with its range,
    and all evidence types that it requires. Filters without a value permit all.

    Queries that name a video meet its scenes, those with a range only the scenes of its time buckets, by equi joins. A query with neither
    permits all scenes of the corpus: searches use ``allowed``, which writes no such table."""
    q, cond = _filters(queries), _permits()
    named = docs.join(q.filter("qv IS NOT NULL"), F.col("video_id") == F.col("qv")).filter(cond)
    at = lambda c: F.floor(F.col(c) / bucket_ms).cast("long")
    buckets = lambda lo, hi: F.explode(F.sequence(at(lo), F.greatest(at(lo), F.floor((F.col(hi) - 1) / bucket_ms).cast("long"))))
    ranged = q.filter("qv IS NULL AND qs IS NOT NULL").withColumn("bucket", buckets("qs", "qe"))
    placed = docs.filter("start_ms IS NOT NULL AND end_ms IS NOT NULL").withColumn("bucket", buckets("start_ms", "end_ms"))
    # a pair counts in the first bucket that both reach
    near = placed.join(ranged, "bucket").filter(cond & (F.col("bucket") == F.greatest(at("start_ms"), at("qs"))))
    free = docs.join(q.filter("qv IS NULL AND qs IS NULL"), cond)
    keys = ["query_id", "video_id", "scene_id"]
    return named.select(keys).unionByName(near.select(keys)).unionByName(free.select(keys))


def ranked(scores: DataFrame, k: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Consecutive ranks within ``by`` and, with ``k``, the first k (pruned before the shuffle by Spark)."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "video_id", "scene_id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", filtered: bool = False) -> DataFrame:
    """The k best documents of each query; with ``filtered``, of those that the query's own filters permit."""
    return filtered_bm25_search(docs, queries, k, text) if filtered else ranked(bm25_scores(docs, queries, text), k)


def _counts(docs: DataFrame, text: str, used: frozenset[str] | None) -> DataFrame:
    """The rows of ``docs`` with their length and the counts (terms, tfs) of the terms in ``used``, or of all terms."""
    keys = ["video_id", "scene_id", "start_ms", "end_ms", "evidence_types"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 500):
            counts = [Counter(tokens_of(t or "")) for t in batch.column(text).to_pylist()]
            lengths = pa.array([c.total() for c in counts], pa.int64())
            if used is not None:
                counts = [{t: n for t, n in c.items() if t in used} for c in counts]
            terms, tfs = pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lengths, terms, tfs], [*keys, "length", "terms", "tfs"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", length long, terms array<string>, tfs array<int>"
    return docs.select(*keys, text).mapInArrow(run, schema)


def _packing(columns: list[str], prefix: str, block: int, lists: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a block of ``block`` rows and about HITS terms, or fewer: all columns as arrays. Of the columns ``lists`` the elements lie one after another,
    with their numbers in ``_n``; terms are numbers into ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, block):
            if not batch.num_rows:
                continue
            # a place is looked at by each query
            size = sum(w * pc.list_value_length(batch.column(c)).to_numpy().astype(np.int64) for c, w in (("terms", 1), ("places", 16)) if c in lists)
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(np.cumsum(size) // HITS)) + 1).tolist(), batch.num_rows]):
                of = {c: pa.concat_arrays([batch.column(c).slice(a, b - a)]) for c in columns}
                of |= {f"{c}_n": pc.list_value_length(of[c]).cast(pa.int32()) for c in lists} | {c: of[c].flatten() for c in lists}
                coded = of["terms"].dictionary_encode()
                of |= {"terms": coded.indices, "words": coded.dictionary}
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in of.values()], [prefix + c for c in of])

    return run


def _blocks(rows: DataFrame, prefix: str, block: int, lists: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    types = {c: t if c in lists else f"array<{t}>" for c, t in kinds.items()} | {f"{c}_n": "array<int>" for c in lists} | {"terms": "array<int>", "words": "array<string>"}
    return rows.mapInArrow(_packing(rows.columns, prefix, block, lists), ", ".join(f"{prefix}{c} {t}" for c, t in types.items()))


def _columns(blocks: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """Of each block, or pair of blocks, the elements of its arrays."""
    for one in small(blocks, 1):
        yield {c: one.column(c).flatten() for c in one.schema.names}


def _sums(term: np.ndarray, of_unit: np.ndarray, parts: np.ndarray, units: int, asked: np.ndarray, of_query: np.ndarray, weights: np.ndarray, queries: int) -> np.ndarray:
    """Units x queries: sums of part times weight over the terms that they share; a term of a unit that no query has is -1."""
    order, begins = np.argsort(asked, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(asked))))
    of_query, weights = of_query[order], weights[order]
    known = np.flatnonzero(term >= 0)
    term, of_unit, parts = term[known], of_unit[known], parts[known]
    each = np.diff(begins)[term]
    ends, out = np.cumsum(each), np.zeros(units * queries)
    for a, b in pairwise([*np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, EXPANDED))).tolist(), len(ends)]):
        n = each[a:b]
        to = np.repeat(begins[term[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(of_unit[a:b] * queries, n) + of_query[to], np.repeat(parts[a:b], n) * weights[to], units * queries)
    return out.reshape(units, queries)


def _permitted(of: dict[str, pa.Array], video: pa.Array, places: pa.StructArray) -> np.ndarray:
    """Which places (columns) each query (rows) permits, as ``_permits``."""

    def known(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return pc.fill_null(x, 0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)

    asked = of["q_qv"]
    wanted, found = (pc.fill_null(pc.index_in(x, value_set=asked.unique()), -1).to_numpy() for x in (asked, video))
    out = asked.is_null().to_numpy(zero_copy_only=False)[:, None] | (wanted[:, None] == found[None])
    (start, a), (end, b) = (known(places.field(c)) for c in ("start_ms", "end_ms"))
    (lo, ranged), (hi, ended) = (known(of[c]) for c in ("q_qs", "q_qe"))
    out &= ~ranged[:, None] | ((start[None] < hi[:, None]) & (lo[:, None] < end[None]) & (a & b)[None] & ended[:, None])
    need = [frozenset(x or ()) for x in of["q_required_evidence_types"].to_pylist()]
    types = [frozenset(x or ()) for x in places.field("evidence_types").to_pylist()]
    for each in set(need) - {frozenset()}:
        holds = np.array([None not in each and x >= each for x in types], bool)
        out[np.array([x == each for x in need])] &= holds[None]
    return out


def filtered_bm25_search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text") -> DataFrame:
    """R3 with P1: query_id, video_id, scene_id, score, rank of the k best documents that each query permits.

    Counts of the terms asked for are made in the task of their text and written. Blocks of them meet blocks of queries, which are a stated set; a pair of
    blocks is scored, filtered and cut to the k best of each query in one task, so no table of pairs moves or is written. Rows of docs with one
    key (video_id, scene_id) are one document with several places: counts are summed where lengths are equal too, what they add to a score is summed by
    term, and each place that a query permits counts as a row. A row of queries with the id of another shares its terms and has filters of its own."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = materialize(asked, "asked-terms")
    used = [r["term"] for r in asked.select("term").distinct().limit(SENT_TERMS + 1).collect()]
    counts = materialize(_counts(docs, text, frozenset(used) if len(used) <= SENT_TERMS else None), "term-counts")
    totals = counts.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))  # one row

    keys = counts.groupBy(F.col("video_id").alias("v"), F.col("scene_id").alias("s")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    keys = materialize(keys, "repeated-keys")
    same = F.col("video_id").eqNullSafe(F.col("v")) & F.col("scene_id").eqNullSafe(F.col("s"))
    once, repeated = counts.join(keys, same, "left_anti"), counts.join(keys, same)
    merged = repeated.select("video_id", "scene_id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    merged = merged.groupBy("video_id", "scene_id", "length", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("tf"))
    merged = materialize(merged, "merged-counts")

    held = once.select(F.explode("terms").alias("term")).unionByName(merged.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(held, "term").join(F.broadcast(totals)).select("query_id", F.struct("term", (F.col("qtf") * idf).alias("weight")).alias("t"), "mean_length")
    weighted = weighted.groupBy("query_id", "mean_length").agg(F.collect_list("t").alias("t"))
    wanted = weighted.join(_filters(queries), "query_id").select("query_id", "qv", "qs", "qe", "required_evidence_types", "mean_length", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    wanted = materialize(wanted, "query-terms")
    query_blocks = materialize(_blocks(wanted.repartition(1 + wanted.count() // (8 * QUERIES)), "q_", QUERIES, ["terms", "weights"]), "query-blocks")

    # tfs: counts of one length, or where that is null what a unit of weight adds to the score
    place = F.struct("start_ms", "end_ms", "evidence_types")
    alone = once.filter("video_id IS NOT NULL AND scene_id IS NOT NULL AND size(terms) > 0").select(
        "video_id", "scene_id", "length", "terms", F.col("tfs").cast("array<double>").alias("tfs"), F.array(place).alias("places")
    )
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / PLACES))
    placed = counts.withColumn("id", F.monotonically_increasing_id()).join(keys, same).withColumn("part", part).groupBy("video_id", "scene_id", "part").agg(F.collect_list(place).alias("places"))
    tf = F.col("tf")
    added = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest("mean_length", F.lit(1e-9))))
    whole = merged.join(F.broadcast(totals)).groupBy("video_id", "scene_id", "term").agg(F.sum(added).alias("part")).groupBy("video_id", "scene_id").agg(F.collect_list(F.struct("term", "part")).alias("t"))
    shared = placed.join(whole, ["video_id", "scene_id"]).select(
        "video_id", "scene_id", F.lit(None).cast("long").alias("length"), F.col("t.term").alias("terms"), F.col("t.part").alias("tfs"), "places"
    )
    units, lists = alone.unionByName(materialize(shared, "repeated-counts")), ["terms", "tfs", "places"]
    discard(asked, merged, wanted)

    def best(of: dict[str, pa.Array]) -> pa.RecordBatch:
        flat = {c: of[c].to_numpy(zero_copy_only=False) for c in of if pa.types.is_integer(of[c].type) or pa.types.is_floating(of[c].type)}
        # units are numbered in the order that settles ties
        by_key = pc.sort_indices(pa.table({"v": of["d_video_id"], "s": of["d_scene_id"]}), [("v", "ascending"), ("s", "ascending")]).to_numpy()
        size, n, terms = len(by_key), len(of["q_query_id"]), flat["d_terms_n"]
        number = np.empty(size, np.int64)
        number[by_key] = np.arange(size)
        tf, length = flat["d_tfs"], np.repeat(flat["d_length"].astype(np.float64), terms)
        parts = np.where(np.isnan(length), tf, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(of["q_mean_length"][0].as_py(), 1e-9))))
        term = pc.fill_null(pc.index_in(of["d_words"], value_set=of["q_words"]), -1).to_numpy()[flat["d_terms"]]
        score = _sums(term, np.repeat(number, terms), parts, size, flat["q_terms"], np.repeat(np.arange(n), flat["q_terms_n"]), flat["q_weights"], n)
        score, unit = np.round(score, 9).T, np.repeat(number, flat["d_places_n"])
        order = np.argsort(unit, kind="stable")
        unit, places = unit[order], of["d_places"].take(pa.array(order))
        able = _permitted(of, of["d_video_id"].take(pa.array(by_key[unit])), places)
        picked = [p[np.argsort(-score[q, unit[p]], kind="stable")[:k]] for q in range(n) for p in [np.flatnonzero(able[q] & (score[q] > 0)[unit])]]
        query, row = np.repeat(np.arange(n), [len(p) for p in picked]), unit[np.concatenate(picked)]
        score, row = score[query, row], by_key[row]
        return pa.RecordBatch.from_arrays(
            [of["q_query_id"].take(pa.array(query)), of["d_video_id"].take(pa.array(row)), of["d_scene_id"].take(pa.array(row)), pa.array(score)],
            ["query_id", "video_id", "scene_id", "score"],
        )

    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString()} | {c: docs.schema[c].dataType.simpleString() for c in ("video_id", "scene_id")}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", score double"
    # a stated set of queries against all documents, block by block
    if query_blocks.count() <= SENT_BLOCKS:
        sent, pack = list(_columns(iter(query_blocks.toArrow().to_batches()))), _packing(units.columns, "d_", UNITS, lists)
        return ranked(units.mapInArrow(lambda batches: (best(of | asked) for of in _columns(pack(batches)) for asked in sent), schema), k)
    pairs = _blocks(units, "d_", UNITS, lists).crossJoin(query_blocks)
    return ranked(pairs.mapInArrow(lambda batches: map(best, _columns(batches)), schema), k)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """Exact search by dot products of unit vectors: query_id, video_id, scene_id, item, score, rank.

    (video_id, scene_id, item, embedding) against (query_id, embedding). Both sides are packed into blocks of ``block`` vectors, one row each;
    every pair of blocks is one product in a task, which passes on its k best a query. Nothing goes through the driver.
    """
    return ranked(_block_products(vectors, queries, k, block, False), k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _packed(rows: DataFrame, keys: list[str], prefix: str, block: int) -> DataFrame:
    """One row a block of ``block`` rows or fewer: the key columns as arrays, and the unit vectors as bytes."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, block):
            if batch.num_rows:
                x = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in keys]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary())], [*[prefix + c for c in keys], prefix + "x"])

    schema = ", ".join(f"{prefix}{c} array<{kinds[c]}>" for c in keys) + f", {prefix}x binary"
    return materialize(rows.select(*keys, "embedding").mapInArrow(run, schema), "vector-blocks")


def _block_products(vectors: DataFrame, queries: DataFrame, k: int, block: int, by_scene: bool) -> DataFrame:
    """Scores of all pairs of blocks, cut in each pair to the k best items of a query, or with ``by_scene`` to the best items of its k best
    scenes. Ties of the k-th best stay, so that the final order settles them."""
    v = _packed(vectors, ["video_id", "scene_id", "item"], "v_", block)
    q = _packed(queries, ["query_id"], "q_", block)

    def least_of_best(s: np.ndarray) -> np.ndarray:
        at = max(0, s.shape[1] - k)
        return np.partition(s, at, axis=1)[:, at, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                of = {c: batch.column(c).flatten() for c in batch.schema.names if not c.endswith("_x")}
                x, y = (np.frombuffer(batch.column(c)[0].as_py(), np.float64).reshape(n, -1) for c, n in (("v_x", len(of["v_item"])), ("q_x", len(of["q_query_id"]))))
                s = np.round(y @ x.T, 9)
                if by_scene:
                    scenes: dict = {}
                    code = np.array([scenes.setdefault(w, len(scenes)) for w in zip(of["v_video_id"].to_pylist(), of["v_scene_id"].to_pylist(), strict=True)])
                    order = np.argsort(code, kind="stable")
                    best = np.maximum.reduceat(s[:, order], np.flatnonzero(np.diff(code[order], prepend=-1)), axis=1)
                    i, j = np.nonzero((s == best[:, code]) & (best >= least_of_best(best))[:, code])
                else:
                    i, j = np.nonzero(s >= least_of_best(s))
                picked = [of[c].take(pa.array(j)) for c in ("v_video_id", "v_scene_id", "v_item")]
                yield pa.RecordBatch.from_arrays([of["q_query_id"].take(pa.array(i)), *picked, pa.array(s[i, j])], ["query_id", "video_id", "scene_id", "item", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema} | {f.name: f.dataType.simpleString() for f in queries.schema if f.name == "query_id"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "video_id", "scene_id", "item")) + ", score double"
    # a stated set of queries against all rows, block by block
    return v.crossJoin(q).mapInArrow(run, schema)


def best_frames(scores: DataFrame) -> DataFrame:
    """Of (query_id, video_id, scene_id, item, score) the best item of each scene; the first item wins ties."""
    return scores.groupBy("query_id", "video_id", "scene_id").agg(
        F.max("score").alias("score"), F.max_by("item", F.struct("score", -F.col("item"))).alias("item")
    )


def visual_search(frames: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """Every frame is scored, each scene counts by its best frame, the k best scenes stay. A scene among the k best of all is
    among the k best of the block that holds its best frame, so blocks pass on no more than that."""
    return ranked(best_frames(_block_products(frames, queries, k, block, True)), k)


def embed_once(references: DataFrame, artifact: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``embed`` sees each distinct artifact once; its columns are joined back to all references."""
    return references.join(embed(references.select(artifact).filter(F.col(artifact).isNotNull()).distinct()), artifact, "left")


def fuse(rankings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion of (query_id, channel, video_id, scene_id, rank): sum of 1 / (60 + rank) within depth."""
    return ranked(
        rankings.filter(F.col("rank") <= depth).groupBy("query_id", "video_id", "scene_id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 12).alias("score"))
    )


def fuse_weighted(rankings: DataFrame, weights: DataFrame, channels: list[str], depth: int = DEPTH, keep: int = 20) -> DataFrame:
    """Weights (query_id, channel, weight); components ``rank_<channel>`` and ``rrf_<channel>`` stay as columns."""
    part = rankings.filter(F.col("rank") <= depth).join(weights, ["query_id", "channel"]).withColumn("part", F.col("weight") / (RRF + F.col("rank")))
    components = [F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"rank_{c}") for c in channels]
    components += [F.round(F.sum(F.when(F.col("channel") == c, F.col("part"))), 12).alias(f"rrf_{c}") for c in channels]
    return ranked(part.groupBy("query_id", "video_id", "scene_id").agg(F.round(F.sum("part"), 12).alias("score"), *components), keep)


def unique_evidence(evidence: DataFrame, type_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(query_id, video_id, scene_id, channel_pos, pos, type, ref, field, text) -> first of each (type, ref, field, text)
    in channel order, and the types of each scene in a fixed order."""
    scene = ["query_id", "video_id", "scene_id"]
    w = Window.partitionBy(*scene, "type", "ref", "field", "text").orderBy("channel_pos", "pos")
    first = evidence.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    order = F.array(*[F.lit(t) for t in type_order])
    types = first.groupBy(*scene).agg(F.collect_set("type").alias("t")).select(*scene, F.filter(order, lambda t: F.array_contains("t", t)).alias("types"))
    return first, types


# Term groups of the query analysis.
INTENTS = ("visible_text", "speech_or_quote", "action_or_motion", "static_visual_entity", "semantic_scene", "ambiguous")
VISIBLE = ("visible text", "exact text", "on screen", "screen reads", "showing the text", "ocr", "屏幕文字", "画面文字", "显示文字", "写着", "字幕为")
SPEECH = ("narration", "narrator", "says", "said", "spoken", "speech", "hear", "voice", "旁白", "说出", "说了", "语音", "听到")
ACTIONS = {
    "move_left": ("move left", "moving left", "leftward", "向左", "左移"),
    "move_right": ("move right", "moving right", "rightward", "向右", "右移"),
    "move_up": ("move up", "moving up", "upward", "向上", "上移"),
    "move_down": ("move down", "moving down", "downward", "向下", "下移"),
    "stationary": ("stationary", "not moving", "stands still", "静止", "不动"),
    "appear": ("appear", "appears", "becomes visible", "出现"),
    "disappear": ("disappear", "disappears", "vanish", "消失"),
    "enter_frame": ("enter frame", "enters the frame", "进入画面", "入画"),
    "exit_frame": ("exit frame", "leaves the frame", "离开画面", "出画"),
    "approach": ("approach", "closer", "toward camera", "靠近", "接近镜头"),
    "move_away": ("move away", "farther", "recede", "远离"),
    "pick_up": ("pick up", "picks up", "lift", "拿起", "捡起"),
    "drop": ("drop", "drops", "put down", "放下", "掉落"),
    "start": ("start moving", "starts moving", "开始移动"),
    "stop": ("stop moving", "stops moving", "停止移动"),
    "before": (" before ", "先于", "之前"),
    "after": (" after ", "晚于", "之后"),
}
ENTITIES = (
    "ball circle square box object person logo phone product red blue green yellow purple orange cyan magenta "
    "球 圆形 方块 物体 人物 人 标志 手机 产品 红色 蓝色 绿色 黄色 紫色 橙色"
).split()
STATIC = ("containing", "contains", "showing", "find a", "object", "entity", "包含", "有一个", "物体")
SEMANTIC = ("scene where", "a scene", "moment when", "场景", "画面", "时刻")
WEIGHTS = {
    "visible_text": {"bm25_ocr": 4.0, "bm25_combined": 0.5, "dense_text": 1.0, "visual": 0.5},
    "speech_or_quote": {"bm25_transcript": 3.0, "bm25_combined": 0.5, "dense_text": 1.5, "visual": 0.25},
    "static_visual_entity": {"bm25_combined": 0.5, "dense_text": 1.5, "visual": 2.5},
    "semantic_scene": {"bm25_combined": 0.75, "dense_text": 2.0, "visual": 1.25},
    "action_or_motion": {"bm25_structured": 1.0, "dense_text": 2.0, "visual": 1.25},
    "ambiguous": {"bm25_combined": 1.0, "dense_text": 1.0, "visual": 1.0},
}
UNIFORM = {"bm25_combined": 1.0, "dense_text": 1.0, "visual": 1.0}
STATIC_WEIGHTS = {"bm25_combined": 1.0, "dense_text": 1.25, "visual": 1.25}


def any_of(x: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | x.contains(t)
    return out


def analyse(queries: DataFrame) -> DataFrame:
    """Per query: quoted phrases, action codes, entity terms, six intent scores and the primary intent (ties in a
    fixed order)."""
    text = squeeze(casefold(F.coalesce("text", F.lit(""))))
    quote = '["“”‘’]'
    q = queries.withColumns(
        {
            "normal": text,
            "quoted": F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f'{quote}([^"“”‘’]+){quote}'), 1), F.trim)),
        }
    )
    n = F.col("normal")
    q = q.withColumns(
        {
            "actions": F.array_compact(F.array(*[F.when(any_of(n, v), F.lit(k)) for k, v in ACTIONS.items()])),
            "entities": F.array_sort(F.array_compact(F.array(*[F.when(n.contains(e), F.lit(e)) for e in ENTITIES]))),
        }
    )
    visible = F.when(any_of(n, VISIBLE), 1.0).otherwise(0.0)
    heard = F.when(any_of(n, SPEECH), 1.0).otherwise(0.0)
    n_actions = F.size("actions")
    action = F.when(n_actions > 0, F.least(F.lit(1.0), 0.85 + 0.10 * (n_actions - 1))).otherwise(0.0)
    static = F.greatest(F.when(F.size("entities") > 0, 0.6).otherwise(0.0), F.when(any_of(n, STATIC), 0.75).otherwise(0.0))
    q = q.withColumns({"s_visible_text": visible, "s_action_or_motion": action, "s_static_visual_entity": static, "heard": heard})
    q = q.withColumn("s_speech_or_quote", F.when((F.size("quoted") > 0) & (F.col("s_visible_text") == 0) & (F.col("heard") == 0), 0.55).otherwise(F.col("heard")))
    q = q.withColumns(
        {
            "s_semantic_scene": F.greatest(F.when(any_of(n, SEMANTIC), 0.8).otherwise(0.2), F.when(F.col("s_action_or_motion") > 0, 0.45).otherwise(0.0)),
            "s_ambiguous": F.when(F.greatest("s_visible_text", "s_speech_or_quote", "s_action_or_motion", "s_static_visual_entity") < 0.55, 0.5).otherwise(0.05),
        }
    )
    scores = [F.col(f"s_{i}") for i in INTENTS]
    top = F.greatest(*scores)
    # never null, so that joins on it infer no filter, which Spark would push through all the steps above, each written out anew
    primary = F.coalesce(*[F.when(s == top, F.lit(i)) for i, s in zip(INTENTS[:-1], scores, strict=False)], F.lit(INTENTS[-1]))
    return q.withColumn("intent", primary).drop("normal", "heard")


def route(analysed: DataFrame, strategy: str = "query_aware", disabled: tuple[str, ...] = ()) -> DataFrame:
    """query_id, channel, weight. An error if no channel is left."""
    spark = analysed.sparkSession
    if strategy == "query_aware":
        rows = [(i, c, w) for i, cs in WEIGHTS.items() for c, w in cs.items() if c not in disabled]
    else:
        rows = [(i, c, w) for i in INTENTS for c, w in (UNIFORM if strategy == "uniform" else STATIC_WEIGHTS).items() if c not in disabled]
    if {r[0] for r in rows} != set(INTENTS):
        raise ValueError("routing leaves an intent without a channel")
    weights = spark.createDataFrame(rows, "intent string, channel string, weight double")
    return analysed.select("query_id", "intent").join(F.broadcast(weights), "intent").select("query_id", "channel", "weight")


def rerank(candidates: DataFrame, analysed: DataFrame, depth: int = 5) -> DataFrame:
    """Evidence rules on the first ``depth`` candidates of each query.

    candidates: query_id, video_id, scene_id, score, rank, ocr, transcript, structured, evidence_types. Adds adjustment, matched, penalties, final_rank and
    the new score; the tail stays below the head, in its order."""
    a = analysed.select("query_id", "intent", "quoted", "actions", "entities", squeeze(casefold(F.col("text"))).alias("query_text"))
    c = candidates.join(a, "query_id", "left")
    norm = {f: squeeze(casefold(F.coalesce(f, F.lit("")))) for f in ("ocr", "transcript", "structured")}
    c = c.withColumns({f"n_{f}": v for f, v in norm.items()})
    c = c.withColumn("all_text", squeeze(F.concat_ws(" ", "n_transcript", "n_ocr", "n_structured")))
    head = F.col("rank") <= depth
    says = lambda f: F.exists("quoted", lambda p: F.col(f).contains(squeeze(casefold(p))))
    holds = {k: any_of(F.col("n_structured"), [v.strip() for v in vs]) | F.col("n_structured").contains(k) for k, vs in ACTIONS.items()}
    hits = F.array_compact(F.array(*[F.when(F.array_contains("actions", k) & h, F.lit(k)) for k, h in holds.items()]))
    others = F.array_compact(F.array(*[F.when(~F.array_contains("actions", k) & h, F.lit(k)) for k, h in holds.items()]))
    found = F.filter("entities", lambda t: F.col("all_text").contains(t))
    terms = F.filter(F.split(F.regexp_replace("query_text", '"', " "), " "), lambda t: F.length(t) > 2)
    quoted = F.size("quoted") > 0
    flags = {
        "exact_ocr_phrase": ((F.col("intent") == "visible_text") & quoted & says("n_ocr"), F.lit(0.025)),
        "missing_exact_ocr_phrase": ((F.col("intent") == "visible_text") & quoted & ~says("n_ocr"), F.lit(-0.008)),
        "exact_transcript_phrase": ((F.col("intent") == "speech_or_quote") & quoted & says("n_transcript"), F.lit(0.020)),
        "missing_exact_transcript_phrase": ((F.col("intent") == "speech_or_quote") & quoted & ~says("n_transcript"), F.lit(-0.006)),
        "requested_action": ((F.col("intent") == "action_or_motion") & (F.size(hits) > 0), 0.014 + 0.002 * (F.size(hits) - 1)),
        "missing_requested_action_evidence": ((F.col("intent") == "action_or_motion") & (F.size(hits) == 0), F.lit(-0.010)),
        "conflicting_action": ((F.col("intent") == "action_or_motion") & (F.size(hits) == 0) & (F.size(others) > 0), F.lit(-0.004)),
        "visual_only_for_action_query": ((F.col("intent") == "action_or_motion") & F.col("evidence_types").eqNullSafe(F.array(F.lit("keyframe"))), F.lit(-0.004)),
        "entity": (F.size(found) > 0, F.least(F.lit(0.006), 0.002 * F.size(found))),
        "no_textual_query_support": ((F.size(terms) > 0) & ~F.exists(terms, lambda t: F.col("all_text").contains(t)), F.lit(-0.003)),
    }
    w = Window.partitionBy("query_id", "all_text").orderBy("rank")
    c = c.withColumn("repeat", F.when(F.col("all_text") != "", F.row_number().over(w) - 1).otherwise(0))
    flags["duplicate_evidence_signature"] = (F.col("repeat") > 0, -F.least(F.lit(0.004), 0.001 * F.col("repeat")))
    total = F.lit(0.0)
    for on, delta in flags.values():
        total = total + F.when(head & F.coalesce(on, F.lit(False)), delta).otherwise(0.0)
    named = lambda want: F.array_compact(F.array(*[F.when(head & on, F.lit(k)) for k, (on, _) in flags.items() if (k in want)]))
    good = {"exact_ocr_phrase", "exact_transcript_phrase", "requested_action", "entity"}
    out = c.withColumns({"adjustment": F.round(total, 9), "matched": named(good), "penalties": named(set(flags) - good)})
    out = out.withColumn("new_score", F.round(F.col("score") + F.col("adjustment"), 12))
    order = Window.partitionBy("query_id").orderBy((~head).cast("int"), F.when(head, -F.col("new_score")).otherwise(F.col("rank").cast("double")), "video_id", "scene_id")
    return out.withColumn("final_rank", F.row_number().over(order)).drop("n_ocr", "n_transcript", "n_structured", "all_text", "repeat", "query_text", "quoted", "actions", "entities")


def needs_verification(reranked: DataFrame, margin: float = 0.003) -> DataFrame:
    """query_id, verify: two candidates or more, and a close top two or one of them without action evidence."""
    top = reranked.filter("final_rank <= 2").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(F.when(F.col("final_rank") == 1, F.col("new_score"))) - F.max(F.when(F.col("final_rank") == 2, F.col("new_score")))).alias("gap"),
        F.max(~F.array_contains("matched", "requested_action")).alias("lacks"),
    )
    return top.select("query_id", ((F.col("n") >= 2) & ((F.round("gap", 12) <= margin) | F.col("lacks"))).alias("verify"))


def apply_verdicts(reranked: DataFrame, verdicts: DataFrame, delta: float = 0.020) -> DataFrame:
    """Verdicts (query_id, video_id, scene_id, verdict in supported / contradicted / uncertain); all candidates are
    sorted again by score, with or without verdicts."""
    j = reranked.join(verdicts.select("query_id", "video_id", "scene_id", "verdict"), ["query_id", "video_id", "scene_id"], "left")
    moved = F.when(F.col("verdict") == "supported", delta).when(F.col("verdict") == "contradicted", -delta).otherwise(0.0)
    out = j.withColumn("final_score", F.round(F.col("new_score") + moved, 12))
    w = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "video_id", "scene_id")
    return out.withColumn("verified_rank", F.row_number().over(w))


def variant_grid(rankings: DataFrame, variants: dict[str, dict[str, float]]) -> DataFrame:
    """Weighted fusion under several settings in one job; the variant is part of every key. The settings are a
    literal of a few rows."""
    rows = [(v, c, float(w)) for v, cs in variants.items() for c, w in cs.items()]
    grid = rankings.sparkSession.createDataFrame(rows, "variant string, channel string, weight double")
    part = rankings.join(F.broadcast(grid), "channel").withColumn("part", F.col("weight") / (RRF + F.col("rank")))
    return ranked(part.groupBy("variant", "query_id", "video_id", "scene_id").agg(F.round(F.sum("part"), 12).alias("score")), 10, ("variant", "query_id"))


def rank_stability(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per key set: positions that differ between two runs, and whether any does."""
    on = [*keys, "rank"]
    a = first.select(*on, F.struct("video_id", "scene_id").alias("a"))
    b = second.select(*on, F.struct("video_id", "scene_id").alias("b"))
    return a.join(b, on, "full_outer").groupBy(*keys).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed")).withColumn("changed", F.col("n_changed") > 0)
