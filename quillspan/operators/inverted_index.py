"""A kept inverted index of several fields, and BM25 search that skips document ranges by their upper bounds.

Building reads the texts once. Postings lie in blocks: one row for each field, term and range of ``span`` document numbers, with the largest part
that a posting of the block can add to a score for one unit of the term's weight. A range of numbers lies in one task, so its blocks are made where its
texts are read, and postings move once, as whole blocks. No row outgrows the span, however frequent the term. Blocks are partitioned by field and by a
hash of the term, so a search reads the shards of its own terms only.

A search first scores the rarest terms of each query alone: the k-th best of these partial scores is a bound that the k best documents reach.
Ranges whose blocks cannot add up to the bound are skipped, unread; the rest is scored in full. Results are those of a search without skipping.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators.retrieval import K1, B, allowed, ranked
from quillspan.plans.scratch import materialize, scratch_root

SPAN = 1024  # document numbers of a range
SHARDS = 8  # of terms: folders of the kept index; inside them files are sorted by term
DOCUMENTS = -1  # the shard of the rows of documents
FILES = 32  # of a field and shard, at most
FIRST_TERMS = 3  # rarest terms of a query that give its bound
HELD = 4_000_000  # postings of a field that a task holds before it writes them, about: a range with more has more than one row a term

# Latin words and digits, or a run of CJK characters.
TOKEN = re.compile("[a-z0-9]+|[㐀-䶿一-鿿]+", re.IGNORECASE)
BEYOND = re.compile("[㐀-䶿一-鿿ı]")  # what TOKEN takes of a folded text beside ASCII
WORDS = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))


def terms_of(text: str) -> list[str]:
    """Words of the folded text; of a CJK run each character, then each pair of neighbours."""
    text = text.casefold()
    if text.isascii() or not BEYOND.search(text):
        return text.encode("ascii", "replace").translate(WORDS).decode().split()
    out: list[str] = []
    for t in TOKEN.findall(text):
        if "㐀" <= t[0] <= "鿿":
            out += [*t, *map("".join, zip(t, t[1:], strict=False))]
        else:
            out.append(t)
    return out


def _count(texts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, length, terms, tfs: a row for each row and field of ``texts``."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for field in fields:
                    counts = [Counter(terms_of(t or "")) for t in batch.column(field).to_pylist()]
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k) for k in keys], pa.array([field] * n), pa.array([sum(c.values()) for c in counts], pa.int64()),
                         pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                        [*keys, "field", "length", "terms", "tfs"],
                    )

    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "field string, length long, terms array<string>, tfs array<int>"
    return texts.select(*keys, *fields).mapInArrow(run, schema)


class _Held:
    """Postings of one field and range, by document: numbers of terms, and how often they occur."""

    def __init__(self):
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.terms, self.tfs = array("q"), array("i")
        self.docs, self.lengths, self.sizes = [], [], []

    def add(self, doc: int, text: str) -> int:
        terms = terms_of(text)
        counts = Counter(terms)
        self.terms.extend(map(self.numbers.__getitem__, counts))
        self.tfs.extend(counts.values())
        self.docs.append(doc)
        self.lengths.append(len(terms))
        self.sizes.append(len(counts))
        return len(terms)

    def blocks(self) -> Iterator[list[pa.Array]]:
        """term, number of its postings, sum of their tf, postings by document number, and of each different tf the least length (tf << 32 | length): one
        of these adds most to a score, whatever the mean length is."""
        terms, words = np.array(self.terms, np.int64), pa.array(list(self.numbers), pa.string())
        doc, length = (np.repeat(np.array(x, np.int64), self.sizes) for x in (self.docs, self.lengths))
        tf = np.array(self.tfs, np.int32)
        peaks = np.lexsort((length, tf, terms))
        new = np.concatenate(([True], (np.diff(terms[peaks]) != 0) | (np.diff(tf[peaks]) != 0)))[: len(terms)]
        peaks, order = peaks[new], np.argsort(terms, kind="stable")
        starts, peak_starts = (np.concatenate(([0], np.cumsum(np.bincount(terms[x], minlength=len(words))))) for x in (order, peaks))
        occurrences = np.diff(np.concatenate(([0], np.cumsum(tf[order], dtype=np.int64)))[starts])
        listed = lambda begins, a, b, values: pa.ListArray.from_arrays(pa.array((begins[a : b + 1] - begins[a]).astype(np.int32)), values)
        # rows of about 100,000 postings at once
        for a, b in pairwise([*np.unique(np.searchsorted(starts, np.arange(0, starts[-1], 100_000))).tolist(), len(words)]):
            some, top = order[starts[a] : starts[b]], peaks[peak_starts[a] : peak_starts[b]]
            postings = pa.StructArray.from_arrays([pa.array(doc[some]), pa.array(tf[some]), pa.array(length[some])], ["doc", "tf", "length"])
            highest = listed(peak_starts, a, b, pa.array(tf[top].astype(np.int64) << 32 | length[top]))
            yield [words[a:b], pa.array(np.diff(starts[a : b + 1])), pa.array(occurrences[a:b]), highest, listed(starts, a, b, postings)]


def _invert(docs: DataFrame, fields: list[str], span: int) -> DataFrame:
    """Rows of two kinds, from documents numbered in order in each partition: of a document and field (doc, video_id, scene_id, length), and of a
    field, term and range (term, span, n, occurrences, peaks, docs)."""
    long = pa.int64()
    types = {"term": pa.string(), "span": long, "n": long, "occurrences": long, "peaks": pa.list_(long)}
    types["docs"] = pa.list_(pa.struct([("doc", long), ("tf", pa.int32()), ("length", long)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, ids = {f: _Held() for f in fields}, None, []
        names = ["field", "doc", "video_id", "scene_id", "length", *types]

        def written() -> Iterator[pa.RecordBatch]:
            for field, h in held.items():
                for term, *columns in h.blocks():
                    rows = len(term)
                    empty = [pa.nulls(rows, k) for k in (long, *ids, long)]
                    yield pa.RecordBatch.from_arrays([pa.array([field] * rows), *empty, term, pa.array([at] * rows, long), *columns], names)
                held[field] = _Held()

        for whole in batches:
            ids = [whole.column(c).type for c in ("video_id", "scene_id")]
            for begin in range(0, whole.num_rows, 500):
                some = whole.slice(begin, 500)
                ranges = some.column("doc").to_numpy() // span
                for a, b in pairwise([0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]):
                    batch = some.slice(a, b - a)
                    if at is not None and (at != ranges[a] or max(len(h.terms) for h in held.values()) > HELD):
                        yield from written()
                    at, numbers, keys = int(ranges[a]), batch.column("doc").to_pylist(), [batch.column(c) for c in ("doc", "video_id", "scene_id")]
                    for field in fields:
                        lengths = [held[field].add(i, t or "") for i, t in zip(numbers, batch.column(field).to_pylist(), strict=True)]
                        empty = [pa.nulls(len(lengths), k) for k in types.values()]
                        yield pa.RecordBatch.from_arrays([pa.array([field] * len(lengths)), *keys, pa.array(lengths, long), *empty], names)
        if at is not None:
            yield from written()

    return docs.select("doc", "video_id", "scene_id", *fields).mapInArrow(run, _rows(docs))


def _rows(docs: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return f"field string, doc long, video_id {kinds['video_id']}, scene_id {kinds['scene_id']}, length long, term string, span long, n long, occurrences long, peaks array<long>, docs array<struct<doc:long,tf:int,length:long>>"


class Index(NamedTuple):
    """documents: doc, video_id, scene_id, field, length; totals: field, n_docs, mean_length; terms: field, term, df, occurrences; blocks: field, shard,
    term, span, most, n and occurrences (postings, and the sum of their tf), docs (doc, tf, length)."""

    documents: DataFrame
    totals: DataFrame
    terms: DataFrame
    blocks: DataFrame


def _part(tf: Column, length: Column, mean: Column) -> Column:
    """What a posting adds to a score for one unit of weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(mean, F.lit(1e-9))))


def _shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def write_index(docs: DataFrame, path: str, fields: list[str], span: int = SPAN) -> None:
    """R2: write the index of ``docs`` (video_id, scene_id, and a text column for each field) to a folder. Documents without a term in a field
    count in its mean length; null texts are empty ones."""
    spark = docs.sparkSession
    rows = _invert(docs.withColumn("doc", F.monotonically_increasing_id()), fields, span)
    rows = rows.withColumn("shard", F.when(F.col("term").isNull(), DOCUMENTS).otherwise(_shard(F.col("term"))))
    even = F.pmod(F.xxhash64("term", "span", "doc"), F.lit(FILES))
    rows.repartition("field", "shard", even).sortWithinPartitions("field", "shard", "term", "span").write.partitionBy("field", "shard").parquet(f"{path}/rows")
    docs.select("video_id", "scene_id").limit(0).write.parquet(f"{path}/keys")  # their types, also where there are no rows
    kept = _kept(spark, path)
    documents, blocks = kept.filter(F.col("shard") == DOCUMENTS), kept.filter(F.col("shard") != DOCUMENTS)
    documents.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length")).write.parquet(f"{path}/totals")
    blocks.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("occurrences").alias("occurrences")).write.parquet(f"{path}/terms")


def _kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_rows(spark.read.parquet(f'{path}/keys'))}, shard int").parquet(f"{path}/rows")


def read_index(spark: SparkSession, path: str) -> Index:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    rows, totals = _kept(spark, path), read("totals", "field string, n_docs long, mean_length double")
    documents = rows.filter(F.col("shard") == DOCUMENTS).select("doc", "video_id", "scene_id", "field", "length")
    blocks = rows.filter(F.col("shard") != DOCUMENTS).join(F.broadcast(totals.select("field", "mean_length")), "field")  # one row a field
    most = F.array_max(F.transform("peaks", lambda p: _part(F.shiftright(p, 32), p.bitwiseAND(0xFFFFFFFF), F.col("mean_length"))))
    return Index(
        documents,
        totals,
        read("terms", "field string, term string, df long, occurrences long"),
        blocks.select("term", "span", most.alias("most"), "n", "occurrences", "docs", "field", "shard"),
    )


def build_index(docs: DataFrame, fields: list[str], span: int = SPAN) -> Index:
    """An index in the shared scratch folder."""
    path = f"{scratch_root(docs.sparkSession)}/quillspan/index-{uuid.uuid4().hex}"
    write_index(docs, path, fields, span)
    return read_index(docs.sparkSession, path)


def asked_terms(index: Index, queries: DataFrame, field: str) -> DataFrame:
    """query_id, term, shard, weight (query count times inverse document frequency) of terms that the field holds."""
    q = _count(queries.select("query_id", F.col("text").alias(field)), ["query_id"], [field])
    q = q.select("query_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("query_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("qtf"))
    known = index.terms.filter(F.col("field") == field).select("term", "df")
    n = index.totals.filter(F.col("field") == field).select("n_docs")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return q.join(known, "term").join(F.broadcast(n)).select("query_id", "term", _shard(F.col("term")).alias("shard"), (F.col("qtf") * idf).alias("weight"))


def _scored(index: Index, asked: DataFrame, field: str, live: DataFrame | None = None) -> DataFrame:
    """query_id, doc, score, matched (terms): sums over the blocks of the asked terms, of the live (query_id, span) only if they are given."""
    mean = index.totals.filter(F.col("field") == field).select("mean_length")
    hits = index.blocks.filter(F.col("field") == field).join(asked, ["shard", "term"])
    if live is not None:
        hits = hits.join(live, ["query_id", "span"])
    hits = hits.select("query_id", "weight", F.explode("docs").alias("d")).join(F.broadcast(mean))
    part = F.col("weight") * _part(F.col("d.tf"), F.col("d.length"), F.col("mean_length"))
    return hits.groupBy("query_id", F.col("d.doc").alias("doc")).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"))


def _named(index: Index, scores: DataFrame, field: str) -> DataFrame:
    names = index.documents.filter(F.col("field") == field).select("doc", "video_id", "scene_id")
    return scores.join(names, "doc")


def live_ranges(index: Index, asked: DataFrame, bound: DataFrame, field: str) -> DataFrame:
    """query_id, span of the ranges that can hold one of the k best: their blocks' largest parts reach the query's bound. Reads no posting."""
    most = index.blocks.filter(F.col("field") == field).select("shard", "term", "span", "most").join(asked, ["shard", "term"])
    reach = most.groupBy("query_id", "span").agg(F.sum(F.col("weight") * F.col("most")).alias("reach"))
    # sums in another order differ in their last digits
    return reach.join(bound, "query_id", "left").filter(F.col("bound").isNull() | (F.col("reach") >= F.col("bound") - 1e-6)).select("query_id", "span")


def search(index: Index, queries: DataFrame, field: str = "combined", k: int = 10, docs: DataFrame | None = None) -> DataFrame:
    """query_id, video_id, scene_id, score, rank of the k best documents of each query (query_id, text) in one field.

    With ``docs`` (video_id, scene_id, start_ms, end_ms, evidence_types) only those count that the query's own filters permit (P1)."""
    asked = asked_terms(index, queries, field)
    permit = lambda named: allowed(named, docs, queries) if docs is not None else named
    by_weight = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "term")
    rarest = asked.withColumn("n", F.row_number().over(by_weight)).filter(F.col("n") <= FIRST_TERMS).drop("n")
    partial = _scored(index, rarest, field)
    if docs is not None:
        partial = permit(_named(index, partial, field))
    nth = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    bound = partial.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= k).groupBy("query_id").agg(F.min(F.when(F.col("n") == k, F.col("score"))).alias("bound"))
    full = _scored(index, asked, field, live_ranges(index, asked, bound, field)).withColumn("score", F.round("score", 9)).filter("score > 0")
    return ranked(permit(_named(index, full, field)).select("query_id", "video_id", "scene_id", "score"), k)


def matched_terms(index: Index, queries: DataFrame, field: str = "combined") -> DataFrame:
    """query_id, video_id, scene_id, score: the number of distinct terms that a document shares with a query."""
    found = _scored(index, asked_terms(index, queries, field), field)
    return _named(index, found, field).select("query_id", "video_id", "scene_id", F.col("matched").cast("double").alias("score"))


class Counts(NamedTuple):
    """forward: doc, video_id, scene_id, field, length, terms, tfs; totals: field, n_docs, mean_length."""

    forward: DataFrame
    totals: DataFrame


def count_terms(docs: DataFrame, fields: list[str]) -> Counts:
    """The term counts of ``docs`` alone, without posting lists: for searches that ask a set of queries once."""
    numbered = docs.withColumn("doc", F.monotonically_increasing_id())
    forward = materialize(_count(numbered, ["doc", "video_id", "scene_id"], fields), "term-counts")
    return Counts(forward, materialize(forward.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length")), "totals"))


def scores_by_document(counts: Counts, queries: DataFrame, field: str = "combined") -> DataFrame:
    """query_id, video_id, scene_id, score, matched of all documents that share a term with a query.

    The counts of a document move once, by its number; what its terms add up to stays in that task, however many queries ask for them, and a cut to the k
    best of each query is made there too. Only the terms asked for and their weights go to the other tasks."""
    forward = counts.forward.filter(F.col("field") == field).drop("field")
    asked = _count(queries.select("query_id", F.col("text").alias(field)), ["query_id"], [field])
    asked = asked.select("query_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("query_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("qtf"))
    asked = materialize(asked, "asked-terms")
    held = forward.select(F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = counts.totals.filter(F.col("field") == field).select("n_docs", "mean_length")  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = materialize(asked.join(held, "term").join(F.broadcast(totals)).select("query_id", "term", (F.col("qtf") * idf).alias("weight"), "mean_length"), "term-weights")
    spark = forward.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    postings = forward.repartition(parts, "doc").select("doc", "video_id", "scene_id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    postings = postings.select("doc", "video_id", "scene_id", "length", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    part = F.col("weight") * _part(F.col("tf"), F.col("length"), F.col("mean_length"))
    scored = postings.join(weights, "term").groupBy("query_id", "doc", "video_id", "scene_id").agg(F.round(F.sum(part), 9).alias("score"), F.count(F.lit(1)).cast("double").alias("matched"))
    return scored.drop("doc")


def search_counts(counts: Counts, queries: DataFrame, field: str = "combined", k: int = 10) -> DataFrame:
    """As ``search``, from term counts."""
    return ranked(scores_by_document(counts, queries, field).filter("score > 0").drop("matched"), k)


def matched_counts(counts: Counts, queries: DataFrame, field: str = "combined", k: int = 10) -> DataFrame:
    """The k best documents of each query by the number of distinct terms that they share with it; the number is the score."""
    return ranked(scores_by_document(counts, queries, field).drop("score").withColumnRenamed("matched", "score"), k)
