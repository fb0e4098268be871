"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

1. *Features*: lower-cased words of a document and their prefixes of 4 to 8 letters, as 64-bit hashes.
2. *Selection*: in at most ``SAMPLE`` labelled documents (chosen by a hash, outside the held-out fifth) Spark counts toxic and
   other documents for each feature; the ``FEATURES`` with the largest z-score of the difference stay.
3. *Grades*: labels say only toxic or not. Grade 0 is not toxic; toxic documents are graded 1 to ``GRADES`` by how many
   occurrences of features that speak for toxicity they hold (quantiles over the toxic documents of the sample).
4. *Model*: ``P(grade >= k) = sigmoid(w . x - theta_k)`` with one ``w`` for all thresholds and ``theta_1 < theta_2 < ...``
   by construction; fitted on the sample. The expected severity is the sum of these probabilities over k.

Definitions that hold for every row: a null or empty text has no features, so its severity is that of the thresholds
alone; repeated rows get equal grades; a null ``doc_id`` is graded; null labels are not used; without toxic and other
labels every severity is 0; an empty table gives an empty result; extra columns pass through (own result columns are
replaced). Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.quality_model import held_out
from quillspan.llm.text import small

SAMPLE = 20_000
FEATURES = 1_500
GRADES = 3
PREFIXES = (4, 5, 6, 7, 8)
WORDS_KEPT = 200_000
LEAST_DOCS = 3
RESULT = ("severity", "grade", "toxic", "kept")


class WordFeatures(dict):
    """word -> hashes of the word and its prefixes, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        letters = re.sub(r"[\W_]+", "", word.decode("utf-8", "replace")).lower()
        out = (xxhash.xxh3_64_intdigest("w" + letters), *(xxhash.xxh3_64_intdigest("p" + letters[:n]) for n in PREFIXES if len(letters) >= n)) if letters else ()
        self[word] = tuple(h - (1 << 64) if h >> 63 else h for h in out)
        return self[word]


class ColumnsOf(dict):
    """word -> number of the set of model columns that it counts for (0: none), remembered for a bounded number of words."""

    def __init__(self, columns: dict[int, int]):
        super().__init__()
        self.columns, self.features = columns, WordFeatures()
        self.numbers: dict[tuple[int, ...], int] = {(): 0}
        self.sets: list[tuple[int, ...]] = [()]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        held = tuple(self.columns[h] for h in self.features[word] if h in self.columns)
        number = self.numbers.setdefault(held, len(self.sets))
        if number == len(self.sets):
            self.sets.append(held)
        self[word] = number
        return number


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _counts(text: bytes | None, columns: ColumnsOf) -> Counter:
    """Column -> occurrences in the text. Words without a column, nearly all, are passed over in one array."""
    words = text.split() if text else []
    numbers = np.fromiter(map(columns.__getitem__, words), np.int64, len(words))
    out: Counter = Counter()
    for number, n in zip(*map(np.ndarray.tolist, np.unique(numbers[numbers > 0], return_counts=True)), strict=True):
        for c in columns.sets[number]:
            out[c] += n
    return out


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> feature, toxic and other documents that hold it."""
    features = WordFeatures()
    for batch in small(batches):
        held: dict[int, list[int]] = {}
        for text, y in zip(_texts(batch), batch.column("y").to_pylist(), strict=True):
            for h in {h for word in set(text.split() if text else ()) for h in features[word]}:
                held.setdefault(h, [0, 0])[0 if y else 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())],
            ["feature", "toxic_docs", "other_docs"],
        )


class Ordinal:
    """Shared weights ``w`` and ascending thresholds ``theta``; columns are features by hash."""

    def __init__(self, columns: dict[int, int], w: np.ndarray, theta: np.ndarray):
        self.columns, self.w, self.theta = columns, w, theta

    def above(self, rows: list[Counter]) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES."""
        z = np.array([sum(self.w[c] * np.log1p(n) for c, n in r.items()) for r in rows]).reshape(-1, 1)
        return 1 / (1 + np.exp(-np.clip(z - self.theta, -30, 30)))


def fit(rows: list[Counter], grades: np.ndarray, n_columns: int, epochs: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the whole sample: the sum of the binary losses of all thresholds."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    val = np.log1p(np.array([n for r in rows for n in r.values()], np.float64))
    above = (grades[:, None] >= np.arange(1, GRADES + 1)).astype(np.float64)
    # theta_k = base + sum of exp(step) up to k, so that thresholds stay ordered
    p = [np.zeros(n_columns), np.array(2.0), np.zeros(GRADES - 1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, epochs + 1):
        w, base, steps = p
        theta = base + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
        z = np.bincount(row, w[col] * val, len(rows)) if len(col) else np.zeros(len(rows))
        g = (1 / (1 + np.exp(-np.clip(z[:, None] - theta, -30, 30))) - above) / len(rows)
        gz = g.sum(axis=1)
        gw = (np.bincount(col, gz[row] * val, n_columns) if len(col) else np.zeros(n_columns)) + decay * w
        gt = -g.sum(axis=0)
        grads = [gw, gt.sum(), np.array([gt[k + 1 :].sum() * np.exp(steps[k]) for k in range(GRADES - 1)])]
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1] + np.concatenate(([0.0], np.cumsum(np.exp(p[2]))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, least_docs: int = LEAST_DOCS) -> Ordinal | None:
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    # at most ``sample`` rows of two numbers: small enough to be sent to all tasks
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # a document that the table repeats counts once
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    counted = rows.select("text", "y").mapInArrow(_feature_counts, "feature long, toxic_docs long, other_docs long")
    summed = counted.groupBy("feature").agg(F.sum("toxic_docs").alias("a"), F.sum("other_docs").alias("b")).filter(F.col("a") + F.col("b") >= least_docs)
    size = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic or not other:
        return None
    rate = (F.col("a") + F.col("b")) / (toxic + other)
    z = (F.col("a") / toxic - F.col("b") / other) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / toxic + 1 / other))
    top = summed.withColumn("z", z).orderBy(F.abs("z").desc(), "feature").limit(features).collect()
    columns = {r["feature"]: i for i, r in enumerate(top)}
    speaks = {i for i, r in enumerate(top) if r["z"] > 0 and r["a"] / toxic > 8 * r["b"] / other}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ColumnsOf(columns)
        for batch in small(batches):
            rows = [_counts(t, of) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([list(r.keys()) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))],
                ["doc_id", "y", "cols", "counts"],
            )

    got = sorted(rows.mapInArrow(run, "doc_id long, y int, cols array<int>, counts array<int>").collect(), key=lambda r: r["doc_id"])
    found = [Counter(dict(zip(r["cols"], r["counts"], strict=True))) for r in got]
    y = np.array([r["y"] for r in got])
    hits = np.array([sum(n for c, n in f.items() if c in speaks) for f in found])
    cuts = np.quantile(hits[y == 1], np.arange(1, GRADES) / GRADES)
    grades = np.where(y == 1, 1 + (hits[:, None] > cuts).sum(axis=1), 0)
    return Ordinal(columns, *fit(found, grades, len(columns)))


def grade(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with severity (0 to ``GRADES``), grade (its rounding), toxic (P(grade >= 1) >= 0.5) and kept (not toxic)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, features, least_docs))
    base = docs.drop(*RESULT)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ColumnsOf(model.value.columns) if model.value else None
        for batch in small(batches):
            p = model.value.above([_counts(t, of) for t in _texts(batch)]) if of is not None else np.zeros((batch.num_rows, GRADES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(axis=1), pa.float64()), pa.array(p[:, 0] >= 0.5, pa.bool_())], [*names, "severity", "toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", severity double, toxic boolean"
    return base.mapInArrow(run, schema).withColumns({"grade": F.round("severity").cast("int"), "kept": ~F.col("toxic")})
