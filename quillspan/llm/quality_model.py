"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

1. *Tokens*: a word gives a token for its lower-cased letters and, where it has any, tokens for its shape (capitals,
   runs of symbols, digits, standing alone) and for repeating the word before it. Tokens are hashed into ``BUCKETS``: the vector and the
   rarity of a rare word are those of all words of its bucket.
2. *Random indexing* over all documents: every bucket has a fixed sparse vector of -1, 0 and 1; the context vector
   of a bucket is the sum of the index vectors of its neighbours at every occurrence in the corpus. Each task adds up its
   own texts and emits a row a bucket; rows are summed by Spark. The table has ``BUCKETS`` rows whatever the corpus (2 MB as float32), a proven bound,
   and is then sent to all tasks. A bucket's vector is its own index vector plus its normalised context vector.
3. *Pooling*: the mean of a document's token vectors (rare tokens weigh more), and the log of its length.
4. *Network*: one hidden layer, fitted on the driver on at most ``SAMPLE`` labelled documents, chosen by a hash;
   a fifth of the sample is held back to choose the epoch and to fit the temperature of the output.

Inputs of a score are the text only. Labels of documents with ``crc32(doc_id as text) mod 5 = 0`` are never read
for learning. Reruns agree: index vectors, sample and initial weights come from fixed hashes and seeds, and the context sums are whole numbers.

Definitions that hold for every row: a null or empty text gets the score of the pooled vector 0; repeated rows get
equal scores; a null ``doc_id`` is scored, and not held out; conflicting labels of an id take part each, null labels do
not; without any label the score is 0.5 for all; an empty table gives an empty result; extra columns pass through
(``held_out``, ``score`` and ``predicted`` are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.text import small

BUCKETS = 1 << 13
DIMS = 64
NONZERO = 8
WINDOW = 2
SAMPLE = 20_000
THRESHOLD = 0.3
WORDS_KEPT = 150_000
CHUNK = 50_000  # tokens in work at once

_rng = np.random.default_rng(7)
#: places of the values 1 and -1 of each index vector, half of ``NONZERO`` each
_places = np.argsort(_rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO].astype(np.int32)
PLUS, MINUS = _places[:, : NONZERO // 2].copy(), _places[:, NONZERO // 2 :].copy()

_SYMBOLS = re.compile(rb"[^0-9A-Za-z\x80-\xff]{2,}|[#*$%&|<>@{}\[\]=_~^\\]")


def _bucket(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) % BUCKETS


REPEAT, CAPITALS, DIGITS, ALONE = (_bucket(b"\0" + n) for n in (b"repeat", b"capitals", b"digits", b"alone"))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DIGIT = re.compile(rb"[0-9]")


class Tokens(dict):
    """word -> its number; ``buckets[number]`` holds up to three buckets, filled up with -1. A bounded number of words
    is remembered."""

    def __init__(self):
        super().__init__()
        self.buckets = np.full((WORDS_KEPT, 4), -1, np.int32)

    def clear(self) -> None:
        super().clear()
        self.buckets.fill(-1)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        core = word.strip(_PUNCTUATION)
        if core:
            if core.isascii():
                lower, capitals = core.lower(), len(core) > 1 and core.isupper()
            else:
                text = core.decode("utf-8", "replace")
                lower, capitals = text.lower().encode(), len(text) > 1 and text.isupper()
            self.buckets[number, 0] = _bucket(lower)
            if capitals:
                self.buckets[number, 1] = CAPITALS
            elif not core.isalpha() and _DIGIT.search(core):
                self.buckets[number, 1] = DIGITS
        else:
            self.buckets[number, 0] = ALONE
        if not word.isalpha() and (m := _SYMBOLS.search(word)):
            self.buckets[number, 2] = _bucket(b"\0symbols" + m[0][:1])
        return number


def token_ids(text: bytes | None, tokens: Tokens) -> np.ndarray:
    """Buckets of the tokens of a text, in order."""
    words = text.split() if text else []
    out = []
    for at in range(0, len(words), WORDS_KEPT // 4):
        part = words[at : at + WORDS_KEPT // 4]
        if len(tokens) + len(part) >= WORDS_KEPT:
            tokens.clear()
        number = np.fromiter(map(tokens.__getitem__, part), np.int64, len(part))
        rows = tokens.buckets[number]
        repeated = np.flatnonzero(number[1:] == number[:-1]) + 1
        rows[repeated, 3] = REPEAT
        if at and part[0] == words[at - 1]:
            rows[0, 3] = REPEAT
        flat = rows.reshape(-1)
        out.append(flat[flat >= 0])
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _add_context(total: np.ndarray, seen: np.ndarray, ids: np.ndarray, doc: np.ndarray, fresh: np.ndarray) -> None:
    """Add the index vectors of each token's neighbours in its document to the row of its bucket. Tokens that are not ``fresh``
    lead a later piece of a long text: they are neighbours of fresh ones, and else counted with the piece before."""
    centre, near = [], []
    for d in range(1, WINDOW + 1):
        same = (doc[d:] == doc[:-d]) & fresh[d:]
        left, right = ids[:-d][same], ids[d:][same]
        centre += [right, left]
        near += [left, right]
    centre, near = np.concatenate(centre) * DIMS, np.concatenate(near)
    for places, sign in ((PLUS, 1), (MINUS, -1)):
        total += sign * np.bincount((centre[:, None] + places[near]).reshape(-1), minlength=BUCKETS * DIMS).reshape(BUCKETS, DIMS)
    seen += np.bincount(ids[fresh], minlength=BUCKETS)


def context_sums(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors (BUCKETS x DIMS whole numbers) and token counts of the buckets, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total, seen = Tokens(), np.zeros((BUCKETS, DIMS), np.int64), np.zeros(BUCKETS, np.int64)
        held, lead, n = [], [], 0

        def flush():
            nonlocal held, lead, n
            if n:
                sizes = [len(x) for x in held]
                starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
                fresh = np.arange(n) - starts >= np.repeat(lead, sizes)
                _add_context(total, seen, np.concatenate(held), np.repeat(np.arange(len(held)), sizes), fresh)
            held, lead, n = [], [], 0

        for batch in small(batches):
            for text in _texts(batch):
                ids = token_ids(text, tokens)
                for at in range(0, len(ids), CHUNK):  # the pieces of a very long text overlap by the window
                    lead.append(min(at, WINDOW))
                    held.append(ids[at - lead[-1] : at + CHUNK])
                    n += len(held[-1])
                    if n >= CHUNK:
                        flush()
        flush()
        used = np.flatnonzero(seen)
        for at in range(0, len(used), 1024):
            rows = used[at : at + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(seen[rows]), *[pa.array(total[rows, d]) for d in range(DIMS)]], ["bucket", "n", *[f"d{d}" for d in range(DIMS)]]
            )

    schema = ", ".join(["bucket long", "n long", *[f"d{d} long" for d in range(DIMS)]])
    rows = docs.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS)])
    table = rows.toArrow()  # BUCKETS rows at most
    total, seen = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    at = table.column("bucket").to_numpy()
    seen[at] = table.column("n").to_numpy()
    for d in range(DIMS):
        total[at, d] = table.column(f"d{d}").to_numpy()
    return total, seen


def word_vectors(total: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """One vector a bucket: own index vector and context vector, each of length 1, times the weight of the token."""
    shown = seen > 0
    mean = total[shown].sum(axis=0) / max(seen.sum(), 1.0)
    context = total - seen[:, None] * mean  # what all words share says nothing
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    weight = 1e-3 / (1e-3 + seen / max(seen.sum(), 1.0))
    own = np.zeros((BUCKETS, DIMS))
    np.put_along_axis(own, PLUS, 1 / np.sqrt(NONZERO), axis=1)
    np.put_along_axis(own, MINUS, -1 / np.sqrt(NONZERO), axis=1)
    vectors = (own + context) * (0.3 + weight)[:, None]
    return np.where(shown[:, None], vectors, 0).astype(np.float32)


def pool(ids: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Document vectors: mean of the token vectors, and log of the number of tokens."""
    out = np.zeros((len(ids), DIMS + 1), np.float32)
    sizes = np.array([len(x) for x in ids])
    at = 0
    while at < len(ids):
        end, n = at, 0
        while end < len(ids) and (n == 0 or n + sizes[end] <= CHUNK):
            n += sizes[end]
            end += 1
        live = np.flatnonzero(sizes[at:end]) + at
        if len(live):
            flat = np.concatenate([ids[i] for i in live])
            starts = np.concatenate(([0], np.cumsum(sizes[live])[:-1]))
            out[live, :DIMS] = np.add.reduceat(vectors[flat], starts, axis=0) / sizes[live, None]
        at = end
    out[:, DIMS] = np.log1p(sizes) / 4
    return out


class Network:
    """Standardised inputs, one tanh layer, a logistic output over a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on mini-batches; the best epoch on held-back rows, and the temperature that fits those rows best."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, train = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best, kept = np.inf, [a.copy() for a in p]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            gh = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[rows].T @ gh + decay * p[0], gh.sum(axis=0), h.T @ g + decay * p[2], g.sum()]
            step += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        check = back if len(back) else train
        now = _loss(np.tanh(z[check] @ p[0] + p[1]) @ p[2] + p[3], y[check])
        if now < best:
            best, kept = now, [np.array(a) for a in p]
    net = Network(mean, scale, *kept, 1.0)
    check = back if len(back) else train
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    logits = net.logits(x[check])
    net.temperature = float(min(grid, key=lambda t: _loss(logits / t, y[check])))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pooled(docs: DataFrame, vectors, keep: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in small(batches):
            x = pool([token_ids(t, tokens) for t in _texts(batch)], vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array([r.tobytes() for r in x], pa.binary())], [keep, "x"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x binary")


def train(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality", sample: int = SAMPLE) -> Network | None:
    """Fit on at most ``sample`` labelled documents outside the held-out fifth; None without two classes."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(sample).select("doc_id", F.col(label).cast("double").alias("y"))
    # at most ``sample`` rows of two numbers: small enough to be sent to all tasks
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("k", F.col("y"))
    pooled = _pooled(rows.withColumn("key", F.concat_ws(":", "doc_id", "k")), vectors, "key", "string")
    # a document that the table repeats counts once, so that ``sample`` bounds what comes to the driver
    got = sorted(pooled.groupBy("key").agg(F.min("x").alias("x")).collect(), key=lambda r: r["key"])
    if not got:
        return None
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in got], np.float64)
    y = np.array([float(r["key"].split(":")[1]) for r in got])
    return fit(x, y) if 0 < y.sum() < len(y) else None


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    sc = docs.sparkSession.sparkContext
    total, seen = context_sums(docs)
    vectors = sc.broadcast(word_vectors(total, seen))
    net = train(docs, labels, vectors, label, sample)
    base = docs.drop("held_out", "score", "predicted")
    names = base.columns
    model = sc.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in small(batches):
            x = pool([token_ids(t, tokens) for t in _texts(batch)], vectors.value)
            score = model.value.score(x) if model.value is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double"
    scored = base.mapInArrow(run, schema)
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})
