"""Repeated passages: every byte that lies in a string of ``length`` bytes which also starts in a document with a smaller id is removed.

A sparse suffix array, refined by bucket pointers. The identifier of the bucket of q bytes (q: half of ``length``) at an offset is a 64-bit digest,
so that all tasks give a bucket the same one without sorting the corpus.

1. *Initial buckets* hold offsets that are minimisers: of each string of ``length`` bytes the q bytes with the least low bits of the digest. Equal strings have their
   minimiser at the same place, so buckets that only one document uses are closed for good: none of their strings is repeated.
2. *Refinement by neighbours*: open buckets are sorted on the identifiers at the offsets ``length - q`` before and after theirs. A suffix whose refined
   bucket begins with a smaller document is repeated with everything around it; a bucket that was not parted is done. What stays open are the
   edges of passages, and edited copies.
3. *Refinement by the later offset*: the strings of open suffixes are sorted on (identifier, identifier ``length - q`` further on), which is the
   whole string; the updates of step 2 are reused: a string near a repeated suffix is not looked at again.

Documents are dealt to blocks of a few MB, written once as a table bucketed by block; each step reads a block where it lies. What tasks exchange is
packed: the distinct identifiers of a block, cut by bucket range, and a bit or byte for each in return. A frequent passage is one entry a block,
however many documents hold it. Equality of whole strings is decided on 96 bits and more of digests.

Definitions that hold for every row: texts are UTF-8 bytes (null: empty), strings never cross documents and are judged on the input;
texts shorter than ``length`` and rows without an id keep all their bytes and take none from others; rows that share an id are one
document to others and never remove each other's bytes; very long texts are dealt to blocks in overlapping pieces; what stays may end
inside a character, so it is binary; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.plans.scratch import materialize, scratch_root

LENGTH = 50
BLOCK_BYTES = 4_000_000  # texts of a block, about
RANGE_BYTES = 8_000_000  # texts whose buckets make one range, about
PIECE = 1 << 19  # bytes of a piece of a long text
CHUNK = 1 << 18  # bytes that are worked on at once; with one piece more and all gaps less than 1 << 20
MOST_PARTS = 100_000

_rng = np.random.default_rng(20250307)
_SYMBOL = _rng.integers(0, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
GAP = 256  # the symbol between documents
GONE, ASKS, GIVES = 1, 2, 4


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << 20), _powers(pow(_BASE, -1, 1 << 64), 1 << 20)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def identifiers(symbols: np.ndarray, q: int) -> np.ndarray:
    """Digest of the q symbols at each offset."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(_SYMBOL[symbols] * _DOWN[: len(symbols)], out=sums[1:])
    return _mix((sums[q:] - sums[:-q]) * _UP[: len(symbols) - q + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def _part(identifier: np.ndarray, parts: int) -> np.ndarray:
    """Bucket range of an identifier, in the order of identifiers."""
    return (((identifier >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Some documents of a block, one after another with gaps."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int):
        """pieces: row of the block, document id, bytes."""
        self.length, self.q = length, (length + 1) // 2
        step, lead = length - self.q, self.q
        starts, at = [], lead
        for _, _, data in pieces:
            starts.append(at)
            at += len(data) + length
        self.pieces, self.starts = pieces, np.array(starts)
        sizes = np.array([len(d) for _, _, d in pieces])
        symbols = np.full(at, GAP, np.uint16)
        for s, (_, _, data) in zip(starts, pieces, strict=True):
            symbols[s : s + len(data)] = np.frombuffer(data, np.uint8)
        self.ids = identifiers(symbols, self.q)
        # offsets of all whole strings, and the minimiser of each
        n = np.maximum(sizes - length + 1, 0)
        self.windows = np.repeat(self.starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        low = np.uint64((1 << 20) - 1)
        # the least by the low 44 bits: the high ones, by which buckets are dealt to ranges, stay even
        packed = (self.ids << np.uint64(20)) | np.arange(len(self.ids), dtype=np.uint64)
        own = (sliding_min(packed, step + 1)[self.windows] & low).astype(np.int64)
        self.anchors, self.own = np.unique(own, return_inverse=True)
        self.doc = np.array([d for _, d, _ in pieces], np.int64)[np.searchsorted(self.starts, self.anchors, "right") - 1]
        self.bucket = self.ids[self.anchors]
        self.around = _mix(self.ids[self.anchors - step] * np.uint64(3) + self.ids[self.anchors + step] * np.uint64(_BASE))

    def near(self, repeated: np.ndarray) -> np.ndarray:
        """Whether a string holds one of the anchors for which ``repeated`` is set, whose whole surroundings are repeated."""
        edge = np.zeros(len(self.ids) + 1, np.int32)
        a = self.anchors[repeated]
        edge[a - (self.length - self.q)] += 1
        edge[a + 1] -= 1
        return np.cumsum(edge[:-1])[self.windows] > 0

    def spans(self, repeated: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, starts, ends) of the removed bytes of each piece, from the strings for which ``repeated`` is set."""
        edge = np.zeros(len(self.ids) + self.q + self.length, np.int32)
        w = self.windows[repeated]
        edge[w] += 1
        edge[w + self.length] -= 1
        covered = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
        first, last = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
        cuts = np.searchsorted(first, [*self.starts, len(edge)])
        for k, (row, _, _) in enumerate(self.pieces):
            here = slice(cuts[k], cuts[k + 1])
            yield row, first[here] - self.starts[k], last[here] - self.starts[k]


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by the keys, where their groups begin in it, and the group of each row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


class Block:
    """The pieces of a block, ordered by document, and how far their strings are known."""

    def __init__(self, table: pa.Table, parts: int, length: int):
        ids, data = table.column("doc_id").to_numpy(), table.column("data").to_pylist()
        self.parts = parts
        self.chunks: list[Chunk] = []
        held, size = [], 0
        for row in np.argsort(ids, kind="stable"):
            held.append((int(row), int(ids[row]), data[row]))
            size += len(data[row]) + length
            if size >= CHUNK:
                self.chunks.append(Chunk(held, length))
                held, size = [], 0
        if held:
            self.chunks.append(Chunk(held, length))
        join = lambda name: np.concatenate([getattr(c, name) for c in self.chunks])
        self.bucket, self.around, self.doc = join("bucket"), join("around"), join("doc")

    def _slices(self, part: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Ranges and their slices of entries that are ordered by range."""
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for s, e in zip(cuts, [*cuts[1:], len(part)], strict=True):
            yield int(part[s]), slice(s, e)

    def initial(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Entries of step 1: 48 bits of each identifier, the last one telling whether several documents of the block use the bucket."""
        order, begin, self.group = _first_of(self.bucket)
        ends = np.append(begin[1:], len(order)) - 1
        several = self.doc[order[begin]] != self.doc[order[ends]] if len(order) else np.zeros(0, bool)
        u = self.bucket[order[begin]]
        entries = ((u & ~np.uint64(1)) | several.astype(np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        for p, s in self._slices(_part(u, self.parts)):
            yield p, entries[s].tobytes(), b"", b""

    def opened(self, answer: bytes) -> None:
        """After step 1: which anchors stand in buckets of several documents."""
        self.live = np.flatnonzero(np.frombuffer(answer, np.uint8)[self.group] > 0) if len(self.group) else np.empty(0, np.int64)

    @staticmethod
    def _pack_docs(docs: np.ndarray) -> tuple[bytes, bytes]:
        ids, index = np.unique(docs, return_inverse=True)
        return ids.astype("<i8").tobytes(), index.astype("<u4").tobytes()

    def surroundings(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Entries of step 2: bucket and surroundings, with the smallest document of the block that has both."""
        bucket, around = self.bucket[self.live], self.around[self.live]
        order, begin, self.group = _first_of(bucket, around)
        first = order[begin]
        self.first_doc = self.doc[self.live][first]
        keys = np.stack([bucket[first], around[first]], 1).astype("<u8")
        for p, s in self._slices(_part(bucket[first], self.parts)):
            yield p, keys[s].tobytes(), *self._pack_docs(self.first_doc[s])

    def refined(self, answer: bytes) -> None:
        """After step 2: the state of each anchor, and of each string."""
        state = np.zeros(len(self.bucket), np.uint8)
        if len(self.live):
            given = np.frombuffer(answer, np.uint8)[self.group]
            state[self.live] = np.where(self.first_doc[self.group] < self.doc[self.live], GONE, given)
        self.repeated, self.open, at = [], [], 0
        for c in self.chunks:
            s = state[at : at + len(c.anchors)]
            at += len(c.anchors)
            gone = c.near(s == GONE)
            self.repeated.append(gone)
            self.open.append(np.flatnonzero((s[c.own] & (ASKS | GIVES) > 0) & ~gone))

    def strings(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Entries of step 3: the identifiers of both halves of each open string, with the smallest document of the block that has it."""
        here, later, doc = [], [], []
        for c, open_ in zip(self.chunks, self.open, strict=True):
            w = c.windows[open_]
            here.append(c.ids[w])
            later.append(c.ids[w + c.length - c.q])
            doc.append(c.doc[c.own[open_]])
        here, later, self.open_doc = np.concatenate(here), np.concatenate(later), np.concatenate(doc)
        # a frequent first half is spread by the second
        part = _part(_mix(here * np.uint64(3) + later), self.parts)
        order, begin, self.group = _first_of(part, here, later)
        first = order[begin]
        self.first_doc = self.open_doc[first]
        keys = np.concatenate([here[first, None].astype("<u8").view(np.uint8), later[first, None].astype("<u8").view(np.uint8)[:, :4]], 1)
        for p, s in self._slices(part[first]):
            yield p, keys[s].tobytes(), *self._pack_docs(self.first_doc[s])

    def settled(self, answer: bytes) -> None:
        """After step 3: all repeated strings."""
        if not len(self.group):
            return
        gone = (np.frombuffer(answer, np.uint8)[self.group] > 0) | (self.first_doc[self.group] < self.open_doc)
        at = 0
        for repeated, open_ in zip(self.repeated, self.open, strict=True):
            repeated[open_[gone[at : at + len(open_)]]] = True
            at += len(open_)


def _docs_of(row: tuple[bytes, bytes]) -> np.ndarray:
    return np.frombuffer(row[0], "<i8")[np.frombuffer(row[1], "<u4")]


def _judge_initial(keys: list[bytes], _docs: list) -> np.ndarray:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    e = wide.view("<u8").ravel()
    _, group, n = np.unique(e >> np.uint64(1), return_inverse=True, return_counts=True)
    shared = n > 1
    shared[group[(e & np.uint64(1)) > 0]] = True
    return shared[group].astype(np.uint8)


def _judge_surroundings(keys: list[bytes], docs: list) -> np.ndarray:
    k = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    d = np.concatenate([_docs_of(x) for x in docs])
    order, begin, group = _first_of(k[:, 0], k[:, 1])
    smallest = np.minimum.reduceat(d[order], begin)
    bucket = k[order[begin], 0]
    new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    of = np.cumsum(np.concatenate(([True], bucket[1:] != bucket[:-1]))) - 1
    low, high = np.minimum.reduceat(smallest, new)[of], np.maximum.reduceat(smallest, new)[of]
    own = smallest[group]
    return np.where(d > own, GONE, np.where(low[group] < d, ASKS, 0) | np.where(high[group] > d, GIVES, 0)).astype(np.uint8)


def _judge_strings(keys: list[bytes], docs: list) -> np.ndarray:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 12)
    d = np.concatenate([_docs_of(x) for x in docs])
    order, begin, group = _first_of(raw[:, :8].copy().view("<u8").ravel(), raw[:, 8:].copy().view("<u4").ravel())
    return (d > np.minimum.reduceat(d[order], begin)[group]).astype(np.uint8)


_JUDGES = (_judge_initial, _judge_surroundings, _judge_strings)
_ENTRY = "part long, block long, keys binary, ids binary, docs binary"
_ANSWER = "block long, step int, part long, answer binary"


def _known(table: pa.Table, answers: pa.Table | None, steps: int, parts: int, length: int) -> tuple[Block, Iterator]:
    """A block with what the first ``steps`` steps gave, and the entries of the next."""
    block = Block(table, parts, length)
    given: dict[int, list[tuple[int, bytes]]] = {}
    if answers is not None:
        for step, part, answer in zip(*(answers.column(c).to_pylist() for c in ("step", "part", "answer")), strict=True):
            given.setdefault(step, []).append((part, answer))
    course = ((block.initial, block.opened), (block.surroundings, block.refined), (block.strings, block.settled))
    for step, (ask, learn) in enumerate(course[:steps]):
        for _ in ask():  # entries are numbered anew, as they were when they were sent
            pass
        learn(b"".join(a for _, a in sorted(given.get(step, []))))
    return block, course[steps][0]() if steps < len(course) else iter(())


def _ask(steps: int, parts: int, length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        _, entries = _known(table, answers, steps, parts, length)
        cols = list(zip(*entries, strict=True)) or [(), (), (), ()]
        number = pa.array([key[0].as_py()] * len(cols[0]), pa.int64())
        return pa.table([pa.array(cols[0], pa.int64()), number, *[pa.array(c, pa.binary()) for c in cols[1:]]], ["part", "block", "keys", "ids", "docs"])

    return (lambda key, table: run(key, table)) if steps == 0 else run


def _judge(step: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("keys").to_pylist()
        docs = list(zip(table.column("ids").to_pylist(), table.column("docs").to_pylist(), strict=True))
        answers = _JUDGES[step](keys, docs)
        cuts = np.cumsum([len(k) // (6, 16, 12)[step] for k in keys])[:-1]
        out = pa.array([x.tobytes() for x in np.split(answers, cuts)], pa.binary())
        return pa.table([table.column("block"), pa.array([step] * len(keys), pa.int32()), table.column("part"), out], ["block", "step", "part", "answer"])

    return run


_SPAN = "array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut_out(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(data[e:s] for e, s in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))


def _remove(parts: int, length: int):
    """Documents in one piece: what stays and the spans that go. Pieces of longer ones: their own bytes and spans in the document."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        block, _ = _known(table, answers, 3, parts, length)
        row, doc, start, size, data = (table.column(c).to_pylist() for c in ("row", "doc_id", "start", "n_bytes", "data"))
        out = []
        for c, repeated in zip(block.chunks, block.repeated, strict=True):
            for k, starts, ends in c.spans(repeated):
                whole, last = size[k] == len(data[k]), start[k] + len(data[k]) == size[k]
                kept = _cut_out(data[k], starts, ends) if whole else data[k] if last else data[k][:PIECE]
                spans = [{"start": s, "end": e} for s, e in zip((starts + start[k]).tolist(), (ends + start[k]).tolist(), strict=True)]
                out.append((row[k], doc[k], start[k], size[k], whole, spans, kept))
        kinds = (*[pa.int64()] * 4, pa.bool_(), _SPANS, pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "doc_id", "start", "n_bytes", "whole", "spans", "kept"])

    return run


def _assemble(table: pa.Table) -> pa.Table:
    """A document from its pieces."""
    table = table.sort_by("start")
    merged: list[list[int]] = []
    for span in sorted((s["start"], s["end"]) for x in table.column("spans").to_pylist() for s in x):
        if merged and span[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span[1])
        else:
            merged.append(list(span))
    data = b"".join(table.column("kept").to_pylist())
    kept = _cut_out(data, np.array([s for s, _ in merged], np.int64), np.array([e for _, e in merged], np.int64))
    first = table.slice(0, 1)
    return pa.table(
        [first.column("doc_id"), first.column("n_bytes"), pa.array([[{"start": s, "end": e} for s, e in merged]], _SPANS), pa.array([kept], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
    )


def _bucketed(df: DataFrame, by: str, n: int) -> DataFrame:
    """``df`` written once to the shared folder, bucketed by a column: every later step by that column reads it without a shuffle."""
    spark = df.sparkSession
    name = f"quillspan_{uuid.uuid4().hex}"
    df.repartition(n, by).write.format("parquet").option("compression", "zstd").option("path", f"{scratch_root(spark)}/quillspan/{name}").bucketBy(n, by).saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed runs: start, end), kept (the other bytes): one row a row of ``docs``."""
    if not 2 <= length <= 1 << 16:
        raise ValueError("length must be between 2 and 65536")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("n_bytes", F.octet_length("data").cast("long"))
    can = F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length)
    total, most = rows.filter(can).agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.max("n_bytes"), F.lit(0))).first()
    blocks, parts = -(-total // BLOCK_BYTES) or 1, -(-total // RANGE_BYTES) or 1
    starts = F.when(F.col("n_bytes") <= PIECE, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - length, F.lit(PIECE).cast("long")))
    pieces = rows.filter(can).withColumn("row", F.monotonically_increasing_id()).withColumn("start", F.explode(starts))
    data = F.when(F.col("n_bytes") <= PIECE, F.col("data")).otherwise(F.substring(F.col("data"), F.col("start").cast("int") + 1, F.lit(PIECE + length - 1)))
    pieces = pieces.select(F.pmod(F.xxhash64("row", "start"), F.lit(blocks)).alias("block"), "row", "doc_id", "start", "n_bytes", data.alias("data"))
    pieces = _bucketed(pieces, "block", min(blocks, MOST_PARTS))
    answers = None
    for step in range(3):
        held = pieces.select("block", "doc_id", "data").groupBy("block")
        if answers is None:
            entries = held.applyInArrow(_ask(step, parts, length), _ENTRY)
        else:
            entries = held.cogroup(answers.groupBy("block")).applyInArrow(_ask(step, parts, length), _ENTRY)
        judged = materialize(entries.groupBy("part").applyInArrow(_judge(step), _ANSWER), f"passages-{step + 1}")
        answers = judged if answers is None else answers.unionByName(judged)
    out = pieces.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(parts, length), f"row long, doc_id long, start long, n_bytes long, whole boolean, spans {_SPAN}, kept binary")
    columns = ["doc_id", "n_bytes", "spans", "kept"]
    untouched = rows.filter(~can).select("doc_id", "n_bytes", F.array().cast(_SPAN).alias("spans"), F.col("data").alias("kept"))
    if most > PIECE:
        out = materialize(out, "passages-kept")
        whole = out.filter("NOT whole").groupBy("row").applyInArrow(_assemble, f"doc_id long, n_bytes long, spans {_SPAN}, kept binary")
        out = out.filter("whole").select(columns).unionByName(whole)
    return out.select(columns).unionByName(untouched)
