"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. *Sketch* (one pass over the texts): number of distinct word shingles, a 128-bit key of the normalised words, and a
   MinHash signature of 128 one-byte values. Texts with equal keys form a class; classes are the vertices of everything
   that follows, so exact copies never meet as pairs and rows that share an id but not a text are never mixed up.
2. *Forest*: each tree is a fixed order of signature positions. A label is the signature read in that order; all
   labels are sorted (range partitioned by label and class, so no prefix, however common, lands in one task).
   Neighbours in a sorted order whose common prefix is long enough are candidates: the longest common prefixes.
3. *Confirm*: candidates whose signatures agree in 82 of 128 places or more are compared on their full shingle sets.
4. *Adaptive depth*: a region is the set of classes that share the prefix of a level. One that still holds several components
   after its neighbours were confirmed is looked at again: where few classes are outside its largest component (``OUTS``, or
   ``MOST_OUTS`` if that is half of the region or more), these are queries against all of the region (work linear in the region);
   else, as in a template family in which nothing is linked, the region is split: its classes go to the next level of
   ``LEVELS``, with longer prefixes and, because a longer prefix is shared more rarely, more trees. On later levels regions of up
   to ``MOST_COMPARED`` comparisons are searched, too, and those of the last level to the end in bounded blocks. A region of one
   block takes one row a class.
5. *Components* by contraction; every document gets the smallest id reachable.

A pair of similarity 0.8 shares a region of some tree but for a chance of 1e-5 or less on each level, and passes the signature test
but for one of about 3e-6; there are no caps on candidates or partners.

Definitions that hold for every row: words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text with fewer
words than ``width`` is one shingle; a null text or one without words has no shingles and is linked with nothing (its
component is its own id); repeated rows are linked to each other by their equal text; rows with a null id are never
linked and never kept; rows that share an id but not a text are judged each by its text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.components import connected
from quillspan.llm.text import small
from quillspan.plans.scratch import discard, materialize

HASHES = 128
AGREE = 82


class Level(NamedTuple):
    depth: int  # values of the prefix that makes a region
    trees: int  # orders of positions; (1 - 0.8 ** depth) ** trees is the chance to miss a pair of similarity 0.8
    label: int  # values of a label: neighbours are those of the longest common prefix up to here


#: 6 values: missed with 5e-7. 10 and 14 values: missed with 1e-5.
LEVELS = (Level(6, 48, 12), Level(10, 102, 10), Level(14, 256, 14))
OUTS = 16  # classes outside the largest component that any region searches without a split
MOST_OUTS = 1024  # the same where the largest component is at least half of the region, as among near copies
MOST_COMPARED = 1 << 22  # comparisons of signatures for which no region below the first level is split: 2,048 a class of a region of strangers
BLOCK = 1_500_000  # shingles of one block of a region, about
BLOCK_ROWS = 1024  # classes of one block of a region, about
WORDS_KEPT = 400_000

_rng = np.random.default_rng(20240611)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
ORDERS = [np.array([_rng.permutation(HASHES)[: x.label] for _ in range(x.trees)]) for x in LEVELS]


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    acc = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for j in range(min(width, len(words))):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def signature(shingles: np.ndarray) -> bytes:
    """One byte of each of 128 minima."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    top = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(top), 1024):
        np.minimum(low, ((top[None, at : at + 1024] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=low)
    return (((low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _texts(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).cast(pa.binary()).to_pylist()


def sketch(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, text, h) -> doc_id, h, n_shingles, key, sig; key and sig are null without shingles or id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            n, keys, sigs = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), _texts(batch, "text"), strict=True):
                words = text.lower().split() if text else []
                s = shingle_set(words, width, hashes)
                n.append(len(s))
                live = len(s) and i is not None
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if live else None)
                sigs.append(signature(s) if live else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "h", "n_shingles", "key", "sig"],
            )

    return texts.mapInArrow(run, "doc_id long, h long, n_shingles long, key binary, sig binary")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(v, sig, text) -> v, sig, shingles (sorted distinct hashes as signed longs). A class that a task meets again is not repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in small(batches):
            fresh = [v not in seen and not seen.add(v) for v in batch.column("v").to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            sets = [shingle_set(t.lower().split() if t else [], width, hashes).view(np.int64) for t in _texts(batch, "text")]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("sig"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["v", "sig", "shingles"])

    return texts.mapInArrow(run, "v long, sig binary, shingles array<long>")


def _labels(n: int) -> Callable:
    """(v, sig) -> one row a tree of level ``n``: label (tree, then values in the tree's order), v."""
    orders, size = ORDERS[n], LEVELS[n].label
    trees = len(orders)
    number = np.arange(trees, dtype=">u2").view(np.uint8).reshape(trees, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches, 48_000 // trees):
            vs = part.column("v").to_numpy(zero_copy_only=False)
            sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            out = np.empty((len(vs), trees, 2 + size), np.uint8)
            out[:, :, :2] = number
            out[:, :, 2:] = sigs[:, orders]
            labels = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 + size), len(vs) * trees, [None, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([labels.cast(pa.binary()), pa.array(np.repeat(vs, trees))], ["label", "v"])

    return run


def _regions(labels: list[bytes], level: Level) -> np.ndarray:
    """A number a label: the tree in the high bits, then a hash of the prefix."""
    rows = np.frombuffer(b"".join(labels), np.uint8).reshape(-1, 2 + level.label).astype(np.uint64)
    acc = np.zeros(len(rows), np.uint64)
    for j in range(level.depth):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, 2 + j] + np.uint64(1))
    return ((rows[:, 0] << np.uint64(8) | rows[:, 1]) << np.uint64(52) | acc >> np.uint64(12)).view(np.int64)


def _neighbours(level: Level) -> Callable:
    """Sorted labels -> adjacent pairs that share a region; the ends of the partition come out with b null."""

    def pack(region, a, b, label):
        return pa.RecordBatch.from_arrays(
            [pa.array(region, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(label, pa.binary())], ["region", "a", "b", "label"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vs, labels = batch.column("v").to_numpy(zero_copy_only=False), batch.column("label").to_pylist()
            if kept is None:
                yield pack(_regions(labels[:1], level), vs[:1], [None], labels[:1])
            else:
                vs, labels = np.concatenate(([kept[0]], vs)), [kept[1], *labels]
            kept = vs[-1], labels[-1]
            region = _regions(labels, level)
            same = (region[1:] == region[:-1]) & (vs[1:] != vs[:-1])
            yield pack(region[1:][same], vs[:-1][same], vs[1:][same], [None] * int(same.sum()))
        if kept is not None:
            yield pack(_regions([kept[1]], level), [kept[0]], [None], [kept[1]])

    return run


def _sorted_labels(classes: DataFrame, n: int) -> DataFrame:
    labels = classes.mapInArrow(_labels(n), "label binary, v long")
    return labels.repartitionByRange("label", "v").sortWithinPartitions("label", "v")


def _shared(level: Level) -> Callable:
    """Sorted labels -> (region, v) of those that share their region with the label before or after; the ends of the
    partition, whose other neighbour is not seen, come out too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bool] | None = None  # the last label so far, and whether it shares its region
        for batch in batches:
            if not batch.num_rows:
                continue
            region, vs = _regions(batch.column("label").to_pylist(), level), batch.column("v").to_numpy(zero_copy_only=False)
            first = held is None
            if not first:
                region, vs = np.concatenate(([held[0]], region)), np.concatenate(([held[1]], vs))
            same = region[1:] == region[:-1]
            keep = np.concatenate(([True if first else held[2]], same)) | np.concatenate((same, [False]))
            held = region[-1], vs[-1], bool(keep[-1])
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(region[keep]), pa.array(vs[keep])], ["region", "v"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["region", "v"])

    return run


def forest_members(classes: DataFrame, n: int) -> DataFrame:
    """(v, sig) -> region, v: the classes of level ``n`` that share a region with another one, and a few that may."""
    return materialize(_sorted_labels(classes, n).mapInArrow(_shared(LEVELS[n]), "region long, v long"), "members")


def forest_neighbours(classes: DataFrame, n: int = 0) -> DataFrame:
    """(v, sig) -> region, a, b: neighbours in the sorted orders of level ``n`` that share a region."""
    found = materialize(_sorted_labels(classes, n).mapInArrow(_neighbours(LEVELS[n]), "region long, a long, b long, label binary"), "neighbours")
    # the two ends of each partition meet here: two rows a partition
    w = Window.orderBy("label", "a")
    ends = found.filter(F.col("b").isNull()).select("region", "a", F.lead("a").over(w).alias("b"), F.lead("region").over(w).alias("next"))
    return found.filter(F.col("b").isNotNull()).select("region", "a", "b").union(
        ends.filter((F.col("region") == F.col("next")) & (F.col("a") != F.col("b"))).select("region", "a", "b")
    )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def _is_link(inter, union, percent: int):
    return 100 * inter >= percent * union


def _search_region(percent: int, n: int) -> Callable:
    orders, depth = ORDERS[n], LEVELS[n].depth

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = key[0].as_py() >> 52
        cols = {c: table.column(c).combine_chunks() for c in table.column_names}
        vs, comp, query, row = (cols[c].to_numpy(zero_copy_only=False) for c in ("v", "comp", "query", "row"))
        sigs = np.frombuffer(b"".join(cols["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        lists = cols["shingles"]
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [flat[offsets[i] : offsets[i + 1]] for i in range(len(vs))]
        root: dict[int, int] = {}

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        rows = np.flatnonzero(row)
        a, b = [], []
        for q in np.flatnonzero(query):
            same = sigs[rows] == sigs[q]
            near = rows[(same.sum(axis=1) >= AGREE) & (comp[rows] != comp[q])]
            if not len(near):
                continue
            # a pair is searched in the first tree whose region it shares
            first = (sigs[near] == sigs[q])[:, orders[:, :depth]].all(axis=2).argmax(axis=1)
            for r in near[first == tree]:
                if find(comp[q]) == find(comp[r]):
                    continue
                inter = len(np.intersect1d(sets[q], sets[r], assume_unique=True))
                if _is_link(inter, len(sets[q]) + len(sets[r]) - inter, percent):
                    root[find(comp[q])] = find(comp[r])
                    a.append(comp[q])
                    b.append(comp[r])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def plan_regions(members: DataFrame, labels: DataFrame, classes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """What is left to do in the regions of ``members`` (region, v) that hold several components of ``labels`` (v, comp):
    (region, v, comp, out, nr, nq) of those to be searched on this level, in ``nr`` blocks of all rows by ``nq`` of those outside the largest
    component, and the classes v of those to be split on the next."""
    # what a member needs of its class meets it in one join
    known = classes.select("v", (F.col("n") + 64).alias("weight")).join(labels, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"), "weight")
    placed = members.join(known, "v", "left").select("region", "v", "comp", "weight")
    by_comp = placed.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    order = F.struct("n", "comp")
    mixed = by_comp.groupBy("region").agg(
        F.max_by("comp", order).alias("main"), (F.sum("n") - F.max("n")).alias("outs"), F.sum("n").alias("size"), F.sum("w").alias("all"), (F.sum("w") - F.max_by("w", order)).alias("beside"), F.count(F.lit(1)).alias("comps")
    )
    few = (F.col("outs") <= OUTS) | ((F.col("outs") <= MOST_OUTS) & (2 * F.col("outs") <= F.col("size")))
    here = F.lit(True) if n + 1 == len(LEVELS) else few if n == 0 else few | (F.col("outs") * F.col("size") <= MOST_COMPARED)
    parts = lambda w, count: F.ceil(F.greatest(F.col(w) / BLOCK, F.col(count) / BLOCK_ROWS)).cast("int")
    mixed = mixed.filter("comps > 1").select("region", "main", here.alias("here"), parts("all", "size").alias("nr"), parts("beside", "outs").alias("nq"))
    rows = placed.join(mixed, "region").select("region", "v", "comp", (F.col("comp") != F.col("main")).alias("out"), "here", "nr", "nq")
    rows = materialize(rows, "mixed-regions")
    return rows.filter("here").drop("here"), rows.filter("NOT here").select("v").distinct()


def _search(rows: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between components of the regions ``rows``: classes outside the largest component against all of the
    region, in blocks of bounded size."""
    dealt = rows.withColumn("h", F.xxhash64("v"))
    whole, cut = dealt.filter("nr = 1 AND nq = 1"), dealt.filter("nr > 1 OR nq > 1")
    alone = whole.select("region", "v", "comp", F.lit(True).alias("row"), F.col("out").alias("query"), F.lit(0).alias("q"), F.lit(0).alias("r"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod("h", F.col(n)).cast("int")
    all_rows = cut.select("region", "v", "comp", F.lit(True).alias("row"), F.lit(False).alias("query"), each("nq").alias("q"), one("nr").alias("r"))
    asked = cut.filter("out").select("region", "v", "comp", F.lit(False).alias("row"), F.lit(True).alias("query"), one("nq").alias("q"), each("nr").alias("r"))
    work = alone.union(all_rows).union(asked).join(sets, "v")
    return work.groupBy("region", "q", "r").applyInArrow(_search_region(percent, n), "a long, b long").distinct()


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(v, comp) of the classes that are linked once ``links`` (a, b) are added to ``labels``."""
    of = lambda c: labels.select(F.col("v").alias(c), F.col("comp").alias(f"c{c}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = connected(lifted)
    moved = labels.join(more.select(F.col("v").alias("c1"), F.col("comp").alias("c2")), F.col("comp") == F.col("c1"), "left").select("v", F.coalesce("c2", "comp").alias("comp"))
    fresh = more.join(labels.select(F.col("v").alias("known")), F.col("v") == F.col("known"), "left_anti")
    return materialize(moved.union(fresh.select("v", "comp")), "components")


def _judge(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, group (null for a row that is linked with nothing), component_id: one row a row."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sketched = materialize(sketch(texts, width), "sketches")
    found = sketched.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(F.struct("doc_id", "h")).alias("row"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")
    )
    # written once, so that the number of a class stays what it is
    classes = materialize(found.select(F.monotonically_increasing_id().alias("v"), "key", "row.doc_id", "row.h", "sig", "n", "copies"), "classes")
    labels, sets, live = None, None, classes.select("v", "sig")
    for n in range(len(LEVELS)):
        if n == 0:
            near = materialize(forest_neighbours(live), "forest")
            # neighbours of the first level make most of the links; what they leave open is searched region by region
            pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            sig = classes.select("v", "sig")
            joined = pairs.join(sig.select(F.col("v").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("v").alias("b"), F.col("sig").alias("sig_b")), "b")
            agreeing = materialize(joined.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing, "a long, b long"), "agreeing")
            # the full sets of all classes that may be compared on any level: later levels look at members of crowded regions only
            # (the neighbours themselves are confirmed, so that a region of one pair is done)
            several = near.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("region")
            members = materialize(near.join(several, "region").select("region", F.explode(F.array("a", "b")).alias("v")).distinct(), "members")
            wanted = agreeing.select(F.explode(F.array("a", "b")).alias("v")).union(members.select("v")).distinct()
            wanted = materialize(wanted.join(classes.select("v", "doc_id", "h", "sig"), "v"), "wanted")
            # the only time that texts move: by hash of (id, text), against a table of numbers
            read = texts.join(wanted.hint("shuffle_hash"), ["doc_id", "h"]).select("v", "sig", "text")
            sets = materialize(shingle_sets(read, width).dropDuplicates(["v"]), "sets")
            of_a, of_b = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
            inter = F.size(F.array_intersect("sa", "sb"))
            links = agreeing.join(of_a, "a").join(of_b, "b").filter(_is_link(inter, F.size("sa") + F.size("sb") - inter, percent)).select("a", "b")
            labels = connected(materialize(links, "links"))
            discard(near)
        else:
            members = forest_members(live, n)
        rows, split = plan_regions(members, labels, classes, n)
        labels = _merge(labels, materialize(_search(rows, sets, n, percent), "region-links"))
        discard(members)
        if n + 1 == len(LEVELS):
            break
        split = materialize(split, "crowded")
        if split.isEmpty():
            break
        live = classes.join(split, "v").select("v", "sig")
    placed = classes.join(labels, "v", "left").select("key", "doc_id", "copies", "comp")
    of_comp = placed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min("key").alias("group"))
    # classes of several rows and linked ones are looked up; every other row is its own group
    known = placed.filter("copies > 1 OR comp IS NOT NULL").join(of_comp, "comp", "left")
    known = materialize(known.select("key", F.coalesce("group", "key").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id")), "class-components")
    out = sketched.select("doc_id", "h", "n_shingles", "key").join(known, "key", "left")
    return out.select("doc_id", "h", "n_shingles", F.coalesce("group", "key").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of ``docs``."""
    out = _judge(docs, width, percent, doc_id, text).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (of several texts of that id, the one with
    the smallest hash; of rows that agree in both, any one). Rows that are linked with nothing, because they have no word or no id, all stay.

    Texts are shuffled once, by hash of (id, text), against a table of numbers; once more only where rows repeat id and text."""
    judged = _judge(docs, width, percent, doc_id, text).filter(F.col("group").isNotNull())
    rows = judged.groupBy("group", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", "h", "n")).alias("m"))
    first = materialize(first.select(F.col("m.doc_id").alias("__kept_id"), F.col("m.h").alias("__kept_h"), F.col("m.n").alias("__kept_n")), "kept-rows")
    has_words = F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)) & F.col(doc_id).isNotNull()
    keyed = docs.filter(has_words).withColumns({"__id": F.col(doc_id).cast("long"), "__h": F.xxhash64(text)})
    on = (F.col("__id") == F.col("__kept_id")) & (F.col("__h") == F.col("__kept_h"))
    out = keyed.join(first.filter("__kept_n = 1").hint("shuffle_hash"), on).select(docs.columns).unionByName(docs.filter(~has_words))
    several = first.filter("__kept_n > 1")
    if not several.isEmpty():
        # equal rows are merged where they lie before they meet
        merged = keyed.groupBy("__id", "__h").agg(F.first(F.struct(docs.columns)).alias("__row"))
        out = out.unionByName(merged.join(several, on).select("__row.*"))
    return out
