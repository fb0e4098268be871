"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

1. *Tokenise* every whole text with both vocabularies. A word between two single spaces is encoded once a task and remembered: neither
   vocabulary has an entry that runs from a visible character into a space (checked when they are loaded, else texts are encoded in one
   piece), so this gives the tokens of the whole text. For the same reason new words are encoded many at once, joined by single spaces, and
   the tokens are dealt back by their bytes.
2. *Anchors*: ends that both token sequences share just before a token that begins with a space. They cut a document into windows of token
   ids. A window's alignment depends on its ids alone, so it is remembered by the two id tuples.
3. *Counts*: a block of documents gives one row for each id pair that it links; these are added up over the corpus, the highest
   count of each id of the second vocabulary is found, and what the pairs of a block came to goes back to its documents. Texts and token
   ids are not shuffled, only numbers of windows.

Definitions that hold for every row: texts are encoded without special tokens, whose names are plain text; a text is read as a space and the
text. A null or empty text, and one whose bytes are not given back by the tokens of both (as where a tokenizer normalises, or the bytes are no
UTF-8), has no tokens: all numbers are 0 and the digest is empty. Repeated rows, null ids and ties count like all others; very long texts are encoded
and aligned in parts at single spaces between letters; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.plans.scratch import materialize

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 8_000_000  # text of one block, about
BLOCK_ROWS = 20_000
REMEMBERED = 150_000  # words, and windows, that a task remembers, about
PART = 1 << 20  # characters of a long text that are aligned at once, about
JOINED = (1000, 50)  # words that are encoded as one text; the fewer where the tokens of the more do not give back the bytes
SHORT = 100  # characters
# Fixed value: how byte-level entries of this kind split a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GAP = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"[^\S \n]")  # white space other than spaces and line ends
LETTERS = re.compile(r"(?<=[a-z]) (?=[a-z])")


def _byte_level() -> dict[str, int]:
    """Character -> byte of byte-level entries: printable Latin-1 stands for itself, other bytes for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Ids of words in context, bytes of ids. ``words`` tells whether texts can be encoded word by word."""

    tokens: list[bytes]
    words: bool

    def _finish(self) -> None:
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.spaced = [t[:1] == b" " for t in self.tokens]
        # no entry leads from something visible to a space: encoding never joins what stands left and right of a single space
        self.words = not any(re.search(r"\S ", t.decode("utf-8", "replace")) for t in self.tokens)


class ByteVocabulary(Vocabulary):
    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        byte, model = _byte_level(), json.loads(data)["model"]
        entries = model["vocab"]
        self.tokens = [b""] * self.tokenizer.get_vocab_size()
        for entry, i in entries.items():
            self.tokens[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        merged = [entries["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.ranked = None
        if merged == sorted(merged):  # ids are ranks of merges: a second encoder of the same entries is several times faster
            special = {t["id"] for t in json.loads(data).get("added_tokens", [])}
            ranks = {self.tokens[i]: i for i in entries.values() if i not in special}
            self.ranked = tiktoken.Encoding("entries", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._finish()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and the text, for each text. Short texts of printable ASCII, in which encoders cannot differ about the kind of a character,
        go to the faster encoder."""
        out: list = [self.ranked.encode_ordinary(" " + t) if self.ranked and len(t) <= SHORT and t.isascii() and t.isprintable() else None for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([f" {texts[k]}" for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def quick(self, word: str) -> bool:
        """Whether a word without spaces may go to the faster encoder."""
        return self.ranked is not None and len(word) <= SHORT and word.isascii() and word.isprintable()

    def encode_text(self, text: str, quick: bool) -> list[int]:
        """Ids of a space and the text; quick: all its words are."""
        return self.ranked.encode_ordinary(f" {text}") if quick else self.tokenizer.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids


class PieceVocabulary(Vocabulary):
    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = p = SentencePieceProcessor(model_proto=data)
        self.tokens = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
        self._finish()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the processor adds the space."""
        return self.processor.encode(texts, num_threads=1)

    def encode_text(self, text: str) -> list[int]:
        return self.processor.encode(text)


def _words(text: str) -> list[str]:
    """The text cut at the single spaces between visible characters."""
    if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or ODD.search(text):
        return GAP.split(text)
    return text.split(" ")


def _whole(text: str) -> list[str]:
    return [text]


class Windows:
    """Alignments of windows, by number. New ones are aligned together: their shared ends are found in two sorted arrays of offsets, and their
    groups are written by one join of ready pieces. Windows that can be met in several words are remembered by their two id tuples."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides = (a, b)
        self.size = max(len(a.tokens), len(b.tokens))
        self.pieces = [f"{i}{end}" for end in ",|;\n" for i in range(self.size)]
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        self.groups: list[str] = []
        self.sizes = array("q"), array("q")  # of each window: its ids on either side
        self.starts, self.links = array("q", [0]), array("q")  # of each window: where its links begin; id of a << 32 | id of b

    def number(self, keys: list[tuple[tuple[int, ...], tuple[int, ...]]]) -> list[int]:
        """The number of each window; all have the same bytes on both sides."""
        fresh = [k for k in dict.fromkeys(keys) if k not in self.numbers]
        if fresh:
            flat = [np.fromiter(chain.from_iterable(w[side] for w in fresh), np.int64) for side in (0, 1)]
            numbers = self.add(flat, [np.array([len(w[side]) for w in fresh]) for side in (0, 1)])
            self.numbers.update(zip(fresh, numbers, strict=True))
        return [self.numbers[k] for k in keys]

    def add(self, flat: list[np.ndarray], count: list[np.ndarray]) -> range:
        """Numbers of new windows, given as the ids of all of them and how many are of each, on either side."""
        (a, b), ends = flat, [np.cumsum(v.lengths[x]) for v, x in zip(self.sides, flat, strict=True)]
        at = np.searchsorted(ends[1], ends[0])  # both end with the last window, so none lies behind
        last_a = np.flatnonzero(ends[1][at] == ends[0])
        last_b = at[last_a]
        window_end = np.zeros(len(last_a), bool)
        window_end[np.searchsorted(last_a, np.cumsum(count[0]) - 1)] = True
        # pieces: ids of the first side end by , or |, of the second by , or ; or the end of the window
        of_a, of_b = a.copy(), b.copy()
        of_a[last_a] += self.size
        of_b[last_b] += np.where(window_end, 3, 2) * self.size
        group_a, group_b = (np.searchsorted(last, np.arange(len(x))) for x, last in ((a, last_a), (b, last_b)))
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = of_a
        line[np.arange(len(b)) + (last_a + 1)[group_b]] = of_b
        text = "".join(map(self.pieces.__getitem__, line.tolist()))
        before = len(self.groups)
        self.groups += text.split("\n")[:-1]
        for sizes, c in zip(self.sizes, count, strict=True):
            sizes.frombytes(c.astype(np.int64).tobytes())
        self.starts.frombytes((self.starts[-1] + np.flatnonzero(window_end) + 1).astype(np.int64).tobytes())
        self.links.frombytes((a[last_a] << 32 | b[last_b]).tobytes())
        return range(before, len(self.groups))


class Aligner:
    """Tokens and windows of texts; words and windows that were met are remembered until ``forget``."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteVocabulary(a), PieceVocabulary(b)
        self.by_word = self.a.words and self.b.words
        self.split = _words if self.by_word else _whole
        self.windows = Windows(self.a, self.b)
        self.forget()

    @property
    def full(self) -> bool:
        return len(self.words) > REMEMBERED or len(self.windows.groups) > REMEMBERED

    def forget(self) -> None:
        # word -> its window; -1 if the tokens do not give back its bytes; below that, -2 - its place in ``several``
        self.words: dict[str, int] = {}
        self.several: list[tuple[int, ...]] = []
        self.windows.forget()

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts, without the single space between letters at which it is cut."""
        at = 0
        while len(text) - at > PART and self.by_word and (m := LETTERS.search(text, at + PART)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them tokenised and cut into windows from now on."""
        found = [self.split(t) for t in texts]
        fresh = set(chain.from_iterable(found)).difference(self.words)
        quick, slow, rest = [], [], []
        for word in fresh:
            # words that begin or end with white space are not what they are alone when they stand in a row
            kind = rest if not self.by_word or " " in word or word.strip() != word else quick if self.a.quick(word) else slow
            kind.append(word)
        rest += self.learn_rows(quick, True) + self.learn_rows(slow, False)
        for at in range(0, len(rest), 2000):
            self.learn_words(rest[at : at + 2000])
        return found

    def learn_rows(self, words: list[str], quick: bool) -> list[str]:
        """Learn words without inner or outer spaces, many as one text; those of texts whose tokens do not give back the bytes are returned."""
        for size in JOINED:
            words = [w for at in range(0, len(words), size) if not self.learn_row(words[at : at + size], quick) for w in words[at : at + size]]
        return words

    def learn_row(self, words: list[str], quick: bool) -> bool:
        """Learn the words of a text that they make with single spaces, if its tokens give back the bytes, on both sides and word by word."""
        joined = " ".join(words)
        whole = b" " + joined.encode()
        ends = np.cumsum([len(w) + 1 for w in (words if quick else whole[1:].split(b" "))])
        flat, count = [], []
        for v, ids in ((self.a, self.a.encode_text(joined, quick)), (self.b, self.b.encode_text(joined))):
            ids_at = np.array(ids, np.int64)
            upto = np.cumsum(v.lengths[ids_at])
            last = np.searchsorted(upto, ends)
            if b"".join(map(v.tokens.__getitem__, ids)) != whole or not np.array_equal(upto[last], ends):
                return False
            flat.append(ids_at)
            count.append(np.diff(last, prepend=-1))
        self.words.update(zip(words, self.windows.add(flat, count), strict=True))
        return True

    def learn_words(self, words: list[str]) -> None:
        """Learn words of any kind, each of them encoded alone."""
        cuts = [self.cut(word, a, b) for word, a, b in zip(words, self.a.encode(words), self.b.encode(words), strict=True)]
        numbers = iter(self.windows.number([w for c in cuts if c for w in c]))
        for word, c in zip(words, cuts, strict=True):
            if c and len(c) > 1:
                self.words[word] = -2 - len(self.several)
                self.several.append(tuple([next(numbers) for _ in c]))
            else:
                self.words[word] = next(numbers) if c else -1

    def cut(self, word: str, a: list[int], b: list[int]) -> list[tuple[tuple[int, ...], tuple[int, ...]]] | None:
        """Windows of a space and the word: cut at the anchors, ends of both token sequences before tokens that both begin with a space. None if
        the tokens do not give back the bytes."""
        whole = b" " + word.encode()
        of_a, of_b = self.a.tokens, self.b.tokens
        if b"".join([of_a[i] for i in a]) != whole or b"".join([of_b[i] for i in b]) != whole:
            return None
        if b" " not in whole[1:]:  # no other token begins with a space
            return [(tuple(a), tuple(b))]
        marked = []
        for v, ids in ((self.a, a), (self.b, b)):
            ends = accumulate(len(v.tokens[i]) for i in ids)
            marked.append({end: k for k, end in enumerate(ends, 1) if k < len(ids) and v.spaced[ids[k]]})
        anchors = [(k, marked[1][end]) for end, k in marked[0].items() if end in marked[1]]
        cuts = [(0, 0), *anchors, (len(a), len(b))]
        return [(tuple(a[s:e]), tuple(b[u:v])) for (s, u), (e, v) in pairwise(cuts)]

    def document(self, parts: Iterator[list[str]]) -> tuple[str, array] | None:
        """Digest of the groups and numbers of the windows of a text, given as the words of its parts."""
        digest, windows = hashlib.sha256(), array("I")
        for k, words in enumerate(parts):
            found = list(map(self.words.__getitem__, words))
            if min(found) < 0:
                if -1 in found:
                    return None
                found = list(chain.from_iterable([self.several[-2 - w] if w < 0 else (w,) for w in found]))
            digest.update(((";" if k else "") + ";".join(map(self.windows.groups.__getitem__, found))).encode())
            windows.extend(found)
        return digest.hexdigest(), windows


_ROWS = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, x binary, y binary, pair long, no long, n long"
_KINDS = (pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 3)
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
DOC, DICTIONARY, PAIR = 0, 1, 2


def _columns(rows: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(rows, k) for c, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


class Block:
    """Documents whose links are counted together."""

    def __init__(self, number: int):
        self.number, self.bytes, self.rows = number, 0, []

    def add(self, doc_id, size: int, found: tuple[str, array] | None) -> None:
        self.bytes += size
        windows, times = np.unique(np.frombuffer(found[1], np.uint32) if found else np.empty(0, np.uint32), return_counts=True)
        self.rows.append((doc_id, found[0] if found else "", windows, times))

    def close(self, known: Windows) -> Iterator[pa.RecordBatch]:
        """Rows of the documents (x: their windows by number in the block, y: how often), of the pairs of each window (x: where they begin,
        y: their numbers in the block), and of the block's pairs."""
        every = np.unique(np.concatenate([w for _, _, w, _ in self.rows])).astype(np.int64)
        begins = np.array(known.starts, np.int64)
        n_links = begins[every + 1] - begins[every]
        sizes = [np.array(x, np.int64)[every] for x in known.sizes]
        starts = np.concatenate(([0], np.cumsum(n_links))).astype(np.int64)
        flat = np.array(known.links, np.int64)[np.repeat(begins[every] - starts[:-1], n_links) + np.arange(starts[-1])]
        pairs, numbers = np.unique(flat, return_inverse=True)
        times_of = np.zeros(len(every), np.int64)
        for at in range(0, len(self.rows), 1000):
            part, docs = self.rows[at : at + 1000], []
            for doc_id, digest, windows, times in part:
                w = np.searchsorted(every, windows)
                times_of[w] += times
                n_groups = int(((starts[w + 1] - starts[w]) * times).sum())
                n_a, n_b = (int((x[w] * times).sum()) for x in sizes)
                docs.append((doc_id, n_a, n_b, n_groups, digest, w.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()))
            cols = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "x", "y"), map(list, zip(*docs, strict=True)), strict=True))
            yield _columns(len(part), kind=[DOC] * len(part), block=[self.number] * len(part), **cols)
        yield _columns(1, kind=[DICTIONARY], block=[self.number], x=[starts.astype(np.uint32).tobytes()], y=[numbers.astype(np.uint32).tobytes()])
        n = np.bincount(numbers, np.repeat(times_of, np.diff(starts)), len(pairs)).astype(np.int64)
        for at in range(0, len(pairs), 50_000):
            p = pairs[at : at + 50_000]
            yield _columns(len(p), kind=np.full(len(p), PAIR, np.int32), block=np.full(len(p), self.number), pair=p, no=np.arange(at, at + len(p)), n=n[at : at + len(p)])


_loaded: dict[bytes, Aligner] = {}


def _aligner(a: bytes, b: bytes) -> Aligner:
    """The vocabularies as this worker process holds them: loaded once, not once a task."""
    key = hashlib.sha256(a + b).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(a, b)
    return _loaded[key]


def _align(a: bytes, b: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                ids, raws = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
                texts = []
                for raw in raws:
                    try:
                        texts.append((raw or b"").decode())
                    except UnicodeDecodeError:
                        texts.append("")
                short = [bool(t) and len(t) <= PART for t in texts]
                known = iter(aligner.learn([t for t, ok in zip(texts, short, strict=True) if ok]))
                for i, raw, t, ok in zip(ids, raws, texts, short, strict=True):
                    words = iter([next(known)]) if ok else (aligner.learn([x])[0] for x in aligner.parts(t))
                    block.add(i, len(raw or b""), aligner.document(words) if t else None)
                if block.bytes >= BLOCK_BYTES or len(block.rows) >= BLOCK_ROWS or aligner.full:
                    yield from block.close(aligner.windows)
                    number += 1
                    block = Block(number)
                    if aligner.full:
                        aligner.forget()
        if block.rows:
            yield from block.close(aligner.windows)

    return run


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with n_best and count_sum, from the counts of its pairs."""
    kind = left.column("kind").to_numpy()
    x, y = left.column("x").to_pylist(), left.column("y").to_pylist()
    where = int(np.flatnonzero(kind == DICTIONARY)[0])
    starts, numbers = np.frombuffer(x[where], np.uint32).astype(np.int64), np.frombuffer(y[where], np.uint32)
    count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    no = right.column("no").to_numpy()
    count[no], best[no] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    sums = [np.diff(np.concatenate(([0], np.cumsum(v[numbers])))[starts]) for v in (count, best)]
    docs = np.flatnonzero(kind == DOC)
    out: list[list[int]] = [[], []]
    for k in docs:
        w, times = np.frombuffer(x[k], np.uint32), np.frombuffer(y[k], np.uint32).astype(np.int64)
        for o, s in zip(out, sums, strict=True):
            o.append(int((s[w] * times).sum()))
    kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]).take(pa.array(docs))
    return kept.append_column("count_sum", pa.array(out[0], pa.int64())).append_column("n_best", pa.array(out[1], pa.int64()))


def align(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and id pairs (a, b, count, best): one row a row
    of ``docs``, and one row a pair that is linked anywhere. The files of the vocabularies are read by the driver."""
    a, b = Path(byte_vocabulary).read_bytes(), Path(piece_vocabulary).read_bytes()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = materialize(rows.mapInArrow(_align(a, b), _ROWS), "alignments")
    local = found.filter(F.col("kind") == PAIR).select("block", "pair", "no", "n")
    total = local.groupBy("pair").agg(F.sum("n").alias("total"))
    # one row a pair from here on: the pairs of an id are bounded by the other vocabulary
    highest = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))
    total = materialize(total.withColumn("best", F.col("total") == F.max("total").over(highest)), "pair-counts")
    back = local.select("block", "pair", "no").join(total, "pair").select(F.col("block").alias("of"), "no", "total", "best")
    left = found.filter(F.col("kind") != PAIR).select("kind", "block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "x", "y")
    out = left.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_score, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, count_sum long, n_best long")
    # tokens are never empty, so a shared end is one link
    out = out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
    pairs = total.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), F.col("total").alias("count"), "best")
    return out, pairs


def groups(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, groups: the alignment itself, as arrays of the ids of both vocabularies, one struct a group."""
    a, b = Path(byte_vocabulary).read_bytes(), Path(piece_vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for whole in batches:
            for at in range(0, whole.num_rows, 20):
                batch, out = whole.slice(at, 20), []
                for raw in batch.column("text").cast(pa.binary()).to_pylist():
                    found = []
                    try:
                        done = aligner.document(aligner.learn([x])[0] for x in aligner.parts(raw.decode())) if raw else None
                        for w in done[1] if done else ():
                            for g in aligner.windows.groups[w].split(";"):
                                x, y = g.split("|")
                                found.append({"a": [int(i) for i in x.split(",")], "b": [int(i) for i in y.split(",")]})
                    except UnicodeDecodeError:
                        found = []
                    out.append(found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "groups"])
                if aligner.full:
                    aligner.forget()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")
