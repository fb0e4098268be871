"""Repeated passages, fill-in-the-middle and tokenizer alignment against brute force; nulls, ties, long texts, empty tables."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import DATA

from quillspan.llm import fill_middle, passage_dedup, queries, token_align

DOCS = "doc_id long, text string"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# 11 repeated passages


def passages_by_hand(rows, length=50):
    """doc_id, bytes, spans, kept: from a dictionary of all strings."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - length + 1) if i is not None else ():
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1) if i is not None else ():
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        edges = [k for k in range(len(b) + 1) if (gone[k] if k < len(b) else 0) != (gone[k - 1] if k else 0)]
        out.append((i, len(b), tuple(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def passages(df, **more):
    out = passage_dedup.remove_repeats(df, **more).collect()
    return sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in out), key=repr)


def made_up(rng, n):
    return "".join(rng.choice("abcdefgh é\n") for _ in range(n))


def test_passages_of_small_texts_equal_brute_force(spark):
    rng = random.Random(5)
    shared = [made_up(rng, n) for n in (24, 48, 49, 50, 51, 75, 90, 400)]
    rows = [(i % 50, "".join(rng.choice(shared) if rng.random() < 0.5 else made_up(rng, rng.randint(0, 60)) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    edited = made_up(rng, 600)
    rows += [(100 + i, edited[: i * 13] + "X" + edited[i * 13 + 1 :]) for i in range(40)]
    rows += [(200, "a" * 300), (201, "a" * 120), (202, "ab" * 100), (199, "a" * 49), (203, None), (204, ""), (None, "a" * 300), (None, None), (205, "a" * 300), (205, "a" * 300)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], DOCS + ", spans string").repartition(5)
    for length in (50, 21, 90):
        assert passages(df, length=length) == sorted(passages_by_hand(rows, length), key=repr)
    assert passages(df.limit(0)) == []


def test_passages_of_texts_in_pieces(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghij klmnop") for _ in range(passage_dedup.PIECE * 2 + 1000))
    at = passage_dedup.PIECE
    other = [(1, long[at - 60 : at + 70]), (2, long[2 * at - 10 : 2 * at + 300]), (3, long[-55:]), (5, long), (6, "x" + long[at - 49 : at + 49] + "y")]
    rows = [(4, long), *other]
    got = {r[0]: r for r in passages(spark.createDataFrame(rows, DOCS))}
    want = {r[0]: r for r in passages_by_hand(rows)}
    assert got == want and want[5][3] == b"" and len(want[4][2]) == 3


def test_a_passage_of_most_documents_stays_once(spark):
    rng = random.Random(7)
    passage = made_up(rng, 200)
    rows = [(i, made_up(rng, 80) + passage + made_up(rng, 80)) for i in range(300)]
    assert passages(spark.createDataFrame(rows, DOCS).repartition(9)) == sorted(passages_by_hand(rows), key=repr)


def test_passages_of_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op11_bucket_pointers"](spark, DATA).collect()}
    assert got == {(i, n, sum(e - s for s, e in spans), len(spans), sha(kept)) for i, n, spans, kept in passages_by_hand(rows)}


# 12 fill in the middle


def test_middle_of_odd_rows(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "\n\n\n"), (3, "é\n\U0001f600x\n"), (4, ""), (5, None), (6, "has <S> inside\nx"), (None, "a\nb"), (7, "one line"), (8, "x\n" * 50_000), (9, "<P"), (10, "a\r\nb c\n")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], DOCS + ", output string")
    out = fill_middle.restore(fill_middle.transform(df)).collect()
    assert sorted((r["doc_id"], r["restored"]) for r in out if r["doc_id"]) == sorted((i, t or "") for i, t in rows if i)
    for r in out:
        text = dict(rows)[r["doc_id"]] or ""
        lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if not text.endswith("\n") and text else [])
        assert r["n"] == len(lines)
        if text == "" or "<S>" in text:
            assert (r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == ("plain", None, None, text)
            continue
        h = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
        p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
        assert (r["prefix_chars"], r["middle_chars"]) == (len(p), len(m))
        assert (r["form"], r["output"]) == (("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}"))
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_middle_rates_and_units(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    forms = collections.Counter(r["form"] for r in fill_middle.transform(df, rate=50, spm=20).collect())
    assert 150 < forms["plain"] < 250 and 20 < forms["spm"] < 70 < forms["psm"]
    by_word = fill_middle.restore(fill_middle.transform(df, unit=r"\S+\s*|\s+")).collect()
    assert {r["n"] for r in by_word} == {4} and {r["restored"] for r in by_word} == {"one two three four"}


# 13 tokenizer alignment


def alignment_by_hand(rows):
    """The contract's columns from whole-text encodings and dictionaries of ends."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(token_align.BYTE_VOCABULARY), SentencePieceProcessor(model_file=token_align.PIECE_VOCABULARY)
    first.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    count, docs = collections.Counter(), []
    for i, t in rows:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        bytes_a = [bytes(chars[c] for c in first.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + t.encode():
            docs.append((i, [], [], [], ""))
            continue
        ends = []
        for tokens in (bytes_a, bytes_b):
            at, where = 0, {}
            for k, x in enumerate(tokens):
                at += len(x)
                where[at] = k
            ends.append(where)
        links, groups, x, y = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0][e], ends[1][e]
            links.append((a[k], b[m]))
            groups.append(",".join(map(str, a[x : k + 1])) + "|" + ",".join(map(str, b[y : m + 1])))
            x, y = k + 1, m + 1
        count.update(links)
        docs.append((i, a, b, links, sha(";".join(groups).encode())))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(i, len(a), len(b), len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), h) for i, a, b, links, h in docs]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_odd_texts(spark):
    rng = random.Random(8)
    odd = ["▁ x", "a  b   c", " lead", "trail ", "\n\n a\t b", "<|endoftext|> and </s><s> <0x41>", "café naïve \U0001f600\U0001f468‍\U0001f469", "é", "  x 　 y", "\x00 nul", "'s don't 's", "1 2 33 444", "᠎ b \x1c c", "ﬁ ① Ａ", "a\r\nb", "中文 文", "x" * 5000, "क्ष ड"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(100, None), (101, ""), (None, "a b"), (0, odd[0]), (7, "again"), (7, "again")]
    rows += [(200 + k, "".join(rng.choice(["a", "B ", " ", "\n", "'", "9", ".", "é", "the ", " of", " "]) for _ in range(200))) for k in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS + ", n_a int").repartition(4)
    got, pairs = token_align.align(df)
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=key) == sorted(alignment_by_hand(rows), key=key)
    assert pairs.agg(F.sum("count")).first()[0] == sum(r[4] for r in alignment_by_hand(rows))
    empty, none = token_align.align(df.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_alignment_of_a_long_text_in_parts(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdeou") for _ in range(rng.randint(1, 9))) for _ in range(600_000))
    assert len(text) > 2 * token_align.PART
    rows = [(1, text), (2, "some words")]
    got = token_align.align(spark.createDataFrame(rows, DOCS))[0].select(COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == sorted(alignment_by_hand(rows))


def test_alignment_of_the_smallest_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_token_anchors"](spark, DATA).select(COLUMNS).collect())
    want = sorted(alignment_by_hand(rows))
    assert got == want and sum(r[1] for r in want) > 0
    groups = {r["doc_id"]: r["groups"] for r in token_align.groups(docs).collect()}
    for i, n_a, n_b, n_groups, *_, digest in want:
        assert (sum(len(g["a"]) for g in groups[i]), sum(len(g["b"]) for g in groups[i]), len(groups[i])) == (n_a, n_b, n_groups)
        text = ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in groups[i])
        assert (sha(text.encode()) if n_groups else "") == digest


@pytest.mark.parametrize("first", ["a", "é", "\n", "中", "᠎", "​", "\x85", "'", "7"])
def test_words_are_encoded_as_in_the_whole_text(first):
    """Cutting at single spaces gives the tokens of the whole text, whatever stands beside the space."""
    a, b = token_align.ByteVocabulary(open(token_align.BYTE_VOCABULARY, "rb").read()), token_align.PieceVocabulary(open(token_align.PIECE_VOCABULARY, "rb").read())
    assert a.words and b.words
    texts = [f"x{first} {c}y{c} {first}{c}z" for c in map(chr, [*range(0x20, 0x180), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0xFB01, 0x1F600])]
    for text in texts:
        words = token_align.GAP.split(text)
        for v in (a, b):
            assert [i for ids in v.encode(words) for i in ids] == v.encode([text])[0]


def test_new_words_are_encoded_in_rows():
    """New words go to both encoders many at once; the tokens are those of each word alone, also beside words whose bytes are not given back."""
    rng = random.Random(10)
    aligner = token_align.Aligner(open(token_align.BYTE_VOCABULARY, "rb").read(), open(token_align.PIECE_VOCABULARY, "rb").read())
    odd = ["▁", "x▁y", "　", "a　b", "ﬁ①", "\x00", "᠎b", "\x85", "é\nb", "a  b", "​", "'s", "<|endoftext|>", "中文", "x" * 300, "a\n b"]
    words = sorted({"".join(rng.choice("abcdefgé'.9中") for _ in range(rng.randint(1, 12))) for _ in range(6000)})
    calls = collections.Counter()

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            calls[name] += name.startswith("encode")
            return getattr(self.inner, name)

    aligner.a.tokenizer, aligner.a.ranked, aligner.b.processor = Counted(aligner.a.tokenizer), Counted(aligner.a.ranked), Counted(aligner.b.processor)
    aligner.learn([" ".join(words)])
    assert 0 < sum(calls.values()) < len(words) / 50
    mixed = words[:3000] + [f"{w}{x}" for w in words[:40] for x in odd]
    rng.shuffle(mixed)
    aligner.forget()
    aligner.learn([" ".join(mixed)])
    for text in [" ".join(mixed), *odd, *mixed]:
        for word in aligner.learn([text])[0]:
            ids = [list(aligner.a.encode([word])[0]), list(aligner.b.encode([word])[0])]
            n = aligner.words[word]
            if any(b"".join(v.tokens[i] for i in x) != b" " + word.encode() for v, x in zip((aligner.a, aligner.b), ids, strict=True)):
                assert n == -1
                continue
            found = [g.split("|") for w in ([n] if n >= 0 else aligner.several[-2 - n]) for g in aligner.windows.groups[w].split(";")]
            assert [[int(i) for g in found for i in g[side].split(",")] for side in (0, 1)] == ids
