"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix at unit borders and reordered.

One full match of ``(unit)*`` by the regex library keeps every repetition of its group, so that ``match.ends(1)`` gives the number of units
and both cut offsets without a loop. Cuts, form and order are drawn from a digest of seed and doc_id, so reruns agree.

Definitions that hold for every row: offsets and counts are in code points; a null text is an empty one; empty texts, texts that hold a
sentinel, and those that the rate leaves out are ``plain``: output equals text, prefix and middle lengths are null; bytes that are no UTF-8 count one
code point each and come back as they were; a null doc_id is drawn as the digest of the seed alone; repeated rows give equal rows; very
long texts need memory in proportion to their own length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.text import small

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE = r"[^\n]*\n|[^\n]+"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits each of a document."""
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    digest = hashlib.sha256(key).digest()
    return [int.from_bytes(digest[at : at + 4]) for at in range(0, 16, 4)]


def cut(text: str, pattern: regex.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """Number of units of the text, and the ends of its prefix and of its middle."""
    ends = pattern.fullmatch(text).ends(1)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: one row a row of ``docs``.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of these with the suffix first; ``unit`` is one group-free pattern whose
    repetitions cover any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(f"({unit})*")
        for batch in small(batches, 200):
            rows = []
            for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                t = (raw or b"").decode("utf-8", "surrogateescape")
                h1, h2, h3, h4 = draws(seed, i)
                n, a, b = cut(t, pattern, h1, h2)
                if not t or h3 % 100 >= rate or any(s in t for s in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((n, "plain", None, None, raw or b""))
                    continue
                if h4 % 100 < spm:
                    form, out = "spm", SUFFIX + t[b:] + PREFIX + t[:a] + MIDDLE + t[a:b]
                else:
                    form, out = "psm", PREFIX + t[:a] + SUFFIX + t[b:] + MIDDLE + t[a:b]
                rows.append((n, form, a, b - a, out.encode("utf-8", "surrogateescape")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(transformed: DataFrame) -> DataFrame:
    """``transformed`` (form, output) with ``restored``, the text before the transformation, found by the sentinels alone."""
    p, s, m = (F.locate(x, F.col("output")) for x in (PREFIX, SUFFIX, MIDDLE))
    width = len(MIDDLE)
    part = lambda start, end: F.substring(F.col("output"), start + width, end - start - width)
    middle = F.substring(F.col("output"), m + width, F.length("output"))
    text = F.when(F.col("form") == "psm", F.concat(part(p, s), middle, part(s, m))).when(F.col("form") == "spm", F.concat(part(p, m), middle, part(s, p)))
    return transformed.withColumn("restored", text.otherwise(F.col("output")))
