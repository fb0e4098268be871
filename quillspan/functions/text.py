"""Text columns: case folding, retrieval tokens, word error rates."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


CJK = re.compile("[\u3400-\u9fff]")
RUNS = re.compile("[a-z0-9]+|[\u3400-\u9fff]+")
LATIN = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))


def casefold(x: Column) -> Column:
    """Lower case with the German sharp s as ss."""
    return F.regexp_replace(F.lower(x), "ß", "ss")


def squeeze(x: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def tokens(x: Column) -> Column:
    """Latin words ``[a-z0-9]+``; of a run of CJK characters each character, then each pair of neighbours."""
    runs = F.regexp_extract_all(casefold(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+|[\\x{3400}-\\x{9fff}]+"), 0)

    def units(t: Column) -> Column:
        n = F.length(t)
        one = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(1)))
        two = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(t.rlike("^[a-z0-9]"), F.array(t)).otherwise(F.concat(one, two))

    # a function over the elements of an array is interpreted, and a match costs more than a cut: only texts that need them pay for them
    latin = F.array_remove(F.split(casefold(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), "")
    return F.when(F.coalesce(x, F.lit("")).rlike("[\\x{3400}-\\x{9fff}]"), F.flatten(F.transform(runs, units))).otherwise(latin)


def tokens_of(text: str) -> list[str]:
    """As ``tokens``, of one text."""
    text = text.lower().replace("ß", "ss")
    if text.isascii() or not CJK.search(text):
        return text.encode("ascii", "replace").translate(LATIN).decode().split()
    return [x for t in RUNS.findall(text) for x in ([*t, *map("".join, zip(t, t[1:], strict=False))] if CJK.match(t) else [t])]


def words(x: Column) -> Column:
    """Case-folded alphanumeric words, for word error rates."""
    return F.regexp_extract_all(casefold(F.coalesce(x, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), 0)


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance between two strings or lists of words: a column of the table is one long integer, so a step costs a few operations
    on the bits of the longer side (Myers 1999, Hyyrö 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0  # where a cell is one more, or one less, than the cell before it
    for x in b:
        equal = at.get(x, 0)
        across = ((((equal & up) + up) ^ up) | equal) & full
        more = down | (full ^ (across | up))
        less = up & across
        score += 1 if more & last else -1 if less & last else 0
        more = (more << 1 | 1) & full
        over = equal | down
        up = (less << 1 & full) | (full ^ (over | more))
        down = more & over
    return score


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance between two strings, or two arrays, as ``distance``: Spark's own compares each pair of characters."""
    return F.pandas_udf(_distances, "int")(a, b)


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance between two arrays of words."""
    return edit_distance(a, b)


def _code(i: Column) -> Column:
    """A single character for a number from 1 to about a million: the code points from U+10000 on."""
    return F.decode(F.unhex(F.lpad(F.hex(i + 0xFFFF), 8, "0")), "UTF-32")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    r, h = words(reference), words(hypothesis)
    return word_distance(r, h) / F.greatest(F.size(r), F.lit(1))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    r, h = F.array_join(words(reference), ""), F.array_join(words(hypothesis), "")
    return edit_distance(r, h) / F.greatest(F.length(r), F.lit(1))
