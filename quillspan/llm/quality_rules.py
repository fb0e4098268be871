"""Quality rules: one threshold table compiled into one native projection.

Definitions that hold for every row:

* a null text is an empty text: all counts are 0 and the base rule rejects it;
* repeated rows and repeated ``doc_id`` are judged each on its own; a null ``doc_id`` passes through;
* extra columns pass through; an input column with the name of a metric is replaced by the metric;
* texts of any length are measured whole: every step is linear or ``n log n`` in the words of one text and needs
  the memory of that one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.text import let, words

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by this from are or an at "
    "der die das und ist von zu mit den ein eine nicht auf im für sich des dem als auch "
    "le la les et est de des un une que qui dans pour sur du par en au avec pas "
    "el los las y es del una por con para no se lo su al"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least <= metric <= most``; a null bound is open."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are of all words unless the name says otherwise.
RULES = (
    Rule("length", "n_words", least=50, most=1_000_000),
    Rule("word_length", "mean_word_length", least=2.0, most=15.0),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("stop_words", "stop_word_ratio", least=0.03),
    Rule("repeated_lines", "dup_line_ratio", most=0.30),
    Rule("repeated_windows", "repeat_word_ratio", most=0.50),
    Rule("capitals", "capital_ratio", most=0.40),
    Rule("exclamation", "exclamation_ratio", most=0.10),
)


def repeat_words(ws: Column) -> Column:
    """Number of words that lie in a 3-word window which the text holds twice or more (the first included).

    The windows are sorted by content, equal neighbours give the start positions of repeated windows, and the union
    of ``[p, p + 2]`` over the sorted positions is counted: ``n log n``, no pairs.
    """
    windows = let(
        ws,
        lambda w: F.when(
            F.size(w) >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(1), F.size(w) - 2),
                    lambda i: F.struct(
                        F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("g"),
                        i.alias("p"),
                    ),
                )
            ),
        ),
    )
    starts = let(
        windows,
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))),
                lambda x: x["p"],
            )
        ),
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-2).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.coalesce(covered, F.lit(0).cast("long"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts and ratios that rules refer to."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals", "n_exclamation")
    base = docs.drop(*own, "__words", "__lines") if set(docs.columns) & {*own, "__words", "__lines"} else docs
    body = F.coalesce(F.col(text), F.lit(""))
    split = base.withColumns(
        {
            "__words": words(F.col(text)),
            "__lines": F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        }
    )
    w, lines = F.col("__words"), F.col("__lines")
    counts = split.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeat_words(w),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            "n_capitals": F.regexp_count(body, F.lit("\\p{Lu}")).cast("long"),
            "n_exclamation": F.regexp_count(body, F.lit("!")).cast("long"),
        }
    ).drop("__words", "__lines")
    n = F.col("n_words")
    return counts.withColumns(
        {
            "mean_word_length": _ratio(F.col("word_chars"), n),
            "symbol_ratio": _ratio(F.col("n_symbols"), n),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), n),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_word_ratio": _ratio(F.col("n_repeat_words"), n),
            "capital_ratio": _ratio(F.col("n_capitals"), F.col("word_chars")),
            "exclamation_ratio": _ratio(F.col("n_exclamation"), n),
        }
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column for each rule: true where the document breaks it."""
    out = {}
    for r in rules:
        m, broken = F.col(r.metric), F.lit(False)
        if r.least is not None:
            broken = broken | (m < r.least)
        if r.most is not None:
            broken = broken | (m > r.most)
        out[f"fails_{r.name}"] = broken
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with metrics, one ``fails_*`` column a rule, ``base_failed`` and ``kept``."""
    flags = compile_rules(rules)
    judged = measure(docs, text).withColumns(flags)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.lit(False)
    for name in flags:
        broken = broken | F.col(name)
    return judged.withColumns({"base_failed": base, "kept": ~(base | broken)})
