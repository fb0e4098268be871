"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant and all others
as named users; loss masks cover the assistant's own words. One output row is one *piece* of one rendering: ``part`` counts
``turns_per_part`` turn numbers, and a part that holds more than ``rows_per_piece`` rows, such as that of a hot null conversation
or of a turn number that is repeated without end, is cut into pieces of that many rows. So no task renders more
than a bounded number of rows at once; the rendering of a conversation is its pieces in the order of part and piece. The rows of
such parts are numbered by range partitions and offsets, equal rows by their place in the input; all other parts are piece 0.

Definitions that hold for every row:

* participants are the distinct speakers other than ``narrators`` (default ``system``); narrator turns are rendered
  as system messages in every perspective;
* a null text is rendered as an empty message; a null speaker is the participant named ``unknown``;
* rows with a null conversation id form one conversation; a null turn counts as turn -1, before all others;
* repeated (conversation, turn) rows all stay, ordered by speaker and text; equal rows too;
* texts of any length are rendered whole;
* a conversation with narrator turns only has no participant and gives no row; an empty table gives no rows;
* extra columns are ignored; speaker names are cleaned to ``[A-Za-z0-9_-]`` for the ``name`` tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.governance import numbered
from quillspan.plans.scratch import materialize


def rotate(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    narrators: tuple[str, ...] = ("system",),
    turns_per_part: int = 256,
    rows_per_piece: int = 4096,
) -> DataFrame:
    """conv, perspective, part, piece, n_turns, n_assistant, rendered, mask (array of half-open code point spans).

    Turns are dealt by (conversation, part) and rendered once for each participant; the participants of a
    conversation come from a pre-aggregated distinct, joined back on the conversation.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("part", F.floor(F.col("turn") / turns_per_part).cast("long"))
    is_narrator = F.col("speaker").isin(*narrators)
    cast = rows.filter(~is_narrator).select(F.col("conv").alias("cast_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = _in_pieces(rows, rows_per_piece)
    parts = rows.groupBy("conv", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    both = parts.join(cast, F.col("conv").eqNullSafe(F.col("cast_conv")))

    def head(t):
        name = F.regexp_replace(t["speaker"], "[^A-Za-z0-9_-]", "_")
        return (
            F.when(t["speaker"].isin(*narrators), F.lit("<|system|>\n"))
            .when(t["speaker"] == F.col("perspective"), F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
        )

    tail = "<|end|>\n"
    pieces = both.withColumn(
        "pieces",
        F.transform(
            "turns",
            lambda t: F.struct(
                head(t).alias("head"),
                t["text"].alias("text"),
                (t["speaker"] == F.col("perspective")).alias("own"),
            ),
        ),
    )
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["text"]) + len(tail)).alias("at"),
            F.when(
                p["own"],
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(p["head"])).alias("start"),
                            (a["at"] + F.length(p["head"]) + F.length(p["text"]) + len(tail) - 1).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return pieces.select(
        F.col("conv").alias(conv),
        "perspective",
        "part",
        "piece",
        F.size("pieces").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).alias("n_assistant"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(tail))), "").alias("rendered"),
        spans.alias("mask"),
    )


def _in_pieces(rows: DataFrame, rows_per_piece: int) -> DataFrame:
    """``rows`` (conv, part, turn, speaker, text) with the piece of each: its position in its part, in parts of ``rows_per_piece``."""
    sizes = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_piece)
    large = materialize(sizes.select(F.col("conv").alias("large_conv"), F.col("part").alias("large_part")), "large-parts")
    if large.isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long"))
    same = F.col("conv").eqNullSafe(F.col("large_conv")) & (F.col("part") == F.col("large_part"))
    # the place in the input tells equal rows apart, so that ranges can split them; written, so that it stays what it is
    held = materialize(rows.join(large, same).select(*rows.columns, F.monotonically_increasing_id().alias("place")), "large-rows")
    at = numbered(held, ["conv", "part", "turn", "speaker", "text", "place"], "at")
    first = at.groupBy("conv", "part").agg(F.min("at").alias("first")).select(F.col("conv").alias("large_conv"), F.col("part").alias("large_part"), "first")
    pieces = at.join(first, same).withColumn("piece", F.floor((F.col("at") - F.col("first")) / rows_per_piece).cast("long"))
    return rows.join(large, same, "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(pieces.select(*rows.columns, "piece"))
