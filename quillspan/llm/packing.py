"""Packing into optimal length buckets.

A dynamic program over the global histogram of sequence lengths chooses the bucket boundaries that minimise padding;
inside each bucket sequences form batches under a token budget.

1. Documents longer than ``max_len`` are cut into consecutive pieces of ``max_len`` tokens and a rest, so no token is
   lost; the histogram therefore has ``max_len`` rows at most, whatever the corpus, and may go to the driver.
2. ``optimal_boundaries`` solves ``cost[k][j] = min_i cost[k-1][i] + padding(i, j)`` exactly.
3. Every bucket is dealt into shards of a bounded number of sequences by a hash of the row (of its number among equal rows, too,
   so that a null or repeated id is dealt like any other), and a batch is
   ``max(1, budget div boundary)`` neighbours of a shard in length order. Windows run inside a shard only, so a
   bucket with most of the corpus is spread over the cluster; only the last batch of a shard may be short.

Definitions that hold for every row: a null or empty text has no tokens and gives one row with piece 0, length 0 and
no bucket or batch; repeated rows are packed each; ties in length break by document and piece; a null ``doc_id`` is a
document like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.text import spread, word_count
from quillspan.plans.scratch import materialize

SHARD = 2_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise ``sum(counts * (bound - length))``, ascending.

    A best bound is always an occurring length. ``padding(i, j)`` of putting lengths i+1..j under bound j comes from
    prefix sums, so that each layer of the program is one vector minimum a length.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(x)
    if not m:
        return []
    n = np.concatenate(([0], np.cumsum(c)))
    tokens = np.concatenate(([0], np.cumsum(c * x)))
    best = x * n[1:] - tokens[1:]  # one bucket over the first j lengths
    choice = [np.zeros(m, np.int64)]
    for _ in range(1, min(buckets, m)):
        new, cut = best.copy(), np.zeros(m, np.int64)
        for j in range(1, m):
            total = best[:j] + x[j] * (n[j + 1] - n[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(total.argmin())
            if total[i] < new[j]:
                new[j], cut[j] = total[i], i + 1
        best, choice = new, [*choice, cut]
    bounds, j = [], m - 1
    for cut in reversed(choice):
        bounds.append(int(x[j]))
        if cut[j] == 0:
            break
        j = int(cut[j]) - 1
    return bounds[::-1]


def pieces(docs: DataFrame, max_len: int, tokens: Column, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length: whole documents as pieces of ``max_len`` tokens at most."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("n_tokens"))
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n_tokens") / max_len).cast("long") - 1)
    return sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * max_len).alias("start"),
        F.least(F.lit(max_len), F.col("n_tokens") - F.col("piece") * max_len).cast("long").alias("length"),
    )


def pack(
    docs: DataFrame,
    buckets: int = 8,
    max_len: int = 4096,
    budget: int = 32_768,
    tokens: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, bucket_len, batch_id, slot: one row a piece."""
    cut = pieces(docs, max_len, word_count(F.col(text)) if tokens is None else tokens, doc_id)
    # rows that agree in all of their result are counted, and told apart by a number that deals them to shards
    rows = materialize(spread(cut.groupBy("doc_id", "piece", "start", "length").agg(F.count(F.lit(1)).alias("n"))), "pieces")
    hist = rows.filter("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # max_len rows at most
    bounds = optimal_boundaries(np.array([r["length"] for r in hist], np.int64), np.array([r["n"] for r in hist], np.int64), buckets)
    if not bounds:
        return rows.drop("nth").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket_len", "long"), ("batch_id", "string"), ("slot", "long"))])
    held = [sum(r["n"] for r in hist if low < r["length"] <= high) for low, high in zip([0, *bounds], bounds, strict=False)]
    bucket, shards = F.lit(None).cast("long"), F.lit(1)
    for bound, n in reversed(list(zip(bounds, held, strict=True))):
        bucket = F.when(F.col("length") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
        shards = F.when(F.col("length") <= bound, F.lit(-(-n // SHARD) or 1)).otherwise(shards)
    # rows without tokens take no part in the windows: they are spread by the same hash, in a bucket of their own
    placed = rows.withColumns(
        {
            "bucket_len": F.when(F.col("length") > 0, bucket),
            "shard": F.pmod(F.xxhash64("doc_id", "piece", "length", "nth", F.lit(29)), F.when(F.col("length") > 0, shards).otherwise(F.lit(1 << 20))),
        }
    )
    w = Window.partitionBy("bucket_len", "shard").orderBy("length", "doc_id", "piece", "nth")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")).cast("long"))
    at = (F.row_number().over(w) - 1).cast("long")
    numbered = placed.withColumns({"at": at, "room": room})
    batch = F.concat_ws("-", "bucket_len", "shard", F.floor(F.col("at") / F.col("room")).cast("long"))
    return numbered.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "bucket_len",
        F.when(F.col("bucket_len").isNotNull(), batch).alias("batch_id"),
        F.when(F.col("bucket_len").isNotNull(), F.col("at") % F.col("room")).alias("slot"),
    )
