"""Exact dense and visual search among the scenes that a query's own filters permit (R4, R5 with P1).

Vectors are sorted by video and time and packed into blocks, so that a block is a zone: it knows its least and greatest video, its first and
last moment, and the evidence types in it. Queries are packed by the filters that they use. A pair of blocks is multiplied only if the zones can
meet; inside the product, scenes that a query does not permit are masked before its k best are cut. So every query gets k rows
wherever k scenes are eligible, and blocks that no query can use are never read by a product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.retrieval import best_frames, ranked, small
from quillspan.plans.scratch import materialize

ITEM = ["video_id", "scene_id", "item", "start_ms", "end_ms", "evidence_types"]
FILTER = ["query_id", "video_id", "start_ms", "end_ms", "required_evidence_types"]


def _pack(rows: DataFrame, columns: list[str], prefix: str, block: int, order: list[Column]) -> DataFrame:
    """One row a block of ``block`` rows or fewer, neighbours in ``order``: columns as arrays, unit vectors as bytes. Rows that differ in
    ``kind`` never share a block."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, block):
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                lists = [pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), pa.concat_arrays([batch.column(c).slice(at, end - at)])) for c in columns]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x[at:end].tobytes()], pa.binary())], [*[prefix + c for c in columns], prefix + "x"])

    schema = ", ".join(f"{prefix}{c} array<{kinds[c]}>" for c in columns) + f", {prefix}x binary"
    sorted_rows = rows.select(*columns, "embedding", "kind").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(sorted_rows.mapInArrow(run, schema), "vector-zones")


def _item_blocks(items: DataFrame, block: int) -> DataFrame:
    out = _pack(items.withColumn("kind", F.lit(0)), ITEM, "v_", block, [F.col("video_id"), F.col("start_ms"), F.col("scene_id"), F.col("item")])
    return out.select(
        *out.columns,
        F.array_min("v_video_id").alias("low_video"),
        F.array_max("v_video_id").alias("high_video"),
        F.array_min("v_start_ms").alias("begins"),
        F.array_max("v_end_ms").alias("ends"),
        F.array_distinct(F.flatten(F.transform("v_evidence_types", lambda t: F.coalesce(t, F.array().cast("array<string>"))))).alias("held"),
    )


def _query_blocks(queries: DataFrame, block: int) -> DataFrame:
    need = F.array_sort(F.coalesce("required_evidence_types", F.array().cast("array<string>")))
    q = queries.withColumn("required_evidence_types", need)
    free, whole = F.col("video_id").isNull(), F.col("start_ms").isNull()
    q = q.withColumn("kind", free.cast("int") * 2 + whole.cast("int"))
    out = _pack(q, FILTER, "q_", block, [F.col("kind"), F.col("video_id"), F.col("start_ms"), F.col("required_evidence_types"), F.col("query_id")])
    first = F.element_at("q_required_evidence_types", 1)
    return out.select(
        *out.columns,
        F.exists("q_video_id", F.isnull).alias("any_video"),
        F.exists("q_start_ms", F.isnull).alias("any_time"),
        F.array_min("q_video_id").alias("low_asked"),
        F.array_max("q_video_id").alias("high_asked"),
        F.array_min("q_start_ms").alias("from_ms"),
        F.array_max("q_end_ms").alias("to_ms"),
        F.aggregate("q_required_evidence_types", first, F.array_intersect).alias("all_need"),
    )


def _zones_meet() -> Column:
    video = F.col("any_video") | ((F.col("low_asked") <= F.col("high_video")) & (F.col("high_asked") >= F.col("low_video")))
    time = F.col("any_time") | ((F.col("from_ms") < F.col("ends")) & (F.col("to_ms") > F.col("begins")))
    return video & time & (F.size(F.array_except("all_need", "held")) == 0)


def _mask(of: dict[str, pa.Array]) -> np.ndarray:
    """Which items (columns) each query (rows) permits."""
    codes: dict = {}
    video = np.array([-2 if v is None else codes.setdefault(v, len(codes)) for v in of["v_video_id"].to_pylist()])
    asked = np.array([-1 if v is None else codes.get(v, -3) for v in of["q_video_id"].to_pylist()])
    out = (asked[:, None] == -1) | (asked[:, None] == video[None])
    start, end, lo, hi = (np.array([np.nan if x is None else x for x in of[c].to_pylist()], np.float64) for c in ("v_start_ms", "v_end_ms", "q_start_ms", "q_end_ms"))
    out &= np.isnan(lo)[:, None] | ((start[None] < hi[:, None]) & (lo[:, None] < end[None]))
    need = [tuple(x) for x in of["q_required_evidence_types"].to_pylist()]
    types = [set(x or ()) for x in of["v_evidence_types"].to_pylist()]
    for wanted in set(need) - {()}:
        rows = np.array([n == wanted for n in need])
        out[rows] &= np.array([types_of.issuperset(wanted) for types_of in types])[None]
    return out


def _least_of_best(s: np.ndarray, k: int) -> np.ndarray:
    at = max(0, s.shape[1] - k)
    return np.partition(s, at, axis=1)[:, at, None]


def _products(items: DataFrame, queries: DataFrame, k: int, block: int, by_scene: bool) -> DataFrame:
    """Scores of permitted pairs, cut in each pair of blocks to the k best items of a query, or with ``by_scene`` to the best items of its k best
    scenes; ties of the k-th best stay, so that the final order settles them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                of = {c: batch.column(c).flatten() for c in batch.schema.names if c[:2] in ("v_", "q_") and not c.endswith("_x")}
                x, y = (np.frombuffer(batch.column(c)[0].as_py(), np.float64).reshape(n, -1) for c, n in (("v_x", len(of["v_item"])), ("q_x", len(of["q_query_id"]))))
                permitted = _mask(of)
                s = np.where(permitted, np.round(y @ x.T, 9), -np.inf)
                if by_scene:
                    scenes: dict = {}
                    code = np.array([scenes.setdefault(w, len(scenes)) for w in zip(of["v_video_id"].to_pylist(), of["v_scene_id"].to_pylist(), strict=True)])
                    order = np.argsort(code, kind="stable")
                    best = np.maximum.reduceat(s[:, order], np.flatnonzero(np.diff(code[order], prepend=-1)), axis=1)
                    picked = permitted & (s == best[:, code]) & (best >= _least_of_best(best, k))[:, code]
                else:
                    picked = permitted & (s >= _least_of_best(s, k))
                i, j = np.nonzero(picked)
                rows = [of[c].take(pa.array(j)) for c in ("v_video_id", "v_scene_id", "v_item")]
                yield pa.RecordBatch.from_arrays([of["q_query_id"].take(pa.array(i)), *rows, pa.array(s[i, j])], ["query_id", "video_id", "scene_id", "item", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in items.schema} | {"query_id": queries.schema["query_id"].dataType.simpleString()}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "video_id", "scene_id", "item")) + ", score double"
    # a stated set of queries against all rows, block by block; blocks whose zones cannot meet form no pair
    return _item_blocks(items, block).join(_query_blocks(queries, block), _zones_meet()).mapInArrow(run, schema)


def filtered_dense_search(items: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """R4 with P1: query_id, video_id, scene_id, item, score, rank of the k best items that each query permits.

    items: video_id, scene_id, item, start_ms, end_ms, evidence_types, embedding. queries: query_id, video_id, start_ms, end_ms,
    required_evidence_types, embedding; a filter that is null, or an empty list, permits all. Items without times meet no range."""
    return ranked(_products(items, queries, k, block, False), k)


def filtered_visual_search(frames: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """R5 with P1: each permitted scene counts by its best frame; frames carry the times and types of their scene."""
    return ranked(best_frames(_products(frames, queries, k, block, True)), k)
