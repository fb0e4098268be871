"""Queries of exact vector search with filters, over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import vector_search as V
from quillspan.plans.registry import query

# types are bits: 1 transcript, 2 ocr, 4 keyframe
ITEMS = """SELECT label AS video_id, vec_id AS scene_id, vec_id AS item, vec_id % 997 * 1000 AS start_ms, vec_id % 997 * 1000 + 1500 AS end_ms,
  vec_id % 8 AS bits, embedding FROM {embeddings}"""
FRAMES = """SELECT label AS video_id, CAST(floor(vec_id / 5) AS BIGINT) AS scene_id, vec_id AS item, CAST(floor(vec_id / 5) AS BIGINT) % 499 * 1000 AS start_ms,
  CAST(floor(vec_id / 5) AS BIGINT) % 499 * 1000 + 2500 AS end_ms, CAST(floor(vec_id / 5) AS BIGINT) % 8 AS bits, embedding FROM {embeddings}"""
ASKED = """SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN label END AS video_id, CASE WHEN vec_id % 4 < 2 THEN vec_id % 300 * 1000 END AS start_ms,
  CASE WHEN vec_id % 4 < 2 THEN vec_id % 300 * 1000 + 40000 END AS end_ms, CASE WHEN vec_id % 200 = 0 THEN 5 WHEN vec_id % 200 = 50 THEN 2 ELSE 0 END AS need, embedding
  FROM {embeddings} WHERE vec_id % 50 = 0"""
TYPES = {"transcript": 1, "ocr": 2, "keyframe": 4}

_E = "list_transform(embedding, lambda x: x::DOUBLE)"
PERMITTED = f"""
v AS (SELECT * EXCLUDE (embedding), {_E} AS e FROM ({{0}})), w AS (SELECT * EXCLUDE (embedding), {_E} AS qe FROM ({{1}})),
s AS (SELECT query_id, v.video_id, scene_id, item, round(list_inner_product(e, qe) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(qe, qe)), 9) AS score
  FROM v JOIN w ON (w.video_id IS NULL OR w.video_id = v.video_id) AND (w.start_ms IS NULL OR (v.start_ms < w.end_ms AND w.start_ms < v.end_ms)) AND v.bits & need = need)"""


def _types(df: DataFrame, bits: str, name: str) -> DataFrame:
    held = F.array_compact(F.array(*[F.when(F.col(bits).bitwiseAND(b) != 0, F.lit(t)) for t, b in TYPES.items()]))
    return df.withColumn(name, held)


def _sides(get, items: str) -> tuple[DataFrame, DataFrame]:
    return _types(get(items), "bits", "evidence_types"), _types(get(ASKED), "need", "required_evidence_types")


_ORDER = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, scene_id) AS rank"


@query(
    "r4_filtered_search",
    "WITH " + PERMITTED.replace("{0}", ITEMS).replace("{1}", ASKED) + f" SELECT query_id, video_id, scene_id, round(score, 7) AS score, {_ORDER} FROM s QUALIFY rank <= 10",
)
def r4_filtered(get):
    """The ten best vectors that the video, range and evidence filters of a query permit."""
    return V.filtered_dense_search(*_sides(get, ITEMS)).select("query_id", "video_id", "scene_id", F.round("score", 7).alias("score"), "rank")


@query(
    "r5_filtered_search",
    "WITH " + PERMITTED.replace("{0}", FRAMES).replace("{1}", ASKED) + f""",
    b AS (SELECT query_id, video_id, scene_id, max(score) AS score, arg_max(item, score * 1e12 - item) AS item FROM s GROUP BY ALL)
    SELECT query_id, video_id, scene_id, item, round(score, 7) AS score, {_ORDER} FROM b QUALIFY rank <= 10""",
)
def r5_filtered(get):
    """The ten best scenes by their best frame, of those that a query permits."""
    return V.filtered_visual_search(*_sides(get, FRAMES)).select("query_id", "video_id", "scene_id", "item", F.round("score", 7).alias("score"), "rank")
