"""Filtered vector search and the kept index against plain loops over all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillspan import queries
from quillspan.functions.text import tokens, tokens_of
from quillspan.operators import inverted_index, retrieval, vector_search

ITEMS = "video_id string, scene_id int, item int, start_ms int, end_ms int, evidence_types array<string>, embedding array<float>"
ASKED = "query_id int, video_id string, start_ms int, end_ms int, required_evidence_types array<string>, embedding array<float>"


def permits(q, d):
    return (q[1] is None or q[1] == d[0]) and (q[2] is None or (d[3] is not None and d[3] < q[3] and q[2] < d[4])) and set(q[4] or []) <= set(d[5] or [])


def made_up(rng, scenes):
    unit = lambda: [float(x) for x in np.round([rng.gauss(0, 1) for _ in range(8)], 2)]
    types = ["transcript", "ocr", "keyframe"]
    places = {s: (rng.choice("abcd"), s, *((None, None) if rng.random() < 0.1 else (t := rng.randint(0, 9000), t + 900)), rng.sample(types, rng.randint(0, 3)) if rng.random() < 0.9 else None) for s in scenes}
    items = [(v, s, 10 * s + f, lo, hi, held, unit()) for s, (v, _, lo, hi, held) in places.items() for f in range(rng.randint(1, 3))]
    asked = [
        (i, rng.choice(["a", "c", "z"]) if i % 3 == 0 else None, *((lo := rng.randint(0, 9000), lo + 1500) if i % 2 else (None, None)), rng.choice([None, [], ["ocr"], ["keyframe", "ocr"]]), unit())
        for i in range(40)
    ]
    return items, asked


def by_hand(items, asked, k, by_scene):
    out = set()
    for q in asked:
        y = np.array(q[5]) / np.linalg.norm(q[5])
        scored = [(-round(float(np.array(d[6]) / np.linalg.norm(d[6]) @ y), 7), d[0], d[1], d[2]) for d in items if permits(q, d)]
        best = {}
        for s, v, scene, item in scored:
            key = (v, scene) if by_scene else (v, scene, item)
            best[key] = min(best.get(key, (9,)), (s, v, scene, item))
        out |= {(q[0], v, scene, item, -s) for s, v, scene, item in sorted(best.values())[:k]}
    return out


def test_filters_hold_before_the_best_are_cut(spark):
    rng = random.Random(4)
    items, asked = made_up(rng, range(300))
    df, q = spark.createDataFrame(items, ITEMS).repartition(3), spark.createDataFrame(asked, ASKED)
    for search, by_scene in ((vector_search.filtered_dense_search, False), (vector_search.filtered_visual_search, True)):
        got = {(r["query_id"], r["video_id"], r["scene_id"], r["item"], round(r["score"], 7)) for r in search(df, q, 5, block=16).collect()}
        want = by_hand(items, asked, 5, by_scene)
        assert len(got) == len(want) and {x[:4] for x in got} == {x[:4] for x in want}
    assert vector_search.filtered_dense_search(df.limit(0), q, 5).count() == 0
    assert vector_search.filtered_dense_search(df, q.limit(0), 5).count() == 0


def test_blocks_that_no_query_can_use_form_no_pair(spark):
    items, _ = made_up(random.Random(5), range(200))
    one = [(1, "b", 100, 200, None, [1.0] * 8)]
    blocks = vector_search._item_blocks(spark.createDataFrame(items, ITEMS).coalesce(1), 8)
    asked = vector_search._query_blocks(spark.createDataFrame(one, ASKED), 8)
    met = blocks.join(asked, vector_search._zones_meet())
    assert 0 < met.count() < blocks.count() / 3


def bm25_by_hand(docs, queries, k):
    counts = [Counter(inverted_index.terms_of(t or "")) for *_, t in docs]
    lengths = [sum(c.values()) for c in counts]
    mean, df = sum(lengths) / len(lengths), Counter(t for c in counts for t in c)
    out = set()
    for i, text in queries:
        scores = []
        for (v, s, _), c, n in zip(docs, counts, lengths):
            x = sum(m * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * n / mean)) for t, m in Counter(inverted_index.terms_of(text)).items() if c[t])
            if x > 0:
                scores.append((-round(x, 9), v, s))
        out |= {(i, v, s, rank) for rank, (_, v, s) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_skipping_ranges_changes_no_result(spark, tmp_path):
    rng = random.Random(6)
    words = ["the"] * 40 + [f"w{i}" for i in range(60)] * 2 + [f"rare{i}" for i in range(200)] + ["红色", "方块红"]
    docs = [(rng.choice("ab"), i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(500)] + [("a", 900, None), ("b", 901, "")]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for i in range(25)] + [(90, "THE the"), (91, "nowhere"), (92, ""), (93, "红色 w1")]
    df = spark.createDataFrame([(v, s, t, (t or "")[:20]) for v, s, t in docs], "video_id string, scene_id int, combined string, ocr string").repartition(2)
    q = spark.createDataFrame(queries, "query_id int, text string")
    inverted_index.write_index(df, f"{tmp_path}/index", ["combined", "ocr"], span=16)
    index = inverted_index.read_index(spark, f"{tmp_path}/index")
    got = {(r["query_id"], r["video_id"], r["scene_id"], r["rank"]) for r in inverted_index.search(index, q, k=4).collect()}
    assert got == bm25_by_hand(docs, queries, 4)
    short = [(v, s, (t or "")[:20]) for v, s, t in docs]
    got = {(r["query_id"], r["video_id"], r["scene_id"], r["rank"]) for r in inverted_index.search(index, q, "ocr", 4).collect()}
    assert got == bm25_by_hand(short, queries, 4)
    # the bound really skips
    one = spark.createDataFrame([(1, "rare7")], "query_id int, text string")
    asked = inverted_index.asked_terms(index, one, "combined")
    parts = [r["most"] * r["weight"] for r in index.blocks.filter("field = 'combined'").join(asked, "term").select("most", "weight").collect()]
    live = [inverted_index.live_ranges(index, asked, spark.createDataFrame([(1, x)], "query_id int, bound double"), "combined").count() for x in (None, max(parts), max(parts) + 1)]
    assert live[0] == len(parts) > live[1] >= 1 and live[2] == 0


def test_filters_inside_the_indexed_search(spark):
    docs = [("a", 1, "red ball", 0, 10, ["ocr"]), ("a", 2, "red red ball", 10, 20, []), ("b", 3, "red", 0, 10, ["ocr"]), ("b", 4, "ball", 5, 9, ["ocr"])]
    df = spark.createDataFrame(docs, "video_id string, scene_id int, combined string, start_ms int, end_ms int, evidence_types array<string>")
    q = spark.createDataFrame([(1, "red", None, None, None, ["ocr"]), (2, "red ball", "a", 10, 11, None), (3, "red", None, None, None, None)], "query_id int, text string, video_id string, start_ms int, end_ms int, required_evidence_types array<string>")
    got = {(r["query_id"], r["scene_id"]) for r in inverted_index.search(inverted_index.build_index(df, ["combined"]), q, k=1, docs=df).collect()}
    plain = {(r["query_id"], r["scene_id"]) for r in retrieval.bm25_search(df.withColumnRenamed("combined", "text"), q, 1, filtered=True).collect()}
    assert got == plain and len(got) == 3


def test_terms_of_two_scripts():
    assert inverted_index.terms_of("Straße SALE-42 红方块 x") == ["strasse", "sale", "42", "红", "方", "块", "红方", "方块", "x"]


def test_routes_do_not_write_the_analysis_out_anew(spark):
    asked = spark.createDataFrame([(1, "find the ball moving left"), (2, None)], "query_id long, text string")
    routed = retrieval.route(retrieval.analyse(asked))
    assert "isnotnull(coalesce" not in routed._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r["query_id"], r["channel"]) for r in routed.collect()} == {(1, c) for c in retrieval.WEIGHTS["action_or_motion"]} | {(2, c) for c in retrieval.WEIGHTS["ambiguous"]}


def test_scores_stay_in_the_task_of_their_document(spark):
    docs = spark.createDataFrame([("v", i, f"common w{i % 7} x{i % 3}") for i in range(60)] + [("w", None, None)], "video_id string, scene_id long, text string")
    asked = spark.createDataFrame([(1, "common w1 w1"), (2, "x2 common"), (3, "absent")], "query_id long, text string")
    counts = inverted_index.count_terms(docs, ["text"])
    got = inverted_index.search_counts(counts, asked, "text", 5)
    index = inverted_index.build_index(docs, ["text"], span=8)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "video_id", "scene_id", "score", "rank").collect()))
    assert rows(got) == rows(inverted_index.search(index, asked, "text", 5))
    assert rows(inverted_index.matched_counts(counts, asked, "text", 5)) == rows(retrieval.ranked(inverted_index.matched_terms(index, asked, "text"), 5))
    # pairs of query and document are summed and cut before they move: one exchange of documents, one of the k best
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_blocks_are_made_in_the_task_of_their_texts(spark, tmp_path, monkeypatch):
    """Postings are not grouped by a shuffle: a kept row holds a whole block. Blocks say how much they hold, and a full task writes a range in several rows."""
    rng = random.Random(7)
    docs = [("a", i, " ".join(rng.choice(["the", "of", f"w{rng.randint(0, 30)}", "é", "Straße"]) for _ in range(rng.randint(0, 20)))) for i in range(300)]
    df = spark.createDataFrame(docs, "video_id string, scene_id int, text string").repartition(3)
    plan = inverted_index._invert(df.withColumn("doc", F.monotonically_increasing_id()), ["text"], 64)._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan
    q = spark.createDataFrame([(1, "the w1 w2"), (2, "strasse of w3"), (3, "w4")], "query_id int, text string")
    kept = []
    for held in (inverted_index.HELD, 40):
        monkeypatch.setattr(inverted_index, "HELD", held)
        path = f"{tmp_path}/{held}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
        try:
            inverted_index.write_index(df, path, ["text"], span=2048)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        index = inverted_index.read_index(spark, path)
        mean = index.totals.first()["mean_length"]
        for b in index.blocks.collect():
            assert (b["n"], b["occurrences"]) == (len(b["docs"]), sum(d["tf"] for d in b["docs"]))
            assert [d["doc"] for d in b["docs"]] == sorted(d["doc"] for d in b["docs"])
            assert math.isclose(b["most"], max(d["tf"] * 2.5 / (d["tf"] + 1.5 * (0.25 + 0.75 * d["length"] / mean)) for d in b["docs"]), rel_tol=1e-12)
        counts = [Counter(inverted_index.terms_of(t)) for *_, t in docs]
        want = {(t, sum(t in c for c in counts), sum(c[t] for c in counts)) for t in set().union(*counts)}
        assert {(r["term"], r["df"], r["occurrences"]) for r in index.terms.collect()} == want
        assert {tuple(r) for r in inverted_index.search(index, q, "text", 5).select("query_id", "video_id", "scene_id", "rank").collect()} == bm25_by_hand(docs, [(1, "the w1 w2"), (2, "strasse of w3"), (3, "w4")], 5)
        kept.append(index.blocks.count())
    assert kept[0] < kept[1]


def test_an_index_of_no_documents(spark):
    index = inverted_index.build_index(spark.createDataFrame([], "video_id string, scene_id int, text string"), ["text"])
    assert (index.documents.count(), index.blocks.count(), index.terms.count()) == (0, 0, 0)


def test_terms_are_those_of_the_pattern():
    for at in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}B{chr(c)} " for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        runs = inverted_index.TOKEN.findall(text.casefold())
        want = [x for t in runs for x in ([*t, *map("".join, zip(t, t[1:]))] if "㐀" <= t[0] <= "鿿" else [t])]
        assert inverted_index.terms_of(text) == want


def test_pairs_of_a_filtered_search_do_not_move(spark):
    """Scores are filtered and cut in the task of their block: only the k best move, once."""
    docs = [("ab"[i % 2], i, f"common w{i % 7} x{i % 3}", i, i + 5, ["ocr"][: i % 2]) for i in range(60)]
    df = spark.createDataFrame(docs, "video_id string, scene_id int, text string, start_ms int, end_ms int, evidence_types array<string>")
    q = spark.createDataFrame([(1, "common w1", None, None, None, ["ocr"]), (2, "x2", "a", 10, 30, None)], "query_id int, text string, video_id string, start_ms int, end_ms int, required_evidence_types array<string>")
    plan = retrieval.bm25_search(df, q, 5, filtered=True)._jdf.queryExecution()
    assert plan.sparkPlan().toString().count("WindowGroupLimit") == 2 and "Aggregate" not in plan.sparkPlan().toString()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_filtered_search_of_repeated_and_null_keys(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["the"] * 10 + ["Straße", "é", "x-1"]
    text = lambda n: rng.choice([None, "", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, n))) for _ in range(12)]])
    docs = [(rng.choice([None, *range(150)]) if rng.random() < 0.5 else 200 + i, text(12), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None])) for i in range(500)]
    docs += [(7, "w1 w2 the", "en", "src0")] * 40 + [(None, "w1 w2 the", "en", None)] * 5 + [(1000 + i, "w3 the", "en", "src1") for i in range(30)]
    asked = [(i, text(6)) for i in range(40)] + [(4, "w1 the"), (4, "w5"), (6, "w2 w2"), (None, "w1"), (50, "nowhere"), (51, "w3"), (52, "w3 the"), (54, "w1 w2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    sql = con.execute(queries.ORACLE["p1_filtered_search"])
    names = [c[0] for c in sql.description]
    rows = lambda found: sorted((r["query_id"], r["rank"], r["video_id"], r["scene_id"], round(r["score"], 7)) for r in found)
    want = rows(dict(zip(names, r)) for r in sql.fetchall())
    assert len(want) > 200 and len({x[0] for x in want}) > 30
    run = lambda: rows(queries.QUERIES["p1_filtered_search"](spark, str(tmp_path)).collect())
    assert run() == want
    for name, least in (("UNITS", 16), ("QUERIES", 3), ("HITS", 60), ("PLACES", 4), ("SENT_TERMS", 1)):
        monkeypatch.setattr(retrieval, name, least)
    assert run() == want


def test_filters_of_blocks_are_those_of_pairs(spark, monkeypatch):
    rng = random.Random(9)
    types = ["ocr", "keyframe", "transcript"]
    some = lambda x, p=0.2: None if rng.random() < p else x
    docs = [(some(rng.choice("abé"), 0.05), some(i // 2, 0.05), " ".join(rng.choices(["red", "ball", "box"], k=rng.randint(0, 5))), some(t := 2**53 + rng.randint(0, 90)), some(t + 9), some([some(x) for x in rng.sample(types, rng.randint(0, 3))])) for i in range(200)]
    asked = [(i, rng.choice(["red", "ball box", "red red box"]), some(rng.choice("aé"), 0.6), some(t := 2**53 + rng.randint(0, 90), 0.5), some(t + 5, 0.3), some([some(x, 0.1) for x in rng.sample(types, rng.randint(0, 2))], 0.4)) for i in range(30)]
    df = spark.createDataFrame(docs, "video_id string, scene_id int, text string, start_ms long, end_ms long, evidence_types array<string>").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, text string, video_id string, start_ms long, end_ms long, required_evidence_types array<string>")
    monkeypatch.setattr(retrieval, "UNITS", 16)
    rows = lambda x: sorted((r["query_id"], r["rank"], r["video_id"], r["scene_id"], round(r["score"], 7)) for r in x.collect())
    got = rows(retrieval.bm25_search(df, q, 7, filtered=True))
    assert got == rows(retrieval.ranked(retrieval.allowed(retrieval.bm25_scores(df, q), df, q), 7)) and len({x[0] for x in got}) > 10
    assert retrieval.bm25_search(df.limit(0), q, 7, filtered=True).count() == 0
    assert retrieval.bm25_search(df, q.limit(0), 7, filtered=True).count() == 0


def test_sums_of_a_block_in_several_steps(monkeypatch):
    rng = np.random.default_rng(1)
    term, unit, part = rng.integers(-1, 6, 200), np.sort(rng.integers(0, 20, 200)), rng.random(200)
    asked, query, weight = rng.permutation(np.arange(30) % 6), rng.integers(0, 4, 30), rng.random(30)
    want = np.zeros((20, 4))
    for t, u, p in zip(term, unit, part):
        for a, q, w in zip(asked, query, weight):
            want[u, q] += p * w * (t == a)
    for least in (1, 17, 10**6):
        monkeypatch.setattr(retrieval, "EXPANDED", least)
        assert np.allclose(retrieval._sums(term, unit, part, 20, asked, query, weight, 4), want)
    assert not retrieval._sums(term[:0], unit[:0], part[:0], 20, asked, query, weight, 4).any()


def test_terms_of_one_text_are_those_of_the_column(spark):
    texts = ["".join(f"a{chr(c)}B{chr(c)} " for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 64)] + ["Straße SALE-42 红方块 x", "", "红色"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("i", tokens(F.col("text")).alias("terms")).collect():
        assert Counter(r["terms"]) == Counter(tokens_of(texts[r["i"]]))
