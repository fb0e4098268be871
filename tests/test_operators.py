"""Hand-computed cases of single operators."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions.text import _code, distance, edit_distance, tokens, word_distance
from quillspan.operators import event_log, governance, intervals, ranking_metrics, retrieval, training_data
from quillspan.sources import records


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tokens_of_two_scripts(spark):
    df = spark.createDataFrame([("Find 蓝色圆形 EXIT Straße",), (None,)], "t string")
    got = [r[0] for r in df.select(tokens(F.col("t"))).collect()]
    assert got[0] == ["find", "蓝", "色", "圆", "形", "蓝色", "色圆", "圆形", "exit", "strasse"] and got[1] == []


def test_bm25_order(spark):
    docs = spark.createDataFrame([("v", 1, "red square moves right"), ("v", 2, "blue circle stays still"), ("v", 3, "red circle"), ("v", 4, "")], "video_id string, scene_id int, text string")
    q = spark.createDataFrame([(1, "red square"), (2, "missing")], "query_id int, text string")
    assert [r["scene_id"] for r in retrieval.bm25_search(docs, q).orderBy("rank").collect()] == [1, 3]


def test_filters_apply_before_ranking(spark):
    docs = spark.createDataFrame([("a", 1, 0, 10, ["ocr"]), ("a", 2, 10, 20, []), ("b", 3, 0, 10, ["ocr"])], "video_id string, scene_id int, start_ms int, end_ms int, evidence_types array<string>")
    q = spark.createDataFrame([(1, "a", 5, 10, ["ocr"]), (2, None, None, None, ["ocr"]), (3, "a", 10, 11, None)], "query_id int, video_id string, start_ms int, end_ms int, required_evidence_types array<string>")
    assert rows(retrieval.eligible(docs, q), "query_id", "scene_id") == [(1, 1), (2, 1), (2, 3), (3, 2)]


def test_filters_inside_a_search_equal_the_table_of_permitted_pairs(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(rng.choice("ab"), i, (s := rng.randint(0, 300_000)), s + rng.randint(0, 90_000), rng.sample(["ocr", "asr"], rng.randint(0, 2)), "w" + str(i % 7)) for i in range(120)], "video_id string, scene_id int, start_ms int, end_ms int, evidence_types array<string>, text string")
    qs = [(i, rng.choice(["a", None]), *((s, s + 100_000) if rng.random() < 0.6 else (None, None)), rng.choice([None, ["ocr"], []]), f"w{i % 7} w{(i + 1) % 7}") for i, s in enumerate(rng.choices(range(250_000), k=30))]
    q = spark.createDataFrame(qs, "query_id int, video_id string, start_ms int, end_ms int, required_evidence_types array<string>, text string")
    pairs = {tuple(r) for r in retrieval.eligible(docs, q).collect()}
    want = {(i, d["video_id"], d["scene_id"]) for d in docs.collect() for i, v, s, e, need, _ in qs if (v is None or v == d["video_id"]) and (s is None or (d["start_ms"] < e and s < d["end_ms"])) and set(need or []) <= set(d["evidence_types"])}
    assert pairs == want
    found = rows(retrieval.bm25_search(docs, q, 1000, filtered=True), "query_id", "video_id", "scene_id")
    scored = rows(retrieval.bm25_scores(docs, q), "query_id", "video_id", "scene_id")
    assert found == [p for p in scored if p in want]


def test_dense_blocks_equal_all_products(spark):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(23, 8))
    vectors = spark.createDataFrame([("v", int(i) // 3, int(i), [float(x) for x in r]) for i, r in enumerate(v)], "video_id string, scene_id int, item int, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(q)], "query_id int, embedding array<double>").repartition(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(v).T, 9)
    got = retrieval.dense_search(vectors, queries, 4, block=50).collect()
    assert sorted((r["query_id"], r["rank"], r["item"]) for r in got) == sorted((i, n + 1, int(j)) for i in range(23) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:4]))
    scenes = s.reshape(23, 100, 3).max(axis=2)
    seen = retrieval.visual_search(vectors, queries, 4, block=50).collect()
    assert sorted((r["query_id"], r["rank"], r["scene_id"]) for r in seen) == sorted((i, n + 1, int(j)) for i in range(23) for n, j in enumerate(np.argsort(-scenes[i], kind="stable")[:4]))
    assert retrieval.dense_search(vectors.limit(0), queries, 4).count() == 0 and retrieval.dense_search(vectors, queries.limit(0), 4).count() == 0


def test_intents(spark):
    q = spark.createDataFrame([(1, 'visible exact text "SALE 42"'), (2, "找到红色方块向右移动的场景"), (3, None)], "query_id int, text string")
    got = {r["query_id"]: r for r in retrieval.analyse(q).collect()}
    assert got[1]["intent"] == "visible_text" and got[1]["quoted"] == ["SALE 42"]
    assert got[2]["intent"] == "action_or_motion" and got[2]["actions"] == ["move_right"]
    assert got[3]["intent"] == "ambiguous"


def test_routing_needs_a_channel(spark):
    a = retrieval.analyse(spark.createDataFrame([(1, "x")], "query_id int, text string"))
    with pytest.raises(ValueError):
        retrieval.route(a, disabled=("bm25_combined", "dense_text", "visual"))


def test_texts_of_one_script_and_of_several_give_the_same_tokens(spark):
    df = spark.createDataFrame([("Straße 7, A-b",), ("红色 ab方块c",), ("",), (None,), ("é!",)], "text string")
    assert [r["t"] for r in df.select(tokens(F.col("text")).alias("t")).collect()] == [["strasse", "7", "a", "b"], ["红", "色", "红色", "ab", "方", "块", "方块", "c"], [], [], []]


def test_index_splits_the_texts_once(spark):
    docs = spark.createDataFrame([("v", 1, "a b a"), ("v", 1, "a b a"), ("v", 2, "b"), ("w", 1, None)], "video_id string, scene_id int, text string")
    index = retrieval.bm25_index(docs)
    assert rows(index, "term", "video_id", "scene_id", "tf", "length", "df", "n_docs", "mean_length") == [("a", "v", 1, 4, 3, 1, 4, 1.75), ("b", "v", 1, 2, 3, 2, 4, 1.75), ("b", "v", 2, 1, 1, 2, 4, 1.75)]
    assert "regexp_extract_all" not in index._jdf.queryExecution().executedPlan().toString()


def test_error_rates(spark):
    p = spark.createDataFrame([("red square", "red circle"), ("Red square.", "red square"), ("CASE 01", "case01"), ("", "a b"), ("kitten", "sitting")], "reference string, hypothesis string")
    got = [(r["wer"], r["cer"]) for r in training_data.error_rates(p).collect()]
    assert [g[0] for g in got[:2]] == [0.5, 0.0] and got[2][1] == 0.0 and got[3][0] == 2.0 and got[4][1] == 0.5


def test_word_distances_match_brute_force(spark):
    rng = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    pairs = [([rng.choice("abcdef") for _ in range(rng.randint(0, 12))], [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["d"] for r in df.select("i", word_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: distance(a, b) for i, (a, b) in enumerate(pairs)}
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i)).alias("a"))
    assert many.select(word_distance(F.slice("a", 59_000, 1001), F.slice("a", 1, 3)).alias("d")).first()["d"] == 1001
    codes = many.select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), _code).alias("c")).select(F.size(F.array_distinct("c")).alias("n"), F.length(F.array_join("c", "")).alias("l")).first()
    assert (codes["n"], codes["l"]) == (60_000, 60_000)


def test_distances_of_long_texts_equal_levenshtein(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abé😀 ") for _ in range(n)), "".join(rng.choice("abé😀 ") for _ in range(m))) for n, m in ((0, 0), (0, 9), (1, 1), (64, 65), (700, 31), (300, 900))]
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    assert all(r["d"] == r["l"] for r in df.select(edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("l")).collect())
    # 20,000 characters against as many others: 4e8 cells, a step of which is not a step of ours
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(20_000)) for _ in range(2))
    began = time.perf_counter()
    assert distance(a, "x" + a[:-1]) == 2 and distance(a, b) > 5_000
    assert time.perf_counter() - began < 5


def test_asr_table(spark):
    spans = spark.createDataFrame([("a", 1, "square", 600, 1100), ("a", 0, "red", 50, 500)], "case_id string, pos int, text string, start_ms long, end_ms long")
    gold = spark.createDataFrame([("a", "red square", 0, 1000), ("b", "x", 0, 10)], "case_id string, text string, start_ms long, end_ms long")
    got = {r["case_id"]: r for r in training_data.asr_table(spans, gold).collect()}
    assert (got["a"]["wer"], got["a"]["start_error"], got["a"]["end_error"], got["a"]["kind"]) == (0.0, 50, 100, "correct")
    assert (got["b"]["wer"], got["b"]["kind"]) == (1.0, "deletion")


def test_a_prediction_without_gold_in_its_video_scores_nothing(spark):
    p = spark.createDataFrame([(1, "v", 0, 10), (2, "w", 0, 10)], "k int, video_id string, start_ms int, end_ms int")
    g = spark.createDataFrame([("v", 0, 5), ("v", 0, 8)], "video_id string, start_ms int, end_ms int")
    assert rows(ranking_metrics.best_match(p, g, ["video_id"]), "k", "iou") == [(1, 0.8), (2, 0.0)]


def test_rounding_of_ticks(spark):
    df = spark.createDataFrame([(3, 0, 1, 2000), (-3, 0, 1, 2000), (1, 0, 1, 3), (10**15, 1, 1001, 90000)], "p long, o long, n long, d long")
    ms = lambda r: intervals.ticks_to_ms(F.col("p"), F.col("o"), F.col("n"), F.col("d"), r)
    got = df.select(ms("nearest"), ms("floor"), ms("ceil")).collect()
    assert [tuple(r) for r in got[:3]] == [(2, 1, 2), (-2, -2, -1), (333, 333, 334)]
    n, d = (10**15 - 1) * 1001 * 1000, 90000
    assert got[3][1] == n // d


def test_boundaries_are_merged_whatever_their_order(spark):
    d = spark.createDataFrame([("v", 1000), ("w", 100)], "video_id string, duration_ms long")
    b = spark.createDataFrame([("v", x) for x in (950, 100, 500, 100, 560, 0, 2000)], "video_id string, boundary_ms long")
    assert rows(intervals.merge_boundaries(b, d, 100), "video_id", "start_ms", "end_ms") == [("v", 0, 100), ("v", 100, 500), ("v", 500, 1000), ("w", 0, 100)]


def test_boundaries_of_a_long_video(spark):
    """One video with most of the boundaries, gaps far wider than a bucket, repeats and bounds outside, against a loop."""
    cuts = [("long", (i * i * 7919) % 400_000) for i in range(6000)] + [("long", 900_000), ("long", 900_050), ("long", -5), ("tail", 950), ("tail", 300), ("none", 2000)]
    lengths = {"long": 900_120, "tail": 1000, "none": 2000}
    want = []
    for v, d in lengths.items():
        kept = [0]
        for x in sorted({c for w, c in cuts if w == v and 0 < c < d}):
            if x - kept[-1] >= 150:
                kept.append(x)
        if len(kept) > 1 and d - kept[-1] < 150:
            kept.pop()
        want += [(v, n, s, e) for n, (s, e) in enumerate(zip(kept, [*kept[1:], d], strict=True))]
    b = spark.createDataFrame([*cuts, (None, 5)], "video_id string, boundary_ms long")
    d = spark.createDataFrame([*lengths.items(), (None, 9)], "video_id string, duration_ms long")
    assert rows(intervals.merge_boundaries(b, d, 150), "video_id", "n", "start_ms", "end_ms") == sorted(want)


def test_overlaps_are_found_once_in_any_bucket(spark):
    a = spark.createDataFrame([(1, 1, 0, 250), (1, 2, 99, 101), (1, 3, 100, 100)], "k int, span_id int, start_ms long, end_ms long")
    b = spark.createDataFrame([(1, 7, 50, 300), (1, 8, 250, 260), (1, 9, 0, 100)], "k int, scene_id int, start_ms long, end_ms long")
    got = rows(intervals.overlap_join(a, b, "k", 40), "span_id", "scene_id")
    assert got == [(1, 7), (1, 9), (2, 7), (2, 9), (3, 7)]


def test_one_violation_each(spark):
    schema = "run_id string, arrival int, task_id int, run_task int, event_id string, sequence_no long, parent_version long, kind string, revision long, delta long"
    log = lambda run, *events: [(run, i, t, 0, e, s, p, k, r, d) for i, (t, e, s, p, k, r, d) in enumerate(events)]
    data = (
        log("ok", (0, "a", 1, 0, "plan", 1, 0), (0, "b", 2, 1, "budget", None, 5), (0, "c", 3, 2, "terminal", None, 0))
        + log("dup", (0, "a", 1, 0, "x", None, 0), (0, "a", 2, 1, "x", None, 0))
        + log("gap", (0, "a", 1, 0, "x", None, 0), (0, "b", 3, 2, "x", None, 0))
        + log("parent", (0, "a", 1, 1, "x", None, 0))
        + log("task", (1, "a", 1, 0, "x", None, 0))
        + log("plan", (0, "a", 1, 0, "plan", 2, 0))
        + log("budget", (0, "a", 1, 0, "budget", None, 11))
        + log("after", (0, "a", 1, 0, "terminal", None, 0), (0, "b", 2, 1, "x", None, 0))
    )
    got = dict(rows(event_log.audit_log(spark.createDataFrame(data, schema), 10), "run_id", "violation"))
    assert got == {"dup": "duplicate_event", "gap": "sequence", "parent": "parent_version", "task": "task_mismatch", "plan": "plan_revision", "budget": "budget", "after": "after_terminal"}


def test_lineage_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, None)], "child int, parent int")
    s = spark.createDataFrame([(1,), (4,), (9,)], "start int")
    assert rows(event_log.ancestors(e, s), "start", "node") == [(1, 1), (1, 2), (1, 3), (4, 4), (9, 9)]


def test_lineage_of_a_long_chain(spark):
    e = [(i, i + 1) for i in range(1500)] + [(1500, 1490), (700, 703), (2000, 700), (5000, 5001), (5001, 5000)]
    s = spark.createDataFrame([(0,), (2000,), (5000,)], "start int")
    want = [(0, i) for i in range(1501)] + [(2000, i) for i in [*range(700, 1501), 2000]] + [(5000, 5000), (5000, 5001)]
    assert rows(event_log.ancestors(spark.createDataFrame(e, "child int, parent int"), s), "start", "node") == want


def test_bootstrap_of_equal_and_opposite_arms(spark):
    t = [(i, f"s{i // 2}", b, b) for i, b in enumerate((1, 1, 0, 0, 1, 0))]
    got = {r["quantity"]: r for r in governance.paired_bootstrap(spark.createDataFrame(t, "task_id int, source_id string, base int, other int"), 200, 1).collect()}
    assert (got["difference"]["value"], got["difference"]["lo"], got["difference"]["hi"]) == (0, 0, 0) and got["base"]["value"] == 0.5
    t = [(i, f"s{i // 2}", b, 0) for i, b in enumerate((1, 1, 0, 0))]
    got = {r["quantity"]: r for r in governance.paired_bootstrap(spark.createDataFrame(t, "task_id int, source_id string, base int, other int"), 400, 1).collect()}
    assert (got["base"]["value"], got["base"]["lo"], got["base"]["hi"]) == (0.5, 0, 1) and got["difference"]["value"] == -0.5


def test_bootstrap_holds_the_sources_in_memory_and_not_the_draws(spark, monkeypatch):
    n = 3000
    outcomes = spark.range(2 * n).selectExpr("id AS task_id", "id % 3000 AS source_id", "CAST(id % 7 < 3 AS INT) AS base", "CAST(id % 5 < 3 AS INT) AS other")
    out = governance.paired_bootstrap(outcomes, 20, 5)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :|+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            inside = [x for x in lines[i + 1 :] if x][: next((j for j, x in enumerate(lines[i + 1 :]) if depth(x) <= depth(line)), None)]
            assert not any("Generate" in x for x in inside)
    want = out.collect()
    monkeypatch.setattr(governance, "SENT", 10)
    monkeypatch.setattr(governance, "PIECE", 700)
    other = governance.paired_bootstrap(outcomes, 20, 5)
    assert other.collect() == want and "ShuffledHashJoin" in other._jdf.queryExecution().executedPlan().toString()


def test_even_sample_rounds_halves_to_even(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    assert rows(governance.even_sample(df, 4, "k"), "k") == [(0,), (3,), (6,), (9,)]
    assert rows(governance.even_sample(df, 1, "k"), "k") == [(0,)]


def test_rollout_rewards(spark):
    want = '{"arguments":{"x":"1"},"decision_type":"tool","name":"trim"}'
    r = spark.createDataFrame([(1, 1, 0, want, want), (2, 2, 0, "not JSON", want), (3, 3, 1, want, want), (4, 4, 0, None, want), (5, 5, 0, '{"decision_type":"finish"}', want)], "rollout_id int, sample_id int, n int, raw string, expected string")
    got = {x["rollout_id"]: x["total"] for x in training_data.score_rollouts(r, ["tool", "finish"]).collect()}
    assert got == {1: 3.0, 2: -1.25, 3: -1.0, 4: -1.25, 5: -0.5}


def test_manifest_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(i, f"t{i}", i % 3) for i in range(50)] + [(7, None, 1)], "k int, t string, g int")
    a, b = (records.manifest(x, ["k", "t"], "g").collect()[0] for x in (df, df.repartition(7).orderBy(F.desc("k"))))
    assert a == b and a["n_rows"] == 51 and a["n_groups"] == 3
    assert records.manifest(df.filter("k <> 3"), ["k", "t"], "g").collect()[0]["digest"] != a["digest"]


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([(1, "a", "in", 1), (2, "b", "out", 0)], "k int, subsplit string, x string, y int")
    records.write_split(df, p, ["x"], ["y"], "k", "subsplit")
    public, private = spark.read.json(f"{p}/public"), spark.read.json(f"{p}/private")
    assert set(public.columns) == {"k", "x", "subsplit"} and set(private.columns) == {"k", "y", "subsplit"}
    assert records.read_records(spark, f"{p}/public", "k int, x string").count() == 2
    (tmp_path / "bad.json").write_text('{"k": 1}\n{"k": ')
    with pytest.raises(Exception):  # noqa: B017
        records.read_records(spark, f"{p}/bad.json", "k int").collect()
    for d in ("u", "v"):
        (tmp_path / "one" / d).mkdir(parents=True)
        (tmp_path / "one" / d / "same.json").write_text('{"k": 1}')
    (tmp_path / "one" / "u" / "other.json").write_text('{\n"k": 2}')
    good, twice = records.read_one_per_file(spark, f"{p}/one", "k int")
    assert rows(good, "k", "stem") == [(2, "other")] and rows(twice, "stem", "n") == [("same", 2)]
    (tmp_path / "r.csv").write_text("rater,score\na,1\n")
    assert records.read_ratings(spark, f"{p}/r.csv", "rater string, score int").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        records.read_ratings(spark, f"{p}/r.csv", "score int, rater string").collect()
    row = df.select(records.chat_row(F.col("x"), F.col("subsplit")).alias("j")).first()["j"]
    assert row == '{"messages":[{"role":"user","content":"in"},{"role":"assistant","content":"a"}]}'


def test_one_record_a_file_opens_each_file_once(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.json").write_text('{"k": 1}')
    good, twice = records.read_one_per_file(spark, str(tmp_path), "k int")
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (good, twice)]
    assert rows(good, "k", "stem") == [(1, "a"), (1, "b")] and not any("FileScan json" in p for p in plans)


def test_labels_of_other_scripts_stay_apart(spark):
    rows_ = [("红色 方块", 1, True), ("红色  方块!", 2, False), ("蓝色", 3, True), ("蓝色", 4, True), ("Red-Square", 5, True), ("red square", 6, False)]
    got = {r["label"]: r["scenes"] for r in intervals.relevance_sets(spark.createDataFrame(rows_, "label string, scene_id int, has_evidence boolean")).collect()}
    assert got == {"红色 方块": [1, 2], "蓝色": [3, 4], "red square": [5, 6]}


def test_sums_before_every_value(spark):
    rng = random.Random(2)
    values = rng.sample(range(10_000), 500)
    df = spark.createDataFrame([(float(v), i % 7, i) for i, v in enumerate(values)], "p double, c long, d long").repartition(5)
    got = {r["p"]: (r["c_before"], r["d_before"]) for r in governance.sums_before(df, "p", ["c", "d"]).collect()}
    ordered = sorted((v, i % 7, i) for i, v in enumerate(values))
    assert got == {v: (sum(x[1] for x in ordered[:k]), sum(x[2] for x in ordered[:k])) for k, (v, _, _) in enumerate(ordered)}
