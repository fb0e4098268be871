"""Each stage of the pipeline on its own input: lines and near-duplicates against brute force, the rest against sums and learned scores."""

import collections
import re

from pyspark.sql import functions as F
from test_llm_operators import brute_components

import corpus_pipeline
from quillspan.llm import mixing, quality_model
from quillspan.plans.scratch import materialize

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "near-duplicates", "mixing", "packing"]
    before, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, DATA), "test-stage")
        if name != "packing":
            assert after.columns == columns
        seen[name] = (before.collect(), after.collect())
        before = after

    inp, out = seen["quality classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in out}
    agree = [(labels[r["doc_id"]] == 1) == (r["doc_id"] in kept) for r in inp if r["doc_id"] in labels]
    assert sum(agree) / len(agree) > 0.9

    inp, out = seen["line dedup"]
    sites, first = collections.defaultdict(set), {}
    for r in inp:
        for x in r["text"].split("\n"):
            h = x.strip(" \t\n\x0b\x0c\r")
            if len(re.findall(r"[^\x20\x09-\x0D]+", h)) >= 4:
                sites[h].add(r["source"])
                first[h] = min(first.get(h, r["doc_id"]), r["doc_id"])
    want = {}
    for r in inp:
        lines = r["text"].split("\n")
        left = [x for x in lines if not (len(sites.get(x.strip(" \t\n\x0b\x0c\r"), ())) >= 10 and first[x.strip(" \t\n\x0b\x0c\r")] != r["doc_id"])]
        if len(left) == len(lines) or "\n".join(left).split():
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in out} == want

    inp, out = seen["near-duplicates"]
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in inp} and len({r["text"] for r in out}) == len(out)

    inp, out = seen["mixing"]
    copies = collections.Counter(r["doc_id"] for r in out)
    assert set(copies) <= {r["doc_id"] for r in inp} and max(copies.values()) <= 2

    inp, out = seen["packing"]
    assert sum(r["length"] for r in out) == sum(len(r["text"].encode().split()) for r in inp)


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns named like the results of the stages."""
    words = " ".join(f"wort{i}" for i in range(80))
    line = "all rights of this page are kept by its owner"
    rows = [(i, f"{line}\n{words} {i} {i * 7}", "en", f"s{i % 12}", 5) for i in range(24)]
    rows += [rows[3], rows[3], (3, "another text of the same id " + words[::-1], None, "s1", None), (None, f"{line}\nnull id", "de", None, 1), (None, None, None, None, None)]
    rows += [(50, "", "en", "s1", 0), (51, "long " * 60_000, "en", "s2", 1), (52, None, "en", "s2", 1), (53, line, "en", "s3", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    clash = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("score", "held_out", "predicted", "n_lines", "n_removed", "h", "key", "v", "copies", "target")}
    return d.withColumns(clash)


def test_stages_on_odd_rows(spark):
    d = odd(spark)
    rows = d.collect()
    empty = d.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, DATA)
        assert out.columns == d.columns and out.schema["n_chars"].dataType == d.schema["n_chars"].dataType, name
        got = out.collect()
        assert got and all(r["score"] == f"score of {'none' if r['doc_id'] is None else r['doc_id']}" and r["n_lines"].startswith("n_lines of") for r in got), name
        if name != "line dedup":
            assert {(r["doc_id"], r["text"], r["source"]) for r in got} <= {(r["doc_id"], r["text"], r["source"]) for r in rows}, name
        if name == "quality classifier":
            judged = quality_model.classify(d, spark.read.parquet(f"{DATA}/labels.parquet")).filter("predicted = 1")
            assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((r["doc_id"], r["text"]) for r in judged.collect())
        if name == "line dedup":
            want = collections.Counter()
            for r in rows:
                t = r["text"]
                if t is not None and r["doc_id"] != 0:
                    left = "\n".join(x for x in t.split("\n") if x != "all rights of this page are kept by its owner")
                    t = left
                    if left != r["text"] and not left.split():
                        continue
                want[r["doc_id"], t] += 1
            assert collections.Counter((r["doc_id"], r["text"]) for r in got) == want
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        if name == "near-duplicates":
            comp = brute_components([(r["doc_id"], r["text"], None) for r in rows], 5)
            linked = {i for i, c in comp if i is not None}
            kept = collections.Counter((r["doc_id"], r["text"]) for r in got)
            assert {i for i, _ in kept if i is not None} <= linked and max(kept.values()) == 1 and kept[3, rows[26]["text"]] == 1
            assert sum(1 for i, t in kept if t and "wort1 " in t and i is not None) == len({c for (i, c), r in zip(comp, rows, strict=True) if r["text"] and "wort1 " in r["text"] and i is not None})
        if name == "mixing":
            plan = collections.Counter()
            for r in mixing.mix(d).collect():
                plan[r["doc_id"]] += r["copies"]
            assert collections.Counter(r["doc_id"] for r in got) == +plan
    packed = corpus_pipeline.batches(spark, d, DATA).collect()
    assert sum(r["length"] for r in packed) == sum(len((r["text"] or "").split()) for r in rows)
