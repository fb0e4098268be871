"""Small cases of the ten operators: nulls, empty tables, ties, repeated rows, clashing columns, brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import chat, components, line_dedup, media, mixing, near_dup, packing, pii, quality_model, quality_rules, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# 1 chat


def test_rotation_renders_every_perspective(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi é"), (1, 2, "bob", None), (1, 3, "cy d", "x"), (2, 0, "system", "only"), (None, None, None, "lost")],
        "conv_id long, turn long, role string, text string",
    )
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy d"), (None, "unknown")}
    r = got[1, "ann"]
    assert r["rendered"] == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi é<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=cy_d|>\nx<|end|>\n"
    assert [r["rendered"][m["start"] : m["end"]] for m in r["mask"]] == ["Hi é<|end|>"]
    assert [got[1, "bob"]["rendered"][m["start"] : m["end"]] for m in got[1, "bob"]["mask"]] == ["<|end|>"]


def test_rotation_splits_long_conversations_and_keeps_ties(spark):
    turns = spark.createDataFrame([(1, i // 2, "ab"[i % 2], f"t{i}") for i in range(20)], "conv_id long, turn long, role string, text string")
    got = chat.rotate(turns, turns_per_part=4).collect()
    assert len(got) == 2 * 3 and sum(r["n_turns"] for r in got) == 40
    assert chat.rotate(turns.limit(0)).count() == 0


# 2 packing


def test_boundaries_match_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        x = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        c = [rng.randint(1, 9) for _ in x]
        k = rng.randint(1, 4)

        def cost(bounds):
            return sum(n * (min(b for b in bounds if b >= v) - v) for v, n in zip(x, c))

        best = min(cost((*p, x[-1])) for m in range(min(k, len(x))) for p in itertools.combinations(x[:-1], m))
        got = packing.optimal_boundaries(np.array(x), np.array(c), k)
        assert cost(got) == best and len(got) <= k and got == sorted(got)


def test_packing_loses_no_token_and_keeps_the_budget(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 50)), "s") for i in range(200)] + [(None, "a b", "s"), (7, None, "s"), (7, "", "s")]
    got = packing.pack(docs(spark, rows), buckets=3, max_len=16, budget=64).collect()
    assert sum(r["length"] for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    batches = collections.defaultdict(list)
    for r in got:
        if r["length"]:
            assert r["length"] <= r["bucket_len"]
            batches[r["batch_id"]].append(r)
        else:
            assert r["batch_id"] is None and r["bucket_len"] is None
    assert all(len({r["slot"] for r in b}) == len(b) and len(b) * b[0]["bucket_len"] <= 64 for b in batches.values())
    assert packing.pack(docs(spark, []), max_len=16).count() == 0


# 3 quality classifier


def test_classifier_is_accurate_on_held_out_rows_and_ignores_their_labels(spark):
    p = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{p}/documents.parquet"), spark.read.parquet(f"{p}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_model.classify(d, labels).collect()}
    truth = [(r["quality"], got[r["doc_id"]]) for r in labels.collect()]
    held = [(y, r["predicted"]) for y, r in truth if r["held_out"]]
    assert len(held) > 40 and np.mean([y == q for y, q in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    flipped = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality_model.classify(d, flipped).collect()}
    assert all(again[i] == r["score"] for i, r in got.items())


def test_context_sums_match_brute_force_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "CHUNK", 50)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ein", "zwei", "drei", "vier", "X1", "##"]) for _ in range(n)) for n in (0, 1, 49, 50, 51, 52, 100, 101, 333)]
    total, seen = quality_model.context_sums(docs(spark, [(i, t, None) for i, t in enumerate(texts)]))
    index = np.zeros((quality_model.BUCKETS, quality_model.DIMS))
    np.put_along_axis(index, quality_model.PLUS, 1, axis=1)
    np.put_along_axis(index, quality_model.MINUS, -1, axis=1)
    want, counts = np.zeros_like(total), np.zeros_like(seen)
    for t in texts:
        ids = quality_model.token_ids(t.encode(), quality_model.Tokens())
        for i, b in enumerate(ids):
            counts[b] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    want[b] += index[ids[j]]
    assert (seen == counts).all() and (total == want).all()


def test_classifier_edge_cases(spark):
    d = docs(spark, [(1, None, "a"), (1, None, "a"), (2, "", "a"), (None, "x " * 9000, "a")]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    got = quality_model.classify(d, labels).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.5} and all(r["predicted"] == 1 for r in got)
    assert quality_model.classify(d.limit(0), labels.limit(0)).count() == 0


# 4 toxicity


def test_toxicity_on_held_out_rows(spark):
    p = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{p}/documents.parquet"), spark.read.parquet(f"{p}/labels.parquet")
    d = d.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r["doc_id"]: r for r in toxicity.grade(d, labels).collect()}
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in got]
    assert np.mean([r["toxic"] for y, r in held if y]) > 0.8 and np.mean([r["toxic"] for y, r in held if not y]) < 0.02
    assert all(0 <= r["severity"] <= toxicity.GRADES and r["kept"] != r["toxic"] for r in got.values())


def test_ordinal_thresholds_are_ordered_and_weights_shared():
    rows = [collections.Counter({0: n}) if n else collections.Counter() for n in [0] * 30 + [1, 1, 1, 3, 3, 3, 9, 9, 9]]
    w, theta = toxicity.fit(rows, np.array([0] * 30 + [1] * 3 + [2] * 3 + [3] * 3), 1)
    assert w[0] > 0 and list(theta) == sorted(theta)
    p = toxicity.Ordinal({}, w, theta).above([collections.Counter({0: n}) for n in (1, 3, 9)])
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(p.sum(axis=1)) > 0).all()


def test_ordinal_fit_is_a_minimum_of_its_loss():
    """Brute force: no small step of any weight or threshold lowers the loss by more than the optimiser's tolerance, and the model beats
    a fit that gives each threshold weights of its own on fresh rows drawn from shared weights."""
    rng = np.random.default_rng(6)
    w, theta = np.array([1.5, -1.0, 0.5]), np.array([0.5, 2.0, 3.0])

    def draw(n):
        x = rng.poisson(1.5, (n, 3))
        above = rng.random((n, 1)) < 1 / (1 + np.exp(-(np.log1p(x) @ w)[:, None] + theta))
        return [collections.Counter({c: int(v) for c, v in enumerate(r) if v}) for r in x], above.sum(axis=1)

    rows, grades = draw(600)
    got_w, got_theta = toxicity.fit(rows, grades, 3)

    def loss(w, theta):
        z = np.array([sum(w[c] * np.log1p(n) for c, n in r.items()) for r in rows])[:, None] - theta
        y = grades[:, None] >= np.arange(1, 4)
        return (np.logaddexp(0, z) - y * z).sum(axis=1).mean() + 1e-4 * (w**2).sum()

    best = loss(got_w, got_theta)
    for i in range(3):
        for step in (-0.05, 0.05):
            e = np.eye(3)[i] * step
            assert loss(got_w + e, got_theta) > best - 1e-4 and loss(got_w, got_theta + e) > best - 1e-4
    assert np.corrcoef(got_w, w)[0, 1] > 0.9


def test_severity_rises_with_toxic_content_on_held_out_documents(spark):
    """Severity is measured on documents that teach nothing: clean text with 0, 2, 8 and 30 of the words that mark toxic documents."""
    p = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{p}/documents.parquet").join(spark.read.parquet(f"{p}/labels.parquet").select("doc_id"), "doc_id", "left_semi"), spark.read.parquet(f"{p}/labels.parquet")
    model = toxicity.train(d, labels)
    strongest = sorted(model.columns.items(), key=lambda x: -model.w[x[1]])
    texts = [r["text"] for r in d.join(labels.filter("toxic = 1"), "doc_id").limit(200).collect()]
    of = toxicity.WordFeatures()
    top = {h for h, _ in strongest[:300]}
    words = sorted({x for t in texts for x in t.encode().split() if set(of[x]) & top})[:60]
    clean = next(r["text"] for r in d.join(labels.filter("toxic = 0 AND quality = 1"), "doc_id").collect() if 500 < len(r["text"]) < 2000)
    made = [" ".join([clean, *(w.decode() for w in words[:n])]).encode() for n in (0, 2, 8, 30)]
    columns = toxicity.ColumnsOf(model.columns)
    severity = model.above([toxicity._counts(t, columns) for t in made]).sum(axis=1)
    assert len(words) >= 30 and (np.diff(severity) > 0).all() and severity[0] < 0.5 < severity[-1]


def test_column_counts_match_brute_force():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["badword", "badwords", "good", "Bad!", "worse,"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(50)]
    of = toxicity.WordFeatures()
    columns = {h: i for i, h in enumerate(sorted({h for w in (b"badword", b"worse") for h in of[w]}))}
    fast = toxicity.ColumnsOf(columns)
    for t in texts:
        want = collections.Counter(columns[h] for w in t.split() for h in of[w] if h in columns)
        assert toxicity._counts(t, fast) == want
    assert toxicity._counts(None, fast) == collections.Counter()


def test_toxicity_edge_cases(spark):
    d = docs(spark, [(1, None, "a"), (None, "bad bad", "a"), (1, None, "a")]).withColumn("grade", F.lit("clash"))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.grade(d, labels).collect()
    assert len(got) == 3 and all(r["severity"] == 0 and r["kept"] for r in got)
    assert toxicity.grade(d.limit(0), labels).count() == 0


# 5 quality rules


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    covered = {p for i, t in enumerate(tri) if n[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "é è x", "a a a a", "a b c a b c", "#|<> x\n#|<> x\n\n \ny"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))).replace("b c", "b\nc") for _ in range(60)]
    d = docs(spark, [(i, t, None) for i, t in enumerate(texts)]).withColumn("n_words", F.lit("clash"))
    for r in quality_rules.apply_rules(d).collect():
        n = brute_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, texts[r["doc_id"]]
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(d.limit(0)).count() == 0


def test_rules_keep_clean_documents(spark):
    p = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{p}/labels.parquet").filter("quality = 1")
    got = quality_rules.apply_rules(spark.read.parquet(f"{p}/documents.parquet").join(labels, "doc_id")).filter("n_words >= 50")
    assert got.filter("kept").count() >= 0.98 * got.count()


# 6 personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda: 12 <= len(d) <= 19 and pii.luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(8)
    pieces = ["a@b.c", "x", "@", ".", " ", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "12", "-", "é", "(", ")", "\n", "0", "00.0.0.000"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if fits(k, m[0]))
        assert pii.base_spans(t) == want, t


def test_long_runs_are_scanned_in_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "+1" + " " * 300_000):
        pii.base_spans(t)
        pii.nodes(t)


def test_the_field_adds_consistent_mentions_and_keeps_the_base(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").limit(3000)
    more = spark.createDataFrame([(10**9, "Call +1 (743) 555-3824 now, or again (743) 555-3824 later"), (10**9 + 1, None), (None, "no data")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(d.union(more)).collect()}
    r = got[10**9]
    assert r["spans"].startswith("phone:5:22") and "phone:37:51" in r["spans"] and r["n_phone"] == 1
    assert got[10**9 + 1]["spans"] == "" and got[10**9 + 1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    # what is added to real documents: the values that are assigned to the name of a secret, and next to nothing else
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    secrets = {i: {f"secret:{s}:{e}" for s, _, e in pii.seeds(t)} for i, t in texts.items()}
    found = {i: {x for x in got[i]["spans"].split(",") if x.startswith("secret")} for i in texts}
    assert sum(map(len, secrets.values())) > 20 and sum(len(found[i] & secrets[i]) for i in texts) >= 0.95 * sum(map(len, secrets.values()))
    assert sum(got[i]["n_added"] for i in texts) - sum(len(found[i] & secrets[i]) for i in texts) < 10
    assert all(got[i]["n_secret"] == len(found[i]) and got[i]["personal"] == bool(got[i]["spans"]) for i in texts)
    assert pii.find(d.limit(0)).count() == 0


def _planted(rng):
    """(kind, value) of entities that no training text holds."""
    card = next(c for c in iter(lambda: "".join(rng.choice("0123456789") for _ in range(16)), "") if pii.luhn(c))
    return (
        (0, f"{rng.choice(['ann', 'bo.lee', 'kim'])}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.org"),
        (1, ".".join(str(rng.randint(1, 255)) for _ in range(4))),
        (2, card),
        (3, f"+1 ({rng.randint(100, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"),
        (4, "".join(rng.choice("0123456789abcdef") for _ in range(40))),
    )


def test_the_field_finds_planted_forms_that_the_patterns_miss(spark):
    """Recall and precision on forms of unseen entities in documents that teach nothing: the base patterns find none of them."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    field = pii.train(d.filter("doc_id % 2 = 0"))
    hosts = [r["text"] for r in d.filter("doc_id % 2 = 1").limit(1500).collect() if not pii.nodes(r["text"]) and len(r["text"]) > 300]
    assert len(hosts) > 300
    assert sum(len(a) for _, a in pii.complete(hosts, field)) == 0
    rng = random.Random(11)
    hits, base_hits, wrong, n = collections.Counter(), 0, 0, 0
    for host in hosts[:60]:
        cut = host.find(" ", len(host) // 2)
        for kind, value in _planted(rng):
            form, miss = pii.other_form(kind, value, rng.randint(0, 3)), pii.near_miss(kind, value, rng.randint(0, 999))
            lead = ' key = "' if kind == pii.SECRET else " "
            texts = {"alone": host[:cut] + lead + form + '" ' + host[cut:], "repeated": value + " " + host[:cut] + " " + form + host[cut:], "miss": host[:cut] + " " + miss + host[cut:]}
            for name, (base, spans) in zip(texts, pii.complete(list(texts.values()), field)):
                at = texts[name].index(miss if name == "miss" else form, 0 if name != "repeated" else len(value))
                held = [k for s, k, e in spans if s < at + len(miss if name == "miss" else form) and e > at]
                hits[name] += kind in held if name != "miss" else 0
                wrong += bool(held) if name == "miss" else sum(k != kind for k in held)
                base_hits += any(s < at + len(form) and e > at for s, _, e in base) if name != "miss" else 0
            n += 1
    assert hits["alone"] > 0.85 * n and hits["repeated"] > 0.85 * n, (hits, n)
    assert base_hits < 0.05 * n and wrong < 0.03 * 3 * n, (base_hits, wrong, n)


def test_skip_edges_carry_labels_to_forms_that_were_never_trained(spark):
    """An address in a form that no training text has is found beside a clear mention, with the learned potentials, and not alone."""
    field = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    filler = "and then much later in this long text it says "
    n = alone = beside = without = 0
    cut = pii.Field(field.w, field.bias, np.where(np.arange(4)[:, None, None] >= 2, 0, 0) * field.pair)
    for _, value in (x for seed in range(30) for x in _planted(random.Random(seed))[:1]):
        odd = value.replace("@", "=AT=")
        alone += any(s for s in pii.complete([filler + odd], field)[0][1])
        beside += len(pii.complete([f"{filler}{value} {filler * 20}{odd} end"], field)[0][1]) >= 2
        without += len(pii.complete([f"{filler}{value} {filler * 20}{odd} end"], cut)[0][1]) >= 2
        n += 1
    assert beside >= without and beside >= alone, (alone, beside, without, n)


def test_messages_are_near_exact_marginals_on_graphs_with_loops():
    rng = np.random.default_rng(4)
    for _ in range(20):
        k, n = 3, 5
        f = pii.Field(None, None, rng.normal(0, 0.25, (2, k, k)))
        u = rng.normal(0, 1, (n, k))
        edges = [(i, j, int(rng.integers(2))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            p = np.exp(sum(u[i, y[i]] for i in range(n)) + sum(f.pair[e, y[i], y[j]] for i, j, e in edges))
            for i in range(n):
                want[i, y[i]] += p
        got = f.marginals(u, *np.array(edges, np.int64).reshape(-1, 3).T)
        assert np.abs(got - want / want.sum(axis=1, keepdims=True)).max() < 0.05


def test_personal_data_edge_cases(spark):
    d = docs(spark, [(1, None, "a"), (1, None, "a"), (None, "a@b.example 1.2.3.4", "a"), (2, "", "a"), (3, "x1 " * 60_000, "a")])
    d = d.withColumns({"spans": F.lit("clash"), "n_email": F.lit("clash"), "labels": F.lit(0)}).union(d.limit(0).withColumns({"spans": F.lit(""), "n_email": F.lit(""), "labels": F.lit(0)}))
    got = pii.find(d).collect()
    assert len(got) == 5 and all(r["spans"] == "" for r in got if r["doc_id"] in (1, 2))
    assert [r["spans"] for r in got if r["doc_id"] is None] == ["email:0:11,ip:12:19"]


def test_messages_equal_exact_marginals_on_a_tree():
    rng = np.random.default_rng(1)
    f = pii.Field(None, None, rng.normal(0, 1, (2, 5, 5)))
    u = rng.normal(0, 1, (3, 5))
    i, j, k = np.array([0, 1]), np.array([1, 2]), np.array([0, 1])
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2] + f.pair[0][:, :, None] + f.pair[1][None])
    want = np.stack([joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))]) / joint.sum()
    pii.ROUNDS, old = 60, pii.ROUNDS
    assert np.allclose(f.marginals(u, i, j, k), want, atol=1e-6)
    pii.ROUNDS = old


def test_one_clear_mention_reaches_fifty_others_in_any_order():
    w, bias, pair = np.zeros((pii.HASHED, 5)), np.array([1.0, 0, 0, 0, 0]), np.zeros((2, 5, 5))
    w[pii._columns(("quad",))[0], 2] = 6
    pair[1] = np.eye(5) * 3.5 - 1.75
    field = pii.Field(w, bias, pair)
    clear, other = "see 10.20.30.40 now", "or 10-20-30-40 later"
    alone = pii.complete([" ".join([other] * 50)], field)[0]
    assert alone == ([], [])
    for at in (0, 1, 25, 50):
        t = " ".join([other] * at + [clear] + [other] * (50 - at))
        (base, got), again = pii.complete([t, "x 1"], field)[0], pii.complete([t], field)[0]
        assert len(base) == 1 and len(got) == 51 and (base, got) == again
        assert all(t[s:e] in ("10.20.30.40", "10-20-30-40") and k == 1 for s, k, e in got)


# 7 line dedup


def test_boilerplate_stays_in_its_first_document_only(spark):
    line = "this is a shared line"
    rows = [(i, f"own text of number {i}\n  {line}\nshort one", f"s{i % 4}") for i in range(1, 9)]
    rows += [(20, line, None), (21, None, "s1"), (22, "", "s1"), (None, f"{line}\nx", "s0"), (3, f"{line}", "s9")]
    got = line_dedup.dedup_lines(docs(spark, rows), min_sites=5).withColumn("h", F.lit(1)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(rows)
    assert line in by[1][0]["text"] and by[1][0]["n_removed"] == 0
    assert by[2][0]["text"] == "own text of number 2\nshort one" and by[20][0]["text"] == "" and by[None][0]["text"] == "x"
    assert by[21][0]["text"] is None and by[21][0]["n_lines"] == 0 and by[22][0]["n_lines"] == 1
    left = line_dedup.dedup_lines(docs(spark, rows), min_sites=5, drop_emptied=True)
    assert left.count() == len(rows) - 2 and left.filter("doc_id = 22").count() == 1
    assert line_dedup.dedup_lines(docs(spark, rows), min_sites=7).filter("n_removed > 0").count() == 0
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# 8 mixing


def water_fill(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, live = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while live and left > 1e-9:
        total = sum(w[s] for s in live)
        over = 0.0
        for s in sorted(live, key=str):
            target[s] += left * w[s] / total
        left = 0
        for s in sorted(live, key=str):
            if target[s] >= 2 * sizes[s]:
                over += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                live.discard(s)
        left = over
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 10)), rng.choice(["a", "b", "c", "d", None, "a", "a"])) for i in range(1500)]
    rows += [(5, "", "e"), (None, "x y z", "c"), (7, None, "a"), rows[0], rows[0]]
    d = docs(spark, rows).withColumn("target", F.lit("clash"))
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water_fill(sizes)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 12 for s in sizes)
    key = lambda rs: sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in rs)
    assert key(got) == key(mixing.mix(d.repartition(13)).collect())
    copies = mixing.take(d)
    assert copies.columns == d.columns and copies.count() == sum(r["copies"] for r in got)


def test_mix_without_words(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    got = mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert len(got) == 2 and all(r["taken"] == 0 and r["target"] == 0 for r in got)


# 9 near duplicates


def brute_components(rows, width, percent=80):
    sets = []
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w and i is not None else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    parent[find(a)] = find(b)
    low = collections.defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return [(i, min(low[find(k)]) if i is not None else None) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(1000, None, "s"), (1001, "", "s"), (1002, " \n", "s"), (1003, "One two", "s"), (1004, "one  TWO", "s"), (None, "one two", "s"), (1005, "Ä b c d e", "s"), (1006, "ä b c d e", "s")]
    for base in range(12):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([8, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w), "s"))
    rows.append(rows[20])
    got = near_dup.near_duplicates(docs(spark, rows).withColumn("key", F.lit(1)), width=width).collect()
    pairs = lambda x: sorted(((i is None, i or 0), (c is None, c or 0)) for i, c in x)
    assert pairs((r["doc_id"], r["component_id"]) for r in got) == pairs(brute_components(rows, width))
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_a_large_family_of_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(words)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w), "s"))
    got = near_dup.near_duplicates(docs(spark, rows), width=4).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(brute_components(rows, 4))


def test_components_of_long_paths(spark):
    rng = random.Random(6)
    path = [(i, i + 1) for i in range(4999)]
    far = [(10_000 + i, 10_000 + j) for i in range(1000) for j in range(i + 1, min(i + 5, 1000))]
    ids = rng.sample(range(20_000, 30_000), 3000)
    mixed = list(zip(ids, ids[1:]))
    e = path + far + mixed + [(40_000, 40_000), (None, 3)]
    got = {r["v"]: r["comp"] for r in components.connected(spark.createDataFrame(e, "a long, b long")).collect()}
    want = dict.fromkeys(range(5000), 0) | dict.fromkeys(range(10_000, 11_000), 10_000) | dict.fromkeys(ids, min(ids))
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (9, None, "s"), (None, "a b", "s")]
    got = sorted((r["doc_id"] or 0) for r in near_dup.keep_one(docs(spark, rows)).collect())
    assert got == [0, 2, 9]
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


# 10 media is in test_webp.py


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "\0", "long " * 300_000]
    d = docs(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, "a", None)]).withColumn("media", F.lit(1))
    stored = media.store_texts(d)
    got = {r["doc_id"]: r for r in media.describe(stored).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        p = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[0]["feature"] == got[1]["feature"] and got[None]["media_sha256"] == got[2]["media_sha256"]
    px = media.pixels(stored.filter("doc_id = 3").union(d.limit(1).select(F.lit(77).cast("long"), F.lit(0).cast("long"), F.lit(b"RIFFxxxxjunk").cast("binary"))), "doc_id", "media").collect()
    by = {r["doc_id"]: r for r in px}
    assert (by[3]["width"], by[3]["height"], by[3]["error"]) == (16, 4, None) and by[77]["error"] and by[77]["pixels"] is None
    assert media.describe(media.store_texts(d.limit(0))).count() == 0
