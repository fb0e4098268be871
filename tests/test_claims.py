"""Hand-computed cases of visual and motion claims."""

from quillspan.operators import claims as C

GOLD = "case_id string, direction string, first_actor string, second_actor string, supported array<string>"
LABELS = "case_id string, labels array<string>"
EXPECTED = "case_id string, n int, actors array<string>, action string, start_ms long, end_ms long"
CLAIMS = "case_id string, claim_id int, text string, start_ms long, end_ms long"
PREDICTED = "case_id string, label string"


def motion(spark, gold, labels, expected, claims, predicted):
    make = spark.createDataFrame
    r = C.motion_metrics(make(gold, GOLD), make(labels, LABELS), make(expected, EXPECTED), make(claims, CLAIMS), make(predicted, PREDICTED))
    return {x["case_id"]: x for x in r.collect()}


def test_motion_with_aliases_and_supported_terms(spark):
    got = motion(
        spark,
        [("m", "left", "ball", "box", ["shadow"])],
        [("m", ["ball", "sphere"]), ("m", ["box"])],
        [("m", 0, ["ball", "sphere"], "move_left", 0, 1000)],
        [("m", 1, "Sphere moves_left", 100, 900), ("m", 2, "a dog appears", None, None), ("m", 3, "the box halts", 500, 700), ("m", 4, "ball", 50, 60)],
        [("m", "red sphere"), ("m", "shadow"), ("m", "dog")],
    )["m"]
    assert got["entity_correctness"] == 0.5 and got["n_hallucinated"] == 1
    assert got["action_correct"] and got["temporal_correct"] and got["localisation_error"] == 100
    assert got["unsupported_rate"] == 4 / 7  # the dog as entity, and three of four claims
    assert got["direction_correct"] and got["order_correct"]


def test_motion_without_expected_events(spark):
    gold = [(c, None, None, None, None) for c in "abcd"]
    labels = [(c, ["box"]) for c in "abcd"]
    got = motion(spark, gold, labels, [], [("a", 1, "the box is still", None, None), ("b", 1, "the box vanishes", None, None), ("c", 1, "a dog vanishes", 5, 9)], [])
    assert [got[c]["action_correct"] for c in "abcd"] == [True, False, True, True]
    assert [got[c]["temporal_correct"] for c in "abcd"] == [True, True, False, True]
    assert [got[c]["unsupported_rate"] for c in "abcd"] == [1, 1, 1, 0] and got["a"]["direction_correct"] is None


def test_all_terms_of_a_pattern(spark):
    texts = ["moves to the left", "it is left", "向左", "no longer visible", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [sorted(x[0]) for x in got.select("i", C.claimed_actions(got["t"]).alias("c")).orderBy("i").select("c").collect()]
    assert got == [["move_left"], [], ["move_left"], ["disappear"], []]


def test_visual_evidence_and_rightward_moves(spark):
    make = spark.createDataFrame
    cases = ["range", "covered", "other segment", "late", "none"]
    gold = make([(c, ["ball"], "moves_right", "SALE", None, None) for c in cases], "case_id string, entities array<string>, action string, visible_text string, event_start long, event_end long")
    actions = make([("range", "ball MOVED rightwards"), ("covered", "球 向右"), ("late", "moves left")], "case_id string, text string")
    ref = "array<struct<segment_id:string,observed_ms:long,start_ms:long,end_ms:long>>"
    texts = [
        ("range", "sale", "s", None, 0, 100, [("s", 99, None, None)]),
        ("covered", "Sale!", "s", None, 10, 100, [(None, None, 0, 100)]),
        ("other segment", "sale", "s", 5, None, None, [("t", 5, None, None)]),
        ("late", "sale", "s", None, 0, 100, [("s", 100, None, None)]),
        ("none", "sale", "s", 5, None, None, None),
    ]
    texts = make(texts, f"case_id string, text string, segment_id string, observed_ms long, start_ms long, end_ms long, refs {ref}")
    pairs, none = "case_id string, artifact_id string", make([], "case_id string, text string")
    got = C.visual_metrics(gold, none, actions, texts, make([], "case_id string, start_ms long, end_ms long"), make([("range", "x"), ("late", "y")], pairs), make([("range", "x"), ("covered", "y")], pairs))
    got = {x["case_id"]: x for x in got.collect()}
    assert [got[c]["text_evidence_correct"] for c in cases] == [True, True, False, False, False]
    assert [got[c]["action_correct"] for c in cases] == [True, True, False, False, False]
    assert [got[c]["evidence_integrity"] for c in cases] == [True, True, True, False, True]
