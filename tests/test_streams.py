"""Guards over several micro batches: state that lasts, events that come late, runs that fall silent."""

from __future__ import annotations

import datetime

from quillspan.streaming import guards

START = datetime.datetime(2024, 5, 1)
SCHEMA = "run_id string, event_id long, ts timestamp, sequence_no long, kind string, delta long, fingerprint string, artifact string, verification string"


def row(run, number, minute, kind="step", delta=0, fingerprint="f", artifact=None, verification=None, event_id=None):
    return (run, number if event_id is None else event_id, START + datetime.timedelta(minutes=minute), number, kind, delta, fingerprint, artifact, verification)


def batches(spark, folder, guard, *parts):
    """The output of a guard over parts that come one after another."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        out = guards.run_once(guard(stream), f"{folder}/out", f"{folder}/checkpoint")
    return out


END = [row("end", 1, 10_000)]


def test_an_event_of_a_later_batch_takes_its_place(spark, tmp_path):
    parts = [row("r", 1, 1), row("r", 3, 3)], [row("r", 2, 2), row("r", 5, 5), row("r", 4, 4, "terminal")], END
    got = batches(spark, tmp_path, lambda s: guards.ordered_audit(s, 10), *parts)
    assert {(r["event_id"], r["violation"]) for r in got.filter("run_id = 'r'").collect()} == {(5, "after_terminal")}


def test_copies_gaps_and_budgets_across_batches(spark, tmp_path):
    parts = [row("r", 1, 1, delta=6), row("r", 2, 2, delta=3)], [row("r", 2, 2, delta=3), row("r", 5, 5, delta=4)], [row("r", 1, 1)], END
    got = batches(spark, tmp_path, lambda s: guards.ordered_audit(s, 10), *parts)
    assert sorted((r["sequence_no"], r["violation"]) for r in got.filter("run_id = 'r'").collect()) == [(1, "duplicate"), (2, "duplicate"), (5, "gap"), (5, "over_budget")]


def test_events_later_than_the_watermark_are_dropped(spark, tmp_path):
    parts = [row("r", 1, 1), row("r", 3, 60)], [row("r", 2, 2)], END
    got = batches(spark, tmp_path, lambda s: guards.ordered_audit(s, 10), *parts)
    assert [(r["event_id"], r["violation"]) for r in got.filter("run_id = 'r'").collect()] == [(3, "gap")]


def test_counters_outlive_a_batch_and_silent_runs_are_forgotten(spark, tmp_path):
    same = lambda *ids: [row("r", i, i) for i in ids]
    got = batches(spark, tmp_path / "a", lambda s: guards.repeat_alerts(s, 3), same(1, 2), same(3, 4), same(5))
    assert sorted((r["event_id"], r["occurrence"]) for r in got.collect()) == [(4, 4), (5, 5)]
    # an hour of silence, seen by the watermark of another run, ends the state
    got = batches(spark, tmp_path / "b", lambda s: guards.repeat_alerts(s, 3), same(1, 2, 3), [row("other", 1, 500)], [row("other", 2, 501)], [row("r", 600, 600)])
    assert got.filter("run_id = 'r'").count() == 0


def test_no_gain_across_batches(spark, tmp_path):
    parts = (
        [row("r", 1, 1), row("r", 2, 2)],
        [row("r", 3, 3), row("r", 4, 4, artifact="a"), row("r", 5, 5, artifact="a")],
        [row("r", 6, 6, verification="v"), row("r", 7, 7), row("r", 8, 8, fingerprint="g"), row("q", 9, 9)],
        [row("r", 10, 10)],
    )
    got = batches(spark, tmp_path, lambda s: guards.no_gain_alerts(s, 2), *parts)
    # 1 starts, 2 and 3 repeat; 4 gains, 5 repeats; 6 gains, 7 and 10 repeat
    assert sorted((r["event_id"], r["version"], r["no_gain"]) for r in got.collect()) == [(3, 0, 2), (10, 2, 2)]


def test_keys_of_one_shard_keep_their_own_counters_and_times(spark, tmp_path):
    parts = (
        [row("r", 1, 1), row("r", 2, 2), row("r", 3, 3), row("q", 4, 4), row("r", 5, 5, fingerprint="g"), row(None, 6, 6)],
        [row("q", 7, 500)],
        [row("q", 8, 501), row(None, 9, 502)],
        [row("r", 600, 600), row("q", 601, 600), row("q", 602, 601)],
    )

    got = batches(spark, tmp_path, lambda s: guards.repeat_alerts(s, 3, shards=1), *parts)
    # r fell silent for an hour, q came with the batch in which its time had passed
    assert sorted((r["run_id"], r["event_id"], r["occurrence"]) for r in got.collect()) == [("q", 601, 4), ("q", 602, 5)]


def test_runs_of_one_shard_keep_their_own_order_budget_and_time(spark, tmp_path):
    parts = (
        [row("r", 1, 1, delta=6), row("q", 2, 2), row("r", 3, 3), row(None, 1, 4), row("q", 1, 5, event_id=51)],
        [row("r", 4, 6, "terminal", delta=6), row("q", 3, 500)],
        [row("r", 5, 501), row("q", 4, 501), row(None, 2, 501)],
    )
    got = batches(spark, tmp_path, lambda s: guards.order_guard(s, 10, ttl_minutes=10_000, shards=1), *parts)
    assert sorted((str(r["run_id"]), r["event_id"], r["violation"]) for r in got.collect()) == [("r", 3, "gap"), ("r", 4, "over_budget"), ("r", 5, "after_terminal"), ("r", 5, "over_budget")]


def test_no_gain_of_runs_in_one_shard(spark, tmp_path):
    parts = (
        [row("r", 1, 1, artifact="a"), row("q", 2, 2, artifact="a"), row("r", 3, 3), row("q", 4, 4, fingerprint=None), row(None, 5, 5)],
        [row("q", 6, 6, fingerprint=None), row("r", 7, 7), row("q", 8, 8, fingerprint=None, artifact="a"), row(None, 9, 9), row("q", 10, 10, artifact="b")],
        [row("r", 11, 11, artifact="a"), row(None, 12, 12), row("q", 13, 13), row("q", 14, 14, fingerprint=None)],
    )
    got = batches(spark, tmp_path, lambda s: guards.no_gain_alerts(s, 2, shards=1), *parts)
    assert sorted((str(r["run_id"]), r["event_id"], r["version"], r["no_gain"]) for r in got.collect()) == [("None", 12, 0, 2), ("q", 8, 1, 2), ("r", 7, 1, 2), ("r", 11, 1, 3)]


def test_late_events_of_runs_in_one_shard(spark, tmp_path):
    parts = [row("r", 1, 1, delta=6), row("q", 1, 1), row("r", 3, 3), row(None, 2, 3)], [row("r", 2, 2, delta=6), row("q", 3, 12), row("r", 4, 4, "terminal")], [row("q", 2, 11), row("r", 5, 12)], END
    got = batches(spark, tmp_path, lambda s: guards.ordered_audit(s, 10, shards=1), *parts)
    assert sorted((str(r["run_id"]), r["sequence_no"], r["violation"]) for r in got.filter("run_id IS NULL OR run_id <> 'end'").collect()) == [
        ("None", 2, "gap"), ("r", 2, "over_budget"), ("r", 3, "over_budget"), ("r", 4, "over_budget"), ("r", 5, "after_terminal"), ("r", 5, "over_budget")]
