"""Online guards over an event stream (ST1, ST2).

They hold a few numbers a key in Spark's state store, many keys in a hashed group; ``no_gain_alerts`` holds what a run has seen, and ``ordered_audit`` the events that may still be
overtaken. A watermark on the event time bounds the state: a
run that stays silent for ``ttl_minutes`` of event time is forgotten, and events later than the watermark are dropped by
Spark. The policy for late events is ours; the batch forms are ``event_log.nth_repeat`` and ``event_log.audit_log``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERTS = "run_id string, event_id long, fingerprint string, occurrence long"
GUARD = "run_id string, event_id long, violation string"
SHARDS = 1024  # groups of keys whose states lie together


def _dated(stream: DataFrame, delay: str) -> DataFrame:
    """The stream with its watermark, and the event time in milliseconds as ``at``."""
    return stream.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))


def _sharded(stream: DataFrame, delay: str, shards: int, *keys: str) -> DataFrame:
    return _dated(stream, delay).withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))


def _texts(values: Iterable) -> list:
    return [None if pd.isna(x) else x for x in values]


def _coded(held: list, came: Iterable) -> tuple[np.ndarray, list]:
    """Numbers of the values that came, and all values by number: those held keep their places, new ones follow."""
    codes, names = pd.factorize(np.array([*held, *came], dtype=object), use_na_sentinel=False)
    return codes[len(held) :], _texts(names)


def _grown(held: list, n: int, kind: type) -> np.ndarray:
    return np.concatenate([np.array(held, dtype=kind), np.zeros(n - len(held), dtype=kind)])


def _starts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by a number: whether a row is the first of its number, and where that first row is."""
    first = np.concatenate((np.ones(min(len(code), 1), bool), code[1:] != code[:-1]))
    return first, np.maximum.accumulate(np.where(first, np.arange(len(code)), 0)) if len(code) else np.zeros(0, np.int64)


def _in_order(code: np.ndarray, rows: pd.DataFrame, last: np.ndarray, used: np.ndarray, ended: np.ndarray, budget: int) -> dict[str, np.ndarray]:
    """What is wrong with ``rows`` (sequence_no, terminal, delta), which are sorted by run and number; the state of the runs, one place a run, is moved on."""
    if not len(code):
        return {}
    first, at = _starts(code)
    seq, terminal, delta = (rows[c].to_numpy() for c in ("sequence_no", "terminal", "delta"))
    before = np.where(first, last[code], np.maximum(last[code], np.concatenate(([0], seq[:-1]))))
    new = seq > before
    ends, cost = new & terminal, np.where(new, delta, 0)
    n_ends, spent = np.cumsum(ends), np.cumsum(cost)
    over = ended[code] | (n_ends - ends > n_ends[at] - ends[at])
    spent = used[code] + spent - (spent[at] - cost[at])
    tail = np.concatenate((first[1:], [True]))
    last[code[tail]], used[code[tail]], ended[code[tail]] = np.maximum(before, seq)[tail], spent[tail], (over | ends)[tail]
    return {"duplicate": ~new, "after_terminal": new & over, "gap": new & ~over & (seq != before + 1), "over_budget": new & (spent > budget)}


def repeat_alerts(stream: DataFrame, limit: int, ttl_minutes: int = 60, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """ST1: an alert for each event whose fingerprint occurred more than ``limit`` times in its run.

    stream: run_id string, event_id long, ts timestamp, fingerprint string. A key is a (run, fingerprint), with a counter and the time at which it is
    forgotten. Keys are held by ``shards`` hashed groups, each judged in whole arrays: a call a key costs far more than the few events it
    has, while a run with many fingerprints is still spread. Inside a micro batch events are taken by event_id."""
    names = ["run_id", "fingerprint", "seen", "until"]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        frames = [] if state.hasTimedOut else list(frames)
        held = pd.DataFrame(dict(zip(names, map(list, state.get), strict=True))) if state.exists else pd.DataFrame({n: [] for n in names})
        held = held.astype({"run_id": object, "fingerprint": object, "seen": np.int64, "until": np.int64})
        if frames:
            batch = pd.concat(frames)[["run_id", "fingerprint", "event_id", "at"]].sort_values("event_id", kind="stable")
            on = ["run_id", "fingerprint"]
            before = batch.merge(held[[*on, "seen"]], "left", on)["seen"].fillna(0).astype(np.int64).to_numpy()
            occurrence = before + batch.groupby(on, dropna=False).cumcount().to_numpy() + 1
            late = occurrence > limit
            if late.any():
                yield batch.loc[late, ["run_id", "event_id", "fingerprint"]].assign(occurrence=occurrence[late])
            # keys of this batch live on from here; others go when the watermark has passed their time
            batch = batch.assign(seen=occurrence)
            fresh = batch.groupby(on, dropna=False, as_index=False).agg(seen=("seen", "max"), until=("at", "max"))
            fresh["until"] = np.maximum(fresh["until"].astype(np.int64), watermark) + ttl_minutes * 60_000
            held = pd.concat([held, fresh]).drop_duplicates(on, keep="last")
        held = held[held["until"] >= watermark]
        if held.empty:
            state.remove()
            return
        state.update((_texts(held["run_id"]), _texts(held["fingerprint"]), held["seen"].tolist(), held["until"].tolist()))
        state.setTimeoutTimestamp(int(held["until"].min()))

    kept = "runs array<string>, fingerprints array<string>, seen array<long>, until array<long>"
    return _sharded(stream, delay, shards, "run_id", "fingerprint").groupBy("shard").applyInPandasWithState(update, ALERTS, kept, "append", GroupStateTimeout.EventTimeTimeout)


def order_guard(stream: DataFrame, budget: int, ttl_minutes: int = 60, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """ST2: duplicate, gap, after_terminal and over_budget events, as they arrive.

    stream: run_id string, event_id long, ts timestamp, sequence_no long, kind string, delta long. A sequence number at or below the last one
    (or none) is a duplicate; a gap moves the expectation on, so that one gap is one alert. Order is a property of a run, whose state is three values and
    the time at which it is forgotten. Runs lie in ``shards`` hashed groups, each judged in whole arrays, as in ``repeat_alerts``."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = [list(x) for x in state.get] if state.exists else [[], [], [], [], []]
        frames = [] if state.hasTimedOut else list(frames)
        batch = pd.concat(frames) if frames else None
        code, runs = _coded(held[0], [] if batch is None else batch["run_id"])
        last, used, ended, until = (_grown(x, len(runs), kind) for x, kind in zip(held[1:], (np.int64, np.int64, bool, np.int64), strict=True))
        if batch is not None:
            rows = pd.DataFrame({
                "run": code, "event_id": batch["event_id"].array, "sequence_no": batch["sequence_no"].fillna(np.iinfo(np.int64).min).astype(np.int64).array,
                "terminal": (batch["kind"] == "terminal").array, "delta": batch["delta"].fillna(0).astype(np.int64).array, "at": batch["at"].array,
            }).sort_values(["run", "sequence_no", "event_id"], kind="stable")
            code = rows["run"].to_numpy()
            found = _in_order(code, rows, last, used, ended, budget)
            # runs of this batch live on from here; others go when the watermark has passed their time
            latest = rows.groupby("run")["at"].max()
            until[latest.index] = np.maximum(latest.to_numpy(np.int64), watermark) + ttl_minutes * 60_000
            names = np.array(runs, dtype=object)
            out = [pd.DataFrame({"run_id": names[code[hit]], "event_id": rows["event_id"][hit], "violation": name}) for name, hit in found.items() if hit.any()]
            if out:
                yield pd.concat(out)
        stay = np.flatnonzero(until >= watermark)
        if not len(stay):
            state.remove()
            return
        state.update(([runs[i] for i in stay], *[x[stay].tolist() for x in (last, used, ended, until)]))
        state.setTimeoutTimestamp(int(until[stay].min()))

    kept = "runs array<string>, last array<long>, used array<long>, ended array<boolean>, until array<long>"
    return _sharded(stream, delay, shards, "run_id").groupBy("shard").applyInPandasWithState(update, GUARD, kept, "append", GroupStateTimeout.EventTimeTimeout)


NO_GAIN = "run_id string, event_id long, fingerprint string, version long, no_gain long"
AUDIT = "run_id string, event_id long, sequence_no long, violation string"


def _first_seen(code: np.ndarray, values: pd.Series, held: list) -> tuple[np.ndarray, list]:
    """Whether a row, in order, is the first of its run with its value (null is none), and all (runs by number, values) seen so far."""
    table = pd.DataFrame({"run": np.concatenate([np.array(held[0], np.int64), code]), "value": np.array([*held[1], *values], dtype=object)})
    new = (table["value"].notna() & ~table.duplicated()).to_numpy()
    return new[len(held[0]) :], [table["run"][new].tolist(), table["value"][new].tolist()]


def no_gain_alerts(stream: DataFrame, limit: int, ttl_minutes: int = 60, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """ST1 for W4: an alert for each edit that repeats an earlier one of its run ``limit`` times or more in a row without new information.

    stream: run_id string, event_id long, ts timestamp, fingerprint string, artifact string, verification string. The information version is the
    number of distinct artifacts and of distinct verifications of the run so far. The state of a run is the sets of both, for each
    fingerprint the last version and the count, and the time at which it is forgotten; runs lie in ``shards`` hashed groups, each judged in whole arrays. Inside
    a micro batch events are taken by event_id; micro batches in the order in which they come."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = [list(x) for x in state.get] if state.exists else [[] for _ in range(10)]
        frames = [] if state.hasTimedOut else list(frames)
        batch = pd.concat(frames).sort_values("event_id", kind="stable") if frames else None
        code, runs = _coded(held[0], [] if batch is None else batch["run_id"])
        until = _grown(held[1], len(runs), np.int64)
        artifacts, verifications, prints = held[2:4], held[4:6], pd.DataFrame(dict(zip(("run", "name", "version", "count"), held[6:], strict=True)))
        if batch is not None:
            order = np.argsort(code, kind="stable")
            batch, code = batch.iloc[order], code[order]
            seen = np.bincount(np.array([*artifacts[0], *verifications[0]], np.int64), minlength=len(runs))
            fresh, artifacts = _first_seen(code, batch["artifact"], artifacts)
            checked, verifications = _first_seen(code, batch["verification"], verifications)
            _, at = _starts(code)
            gained = fresh.astype(np.int64) + checked
            total = np.cumsum(gained)
            version = seen[code] + total - (total[at] - gained[at])
            # the rows of a fingerprint stand together, after what is held of it with a version and a count
            rows = pd.DataFrame({"run": code, "name": batch["fingerprint"].array, "version": version, "count": 0, "place": np.arange(len(code))})
            both = pd.concat([prints.assign(place=-1), rows]) if len(prints) else rows
            both["group"] = pd.factorize(pd.MultiIndex.from_arrays([both["run"], _coded([], both["name"])[0]]))[0]
            both = both.sort_values(["group", "place"], kind="stable")
            first, _ = _starts(both["group"].to_numpy())
            now, place = both["version"].to_numpy(np.int64), both["place"].to_numpy()
            starts = first | (now > np.concatenate(([0], now[:-1])))
            origin = np.maximum.accumulate(np.where(starts, np.arange(len(now)), 0))
            both["count"] = np.arange(len(now)) - origin + both["count"].to_numpy(np.int64)[origin]
            hit = (place >= 0) & (both["count"].to_numpy() >= limit)
            if hit.any():
                which = place[hit]
                yield pd.DataFrame({"run_id": np.array(runs, dtype=object)[code[which]], "event_id": batch["event_id"].to_numpy()[which], "fingerprint": batch["fingerprint"].to_numpy()[which], "version": version[which], "no_gain": both["count"].to_numpy()[hit]})
            prints = both[np.concatenate((first[1:], [True]))]
            latest = pd.Series(batch["at"].to_numpy()).groupby(code).max()
            until[latest.index] = np.maximum(latest.to_numpy(np.int64), watermark) + ttl_minutes * 60_000
        stay = until >= watermark
        if not stay.any():
            state.remove()
            return
        number = np.cumsum(stay) - 1
        kept = lambda rows, *columns: [number[np.array(rows, np.int64)[stay[np.array(rows, np.int64)]]].tolist(), *[[x for x, i in zip(c, rows, strict=True) if stay[i]] for c in columns]]
        lists = prints["run"].tolist(), _texts(prints["name"]), prints["version"].tolist(), prints["count"].tolist()
        state.update(([x for x, here in zip(runs, stay, strict=True) if here], until[stay].tolist(), *kept(*artifacts), *kept(*verifications), *kept(*lists)))
        state.setTimeoutTimestamp(int(until[stay].min()))

    kept = (
        "runs array<string>, until array<long>, artifact_runs array<long>, artifacts array<string>, verification_runs array<long>, verifications array<string>, "
        "print_runs array<long>, prints array<string>, versions array<long>, counts array<long>"
    )
    return _sharded(stream, delay, shards, "run_id").groupBy("shard").applyInPandasWithState(update, NO_GAIN, kept, "append", GroupStateTimeout.EventTimeTimeout)


def ordered_audit(stream: DataFrame, budget: int, ttl_minutes: int = 60, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """ST2 with late events: duplicate, gap, after_terminal and over_budget events in the order of sequence numbers, not of arrival.

    stream as in ``order_guard``. An event is held back until the watermark has passed it, so whatever comes within the delay takes its place; events are
    then judged by (sequence_no, event_id). A copy (an event_id that the run has among what it holds or has just judged) and any other event at or below the
    last number are duplicates. Events later than the watermark are dropped by Spark. A run that stays silent for ``ttl_minutes`` is forgotten. Runs lie in
    ``shards`` hashed groups, each judged in whole arrays."""
    names = ["run", "event_id", "at", "sequence_no", "terminal", "delta"]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = [list(x) for x in state.get] if state.exists else [[] for _ in range(11)]
        frames = [] if state.hasTimedOut else list(frames)
        batch = pd.concat(frames) if frames else None
        code, runs = _coded(held[0], [] if batch is None else batch["run_id"])
        last, used, ended, latest = (_grown(x, len(runs), kind) for x, kind in zip(held[1:5], (np.int64, np.int64, bool, np.int64), strict=True))
        pending = pd.DataFrame({c: np.array(x, bool if c == "terminal" else np.int64) for c, x in zip(names, held[5:], strict=True)})
        heard = np.zeros(len(runs), bool)
        heard[pending["run"]] = True
        heard[code] = True
        if batch is not None:
            numbers = {c: batch[c].astype(np.int64).array for c in ("event_id", "at")}
            fresh = pd.DataFrame({
                "run": code, **numbers, "sequence_no": batch["sequence_no"].fillna(np.iinfo(np.int64).min).astype(np.int64).array,
                "terminal": (batch["kind"] == "terminal").array, "delta": batch["delta"].fillna(0).astype(np.int64).array,
            })
            pending = pd.concat([pending, fresh], ignore_index=True)
            np.maximum.at(latest, code, fresh["at"].to_numpy())
        due = (pending["at"] < watermark).to_numpy()
        rows, pending = pending[due].sort_values(["run", "sequence_no", "event_id"], kind="stable"), pending[~due]
        code, title = rows["run"].to_numpy(), np.array(runs, dtype=object)
        out = [
            pd.DataFrame({"run_id": title[code[hit]], "event_id": rows["event_id"][hit], "sequence_no": rows["sequence_no"][hit], "violation": name})
            for name, hit in _in_order(code, rows, last, used, ended, budget).items()
            if hit.any()
        ]
        if out:
            yield pd.concat(out)
        # a run goes when it holds nothing, nothing came, and the watermark has passed its time
        silent = latest + ttl_minutes * 60_000
        stay = heard | (silent >= watermark)
        if not stay.any():
            state.remove()
            return
        number = np.cumsum(stay) - 1
        pending = pending.assign(run=number[pending["run"]])
        state.update(([x for x, here in zip(runs, stay, strict=True) if here], *[x[stay].tolist() for x in (last, used, ended, latest)], *[pending[c].tolist() for c in names]))
        # the watermark moves past the first held event, or a run falls silent
        wake = min(int(silent[stay].min()), int(pending["at"].min()) + 1 if len(pending) else np.iinfo(np.int64).max)
        state.setTimeoutTimestamp(max(wake, watermark + 1))

    kept = (
        "runs array<string>, last array<long>, used array<long>, ended array<boolean>, latest array<long>, "
        "held array<long>, ids array<long>, at array<long>, sequence_nos array<long>, terminals array<boolean>, deltas array<long>"
    )
    return _sharded(stream, delay, shards, "run_id").groupBy("shard").applyInPandasWithState(update, AUDIT, kept, "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, as Parquet under ``path``, and read the result back."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def timestamps(df: DataFrame, column: str) -> DataFrame:
    """Event times without a zone are taken as UTC of the session, as watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
