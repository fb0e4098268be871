"""Queries of the event-log operators: users as runs, events in order of their id."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspan.operators import event_log as E
from quillspan.plans.registry import ORACLE, QUERIES, adapt, query
from quillspan.plans.scratch import scratch_root
from quillspan.streaming import guards

_KIND = "CASE WHEN event_id % 97 = 0 THEN 'terminal' WHEN event_id % 5 = 0 THEN 'plan' WHEN event_id % 5 = 1 THEN 'budget' WHEN event_id % 5 = 2 THEN 'edit' ELSE 'observation' END"
LOG = f"""SELECT user_id AS run_id, event_id AS arrival, CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END AS task_id, 0 AS run_task, CASE WHEN event_id % 101 = 0 THEN -user_id ELSE event_id END AS event_id,
  n + CASE WHEN event_id % 83 = 0 THEN 1 ELSE 0 END AS sequence_no, n - 1 + CASE WHEN event_id % 83 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END AS parent_version,
  {_KIND} AS kind, CASE WHEN event_id % 5 = 0 THEN sum(CASE WHEN {_KIND} = 'plan' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 85 = 0 THEN 1 ELSE 0 END END AS revision, event_id % 7 AS delta,
  event_type AS artifact_id, event_id % 3 <> 0 AS succeeded, event_type AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {{events}}) AS e"""


@query(
    "w1_log_audit",
    f"""WITH l AS ({LOG}), e AS (SELECT *, row_number() OVER (PARTITION BY run_id, event_id ORDER BY arrival) AS copy, coalesce(max(sequence_no) OVER b, 0) + 1 AS expected, coalesce(bool_or(kind = 'terminal') OVER b, false) AS ended,
      count(*) FILTER (kind = 'plan') OVER s AS revised, sum(CASE WHEN kind = 'budget' THEN delta ELSE 0 END) OVER s AS used FROM l
      WINDOW b AS (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    v AS (SELECT *, CASE WHEN task_id <> run_task THEN 'task_mismatch' WHEN copy > 1 THEN 'duplicate_event' WHEN sequence_no <> expected THEN 'sequence' WHEN parent_version <> sequence_no - 1 THEN 'parent_version' WHEN ended THEN 'after_terminal'
      WHEN kind = 'plan' AND revision <> revised THEN 'plan_revision' WHEN kind = 'budget' AND used > 40 THEN 'budget' END AS violation FROM e)
    SELECT run_id, arg_min(sequence_no, arrival) AS sequence_no, arg_min(violation, arrival) AS violation FROM v WHERE violation IS NOT NULL GROUP BY run_id""",
)
def w1(get):
    return E.audit_log(get(LOG), 40)


@query(
    "w2_final_state",
    f"""SELECT run_id, sum(CASE WHEN kind = 'budget' THEN delta ELSE 0 END)::BIGINT AS used, (arg_max(revision, sequence_no) FILTER (kind = 'plan'))::BIGINT AS plan_revision, arg_max(artifact_id, sequence_no) FILTER (kind = 'edit' AND succeeded) AS working_artifact,
      arg_max(reason, sequence_no) FILTER (kind = 'terminal') AS terminal_reason, max(sequence_no) AS last_sequence, count(*) AS n_events FROM ({LOG.replace("n + CASE WHEN event_id % 83 = 0 THEN 1 ELSE 0 END AS sequence_no", "n AS sequence_no")}) GROUP BY run_id""",
)
def w2(get):
    return E.fold_state(get(LOG.replace("n + CASE WHEN event_id % 83 = 0 THEN 1 ELSE 0 END AS sequence_no", "n AS sequence_no")))


CALLS = "SELECT user_id AS run_id, event_id, ts, event_type, event_id % 3 AS argument FROM {events}"


@query("w3_repeat_detection", f"SELECT event_id, row_number() OVER (PARTITION BY run_id, event_type, argument ORDER BY event_id) AS occurrence, occurrence > 3 AS alert FROM ({CALLS})")
def w3(get):
    return E.nth_repeat(get(CALLS), ["event_type", "argument"], "event_id", 3).select("event_id", "occurrence", "alert")


EDITS = "SELECT user_id AS run_id, event_id, event_type, CASE WHEN event_id % 4 = 0 THEN event_id % 40 END AS artifact, CASE WHEN event_id % 6 = 0 THEN event_id % 30 END AS verification FROM {events}"


@query(
    "w4_no_gain_edits",
    f"""WITH c AS ({EDITS}), m AS (SELECT *, (artifact IS NOT NULL AND row_number() OVER (PARTITION BY run_id, artifact ORDER BY event_id) = 1)::INT + (verification IS NOT NULL AND row_number() OVER (PARTITION BY run_id, verification ORDER BY event_id) = 1)::INT AS d FROM c),
    v AS (SELECT *, sum(d) OVER (PARTITION BY run_id ORDER BY event_id) AS version FROM m), g AS (SELECT *, coalesce(version > lag(version) OVER w, true) AS gain FROM v WINDOW w AS (PARTITION BY run_id, event_type ORDER BY event_id)),
    i AS (SELECT *, sum(gain::INT) OVER (PARTITION BY run_id, event_type ORDER BY event_id) AS island FROM g)
    SELECT event_id, version::BIGINT AS version, row_number() OVER (PARTITION BY run_id, event_type, island ORDER BY event_id) - 1 AS no_gain, no_gain >= 2 AS alert FROM i""",
)
def w4(get):
    v = E.information_version(get(EDITS), "event_id", "artifact", "verification")
    return E.no_gain_repeats(v, ["event_type"], "version", "event_id", 2).select("event_id", "version", "no_gain", "alert")


@query("w5_unchanged_plans", f"SELECT event_id, coalesce(event_type = lag(event_type) OVER w AND argument = lag(argument) OVER w, false) AS unchanged FROM ({CALLS}) WINDOW w AS (PARTITION BY run_id ORDER BY event_id)")
def w5(get):
    return E.unchanged_plans(get(CALLS), ["event_type", "argument"], "event_id").select("event_id", "unchanged")


@query("w7_curriculum_stage", f"SELECT event_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS position, CASE WHEN position < 2 THEN 'first' WHEN position < 6 THEN 'middle' ELSE 'late' END AS stage FROM ({CALLS})")
def w7(get):
    return E.stages(get(CALLS), "run_id", "event_id", [(2, "first"), (6, "middle")], "late").select("event_id", "position", "stage")


@query("w8_rollout_groups", f'SELECT event_id, (row_number() OVER w - 1) // 4 AS "group", (row_number() OVER w - 1) % 4 AS place FROM ({CALLS}) WINDOW w AS (PARTITION BY run_id ORDER BY event_id)')
def w8(get):
    return E.rollout_groups(get(CALLS), "run_id", "event_id").select("event_id", "group", "place")


EDGES = "SELECT event_id AS child, CAST(floor(event_id / 3) AS BIGINT) AS parent FROM {events} UNION ALL SELECT event_id AS child, event_id + 1 AS parent FROM {events} WHERE event_id % 50 = 7"
STARTS = "SELECT event_id AS start FROM {events} WHERE event_id % 50 = 0"


@query(
    "j8_lineage",
    f"""WITH RECURSIVE e AS ({EDGES}), r AS (SELECT start, start AS node FROM ({STARTS}) UNION SELECT r.start, e.parent FROM r JOIN e ON r.node = e.child)
    SELECT start, count(*) AS n_ancestors, sum(node)::BIGINT AS node_sum FROM r GROUP BY start""",
)
def j8(get):
    return E.ancestors(get(EDGES), get(STARTS)).groupBy("start").agg(F.count(F.lit(1)).alias("n_ancestors"), F.sum("node").alias("node_sum"))


CITED = "SELECT user_id AS run_id, event_id % 50 AS evidence_id, event_id FROM {events}"
SEEN_A = "SELECT user_id AS run_id, event_id % 35 AS evidence_id FROM {events}"
SEEN_B = "SELECT user_id AS run_id, event_id % 20 + 25 AS evidence_id FROM {events}"


@query("j9_unknown_citations", f"SELECT event_id, run_id, evidence_id FROM ({CITED}) c WHERE NOT EXISTS (SELECT 1 FROM (({SEEN_A}) UNION ALL ({SEEN_B})) s WHERE s.run_id = c.run_id AND s.evidence_id = c.evidence_id)")
def j9(get):
    return E.unknown_citations(get(CITED), [get(SEEN_A), get(SEEN_B)]).select("event_id", "run_id", "evidence_id")


STEP = "SELECT user_id AS run_id, event_id AS seq FROM {{events}} WHERE event_type = '{0}' AND event_id % {1} = 0"
CHAIN = [STEP.format("error", 7), STEP.format("view", 11), STEP.format("purchase", 13)]


@query(
    "j10_first_match_after",
    f"""WITH a AS (SELECT run_id, min(seq) AS seq_0 FROM ({CHAIN[0]}) GROUP BY 1), b AS (SELECT a.*, (SELECT min(seq) FROM ({CHAIN[1]}) s WHERE s.run_id = a.run_id AND s.seq > a.seq_0) AS seq_1 FROM a)
    SELECT b.*, (SELECT min(seq) FROM ({CHAIN[2]}) s WHERE s.run_id = b.run_id AND s.seq > b.seq_1) AS seq_2 FROM b""",
)
def j10(get):
    return E.first_after([get(c) for c in CHAIN])


def _stream(spark, sf_dir):
    """The events table as a file stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/events[.]parquet")


def _is_folder(spark, path: str) -> bool:
    """Asked of Spark's own file system, so that any store does."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _run(spark, df):
    root = f"{scratch_root(spark)}/quillspan/stream-{uuid.uuid4().hex}"
    return guards.run_once(df, f"{root}/out", f"{root}/checkpoint")


def st1(spark, sf_dir):
    """Alerts of one run of the stream over all events; equal to W3 above the limit."""
    s = guards.timestamps(_stream(spark, sf_dir), "ts").select(F.col("user_id").cast("string").alias("run_id"), "event_id", "ts", F.concat_ws(":", "event_type", F.col("event_id") % 3).alias("fingerprint"))
    return _run(spark, guards.repeat_alerts(s, 3))


def st2(spark, sf_dir):
    s = guards.timestamps(_stream(spark, sf_dir), "ts")
    kind = F.when(F.col("event_id") % 97 == 0, "terminal").otherwise("step")
    return _run(spark, guards.order_guard(s.select(F.col("user_id").cast("string").alias("run_id"), "event_id", "ts", F.col("event_id").alias("sequence_no"), kind.alias("kind"), (F.col("event_id") % 7).alias("delta")), 100))


QUERIES["st1_repeat_alerts"] = st1
QUERIES["st2_order_guard"] = st2
ORACLE["st1_repeat_alerts"] = """SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, event_type || ':' || CAST(event_id % 3 AS VARCHAR) AS fingerprint,
  row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY event_id) AS occurrence FROM events QUALIFY occurrence > 3"""
ORACLE["st2_order_guard"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, coalesce(lag(event_id) OVER w, 0) AS last, sum(event_id % 7) OVER w AS used, coalesce(bool_or(event_id % 97 = 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended
  FROM events WHERE event_id > 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT run_id, event_id, CASE WHEN ended THEN 'after_terminal' ELSE 'gap' END AS violation FROM e WHERE ended OR event_id <> last + 1 UNION ALL SELECT run_id, event_id, 'over_budget' FROM e WHERE used > 100
  UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 'duplicate' FROM events WHERE event_id = 0"""


def _arrivals(spark, events, arrival, last=None):
    """The rows of ``events`` in three arrivals, cut at thirds of the number ``arrival``, and ``last`` in a fourth, each taken up by the stream before
    the next one comes: the folder that they are written to, and a function that runs a stream of it to its end so far."""
    root = f"{scratch_root(spark)}/quillspan/stream-{uuid.uuid4().hex}"
    dated = events.withColumn("__arrival", arrival.cast("double"))
    low, high = dated.approxQuantile("__arrival", [1 / 3, 2 / 3], 0.01) or (0.0, 0.0)
    at = F.col("__arrival")
    parts = [dated.filter(at <= low), dated.filter((at > low) & (at <= high)), dated.filter(at > high)]
    parts = [p.drop("__arrival") for p in parts] + ([last] if last is not None else [])

    def run(build):
        for p in parts:
            p.write.mode("append").parquet(f"{root}/in")
            out = guards.run_once(build(spark.readStream.schema(events.schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/checkpoint")
        return out

    return run


def st3(spark, sf_dir):
    """No-gain alerts of a stream that comes in three micro batches; equal to W4."""
    calls = adapt(spark, sf_dir, EDITS.replace("event_type,", "ts, event_type,"))
    calls = guards.timestamps(calls, "ts").select(F.col("run_id").cast("string"), "event_id", "ts", F.col("event_type").alias("fingerprint"), F.col("artifact").cast("string"), F.col("verification").cast("string"))
    run = _arrivals(spark, calls, F.col("event_id"))
    return run(lambda s: guards.no_gain_alerts(s, 2, ttl_minutes=10**7, delay="3650 days")).select("event_id", "version", "no_gain")


def st4(spark, sf_dir):
    """Order audit of a stream whose events come up to four hours late, over micro batches; equal to the audit of the sorted log."""
    events = guards.timestamps(adapt(spark, sf_dir, "SELECT * FROM {events}"), "ts")
    kind = F.when(F.col("event_id") % 97 == 0, "terminal").otherwise("step")
    log = events.select(F.col("user_id").cast("string").alias("run_id"), "event_id", "ts", F.col("event_id").alias("sequence_no"), kind.alias("kind"), (F.col("event_id") % 7).alias("delta"))
    end = log.agg(F.max("ts").alias("ts")).select(F.lit("end of stream").alias("run_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(1).cast("long").alias("sequence_no"), F.lit("step").alias("kind"), F.lit(0).cast("long").alias("delta"))
    run = _arrivals(spark, log, F.unix_timestamp("ts") + F.col("event_id") % 5 * 3600, end.select(log.columns))
    out = run(lambda s: guards.ordered_audit(s, 100, ttl_minutes=10**7, delay="6 hours"))
    return out.filter("event_id >= 0").select("run_id", "event_id", "violation")


QUERIES["st3_no_gain_alerts"] = st3
QUERIES["st4_late_events"] = st4
ORACLE["st3_no_gain_alerts"] = f"SELECT event_id, version, no_gain FROM ({ORACLE['w4_no_gain_edits']}) WHERE alert"
ORACLE["st4_late_events"] = ORACLE["st2_order_guard"]
