"""Registered queries: Structured Streaming jobs over a replay of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import r6
from tidemark.plans.drift import adwin_sql
from tidemark.plans.registry import query
from tidemark.plans.views import SCORED_SQL, prop_k, scored, table
from tidemark.sources import logs as lg
from tidemark.streaming import live
from tidemark.workspace import new_path


def _feed(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return live.replay(spark, sf_dir, schema, pattern="events.parquet").withColumn("k", prop_k())


def _rule(df):
    """Stand-in for a model: the same decision for every row of a batch or a stream."""
    return df.withColumn("y_pred", F.when(F.col("k") < 40, "ATTACK").otherwise("BENIGN")).withColumn("confidence", 0.5 + F.col("k") / 78.0)


@query(
    "stream_score_log",
    """WITH e AS (SELECT event_id, user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
SELECT event_id, user_id, round(5e-1 + k / 78e0, 4) AS confidence,
  CASE WHEN 5e-1 + k / 78e0 > 9e-1 THEN 'high' WHEN 5e-1 + k / 78e0 > 7e-1 THEN 'medium' ELSE 'low' END AS severity FROM e WHERE k < 40""",
)
def stream_score_log(spark, sf_dir):
    root = new_path(spark, "feed")
    live.score_and_log(_feed(spark, sf_dir), _rule, root, f"{root}/checkpoint", event_id="event_id", user_id="user_id")
    return lg.read(spark, root, "attacks").select("event_id", "user_id", "confidence", "severity")


@query(
    "stream_flow_sessions",
    """WITH e AS (SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM e)
SELECT user_id, count(*) AS n_packets, CAST(sum(cents) AS BIGINT) AS bytes, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us
FROM s GROUP BY user_id, no""",
)
def stream_flow_sessions(spark, sf_dir):
    """Every session, also those still open when the feed ends."""
    feed = lambda: _feed(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    end = table(spark, sf_dir, "events").agg(F.max("ts") + F.expr("INTERVAL 2 HOURS")).first()[0]
    out = live.all_sessions(feed, ["user_id"], "ts", "cents", new_path(spark, "sessions"), "30 minutes", "1 minute", end)
    return out.select("user_id", "n_packets", "bytes", F.unix_micros("start_time").alias("start_us"), F.unix_micros("last_time").alias("last_us"))


@query(
    "stream_adwin",
    adwin_sql(SCORED_SQL, "event_type", "err", "scored")
    + """SELECT g AS event_type, pos, CAST(i AS BIGINT) AS n_seen, CAST(drifts AS BIGINT) AS n_drifts, CAST(n AS BIGINT) AS window_size,
  round(u / n, 6) AS estimation FROM drifts""",
)
def stream_adwin(spark, sf_dir):
    """The error signal replayed in at least four batches of positions, in order; the state goes from batch to batch."""
    rows = scored(spark, sf_dir).select("event_type", "pos", "err")
    root = new_path(spark, "monitor")
    feed = live.replay_positions(rows, max(1, -(-rows.count() // 4)), f"{root}/feed")
    found = live.monitor_drift(feed, "event_type", "pos", "err")
    live.run_through(found, lambda w: w.format("parquet").start(f"{root}/out"), "append", f"{root}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{root}/out").withColumn("estimation", r6("estimation"))


@query(
    "stream_replay",
    f"""WITH {SCORED_SQL}, m AS (SELECT max(pos) AS last, CAST(ceil(count(*) / 4e0) AS BIGINT) AS size FROM scored)
SELECT CAST(floor(pos / size) AS BIGINT) AS batch, count(*) AS n_rows, min(pos) AS first_pos, max(pos) AS last_pos FROM scored, m GROUP BY 1""",
)
def stream_replay(spark, sf_dir):
    """A paced replay: positions in batches of a fixed size; started again from its checkpoint."""
    rows = scored(spark, sf_dir).select("pos", "err")
    root, n = new_path(spark, "paced"), rows.count()
    size = max(1, -(-n // 4))

    def keep(batch, number):
        facts = batch.agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
        facts.filter("n_rows > 0").withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/out/number={number}")

    for _ in range(2):  # the second run goes on from the checkpoint and finds nothing new
        feed = live.replay_positions(rows, size, f"{root}/feed")
        live.run_through(feed, lambda w: w.foreachBatch(keep).start(), "append", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("batch", "n_rows", "first_pos", "last_pos")


@query(
    "stream_confidence_log",
    adwin_sql(SCORED_SQL, "event_type", "confidence", "scored", (0.5,))
    + """SELECT g AS event_type, pos AS stream_position, CAST(i AS BIGINT) AS n_seen, CAST(drifts AS BIGINT) AS n_drifts, round(u / n, 6) AS estimation FROM drifts""",
)
def stream_confidence_log(spark, sf_dir):
    """Live scoring with its drift log: confidences of every batch go to a lenient detector per event type."""
    rows = scored(spark, sf_dir).select("event_id", "ts", "event_type", "pos", "y_pred", "confidence")
    root = new_path(spark, "live")
    feed = live.replay_positions(rows, max(1, -(-rows.count() // 4)), f"{root}/feed")
    monitor = live.ConfidenceMonitor("event_type", "pos", delta=0.5)
    live.score_and_log(feed, lambda batch: batch, root, f"{root}/checkpoint", monitor=monitor, run=live.run_through, event_id="event_id")
    log = lg.read(spark, root, "drift_events", "event_type string, stream_position long, detector_state map<string,double>")
    state = F.col("detector_state")
    return log.select("event_type", "stream_position", state["n_seen"].cast("long").alias("n_seen"), state["n_drifts"].cast("long").alias("n_drifts"), r6(state["estimation"]).alias("estimation"))


@query(
    "stream_counters",
    """SELECT count(*) AS n_predictions, count(*) FILTER (WHERE CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) < 40) AS n_attacks FROM events""",
)
def stream_counters(spark, sf_dir):
    root = new_path(spark, "counters")
    totals = live.counters(_rule(_feed(spark, sf_dir)))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out")  # complete mode: the last batch holds the totals

    live.run_now(totals, lambda w: w.foreachBatch(keep).start(), "complete", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")
