"""Adapter views that give the given tables the roles the operators expect.

Every view is defined twice with the same meaning: as a DataFrame and as the text of SQL
common table expressions (``*_SQL``) for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import INF
from tidemark.operators.adapt import Periodic, Static
from tidemark.operators.ordering import global_position
from tidemark.operators.prequential import CellLearner, Grid, run_grid

ATTACK_TYPES = ("error", "signup")
DRIFT_AT = 0.6
FLOW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
FLOW_ORDER = ["Timestamp", *FLOW_KEY]
FLOW_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prop_k() -> Column:
    return F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")


# --- scored: a stream of labelled and predicted rows whose quality drops at 60 % ---------


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", prop_k().alias("k")
    )
    placed = global_position(events, ["event_id"], "pos", total="n")
    attack = F.col("event_type").isin(*ATTACK_TYPES)
    late = F.col("pos") >= F.floor(F.col("n") * F.lit(DRIFT_AT))
    hit = F.when(late, 40).otherwise(80)
    false_alarm = F.when(late, 30).otherwise(10)
    return (
        placed.withColumn("y_true", F.when(attack, "ATTACK").otherwise("BENIGN"))
        .withColumn("y_pred", F.when(F.col("k") < F.when(attack, hit).otherwise(false_alarm), "ATTACK").otherwise("BENIGN"))
        .withColumn("err", (F.col("y_true") != F.col("y_pred")).cast("int"))
        .withColumn("confidence", 0.5 + F.col("k") / 198.0)
    )


SCORED_SQL = """
placed AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n
  FROM events),
truth AS (
  SELECT *, CASE WHEN event_type IN ('error', 'signup') THEN 'ATTACK' ELSE 'BENIGN' END AS y_true,
         pos >= floor(n * 6e-1) AS late
  FROM placed),
pred AS (
  SELECT *, CASE WHEN k < CASE WHEN y_true = 'ATTACK' THEN CASE WHEN late THEN 40 ELSE 80 END
                               ELSE CASE WHEN late THEN 30 ELSE 10 END END
                 THEN 'ATTACK' ELSE 'BENIGN' END AS y_pred
  FROM truth),
scored AS (
  SELECT *, CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END AS err,
         5e-1 + k / 198e0 AS confidence
  FROM pred)"""


# --- flows: a wide table with a time stamp, id columns, features and three labels --------


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "N", "BENIGN").when(F.col("l_returnflag") == "R", "DDoS").otherwise("PortScan")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("Timestamp"), *FLOW_KEY, "l_discount", "l_tax", label.alias("Label")
    )


FLOWS_SQL = """
flows AS (
  SELECT l_shipdate AS "Timestamp", l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax,
         CASE l_returnflag WHEN 'N' THEN 'BENIGN' WHEN 'R' THEN 'DDoS' ELSE 'PortScan' END AS "Label"
  FROM lineitem)"""
FLOW_ORDER_SQL = '"Timestamp", l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice'


# --- dirty: events with planted defects -------------------------------------------------


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and infinite values, constant columns, mixed time shapes and untidy labels."""
    i = F.col("event_id")
    nan, inf = F.lit(float("nan")), F.lit(INF)
    base = table(spark, sf_dir, "events").withColumn("k", prop_k())
    return base.select(
        "event_id",
        F.col("user_id").alias("Source IP"),
        F.concat_ws("-", "user_id", "k").alias("Flow ID"),
        F.when(i % 61 == 7, "not a time").when(i % 3 == 0, F.date_format("ts", "d/M/yyyy H:mm"))
        .otherwise(F.date_format("ts", "d/M/yyyy H:mm:ss")).alias("Timestamp"),
        F.when(i % 97 == 0, None).when(i % 101 == 1, inf).when(i % 103 == 2, -inf).when(i % 107 == 3, nan)
        .otherwise(F.col("value")).alias("Flow Bytes/s"),
        F.when(i % 89 == 4, None).when(i % 83 == 5, inf).otherwise(F.col("k").cast("double")).alias("Flow Packets/s"),
        F.lit(7.0).alias("const_all"),
        F.when(i % 400 == 0, 1.0).otherwise(0.0).alias("const_most"),
        F.when(i % 211 == 6, None)
        .when(F.col("event_type") == "view", F.when(i % 2 == 0, "  Benign ").otherwise("benign"))
        .when(F.col("event_type") == "click", "BENIGN")
        .otherwise(F.concat(F.lit(" "), F.initcap("event_type"))).alias(" Label"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``planted`` with every fiftieth row repeated."""
    rows = planted(spark, sf_dir)
    return rows.unionByName(rows.filter(F.col("event_id") % 50 == 0))


DIRTY_SQL = """
planted AS (
  SELECT event_id, user_id AS "Source IP",
    user_id || '-' || regexp_extract(props, '"k": *([0-9]+)', 1) AS "Flow ID",
    CASE WHEN event_id % 61 = 7 THEN 'not a time' WHEN event_id % 3 = 0 THEN strftime(ts, '%-d/%-m/%Y %-H:%M')
         ELSE strftime(ts, '%-d/%-m/%Y %-H:%M:%S') END AS "Timestamp",
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 1 THEN CAST('inf' AS DOUBLE)
         WHEN event_id % 103 = 2 THEN CAST('-inf' AS DOUBLE) WHEN event_id % 107 = 3 THEN CAST('nan' AS DOUBLE)
         ELSE value END AS "Flow Bytes/s",
    CASE WHEN event_id % 89 = 4 THEN NULL WHEN event_id % 83 = 5 THEN CAST('inf' AS DOUBLE)
         ELSE CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) END AS "Flow Packets/s",
    7e0 AS const_all,
    CASE WHEN event_id % 400 = 0 THEN 1e0 ELSE 0e0 END AS const_most,
    CASE WHEN event_id % 211 = 6 THEN NULL
         WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN '  Benign ' ELSE 'benign' END
         WHEN event_type = 'click' THEN 'BENIGN'
         ELSE ' ' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS "Label"
  FROM events),
dirty AS (SELECT * FROM planted UNION ALL SELECT * FROM planted WHERE event_id % 50 = 0)"""


# --- packets: events as packets between users and seven hosts ---------------------------


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = prop_k()
    odd = k % 2 == 1
    src, dst = F.col("user_id").cast("string"), F.concat(F.lit("h"), (k % 7).cast("string"))
    base = table(spark, sf_dir, "events")
    return base.select(
        F.col("event_id").alias("packet_id"),
        # whole 64ths of a second, so that time differences are exact in every engine
        (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 15625) / 64.0).alias("time"),
        F.when(odd, dst).otherwise(src).alias("src"),
        F.when(odd, src).otherwise(dst).alias("dst"),
        F.when(k % 3 == 0, None).otherwise((1000 + k % 2).cast("string")).alias("tcp_srcport"),
        F.when(k % 3 == 0, None).when(k == 50, "bad").otherwise("443").alias("tcp_dstport"),
        F.when(k % 3 == 0, "53").alias("udp_srcport"),
        F.when(k % 3 == 0, "53").alias("udp_dstport"),
        F.when(k % 3 == 0, 17).otherwise(6).alias("proto"),
        F.when(F.col("event_id") % 131 == 0, None).otherwise(F.round("value").cast("long").cast("string")).alias("length"),
        F.when(k == 99, "zz").when(k == 98, None).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(k)))).alias("flags"),
        F.when(k > 20, (k * 100).cast("string")).alias("window"),
    )


PACKETS_SQL = """
kev AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events),
packets AS (
  SELECT event_id AS packet_id, floor(epoch_us(ts) / 15625) / 64e0 AS "time",
    CASE WHEN k % 2 = 1 THEN 'h' || (k % 7) ELSE CAST(user_id AS VARCHAR) END AS src,
    CASE WHEN k % 2 = 1 THEN CAST(user_id AS VARCHAR) ELSE 'h' || (k % 7) END AS dst,
    CASE WHEN k % 3 = 0 THEN 53 ELSE 1000 + k % 2 END AS srcport,
    CASE WHEN k % 3 = 0 THEN 53 WHEN k = 50 THEN 0 ELSE 443 END AS dstport,
    CASE WHEN k % 3 = 0 THEN 17 ELSE 6 END AS proto,
    CASE WHEN event_id % 131 = 0 THEN 0e0 ELSE round(value) END AS length,
    CASE WHEN k >= 98 THEN NULL ELSE k END AS flags,
    CASE WHEN k > 20 THEN k * 100e0 END AS win
  FROM kev)"""


# --- samples: class probabilities in batches of 1,000 positions -------------------------


def samples(spark: SparkSession, sf_dir: str, batch_rows: int = 1000) -> DataFrame:
    a, b, c = F.col("k") + 1, (F.col("k") * 7) % 50 + 1, (F.col("k") * 13) % 30 + 1
    total = (a + b + c).cast("double")
    return scored(spark, sf_dir).select(
        "event_id", "pos", F.floor(F.col("pos") / batch_rows).alias("batch"), "y_true",
        F.array(a / total, b / total, c / total).alias("probabilities"),
    )


SAMPLES_SQL = SCORED_SQL + """,
weights AS (SELECT event_id, pos, CAST(floor(pos / 1000) AS BIGINT) AS batch, y_true,
                   k + 1 AS a, (k * 7) % 50 + 1 AS b, (k * 13) % 30 + 1 AS c FROM scored),
samples AS (SELECT event_id, pos, batch, y_true,
                   a / CAST(a + b + c AS DOUBLE) AS pa, b / CAST(a + b + c AS DOUBLE) AS pb,
                   c / CAST(a + b + c AS DOUBLE) AS pc FROM weights)"""


# --- labelled: the stream with a learnable label whose rule turns round at 60 % ----------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    late = F.col("pos") >= F.floor(F.col("n") * F.lit(DRIFT_AT))
    k = F.col("k").cast("double")
    level = F.col("value") / 5 + F.when(late, 99 - k).otherwise(k)
    return rows.select(
        "event_id", "pos", "n", "ts", "user_id", "value", k.alias("k"), F.hour("ts").cast("double").alias("hour"),
        (F.floor(F.col("k") / 10) * 10 + F.least(F.floor(F.col("value") / 25), F.lit(9))).cast("long").alias("cell"),
        F.when(level > 60, "ATTACK").otherwise("BENIGN").alias("Label"),
        F.when(level > 75, "DDoS").when(level > 45, "PortScan").otherwise("BENIGN").alias("Kind"),
    )


LABELLED_SQL = SCORED_SQL + """,
labelled AS (
  SELECT event_id, pos, n, user_id, value, k, CAST(floor(k / 10e0) * 10 + least(floor(value / 25), 9) AS BIGINT) AS cell,
         CASE WHEN value / 5 + CASE WHEN late THEN 99 - k ELSE k END > 60 THEN 'ATTACK' ELSE 'BENIGN' END AS "Label"
  FROM scored)"""


# --- adaptive runs of a cell table (the majority label per cell), which SQL can follow ----

WARM = 0.3
SEEDS = (42, 123, 256, 512, 1024)
RULE_PERIODS = (1000, 2000)
RULE_WINDOW = 2000
RULE_SHARE = 0.8


def runs_sql(seeds: tuple[int, ...]) -> str:
    """``by_run(strategy, seed, pos, y_true, y_pred)`` and ``retrains(strategy, seed, n_retrains)``."""
    periods = ", ".join(f"('periodic_{p}', {p})" for p in RULE_PERIODS)
    return LABELLED_SQL + f""",
size AS (SELECT count(*) AS n, CAST(floor(count(*) * 3e-1) AS BIGINT) AS warm FROM labelled),
t AS (SELECT pos - warm AS pos, event_id, "Label" AS y, cell FROM labelled, size),
policy(strategy, period) AS (VALUES ('static', 1000000000), {periods}),
seeds(seed) AS (VALUES {', '.join(f'({s})' for s in seeds)}),
trig AS (
  SELECT strategy, period, unnest(range(0, CAST(floor((n - warm - 1) / period) AS BIGINT) + 1)) AS j FROM policy, size),
span AS (SELECT strategy, j, CASE WHEN j = 0 THEN -warm ELSE greatest(0, j * period - {RULE_WINDOW} + 1) END AS a, CASE WHEN j = 0 THEN -1 ELSE j * period END AS z FROM trig, size),
guard AS (SELECT strategy, j FROM span JOIN t ON t.pos BETWEEN a AND z GROUP BY strategy, j HAVING j = 0 OR (count(*) >= 500 AND count(DISTINCT y) >= 2)),
seen AS (
  SELECT s.strategy, s.j, seed, cell, y, count(*) AS c FROM span s JOIN guard USING (strategy, j) JOIN t ON t.pos BETWEEN a AND z, seeds
  WHERE CAST('0x' || substr(md5(seed || '|' || event_id), 1, 8) AS BIGINT) / 4294967296e0 < {RULE_SHARE!r} GROUP BY 1, 2, 3, 4, 5),
per_cell AS (SELECT strategy, j, seed, cell, y FROM seen QUALIFY row_number() OVER (PARTITION BY strategy, j, seed, cell ORDER BY c DESC, y) = 1),
overall AS (
  SELECT strategy, j, seed, y FROM (SELECT strategy, j, seed, y, sum(c) AS c FROM seen GROUP BY 1, 2, 3, 4)
  QUALIFY row_number() OVER (PARTITION BY strategy, j, seed ORDER BY c DESC, y) = 1),
asked AS (
  SELECT p.strategy, seed, t.pos, t.cell, t.y, (SELECT max(g.j) FROM guard g WHERE g.strategy = p.strategy AND g.j <= greatest(0, floor((t.pos - 1) / p.period))) AS j
  FROM t, policy p, seeds WHERE t.pos >= 0),
by_run AS (
  SELECT a.strategy, a.seed, a.pos, a.y AS y_true, coalesce(c.y, o.y) AS y_pred
  FROM asked a JOIN overall o USING (strategy, seed, j) LEFT JOIN per_cell c ON c.strategy = a.strategy AND c.seed = a.seed AND c.j = a.j AND c.cell = a.cell),
retrains AS (SELECT strategy, count(*) FILTER (j > 0) AS n_retrains FROM guard GROUP BY strategy)"""


def rule_runs(spark: SparkSession, sf_dir: str, seeds: tuple[int, ...]) -> Grid:
    stream = labelled(spark, sf_dir)
    policies = [Static(), *[Periodic(p) for p in RULE_PERIODS]]
    warm = int(stream.agg(F.floor(F.count(F.lit(1)) * F.lit(WARM))).first()[0])
    return run_grid(stream, CellLearner("cell"), "Label", policies, warm, seeds, window_rows=RULE_WINDOW, key=["event_id"], share=RULE_SHARE)
