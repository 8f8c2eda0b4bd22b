"""Registered queries: sources, sinks, logs and scoring summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models as ml
from tidemark.plans.registry import query
from tidemark.plans.views import SCORED_SQL, scored, table
from tidemark.sources import logs as lg
from tidemark.sources import tables as tb
from tidemark.workspace import materialize, new_path

_ORDER_COLUMNS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
_ORDER_NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*_ORDER_NAMES)


@query("scan_csv_folder", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_csv_folder(spark, sf_dir):
    path = new_path(spark, "csv")
    # padded header names, as flow exports have them
    padded = _orders(spark, sf_dir).toDF(*[f" {c}" for c in _ORDER_NAMES])
    padded.write.option("header", True).csv(path)
    return tb.scan_csv_folder(spark, path, _ORDER_COLUMNS, name_part="part-")


@query("row_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def row_cap(spark, sf_dir):
    return tb.row_cap(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, ["o_orderkey"])


@query(
    "hash_sample_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT), o_orderkey LIMIT 500",
)
def hash_sample_n(spark, sf_dir):
    return tb.sample_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"])


@query(
    "hash_sample_fraction",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296e0 < 25e-2",
)
def hash_sample_fraction(spark, sf_dir):
    return tb.sample_fraction(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 0.25, ["o_orderkey"])


@query(
    "dataset_normalize",
    """SELECT o_orderkey, o_totalprice AS "Flow Duration", CASE WHEN o_orderstatus IN ('O', 'P') THEN 'BENIGN' ELSE 'ATTACK' END AS "Label",
  o_orderstatus AS _original_label FROM orders""",
)
def dataset_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit(" "), "o_orderstatus").alias("status"))
    return tb.dataset_normalize(rows, {"o_totalprice": "Flow Duration"}, "status", ("O", "P"))


@query(
    "scan_headerless",
    """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'Normal' ELSE o_orderpriority END AS attack_cat,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(o_custkey % 2 AS INTEGER) END AS label FROM orders""",
)
def scan_headerless(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice",
        F.when(key % 7 == 0, None).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("attack_cat"),
        F.when(key % 5 == 0, "unknown").otherwise((F.col("o_custkey") % 2).cast("string")).alias("label"),
    )
    path = new_path(spark, "headerless")
    rows.write.option("header", False).csv(path)
    return tb.scan_headerless(spark, path, "o_orderkey long, o_totalprice double, attack_cat string, label int", "label", "attack_cat")


@query("parquet_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def parquet_roundtrip(spark, sf_dir):
    return materialize(_orders(spark, sf_dir), "orders")


def _predictions(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "ts", "user_id", "pos", "y_true", "y_pred", "confidence")


@query("sink_predictions", f"WITH {SCORED_SQL} SELECT pos, y_true, y_pred, round(confidence, 4) AS confidence FROM scored")
def sink_predictions(spark, sf_dir):
    path = new_path(spark, "predictions")
    rows = _predictions(spark, sf_dir).select("pos", "y_true", "y_pred", F.round("confidence", 4).alias("confidence"))
    lg.write_result(rows, path, "csv")
    return spark.read.schema(rows.schema).option("header", True).csv(path)


_ATTACKS_SQL = f"""{SCORED_SQL}, attacks AS (SELECT ts, event_id, user_id, round(confidence, 4) AS confidence,
  CASE WHEN confidence > 9e-1 THEN 'high' WHEN confidence > 7e-1 THEN 'medium' ELSE 'low' END AS severity, false AS acknowledged
  FROM scored WHERE y_pred = 'ATTACK')"""


def _attack_log(spark, sf_dir):
    rows = lg.attack_records(_predictions(spark, sf_dir), "ts", "y_pred", "confidence", event_id="event_id", user_id="user_id")
    root = new_path(spark, "logs")
    lg.append(rows, root, "attacks", batch=0)
    lg.append(rows, root, "attacks", batch=0)  # a repeated batch replaces itself
    return lg.read(spark, root, "attacks")


@query("log_attacks", f"WITH {_ATTACKS_SQL} SELECT event_id, user_id, confidence, severity, acknowledged, 'attack_detected' AS type FROM attacks")
def log_attacks(spark, sf_dir):
    return _attack_log(spark, sf_dir).select("event_id", "user_id", "confidence", "severity", "acknowledged", "type")


@query("recent_attacks", f"WITH {_ATTACKS_SQL} SELECT event_id, user_id, confidence, severity FROM attacks ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_attacks(spark, sf_dir):
    return lg.recent(_attack_log(spark, sf_dir), 50, ["event_id"]).select("event_id", "user_id", "confidence", "severity")


@query(
    "attack_stats",
    f"""WITH {_ATTACKS_SQL} SELECT (SELECT count(*) FROM scored) AS total_predictions, count(*) AS total_attacks,
  count(*) FILTER (WHERE NOT (event_id % 4 = 0)) AS unacknowledged_attacks FROM attacks""",
)
def attack_stats(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    predictions = lg.prediction_records(rows, "ts", "y_pred", "confidence", event_id="event_id")
    attacks = lg.attack_records(rows, "ts", "y_pred", "confidence", event_id="event_id")
    return lg.statistics({"predictions": predictions, "attacks": attacks.withColumn("acknowledged", F.col("event_id") % 4 == 0)})


@query(
    "attack_severity",
    f"WITH {_ATTACKS_SQL} SELECT severity, count(*) AS n FROM attacks GROUP BY 1",
)
def attack_severity(spark, sf_dir):
    rows = _predictions(spark, sf_dir).filter("y_pred = 'ATTACK'")
    return rows.groupBy(lg.severity("confidence").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scoring_summary",
    f"""WITH {SCORED_SQL} SELECT y_pred AS prediction, count(*) AS n, round(count(*) * 1e2 / (SELECT count(*) FROM scored), 2) AS pct,
  round(avg(confidence), 6) AS mean_confidence FROM scored GROUP BY 1""",
)
def scoring_summary(spark, sf_dir):
    return ml.scoring_summary(_predictions(spark, sf_dir), "y_pred", "confidence").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    "registry_latest",
    """WITH r AS (SELECT 'model-' || (o_custkey % 20) AS model_id, CASE WHEN o_orderstatus = 'F' THEN 'gbt' ELSE 'rf' END AS algorithm,
  o_orderkey AS seq, o_totalprice AS f1 FROM orders)
SELECT algorithm, arg_max(model_id, seq) AS model_id, max(seq) AS seq, arg_max(f1, seq) AS f1, count(*) AS n_registered FROM r GROUP BY 1""",
)
def registry_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("model-"), (F.col("o_custkey") % 20).cast("string")).alias("model_id"),
        F.when(F.col("o_orderstatus") == "F", "gbt").otherwise("rf").alias("algorithm"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("f1"),
    )
    return ml.latest_models(rows, "seq", ["algorithm"], ["model_id", "f1"])
