"""Append-only logs of predictions, attacks, drifts and retrains, and result sinks.

A log is a Parquet table partitioned by day, run and batch.  Writing a batch of a run again
replaces it, so a repeated task or a restarted stream leaves no doubles; runs do not touch
each other's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col

COLLECTIONS = ("predictions", "attacks", "drift_events", "model_log")


def severity(confidence: str | Column) -> Column:
    return F.when(col(confidence) > 0.9, "high").when(col(confidence) > 0.7, "medium").otherwise("low")


def prediction_records(df: DataFrame, time: str, prediction: str, confidence: str, **fields: str) -> DataFrame:
    """What the prediction log keeps; ``fields`` maps further names to columns."""
    return df.select(
        col(time).alias("timestamp"), col(prediction).alias("prediction"), F.round(col(confidence), 4).alias("confidence"),
        *[col(c).alias(n) for n, c in fields.items()],
    )


def attack_records(df: DataFrame, time: str, prediction: str, confidence: str, **fields: str) -> DataFrame:
    """Predicted attacks with their severity, not yet acknowledged."""
    return df.filter(col(prediction) == "ATTACK").select(
        col(time).alias("timestamp"), F.lit("attack_detected").alias("type"), F.round(col(confidence), 4).alias("confidence"),
        severity(confidence).alias("severity"), F.lit(False).alias("acknowledged"), *[col(c).alias(n) for n, c in fields.items()],
    )


def drift_records(events: DataFrame, time: str, detector: str, position: str, state: str, **fields: str) -> DataFrame:
    """What the drift log keeps; ``state`` names a map column."""
    return events.select(
        col(time).alias("timestamp"), col(detector).alias("detector"), col(position).alias("stream_position"), col(state).alias("detector_state"),
        *[col(c).alias(n) for n, c in fields.items()],
    )


def retrain_records(df: DataFrame, time: str, model_version: str, trigger: str, rows: str, seconds: str) -> DataFrame:
    return df.select(
        col(time).alias("timestamp"), col(model_version).alias("model_version"), col(trigger).alias("trigger"),
        col(rows).alias("training_samples"), F.round(col(seconds), 3).alias("training_time_s"),
    )


def append(df: DataFrame, root: str, collection: str, batch: int, time: str = "timestamp", run: str = "once") -> None:
    """Add one batch of a run to a log; the same run and batch again replace what they wrote before."""
    dated = df.withColumn("day", F.to_date(col(time))).withColumn("run", F.lit(run)).withColumn("batch", F.lit(batch))
    (
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "run", "batch").parquet(f"{root}/{collection}")
    )


def read(spark: SparkSession, root: str, collection: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A log; one that may hold no record yet needs its ``schema``."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{root}/{collection}")


def recent(log: DataFrame, limit: int, tie_break: list[str], time: str = "timestamp") -> DataFrame:
    """Newest records first; each task keeps its own newest ones only."""
    return log.orderBy(F.desc(time), *[F.desc(c) for c in tie_break]).limit(limit)


def statistics(logs: dict[str, DataFrame]) -> DataFrame:
    """Records per collection and attacks nobody has acknowledged, as one row.

    Every log contributes its own partial counts; only those are united.
    """
    counts = None
    for name, log in logs.items():
        open_ones = F.count_if(~F.col("acknowledged")) if name == "attacks" else F.lit(0).cast("long")
        row = log.agg(F.count(F.lit(1)).alias("n"), open_ones.alias("open")).withColumn("name", F.lit(name))
        counts = row if counts is None else counts.unionByName(row)
    return counts.agg(
        *[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(f"total_{n}") for n in logs], F.sum("open").alias("unacknowledged_attacks")
    )


def _flat(df: DataFrame) -> DataFrame:
    """Maps and arrays as JSON text, which is all a CSV file can hold."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(*[F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name) for f in df.schema.fields])


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result as it is partitioned; nothing is gathered into one file."""
    if fmt == "csv":
        # quotes are doubled, as other CSV readers expect
        _flat(df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        df.write.mode("errorifexists").json(path)
    elif fmt == "parquet":
        df.write.mode("errorifexists").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; known: csv, json, parquet")
