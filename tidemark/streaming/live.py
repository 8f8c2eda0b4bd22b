"""Structured Streaming: scoring a feed, flow assembly, drift monitoring, counters.

Every job takes any streaming frame; the trigger decides whether it runs on or replays
what is there.  Logs are written per micro-batch under the run (the id that a checkpoint
gives its query) and the batch number, so a batch that is repeated after a failure replaces
itself, and another run replaces nothing.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.functions.expressions import col
from tidemark.operators.detectors import create
from tidemark.operators.split import position_batches
from tidemark.sources import logs as lg
from tidemark.sources.replay import PositionSource
from tidemark.workspace import materialize, ship_package


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def write_batches(df: DataFrame, path: str, batch_rows: int, pos: str = "pos") -> int:
    """Lay a positioned table out as one folder per batch of ``batch_rows`` positions, for replay in order."""
    cut = position_batches(df, batch_rows, pos)
    cut.repartition("batch").write.partitionBy("batch").parquet(path)
    return cut.agg(F.max("batch")).first()[0] + 1


def run_now(stream: DataFrame, start: Callable, mode: str, checkpoint: str) -> StreamingQuery:
    """Start a query that processes what is available and stops."""
    query = start(stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True))
    query.awaitTermination()
    return query


def replay_positions(df: DataFrame, batch_rows: int, folder: str, pos: str = "pos") -> DataFrame:
    """A table with dense positions as a stream of micro-batches of exactly ``batch_rows`` rows, in order.

    The table is laid out by position below ``folder``, where the progress is kept too; a
    query that starts again from its checkpoint goes on behind its last batch.
    """
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(PositionSource)
    stored = df.withColumn(pos, col(pos).cast("long"))
    stored.repartitionByRange(col(pos)).sortWithinPartitions(pos).write.mode("ignore").parquet(f"{folder}/rows")
    end = (spark.read.schema(stored.schema).parquet(f"{folder}/rows").agg(F.max(pos)).first()[0] or -1) + 1
    reader = spark.readStream.format("positions").schema(stored.schema)
    return reader.option("folder", folder).option("pos", pos).option("batch_rows", str(batch_rows)).option("end", str(end)).load()


def run_through(stream: DataFrame, start: Callable, mode: str, checkpoint: str) -> StreamingQuery:
    """Start a query on a paced feed, let it take batch after batch until nothing is left, and stop it."""
    query = start(stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a checkpoint keeps for its query over all restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def score_and_log(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, time: str = "ts",
    monitor: ConfidenceMonitor | None = None, run: Callable = run_now, **fields: str,
) -> StreamingQuery:
    """Score every row, log the prediction, log predicted attacks with their severity.

    ``score`` adds ``y_pred`` and ``confidence``; a fitted ``Classifier.predict`` fits.  A batch is
    scored once.  With a ``monitor`` the confidences go to its detectors, too, and their drifts
    to the drift log.
    """
    spark = stream.sparkSession

    def each_batch(batch: DataFrame, number: int) -> None:
        scored = score(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            me = run_id(spark, checkpoint)
            lg.append(lg.prediction_records(scored, time, "y_pred", "confidence", **fields), root, "predictions", number, run=me)
            lg.append(lg.attack_records(scored, time, "y_pred", "confidence", **fields), root, "attacks", number, run=me)
            if monitor:
                lg.append(monitor.update(scored, root, me, number, time), root, "drift_events", number, run=me)
        finally:
            scored.unpersist()

    return run(stream, lambda w: w.foreachBatch(each_batch).start(), "append", checkpoint)


class ConfidenceMonitor:
    """A label-free drift detector per key on the confidence of scored rows.

    The state after each batch is a table of its own, so a batch that is repeated starts from the
    state it started from before.  Rows of a key are read in the order of ``order``.
    """

    def __init__(self, key: str, order: str, method: str = "confidence", value: str = "confidence", **params):
        create(method, **params)
        self.key, self.order, self.method, self.value, self.params = key, order, method, value, params

    def update(self, scored: DataFrame, root: str, run: str, batch: int, time: str) -> DataFrame:
        """Fold one batch; returns its drift records."""
        spark = scored.sparkSession
        ship_package(spark)
        key, method, params = self.key, self.method, self.params
        rows = scored.select(col(key), col(self.order).cast("long").alias("_pos"), col(self.value).cast("double").alias("_value"), col(time).alias("_time"))
        fields = [rows.schema[key], rows.schema["_time"]]
        kind = T.StructType([*fields, *T.StructType.fromDDL("pos long, n_seen long, n_drifts long, window_size long, estimation double, state binary").fields])
        names = kind.fieldNames()
        state = f"{root}/monitor/{run}"

        def fold(values: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            detector = pickle.loads(before["state"].iloc[0]) if len(before) else create(method, **params)
            values, out = values.sort_values("_pos", ignore_index=True), []
            for i, what in detector.scan(values["_value"].to_numpy(dtype=float)):
                if what == "drift":
                    row = values.iloc[i]
                    out.append((row[key], row["_time"], int(row["_pos"]), detector.n_seen, detector.n_drifts, detector.width, detector.estimate, None))
            last = values[key].iloc[0] if len(values) else before[key].iloc[0]
            out.append((last, None, None, None, None, None, None, pickle.dumps(detector)))
            return pd.DataFrame(out, columns=names, dtype=object)

        known = spark.createDataFrame([], T.StructType([rows.schema[key], *T.StructType.fromDDL("state binary").fields]))
        if batch > 0:
            known = spark.read.schema(known.schema).parquet(f"{state}/batch={batch - 1}")
        found = materialize(rows.groupBy(key).cogroup(known.groupBy(key)).applyInPandas(fold, kind), "monitored")
        found.filter("state IS NOT NULL").select(key, "state").write.mode("overwrite").parquet(f"{state}/batch={batch}")
        numbers = ("n_seen", "n_drifts", "window_size", "estimation")
        detail = F.create_map(*[x for n in numbers for x in (F.lit(n), F.col(n).cast("double"))])
        drifts = found.filter("state IS NULL").withColumns({"detector": F.lit(method), "detector_state": detail})
        return lg.drift_records(drifts, "_time", "detector", "pos", "detector_state", **{key: key})


def session_flows(stream: DataFrame, key: list[str], time: str, length: str, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Flows that close after a silence of ``gap``; emitted once the watermark has passed them."""
    timed = stream.withColumn("_time", col(time).cast("timestamp")).withWatermark("_time", delay)
    flows = timed.groupBy(*key, F.session_window("_time", gap).alias("_s")).agg(
        F.count(F.lit(1)).alias("n_packets"), F.sum(length).alias("bytes"), F.min("_time").alias("start_time"), F.max("_time").alias("last_time")
    )
    return flows.drop("_s")


def close_feed(spark: SparkSession, folder: str, schema: T.StructType, time: str, at: object = None) -> DataFrame:
    """A control feed: empty at first; with ``at``, a row of that time is added, which moves the watermark past every open flow."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    if at is not None:
        row = spark.range(1).select(*[(F.lit(at) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        row.write.mode("append").parquet(folder)
    return replay(spark, folder, schema)


def all_sessions(
    feed: Callable[[], DataFrame], key: list[str], time: str, length: str, out: str, gap: str = "30 seconds", delay: str = "1 minute", last: object = None
) -> DataFrame:
    """Run ``session_flows`` over what is there, then close the feed so that open flows come out too.

    ``feed`` makes the streaming frame, ``last`` is a time more than ``gap`` and ``delay`` after the
    last row.  The second run goes on from the checkpoint of the first.
    """
    for at in (None, last):
        stream = feed()
        spark = stream.sparkSession
        closed = stream.unionByName(close_feed(spark, f"{out}/control", stream.schema, time, at))
        flows = session_flows(closed, key, time, length, gap, delay)
        run_now(flows, lambda w: w.format("parquet").start(f"{out}/flows"), "append", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/flows")


DRIFT_SCHEMA = "pos long, n_seen long, n_drifts long, window_size long, estimation double"
STATE_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Monitor(StatefulProcessor):
    """One detector per key in a typed value state that expires after ``ttl_ms`` without a row (0: never)."""

    def __init__(self, key: str, method: str, params: dict, names: list[str], ttl_ms: int):
        self.key, self.method, self.params, self.names, self.ttl_ms = key, method, params, names, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("detector", "n_seen long, state binary", ttlDurationMs=self.ttl_ms or None)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        raw = bytes(initialState["state"].iloc[0])
        self.state.update((pickle.loads(raw).n_seen, raw))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(self.state.get()[1]) if self.state.exists() else create(self.method, **self.params)
        # Arrow cuts the rows of a key into chunks; the order must hold across them.  Columns come by place, not by name
        rows = pd.concat([r.set_axis(["_key", "_pos", "_value"], axis=1) for r in rows]).sort_values("_pos", ignore_index=True)
        found = []
        for i, what in detector.scan(rows["_value"].to_numpy(dtype=float)):
            if what == "drift":
                found.append((key[0], int(rows["_pos"].iloc[i]), detector.n_seen, detector.n_drifts, detector.width, detector.estimate))
        self.state.update((detector.n_seen, pickle.dumps(detector)))
        yield pd.DataFrame(found, columns=self.names)

    def close(self) -> None:
        pass


def monitor_drift(
    stream: DataFrame, key: str, pos: str, value: str, method: str = "adwin", initial: DataFrame | None = None, ttl_ms: int = 0, **params
) -> DataFrame:
    """Detector per key whose state lives in the state store between micro-batches.

    Rows of a key are read in position order inside a micro-batch, whose size the source
    bounds (see ``replay_positions``); positions of later micro-batches must be larger, as in a
    feed.  ``initial`` (key, state) starts keys from pickled detectors, for example those of an
    earlier run; a key without rows for ``ttl_ms`` milliseconds is forgotten.
    """
    create(method, **params)
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set(*STATE_PROVIDER)
    kind = stream.schema[key].dataType
    out_schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL(DRIFT_SCHEMA).fields])
    rows = stream.select(col(key), col(pos).cast("long").alias("_pos"), col(value).cast("double").alias("_value"))
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Monitor(key, method, params, out_schema.fieldNames(), ttl_ms), outputStructType=out_schema, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None", initialState=None if initial is None else initial.select(col(key), "state").groupBy(key),
    )


def counters(stream: DataFrame, prediction: str = "y_pred") -> DataFrame:
    """Running totals of predictions and attacks."""
    return stream.agg(F.count(F.lit(1)).alias("n_predictions"), F.count_if(col(prediction) == "ATTACK").alias("n_attacks"))
