import pickle
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect as dt
from tidemark.operators import models as ml
from tidemark.operators.detectors import create
from tidemark.operators import trees
from tidemark.plans import load_all
from tidemark.plans.registry import QUERIES
from tidemark.sources import logs as lg
from tidemark.streaming import live
from tidemark.workspace import new_path

load_all()


def learnable(spark, n=600, turn=None):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"pos": range(n), "a": rng.random(n), "b": rng.random(n)})
    hit = pdf["a"] > 0.5
    if turn:
        hit = np.where(pdf["pos"] >= turn, ~hit, hit)
    return spark.createDataFrame(pdf.assign(Label=np.where(hit, "ATTACK", "BENIGN")))


def test_train_save_load_register(spark):
    df = learnable(spark)
    root = new_path(spark, "test-models")
    for algorithm, params in (("gbt", {"maxIter": 2, "maxDepth": 2}), ("rf", {"numTrees": 3, "maxDepth": 3})):
        model = ml.train(df, ["a", "b"], "Label", algorithm, **params)
        out = model.predict(df).select("pos", "y_pred", "confidence", "Label").orderBy("pos").collect()
        assert np.mean([r["y_pred"] == r["Label"] for r in out]) > 0.95 and all(0.5 <= r["confidence"] <= 1 for r in out)
        path = ml.register_model(spark, root, model, f"{algorithm}-1", algorithm, {"f1": 1.0})
        again = ml.Classifier.load(spark, path)
        assert again.features == ["a", "b"]
        assert again.predict(df).select("pos", "y_pred", "confidence", "Label").orderBy("pos").collect() == out
        assert dict(model.importances())["a"] > dict(model.importances())["b"]
        # a column the model knows and the table lacks counts as 0
        assert {r["y_pred"] for r in model.predict(df.drop("a", "Label")).select("y_pred").distinct().collect()} == {"BENIGN"}
    records = ml.registry(spark, root)
    kept = ml.model_by_id(records, "gbt-1").first()
    assert (kept["training_samples"], kept["n_features"], kept["classes"]) == (600, 2, ["ATTACK", "BENIGN"]) and kept["training_time_s"] > 0
    assert ml.model_by_id(records, "rf-1").count() == 1
    assert {r["model_id"] for r in ml.latest_models(records, "seq", ["algorithm"], ["model_id"]).collect()} == {"gbt-1", "rf-1"}
    with pytest.raises(ValueError):
        ml.train(df, ["a"], "Label", "nothing")


def error_stream(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(rng.random() < (0.05 if i < 600 else 0.6))) for i in range(1200) for k in ("a", "b")]
    return spark.createDataFrame(rows, "key string, pos long, err double")


def test_monitor_keeps_its_state_between_batches(spark):
    df = error_stream(spark)
    root = new_path(spark, "test-monitor")
    found, want = [], dt.detect(df, ["key"], ["pos"], "err").select("key", "pos", "n_drifts").collect()
    # the feed grows; every run goes on from the state of the last one
    for part in range(3):
        df.filter(f"floor(pos / 400) = {part}").write.mode("append").parquet(f"{root}/in")
        feed = live.replay(spark, f"{root}/in", df.schema, files_per_batch=50)
        live.run_now(live.monitor_drift(feed, "key", "pos", "err"), lambda w: w.format("parquet").start(f"{root}/out"), "append", f"{root}/checkpoint")
    found = spark.read.parquet(f"{root}/out").select("key", "pos", "n_drifts").collect()
    assert sorted(tuple(r) for r in found) == sorted(tuple(r) for r in want) and want


def test_scoring_a_growing_feed(spark):
    df = spark.range(105).select(F.col("id").alias("pos"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), (F.col("id") % 100 / 100.0).alias("p"))
    root = new_path(spark, "test-feed")
    assert live.write_batches(df, f"{root}/in", 20) == 6
    score = lambda d: d.withColumn("y_pred", F.when(F.col("p") > 0.5, "ATTACK").otherwise("BENIGN")).withColumn("confidence", F.col("p"))
    feed = live.replay(spark, f"{root}/in", df.schema, files_per_batch=1)
    live.score_and_log(feed, score, root, f"{root}/checkpoint", pos="pos")
    live.score_and_log(feed, score, root, f"{root}/checkpoint", pos="pos")  # nothing new arrives
    assert lg.read(spark, root, "predictions").count() == 105
    assert lg.read(spark, root, "predictions").select("batch").distinct().count() == 6
    attacks = lg.read(spark, root, "attacks")
    assert attacks.count() == 49 and attacks.filter("severity = 'high'").count() == 9


def test_sessions_close_after_the_gap(spark):
    at = [0, 10, 39, 100, 5000]
    df = spark.createDataFrame([("u", float(t), 1) for t in at], "user string, sec double, n int").withColumn("ts", F.timestamp_seconds("sec"))
    root = new_path(spark, "test-sessions")
    df.coalesce(1).write.parquet(f"{root}/in")
    feed = live.replay(spark, f"{root}/in", df.schema)
    live.run_now(live.session_flows(feed, ["user"], "ts", "n"), lambda w: w.format("parquet").start(f"{root}/out"), "append", f"{root}/checkpoint")
    got = spark.read.parquet(f"{root}/out").orderBy("start_time").collect()
    assert [r["n_packets"] for r in got] == [3, 1]  # the last flow is still open


def test_paced_replay_goes_on_from_its_checkpoint(spark):
    root, sizes = new_path(spark, "test-paced"), []
    df = spark.range(230).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("x"))

    def keep(batch, number):
        rows = sorted((r["pos"], r["x"]) for r in batch.collect())
        sizes.append((number, [r[0] for r in rows]))
        assert all(x == 2 * p for p, x in rows)
        if len(sizes) == 2 and not failed:
            failed.append(True)
            raise RuntimeError("stop here once")

    failed = []
    feed = lambda: live.replay_positions(df, 50, f"{root}/feed")
    with pytest.raises(Exception):
        live.run_through(feed(), lambda w: w.foreachBatch(keep).start(), "append", f"{root}/checkpoint")
    live.run_through(feed(), lambda w: w.foreachBatch(keep).start(), "append", f"{root}/checkpoint")
    # the second batch failed once and came again
    assert [n for n, _ in sizes] == [0, 1, 1, 2, 3, 4] and sizes[1][1] == sizes[2][1] == list(range(50, 100))
    assert [len(p) for _, p in sizes] == [50, 50, 50, 50, 50, 30]


def test_all_sessions_come_out(spark):
    at = [0, 10, 39, 100, 5000]
    df = spark.createDataFrame([("u", float(t), 1) for t in at] + [("v", 4990.0, 1)], "user string, sec double, n int").withColumn("ts", F.timestamp_seconds("sec"))
    root = new_path(spark, "test-closing")
    df.coalesce(1).write.parquet(f"{root}/in")
    last = df.agg(F.max("ts") + F.expr("INTERVAL 1 HOUR")).first()[0]
    got = live.all_sessions(lambda: live.replay(spark, f"{root}/in", df.schema), ["user"], "ts", "n", f"{root}/out", last=last)
    assert sorted((r["user"], r["n_packets"]) for r in got.collect()) == [("u", 1), ("u", 1), ("u", 3), ("v", 1)]


def test_drifts_of_live_confidences_are_logged(spark):
    rng = np.random.default_rng(6)
    rows = [(i, k, float(np.clip(rng.normal(0.9 if i < 500 else 0.6, 0.05), 0, 1))) for i in range(1000) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "pos long, sensor string, confidence double").withColumn("ts", F.timestamp_seconds(F.col("pos") + 1_700_000_000))
    df = df.withColumn("row", F.col("pos") * 2 + (F.col("sensor") == "b").cast("long")).withColumn("y_pred", F.lit("BENIGN"))
    root, seen = new_path(spark, "test-live"), []

    def score(batch):
        seen.append(1)
        return batch

    monitor = live.ConfidenceMonitor("sensor", "pos")
    for run in ("one", "two"):  # another checkpoint is another run and replaces nothing
        feed = live.replay_positions(df, 300, f"{root}/feed-{run}", pos="row")
        live.score_and_log(feed, score, root, f"{root}/checkpoint-{run}", monitor=monitor, run=live.run_through, row="row")
    assert len(seen) == 14
    log = lg.read(spark, root, "drift_events")
    expected = dt.detect(df, ["sensor"], ["pos"], "confidence", "confidence").select("sensor", "pos", "n_drifts").collect()
    for run in log.select("run").distinct().collect():
        mine = log.filter(F.col("run") == run["run"])
        assert sorted((r["sensor"], r["stream_position"], int(r["detector_state"]["n_drifts"])) for r in mine.collect()) == sorted(tuple(r) for r in expected)
    assert log.select("run").distinct().count() == 2 and len(expected) >= 2
    assert lg.read(spark, root, "predictions").count() == 4000


def test_monitor_starts_from_given_detectors(spark):
    df = error_stream(spark)
    first, rest = df.filter("pos < 500"), df.filter("pos >= 500")
    states = []
    for key in ("a", "b"):
        d = create("adwin")
        list(d.scan(np.array([r["err"] for r in first.filter(F.col("key") == key).orderBy("pos").collect()])))
        states.append((key, pickle.dumps(d)))
    initial = spark.createDataFrame(states, "key string, state binary")
    root = new_path(spark, "test-initial")
    rest.write.parquet(f"{root}/in")
    found = live.monitor_drift(live.replay(spark, f"{root}/in", df.schema), "key", "pos", "err", initial=initial)
    live.run_now(found, lambda w: w.format("parquet").start(f"{root}/out"), "append", f"{root}/checkpoint")
    got = spark.read.parquet(f"{root}/out").select("key", "pos", "n_drifts").collect()
    want = dt.detect(df, ["key"], ["pos"], "err").filter("pos >= 500").select("key", "pos", "n_drifts").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want) and want


MODEL_QUERIES = (
    "gbt_score rf_score gbt_multiclass temporal_degradation feature_importances importance_shift model_roundtrip cross_dataset_eval model_registry "
    "prequential_run prequential_comparison policy_comparison"
).split()


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_model_queries_ask_for_the_documented_trees(spark, monkeypatch, name):
    fit, asked = trees.fit_many, []

    def small(df, model, features, label, how):
        asked.extend(how.values() if isinstance(how, dict) else [how])
        cut = lambda s: replace(s, trees=1, depth=2)
        return fit(df, model, features, label, {m: cut(s) for m, s in how.items()} if isinstance(how, dict) else cut(how))

    monkeypatch.setattr(trees, "fit_many", small)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert asked and all(s.trees == 200 and s.depth == (8 if s.algorithm == "gbt" else 20) for s in asked)
