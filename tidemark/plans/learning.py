"""Registered queries: models, scoring across tables, adaptation over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import r6
from tidemark.operators import adapt as ad
from tidemark.operators import evaluate as ev
from tidemark.operators import models as ml
from tidemark.operators.prequential import CellLearner, TreeLearner, policy_table, run_grid
from tidemark.operators.split import random_split, temporal_split
from tidemark.plans.registry import query
from tidemark.plans.views import LABELLED_SQL, SEEDS, WARM, labelled, table
from tidemark.workspace import new_path

FEATURES = ["value", "k", "hour"]


def _split(spark, sf_dir):
    rows = random_split(labelled(spark, sf_dir), ["event_id"])
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def _metrics(df):
    out = ev.binary_metrics(df, "Label", "y_pred")
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("gbt_score")
def gbt_score(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _metrics(ml.train(train, FEATURES, "Label", "gbt").predict(test))


@query("rf_score")
def rf_score(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _metrics(ml.train(train, FEATURES, "Label", "rf").predict(test))


@query("temporal_degradation")
def temporal_degradation(spark, sf_dir):
    """The same model on a random and on a chronological split."""
    train, test = _split(spark, sf_dir)
    by_chance = _metrics(ml.train(train, FEATURES, "Label", "gbt").predict(test)).withColumn("strategy", F.lit("random"))
    timed = temporal_split(labelled(spark, sf_dir).drop("pos"), "ts", ["event_id"], train=0.6)
    model = ml.train(timed.filter("split = 'train'"), FEATURES, "Label", "gbt")
    later = _metrics(model.predict(timed.filter("split = 'test'"))).withColumn("strategy", F.lit("temporal"))
    return by_chance.unionByName(later)


@query("feature_importances")
def feature_importances(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return ml.importance_table(spark, ml.train(train, FEATURES, "Label", "gbt"))


@query("importance_shift")
def importance_shift(spark, sf_dir):
    """Importances before and after the rule turns round; both forests are grown side by side."""
    rows = labelled(spark, sf_dir)
    late = F.col("pos") >= F.floor(F.col("n") * F.lit(0.6))
    rows = rows.withColumn("period", F.when(late, "later").otherwise("earlier"))
    found = ml.train_many(rows, "period", FEATURES, "Label", ml.settings("rf"))
    return ml.importance_shift(spark, found["earlier"], found["later"])


@query("gbt_multiclass")
def gbt_multiclass(spark, sf_dir):
    """Boosted trees over three labels, with the report per label."""
    train, test = _split(spark, sf_dir)
    out = ev.classification_report(ml.train(train, FEATURES, "Kind", "gbt").predict(test), "Kind", "y_pred")
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("model_roundtrip", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_mismatches FROM events")
def model_roundtrip(spark, sf_dir):
    """Predictions before and after saving, on all rows."""
    rows = labelled(spark, sf_dir)
    model = ml.train(rows, FEATURES, "Label", "gbt")
    path = new_path(spark, "model")
    model.save(spark, path)
    again = ml.Classifier.load(spark, path)
    before = model.predict(rows).withColumnsRenamed({"y_pred": "y_before", "confidence": "c_before"}).drop("probabilities")
    after = again.predict(before)
    differs = (F.col("y_before") != F.col("y_pred")) | (F.col("c_before") != F.col("confidence"))
    return after.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(differs).alias("n_mismatches"))


@query("cross_dataset_eval")
def cross_dataset_eval(spark, sf_dir):
    """Train on line items, test on orders, through the one feature they share."""
    a = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("price"), "l_tax", F.when(F.col("l_extendedprice") > 50000, "ATTACK").otherwise("BENIGN").alias("Label")
    )
    b = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("price"), "o_custkey", F.when(F.col("o_totalprice") > 60000, "ATTACK").otherwise("BENIGN").alias("Label")
    )
    alone = _metrics(ml.cross_dataset(a, b)).withColumn("trained_on", F.lit("a"))
    train_b = random_split(b, ["o_custkey", "price"]).filter("split = 'train'").drop("split")
    both = _metrics(ml.cross_dataset(a, b, combined=train_b)).withColumn("trained_on", F.lit("a and b"))
    return alone.unionByName(both)


@query("model_registry")
def model_registry(spark, sf_dir):
    """Fit two model families, register both with their quality, read the registry back."""
    train, test = _split(spark, sf_dir)
    root = new_path(spark, "registry")
    for algorithm in ("gbt", "rf"):
        model = ml.train(train, FEATURES, "Label", algorithm)
        f1 = _metrics(model.predict(test)).first()["f1"]
        ml.register_model(spark, root, model, f"{algorithm}-1", algorithm, {"f1": f1})
    records = ml.registry(spark, root).withColumn("f1", F.col("metrics")["f1"])
    kept = ["model_id", "f1", "training_samples", "n_features", "features", "classes", "random_seed", "params"]
    return ml.latest_models(records, "seq", ["algorithm"], kept).drop("seq")


_TRAIN_SQL = "CAST('0x' || substr(md5('42|' || event_id), 1, 8) AS BIGINT) / 4294967296e0"


@query(
    "registry_facts",
    f"""WITH {LABELLED_SQL}, train AS (SELECT * FROM labelled WHERE {_TRAIN_SQL} >= 2e-1)
SELECT a.algorithm, a.algorithm || '-1' AS model_id, count(*) AS training_samples, 3 AS n_features, 'value,k,hour' AS features,
  string_agg(DISTINCT "Label", ',' ORDER BY "Label") AS classes, CAST(42 AS BIGINT) AS random_seed, CAST(1 AS BIGINT) AS n_registered
FROM train, (VALUES ('gbt'), ('rf')) a(algorithm) GROUP BY a.algorithm""",
)
def registry_facts(spark, sf_dir):
    """What the registry keeps about the data of every fitted model."""
    records = model_registry(spark, sf_dir)
    return records.select(
        "algorithm", "model_id", "training_samples", "n_features", F.array_join("features", ",").alias("features"),
        F.array_join("classes", ",").alias("classes"), "random_seed", "n_registered",
    )


# --- adaptive runs over the stream --------------------------------------------------------


def _grid(spark, sf_dir, policies, seeds=(42,), share=1.0):
    stream = labelled(spark, sf_dir)
    warm = int(stream.agg(F.floor(F.count(F.lit(1)) * F.lit(WARM))).first()[0])
    return run_grid(stream, TreeLearner(FEATURES), "Label", policies, warm, seeds, key=["event_id"], share=share)


@query("prequential_run")
def prequential_run(spark, sf_dir):
    """Quality per window of 1,000 positions of a model that is refitted when its errors drift, and the retrains in it."""
    grid = _grid(spark, sf_dir, [ad.DriftTriggered()])
    windows = ev.windowed_metrics(grid.predictions, window_rows=1000).select("window_id", "support", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"))
    log = grid.log.groupBy(F.floor(F.col("pos") / 1000).alias("window_id")).agg(
        F.count(F.lit(1)).alias("n_triggered"), F.count_if("retrained").alias("n_retrained"), F.min("pos").alias("first_trigger")
    )
    return windows.join(log, "window_id", "left").fillna(0, ["n_triggered", "n_retrained"])


def _policies():
    return [ad.Static(), ad.Periodic(5_000), ad.Periodic(10_000), ad.DriftTriggered()]


def _quality(grid):
    out = ev.binary_metrics(grid.predictions, by=["strategy", "seed"]).join(policy_table(grid).drop("train_seconds", "n_rows"), ["strategy", "seed"])
    return out.select("strategy", "seed", "support", *[r6(c).alias(c) for c in ("f1", "recall", "fpr", "fnr", "mcc")], "n_triggered", "n_retrains")


@query("policy_comparison")
def policy_comparison(spark, sf_dir):
    """The same stream under four policies: quality, triggers and retrains."""
    return _quality(_grid(spark, sf_dir, _policies())).drop("seed")


@query("prequential_comparison")
def prequential_comparison(spark, sf_dir):
    """Three policies under five seeds; a seed draws 80 % of the rows a model is fitted on."""
    policies = [ad.Static(), ad.Periodic(5_000), ad.DriftTriggered()]
    return _quality(_grid(spark, sf_dir, policies, SEEDS, share=0.8))


@query(
    "retrain_log",
    f"""WITH {LABELLED_SQL}, size AS (SELECT count(*) AS n, CAST(floor(count(*) * 3e-1) AS BIGINT) AS warm FROM labelled),
t AS (SELECT pos - warm AS pos, "Label" AS y FROM labelled, size WHERE pos >= warm),
trig AS (SELECT 'periodic_' || p AS strategy, t.pos FROM t, (VALUES (500), (2000)) periods(p) WHERE t.pos > 0 AND t.pos % p = 0)
SELECT strategy, trig.pos, count(*) AS window_rows, CAST(count(DISTINCT y) AS INTEGER) AS n_classes,
  count(*) >= 500 AND count(DISTINCT y) >= 2 AS retrained
FROM trig JOIN t ON t.pos <= trig.pos AND t.pos > trig.pos - 20000 GROUP BY 1, 2""",
)
def retrain_log(spark, sf_dir):
    """Every trigger of two periodic runs of a cell table, with its guard."""
    stream = labelled(spark, sf_dir)
    warm = int(stream.agg(F.floor(F.count(F.lit(1)) * F.lit(WARM))).first()[0])
    return run_grid(stream, CellLearner("cell"), "Label", [ad.Periodic(500), ad.Periodic(2_000)], warm).log.drop("seed", "train_seconds")
