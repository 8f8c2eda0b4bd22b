"""Adaptive runs against a plain loop over the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import adapt as ad
from tidemark.operators import prequential as pq
from tidemark.operators.detectors import create


def stream(n=2400, turns=(900, 1700), seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"pos": range(n), "cell": rng.integers(0, 6, n)})
    flip = sum((pdf["pos"] >= t).astype(int) for t in turns) % 2
    pdf["Label"] = np.where(((pdf["cell"] >= 3).astype(int) + flip) % 2 == 1, "ATTACK", "BENIGN")
    noise = rng.random(n) < 0.05
    pdf.loc[noise, "Label"] = np.where(pdf.loc[noise, "Label"] == "ATTACK", "BENIGN", "ATTACK")
    return pdf


def majority(rows):
    count = rows.groupby(["cell", "Label"]).size()
    total = rows.groupby("Label").size()
    best = lambda c: sorted(c.items(), key=lambda x: (-x[1], x[0]))[0][0]
    return {c: best(count[c]) for c in count.index.levels[0]}, best(total)


def plain(pdf, policy, warm, window, minimum, delta):
    """One row after the other: predict, tell the detector, retrain behind the trigger."""
    model, otherwise = majority(pdf[:warm])
    rest = pdf[warm:].reset_index(drop=True)
    detector, last, out, log = create("adwin", delta=delta), policy.first_trigger_base, [], []
    for i, (cell, label) in enumerate(zip(rest["cell"], rest["Label"])):
        y = model.get(cell, otherwise)
        out.append(y)
        drift = any(s == "drift" for _, s in detector.scan(np.array([float(y != label)])))
        if isinstance(policy, ad.Periodic):
            due = i - last >= policy.period
        else:
            due = policy.needs_drifts and drift and i - last >= policy.cooldown
        if due:
            last, recent = i, rest[max(0, i - window + 1) : i + 1]
            ok = len(recent) >= minimum and recent["Label"].nunique() >= 2
            log.append((i, len(recent), recent["Label"].nunique(), ok))
            if ok:
                model, otherwise = majority(recent)
    return out, log


@pytest.mark.parametrize("stretch,ahead", [(100_000, 64), (130, 3)])
def test_runs_equal_the_plain_loop(spark, monkeypatch, stretch, ahead):
    monkeypatch.setattr(pq, "AHEAD", ahead)
    pdf = stream()
    policies = [ad.Static(), ad.Periodic(150), ad.DriftTriggered(40)]
    grid = pq.run_grid(
        spark.createDataFrame(pdf).repartition(4), pq.CellLearner("cell"), "Label", policies, 500,
        window_rows=260, minimum=100, detector_params={"delta": 0.05}, stretch_rows=stretch,
    )
    rows = grid.predictions.orderBy("strategy", "pos").collect()
    log = grid.log.collect()
    assert len(rows) == 3 * 1900
    for policy in policies:
        out, expected = plain(pdf, policy, 500, 260, 100, 0.05)
        mine = [r for r in rows if r["strategy"] == policy.name]
        assert [r["pos"] for r in mine] == list(range(1900)) and [r["y_pred"] for r in mine] == out
        assert all(r["err"] == int(r["y_pred"] != r["y_true"]) for r in mine)
        assert sorted((e["pos"], e["window_rows"], e["n_classes"], e["retrained"]) for e in log if e["strategy"] == policy.name) == expected
    drifts = [e for e in log if e["strategy"] == "drift_triggered"]
    assert len(drifts) >= 2 and drifts[0]["pos"] > 399  # two turns, the first after 400 streamed rows


def test_guards_keep_the_old_model(spark):
    pdf = stream(1200, turns=())
    pdf.loc[600:, "Label"] = "BENIGN"  # one label only in every later window
    grid = pq.run_grid(spark.createDataFrame(pdf), pq.CellLearner("cell"), "Label", [ad.Periodic(100)], 500, window_rows=90, minimum=80)
    log = {e["pos"]: e for e in grid.log.collect()}
    assert log[100]["retrained"] and not log[200]["retrained"] and log[200]["n_classes"] == 1
    short = pq.run_grid(spark.createDataFrame(pdf), pq.CellLearner("cell"), "Label", [ad.Periodic(100)], 500, window_rows=90, minimum=91)
    assert not any(e["retrained"] for e in short.log.collect())


def test_seeds_draw_their_rows_and_trees_recover(spark):
    pdf = stream(1500, turns=(1000,))
    df = spark.createDataFrame(pdf)
    learner = pq.TreeLearner(["cell"], maxIter=3, maxDepth=3)
    grid = pq.run_grid(df, learner, "Label", [ad.Static(), ad.Periodic(300)], 500, seeds=(1, 2), window_rows=200, minimum=50, share=0.7)
    rate = {(r["strategy"], r["seed"]): r["e"] for r in grid.predictions.filter("pos > 900").groupBy("strategy", "seed").agg(F.avg("err").alias("e")).collect()}
    assert all(rate["static", s] > 0.8 and rate["periodic_300", s] < 0.2 for s in (1, 2))
    table = {(r["strategy"], r["seed"]): r for r in pq.policy_table(grid).collect()}
    assert table["periodic_300", 1]["n_retrains"] == 3 and table["static", 2]["n_triggered"] == 0 and table["periodic_300", 2]["train_seconds"] > 0


def test_nothing_to_stream(spark):
    df = spark.createDataFrame(stream(100, turns=()))
    grid = pq.run_grid(df, pq.CellLearner("cell"), "Label", [ad.Static(), ad.DriftTriggered()], 100)
    assert grid.predictions.count() == 0 and grid.log.count() == 0


def test_planned_runs_of_a_cell_table_need_no_turns(spark, monkeypatch):
    """Thousands of periodic models are one table: none is fitted or scored in a turn."""
    monkeypatch.setattr(pq, "_score", None)
    monkeypatch.setattr(pq.CellLearner, "fit", None)
    pdf = stream(2000)
    pdf.loc[700, "Label"], pdf["cell"] = None, pdf["cell"].astype(float)
    pdf.loc[800, "cell"] = None
    policies = [ad.Static(), ad.Periodic(10)]
    grid = pq.run_grid(spark.createDataFrame(pdf).withColumn("cell", F.col("cell").cast("long")), pq.CellLearner("cell"), "Label", policies, 500, window_rows=260, minimum=100)
    rows, log = grid.predictions.collect(), grid.log.collect()
    assert len(rows) == 2 * 1500 and sum(e["retrained"] for e in log) == sum(e["pos"] >= 99 for e in log) == 140
    assert {(r["err"], r["y_true"]) for r in rows if r["pos"] == 200} == {(0, None)} and all(r["y_pred"] for r in rows)


def test_planned_runs_of_trees_need_no_turns(spark, monkeypatch):
    """Periodic models are fitted in one job and give what a turn after the other gives."""
    pdf = stream(1500, turns=(1000,))
    pdf.loc[700, "Label"], pdf["other"] = None, np.arange(1500) % 7
    pdf.loc[pdf.index % 11 == 3, "other"] = np.nan
    pdf.loc[1100:1250, "Label"] = "BENIGN"  # windows in here have one label, so the model stays
    df = spark.createDataFrame(pdf)
    policies = [ad.Static(), ad.Periodic(100), ad.Periodic(130)]

    def run():
        learner = pq.TreeLearner(["cell", "other"], maxIter=3, maxDepth=3)
        grid = pq.run_grid(df, learner, "Label", policies, 500, seeds=(1, 2), window_rows=140, minimum=110, share=0.7)
        rows = grid.predictions.orderBy("strategy", "seed", "pos").collect()
        log = grid.log.drop("train_seconds").orderBy("strategy", "seed", "pos").collect()
        return [r.asDict() for r in rows], log

    fitted, real = [], pq.TreeLearner.fit
    with monkeypatch.context() as m:
        m.setattr(pq, "_score", None)
        m.setattr(pq.TreeLearner, "fit", lambda self, rows, name, label, seeds: fitted.extend(seeds) or real(self, rows, name, label, seeds))
        rows, log = run()
    assert sorted(fitted) == ["first|1", "first|2"]
    monkeypatch.setattr(pq.TreeLearner, "in_tables", lambda self, window_rows: False)
    turns, turns_log = run()
    assert len(rows) == 3 * 2 * 1000 and rows == turns and log == turns_log
    assert {r["retrained"] for r in log} == {True, False}


def test_a_quiet_stream_takes_few_turns(spark, monkeypatch):
    """Stretches without a drift grow, so their number does not grow with the rows."""
    calls, real = [], pq._score
    monkeypatch.setattr(pq, "_score", lambda *a: calls.append(a[3]) or real(*a))
    grid = pq.run_grid(spark.createDataFrame(stream(3500, turns=())), pq.CellLearner("cell"), "Label", [ad.DriftTriggered()], 500, detector_params={"delta": 1e-9}, stretch_rows=100)
    assert grid.log.count() == 0 and grid.predictions.select("pos").distinct().count() == grid.predictions.count() == 3000
    assert [z - a + 1 for ((_, a, z, _),) in calls] == [100, 200, 400, 800, 1500]
