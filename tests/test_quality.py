import numpy as np
import pandas as pd
import pytest

from tidemark.operators import evaluate as ev
from tidemark.operators import experiments as ex


def pairs(spark, y_true, y_pred):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(y_true, y_pred))], "pos long, y_true string, y_pred string")


def test_perfect_and_all_wrong(spark):
    y = ["ATTACK"] * 5 + ["BENIGN"] * 5
    good = ev.binary_metrics(pairs(spark, y, y)).first()
    assert (good["accuracy"], good["f1"], good["mcc"], good["fpr"], good["fnr"]) == (1, 1, 1, 0, 0)
    bad = ev.binary_metrics(pairs(spark, y, y[::-1])).first()
    assert (bad["accuracy"], bad["f1"], bad["fnr"], bad["mcc"]) == (0, 0, 1, -1)


def test_rates_with_known_errors(spark):
    y = ["ATTACK"] * 50 + ["BENIGN"] * 50
    p = ["BENIGN"] * 10 + ["ATTACK"] * 40 + ["ATTACK"] * 5 + ["BENIGN"] * 45
    m = ev.binary_metrics(pairs(spark, y, p)).first()
    assert (m["tp"], m["fn"], m["fp"], m["tn"], m["support"]) == (40, 10, 5, 45, 100)
    assert m["fnr"] == pytest.approx(0.2) and m["fpr"] == pytest.approx(0.1)


def test_one_label_and_other_labels(spark):
    only = ev.binary_metrics(pairs(spark, ["BENIGN"] * 4, ["BENIGN"] * 4)).first()
    assert only["f1"] == 1 and only["fpr"] is None and only["tp"] is None and only["mcc"] == 0
    # neither is ATTACK: the last label is the positive one
    m = ev.binary_metrics(pairs(spark, ["a", "b", "b"], ["a", "b", "a"])).first()
    assert (m["tp"], m["fn"], m["fp"], m["tn"]) == (1, 1, 0, 1)
    assert ev.binary_metrics(pairs(spark, [], [])).first()["support"] is None


def test_windows_tail_and_ids(spark):
    y = ["ATTACK", "BENIGN"] * 52 + ["BENIGN"]
    w = ev.windowed_metrics(pairs(spark, y, y), window_rows=25).orderBy("window_id").collect()
    assert [r["window_id"] for r in w] == [0, 1, 2, 3, 4]
    assert [(r["window_start"], r["window_end"]) for r in w][-1] == (100, 105)
    drifts = spark.createDataFrame([(0,), (24,), (25,), (104,)], "pos long")
    hits = {r["window_id"]: r["n_drifts"] for r in ev.drift_in_window(ev.windowed_metrics(pairs(spark, y, y), window_rows=25), drifts, window_rows=25).collect()}
    assert hits == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}


def test_three_labels_against_hand_count(spark):
    y = ["a", "a", "b", "b", "c", "c"]
    p = ["a", "b", "b", "b", "d", "c"]  # d occurs only as a prediction
    report = {r["label"]: r for r in ev.classification_report(pairs(spark, y, p)).collect()}
    assert report["b"]["precision"] == pytest.approx(2 / 3) and report["b"]["recall"] == 1
    assert report["d"]["support"] == 0 and report["d"]["f1"] == 0
    m = ev.multiclass_metrics(pairs(spark, y, p)).first()
    assert m["n_labels"] == 4 and m["accuracy"] == pytest.approx(4 / 6)
    assert m["macro_recall"] == pytest.approx((0.5 + 1 + 0.5 + 0) / 4)
    grid = ev.confusion_matrix(pairs(spark, y, p)).collect()
    assert len(grid) == 16 and sum(r["n"] for r in grid) == 6


def test_rolling_and_cumulative_error(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"key": rng.choice(["h", "h", "x"], 300), "pos": range(300), "err": rng.integers(0, 2, 300)})
    df = spark.createDataFrame(pdf)
    got = ev.rolling_error(df, ["key"], ["pos"], rows=10, chunk_rows=13).toPandas().sort_values("pos")
    want = pdf.groupby("key")["err"].transform(lambda s: s.rolling(10, min_periods=1).mean())
    assert np.allclose(got["rolling_error"], want)
    got = ev.cumulative_error(df, ["key"], ["pos"], chunk_rows=13).toPandas().sort_values("pos")
    assert np.allclose(got["cumulative_error"], pdf.groupby("key")["err"].transform(lambda s: s.expanding().mean()))


def test_wilcoxon_ranks_ties_and_zeros(spark):
    rows = [(1.0, 0.0), (2.0, 1.0), (0.0, 3.0), (5.0, 5.0), (9.0, 4.0), (1.0, 5.0)]
    r = ex.wilcoxon_paired(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    # sizes 1 1 3 5 4: ranks 1.5 1.5 3 5 4
    assert (r["n_pairs"], r["w_plus"], r["w_minus"], r["statistic"]) == (5, 8.0, 7.0, 7.0)
    assert 0.8 < r["p_value"] <= 1.0


def test_bootstrap_interval_covers_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(70)], "i int, v double")
    r = ex.bootstrap_ci(df, "v", ["i"], replicates=200).first()
    assert r["n_replicates"] == 200 and r["ci_lower"] < r["mean"] < r["ci_upper"]
    assert r["ci_upper"] - r["ci_lower"] < 1.5


def test_run_summary(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("s", 3.0, 2.0)], "strategy string, f1 double, mcc double")
    got = {r["metric"]: (r["mean"], r["std"], r["n_runs"]) for r in ex.run_summary(df, ["strategy"], ["f1", "mcc"]).collect()}
    assert got == {"f1": (2.0, 1.0, 2), "mcc": (2.0, 0.0, 2)}
