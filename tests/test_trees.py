"""Histogram trees: one task against many, several labels, weights, missing values, importances."""

import io
import json
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as ml
from tidemark.operators import trees

SMALL = dict(trees=6, depth=4, min_rows=3)


def table(spark, n=900, labels=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    score = x[:, 0] + 0.5 * x[:, 1]
    y = np.digitize(score, np.quantile(score, np.linspace(0, 1, labels + 1)[1:-1]))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=[f"k{i}" for i in y], m=np.where(np.arange(n) % 3 == 0, "odd", "even"), i=range(n))
    pdf.loc[5, "c"], pdf.loc[6, "c"], pdf.loc[7, "y"] = np.nan, np.inf, None
    return spark.createDataFrame(pdf).repartition(3)


@pytest.mark.parametrize("algorithm,labels", [("gbt", 2), ("gbt", 3), ("rf", 3)])
def test_blocks_over_the_cluster_give_the_trees_of_one_task(spark, monkeypatch, algorithm, labels):
    df = table(spark, labels=labels)
    how = replace(ml.settings(algorithm), **SMALL)
    here = trees.fit_many(df, "m", list("abcd"), "y", how)
    monkeypatch.setattr(trees, "LOCAL_CELLS", 0)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    monkeypatch.setattr(trees, "WRITE_ROUNDS", 3)
    there = trees.fit_many(df.repartition(5), "m", list("abcd"), "y", how)
    assert set(here) == set(there) == {"odd", "even"}
    for m in here:
        assert len(here[m].trees) == how.trees * (labels if algorithm == "gbt" and labels > 2 else 1)
        for s, t, v, w in zip(here[m].trees, there[m].trees, here[m].values, there[m].values):
            assert all(np.array_equal(s[k], t[k]) for k in s) and np.allclose(v, w, atol=1e-12)


@pytest.mark.parametrize("keep", [1 << 24, 1])
def test_counting_in_lots_gives_the_same_tree(spark, monkeypatch, keep):
    monkeypatch.setattr(trees, "KEEP_CELLS", keep)
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 32, (3, 400)).astype(np.uint8), rng.integers(0, 2, 400)
    how = trees.Settings(trees=3, depth=5, min_rows=2, bins=32)
    rounds = trees.Rounds(how, 3, np.ones(2), np.bincount(y).astype(float))
    trees._local(rounds, bins, y, trees.mix(np.arange(400)))
    # a plain search for the best first split
    p = y.mean()
    g, h = np.rint((p - y) * trees.SCALE), np.rint(np.full(400, p * (1 - p)) * trees.SCALE)
    gain = {}
    for j in range(3):
        for b in range(31):
            left = bins[j] <= b
            if 2 <= left.sum() <= 398:
                gain[j, b] = sum(g[s].sum() ** 2 / h[s].sum() for s in (left, ~left))
    best = max(gain, key=gain.get)
    assert (rounds.trees[0]["feature"][0], rounds.trees[0]["bin"][0]) == best
    node = trees.route(rounds.trees[0], bins, levels=5)
    for leaf in np.unique(node):
        assert rounds.values[0][leaf] == pytest.approx(-0.1 * g[node == leaf].sum() / h[node == leaf].sum())
        assert (node == leaf).sum() >= 2


def test_quality_on_rows_never_seen(spark):
    df = table(spark, n=4000, seed=1)
    for algorithm in ("gbt", "rf"):
        how = {"maxIter": 40} if algorithm == "gbt" else {"numTrees": 40}
        model = ml.train(df.filter("i % 4 <> 0"), list("abcd"), "y", algorithm, **how)
        out = model.predict(df.filter("i % 4 = 0 AND y IS NOT NULL"))
        assert out.filter("y = y_pred").count() / out.count() > 0.9
        gain = dict(model.importances())
        assert gain["a"] > gain["b"] > max(gain["c"], gain["d"]) and sum(gain.values()) == pytest.approx(1)
        assert model.metadata["classes"] == ["k0", "k1", "k2"] and model.metadata["training_samples"] == 3000 - 1
        r = out.select("probabilities", "confidence").first()
        assert sum(r["probabilities"]) == pytest.approx(1) and r["confidence"] == max(r["probabilities"])


def test_missing_and_infinite_values_count_as_zero(spark):
    df = table(spark, labels=2)
    model = ml.train(df, list("abcd"), "y", maxIter=5)
    odd = spark.createDataFrame([(None, 1.0, float("nan"), 0.0), (0.0, 1.0, 0.0, 0.0), (float("inf"), 1.0, float("-inf"), 0.0)], "a double, b double, c double, d double")
    assert len({tuple(r["probabilities"]) for r in model.predict(odd).collect()}) == 1
    assert model.predict(odd.drop("d")).select("confidence").distinct().count() == 1


def test_balanced_weights_and_one_label(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=2000)})
    pdf["y"] = np.where(rng.random(2000) < np.where(pdf["a"] > 1, 0.3, 0.02), "rare", "usual")
    df = spark.createDataFrame(pdf)
    found = {b: ml.train(df, ["a"], "y", maxIter=20, balanced=b).predict(df).filter("a > 1 AND y_pred = 'rare'").count() for b in (True, False)}
    assert found[True] > 100 > found[False]
    only = ml.train(df.filter("y = 'usual'"), ["a"], "y").predict(df)
    assert only.select("y_pred").distinct().collect()[0][0] == "usual" and only.select("y_pred").distinct().count() == 1


def test_leaf_budget_and_round_trip():
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 255, (2, 3000)).astype(np.uint8), rng.integers(0, 2, 3000)
    how = trees.Settings(trees=4, min_rows=1)
    rounds = trees.Rounds(how, 2, np.ones(2), np.bincount(y).astype(float))
    trees._local(rounds, bins, y, trees.mix(np.arange(3000)))
    assert all((t["gain"] > 0).sum() == 62 for t in rounds.trees)
    model = trees.Trees(["n", "y"], ["a", "b"], [np.arange(254.0)] * 2, rounds.trees, rounds.values, rounds.start, how, {"x": 1})
    again = trees.Trees.from_bytes(model.to_bytes())
    columns = [rng.random(50) * 260 for _ in range(2)]
    assert np.array_equal(model.probabilities(columns), again.probabilities(columns)) and again.settings == how and again.metadata == {"x": 1}
    with pytest.raises(ValueError):
        ml.settings("lightning")


@pytest.mark.parametrize("algorithm", ["gbt", "rf"])
def test_rows_equal_in_all_bins_are_one_entry(spark, monkeypatch, algorithm):
    """Many rows over few values are grown in one task, with the trees of single rows, and scored once."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 3000).astype(float), "b": rng.integers(0, 5, 3000).astype(float)})
    pdf["y"] = np.where(rng.random(3000) < (pdf["a"] + pdf["b"]) / 10, "yes", "no")
    df = spark.createDataFrame(pdf).withColumn("m", F.lit("one"))
    how = replace(ml.settings(algorithm), **SMALL)
    with monkeypatch.context() as patch:
        patch.setattr(trees, "LOCAL_CELLS", 0)
        blocks = trees.fit_many(df, "m", ["a", "b"], "y", how)["one"]
    monkeypatch.setattr(trees, "LOCAL_CELLS", 200)  # 60 entries of two features, 3,000 rows
    monkeypatch.setattr(trees, "_fit_large", None)
    entries = trees.fit_many(df, "m", ["a", "b"], "y", how)["one"]
    for s, t, v, w in zip(entries.trees, blocks.trees, entries.values, blocks.values, strict=True):
        assert all(np.array_equal(s[k], t[k]) for k in s) and np.array_equal(v, w)
    met, whole = [], trees.Trees._of_bins
    monkeypatch.setattr(trees.Trees, "_of_bins", lambda self, bins: met.append(bins.shape[1]) or whole(self, bins))
    columns = [pdf["a"].to_numpy(), pdf["b"].to_numpy()]
    assert np.array_equal(entries.probabilities(columns), whole(entries, trees.binned(columns, entries.edges))) and met == [30]


def test_models_of_a_table_are_grown_in_the_jvm(spark, monkeypatch):
    """With two labels no model is grown by array operations, and all trees are those that these give."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": np.arange(4000) % 2, "a": rng.normal(size=4000), "b": rng.integers(0, 9, 4000).astype(float)})
    pdf["y"] = np.where(pdf["a"] + rng.normal(size=4000) > pdf["g"], "yes", "no")
    pdf.loc[3, "a"], pdf.loc[4, "b"], pdf.loc[5, "y"] = np.nan, np.inf, None
    pdf["draws"] = [[s for s in (7, 8) if rng.random() < 0.8] for _ in range(len(pdf))]
    df = spark.createDataFrame(pdf).repartition(1).cache()  # the sketches of edges see one order of rows
    how = {7: ml.settings(seed=7, maxIter=30), 8: ml.settings(seed=8, maxIter=12, maxLeaves=0, maxDepth=4, minInstancesPerNode=3)}

    def fitted():
        rows = trees.fit_table(df, ["g"], ["a", "b"], "y", "draws", how, 2).collect()
        assert all(r["seconds"] > 0 for r in rows)
        return {(r["g"], r["seed"]): trees.Trees.from_bytes(bytes(r["model"])) for r in rows}

    with monkeypatch.context() as patch:
        patch.setattr(trees, "_local", None)
        there = fitted()
    monkeypatch.setattr(trees.jvm, "function", lambda *a: None)
    here = fitted()
    assert set(here) == set(there) == {(g, s) for g in (0, 1) for s in (7, 8)}
    for m, model in here.items():
        other = there[m]
        assert (len(model.trees), model.labels, model.settings) == (how[m[1]].trees, other.labels, other.settings)
        for s, t, v, w in zip(model.trees, other.trees, model.values, other.values, strict=True):
            assert all(np.array_equal(s[k], t[k]) for k in ("feature", "bin", "left")) and np.allclose(s["gain"], t["gain"]) and np.allclose(v, w)
        assert model.metadata["training_samples"] == other.metadata["training_samples"] == sum(m[1] in d and y is not None for g, d, y in zip(pdf["g"], pdf["draws"], pdf["y"]) if g == m[0])


def test_models_saved_as_archives_are_still_read():
    how = trees.Settings(trees=1, bins=4)
    tree = {"feature": np.array([0, 0, 0], dtype=np.int32), "bin": np.array([1, 4, 4], dtype=np.int32), "left": np.array([1, 1, 2], dtype=np.int32), "gain": np.array([2.0, 0, 0])}
    model = trees.Trees(["n", "y"], ["a"], [np.array([0.0, 1.0])], [tree], [np.array([0.0, -1.0, 1.0])], np.zeros(1), how, {"x": 1})
    head = {"labels": model.labels, "features": model.features, "settings": how.__dict__, "metadata": model.metadata, "trees": 1}
    out = io.BytesIO()
    arrays = {f"{k}0": v for k, v in tree.items()} | {"value0": model.values[0], "edges0": model.edges[0], "start": model.start}
    np.savez_compressed(out, head=np.frombuffer(json.dumps(head).encode(), dtype=np.uint8), **arrays)
    x = [np.array([-1.0, 0.5, 3.0])]
    for raw in (out.getvalue(), model.to_bytes()):
        again = trees.Trees.from_bytes(raw)
        assert np.array_equal(again.probabilities(x), model.probabilities(x)) and again.settings == how and again.metadata == {"x": 1}


@pytest.mark.parametrize("labels,leaves", [(2, 63), (3, 7), (2, 0)])
def test_scoring_by_tables_equals_a_walk_down_the_trees(monkeypatch, labels, leaves):
    rng = np.random.default_rng(6)
    edges = [np.arange(n, dtype=float) for n in (254, 0, 30)]  # the second feature has one bin
    bins, y = np.stack([rng.integers(0, len(e) + 1, 2000) for e in edges]).astype(np.uint8), rng.integers(0, labels, 2000)
    how, rows = trees.Settings(trees=5, leaves=leaves, min_rows=2), np.bincount(y).astype(float)
    rounds = trees._Plan(list("abc"[:labels]), rows, np.ones(labels), edges).rounds(how, 3)
    trees._local(rounds, bins, y, None)
    model = trees.Trees(list("abc"[:labels]), list("xyz"), edges, rounds.trees, rounds.values, rounds.start, how)
    walked, route = [], trees.route
    monkeypatch.setattr(trees, "route", lambda *a, **kw: walked.append(1) or route(*a, **kw))
    fast = model._of_bins(bins)
    assert bool(walked) == (max(len(t["left"]) for t in rounds.trees) > 127)  # a longer row of leaves has no place in a table
    monkeypatch.setattr(trees, "TABLE_FEATURES", 0)
    assert np.array_equal(fast, model._of_bins(bins)) and walked


def test_a_key_whose_rows_no_seed_draws_has_no_model(spark, monkeypatch):
    rows = [(g, float(i % 5), "yes" if i % 2 else "no", [1] if g else []) for g in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows + [(1, 1.0, None, [1, 2]), (2, 1.0, "yes", [2])], "g int, a double, y string, draws array<long>")
    how = {s: ml.settings(seed=s, maxIter=2) for s in (1, 2)}
    for function in (trees.jvm.function, lambda *a: None):
        monkeypatch.setattr(trees.jvm, "function", function)
        found = {(r["g"], r["seed"]): trees.Trees.from_bytes(bytes(r["model"])) for r in trees.fit_table(df, ["g"], ["a"], "y", "draws", how, 3).collect()}
        assert set(found) == {(1, 1), (2, 2)} and found[2, 2].labels == ["yes"] and not found[2, 2].trees
        assert found[2, 2].probabilities([np.zeros(2)]).tolist() == [[1.0], [1.0]]
