import numpy as np
import pytest

from tidemark.operators import active as al


def rows(spark, n=200, classes=3, batches=1):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1] * classes, n)
    return p, spark.createDataFrame([(i, i % batches, [float(v) for v in p[i]]) for i in range(n)], "id long, batch int, probabilities array<double>")


def test_ten_percent_of_the_least_certain(spark):
    p, df = rows(spark)
    got = al.select_for_labels(df, "uncertainty", "batch", ["id"], chunk_rows=16).collect()
    assert len(got) == 20
    assert {r["id"] for r in got} == set(np.argsort(p.max(axis=1), kind="stable")[:20].tolist())


def test_margin_and_single_class(spark):
    p, df = rows(spark)
    top = np.sort(p, axis=1)[:, ::-1]
    got = {r["id"] for r in al.select_for_labels(df, "margin", "batch", ["id"]).collect()}
    assert got == set(np.argsort(top[:, 0] - top[:, 1], kind="stable")[:20].tolist())
    _, one = rows(spark, 30, 1)
    assert {r["id"] for r in al.select_for_labels(one, "margin", "batch", ["id"]).collect()} == {0, 1, 2}


def test_small_batches_get_one_label_and_random_repeats(spark):
    _, df = rows(spark, 12, 3, batches=4)
    assert al.select_for_labels(df, "uncertainty", "batch", ["id"]).count() == 4
    pick = lambda d: sorted(r["id"] for r in al.select_for_labels(d, "random", "batch", ["id"], budget=0.5).collect())
    assert pick(df) == pick(df.repartition(5)) and len(pick(df)) == 4
    pool = al.labelled_pool([al.select_for_labels(df, s, "batch", ["id"]) for s in ("margin", "random")])
    eff = {r["strategy"]: r["label_efficiency"] for r in al.label_efficiency(pool, df).collect()}
    assert eff == {"margin": round(4 / 12, 4), "random": round(4 / 12, 4)}
    with pytest.raises(ValueError):
        al.score("nothing", "probabilities", ["id"])
