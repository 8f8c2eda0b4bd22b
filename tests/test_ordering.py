import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.expressions import long_form
from tidemark.operators import ordering as o


def hot_frame(spark, n=3000, seed=1):
    """A third of all rows belongs to one key; values tie often."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, "hot", np.char.add("k", rng.integers(0, 40, n).astype(str)))
    pdf = pd.DataFrame({"key": key, "t": rng.integers(0, 50, n), "id": np.arange(n), "v": rng.integers(0, 9, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("partitions", [None, 1, 3, 50])
def test_global_position_is_exact_for_any_partitioning(spark, partitions):
    pdf, df = hot_frame(spark)
    got = o.global_position(df, ["t", "id"], "pos", "n", partitions).toPandas().sort_values("pos")
    want = pdf.sort_values(["t", "id"])
    assert got["pos"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == want["id"].tolist()
    assert set(got["n"]) == {len(pdf)}


def test_global_position_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, b string")
    assert o.global_position(empty, ["a"]).collect() == []


@pytest.mark.parametrize("chunk_rows", [10, 100, 5000])
def test_running_carries_across_chunks(spark, chunk_rows):
    pdf, df = hot_frame(spark)
    what = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.struct("v", "id"))}
    got = o.running(df, ["key"], ["t", "id"], what, chunk_rows=chunk_rows, partitions=5).toPandas().sort_values("id")
    want = pdf.sort_values(["t", "id"])
    want["s"] = want.groupby("key")["v"].cumsum()
    want["lo"] = want.groupby("key")["v"].cummin()
    want = want.sort_values("id")
    assert got["s"].tolist() == want["s"].tolist()
    assert got["lo"].tolist() == want["lo"].tolist()
    best, top = {}, {}
    for r in pdf.sort_values(["t", "id"]).itertuples():
        best[r.key] = max(best.get(r.key, (-1, -1)), (r.v, r.id))
        top[r.id] = best[r.key][1]
    assert [h["id"] for h in got["hi"]] == [top[i] for i in got["id"]]


def test_running_keeps_null_groups_and_all_rows(spark):
    df = spark.createDataFrame([(None, i, 1) if i % 2 else ("a", i, 1) for i in range(40)], "g string, i int, v int")
    got = o.running(df, ["g"], ["i"], {"s": ("sum", F.col("v"))}, chunk_rows=7)
    assert got.count() == 40
    assert {r["g"]: r["m"] for r in got.groupBy("g").agg(F.max("s").alias("m")).collect()} == {None: 20, "a": 20}


def test_running_global_and_position_in_group(spark):
    pdf, df = hot_frame(spark, 500)
    got = o.running(df, [], ["id"], {"s": ("sum", F.col("v"))}, chunk_rows=11).orderBy("id").toPandas()
    assert got["s"].tolist() == pdf["v"].cumsum().tolist()
    got = o.position_in_group(df, ["key"], ["id"], "r", chunk_rows=11).orderBy("id").toPandas()
    assert got["r"].tolist() == pdf.groupby("key").cumcount().tolist()


@pytest.mark.parametrize("rows,chunk_rows", [(1, 4), (5, 5), (30, 8), (30, 400)])
def test_look_back_sees_rows_of_earlier_chunks(spark, rows, chunk_rows):
    pdf, df = hot_frame(spark, 800)
    build = lambda w: {"m": F.sum("v").over(w.rowsBetween(-rows, 0)), "p": F.lag("id").over(w)}
    got = o.look_back(df, ["key"], ["t", "id"], rows, build, chunk_rows=chunk_rows).toPandas().sort_values("id")
    want = pdf.sort_values(["t", "id"])
    want["m"] = want.groupby("key")["v"].transform(lambda s: s.rolling(rows + 1, min_periods=1).sum())
    want["p"] = want.groupby("key")["id"].shift(1)
    want = want.sort_values("id")
    assert got["m"].tolist() == want["m"].tolist()
    assert got["p"].fillna(-1).tolist() == want["p"].fillna(-1).tolist()
    assert len(got) == len(pdf)


@pytest.mark.parametrize("margin", [0.0, 0.001, 1.0])
def test_quantiles_match_numpy(spark, margin):
    """A bracket of no width is widened until it holds the ranks."""
    pdf, df = hot_frame(spark)
    df = df.withColumn("w", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") * 1.5)).withColumn("u", F.when(F.col("id") == 7, 4.5))
    df = df.withColumn("z", F.pow(F.lit(1.001), F.col("id") % 2971))
    points = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["feature"]: r for r in o.quantiles_by_group(long_form(df, ["v", "w", "u", "z"]), ["feature"], "value", points, margin, partitions=6).collect()}
    w = pdf["id"][pdf["id"] % 3 != 0] * 1.5
    for name, values in (("v", pdf["v"]), ("w", w), ("u", [4.5]), ("z", 1.001 ** (pdf["id"] % 2971))):
        for p, q in points.items():
            assert got[name][p] == pytest.approx(np.percentile(values, q * 100)), (name, p)
    whole = o.quantiles_by_group(df, [], "v", {"m": 0.5}, margin).first()
    assert whole["m"] == np.median(pdf["v"])


def test_no_single_task_window_over_rows(spark):
    """The only un-partitioned window is the one over partition sizes."""
    _, df = hot_frame(spark, 100)
    out = o.running(df, ["key"], ["t", "id"], {"s": ("sum", F.col("v"))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
