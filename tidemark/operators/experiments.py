"""Comparing runs: strategy tables, run summaries, bootstrap and paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, hash_bits, ratio
from tidemark.operators.evaluate import binary_metrics
from tidemark.operators.ordering import global_position, quantiles_by_group, running


def strategy_comparison(
    df: DataFrame, retrains: DataFrame, baseline: str = "static", periodic: str = "periodic_5000",
    y_true: str = "y_true", y_pred: str = "y_pred",
) -> DataFrame:
    """Metrics per strategy next to the baseline.

    ``retrains`` has (strategy, n_retrains).  ``recovery`` is the F1 gain over the
    baseline, ``improvement_pct`` the same relative to it, ``degradation_pct`` the loss
    against the best strategy and ``retrain_saving_pct`` the share of retrains saved
    against the periodic policy.
    """
    metrics = binary_metrics(df, y_true, y_pred, ["strategy"]).join(retrains, "strategy", "left")
    metrics = metrics.withColumn("n_retrains", F.coalesce("n_retrains", F.lit(0)).cast("long"))
    # one row: the reference values all strategies are compared with
    ref = metrics.agg(
        F.struct(
            F.max(F.when(F.col("strategy") == baseline, F.col("f1"))).alias("base"),
            F.max("f1").alias("best"),
            F.max(F.when(F.col("strategy") == periodic, F.col("n_retrains"))).alias("retrains"),
        ).alias("r")
    ).scalar()
    base, best, n = ref.getField("base"), ref.getField("best"), ref.getField("retrains")
    return metrics.select(
        "*",
        (F.col("f1") - base).alias("recovery"),
        (100 * ratio(F.col("f1") - base, base)).alias("improvement_pct"),
        (100 * ratio(best - F.col("f1"), best)).alias("degradation_pct"),
        F.when(n > 0, 100 * (1 - F.col("n_retrains") / n)).otherwise(0.0).alias("retrain_saving_pct"),
    )


def run_summary(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation over runs, one row per (by, metric)."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("value")) for m in metrics])
    return (
        runs.select(*by, F.explode(cells).alias("c"))
        .groupBy(*by, F.col("c.metric").alias("metric"))
        .agg(F.count("c.value").alias("n_runs"), F.avg("c.value").alias("mean"), F.stddev_pop("c.value").alias("std"))
    )


def bootstrap_ci(
    df: DataFrame, value: str, order: list[str], replicates: int = 1000, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """Percentile interval of the mean over resamples with replacement.

    Every position draws one position per replicate by hash, so the draws are the same in
    any engine and on any retry.  The draws are counted per drawn position before they
    meet the values: the join moves positions, not draws.
    """
    placed = global_position(df.select(*order, value), order, "_j", "_n")
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep")
    draws = placed.select("_j", "_n", reps).select(
        "_rep", (hash_bits(seed, "_rep", "_j") % F.col("_n")).alias("_j")
    )
    times = draws.groupBy("_rep", "_j").agg(F.count(F.lit(1)).alias("_times"))
    means = (
        times.join(placed.select("_j", value), "_j")
        .groupBy("_rep")
        .agg((F.sum(col(value) * F.col("_times")) / F.sum("_times")).alias("_mean"))
    )
    tail = (1 - confidence) / 2
    # one mean per replicate, so the built-in exact percentile is bounded
    ends = means.agg(
        F.count(F.lit(1)).alias("n_replicates"),
        F.percentile("_mean", F.lit(tail)).alias("ci_lower"),
        F.percentile("_mean", F.lit(1 - tail)).alias("ci_upper"),
    )
    observed = placed.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).alias("o")).scalar()
    return ends.select(observed.getField("n").alias("n_values"), observed.getField("mean").alias("mean"), "*")


def wilcoxon_paired(df: DataFrame, a: str | Column, b: str | Column, by: list[str] | None = None) -> DataFrame:
    """Wilcoxon signed-rank test of paired values per group.

    Zero differences are dropped and tied sizes share their mean rank.  Equal sizes are
    counted first, then summed along the order across partitions, so the ranks need no
    window over a whole group.  The p-value is the two-sided normal approximation with tie
    correction and without continuity correction.
    """
    by = by or []
    diff = col(a) - col(b)
    sizes = (
        df.select(*by, F.round(diff, 12).alias("_d"))
        .filter("_d <> 0")
        .groupBy(*by, F.abs("_d").alias("_size"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("_d") > 0).cast("long")).alias("_up"))
    )
    ranked = running(sizes, by, ["_size"], {"_upto": ("sum", F.col("_n"))})
    rank = F.col("_upto") - (F.col("_n") - 1) / 2.0
    ties = F.col("_n").cast("double") * (F.col("_n") * F.col("_n") - 1)
    sums = ranked.groupBy(*by).agg(
        F.sum("_n").alias("n_pairs"),
        F.sum(rank * F.col("_up")).alias("w_plus"),
        F.sum(rank * (F.col("_n") - F.col("_up"))).alias("w_minus"),
        F.sum(ties).alias("_ties"),
    )
    n = F.col("n_pairs").cast("double")
    w = F.least("w_plus", "w_minus")
    mean = n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = ratio(w - mean, sd)
    return sums.select(*by, "n_pairs", "w_plus", "w_minus", w.alias("statistic"), z.alias("z")).withColumn(
        "p_value", F.least(F.lit(1.0), 2 * normal_cdf(F.col("z")))
    )


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution for z <= 0 (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    # fixed values of the published approximation
    p, coefficients = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 - p * z)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    return poly * F.exp(-z * z / 2) / F.lit(2.5066282746310002)


def summary_quantiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and quartiles of a run metric."""
    return quantiles_by_group(df, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
