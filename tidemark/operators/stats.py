"""Feature statistics, distribution shifts between periods, histograms, traffic over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, finite, long_form, not_nan
from tidemark.operators.ordering import quantiles_by_group, running
from tidemark.operators.split import equal_windows

# The candidate flow features, in their usual order.
FLOW_FEATURE_NAMES = (
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean",
    "Fwd Packet Length Std", "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max",
    "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total",
    "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags",
    "Bwd URG Flags", "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s", "Min Packet Length",
    "Max Packet Length", "Packet Length Mean", "Packet Length Std", "Packet Length Variance", "FIN Flag Count",
    "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "Down/Up Ratio",
    "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size", "Subflow Fwd Packets", "Subflow Fwd Bytes",
    "Subflow Bwd Packets", "Subflow Bwd Bytes", "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "act_data_pkt_fwd", "min_seg_size_forward", "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean",
    "Idle Std", "Idle Max", "Idle Min",
)
QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p99": 0.99}


def available_features(df: DataFrame, candidates: tuple[str, ...] | list[str] = FLOW_FEATURE_NAMES) -> list[str]:
    """The candidates the table has, in the candidates' order; needs no job."""
    return [c for c in candidates if c in df.columns]


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean, deviation, quantiles, extremes, missing, distinct, skewness and kurtosis.

    Moments come from one partial aggregation.  Skewness and kurtosis are corrected for
    bias (the built-ins are population moments).
    """
    cells = long_form(df, features).withColumn("value", not_nan("value"))
    n, g1, g2 = F.col("count"), F.col("_g1"), F.col("_g2")
    moments = cells.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"),
    )
    nd = n.cast("double")
    corrected = moments.withColumns({
        "skewness": F.when(n > 2, g1 * F.sqrt(nd * (nd - 1)) / (nd - 2)),
        "kurtosis": F.when(n > 3, (nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g2 + 6)),
    }).drop("_g1", "_g2")
    spread = quantiles_by_group(cells, ["feature"], "value", QUANTILES)
    distinct = cells.groupBy("feature", "value").agg(F.count("value").alias("_n")).groupBy("feature").agg(F.count_if(F.col("_n") > 0).alias("n_unique"))
    return corrected.join(spread, "feature", "left").join(distinct, "feature")


def window_compare(df: DataFrame, features: list[str], in_second: Column) -> DataFrame:
    """Mean, sample deviation and shifts of two windows in one pass."""
    cells = long_form(df.withColumn("_b", in_second), features, keep=["_b"])
    side = lambda fn, flag: fn(F.when(flag, F.col("value")))
    b = F.col("_b")
    out = cells.groupBy("feature").agg(
        side(F.avg, ~b).alias("mean_a"), side(F.stddev_samp, ~b).alias("std_a"),
        side(F.avg, b).alias("mean_b"), side(F.stddev_samp, b).alias("std_b"),
    )
    shift = F.col("mean_b") - F.col("mean_a")
    return out.withColumn("mean_shift", shift).withColumn("relative_shift", F.abs(shift) / (F.abs("mean_a") + 1e-10))


def kolmogorov_tail(lam: Column, terms: int = 100) -> Column:
    """Probability that the Kolmogorov statistic exceeds ``lam`` (alternating series)."""
    k = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(
        k, F.lit(0.0),
        lambda s, i: s + F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * lam * lam),
    )
    # below 0.2 the probability is 1 within 1e-12, and the series would need more terms
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def ks_two_sample(df: DataFrame, features: list[str], in_second: Column, min_rows: int = 10, alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of every feature at once.

    Equal values are counted before the shuffle; the two cumulative counts run along
    (feature, value) across partitions, so no feature is confined to one task.
    """
    cells = long_form(df.withColumn("_b", in_second), features, keep=["_b"])
    cells = cells.withColumn("value", not_nan("value")).filter("value IS NOT NULL")
    b = F.col("_b")
    counted = cells.groupBy("feature", "value").agg(F.count_if(~b).alias("_na"), F.count_if(b).alias("_nb"))
    summed = running(counted, ["feature"], ["value"], {"_ca": ("sum", F.col("_na")), "_cb": ("sum", F.col("_nb"))})
    side = lambda fn, flag: fn(F.when(flag, F.col("value")))
    moments = cells.groupBy("feature").agg(
        F.count_if(~b).alias("n_a"), F.count_if(b).alias("n_b"),
        side(F.avg, ~b).alias("mean_a"), side(F.avg, b).alias("mean_b"),
        side(F.stddev_pop, ~b).alias("std_a"), side(F.stddev_pop, b).alias("std_b"),
    ).filter((F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows))
    gap = F.abs(F.col("_ca") / F.col("n_a") - F.col("_cb") / F.col("n_b"))
    sizes = F.broadcast(moments.select("feature", "n_a", "n_b"))  # one row per feature column
    distance = summed.join(sizes, "feature").groupBy("feature").agg(F.max(gap).alias("ks_statistic"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    lam = F.sqrt(na * nb / (na + nb)) * F.col("ks_statistic")
    shift = F.abs(F.col("mean_b") - F.col("mean_a"))
    out = moments.join(distance, "feature").withColumn("p_value", kolmogorov_tail(lam))
    return out.withColumns({
        "significant": F.col("p_value") < alpha, "mean_shift": shift, "relative_shift": shift / (F.abs("mean_a") + 1e-10)
    })


def ks_summary(ks: DataFrame) -> DataFrame:
    """Features tested, features that drifted and their percentage."""
    n, hit = F.count(F.lit(1)), F.count_if("significant")
    return ks.agg(n.alias("n_features"), hit.alias("n_significant"), F.round(hit / n * 100, 1).alias("pct_drifted"))


def ks_top_features(ks: DataFrame, k: int = 10) -> DataFrame:
    return ks.orderBy(F.desc("ks_statistic"), "feature").limit(k)


def windowed_feature_stats(df: DataFrame, features: list[str], pos: str, n: Column, windows: int = 5) -> DataFrame:
    """Mean, population deviation and exact median per (window, feature)."""
    cut = df.withColumn("_w", equal_windows(col(pos), n, windows))
    cells = long_form(cut, features, keep=["_w"]).withColumn("value", not_nan("value")).filter("value IS NOT NULL")
    cells = cells.withColumnRenamed("_w", "window")
    moments = cells.groupBy("window", "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    return moments.join(quantiles_by_group(cells, ["window", "feature"], "value", {"median": 0.5}), ["window", "feature"])


def feature_histogram(df: DataFrame, features: list[str], bins: int = 50, in_second: Column | None = None) -> DataFrame:
    """Counts and densities in equal bins between the finite extremes; empty bins included.

    The extremes of all features are one row that reaches the driver; every cell then finds
    its bin by arithmetic.
    With ``in_second`` both samples share the bins and have their own density.
    """
    side = F.when(in_second, "b").otherwise("a") if in_second is not None else F.lit("a")
    values = df.select(side.alias("side"), *[finite(col(f).cast("double")).alias(f"_{i}") for i, f in enumerate(features)])
    ends = values.agg(*[x for i in range(len(features)) for x in (F.min(f"_{i}").alias(f"lo{i}"), F.max(f"_{i}").alias(f"hi{i}"))]).first()
    sides = ("a", "b") if in_second is not None else ("a",)
    cells = []
    for i, f in enumerate(features):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None:
            continue
        v, width = F.col(f"_{i}"), hi - lo
        at = F.least(F.floor((v - lo) / width * bins), F.lit(bins - 1)) if width > 0 else F.lit(0)
        cells.append(F.struct(
            F.lit(f).alias("feature"), F.when(v.isNotNull(), at).cast("long").alias("bin"), F.lit(lo).alias("lo"), F.lit(width).alias("width")
        ))
    counted = (
        values.select("side", F.explode(F.array(*cells)).alias("c")).select("side", "c.*").filter("bin IS NOT NULL")
        .groupBy("feature", "side", "bin", "lo", "width").agg(F.count(F.lit(1)).alias("n"))
    )
    # at most features x sides x bins rows from here on
    known = counted.groupBy("feature", "lo", "width").agg(F.sum("n").alias("_all"))
    grid = known.select("feature", "lo", "width", F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    full = grid.join(counted.select("feature", "side", "bin", "n"), ["feature", "side", "bin"], "left")
    sizes = counted.groupBy("feature", "side").agg(F.sum("n").alias("_size"))
    step = F.col("width") / bins
    return full.join(sizes, ["feature", "side"]).select(
        "feature", "side", "bin", (F.col("lo") + step * F.col("bin")).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(step > 0, F.coalesce("n", F.lit(0)) / (F.col("_size") * step)).alias("density"),
    )


def traffic_hourly(df: DataFrame, timestamp: str) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", col(timestamp)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
