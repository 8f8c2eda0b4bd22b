"""Classification quality: confusion counts, metrics, reports, metrics over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expressions import col, ratio
from tidemark.operators.ordering import global_position, look_back, running

POSITIVE = "ATTACK"


def pair_counts(df: DataFrame, y_true: str, y_pred: str, by: list[str]) -> DataFrame:
    """Rows per (by, true label, predicted label): the only pass over the data.

    The partial aggregation leaves a handful of rows per task, so a hot window or label
    costs nothing extra in the shuffle.
    """
    return df.groupBy(*by, col(y_true).alias("label_true"), col(y_pred).alias("label_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Count for every pair of labels that occur on either side, zeros included."""
    counts = pair_counts(df, y_true, y_pred, [])
    sides = counts.select(F.explode(F.array("label_true", "label_pred")).alias("label"))
    all_labels = sides.agg(F.sort_array(F.collect_set("label")).alias("labels")).scalar()
    grid = sides.distinct().select(F.col("label").alias("label_true"), F.explode(all_labels).alias("label_pred"))
    return grid.join(counts, ["label_true", "label_pred"], "left").select(
        "label_true", "label_pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def _binary_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    product = lambda *cs: F.lit(1.0) * cs[0] * cs[1] * cs[2] * cs[3]
    spread = F.sqrt(product(tp + fp, tp + fn, tn + fp, tn + fn))
    gap = tp.cast("double") * tn.cast("double") - fp.cast("double") * fn.cast("double")
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(gap, spread),
    }


def binary_metrics(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: list[str] | None = None, positive: str = POSITIVE
) -> DataFrame:
    """Accuracy, precision, recall, F1, MCC, FPR and FNR per group of at most two labels.

    The positive class is ``positive`` where it occurs in the group, else the last label.
    FPR, FNR and the four counts need exactly two labels and are NULL otherwise.
    """
    by = by or []
    counts = pair_counts(df, y_true, y_pred, by)
    group = Window.partitionBy(*by)  # at most four rows per group here
    seen = F.max((F.col("label_true") == positive) | (F.col("label_pred") == positive)).over(group)
    last = F.max(F.greatest("label_true", "label_pred")).over(group)
    first = F.min(F.least("label_true", "label_pred")).over(group)
    counts = counts.select(
        "*", F.when(seen, F.lit(positive)).otherwise(last).alias("_pos"), (last != first).alias("_two")
    )
    is_true, is_pred = F.col("label_true") == F.col("_pos"), F.col("label_pred") == F.col("_pos")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    agg = counts.groupBy(*by).agg(
        total(is_true & is_pred).alias("tp"),
        total(~is_true & is_pred).alias("fp"),
        total(is_true & ~is_pred).alias("fn"),
        total(~is_true & ~is_pred).alias("tn"),
        F.sum("n").alias("support"),
        F.max("_two").alias("_two"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    two = F.col("_two")
    return agg.select(
        *by,
        "support",
        *[c.alias(n) for n, c in _binary_columns(tp, fp, fn, tn).items()],
        F.when(two, ratio(fp, fp + tn)).alias("fpr"),
        F.when(two, ratio(fn, fn + tp)).alias("fnr"),
        *[F.when(two, c).alias(n) for n, c in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", tn))],
    )


def per_class(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every label on either side."""
    by = by or []
    counts = pair_counts(df, y_true, y_pred, by)
    hit = F.when(F.col("label_true") == F.col("label_pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("label_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    sums = (
        counts.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hits").alias("hits"))
    )
    return sums.select(
        *by,
        "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "predicted",
        "hits",
    )


def multiclass_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro precision/recall/F1, weighted F1 and multiclass MCC."""
    by = by or []
    d = lambda c: F.sum(F.col(c).cast("double"))
    agg = per_class(df, y_true, y_pred, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.sum("support").alias("support"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), d("support")).alias("weighted_f1"),
        d("hits").alias("_c"),
        d("support").alias("_s"),
        F.sum(F.col("predicted").cast("double") * F.col("support")).alias("_pt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("_pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("_tt"),
    )
    s2 = F.col("_s") * F.col("_s")
    mcc = ratio(F.col("_c") * F.col("_s") - F.col("_pt"), F.sqrt((s2 - F.col("_pp")) * (s2 - F.col("_tt"))))
    return agg.select(
        *by, "n_labels", "support", ratio(F.col("_c"), F.col("_s")).alias("accuracy"),
        "macro_precision", "macro_recall", "macro_f1", "weighted_f1", mcc.alias("mcc"),
    )


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-class rows followed by ``macro avg`` and ``weighted avg``."""
    classes = per_class(df, y_true, y_pred)
    scores = ("precision", "recall", "f1")
    macro = classes.agg(*[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support"))
    weighted = classes.agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores],
        F.sum("support").alias("support"),
    )
    columns = ["label", *scores, "support"]
    return (
        classes.select(*columns)
        .unionByName(macro.withColumn("label", F.lit("macro avg")).select(*columns))
        .unionByName(weighted.withColumn("label", F.lit("weighted avg")).select(*columns))
    )


def windowed_metrics(
    df: DataFrame, pos: str = "pos", window_rows: int = 5000, y_true: str = "y_true", y_pred: str = "y_pred",
    by: list[str] | None = None,
) -> DataFrame:
    """``binary_metrics`` per non-overlapping window of positions."""
    by = by or []
    cut = df.withColumn("window_id", F.floor(col(pos) / F.lit(window_rows)))
    out = binary_metrics(cut, y_true, y_pred, [*by, "window_id"])
    start = F.col("window_id") * F.lit(window_rows)
    return out.withColumn("window_start", start).withColumn("window_end", start + F.col("support"))


def metric_range(windows: DataFrame, metric: str = "f1", by: list[str] | None = None) -> DataFrame:
    """Smallest, largest, mean and population deviation of a metric over windows."""
    return windows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min(metric).alias(f"{metric}_min"),
        F.max(metric).alias(f"{metric}_max"),
        F.avg(metric).alias(f"{metric}_mean"),
        F.stddev_pop(metric).alias(f"{metric}_std"),
    )


def rolling_error(
    df: DataFrame, key: list[str], order: list[str], error: str = "err", rows: int = 500, name: str = "rolling_error", **kw
) -> DataFrame:
    """Mean of the last ``rows`` errors per stream; shorter at the start.

    The difference of two running sums costs the same for any ``rows``; a sliding frame
    would add up ``rows`` values for every row.
    """

    def build(w):
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        return [
            {"_sum": F.sum(col(error)).over(so_far), "_at": F.row_number().over(w)},
            {name: (F.col("_sum") - F.coalesce(F.lag("_sum", rows).over(w), F.lit(0))) / F.least("_at", F.lit(rows))},
        ]

    return look_back(df, key, order, rows, build, **kw).drop("_sum", "_at")


def cumulative_error(
    df: DataFrame, key: list[str], order: list[str], error: str = "err", name: str = "cumulative_error", **kw
) -> DataFrame:
    """Mean of all errors so far per stream."""
    what = {"_errors": ("sum", col(error)), "_rows": ("sum", F.lit(1).cast("long"))}
    return running(df, key, order, what, **kw).withColumn(name, F.col("_errors") / F.col("_rows")).drop("_errors", "_rows")


def drift_in_window(windows: DataFrame, drifts: DataFrame, pos: str = "pos", window_rows: int = 5000) -> DataFrame:
    """Number of drift positions inside each window, by equality on the window number."""
    hits = drifts.groupBy(F.floor(col(pos) / F.lit(window_rows)).alias("window_id")).agg(
        F.count(F.lit(1)).alias("n_drifts"), F.min(col(pos)).alias("first_drift")
    )
    return windows.join(hits, "window_id", "left").withColumn("n_drifts", F.coalesce("n_drifts", F.lit(0)))


def with_position(df: DataFrame, order: list[str], pos: str = "pos") -> DataFrame:
    return global_position(df, order, pos)
