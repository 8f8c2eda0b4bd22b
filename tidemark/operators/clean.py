"""Leakage-safe cleaning: everything that is learned comes from the training rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, finite, is_floating, is_infinite, long_form, numeric_columns, ratio
from tidemark.operators.ordering import global_position, join_small, quantiles_by_group
from tidemark.operators.profile import missing

# The names the label column goes by and the identifying columns.
LABEL_NAMES = ("Label", "label")
ID_COLUMNS = ("Flow ID", "Source IP", "Destination IP")


def tidy_header(df: DataFrame, label: str = "Label") -> DataFrame:
    """Trim column names and give the label column its usual name."""
    out = df.toDF(*[c.strip() for c in df.columns])
    for alias in LABEL_NAMES:
        if label not in out.columns and alias in out.columns:
            out = out.withColumnRenamed(alias, label)
    return out


def binary_label(c: str | Column, benign: str = "BENIGN", attack: str = "ATTACK") -> Column:
    """BENIGN for any spelling of it, ATTACK for the rest; a missing label stays missing."""
    text = F.upper(F.trim(col(c)))
    return F.when(text == benign.upper(), F.lit(benign)).when(text.isNotNull(), F.lit(attack))


def multiclass_label(c: str | Column) -> Column:
    return F.trim(col(c))


def infinite_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinite values become NULL, so that aggregates skip them."""
    floats = {f.name for f in df.schema.fields if is_floating(f.dataType)}
    return df.select(*[finite(c).alias(c) if c in floats else col(c) for c in df.columns])


def fill_values(df: DataFrame, columns: list[str], strategy: str = "median", approx: bool = False) -> dict[str, float]:
    """What a missing value of each column is replaced with.

    One small row reaches the driver.  ``approx`` trades exact medians for one pass
    without a shuffle of the values.
    """
    if strategy == "zero":
        return {c: 0.0 for c in columns}
    if strategy == "mean" or approx:
        measure = F.avg if strategy == "mean" else (lambda c: F.percentile_approx(c, 0.5, 10000))
        row = df.agg(*[measure(col(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
        found = {c: row[i] for i, c in enumerate(columns)}
    else:
        medians = quantiles_by_group(long_form(df, columns), ["feature"], "value", {"median": 0.5})
        found = {r["feature"]: r["median"] for r in medians.collect()}
    return {c: found[c] for c in columns if found.get(c) is not None}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace NULL by the given values; whole-number columns keep their type and take the rounded value."""

    def filled(c: str) -> Column:
        kind, value = df.schema[c].dataType, F.lit(values[c])
        return F.coalesce(col(c), value if is_floating(kind) else F.round(value).cast(kind))

    return df.select(*[filled(c).alias(c) if c in values else col(c) for c in df.columns])


def drop_null_rows(df: DataFrame, numeric_only: bool = False) -> DataFrame:
    """Rows without a missing value in any (numeric) column."""
    names = numeric_columns(df) if numeric_only else df.columns
    keep = F.lit(True)
    for c in names:
        keep = keep & ~missing(df, c)
    return df.filter(keep)


def near_constant_columns(df: DataFrame, columns: list[str], threshold: float = 0.99) -> list[str]:
    """Columns with one value, or one value that covers ``threshold`` of the non-missing rows.

    A value that covers more than half of the rows is the median, and an approximate
    median is exact for it.  So two aggregations without a shuffle of rows replace a count
    of every distinct value.
    """
    return [r["column"] for r in near_constant_shares(df, columns, threshold).filter("near_constant").collect()]


def near_constant_shares(df: DataFrame, columns: list[str], threshold: float = 0.99) -> DataFrame:
    if threshold <= 0.5:
        counted = long_form(df, columns).filter("value IS NOT NULL AND NOT isnan(value)")
        counted = counted.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        top = counted.groupBy("feature").agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"))
        shares = top.select(F.col("feature").alias("column"), ratio(F.col("top"), F.col("n")).alias("top_share"), (F.col("values") <= 1).alias("single"))
    else:
        value = {c: F.when(~missing(df, c), col(c).cast("double")) for c in columns}
        middle = df.agg(*[F.percentile_approx(value[c], 0.5, 10000).alias(f"_{i}") for i, c in enumerate(columns)]).first()
        row = df.agg(*[
            F.struct(
                F.lit(c).alias("column"),
                ratio(F.count_if(value[c] == F.lit(middle[i])), F.count(value[c])).alias("top_share"),
                F.coalesce(F.min(value[c]) == F.max(value[c]), F.lit(True)).alias("single"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ])
        shares = row.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(columns))])).alias("c")).select("c.*")
    flagged = F.col("single") | (F.col("top_share") >= threshold)
    return shares.select("column", F.when(flagged, F.col("top_share")).alias("top_share"), flagged.alias("near_constant"))


@dataclass
class CleanTable:
    """A cleaned table with its audit: (step, column, n) per count."""

    df: DataFrame
    report: DataFrame
    fills: dict[str, float] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)


def clean_table(
    df: DataFrame,
    label: str = "Label",
    timestamp: str = "Timestamp",
    task: str = "binary",
    strategy: str = "median",
    threshold: float = 0.99,
    id_columns: tuple[str, ...] = ID_COLUMNS,
    approx: bool = False,
) -> CleanTable:
    """Labels, infinities, imputation, null rows, id columns, constants, duplicates - in this order.

    Medians and near-constant columns need one small action each, because they decide the
    schema of the result; everything else is one lazy plan.
    """
    raw = tidy_header(df, label)
    if label in raw.columns:
        raw = raw.withColumn(label, binary_label(label) if task == "binary" else multiclass_label(label))
    features = numeric_columns(raw, (label, timestamp))
    floats = [c for c in features if is_floating(raw.schema[c].dataType)]
    finite_rows = infinite_to_null(raw)
    fills = fill_values(finite_rows, features, strategy, approx)
    kept = drop_null_rows(impute(finite_rows, fills))
    ids = [c for c in id_columns if c in kept.columns]
    kept = kept.drop(*ids)
    flat = near_constant_columns(kept, numeric_columns(kept, (label, timestamp)), threshold)
    out = kept.drop(*flat).dropDuplicates()

    counts = raw.agg(
        F.count(F.lit(1)).alias("rows_before"),
        *[F.count_if(is_infinite(c)).alias(f"inf_{i}") for i, c in enumerate(floats)],
    )
    empty = finite_rows.agg(*[F.count_if(col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(features)])
    after_null = kept.agg(F.count(F.lit(1)).alias("n"))
    after = out.agg(F.count(F.lit(1)).alias("n"))
    entry = lambda step, column, n: F.struct(
        F.lit(step).alias("step"), F.lit(column).alias("column"), n.cast("long").alias("n")
    )
    before = counts.select("rows_before").scalar()
    lines = [
        counts.select(F.explode(F.array(
            entry("rows_before", "", F.col("rows_before")),
            entry("columns_before", "", F.lit(len(df.columns))),
            *[entry("infinite", c, F.col(f"inf_{i}")) for i, c in enumerate(floats)],
        )).alias("e")),
        empty.select(F.explode(F.array(*[entry("filled", c, F.col(f"null_{i}")) for i, c in enumerate(features)])).alias("e")),
        after_null.select(F.explode(F.array(
            entry("null_rows", "", before - F.col("n")),
            *[entry("dropped_id", c, F.lit(1)) for c in ids],
            *[entry("dropped_constant", c, F.lit(1)) for c in flat],
        )).alias("e")),
        after.select(F.explode(F.array(
            entry("duplicates", "", after_null.scalar() - F.col("n")),
            entry("rows_after", "", F.col("n")),
            entry("columns_after", "", F.lit(len(out.columns))),
        )).alias("e")),
    ]
    report = lines[0]
    for more in lines[1:]:
        report = report.unionByName(more)
    return CleanTable(out, report.select("e.*").filter("n > 0"), fills, ids + flat)


@dataclass
class FittedCleaner:
    """What was learned on the training rows: column order, fills, means and deviations."""

    features: list[str]
    fills: dict[str, float]
    label: str = "Label"
    task: str = "binary"
    scale: dict[str, tuple[float, float]] | None = None
    dropped: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame, keep: list[str] | None = None, remove_duplicates: bool = False) -> DataFrame:
        """Same columns in the same order for any table; absent features become 0.

        ``remove_duplicates`` drops repeated rows, the dropped columns left out of account.
        """
        out = tidy_header(df, self.label)
        if remove_duplicates:
            out = impute(infinite_to_null(out.drop(*self.dropped)), self.fills).dropDuplicates()
        if self.label in out.columns:
            out = out.withColumn(self.label, binary_label(self.label) if self.task == "binary" else multiclass_label(self.label))
        kept = [c for c in [*(keep or []), self.label] if c in out.columns]
        values = []
        for f in self.features:
            v = finite(col(f).cast("double")) if f in out.columns else F.lit(0.0)
            v = F.coalesce(v, F.lit(float(self.fills.get(f, 0.0))))
            if self.scale:
                mean, sd = self.scale[f]
                v = (v - F.lit(mean)) / F.lit(sd)
            values.append(v.alias(f))
        return out.select(*[col(c) for c in kept], *values)


def fit_cleaner(
    train: DataFrame, label: str = "Label", timestamp: str = "Timestamp", task: str = "binary", strategy: str = "median",
    threshold: float = 0.99, id_columns: tuple[str, ...] = ID_COLUMNS, scale: bool = False, approx: bool = False,
    features: list[str] | None = None,
) -> FittedCleaner:
    """Learn fills, dropped columns and scaling from the training rows only."""
    rows = infinite_to_null(tidy_header(train, label)).drop(*id_columns)
    names = features or numeric_columns(rows, (label, timestamp))
    fills = fill_values(rows, names, strategy, approx)
    filled = impute(rows, fills)
    if features is None:
        flat = set(near_constant_columns(filled, names, threshold))
        names = [c for c in names if c not in flat]
    dropped = [c for c in [*id_columns, *fills] if c not in names]
    fitted = FittedCleaner(names, fills, label, task, dropped=dropped)
    if scale:
        row = filled.agg(*[x for i, c in enumerate(names) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]).first()
        fitted.scale = {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(names)}
    return fitted


def coerce_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text or numbers to double; whatever is missing, unreadable or infinite becomes 0."""
    return df.select(*[
        F.coalesce(finite(col(c).try_cast("double")), F.lit(0.0)).alias(c) if c in columns else col(c) for c in df.columns
    ])


def categorical_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace text by the rank of its value among all distinct values, from 0.

    The dictionary is ranked with a distributed sort and joined by its measured size.
    """
    for c in columns:
        values = df.select(c).filter(col(c).isNotNull()).distinct()
        df = join_small(df, global_position(values, [c], "_code"), [c], "left").withColumn(c, F.col("_code")).drop("_code")
    return df


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per label: rows / (labels x rows of the label)."""
    counts = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("w")).scalar()
    return counts.select("label", "n", (whole.getField("n") / (whole.getField("k") * F.col("n"))).alias("weight"))


def dedupe_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()
