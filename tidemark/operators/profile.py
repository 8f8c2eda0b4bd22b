"""Profiles of raw tables; each one is a single aggregation over all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col, is_floating, is_infinite, numeric_columns

# Day-first time stamp shapes of flow exports and name parts that give
# away the identity of an end point.
TIMESTAMP_FORMATS = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm")
LEAKAGE_PARTS = ("ip", "port", "flow id")


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is NULL or NaN."""
    c = col(name)
    return c.isNull() | F.isnan(c) if is_floating(df.schema[name].dataType) else c.isNull()


def parse_timestamp(c: str | Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """First format that fits, NULL where none does."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in formats])


def per_column(df: DataFrame, columns: list[str], measure, name: str) -> DataFrame:
    """``measure(column)`` aggregated for all columns in one pass, one row per column."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[measure(c).alias(f"_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias(name)) for i, c in enumerate(columns)])
    return row.select("n_rows", F.explode(cells).alias("c")).select("c.column", "n_rows", f"c.{name}")


def profile_nulls(df: DataFrame) -> DataFrame:
    """Type, row count and missing count per column, and the missing total."""
    out = per_column(df, df.columns, lambda c: F.count_if(missing(df, c)), "n_null")
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    total = out.agg(F.sum("n_null")).scalar()
    return out.select("column", kinds[F.col("column")].alias("dtype"), "n_rows", "n_null", total.alias("total_null"))


def profile_infinite(df: DataFrame) -> DataFrame:
    """Numeric columns that hold infinite values, with the total."""
    floats = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    out = per_column(df, floats, lambda c: F.count_if(is_infinite(c)), "n_infinite")
    total = out.agg(F.sum("n_infinite")).scalar()
    return out.filter("n_infinite > 0").select("column", "n_infinite", total.alias("total_infinite"))


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy; equal rows are merged before the shuffle."""
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percentage per label and the number of labels."""
    counts = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count("label").alias("labels")).alias("w")).scalar()
    return counts.select(
        "label", "n", F.round(F.col("n") * 100 / whole.getField("n"), 2).alias("pct"), whole.getField("labels").alias("n_labels")
    )


def temporal_info(df: DataFrame, timestamp: str, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> DataFrame:
    """First and last time, span, valid and invalid counts and the dates that occur."""
    if isinstance(df.schema[timestamp].dataType, T.StringType):
        parsed = parse_timestamp(timestamp, formats)
    else:
        parsed = col(timestamp).cast("timestamp")
    days = (
        df.select(parsed.alias("_t"))
        .groupBy(F.to_date("_t").alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_min"), F.max("_t").alias("_max"))
    )
    valid = F.col("_day").isNotNull()
    text = "yyyy-MM-dd HH:mm:ss"
    return days.agg(
        F.date_format(F.min("_min"), text).alias("first_time"),
        F.date_format(F.max("_max"), text).alias("last_time"),
        (F.unix_timestamp(F.max("_max")) - F.unix_timestamp(F.min("_min"))).alias("duration_s"),
        F.coalesce(F.sum(F.when(valid, F.col("_n"))), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum(F.when(~valid, F.col("_n"))), F.lit(0)).alias("n_invalid"),
        F.array_join(F.sort_array(F.collect_list(F.col("_day").cast("string"))), ",").alias("unique_dates"),
    )


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value; smallest = largest, so no distinct is needed."""

    def single(c: str) -> Column:
        v = F.when(~missing(df, c), col(c))
        return F.coalesce(F.min(v) == F.max(v), F.lit(True))

    return per_column(df, df.columns, single, "constant").filter("constant").select("column", "n_rows")


def leakage_columns(df: DataFrame, parts: tuple[str, ...] = LEAKAGE_PARTS) -> DataFrame:
    """Columns whose name suggests that they identify an end point, with their filled rows."""
    names = [c for c in df.columns if any(p in c.lower() for p in parts)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_rows long, n_filled long")
    return per_column(df, names, lambda c: F.count_if(~missing(df, c)), "n_filled")


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """16 hex digits over the whole table that do not depend on the row order."""
    text = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("\\N")) for c in df.columns])
    digest = F.md5(text)
    word = lambda at: F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(20,0)"))
    folded = lambda s: F.lower(F.lpad(F.hex((s % F.lit(4294967296)).cast("long")), 8, "0"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), word(1).alias("_a"), word(9).alias("_b")).select(
        "n_rows", F.concat(folded(F.col("_a")), folded(F.col("_b"))).alias("fingerprint")
    )


def common_features(a: DataFrame, b: DataFrame, exclude: tuple[str, ...] = ("Label", "Timestamp", "_original_label")) -> list[str]:
    """Sorted names of the numeric columns both tables have; needs no job."""
    return sorted(set(numeric_columns(a, exclude)) & set(numeric_columns(b, exclude)))


def common_feature_profile(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common features with their non-missing rows and means on both sides."""
    names = common_features(a, b)
    sides = []
    for side, df in (("a", a), ("b", b)):
        cells = F.array(*[
            F.struct(F.lit(n).alias("feature"), F.col(f"n{i}").alias(f"n_{side}"), F.col(f"m{i}").alias(f"mean_{side}"))
            for i, n in enumerate(names)
        ])
        aggs = [x for i, n in enumerate(names) for x in (F.count(col(n)).alias(f"n{i}"), F.avg(col(n)).alias(f"m{i}"))]
        sides.append(df.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*"))
    return sides[0].join(sides[1], "feature")
