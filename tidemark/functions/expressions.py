"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def col(c: str | Column) -> Column:
    """Column of that exact name (names may contain dots, slashes and spaces)."""
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def is_infinite(c: str | Column) -> Column:
    return F.abs(col(c)) == F.lit(INF)


def finite(c: str | Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def not_nan(c: str | Column) -> Column:
    """The value, or NULL where it is NaN."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double with 0 for a zero denominator."""
    num, den = numerator.cast("double"), denominator.cast("double")
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def r6(c: str | Column) -> Column:
    return F.round(col(c), 6)


def hash_bits(seed: int | str, *cols: str | Column) -> Column:
    """First 32 bits of an md5 over the seed and the columns, as a long.

    md5 gives the same value in every engine and on every retry, so samples built on it
    are reproducible whatever the partitioning.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_uniform(seed: int | str, *cols: str | Column) -> Column:
    """Reproducible uniform number in [0, 1)."""
    return hash_bits(seed, *cols) / F.lit(4294967296.0)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Names of the numeric columns, in schema order; needs no job."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def long_form(df: DataFrame, features: list[str], keep: list[str | Column] | None = None) -> DataFrame:
    """One row per (row, feature): the kept columns plus ``feature`` and ``value`` (double).

    The values travel in one narrow ``explode`` and need no shuffle.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), col(f).cast("double").alias("value")) for f in features])
    kept = [col(k) for k in (keep or [])]
    return df.select(*kept, F.explode(cells).alias("_cell")).select(
        *[col(n) for n in df.select(*kept).columns], "_cell.feature", "_cell.value"
    )


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys where NULL equals NULL, so that no group gets lost."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & col(k).eqNullSafe(col(f"_r_{k}"))
    return left.join(right, match, how).drop(*[f"_r_{k}" for k in keys])
