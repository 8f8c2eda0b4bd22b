"""Chronological, row-order and random splits, ordered streams and row sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col, hash_bits, hash_uniform
from tidemark.operators.ordering import global_position, join_small, look_back, position_in_group
from tidemark.operators.profile import TIMESTAMP_FORMATS, parse_timestamp


def _by_position(pos: Column, n: Column, train: float, validation: float) -> Column:
    """Split name by position; bounds are cut in double arithmetic like ``int(n * f)``."""
    first = F.floor(n * F.lit(float(train)))
    second = F.floor(n * F.lit(float(train + validation)))
    return F.when(pos < first, "train").when(pos < second, "validation").otherwise("test")


def row_order_split(df: DataFrame, order: list[str], train: float = 0.70, validation: float = 0.10) -> DataFrame:
    """Split by rank in the given order; one ``split`` column instead of three tables."""
    placed = global_position(df, order, "pos", "_n")
    return placed.withColumn("split", _by_position(F.col("pos"), F.col("_n"), train, validation)).drop("_n")


def temporal_split(
    df: DataFrame, timestamp: str, tie_break: list[str], train: float = 0.70, validation: float = 0.10,
    formats: tuple[str, ...] = TIMESTAMP_FORMATS,
) -> DataFrame:
    """Chronological split; rows whose time cannot be read are left out."""
    if timestamp not in df.columns:
        return row_order_split(df, tie_break, train, validation)
    is_text = isinstance(df.schema[timestamp].dataType, T.StringType)
    parsed = parse_timestamp(timestamp, formats) if is_text else col(timestamp)
    timed = df.withColumn("_time", parsed).filter("_time IS NOT NULL")
    return row_order_split(timed, ["_time", *tie_break], train, validation).drop("_time")


def temporal_integrity(df: DataFrame, timestamp: str, split: str = "split") -> DataFrame:
    """Every ordered pair of splits with its bounds: ``ok`` unless the earlier one reaches past the later one.

    Rows that share the boundary time are reported as ``n_tied`` of the later split.
    """
    order = F.array(F.lit("train"), F.lit("validation"), F.lit("test"))
    per_time = df.groupBy(col(split).alias("split"), col(timestamp).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    bounds = per_time.groupBy("split").agg(
        F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.min_by("_n", "_t").alias("at_lo")
    )
    # at most three rows from here on
    later = bounds.select(
        F.col("split").alias("later"), F.col("lo").alias("later_min"), "at_lo",
        F.explode(F.slice(order, F.lit(1), (F.array_position(order, F.col("split")) - 1).cast("int"))).alias("earlier"),
    )
    earlier = bounds.select(F.col("split").alias("earlier"), F.col("hi").alias("earlier_max"))
    return later.join(earlier, "earlier").select(
        "earlier", "later", "earlier_max", "later_min",
        (F.col("earlier_max") <= F.col("later_min")).alias("ok"),
        F.when(F.col("earlier_max") == F.col("later_min"), F.col("at_lo")).otherwise(0).alias("n_tied"),
    )


def stratified_split(df: DataFrame, label: str, key: list[str], test: float = 0.20, seed: int = 42) -> DataFrame:
    """Exact share of every label in the test part, chosen by hash order.

    The order runs over (label, hash, key) across all partitions, so a label that holds
    most rows is not sorted in one task.  A label of two or more rows keeps at least one
    row on both sides.
    """
    hashed = df.withColumn("_h", hash_bits(seed, *key))
    ranked = position_in_group(hashed, [label], ["_h", *key], "_rank")
    joined = join_small(ranked, df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), [label])
    wanted = F.floor(F.col("_n") * F.lit(float(test)) + 0.5)
    wanted = F.when(F.col("_n") >= 2, F.least(F.greatest(wanted, F.lit(1)), F.col("_n") - 1)).otherwise(wanted)
    return joined.withColumn("split", F.when(F.col("_rank") < wanted, "test").otherwise("train")).drop("_h", "_rank", "_n")


def random_split(df: DataFrame, key: list[str], test: float = 0.20, seed: int = 42) -> DataFrame:
    """Row-wise split by hash threshold: no sort, no shuffle, same result on every retry."""
    return df.withColumn("split", F.when(hash_uniform(seed, *key) < F.lit(float(test)), "test").otherwise("train"))


def ordered_stream(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their 0-based position in the stream."""
    return global_position(df, order, "pos")


def position_batches(df: DataFrame, batch_rows: int, pos: str = "pos") -> DataFrame:
    """Batch number of each row, with the batch's [start, end) before the stream's end is known."""
    return df.withColumn("batch", F.floor(col(pos) / F.lit(batch_rows)))


def batch_bounds(df: DataFrame, batch_rows: int, pos: str = "pos") -> DataFrame:
    """Start, end and size of every batch; the last one may be short."""
    return (
        position_batches(df, batch_rows, pos).groupBy("batch")
        .agg(F.min(col(pos)).alias("start"), (F.max(col(pos)) + 1).alias("end"), F.count(F.lit(1)).alias("n_rows"))
    )


def equal_windows(pos: Column, n: Column, windows: int) -> Column:
    """Window number of ``n // windows`` rows each; the last one takes the remainder."""
    width = F.greatest(F.floor(n / F.lit(windows)), F.lit(1))
    return F.least(F.floor(pos / width), F.lit(windows - 1))


def sequence_windows(
    df: DataFrame, key: list[str], order: list[str], features: list[str], label: str, length: int, label_offset: int = 1, **kw
) -> DataFrame:
    """Every run of ``length`` consecutive rows of a stream with the label that belongs to it.

    ``label_offset`` 0 takes the label of the last row in the run, 1 that of the row after
    it.  The row holding the label is the current one, so the frame only looks back.
    """
    rows = df.withColumn("_x", F.array(*[col(f).cast("double") for f in features]))

    def build(w):
        frame = w.rowsBetween(-(length - 1) - label_offset, -label_offset)
        return {"sequence": F.collect_list("_x").over(frame), "_len": F.count("_x").over(frame)}

    out = look_back(rows, key, order, length - 1 + label_offset, build, **kw)
    return out.filter(F.col("_len") == length).select(*key, *order, "sequence", col(label).alias("label"))


def padded_short_streams(
    df: DataFrame, key: list[str], order: list[str], features: list[str], label: str, length: int, label_offset: int = 1
) -> DataFrame:
    """The one left-zero-padded sequence of every stream too short for ``sequence_windows``, with its last label.

    Longer streams are dropped before anything is collected, so a collected list never
    exceeds ``length`` rows.
    """
    small = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < length + label_offset)
    cells = F.struct(*order, F.array(*[col(f).cast("double") for f in features]).alias("_x"), col(label).alias("_y"))
    lists = df.join(small, key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(cells)).alias("_rows"))
    zero = F.array(*[F.lit(0.0) for _ in features])
    pad = F.array_repeat(zero, (F.lit(length) - F.size("_rows")).cast("int"))
    last = F.element_at("_rows", -1)
    return lists.select(
        *key, *[last[o].alias(o) for o in order],
        F.concat(pad, F.transform("_rows", lambda r: r["_x"])).alias("sequence"), last["_y"].alias("label"),
    )
