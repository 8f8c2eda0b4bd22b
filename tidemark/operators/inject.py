"""Controlled drift for experiments: closed forms over the stream position.

Frames need a position column and a column with the stream length (``global_position``
gives both).  Deviations are population deviations of the untouched rows the definition
names; they reach the driver as one row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, hash_bits, hash_uniform

SCENARIOS = ("none", "sudden", "gradual", "incremental", "recurring")
EPSILON = 1e-10  # fixed value: keeps a constant feature from standing still


def direction(seed: int, feature: str) -> int:
    """+1 or -1 per feature, from the seed."""
    return 1 if int(hashlib.md5(f"{seed}|{feature}".encode()).hexdigest()[:8], 16) % 2 else -1


def _at(n: Column, fraction: float) -> Column:
    return F.floor(n * F.lit(float(fraction)))


def _deviations(df: DataFrame, features: list[str], rows: Column | None) -> dict[str, float]:
    value = lambda f: col(f) if rows is None else F.when(rows, col(f))
    row = df.agg(*[F.stddev_pop(value(f)).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return {f: (row[i] or 0.0) + EPSILON for i, f in enumerate(features)}


def _shift(df: DataFrame, features: list[str], amount: Column, magnitude: float, seed: int, sd: dict[str, float]) -> DataFrame:
    """Add ``amount`` (0..1) x magnitude x deviation x direction to each feature."""
    return df.withColumns({f: col(f) + amount * F.lit(magnitude * sd[f] * direction(seed, f)) for f in features})


def sudden(
    df: DataFrame, features: list[str], pos: str = "pos", n: str = "n", position: float = 0.6, magnitude: float = 0.3, seed: int = 42
) -> DataFrame:
    """A step at one point of the stream."""
    start = _at(col(n), position)
    sd = _deviations(df, features, col(pos) < start)
    return _shift(df, features, F.when(col(pos) >= start, 1.0).otherwise(0.0), magnitude, seed, sd)


def flip_labels(
    df: DataFrame, label: str, key: list[str], pos: str = "pos", n: str = "n", position: float = 0.6, rate: float = 0.1, seed: int = 42
) -> DataFrame:
    """After the point, each label becomes another one with probability ``rate``."""
    labels = df.groupBy(col(label).alias("_l")).count().agg(F.sort_array(F.collect_list("_l"))).scalar()
    other = F.array_except(labels, F.array(col(label)))
    pick = F.element_at(other, (hash_bits(seed + 1, *key) % F.size(other) + 1).cast("int"))
    hit = (col(pos) >= _at(col(n), position)) & (hash_uniform(seed, *key) < rate) & (F.size(other) > 0)
    return df.withColumn(label, F.when(hit, pick).otherwise(col(label)))


def gradual(
    df: DataFrame, features: list[str], pos: str = "pos", n: str = "n", start: float = 0.4, end: float = 0.7,
    magnitude: float = 0.3, seed: int = 42,
) -> DataFrame:
    """A shift that grows between two points and then stays."""
    s, e = _at(col(n), start), _at(col(n), end)
    sd = _deviations(df, features, col(pos) < s)
    progress = F.least((col(pos) - s) / F.greatest(e - s, F.lit(1)), F.lit(1.0))
    return _shift(df, features, F.when(col(pos) >= s, progress).otherwise(0.0), magnitude, seed, sd)


def incremental(
    df: DataFrame, features: list[str], pos: str = "pos", n: str = "n", magnitude: float = 0.1, seed: int = 42
) -> DataFrame:
    """A slow shift over the whole stream."""
    return _shift(df, features, col(pos) / col(n), magnitude, seed, _deviations(df, features, None))


def recurring(
    df: DataFrame, features: list[str], pos: str = "pos", n: str = "n", cycle: float = 0.25, magnitude: float = 0.3, seed: int = 42
) -> DataFrame:
    """A shift that comes and goes with every other cycle."""
    period = F.greatest(_at(col(n), cycle), F.lit(1))
    on = F.floor(col(pos) / period) % 2 == 1
    return _shift(df, features, F.when(on, 1.0).otherwise(0.0), magnitude, seed, _deviations(df, features, None))


def scenarios(df: DataFrame, features: list[str], pos: str = "pos", n: str = "n", seed: int = 42) -> DataFrame:
    """The stream once per scenario, told apart by a ``scenario`` column."""
    made = {
        "none": df,
        "sudden": sudden(df, features, pos, n, seed=seed),
        "gradual": gradual(df, features, pos, n, seed=seed),
        "incremental": incremental(df, features, pos, n, seed=seed),
        "recurring": recurring(df, features, pos, n, seed=seed),
    }
    out = None
    for name in SCENARIOS:
        part = made[name].withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def bernoulli_errors(
    df: DataFrame, pos: str = "pos", n: str = "n", change: float = 0.6, stable: float = 0.1, drifted: float = 0.4, seed: int = 42
) -> DataFrame:
    """A 0/1 error signal on the positions of a stream, with a higher rate after the change."""
    rate = F.when(col(pos) >= _at(col(n), change), drifted).otherwise(stable)
    return df.withColumn("error", (hash_uniform(seed, pos) < rate).cast("int"))
