"""Sharding by histogram sort: splitters from exact counts, then one exchange.

Rows are ordered by (key, tie).  For each wanted byte position the splitter is bracketed by
probes: all tasks count the bytes and rows between neighbouring probes, the bracket shrinks
to the interval that holds the position, and probes are placed anew until the nearest
boundary is within tolerance.  A key that alone holds more than the tolerance is split
along the tie column in the same way.  The exact counts also give every part's first slot,
so the rows move once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import slots
from tidemark.workspace import materialize, ship_package

LOW, HIGH = -(1 << 63), (1 << 63) - 1
PROBES = 16


@dataclass
class Splitter:
    """Rows below (key, tie) come before the boundary; ``weight`` and ``rows`` count them."""

    key: int
    tie: int
    weight: int
    rows: int


def _histogram(rows: DataFrame, column: str, probes: np.ndarray) -> pd.DataFrame:
    """Bytes, rows and extreme keys between neighbouring probes; one result row per interval."""
    bucket = F.pandas_udf(lambda v: pd.Series(np.searchsorted(probes, v.to_numpy(), side="right").astype(np.int64)), "long")
    agg = rows.select("_size", column).groupBy(bucket(column).alias("b")).agg(
        F.sum("_size").alias("w"), F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")
    )
    got = agg.toPandas().sort_values("b")  # bounded by the number of probes
    got["w_end"], got["n_end"] = got["w"].cumsum(), got["n"].cumsum()
    return got.reset_index(drop=True)


def _boundaries(rows: DataFrame, column: str, targets: list[int], tolerances: list[int]) -> list[tuple[int, int, int, int | None]]:
    """For each byte position: (boundary, bytes below, rows below, hot value or None).

    The last is a value that holds the position alone and whose nearer edge is out of
    tolerance.
    """
    answer: dict[int, tuple[int, int, int, int | None]] = {}
    bracket: dict[int, tuple[int, int]] = {i: (LOW, HIGH) for i in range(len(targets))}
    best: dict[int, tuple[int, int, int]] = {}
    while bracket:
        spans = set(bracket.values())
        count = max(PROBES, 1024 // len(spans))  # few brackets get more probes
        # a bracket's ends are probes too, so the next interval lies inside it
        inside = [lo - (lo - hi) * j // count for lo, hi in spans for j in range(count)]
        probes = np.unique(np.array(inside + [min(hi + 1, HIGH) for _, hi in spans], dtype=np.int64))
        got = _histogram(rows, column, probes)
        if got.empty:
            return [(HIGH, 0, 0, None) for _ in targets]
        ends = got["w_end"].to_numpy()
        for i in list(bracket):
            at = min(int(np.searchsorted(ends, targets[i], side="right")), len(got) - 1)
            lo, hi, weight, rows_here, w_end, n_end = (int(got[c][at]) for c in ("lo", "hi", "w", "n", "w_end", "n_end"))
            below, above = (lo, w_end - weight, n_end - rows_here), (min(hi, HIGH - 1) + 1, w_end, n_end)
            for c in (below, above):
                if i not in best or abs(c[1] - targets[i]) < abs(best[i][1] - targets[i]):
                    best[i] = c
            off = abs(best[i][1] - targets[i])
            if off <= tolerances[i]:
                answer[i] = (*best[i], None)
                del bracket[i]
            elif lo == hi:
                answer[i] = (*best[i], lo)
                del bracket[i]
            else:
                bracket[i] = (lo, hi)
    return [answer[i] for i in range(len(targets))]


def splitters(rows: DataFrame, shards: int, parts: int, close: float, hold: float) -> tuple[list[Splitter], int, int]:
    """Splitters for ``shards * parts`` parts of rows with ``_key``, ``_tie`` and ``_size``."""
    total, n = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = [total * j // (shards * parts) for j in range(1, shards * parts)]
    shard = total / shards
    # a shard's own edge must be close; edges inside a shard only spread the work
    tight = [int(shard * close) if j % parts == 0 else int(shard / parts / 5) for j in range(1, shards * parts)]
    found = _boundaries(rows, "_key", wanted, tight)
    out: list[Splitter] = []
    hot: dict[int, list[int]] = {}
    for j, (value, weight, below, alone) in enumerate(found):
        out.append(Splitter(value, LOW, weight, below))
        inner = (j + 1) % parts != 0
        if alone is not None and abs(weight - wanted[j]) > max(tight[j], 0 if inner else int(shard * hold)):
            hot.setdefault(alone, []).append(j)
    for value, numbers in hot.items():
        mine = rows.filter(F.col("_key") == F.lit(value))
        lower = rows.filter(F.col("_key") < F.lit(value)).agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
        inside = _boundaries(mine, "_tie", [wanted[j] - lower[0] for j in numbers], [tight[j] for j in numbers])
        for j, (tie, weight, below, _) in zip(numbers, inside):
            out[j] = Splitter(value, tie, weight + lower[0], below + lower[1])
    out.sort(key=lambda s: (s.weight, s.key, s.tie))
    return out, total, n


def histogram_sort(df: DataFrame, key: Column, tie: Column, size: Column, shards: int, parts: int | None = None, close: float = 0.001, hold: float = 0.01) -> DataFrame:
    """Add ``shard`` (0 ..) and ``slot`` (gapless from 0 in each shard) by nearly equal bytes.

    ``key`` and ``tie`` are whole numbers.  Rows of one key stay in one shard unless the
    nearest key boundary is more than ``hold`` of a shard away from its ideal place; such a
    key is split along ``tie``.  Rows that agree in both cannot be split; their order among
    each other is arbitrary.  Null ties order first, null keys count as the smallest key,
    null sizes as 0.  An empty table gives no rows.  Columns of ``df`` that are called
    ``shard`` or ``slot`` give way to the new ones, all others keep their values.  Each shard is sorted in ``parts``
    independent ranges (default: as many as give every shuffle partition one).
    """
    spark = df.sparkSession
    ship_package(spark)
    parts = parts or max(1, -(-slots(spark) // shards))
    keyed = df.select(F.struct("*").alias("_row"), F.coalesce(key, F.lit(LOW)).alias("_key"), F.coalesce(tie, F.lit(LOW)).alias("_tie"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    rows = materialize(keyed, "keyed")
    cuts, _, _ = splitters(rows, shards, parts, close, hold)
    keys, ties = np.array([c.key for c in cuts], dtype=np.int64), np.array([c.tie for c in cuts], dtype=np.int64)
    starts = [0, *[c.rows for c in cuts]]

    def part_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(), tie.to_numpy()
        out = np.searchsorted(keys, k, side="left")
        upto = np.searchsorted(keys, k, side="right")
        for value in np.unique(k[upto > out]):  # keys that are boundaries: compare ties
            own = np.flatnonzero(k == value)
            span = ties[out[own[0]] : upto[own[0]]]
            out[own] += np.searchsorted(span, t[own], side="right")
        return pd.Series(out.astype(np.int64))

    dealt = rows.withColumn("_part", F.pandas_udf(part_of, "long")("_key", "_tie"))
    # one row per part: bounded by the number of shuffle partitions
    table = spark.createDataFrame([(p, p // parts, starts[p] - starts[p // parts * parts]) for p in range(shards * parts)], "_part long, shard int, _first long")
    order = Window.partitionBy("_part").orderBy("_key", "_tie", "_size")
    placed = dealt.withColumn("_at", F.row_number().over(order) - 1)
    out = placed.join(F.broadcast(table), "_part").withColumn("slot", F.col("_first") + F.col("_at"))
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    return out.select(*[F.col("_row").getField(c).alias(c) for c in kept], "shard", "slot")
