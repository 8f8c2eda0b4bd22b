"""Global order without a single-task window.

``Window.orderBy`` without a partition key moves every row to one task, and a window
partitioned by a natural key moves a hot key to one task.  The operators here range-
partition on the full ordering key instead, so equal work reaches every task whatever the
key distribution, and carry the few numbers that cross a boundary in a table with one row
per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.expressions import col, join_on
from tidemark.workspace import materialize

MIN_CHUNK_ROWS = 4_096
MAX_CHUNK_ROWS = 4_000_000
MAX_BROADCAST_ROWS = 100_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def global_position(
    df: DataFrame,
    order: list[str | Column],
    name: str = "pos",
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add the exact 0-based rank of each row in the given total order.

    One range shuffle sorts the rows; the layout is then written, because two runs of the
    range sampling may cut differently.  Only one row per partition takes part in the
    offset sum.  ``order`` must be total (append a unique column); ties are otherwise
    ranked arbitrarily.  ``total`` names an optional column holding the row count.
    """
    keys = [col(c) for c in order]
    # Without an explicit number AQE merges small neighbouring ranges.
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    stored = materialize(
        ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()), "ordered"
    )
    stored = stored.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    )
    # at most one row per shuffle partition, whatever the size of the data
    out = stored.join(F.broadcast(offsets), "_part")
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = out.withColumn(name, F.col("_offset") + row)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_mid", "_offset", "_total")


def _chunk_rows(df: DataFrame, total: Column, at_least: int, chunk_rows: int | None) -> Column:
    if chunk_rows:
        return F.lit(max(chunk_rows, at_least)).cast("long")
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # four chunks per slot even out the hashing of chunk numbers to tasks
    even = F.least(F.lit(MAX_CHUNK_ROWS), F.ceil(total / F.lit(4 * slots)))
    return F.greatest(even, F.lit(max(MIN_CHUNK_ROWS, at_least))).cast("long")


def in_chunks(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    halo: int = 0,
    chunk_rows: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Cut the (group, order) sequence into chunks of equal row count.

    Adds ``_pos`` and ``_chunk``.  With ``halo`` each chunk also receives copies of the
    last ``halo`` rows of the chunk before it, marked ``_own = false``, so that windows
    reaching back at most ``halo`` rows are complete inside one chunk.
    """
    placed = global_position(df, [*group, *order], "_pos", "_stream_rows", partitions)
    size = _chunk_rows(df, F.col("_stream_rows"), halo, chunk_rows)
    placed = placed.withColumn("_chunk_rows", size).withColumn("_home", F.floor(F.col("_pos") / F.col("_chunk_rows")))
    if halo:
        near_end = F.col("_pos") % F.col("_chunk_rows") >= F.col("_chunk_rows") - F.lit(halo)
        targets = F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
        placed = placed.withColumn("_chunk", F.explode(targets)).withColumn("_own", F.col("_chunk") == F.col("_home"))
    else:
        placed = placed.withColumn("_chunk", F.col("_home"))
    return placed.drop("_stream_rows", "_chunk_rows", "_home")


def look_back(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    rows: int,
    build: Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]],
    chunk_rows: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Window expressions that look at most ``rows`` rows back inside a group.

    ``build`` receives the ordered window and returns the new columns, or a list of them
    where later ones use earlier ones.  A group of any size is spread over many chunks.
    """
    out = in_chunks(df, group, order, rows, chunk_rows, partitions)
    steps = build(Window.partitionBy("_chunk", *group).orderBy("_pos"))
    for columns in steps if isinstance(steps, list) else [steps]:
        out = out.select("*", *[c.alias(n) for n, c in columns.items()])
    return out.filter("_own").drop("_own", "_chunk", "_pos")


_COMBINE = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "min": lambda before, here: F.least(before, here),
    "max": lambda before, here: F.greatest(before, here),
}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    what: dict[str, tuple[str, Column]],
    position: str | None = None,
    chunk_rows: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Running sum / min / max per group over rows up to and including the current one.

    ``what`` maps a new column to ``(kind, expression)``.  Each chunk is scanned on its
    own; a group that continues from an earlier chunk gets its carry from a table that has
    at most one row per chunk, since only the first group of a chunk can continue.
    ``position`` keeps the global rank under that name.
    """
    cut = in_chunks(df, group, order, 0, chunk_rows, partitions)
    inner = Window.partitionBy("_chunk", *group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[_AGG[k](c).over(inner).alias(n) for n, (k, c) in what.items()])

    parts = cut.groupBy("_chunk", *group).agg(*[_AGG[k](c).alias(n) for n, (k, c) in what.items()])
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        F.col("_chunk").alias("_c_chunk"),
        *[col(g).alias(f"_c_{g}") for g in group],
        F.count(F.lit(1)).over(earlier).alias("_seen"),
        *[_AGG[k](n).over(earlier).alias(f"_c_{n}") for n, (k, _) in what.items()],
    ).filter("_seen > 0")

    match = F.col("_chunk") == F.col("_c_chunk")
    for g in group:
        match = match & col(g).eqNullSafe(F.col(f"`_c_{g}`"))
    out = local.join(F.broadcast(carry), match, "left")
    for n, (k, _) in what.items():
        out = out.withColumn(n, _COMBINE[k](F.col(f"_c_{n}"), F.col(n)))
    if position:
        out = out.withColumn(position, F.col("_pos"))
    return out.drop("_chunk", "_pos", "_seen", "_c_chunk", *[f"_c_{g}" for g in group], *[f"_c_{n}" for n in what])


def position_in_group(df: DataFrame, group: list[str], order: list[str | Column], name: str = "pos", **kw) -> DataFrame:
    """0-based rank of each row inside its group, for groups of any size."""
    return running(df, group, order, {name: ("sum", F.lit(1).cast("long"))}, **kw).withColumn(name, F.col(name) - 1)


def join_small(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join with a table that is usually small.

    The right side is computed once and broadcast if it has at most ``MAX_BROADCAST_ROWS``
    rows, which spares the left side a shuffle on what may be a handful of hot keys.  A
    larger one is joined the usual way.
    """
    right = materialize(right, "small")
    return join_on(left, F.broadcast(right) if right.count() <= MAX_BROADCAST_ROWS else right, keys, how)


def quantiles_by_group(
    df: DataFrame, group: list[str], value: str, points: dict[str, float], margin: float = 0.001, partitions: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per group without sorting all values.

    The built-in exact ``percentile`` keeps all values of a group in one task, and a full
    sort moves every row.  Here a sketch brackets each quantile.  One more pass counts what
    lies below and above a bracket (merged before the shuffle) and keeps only the values
    inside, about ``2 * margin`` of the rows.  The wanted ranks must lie inside, or right
    at the edge of, the bracket; if a sketch was off by more, the bracket is widened, in
    the end to all rows.
    """
    rows = df.filter(col(value).isNotNull()).select(*group, col(value).alias("_v"))
    names = list(points)
    while True:
        edges = [x for p in points.values() for x in (max(0.0, p - margin), min(1.0, p + margin))]
        sketch = rows.groupBy(*group).agg(
            F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), 10_000).alias("_edges"), F.count("_v").alias("_size")
        )
        if group:
            joined = join_small(rows, sketch, group)
        else:
            one = sketch.select(F.struct("_edges", "_size")).scalar()
            joined = rows.select("*", one.getField("_edges").alias("_edges"), one.getField("_size").alias("_size"))
        marks = F.array(*[
            F.struct(
                F.lit(i).alias("_q"),
                F.when(F.col("_v") < F.col("_edges")[2 * i], 0).when(F.col("_v") > F.col("_edges")[2 * i + 1], 2).otherwise(1).alias("_zone"),
                (F.lit(points[n]) * (F.col("_size") - 1)).alias("_rank"),
            )
            for i, n in enumerate(names)
        ])
        cells = joined.select(*group, "_v", F.explode(marks).alias("_m")).select(*group, "_v", "_m.*")
        inside = F.when(F.col("_zone") == 1, F.col("_v")).alias("_key")
        binned = cells.groupBy(*group, "_q", "_rank", "_zone", inside).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        summed = running(binned, [*group, "_q"], ["_zone", "_key"], {"_upto": ("sum", F.col("_n"))}, partitions=partitions)
        low, high, start = F.floor("_rank"), F.ceil("_rank"), F.col("_upto") - F.col("_n")
        holds = lambda r: (start <= r) & (r < F.col("_upto"))
        off = lambda r: holds(r) & (
            ((F.col("_zone") == 0) & (r != F.col("_upto") - 1)) | ((F.col("_zone") == 2) & (r != start))
        )
        here = F.when(F.col("_zone") == 0, F.col("_hi")).otherwise(F.col("_lo"))
        picked = summed.groupBy(*group, "_q", "_rank").agg(
            F.min(F.when(holds(low), here)).alias("_a"), F.min(F.when(holds(high), here)).alias("_b"),
            F.max(off(low) | off(high)).alias("_off"),
        )
        picked = materialize(picked, "quantiles")  # one row per group and quantile
        if margin >= 1.0 or not picked.filter("_off").limit(1).count():
            break
        margin = min(1.0, max(margin, 0.0001) * 10)
    found = picked.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank")))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)])
