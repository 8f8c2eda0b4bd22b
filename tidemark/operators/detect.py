"""Concept drift in many ordered streams at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import col, join_on
from tidemark.operators.detectors import DetectorFold, create
from tidemark.operators.ordering import join_small, look_back, position_in_group, running
from tidemark.operators.rounds import detect_rounds
from tidemark.operators.streams import fold_streams
from tidemark.workspace import materialize

CHUNK_ROWS = 200_000
DRIFT_FIELDS = "config string, state string, n_seen long, n_drifts long, window_size long, estimation double"
SENSITIVITY_GRID = (0.0001, 0.001, 0.002, 0.01, 0.05, 0.1, 0.5)


def detect(
    df: DataFrame,
    key: list[str],
    order: list[str],
    value: str,
    method: str = "adwin",
    params: dict | None = None,
    grid: dict[str, dict] | None = None,
    states: tuple[str, ...] = ("drift",),
    chunk_rows: int = CHUNK_ROWS,
    rank: str | None = None,
) -> DataFrame:
    """One row per drift (and warning, if asked for) of every stream.

    ``grid`` maps a label to parameters: all of them read the stream in the same pass, so
    a sensitivity sweep does not copy the data.  A stream of up to ``chunk_rows`` rows is one
    task's work; a longer one, be it the only one, is spread over as many tasks as it has
    chunks (see ``rounds``), with the same alarms.  Values with fractions are summed chunk by
    chunk there.
    """
    grid = grid or {"default": params or {}}
    for p in grid.values():
        create(method, **p)  # an unknown name or parameter fails here, not in a task
    keys = key or ["_stream"]
    rows = df.select(*[col(c) for c in [*key, *order]], col(value).alias("_value"), *([col(rank).cast("long").alias("_seq")] if rank else []))
    rows = rows if key else rows.withColumn("_stream", F.lit(0))
    ranked = materialize(rows if rank else position_in_group(rows, keys, order, "_seq"), "streams")
    sizes = ranked.groupBy(*keys).agg((F.max("_seq") + 1).alias("_n")).filter(F.col("_n") > chunk_rows)
    some_long = not sizes.isEmpty()
    long_keys = sizes.select(*keys)
    short = join_on(ranked, long_keys, keys, "left_anti") if some_long else ranked
    out = fold_streams(short, keys, order, "_value", lambda: DetectorFold(method, grid, states), DRIFT_FIELDS, chunk_rows, "_seq", all_short=True)
    if some_long:
        out = out.unionByName(detect_rounds(join_on(ranked, long_keys, keys, "left_semi"), keys, order, method, grid, states, chunk_rows))
    return out if key else out.drop("_stream")


def sensitivity(
    df: DataFrame, key: list[str], order: list[str], value: str, injected: int, deltas: tuple[float, ...] = SENSITIVITY_GRID, **kw
) -> DataFrame:
    """ADWIN over a grid of confidence values: alarms, first detection and delay after the injection.

    ``injected`` counts rows of a stream before the injected change.
    """
    found = detect(df, key, order, value, "adwin", grid={str(d): {"delta": d} for d in deltas}, **kw)
    after = F.when(F.col("n_seen") > injected, F.col("n_seen"))
    stats = found.groupBy(*key, "config").agg(
        F.count(F.lit(1)).alias("n_alarms"), F.min("n_seen").alias("first_detection"), (F.min(after) - injected).alias("delay")
    )
    streams = df.select(*key).distinct() if key else df.agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    every = streams.withColumn("config", F.explode(F.array(*[F.lit(str(d)) for d in deltas])))
    joined = join_on(every, stats, [*key, "config"], "left")
    return joined.withColumn("n_alarms", F.coalesce("n_alarms", F.lit(0))).withColumnRenamed("config", "delta")


def drift_events(
    df: DataFrame, key: list[str], order: list[str], error: str, method: str = "adwin", params: dict | None = None,
    model_version: str = "v1", rolling_rows: int = 500, **kw
) -> DataFrame:
    """The drift-event table: id, detector, position, model, window, recent and overall error, state.

    The stream is ranked and its errors are summed in one sort.  Only the two ends of each
    event's recent stretch are looked up, by equality on the rank.
    """
    what = {"_n": ("sum", F.lit(1).cast("long")), "_errors": ("sum", col(error).cast("double"))}
    ranked = running(df.select(*key, *order, error), key, order, what).withColumn("_rank", F.col("_n") - 1)
    found = detect(ranked, key, order, error, method, params, rank="_rank", **kw)
    ends = F.array(
        F.struct(F.col("n_seen").alias("_n"), F.lit(True).alias("_end")),
        F.struct((F.col("n_seen") - rolling_rows).alias("_n"), F.lit(False).alias("_end")),
    )
    probes = found.select(*key, "n_seen", F.explode(ends).alias("e")).select(*key, "n_seen", "e.*")
    sums = join_small(ranked.select(*key, "_n", "_errors"), probes, [*key, "_n"]).groupBy(*key, "n_seen").agg(
        F.sum(F.when(F.col("_end"), F.col("_errors"))).alias("_upto"),
        F.coalesce(F.sum(F.when(~F.col("_end"), F.col("_errors"))), F.lit(0.0)).alias("_before"),
    )
    joined = join_on(found, sums, [*key, "n_seen"]).withColumns({
        "rolling_error": (F.col("_upto") - F.col("_before")) / F.least("n_seen", F.lit(rolling_rows)),
        "cumulative_error": F.col("_upto") / F.col("n_seen"),
    })
    numbered = position_in_group(joined, [], [*order, *key], "event_no")
    return numbered.select(
        F.concat(F.lit("drift-"), F.lpad((F.col("event_no") + 1).cast("string"), 6, "0")).alias("event_id"),
        F.lit("concept").alias("drift_type"), F.lit(method).alias("detector"), *key, *order,
        F.lit(model_version).alias("model_version"), "window_size",
        F.create_map(F.lit("rolling_error"), F.col("rolling_error"), F.lit("cumulative_error"), F.col("cumulative_error")).alias("context"),
        F.create_map(
            F.lit("n_seen"), F.col("n_seen").cast("double"), F.lit("n_drifts"), F.col("n_drifts").cast("double"),
            F.lit("estimation"), F.col("estimation"),
        ).alias("detector_state"),
    )


# --- first alarms in closed form: running aggregates instead of a sequential fold --------


def ddm_first_alarm(
    df: DataFrame, key: list[str], order: list[str], error: str, warm_start: int = 30, warning: float = 2.0, drift: float = 3.0, **kw
) -> DataFrame:
    """First warning and first drift of each stream before any reset, by DDM."""
    counts = running(
        df.select(*key, *order, error), key, order,
        {"_n": ("sum", F.lit(1).cast("long")), "_e": ("sum", col(error).cast("long"))}, **kw,
    )
    rate = F.col("_e") / F.col("_n")
    levels = counts.withColumn("_p", rate).withColumn("_s", F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col("_n")))
    levels = levels.withColumn("_level", F.col("_p") + F.col("_s")).filter(F.col("_n") > warm_start)
    best = running(levels, key, order, {"_best": ("min", F.struct("_level", "_p", "_s"))}, **kw)
    over = lambda k: F.col("_level") > F.col("_best._p") + k * F.col("_best._s")
    first = lambda k: F.min(F.when(over(k), F.col("_n")))
    out = best.groupBy(*key).agg(first(warning).alias("first_warning"), first(drift).alias("first_drift"))
    return out.filter("first_drift IS NOT NULL OR first_warning IS NOT NULL")


def eddm_first_alarm(
    df: DataFrame, key: list[str], order: list[str], error: str, warm_start: int = 30, alpha: float = 0.95, beta: float = 0.9, **kw
) -> DataFrame:
    """First warning and first drift of each stream before any reset, by EDDM; only error rows take part."""
    placed = position_in_group(df.select(*key, *order, error), key, order, "_at", **kw)
    errors = placed.filter(col(error) == 1).withColumn("_at", F.col("_at") + 1)
    gaps = look_back(errors, key, order, 1, lambda w: {"_d": F.col("_at") - F.coalesce(F.lag("_at").over(w), F.lit(0))}, **kw)
    sums = running(
        gaps, key, order,
        {"_k": ("sum", F.lit(1).cast("long")), "_ds": ("sum", F.col("_d")), "_dd": ("sum", F.col("_d") * F.col("_d"))}, **kw,
    )
    mean = F.col("_ds") / F.col("_k")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_dd") / F.col("_k") - mean * mean))
    levels = sums.filter(F.col("_k") >= warm_start).withColumn("_level", mean + 2 * spread)
    top = running(levels, key, order, {"_top": ("max", F.col("_level"))}, **kw)
    first = lambda bound: F.min(F.when(F.col("_level") / F.col("_top") < bound, F.col("_at")))
    out = top.groupBy(*key).agg(first(alpha).alias("first_warning"), first(beta).alias("first_drift"))
    return out.filter("first_drift IS NOT NULL OR first_warning IS NOT NULL")


def page_hinkley_first_alarm(
    df: DataFrame, key: list[str], order: list[str], value: str, min_instances: int = 30, delta: float = 0.005, threshold: float = 50.0, **kw
) -> DataFrame:
    """First drift of each stream by the Page-Hinkley test without forgetting (alpha = 1)."""
    means = running(
        df.select(*key, *order, value), key, order, {"_n": ("sum", F.lit(1).cast("long")), "_x": ("sum", col(value).cast("double"))}, **kw
    )
    gaps = means.withColumn("_gap", col(value) - F.col("_x") / F.col("_n"))
    sums = running(gaps, key, order, {"_up": ("sum", F.col("_gap") - delta), "_down": ("sum", F.col("_gap") + delta)}, **kw)
    ends = running(sums, key, order, {"_low": ("min", F.col("_up")), "_high": ("max", F.col("_down"))}, **kw)
    alarm = F.greatest(F.col("_up") - F.col("_low"), F.col("_high") - F.col("_down")) > threshold
    hit = F.when(alarm & (F.col("_n") >= min_instances), F.col("_n"))
    return ends.groupBy(*key).agg(F.min(hit).alias("first_drift")).filter("first_drift IS NOT NULL")
