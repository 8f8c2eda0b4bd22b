"""Drift detection inside single streams of any length, in parallel.

Up to its next drift, a detector's state at any later place follows from sums over the rows
between (see ``Detector.measure``).  A long stream is cut into chunks; in each round all chunks
a stretch ahead are summed up, the state at the start of each follows, and all are scanned.
The first chunk with a drift counts to its end, with all its drifts; what lies behind it is
done anew in the next round, with the state that chunk left.  A stretch doubles as long as no
drift is found and is one chunk, which needs no sums, after a drift.  So a stream takes at most
as many rounds as it has chunks, however many drifts it has.  Streams and configurations
advance together.  Every state and summary travels in written tables, none through the driver.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import join_on
from tidemark.operators.detectors import create
from tidemark.workspace import materialize, ship_package

FIRST_AHEAD = 8  # chunks of the first stretch; after a drift it is one
MOST_AHEAD = 4_096
CHUNKS = 12  # a longer stream has longer chunks, up to
MOST_CHUNK_ROWS = 1_000_000


def detect_rounds(rows: DataFrame, keys: list[str], order: list[str], method: str, grid: dict[str, dict], states: tuple[str, ...], chunk_rows: int) -> DataFrame:
    """Alarms of every stream of ``rows`` (keys, order columns, ``_seq`` and ``_value``).

    The result has the keys, the order columns of the alarm's row and the detector's state.
    """
    spark = rows.sparkSession
    ship_package(spark)
    longest = rows.agg(F.max("_seq")).first()[0] + 1
    chunk_rows = max(chunk_rows, min(MOST_CHUNK_ROWS, -(-longest // CHUNKS)))
    stored = materialize(rows.withColumn("_chunk", F.floor(F.col("_seq") / F.lit(chunk_rows)).cast("int")), "chunks", partition_by=["_chunk"])
    phases = len(create(method, **next(iter(grid.values()))).carried)
    key_fields = [stored.schema[k] for k in keys]
    plan_type = T.StructType([
        *key_fields, *T.StructType.fromDDL("config string, _chunk int, at long, n long, ahead int, start binary, state binary, summary binary").fields
    ])
    event_type = T.StructType([
        *key_fields, *[stored.schema[o] for o in order],
        *T.StructType.fromDDL("config string, _chunk int, state string, n_seen long, n_drifts long, window_size long, estimation double, _end binary, _drift boolean, _at long").fields,
    ])
    state_type = T.StructType([*key_fields, *T.StructType.fromDDL("config string, at long, n long, ahead int, state binary, upto int").fields])
    per_config = spark.createDataFrame([(c, pickle.dumps(create(method, **p))) for c, p in grid.items()], "config string, state binary")
    sizes = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    live = sizes.crossJoin(F.broadcast(per_config)).select(*keys, "config", F.lit(0).cast("long").alias("at"), "n", F.lit(FIRST_AHEAD).alias("ahead"), "state", F.lit(-1).alias("upto"))
    live, out = materialize(live, "streams"), None

    def values_of(chunk: pd.DataFrame, at: int) -> pd.DataFrame:
        return chunk[chunk["_seq"] >= at].sort_values("_seq", ignore_index=True)

    def measure(phase: int):
        def run(chunk: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
            for i, row in enumerate(plan.to_dict("records")):
                part, detector = values_of(chunk, row["at"])["_value"].to_numpy(dtype=float), pickle.loads(row["state"])
                if phase == 0:
                    detector.skip(max(0, row["_chunk"] * chunk_rows - row["at"]))
                plan.at[plan.index[i], "summary"] = pickle.dumps(detector.measure(part, phase))
            return plan[plan_type.fieldNames()]

        return run

    def carry(phase: int):
        def run(plan: pd.DataFrame) -> pd.DataFrame:
            plan = plan.sort_values("_chunk", ignore_index=True)
            carried = pickle.loads(plan["start"].iloc[0])
            after = []
            for raw, summary in zip(plan["state"], plan["summary"]):
                here = pickle.loads(raw)
                for f in here.carried[phase]:
                    setattr(here, f, getattr(carried, f))
                after.append(pickle.dumps(here))
                carried.absorb(pickle.loads(summary), phase)
            plan["state"] = after
            return plan[plan_type.fieldNames()]

        return run

    def scan(chunk: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        row = plan.iloc[0]
        part, detector = values_of(chunk, row["at"]), pickle.loads(row["state"])
        found, drifted = [], False
        for i, state in detector.scan(part["_value"].to_numpy(dtype=float)):
            drifted |= state == "drift"
            if state in states:
                found.append((i, state, detector.n_seen, detector.n_drifts, detector.width, detector.estimate))
        detector.settle()
        end = int(part["_seq"].iloc[-1]) + 1 if len(part) else row["at"]
        # one row more than alarms, for the state at the end
        places = [f[0] for f in found]
        out = pd.DataFrame({o: pd.Series([*part[o].take(places), None], dtype=object) for o in order})
        for k in [*keys, "config", "_chunk"]:
            out[k] = pd.Series([row[k]] * len(out), dtype=object)
        for j, name in enumerate(("state", "n_seen", "n_drifts", "window_size", "estimation"), 1):
            out[name] = pd.Series([*[f[j] for f in found], None], dtype=object)
        for name, value in (("_end", pickle.dumps(detector)), ("_drift", drifted), ("_at", end)):
            out[name] = pd.Series([None] * len(found) + [value], dtype=object)
        return out[event_type.fieldNames()]

    def resolve(ends: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        ends, old = ends.sort_values("_chunk", ignore_index=True), before.iloc[0]
        hits = ends.index[ends["_drift"].astype(bool)]
        row = ends.loc[hits[0] if len(hits) else ends.index[-1]]
        ahead = 1 if len(hits) else min(int(old["ahead"]) * 2, MOST_AHEAD)
        out = {k: old[k] for k in keys} | {"config": old["config"], "at": int(row["_at"]), "n": int(old["n"]), "ahead": ahead, "state": row["_end"], "upto": int(row["_chunk"])}
        return pd.DataFrame([out])[state_type.fieldNames()]

    while not live.isEmpty():
        first = F.floor(F.col("at") / F.lit(chunk_rows)).cast("int")
        last = F.least(first + F.col("ahead") - 1, F.floor((F.col("n") - 1) / F.lit(chunk_rows)).cast("int"))
        plan = live.withColumns({"_first": first, "_last": last})
        low, high, several = plan.agg(F.min("_first"), F.max("_last"), F.max(F.col("_last") - F.col("_first"))).first()
        plan = plan.select(*keys, "config", F.explode(F.sequence("_first", "_last")).alias("_chunk"), "at", "n", "ahead", F.col("state").alias("start"), "state", F.lit(None).cast("binary").alias("summary"))
        chunks = stored.filter(F.col("_chunk").between(low, high)).select(*keys, *order, "_seq", "_value", "_chunk")
        # configurations are read side by side
        piece = [*keys, "config", "_chunk"]
        chunks = join_on(chunks, plan.select(*keys, F.col("config").alias("config"), "_chunk"), [*keys, "_chunk"])
        for phase in range(phases if several else 0):
            measured = chunks.groupBy(*piece).cogroup(plan.groupBy(*piece)).applyInPandas(measure(phase), plan_type)
            plan = materialize(measured.groupBy(*keys, "config").applyInPandas(carry(phase), plan_type), "carried")
        events = materialize(chunks.groupBy(*piece).cogroup(plan.groupBy(*piece)).applyInPandas(scan, event_type), "scanned")
        ends = events.filter("_end IS NOT NULL")
        state = materialize(ends.groupBy(*keys, "config").cogroup(live.groupBy(*keys, "config")).applyInPandas(resolve, state_type), "streams")
        upto = state.select(*keys, "config", "upto")
        kept = join_on(events.filter("_end IS NULL"), upto, [*keys, "config"]).filter("_chunk <= upto")
        kept = kept.select(*keys, *order, "config", "state", "n_seen", "n_drifts", "window_size", "estimation")
        out = kept if out is None else out.unionByName(kept)
        live = state.filter("at < n")
    return out
