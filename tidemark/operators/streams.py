"""Sequential folds over many ordered streams, with bounded memory for streams of any length.

A stream (all rows of one key, in order) is cut into turns of at most ``chunk_rows`` rows.
One turn of a key is one task's input.  Streams shorter than that, usually all of them,
are done in a single parallel pass.  A longer stream goes on in the next turn with the
small state its last turn left in a written table; turns of all long streams run in
parallel, and a lost executor only repeats one turn.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col
from tidemark.operators.ordering import position_in_group
from tidemark.workspace import materialize, ship_package

CHUNK_ROWS = 2_000_000


def fold_streams(
    df: DataFrame,
    key: list[str],
    order: list[str],
    value: str,
    factory: Callable[[], object],
    fields: str,
    chunk_rows: int = CHUNK_ROWS,
    rank: str | None = None,
    all_short: bool = False,
) -> DataFrame:
    """Fold ``value`` of every stream in order.

    ``factory`` makes the fold of one stream.  Its ``push(chunk)`` gets the next rows as a
    pandas frame with ``_value`` and returns tuples whose first item is the row's index in
    the chunk; the other items are the ``fields`` (a DDL string).  The result has the key,
    the order columns of that row and the fields.  ``rank`` names a column that already
    holds the 0-based rank in the stream, which saves sorting it again; ``all_short`` says that
    no stream has more than ``chunk_rows`` rows.
    """
    ship_package(df.sparkSession)
    keys = key or ["_stream"]
    known = [col(rank).cast("long").alias("_seq")] if rank else []
    rows = df.select(*[col(c) for c in [*key, *order]], col(value).alias("_value"), *known)
    if not key:
        rows = rows.withColumn("_stream", F.lit(0))
    ranked = rows if rank else position_in_group(rows, keys, order, "_seq")
    extra = T.StructType.fromDDL(fields)
    outer = T.StructType([ranked.schema[k] for k in keys] + [ranked.schema[o] for o in order])
    out_schema = T.StructType([*outer.fields, *extra.fields, T.StructField("_state", T.BinaryType())])
    names = out_schema.fieldNames()

    def run(fold, chunk: pd.DataFrame, keep_state: bool) -> pd.DataFrame:
        chunk = chunk.sort_values("_seq", ignore_index=True)
        found = fold.push(chunk)
        at = [r[0] for r in found]
        out = chunk.loc[at, [*keys, *order]].reset_index(drop=True)
        for i, f in enumerate(extra.fieldNames()):
            out[f] = pd.Series([r[i + 1] for r in found], dtype=None if found else object)
        out["_state"] = None
        if keep_state:
            tail = {c: None for c in names} | {k: chunk[k].iloc[0] for k in keys} | {"_state": pickle.dumps(fold)}
            out = pd.concat([out.astype(object), pd.DataFrame([tail], dtype=object)], ignore_index=True)
        return out[names]

    longest = 0 if all_short else ranked.agg(F.max("_seq")).first()[0]
    turns = 1 if longest is None else longest // chunk_rows + 1
    if turns == 1:
        done = ranked.groupBy(*keys).applyInPandas(lambda pdf: run(factory(), pdf, False), out_schema)
        return done.drop("_state", *([] if key else ["_stream"]))

    cut = ranked.withColumn("_turn", F.floor(F.col("_seq") / F.lit(chunk_rows)).cast("int"))
    stored = materialize(cut, "turns", partition_by=["_turn"])

    def go_on(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        return run(pickle.loads(state["_state"].iloc[0]), pdf, True)

    done, state = None, None
    for turn in range(turns):
        chunk = stored.filter(F.col("_turn") == turn).drop("_turn")  # prunes to one folder
        if turn == 0:
            out = chunk.groupBy(*keys).applyInPandas(lambda pdf: run(factory(), pdf, True), out_schema)
        else:
            out = chunk.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(go_on, out_schema)
        out = materialize(out, f"turn{turn}")
        state = out.filter("_state IS NOT NULL").select(*keys, "_state")
        found = out.filter("_state IS NULL").drop("_state")
        done = found if done is None else done.unionByName(found)
    return done.drop(*([] if key else ["_stream"]))
