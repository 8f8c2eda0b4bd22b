"""Packing documents into sequences by linear grouping.

Pieces are ranked by length.  Those above ``small`` tokens are cut into groups of equal
cardinality and every length is rounded up to its group's largest.  For those few sizes the
driver optimises configurations (column generation over a table with one count per length,
so its work does not depend on the number of documents).  The ranks then substitute actual
pieces for rounded ones, and the short pieces go best-fit, in many independent blocks of
sequences, to what rounding and configurations have left free.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, id_key
from tidemark.llm.wordbpe import encoder
from tidemark.operators.ordering import global_position
from tidemark.workspace import materialize, ship_package

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BLOCK_PIECES = 20_000  # pieces that one best-fit block holds on average


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, counted and summed from the encoded text."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                raw += end
                for number, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for key, value in zip(rows, (doc_id, number, at // 4, len(part) // 4, zlib.crc32(part))):
                        rows[key].append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types)})

    return documents(docs).mapInArrow(cut, PIECES)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of sizes with their multiplicities that cover the demand in few sequences.

    Column generation: a simplex basis of patterns, priced by an unbounded knapsack over
    the capacity.  The fractional optimum is rounded down and the few sizes left over are
    placed first-fit decreasing.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse, used = np.linalg.inv(basis), demand / np.diag(basis)
    for _ in range(50 * k):
        prices = inverse.sum(axis=0)  # every sequence costs one
        worth, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // int(sizes.min())):
            with_one = np.full((k, capacity + 1), -1.0)
            for i, n in enumerate(sizes.tolist()):
                with_one[i, n:] = worth[: capacity + 1 - n] + prices[i]
            pick = with_one.argmax(axis=0)
            gain = with_one[pick, np.arange(capacity + 1)]
            better = gain > worth + 1e-12
            if not better.any():
                break
            worth = np.where(better, gain, worth)
            picks.append(np.where(better, pick, -1))
        if worth[capacity] <= 1 + 1e-7:
            break
        pattern, room = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[room] >= 0:
                pattern[pick[room]] += 1
                room -= int(sizes[pick[room]])
        column = inverse @ pattern
        ratio = np.where(column > 1e-9, used / np.where(column > 1e-9, column, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        used = np.maximum(used - step * column, 0)
        used[leave] = step
        basis[:, leave] = pattern
        inverse = np.linalg.inv(basis)
    whole = np.floor(used + 1e-9).astype(np.int64)
    out = [(basis[:, j].astype(np.int64), int(whole[j])) for j in range(k) if whole[j] > 0]
    left = np.maximum(demand - sum((p * n for p, n in out), np.zeros(k, dtype=np.int64)), 0)
    bins: list[tuple[np.ndarray, int]] = []
    for i in np.argsort(-sizes):
        for _ in range(int(left[i])):
            spot = next((b for b, (_, free) in enumerate(bins) if free >= sizes[i]), None)
            if spot is None:
                bins.append((np.zeros(k, dtype=np.int64), capacity))
                spot = len(bins) - 1
            bins[spot][0][i] += 1
            bins[spot] = (bins[spot][0], bins[spot][1] - int(sizes[i]))
    return out + [(p, 1) for p, _ in bins]


def plan(counts: dict[int, int], capacity: int, small: int, groups: int) -> tuple[np.ndarray, int, int]:
    """Rows (first rank, pieces of this size in a sequence, first sequence) for all ranks of large pieces.

    Returned with the number of ranked large pieces and of planned sequences.  ``counts``
    has at most one entry per length.
    """
    lengths = np.array(sorted((n for n in counts if n > small), reverse=True), dtype=np.int64)
    number = np.array([counts[int(n)] for n in lengths], dtype=np.int64)
    total, full = int(number.sum()), int(counts.get(capacity, 0))
    rows = [(0, 1, 0)] if full else []
    if total > full:
        upto = np.cumsum(number)
        width = -(-(total - full) // groups)
        first = np.arange(full, total, width)
        size = lengths[np.searchsorted(upto, first, side="right")]
        edge = np.append(first, total)
        # groups that round to one size are one demand
        keep = np.append(True, size[1:] != size[:-1])
        first, size = first[keep], size[keep]
        demand = np.diff(np.append(first, total))
        base, taken = full, first.copy()
        for pattern, times in configurations(size, demand, capacity):
            for i in np.flatnonzero(pattern):
                if taken[i] < (first[i + 1] if i + 1 < len(first) else edge[-1]):
                    rows.append((int(taken[i]), int(pattern[i]), base))
                taken[i] += int(pattern[i]) * times
            base += times
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3), total, base
    return np.array(rows, dtype=np.int64).reshape(-1, 3), total, full


def best_fit(lengths: np.ndarray, free: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the lengths, longest first, each to the fullest sequence that has room, or to a new one."""
    by_free: dict[int, list[int]] = {}
    mask = 0
    for i, room in enumerate(free):
        by_free.setdefault(room, []).append(i)
        mask |= 1 << room
    place, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    count = len(free)
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = by_free[room]
            at = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, at = capacity, count
            count += 1
        place[i], offset[i] = at, capacity - room
        by_free.setdefault(room - n, []).append(at)
        mask |= 1 << (room - n)
    return place, offset


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, small: int | None = None, groups: int = 64) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id.  Repeated rows are packed each.  Rows
    without an id keep a null id.  An empty table gives no rows.  Pieces of equal length
    are ranked by (doc_id, piece), so ties are settled; pieces that agree in everything
    are interchangeable.
    """
    small = capacity // 8 if small is None else small
    pieces = materialize(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    order = [F.col("length").desc(), *id_key(), F.col("piece"), F.col("ids_crc32")]
    ranked = global_position(pieces, order, "rank")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table, large, planned = plan(counts, capacity, small, groups)
    blocks = max(1, -(-sum(counts.values()) // BLOCK_PIECES))

    def sequence(rank: pd.Series) -> pd.Series:
        ranks = rank.to_numpy()
        at = np.searchsorted(table[:, 0], ranks, side="right") - 1
        return pd.Series(table[at, 2] + (ranks - table[at, 0]) // table[at, 1])

    numbered = F.pandas_udf(sequence, "long")
    big = ranked.filter(F.col("rank") < large).withColumn("sequence_id", numbered("rank"))
    rest = ranked.filter(F.col("rank") >= large).withColumn("sequence_id", F.lit(None).cast("long"))
    full = big.filter(F.col("length") == capacity)
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    dealt = big.filter(F.col("length") < capacity).unionByName(rest)
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(F.coalesce("sequence_id", "rank")), F.lit(blocks)))

    def fill(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank", kind="stable")
        fixed = block[block["sequence_id"].notna()].sort_values(["sequence_id", "rank"], kind="stable")
        loose = block[block["sequence_id"].isna()]
        known = fixed["sequence_id"].astype("int64")
        size = fixed["length"].groupby(known)
        fixed = fixed.assign(sequence_id=known, offset=size.cumsum() - fixed["length"])
        used = size.sum()
        names = used.index.to_numpy()
        place, offset = best_fit(loose["length"].to_numpy(), (capacity - used).tolist(), capacity)
        fresh = planned + int(key[0]) + blocks * (place - len(names))
        named = np.append(names, 0)[np.minimum(place, len(names))]
        loose = loose.assign(sequence_id=np.where(place < len(names), named, fresh), offset=offset)
        return pd.concat([fixed, loose])[[*fields, "offset"]].astype({"sequence_id": "int64", "offset": "int64"})

    schema = PIECES + ", sequence_id long, offset long"
    filled = dealt.groupBy("_block").applyInPandas(fill, schema)
    return full.select(*fields, F.lit(0).cast("long").alias("offset")).unionByName(filled)
