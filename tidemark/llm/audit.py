"""How filters of a corpus interact: every order of all filters, from wide packed counters.

What a sequence of filters does to a document depends only on the set (mask) of filters it
fails.  Each mask is mapped to one big integer with a field for every outcome of every step
of every order, 64 bits wide so that no count overflows into its neighbour.  The integers of
the documents of a part are added up and unpacked once at the end: one addition per document
counts all 600 steps of five filters.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle
from tidemark.workspace import ship_package

# The filters and their bounds.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FIELD_BITS = 64
OUTCOMES = ("kept", "removed", "redundant")
PARTS_HELD = 200  # parts a task adds up before it hands them on, about 20 MB
SALTS = 16

_OTHERS = bytes(b for b in range(256) if b not in CAPITALS)
_NO_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
ROWS = "doc_id long, part string, mask int, digest binary"
SUMS = "part string, outcomes binary, good binary, toxic binary, unique array<long>"


def failures(text: bytes, code_points: int) -> int:
    """Mask of the failed filters A to D; bit i belongs to the i-th filter."""
    words = text.split()
    out = 0
    if len(words) < MIN_WORDS:
        out |= 1
    if 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words):
        out |= 2
    if 100 * len(text.translate(None, _OTHERS)) > MAX_CAPITAL_PERCENT * code_points:
        out |= 4
    if text.translate(None, _NO_SYMBOL):
        out |= 8
    return out


def steps(filters: str = FILTERS) -> list[tuple[str, int]]:
    """All (order, step) pairs; their number is the number of a field."""
    return [("".join(o), i + 1) for o in permutations(filters) for i in range(len(filters))]


def packed(mask: int, filters: str = FILTERS) -> tuple[int, int]:
    """The outcomes of one document at all steps, and its removals alone, as packed integers."""
    outcomes = removals = 0
    for field, (order, step) in enumerate(steps(filters)):
        failed = [bool(mask >> filters.index(f) & 1) for f in order[:step]]
        gone_before = any(failed[:-1])
        flags = (not any(failed), failed[-1] and not gone_before, failed[-1] and gone_before)
        for i, flag in enumerate(flags):
            outcomes |= int(flag) << FIELD_BITS * (field * len(OUTCOMES) + i)
        removals |= int(flags[1]) << FIELD_BITS * field
    return outcomes, removals


def unpack(value: int, fields: int) -> np.ndarray:
    return np.frombuffer(value.to_bytes(fields * FIELD_BITS // 8, "little"), dtype="<i8")


def _bytes(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "little")


def _facts(docs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            masks = [failures(t, n) for t, n in zip(texts, batch.column("points").to_pylist())]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), digests], names=["doc_id", "part", "mask", "digest"])

    return docs.mapInArrow(read, ROWS)


def _add(groups: DataFrame, filters: str) -> DataFrame:
    """Packed sums per part of each task's rows (part, mask, good, toxic, n)."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = [packed(mask, filters) for mask in range(1 << len(filters))]
        held: dict[str, list] = {}
        for chunk in chunks:
            for part, mask, good, toxic, n in zip(*(chunk[c].tolist() for c in ("part", "mask", "good", "toxic", "n"))):
                total = held.setdefault(part, [0, 0, 0, Counter()])
                outcomes, removals = table[mask]
                total[0] += n * outcomes
                total[1] += n * removals if good else 0
                total[2] += n * removals if toxic else 0
                total[3][mask] += n
                if len(held) > PARTS_HELD:
                    yield _frame(held, filters)
                    held = {}
        yield _frame(held, filters)

    return groups.mapInPandas(run, SUMS)


def _frame(held: dict[str, list], filters: str) -> pd.DataFrame:
    rows = [(p, _bytes(a), _bytes(b), _bytes(c), [m[1 << i] for i in range(len(filters))]) for p, (a, b, c, m) in held.items()]
    return pd.DataFrame(rows, columns=["part", "outcomes", "good", "toxic", "unique"])


def _merged(part: str, rows: pd.DataFrame) -> pd.DataFrame:
    whole = lambda c: _bytes(sum(int.from_bytes(v, "little") for v in rows[c]))
    unique = np.sum(np.stack(rows["unique"].to_numpy()), axis=0).tolist()
    return pd.DataFrame({"part": [part], "outcomes": [whole("outcomes")], "good": [whole("good")], "toxic": [whole("toxic")], "unique": [unique]})


def interactions(facts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of documents given as (part, mask, good, toxic): one row per part, order and step.

    Tasks add packed integers; partial sums of a part are merged in two steps, so that
    neither a task nor the driver meets more than one sum per part and task.
    """
    ship_package(facts.sparkSession)
    groups = facts.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    sums = _add(groups, filters).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    merge = lambda key, rows: _merged(key[0], rows)
    sums = sums.groupBy("part", "salt").applyInPandas(merge, SUMS).groupBy("part").applyInPandas(merge, SUMS)
    order = steps(filters)

    def report(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for row in chunk.to_dict("records"):
                fields = unpack(int.from_bytes(row["outcomes"], "little"), len(order) * len(OUTCOMES)).reshape(-1, len(OUTCOMES))
                out = pd.DataFrame(order, columns=["filter_order", "step"]).assign(part=row["part"])
                for i, name in enumerate(OUTCOMES):
                    out[name] = fields[:, i]
                name_at = [o[s - 1] for o, s in order]
                out["unique_fails"] = [row["unique"][filters.index(f)] for f in name_at]
                out["good_lost"] = unpack(int.from_bytes(row["good"], "little"), len(order))
                out["toxic_lost"] = unpack(int.from_bytes(row["toxic"], "little"), len(order))
                out["shapley"] = out["removed"].groupby(pd.Series(name_at)).transform("sum")
                yield out[[c.split()[0] for c in REPORT.split(", ")]]

    return sums.mapInPandas(report, REPORT)


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filter audit of documents by language; columns of ``REPORT``.

    Null texts are empty, a null language is the part ''.  Filter E compares whole texts over
    all parts; rows without an id come after all others and repeat any text that a row with an
    id holds.  Rows of one id do not repeat each other.  A document is good or toxic if any of its
    label rows says so; unlabelled ones are neither.  Repeated rows count each.  An empty
    table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    source = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text")
    ).withColumn("points", F.length("text"))
    facts = settle(_facts(source), "facts")
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    marks = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"], labels["toxic"]).groupBy("_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    repeats = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    joined = facts.join(firsts, "digest", "left").join(marks, facts["doc_id"] == marks["_id"], "left")
    return interactions(joined.select(
        "part", F.when(repeats, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    ))
