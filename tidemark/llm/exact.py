"""Exact deduplication of an incoming batch against an immutable snapshot.

A snapshot is described once: one row per distinct normalised text, and for each bucket of
digests a static binary-fuse filter.  Incoming digests are first grouped among themselves,
so a bucket sees each digest once.  The filter then screens them: what it denies is
certainly new, what it lets pass joins the exact buckets and is compared byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, documents
from tidemark.workspace import materialize, ship_package

BUCKET_KEYS = 20_000
SCREEN_BYTES = 64 << 20  # of the filter that screens texts for the byte check
FILTERS = "bucket long, seed long, segment long, segments long, prints binary"
_M = (1 << 64) - 1


def normalised(text: Column) -> Column:
    """The text without white space; two texts are equal when these are."""
    return F.regexp_replace(text, SPACE, "")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (public-domain constants)."""
    h = keys.astype(np.uint64) + np.uint64(seed & _M)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in adjacent segments and the one-byte fingerprint of each key."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    inner = [h & low, (h >> np.uint64(18)) & low, _mix(h, 1) & low]
    where = np.stack([(first + np.uint64(j)) * np.uint64(segment) + inner[j] for j in range(3)], axis=1)
    return where.astype(np.int64), (_mix(h, 2) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Binary-fuse filter of distinct keys: (seed, segment length, segments, fingerprints).

    Slots that only one key uses are peeled off until no key is left, then fingerprints are
    set in reverse order.  A key set that does not peel gets another seed.
    """
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    segments = max(1, -(-int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))) // segment))
    size = (segments + 2) * segment
    for seed in range(1, 200):
        where, prints = _slots(keys, seed, segment, segments)
        count = np.bincount(where.ravel(), minlength=size).tolist()
        held = np.zeros(size, dtype=np.int64)  # xor of the numbers of the keys that use a slot
        for j in range(3):
            np.bitwise_xor.at(held, where[:, j], np.arange(n))
        held, spots = held.tolist(), where.tolist()
        queue, order = [s for s in range(size) if count[s] == 1], []
        while queue:
            slot = queue.pop()
            if count[slot] != 1:
                continue
            key = held[slot]
            order.append((key, slot))
            for other in spots[key]:
                count[other] -= 1
                held[other] ^= key
                if count[other] == 1:
                    queue.append(other)
        if len(order) == n:
            table, marks = bytearray(size), prints.tolist()
            for key, slot in reversed(order):
                a, b, c = spots[key]
                table[slot] = 0
                table[slot] = marks[key] ^ table[a] ^ table[b] ^ table[c]
            return seed, segment, segments, bytes(table)
        if seed % 10 == 0:  # a small set may need more room
            segments += 1
            size = (segments + 2) * segment
    raise ValueError("no seed peels this key set")


def passes(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    table = np.frombuffer(prints, dtype=np.uint8)
    where, marks = _slots(keys, seed, segment, segments)
    return (table[where[:, 0]] ^ table[where[:, 1]] ^ table[where[:, 2]]) == marks


@dataclass
class Snapshot:
    """Groups of equal texts of the snapshot and the filters over their digests."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _rows(docs: DataFrame) -> DataFrame:
    docs = documents(docs)
    norm = normalised(F.col("text"))
    return docs.select(
        "doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"), F.length("text").cast("long").alias("points"), F.monotonically_increasing_id().alias("row")
    )


def _grouped(rows: DataFrame) -> DataFrame:
    best = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    return rows.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))


def _key() -> Column:
    return F.xxhash64("digest")


def _build_bucket(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    seed, segment, segments, prints = build_filter(part["key"].to_numpy().astype(np.uint64))
    return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "segment": [segment], "segments": [segments], "prints": [prints]})


def snapshot(rows: DataFrame) -> Snapshot:
    """Describe an immutable set of rows (see ``_rows``): groups and filters are written once."""
    ship_package(rows.sparkSession)
    groups = materialize(_grouped(rows), "snapshot")
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))

    keyed = groups.select(_key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return Snapshot(groups, materialize(keyed.groupBy("bucket").applyInPandas(_build_bucket, FILTERS), "filters"), buckets)


def screen(incoming: DataFrame, known: Snapshot) -> DataFrame:
    """Digests of ``incoming`` (distinct) that the snapshot may hold."""

    def test(left: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if left.empty or filters.empty:
            return left[["digest"]].head(0)
        f = filters.iloc[0]
        hit = passes(left["key"].to_numpy().astype(np.uint64), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["prints"])
        return left.loc[hit, ["digest"]]

    keyed = incoming.select("digest", _key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(known.buckets)))
    return keyed.groupBy("bucket").cogroup(known.filters.groupBy("bucket")).applyInPandas(test, "digest binary")


def deduplicate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Exact groups over a snapshot and a new batch: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are identical without white space (null counts as empty).  Of a group the
    row with the most code points stays, then the smallest id, rows without an id last; of
    fully repeated rows exactly one stays.  Empty tables are fine on either side.  Other
    columns are ignored.  A digest that passes the filter but fails the byte check makes a
    group of its own.
    """
    both = _rows(old).withColumn("side", F.lit(0)).unionByName(_rows(new).withColumn("side", F.lit(1)))
    rows = materialize(both.withColumn("row", F.monotonically_increasing_id()), "digests")
    known = snapshot(rows.filter("side = 0"))
    batch = materialize(_grouped(rows.filter("side = 1")), "batch")
    candidates = screen(batch, known).join(batch, "digest").select("digest", F.col("best.id").alias("new_id"))
    met = materialize(candidates.join(known.groups, "digest").select("digest", "new_id", F.col("best.id").alias("old_id")), "met")
    same = _byte_check(met, old, new)

    joined = batch.join(same.withColumn("match", F.lit(True)), "digest", "left")
    batch = joined.select("digest", F.lit(1).alias("side"), F.when(F.col("match"), 0).otherwise(1).alias("gen"), "best", "size")
    sides = materialize(known.groups.select("digest", F.lit(0).alias("side"), F.lit(0).alias("gen"), "best", "size").unionByName(batch), "sides")
    groups = sides.groupBy("digest", "gen").agg(F.min("best").alias("best"), F.sum("size").alias("group_size"))
    named = materialize(sides.select("digest", "side", "gen").join(groups, ["digest", "gen"]).drop("gen"), "groups")
    # one row per group against all rows: adaptive execution splits the large groups
    return rows.join(named, ["digest", "side"]).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _byte_check(met: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Digests of which a snapshot text and a batch text agree in every byte.

    Only texts that stand for a group in ``met`` pass a filter and are shuffled; the filter is
    handed to all tasks if it has at most ``SCREEN_BYTES``, else all texts are shuffled.
    """
    texts = []
    for docs, name in ((old, "old_id"), (new, "new_id")):
        norm = normalised(F.col("text"))
        # an id may repeat with other texts: only the text of this digest counts
        found = documents(docs).select("doc_id", norm.alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
        wanted = met.select(F.col("digest").alias("_digest"), F.col(name).alias("_id"))
        maybe = _screen_of(wanted.select(F.xxhash64("_digest", "_id").alias("key")))
        if maybe is not None:
            found = found.filter(maybe(F.xxhash64("digest", "doc_id")))
        same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        texts.append(found.join(wanted, same).select("digest", "norm").dropDuplicates())
    a, b = texts
    return a.withColumnRenamed("norm", "a").join(b.withColumnRenamed("norm", "b"), "digest").filter("a = b").select("digest").distinct()


def _screen_of(keys: DataFrame):
    """A column function that passes every ``key`` and about one in 256 others, or None where it would be too large."""
    n = keys.count()
    if n * 2 > SCREEN_BYTES:  # a fuse filter takes a little over a byte a key
        return None
    spark, buckets = keys.sparkSession, max(1, -(-n // BUCKET_KEYS))
    built = keys.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInPandas(_build_bucket, FILTERS)
    filters = spark.sparkContext.broadcast({r["bucket"]: (r["seed"], r["segment"], r["segments"], bytes(r["prints"])) for r in built.collect()})

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        values = key.to_numpy()
        bucket, out = values % buckets, np.zeros(len(values), dtype=bool)
        for b in np.unique(bucket):
            if int(b) in filters.value:
                at = np.flatnonzero(bucket == b)
                out[at] = passes(values[at].astype(np.uint64), *filters.value[int(b)])
        return pd.Series(out)

    return maybe
