"""Substring deduplication over prefix-partitioned suffix trees.

Wanted are all runs of ``window`` words that also start in a document with a smaller id.
Every window is filed under one of its suffixes: the one that begins with the smallest
hashed ``PREFIX``-word run inside the window, an anchor that depends on the window's words
alone.  Suffixes are partitioned by that prefix, and a prefix of only one document drops out
before any text moves.  A memory-sized group is grown into a suffix tree level by level:
one level splits the nodes by the next word, to the right of the anchor and, for windows
that begin before it, to the left.  Nodes at full window depth with several documents are
the repeats.  A prefix of more than ``GROUP`` places takes the whole window as its longer
prefix, and its nodes are resolved by an ordinary aggregation that no single task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents
from tidemark.llm.words import in_slices, rolling, word_hashes
from tidemark.workspace import materialize, ship_package

WINDOW = 50
PREFIX = 8
GROUP = 50_000  # places of one prefix that a tree may hold, about 60 MB of contexts and matrix
BLOCK = 20_000  # places after which the trees of a task's next prefixes are grown
SLICE_BYTES = 8 << 20
LAST = (1 << 63) - 1  # order of rows without an id

SCAN = "doc_id long, text_key long, n_words long, sha binary, grams array<long>, places array<int>, firsts array<int>"
CONTEXTS = "gram long, ord long, text_key long, place int, before int, first int, count int, words binary"
WINDOWS = "h1 long, h2 long, ord long, text_key long, first int"
RANGES = "ord long, text_key long, first int, last int"
NOTHING = hashlib.sha256(b"").digest()


def anchors(hashes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, anchor, hash), over texts laid end to end.

    The anchor is the leftmost smallest prefix hash of the window.
    """
    grams = rolling(hashes, PREFIX)
    width = window - PREFIX + 1
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    at, span = np.arange(len(grams)), 1
    while span < width:  # doubling: smallest of the next `span` grams
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at, span = np.where(grams[right] < grams[left], right, left), span + step
    at = at[:n]
    owner = np.searchsorted(ends, np.arange(n), side="right")
    valid = np.arange(n) + window <= ends[owner]
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    return first, at[first], grams[at[first]]


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _scan(docs: DataFrame, window: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()))
            for part in in_slices(rows, lambda r: len(r[2]), SLICE_BYTES):
                known.trim()
                words = [t.split() for _, _, t in part]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                ends = np.cumsum(sizes)
                hashes = known.of([w for ws in words for w in ws])
                first, place, gram = anchors(hashes, ends, window)
                owner = np.searchsorted(ends, first, side="right")
                base = (ends - sizes)[owner]
                cuts = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (_signed(gram), (place - base).astype(np.int32), (first - base).astype(np.int32))]
                sha = [hashlib.sha256(b" ".join(w)).digest() for w in words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array(sizes), pa.array(sha, pa.binary()), *lists],
                    names=["doc_id", "text_key", "n_words", "sha", "grams", "places", "firsts"],
                )

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(scan, SCAN)


def _refine(nodes: np.ndarray, words: np.ndarray, many: int) -> np.ndarray:
    """One level down the tree: nodes numbered anew by (node, next word)."""
    return np.unique(nodes * many + words, return_inverse=True)[1]


def grow(gram: np.ndarray, order: np.ndarray, words: np.ndarray, before: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Which windows repeat one of an earlier document, for whole groups of places.

    ``words`` has ``window - PREFIX`` columns left of the anchor (nearest first) and
    ``window`` from it on, -1 where a context ends.  A place has ``count`` windows, the
    first of which begins ``before`` words left of the anchor.  Gives a matrix over how
    many words before the anchor a window begins.
    """
    reach, many = window - PREFIX, int(words.max()) + 2
    left, right = words[:, :reach] + 1, words[:, reach:] + 1
    nodes = np.unique(gram, return_inverse=True)[1]
    deep = [nodes]
    for level in range(window):
        nodes = _refine(nodes, right[:, level], many)
        deep.append(nodes)
    back, out = deep[0], np.zeros((len(gram), reach + 1), dtype=bool)
    for shift in range(reach + 1):
        if shift:
            back = _refine(back, left[:, shift - 1], many)
        rows = np.flatnonzero((before >= shift) & (before - count < shift))
        if len(rows):
            _, node = np.unique(back[rows] * (len(gram) + 1) + deep[window - shift][rows], return_inverse=True)
            lowest = np.full(node.max() + 1, LAST, dtype=np.int64)
            np.minimum.at(lowest, node, order[rows])
            out[rows, shift] = order[rows] > lowest[node]
    return out


def _trees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Grow the trees of sorted contexts, a block of whole groups at a time."""
    reach = window - PREFIX

    def block(table: pa.Table) -> pa.RecordBatch:
        column = {n: table.column(n).to_numpy() for n in ("gram", "ord", "text_key", "place", "before", "count")}
        numbers: dict[bytes, int] = {}
        matrix = np.full((table.num_rows, reach + window), -1, dtype=np.int32)
        for i, raw in enumerate(table.column("words").to_pylist()):
            ids = [numbers.setdefault(w, len(numbers)) for w in raw.split(b" ")]
            b = int(column["before"][i])
            matrix[i, :b] = ids[:b][::-1]
            matrix[i, reach : reach + len(ids) - b] = ids[b:]
        hit = grow(column["gram"], column["ord"], matrix, column["before"], column["count"], window)
        row, shift = np.nonzero(hit[:, ::-1])  # ascending window starts
        start = column["place"][row] - (reach - shift)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row))[: len(first)] - 1
        return pa.RecordBatch.from_pydict({
            "ord": pa.array(column["ord"][row[first]]), "text_key": pa.array(column["text_key"][row[first]]),
            "first": pa.array(start[first].astype(np.int32)), "last": pa.array((start[last] + window).astype(np.int32)),
        })

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last group may go on
            if cut:
                yield block(table.slice(0, cut))
                table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield block(pa.Table.from_batches(held))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, text_key and the kept text's ranges.

    A word is removed if a window that covers it has a word sequence that also starts in a
    document with a smaller id; windows are judged on the input.  Null texts have no words.
    Rows without an id come after all others and are not earlier than each other; rows of
    one id are not earlier than each other either.  Texts of fewer than ``window`` words
    stay whole.  ``removed`` lists the removed word ranges (first, end) of the row.  Equal
    word sequences are worked on once.  An empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = documents(docs)
    scanned = materialize(_scan(texts, window), "scanned")
    order = F.coalesce("doc_id", F.lit(LAST)).alias("ord")
    first = F.min(F.struct(order, "text_key", "n_words", "grams", "places", "firsts")).alias("u")
    distinct = materialize(scanned.groupBy("sha").agg(first).select("sha", "u.*"), "sequences")

    # anchors whose prefix starts in more than one document
    runs = F.transform(
        F.sequence(F.lit(0), F.size("grams") - 1),
        lambda i: F.struct(F.get("grams", i).alias("gram"), F.get("places", i).alias("place"), F.get("firsts", i).alias("first")),
    )
    places = distinct.filter(F.size("grams") > 0).select("ord", "text_key", F.explode(runs).alias("r")).select("ord", "text_key", "r.*")
    shared = places.groupBy("gram").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    shared = materialize(shared.select("gram", (F.col("n") > GROUP).alias("hot")), "prefixes")
    mine = places.join(shared, "gram").groupBy("ord", "text_key").agg(F.collect_list(F.struct("first", "place", "gram", "hot")).alias("runs"))
    keyed = texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("text_key"), "text")
    # one text per key: equal rows would give equal ranges
    chosen = materialize(keyed.join(mine, ["ord", "text_key"]), "chosen")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc in _runs(batch, window, hot=False):
                order_, key, words, found = doc
                rows = [
                    (gram, order_, key, place, place - first_, first_, count, b" ".join(words[first_ : first_ + count - 1 + window]))
                    for gram, place, first_, count in found
                ]
                if rows:
                    cols = list(zip(*rows))
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    names = ["gram", "ord", "text_key", "place", "before", "first", "count", "words"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            for order_, key, words, found in _runs(batch, window, hot=True):
                if not found:
                    continue
                known.trim()
                hashes = known.of(words)
                h1, h2 = rolling(hashes, window, 1000), rolling(hashes, window, 2000)
                at = np.concatenate([np.arange(f, f + c) for _, _, f, c in found])
                yield pa.RecordBatch.from_pydict({
                    "h1": pa.array(_signed(h1[at])), "h2": pa.array(_signed(h2[at])), "ord": pa.array(np.full(len(at), order_)),
                    "text_key": pa.array(np.full(len(at), key)), "first": pa.array(at.astype(np.int32)),
                })

    grown = chosen.mapInArrow(contexts, CONTEXTS).repartition("gram").sortWithinPartitions("gram")
    ranges = grown.mapInArrow(lambda b: _trees(b, window), RANGES)
    hot = materialize(chosen.filter(F.exists("runs", lambda r: r["hot"])).mapInArrow(whole_windows, WINDOWS), "hot-windows")
    lowest = materialize(hot.groupBy("h1", "h2").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).filter("low < high").drop("high"), "hot-nodes")
    deep = hot.join(lowest, ["h1", "h2"]).filter("ord > low").select("ord", "text_key", "first", (F.col("first") + window).cast("int").alias("last"))
    cover = ranges.unionByName(deep).groupBy("ord", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("cover"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("ord", "text_key", "n_removed", "kept", "removed")}
            columns = (batch.column("ord"), batch.column("text_key"), batch.column("text").cast(pa.binary()), batch.column("cover"))
            for order_, key, text, spans in zip(*(c.to_pylist() for c in columns)):
                words, merged = text.split(), []
                for span in sorted((s["first"], s["last"]) for s in spans):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                values = (order_, key, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).digest(), [{"first": a, "last": b} for a, b in merged])
                for name, value in zip(out, values):
                    out[name].append(value)
            span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), span_type)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    schema = "ord long, text_key long, n_removed long, kept binary, removed array<struct<first:int,last:int>>"
    changed = chosen.select("ord", "text_key", "text").join(cover, ["ord", "text_key"]).mapInArrow(cut, schema)
    changed = changed.dropDuplicates(["ord", "text_key"])
    results = materialize(distinct.select("sha", "ord", "text_key").join(changed, ["ord", "text_key"], "left").select("sha", F.col("ord").alias("head"), "n_removed", "kept", "removed"), "results")

    all_rows = scanned.select("doc_id", "text_key", "n_words", "sha", order).join(results, "sha")
    copy = (F.col("ord") > F.col("head")) & (F.col("n_words") >= window)
    own = F.col("ord") == F.col("head")
    everything = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")))
    return all_rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.lit(NOTHING)).when(own, F.coalesce("kept", "sha")).otherwise(F.col("sha")))).alias("kept_sha256"),
        "text_key", F.when(copy, everything).when(own, F.col("removed")).alias("removed"),
    )


def _runs(batch: pa.RecordBatch, window: int, hot: bool):
    """Documents of a batch with the runs of windows under a shared prefix: (gram, place, first, count)."""
    columns = (batch.column("ord"), batch.column("text_key"), batch.column("text").cast(pa.binary()), batch.column("runs"))
    for order, key, text, runs in zip(*(c.to_pylist() for c in columns)):
        words = text.split()
        # a run ends where its anchor leaves the window or the next run starts; the stored
        # runs are only the shared ones, so the end is the anchor unless a later one is nearer
        runs = sorted((r["first"], r["place"], r["gram"], r["hot"]) for r in runs)
        found = []
        for i, (first, place, gram, is_hot) in enumerate(runs):
            stop = min(place, len(words) - window)
            if i + 1 < len(runs):
                stop = min(stop, runs[i + 1][0] - 1)
            if is_hot == hot:
                found.append((gram, place, first, stop - first + 1))
        yield order, key, words, found
