"""Substring deduplication over the suffix array of a prefix-free parse.

Wanted are all strings of ``window`` bytes that also start earlier in the corpus.  Each such
string has an anchor: the place of its smallest rolling hash over ``gram`` bytes.  A trigger
is a string of ``window + 1`` bytes whose anchor moves between its two windows, so whether a
place is a trigger depends on its bytes alone.  A phrase runs from one trigger to the end of
the next; every window lies in exactly one phrase, and no phrase suffix of that length is a
proper prefix of another, which makes the parse prefix-free.

* The *parse* lists every phrase with its places.  Its suffixes sorted by phrase put all
  places of a phrase next to each other in corpus order: all but the first are repeats, and
  highly repetitive text is settled here, phrase by phrase.
* The *dictionary* holds every distinct phrase once.  Windows with equal bytes share their
  anchor, so its suffix array is built in partitions of one anchor string each; phrases that
  share theirs with no other phrase need none.
* Combined: a suffix of the dictionary stands for its places in the parse, so the earliest
  place of a class of neighbouring suffixes (common prefix of a whole window) is the smallest
  first place of their phrases.

An anchor string that too many distinct phrases share (the edges of a very common passage)
is lengthened: its windows are halved by their distance from the anchor, and each half files
its phrases under the longer string that all its windows contain, deduplicated anew.  After
six halvings a group is one window, so no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, release, settle
from tidemark.llm.words import mix
from tidemark.workspace import ship_package

WINDOW = 100
GROUP = 4_000  # phrases of one anchor string whose suffixes one task sorts, at most 61 windows each
BLOCK = 4_000  # phrases after which the suffixes of a task's next groups are sorted
PIECE = 1 << 21  # bytes hashed at a time; a longer text is parsed in overlapping pieces
LAST = (1 << 63) - 1  # order of rows without an id
SEEN = 100_000  # phrases whose bytes a task has sent and does not send again
_RADIX = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_PLACE_BITS = 23  # places inside a piece

SCAN = "doc_id long, ord long, tid long, n_bytes long, sha binary, grams array<long>, firsts array<int>, counts array<int>, again array<boolean>"
PHRASES = "phrase binary, key long, lo int, hi int, back int, ord long, tid long, first int, count int, bytes binary"
RANGES = "tid long, first int, count int"
NOTHING = hashlib.sha256(b"").digest()


def gram_of(window: int) -> int:
    """Bytes of the rolling hash for windows of this size."""
    return max(1, window * 2 // 5)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_RADIX, pow(_RADIX, -1, 1 << 64)):
        row = np.full(PIECE + (1 << 16), base, dtype=np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def parse(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts laid end to end: (anchor hash, anchor place, first window, windows).

    ``ends`` are the ends of the texts; no window crosses one.
    """
    gram = gram_of(window)
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.uint64),) + (np.zeros(0, dtype=np.int64),) * 3
    power, inverse = _powers()
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    hashes = mix((total[gram:] - total[:-gram]) * inverse[: len(data) - gram + 1])
    # the place in the low bits makes the leftmost of equal hashes the smallest
    least = (hashes << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    width, span = window - gram + 1, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    at = (least[:n] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    valid = np.ones(n, dtype=bool)
    starts = np.arange(n)
    for end in ends[:-1]:  # windows over the end of a text
        valid[max(0, end - window + 1) : end] = False
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    first, last = starts[new], starts[stop]
    return hashes[at[first]], at[first], first, last - first + 1


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lots of (text number, offset, bytes) of about a piece; long texts overlap by a window less one."""
    lot, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), PIECE // 2):
            part = text[at : at + PIECE // 2 + window - 1]
            lot.append((i, at, part))
            size += len(part)
            if size >= PIECE // 2:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def phrases_of(texts: list[bytes], window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: anchor hashes, anchor places, first windows and window counts of its phrases."""
    found: list[list] = [[] for _ in texts]
    for lot in _pieces(texts, window):
        data = np.frombuffer(b"".join(p for _, _, p in lot), dtype=np.uint8)
        ends = np.cumsum([len(p) for _, _, p in lot])
        key, place, first, count = parse(data, ends, window)
        cuts = np.searchsorted(first, np.append(0, ends))
        for j, (i, at, part) in enumerate(lot):
            a, b, base = cuts[j], cuts[j + 1], ends[j] - len(part) - at
            found[i].append((key[a:b], place[a:b] - base, first[a:b] - base, count[a:b]))
    return [tuple(np.concatenate(c) for c in zip(*parts)) for parts in found]


def _scan(docs: DataFrame, window: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            parsed = phrases_of(texts, window) if texts else []
            again = []
            for key, *_ in parsed:
                _, where, n = np.unique(key, return_inverse=True, return_counts=True)
                again.append(n[where] > 1)
            cuts = pa.array(np.append(0, np.cumsum([len(p[0]) for p in parsed])).astype(np.int32))
            flat = lambda k: np.concatenate([p[k] for p in parsed]) if parsed else np.zeros(0)
            lists = [
                pa.ListArray.from_arrays(cuts, pa.array(v))
                for v in (flat(0).astype(np.uint64).view(np.int64), flat(2).astype(np.int32), flat(3).astype(np.int32), np.concatenate(again) if again else np.zeros(0, dtype=bool))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ord"), batch.column("tid"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), *lists],
                names=["doc_id", "ord", "tid", "n_bytes", "sha", "grams", "firsts", "counts", "again"],
            )

    return docs.mapInArrow(scan, SCAN)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in names.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _lists(column: pa.ListArray, fields: tuple[str, ...] = ()) -> Iterator:
    """The lists of a column as numpy arrays; of structs, a tuple of arrays."""
    cuts = column.offsets.to_numpy()
    flat = [column.values.field(f).to_numpy() for f in fields] if fields else [column.values.to_numpy()]
    for a, b in zip(cuts[:-1], cuts[1:]):
        parts = tuple(v[a:b] for v in flat)
        yield parts if fields else parts[0]


def _cut_phrases(window: int):
    """Texts with their shared anchors to phrases; a task sends the bytes of a phrase once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            parsed = phrases_of(texts, window) if texts else []
            for order, tid, data, shared, (key, place, first, count) in zip(*(batch.column(c).to_pylist() for c in ("ord", "tid")), texts, _lists(batch.column("runs")), parsed):
                chosen, rows = np.isin(first, shared), []
                key, place, first, count = (v[chosen].tolist() for v in (key.view(np.int64), place, first, count))
                for k, p, a, n in zip(key, place, first, count):
                    raw = data[a : a + n + window - 1]
                    digest = xxhash.xxh3_128_digest(raw)
                    known = digest in sent
                    rows.append((digest, k, 0, window - gram_of(window) + 1, p - a, order, tid, a, n, None if known else raw))
                    if not known:
                        if len(sent) >= SEEN:
                            sent.clear()
                        sent.add(digest)
                    if len(rows) == 10_000:
                        yield _batch(rows, PHRASES)
                        rows = []
                if rows:
                    yield _batch(rows, PHRASES)

    return cut


def halve(key: int, lo: int, hi: int, back: int, first: int, count: int, raw: bytes, window: int):
    """The two halves of a phrase by the distance of its windows to the anchor, under longer strings.

    Distances are in [lo, hi); the anchor is ``back`` bytes after the first window.
    """
    middle = (lo + hi + 1) // 2
    for a, b in ((lo, middle), (middle, hi)):
        start, stop = max(0, back - b + 1), min(count, back - a + 1)  # windows at distance a .. b - 1
        if a < b and start < stop:
            common = raw[back - a : back - b + 1 + window]  # in every window of this half
            longer = xxhash.xxh3_64_intdigest(common, seed=a * 1_000 + b) - (1 << 63)
            part = raw[start : stop + window - 1]
            yield longer, a, b, back - start, first + start, stop - start, part


def _halves(window: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for key, lo, hi, back, first, count, raw in halve(r["key"], r["lo"], r["hi"], r["back"], r["first"], r["count"], r["bytes"], window):
                    rows.append((xxhash.xxh3_128_digest(raw), key, lo, hi, back, r["ord"], r["tid"], first, count, raw))
            yield _batch(rows, PHRASES)

    return split


def suffix_array(raw: list[bytes], group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of at least a window, by group: (phrase, offset, class) in suffix order.

    Suffixes of one class agree in their first ``window`` bytes.
    """
    sizes = np.array([len(r) for r in raw])
    counts = sizes - window + 1
    base = np.cumsum(sizes) - sizes
    phrase = np.repeat(np.arange(len(raw)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(data, window)
    strings = np.ascontiguousarray(views[base[phrase] + offset]).view(f"S{window}").ravel()
    by_group = group[phrase]
    order = np.argsort(strings, kind="stable")
    order = order[np.argsort(by_group[order], kind="stable")]
    strings, by_group = strings[order], by_group[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (strings[1:] != strings[:-1]) | (by_group[1:] != by_group[:-1])
    return phrase[order], offset[order], np.cumsum(new) - 1


def _repeats(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Windows of first places that are not the earliest of their class, as runs."""
    key = rows.column("key").to_numpy()
    group = np.cumsum(np.append(0, key[1:] != key[:-1]))
    phrase, offset, cls = suffix_array(rows.column("bytes").to_pylist(), group, window)
    order, tid, first = (rows.column(c).to_numpy()[phrase] for c in ("ord", "tid", "first"))
    place = first + offset
    rank = np.lexsort((place, tid, order, cls))  # corpus order inside each class
    later = np.zeros(len(rank), dtype=bool)
    later[1:] = cls[rank][1:] == cls[rank][:-1]
    hit = rank[later]
    hit = hit[np.lexsort((offset[hit], phrase[hit]))]
    p, o = phrase[hit], offset[hit]
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(hit)))
    return pa.RecordBatch.from_arrays(
        [pa.array(tid[hit][at], pa.int64()), pa.array(place[hit][at].astype(np.int32)), pa.array(count.astype(np.int32))], names=["tid", "first", "count"]
    )


def _sorted_groups(window: int):
    """Suffix arrays of rows sorted by key, a block of whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                for at in _blocks(key[:cut]):
                    yield _repeats(table.slice(at[0], at[1] - at[0]), window)
                table = table.slice(cut)
                held, rows = table.to_batches(), table.num_rows
        if rows:
            table = pa.Table.from_batches(held)
            for a, b in _blocks(table.column("key").to_numpy()):
                yield _repeats(table.slice(a, b - a), window)

    return run


def _blocks(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of sorted keys into runs of about BLOCK rows that split no key."""
    at = 0
    while at < len(key):
        end = min(at + BLOCK, len(key))
        if end < len(key):
            whole = int(np.searchsorted(key, key[end]))
            end = whole if whole > at else int(np.searchsorted(key, key[end], side="right"))
        yield at, end
        at = end


def _dictionary(phrases: DataFrame) -> DataFrame:
    """Every distinct phrase with its first place in corpus order."""
    place = F.min(F.struct("ord", "tid", "first")).alias("at")
    kept = [F.first(c).alias(c) for c in ("key", "hi", "back", "count")]
    out = phrases.groupBy("phrase", "lo").agg(place, *kept, F.first("bytes", ignorenulls=True).alias("bytes"))
    return out.select("phrase", "lo", "key", "hi", "back", "count", "at.ord", "at.tid", "at.first", "bytes")


def _later(phrases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The places of the parse that are not the first of their phrase."""
    first = dictionary.select("phrase", "lo", F.struct("tid", "first").alias("at"))
    return phrases.select("phrase", "lo", "tid", "first", "count").join(first, ["phrase", "lo"]).filter(
        F.struct("tid", "first") != F.col("at")
    ).select("tid", "first", "count")


def repeated_windows(chosen: DataFrame, window: int, group: int = GROUP) -> list[DataFrame]:
    """Runs of windows that also start earlier: written tables of (tid, first, count), over texts with shared anchors."""
    phrases = settle(chosen.mapInArrow(_cut_phrases(window), PHRASES), "parse")
    found = []
    for _ in range(window):  # a group is one window after about six halvings
        dictionary = settle(_dictionary(phrases), "dictionary")
        found.append(settle(_later(phrases, dictionary), "later"))
        release(phrases)
        sizes = dictionary.groupBy("key", "lo").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = settle(dictionary.join(sizes, ["key", "lo"]), "shared-anchors")
        release(dictionary)
        small = (F.col("n") <= group) | (F.col("hi") - F.col("lo") <= 1)
        cold = shared.filter(small).select("key", "ord", "tid", "first", "bytes")
        # distances of one key are apart in the key itself from the first halving on
        found.append(settle(cold.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(window), RANGES), "suffixes"))
        hot = shared.filter(~small)
        more = not hot.isEmpty()
        if more:
            phrases = settle(hot.select("key", "lo", "hi", "back", "ord", "tid", "first", "count", "bytes").mapInArrow(_halves(window), PHRASES), "longer")
        release(shared)
        if not more:
            break
    return found


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans.

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a
    document with a smaller id, or before in the same document.  Strings are judged on the
    input and never cross documents.  Null texts are empty; texts shorter than ``window``
    stay whole.  Rows without an id come after all others; rows that share their id, or have
    none, follow each other by a hash of id and text, and count as one document where the
    text is equal too.  Of equal texts the later documents lose everything.  An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = documents(docs).withColumn("ord", F.coalesce("doc_id", F.lit(LAST))).withColumn("tid", F.xxhash64("ord", "text"))
    scanned = settle(_scan(texts, window), "scanned")
    rows = settle(scanned.select("doc_id", "ord", "tid", "n_bytes", "sha"), "rows")
    heads = rows.groupBy("sha").agg(F.min(F.struct("ord", "tid")).alias("h")).select("sha", F.col("h.ord").alias("head_ord"), F.col("h.tid").alias("head"))
    heads = settle(heads, "heads")

    # anchors of one place alone cannot repeat; copies of one text count once
    content = F.xxhash64("sha")
    grams = scanned.select(content.alias("content"), F.explode(F.arrays_zip("grams", "again")).alias("g")).select("content", "g.grams", "g.again")
    shared = grams.groupBy("grams").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.max("again").alias("again")).filter("a <> b OR again")
    shared = settle(shared.select("grams"), "anchors")
    places = scanned.select("tid", F.explode(F.arrays_zip("grams", "firsts")).alias("g")).select("tid", "g.grams", F.col("g.firsts").alias("first"))
    mine = places.join(shared, "grams").groupBy("tid").agg(F.collect_set("first").alias("runs"))
    mine = mine.join(heads.select(F.col("head").alias("tid")).distinct(), "tid", "left_semi")
    mine = settle(mine, "places")
    release(scanned, shared)
    chosen = texts.select("tid", "ord", "text").join(mine, "tid").dropDuplicates(["tid"])
    chosen = settle(chosen, "chosen")
    release(mine)

    found = repeated_windows(chosen, window, group)
    cover = reduce(DataFrame.unionByName, found).groupBy("tid").agg(F.collect_list(F.struct("first", "count")).alias("cover"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for tid, data, (first, count) in zip(batch.column("tid").to_pylist(), texts, _lists(batch.column("cover"), ("first", "count"))):
                order = np.argsort(first, kind="stable")
                first, end = first[order].astype(np.int64), (first + count)[order].astype(np.int64) + window - 1
                reach = np.maximum.accumulate(end)
                new = np.append(True, first[1:] > reach[:-1])
                at = np.flatnonzero(new)
                spans = list(zip(first[at].tolist(), reach[np.append(at[1:], len(first)) - 1].tolist()))
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out.append((tid, sum(b - a for a, b in spans), digest.digest(), [{"first": a, "last": b} for a, b in spans]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tid", "n_removed", "kept", "removed"])

    schema = "tid long, n_removed long, kept binary, removed array<struct<first:int,last:int>>"
    changed = settle(chosen.select("tid", "text").join(cover, "tid").mapInArrow(cut, schema), "changed")
    release(chosen, *found)
    by_text = settle(heads.join(changed.withColumnRenamed("tid", "head"), "head", "left"), "results")

    copy = (F.col("ord") > F.col("head_ord")) & (F.col("n_bytes") >= window)
    own = F.col("tid") == F.col("head")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_bytes").cast("int").alias("last")))
    out = rows.join(by_text, "sha").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.lit(NOTHING)).when(own, F.coalesce("kept", "sha")).otherwise(F.col("sha")))).alias("kept_sha256"),
        F.coalesce(F.when(copy, whole).when(own, F.col("removed")), F.array().cast("array<struct<first:int,last:int>>")).alias("removed"),
    )
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", "removed")
