"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

Each (shingle, weight range) owns a Poisson process that depends on its hash alone.  Weight
ranges double ([0,1), [1,2), [2,4), ...); a point of a range falls to one of its weight
units by random halving and counts if the shingle occurs that often.  Points arrive in
rising order, each hits one register, and a process ends when its next point exceeds the
largest register of the document, so long documents need about one point per shingle.  Two
registers agree with the probability of the weighted Jaccard similarity.

Bands of registers give candidates; the exact multiset similarity decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LAST, documents, unpacked, whole_rows
from tidemark.llm.components import components
from tidemark.llm.words import in_slices, mix, rolling, word_hashes
from tidemark.workspace import materialize, ship_package

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
LIKELY = 0.65  # registers that must agree before texts are compared, over four deviations below 0.8
SLICE_BYTES = 6 << 20
CELL = 2_000  # members of a bucket compared with each other in one piece
SIGNED = "doc_id long, text_key long, sha binary, n_shingles long, bands array<long>, registers binary"


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all five-word runs; a shorter text is one shingle, a text without words has none."""
    return rolling(hashes, SHINGLE) if len(hashes) >= SHINGLE or not len(hashes) else rolling(hashes, len(hashes), 77)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, documents_: int) -> np.ndarray:
    """Register minima (as 64-bit patterns) of documents given as (owner, shingle, weight) entries."""
    least = np.full(documents_ * REGISTERS, np.inf)
    top = np.full(documents_, np.inf)
    # one entry per weight range that the shingle reaches into
    parts = [(owner, element, np.zeros(len(owner), dtype=np.int64), np.ones(len(owner), dtype=np.int64))]
    level = 1
    while True:
        low = 1 << (level - 1)
        reach = np.flatnonzero(weight > low)
        if not len(reach):
            break
        parts.append((owner[reach], element[reach], np.full(len(reach), level), np.minimum(weight[reach] - low, low)))
        level += 1
    doc, item, range_, units = (np.concatenate(p) for p in zip(*parts))
    width = np.left_shift(1, np.maximum(range_ - 1, 0))  # weight units in the range
    seed = mix(item + np.uint64(0x9E3779B97F4A7C15) * (range_.astype(np.uint64) + np.uint64(1)))
    at, step, done = np.zeros(len(doc)), 1, 0
    while len(doc):
        turn = np.arange(done, done + step, dtype=np.uint64)
        h = mix(seed[:, None] + (turn + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (REGISTERS * width)[:, None]
        when = at[:, None] + np.cumsum(gap, axis=1)
        side = mix(h ^ np.uint64(0xA0761D6478BD642F))
        register = ((side >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        unit = ((side & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64)[:, None]) >> np.uint64(32)
        live = (when <= top[doc][:, None]) & (unit < units.astype(np.uint64)[:, None])
        row, col = np.nonzero(live)
        np.minimum.at(least, doc[row] * REGISTERS + register[row, col].astype(np.int64), when[row, col])
        touched = np.unique(doc)
        top[touched] = least.reshape(documents_, REGISTERS)[touched].max(axis=1)
        at = when[:, -1]
        keep = at <= top[doc]
        doc, seed, width, units, at = doc[keep], seed[keep], width[keep], units[keep], at[keep]
        done += step
        step = min(64, step * 2) if done > 1 else 1
    return least.view(np.uint64).reshape(documents_, REGISTERS)


def _sign(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()))
            for part in in_slices(rows, lambda r: len(r[2]) + 2000, SLICE_BYTES):
                known.trim()
                words = [t.split() for _, _, t in part]
                sets = [np.unique(shingles(known.of(w)), return_counts=True) for w in words]
                sizes = np.array([len(s[0]) for s in sets])
                owner = np.repeat(np.arange(len(part)), sizes)
                found = signatures(owner, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), len(part))
                banded = np.zeros((len(part), BANDS), dtype=np.uint64)
                for j in range(ROWS):
                    banded = mix(banded * np.uint64(31) + found[:, j::ROWS] + np.uint64(j))
                banded = mix(banded + np.arange(BANDS, dtype=np.uint64))
                marks = (mix(found) & np.uint64(255)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(banded.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary()),
                        pa.array([int(s[1].sum()) for s in sets], pa.int64()), lists, pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "sha", "n_shingles", "bands", "registers"],
                )

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(sign, SIGNED)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    if not len(a) or not len(b):
        return 0.0
    _, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = int(inverse.max()) + 1
    left, right = np.bincount(inverse[: len(a)], minlength=n), np.bincount(inverse[len(a) :], minlength=n)
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


def _likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose registers and sizes leave room for the wanted similarity."""
    for name in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(name), F.col("registers").alias(f"r_{name}"), F.col("n_shingles").alias(f"n_{name}")), name)

    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        u, v = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), REGISTERS) for s in (x, y))
        return pd.Series((u == v).mean(axis=1))

    bound = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * SIMILARITY
    return pairs.filter(bound).filter(F.pandas_udf(agree, "double")("r_a", "r_b") >= LIKELY).select("a", "b")


def _texts_of(ids: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Id and whole text of the named texts."""
    wanted = ids.distinct().join(texts.select("id", "ord", "text_key"), "id")
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("text_key"), "text")
    return materialize(keyed.join(wanted, ["ord", "text_key"]).dropDuplicates(["id"]).select("id", "text"), "own-texts")


def _verify(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose multisets have the wanted similarity, from their whole texts."""
    pairs = materialize(pairs, "pairs")
    own = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), texts, docs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = word_hashes(), (None, None)
        for batch in batches:
            known.trim()
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts_ = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("t_a", "t_b"))
            good = []
            for x, y, s, t in zip(a, b, *texts_):
                if last[0] != x:
                    last = (x, shingles(known.of(s.split())))
                good.append(similarity(last[1], shingles(known.of(t.split()))) >= SIMILARITY)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    both = pairs.join(own.select(F.col("id").alias("b"), F.col("text").alias("t_b")), "b").join(own.select(F.col("id").alias("a"), F.col("text").alias("t_a")), "a")
    return materialize(both.select("a", "b", "t_a", "t_b").mapInArrow(check, "a long, b long"), "links")


def _across(members: DataFrame) -> DataFrame:
    """Links between different components of one bucket, found in cells of bounded size.

    A bucket of n members is cut into chunks; every pair of chunks meets in one cell.  There
    all pairs of different components are compared, likely ones on their whole texts, until
    a link has joined the components; only such links are emitted.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("chunks"))
    cut = members.join(materialize(sizes, "cells"), "bucket").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda j: F.struct(F.least(F.col("chunk"), j).alias("low"), F.greatest(F.col("chunk"), j).alias("high")),
    )
    cells = cut.withColumn("cell", F.explode(meets)).select("bucket", "cell.low", "cell.high", "chunk", "id", "root", "n_shingles", "registers", "text")

    def compare(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        known, seen, joined, out = word_hashes(), {}, {}, []
        known.trim()
        texts = dict(zip(cell["id"], cell["text"]))

        def own(id_: int) -> np.ndarray:
            if id_ not in seen:
                seen[id_] = shingles(known.of(texts[id_].encode("utf-8", "surrogatepass").split()))
            return seen[id_]

        def find(root: int) -> int:
            while joined.get(root, root) != root:
                root = joined[root]
            return root

        left, right = cell[cell["chunk"] == key[1]], cell[cell["chunk"] == key[2]]
        other = np.frombuffer(b"".join(right["registers"]), dtype=np.uint8).reshape(len(right), REGISTERS)
        ids, roots, sizes_ = (right[c].to_numpy() for c in ("id", "root", "n_shingles"))
        for id_, root, size, raw in zip(left["id"], left["root"], left["n_shingles"], left["registers"]):
            near = (roots != root) & (np.minimum(sizes_, size) >= np.maximum(sizes_, size) * SIMILARITY)
            if key[1] == key[2]:
                near &= ids > id_
            at = np.flatnonzero(near)
            if len(at):
                at = at[(other[at] == np.frombuffer(raw, dtype=np.uint8)).mean(axis=1) >= LIKELY]
            for i in at.tolist():
                a, b = find(root), find(int(roots[i]))
                if a != b and similarity(own(id_), own(int(ids[i]))) >= SIMILARITY:
                    joined[max(a, b)] = min(a, b)
                    out.append((min(id_, int(ids[i])), max(id_, int(ids[i]))))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cells.groupBy("bucket", "low", "high").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, n_links, text_key, is_head.

    A class is a connected component of texts whose multisets of five-word shingles have a
    weighted Jaccard similarity of at least 0.8; ``class_id`` is its smallest doc_id.  Equal
    word sequences are one text; ``n_links`` counts the verified links between different texts
    that the classes rest on (pairs already joined are not compared again).  Words are
    runs without white space, unchanged.  A text of one to four words is a single shingle;
    texts without words (null ones too) equal each other and nothing else.  Rows without an
    id belong to classes but name one only if it has no other row (``class_id`` is null
    then).  Repeated rows are all returned.  An empty table gives no rows, other columns are
    ignored.

    First every member of a bucket is compared with the bucket's first member.  What is
    still in different components after that is compared within each bucket completely.
    """
    ship_package(docs.sparkSession)
    docs = documents(docs)
    signed = materialize(_sign(docs), "signed")
    order = F.coalesce("doc_id", F.lit(LAST)).alias("ord")
    first = F.min(F.struct(order, "text_key", "n_shingles", "bands", "registers")).alias("u")
    texts = materialize(signed.groupBy("sha").agg(first).select("sha", "u.*").withColumn("id", F.monotonically_increasing_id()), "texts")

    entries = texts.filter("n_shingles > 0").select("id", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = materialize(entries.join(buckets, "bucket"), "members")
    stars = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = _verify(_likely(stars, texts), texts, docs)
    roots = components(links)

    placed = members.select("bucket", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = materialize(placed.join(mixed, "bucket"), "open")
    own = _texts_of(open_.select("id"), texts, docs).join(texts.select("id", "n_shingles", "registers"), "id")
    more = materialize(_across(open_.join(own, "id")), "more-links")
    links = links.union(more)
    roots = components(links) if not more.isEmpty() else roots

    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    named = texts.select("id", "sha", "ord", "text_key").join(roots.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    named = materialize(named.select("sha", "ord", "text_key", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    counted = signed.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).join(named.select("sha", "ord", "text_key", "root"), "sha")
    classes = counted.groupBy("root").agg(F.min(F.struct("ord", "text_key")).alias("head"), F.sum("n").alias("class_size"))
    by_text = materialize(named.drop("ord", "text_key").join(classes, "root").drop("root"), "classes")
    is_head = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.col("text_key")) == F.col("head")
    return signed.select("doc_id", "text_key", "sha").join(by_text, "sha").select(
        "doc_id", F.when(F.col("head.ord") != LAST, F.col("head.ord")).alias("class_id"), "class_size", "n_links", "text_key", is_head.alias("is_head")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of ``docs``: the one with the smallest doc_id.

    Of rows that repeat that id and text one stays; a class without any id keeps the row
    with the smallest text key.
    """
    heads = near_duplicates(docs).filter("is_head").select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "text_key").distinct()
    kept = whole_rows(docs).join(materialize(heads, "heads"), ["ord", "text_key"], "left_semi")
    return unpacked(kept.dropDuplicates(["ord", "text_key"]), docs.columns)
