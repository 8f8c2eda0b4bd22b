"""Quality classifier: naive Bayes support vectors over character n-grams.

Indicators of byte 1-, 2- and 3-grams, and of runs of one repeated word, are scaled by the log ratio of their class counts,
which are taken over all labelled training texts, and a linear hinge-loss model is fitted
to them by dual coordinate descent on a bounded sample.  Margins become probabilities by a
logistic fit on sampled rows that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents
from tidemark.workspace import materialize, ship_package

DIM = 1 << 15
FIT_ROWS = 6_000  # labelled rows that the hinge-loss model is fitted to, on average
THRESHOLD = 0.7
RUNS = 9  # runs of a repeated word are told apart up to this length


def indicators(text: bytes) -> np.ndarray:
    """Hashed numbers of the n-grams that occur in a text, ascending."""
    a = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(DIM, dtype=bool)
    seen[a] = True
    if len(a) > 1:
        two = (a[:-1] << np.uint32(8)) | a[1:]
        seen[((two + np.uint32(1 << 24)) * np.uint32(2654435761)) >> np.uint32(17)] = True
        if len(a) > 2:
            three = (two[:-1] << np.uint32(8)) | a[2:]
            seen[(three * np.uint32(2654435761)) >> np.uint32(17)] = True
    words = text.split()
    if len(words) > 1:
        other = np.flatnonzero(np.array([x != y for x, y in zip(words, words[1:])] + [True]))
        longest = int(np.diff(other, prepend=-1).max())  # words in the longest run of one word
        seen[DIM - min(longest, RUNS) : DIM - 1] = True
    return np.flatnonzero(seen).astype(np.uint16)


def pack(found: np.ndarray) -> bytes:
    """Ascending numbers as gaps, one byte each; 255 stands for a gap of 255 that goes on."""
    gaps = np.diff(found.astype(np.int64), prepend=-1) - 1
    whole = gaps // 255
    out = np.full(len(gaps) + int(whole.sum()), 255, dtype=np.uint8)
    out[np.cumsum(whole + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, dtype=np.uint8)
    last = gaps < 255
    return (np.cumsum(gaps.astype(np.int64) + last)[last] - 1).astype(np.uint16)


@dataclass
class Model:
    """``ratio`` scales indicators, ``weights`` apply to rows scaled to unit length."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        row = self.ratio[found]
        norm = float(np.sqrt(row @ row))
        return (float(row @ self.weights[found]) / norm if norm else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -60, 60))))


def descend(rows: list[np.ndarray], sign: np.ndarray, ratio: np.ndarray, cost: float = 1.0, passes: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the bias is one more constant feature."""
    weights, bias, dual = np.zeros(DIM), 0.0, np.zeros(len(rows))
    scaled = []
    for found in rows:
        x = ratio[found]
        norm = np.sqrt(x @ x)
        scaled.append(x / norm if norm else x)
    size = np.array([x @ x + 1.0 for x in scaled])
    draw = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            slack = sign[i] * (weights[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(dual[i] - slack / size[i], 0.0), cost)
            change = (new - dual[i]) * sign[i]
            if change:
                weights[rows[i]] += change * scaled[i]
                bias += change
                dual[i] = new
                moved += abs(change)
        if moved < 1e-3 * len(rows):
            break
    return weights, bias


def calibrate(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities (Newton steps, smoothed targets)."""
    good = int(label.sum())
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -60, 60)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(shift)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a row without an id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def _featured(docs: DataFrame) -> DataFrame:
    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pack(indicators(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "found"])

    return docs.mapInArrow(feature, "doc_id long, found binary")


def _class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of class 0 and 1 have each indicator; the last entry counts the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, DIM + 1), dtype=np.int64)
        for batch in batches:
            for raw, label in zip(batch.column("found").to_pylist(), batch.column("label").to_pylist()):
                sums[label, unpack(raw)] += 1
                sums[label, DIM] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_pydict({"i": pa.array(at), "c0": pa.array(sums[0, at]), "c1": pa.array(sums[1, at])})

    counted = labelled.select("found", "label").mapInArrow(count, "i long, c0 long, c1 long").groupBy("i").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    out = np.zeros((2, DIM + 1), dtype=np.int64)
    for row in counted.collect():  # at most DIM + 1 rows
        out[:, row["i"]] = row["c0"], row["c1"]
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labels of rows that are not held out.

    Null labels and ids are left out; labels that repeat for an id count once, by their
    mean, and not at all if that is undecided.  With one class or no labels the model
    gives every text the same score, the smoothed share of class 1.
    """
    ship_package(docs.sparkSession)
    voted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("v")).dropna().groupBy("doc_id").agg(F.avg("v").alias("v"))
    voted = voted.filter("v <> 0.5").select("doc_id", (F.col("v") > 0.5).cast("int").alias("label"))
    texts = documents(docs).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = materialize(_featured(texts).join(voted, "doc_id"), "labelled")
    zero, one = _class_counts(labelled)
    rows = int(zero[DIM] + one[DIM])
    if not zero[DIM] or not one[DIM]:
        share = (one[DIM] + 1) / (rows + 2)
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, 0.0, float(np.log(share / (1 - share))))
    p, q = one[:DIM] + 1.0, zero[:DIM] + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    spread = 1 << 20
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(spread)) < int(spread * min(1.0, fit_rows / rows)))
    sample = sorted((r["doc_id"], r["found"], r["label"]) for r in chosen.select("doc_id", "found", "label").collect())  # about fit_rows rows
    if len({s[2] for s in sample}) < 2:
        sample = sorted((r["doc_id"], r["found"], r["label"]) for k in (0, 1) for r in labelled.filter(F.col("label") == k).limit(fit_rows // 2).collect())
    found, label = [unpack(s[1]) for s in sample], np.array([s[2] for s in sample])
    order = np.random.default_rng(11).permutation(len(sample))
    test = np.zeros(len(sample), dtype=bool)
    for k in (0, 1):  # a fifth of each class calibrates
        test[order[label[order] == k][::5]] = True
    fit = np.flatnonzero(~test) if len({*label[~test]}) == 2 else np.arange(len(sample))
    weights, bias = descend([found[i] for i in fit], 2.0 * label[fit] - 1, ratio)
    model = Model(ratio, weights, bias, 1.0, 0.0)
    margins = np.array([model.margin(found[i]) for i in np.flatnonzero(test)])
    model.slope, model.shift = calibrate(margins, label[test])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's score from its whole text: doc_id, score.  Null texts count as empty."""
    ship_package(docs.sparkSession)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = [model.score(indicators(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rates, pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(rate, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is at least 0.7) of every row.

    Repeated rows get equal scores, an empty table gives no rows, other columns are
    ignored.  Empty texts get the score of a text without n-grams.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = train(docs, labels)
    ship_package(docs.sparkSession)

    def good(texts):
        import pandas as pd

        return pd.Series([model.score(indicators((t or "").encode("utf-8", "surrogatepass"))) >= THRESHOLD for t in texts])

    return docs.filter(F.pandas_udf(good, "boolean")(docs["text"]))
