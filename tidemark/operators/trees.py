"""Histogram trees: boosting for any number of labels and random forests, many models at once.

Features are binned once to bytes, by edges from one quantile sketch per model and feature.
Trees are grown level by level from histograms: per node, feature and bin the sums of a few
channels (gradient, hessian and rows, or weighted rows per label).  Only the smaller child of
a split is counted, its sibling is the difference.  Channels are whole numbers (fractions of
2^-20), so sums do not depend on the order or the partitioning of the rows.

Rows of one label that agree in all bins are one entry: it stands for their number, or in a
forest for the sums of their draws, which are made per row before.  That changes no histogram,
and with few features the entries are bounded by the bins, however many the rows.

A model of up to ``LOCAL_CELLS`` binned cells (entries x features) is grown inside one task, all
such models of a call in parallel; a retraining window is always of that kind.  A larger model
keeps its rows in blocks over the cluster: one job per level sums the histograms of all open
nodes of all large models, and only these sums, whose size the settings bound, reach the
driver.  Both ways give the same trees.
"""

from __future__ import annotations

import io
import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import jvm
from tidemark.functions.expressions import col
from tidemark.workspace import materialize, ship_package

LOCAL_CELLS = 1 << 26
BLOCK_ROWS = 1 << 16
FOREST_SHARES = 16  # tasks that the trees of one forest are dealt to
WRITE_ROUNDS = 10  # rounds between two written tables of margins
MODEL_TASKS = 8_192  # most tasks that a table of models is dealt to
JVM_CELLS = 1 << 22  # histogram cells of a tree's leaves up to which the JVM grows it, 16 bytes each
TABLE_FEATURES = 16  # most features of boosted trees that are scored by tables
TABLE_ROWS = 4_096  # rows scored by tables at a time
MAX_LABELS = 1_000
SCALE = float(1 << 20)
CHUNK_CELLS = 1 << 22  # histogram cells searched at a time
KEEP_CELLS = 1 << 24  # histogram cells of a level that are kept or counted at a time


@dataclass(frozen=True)
class Settings:
    """How the trees of a model are grown."""

    algorithm: str = "gbt"
    trees: int = 200
    depth: int = 8
    rate: float = 0.1
    leaves: int = 63  # 0: no limit
    min_rows: int = 20
    min_split: int = 0
    bins: int = 255
    seed: int = 42
    balanced: bool = True

    @property
    def forest(self) -> bool:
        return self.algorithm == "rf"


# --- growing one tree ---------------------------------------------------------------------


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain constants)."""
    h = values.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def histograms(bins: np.ndarray, slot: np.ndarray, channels: np.ndarray, slots: int, n_bins: int) -> np.ndarray:
    """Sums per [channel, slot, feature, bin] over the rows of ``bins`` (feature-major)."""
    out = np.empty((len(channels), slots, len(bins), n_bins))
    base = slot.astype(np.int64) * n_bins
    for j, column in enumerate(bins):
        at = base + column
        for c, values in enumerate(channels):
            out[c, :, j, :] = np.bincount(at, weights=values, minlength=slots * n_bins).reshape(slots, n_bins)
    return out


class Grower:
    """One tree: names the nodes it needs counted and splits them by their histograms.

    ``pending`` holds lots of nodes; ``offer`` takes the histograms of the first lot.  A level
    is decided when its last lot is in.
    """

    def __init__(self, settings: Settings, features: int, n_channels: int, salt: int = 0):
        self.s, self.features, self.salt = settings, features, salt
        self.cells = features * settings.bins * n_channels  # of one node
        self.feature, self.bin, self.left, self.gain = [0], [settings.bins], [0], [0.0]
        self.totals: list[np.ndarray] = [np.zeros(n_channels)]
        self.level, self.n_leaves = 0, 1
        self.open = {0}  # nodes that may split
        self.pairs: dict[int, tuple[int, np.ndarray]] = {}  # counted node: its sibling and their parent's histogram
        self.found: list[tuple] = []
        self.kept: dict[int, np.ndarray] = {}
        self.pending: list[list[int]] = [[0]]

    def offer(self, hist: np.ndarray) -> None:
        """``hist`` is [channel, node, feature, bin] for the nodes of the first pending lot."""
        nodes = self.pending.pop(0)
        if self.level == 0:
            self.totals[0] = hist[:, 0, 0, :].sum(axis=1)
        parts = {}
        for i, node in enumerate(nodes):
            mine = hist[:, i]
            parts[node] = mine
            if node in self.pairs:
                sibling, parent = self.pairs[node]
                parts[sibling] = parent - mine
        parts = {n: h for n, h in sorted(parts.items()) if n in self.open}
        order, step = list(parts), max(1, CHUNK_CELLS // self.cells)
        for a in range(0, len(order), step):
            lot = order[a : a + step]
            self.found += self._best(lot, np.stack([parts[n] for n in lot], axis=1))
        if self.level == 0 or self.pairs:
            self.kept = parts
        if not self.pending:
            self._close_level()

    def _close_level(self) -> None:
        found = [f for f in self.found if f[0] > 0]
        if self.s.leaves:
            found = sorted(found, key=lambda f: (-f[0], f[1]))[: max(0, self.s.leaves - self.n_leaves)]
            found.sort(key=lambda f: f[1])
        self.n_leaves += len(found)
        self.level += 1
        last = self.level >= self.s.depth or (self.s.leaves and self.n_leaves >= self.s.leaves)
        kept, self.kept, self.pairs, self.found, self.open = self.kept, {}, {}, [], set()
        for gain, node, j, b, left in found:
            child = len(self.feature)
            self.feature[node], self.bin[node], self.left[node], self.gain[node] = j, b, child, gain
            sides = (left, self.totals[node] - left)
            for side in sides:
                self.feature.append(0)
                self.bin.append(self.s.bins)
                self.left.append(len(self.left))
                self.gain.append(0.0)
                self.totals.append(side)
            grows = {child + k for k, side in enumerate(sides) if self._splittable(side)}
            if grows and not last:
                self.open |= grows
                if node in kept:
                    small = child if self._size(sides[0]) <= self._size(sides[1]) else child + 1
                    self.pairs[small] = (2 * child + 1 - small, kept[node])
        if len(self.pairs) * self.cells > KEEP_CELLS:
            self.pairs = {}
        # without the parents' histograms every open node is counted, a lot at a time
        nodes, step = sorted(self.pairs or self.open), max(1, KEEP_CELLS // self.cells)
        self.pending = [nodes[a : a + step] for a in range(0, len(nodes), step)]

    def _size(self, total: np.ndarray) -> float:
        return total[-1]

    def _splittable(self, total: np.ndarray) -> bool:
        pure = self.s.forest and (total[:-1] > 0).sum() < 2
        return not pure and total[-1] >= max(2 * self.s.min_rows, self.s.min_split)

    def _best(self, nodes: list[int], hist: np.ndarray) -> list[tuple]:
        """Best split of each node: (gain, feature, bin, channel sums of its left side)."""
        left = np.cumsum(hist, axis=3)[..., :-1]
        total = np.stack([self.totals[n] for n in nodes], axis=1)[:, :, None, None]
        right = total - left
        allowed = (left[-1] >= self.s.min_rows) & (right[-1] >= self.s.min_rows)
        gain = self._score(left) + self._score(right) - self._score(total)
        if self.s.forest:
            allowed &= self._subset(nodes)[:, :, None]
        else:
            allowed &= (left[1] > 1e-3 * SCALE) & (right[1] > 1e-3 * SCALE)
        gain = np.where(allowed, gain, -np.inf).reshape(len(nodes), -1)
        best = gain.argmax(axis=1)
        width = left.shape[3]
        out = []
        for i, at in enumerate(best):
            j, b = divmod(int(at), width)
            worth = gain[i, at]
            out.append((worth if worth > 1e-9 * SCALE else 0.0, nodes[i], j, b, left[:, i, j, b].copy()))
        return out

    def _score(self, sums: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.s.forest:
                weight = sums[:-1].sum(axis=0)
                return np.where(weight > 0, (sums[:-1] ** 2).sum(axis=0) / weight, 0.0)
            return np.where(sums[1] > 0, sums[0] ** 2 / sums[1], 0.0)

    def _subset(self, nodes: list[int]) -> np.ndarray:
        """The square root of the features, drawn anew for every node."""
        keep = max(1, round(math.sqrt(self.features)))
        base = (np.array(nodes, dtype=np.uint64)[:, None] << np.uint64(20)) + np.arange(self.features, dtype=np.uint64)
        draw = mix(base + np.uint64((self.s.seed * 1_000_003 + self.salt) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
        return draw <= np.sort(draw, axis=1)[:, keep - 1 : keep]

    def shape(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), dtype=np.int32) for k in ("feature", "bin", "left")}

    def tree(self) -> dict[str, np.ndarray]:
        """Arrays of the tree; a leaf is its own left child and never goes right."""
        return self.shape() | {"gain": np.array(self.gain), "totals": np.stack(self.totals)}


def route(tree: dict[str, np.ndarray], bins: np.ndarray, node: np.ndarray | None = None, levels: int = 1) -> np.ndarray:
    """Node of every row after some more levels; ``bins`` is feature-major."""
    n = bins.shape[1]
    node = np.zeros(n, dtype=np.int64) if node is None else node
    flat, rows, start = bins.ravel(), np.arange(n), tree["feature"].astype(np.int64) * n
    for _ in range(levels):
        node = tree["left"].take(node) + (flat.take(start.take(node) + rows) > tree["bin"].take(node))
    return node


# --- a model: rounds of trees -------------------------------------------------------------


class Rounds:
    """The order in which the trees of a model are grown, whoever counts the histograms.

    A round has one tree per label for boosting with more than two labels and one otherwise.
    """

    def __init__(self, settings: Settings, features: int, class_weight: np.ndarray, class_rows: np.ndarray):
        self.s, self.features, self.class_weight = settings, features, class_weight
        self.k = len(class_weight)
        self.per_round = 1 if settings.forest or self.k == 2 else self.k
        share = class_weight * class_rows
        share = share / share.sum()
        self.start = np.log(share) if self.per_round > 1 else np.array([math.log(share[1] / share[0])]) if self.k == 2 else np.zeros(1)
        self.trees: list[dict[str, np.ndarray]] = []
        self.values: list[np.ndarray] = []
        self.round = self.first = 0
        self._next()

    def _next(self) -> None:
        n = self.k + 1 if self.s.forest else 3
        self.growers = [Grower(self.s, self.features, n, salt=self.round) for _ in range(self.per_round)] if self.round < self.s.trees and self.k > 1 else []

    def go_to(self, number: int) -> None:
        """Begin with a later round, which a forest may."""
        self.round = self.first = number
        self._next()

    @property
    def done(self) -> bool:
        return not self.growers

    def draw(self, y: np.ndarray, row_hash: np.ndarray, number: int) -> np.ndarray:
        """A Poisson number of copies of every row for one tree of a forest: [weight, copies]."""
        draw = mix(row_hash ^ mix(np.array([self.s.seed * 7_919 + number + 1], dtype=np.uint64))[0]) / 2.0**64
        times = np.searchsorted(_POISSON, draw, side="right").astype(float)
        return np.stack([np.rint(times * self.class_weight[y] * SCALE), times])

    def channels(self, y: np.ndarray, margin: np.ndarray, row_hash: np.ndarray | None, stands_for: np.ndarray | None = None) -> list[np.ndarray]:
        """Channels of the round's trees for rows with these labels; ``margin`` is [tree, row].

        For entries that are several rows, ``stands_for`` is their number, or in a forest the
        sums of ``draw`` as [tree, 2, entry] from the first tree grown here on.
        """
        weight = self.class_weight[y]
        if self.s.forest:
            weighted, times = self.draw(y, row_hash, self.round) if stands_for is None else stands_for[self.round - self.first]
            per_label = np.zeros((self.k, len(y)))
            per_label[y, np.arange(len(y))] = weighted
            return [np.concatenate([per_label, times[None]])]
        one = np.ones(len(y)) if stands_for is None else stands_for
        if self.per_round == 1:
            p = 1.0 / (1.0 + np.exp(-margin[0]))
            grad, hess = (p - y)[None], (p * (1 - p))[None]
        else:
            p = softmax(margin)
            grad, hess = p - (y == np.arange(self.k)[:, None]), self.k / (self.k - 1) * p * (1 - p)
        return [np.stack([np.rint(g * weight * SCALE) * one, np.rint(h * weight * SCALE) * one, one]) for g, h in zip(grad, hess)]

    def advance(self) -> list[tuple[dict[str, np.ndarray], np.ndarray]]:
        """Close the round: its trees and their leaf values."""
        closed = []
        for g in self.growers:
            tree = g.tree()
            totals = tree.pop("totals")
            if self.s.forest:
                weight = totals[:, :-1]
                value = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-12)
            else:
                value = -self.s.rate * totals[:, 0] / np.maximum(totals[:, 1], 1e-3 * SCALE)
            closed.append((tree, value))
            self.trees.append(tree)
            self.values.append(value)
        self.round += 1
        self._next()
        return closed


def _poisson_bounds() -> np.ndarray:
    term, total, out = math.exp(-1.0), 0.0, []
    for n in range(20):
        total += term
        out.append(total)
        term /= n + 1
    return np.array(out)


_POISSON = _poisson_bounds()


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=0))
    return e / e.sum(axis=0)


def _place(bit: np.ndarray) -> np.ndarray:
    """A place from 0 to 63 for each single bit, its own for every bit (a de Bruijn sequence)."""
    return ((bit * np.uint64(0x03F79D71B4CB0A89)) >> np.uint64(58)).view(np.int64)


_MARK = b"tidemark"
_NODE = [("feature", "<i4"), ("bin", "<i4"), ("left", "<i4"), ("gain", "<f8")]


@dataclass
class Trees:
    """A fitted model: labels, features, bin edges and all trees."""

    labels: list[str]
    features: list[str]
    edges: list[np.ndarray]
    trees: list[dict[str, np.ndarray]]
    values: list[np.ndarray]
    start: np.ndarray
    settings: Settings
    metadata: dict = field(default_factory=dict)
    _tables: tuple | None = field(default=None, init=False, repr=False, compare=False)

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """[row, label] of rows given as one array per feature; missing and infinite values count as 0."""
        bins = binned(columns, self.edges)
        if len(self.labels) < 2:
            return np.ones((bins.shape[1], len(self.labels)))
        if len(bins) <= 8:  # rows with the same bins meet the trees once
            key = sum(column.astype(np.uint64) << np.uint64(8 * j) for j, column in enumerate(bins))
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            return self._of_bins(np.ascontiguousarray(bins[:, first]))[back]
        return self._of_bins(bins)

    def _of_bins(self, bins: np.ndarray) -> np.ndarray:
        n, k = bins.shape[1], len(self.labels)
        if self.settings.forest:
            out = np.zeros((n, k))
            for tree, value in zip(self.trees, self.values):
                out += value[route(tree, bins, levels=self.settings.depth)]
            return out / out.sum(axis=1, keepdims=True)
        per_round = len(self.start)
        margin = np.repeat(self.start[:, None], n, axis=1)
        if len(bins) <= TABLE_FEATURES and 0 < max((len(t["left"]) for t in self.trees), default=0) < 2 * 64:
            self._add_by_table(margin, bins)
        else:
            for i, (tree, value) in enumerate(zip(self.trees, self.values)):
                margin[i % per_round] += value[route(tree, bins, levels=self.settings.depth)]
        if per_round > 1:
            return softmax(margin).T
        p = 1.0 / (1.0 + np.exp(-margin[0]))
        return np.stack([1 - p, p], axis=1)

    def _add_by_table(self, margin: np.ndarray, bins: np.ndarray) -> None:
        """Adds all trees to the margins: per tree one look-up for each feature instead of a walk down the levels."""
        if self._tables is None:
            self._tables = self._leaf_tables()
        (reach, ends, values), per_round = self._tables, len(self.start)
        spans = list(zip([0, *ends], ends))
        for a in range(0, bins.shape[1], TABLE_ROWS):
            columns = [c.astype(np.intp) for c in bins[:, a : a + TABLE_ROWS]]
            for i, (of, value) in enumerate(zip(reach, values)):
                left = of[slice(*spans[0])].take(columns[0])
                for (start, end), column in zip(spans[1:], columns[1:]):
                    left &= of[start:end].take(column)
                left &= np.negative(left)  # the lowest bit
                margin[i % per_round, a : a + TABLE_ROWS] += value.take(_place(left))

    def _leaf_tables(self) -> tuple[np.ndarray, list[int], np.ndarray]:
        """Per tree, feature and bin the leaves, as bits from left to right, that a row may still end in; per tree the leaf values.

        A split that sends a row to the right rules out the leaves on its left, so the lowest bit left by all features is the row's leaf.
        """
        sizes = [len(t["left"]) for t in self.trees]
        tree = np.repeat(np.arange(len(sizes)), sizes)
        feature, cut, left = (np.concatenate([t[name] for t in self.trees]).astype(np.int64) for name in ("feature", "bin", "left"))
        left += np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        inner = np.flatnonzero(left != np.arange(len(left)))
        low, high = left[inner], left[inner] + 1
        leaves, first = np.ones(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
        for _ in range(self.settings.depth):
            leaves[inner] = leaves[low] + leaves[high]
        for _ in range(self.settings.depth):
            first[low], first[high] = first[inner], first[inner] + leaves[low]
        one = np.uint64(1)
        ruled_out = ((one << leaves[low].astype(np.uint64)) - one) << first[low].astype(np.uint64)
        widths = np.array([len(e) + 1 for e in self.edges])
        ends = np.cumsum(widths)
        reach = np.full((len(sizes), int(ends[-1])), ~np.uint64(0))
        met = cut[inner] + 1 < widths[feature[inner]]  # else no row goes right
        at = (ends - widths)[feature[inner]] + cut[inner] + 1
        np.bitwise_and.at(reach, (tree[inner][met], at[met]), ~ruled_out[met])
        for start, end in zip((ends - widths).tolist(), ends.tolist()):
            np.bitwise_and.accumulate(reach[:, start:end], axis=1, out=reach[:, start:end])
        values, leaf = np.zeros((len(sizes), 64)), np.flatnonzero(left == np.arange(len(left)))
        values[tree[leaf], _place(one << first[leaf].astype(np.uint64))] = np.concatenate(self.values)[leaf]
        return reach, ends.tolist(), values

    def importances(self, kind: str = "gain") -> np.ndarray:
        """Share of each feature in the gain (or the number) of all splits."""
        out = np.zeros(len(self.features))
        for tree in self.trees:
            split = tree["gain"] > 0
            np.add.at(out, tree["feature"][split], tree["gain"][split] if kind == "gain" else 1.0)
        return out / out.sum() if out.sum() else out

    def to_bytes(self) -> bytes:
        """A head (everything but the trees) and a body: numbers of trees and nodes, nodes per tree, then each array over all nodes."""
        arrays = [np.concatenate([np.ravel(t[name]) for t in self.trees], dtype=kind) if self.trees else np.empty(0) for name, kind in _NODE]
        values = np.concatenate([np.ravel(v) for v in self.values]) if self.values else np.empty(0)
        sizes = np.array([len(t["left"]) for t in self.trees], dtype="<i4")
        body = np.array([len(sizes), sizes.sum()], dtype="<i4").tobytes() + sizes.tobytes()
        return self.head() + body + b"".join(a.tobytes() for a in arrays) + values.astype("<f8").tobytes()

    def head(self) -> bytes:
        facts = {
            "labels": self.labels, "features": self.features, "settings": self.settings.__dict__, "metadata": self.metadata,
            "edges": [len(e) for e in self.edges], "start": len(self.start),
        }
        text = json.dumps(facts).encode()
        numbers = np.concatenate([*self.edges, self.start]).astype("<f8").tobytes()
        return _MARK + np.array([len(text)], dtype="<i4").tobytes() + text + numbers

    @staticmethod
    def from_bytes(raw: bytes) -> Trees:
        if not raw.startswith(_MARK):
            return Trees._from_archive(raw)
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            at, start = at + n * np.dtype(kind).itemsize, at
            return np.frombuffer(raw, kind, n, start)

        take("u1", len(_MARK))
        head = json.loads(take("u1", int(take("<i4", 1)[0])).tobytes())
        edges, start = [take("<f8", n) for n in head["edges"]], take("<f8", head["start"])
        n, nodes = take("<i4", 2).tolist()
        ends = np.cumsum(take("<i4", n)).tolist()
        spans = list(zip([0, *ends], ends))
        arrays = {name: take(kind, nodes) for name, kind in _NODE}
        values = np.frombuffer(raw, "<f8", -1, at)
        if head["settings"]["algorithm"] == "rf":  # one value per label
            values = values.reshape(nodes, len(head["labels"]))
        trees = [{name: x[a:b] for name, x in arrays.items()} for a, b in spans]
        return Trees(head["labels"], head["features"], edges, trees, [values[a:b] for a, b in spans], start, Settings(**head["settings"]), head["metadata"])

    @staticmethod
    def _from_archive(raw: bytes) -> Trees:
        """As models were saved before: an archive of arrays, four per tree."""
        with np.load(io.BytesIO(raw)) as a:
            head = json.loads(a["head"].tobytes())
            trees = [{name: a[f"{name}{i}"] for name in ("feature", "bin", "left", "gain")} for i in range(head["trees"])]
            values = [a[f"value{i}"] for i in range(head["trees"])]
            edges = [a[f"edges{i}"] for i in range(len(head["features"]))]
            return Trees(head["labels"], head["features"], edges, trees, values, a["start"], Settings(**head["settings"]), head["metadata"])


def binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, feature-major; a value belongs to the first edge that is not below it."""
    out = np.empty((len(columns), len(columns[0]) if columns else 0), dtype=np.uint8)
    for j, (values, cuts) in enumerate(zip(columns, edges)):
        values = np.asarray(values, dtype=float)
        out[j] = np.searchsorted(cuts, np.where(np.isfinite(values), values, 0.0), side="left")
    return out


# --- fitting many models ------------------------------------------------------------------


def _local(rounds: Rounds, bins: np.ndarray, y: np.ndarray, row_hash: np.ndarray | None, stands_for: np.ndarray | None = None) -> None:
    """Grow a model whose rows, or entries, are all here."""
    s = rounds.s
    margin = np.repeat(rounds.start[:, None], bins.shape[1], axis=1)
    while not rounds.done:
        nodes_of = []
        for grower, channels in zip(rounds.growers, rounds.channels(y, margin, row_hash, stands_for)):
            node = np.zeros(bins.shape[1], dtype=np.int64)
            while grower.pending:
                level = grower.level
                grower.offer(_count(bins, node, channels, grower.pending[0], s.bins))
                if grower.level > level:
                    node = route(grower.shape(), bins, node)
            nodes_of.append(node)
        for i, ((_, value), node) in enumerate(zip(rounds.advance(), nodes_of)):
            if not s.forest:
                margin[i] += value[node]


def _count(bins: np.ndarray, node: np.ndarray, channels: np.ndarray, wanted: list[int], n_bins: int) -> np.ndarray:
    slot_of = np.full(max(int(node.max(initial=0)), max(wanted)) + 1, -1)
    slot_of[wanted] = np.arange(len(wanted))
    slot = slot_of.take(node)
    here = np.flatnonzero((slot >= 0) & (channels[-1] > 0))
    if len(here) < len(slot):
        bins, slot, channels = bins.take(here, axis=1), slot.take(here), channels.take(here, axis=1)
    return histograms(bins, slot, channels, len(wanted), n_bins)


@dataclass
class _Plan:
    """What is known of a model before its trees are grown."""

    labels: list[str]
    rows: np.ndarray
    weight: np.ndarray
    edges: list[np.ndarray]

    def rounds(self, settings: Settings, features: int) -> Rounds:
        return Rounds(settings, features, self.weight, self.rows)


def fit_many(df: DataFrame, model: str, features: list[str], label: str, settings: Settings | dict[str, Settings]) -> dict[str, Trees]:
    """Fit one model per value of the column ``model``; ``settings`` may differ per model.

    Rows without a label are left out; missing, NaN and infinite features count as 0.  A model
    with one label only gives that label.  Returned are the models by name, with rows,
    features, labels, settings and seconds in ``metadata``.
    """
    spark = df.sparkSession
    ship_package(spark)
    names = [f"_f{j}" for j in range(len(features))]
    rows = df.filter(col(label).isNotNull()).select(
        col(model).cast("string").alias("_model"), col(label).cast("string").alias("_label"), *[_finite(f).alias(n) for f, n in zip(features, names)]
    )
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        plans = _plans(rows, names, settings)
        cut, most = _cut(rows, plans, names), LOCAL_CELLS // max(1, len(features))
        small = [m for m, p in plans.items() if p.rows.sum() <= most]
        if unsure := [m for m in plans if m not in small]:
            entries = cut.filter(F.col("_model").isin(unsure)).select(*_ENTRY).distinct().groupBy("_model").count()
            small += [r["_model"] for r in entries.collect() if r["count"] <= most]
        began = time.perf_counter()
        fitted = _fit_small(cut.filter(F.col("_model").isin(small)), {m: plans[m] for m in small}, features, settings) if small else {}
        large = {m: plans[m] for m in plans if m not in fitted}
        if large:
            fitted |= _fit_large(rows.filter(F.col("_model").isin(list(large))), large, features, names, settings)
        seconds = time.perf_counter() - began
    finally:
        rows.unpersist()
    for m, trees in fitted.items():
        trees.metadata |= _facts(trees, plans[m])
        trees.metadata.setdefault("training_time_s", round(seconds, 3))
    return fitted


def _finite(feature: str) -> Column:
    c = col(feature).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(0.0)


def _facts(trees: Trees, plan: _Plan) -> dict:
    s = trees.settings
    return {
        "algorithm": s.algorithm, "params": {k: v for k, v in s.__dict__.items() if k != "seed"}, "random_seed": s.seed,
        "training_samples": int(plan.rows.sum()), "n_features": len(trees.features), "classes": trees.labels,
    }


def fit_table(df: DataFrame, key: list[str], features: list[str], label: str, draws: str, settings: dict[int, Settings], models: int) -> DataFrame:
    """Fit boosted models per value of the columns ``key``, one per seed: the key, ``seed``, ``model`` (bytes) and ``seconds`` as a table.

    The same models as those of ``fit_many``, for thousands of models of few rows each: no model
    passes the driver, those of a key are one task's work.  The array ``draws`` has the seeds whose
    model is fitted on a row, out of those that ``settings`` names; ``models`` is about how many
    keys there are.  Models for two labels are grown in the JVM (``Boost.java``) if it compiles there.
    """
    spark = df.sparkSession
    ship_package(spark)
    names, seeds = [f"_f{j}" for j in range(len(features))], sorted(settings)
    rows = df.filter(col(label).isNotNull()).select(*key, col(label).cast("string").alias("_label"), col(draws).alias("_draws"), *[_finite(f).alias(n) for f, n in zip(features, names)])
    # sketched before the rows are dealt, as fit_many does: the sketch may move by a rank with the rows it is merged from
    drawn = rows.select(*key, F.explode("_draws").alias("_seed"), *names)
    cuts = drawn.groupBy(*key, "_seed").agg(*_cuts(names, max(s.bins for s in settings.values())))
    cuts = cuts.withColumnsRenamed({k: f"_of_{k}" for k in key})  # told apart from those of the rows
    # a row goes to its task once, with a column per seed
    rows = rows.select(*key, "_label", *names, *[F.array_contains("_draws", F.lit(s)).alias(f"_d{i}") for i, s in enumerate(seeds)])
    rows = rows.repartition(max(1, min(4 * models, MODEL_TASKS)), *key)
    grow = jvm.function(spark, __package__, "Boost", StructType.fromDDL("trees binary, seconds double"))
    native = grow is not None

    def fit(value: tuple, part: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        named, out = dict(zip(key, value)), []
        codes, known = pd.factorize(part["_label"], sort=True)
        columns = [part[n].to_numpy(dtype=float) for n in names]
        for at, seed in enumerate(cut["_seed"].tolist()):
            began, s = time.perf_counter(), settings[seed]
            mine = np.flatnonzero(part[f"_d{seeds.index(seed)}"].to_numpy(dtype=bool))
            per_label = np.bincount(codes[mine], minlength=len(known))
            here = np.flatnonzero(per_label)  # labels that this draw has
            y = np.searchsorted(here, codes[mine])
            plan = _plan(dict(zip(known[here], per_label[here].tolist())), [np.unique(np.array(cut[n].iloc[at], dtype=float)) for n in names], s)
            bins = binned([c[mine] for c in columns], plan.edges)
            y, bins, n = _entries(y, bins)
            rounds = plan.rounds(s, len(features))
            trees, packed = _trees(rounds, plan, features, s), _packed(rounds, bins, y, n, plan) if native else None
            if packed is None:
                _local(rounds, bins, y, None, n.astype(float))
            seconds = round(time.perf_counter() - began, 3)
            trees.metadata |= _facts(trees, plan) | ({"training_time_s": seconds} if packed is None else {})
            out.append((*named.values(), seed, trees.to_bytes() if packed is None else trees.head(), packed, seconds))
        return pd.DataFrame(out, columns=[*named, "seed", "model", "packed", "seconds"])

    types = dict(df.select(*key).dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", seed long, model binary, packed binary, seconds double"
    fitted = rows.groupBy(*key).cogroup(cuts.groupBy(*[f"_of_{k}" for k in key])).applyInPandas(fit, schema)
    if not native:
        return fitted.drop("packed")
    fitted = fitted.withColumn("grown", grow(F.col("packed")))
    model = F.concat("model", F.coalesce("grown.trees", F.lit(b"")))
    return fitted.select(*key, "seed", model.alias("model"), (F.col("seconds") + F.coalesce("grown.seconds", F.lit(0.0))).alias("seconds"))


def _entries(y: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one label that agree in all bins as one entry: labels, bins and number of rows."""
    if len(bins) <= 6:  # all in one number
        key = y.astype(np.uint64) << np.uint64(8 * len(bins))
        for j, column in enumerate(bins):
            key |= column.astype(np.uint64) << np.uint64(8 * j)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
    else:
        rows = np.concatenate([y[:, None].astype(np.int16), bins.T.astype(np.int16)], axis=1)
        _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return y[first].astype(np.int64), np.ascontiguousarray(bins[:, first]), n


def _packed(rounds: Rounds, bins: np.ndarray, y: np.ndarray, n: np.ndarray, plan: _Plan) -> bytes | None:
    """What ``Boost.java`` reads; nothing for models that it does not grow."""
    s, widths = rounds.s, [len(e) + 1 for e in plan.edges]
    leaves = min(s.leaves or 2**s.depth, 2**s.depth, len(y))
    if s.forest or rounds.k != 2 or n.sum() >= 1 << 22 or leaves * sum(widths) > JVM_CELLS:
        return None
    whole = [len(y), len(bins), s.trees, s.depth, s.leaves, leaves, s.min_rows, max(2 * s.min_rows, s.min_split), s.bins]
    parts = [np.array(whole, "<i4"), np.array([s.rate, *rounds.class_weight, rounds.start[0]], "<f8"), np.array(widths, "<i4")]
    return b"".join(a.tobytes() for a in [*parts, bins, y.astype(np.uint8), n.astype("<i4")])


def _of(settings: Settings | dict[str, Settings], model: str) -> Settings:
    return settings[model] if isinstance(settings, dict) else settings


def _plans(rows: DataFrame, names: list[str], settings) -> dict[str, _Plan]:
    """Labels, weights and bin edges of every model: one row per model and label, one per model."""
    counts = rows.groupBy("_model", "_label").agg(F.count(F.lit(1)).alias("n"))
    if not counts.groupBy("_model").count().filter(F.col("count") > MAX_LABELS).isEmpty():
        raise ValueError(f"a model has over {MAX_LABELS} labels")
    by_model: dict[str, dict[str, int]] = {}
    for r in counts.collect():
        by_model.setdefault(r["_model"], {})[r["_label"]] = r["n"]
    most = max((_of(settings, m).bins for m in by_model), default=2)
    sketches = rows.groupBy("_model").agg(*_cuts(names, most))
    edges = {r["_model"]: [np.unique(np.array(r[n], dtype=float)) for n in names] for r in sketches.collect()}
    return {m: _plan(c, edges[m], _of(settings, m)) for m, c in by_model.items()}


def _plan(rows_of: dict[str, int], edges: list[np.ndarray], s: Settings) -> _Plan:
    labels = sorted(rows_of)
    n = np.array([rows_of[x] for x in labels], dtype=float)
    return _Plan(labels, n, n.sum() / (len(n) * n) if s.balanced else np.ones(len(n)), [_thin(e, s.bins - 1) for e in edges])


def _cuts(names: list[str], bins: int) -> list:
    """Aggregates that give the bin edges of each feature."""
    points = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return [F.percentile_approx(n, points, 20_000).alias(n) for n in names]


def _thin(edges: np.ndarray, most: int) -> np.ndarray:
    return edges if len(edges) <= most else edges[np.unique(np.linspace(0, len(edges) - 1, most).round().astype(int))]


def _row_hash(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    out = mix(y.astype(np.uint64) + np.uint64(1))
    for values in columns:
        out = mix(out * np.uint64(31) + np.ascontiguousarray(values, dtype=float).view(np.uint64))
    return out


def _trees(rounds: Rounds, plan: _Plan, features: list[str], settings: Settings) -> Trees:
    return Trees(plan.labels, features, plan.edges, rounds.trees, rounds.values, rounds.start, settings)


_ENTRY = ["_model", "_y", "_bins"]


def _cut(rows: DataFrame, plans: dict[str, _Plan], names: list[str]) -> DataFrame:
    """Label number, bins (a byte per feature) and hash of every row."""
    lookup, width = {m: {x: i for i, x in enumerate(p.labels)} for m, p in plans.items()}, len(names)

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for m, part in chunk.groupby("_model", sort=False):
                y = part["_label"].map(lookup[m]).to_numpy(dtype=np.int32)
                columns = [part[n].to_numpy(dtype=float) for n in names]
                raw = binned(columns, plans[m].edges).T.tobytes()
                bins = [raw[i * width : (i + 1) * width] for i in range(len(y))]
                yield pd.DataFrame({"_model": m, "_y": y, "_bins": bins, "_hash": _row_hash(columns, y).view(np.int64)})

    return rows.mapInPandas(run, "_model string, _y int, _bins binary, _hash long")


def _draws(cut: DataFrame, plans: dict[str, _Plan], n_features: int, settings) -> DataFrame:
    """Per entry and share of a forest's trees the sums of what its rows draw; an entry may come in several rows."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for m, part in chunk.groupby("_model", sort=False):
                rounds = plans[m].rounds(_of(settings, m), n_features)
                y, row_hash = part["_y"].to_numpy(), part["_hash"].to_numpy().view(np.uint64)
                bins = part["_bins"].to_numpy()
                # sorted, so rows of one entry lie side by side
                starts = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (bins[1:] != bins[:-1])))
                for share in range(FOREST_SHARES):
                    first, last = _dealt(rounds.s, share)
                    if first == last:
                        continue
                    sums = np.stack([np.add.reduceat(rounds.draw(y, row_hash, t), starts, axis=1) for t in range(first, last)])
                    raw, size = sums.transpose(2, 0, 1).tobytes(), 16 * (last - first)
                    yield pd.DataFrame({
                        "_model": m, "_share": share, "_y": y[starts], "_bins": bins[starts],
                        "_for": [raw[i * size : (i + 1) * size] for i in range(len(starts))],
                    })

    side_by_side = cut.repartition(*_ENTRY).sortWithinPartitions(*_ENTRY)
    return side_by_side.mapInPandas(run, "_model string, _share int, _y int, _bins binary, _for binary")


def _dealt(settings: Settings, share: int) -> tuple[int, int]:
    """The trees (first, one behind the last) of one task."""
    if not settings.forest:
        return 0, settings.trees
    return settings.trees * share // FOREST_SHARES, settings.trees * (share + 1) // FOREST_SHARES


def _fit_small(cut: DataFrame, plans: dict[str, _Plan], features: list[str], settings) -> dict[str, Trees]:
    """One task per model; the trees of a forest do not depend on each other and are dealt to several."""

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        m, share = key[0], int(key[1])
        plan, s = plans[m], _of(settings, m)
        y = part["_y"].to_numpy(dtype=np.int64)
        bins = np.frombuffer(b"".join(part["_bins"]), dtype=np.uint8).reshape(len(part), len(features))
        if s.forest:
            stands_for = np.frombuffer(b"".join(part["_for"]), dtype=float).reshape(len(part), -1, 2).transpose(1, 2, 0)
        else:
            stands_for = part["_n"].to_numpy(dtype=float)
        first, last = _dealt(s, share)
        rounds = plan.rounds(replace(s, trees=last), len(features))
        rounds.go_to(first)
        _local(rounds, np.ascontiguousarray(bins.T), y, None, stands_for)
        trees = _trees(rounds, plan, features, s)
        trees.metadata["training_time_s"] = round(time.perf_counter() - began, 3)
        return pd.DataFrame({"model": [m], "share": [share], "trees": [trees.to_bytes()]})

    forests = [m for m in plans if _of(settings, m).forest]
    boosted = [m for m in plans if m not in forests]
    entries = None
    if boosted:
        entries = cut.filter(F.col("_model").isin(boosted)).groupBy(*_ENTRY).agg(F.count(F.lit(1)).alias("_n"))
        entries = entries.select("_model", F.lit(0).alias("_share"), "_y", "_bins", "_n", F.lit(None).cast("binary").alias("_for"))
    if forests:
        drawn = _draws(cut.filter(F.col("_model").isin(forests)), plans, len(features), settings)
        drawn = drawn.select("_model", "_share", "_y", "_bins", F.lit(0).cast("long").alias("_n"), "_for")
        entries = drawn if entries is None else entries.unionByName(drawn)
    entries = entries.repartition(8 * max(1, len(plans)), "_model", "_share")
    found: dict[str, Trees] = {}
    for r in sorted(entries.groupBy("_model", "_share").applyInPandas(fit, "model string, share int, trees binary").collect(), key=lambda r: r["share"]):
        part = Trees.from_bytes(r["trees"])
        if r["model"] in found:
            whole = found[r["model"]]
            whole.trees += part.trees
            whole.values += part.values
            whole.metadata["training_time_s"] = max(whole.metadata["training_time_s"], part.metadata["training_time_s"])
        else:
            found[r["model"]] = part
    return found


_BLOCK = "model string, rows int, bins binary, y binary, row_hash binary, margin binary"


def _fit_large(rows: DataFrame, plans: dict[str, _Plan], features: list[str], names: list[str], settings) -> dict[str, Trees]:
    """Level by level over blocks of rows, one job for all open nodes of all models."""
    n_features = len(features)
    rounds = {m: p.rounds(_of(settings, m), n_features) for m, p in plans.items()}
    starts = {m: r.start for m, r in rounds.items()}

    def pack(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for m, part in chunk.groupby("_model"):
                for a in range(0, len(part), BLOCK_ROWS):
                    b, plan = part.iloc[a : a + BLOCK_ROWS], plans[m]
                    y = b["_label"].map({x: i for i, x in enumerate(plan.labels)}).to_numpy(dtype=np.int32)
                    columns = [b[n].to_numpy(dtype=float) for n in names]
                    margin = np.repeat(starts[m][:, None], len(b), axis=1)
                    out = (m, len(b), binned(columns, plan.edges).tobytes(), y.tobytes(), _row_hash(columns, y).tobytes(), margin.tobytes())
                    yield pd.DataFrame([out], columns=[c.split()[0] for c in _BLOCK.split(", ")])

    state = materialize(rows.mapInPandas(pack, _BLOCK), "blocks")
    round_no = 0
    while any(not r.done for r in rounds.values()):
        busy = {m: r for m, r in rounds.items() if not r.done}
        while wanted := [(m, t, g.pending[0]) for m, r in busy.items() for t, g in enumerate(r.growers) if g.pending]:
            sums = _level(state, rounds, wanted, n_features)
            for m, t, _ in wanted:
                rounds[m].growers[t].offer(sums[m, t])
        closed = {m: r.advance() for m, r in busy.items()}
        round_no += 1
        closed = {m: (t, rounds[m].s.depth) for m, t in closed.items() if not rounds[m].s.forest and not rounds[m].done}
        if not closed:
            continue
        moved = state.mapInPandas(_mover(closed, n_features), _BLOCK)
        if round_no % WRITE_ROUNDS == 0:
            state.unpersist()
            state = materialize(moved, "margins")
        else:
            before, state = state, moved.persist(StorageLevel.MEMORY_AND_DISK)
            state.count()
            before.unpersist()
    state.unpersist()
    return {m: _trees(r, plans[m], features, r.s) for m, r in rounds.items()}


def _arrays(row, n_features: int):
    n = int(row["rows"])
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(n_features, n)
    return bins, np.frombuffer(row["y"], dtype=np.int32), np.frombuffer(row["row_hash"], dtype=np.uint64), np.frombuffer(row["margin"]).reshape(-1, n)


def _level(state: DataFrame, rounds: dict[str, Rounds], wanted: list, n_features: int) -> dict:
    """Histograms of the wanted nodes, summed over all blocks."""
    partial = {(m, t): rounds[m].growers[t].shape() for m, t, _ in wanted}
    levels = {(m, t): rounds[m].growers[t].level for m, t, _ in wanted}
    asked: dict[str, list] = {}
    for m, t, nodes in wanted:
        asked.setdefault(m, []).append((t, nodes))
    # what a task needs to compute channels, without the trees grown so far
    light = {m: _Light(rounds[m]) for m in asked}

    def count(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for chunk in chunks:
            for row in chunk.to_dict("records"):
                m = row["model"]
                if m not in asked:
                    continue
                bins, y, row_hash, margin = _arrays(row, n_features)
                channels = light[m].channels(y, margin, row_hash)
                for t, nodes in asked[m]:
                    node = route(partial[m, t], bins, levels=levels[m, t])
                    h = _count(bins, node, channels[t], nodes, light[m].s.bins)
                    total[m, t] = total[m, t] + h if (m, t) in total else h
        for (m, t), h in total.items():
            nodes = next(n for u, n in asked[m] if u == t)
            for i, node in enumerate(nodes):
                yield pd.DataFrame({"model": [m], "tree": [t], "node": [node], "sums": [h[:, i].astype("<i8").tobytes()]})

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(s, dtype="<i8") for s in part["sums"])
        return pd.DataFrame({"model": [key[0]], "tree": [key[1]], "node": [key[2]], "sums": [whole.tobytes()]})

    schema = "model string, tree int, node int, sums binary"
    found = state.mapInPandas(count, schema).groupBy("model", "tree", "node").applyInPandas(add, schema).collect()
    by_node = {(r["model"], r["tree"], r["node"]): np.frombuffer(r["sums"], dtype="<i8").astype(float) for r in found}
    out = {}
    for m, t, nodes in wanted:
        s = rounds[m].s
        out[m, t] = np.stack([by_node[m, t, n].reshape(-1, n_features, s.bins) for n in nodes], axis=1)
    return out


class _Light(Rounds):
    """The part of a model's rounds that computes channels."""

    def __init__(self, rounds: Rounds):
        self.s, self.class_weight, self.k, self.per_round, self.round = rounds.s, rounds.class_weight, rounds.k, rounds.per_round, rounds.round


def _mover(closed: dict[str, list], n_features: int):
    """Adds the round's trees to the margins of every block."""

    def move(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for row in chunk.to_dict("records"):
                if row["model"] in closed:
                    bins, _, _, margin = _arrays(row, n_features)
                    margin, (grown, depth) = margin.copy(), closed[row["model"]]
                    for t, (tree, value) in enumerate(grown):
                        margin[t] += value[route(tree, bins, levels=depth)]
                    row["margin"] = margin.tobytes()
                yield pd.DataFrame([row])

    return move
