"""Benchmark decontamination by latent semantic retrieval.

The words of all texts are hashed once and written beside the texts, two bytes a word.
Texts are cut into overlapping passages of two blocks, items into pieces that fit one.  A distributed randomised SVD of the
TF-IDF passage matrix A (one pass that sums A'AQ for a random Q over all passages, then a
Nystrom decomposition of the small result) gives a latent space whose axes are scaled to
unit variance.  Passages near a piece of an item in that space are candidates.  They are
checked on their words: the share of the piece's weight that the passage holds, then the
longest common subsequence of the whole item and the surroundings and, for paraphrases, the
item's answer.  So an item may be longer than a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, unpacked, whole_rows
from tidemark.llm.words import in_slices
from tidemark.workspace import materialize, ship_package

BITS = 13  # hashed vocabulary of the passage matrix
DIM = 1 << BITS
RANK = 64
BLOCK = 24  # words; a passage is two blocks
PIECE = 2 * BLOCK  # most words of a piece of an item; a passage cannot hold more
NEAR = 0.1  # least cosine in the latent space with axes of unit variance (low, as a short item is a small part of its passage),
SAME = 0.9  # or least cosine before that scaling
HELD = 0.35  # least share of a piece's weight inside the passage
SURE = 0.8  # common subsequence, as a share of the item, that settles it
LIKE = 0.6  # share that is enough together with the answer
ANSWER_WORDS = 5
SHORT = 8  # items with fewer words must occur word for word
PIECES = 4_000  # pieces of items searched in one pass over the texts
SLICE_BYTES = 4 << 20
KNOWN_WORDS = 600_000  # hashes a task keeps before it starts anew
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„–—…¿¡"


class FoldedHashes(dict):
    """Hash of a lower-case word without outer punctuation; 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        bare = word.decode("utf-8", "replace").strip(PUNCTUATION).encode()
        self[word] = out = xxhash.xxh64_intdigest(bare) | 1 if bare else 0
        return out

    def of(self, text: bytes) -> np.ndarray:
        words = text.decode("utf-8", "replace").lower().encode().split()
        found = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        return found[found != 0]


@lru_cache(maxsize=1)
def folded() -> FoldedHashes:
    return FoldedHashes()


def group_sums(table: np.ndarray, index: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Sum of ``table[index]`` over stretches of ``index`` of at most ``width`` entries.

    Goes through the stretches side by side, entry by entry, as one long gather and a
    segmented sum are several times slower for rows of 64 numbers.
    """
    table = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
    index = np.append(index, len(table) - 1)
    out = np.zeros((len(starts), table.shape[1]), dtype=table.dtype)
    for low in range(0, len(starts), 2048):
        first, size, total = starts[low : low + 2048], lengths[low : low + 2048], out[low : low + 2048]
        for j in range(min(width, int(size.max()))):
            total += table[index[np.where(j < size, first + j, len(index) - 1)]]
    return out


class Passages:
    """The blocks and passages of some texts, given by the word numbers, laid end to end."""

    def __init__(self, numbers: list[np.ndarray]):
        self.sizes = np.array([len(n) for n in numbers], dtype=np.int64)
        self.ids = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.uint16)
        self.base = np.cumsum(self.sizes) - self.sizes
        blocks = -(-self.sizes // BLOCK)
        self.text = np.repeat(np.arange(len(numbers)), blocks)  # text of each block
        inside = np.arange(len(self.text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.starts = self.base[self.text] + BLOCK * inside
        ends = np.append(self.starts[1:], len(self.ids))
        self.lengths = (ends - self.starts)[: len(self.starts)]
        follows = np.append(self.text[1:] == self.text[:-1], False)[: len(self.text)]
        self.first = np.flatnonzero(follows | (blocks[self.text] == 1))  # first block of each passage
        self.two = follows[self.first]

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over each block."""
        return group_sums(table, self.ids, self.starts, self.lengths, BLOCK)

    def scattered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers that occur, and for each the sum of the rows of the blocks around its occurrences."""
        order = np.argsort(self.ids, kind="stable")
        ids = self.ids[order]
        block = np.repeat(np.arange(len(self.starts)), self.lengths)[order]
        cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        count = np.diff(np.append(cut, len(ids)))
        runs = -(-count // BLOCK)  # occurrences of a word are summed in runs first
        inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        starts = np.repeat(cut, runs) + BLOCK * inside
        part = group_sums(rows, block, starts, np.minimum(np.repeat(cut + count, runs) - starts, BLOCK), BLOCK)
        return ids[cut], np.add.reduceat(part, np.cumsum(runs) - runs, axis=0)

    def cells(self, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
        """The different word numbers of each stretch of at most ``width`` words, filled up with DIM."""
        place = starts[:, None] + np.arange(width)
        out = np.append(self.ids, np.uint16(DIM))[np.where(place < ends[:, None], place, len(self.ids))]
        out.sort(axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = DIM
        return out

    def joined(self, blocks: np.ndarray) -> np.ndarray:
        """Block sums to passage sums."""
        out = blocks[self.first].copy()
        out[self.two] += blocks[self.first[self.two] + 1]
        return out


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the hashed word numbers of each text (little-endian 16-bit), written once for all passes."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = folded()
        for batch in batches:
            numbers = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                if len(known) > KNOWN_WORDS:
                    known.clear()
                numbers.append((known.of(text) >> np.uint64(64 - BITS)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(numbers, pa.binary())], names=["doc_id", "text", "ids"])

    return materialize(docs.mapInArrow(number, "doc_id long, text string, ids binary"), "word-numbers")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[range, Passages]]:
    """Bounded stretches of the batch's rows with their passages."""
    numbers = [np.frombuffer(x, dtype="<u2") for x in batch.column("ids").to_pylist()]
    at = 0
    for part in in_slices(numbers, len, SLICE_BYTES // 8):
        yield range(at, at + len(part)), Passages(part)
        at += len(part)


def _weights(numbered: DataFrame) -> np.ndarray:
    """Inverse document frequency of each hashed word over all blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(DIM + 1, dtype=np.int64)
        for batch in batches:
            for _, p in _slices(batch):
                found[:DIM] += np.bincount(p.cells(p.starts, p.starts + p.lengths, BLOCK).ravel(), minlength=DIM + 1)[:DIM]
                found[DIM] += len(p.starts)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at), "n": pa.array(found[at])})

    out = np.zeros(DIM + 1)
    for row in numbered.select("ids").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most DIM + 1 rows
        out[row["i"]] = row["n"]
    return np.log((out[DIM] + 1) / (out[:DIM] + 1)).clip(min=0).astype(np.float32)


def _basis(numbered: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projection of a passage to the scaled latent space (DIM x RANK) and the axes' singular values."""
    probe = np.random.default_rng(3).standard_normal((DIM, RANK)).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIM, RANK), dtype=np.float32)
        for batch in batches:
            for _, p in _slices(batch):
                if not len(p.ids):
                    continue
                norm = p.joined(p.sums(weights[:, None] ** 2)) + 1e-9
                seen = p.joined(p.sums(weights[:, None] * probe)) / norm  # rows of A Q over squared row norms
                back = np.zeros((len(p.starts), RANK), dtype=np.float32)
                back[p.first] += seen
                back[p.first[p.two] + 1] += seen[p.two]
                ids, rows = p.scattered(back)
                total[ids] += rows
        at = np.flatnonzero(total.any(axis=1))
        values = {f"v{j}": pa.array(total[at, j].astype(np.float64)) for j in range(RANK)}
        yield pa.RecordBatch.from_pydict({"i": pa.array(at), **values})

    columns = [f"v{j}" for j in range(RANK)]
    summed = numbered.select("ids").mapInArrow(sketch, "i long, " + ", ".join(f"{c} double" for c in columns)).groupBy("i").agg(*[F.sum(c).alias(c) for c in columns])
    y = np.zeros((DIM, RANK))
    for row in summed.collect():  # at most DIM rows
        y[row["i"]] = row[1:]
    y *= weights[:, None]
    core = probe.T.astype(np.float64) @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > max(value.max(), 0) * 1e-9
    if not keep.any():
        return np.zeros((DIM, RANK), dtype=np.float32), np.zeros(RANK, dtype=np.float32)
    left, size, _ = np.linalg.svd(y @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    out = np.zeros((DIM, RANK), dtype=np.float32)
    size = np.maximum(size, size.max() * 1e-6)
    out[:, : len(size)] = weights[:, None] * left / size
    return out, np.pad(size, (0, RANK - len(size))).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (bit masks of its words) and ``words``."""
    full = (1 << size) - 1
    row = full
    for w in words:
        hit = row & masks.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


class Item:
    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray | None):
        self.item_id, self.words = item_id, words.tolist()
        self.answer = (answer if answer is not None and len(answer) else words[-ANSWER_WORDS:]).tolist()
        self.masks, self.answer_masks = self._masks(self.words), self._masks(self.answer)

    def pieces(self) -> list[list[int]]:
        """The words in as few pieces of nearly equal length as PIECE allows."""
        n = len(self.words)
        count = -(-n // PIECE)
        return [self.words[n * j // count : n * (j + 1) // count] for j in range(count)]

    @staticmethod
    def _masks(words: list[int]) -> dict[int, int]:
        masks: dict[int, int] = {}
        for i, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << i
        return masks

    def verdict(self, region: list[int]) -> tuple[float, bool] | None:
        """(share of the item in common, answer found) if the region gives the item away."""
        n = len(self.words)
        if n < SHORT:
            whole = any(region[i : i + n] == self.words for i in range(len(region) - n + 1))
            return (1.0, True) if whole else None
        share = common_subsequence(self.masks, n, region) / n
        if share < LIKE:
            return None
        answer = common_subsequence(self.answer_masks, len(self.answer), region) >= SURE * len(self.answer)
        return (share, answer) if share >= SURE or answer else None


HITS = "doc_id long, item_id long, common double, answer boolean"


def _search(numbered: DataFrame, items: list[Item], weights: np.ndarray, basis: np.ndarray, size: np.ndarray) -> DataFrame:
    cut = [(i, piece) for i, item in enumerate(items) for piece in item.pieces()]
    owner = [i for i, _ in cut]  # item of each piece
    hashed = [(np.array(piece, dtype=np.uint64) >> np.uint64(64 - BITS)).astype(np.int64) for _, piece in cut]
    held = np.zeros((len(cut), DIM + 1), dtype=np.float32)  # weight of the piece's words; the last column is padding
    for k, ids in enumerate(hashed):
        held[k, ids] = weights[ids]
    mass = np.maximum(held.sum(axis=1), 1e-9)
    query = np.array([basis[ids].sum(axis=0) for ids in hashed], dtype=np.float32).reshape(-1, RANK)
    plain, query = _unit(query * size), _unit(query)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = folded()
        for batch in batches:
            out = []
            for rows_, p in _slices(batch):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                words: dict[int, np.ndarray] = {}  # full hashes, of texts with candidates only
                best: dict[tuple[int, int], tuple[float, bool]] = {}
                latent = p.joined(p.sums(basis))
                for at in range(0, len(latent), 4096):
                    some, start = latent[at : at + 4096], p.starts[p.first[at : at + 4096]]
                    text = p.text[p.first[at : at + 4096]]
                    close = (query @ _unit(some).T >= NEAR) | (plain @ _unit(some * size).T >= SAME)
                    cells = p.cells(start, np.minimum(start + 2 * BLOCK, p.base[text] + p.sizes[text]), 2 * BLOCK)
                    judged: set[tuple[int, int]] = set()  # a passage may be near several pieces of an item
                    for q in np.flatnonzero(close.any(axis=1)).tolist():
                        rows = np.flatnonzero(close[q])
                        i = owner[q]
                        one, reach = items[i], len(items[i].words)
                        for k in rows[held[q][cells[rows]].sum(axis=1) >= HELD * mass[q]].tolist():
                            if (i, k) in judged:
                                continue
                            judged.add((i, k))
                            t = int(text[k])
                            if t not in words:
                                words[t] = known.of(batch.column("text")[rows_[t]].as_py().encode())
                            inside = int(start[k] - p.base[t])
                            found = one.verdict(words[t][max(0, inside - reach) : inside + 2 * BLOCK + reach].tolist())
                            if found and found > best.get((t, i), (0.0, False)):
                                best[t, i] = found
                out += [(batch.column("doc_id")[rows_[t]].as_py(), items[i].item_id, share, answer) for (t, i), (share, answer) in sorted(best.items())]
            columns = list(zip(*out)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "common", "answer"])

    return numbered.mapInArrow(search, HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None) -> DataFrame:
    """Texts that give a benchmark item away: doc_id, item_id, common, answer.

    ``common`` is the longest common subsequence as a share of the item's words, the
    largest of the text; case and outer punctuation do not count.  A share of 0.8 is a hit,
    a share of 0.6 if the answer is found too (``answer_col``, or the item's last words).
    Items of fewer than eight words must occur word for word; items without words or id
    match nothing.  Items may be of any length.  Null texts have no words.  Repeated rows and items are each reported;
    an empty table on either side gives no rows.  Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    plain = documents(docs)
    wanted = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
        (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"),
    ).dropna(subset=["item_id", "text"])
    pieces = F.ceil(F.size(F.split(F.trim("text"), "\\s+")) / PIECE)
    passes = max(1, -(-(wanted.agg(F.sum(pieces)).first()[0] or 0) // PIECES))
    numbered = _numbered(plain)
    weights = _weights(numbered)
    basis, size = _basis(numbered, weights)
    hits, known = None, FoldedHashes()
    for turn in range(passes):  # a pass holds a bounded block of pieces
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).collect()
        items = [Item(r["item_id"], known.of(r["text"].encode()), known.of(r["answer"].encode()) if r["answer"] else None) for r in rows]
        found = _search(numbered, [i for i in items if i.words], weights, basis, size)
        hits = found if hits is None else hits.unionByName(found)
    return hits


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that give no item away, with all their columns; rows without an id are judged by their text too."""
    keyed = whole_rows(docs)
    # the search sees the text's key in place of the id, so that ids may be null or repeat
    judged = contaminated(keyed.select(F.col("text_key").alias("doc_id"), F.col("row").getField("text").alias("text")), benchmark)
    gone = materialize(judged.select(F.col("doc_id").alias("text_key")).distinct(), "leaks")  # its size decides how it is joined
    return unpacked(keyed.join(gone, "text_key", "left_anti"), docs.columns)
