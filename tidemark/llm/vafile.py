"""Exact k-means over a vector-approximation file (VA-file).

Each vector is kept twice: as a few bits per dimension (the number of the cell its
component falls into) and in full.  A round reads the approximations.  For a centroid, a
table per dimension gives the smallest and the largest squared difference of every cell,
and the sums over the dimensions bound the distance from both sides.  A vector whose best
upper bound lies below all other lower bounds is assigned without its full components.
Only the others, and those whose cluster changed (its sums move), are fetched, by their
offset in the file.  Results equal those of a full scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attempt_name, filesystem, settle
from tidemark.workspace import new_path, ship_package

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
BITS = 4  # per dimension
LIMIT = 1 << 27  # largest component whose squared distances fit 64 bits for any other
BLOCK = 4_096  # vectors bounded at a time
GAP = 16  # vectors read through instead of a second seek

PARTS = "part int, approximations string, vectors string, ids string, n long"
STEP = "part int, state string, cluster int, n long, sums array<long>, fetched long"
RESULT = "vec_id long, cluster int, distance long"


def components(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """floor(256 x) of every component, or null where the vector is not kept."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * 256) < F.lit(float(LIMIT)))
    return F.when((F.size(vector) == dimensions) & finite & fits, whole)


def _write(kept: DataFrame, edges: np.ndarray, folder: str) -> DataFrame:
    """Approximation, vector and id files of every partition; the written manifest names the valid ones."""

    def write(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        names = [attempt_name(folder, label, part, "bin") for label in ("cells", "vectors", "ids")]
        fs, inside = filesystem(folder)
        fs.create_dir(inside, recursive=True)
        streams = [fs.open_output_stream(filesystem(name)[1]) for name in names]
        for chunk in chunks:
            if chunk.empty:
                continue
            full = np.stack(chunk["v"].to_numpy()).astype(np.int64)
            cells = np.stack([np.searchsorted(edges[j], full[:, j], side="right") for j in range(full.shape[1])], axis=1).astype(np.uint8)
            cells = np.pad(cells, ((0, 0), (0, cells.shape[1] % 2)))
            packed = (cells[:, 0::2] << BITS) | cells[:, 1::2]  # two cells a byte
            ids = np.stack([chunk["vec_id"].fillna(0).to_numpy().astype(np.int64), chunk["vec_id"].isna().to_numpy().astype(np.int64)], axis=1)
            for stream, values in zip(streams, (packed, full.astype("<i4"), ids.astype("<i8"))):
                stream.write(np.ascontiguousarray(values).tobytes())
            n += len(full)
        for stream in streams:
            stream.close()
        if n:
            yield pd.DataFrame({"part": [part], "approximations": [names[0]], "vectors": [names[1]], "ids": [names[2]], "n": [n]})

    return settle(kept.mapInPandas(write, PARTS), "va-parts")


def tables(centroids: np.ndarray, edges: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared difference to every centroid: [dimension, cell, centroid]."""
    starts = np.concatenate([low[:, None], edges], axis=1)[:, :, None]
    stops = np.concatenate([edges - 1, high[:, None]], axis=1)[:, :, None]
    at = centroids.T[:, None, :]
    near = np.maximum(np.maximum(starts - at, at - stops), 0)
    far = np.maximum(np.abs(at - starts), np.abs(at - stops))
    return near * near, far * far


def bounds(cells: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the squared distance of every vector to every centroid."""
    lower = np.zeros((len(cells), near.shape[2]), dtype=np.int64)
    upper = np.zeros_like(lower)
    for j in range(cells.shape[1]):
        lower += near[j][cells[:, j]]
        upper += far[j][cells[:, j]]
    return lower, upper


def distances(full: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((full - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class _Part:
    """The three files of one partition, opened in a task."""

    def __init__(self, row, dimensions: int):
        self.row, self.dimensions = row, dimensions
        self.files = [fs.open_input_file(path) for fs, path in (filesystem(row[c]) for c in ("approximations", "vectors", "ids"))]

    def read(self, which: int, start: int, stop: int, kind: str, width: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * width
        raw = self.files[which].read_at((stop - start) * size, start * size)
        return np.frombuffer(raw, dtype=kind).reshape(-1, width)

    def cells(self, start: int, stop: int) -> np.ndarray:
        packed = self.read(0, start, stop, "u1", (self.dimensions + 1) // 2)
        return np.stack([packed >> BITS, packed & ((1 << BITS) - 1)], axis=2).reshape(len(packed), -1)[:, : self.dimensions]

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Full vectors of ascending rows; near ones are read in one go."""
        if not len(rows):
            return np.zeros((0, self.dimensions), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(rows) > GAP) + 1
        parts = [self.read(1, r[0], r[-1] + 1, "<i4", self.dimensions)[r - r[0]] for r in np.split(rows, cuts)]
        return np.concatenate(parts).astype(np.int64)

    def close(self) -> None:
        for f in self.files:
            f.close()


def assign(part: _Part, start: int, stop: int, centroids: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters of a block, the rows whose intervals overlap and their full vectors."""
    lower, upper = bounds(part.cells(start, stop), near, far)
    open_ = lower <= upper.min(axis=1)[:, None]
    cluster = np.argmax(open_, axis=1)
    rows = np.flatnonzero(open_.sum(axis=1) > 1)
    full = part.vectors(start + rows)
    if len(rows):
        exact = np.where(open_[rows], distances(full, centroids), np.iinfo(np.int64).max)
        cluster[rows] = exact.argmin(axis=1)  # ties: the smaller number
    return cluster, rows, full


def _round(parts: DataFrame, slots: int, centroids: np.ndarray, box, folder: str, dimensions: int) -> DataFrame:
    """One assignment: per part the changes of every cluster's sums and count, and the file of the new clusters.

    ``parts`` has the files of each part and, from the second round on, ``state``, the file of its present clusters.
    """
    edges, low, high = box
    near, far = tables(centroids, edges, low, high)

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for row in chunk.to_dict("records"):
                yield _move(row)

    def _move(row: dict) -> pd.DataFrame:
        part, k = _Part(row, dimensions), len(centroids)
        sums, counts, fetched = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64), 0
        before = _open(row["state"]) if row["state"] else None
        state = attempt_name(folder, "clusters", row["part"], "bin")
        fs, path = filesystem(state)
        with fs.open_output_stream(path) as out:
            for start in range(0, row["n"], BLOCK):
                stop = min(start + BLOCK, row["n"])
                cluster, rows, full = assign(part, start, stop, centroids, near, far)
                old = np.full(stop - start, -1) if before is None else _clusters(before, start, stop)
                extra = np.setdiff1d(np.flatnonzero(cluster != old), rows)
                rows, full = np.concatenate([rows, extra]), np.concatenate([full, part.vectors(start + extra)])
                fetched += len(rows)
                moved = cluster[rows] != old[rows]
                v, to, was = full[moved], cluster[rows[moved]], old[rows[moved]]
                np.add.at(sums, to, v)
                np.add.at(counts, to, 1)
                had = was >= 0
                np.subtract.at(sums, was[had], v[had])
                np.subtract.at(counts, was[had], 1)
                out.write(cluster.astype("<i4").tobytes())
        if before is not None:
            before.close()
        part.close()
        return pd.DataFrame({"part": row["part"], "state": state, "cluster": np.arange(k), "n": counts, "sums": list(sums), "fetched": fetched})

    return settle(parts.repartition(slots).mapInPandas(run, STEP), "va-round")


def _open(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def _clusters(file, start: int, stop: int) -> np.ndarray:
    return np.frombuffer(file.read_at((stop - start) * 4, start * 4), dtype="<i4")


def _measure(parts: DataFrame, slots: int, centroids: np.ndarray, dimensions: int) -> DataFrame:
    """Every vector with its cluster and exact distance."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            for row in chunk.to_dict("records"):
                part, state = _Part(row, dimensions), _open(row["state"])
                for start in range(0, row["n"], BLOCK):
                    stop = min(start + BLOCK, row["n"])
                    cluster, full = _clusters(state, start, stop), part.vectors(np.arange(start, stop))
                    ids = part.read(2, start, stop, "<i8", 2)
                    distance = ((full - centroids[cluster]) ** 2).sum(axis=1)
                    vec_id = pd.Series(ids[:, 0], dtype="Int64").mask(ids[:, 1] == 1)
                    yield pd.DataFrame({"vec_id": vec_id, "cluster": cluster, "distance": distance})
                state.close()
                part.close()

    return parts.repartition(slots).mapInPandas(run, RESULT)


@dataclass
class Clusters:
    """Assignments, final centroids (number order) and, per round, the share of vectors fetched in full."""

    rows: DataFrame
    centroids: list[list[int]]
    fetched: list[float]


def kmeans(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> Clusters:
    """Lloyd's rounds on integer vectors with exact floor means; see ``cluster`` for the rules."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), components(vectors[vector_col], dimensions).alias("v")).filter("v IS NOT NULL")
    rank = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    if not first:
        return Clusters(spark.createDataFrame([], RESULT), [], [])
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    points = F.array(*[F.lit(i / (1 << BITS)) for i in range(1, 1 << BITS)])
    each = [F.struct(F.percentile_approx(F.col("v")[j], points, 1_000).alias("e"), F.min(F.col("v")[j]).alias("lo"), F.max(F.col("v")[j]).alias("hi")) for j in range(dimensions)]
    shape = rows.agg(F.array(*each).alias("d")).first()["d"]
    edges = np.array([d["e"] for d in shape], dtype=np.int64)
    box = (edges, np.array([d["lo"] for d in shape], dtype=np.int64), np.array([d["hi"] for d in shape], dtype=np.int64))

    folder = new_path(spark, "va-file")
    written = _write(rows, edges, folder)
    slots = written.count()
    parts = written.withColumn("state", F.lit(None).cast("string"))
    sums, counts, shares = np.zeros(centroids.shape, dtype=object), np.zeros(len(centroids), dtype=object), []
    total = written.agg(F.sum("n")).first()[0]
    for turn in range(rounds + 1):
        step = _round(parts, slots, centroids, box, folder, dimensions)
        parts = written.join(step.filter("cluster = 0").select("part", "state"), "part")
        shares.append(step.filter("cluster = 0").agg(F.sum("fetched")).first()[0] / total)
        if turn == rounds:
            break
        change = step.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(dimensions)]).alias("s"))
        for r in change.collect():  # one row per centroid
            sums[r["cluster"]] += np.array(r["s"], dtype=object)
            counts[r["cluster"]] += r["n"]
        centroids = np.array([[int(x) // int(n) for x in s] if n else list(c) for s, n, c in zip(sums, counts, centroids)], dtype=np.int64)
    return Clusters(settle(_measure(parts, slots, centroids, dimensions), "va-clusters"), centroids.tolist(), shares)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite; a
    component x counts as floor(256 x).  A vector with a component of 2^27 or more after that
    has no squared distance in 64 bits and is left out like a non-finite one.  Centroids
    start as the vectors whose hashed id is smallest (ties, and rows without an id, which
    come last: smaller components first); with fewer than ``k`` vectors there are fewer.
    Repeated rows count each.  An empty table, or one without kept vectors, gives no rows;
    other columns are ignored.
    """
    found = kmeans(vectors, id_col, vector_col, k, rounds, dimensions)
    spark = vectors.sparkSession
    each = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row per centroid
    names = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)], "cluster long, centroid_sha256 string"
    )
    table = each.join(names, "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return found.rows.join(F.broadcast(table), "cluster").select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
