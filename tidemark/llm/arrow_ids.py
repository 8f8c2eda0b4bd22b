"""Token ids in Arrow files of fixed-size lists.

The documents, in ascending id order, form one stream of ids.  Each shard holds whole
documents: its ids are cut into sequences of equal length, a record batch has a fixed
number of sequences, and a mask (one bit per id) marks the padding at the shard's end.  Ids
take 16 bits where the vocabulary allows it.  All batches but the last have the same shape,
so a reader finds any sequence by arithmetic and sees its ids and the mask's bytes without
a copy.  A second file beside each shard lists its documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import attempt_name, documents, filesystem, id_key
from tidemark.llm.wordbpe import encoder
from tidemark.workspace import materialize, new_path, ship_package

MANIFEST = "shard int, ids_path string, index_path string, n_docs long, n_ids long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(seq_len: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class IdWriter:
    """Streams ids into one file; memory holds one record batch."""

    def __init__(self, sink, seq_len: int, batch_rows: int, wide: bool):
        self.seq_len, self.room, self.schema = seq_len, seq_len * batch_rows * 4, sequence_schema(seq_len, wide)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.size = [], 0

    def _batch(self, raw: bytes, valid: int) -> None:
        ids = np.frombuffer(raw, dtype="<u4").astype(self.schema.field("ids").type.value_type.to_pandas_dtype())
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, np.arange(len(ids)) < valid)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.room:
            whole = b"".join(self.held)
            for at in range(0, len(whole) - self.room + 1, self.room):
                self._batch(whole[at : at + self.room], self.room // 4)
            rest = whole[len(whole) - len(whole) % self.room :]
            self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        raw = b"".join(self.held)
        if raw:
            self._batch(raw + b"\0" * (-len(raw) % (4 * self.seq_len)), len(raw) // 4)
        self.out.close()


class IdReader:
    """Random access to one shard; arrays are views of the file's memory where that is local."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, np.ndarray, np.ndarray] | None = None
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def _load(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if self.last is None or self.last[0] != number:
            batch = self.file.get_batch(number)
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            self.last = (number, ids, batch.column(1).flatten().to_numpy(zero_copy_only=False))
        return self.last[1], self.last[2]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        ids, mask = self._load(number // self.rows)
        at = number % self.rows * self.seq_len
        return ids[at : at + self.seq_len], mask[at : at + self.seq_len]

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of ``n`` ids from place ``start`` of the shard, one for each record batch they touch."""
        width = self.rows * self.seq_len
        while n > 0:
            ids, mask = self._load(start // width)
            view = ids[start % width : start % width + n]
            if not mask[start % width : start % width + n].all():
                raise ValueError("a document reaches into padding")
            yield view
            start, n = start + len(view), n - len(view)


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 1, seq_len: int = 2048, batch_rows: int = 64, folder: str | None = None) -> DataFrame:
    """Encode all documents, write the shards and return their manifest.

    Rows are ordered by doc_id, those of one id by a hash of the text; rows without an id come last, null texts count as
    empty and give the end id alone, repeated rows are all written.  An empty table gives
    an empty manifest.  Other columns are ignored.  A repeated task writes files of its
    own; only those named in the committed manifest count.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or new_path(spark, "arrow-ids")
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = encoder(vocabulary), TaskContext.get().partitionId()
        encode, wide = words.encode, max(words.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        out = index = None
        n_docs = n_ids = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                paths = [attempt_name(folder, label, shard, "arrow") for label in ("ids", "docs")]
                fs, _ = filesystem(folder)
                fs.create_dir(filesystem(folder)[1], recursive=True)
                sinks = [fs.open_output_stream(filesystem(p)[1]) for p in paths]
                out, index = IdWriter(sinks[0], seq_len, batch_rows, wide), pa.ipc.new_file(sinks[1], INDEX)
            starts, sizes = [], []
            for raw in encode(batch.column("text").to_pylist()):
                raw += end
                out.add(raw)
                starts.append(n_ids)
                sizes.append(len(raw) // 4)
                n_ids += sizes[-1]
            n_docs += len(sizes)
            index.write_batch(pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
        if out is not None:
            out.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "ids_path": [paths[0]], "index_path": [paths[1]], "n_docs": [n_docs], "n_ids": [n_ids]})

    # the range sampler brings its keys to the driver: a hash stands for the text
    order = [*id_key(), F.xxhash64("text")]
    sorted_docs = documents(docs).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return materialize(sorted_docs.mapInArrow(write, MANIFEST), "arrow-manifest")


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document, computed from the files: doc_id, start, n_tokens, ids_crc32, shard, local_start."""
    ship_package(spark)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = IdReader(row["ids_path"])
                fs, path = filesystem(row["index_path"])
                with fs.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for number in range(index.num_record_batches):
                        part = index.get_batch(number)
                        starts, sizes = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        sums = np.zeros(len(starts), dtype=np.int64)
                        for i, (start, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
                            crc = 0
                            for view in reader.span(start, n):
                                crc = zlib.crc32(view.astype("<u4"), crc)
                            sums[i] = crc
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": part.column("doc_id"), "start": pa.array(starts + row["before"]), "n_tokens": part.column("n_tokens"),
                            "ids_crc32": pa.array(sums), "shard": pa.array(np.full(len(sums), row["shard"], dtype=np.int32)), "local_start": pa.array(starts),
                        })

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, local_start long"
    return placed.repartition(files).mapInArrow(read, schema)
