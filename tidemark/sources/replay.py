"""A paced feed: a table with dense positions, read as micro-batches of a fixed number of rows.

Offsets are positions.  The reader keeps the end of the last finished batch beside the rows,
so that a restarted query, whose checkpoint knows its own offsets, is offered what follows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SLICES = 8  # partitions of a batch, at most


class Span(InputPartition):
    """Positions start .. stop - 1."""

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class PositionSource(DataSource):
    """Options: ``folder`` (with ``rows``, a Parquet table), ``pos``, ``batch_rows``, ``end``."""

    @classmethod
    def name(cls) -> str:
        return "positions"

    def streamReader(self, schema) -> PositionReader:
        return PositionReader(schema.names, dict(self.options))


class PositionReader(DataSourceStreamReader):
    def __init__(self, names: list[str], options: dict):
        self.names, self.folder, self.pos = names, options["folder"], options.get("pos", "pos")
        self.batch_rows, self.end = int(options["batch_rows"]), int(options["end"])
        self.planned = None

    def _progress(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(f"{self.folder}/progress.json")

    def initialOffset(self) -> dict:
        return {"pos": 0}

    def latestOffset(self) -> dict:
        if self.planned is None:
            fs, path = self._progress()
            known = fs.get_file_info(path).type == pyarrow.fs.FileType.File
            self.planned = json.loads(fs.open_input_file(path).read())["pos"] if known else 0
        return {"pos": min(self.planned + self.batch_rows, self.end)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        a, b = start["pos"], end["pos"]
        self.planned = b  # the next batch begins here
        step = max(1, -(-(b - a) // SLICES))
        return [Span(x, min(x + step, b)) for x in range(a, b, step)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(f"{self.folder}/rows")
        at = pyarrow.dataset.field(self.pos)
        # row groups of other positions are skipped by their statistics
        rows = pyarrow.dataset.dataset(path, filesystem=fs, format="parquet")
        table = rows.to_table(columns=self.names, filter=(at >= partition.start) & (at < partition.stop)).sort_by(self.pos)
        for i, f in enumerate(table.schema):
            if pa.types.is_timestamp(f.type) and f.type.unit == "ns":  # Spark's older 96-bit form of an instant
                table = table.set_column(i, f.name, table.column(i).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")))
        yield from table.to_batches()

    def commit(self, end: dict) -> None:
        fs, path = self._progress()
        with fs.open_output_stream(path) as out:
            out.write(json.dumps(end).encode())
