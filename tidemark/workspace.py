"""Shared scratch space for intermediate tables.

Intermediate results that must not change between two passes (row positions, detector
state) are written as Parquet tables below the folder the cluster names in
``spark.checkpoint.dir``.  A written table survives the loss of executors and is read
back with column pruning.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_REGISTERED: set[str] = set()
_SHIPPED: set[str] = set()
_SCOPES: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = _FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))
    root = f"{configured.rstrip('/')}/tidemark-{app}"
    if root not in _REGISTERED:
        _REGISTERED.add(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return root


def new_path(spark: SparkSession, label: str) -> str:
    """A path that no other table uses, inside the innermost open scope."""
    base = _SCOPES[-1] if _SCOPES else scratch_root(spark)
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_scope(spark: SparkSession, label: str) -> Iterator[str]:
    """Intermediate tables made inside go below one folder, which ``free`` deletes once nothing reads them."""
    path = new_path(spark, label)
    _SCOPES.append(path)
    try:
        yield path
    finally:
        _SCOPES.remove(path)


def free(spark: SparkSession, path: str) -> None:
    """Delete a written table or scope."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    # the archive is made next to the driver and handed out by Spark
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
