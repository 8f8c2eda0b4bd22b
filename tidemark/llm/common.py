"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.workspace import free, new_path

#: The white space of all contracts: words are runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1  # order of rows without an id


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty) under fixed names; other columns cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def id_key(name: str = "doc_id") -> list[Column]:
    """Ascending order of ids in which rows without an id come last."""
    return [F.col(name).isNull().alias("_null"), F.col(name)]


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it; usable in tasks."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def attempt_name(folder: str, label: str, part: int, suffix: str) -> str:
    """A file name that no other attempt of the task uses; a committed manifest names the valid files."""
    return f"{folder.rstrip('/')}/{label}-{part:06d}-{uuid.uuid4().hex[:12]}.{suffix}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table; the shuffle files that led to it are given back once it is written."""
    spark = df.sparkSession
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    path = new_path(spark, label)
    try:
        df.write.parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``settle`` that nothing reads any more: all that depends on them is written."""
    for table in tables:
        free(table.sparkSession, table.settled_at)


def whole_rows(docs: DataFrame) -> DataFrame:
    """Every row as one struct ``row``, so that no name of its columns meets an inner one; with its ``ord`` and ``text_key``."""
    order = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("ord")
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), order, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_key"))


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``whole_rows`` again, some of them replaced."""
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
