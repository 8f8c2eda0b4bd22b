"""Reading flow tables: folders of CSV files, headerless files, named datasets, Parquet."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col, hash_bits, hash_uniform
from tidemark.operators.ordering import global_position

TOP_K_ROWS = 100_000

# Public flow datasets with their label, time and column names.
DATASETS = {
    "cic_ids_2017": {"label": "Label", "timestamp": "Timestamp", "benign": ("BENIGN",), "rename": {}},
    "cse_cic_ids_2018": {"label": "Label", "timestamp": "Timestamp", "benign": ("Benign",), "rename": {}},
    "unsw_nb15": {
        "label": "label",
        "timestamp": None,
        "benign": ("0", "Normal", "normal"),
        "rename": {
            "dur": "Flow Duration", "spkts": "Total Fwd Packets", "dpkts": "Total Backward Packets",
            "sbytes": "Total Length of Fwd Packets", "dbytes": "Total Length of Bwd Packets", "sttl": "ip.ttl",
            "swin": "Init_Win_bytes_forward", "dwin": "Init_Win_bytes_backward", "smean": "Fwd Packet Length Mean",
            "dmean": "Bwd Packet Length Mean", "sinpkt": "Flow IAT Mean", "dinpkt": "Bwd IAT Mean",
            "sjit": "Flow IAT Std", "djit": "Bwd IAT Std", "ct_srv_src": "ct_srv_src", "ct_srv_dst": "ct_srv_dst",
        },
    },
}


def _files(spark: SparkSession, folder: str, name_part: str | None) -> list[str]:
    """Sorted CSV files of a folder on any file system Spark can read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    names = sorted(p.toString() for p in found if p.getName().endswith(".csv") and (not name_part or name_part in p.getName()))
    if not names:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return names


def _header(spark: SparkSession, name: str, encoding: str) -> tuple[str, ...]:
    """Column names in the first line of a file."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(name)
    reader = jvm.java.io.BufferedReader(
        jvm.java.io.InputStreamReader(path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path), encoding)
    )
    try:
        line = reader.readLine() or ""
    finally:
        reader.close()
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), []))


def scan_csv_folder(
    spark: SparkSession, folder: str, schema: T.StructType | str | None = None, name_part: str | None = None,
    encoding: str = "utf-8", sampling: float = 1.0,
) -> DataFrame:
    """All CSV files of a folder as one table; columns are matched by trimmed name.

    With a schema (its columns in any order) nothing is inferred.  The driver reads one
    line per file; files with the same header are read together by one scan, so only
    differing headers cost a plan node.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in _files(spark, folder, name_part):
        by_header.setdefault(_header(spark, path, encoding), []).append(path)
    out = None
    for header, paths in by_header.items():
        reader = spark.read.option("header", True).option("encoding", encoding)
        if schema:
            reader = reader.schema(T.StructType([T.StructField(h, types.get(h.strip(), T.StringType())) for h in header]))
        else:
            reader = reader.option("inferSchema", True).option("samplingRatio", sampling)
        part = reader.csv(paths).toDF(*[h.strip() for h in header])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def scan_headerless(
    spark: SparkSession, path: str, schema: T.StructType | str, label: str, category: str, normal: str = "Normal"
) -> DataFrame:
    """CSV without header: unreadable labels become 0, a missing category the normal one."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name == label else f.dataType) for f in schema.fields])
    df = spark.read.schema(raw).option("header", False).csv(path)
    kind = F.trim(col(category))
    return df.withColumns({
        label: F.coalesce(F.trim(col(label)).try_cast("double").cast("int"), F.lit(0)),
        category: F.when(kind.isNull() | (kind == ""), F.lit(normal)).otherwise(kind),
    })


def row_cap(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in the given total order.

    A small cap is a top-k: each task keeps its own first ``n`` rows.  A large one would
    move all its rows through one task, so it filters on the distributed rank instead.
    """
    if n <= TOP_K_ROWS:
        return df.orderBy(*order).limit(n)
    return global_position(df, order, "_rank").filter(F.col("_rank") < n).drop("_rank")


def sample_fraction(df: DataFrame, fraction: float, key: list[str], seed: int = 42) -> DataFrame:
    """Reproducible sample without replacement by hash threshold; no shuffle."""
    return df.filter(hash_uniform(seed, *key) < F.lit(float(fraction)))


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in hash order, the same ones on every run."""
    return row_cap(df.withColumn("_h", hash_bits(seed, *key)), n, ["_h", *key]).drop("_h")


def normalize_labels(df: DataFrame, label: str, benign: tuple[str, ...]) -> DataFrame:
    """``Label`` is BENIGN for the listed spellings and ATTACK for the rest; the original stays, a missing label stays missing."""
    text: Column = F.trim(col(label).cast("string"))
    mapped = F.when(text.isin(*benign), "BENIGN").when(text.isNotNull(), "ATTACK")
    if label == "Label":
        return df.withColumn("Label", mapped)
    # two names that differ by case only need a select, not withColumn
    others = [col(c) for c in df.columns if c != label]
    return df.select(*others, mapped.alias("Label"), text.alias("_original_label"))


def dataset_normalize(df: DataFrame, rename: dict[str, str], label: str, benign: tuple[str, ...]) -> DataFrame:
    renamed = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    return normalize_labels(renamed, label, benign) if label in renamed.columns else renamed


def load_dataset(
    spark: SparkSession, folder: str, name: str, fraction: float = 1.0, key: list[str] | None = None, seed: int = 42, **kw
) -> DataFrame:
    """A public dataset by name, with common column names and labels."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASETS)}")
    about = DATASETS[name]
    df = scan_csv_folder(spark, folder, **kw)
    if fraction < 1.0:
        df = sample_fraction(df, fraction, key or df.columns, seed)
    return dataset_normalize(df, about["rename"], about["label"], about["benign"])
