"""Registered queries: profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import numeric_columns, r6
from tidemark.operators import clean as cl
from tidemark.operators import profile as pr
from tidemark.operators.split import temporal_split
from tidemark.plans.registry import query
from tidemark.plans.views import DIRTY_SQL, FLOWS_SQL, FLOW_KEY, FLOW_ORDER_SQL, FLOW_FEATURES, dirty, flows, packets, planted, table

_COLUMNS = ["event_id", "Source IP", "Flow ID", "Timestamp", "Flow Bytes/s", "Flow Packets/s", "const_all", "const_most", "Label"]
_NUMBERS = ["Flow Bytes/s", "Flow Packets/s", "const_all", "const_most"]


def _tidy(spark, sf_dir):
    return cl.tidy_header(dirty(spark, sf_dir))


def _absent(c: str) -> str:
    return f'("{c}" IS NULL OR isnan("{c}"))' if c in _NUMBERS else f'"{c}" IS NULL'


@query(
    "profile_nulls",
    f"WITH {DIRTY_SQL}, c AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", lower(replace(any_value(typeof("{c}")), 'VARCHAR', 'string')) AS dtype, count(*) AS n_rows,
  count(*) FILTER (WHERE {_absent(c)}) AS n_null FROM dirty"""
        for c in _COLUMNS
    )
    + ') SELECT *, CAST(sum(n_null) OVER () AS BIGINT) AS total_null FROM c',
)
def profile_nulls(spark, sf_dir):
    return pr.profile_nulls(_tidy(spark, sf_dir))


@query(
    "profile_infinite",
    f"WITH {DIRTY_SQL}, c AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE abs("{c}") = CAST('inf' AS DOUBLE)) AS n_infinite FROM dirty""" for c in _NUMBERS
    )
    + ") SELECT *, CAST(sum(n_infinite) OVER () AS BIGINT) AS total_infinite FROM c WHERE n_infinite > 0",
)
def profile_infinite(spark, sf_dir):
    return pr.profile_infinite(_tidy(spark, sf_dir))


@query(
    "profile_duplicates",
    f"WITH {DIRTY_SQL} SELECT (SELECT count(*) FROM dirty) AS n_rows, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n_duplicates",
)
def profile_duplicates(spark, sf_dir):
    return pr.profile_duplicates(_tidy(spark, sf_dir))


@query(
    "class_distribution",
    f"""WITH {FLOWS_SQL} SELECT "Label" AS label, count(*) AS n, round(count(*) * 1e2 / (SELECT count(*) FROM flows), 2) AS pct,
  (SELECT count(DISTINCT "Label") FROM flows) AS n_labels FROM flows GROUP BY 1""",
)
def class_distribution(spark, sf_dir):
    return pr.class_distribution(flows(spark, sf_dir), "Label")


_TIME_SQL = """COALESCE(try_strptime("Timestamp", '%d/%m/%Y %H:%M:%S'), try_strptime("Timestamp", '%d/%m/%Y %H:%M'))"""


@query(
    "temporal_info",
    f"""WITH {DIRTY_SQL}, t AS (SELECT {_TIME_SQL} AS t FROM dirty)
SELECT strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_time,
  date_diff('second', min(t), max(t)) AS duration_s, count(t) AS n_valid, count(*) - count(t) AS n_invalid,
  (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT strftime(t, '%Y-%m-%d') AS d FROM t WHERE t IS NOT NULL)) AS unique_dates
FROM t""",
)
def temporal_info(spark, sf_dir):
    return pr.temporal_info(_tidy(spark, sf_dir), "Timestamp")


@query(
    "constant_columns",
    f"WITH {DIRTY_SQL}, c AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(DISTINCT CASE WHEN NOT {_absent(c)} THEN "{c}" END) AS d FROM dirty"""
        for c in _COLUMNS
    )
    + ') SELECT "column", n_rows FROM c WHERE d <= 1',
)
def constant_columns(spark, sf_dir):
    return pr.constant_columns(_tidy(spark, sf_dir))


@query(
    "leakage_columns",
    f"""WITH {DIRTY_SQL} SELECT 'Source IP' AS "column", count(*) AS n_rows, count("Source IP") AS n_filled FROM dirty
UNION ALL SELECT 'Flow ID', count(*), count("Flow ID") FROM dirty""",
)
def leakage_columns(spark, sf_dir):
    return pr.leakage_columns(_tidy(spark, sf_dir))


_WORD = "sum(CAST(CAST('0x' || substr(h, {at}, 8) AS BIGINT) AS HUGEINT)) % 4294967296"


@query(
    "dataset_fingerprint",
    f"""WITH r AS (SELECT md5(concat_ws('|', COALESCE(CAST(doc_id AS VARCHAR), '\\N'), COALESCE(text, '\\N'), COALESCE(lang, '\\N'),
  COALESCE(source, '\\N'), COALESCE(CAST(n_chars AS VARCHAR), '\\N'))) AS h FROM documents)
SELECT count(*) AS n_rows, printf('%08x', CAST({_WORD.format(at=1)} AS BIGINT)) || printf('%08x', CAST({_WORD.format(at=9)} AS BIGINT)) AS fingerprint FROM r""",
)
def dataset_fingerprint(spark, sf_dir):
    return pr.dataset_fingerprint(table(spark, sf_dir, "documents"))


@query(
    "common_features",
    """WITH a AS (SELECT count(l_extendedprice) AS np, avg(l_extendedprice) AS mp, count(l_quantity) AS nq, avg(l_quantity) AS mq FROM lineitem),
b AS (SELECT count(p_retailprice) AS np, avg(p_retailprice) AS mp, count(p_size) AS nq, avg(p_size) AS mq FROM part)
SELECT 'price' AS feature, a.np AS n_a, round(a.mp, 4) AS mean_a, b.np AS n_b, round(b.mp, 4) AS mean_b FROM a, b
UNION ALL SELECT 'quantity', a.nq, round(a.mq, 4), b.nq, round(b.mq, 4) FROM a, b""",
)
def common_features(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_extendedprice": "price", "l_quantity": "quantity", "l_shipdate": "Timestamp"})
    b = table(spark, sf_dir, "part").withColumnsRenamed({"p_retailprice": "price", "p_size": "quantity"})
    out = pr.common_feature_profile(a, b)
    return out.withColumns({"mean_a": F.round("mean_a", 4), "mean_b": F.round("mean_b", 4)})


# --- cleaning ---------------------------------------------------------------------------

_BINARY = """CASE WHEN upper(trim("Label")) = 'BENIGN' THEN 'BENIGN' WHEN "Label" IS NOT NULL THEN 'ATTACK' END"""


@query("label_binary", f'WITH {DIRTY_SQL} SELECT event_id, {_BINARY} AS label FROM dirty')
def label_binary(spark, sf_dir):
    return _tidy(spark, sf_dir).select("event_id", cl.binary_label("Label").alias("label"))


@query("label_multiclass", f'WITH {DIRTY_SQL} SELECT trim("Label") AS label, count(*) AS n FROM dirty GROUP BY 1')
def label_multiclass(spark, sf_dir):
    return _tidy(spark, sf_dir).groupBy(cl.multiclass_label("Label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_FINITE = lambda c: f"""CASE WHEN NOT isnan("{c}") AND abs("{c}") <> CAST('inf' AS DOUBLE) THEN "{c}" END"""
_CLEAN_SQL = f"""{DIRTY_SQL},
fin AS (SELECT event_id, "Source IP", "Flow ID", "Timestamp", {_FINITE("Flow Bytes/s")} AS b, {_FINITE("Flow Packets/s")} AS p,
  const_all, const_most, {_BINARY} AS label FROM dirty)"""


@query("clean_infinity", f"WITH {_CLEAN_SQL} SELECT event_id, b AS bytes_s, p AS packets_s FROM fin")
def clean_infinity(spark, sf_dir):
    out = cl.infinite_to_null(_tidy(spark, sf_dir))
    return out.select("event_id", F.col("`Flow Bytes/s`").alias("bytes_s"), F.col("`Flow Packets/s`").alias("packets_s"))


def _impute(strategy):
    def run(spark, sf_dir):
        rows = cl.infinite_to_null(_tidy(spark, sf_dir))
        names = ["Flow Bytes/s", "Flow Packets/s"]
        out = cl.impute(rows, cl.fill_values(rows, names, strategy))
        return out.select("event_id", r6("Flow Bytes/s").alias("bytes_s"), r6("Flow Packets/s").alias("packets_s"))

    return run


for _name, _agg in (("median", "quantile_cont({c}, 5e-1)"), ("mean", "avg({c})"), ("zero", "0e0 * count({c})")):
    query(
        f"impute_{_name}",
        f"""WITH {_CLEAN_SQL} SELECT event_id, round(COALESCE(b, (SELECT {_agg.format(c='b')} FROM fin)), 6) AS bytes_s,
  round(COALESCE(p, (SELECT {_agg.format(c='p')} FROM fin)), 6) AS packets_s FROM fin""",
    )(_impute(_name))


@query("drop_null_rows", f"WITH {_CLEAN_SQL} SELECT event_id, label FROM fin WHERE b IS NOT NULL AND p IS NOT NULL AND label IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    rows = _tidy(spark, sf_dir)
    out = cl.drop_null_rows(cl.infinite_to_null(rows.withColumn("Label", cl.binary_label("Label"))))
    return out.select("event_id", F.col("Label").alias("label"))


@query("drop_null_numeric_rows", f"WITH {_CLEAN_SQL} SELECT event_id, label FROM fin WHERE b IS NOT NULL AND p IS NOT NULL")
def drop_null_numeric_rows(spark, sf_dir):
    rows = _tidy(spark, sf_dir).withColumn("Label", cl.binary_label("Label"))
    return cl.drop_null_rows(cl.infinite_to_null(rows), numeric_only=True).select("event_id", F.col("Label").alias("label"))


@query(
    "near_constant_columns",
    f"WITH {_CLEAN_SQL}, s AS ("
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", (SELECT max(k) FROM (SELECT count({c}) AS k FROM fin GROUP BY {c})) * 1e0 / count({c}) AS s FROM fin"""
        for n, c in (("event_id", "event_id"), ("Source IP", '"Source IP"'), ("Flow Bytes/s", "b"), ("Flow Packets/s", "p"), ("const_all", "const_all"), ("const_most", "const_most"))
    )
    + """) SELECT "column", round(CASE WHEN s >= 99e-2 THEN s END, 6) AS top_share, s >= 99e-2 AS near_constant FROM s""",
)
def near_constant_columns(spark, sf_dir):
    rows = cl.infinite_to_null(_tidy(spark, sf_dir))
    return cl.near_constant_shares(rows, numeric_columns(rows)).withColumn("top_share", r6("top_share"))


_FILLED_SQL = f"""{_CLEAN_SQL},
filled AS (SELECT event_id, "Timestamp", COALESCE(b, (SELECT quantile_cont(b, 5e-1) FROM fin)) AS b,
  COALESCE(p, (SELECT quantile_cont(p, 5e-1) FROM fin)) AS p, label FROM fin),
kept AS (SELECT * FROM filled WHERE label IS NOT NULL),
cleaned AS (SELECT DISTINCT * FROM kept)"""


@query(
    "clean_table",
    f"""WITH {_FILLED_SQL} SELECT event_id, "Timestamp" AS time_text, round(b, 6) AS bytes_s, round(p, 6) AS packets_s, label FROM cleaned""",
)
def clean_table(spark, sf_dir):
    out = cl.clean_table(dirty(spark, sf_dir)).df
    return out.select(
        "event_id", F.col("Timestamp").alias("time_text"), r6("Flow Bytes/s").alias("bytes_s"),
        r6("Flow Packets/s").alias("packets_s"), F.col("Label").alias("label"),
    )


@query(
    "clean_report",
    f"""WITH {_FILLED_SQL}, lines(step, "column", n) AS (
  SELECT 'rows_before', '', count(*) FROM dirty
  UNION ALL SELECT 'columns_before', '', 9
  UNION ALL SELECT 'infinite', 'Flow Bytes/s', count(*) FROM dirty WHERE abs("Flow Bytes/s") = CAST('inf' AS DOUBLE)
  UNION ALL SELECT 'infinite', 'Flow Packets/s', count(*) FROM dirty WHERE abs("Flow Packets/s") = CAST('inf' AS DOUBLE)
  UNION ALL SELECT 'filled', 'Flow Bytes/s', count(*) FROM fin WHERE b IS NULL
  UNION ALL SELECT 'filled', 'Flow Packets/s', count(*) FROM fin WHERE p IS NULL
  UNION ALL SELECT 'null_rows', '', (SELECT count(*) FROM filled) - (SELECT count(*) FROM kept)
  UNION ALL SELECT 'dropped_id', 'Source IP', 1
  UNION ALL SELECT 'dropped_id', 'Flow ID', 1
  UNION ALL SELECT 'dropped_constant', 'const_all', 1
  UNION ALL SELECT 'dropped_constant', 'const_most', 1
  UNION ALL SELECT 'duplicates', '', (SELECT count(*) FROM kept) - (SELECT count(*) FROM cleaned)
  UNION ALL SELECT 'rows_after', '', count(*) FROM cleaned
  UNION ALL SELECT 'columns_after', '', 5)
SELECT step, "column", CAST(n AS BIGINT) AS n FROM lines WHERE n > 0""",
)
def clean_report(spark, sf_dir):
    return cl.clean_table(dirty(spark, sf_dir)).report


@query("dedupe_rows", "SELECT DISTINCT md5(text) AS text_md5, lang, source FROM documents")
def dedupe_rows(spark, sf_dir):
    out = cl.dedupe_rows(table(spark, sf_dir, "documents").select("text", "lang", "source"))
    return out.select(F.md5("text").alias("text_md5"), "lang", "source")


_SPLIT_SQL = f"""{DIRTY_SQL},
timed AS (SELECT *, {_TIME_SQL} AS t FROM planted),
ranked AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS pos, count(*) OVER () AS n FROM timed WHERE t IS NOT NULL),
parts AS (SELECT *, CASE WHEN pos < floor(n * 7e-1) THEN 'train' WHEN pos < floor(n * (7e-1 + 1e-1)) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


@query(
    "fit_apply_impute",
    f"""WITH {_SPLIT_SQL}, f AS (SELECT event_id, split, {_BINARY} AS label, {_FINITE("Flow Bytes/s")} AS b, {_FINITE("Flow Packets/s")} AS p FROM parts),
m AS (SELECT quantile_cont(b, 5e-1) AS b, quantile_cont(p, 5e-1) AS p FROM f WHERE split = 'train')
SELECT event_id, label, round(COALESCE(f.b, m.b), 6) AS bytes_s, round(COALESCE(f.p, m.p), 6) AS packets_s, 0e0 AS absent
FROM f, m WHERE split = 'test'""",
)
def fit_apply_impute(spark, sf_dir):
    rows = temporal_split(cl.tidy_header(planted(spark, sf_dir)), "Timestamp", ["event_id"])
    fitted = cl.fit_cleaner(rows.filter("split = 'train'"), features=["Flow Bytes/s", "Flow Packets/s"])
    fitted.features = [*fitted.features, "absent"]  # a column the test table does not have
    out = fitted.apply(rows.filter("split = 'test'"), keep=["event_id"])
    return out.select(
        "event_id", F.col("Label").alias("label"), r6("Flow Bytes/s").alias("bytes_s"), r6("Flow Packets/s").alias("packets_s"), "absent"
    )


_FLOW_SPLIT_SQL = f"""{FLOWS_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY {FLOW_ORDER_SQL}) - 1 AS pos, count(*) OVER () AS n FROM flows),
parts AS (SELECT *, CASE WHEN pos < floor(n * 7e-1) THEN 'train' WHEN pos < floor(n * (7e-1 + 1e-1)) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


@query(
    "scale_train_fit",
    f"""WITH {_FLOW_SPLIT_SQL}, m AS (SELECT """
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FLOW_FEATURES)
    + " FROM parts WHERE split = 'train') SELECT pos, split, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) + 0e0 AS {c}" for c in FLOW_FEATURES)
    + " FROM parts, m WHERE split <> 'train'",
)
def scale_train_fit(spark, sf_dir):
    rows = temporal_split(flows(spark, sf_dir), "Timestamp", FLOW_KEY)
    fitted = cl.fit_cleaner(rows.filter("split = 'train'"), features=FLOW_FEATURES, scale=True, approx=True)
    out = fitted.apply(rows.filter("split <> 'train'"), keep=["pos", "split"])
    return out.select("pos", "split", *[(F.round(c, 4) + 0.0).alias(c) for c in FLOW_FEATURES])


@query(
    "coerce_zero",
    """WITH kev AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
SELECT event_id AS packet_id, CASE WHEN event_id % 131 = 0 THEN 0e0 ELSE round(value) END AS length,
  CASE WHEN k > 20 THEN k * 1e2 ELSE 0e0 END AS "window", CASE WHEN k % 3 = 0 OR k = 50 THEN 0e0 ELSE 443e0 END AS tcp_dstport FROM kev""",
)
def coerce_zero(spark, sf_dir):
    names = ["length", "window", "tcp_dstport"]
    return cl.coerce_zero(packets(spark, sf_dir).select("packet_id", *names), names)


@query(
    "categorical_codes",
    """WITH a AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS value FROM orders)),
b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS value FROM orders))
SELECT o_orderkey, a.code AS o_orderpriority, b.code AS o_orderstatus FROM orders JOIN a ON o_orderpriority = a.value JOIN b ON o_orderstatus = b.value""",
)
def categorical_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return cl.categorical_codes(rows, ["o_orderpriority", "o_orderstatus"])


@query(
    "class_weights",
    "SELECT CAST(toxic AS VARCHAR) AS label, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * CAST(count(*) AS DOUBLE)), 6) AS weight FROM labels GROUP BY 1",
)
def class_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("toxic", F.col("toxic").cast("string"))
    return cl.class_weights(rows, "toxic").withColumn("weight", r6("weight"))
