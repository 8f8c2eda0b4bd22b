"""Registered queries: splits, ordered streams and row sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean as cl
from tidemark.operators import split as sp
from tidemark.plans.preparation import _FLOW_SPLIT_SQL, _SPLIT_SQL
from tidemark.plans.registry import query
from tidemark.plans.views import FLOW_KEY, FLOWS_SQL, SCORED_SQL, flows, planted, scored, table

_KEY_TEXT = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey"
_HASH_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("temporal_split", f"WITH {_SPLIT_SQL} SELECT event_id, pos, split FROM parts")
def temporal_split(spark, sf_dir):
    out = sp.temporal_split(cl.tidy_header(planted(spark, sf_dir)), "Timestamp", ["event_id"])
    return out.select("event_id", "pos", "split")


@query(
    "row_order_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos < floor(n * 7e-1) THEN 'train' WHEN pos < floor(n * (7e-1 + 1e-1)) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def row_order_split(spark, sf_dir):
    return sp.row_order_split(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", "split")


@query(
    "temporal_integrity",
    f"""WITH {_FLOW_SPLIT_SQL}, b AS (SELECT split, min("Timestamp") AS lo, max("Timestamp") AS hi,
  CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS r FROM parts GROUP BY 1)
SELECT e.split AS earlier, l.split AS later, strftime(e.hi, '%Y-%m-%d') AS earlier_max, strftime(l.lo, '%Y-%m-%d') AS later_min, e.hi <= l.lo AS ok,
  CASE WHEN e.hi = l.lo THEN (SELECT count(*) FROM parts p WHERE p.split = l.split AND p."Timestamp" = l.lo) ELSE 0 END AS n_tied
FROM b e JOIN b l ON e.r < l.r""",
)
def temporal_integrity(spark, sf_dir):
    out = sp.temporal_integrity(sp.temporal_split(flows(spark, sf_dir), "Timestamp", FLOW_KEY), "Timestamp")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("earlier", "later", day("earlier_max"), day("later_min"), "ok", "n_tied")


@query(
    "stratified_split",
    f"""WITH {FLOWS_SQL}, h AS (SELECT *, CAST('0x' || substr(md5('42|' || {_KEY_TEXT}), 1, 8) AS BIGINT) AS h FROM flows),
r AS (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY h, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS rk,
        count(*) OVER (PARTITION BY "Label") AS n FROM h)
SELECT "Label" AS label, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN rk < CASE WHEN n >= 2 THEN least(greatest(floor(n * 2e-1 + 5e-1), 1), n - 1) ELSE floor(n * 2e-1 + 5e-1) END THEN 'test' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, sf_dir):
    rows = flows(spark, sf_dir).select("Label", *FLOW_KEY)
    out = sp.stratified_split(rows, "Label", FLOW_KEY_HASHED, test=0.2)
    return out.select(F.col("Label").alias("label"), *_HASH_KEY, "split")


@query(
    "random_split",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN CAST('0x' || substr(md5('42|' || {_KEY_TEXT}), 1, 8) AS BIGINT) / 4294967296e0 < 2e-1 THEN 'test' ELSE 'train' END AS split FROM lineitem""",
)
def random_split(spark, sf_dir):
    return sp.random_split(table(spark, sf_dir, "lineitem").select(*_HASH_KEY), _HASH_KEY)


@query("ordered_stream", f"WITH {SCORED_SQL} SELECT pos, event_id, value, y_true FROM scored")
def ordered_stream(spark, sf_dir):
    rows = scored(spark, sf_dir).select("event_id", "ts", "value", "y_true")
    return sp.ordered_stream(rows, ["ts", "event_id"]).select("pos", "event_id", "value", "y_true")


@query(
    "position_batches",
    f"""WITH {SCORED_SQL} SELECT CAST(floor(pos / 300) AS BIGINT) AS batch, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS n_rows FROM scored GROUP BY 1""",
)
def position_batches(spark, sf_dir):
    return sp.batch_bounds(scored(spark, sf_dir).select("pos"), 300)


def _text(c):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.transform(x, lambda v: v.cast("long").cast("string")))), ",")


@query(
    "sequence_windows",
    f"""WITH {SCORED_SQL}, s AS (
  SELECT user_id, pos, y_true AS label, row_number() OVER w AS rn,
    string_agg(k || ':' || CAST(round(value * 100) AS BIGINT), ',') OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS sequence
  FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, pos, sequence, label FROM s WHERE rn > 5""",
)
def sequence_windows(spark, sf_dir):
    rows = scored(spark, sf_dir).select("user_id", "pos", "k", F.round(F.col("value") * 100).alias("cents"), "y_true")
    out = sp.sequence_windows(rows, ["user_id"], ["pos"], ["k", "cents"], "y_true", 5)
    return out.withColumn("sequence", _text(F.col("sequence")))


@query(
    "sequence_padding",
    """WITH c AS (SELECT conv_id, turn, length(text) AS len, role, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT conv_id, max(turn) AS turn, max(n) AS n, string_agg(len || ':' || turn, ',' ORDER BY turn) AS seq, arg_max(role, turn) AS label FROM c GROUP BY 1)
SELECT conv_id, turn, repeat('0:0,', CAST(8 - n AS BIGINT)) || seq AS sequence, label FROM s WHERE n < 8""",
)
def sequence_padding(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("len"), F.col("turn").alias("t"), "role")
    out = sp.padded_short_streams(rows, ["conv_id"], ["turn"], ["len", "t"], "role", 8, label_offset=0)
    return out.withColumn("sequence", _text(F.col("sequence")))


FLOW_KEY_HASHED = _HASH_KEY
