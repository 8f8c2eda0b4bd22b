"""Registered queries: packets to flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import flows as fl
from tidemark.plans.registry import query
from tidemark.plans.views import PACKETS_SQL, packets

GAP_S = 21600
_DIRECTED = "src, dst, srcport, dstport, proto"
_PAIR = "a_host, a_port, b_host, b_port, proto"


def _in_micros(name):
    return "IAT" in name or name == "Flow Duration" or name.startswith("iat_")


def _rounded(df):
    """Times as seconds with 3 digits (a double cannot hold more here), the rest with 6."""

    def cell(n, t):
        c = F.col(f"`{n}`")
        if t != "double":
            return c
        return (F.round(c / 1e6, 3) if _in_micros(n) else F.round(c, 6)).alias(n)

    return df.select(*[cell(n, t) for n, t in df.dtypes])


_GAPS_SQL = f"""{PACKETS_SQL},
gaps AS (SELECT *, ("time" - lag("time") OVER (PARTITION BY {_DIRECTED} ORDER BY "time", packet_id)) * 1e6 AS iat FROM packets)"""


@query(
    "flow_aggregate",
    f"""WITH {PACKETS_SQL}, f AS (SELECT {_DIRECTED}, (max("time") - min("time")) * 1e6 AS d, count(*) AS n, sum(length) AS s, max(length) AS mx, min(length) AS mn,
  avg(length) AS av, stddev_pop(length) AS sd, var_pop(length) AS va, min("time") AS t0 FROM packets GROUP BY ALL)
SELECT {_DIRECTED}, round(d / 1e6, 3) AS "Flow Duration", n AS "Total Fwd Packets", CAST(0 AS BIGINT) AS "Total Backward Packets", round(s, 6) AS "Total Length of Fwd Packets",
  0e0 AS "Total Length of Bwd Packets", round(mx, 6) AS "Fwd Packet Length Max", round(mn, 6) AS "Fwd Packet Length Min", round(av, 6) AS "Fwd Packet Length Mean",
  round(sd, 6) AS "Fwd Packet Length Std", round(CASE WHEN d / 1e6 = 0 THEN 0e0 ELSE s / (d / 1e6) END, 6) AS "Flow Bytes/s",
  round(CASE WHEN d / 1e6 = 0 THEN 0e0 ELSE n / (d / 1e6) END, 6) AS "Flow Packets/s", round(va, 6) AS "Packet Length Variance", round(t0, 6) AS "Timestamp" FROM f""",
)
def flow_aggregate(spark, sf_dir):
    out = fl.aggregate_flows(packets(spark, sf_dir))
    names = [
        "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets",
        "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std", "Flow Bytes/s",
        "Flow Packets/s", "Packet Length Variance", "Timestamp",
    ]
    return _rounded(out.select(*fl.DIRECTED_KEY, *[F.col(f"`{n}`") for n in names]))


@query(
    "flow_iat",
    f"""WITH {_GAPS_SQL} SELECT {_DIRECTED}, round(COALESCE(avg(iat), 0e0) / 1e6, 3) AS iat_mean, round(COALESCE(stddev_pop(iat), 0e0) / 1e6, 3) AS iat_std,
  round(COALESCE(max(iat), 0e0) / 1e6, 3) AS iat_max, round(COALESCE(min(iat), 0e0) / 1e6, 3) AS iat_min, round(COALESCE(sum(iat), 0e0) / 1e6, 3) AS iat_total FROM gaps GROUP BY ALL""",
)
def flow_iat(spark, sf_dir):
    out = fl.aggregate_flows(packets(spark, sf_dir))
    names = {"iat_mean": "Flow IAT Mean", "iat_std": "Flow IAT Std", "iat_max": "Flow IAT Max", "iat_min": "Flow IAT Min", "iat_total": "Fwd IAT Total"}
    return _rounded(out.select(*fl.DIRECTED_KEY, *[F.col(f"`{v}`").alias(k) for k, v in names.items()]))


@query(
    "flow_flags",
    f"WITH {PACKETS_SQL} SELECT {_DIRECTED}, "
    + ", ".join(f'count(*) FILTER (WHERE flags & {b} <> 0) AS "{n} Flag Count"' for n, b in fl.TCP_FLAGS)
    + " FROM packets GROUP BY ALL",
)
def flow_flags(spark, sf_dir):
    out = fl.aggregate_flows(packets(spark, sf_dir))
    return out.select(*fl.DIRECTED_KEY, *[f"`{n} Flag Count`" for n, _ in fl.TCP_FLAGS])


@query(
    "flow_first_window",
    f"WITH {PACKETS_SQL} SELECT {_DIRECTED}, COALESCE(arg_min(win, packet_id) FILTER (WHERE win IS NOT NULL), 0e0) AS first_window FROM packets GROUP BY ALL",
)
def flow_first_window(spark, sf_dir):
    return fl.aggregate_flows(packets(spark, sf_dir)).select(*fl.DIRECTED_KEY, F.col("Init_Win_bytes_forward").alias("first_window"))


_ENDS_SQL = f"""{PACKETS_SQL},
ends AS (SELECT *, (src, srcport) > (dst, dstport) AS up FROM packets),
pairs AS (SELECT packet_id, "time", src, dst, srcport, dstport, proto, length, flags, win,
  CASE WHEN up THEN src ELSE dst END AS a_host, CASE WHEN up THEN srcport ELSE dstport END AS a_port,
  CASE WHEN up THEN dst ELSE src END AS b_host, CASE WHEN up THEN dstport ELSE srcport END AS b_port FROM ends),
prev AS (SELECT *, lag("time") OVER (PARTITION BY {_PAIR} ORDER BY "time", packet_id) AS prev FROM pairs),
marked AS (SELECT *, CASE WHEN prev IS NULL OR "time" - prev > {GAP_S} THEN 1 ELSE 0 END AS fresh FROM prev),
sess AS (SELECT *, sum(fresh) OVER (PARTITION BY {_PAIR} ORDER BY "time", packet_id) AS flow_no FROM marked)"""


@query(
    "flow_bidirectional",
    f"""WITH {_ENDS_SQL}, f AS (SELECT {_PAIR}, arg_min(src, packet_id) AS src_ip, count(*) FILTER (WHERE src = a_host) AS na, count(*) FILTER (WHERE src <> a_host) AS nb,
  COALESCE(sum(length) FILTER (WHERE src = a_host), 0e0) AS ba, COALESCE(sum(length) FILTER (WHERE src <> a_host), 0e0) AS bb FROM pairs GROUP BY ALL)
SELECT {_PAIR}, src_ip, CASE WHEN src_ip = a_host THEN na ELSE nb END AS fwd_packets, CASE WHEN src_ip = a_host THEN nb ELSE na END AS bwd_packets,
  round(CASE WHEN src_ip = a_host THEN ba ELSE bb END, 6) AS fwd_bytes, round(CASE WHEN src_ip = a_host THEN bb ELSE ba END, 6) AS bwd_bytes FROM f""",
)
def flow_bidirectional(spark, sf_dir):
    out = fl.bidirectional_flows(packets(spark, sf_dir), None)
    return _rounded(out.select(*fl.PAIR_KEY, "src_ip", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes"))


@query(
    "flow_sessions",
    f"""WITH {_ENDS_SQL} SELECT {_PAIR}, CAST(flow_no AS BIGINT) AS flow_no, count(*) AS n_packets, round(min("time"), 6) AS start_time, round(max("time"), 6) AS last_time
FROM sess GROUP BY ALL""",
)
def flow_sessions(spark, sf_dir):
    out = fl.bidirectional_flows(packets(spark, sf_dir), GAP_S)
    return _rounded(out.select(*fl.PAIR_KEY, "flow_no", "n_packets", "start_time", "last_time"))


_D = "(max(\"time\") - min(\"time\")) * 1e6"
_RATE = f"CASE WHEN ({_D}) / 1e6 = 0 THEN 0e0 ELSE {{x}} / (({_D}) / 1e6) END"
_IAT = "CASE WHEN fresh = 0 THEN (\"time\" - prev) * 1e6 END"


def _dbl(expr, name):
    value = f"({expr}) / 1e6, 3" if _in_micros(name) else f"CAST({expr} AS DOUBLE), 6"
    return f'round({value}) AS "{name}"'


_FEATURES_SQL = ", ".join(
    [
        _dbl(_D, "Flow Duration"),
        *[_dbl("max(length)", n) for n in ("Fwd Packet Length Max", "Max Packet Length")],
        *[_dbl("min(length)", n) for n in ("Fwd Packet Length Min", "Min Packet Length")],
        *[_dbl("avg(length)", n) for n in ("Fwd Packet Length Mean", "Packet Length Mean", "Average Packet Size")],
        *[_dbl("stddev_pop(length)", n) for n in ("Fwd Packet Length Std", "Packet Length Std")],
        _dbl("var_pop(length)", "Packet Length Variance"),
        _dbl(_RATE.format(x="sum(length)"), "Flow Bytes/s"),
        _dbl(_RATE.format(x="count(*)"), "Flow Packets/s"),
        *[_dbl(f"COALESCE({a}({_IAT}), 0e0)", f"{side} IAT {n}") for side in ("Flow", "Fwd") for a, n in (("avg", "Mean"), ("stddev_pop", "Std"), ("max", "Max"), ("min", "Min"))],
        _dbl(f"COALESCE(sum({_IAT}), 0e0)", "Fwd IAT Total"),
        *[_dbl(f"count(*) FILTER (WHERE flags & {b} <> 0)", f"{n} Flag Count") for n, b in fl.TCP_FLAGS if n != "URG"],
        _dbl("arg_min(dstport, packet_id)", "Destination Port"),
        _dbl("arg_min(srcport, packet_id)", "Source Port"),
        _dbl("proto", "Protocol"),
    ]
)


@query(
    "flow_features",
    f"""WITH {_ENDS_SQL}, f AS (SELECT {_PAIR}, CAST(flow_no AS BIGINT) AS flow_no, arg_min(src, packet_id) AS s0, {_FEATURES_SQL},
  count(*) FILTER (WHERE src = a_host) AS na, count(*) FILTER (WHERE src <> a_host) AS nb,
  COALESCE(sum(length) FILTER (WHERE src = a_host), 0e0) AS ba, COALESCE(sum(length) FILTER (WHERE src <> a_host), 0e0) AS bb FROM sess GROUP BY ALL)
SELECT * EXCLUDE (s0, na, nb, ba, bb), CAST(CASE WHEN s0 = a_host THEN na ELSE nb END AS DOUBLE) AS "Total Fwd Packets",
  CAST(CASE WHEN s0 = a_host THEN nb ELSE na END AS DOUBLE) AS "Total Backward Packets",
  round(CASE WHEN s0 = a_host THEN ba ELSE bb END, 6) AS "Total Length of Fwd Packets", round(CASE WHEN s0 = a_host THEN bb ELSE ba END, 6) AS "Total Length of Bwd Packets" FROM f""",
)
def flow_features(spark, sf_dir):
    out = fl.flow_features(packets(spark, sf_dir), GAP_S)
    return _rounded(out.drop("src_ip", "dst_ip", "start_time", "last_time", "n_packets"))
