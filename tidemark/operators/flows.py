"""Packets to flows: directed aggregation, both directions, idle time-out, feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import col, finite, ratio
from tidemark.operators.ordering import look_back, running

# Flag bits of the TCP header and the names of the scored features.
TCP_FLAGS = (("SYN", 0x02), ("ACK", 0x10), ("FIN", 0x01), ("RST", 0x04), ("PSH", 0x08), ("URG", 0x20))
SCORED_FEATURES = (
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean",
    "Fwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max",
    "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Min Packet Length",
    "Max Packet Length", "Packet Length Mean", "Packet Length Std", "Packet Length Variance", "Average Packet Size",
    "SYN Flag Count", "ACK Flag Count", "FIN Flag Count", "RST Flag Count", "PSH Flag Count", "Destination Port",
    "Source Port", "Protocol",
)
DIRECTED_KEY = ["src", "dst", "srcport", "dstport", "proto"]
PAIR_KEY = ["a_host", "a_port", "b_host", "b_port", "proto"]
ORDER = ["time", "packet_id"]
IDLE_TIMEOUT_S = 30.0


def _whole(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0)
    return F.coalesce(col(name).try_cast("double").try_cast("int"), F.lit(0))


def _flag_bits(df: DataFrame) -> Column:
    """Flag field as a number: hexadecimal text or a whole number, NULL when unreadable."""
    if "flags" not in df.columns:
        return F.lit(None).cast("long")
    if not isinstance(df.schema["flags"].dataType, T.StringType):
        return col("flags").cast("long")
    digits = F.regexp_extract(F.lower(F.trim(col("flags"))), "^(?:0x)?([0-9a-f]{1,8})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def tidy_packets(packets: DataFrame) -> DataFrame:
    """Merge TCP and UDP ports, read numbers and flags; bad ports and lengths become 0."""
    return packets.select(
        "packet_id",
        finite(col("time").try_cast("double")).alias("time"),
        "src",
        "dst",
        (_whole(packets, "tcp_srcport") + _whole(packets, "udp_srcport")).alias("srcport"),
        (_whole(packets, "tcp_dstport") + _whole(packets, "udp_dstport")).alias("dstport"),
        "proto",
        F.coalesce(finite(col("length").try_cast("double")), F.lit(0.0)).alias("length"),
        _flag_bits(packets).alias("flags"),
        (finite(col("window").try_cast("double")) if "window" in packets.columns else F.lit(None).cast("double")).alias("window"),
    )


def with_endpoints(tidy: DataFrame) -> DataFrame:
    """Order the two end points, so both directions share one key."""
    one, two = F.struct(col("src").alias("host"), col("srcport").alias("port")), F.struct(col("dst").alias("host"), col("dstport").alias("port"))
    ends = tidy.withColumn("_a", F.when(one > two, one).otherwise(two)).withColumn("_b", F.when(one > two, two).otherwise(one))
    return ends.select(
        "*", F.col("_a.host").alias("a_host"), F.col("_a.port").alias("a_port"), F.col("_b.host").alias("b_host"), F.col("_b.port").alias("b_port")
    ).drop("_a", "_b")


def with_gaps(tidy: DataFrame, key: list[str], **kw) -> DataFrame:
    """Time of the packet before, inside the same key."""
    return look_back(tidy, key, ORDER, 1, lambda w: {"_prev": F.lag("time").over(w)}, **kw)


def _length_stats() -> dict[str, Column]:
    n, total = F.count(F.lit(1)), F.sum("length")
    seconds = F.max("time") - F.min("time")
    return {
        "Flow Duration": seconds * 1e6,
        "n_packets": n,
        "_bytes": total,
        "_len_max": F.max("length"),
        "_len_min": F.min("length"),
        "_len_mean": F.avg("length"),
        "_len_std": F.stddev_pop("length"),
        "_len_var": F.var_pop("length"),
        "start_time": F.min("time"),
    }


def _iat_stats(iat: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "_iat_mean": F.coalesce(F.avg(iat), zero),
        "_iat_std": F.coalesce(F.stddev_pop(iat), zero),
        "_iat_max": F.coalesce(F.max(iat), zero),
        "_iat_min": F.coalesce(F.min(iat), zero),
        "_iat_total": F.coalesce(F.sum(iat), zero),
    }


def _flag_counts() -> dict[str, Column]:
    bit = lambda b: F.count_if(F.col("flags").bitwiseAND(F.lit(b)) != 0)
    return {f"{name} Flag Count": bit(b) for name, b in TCP_FLAGS}


def first_window() -> Column:
    """First readable TCP window of the flow."""
    known = F.col("window").isNotNull()
    return F.coalesce(F.min_by("window", F.when(known, F.struct("time", "packet_id"))), F.lit(0.0))


def _named(forward_only: bool) -> dict[str, Column]:
    c, zero = F.col, F.lit(0.0)
    rate = lambda x: ratio(x, c("`Flow Duration`") / 1e6)
    fwd = {
        "Total Fwd Packets": c("n_packets") if forward_only else c("fwd_packets"),
        "Total Backward Packets": F.lit(0).cast("long") if forward_only else c("bwd_packets"),
        "Total Length of Fwd Packets": c("_bytes") if forward_only else c("fwd_bytes"),
        "Total Length of Bwd Packets": zero if forward_only else c("bwd_bytes"),
    }
    return {
        "Flow Duration": c("`Flow Duration`"),
        **fwd,
        "Fwd Packet Length Max": c("_len_max"),
        "Fwd Packet Length Min": c("_len_min"),
        "Fwd Packet Length Mean": c("_len_mean"),
        "Fwd Packet Length Std": c("_len_std"),
        "Flow Bytes/s": rate(c("_bytes")),
        "Flow Packets/s": rate(c("n_packets")),
        **{f"Flow IAT {s}": c(f"_iat_{s.lower()}") for s in ("Mean", "Std", "Max", "Min")},
        **{f"Fwd IAT {s}": c(f"_iat_{s.lower()}") for s in ("Total", "Mean", "Std", "Max", "Min")},
        "Min Packet Length": c("_len_min"),
        "Max Packet Length": c("_len_max"),
        "Packet Length Mean": c("_len_mean"),
        "Packet Length Std": c("_len_std"),
        "Packet Length Variance": c("_len_var"),
        "Average Packet Size": c("_len_mean"),
        **{f"{n} Flag Count": c(f"`{n} Flag Count`") for n, _ in TCP_FLAGS},
    }


def aggregate_flows(packets: DataFrame, **kw) -> DataFrame:
    """One row per directed five-tuple with the full set of flow features."""
    gaps = with_gaps(tidy_packets(packets), DIRECTED_KEY, **kw)
    iat = (F.col("time") - F.col("_prev")) * 1e6
    measures = {**_length_stats(), **_iat_stats(iat), **_flag_counts(), "Init_Win_bytes_forward": first_window()}
    flows = gaps.groupBy(*DIRECTED_KEY).agg(*[c.alias(n) for n, c in measures.items()])
    return flows.select(
        *DIRECTED_KEY, *[c.alias(n) for n, c in _named(True).items()],
        "Init_Win_bytes_forward", F.lit(0.0).alias("Init_Win_bytes_backward"), F.col("start_time").alias("Timestamp"),
    )


def with_sessions(packets: DataFrame, timeout_s: float = IDLE_TIMEOUT_S, **kw) -> DataFrame:
    """Number the flows of each end point pair: a silence longer than the time-out starts a new one."""
    gaps = with_gaps(with_endpoints(tidy_packets(packets)), PAIR_KEY, **kw)
    starts = F.col("_prev").isNull() | (F.col("time") - F.col("_prev") > F.lit(float(timeout_s)))
    marked = gaps.withColumn("_start", starts.cast("long"))
    return running(marked, PAIR_KEY, ORDER, {"flow_no": ("sum", F.col("_start"))}, **kw)


def bidirectional_flows(packets: DataFrame, timeout_s: float | None = IDLE_TIMEOUT_S, **kw) -> DataFrame:
    """Flows with both directions; forward is the direction of the first packet.

    Both hosts' totals are kept and swapped at the end, so one aggregation suffices.
    Without a time-out every end point pair is one flow.
    """
    if timeout_s is None:
        gaps = with_gaps(with_endpoints(tidy_packets(packets)), PAIR_KEY, **kw)
        rows = gaps.withColumn("flow_no", F.lit(1).cast("long")).withColumn("_start", F.col("_prev").isNull().cast("long"))
    else:
        rows = with_sessions(packets, timeout_s, **kw)
    iat = F.when(F.col("_start") == 0, (F.col("time") - F.col("_prev")) * 1e6)
    from_a = F.col("src") == F.col("a_host")
    first = lambda c: F.min_by(c, F.struct("time", "packet_id"))
    measures = {
        **_length_stats(), **_iat_stats(iat), **_flag_counts(), "Init_Win_bytes_forward": first_window(),
        "_n_a": F.count_if(from_a), "_n_b": F.count_if(~from_a),
        "_bytes_a": F.sum(F.when(from_a, F.col("length")).otherwise(0.0)),
        "_bytes_b": F.sum(F.when(from_a, F.lit(0.0)).otherwise(F.col("length"))),
        "src_ip": first("src"), "dst_ip": first("dst"), "src_port": first("srcport"), "dst_port": first("dstport"),
        "last_time": F.max("time"),
    }
    flows = rows.groupBy(*PAIR_KEY, "flow_no").agg(*[c.alias(n) for n, c in measures.items()])
    a_first = F.col("src_ip") == F.col("a_host")
    pick = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    return flows.withColumns({
        "fwd_packets": pick("_n_a", "_n_b"), "bwd_packets": pick("_n_b", "_n_a"),
        "fwd_bytes": pick("_bytes_a", "_bytes_b"), "bwd_bytes": pick("_bytes_b", "_bytes_a"),
    })


def flow_features(packets: DataFrame, timeout_s: float | None = IDLE_TIMEOUT_S, **kw) -> DataFrame:
    """The feature vector a model scores, one row per completed flow."""
    flows = bidirectional_flows(packets, timeout_s, **kw)
    named = {
        **_named(False), "Destination Port": F.col("dst_port"), "Source Port": F.col("src_port"), "Protocol": F.col("proto")
    }
    return flows.select(
        "src_ip", "dst_ip", *PAIR_KEY, "flow_no", "start_time", "last_time", "n_packets",
        *[named[n].cast("double").alias(n) for n in SCORED_FEATURES],
    )
