import numpy as np
import pandas as pd
import pytest

from tidemark.operators import flows as fl

SCHEMA = (
    "packet_id long, time double, src string, dst string, tcp_srcport string, tcp_dstport string, udp_srcport string, "
    "udp_dstport string, proto int, length string, flags string, window string"
)


def packet(i, t, src, dst, sport="1000", dport="443", length="100", flags="0x10", window="8", udp=False):
    ports = (None, None, sport, dport) if udp else (sport, dport, None, None)
    return (i, float(t), src, dst, *ports, 17 if udp else 6, length, flags, window)


def test_directed_flow_features(spark):
    rows = [
        packet(0, 10.0, "a", "b", flags="0x02", window=None),
        packet(1, 10.5, "a", "b", length="300", flags="zz", window="77"),
        packet(2, 12.5, "a", "b", length="bad", flags="0x3f"),
        packet(3, 11.0, "b", "a", sport="443", dport="1000", flags=None),
        packet(4, 11.0, "c", "d", sport="53", dport=None, udp=True),
    ]
    got = {(r["src"], r["dst"]): r for r in fl.aggregate_flows(spark.createDataFrame(rows, SCHEMA)).collect()}
    f = got[("a", "b")]
    assert f["Flow Duration"] == 2.5e6 and f["Total Fwd Packets"] == 3 and f["Total Backward Packets"] == 0
    assert f["Total Length of Fwd Packets"] == 400 and f["Flow Bytes/s"] == 160 and f["Min Packet Length"] == 0
    assert f["Fwd Packet Length Std"] == pytest.approx(np.std([100, 300, 0]))
    assert (f["Flow IAT Mean"], f["Flow IAT Max"], f["Flow IAT Min"], f["Fwd IAT Total"]) == (1.25e6, 2e6, 0.5e6, 2.5e6)
    assert f["Flow IAT Std"] == pytest.approx(np.std([0.5e6, 2e6]))
    assert [f[f"{n} Flag Count"] for n, _ in fl.TCP_FLAGS] == [2, 1, 1, 1, 1, 1]
    assert f["Init_Win_bytes_forward"] == 77
    single = got[("c", "d")]
    assert single["Flow Duration"] == 0 and single["Flow Bytes/s"] == 0 and single["Flow IAT Mean"] == 0
    assert (single["srcport"], single["dstport"], single["proto"]) == (53, 0, 17)


def test_integer_flags_and_missing_columns(spark):
    df = spark.createDataFrame([(0, 1.0, "a", "b", 6, 5.0, 0x12)], "packet_id long, time double, src string, dst string, proto int, length double, flags int")
    f = fl.aggregate_flows(df).first()
    assert f["SYN Flag Count"] == 1 and f["ACK Flag Count"] == 1 and f["srcport"] == 0 and f["Init_Win_bytes_forward"] == 0


def test_both_directions_and_the_idle_boundary(spark):
    back = dict(sport="443", dport="1000")
    rows = [
        packet(0, 0, "a", "b"), packet(1, 1, "b", "a", **back), packet(2, 31, "a", "b"),  # exactly the time-out: same flow
        packet(3, 61.5, "b", "a", **back), packet(4, 62, "a", "b", length="7"),  # longer: a new flow, now started by b
    ]
    got = fl.bidirectional_flows(spark.createDataFrame(rows, SCHEMA), 30).orderBy("flow_no").collect()
    assert [(r["src_ip"], r["fwd_packets"], r["bwd_packets"], r["flow_no"]) for r in got] == [("a", 2, 1, 1), ("b", 1, 1, 2)]
    assert got[1]["bwd_bytes"] == 7 and got[1]["start_time"] == 61.5
    whole = fl.bidirectional_flows(spark.createDataFrame(rows, SCHEMA), None).first()
    assert (whole["fwd_packets"], whole["bwd_packets"]) == (3, 2)


def test_feature_vector_against_a_loop_with_a_hot_pair(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i, t in enumerate(np.cumsum(rng.choice([1, 5, 40], 400))):
        src, dst = ("a", "b") if rng.random() < 0.6 else (f"h{rng.integers(4)}", "b")
        rows.append(packet(i, t, src, dst, length=str(rng.integers(40, 1500)), flags=hex(rng.integers(0, 64))))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["src_ip"], r["flow_no"]): r for r in fl.flow_features(df, 30, chunk_rows=17).collect()}
    pdf = pd.DataFrame([(r[2], r[1], float(r[9]), int(r[10], 16)) for r in rows], columns=["src", "t", "len", "flags"])
    n = 0
    for src, g in pdf.groupby("src"):
        no = (g["t"].diff().fillna(1e9) > 30).cumsum()
        for k, s in g.groupby(no):
            r, n = got[(src, k)], n + 1
            iat = np.diff(s["t"]) * 1e6 if len(s) > 1 else np.array([0.0])
            assert r["Total Fwd Packets"] == len(s) and r["Total Length of Fwd Packets"] == s["len"].sum()
            assert r["Fwd IAT Mean"] == pytest.approx(iat.mean()) and r["Flow IAT Std"] == pytest.approx(iat.std())
            assert r["Packet Length Variance"] == pytest.approx(s["len"].var(ddof=0), abs=1e-6)
            assert r["SYN Flag Count"] == ((s["flags"] & 2) > 0).sum()
    assert n == len(got) and len(fl.SCORED_FEATURES) == 34
