import math
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import adapt as ad
from tidemark.operators import detect as dt
from tidemark.operators import rounds
from tidemark.operators.detectors import Adwin, Ddm, Eddm, PageHinkley, create


class PlainAdwin:
    """One value at a time, buckets merged after every value, cuts tested in a plain loop."""

    def __init__(self, delta=0.002, clock=32, most=5, shortest=5, grace=10):
        self.delta, self.clock, self.most, self.shortest, self.grace = delta, clock, most, shortest, grace
        self.buckets = []  # (size, values), oldest first
        self.seen = 0

    def update(self, x):
        self.seen += 1
        self.buckets.append((1, [x]))
        size = 1
        while True:
            same = [i for i, b in enumerate(self.buckets) if b[0] == size]
            if len(same) <= self.most:
                break
            i, j = same[0], same[1]
            self.buckets[i : j + 1] = [(2 * size, self.buckets[i][1] + self.buckets[j][1])]
            size *= 2
        if self.seen % self.clock or self.width() <= self.grace:
            return False
        cut = False
        while self._differs():
            self.buckets.pop(0)
            cut = True
        return cut

    def width(self):
        return sum(b[0] for b in self.buckets)

    def _differs(self):
        values = np.concatenate([b[1] for b in self.buckets])
        n, var = len(values), values.var()
        d = math.log(2 * math.log(n) / self.delta)
        at = 0
        for size, _ in self.buckets[:-1]:
            at += size
            if at < self.shortest or n - at < self.shortest:
                continue
            m = 1 / (at - self.shortest + 1) + 1 / (n - at - self.shortest + 1)
            if abs(values[:at].mean() - values[at:].mean()) > math.sqrt(2 * m * var * d) + 2 / 3 * d * m:
                return True
        return False


def step_stream(seed=0, before=500, after=500, low=0.05, high=0.6):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.random(before) < low, rng.random(after) < high]).astype(float)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("pieces", [1, 3, 37])
def test_adwin_equals_the_plain_loop_however_it_is_fed(seed, pieces):
    x = np.concatenate([step_stream(seed), np.random.default_rng(seed).random(700)])
    plain = PlainAdwin()
    want = [i for i, v in enumerate(x) if plain.update(v)]
    fast, got, at = Adwin(), [], 0
    for part in np.array_split(x, pieces):
        got += [at + i for i, _ in fast.scan(part)]
        at += len(part)
    assert got == want and len(want) > 0
    assert fast.width == plain.width()


def test_adwin_detects_a_jump_soon_after_it_and_rests_on_constants():
    found = [i for i, _ in Adwin().scan(step_stream(3))]
    assert found and 500 <= found[0] < 640
    assert list(Adwin().scan(np.zeros(2000))) == [] and list(Adwin().scan(np.ones(2000))) == []
    assert list(Adwin().scan(np.array([]))) == []


@pytest.mark.parametrize("cls", [Ddm, Eddm])
def test_error_detectors_fire_after_the_jump(cls):
    found = [i for i, s in cls().scan(step_stream(5)) if s == "drift"]
    assert any(500 <= i < 700 for i in found)


def test_page_hinkley_and_names():
    x = np.concatenate([np.zeros(300), np.ones(400) * 5])
    found = [i for i, _ in PageHinkley().scan(x)]
    assert found and found[0] >= 300
    assert isinstance(create("PH"), PageHinkley) and isinstance(create("confidence"), Adwin)
    with pytest.raises(ValueError):
        create("nothing")


def streams(spark):
    rows, at = [], 0
    for key, n in (("hot", 2500), ("a", 700), ("b", 40), ("c", 1)):
        x = step_stream(len(key) + n, n // 2, n - n // 2)
        rows += [(key, i * 3, float(v)) for i, v in enumerate(x)]
    return pd.DataFrame(rows, columns=["key", "pos", "err"])


@pytest.mark.parametrize("method", ["adwin", "ddm", "eddm", "page_hinkley"])
def test_turns_do_not_change_the_result(spark, method):
    pdf = streams(spark)
    df = spark.createDataFrame(pdf).repartition(5)
    params = {"threshold": 5.0} if method == "page_hinkley" else {}
    columns = ["key", "pos", "state", "n_seen", "n_drifts", "window_size", "estimation"]
    found = {
        c: sorted(tuple(r) for r in dt.detect(df, ["key"], ["pos"], "err", method, params, states=("drift", "warning"), chunk_rows=c).select(columns).collect())
        for c in (300, 100_000)
    }
    assert found[300] == found[100_000]
    want = []
    for key, g in pdf.groupby("key"):
        d = create(method, **params)
        for i, s in d.scan(g["err"].to_numpy()):
            want.append((key, int(g["pos"].iloc[i]), s))
    assert [r[:3] for r in found[300]] == sorted(want)
    assert len(want) > 0


def test_first_alarms_equal_the_sequential_detectors(spark):
    pdf = streams(spark)
    df = spark.createDataFrame(pdf).repartition(3)
    cases = [
        (dt.ddm_first_alarm(df, ["key"], ["pos"], "err", chunk_rows=97), Ddm()),
        (dt.eddm_first_alarm(df, ["key"], ["pos"], "err", chunk_rows=97), Eddm()),
        (dt.page_hinkley_first_alarm(df, ["key"], ["pos"], "err", threshold=5.0, chunk_rows=97), PageHinkley(threshold=5.0, alpha=1.0)),
    ]
    for frame, proto in cases:
        got = {r["key"]: r["first_drift"] for r in frame.collect() if r["first_drift"]}
        want = {}
        for key, g in pdf.groupby("key"):
            d = type(proto)(**({"threshold": 5.0, "alpha": 1.0} if isinstance(proto, PageHinkley) else {}))
            hits = [i + 1 for i, s in d.scan(g["err"].to_numpy()) if s == "drift"]
            if hits:
                want[key] = hits[0]
        assert got == want and want


def test_sensitivity_and_unknown_detector(spark):
    x = step_stream(9, 300, 700, 0.05, 0.5)
    df = spark.createDataFrame(pd.DataFrame({"pos": range(len(x)), "err": x}))
    got = {r["delta"]: r for r in dt.sensitivity(df, [], ["pos"], "err", injected=300).collect()}
    assert len(got) == 7 and all(got[d]["n_alarms"] >= 1 for d in ("0.002", "0.5"))
    assert 0 < got["0.002"]["delay"] < 200
    with pytest.raises(ValueError):
        dt.detect(df, [], ["pos"], "err", "nothing")


def test_drift_events_table(spark):
    pdf = streams(spark)
    df = spark.createDataFrame(pdf)
    got = dt.drift_events(df, ["key"], ["pos"], "err", rolling_rows=50).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == [f"drift-{i + 1:06d}" for i in range(len(got))] and got
    for r in got:
        g = pdf[(pdf["key"] == r["key"]) & (pdf["pos"] <= r["pos"])]["err"]
        assert r["context"]["rolling_error"] == pytest.approx(g.tail(50).mean())
        assert r["context"]["cumulative_error"] == pytest.approx(g.mean())
        assert r["detector_state"]["n_seen"] == len(g)


def test_cooldown_period_and_policies(spark):
    drifts = spark.createDataFrame([("s", p) for p in (100, 120, 160, 250)], "key string, pos long")
    for chunk in (1, 2, 1000):
        kept = ad.retrain_cooldown(drifts, ["key"], "pos", 50, chunk_rows=chunk).filter("kept").orderBy("pos").collect()
        assert [r["pos"] for r in kept] == [100, 160, 250] and [r["n_retrains"] for r in kept] == [1, 2, 3]
    stream = spark.range(550).withColumnRenamed("id", "pos").withColumn("y", F.when(F.col("pos") < 300, "A").otherwise("B"))
    assert ad.retrain_periodic(stream, 100).count() == 5
    assert ad.retrain_periodic(spark.range(105).withColumnRenamed("id", "pos"), 10).count() == 10
    g = {r["pos"]: r for r in ad.retrain_guards(stream, ad.retrain_periodic(stream, 100), "y", window_rows=150, minimum=120).collect()}
    assert (g[100]["window_rows"], g[100]["n_classes"], g[100]["retrained"]) == (101, 1, False)
    assert (g[300]["window_rows"], g[300]["n_classes"], g[300]["retrained"]) == (150, 2, True)
    assert (g[500]["window_rows"], g[500]["n_classes"], g[500]["retrained"]) == (150, 1, False)
    c = {r["strategy"]: r for r in ad.compare_policies(stream, drifts.select("pos"), [ad.Static(), ad.Periodic(100), ad.DriftTriggered(50)], "y", 150).collect()}
    assert c["static"]["n_triggered"] == 0 and c["periodic_100"]["n_triggered"] == 5 and c["drift_triggered"]["n_triggered"] == 3


@pytest.mark.parametrize("method,params", [
    ("adwin", {}), ("adwin", {"delta": 0.3, "clock": 7}), ("ddm", {}), ("eddm", {}), ("page_hinkley", {"threshold": 8.0}), ("confidence", {"delta": 0.1}),
])
def test_long_streams_in_rounds_equal_one_task(spark, method, params):
    rng = np.random.default_rng(9)
    n = 1600
    rate = np.where(np.arange(n) % 800 < 450, 0.05, 0.45)
    fraction = method == "confidence"
    rows = []
    for key in ("a", None, "short"):
        for i in range(n if key != "short" else 90):
            rows.append((key, i, float(np.round(rng.random(), 3)) * (1 if rate[i] > 0.1 else 0.3) if fraction else float(rng.random() < rate[i])))
    df = spark.createDataFrame(rows, "key string, pos long, err double").repartition(5)
    columns = ["key", "pos", "state", "n_seen", "n_drifts", "window_size", F.round("estimation", 6)]
    grid = {"one": params, "two": params | ({"delta": 0.02} if method == "adwin" else {})}
    # the plain way: one value after the other
    expected = {}
    for key in ("a", None, "short"):
        for label, p in grid.items():
            d = create(method, **p)
            for i, (_, pos, err) in enumerate(r for r in rows if r[0] == key):
                for _, state in d.scan(np.array([err])):
                    expected[label, key, pos, state, d.n_seen, d.n_drifts, d.width] = d.estimate
    assert sum(e[3] == "drift" for e in expected) >= 4
    for chunk in (10_000, 430):
        got = dt.detect(df, ["key"], ["pos"], "err", method, grid=grid, states=("drift", "warning"), chunk_rows=chunk).select("config", *columns).collect()
        assert {tuple(r)[:-1] for r in got} == set(expected) and len(got) == len(expected)
        assert all(r[-1] == pytest.approx(expected[tuple(r)[:-1]], abs=1e-5) for r in got)


def test_a_detector_carried_over_a_chunk_is_where_a_scan_leaves_it():
    rng = np.random.default_rng(2)
    for method in ("adwin", "ddm", "eddm", "page_hinkley"):
        for first in (0, 5, 77, 400):
            values = rng.random(900) if method == "page_hinkley" else (np.arange(900) % 5 == 0).astype(float)
            scanned, carried = create(method), create(method)
            for d in (scanned, carried):
                assert not any(s == "drift" for _, s in d.scan(values[:first]))
            assert not any(s == "drift" for _, s in scanned.scan(values[first:]))
            start = pickle.loads(pickle.dumps(carried))
            for phase in range(len(start.carried)):
                carried.absorb(start.measure(values[first:], phase), phase)
            mine, theirs = vars(carried), vars(scanned)
            if method == "adwin":
                assert [len(x) for x in carried.levels] == [len(x) for x in scanned.levels] and carried.levels == scanned.levels
            for name in {f for fields in carried.carried for f in fields} - {"levels"}:
                assert mine[name] == pytest.approx(theirs[name]), (method, name)


def test_a_stream_takes_no_more_rounds_than_chunks(spark, monkeypatch):
    """Many drifts in one chunk are one round's work, for all configurations at once."""
    written, write = [], rounds.materialize
    monkeypatch.setattr(rounds, "materialize", lambda df, label, **kw: written.append(label) or write(df, label, **kw))
    values = np.repeat(np.arange(40) % 2, 64).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"pos": range(len(values)), "err": values})).withColumn("ts", F.timestamp_seconds("pos"))
    grid = {"a": {"delta": 0.5}, "b": {"delta": 0.01}}
    got = dt.detect(df, [], ["ts", "pos"], "err", grid=grid, chunk_rows=900).filter("unix_seconds(ts) = pos").select("config", "pos", "n_drifts").collect()
    want = [(c, i) for c, p in grid.items() for i, _ in create("adwin", **p).scan(values)]
    assert sorted((r["config"], r["pos"]) for r in got) == sorted(want)
    assert max(r["n_drifts"] for r in got) > 3 >= written.count("scanned")
