"""Registered queries: drift injection, retrain policies, active learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import active as al
from tidemark.operators import adapt as ad
from tidemark.operators import detect as dt
from tidemark.operators import inject as inj
from tidemark.operators.ordering import global_position
from tidemark.plans.drift import adwin_sql
from tidemark.plans.registry import query
from tidemark.plans.views import SAMPLES_SQL, SCORED_SQL, samples, scored, table

_FEATURES = ["value", "k"]


def _stream(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "pos", "n", "value", F.col("k").cast("double").alias("k"), "y_true", "event_type")


_DIR = "CASE WHEN CAST('0x' || substr(md5('42|{f}'), 1, 8) AS BIGINT) % 2 = 1 THEN 1e0 ELSE -1e0 END"


def _inject_sql(amount: str, rows: str, magnitude: str) -> str:
    sd = ", ".join(f"stddev_pop({f}) + 1e-10 AS sd_{f}" for f in _FEATURES)
    out = ", ".join(f"round({f} + ({amount}) * {magnitude} * sd_{f} * {_DIR.format(f=f)}, 5) + 0e0 AS {f}" for f in _FEATURES)
    return f"""WITH {SCORED_SQL}, x AS (SELECT event_id, pos, n, value, CAST(k AS DOUBLE) AS k, floor(n * 6e-1) AS p6, floor(n * 4e-1) AS p4, floor(n * 7e-1) AS p7,
  greatest(floor(n * 25e-2), 1) AS per FROM scored), d AS (SELECT {sd} FROM x WHERE {rows}) SELECT event_id, {out} FROM x, d"""


def _out(df):
    return df.select("event_id", *[(F.round(f, 5) + 0.0).alias(f) for f in _FEATURES])


_SUDDEN = ("CASE WHEN pos >= p6 THEN 1e0 ELSE 0e0 END", "pos < p6", "3e-1")
_GRADUAL = ("CASE WHEN pos >= p4 THEN least((pos - p4) / CAST(greatest(p7 - p4, 1) AS DOUBLE), 1e0) ELSE 0e0 END", "pos < p4", "3e-1")
_INCREMENTAL = ("CAST(pos AS DOUBLE) / n", "true", "1e-1")
_RECURRING = ("CASE WHEN CAST(floor(pos / per) AS BIGINT) % 2 = 1 THEN 1e0 ELSE 0e0 END", "true", "3e-1")


@query("drift_sudden", _inject_sql(*_SUDDEN))
def drift_sudden(spark, sf_dir):
    return _out(inj.sudden(_stream(spark, sf_dir), _FEATURES))


@query("drift_gradual", _inject_sql(*_GRADUAL))
def drift_gradual(spark, sf_dir):
    return _out(inj.gradual(_stream(spark, sf_dir), _FEATURES))


@query("drift_incremental", _inject_sql(*_INCREMENTAL))
def drift_incremental(spark, sf_dir):
    return _out(inj.incremental(_stream(spark, sf_dir), _FEATURES))


@query("drift_recurring", _inject_sql(*_RECURRING))
def drift_recurring(spark, sf_dir):
    return _out(inj.recurring(_stream(spark, sf_dir), _FEATURES))


@query(
    "drift_label_flip",
    f"""WITH {SCORED_SQL}, l AS (SELECT list_sort(list(DISTINCT event_type)) AS ls FROM scored),
h AS (SELECT event_id, event_type, pos >= floor(n * 6e-1) AND CAST('0x' || substr(md5('42|' || event_id), 1, 8) AS BIGINT) / 4294967296e0 < 1e-1 AS hit,
  list_filter(ls, lambda x: x <> event_type) AS o, CAST('0x' || substr(md5('43|' || event_id), 1, 8) AS BIGINT) AS b FROM scored, l)
SELECT event_id, CASE WHEN hit THEN o[b % len(o) + 1] ELSE event_type END AS event_type FROM h""",
)
def drift_label_flip(spark, sf_dir):
    return inj.flip_labels(_stream(spark, sf_dir), "event_type", ["event_id"]).select("event_id", "event_type")


def _scenario_sql():
    parts = {"none": ("0e0", "true", "0e0"), "sudden": _SUDDEN, "gradual": _GRADUAL, "incremental": _INCREMENTAL, "recurring": _RECURRING}
    rows = []
    for name, (amount, where, magnitude) in parts.items():
        for f in _FEATURES:
            sd = f"(SELECT stddev_pop({f}) + 1e-10 FROM x WHERE {where})"
            rows.append(
                f"SELECT '{name}' AS scenario, '{f}' AS feature, pos >= p6 AS late, {f} + ({amount}) * {magnitude} * {sd} * {_DIR.format(f=f)} AS v FROM x"
            )
    return f"""WITH {SCORED_SQL}, x AS (SELECT pos, n, value, CAST(k AS DOUBLE) AS k, floor(n * 6e-1) AS p6, floor(n * 4e-1) AS p4, floor(n * 7e-1) AS p7,
  greatest(floor(n * 25e-2), 1) AS per FROM scored), c AS ({' UNION ALL '.join(rows)})
SELECT scenario, feature, count(*) AS n, round(avg(v) FILTER (WHERE NOT late), 6) AS mean_before, round(avg(v) FILTER (WHERE late), 6) AS mean_after,
  round(avg(v) FILTER (WHERE late) - avg(v) FILTER (WHERE NOT late), 6) AS shift FROM c GROUP BY 1, 2"""


@query("drift_scenarios", _scenario_sql())
def drift_scenarios(spark, sf_dir):
    rows = inj.scenarios(_stream(spark, sf_dir), _FEATURES)
    late = F.col("pos") >= F.floor(F.col("n") * F.lit(0.6))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in _FEATURES])
    before, after = F.avg(F.when(~late, F.col("c.v"))), F.avg(F.when(late, F.col("c.v")))
    return rows.select("scenario", "pos", "n", F.explode(cells).alias("c")).groupBy("scenario", F.col("c.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("n"), F.round(before, 6).alias("mean_before"), F.round(after, 6).alias("mean_after"),
        F.round(after - before, 6).alias("shift"),
    )


@query(
    "bernoulli_stream",
    """WITH p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
SELECT pos, CASE WHEN CAST('0x' || substr(md5('42|' || pos), 1, 8) AS BIGINT) / 4294967296e0 < CASE WHEN pos >= floor(n * 6e-1) THEN 4e-1 ELSE 1e-1 END THEN 1 ELSE 0 END AS error FROM p""",
)
def bernoulli_stream(spark, sf_dir):
    rows = global_position(table(spark, sf_dir, "events").select("event_id"), ["event_id"], "pos", "n")
    return inj.bernoulli_errors(rows).select("pos", "error")


# --- retrain policies -------------------------------------------------------------------


@query(
    "retrain_periodic",
    f"WITH {SCORED_SQL} SELECT pos, CAST(pos / 500 AS BIGINT) AS retrain_no FROM scored WHERE pos > 0 AND pos % 500 = 0",
)
def retrain_periodic(spark, sf_dir):
    return ad.retrain_periodic(scored(spark, sf_dir).select("pos"), 500)


@query(
    "retrain_cooldown",
    f"""{adwin_sql(SCORED_SQL, "event_type", "err", "scored", (0.5,))},
d AS (SELECT g AS event_type, pos FROM drifts),
kept(event_type, pos, n_retrains) AS (
  SELECT event_type, min(pos), CAST(1 AS BIGINT) FROM d GROUP BY 1
  UNION ALL
  SELECT k.event_type, (SELECT min(d.pos) FROM d WHERE d.event_type = k.event_type AND d.pos >= k.pos + 300), k.n_retrains + 1
  FROM kept k WHERE EXISTS (SELECT 1 FROM d WHERE d.event_type = k.event_type AND d.pos >= k.pos + 300))
SELECT d.event_type, d.pos, k.pos IS NOT NULL AS kept,
  (SELECT max(n_retrains) FROM kept x WHERE x.event_type = d.event_type AND x.pos <= d.pos) AS n_retrains
FROM d LEFT JOIN kept k ON k.event_type = d.event_type AND k.pos = d.pos""",
)
def retrain_cooldown(spark, sf_dir):
    """Drifts that a lenient ADWIN finds per event type, and which of them may retrain."""
    found = dt.detect(scored(spark, sf_dir).select("event_type", "pos", "err"), ["event_type"], ["pos"], "err", params={"delta": 0.5})
    return ad.retrain_cooldown(found.select("event_type", "pos"), ["event_type"], "pos", 300)


_GUARDS_SQL = """SELECT t.pos, count(s.pos) AS window_rows, count(DISTINCT s.event_type) AS n_classes, true AS triggered,
  count(s.pos) >= 500 AND count(DISTINCT s.event_type) >= 2 AS retrained
FROM t JOIN scored s ON s.pos <= t.pos AND s.pos > t.pos - 700 GROUP BY 1"""


@query("retrain_guards", f"WITH {SCORED_SQL}, t AS (SELECT pos FROM scored WHERE pos > 0 AND pos % 400 = 0) {_GUARDS_SQL}")
def retrain_guards(spark, sf_dir):
    rows = scored(spark, sf_dir).select("pos", "event_type")
    return ad.retrain_guards(rows, ad.retrain_periodic(rows, 400).select("pos"), "event_type", window_rows=700)


# --- active learning --------------------------------------------------------------------

_SCORES = {
    "uncertainty": "greatest(pa, pb, pc)",
    "margin": "greatest(pa, pb, pc) - (pa + pb + pc - greatest(pa, pb, pc) - least(pa, pb, pc))",
    "random": "CAST(CAST('0x' || substr(md5('42|' || event_id), 1, 8) AS BIGINT) AS DOUBLE)",
}


def _selection_sql(strategy):
    return f"""SELECT event_id, batch, y_true, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY round({_SCORES[strategy]}, 12), event_id) - 1 AS rank, count(*) OVER (PARTITION BY batch) AS n
  FROM samples) WHERE rank < greatest(1, floor(n * 1e-1))"""


def _select(strategy):
    def run(spark, sf_dir):
        out = al.select_for_labels(samples(spark, sf_dir), strategy, "batch", ["event_id"])
        return out.select("event_id", "batch", "y_true", "rank")

    return run


for _s in al.STRATEGIES:
    query(f"al_{_s}", f"WITH {SAMPLES_SQL} {_selection_sql(_s)}")(_select(_s))


@query(
    "al_efficiency",
    f"""WITH {SAMPLES_SQL}, pool AS ({' UNION ALL '.join(f"SELECT '{s}' AS strategy, event_id FROM ({_selection_sql(s)})" for s in al.STRATEGIES)})
SELECT strategy, 1e-1 AS budget_pct, (SELECT count(*) FROM samples) AS total_samples, count(*) AS total_labelled,
  round(count(*) / CAST((SELECT count(*) FROM samples) AS DOUBLE), 4) AS label_efficiency FROM pool GROUP BY 1""",
)
def al_efficiency(spark, sf_dir):
    rows = samples(spark, sf_dir)
    pool = al.labelled_pool([al.select_for_labels(rows, s, "batch", ["event_id"]) for s in al.STRATEGIES])
    return al.label_efficiency(pool, rows)


@query("confidence", f"WITH {SAMPLES_SQL} SELECT event_id, round(greatest(pa, pb, pc), 6) AS confidence FROM samples")
def confidence(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", F.round(al.confidence("probabilities"), 6).alias("confidence"))
