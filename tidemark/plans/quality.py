"""Registered queries: evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import r6
from tidemark.operators import detect as dt
from tidemark.operators import evaluate as ev
from tidemark.operators import experiments as ex
from tidemark.operators.prequential import policy_table
from tidemark.plans.drift import adwin_sql
from tidemark.plans.registry import query
from tidemark.plans.views import FLOWS_SQL, SCORED_SQL, SEEDS, flows, rule_runs, runs_sql, scored, table

_METRICS = ["accuracy", "precision", "recall", "f1", "mcc", "fpr", "fnr"]


def _rounded(df, names):
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


def metrics_sql(counts: str, by: str = "") -> str:
    """SQL text of the binary metrics over a relation with tp, fp, fn, tn per group."""
    div = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END, 6)"
    spread = "sqrt(1e0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"
    return f"""
SELECT {by} CAST(tp + fp + fn + tn AS BIGINT) AS support,
  {div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall,
  {div('2 * tp', '2 * tp + fp + fn')} AS f1,
  round(CASE WHEN {spread} = 0 THEN 0e0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / {spread} END, 6) AS mcc,
  {div('fp', 'fp + tn')} AS fpr, {div('fn', 'fn + tp')} AS fnr,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
FROM {counts}"""


COUNTS = """sum(CASE WHEN y_true = 'ATTACK' AND y_pred = 'ATTACK' THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true <> 'ATTACK' AND y_pred = 'ATTACK' THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 'ATTACK' AND y_pred <> 'ATTACK' THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN y_true <> 'ATTACK' AND y_pred <> 'ATTACK' THEN 1 ELSE 0 END) AS tn"""

_WINDOWED = f"""WITH {SCORED_SQL},
c AS (SELECT CAST(floor(pos / 1000) AS BIGINT) AS window_id, {COUNTS} FROM scored GROUP BY 1)
{metrics_sql('c', 'window_id, window_id * 1000 AS window_start, CAST(window_id * 1000 + tp + fp + fn + tn AS BIGINT) AS window_end,')}"""


@query("windowed_metrics", _WINDOWED)
def windowed_metrics(spark, sf_dir):
    return _rounded(ev.windowed_metrics(scored(spark, sf_dir), window_rows=1000), _METRICS)


@query(
    "confusion_matrix",
    f"""WITH {SCORED_SQL}, l AS (SELECT y_true AS label FROM scored UNION SELECT y_pred FROM scored)
SELECT a.label AS label_true, b.label AS label_pred, count(s.pos) AS n
FROM l a CROSS JOIN l b LEFT JOIN scored s ON s.y_true = a.label AND s.y_pred = b.label GROUP BY 1, 2""",
)
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(scored(spark, sf_dir))


@query("binary_metrics", f"WITH {SCORED_SQL}, c AS (SELECT {COUNTS} FROM scored) {metrics_sql('c')}")
def binary_metrics(spark, sf_dir):
    return _rounded(ev.binary_metrics(scored(spark, sf_dir)), _METRICS)


# Three labels: the flow label and a guess from quantity and discount.
_GUESS_SQL = f"""{FLOWS_SQL}, guess AS (
  SELECT "Label" AS y_true, CASE WHEN l_quantity < 17 THEN 'BENIGN' WHEN l_discount < 5e-2 THEN 'DDoS' WHEN l_tax < 7e-2 THEN "Label"
         ELSE 'PortScan' END AS y_pred FROM flows),
pairs AS (SELECT y_true, y_pred, count(*) AS n FROM guess GROUP BY 1, 2),
sides AS (
  SELECT label, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM (
    SELECT y_true AS label, n AS s, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS h FROM pairs
    UNION ALL SELECT y_pred, 0, n, 0 FROM pairs) GROUP BY 1),
classes AS (
  SELECT label, CAST(support AS DOUBLE) AS support, CAST(predicted AS DOUBLE) AS predicted, CAST(hits AS DOUBLE) AS hits,
    CASE WHEN predicted = 0 THEN 0e0 ELSE CAST(hits AS DOUBLE) / predicted END AS precision,
    CASE WHEN support = 0 THEN 0e0 ELSE CAST(hits AS DOUBLE) / support END AS recall,
    CASE WHEN predicted + support = 0 THEN 0e0 ELSE 2e0 * hits / (predicted + support) END AS f1
  FROM sides)"""


def _guess(spark, sf_dir):
    y_pred = (
        F.when(F.col("l_quantity") < 17, "BENIGN").when(F.col("l_discount") < 0.05, "DDoS")
        .when(F.col("l_tax") < 0.07, F.col("Label")).otherwise("PortScan")
    )
    return flows(spark, sf_dir).select(F.col("Label").alias("y_true"), y_pred.alias("y_pred"))


@query(
    "multiclass_metrics",
    f"""WITH {_GUESS_SQL}, s AS (
  SELECT count(*) AS n_labels, sum(support) AS s, sum(hits) AS c, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f,
    sum(f1 * support) / sum(support) AS wf, sum(predicted * support) AS pt, sum(predicted * predicted) AS pp,
    sum(support * support) AS tt FROM classes)
SELECT n_labels, CAST(s AS BIGINT) AS support, round(c / s, 6) AS accuracy, round(p, 6) AS macro_precision,
  round(r, 6) AS macro_recall, round(f, 6) AS macro_f1, round(wf, 6) AS weighted_f1,
  round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc FROM s""",
)
def multiclass_metrics(spark, sf_dir):
    out = ev.multiclass_metrics(_guess(spark, sf_dir))
    return _rounded(out, set(out.columns) - {"n_labels", "support"})


@query(
    "classification_report",
    f"""WITH {_GUESS_SQL}, lines AS (
  SELECT label, precision, recall, f1, support FROM classes
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM classes
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM classes)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM lines""",
)
def classification_report(spark, sf_dir):
    return _rounded(ev.classification_report(_guess(spark, sf_dir)), ["precision", "recall", "f1"])


@query(
    "f1_range",
    f"""WITH {SCORED_SQL}, c AS (SELECT CAST(floor(pos / 1000) AS BIGINT) AS window_id, {COUNTS} FROM scored GROUP BY 1),
f AS (SELECT CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END AS f1 FROM c)
SELECT count(*) AS n_windows, round(min(f1), 6) AS f1_min, round(max(f1), 6) AS f1_max, round(avg(f1), 6) AS f1_mean,
  round(stddev_pop(f1), 6) AS f1_std FROM f""",
)
def f1_range(spark, sf_dir):
    out = ev.metric_range(ev.windowed_metrics(scored(spark, sf_dir), window_rows=1000))
    return _rounded(out, set(out.columns) - {"n_windows"})


@query(
    "rolling_error",
    f"""WITH {SCORED_SQL}
SELECT pos, err, round(avg(CAST(err AS DOUBLE)) OVER (ORDER BY pos ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 6) AS rolling_error
FROM scored""",
)
def rolling_error(spark, sf_dir):
    out = ev.rolling_error(scored(spark, sf_dir).select("pos", "err"), [], ["pos"], rows=500)
    return _rounded(out, ["rolling_error"])


@query(
    "rolling_error_by_user",
    f"""WITH {SCORED_SQL}
SELECT user_id, pos, round(avg(CAST(err AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6)
  AS rolling_error FROM scored""",
)
def rolling_error_by_user(spark, sf_dir):
    out = ev.rolling_error(scored(spark, sf_dir).select("user_id", "pos", "err"), ["user_id"], ["pos"], rows=20)
    return _rounded(out.drop("err"), ["rolling_error"])


@query(
    "cumulative_error",
    f"""WITH {SCORED_SQL}
SELECT pos, err, round(avg(CAST(err AS DOUBLE)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
  AS cumulative_error FROM scored""",
)
def cumulative_error(spark, sf_dir):
    out = ev.cumulative_error(scored(spark, sf_dir).select("pos", "err"), [], ["pos"])
    return _rounded(out, ["cumulative_error"])


@query(
    "strategy_comparison",
    f"""WITH {runs_sql((42,))},
c AS (SELECT strategy, {COUNTS} FROM by_run GROUP BY 1),
m AS ({metrics_sql('c', 'strategy, CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END AS raw,')}),
j AS (SELECT m.*, COALESCE(n_retrains, 0) AS n_retrains FROM m LEFT JOIN retrains USING (strategy)),
r AS (SELECT max(CASE WHEN strategy = 'static' THEN raw END) AS base, max(raw) AS best,
             max(CASE WHEN strategy = 'periodic_1000' THEN n_retrains END) AS per FROM j)
SELECT j.* EXCLUDE (raw), round(raw - base, 6) AS recovery, round(100 * (raw - base) / base, 6) AS improvement_pct,
  round(100 * (best - raw) / best, 6) AS degradation_pct,
  round(CASE WHEN per > 0 THEN 100 * (1 - CAST(n_retrains AS DOUBLE) / per) ELSE 0e0 END, 6) AS retrain_saving_pct
FROM j, r""",
)
def strategy_comparison(spark, sf_dir):
    """A cell table under three policies, next to the one that never retrains."""
    grid = rule_runs(spark, sf_dir, (42,))
    retrains = policy_table(grid).select("strategy", "n_retrains")
    out = ex.strategy_comparison(grid.predictions, retrains, periodic="periodic_1000")
    return _rounded(out, [*_METRICS, "recovery", "improvement_pct", "degradation_pct", "retrain_saving_pct"])


@query(
    "drift_in_window",
    adwin_sql(SCORED_SQL, "event_type", "err", "scored") + """, w AS (SELECT DISTINCT CAST(floor(pos / 1000) AS BIGINT) AS window_id FROM scored)
SELECT window_id, count(d.pos) AS n_drifts, min(d.pos) AS first_drift
FROM w LEFT JOIN drifts d ON d.pos >= window_id * 1000 AND d.pos < (window_id + 1) * 1000 GROUP BY 1""",
)
def drift_in_window(spark, sf_dir):
    """Drifts that ADWIN finds per event type, counted in windows of 1,000 positions."""
    rows = scored(spark, sf_dir)
    windows = rows.select(F.floor(F.col("pos") / 1000).alias("window_id")).distinct()
    drifts = dt.detect(rows.select("event_type", "pos", "err"), ["event_type"], ["pos"], "err").select("pos")
    return ev.drift_in_window(windows, drifts, window_rows=1000)


# A run is a cell table under one policy, fitted on the rows its seed draws.
_RUNS_SQL = f"""{runs_sql(SEEDS)},
rc AS (SELECT strategy, seed, {COUNTS} FROM by_run GROUP BY 1, 2),
runs AS (SELECT strategy, seed,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END AS f1,
  CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
  CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(fn AS DOUBLE) / (tp + fn) END AS fnr FROM rc)"""


def _runs(spark, sf_dir):
    return ev.binary_metrics(rule_runs(spark, sf_dir, SEEDS).predictions, by=["strategy", "seed"])


@query(
    "run_summary",
    f"""WITH {_RUNS_SQL}, cells AS (
  SELECT strategy, 'f1' AS metric, f1 AS v FROM runs UNION ALL SELECT strategy, 'recall', recall FROM runs
  UNION ALL SELECT strategy, 'fnr', fnr FROM runs)
SELECT strategy, metric, count(*) AS n_runs, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cells GROUP BY 1, 2""",
)
def run_summary(spark, sf_dir):
    return _rounded(ex.run_summary(_runs(spark, sf_dir), ["strategy"], ["f1", "recall", "fnr"]), ["mean", "std"])


@query(
    "bootstrap_ci",
    f"""WITH {_RUNS_SQL}, v AS (SELECT strategy, seed, f1, row_number() OVER (ORDER BY strategy, seed) - 1 AS j, count(*) OVER () AS n FROM runs),
draws AS (SELECT rep, CAST('0x' || substr(md5('42|' || rep || '|' || j), 1, 8) AS BIGINT) % n AS j FROM v, range(1000) t(rep)),
means AS (SELECT rep, avg(f1) AS m FROM draws JOIN v USING (j) GROUP BY 1)
SELECT (SELECT count(*) FROM v) AS n_values, (SELECT round(avg(f1), 6) FROM v) AS mean, count(*) AS n_replicates,
  round(quantile_cont(m, 25e-3), 6) AS ci_lower, round(quantile_cont(m, 975e-3), 6) AS ci_upper FROM means""",
)
def bootstrap_ci(spark, sf_dir):
    out = ex.bootstrap_ci(_runs(spark, sf_dir), "f1", ["strategy", "seed"])
    return _rounded(out, ["mean", "ci_lower", "ci_upper"])


_CDF_SQL = """(((((1.330274429e0 * t - 1.821255978e0) * t + 1.781477937e0) * t - 0.356563782e0) * t + 0.319381530e0) * t)
  * exp(-z * z / 2) / 2.5066282746310002e0"""


@query(
    "wilcoxon_paired",
    f"""WITH {_RUNS_SQL}, d AS (
  SELECT a.strategy, round(a.f1 - b.f1, 12) AS d FROM runs a JOIN runs b ON a.seed = b.seed AND b.strategy = 'static'
  WHERE a.strategy <> 'static' AND round(a.f1 - b.f1, 12) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY strategy ORDER BY abs(d)) + (count(*) OVER (PARTITION BY strategy, abs(d)) - 1) / 2e0 AS rk,
        count(*) OVER (PARTITION BY strategy, abs(d)) AS t FROM d),
s AS (SELECT strategy, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0e0 END) AS wp,
        sum(CASE WHEN d < 0 THEN rk ELSE 0e0 END) AS wm, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM r GROUP BY 1),
z AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
q AS (SELECT *, 1 / (1 - 0.2316419e0 * z) AS t FROM z)
SELECT strategy, CAST(n AS BIGINT) AS n_pairs, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, round(least(wp, wm), 6) AS statistic,
  round(z, 6) AS z, round(least(1e0, 2 * {_CDF_SQL}), 6) AS p_value FROM q""",
)
def wilcoxon_paired(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("strategy", "seed", "f1")
    static = runs.filter("strategy = 'static'").select("seed", F.col("f1").alias("f1_static"))
    pairs = runs.filter("strategy <> 'static'").join(static, "seed")
    out = ex.wilcoxon_paired(pairs, "f1", "f1_static", ["strategy"])
    return _rounded(out, set(out.columns) - {"strategy", "n_pairs"})
