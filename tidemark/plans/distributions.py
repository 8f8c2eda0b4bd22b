"""Registered queries: feature statistics and feature drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import r6
from tidemark.operators import stats as st
from tidemark.operators.ordering import global_position
from tidemark.operators.split import temporal_split
from tidemark.plans.preparation import _FLOW_SPLIT_SQL
from tidemark.plans.registry import query
from tidemark.plans.views import FLOW_FEATURES, FLOW_KEY, FLOW_ORDER, flows, table

_DRIFTING = [*FLOW_FEATURES, "price_shifted"]

# price_shifted grows by half in the test part, so that one feature drifts for certain.
_LONG_SQL = f"""{_FLOW_SPLIT_SQL},
two AS (SELECT *, split = 'test' AS b, l_extendedprice * CASE WHEN split = 'test' THEN 15e-1 ELSE 1e0 END AS price_shifted
  FROM parts WHERE split <> 'validation'),
cells AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value, b, pos, n FROM two" for f in _DRIFTING)})"""


def _train_test(spark, sf_dir):
    rows = temporal_split(flows(spark, sf_dir), "Timestamp", FLOW_KEY).filter("split <> 'validation'")
    test = F.col("split") == "test"
    return rows.withColumn("price_shifted", F.col("l_extendedprice") * F.when(test, 1.5).otherwise(1.0)), test


def _rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "feature_stats",
    """WITH ev AS (SELECT value, CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS DOUBLE) AS k,
  CASE WHEN event_id % 97 <> 0 THEN value END AS gappy FROM events),
cells AS (SELECT 'value' AS feature, value AS v FROM ev UNION ALL SELECT 'k', k FROM ev UNION ALL SELECT 'gappy', gappy FROM ev)
SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max,
  count(*) - count(v) AS missing, round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis,
  round(quantile_cont(v, 1e-2), 6) AS p01, round(quantile_cont(v, 25e-2), 6) AS p25, round(quantile_cont(v, 5e-1), 6) AS p50,
  round(quantile_cont(v, 75e-2), 6) AS p75, round(quantile_cont(v, 99e-2), 6) AS p99, count(DISTINCT v) AS n_unique
FROM cells GROUP BY 1""",
)
def feature_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "value", F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("double").alias("k"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("gappy"),
    )
    return _rounded(st.feature_stats(rows, ["value", "k", "gappy"]), ["mean", "std", "skewness", "kurtosis", *st.QUANTILES])


@query(
    "window_compare",
    f"""WITH {_LONG_SQL}, s AS (SELECT feature, avg(value) FILTER (WHERE NOT b) AS ma, stddev_samp(value) FILTER (WHERE NOT b) AS sa,
  avg(value) FILTER (WHERE b) AS mb, stddev_samp(value) FILTER (WHERE b) AS sb FROM cells GROUP BY 1)
SELECT feature, round(ma, 6) AS mean_a, round(sa, 6) AS std_a, round(mb, 6) AS mean_b, round(sb, 6) AS std_b,
  round(mb - ma, 6) + 0e0 AS mean_shift, round(abs(mb - ma) / (abs(ma) + 1e-10), 6) AS relative_shift FROM s""",
)
def window_compare(spark, sf_dir):
    rows, test = _train_test(spark, sf_dir)
    out = st.window_compare(rows, _DRIFTING, test)
    return _rounded(out, set(out.columns) - {"feature"}).withColumn("mean_shift", F.col("mean_shift") + 0.0)


_KS_SQL = f"""{_LONG_SQL},
g AS (SELECT feature, value, count(*) FILTER (WHERE NOT b) AS na, count(*) FILTER (WHERE b) AS nb FROM cells GROUP BY 1, 2),
c AS (SELECT feature, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER (PARTITION BY feature) AS ta, sum(nb) OVER (PARTITION BY feature) AS tb
  FROM g WINDOW w AS (PARTITION BY feature ORDER BY value)),
d AS (SELECT feature, max(abs(CAST(ca AS DOUBLE) / ta - CAST(cb AS DOUBLE) / tb)) AS d, any_value(ta) AS ta, any_value(tb) AS tb FROM c GROUP BY 1),
l AS (SELECT *, sqrt(CAST(ta AS DOUBLE) * tb / (ta + tb)) * d AS lam FROM d),
p AS (SELECT l.*, CASE WHEN lam < 2e-1 THEN 1e0 ELSE least(1e0, greatest(0e0,
  (SELECT sum(CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * k * k * lam * lam)) FROM range(1, 101) r(k)))) END AS p FROM l),
m AS (SELECT feature, avg(value) FILTER (WHERE NOT b) AS ma, avg(value) FILTER (WHERE b) AS mb,
  stddev_pop(value) FILTER (WHERE NOT b) AS sa, stddev_pop(value) FILTER (WHERE b) AS sb FROM cells GROUP BY 1),
ks AS (SELECT feature, CAST(ta AS BIGINT) AS n_a, CAST(tb AS BIGINT) AS n_b, ma AS mean_a, mb AS mean_b, sa AS std_a, sb AS std_b, d AS ks_statistic,
  p AS p_value, p < 5e-2 AS significant, abs(mb - ma) AS mean_shift, abs(mb - ma) / (abs(ma) + 1e-10) AS relative_shift FROM p JOIN m USING (feature))"""


def _ks(spark, sf_dir):
    rows, test = _train_test(spark, sf_dir)
    return st.ks_two_sample(rows, _DRIFTING, test)


@query(
    "ks_two_sample",
    f"""WITH {_KS_SQL} SELECT feature, n_a, n_b, significant, round(ks_statistic, 6) AS ks_statistic, round(p_value, 6) AS p_value,
  round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(std_a, 4) AS std_a, round(std_b, 4) AS std_b,
  round(mean_shift, 4) AS mean_shift, round(relative_shift, 4) AS relative_shift FROM ks""",
)
def ks_two_sample(spark, sf_dir):
    out = _rounded(_ks(spark, sf_dir), ["mean_a", "mean_b", "std_a", "std_b", "mean_shift", "relative_shift"], 4)
    return _rounded(out, ["ks_statistic", "p_value"])


@query(
    "ks_summary",
    f"""WITH {_KS_SQL} SELECT count(*) AS n_features, count(*) FILTER (WHERE significant) AS n_significant,
  round(count(*) FILTER (WHERE significant) * 1e2 / count(*), 1) AS pct_drifted FROM ks""",
)
def ks_summary(spark, sf_dir):
    return st.ks_summary(_ks(spark, sf_dir))


@query(
    "ks_top_features",
    f"WITH {_KS_SQL} SELECT feature, round(ks_statistic, 6) AS ks_statistic, round(relative_shift, 4) AS relative_shift FROM ks ORDER BY ks.ks_statistic DESC, feature LIMIT 3",
)
def ks_top_features(spark, sf_dir):
    out = st.ks_top_features(_ks(spark, sf_dir), 3)
    return out.select("feature", r6("ks_statistic").alias("ks_statistic"), F.round("relative_shift", 4).alias("relative_shift"))


@query(
    "windowed_feature_stats",
    f"""WITH {_FLOW_SPLIT_SQL}, w AS (SELECT *, least(CAST(floor(pos / greatest(floor(CAST(n AS DOUBLE) / 5), 1)) AS BIGINT), 4) AS "window" FROM parts),
cells AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value, w.window FROM w" for f in FLOW_FEATURES)})
SELECT "window", feature, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(median(value), 4) AS median
FROM cells GROUP BY 1, 2""",
)
def windowed_feature_stats(spark, sf_dir):
    rows = global_position(flows(spark, sf_dir), FLOW_ORDER, "pos", "n")
    return _rounded(st.windowed_feature_stats(rows, FLOW_FEATURES, "pos", F.col("n")), ["mean", "std", "median"], 4)


def _histogram_sql(f, bins):
    return f"""SELECT '{f}' AS feature, CASE WHEN b THEN 'b' ELSE 'a' END AS side, least(CAST(floor(({f} - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, lo, hi - lo AS width
FROM two, (SELECT min({f}) AS lo, max({f}) AS hi FROM two)"""


@query(
    "feature_histogram",
    f"""WITH {_LONG_SQL}, h AS ({' UNION ALL '.join(_histogram_sql(f, 50) for f in _DRIFTING)}),
ends AS (SELECT DISTINCT feature, lo, width FROM h),
grid AS (SELECT feature, lo, width, s.side, r.bin FROM ends, (VALUES ('a'), ('b')) s(side), range(50) r(bin)),
n AS (SELECT feature, side, bin, count(*) AS n FROM h GROUP BY 1, 2, 3), t AS (SELECT feature, side, count(*) AS t FROM h GROUP BY 1, 2)
SELECT feature, side, bin, round(lo + width / 50 * bin, 6) AS bin_start, COALESCE(n, 0) AS n, round(COALESCE(n, 0) / (t * (width / 50)), 9) AS density
FROM grid LEFT JOIN n USING (feature, side, bin) JOIN t USING (feature, side)""",
)
def feature_histogram(spark, sf_dir):
    rows, test = _train_test(spark, sf_dir)
    out = _rounded(st.feature_histogram(rows, _DRIFTING, 50, test), ["bin_start"])
    return _rounded(out, ["density"], 9)


@query("traffic_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1")
def traffic_hourly(spark, sf_dir):
    out = st.traffic_hourly(table(spark, sf_dir, "events"), "ts")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")
