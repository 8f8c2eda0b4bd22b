"""Registered queries: concept drift detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.expressions import r6
from tidemark.operators import detect as dt
from tidemark.plans.registry import query
from tidemark.plans.views import SCORED_SQL, scored


def _stream(spark, sf_dir, *more):
    return scored(spark, sf_dir).select("event_type", "user_id", "pos", "err", *more)


def _tidy(df):
    return df.withColumn("estimation", r6("estimation"))


# Detectors with restarts, as one step of a recursion per row of a stream.

_STEPS = f"""{SCORED_SQL},
s AS (SELECT event_type, pos, err, value, row_number() OVER (PARTITION BY event_type ORDER BY pos) AS i FROM scored)"""
_FOUND = """SELECT event_type, pos, 'default' AS config, state, CAST(i AS BIGINT) AS n_seen, CAST(drifts AS BIGINT) AS n_drifts,
  CAST(n AS BIGINT) AS window_size, round({estimate}, 6) AS estimation FROM st WHERE state <> ''"""

_DDM_SQL = f"""WITH RECURSIVE {_STEPS},
st AS (
  SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS e,
    CAST('inf' AS DOUBLE) AS best, CAST('inf' AS DOUBLE) AS bp, CAST('inf' AS DOUBLE) AS bs, '' AS state, CAST(0 AS BIGINT) AS drifts FROM s
  UNION ALL
  SELECT event_type, i, pos, n, e, best, bp, bs, state, drifts + CASE WHEN state = 'drift' THEN 1 ELSE 0 END FROM (
    SELECT *, CASE WHEN n <= 30 THEN '' WHEN p + sd > bp + 3e0 * bs THEN 'drift' WHEN p + sd > bp + 2e0 * bs THEN 'warning' ELSE '' END AS state FROM (
      SELECT event_type, i, pos, n, e, p, sd, drifts,
        CASE WHEN n > 30 AND p + sd <= best THEN p + sd ELSE best END AS best,
        CASE WHEN n > 30 AND p + sd <= best THEN p ELSE bp END AS bp, CASE WHEN n > 30 AND p + sd <= best THEN sd ELSE bs END AS bs FROM (
        SELECT *, sqrt(p * (1 - p) / n) AS sd FROM (
          SELECT *, CAST(e AS DOUBLE) / n AS p FROM (
            SELECT s.event_type, s.i, s.pos, st.drifts, CASE WHEN st.state = 'drift' THEN 1 ELSE st.n + 1 END AS n,
              CASE WHEN st.state = 'drift' THEN s.err ELSE st.e + s.err END AS e,
              CASE WHEN st.state = 'drift' THEN CAST('inf' AS DOUBLE) ELSE st.best END AS best,
              CASE WHEN st.state = 'drift' THEN CAST('inf' AS DOUBLE) ELSE st.bp END AS bp,
              CASE WHEN st.state = 'drift' THEN CAST('inf' AS DOUBLE) ELSE st.bs END AS bs
            FROM st JOIN s ON s.event_type = st.event_type AND s.i = st.i + 1))))))
{_FOUND.format(estimate='CAST(e AS DOUBLE) / n')}"""

_EDDM_SQL = f"""WITH RECURSIVE {_STEPS},
st AS (
  SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last,
    CAST(0 AS BIGINT) AS ds, CAST(0 AS BIGINT) AS dd, 0e0 AS top, '' AS state, CAST(0 AS BIGINT) AS drifts FROM s
  UNION ALL
  SELECT event_type, i, pos, n, k, last, ds, dd, top, state, drifts + CASE WHEN state = 'drift' THEN 1 ELSE 0 END FROM (
    SELECT event_type, i, pos, n, k, last, ds, dd, top, drifts,
      CASE WHEN err = 0 THEN zone WHEN k < 30 THEN '' WHEN lev / top < 9e-1 THEN 'drift' WHEN lev / top < 95e-2 THEN 'warning' ELSE '' END AS state FROM (
      SELECT * EXCLUDE (top), CASE WHEN err = 1 AND k >= 30 THEN greatest(top, lev) ELSE top END AS top FROM (
        SELECT *, CASE WHEN k > 0 THEN CAST(ds AS DOUBLE) / k + 2 * sqrt(greatest(0e0, CAST(dd AS DOUBLE) / k - CAST(ds AS DOUBLE) / k * (CAST(ds AS DOUBLE) / k))) END AS lev FROM (
          SELECT event_type, i, pos, err, n, zone, drifts, top, k + err AS k, CASE WHEN err = 1 THEN n ELSE last END AS last,
            ds + CASE WHEN err = 1 THEN n - last ELSE 0 END AS ds, dd + CASE WHEN err = 1 THEN (n - last) * (n - last) ELSE 0 END AS dd FROM (
            SELECT s.event_type, s.i, s.pos, s.err, st.drifts, CASE WHEN f THEN 1 ELSE st.n + 1 END AS n, CASE WHEN f THEN 0 ELSE st.k END AS k,
              CASE WHEN f THEN 0 ELSE st.last END AS last, CASE WHEN f THEN 0 ELSE st.ds END AS ds, CASE WHEN f THEN 0 ELSE st.dd END AS dd,
              CASE WHEN f THEN 0e0 ELSE st.top END AS top, CASE WHEN f THEN '' ELSE st.state END AS zone
            FROM (SELECT *, state = 'drift' AS f FROM st) st JOIN s ON s.event_type = st.event_type AND s.i = st.i + 1))))))
{_FOUND.format(estimate='CASE WHEN k = 0 THEN 0e0 ELSE CAST(ds AS DOUBLE) / k END')}"""

_PAGE_HINKLEY_SQL = f"""WITH RECURSIVE {_STEPS},
st AS (
  SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, 0e0 AS x, 0e0 AS up, CAST('inf' AS DOUBLE) AS low,
    0e0 AS down, CAST('-inf' AS DOUBLE) AS high, '' AS state, CAST(0 AS BIGINT) AS drifts FROM s
  UNION ALL
  SELECT event_type, i, pos, n, x, up, low, down, high, state, drifts + CASE WHEN state = 'drift' THEN 1 ELSE 0 END FROM (
    SELECT *, CASE WHEN n >= 30 AND greatest(up - low, high - down) > 5e1 THEN 'drift' ELSE '' END AS state FROM (
      SELECT * EXCLUDE (low, high), least(low, up) AS low, greatest(high, down) AS high FROM (
        SELECT event_type, i, pos, n, x, drifts, low, high, 9999e-4 * up + (value - x / n) - 5e-3 AS up, 9999e-4 * down + (value - x / n) + 5e-3 AS down FROM (
          SELECT s.event_type, s.i, s.pos, s.value, st.drifts, CASE WHEN f THEN 1 ELSE st.n + 1 END AS n, CASE WHEN f THEN s.value ELSE st.x + s.value END AS x,
            CASE WHEN f THEN 0e0 ELSE st.up END AS up, CASE WHEN f THEN 0e0 ELSE st.down END AS down,
            CASE WHEN f THEN CAST('inf' AS DOUBLE) ELSE st.low END AS low, CASE WHEN f THEN CAST('-inf' AS DOUBLE) ELSE st.high END AS high
          FROM (SELECT *, state = 'drift' AS f FROM st) st JOIN s ON s.event_type = st.event_type AND s.i = st.i + 1)))))
{_FOUND.format(estimate='x / n')}"""


_LEVELS = range(14)  # buckets of up to 2**13 values: enough for the tables the check runs on


def adwin_sql(relations: str, key: str, value: str, source: str, deltas: tuple[float, ...] = (0.002,)) -> str:
    """ADWIN as a recursion: a step lets 32 values in and merges buckets, or drops the oldest bucket.

    The state is the number of buckets per size; sums come from prefix sums of the stream.
    The text defines ``drifts(g, config, pos, i, drifts, n, u)``.
    """
    grid = ", ".join(f"('{d}', CAST('{d}' AS DOUBLE))" for d in deltas)
    enter = ", ".join(
        f"st.k{j} + {'32' if j == 0 else f'p{j - 1}'} AS a{j}, CAST(greatest(0, ceil((a{j} - 5) / 2e0)) AS BIGINT) AS p{j}" for j in _LEVELS
    )
    top = "CASE " + " ".join(f"WHEN st.k{j} > 0 THEN {j}" for j in reversed(_LEVELS)) + " ELSE -1 END AS top"
    after = ", ".join(f"CASE WHEN st.cut THEN st.k{j} - CASE WHEN top = {j} THEN 1 ELSE 0 END ELSE a{j} - 2 * p{j} END AS m{j}" for j in _LEVELS)
    width = " + ".join(f"m{j} * {1 << j}" for j in _LEVELS)
    sizes = "flatten([" + ", ".join(f"list_transform(range(m{j}), lambda z: CAST({1 << j} AS BIGINT))" for j in reversed(_LEVELS)) + "])"
    levels = lambda name: ", ".join(f"{name.format(j=j)} AS k{j}" for j in _LEVELS)
    recip = "(1e0 / (o - 4) + 1e0 / (n - o - 4))"
    return f"""WITH RECURSIVE {relations},
num AS (SELECT {key} AS g, pos, CAST({value} AS DOUBLE) AS x, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS i FROM {source}),
pre AS (SELECT g, i, sum(x) OVER w AS c, sum(x * x) OVER w AS q FROM num WINDOW w AS (PARTITION BY g ORDER BY i)),
arr AS (SELECT g, list_prepend(0e0, list(c ORDER BY i)) AS c, list_prepend(0e0, list(q ORDER BY i)) AS q, count(*) AS total FROM pre GROUP BY g),
st AS (
  SELECT g, config, delta, CAST(0 AS BIGINT) AS i, {levels('CAST(0 AS BIGINT)')}, false AS cut, false AS fell, CAST(0 AS BIGINT) AS drifts,
    CAST(0 AS BIGINT) AS n, 0e0 AS u FROM arr, (VALUES {grid}) grid(config, delta)
  UNION ALL
  SELECT g, config, delta, i, {levels('m{j}')}, cut, fell, drifts + CASE WHEN fell AND NOT cut THEN 1 ELSE 0 END, n, u FROM (
    SELECT *, n > 10 AND len(list_filter(splits, lambda o: o >= 5 AND n - o >= 5 AND
      abs((c[base + o + 1] - c[base + 1]) / o - (c[i + 1] - c[base + o + 1]) / (n - o)) > sqrt(2e0 * {recip} * var * strict) + 2e0 / 3e0 * strict * {recip})) > 0 AS cut FROM (
      SELECT *, i - n AS base, c[i + 1] - c[i - n + 1] AS u, ln(2e0 * ln(greatest(n, 3)) / delta) AS strict,
        greatest(0e0, (q[i + 1] - q[i - n + 1]) / n - (c[i + 1] - c[i - n + 1]) / n * ((c[i + 1] - c[i - n + 1]) / n)) AS var,
        list_transform(range(1, len(sizes)), lambda j: CAST(list_sum(sizes[1:j]) AS BIGINT)) AS splits FROM (
        SELECT *, {width} AS n, {sizes} AS sizes FROM (
          SELECT st.g, st.config, st.delta, st.drifts, st.cut AS fell, arr.c, arr.q, CASE WHEN st.cut THEN st.i ELSE st.i + 32 END AS i, {top}, {enter}, {after}
          FROM st JOIN arr ON arr.g = st.g WHERE st.cut OR st.i + 32 <= arr.total))))),
drifts AS (SELECT st.g, st.config, num.pos, st.i, st.drifts, st.n, st.u FROM st JOIN num ON num.g = st.g AND num.i = st.i WHERE fell AND NOT cut)"""


_DRIFT_ROWS = """SELECT {key} pos, 'default' AS config, 'drift' AS state, CAST(i AS BIGINT) AS n_seen, CAST(drifts AS BIGINT) AS n_drifts,
  CAST(n AS BIGINT) AS window_size, round(u / n, 6) AS estimation FROM drifts"""
_BY_TYPE = adwin_sql(SCORED_SQL, "event_type", "err", "scored")
_KEYED_DRIFTS = _DRIFT_ROWS.format(key="g AS event_type,")


@query("adwin_by_key", f"{_BY_TYPE} {_KEYED_DRIFTS}")
def adwin_by_key(spark, sf_dir):
    return _tidy(dt.detect(_stream(spark, sf_dir), ["event_type"], ["pos"], "err"))


@query("adwin_stream", adwin_sql(SCORED_SQL, "0", "err", "scored") + _DRIFT_ROWS.format(key=""))
def adwin_stream(spark, sf_dir):
    return _tidy(dt.detect(_stream(spark, sf_dir), [], ["pos"], "err", rank="pos"))


@query("ddm_by_key", _DDM_SQL)
def ddm_by_key(spark, sf_dir):
    return _tidy(dt.detect(_stream(spark, sf_dir), ["event_type"], ["pos"], "err", "ddm", states=("drift", "warning")))


@query("eddm_by_key", _EDDM_SQL)
def eddm_by_key(spark, sf_dir):
    return _tidy(dt.detect(_stream(spark, sf_dir), ["event_type"], ["pos"], "err", "eddm", states=("drift", "warning")))


@query("page_hinkley_by_key", _PAGE_HINKLEY_SQL)
def page_hinkley_by_key(spark, sf_dir):
    return _tidy(dt.detect(_stream(spark, sf_dir, "value"), ["event_type"], ["pos"], "value", "page_hinkley"))


@query(
    "confidence_drift",
    adwin_sql(SCORED_SQL, "event_type", "CASE WHEN late THEN 5e-1 + (confidence - 5e-1) / 2 ELSE confidence END", "scored") + _KEYED_DRIFTS,
)
def confidence_drift(spark, sf_dir):
    # confidence falls for late rows, as a model's does on data it has not seen
    rows = scored(spark, sf_dir)
    late = F.col("pos") >= F.floor(F.col("n") * F.lit(0.6))
    rows = rows.select("event_type", "pos", F.when(late, 0.5 + (F.col("confidence") - 0.5) / 2).otherwise(F.col("confidence")).alias("confidence"))
    return _tidy(dt.detect(rows, ["event_type"], ["pos"], "confidence", "confidence"))


@query(
    "attack_rate_drift",
    adwin_sql(SCORED_SQL, "event_type", "CASE WHEN y_pred = 'ATTACK' THEN 1 WHEN (SELECT count(*) FROM scored WHERE y_pred = 'ATTACK') = 0 THEN 5e-1 ELSE 0 END", "scored")
    + _KEYED_DRIFTS,
)
def attack_rate_drift(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("attack", (F.col("y_pred") == "ATTACK").cast("double"))
    share = rows.agg(F.avg("attack")).scalar()
    rows = rows.withColumn("signal", F.when(share > 0, F.col("attack")).otherwise(0.5))
    return _tidy(dt.detect(rows, ["event_type"], ["pos"], "signal"))


@query(
    "drift_events",
    f"""{_BY_TYPE}, e AS (SELECT event_type, pos, avg(CAST(err AS DOUBLE)) OVER (w ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS r,
  avg(CAST(err AS DOUBLE)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM scored WINDOW w AS (PARTITION BY event_type ORDER BY pos))
SELECT 'drift-' || lpad(CAST(row_number() OVER (ORDER BY d.pos, g) AS VARCHAR), 6, '0') AS event_id, 'concept' AS drift_type, 'adwin' AS detector,
  g AS event_type, d.pos, 'v1' AS model_version, CAST(n AS BIGINT) AS window_size, round(r, 6) AS rolling_error, round(a, 6) AS cumulative_error,
  CAST(i AS DOUBLE) AS n_seen, CAST(drifts AS DOUBLE) AS n_drifts, round(u / n, 6) AS estimation
FROM drifts d JOIN e ON e.event_type = d.g AND e.pos = d.pos""",
)
def drift_events(spark, sf_dir):
    out = dt.drift_events(_stream(spark, sf_dir), ["event_type"], ["pos"], "err")
    context = [r6(F.col("context")[n]).alias(n) for n in ("rolling_error", "cumulative_error")]
    state = [r6(F.col("detector_state")[n]).alias(n) for n in ("n_seen", "n_drifts", "estimation")]
    return out.select("event_id", "drift_type", "detector", "event_type", "pos", "model_version", "window_size", *context, *state)


@query(
    "adwin_sensitivity",
    adwin_sql(SCORED_SQL, "0", "err", "scored", dt.SENSITIVITY_GRID)
    + """, cutoff AS (SELECT CAST(floor(count(*) * 6e-1) AS BIGINT) AS injected FROM scored)
SELECT config AS delta, count(i) AS n_alarms, min(i) AS first_detection, min(CASE WHEN i > injected THEN i END) - any_value(injected) AS delay
FROM (SELECT DISTINCT config FROM st) c LEFT JOIN drifts USING (config), cutoff GROUP BY 1""",
)
def adwin_sensitivity(spark, sf_dir):
    rows = _stream(spark, sf_dir)
    n = rows.count()
    return dt.sensitivity(rows, [], ["pos"], "err", injected=int(n * 0.6), rank="pos")


_KEYED = f"{SCORED_SQL}, s AS (SELECT event_type, pos, err, value, row_number() OVER w AS n, sum(err) OVER w AS e, sum(value) OVER w AS x FROM scored WINDOW w AS (PARTITION BY event_type ORDER BY pos))"


@query(
    "ddm_first_alarm",
    f"""WITH {_KEYED}, p AS (SELECT event_type, pos, n, CAST(e AS DOUBLE) / n AS p FROM s),
l AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM p), v AS (SELECT *, p + s AS lev FROM l WHERE n > 30),
b AS (SELECT *, min((lev, p, s)) OVER (PARTITION BY event_type ORDER BY pos) AS m FROM v)
SELECT event_type, min(n) FILTER (WHERE lev > m[2] + 2e0 * m[3]) AS first_warning, min(n) FILTER (WHERE lev > m[2] + 3e0 * m[3]) AS first_drift
FROM b GROUP BY 1 HAVING first_warning IS NOT NULL OR first_drift IS NOT NULL""",
)
def ddm_first_alarm(spark, sf_dir):
    return dt.ddm_first_alarm(_stream(spark, sf_dir), ["event_type"], ["pos"], "err")


@query(
    "eddm_first_alarm",
    f"""WITH {_KEYED}, g AS (SELECT event_type, pos, n, n - COALESCE(lag(n) OVER (PARTITION BY event_type ORDER BY pos), 0) AS d FROM s WHERE err = 1),
c AS (SELECT *, row_number() OVER w AS k, CAST(sum(d) OVER w AS DOUBLE) AS ds, CAST(sum(d * d) OVER w AS DOUBLE) AS dd FROM g WINDOW w AS (PARTITION BY event_type ORDER BY pos)),
l AS (SELECT event_type, pos, n, ds / k + 2 * sqrt(greatest(0e0, dd / k - ds / k * (ds / k))) AS lev FROM c WHERE k >= 30),
t AS (SELECT *, max(lev) OVER (PARTITION BY event_type ORDER BY pos) AS top FROM l)
SELECT event_type, min(n) FILTER (WHERE lev / top < 95e-2) AS first_warning, min(n) FILTER (WHERE lev / top < 9e-1) AS first_drift
FROM t GROUP BY 1 HAVING first_warning IS NOT NULL OR first_drift IS NOT NULL""",
)
def eddm_first_alarm(spark, sf_dir):
    return dt.eddm_first_alarm(_stream(spark, sf_dir), ["event_type"], ["pos"], "err")


@query(
    "page_hinkley_first_alarm",
    f"""WITH {_KEYED}, g AS (SELECT event_type, pos, n, value - x / n AS gap FROM s),
c AS (SELECT *, sum(gap - 5e-3) OVER w AS up, sum(gap + 5e-3) OVER w AS down FROM g WINDOW w AS (PARTITION BY event_type ORDER BY pos)),
m AS (SELECT *, min(up) OVER w AS low, max(down) OVER w AS high FROM c WINDOW w AS (PARTITION BY event_type ORDER BY pos))
SELECT event_type, min(n) AS first_drift FROM m WHERE n >= 30 AND greatest(up - low, high - down) > 5e2 GROUP BY 1""",
)
def page_hinkley_first_alarm(spark, sf_dir):
    return dt.page_hinkley_first_alarm(_stream(spark, sf_dir, "value"), ["event_type"], ["pos"], "value", threshold=500.0)
