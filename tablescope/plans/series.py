"""2.I  Time-series overview, LOESS trend, outliers, epoch detection."""
from __future__ import annotations


from pyspark.sql import functions as F

from tablescope.functions.formats import epoch_micros
from tablescope.operators import series as SR
from tablescope.plans import load, register


@register("ts_overview", """
SELECT date_trunc('day', ts) AS bucket, count(*) AS n, round(sum(value), 2) AS sum_value, round(avg(value), 6) AS avg_value
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def ts_overview(spark, sf):
    out = SR.overview(load(spark, sf, "events"), value="value")
    return out.select("bucket", "n", F.round("sum_value", 2).alias("sum_value"), F.round("avg_value", 6).alias("avg_value"))


@register("ts_overview_auto", """
SELECT date_trunc('year', l_shipdate) AS bucket, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1""")
def ts_overview_auto(spark, sf):
    return SR.overview(load(spark, sf, "lineitem"))   # first time column, auto granularity


def _hourly(spark, sf):
    ev = load(spark, sf, "events")
    s = SR.overview(ev, "ts", unit="hour")
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return s.select((F.timestamp_diff("SECOND", t0, F.col("bucket")) / 3600.0).alias("x"), F.col("n").cast("double").alias("y"))


def _loess_sql(span=0.3) -> str:
    return f"""
WITH s AS (SELECT (epoch(date_trunc('hour', ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 3600.0 AS x, CAST(count(*) AS DOUBLE) AS y
           FROM events WHERE ts IS NOT NULL GROUP BY date_trunc('hour', ts)),
i AS (SELECT x, y, row_number() OVER (ORDER BY x) - 1 AS idx FROM s),
k AS (SELECT greatest(2, CAST(ceil({span} * count(*)) AS BIGINT)) AS q FROM s),
c AS (SELECT a.idx AS i, a.x AS xi, b.idx AS j, b.x AS xj, b.y AS yj, abs(b.x - a.x) AS d
      FROM i a JOIN i b ON b.idx BETWEEN a.idx - (SELECT q FROM k) + 1 AND a.idx + (SELECT q FROM k) - 1),
dq AS (SELECT i, d AS dq FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM c)
       WHERE rn = (SELECT q FROM k)),
w AS (SELECT c.*, CASE WHEN d < dq THEN pow(1 - pow(d / dq, 3), 3) WHEN dq = 0 THEN 1.0 ELSE 0.0 END AS w FROM c JOIN dq USING (i)),
g AS (SELECT i, first(xi) AS xi, sum(w) AS W, sum(w * xj) AS Sx, sum(w * yj) AS Sy, sum(w * xj * xj) AS Sxx, sum(w * xj * yj) AS Sxy
      FROM w GROUP BY i),
f AS (SELECT i, CASE WHEN abs(W * Sxx - Sx * Sx) > 1e-12 * greatest(1.0, abs(W * Sxx))
                     THEN (Sy - ((W * Sxy - Sx * Sy) / (W * Sxx - Sx * Sx)) * Sx) / W + ((W * Sxy - Sx * Sy) / (W * Sxx - Sx * Sx)) * xi
                     ELSE Sy / W END AS fit FROM g)
SELECT i.x, i.y, i.idx, f.fit FROM i JOIN f ON f.i = i.idx"""


@register("ts_trend", "SELECT x, y, idx, round(fit, 6) AS fit FROM (" + _loess_sql() + ")")
def ts_trend(spark, sf):
    return SR.loess(_hourly(spark, sf), "x", "y").select("x", "y", "idx", F.round("fit", 6).alias("fit"))


@register("ts_trend_points", """
WITH i AS (SELECT CAST(o_orderkey AS DOUBLE) AS x, CAST(o_totalprice AS DOUBLE) AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders),
size AS (SELECT count(*) AS n, CAST(ceil(0.3 * count(*)) AS BIGINT) AS q FROM i),
node AS (SELECT k, x AS xk, idx AS spot FROM (SELECT unnest(range(100)) AS k), size JOIN i ON idx = (k * (n - 1)) // 99),
away AS (SELECT k, x - xk AS u, y AS v, abs(x - xk) AS d, row_number() OVER (PARTITION BY k ORDER BY abs(x - xk), idx) AS nth FROM node, i),
reach AS (SELECT k, d AS h FROM away, size WHERE nth = q),
weighed AS (SELECT k, u, v, pow(1 - pow(d / h, 3), 3) AS w FROM away JOIN reach USING (k) WHERE d < h),
line AS (SELECT k, sum(w) AS s0, sum(w * u) AS su, sum(w * v) AS sv, sum(w * u * u) AS suu, sum(w * u * v) AS suv FROM weighed GROUP BY k),
fits AS (SELECT k, xk, spot, (sv - (s0 * suv - su * sv) / (s0 * suu - su * su) * su) / s0 AS fk FROM line JOIN node USING (k)),
spans AS (SELECT *, lead(xk) OVER (ORDER BY k) AS x_next, lead(fk) OVER (ORDER BY k) AS f_next FROM fits)
SELECT x, y, idx, round(CASE WHEN x = xk THEN fk ELSE fk + (x - xk) / (x_next - xk) * (f_next - fk) END, 1) AS fit
FROM i ASOF JOIN spans ON i.idx >= spans.spot""")
def ts_trend_points(spark, sf):
    """The trend of all orders, unbucketed: fitted at 100 points, drawn straight in between."""
    trend = SR.loess(load(spark, sf, "orders"), "o_orderkey", "o_totalprice", vertices=100)
    return trend.select("x", "y", "idx", F.round("fit", 1).alias("fit"))


@register("ts_outliers", f"""
WITH t AS ({_loess_sql()}), r AS (SELECT *, y - fit AS residual FROM t),
m AS (SELECT median(residual) AS med FROM r), mad AS (SELECT median(abs(residual - (SELECT med FROM m))) AS mad FROM r)
SELECT x, y, round(fit, 6) AS fit, round(residual, 6) AS residual, round(residual / (1.4826 * (SELECT mad FROM mad)), 6) AS z
FROM r WHERE abs(residual / (1.4826 * (SELECT mad FROM mad))) > 3.0""")
def ts_outliers(spark, sf):
    tr = SR.loess(_hourly(spark, sf), "x", "y")
    out = SR.outliers(tr, threshold=3.0)
    return out.select("x", "y", F.round("fit", 6).alias("fit"), F.round("residual", 6).alias("residual"), F.round("z", 6).alias("z"))


@register("detect_epoch", """
WITH e AS (SELECT epoch(ts)::BIGINT AS created_at, epoch_ms(ts) AS ts_ms, value AS amount_ms, user_id AS user_at FROM events),
ends AS (SELECT 'created_at' AS column_name, min(created_at) AS lo, max(created_at) AS hi FROM e
         UNION ALL SELECT 'ts_ms', min(ts_ms), max(ts_ms) FROM e
         UNION ALL SELECT 'amount_ms', min(amount_ms), max(amount_ms) FROM e
         UNION ALL SELECT 'user_at', min(user_at), max(user_at) FROM e),
units AS (SELECT column_name, CASE WHEN lo >= 1e9 AND hi <= 4e9 THEN 's' WHEN lo >= 1e12 AND hi <= 4e12 THEN 'ms'
                                   WHEN lo >= 1e15 AND hi <= 4e15 THEN 'us' END AS unit FROM ends)
SELECT * FROM units WHERE unit IS NOT NULL""")
def detect_epoch(spark, sf):
    ev = load(spark, sf, "events")
    us = epoch_micros(F.col("ts"), ev.schema["ts"].dataType)
    ev = ev.select(F.floor(us / 1000000).alias("created_at"), F.floor(us / 1000).alias("ts_ms"),
                                          F.col("value").alias("amount_ms"), F.col("user_id").alias("user_at"))
    return SR.detect_epoch(ev)
