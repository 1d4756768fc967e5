"""Time-series overview (2.I): bucketed series, LOESS trend, distance-from-trend
outliers and epoch-column detection.

The trend works on the *bucketed* series (one row per bucket; its length is
bounded by the bucket rule: hours for <= 2 days, days for <= 90, months for
<= 1500, else years), never on raw rows.

LOESS (the reference drew it in the browser; parameters are ours): local
linear fit at every bucket with tricube weights over the q = ceil(span * n)
nearest buckets (span 0.3), w = (1 - (d / d_q)^3)^3 for d < d_q, no robustness
iterations.  The fit is made at ``vertices`` points evenly spaced in the order (at every point
of a shorter series) and drawn straight in between, so a series of n points costs
n * vertices, whatever its length.  The bandwidth of a vertex is found by moving a window of q
consecutive points over it: the least over the windows of the farther end.

Outliers: robust z = residual / (1.4826 * MAD of residuals); |z| > threshold.
"""
from __future__ import annotations

import math


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from tablescope.operators.facets import granularity
from tablescope.operators.filters import col
from tablescope.operators.census import checkpoint
from tablescope.operators.ordered import ordered_scan
from tablescope.operators.stats import exact_quantiles
from tablescope.types import EPOCH_NAME, is_numeric, is_temporal

LOESS_SPAN = 0.3
OUTLIER_Z = 3.0
#: points at which LOESS fits a line of its own; the fit is drawn straight between them
LOESS_VERTICES = 1000
MAD_SCALE = 1.4826
# plausible epoch values (years 2001-2096) per unit
EPOCH_BOUNDS = {"s": (1e9, 4e9), "ms": (1e12, 4e12), "us": (1e15, 4e15)}


def first_time_column(df: DataFrame) -> str | None:
    for f in df.schema.fields:
        if is_temporal(f.dataType):
            return f.name
    return None


def overview(df: DataFrame, ts: str | None = None, value: str | None = None, unit: str | None = None) -> DataFrame:
    """I1  (bucket, n[, sum_value, avg_value]) by auto granularity of ``ts``."""
    ts = ts or first_time_column(df)
    if ts is None:
        raise ValueError("no time column")
    if unit is None:
        r = df.agg(F.datediff(F.to_date(F.max(col(ts))), F.to_date(F.min(col(ts)))).alias("d")).collect()[0]
        unit = granularity(r["d"])
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs += [F.sum(col(value)).alias("sum_value"), F.avg(col(value)).alias("avg_value")]
    # date_trunc answers a zoned timestamp; the bucket keeps the input's wall clock
    bucket = F.date_trunc(unit, col(ts).cast("timestamp_ntz")).cast("timestamp_ntz")
    return (df.where(col(ts).isNotNull()).groupBy(bucket.alias("bucket"))
            .agg(*aggs))


def loess(series: DataFrame, x: str, y: str, span: float = LOESS_SPAN, vertices: int = LOESS_VERTICES) -> DataFrame:
    """I2  (x, y, idx, fit): local linear LOESS over an ordered series, fitted at up to ``vertices`` points."""
    base = series.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), F.lit(1).alias("one"))
    idx = checkpoint(ordered_scan(base, [], ["x", "y"], sums=["one"]).select("x", "y", (F.col("cum_one") - 1).alias("idx")))
    n = idx.count()
    if n < 2:
        return idx.withColumn("fit", F.col("y"))
    q = min(max(2, math.ceil(span * n)), n)
    steps, gaps = n - 1, min(n, max(2, vertices)) - 1
    at = f"k * {steps}L div {gaps}L"                                       # the point of vertex k
    from_point = lambda e: F.expr(f"({e} * {gaps}L + {steps - 1}L) div {steps}L")          # noqa: E731  the first vertex at point e or behind it
    up_to_point = lambda e: F.expr(f"least({gaps}L, (({e} + 1L) * {gaps}L + {steps - 1}L) div {steps}L - 1L)")   # noqa: E731  the last one not behind it
    # the vertices: at most ``vertices`` rows, so they may be broadcast
    nodes = (idx.withColumn("k", from_point("idx")).where(F.expr(at) == F.col("idx")).select("k", F.col("x").alias("xk")))
    meets = lambda df, first, last: (df.withColumn("k0", F.greatest(F.lit(0).cast("long"), from_point(first))).withColumn("k1", up_to_point(last))
                                     .where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1"))).drop("k0", "k1"))
    ends = idx.select(F.col("idx") - (q - 1), F.col("x").alias("right")).toDF("idx", "right")
    windows = meets(idx.join(ends, "idx").select("idx", F.col("x").alias("left"), "right"), "idx", f"(idx + {q - 1}L)")
    reach = (windows.join(F.broadcast(nodes), "k").groupBy("k")
             .agg(F.first("xk").alias("xk"), F.min(F.greatest(F.col("xk") - F.col("left"), F.col("right") - F.col("xk"))).alias("h")))
    reach = checkpoint(reach)
    near = meets(idx, f"(idx - {q - 1}L)", f"(idx + {q - 1}L)").join(F.broadcast(reach), "k")
    u, v = F.col("x") - F.col("xk"), F.col("y")
    w = F.when(F.abs(u) < F.col("h"), F.pow(1 - F.pow(F.abs(u) / F.col("h"), 3), 3)).when((F.col("h") == 0) & (u == 0), F.lit(1.0))
    moments = (near.select("k", "xk", u.alias("u"), v.alias("v"), w.alias("w")).where("w is not null and v is not null").groupBy("k").agg(
        F.first("xk").alias("xk"), F.sum("w").alias("s0"), F.sum(F.expr("w * u")).alias("su"), F.sum(F.expr("w * v")).alias("sv"),
        F.sum(F.expr("w * u * u")).alias("suu"), F.sum(F.expr("w * u * v")).alias("suv")))
    spread = F.expr("s0 * suu - su * su")
    slope = F.when(spread > 1e-12 * F.expr("s0 * suu"), F.expr("s0 * suv - su * sv") / spread).otherwise(F.lit(0.0))
    fits = checkpoint(moments.select("k", "xk", ((F.col("sv") - slope * F.col("su")) / F.col("s0")).alias("fk")))
    ahead = fits.select((F.col("k") - 1).alias("k"), F.col("xk").alias("x_next"), F.col("fk").alias("f_next"))
    lines = fits.join(F.broadcast(ahead), "k", "left")
    along = (F.col("x") - F.col("xk")) / (F.col("x_next") - F.col("xk"))
    fit = F.when(F.col("x_next").isNull() | (F.col("x_next") == F.col("xk")) | (F.col("x") == F.col("xk")), F.col("fk")).otherwise(
        F.col("fk") + along * (F.col("f_next") - F.col("fk")))
    return idx.withColumn("k", up_to_point("idx")).join(F.broadcast(lines), "k").select("x", "y", "idx", fit.alias("fit"))


def outliers(trend: DataFrame, threshold: float = OUTLIER_Z, top: int | None = None) -> DataFrame:
    """I3  (x, y, fit, residual, z) for |z| > threshold, most extreme first."""
    r = checkpoint(trend.withColumn("residual", F.col("y") - F.col("fit")))   # read four times
    middle = lambda df, c: next((row["value"] for row in exact_quantiles(df, [c], [0.5]).collect()), None)
    med = middle(r, "residual")     # medians from ranks: no task holds the series
    mad = None if med is None else middle(r.select(F.abs(F.col("residual") - F.lit(med)).alias("away")), "away")
    if not mad:
        return r.withColumn("z", F.lit(None).cast("double")).limit(0)
    out = (r.withColumn("z", F.col("residual") / F.lit(MAD_SCALE * mad))
           .where(F.abs(F.col("z")) > threshold).orderBy(F.abs(F.col("z")).desc(), F.col("x")))
    return out.limit(top) if top else out


def detect_epoch(df: DataFrame) -> DataFrame:
    """I5  (column_name, unit) for numeric columns with time-ish names whose
    values all fall in a plausible epoch range (``*_ms`` prefers ms)."""
    spark = df.sparkSession
    cands = [f.name for f in df.schema.fields if is_numeric(f.dataType) and EPOCH_NAME.match(f.name)]
    if not cands:
        return spark.createDataFrame([], "column_name string, unit string")
    r = df.agg(*[F.min(col(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(cands)],
               *[F.max(col(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(cands)]).collect()[0]
    rows = []
    for i, c in enumerate(cands):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is None:
            continue
        units = ["ms", "s", "us"] if c.lower().endswith("_ms") else ["s", "ms", "us"]
        for u in units:
            a, b = EPOCH_BOUNDS[u]
            if a <= lo and hi <= b:
                rows.append((c, u))
                break
    return spark.createDataFrame(rows, "column_name string, unit string")
