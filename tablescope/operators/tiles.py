"""Chart-ready data shapes of the tiles (2.H1-H11, H21, H22).  Only the table
behind each chart is built, never the picture.

No operator here cross joins: full heatmap grids join aggregated cells to their
axes, densities
``explode`` a fixed evaluation grid per aggregated cell, and scalar ranges are
computed by one aggregate and applied as literals.
"""
from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.census import checkpoint, top_k_per_group
from tablescope.operators.filters import col
from tablescope.operators.ordered import order_quantiles, ordered_scan, value_ranks
from tablescope.types import find_coordinates, is_numeric

_AGGS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _agg(name: str, c: Column) -> Column:
    if name not in _AGGS:
        raise ValueError(f"unknown aggregate {name!r}")
    return _AGGS[name](c)


def category_series(df: DataFrame, x: str, ys: Sequence[str], agg: str = "sum") -> DataFrame:
    """H1  One row per x, one aggregated column per y (bar / pie / line / area)."""
    if not ys:
        raise ValueError("a series needs at least one y column")
    return df.groupBy(col(x).alias(x)).agg(*[_agg(agg, col(y)).alias(y) for y in ys])


def stacked_series(df: DataFrame, x: str, series: str, value: str, categories: Sequence | None = None,
                   agg: str = "sum") -> DataFrame:
    """H2  One column per series value: ``sum(v) FILTER (WHERE cat = ...)``.
    ``categories=None`` discovers them (bounded by the pivot value limit)."""
    g = df.groupBy(col(x).alias(x))
    g = g.pivot(series, list(categories)) if categories is not None else g.pivot(series)
    return g.agg(_agg(agg, col(value)))


def time_bucket(c: Column, unit: str) -> Column:
    """H3  Timestamps to DATE (``day``) or truncated timestamps (hour/week/month/year)."""
    if unit == "day":
        return F.to_date(c)
    if unit == "week":
        return F.to_date(F.date_trunc("week", c))
    return F.date_trunc(unit, c)


def bucketed_counts(df: DataFrame, ts: str, unit: str = "day", value: str | None = None,
                    agg: str = "sum") -> DataFrame:
    out = df.where(col(ts).isNotNull()).groupBy(time_bucket(col(ts), unit).alias("bucket"))
    aggs = [F.count(F.lit(1)).alias("n")]
    if value is not None:
        aggs.append(_agg(agg, col(value)).alias(value))
    return out.agg(*aggs)


def cumulative(series: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """H4  Running sum over an ordered (bucketed) series: ``cum_<value>``."""
    return ordered_scan(series, keys, [order], sums=[value])


def heatmap_grid(df: DataFrame, x: str, y: str, value: str | None = None, agg: str = "sum") -> DataFrame:
    """H5  One row per (x, y) of the full grid; missing cells are 0.

    Cells are aggregated once; the grid is the product of the two tables of distinct
    labels, to which the cells are joined.  Labels may be any text."""
    measure = F.count(F.lit(1)) if value is None else _agg(agg, col(value))
    cells = (df.where(col(x).isNotNull() & col(y).isNotNull())
             .groupBy(col(x).alias("x"), col(y).cast("string").alias("y")).agg(measure.cast("double").alias("value")))
    cells = checkpoint(cells)
    # the grid is as many rows as its axes ask for; each x gets the numbers of the y axis, then their labels
    ys = value_ranks(cells.select(F.lit(0).alias("g"), "y").distinct().withColumn("n", F.lit(1).cast("long")), ["g"], "y")
    ys = checkpoint(ys.select("y", F.col("before").alias("yi")))
    grid = (cells.select("x").distinct().withColumn("yi", F.explode(F.sequence(F.lit(0), F.lit(max(ys.count() - 1, 0)).cast("long"))))
            .join(ys, "yi").select("x", "y"))
    return grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def grouped_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact ``quantile_cont`` per group without holding a group in one task:
    census ``(group, value) -> n``, distributed prefix sums, order statistics.
    Returns (group, p, q)."""
    counts = (df.where(col(group).isNotNull() & col(value).isNotNull())
              .groupBy(col(group).alias("g"), col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    return order_quantiles(value_ranks(counts, ["g"], "v"), "g", "v", probs).withColumnRenamed("g", group)


def box_from_values(df: DataFrame, group: str, value: str) -> DataFrame:
    """H6  Five-number summary per group (exact quartiles, linear interpolation)."""
    qs = grouped_quantiles(df, group, value, (0.25, 0.5, 0.75))
    pick = lambda p: F.max(F.when(F.col("p") == F.lit(p), F.col("q")))
    quart = qs.groupBy(group).agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))
    ends = (df.where(col(value).isNotNull()).groupBy(col(group).alias(group))
            .agg(F.min(col(value)).cast("double").alias("min_value"), F.max(col(value)).cast("double").alias("max_value")))
    return ends.join(quart, group).select(group, "min_value", "q1", "median", "q3", "max_value")


def box_tile(df: DataFrame, label: str, five: Sequence[str]) -> DataFrame:
    """H6  Pre-aggregated boxes: rows with an incomplete summary are dropped; the
    shared scale (``scale_lo``/``scale_hi``) spans every kept box."""
    if len(five) != 5:
        raise ValueError("a box needs exactly five columns: min, q1, median, q3, max")
    kept = df.where(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in five]))
    lo_hi = kept.agg(F.min(col(five[0])).cast("double").alias("lo"), F.max(col(five[4])).cast("double").alias("hi")).collect()[0]
    return kept.select(col(label).alias(label), *[col(c).cast("double").alias(c) for c in five],
                       F.lit(lo_hi["lo"]).alias("scale_lo"), F.lit(lo_hi["hi"]).alias("scale_hi"))


# Kernel density (the reference drew it in the browser; kernel and bandwidth
# are our choice): Gaussian kernel, Silverman's rule
# h = 0.9 * min(sd, IQR / 1.34) * n^(-1/5) (sd if IQR is 0), evaluated at the
# centres of DENSITY_CELLS equal cells spanning the shared range of all groups;
# observations are first counted per cell (binned KDE).
DENSITY_CELLS = 128


def density(df: DataFrame, group: str, value: str, cells: int = DENSITY_CELLS) -> DataFrame:
    """H7  (group, cell, x, density, n, mean) per group on a shared scale."""
    obs = df.where(col(group).isNotNull() & col(value).isNotNull()).select(
        col(group).alias("g"), col(value).cast("double").alias("v"))
    rng = obs.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()[0]
    if rng["lo"] is None:
        return df.sparkSession.createDataFrame([], f"{group} string, cell int, x double, density double, n long, mean double")
    lo, hi = rng["lo"], rng["hi"]
    width = (hi - lo) / cells if hi > lo else 1.0
    q = grouped_quantiles(obs, "g", "v", (0.25, 0.75))
    iqr = q.groupBy("g").agg((F.max(F.when(F.col("p") == 0.75, F.col("q"))) - F.max(F.when(F.col("p") == 0.25, F.col("q")))).alias("iqr"))
    stats = obs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    spread = F.when((F.col("iqr") > 0) & (F.col("iqr") / 1.34 < F.coalesce(F.col("sd"), F.lit(0.0))), F.col("iqr") / 1.34) \
        .otherwise(F.col("sd"))
    bw = stats.join(iqr, "g").withColumn(
        "h", F.when(F.coalesce(spread, F.lit(0.0)) > 0, 0.9 * spread * F.pow(F.col("n").cast("double"), -0.2)).otherwise(F.lit(width)))
    cell_of = F.least(F.lit(cells - 1), F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int"))
    binned = obs.groupBy("g", cell_of.alias("c")).agg(F.count(F.lit(1)).alias("k"))
    centre = lambda c: F.lit(lo) + (c + 0.5) * F.lit(width)
    contrib = (binned.join(bw.select("g", "h", "n"), "g")
               .select("g", "c", "k", "h", "n", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
               .withColumn("z", (centre(F.col("cell")) - centre(F.col("c"))) / F.col("h")))
    dens = contrib.groupBy("g", "cell").agg(
        (F.sum(F.col("k") * F.exp(-0.5 * F.col("z") * F.col("z"))) /
         (F.first("n") * F.first("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
    return (dens.join(stats.select("g", "n", "mean"), "g")
            .select(F.col("g").alias(group), "cell", centre(F.col("cell")).alias("x"), "density", "n", "mean"))


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """H8  (x, y) of every row that has both values."""
    return df.where(col(x).isNotNull() & col(y).isNotNull()).select(col(x).alias("x"), col(y).alias("y"))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 64) -> DataFrame:
    """H8  The binned form, which the caller chooses for many points: 2-D bin
    counts (bin_x, bin_y, x_lo, y_lo, cnt) on ``bins`` x ``bins`` equal cells."""
    pts = df.where(col(x).isNotNull() & col(y).isNotNull()).select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    r = pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect()[0]
    if r[0] is None:
        return df.sparkSession.createDataFrame([], "bin_x int, bin_y int, x_lo double, y_lo double, cnt long")
    wx = (r[1] - r[0]) / bins if r[1] > r[0] else 1.0
    wy = (r[3] - r[2]) / bins if r[3] > r[2] else 1.0
    bx = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.lit(r[0])) / F.lit(wx)).cast("int"))
    by = F.least(F.lit(bins - 1), F.floor((F.col("y") - F.lit(r[2])) / F.lit(wy)).cast("int"))
    return (pts.groupBy(bx.alias("bin_x"), by.alias("bin_y")).agg(F.count(F.lit(1)).alias("cnt"))
            .select("bin_x", "bin_y", (F.lit(r[0]) + F.col("bin_x") * F.lit(wx)).alias("x_lo"),
                    (F.lit(r[2]) + F.col("bin_y") * F.lit(wy)).alias("y_lo"), "cnt"))


def quadrant(df: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """H9  Items on a -1..1 x -1..1 plane; centre lines split low/high."""
    for c in (x, y):
        if not is_numeric(df.schema[c].dataType):
            raise ValueError(f"quadrant: {c} must be numeric")
    xs, ys = col(x).cast("double"), col(y).cast("double")
    side = lambda c: F.when(c < 0, F.lit("low")).otherwise(F.lit("high"))
    return df.select(col(label).alias("label"), xs.alias("x"), ys.alias("y"),
                     F.concat(side(xs), F.lit("-"), side(ys)).alias("quadrant"),
                     (xs.between(-1, 1) & ys.between(-1, 1)).alias("in_range"))


# Map grid (the reference's cell size lived in the browser): 2-degree cells.
MAP_CELL_DEG = 2.0


def map_points(df: DataFrame, lat: str | None = None, lon: str | None = None, value: str | None = None, label: str | None = None,
               cell_deg: float = MAP_CELL_DEG, labels: int | None = None) -> DataFrame:
    """H10  Points to grid cells: (cx, cy, lat, lon, n, avg_value, labels).  With ``label``, ``labels``
    says how many of a cell's most frequent labels are listed.  Coordinates that are not
    named are found by their usual names."""
    lat, lon = find_coordinates(df.schema, {"lat": lat, "lon": lon})
    if label and labels is None:
        raise ValueError("map: say how many labels a cell lists")
    pts = df.where(col(lat).between(-90, 90) & col(lon).between(-180, 180))
    cx = F.floor((col(lon) + 180) / F.lit(cell_deg)).cast("int")
    cy = F.floor((F.lit(90) - col(lat)) / F.lit(cell_deg)).cast("int")
    keyed = pts.select(cx.alias("cx"), cy.alias("cy"), *([col(value).cast("double").alias("v")] if value else []),
                       *([col(label).cast("string").alias("lbl")] if label else []))
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.avg("v").alias("avg_value")] if value else [])
    cells = keyed.groupBy("cx", "cy").agg(*aggs).withColumn(
        "lat", F.lit(90.0) - (F.col("cy") + 0.5) * F.lit(cell_deg)).withColumn(
        "lon", (F.col("cx") + 0.5) * F.lit(cell_deg) - F.lit(180.0))
    if label:
        # the most frequent labels per cell, exact top-k
        lc = keyed.where(F.col("lbl").isNotNull()).groupBy("cx", "cy", "lbl").agg(F.count(F.lit(1)).alias("k"))
        top = top_k_per_group(lc.withColumn("cell", F.concat_ws(":", "cx", "cy")), ["cell"],
                              [F.col("k").desc(), F.col("lbl").asc()], labels, tie_key="lbl")
        lab = top.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("rank", "lbl"))).alias("s")) \
            .select("cx", "cy", F.transform("s", lambda e: e["lbl"]).alias("labels"))
        cells = cells.join(lab, ["cx", "cy"], "left")
    return cells


def _ends(df: DataFrame, from_lat: str | None, from_lon: str | None, to_lat: str | None, to_lon: str | None) -> list[str]:
    return find_coordinates(df.schema, {"from_lat": from_lat, "from_lon": from_lon, "to_lat": to_lat, "to_lon": to_lon})


def map_flows(df: DataFrame, from_lat: str | None = None, from_lon: str | None = None, to_lat: str | None = None, to_lon: str | None = None,
              from_label: str | None = None, to_label: str | None = None) -> DataFrame:
    """H11  Connection arcs: the shorter way round when |dlon| > 180 (the end
    longitude is shifted by 360 and ``wraps`` is set)."""
    from_lat, from_lon, to_lat, to_lon = _ends(df, from_lat, from_lon, to_lat, to_lon)
    d = col(to_lon) - col(from_lon)
    wraps = F.abs(d) > 180
    adj = F.when(d > 180, col(to_lon) - 360).when(d < -180, col(to_lon) + 360).otherwise(col(to_lon))
    extra = [col(c).alias(c) for c in df.columns if c not in (from_lat, from_lon, to_lat, to_lon)]
    return df.select(col(from_lat).alias("from_lat"), col(from_lon).alias("from_lon"), col(to_lat).alias("to_lat"),
                     col(to_lon).alias("to_lon"), adj.cast("double").alias("to_lon_drawn"), wraps.alias("wraps"), *extra)


def flow_endpoints(df: DataFrame, from_lat: str | None = None, from_lon: str | None = None, to_lat: str | None = None, to_lon: str | None = None,
                   from_label: str | None = None, to_label: str | None = None) -> DataFrame:
    """H11  Endpoint markers: both ends stacked, grouped by position, named by
    their from/to label (smallest label when several)."""
    from_lat, from_lon, to_lat, to_lon = _ends(df, from_lat, from_lon, to_lat, to_lon)
    a = df.select(col(from_lat).cast("double").alias("lat"), col(from_lon).cast("double").alias("lon"),
                  (col(from_label) if from_label else F.lit(None)).cast("string").alias("label"), F.lit("from").alias("end"))
    b = df.select(col(to_lat).cast("double").alias("lat"), col(to_lon).cast("double").alias("lon"),
                  (col(to_label) if to_label else F.lit(None)).cast("string").alias("label"), F.lit("to").alias("end"))
    return (a.unionByName(b).groupBy("lat", "lon")
            .agg(F.count(F.lit(1)).alias("arcs"), F.min("label").alias("label"),
                 F.count_if(F.col("end") == "from").alias("as_from"), F.count_if(F.col("end") == "to").alias("as_to")))


def band(df: DataFrame, x: str, y: str, lower: str, upper: str) -> DataFrame:
    """H21  A line with a confidence band: exactly two band columns, checked."""
    missing = [c for c in (x, y, lower, upper) if c not in df.columns]
    if missing:
        raise ValueError(f"band: no column {missing[0]!r}; columns: {', '.join(df.columns)}")
    return df.select(col(x).alias("x"), col(y).cast("double").alias("y"), col(lower).cast("double").alias("lower"),
                     col(upper).cast("double").alias("upper"),
                     (col(lower) <= col(upper)).alias("band_ok"))


def threshold(df: DataFrame, x: str, y: str, targets: Sequence[float]) -> DataFrame:
    """H22  Horizontal reference values: one breach flag per target (y > t)."""
    return df.select(col(x).alias("x"), col(y).cast("double").alias("y"),
                     *[(col(y) > F.lit(float(t))).alias(f"above_{i}") for i, t in enumerate(targets)])


def quadrant_mermaid_lines(df: DataFrame, x: str, y: str, label: str, order: str,
                           xlabel: str = "x", ylabel: str = "y") -> DataFrame:
    """H20  A Mermaid ``quadrantChart`` document, one row per line (line_no, line):
    axes named from the dimension labels, one point per item with the -1..1
    coordinates moved to Mermaid's 0..1 scale (3 decimals)."""
    spark = df.sparkSession
    head = [(1, "quadrantChart"), (2, f"  x-axis Low {xlabel} --> High {xlabel}"),
            (3, f"  y-axis Low {ylabel} --> High {ylabel}")]
    unit = lambda c: F.format_number((col(c).cast("double") + 1) / 2, 3)
    pts = df.where(col(x).isNotNull() & col(y).isNotNull()).select(
        col(order).alias("ord"),
        F.concat(F.lit("  "), F.coalesce(col(label).cast("string"), F.lit("")), F.lit(": ["), unit(x), F.lit(", "),
                 unit(y), F.lit("]")).alias("line"))
    numbered = ordered_scan(pts.withColumn("one", F.lit(1)), [], ["ord"], sums=["one"])
    body = numbered.select((F.col("cum_one") + len(head)).alias("line_no"), "line")
    return spark.createDataFrame(head, "line_no long, line string").unionByName(body)
