"""2.H1-H11, H21, H22  Tile data shapes."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import tiles as TL
from tablescope.plans import load, register


def _r(c, d=6):
    return F.round(F.col(c), d).alias(c)


@register("tile_bar", """
SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice
FROM lineitem GROUP BY l_returnflag""")
def tile_bar(spark, sf):
    out = TL.category_series(load(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    return out.select("l_returnflag", _r("l_quantity", 2), _r("l_extendedprice", 2))


PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("tile_stacked", "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, " + ", ".join(
    f"round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 2) AS \"{p}\"" for p in PRIOS)
    + " FROM orders GROUP BY 1")
def tile_stacked(spark, sf):
    o = load(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    out = TL.stacked_series(o, "yr", "o_orderpriority", "o_totalprice", categories=PRIOS)
    return out.select("yr", *[F.round(F.col(f"`{p}`"), 2).alias(p) for p in PRIOS])


@register("tile_daily", """
SELECT CAST(ts AS DATE) AS bucket, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1""")
def tile_daily(spark, sf):
    out = TL.bucketed_counts(load(spark, sf, "events"), "ts", "day", value="value")
    return out.select("bucket", "n", _r("value", 2))


@register("tile_cumulative", """
SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS cum_n
FROM (SELECT CAST(ts AS DATE) AS bucket, count(*) AS n FROM events GROUP BY 1)""")
def tile_cumulative(spark, sf):
    daily = TL.bucketed_counts(load(spark, sf, "events"), "ts", "day")
    return TL.cumulative(daily, "bucket", "n").select("bucket", "n", "cum_n")


def _orders_region(spark, sf):
    o, c, n, r = (load(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))


@register("tile_heatmap", """
WITH f AS (SELECT n.n_name AS x, CAST(o.o_orderdate AS DATE) AS y FROM orders o
           JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT xs.x, ys.y, CAST(coalesce(cnt, 0) AS DOUBLE) AS value
FROM (SELECT DISTINCT x FROM f) xs CROSS JOIN (SELECT DISTINCT y FROM f) ys
LEFT JOIN (SELECT x, y, count(*) AS cnt FROM f GROUP BY x, y) g ON g.x = xs.x AND g.y = ys.y""")
def tile_heatmap(spark, sf):
    """Nation x day counts of all orders: most days have no order from some nation, so the grid has empty cells."""
    o, c, n = (load(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).withColumn("day", F.col("o_orderdate").cast("date"))
    return TL.heatmap_grid(rows, "n_name", "day")


@register("tile_heatmap_all", """
WITH f AS (SELECT r.r_name AS x, o.o_orderpriority AS y FROM orders o
           JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
           JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT xs.x, ys.y, CAST(coalesce(cnt, 0) AS DOUBLE) AS value
FROM (SELECT DISTINCT x FROM f) xs CROSS JOIN (SELECT DISTINCT y FROM f) ys
LEFT JOIN (SELECT x, y, count(*) AS cnt FROM f GROUP BY x, y) g ON g.x = xs.x AND g.y = ys.y""")
def tile_heatmap_all(spark, sf):
    """Region x priority counts of all orders."""
    return TL.heatmap_grid(_orders_region(spark, sf), "r_name", "o_orderpriority")


@register("tile_box", """
SELECT c_mktsegment, CAST(min(c_acctbal) AS DOUBLE) AS min_value, round(quantile_cont(c_acctbal, 0.25), 6) AS q1,
       round(median(c_acctbal), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS q3,
       CAST(max(c_acctbal) AS DOUBLE) AS max_value
FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
def tile_box(spark, sf):
    out = TL.box_from_values(load(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return out.select("c_mktsegment", "min_value", _r("q1"), _r("median"), _r("q3"), "max_value")


BOX_VIEW = """(SELECT event_type, min(value) AS lo, quantile_cont(value, 0.25) AS q1, median(value) AS med,
  CASE WHEN event_type = 'view' THEN NULL ELSE quantile_cont(value, 0.75) END AS q3, max(value) AS hi
  FROM events GROUP BY event_type)"""


@register("tile_box_scale", f"""
SELECT event_type, lo, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, hi,
       (SELECT min(lo) FROM {BOX_VIEW} WHERE q3 IS NOT NULL) AS scale_lo,
       (SELECT max(hi) FROM {BOX_VIEW} WHERE q3 IS NOT NULL) AS scale_hi
FROM {BOX_VIEW} WHERE lo IS NOT NULL AND q1 IS NOT NULL AND med IS NOT NULL AND q3 IS NOT NULL AND hi IS NOT NULL""")
def tile_box_scale(spark, sf):
    ev = load(spark, sf, "events")
    five = TL.box_from_values(ev, "event_type", "value").select(
        "event_type", F.col("min_value").alias("lo"), "q1", F.col("median").alias("med"),
        F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("q3")).alias("q3"), F.col("max_value").alias("hi"))
    out = TL.box_tile(five, "event_type", ["lo", "q1", "med", "q3", "hi"])
    return out.select("event_type", "lo", _r("q1"), _r("med"), _r("q3"), "hi", "scale_lo", "scale_hi")


def _density_sql(cells=128):
    spread = "CASE WHEN iqr > 0 AND iqr / 1.34 < coalesce(sd, 0) THEN iqr / 1.34 ELSE sd END"
    return f"""
WITH obs AS (SELECT c_mktsegment AS g, CAST(c_acctbal AS DOUBLE) AS v FROM customer
             WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL),
r AS (SELECT min(v) AS lo, (max(v) - min(v)) / {cells} AS w FROM obs),
st AS (SELECT g, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd,
              quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM obs GROUP BY g),
bw AS (SELECT g, n, mean, CASE WHEN coalesce({spread}, 0) > 0 THEN 0.9 * ({spread}) * pow(n::DOUBLE, -0.2)
                               ELSE (SELECT w FROM r) END AS h FROM st),
b AS (SELECT g, least({cells - 1}, CAST(floor((v - r.lo) / r.w) AS INTEGER)) AS c, count(*) AS k FROM obs, r GROUP BY 1, 2),
e AS (SELECT b.g, grid.cell, b.k, bw.h, bw.n, bw.mean,
             ((r.lo + (grid.cell + 0.5) * r.w) - (r.lo + (b.c + 0.5) * r.w)) / bw.h AS z
      FROM b JOIN bw ON b.g = bw.g CROSS JOIN (SELECT CAST(range AS INTEGER) AS cell FROM range(0, {cells})) grid, r)
SELECT e.g AS c_mktsegment, e.cell, round((SELECT lo FROM r) + (e.cell + 0.5) * (SELECT w FROM r), 6) AS x,
       round(sum(e.k * exp(-0.5 * e.z * e.z)) / (first(e.n) * first(e.h) * sqrt(2 * pi())), 12) AS density,
       first(e.n) AS n, round(first(e.mean), 6) AS mean
FROM e GROUP BY e.g, e.cell"""


@register("tile_density", _density_sql())
def tile_density(spark, sf):
    out = TL.density(load(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return out.select("c_mktsegment", "cell", _r("x"), _r("density", 12), "n", _r("mean"))


@register("tile_scatter_points", """
SELECT p_size AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def tile_scatter_points(spark, sf):
    return TL.scatter_points(load(spark, sf, "part"), "p_size", "p_retailprice")


@register("tile_scatter", """
WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT min(x) AS x0, (max(x) - min(x)) / 32 AS wx, min(y) AS y0, (max(y) - min(y)) / 32 AS wy FROM p),
b AS (SELECT least(31, CAST(floor((x - x0) / wx) AS INTEGER)) AS bin_x, least(31, CAST(floor((y - y0) / wy) AS INTEGER)) AS bin_y
      FROM p, r)
SELECT bin_x, bin_y, round((SELECT x0 FROM r) + bin_x * (SELECT wx FROM r), 6) AS x_lo,
       round((SELECT y0 FROM r) + bin_y * (SELECT wy FROM r), 6) AS y_lo, count(*) AS cnt FROM b GROUP BY bin_x, bin_y""")
def tile_scatter(spark, sf):
    out = TL.scatter_bins(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", bins=32)
    return out.select("bin_x", "bin_y", _r("x_lo"), _r("y_lo"), "cnt")


@register("tile_quadrant", """
SELECT p_name AS label, round(p_size / 25.0 - 1, 6) AS x, round((p_retailprice - 1500) / 600, 6) AS y,
  (CASE WHEN p_size / 25.0 - 1 < 0 THEN 'low' ELSE 'high' END) || '-' ||
  (CASE WHEN (p_retailprice - 1500) / 600 < 0 THEN 'low' ELSE 'high' END) AS quadrant,
  (p_size / 25.0 - 1 BETWEEN -1 AND 1) AND ((p_retailprice - 1500) / 600 BETWEEN -1 AND 1) AS in_range
FROM part""")
def tile_quadrant(spark, sf):
    p = load(spark, sf, "part").select("p_name", (F.col("p_size") / 25.0 - 1).alias("effort"),
                                       ((F.col("p_retailprice") - 1500) / 600).alias("impact"))
    out = TL.quadrant(p, "effort", "impact", "p_name")
    return out.select("label", _r("x"), _r("y"), "quadrant", "in_range")


CUST_GEO = """(SELECT CAST(c_nationkey * 7.0 - 85 AS DOUBLE) AS lat, (c_acctbal + 1000) / 11000 * 360 - 180 AS lon, c_acctbal, c_mktsegment
FROM customer)"""


@register("tile_map", f"""
WITH p AS (SELECT CAST(floor((lon + 180) / 2.0) AS INTEGER) AS cx, CAST(floor((90 - lat) / 2.0) AS INTEGER) AS cy,
                  CAST(c_acctbal AS DOUBLE) AS v, c_mktsegment AS lbl FROM {CUST_GEO}
           WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
l AS (SELECT cx, cy, lbl, count(*) AS k FROM p WHERE lbl IS NOT NULL GROUP BY ALL),
t AS (SELECT cx, cy, string_agg(lbl, '|' ORDER BY k DESC, lbl) AS labels FROM
      (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY k DESC, lbl) AS rn FROM l) WHERE rn <= 5 GROUP BY cx, cy)
SELECT a.cx, a.cy, CAST(90.0 - (a.cy + 0.5) * 2.0 AS DOUBLE) AS lat, CAST((a.cx + 0.5) * 2.0 - 180.0 AS DOUBLE) AS lon, a.n, round(a.avg_value, 6) AS avg_value, t.labels
FROM (SELECT cx, cy, count(*) AS n, avg(v) AS avg_value FROM p GROUP BY cx, cy) a LEFT JOIN t ON a.cx = t.cx AND a.cy = t.cy""")
def tile_map(spark, sf):
    c = load(spark, sf, "customer").select((F.col("c_nationkey") * 7.0 - 85).alias("lat"),
                                           ((F.col("c_acctbal") + 1000) / 11000 * 360 - 180).alias("lon"),
                                           "c_acctbal", "c_mktsegment")
    out = TL.map_points(c, value="c_acctbal", label="c_mktsegment", labels=5)
    return out.select("cx", "cy", "lat", "lon", "n", _r("avg_value"), F.array_join("labels", "|").alias("labels"))


def _flows(spark, sf):
    li, o, c, s, n = (load(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    geo = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"),
                   (F.col("n_nationkey") * 7.0 - 85).alias("lat"), (F.pmod(F.col("n_nationkey") * 47, F.lit(360)) - 180).cast("double").alias("lon"))
    pairs = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey)
             .groupBy(F.col("c_nationkey").alias("fk"), F.col("s_nationkey").alias("tk")).agg(F.count(F.lit(1)).alias("n")))
    f = geo.select([F.col(x).alias("f_" + x) for x in geo.columns])
    t = geo.select([F.col(x).alias("t_" + x) for x in geo.columns])
    # the nation lookup is tiny: the planner broadcasts it from the file statistics
    return pairs.join(f, pairs.fk == f.f_k).join(t, pairs.tk == t.t_k)


FLOWS_SQL = """(SELECT fn.n_name AS from_nation, tn.n_name AS to_nation,
  CAST(fn.n_nationkey * 7.0 - 85 AS DOUBLE) AS from_lat, CAST((fn.n_nationkey * 47) % 360 - 180 AS DOUBLE) AS from_lon,
  CAST(tn.n_nationkey * 7.0 - 85 AS DOUBLE) AS to_lat, CAST((tn.n_nationkey * 47) % 360 - 180 AS DOUBLE) AS to_lon, count(*) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation fn ON c.c_nationkey = fn.n_nationkey
JOIN nation tn ON s.s_nationkey = tn.n_nationkey GROUP BY ALL)"""


@register("tile_flows", f"""
SELECT from_lat, from_lon, to_lat, to_lon,
  CAST(CASE WHEN to_lon - from_lon > 180 THEN to_lon - 360 WHEN to_lon - from_lon < -180 THEN to_lon + 360 ELSE to_lon END AS DOUBLE) AS to_lon_drawn,
  abs(to_lon - from_lon) > 180 AS wraps, from_nation, to_nation, n FROM {FLOWS_SQL}""")
def tile_flows(spark, sf):
    f = _flows(spark, sf).select(F.col("f_lat").alias("from_lat"), F.col("f_lon").alias("from_lon"),
                                 F.col("t_lat").alias("to_lat"), F.col("t_lon").alias("to_lon"),
                                 F.col("f_name").alias("from_nation"), F.col("t_name").alias("to_nation"), "n")
    return TL.map_flows(f)


@register("tile_flow_endpoints", f"""
SELECT lat, lon, count(*) AS arcs, min(label) AS label, count(*) FILTER (WHERE e = 'from') AS as_from,
       count(*) FILTER (WHERE e = 'to') AS as_to
FROM (SELECT from_lat AS lat, from_lon AS lon, from_nation AS label, 'from' AS e FROM {FLOWS_SQL}
      UNION ALL SELECT to_lat, to_lon, to_nation, 'to' FROM {FLOWS_SQL}) GROUP BY lat, lon""")
def tile_flow_endpoints(spark, sf):
    f = _flows(spark, sf)
    return TL.flow_endpoints(f, "f_lat", "f_lon", "t_lat", "t_lon", "f_name", "t_name")


DAILY_STATS = """(SELECT CAST(ts AS DATE) AS day, avg(value) AS y, stddev_samp(value) AS sd, count(*) AS n
FROM events GROUP BY 1)"""


@register("tile_band", f"""
SELECT day AS x, round(y, 6) AS y, round(y - sd, 6) AS lower, round(y + sd, 6) AS upper, (y - sd) <= (y + sd) AS band_ok
FROM {DAILY_STATS}""")
def tile_band(spark, sf):
    d = (load(spark, sf, "events").groupBy(F.to_date("ts").alias("day"))
         .agg(F.avg("value").alias("y"), F.stddev_samp("value").alias("sd")))
    d = d.select("day", "y", (F.col("y") - F.col("sd")).alias("lo"), (F.col("y") + F.col("sd")).alias("hi"))
    return TL.band(d, "day", "y", "lo", "hi").select("x", _r("y"), _r("lower"), _r("upper"), "band_ok")


@register("tile_threshold", f"SELECT day AS x, CAST(n AS DOUBLE) AS y, n > 300 AS above_0, n > 340 AS above_1 FROM {DAILY_STATS}")
def tile_threshold(spark, sf):
    d = TL.bucketed_counts(load(spark, sf, "events"), "ts", "day")
    return TL.threshold(d, "bucket", "n", [300, 340])


@register("tile_quadrant_mermaid", """
SELECT 1 AS line_no, 'quadrantChart' AS line
UNION ALL SELECT 2, '  x-axis Low effort --> High effort'
UNION ALL SELECT 3, '  y-axis Low impact --> High impact'
UNION ALL
SELECT 3 + row_number() OVER (ORDER BY p_partkey), '  ' || p_name || ': [' || format('{:.3f}', (p_size / 25.0 - 1 + 1) / 2)
       || ', ' || format('{:.3f}', ((p_retailprice - 1500) / 600 + 1) / 2) || ']'
FROM part""")
def tile_quadrant_mermaid(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_size") / 25.0 - 1).alias("effort"),
                                       ((F.col("p_retailprice") - 1500) / 600).alias("impact"))
    return TL.quadrant_mermaid_lines(p, "effort", "impact", "p_name", "p_partkey", "effort", "impact")
