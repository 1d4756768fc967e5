"""2.E  Column statistics.  Float aggregates are rounded to 6 decimals in the
registered queries (engines sum in different orders); the operators return
them unrounded."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators.census import checkpoint
from tablescope.operators.filters import Filter
from tablescope.operators.stats import Stats, sketch_quantiles, sketch_rank_error
from tablescope.plans import load, register

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUM = LINEITEM[:8]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def _r(c):
    return F.round(F.col(c), 6).alias(c)


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@register("stats_counts", _union(
    [f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM lineitem"
     for c in LINEITEM]))
def stats_counts(spark, sf):
    return Stats(load(spark, sf, "lineitem")).counts()


@register("stats_distinct", _union(
    [f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct, true AS exact FROM lineitem" for c in LINEITEM]))
def stats_distinct(spark, sf):
    # exact for every column (the reference estimates above 10,000; the estimate
    # is engine-specific, so the checked query counts exactly)
    return Stats(load(spark, sf, "lineitem")).distinct()


@register("stats_minmaxavg", _union(
    [f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS avg FROM lineitem"
     for c in LINEITEM_NUM]))
def stats_minmaxavg(spark, sf):
    return Stats(load(spark, sf, "lineitem")).numeric_summary().select("column_name", "min", "max", _r("avg"))


QUARTILES_SQL = _union(
    [f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median, "
     f"round(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem" for c in LINEITEM_NUM])


@register("stats_quartiles", QUARTILES_SQL)
def stats_quartiles(spark, sf):
    return Stats(load(spark, sf, "lineitem")).quartiles().select("column_name", _r("q1"), _r("median"), _r("q3"))


@register("stats_quartiles_ranked", QUARTILES_SQL)
def stats_quartiles_ranked(spark, sf):
    return (Stats(load(spark, sf, "lineitem")).quartiles()
            .select("column_name", _r("q1"), _r("median"), _r("q3")))


def _hist_sql(table: str, c: str, bins: int = 12) -> str:
    return f"""
SELECT '{c}' AS column_name, CAST(g.bin AS INTEGER) AS bin,
       round(b.lo + ((b.hi - b.lo) / {bins}) * (g.bin - 1), 6) AS lo,
       round(b.lo + ((b.hi - b.lo) / {bins}) * g.bin, 6) AS hi, coalesce(h.cnt, 0) AS cnt
FROM range(1, {bins + 1}) g(bin)
CROSS JOIN (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {table}) b
LEFT JOIN (
  SELECT least({bins}, greatest(1, CAST(floor(({c} - b2.lo) / ((b2.hi - b2.lo) / {bins})) AS BIGINT) + 1)) AS bin, count(*) AS cnt
  FROM {table}, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {table}) b2
  WHERE {c} IS NOT NULL GROUP BY 1) h ON h.bin = g.bin"""


@register("stats_histogram", _union([_hist_sql("lineitem", c) for c in LINEITEM_NUM]))
def stats_histogram(spark, sf):
    return Stats(load(spark, sf, "lineitem")).histogram().select("column_name", "bin", _r("lo"), _r("hi"), "cnt")


@register("stats_top", f"""
SELECT column_name, value, cnt, CAST(row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS INTEGER) AS rank
FROM ({_union([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM part WHERE {c} IS NOT NULL GROUP BY 2" for c in ["p_name", "p_brand", "p_type"]])})
QUALIFY rank <= 12""")
def stats_top(spark, sf):
    return Stats(load(spark, sf, "part")).top()


def _timeline_sql(table, c, where="TRUE"):
    days = f"datediff('day', CAST(min({c}) AS TIMESTAMP), CAST(max({c}) AS TIMESTAMP))"
    gran = (f"(SELECT CASE WHEN coalesce({days}, 0) <= 2 THEN 'hour' WHEN {days} <= 90 THEN 'day' "
            f"WHEN {days} <= 1500 THEN 'month' ELSE 'year' END FROM {table} WHERE {c} IS NOT NULL AND {where})")
    return (f"SELECT '{c}' AS column_name, date_trunc({gran}, CAST({c} AS TIMESTAMP))::VARCHAR AS bucket, count(*) AS cnt "
            f"FROM {table} WHERE {c} IS NOT NULL AND {where} GROUP BY 2")


@register("stats_timeline", _timeline_sql("events", "ts"))
def stats_timeline(spark, sf):
    return Stats(load(spark, sf, "events")).timeline()


@register("stats_timeline_hours", _timeline_sql("events", "ts", "ts < TIMESTAMP '2024-01-03 00:00:00'"))
def stats_timeline_hours(spark, sf):
    # a two-day window -> hourly buckets
    return Stats(load(spark, sf, "events"), filters=[Filter("ts", tmax="2024-01-03 00:00:00")]).timeline()


FILTERED_WHERE = ("CAST(o_orderstatus AS VARCHAR) = 'O' AND (o_totalprice >= 200000.0) AND "
                  "(" + " OR ".join(f"CAST({c} AS VARCHAR) ILIKE '%1995%'" for c in ORDERS) + ")")


@register("stats_filtered", _union(
    [f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, "
     + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS avg"
        if c in ORDERS_NUM else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS avg")
     + f" FROM orders WHERE {FILTERED_WHERE}" for c in ORDERS]))
def stats_filtered(spark, sf):
    st = Stats(load(spark, sf, "orders"), q="1995",
               filters=[Filter("o_orderstatus", value="O"), Filter("o_totalprice", min=200000)])
    return (st.counts().join(st.numeric_summary(), "column_name", "left")
            .select("column_name", "rows", "nulls", "min", "max", _r("avg")))


@register("stats_nested", """
SELECT column_name, value, cnt, CAST(row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS INTEGER) AS rank
FROM (SELECT 'embedding' AS column_name, CAST(embedding AS VARCHAR) AS value, count(*) AS cnt
      FROM embeddings WHERE embedding IS NOT NULL GROUP BY 2)
QUALIFY rank <= 12""")
def stats_nested(spark, sf):
    """A list column gets top values of its whole-list text (no numeric stats)."""
    return Stats(load(spark, sf, "embeddings")).top()


@register("stats_quartiles_small", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median, "
    f"round(quantile_cont({c}, 0.75), 6) AS q3 FROM customer" for c in ["c_custkey", "c_nationkey", "c_acctbal"]))
def stats_quartiles_small(spark, sf):
    return Stats(load(spark, sf, "customer")).quartiles().select("column_name", _r("q1"), _r("median"), _r("q3"))


@register("stats_top_long", _union([f"""
SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt,
  CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM documents WHERE {c} IS NOT NULL GROUP BY {c})
WHERE rank <= 12""" for c in ["text", "lang", "source"]]))
def stats_top_long(spark, sf):
    """Top values of long texts: counted by digest, the texts of the result fetched at the end."""
    return Stats(load(spark, sf, "documents")).top_long()


@register("stats_histogram_flat", """
SELECT 'flat' AS column_name, CAST(1 AS INTEGER) AS bin, 7.0::DOUBLE AS lo, 7.0::DOUBLE AS hi, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS cnt FROM orders""")
def stats_histogram_flat(spark, sf):
    """A column with one value and NULLs: one bin with the true count."""
    flat = load(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.lit(7)).alias("flat"))
    return Stats(flat).histogram().select("column_name", "bin", "lo", "hi", "cnt")


SKETCHED = (0.25, 0.5, 0.75)
#: estimates of so many groups (under 2 kB each) are broadcast to the rows
SKETCH_GROUPS = 10_000


@register("stats_quartiles_sketch", _union(
    [f"SELECT l_returnflag, '{c}' AS column_name, {p}::DOUBLE AS p, count(*) AS n, true AS within_bound FROM lineitem GROUP BY l_returnflag"
     for c in LINEITEM_NUM for p in SKETCHED]))
def stats_quartiles_sketch(spark, sf):
    """Sketched quartiles of each group, held against their exact ranks: the share of rows under and up to the estimate must
    enclose p within twice the stated error (five standard deviations)."""
    df = load(spark, sf, "lineitem")
    found = sketch_quantiles(df, LINEITEM_NUM, SKETCHED, by=["l_returnflag"])
    wide = checkpoint(found.groupBy("l_returnflag").pivot("column_name", LINEITEM_NUM).agg(F.map_from_entries(F.collect_list(F.struct("p", "value")))))
    # one row for each group: few groups meet the rows where these lie, so that no group is one task's input
    wide = F.broadcast(wide) if wide.count() <= SKETCH_GROUPS else wide
    guess = lambda c, p: F.col(f"guess.{c}")[F.lit(p)]
    rows = df.select("l_returnflag", *LINEITEM_NUM).alias("rows").join(wide.alias("guess"), "l_returnflag")
    counts = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(test).alias(f"{c}_{p}_{side}") for c in LINEITEM_NUM for p in SKETCHED
        for side, test in (("under", F.col(f"rows.{c}") < guess(c, p)), ("upto", F.col(f"rows.{c}") <= guess(c, p)))])
    slack = 2 * sketch_rank_error()
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("p"),
                     ((F.col(f"`{c}_{p}_under`") / F.col("n") <= p + slack) & (F.col(f"`{c}_{p}_upto`") / F.col("n") >= p - slack)).alias("within_bound"))
            for c in LINEITEM_NUM for p in SKETCHED]
    return counts.select("l_returnflag", "n", F.inline(F.array(*each))).select("l_returnflag", "column_name", "p", "n", "within_bound")
