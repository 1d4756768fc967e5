"""2.D  Faceted search (drill-sideways)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators.facets import Facets, facet_values
from tablescope.operators.filters import Filter
from tablescope.plans import load, register
from tablescope.plans.filtering import CUSTOMER_HOLES_SQL, PART_WORDS_SQL, customer_holes, part_words

# orders: status = F, priority in (URGENT, HIGH), 50k <= price <= 300k
ORDER_FILTERS = [Filter("o_orderstatus", value="F"), Filter("o_orderpriority", value="1-URGENT"),
                 Filter("o_orderpriority", value="2-HIGH"), Filter("o_totalprice", min=50000, max=300000)]
P_STATUS = "CAST(o_orderstatus AS VARCHAR) = 'F'"
P_PRIO = "(CAST(o_orderpriority AS VARCHAR) = '1-URGENT' OR CAST(o_orderpriority AS VARCHAR) = '2-HIGH')"
P_PRICE = "(o_totalprice >= 50000.0 AND o_totalprice <= 300000.0)"


def _top(inner: str, k: int = 12) -> str:
    return (f"SELECT column_name, value, cnt, CAST(row_number() OVER (PARTITION BY column_name "
            f"ORDER BY cnt DESC, value) AS INTEGER) AS rank FROM ({inner}) QUALIFY rank <= {k}")


ORDERS_VALUES_SQL = f"""
SELECT 'o_orderstatus' AS column_name, CAST(o_orderstatus AS VARCHAR) AS value,
       count(*) FILTER (WHERE {P_PRIO} AND {P_PRICE}) AS cnt
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR), count(*) FILTER (WHERE {P_STATUS} AND {P_PRICE})
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
"""

ORDERS_RANGE_SQL = f"""
SELECT 'o_orderkey' AS column_name, CAST(min(o_orderkey) AS DOUBLE) AS min, CAST(max(o_orderkey) AS DOUBLE) AS max
FROM orders WHERE {P_STATUS} AND {P_PRIO} AND {P_PRICE}
UNION ALL
SELECT 'o_custkey', CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE)
FROM orders WHERE {P_STATUS} AND {P_PRIO} AND {P_PRICE}
UNION ALL
SELECT 'o_totalprice', CAST(min(o_totalprice) AS DOUBLE), CAST(max(o_totalprice) AS DOUBLE)
FROM orders WHERE {P_STATUS} AND {P_PRIO}
"""


def _gran(days: str) -> str:
    return (f"CASE WHEN coalesce({days}, 0) <= 2 THEN 'hour' WHEN {days} <= 90 THEN 'day' "
            f"WHEN {days} <= 1500 THEN 'month' ELSE 'year' END")


def _time_bounds_sql(table: str, colname: str, where: str) -> str:
    return (f"SELECT '{colname}' AS column_name, min({colname})::VARCHAR AS min, max({colname})::VARCHAR AS max, "
            f"{_gran(f'datediff(' + chr(39) + 'day' + chr(39) + f', CAST(min({colname}) AS TIMESTAMP), CAST(max({colname}) AS TIMESTAMP))')} AS granularity "
            f"FROM {table} WHERE {colname} IS NOT NULL AND {where}")


def _time_bins_sql(table: str, colname: str, where: str) -> str:
    return (f"WITH g AS ({_time_bounds_sql(table, colname, where)}) "
            f"SELECT '{colname}' AS column_name, date_trunc((SELECT granularity FROM g), CAST({colname} AS TIMESTAMP))::VARCHAR AS bucket, "
            f"count(*) AS cnt FROM {table} WHERE {colname} IS NOT NULL AND {where} GROUP BY 2")


ORDERS_TIME_WHERE = f"{P_STATUS} AND {P_PRIO} AND {P_PRICE}"

EVENT_FILTERS = [Filter("event_type", value="click"), Filter("event_type", value="purchase"),
                 Filter("value", min=10, max=50)]
EVENTS_WHERE = ("(CAST(event_type AS VARCHAR) = 'click' OR CAST(event_type AS VARCHAR) = 'purchase') "
                "AND (value >= 10.0 AND value <= 50.0)")


def _orders_facets(spark, sf):
    return Facets(load(spark, sf, "orders"), None, ORDER_FILTERS)


@register("facet_values_top", _top(ORDERS_VALUES_SQL))
def facet_values_top(spark, sf):
    return _orders_facets(spark, sf).values()


@register("facet_range", ORDERS_RANGE_SQL)
def facet_range(spark, sf):
    return _orders_facets(spark, sf).ranges()


@register("facet_time", _time_bins_sql("events", "ts", EVENTS_WHERE))
def facet_time(spark, sf):
    return Facets(load(spark, sf, "events"), None, EVENT_FILTERS).time_bins()


@register("facet_time_bounds", _time_bounds_sql("events", "ts", EVENTS_WHERE))
def facet_time_bounds(spark, sf):
    return Facets(load(spark, sf, "events"), None, EVENT_FILTERS).time_bounds()


@register("facet_time_years", _time_bins_sql("orders", "o_orderdate", ORDERS_TIME_WHERE))
def facet_time_years(spark, sf):
    return _orders_facets(spark, sf).time_bins()


@register("facet_list", _top(f"""
SELECT 'p_words' AS column_name, CAST(u AS VARCHAR) AS value, count(*) FILTER (WHERE keep) AS cnt
FROM (SELECT unnest(list_distinct(p_words)) AS u, (CAST(p_brand AS VARCHAR) = 'Brand#1') AS keep FROM {PART_WORDS_SQL})
WHERE u IS NOT NULL GROUP BY 2
"""))
def facet_list(spark, sf):
    fc = Facets(part_words(spark, sf), None, [Filter("p_brand", value="Brand#1")])
    return fc.values(only=["p_words"])


CUST_NULL_FILTERS = [Filter("c_acctbal", min=0), Filter("c_mktsegment", value="BUILDING")]


@register("facet_nulls", f"""
SELECT 'c_name' AS column_name,
       count(*) FILTER (WHERE c_name IS NULL AND c_acctbal >= 0.0 AND CAST(c_mktsegment AS VARCHAR) = 'BUILDING') AS nulls,
       count(*) FILTER (WHERE c_name IS NULL) > 0 AS has_nulls, false AS is_list, false AS is_boolean
FROM {CUSTOMER_HOLES_SQL}
UNION ALL
SELECT 'c_mktsegment', count(*) FILTER (WHERE c_mktsegment IS NULL AND c_acctbal >= 0.0),
       count(*) FILTER (WHERE c_mktsegment IS NULL) > 0, false, false
FROM {CUSTOMER_HOLES_SQL}
""")
def facet_nulls(spark, sf):
    return Facets(customer_holes(spark, sf), None, CUST_NULL_FILTERS).nulls()


@register("facet_flags", """
WITH o AS (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority = '1-URGENT' END AS urgent FROM orders)
SELECT 'urgent' AS column_name, count(*) FILTER (WHERE urgent IS NULL AND o_totalprice >= 100000) AS nulls,
       count(*) FILTER (WHERE urgent IS NULL) > 0 AS has_nulls, false AS is_list, true AS is_boolean FROM o
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL AND o_totalprice >= 100000),
       count(*) FILTER (WHERE o_orderstatus IS NULL) > 0, false, false FROM o""")
def facet_flags(spark, sf):
    o = load(spark, sf, "orders")
    urgent = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority") == "1-URGENT")
    return Facets(o.select("o_orderstatus", "o_totalprice", urgent.alias("urgent")), None, [Filter("o_totalprice", min=100000)]).nulls()


@register("facet_total", f"""
SELECT 'p_name' AS column_name, count(DISTINCT p_name) AS total FROM part
UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'p_words', (SELECT count(DISTINCT u) FROM (SELECT unnest(list_distinct(p_words)) AS u FROM {PART_WORDS_SQL}) WHERE u IS NOT NULL)
""")
def facet_total(spark, sf):
    return Facets(part_words(spark, sf), None, [Filter("p_brand", value="Brand#7")]).totals()


@register("facet_show_all", _top("""
SELECT 'p_type' AS column_name, CAST(p_type AS VARCHAR) AS value,
       count(*) FILTER (WHERE CAST(p_brand AS VARCHAR) = 'Brand#3') AS cnt
FROM part WHERE p_type IS NOT NULL GROUP BY 2
""", k=1000))
def facet_show_all(spark, sf):
    # the column's own filter is ignored; other columns' filters scope the counts
    return facet_values(load(spark, sf, "part"), "p_type",
                        filters=[Filter("p_brand", value="Brand#3"), Filter("p_type", value="SMALL")])


def _all_sql() -> str:
    vals = _top(ORDERS_VALUES_SQL)
    nulls = f"""
SELECT 'o_orderstatus' AS column_name, count(*) FILTER (WHERE o_orderstatus IS NULL AND {P_PRIO} AND {P_PRICE}) AS nulls,
       (count(*) FILTER (WHERE o_orderstatus IS NULL) > 0) AS has_nulls FROM orders
UNION ALL
SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NULL AND {P_STATUS} AND {P_PRICE}),
       (count(*) FILTER (WHERE o_orderpriority IS NULL) > 0) FROM orders"""
    totals = ("SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS total FROM orders "
              "UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders")
    tb = _time_bounds_sql("orders", "o_orderdate", ORDERS_TIME_WHERE)
    bins = _time_bins_sql("orders", "o_orderdate", ORDERS_TIME_WHERE)
    nd, nl = "CAST(NULL AS DOUBLE)", "CAST(NULL AS BIGINT)"
    return f"""
SELECT column_name, 'range' AS kind, CAST(NULL AS VARCHAR) AS label, {nl} AS cnt, min AS lo, max AS hi FROM ({ORDERS_RANGE_SQL})
UNION ALL SELECT column_name, 'time_min', min, {nl}, {nd}, {nd} FROM ({tb})
UNION ALL SELECT column_name, 'time_max', max, {nl}, {nd}, {nd} FROM ({tb})
UNION ALL SELECT column_name, 'time_bin', bucket, cnt, {nd}, {nd} FROM ({bins})
UNION ALL SELECT column_name, 'value', value, cnt, {nd}, {nd} FROM ({vals})
UNION ALL SELECT column_name, 'nulls', CAST(has_nulls AS VARCHAR), nulls, {nd}, {nd} FROM ({nulls})
UNION ALL SELECT column_name, 'total', CAST(NULL AS VARCHAR), total, {nd}, {nd} FROM ({totals})
"""


@register("facets_all", _all_sql())
def facets_all(spark, sf):
    return _orders_facets(spark, sf).all()


SEARCH_ORDERS = " OR ".join(f"CAST({c} AS VARCHAR) ILIKE '%199%'" for c in
                            ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


@register("facets_search", _top(f"""
SELECT 'o_orderstatus' AS column_name, CAST(o_orderstatus AS VARCHAR) AS value,
       count(*) FILTER (WHERE {P_PRIO} AND ({SEARCH_ORDERS})) AS cnt
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR), count(*) FILTER (WHERE ({SEARCH_ORDERS}))
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
"""))
def facets_search(spark, sf):
    """Search applies to every facet; a column's own filter does not."""
    fl = [Filter("o_orderpriority", value="1-URGENT"), Filter("o_orderpriority", value="2-HIGH")]
    return Facets(load(spark, sf, "orders"), "199", fl).values()
