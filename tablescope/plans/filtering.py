"""2.B  Faceted filter algebra -- each query returns the filtered rows
(nested columns as JSON, as a preview page shows them)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators.explore import json_safe
from tablescope.operators.filters import Filter, apply_filters
from tablescope.plans import load, register


def customer_holes(spark, sf):
    """customer with NULL market segments (derived with nullif, as the oracle does)."""
    c = load(spark, sf, "customer")
    return c.withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'HOUSEHOLD')"))


CUSTOMER_HOLES_SQL = ("(SELECT c_custkey, c_name, c_nationkey, c_acctbal, "
                      "nullif(c_mktsegment, 'HOUSEHOLD') AS c_mktsegment FROM customer)")


def part_words(spark, sf, holes: bool = False):
    """part plus a list column of name words (NULL list for p_size > 45 when ``holes``)."""
    p = load(spark, sf, "part")
    words = F.split(F.col("p_name"), " ")
    if holes:
        words = F.when(F.col("p_size") <= 45, words)
    return p.withColumn("p_words", words)


PART_WORDS_SQL = "(SELECT *, string_split(p_name, ' ') AS p_words FROM part)"
PART_WORDS_HOLES_SQL = ("(SELECT *, CASE WHEN p_size <= 45 THEN string_split(p_name, ' ') END AS p_words FROM part)")
PART_COLS = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, CAST(to_json(p_words) AS VARCHAR) AS p_words"


def _run(df, q=None, filters=()):
    return json_safe(apply_filters(df, q, filters))


@register("filter_value", "SELECT * FROM orders WHERE CAST(o_orderstatus AS VARCHAR) = 'F'")
def filter_value(spark, sf):
    return _run(load(spark, sf, "orders"), filters=[Filter("o_orderstatus", value="F")])


@register("filter_value_numeric",
          "SELECT * FROM lineitem WHERE CAST(l_discount AS VARCHAR) = '0.05' AND CAST(l_linenumber AS VARCHAR) = '3'")
def filter_value_numeric(spark, sf):
    return _run(load(spark, sf, "lineitem"),
                filters=[Filter("l_discount", value="0.05"), Filter("l_linenumber", value="3")])


@register("filter_or_group",
          "SELECT * FROM orders WHERE (CAST(o_orderpriority AS VARCHAR) = '1-URGENT' OR CAST(o_orderpriority AS VARCHAR) = '2-HIGH')")
def filter_or_group(spark, sf):
    return _run(load(spark, sf, "orders"),
                filters=[Filter("o_orderpriority", value="1-URGENT"), Filter("o_orderpriority", value="2-HIGH")])


@register("filter_is_null",
          f"SELECT * FROM {CUSTOMER_HOLES_SQL} WHERE (CAST(c_mktsegment AS VARCHAR) = 'BUILDING' OR c_mktsegment IS NULL)")
def filter_is_null(spark, sf):
    return _run(customer_holes(spark, sf),
                filters=[Filter("c_mktsegment", value="BUILDING"), Filter("c_mktsegment", is_null=True)])


@register("filter_contains",
          f"SELECT {PART_COLS} FROM {PART_WORDS_SQL} WHERE list_contains(CAST(p_words AS VARCHAR[]), 'ring')")
def filter_contains(spark, sf):
    # the element filter arrives without the contains flag: inferred from the schema
    return _run(part_words(spark, sf), filters=[Filter("p_words", value="ring")])


@register("filter_not_value",
          f"SELECT * FROM {CUSTOMER_HOLES_SQL} WHERE CAST(c_mktsegment AS VARCHAR) IS DISTINCT FROM 'MACHINERY'")
def filter_not_value(spark, sf):
    return _run(customer_holes(spark, sf), filters=[Filter("c_mktsegment", value="MACHINERY", negate=True)])


@register("filter_not_null", f"SELECT * FROM {CUSTOMER_HOLES_SQL} WHERE c_mktsegment IS NOT NULL")
def filter_not_null(spark, sf):
    return _run(customer_holes(spark, sf), filters=[Filter("c_mktsegment", is_null=True, negate=True)])


@register("filter_not_contains",
          f"SELECT {PART_COLS} FROM {PART_WORDS_HOLES_SQL} WHERE NOT list_contains(CAST(p_words AS VARCHAR[]), 'bolt')")
def filter_not_contains(spark, sf):
    return _run(part_words(spark, sf, holes=True), filters=[Filter("p_words", value="bolt", contains=True, negate=True)])


@register("filter_range",
          "SELECT * FROM lineitem WHERE (l_quantity >= 10.0 AND l_quantity <= 20.0) AND (l_discount >= 0.04)")
def filter_range(spark, sf):
    # a negated range keeps its range: negate has no effect on ranges
    return _run(load(spark, sf, "lineitem"),
                filters=[Filter("l_quantity", min=10, max=20), Filter("l_discount", min=0.04, negate=True)])


@register("filter_trange",
          "SELECT * FROM orders WHERE (o_orderdate >= '1996-01-01' AND o_orderdate < DATE '1996-12-31' + INTERVAL 1 DAY)")
def filter_trange(spark, sf):
    return _run(load(spark, sf, "orders"), filters=[Filter("o_orderdate", tmin="1996-01-01", tmax="1996-12-31")])


@register("filter_trange_instant",
          "SELECT * FROM events WHERE (ts >= '2024-01-10 06:30:00' AND ts < '2024-01-12 18:00:00')")
def filter_trange_instant(spark, sf):
    return _run(load(spark, sf, "events"),
                filters=[Filter("ts", tmin="2024-01-10 06:30:00", tmax="2024-01-12 18:00:00")])


def _search_sql(table_sql: str, cols: list[str], needle: str, proj: str = "*") -> str:
    ors = " OR ".join(f"CAST({c} AS VARCHAR) ILIKE '%{needle}%'" for c in cols)
    return f"SELECT {proj} FROM {table_sql} WHERE ({ors})"


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("search_text", _search_sql("part", PART_COLUMNS, "RiNg"))
def search_text(spark, sf):
    return _run(load(spark, sf, "part"), q="  RiNg ")


@register("search_numeric_text", _search_sql("customer", CUSTOMER_COLUMNS, "77"))
def search_numeric_text(spark, sf):
    return _run(load(spark, sf, "customer"), q="77")


@register("search_wildcard", _search_sql("part", PART_COLUMNS, "brand#1_"))
def search_wildcard(spark, sf):
    return _run(load(spark, sf, "part"), q="brand#1_")


@register("filter_combined", """
SELECT * FROM orders
WHERE CAST(o_orderstatus AS VARCHAR) = 'O'
  AND (CAST(o_orderpriority AS VARCHAR) = '1-URGENT' OR CAST(o_orderpriority AS VARCHAR) = '5-LOW')
  AND CAST(o_custkey AS VARCHAR) IS DISTINCT FROM '42'
  AND (o_totalprice >= 100000.0 AND o_totalprice <= 400000.0)
  AND (o_orderdate >= '1995-06-01' AND o_orderdate < DATE '1999-12-31' + INTERVAL 1 DAY)
  AND (CAST(o_orderkey AS VARCHAR) ILIKE '%7%' OR CAST(o_custkey AS VARCHAR) ILIKE '%7%'
       OR CAST(o_orderstatus AS VARCHAR) ILIKE '%7%' OR CAST(o_totalprice AS VARCHAR) ILIKE '%7%'
       OR CAST(o_orderdate AS VARCHAR) ILIKE '%7%' OR CAST(o_orderpriority AS VARCHAR) ILIKE '%7%')
""")
def filter_combined(spark, sf):
    return _run(load(spark, sf, "orders"), q="7", filters=[
        Filter("o_orderstatus", value="O"),
        Filter("o_orderpriority", value="1-URGENT"), Filter("o_orderpriority", value="5-LOW"),
        Filter("o_custkey", value="42", negate=True),
        Filter("o_totalprice", min=100000, max=400000),
        Filter("o_orderdate", tmin="1995-06-01", tmax="1999-12-31"),
    ])


@register("filter_whole_array",
          f"SELECT {PART_COLS} FROM {PART_WORDS_SQL} WHERE CAST(p_words AS VARCHAR) = '[small, ring]'")
def filter_whole_array(spark, sf):
    # a whole-array literal is equality even when flagged as containment
    return _run(part_words(spark, sf), filters=[Filter("p_words", value="[small, ring]", contains=True)])
