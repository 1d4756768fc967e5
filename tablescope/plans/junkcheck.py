"""2.G  Junk-column detection on a customer-derived table with planted junk:
a copy column, an empty column, a constant, a sparse and a near-constant one."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators.junk import junk, verdicts
from tablescope.plans import load, register

JUNK_SQL = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
  c_mktsegment AS segment_copy, CAST(NULL AS VARCHAR) AS empty, 'fixed' AS always,
  CASE WHEN c_acctbal > 9000 THEN c_name END AS sparse,
  CASE WHEN c_acctbal < 9500 THEN 'usual' ELSE 'odd' END AS nearly
FROM customer)"""

COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "segment_copy", "empty", "always", "sparse", "nearly"]


def junk_table(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("*", F.col("c_mktsegment").alias("segment_copy"), F.lit(None).cast("string").alias("empty"),
                    F.lit("fixed").alias("always"), F.when(F.col("c_acctbal") > 9000, F.col("c_name")).alias("sparse"),
                    F.when(F.col("c_acctbal") < 9500, F.lit("usual")).otherwise(F.lit("odd")).alias("nearly"))


def _cols_sql() -> str:
    parts = []
    for c in COLS:
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS column_name, count({v}) AS non_null, count(DISTINCT {v}) AS distinct,
  (SELECT {v} FROM {JUNK_SQL} WHERE {c} IS NOT NULL GROUP BY {v} ORDER BY count(*) DESC, {v} LIMIT 1) AS top_value,
  coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM {JUNK_SQL} WHERE {c} IS NOT NULL GROUP BY {v})), 0) AS top_count
FROM {JUNK_SQL}""")
    return "\nUNION ALL\n".join(parts)


COLS_SQL = _cols_sql()


@register("junk_columns", f'SELECT column_name, non_null, "distinct" FROM ({COLS_SQL})')
def junk_columns(spark, sf):
    return junk(junk_table(spark, sf)).columns.select("column_name", "non_null", "distinct")


@register("junk_modal", f"SELECT column_name, top_value, top_count FROM ({COLS_SQL})")
def junk_modal(spark, sf):
    return junk(junk_table(spark, sf)).columns.select("column_name", "top_value", "top_count")


def _dups_sql() -> str:
    parts = []
    for i, a in enumerate(COLS):
        for b in COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE CAST({a} AS VARCHAR) IS NOT DISTINCT FROM "
                         f"CAST({b} AS VARCHAR)) AS eq, count(*) AS n, count({a}) + count({b}) AS nn FROM {JUNK_SQL}")
    return "SELECT a, b FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE eq = n AND n > 0 AND nn > 0"


@register("junk_duplicates", _dups_sql())
def junk_duplicates(spark, sf):
    return junk(junk_table(spark, sf)).duplicates


@register("junk_verdicts", f"""
SELECT column_name, CASE WHEN non_null = 0 THEN 'all_null' WHEN "distinct" = 1 THEN 'constant'
  WHEN top_count::DOUBLE / non_null >= 0.95 THEN 'near_constant'
  WHEN non_null::DOUBLE / (SELECT count(*) FROM customer) < 0.10 THEN 'sparse' ELSE 'ok' END AS verdict
FROM ({COLS_SQL})""")
def junk_verdicts(spark, sf):
    return verdicts(junk(junk_table(spark, sf)))


@register("junk_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT CAST({c} AS VARCHAR)) AS distinct FROM lineitem"
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]))
def junk_lineitem(spark, sf):
    return junk(load(spark, sf, "lineitem")).columns.select("column_name", "non_null", "distinct")
