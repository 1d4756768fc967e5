"""2.A/2.C  Paging, sorting, table tile, export projection, nested-as-JSON."""
from __future__ import annotations

from tablescope.operators.explore import export, export_frame, json_safe, preview_with_total, read_export, table_tile
from pyspark.sql import functions as F

from tablescope.operators.filters import Filter, apply_filters, filters_from_json
from tablescope.operators.pages import KEY, Pages
from tablescope.plans import load, register
from tablescope.session import scratch_path
from tablescope.plans.filtering import PART_WORDS_SQL, part_words


@register("preview_page", """
SELECT *, (SELECT count(*) FROM orders WHERE CAST(o_orderstatus AS VARCHAR) = 'F') AS total
FROM orders WHERE CAST(o_orderstatus AS VARCHAR) = 'F'
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50
""")
def preview_page(spark, sf):
    return preview_with_total(load(spark, sf, "orders"), limit=25, offset=50,
                              filters=[Filter("o_orderstatus", value="F")],
                              sort="o_totalprice", direction="desc", tie_break=["o_orderkey"])


@register("preview_sorted", """
SELECT *, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS total
FROM lineitem WHERE CAST(l_returnflag AS VARCHAR) = 'R'
ORDER BY l_shipdate ASC NULLS LAST, l_orderkey, l_linenumber LIMIT 5000
""")
def preview_sorted(spark, sf):
    return preview_with_total(load(spark, sf, "lineitem"), limit=5000,
                              filters=[Filter("l_returnflag", value="R")],
                              sort="l_shipdate", tie_break=["l_orderkey", "l_linenumber"])


@register("preview_unknown_sort", """
SELECT *, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_suppkey LIMIT 25
""")
def preview_unknown_sort(spark, sf):
    # not a real column -> no sort key; the tie-break keeps the page deterministic
    return preview_with_total(load(spark, sf, "supplier"), sort="no_such_column; DROP", tie_break=["s_suppkey"])


@register("table_tile", """
SELECT * FROM part WHERE (CAST(p_partkey AS VARCHAR) ILIKE '%bolt%' OR CAST(p_name AS VARCHAR) ILIKE '%bolt%'
  OR CAST(p_brand AS VARCHAR) ILIKE '%bolt%' OR CAST(p_type AS VARCHAR) ILIKE '%bolt%'
  OR CAST(p_size AS VARCHAR) ILIKE '%bolt%' OR CAST(p_retailprice AS VARCHAR) ILIKE '%bolt%')
ORDER BY p_partkey LIMIT 20
""")
def table_tile_q(spark, sf):
    return table_tile(load(spark, sf, "part"), text="bolt", order=["p_partkey"])


@register("export_filtered", """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
WHERE CAST(o_orderpriority AS VARCHAR) = '3-MEDIUM'
  AND (CAST(o_orderkey AS VARCHAR) ILIKE '%99%' OR CAST(o_custkey AS VARCHAR) ILIKE '%99%'
   OR CAST(o_orderstatus AS VARCHAR) ILIKE '%99%' OR CAST(o_totalprice AS VARCHAR) ILIKE '%99%'
   OR CAST(o_orderdate AS VARCHAR) ILIKE '%99%' OR CAST(o_orderpriority AS VARCHAR) ILIKE '%99%')
""")
def export_filtered(spark, sf):
    # hidden columns are dropped from the output but still searched; written as CSV and read back
    df, hidden = load(spark, sf, "orders"), ["o_custkey", "o_orderpriority"]
    path = export(df, scratch_path(spark, "export-filtered"), "csv", q="99",
                  filters=[Filter("o_orderpriority", value="3-MEDIUM")], hidden=hidden)
    return read_export(spark, path, df.drop(*hidden).schema)


@register("export_all_hidden", "SELECT * FROM region")
def export_all_hidden(spark, sf):
    df = load(spark, sf, "region")
    return export_frame(df, hidden=df.columns)


@register("nested_json", f"""
SELECT p_partkey, CAST(to_json(p_words) AS VARCHAR) AS p_words, CAST(to_json({{'brand': p_brand, 'size': p_size}}) AS VARCHAR) AS spec
FROM {PART_WORDS_SQL}
""")
def nested_json(spark, sf):
    from pyspark.sql import functions as F
    df = part_words(spark, sf).select("p_partkey", "p_words",
                                      F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("spec"))
    return json_safe(df)


@register("preview_keyset", """
SELECT *, CAST((place - start) // 40 + 1 AS INTEGER) AS page FROM (
  SELECT *, row_number() OVER (ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber) - 1 AS place,
         (SELECT count(*) FROM lineitem) * 3 // 4 AS start FROM lineitem)
WHERE place >= start AND place < start + 120""".replace("SELECT *, CAST", "SELECT * EXCLUDE (place, start), CAST"))
def preview_keyset(spark, sf):
    """Three pages of 40 rows from three quarters down the table: the first by its offset, the others from the last row seen."""
    df = load(spark, sf, "lineitem")
    pages = Pages(df, "l_shipdate", "desc", ["l_orderkey", "l_linenumber"])
    cursor, out = pages.seek(df.count() * 3 // 4), None
    for number in (1, 2, 3):
        page = pages.page(cursor, 40)
        cursor = pages.after(page.select(KEY).collect(), cursor)
        shown = page.drop(KEY).withColumn("page", F.lit(number))
        out = shown if out is None else out.unionByName(shown)
    return out


@register("filter_json", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_shipdate FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 20 AND l_quantity <= 30.5 AND l_linestatus <> 'O'
  AND l_shipdate >= TIMESTAMP '1994-01-01 00:00:00'""")
def filter_json(spark, sf):
    """A filter list as a client sends it."""
    sent = '''[{"column": "l_returnflag", "value": "A"}, {"column": "l_returnflag", "value": "R"},
               {"column": "l_quantity", "min": 20, "max": 30.5}, {"column": "l_linestatus", "value": "O", "negate": true},
               {"column": "l_shipdate", "tmin": "1994-01-01 00:00:00"}]'''
    kept = apply_filters(load(spark, sf, "lineitem"), None, filters_from_json(sent))
    return kept.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate")
