"""2.A  Sources, sinks, catalog."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.operators.explore import read_export
from tablescope.session import scratch_path
from tablescope.sources.catalog import describe, export_query as export_result, list_relations, query, register_tables, save_view, view_definition
from tablescope.sources.ingest import from_values, mixed_fields, read_any, read_ledger, read_mixed_json, read_csv, read_json
from tablescope.sources.snapshot import read_manifest, restore, snapshot
from tablescope.plans import TABLES, load, register


_INVENTORY = ("SELECT '{name}' AS name, 'default' AS schema_name, CAST((SELECT count(*) FROM information_schema.columns "
              "WHERE table_name = '{table}') AS INTEGER) AS column_count, {size} AS estimated_size, {view} AS is_view")


@register("table_inventory", "\nUNION ALL\n".join(
    [_INVENTORY.format(name=t, table=t, size=f"(SELECT count(*) FROM {t})", view="false") for t in TABLES]
    + [_INVENTORY.format(name="late_orders", table="orders", size="CAST(NULL AS BIGINT)", view="true"),
       _INVENTORY.format(name="plain_view", table="region", size="CAST(NULL AS BIGINT)", view="true")]))
def table_inventory(spark, sf):
    register_tables(spark, sf, TABLES)
    save_view(spark, "late_orders", "SELECT * FROM orders WHERE o_orderdate >= DATE '1998-01-01'", overwrite=True)
    load(spark, sf, "region").createOrReplaceTempView("plain_view")
    return list_relations(spark, [*TABLES, "late_orders", "plain_view"])


_KIND = ("CASE WHEN data_type LIKE '%[]' THEN 'list' "
         "WHEN data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT','HUGEINT','FLOAT','REAL','DOUBLE') "
         "OR data_type LIKE 'DECIMAL%' THEN 'numeric' "
         "WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'temporal' "
         "WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE 'text' END")


_TYPE = ("replace(replace(replace(replace(replace(replace(lower(CASE WHEN data_type LIKE '%[]' THEN 'array<' || data_type[:-3] || '>' "
         "ELSE data_type END), 'varchar', 'string'), 'bigint', 'long'), 'integer', 'int'), 'timestamp', 'timestamp_ntz'), 'long', 'bigint'), "
         "'real', 'float')")
_COUNTED = "\n  UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, n FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n)"
    for t in TABLES)


@register("describe_table", f"""
SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, {_TYPE} AS col_type, {_KIND} AS kind,
       is_nullable = 'YES' AS nullable, n AS non_null
FROM information_schema.columns JOIN ({_COUNTED}) USING (table_name, column_name)
""")
def describe_table(spark, sf):
    return reduce(DataFrame.unionByName, [describe(load(spark, sf, t), t) for t in TABLES])


ADHOC_JOIN = """
SELECT n.n_name AS nation, count(*) AS orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name
"""

ADHOC_WINDOW = """
SELECT o_custkey, o_orderkey,
       CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rnk,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
FROM orders
"""

ADHOC_CTE = """
WITH big AS (SELECT * FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem))
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders,
       count(*) FILTER (WHERE l_discount > 0.05) AS discounted
FROM big GROUP BY l_returnflag, l_linestatus
"""

ADHOC_UNION = """
SELECT 'supplier' AS kind, s_name AS name, s_nationkey AS nationkey FROM supplier
UNION ALL
SELECT 'customer' AS kind, c_name AS name, c_nationkey AS nationkey FROM customer
"""

ADHOC_SELF = """
SELECT a.conv_id, a.turn, a.role AS asker, b.role AS answerer
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
"""


def _adhoc(sql):
    def run(spark, sf):
        register_tables(spark, sf, TABLES)
        return query(spark, sql)
    return run


# the same results worked out another way: sums by customer first, ranks and running sums by counting
# the rows in front, a mean from its sum, distinct keys by grouping, a union as an outer join, the next turn by lead
ADHOC_JOIN_CHECK = """
SELECT (SELECT n_name FROM nation WHERE n_nationkey = nk) AS nation, CAST(sum(cnt) AS BIGINT) AS orders, round(sum(total), 2) AS revenue
FROM (SELECT o_custkey, count(*) AS cnt, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) per
JOIN (SELECT c_custkey, c_nationkey AS nk FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)) c ON c_custkey = o_custkey
GROUP BY nk
"""

ADHOC_WINDOW_CHECK = """
SELECT a.o_custkey, a.o_orderkey,
       1 + count(*) FILTER (WHERE b.o_totalprice > a.o_totalprice OR b.o_totalprice = a.o_totalprice AND b.o_orderkey < a.o_orderkey) AS rnk,
       round(sum(b.o_totalprice) FILTER (WHERE b.o_orderdate < a.o_orderdate OR b.o_orderdate = a.o_orderdate AND b.o_orderkey <= a.o_orderkey), 2) AS running
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
GROUP BY a.o_custkey, a.o_orderkey
"""

ADHOC_CTE_CHECK = """
SELECT l_returnflag, l_linestatus, CAST(sum(lines) AS BIGINT) AS n, count(*) AS orders, CAST(sum(cheap) AS BIGINT) AS discounted
FROM (SELECT l_returnflag, l_linestatus, l_orderkey, count(*) AS lines, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS cheap
      FROM lineitem, (SELECT sum(l_quantity) / count(l_quantity) AS mean FROM lineitem) WHERE l_quantity > mean GROUP BY ALL)
GROUP BY l_returnflag, l_linestatus
"""

ADHOC_UNION_CHECK = """
SELECT CASE WHEN s_suppkey IS NOT NULL THEN 'supplier' ELSE 'customer' END AS kind, coalesce(s_name, c_name) AS name,
       coalesce(s_nationkey, c_nationkey) AS nationkey
FROM supplier FULL OUTER JOIN customer ON s_suppkey = -c_custkey - 1
"""

ADHOC_SELF_CHECK = """
SELECT conv_id, turn, role AS asker, answerer
FROM (SELECT *, lead(role) OVER w AS answerer, lead(turn) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE following = turn + 1
"""

for _name, _sql, _check in [("adhoc_query", ADHOC_JOIN, ADHOC_JOIN_CHECK), ("adhoc_window", ADHOC_WINDOW, ADHOC_WINDOW_CHECK),
                            ("adhoc_cte", ADHOC_CTE, ADHOC_CTE_CHECK), ("adhoc_union", ADHOC_UNION, ADHOC_UNION_CHECK),
                            ("adhoc_self_lookup", ADHOC_SELF, ADHOC_SELF_CHECK)]:
    register(_name, _check)(_adhoc(_sql))


@register("saved_view", """
SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 250000) GROUP BY o_orderpriority
""")
def saved_view(spark, sf):
    register_tables(spark, sf, ["orders"])
    save_view(spark, "pricey_orders", "SELECT * FROM orders WHERE o_totalprice > 250000;", overwrite=True)
    return query(spark, "SELECT o_orderpriority, count(*) AS n FROM pricey_orders GROUP BY o_orderpriority")


@register("export_query", """
SELECT l_returnflag, l_linestatus, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-06-01 00:00:00'
""")
def export_query(spark, sf):
    # written as JSON lines and read back
    register_tables(spark, sf, ["lineitem"])
    path = scratch_path(spark, "export-query")
    schema = export_result(spark, "SELECT l_returnflag, l_linestatus, l_shipdate, l_quantity FROM lineitem "
                                  "WHERE l_shipdate >= TIMESTAMP_NTZ '1997-06-01 00:00:00'", path, "json")
    return read_export(spark, path, schema, "json")


@register("ingest_csv", """
SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS INTEGER) AS p_size, p_retailprice
FROM part
""")
def ingest_csv(spark, sf):
    # Spark derives the CSV from the given table, then reads it back with
    # header and type inference (ints stay int: inference picks the narrowest)
    path = scratch_path(spark, "ingest-part-csv")
    load(spark, sf, "part").write.option("header", True).csv(path)
    return read_csv(spark, path)


@register("ingest_tsv", "SELECT r_regionkey, r_name FROM region")
def ingest_tsv(spark, sf):
    path = scratch_path(spark, "ingest-region") + ".tsv"
    load(spark, sf, "region").write.option("header", True).option("sep", "\t").csv(path)
    return read_csv(spark, path)


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@register("ingest_json", "SELECT * FROM events")
def ingest_json(spark, sf):
    src = load(spark, sf, "events")
    path = scratch_path(spark, "ingest-events-json")
    src.write.option("timestampNTZFormat", MICROS).json(path)
    return read_json(spark, path, schema=src.schema, timestamp_format=MICROS)


# what an interrupted or careless writer leaves in a log: a cut line, a missing field, a blank line, a line that is no JSON
_LEDGER = """
WITH lines AS (SELECT event_id, event_type, user_id, event_id % 11 AS fate FROM events)
SELECT event_id, event_type, user_id, CAST(NULL AS VARCHAR) AS line, 'event' AS reason FROM lines WHERE fate NOT IN (3, 5, 9)
UNION ALL SELECT NULL, NULL, NULL, '{"event_id":' || event_id, 'malformed' FROM lines WHERE fate = 3
UNION ALL SELECT NULL, NULL, NULL, '{"event_type":"' || event_type || '"}', 'missing event_id' FROM lines WHERE fate = 5
UNION ALL SELECT NULL, NULL, NULL, 'not json ' || event_id, 'malformed' FROM lines WHERE fate = 9"""


@register("ingest_ledger", _LEDGER)
def ingest_ledger(spark, sf):
    """A log of all events with broken and blank lines among them: events, and the lines that were refused."""
    ev = load(spark, sf, "events").select("event_id", "event_type", "user_id")
    fate, number = F.col("event_id") % 11, F.col("event_id").cast("string")
    line = (F.when(fate == 3, F.concat(F.lit('{"event_id":'), number))
            .when(fate == 5, F.to_json(F.struct("event_type"))).when(fate == 9, F.concat(F.lit("not json "), number))
            .when(fate == 7, F.concat(F.to_json(F.struct("*")), F.lit("\n  \t"))).otherwise(F.to_json(F.struct("*"))))
    path = scratch_path(spark, "ledger")
    ev.select(line.alias("value")).write.text(path)
    rows, rejects = read_ledger(spark, path, ev.schema, ["event_id"])
    return (rows.select("*", F.lit(None).cast("string").alias("line"), F.lit("event").alias("reason"))
            .unionByName(rejects, allowMissingColumns=True))


@register("ingest_variant", """
SELECT 'id' AS path, 'BIGINT' AS type, count(*) AS n FROM orders
UNION ALL SELECT 'price', CASE WHEN o_orderkey % 3 = 0 THEN 'STRING' ELSE 'BIGINT' END, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'flag', 'BOOLEAN', count(*) FROM orders WHERE o_orderkey % 2 = 0""")
def ingest_variant(spark, sf):
    """Records of all orders whose price is now a number, now a text, and whose flag is not always there."""
    key = F.col("o_orderkey")
    whole = F.floor("o_totalprice").cast("long")
    record = F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"price":'), F.when(key % 3 == 0, F.concat(F.lit('"'), whole.cast("string"), F.lit('"'))).otherwise(whole.cast("string")),
                      F.when(key % 2 == 0, F.lit(',"flag":true')).otherwise(F.lit("")), F.lit("}"))
    path = scratch_path(spark, "mixed")
    load(spark, sf, "orders").select(record.alias("value")).write.text(path)
    return mixed_fields(read_mixed_json(spark, path)).select("path", F.col("type"), "n")


@register("snapshot_manifest", "\nUNION ALL\n".join(
    f"SELECT 1 AS version, '{t}' AS table_name, (SELECT count(*) FROM {t}) AS rows, "
    f"CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS INTEGER) AS column_count"
    for t in TABLES))
def snapshot_manifest(spark, sf):
    bundle = scratch_path(spark, "bundle")
    snapshot({t: load(spark, sf, t) for t in TABLES}, bundle)
    return read_manifest(spark, bundle).select("version", "table_name", "rows", "column_count")


@register("snapshot_restore", "SELECT * FROM orders")
def snapshot_restore(spark, sf):
    bundle = scratch_path(spark, "bundle")
    snapshot({t: load(spark, sf, t) for t in TABLES}, bundle)
    return restore(spark, bundle)["orders"]  # every table's rows and checksum are compared


_BUSY = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"


@register("view_text", f"""
SELECT 'busy_customers' AS name, '{_BUSY}' AS definition, count(*) AS rows FROM ({_BUSY})""")
def view_text(spark, sf):
    """The stored text of a saved view next to the rows it gives."""
    register_tables(spark, sf, ["orders"])
    view = save_view(spark, "busy_customers", _BUSY + ";", overwrite=True)
    return view.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("busy_customers").alias("name"), F.lit(view_definition(spark, "busy_customers")).alias("definition"), "rows")


@register("ingest_parquet", "SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem")
def ingest_parquet(spark, sf):
    """Written by Spark in a folder for each flag and read back by its path, the flags from the folder names."""
    path = scratch_path(spark, "ingest-lineitem") + ".parquet"
    (load(spark, sf, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
     .write.partitionBy("l_returnflag").parquet(path))
    return read_any(spark, path)


@register("ingest_values", """
SELECT word, count(o_orderkey) AS orders FROM (VALUES ('F', 'finished'), ('O', 'open'), ('X', 'unheard of')) v(status, word)
LEFT JOIN orders ON o_orderstatus = status GROUP BY word""")
def ingest_values(spark, sf):
    """Inline rows joined to all orders."""
    words = from_values(spark, [("F", "finished"), ("O", "open"), ("X", "unheard of")], "status string, word string")
    counts = load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("o_orderkey").alias("n"))
    return (words.join(counts, words.status == counts.o_orderstatus, "left")
            .select("word", F.coalesce("n", F.lit(0)).cast("long").alias("orders")))
