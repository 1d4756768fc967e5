"""Driver contract and plan shape checks."""
import importlib.util
import os

from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs_on_smoke_data(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0 and df.columns == ["column_name", "value", "cnt", "rank"]


def test_every_oracle_has_a_query():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_values_limit_before_shuffle(spark):
    from tablescope.operators.facets import Facets
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = _plan(Facets(df).values())
    assert "WindowGroupLimit" in plan


def test_column_pruning_reaches_scan(spark):
    from tablescope.operators.stats import Stats
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_returnflag")
    plan = _plan(Stats(df).histogram())
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_ranks_and_scans_have_no_single_partition(spark):
    from tablescope.operators.ordered import ordered_scan, value_ranks
    counts = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    assert "SinglePartition" not in _plan(value_ranks(counts, ["k"], "v"))
    for keys in (["k"], []):
        plan = _plan(ordered_scan(counts, keys, ["v"], sums=["n"], partitions=6))
        assert "SinglePartition" not in plan and "Pandas" not in plan and "Window" in plan


def test_census_aggregates_map_side(spark):
    from tablescope.operators.facets import Facets
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = _plan(Facets(df).census())
    assert "partial_count" in plan            # map-side partial aggregation before the shuffle


def test_ranks_over_many_ranges(spark):
    from tablescope.operators.ordered import value_ranks
    counts = spark.range(3000).select(F.lit("c").alias("k"), F.col("id").cast("double").alias("v"), F.lit(2).cast("long").alias("n"))
    got = {r.v: (r.before, r.tot) for r in value_ranks(counts, ["k"], "v", partitions=9).collect()}
    assert got == {float(i): (2 * i, 6000) for i in range(3000)}


def test_every_oracle_runs_in_duckdb():
    import duckdb
    from tablescope.plans import TABLES
    m = _entry()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in m.oracle_sql().items():
        con.execute(sql).fetchall()
