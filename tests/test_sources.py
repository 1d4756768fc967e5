"""Catalog guards, ingest and snapshot bundles."""
import json
import os

import pytest
from pyspark.sql import functions as F

from tablescope.session import scratch_path
from tablescope.sources import catalog as C
from tablescope.sources import ingest as I
from tablescope.sources import snapshot as S

SF = "/root/testdata/sf0.001"


def test_query_is_read_only_single_statement(spark):
    C.register_tables(spark, SF, ["region"])
    assert C.query(spark, "SELECT r_name FROM region;").count() == 5
    assert C.query(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x").count() == 1
    for bad in ["DROP VIEW region", "SELECT 1; SELECT 2", "", "  INSERT INTO t VALUES (1)"]:
        with pytest.raises(ValueError):
            C.query(spark, bad)
    assert C.query(spark, "SELECT ';' AS semi").collect()[0].semi == ";"   # literals are not statements


def test_query_rewraps_nested_as_json(spark):
    out = C.query(spark, "SELECT array(1, 2) AS a, named_struct('k', 'v') AS s").collect()[0]
    assert out.a == "[1,2]" and out.s == '{"k":"v"}'


def test_saved_view_clash_and_definition(spark):
    C.register_tables(spark, SF, ["nation"])
    with pytest.raises(ValueError):
        C.save_view(spark, "NATION", "SELECT 1 AS x")            # case-insensitive clash
    v = C.save_view(spark, "big_nations", "SELECT * FROM nation WHERE n_nationkey > 20", overwrite=True)
    assert v.count() == 4
    assert C.view_definition(spark, "big_nations") == "SELECT * FROM nation WHERE n_nationkey > 20"
    with pytest.raises(ValueError):
        C.save_view(spark, "bad name", "SELECT 1")
    rel = {r.name: r for r in C.list_relations(spark, ["nation", "big_nations"]).collect()}
    assert rel["big_nations"].is_view and not rel["nation"].is_view and rel["nation"].estimated_size == 25


def test_ingest_formats(spark):
    base = scratch_path(spark, "ingest-test")
    src = spark.read.parquet(f"{SF}/supplier.parquet")
    src.write.option("header", True).option("sep", "\t").csv(base + "/s.tsv")
    src.write.json(base + "/s.json")
    t = I.read_any(spark, base + "/s.tsv")
    assert t.count() == src.count() and dict(t.dtypes)["s_acctbal"] == "double"
    j = I.read_any(spark, base + "/s.json")
    assert sorted(j.columns) == sorted(src.columns)
    with pytest.raises(ValueError):
        I.read_any(spark, base + "/s.xlsx")


def test_snapshot_roundtrip_version_and_tamper(spark):
    bundle = scratch_path(spark, "bundle-test")
    region = spark.read.parquet(f"{SF}/region.parquet")
    man = S.snapshot({"region": region}, bundle).collect()
    assert man[0].rows == 5 and man[0].version == S.FORMAT_VERSION
    back = S.restore(spark, bundle)["region"]
    assert sorted(back.collect()) == sorted(region.collect())
    # a newer bundle format is refused
    newer = scratch_path(spark, "bundle-newer")
    spark.createDataFrame([(S.FORMAT_VERSION + 1, "region", 5, 2, region.schema.json(), "0")],
                          S.MANIFEST_SCHEMA).coalesce(1).write.json(newer + "/_manifest")
    with pytest.raises(ValueError):
        S.restore(spark, newer)
    # a modified table fails verification
    bad = scratch_path(spark, "bundle-bad")
    S.snapshot({"region": region}, bad)
    region.where(F.col("r_regionkey") > 0).write.mode("overwrite").parquet(bad + "/region")
    with pytest.raises(ValueError):
        S.restore(spark, bad)


def test_restore_registers_with_suffix(spark):
    bundle = scratch_path(spark, "bundle-reg")
    region = spark.read.parquet(f"{SF}/region.parquet")
    region.createOrReplaceTempView("regionx")
    S.snapshot({"regionx": region}, bundle)
    S.restore(spark, bundle, register=True)
    assert spark.table("regionx_2").count() == 5


def test_inserts_inside_queries_are_refused(spark):
    import pytest
    from tablescope.sources import catalog
    spark.range(3).createOrReplaceTempView("guard_src")
    for sql in ("WITH q AS (SELECT * FROM guard_src) INSERT INTO guard_tgt SELECT * FROM q", "FROM guard_src INSERT INTO guard_tgt SELECT id"):
        with pytest.raises(ValueError, match="read-only"):
            catalog.query(spark, sql)
        with pytest.raises(ValueError, match="read-only"):
            catalog.save_view(spark, "guard_view", sql)
    assert catalog.query(spark, "WITH q AS (SELECT id FROM guard_src WHERE id IN (SELECT 1)) SELECT 'InsertIntoStatement' AS t FROM q").count() == 1


def test_plain_numbers_have_no_exponent(spark):
    from pyspark.sql import functions as F
    from tablescope.functions.formats import Format, format_number_col
    df = spark.sql("SELECT 12345678.0D AS a, 0.0001D AS b, 9007199254740993L AS c")
    money = Format(prefix="$")
    row = df.select(*[format_number_col(F.col(c), money).alias(c) for c in "abc"]).first()
    assert tuple(row) == ("$12345678.0", "$0.0001", "$9007199254740993")


def test_heatmap_takes_any_label(spark):
    from tablescope.operators.tiles import heatmap_grid
    df = spark.createDataFrame([("a", "x"), ("a", "Red"), ("b", "red"), ("b", "`q")], "k string, v string")
    got = {(r.x, r.y): r.value for r in heatmap_grid(df, "k", "v").collect()}
    assert len(got) == 8 and got["b", "`q"] == 1 and got["a", "red"] == 0


def test_preview_honours_its_limit(spark):
    from tablescope.operators.explore import preview
    assert preview(spark.range(6000), limit=5000).rows.count() == 5000


def test_views_are_listed_without_running_them(spark):
    C.register_tables(spark, SF, ["region"])
    C.save_view(spark, "listed_view", "SELECT CAST(raise_error('ran') AS INT) AS x FROM region", overwrite=True)
    spark.range(3).createOrReplaceTempView("listed_temp")
    rel = {r.name: r for r in C.list_relations(spark, ["region", "listed_view", "listed_temp"]).collect()}
    assert rel["region"].estimated_size == 5 and not rel["region"].is_view
    for name in ("listed_view", "listed_temp"):
        assert rel[name].is_view and rel[name].estimated_size is None


def test_exports_read_back_as_written(spark):
    import datetime as dt
    from tablescope.operators import explore as X
    df = spark.createDataFrame([(1, 'say "hi", then\nleave', dt.datetime(2020, 1, 2, 3, 4, 5, 678901), [1, 2]), (2, "", None, None), (3, None, None, [])],
                               "id int, note string, at timestamp_ntz, l array<int>")
    path = X.export(df, scratch_path(spark, "export-test-json"), "json")
    assert sorted(X.read_export(spark, path, df.schema, "json").collect()) == sorted(df.collect())
    path = X.export(df, scratch_path(spark, "export-test-csv"), "csv")
    got = {r.id: r for r in X.read_export(spark, path, df.schema).collect()}
    assert [got[i].note for i in (1, 2, 3)] == ['say "hi", then\nleave', "", None]
    assert got[1]["at"] == dt.datetime(2020, 1, 2, 3, 4, 5, 678901) and [got[i].l for i in (1, 2, 3)] == ["[1,2]", None, "[]"]
    df.createOrReplaceTempView("export_src")
    path = scratch_path(spark, "export-test-query")
    schema = C.export_query(spark, "SELECT id, note FROM export_src WHERE id < 3", path)
    assert {r.id: r.note for r in X.read_export(spark, path, schema).collect()} == {1: 'say "hi", then\nleave', 2: ""}


def test_snapshot_of_maps_formats_and_changed_schema(spark):
    bundle = scratch_path(spark, "bundle-maps")
    df = spark.createDataFrame([(1, {"a": 1}), (2, None)], "id int, m map<string,int>")
    reg = spark.createDataFrame([("old", "snapmap", "id", "{1}", 1), ("old", None, "id", "{2}", 1), ("old", "other", "id", "{3}", 1)],
                                "db string, table string, column string, spec string, seq long")
    df.createOrReplaceTempView("snapmap")
    S.snapshot({"snapmap": df}, bundle, formats=reg)
    views = S.register_views(spark, S.restore(spark, bundle))
    assert views == {"snapmap": "snapmap_2"} and spark.table("snapmap_2").count() == 2
    got = {(r.db, r.table, r.spec) for r in S.restored_formats(spark, bundle, "new", views).collect()}
    assert got == {("new", "snapmap_2", "{1}"), ("new", None, "{2}"), ("new", "other", "{3}")}
    df.select(F.col("id").cast("long").alias("id"), "m").write.mode("overwrite").parquet(bundle + "/snapmap")
    with pytest.raises(ValueError, match="schema"):
        S.restore(spark, bundle)
