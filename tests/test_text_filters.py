"""Canonical text form and the filter algebra (planted cases)."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.text import text_of
from tablescope.operators.filters import Filter, apply_filters, build_predicate, filters_from_json, normalize_contains


def _texts(spark, values, dt):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", dt)]))
    return [r[0] for r in df.select(text_of(F.col("v"), dt)).collect()]


def test_double_text_matches_sql_cast(spark):
    vals = [17.0, 0.1, 1e7, 12345678.9, 0.0001, 1.234e-05, 1e16, 1.5e17, -0.0, float("nan"), float("inf"), -2.5e-7, None]
    assert _texts(spark, vals, T.DoubleType()) == [
        "17.0", "0.1", "10000000.0", "12345678.9", "0.0001", "1.234e-05", "1e+16", "1.5e+17", "-0.0", "nan", "inf",
        "-2.5e-07", None]


def test_list_text_uses_null_word(spark):
    dt = T.ArrayType(T.DoubleType())
    assert _texts(spark, [[1.0, None, 10.0], [], None], dt) == ["[1.0, NULL, 10.0]", "[]", None]


@pytest.fixture(scope="module")
def nested(spark):
    rows = [(i, [float(i), float(i + 1)], ("k%d" % i, i), ["x", "y"] if i % 2 else ["y"], "g%d" % (i % 3)) for i in range(10)]
    schema = "id long, nums array<double>, st struct<k:string,n:long>, tags array<string>, grp string"
    return spark.createDataFrame(rows, schema)


def test_list_element_filter_is_containment(spark, nested):
    got = sorted(r.id for r in apply_filters(nested, filters=[Filter("nums", value="1.0")]).collect())
    assert got == [0, 1]


def test_whole_array_literal_is_equality(spark, nested):
    f = normalize_contains(nested.schema, [Filter("nums", value="[1.0, 2.0]", contains=True)])
    assert f[0].contains is False
    assert [r.id for r in apply_filters(nested, filters=f).collect()] == [1]


def test_or_within_column_and_across(spark, nested):
    fl = [Filter("grp", value="g0"), Filter("grp", value="g1"), Filter("id", min=2, max=7)]
    got = sorted(r.id for r in apply_filters(nested, filters=fl).collect())
    assert got == [3, 4, 6, 7]


def test_negations_keep_nulls_and_and_together(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "g%d" % (i % 4)) for i in range(20)], "id long, grp string")
    fl = [Filter("grp", value="g1", negate=True), Filter("grp", value="g2", negate=True)]
    got = apply_filters(df, filters=fl).collect()
    assert all(r.grp not in ("g1", "g2") for r in got)
    assert sum(r.grp is None for r in got) == 4          # NULLs survive IS DISTINCT FROM


def test_null_joins_or_group(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "g%d" % (i % 4)) for i in range(20)], "id long, grp string")
    got = apply_filters(df, filters=[Filter("grp", value="g1"), Filter("grp", is_null=True)]).count()
    assert got == 4 + 4


def test_negated_containment_drops_null_lists(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, None)], "id long, l array<string>")
    got = [r.id for r in apply_filters(df, filters=[Filter("l", value="a", negate=True)]).collect()]
    assert got == [2]


def test_range_negate_has_no_effect(spark):
    df = spark.range(10)
    a = apply_filters(df, filters=[Filter("id", min=3, max=5)]).count()
    b = apply_filters(df, filters=[Filter("id", min=3, max=5, negate=True)]).count()
    assert a == b == 3


def test_bare_date_tmax_is_whole_day(spark):
    df = spark.createDataFrame([("2024-01-31 23:59:59",), ("2024-02-01 00:00:00",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))
    assert apply_filters(df, filters=[Filter("t", tmax="2024-01-31")]).count() == 1
    assert apply_filters(df, filters=[Filter("t", tmax="2024-01-31 12:00:00")]).count() == 0


def test_search_any_column_case_insensitive_with_wildcards(spark, nested):
    assert apply_filters(nested, q="  G2 ").count() == 3
    assert apply_filters(nested, q="k_").count() == 10          # '_' is a wildcard
    assert build_predicate(nested.schema, q="   ") is None


def test_string_equality_pushes_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = apply_filters(df, filters=[Filter("o_orderstatus", value="F")])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan


def test_malformed_filter_json_raises():
    with pytest.raises(Exception):
        filters_from_json("[{not json")
    assert filters_from_json('[{"column": "a", "value": "x", "ignored": 1}]') == [Filter("a", value="x")]


def test_integer_value_filter_matches_text_exactly(spark):
    df = spark.createDataFrame([(0,), (5,), (-5,), (None,)], "v long")
    for text, want in {"0": 1, "-0": 0, "5": 1, "05": 0, "-5": 1, "5.0": 0}.items():
        assert apply_filters(df, filters=[Filter("v", value=text)]).count() == want, text


def test_typed_predicates_reach_the_scan(spark, tmp_path):
    from decimal import Decimal
    path = str(tmp_path / "typed")
    spark.range(100).select(
        "id", (F.col("id") / 100).alias("d"), (F.col("id") + 2 ** 53).alias("big"), (F.col("id") / 4).cast("decimal(9,2)").alias("m"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id)").alias("t"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(id)").alias("z")).write.parquet(path)
    df = spark.read.parquet(path)

    def run(f, pushed):
        out = apply_filters(df, None, [f])
        plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert pushed in plan, plan
        return sorted(r.id for r in out.collect())
    assert run(Filter("d", value="0.05"), "EqualTo(d,0.05)") == [5]
    assert run(Filter("m", value="0.75"), "EqualTo(m,0.75)") == [3]
    assert run(Filter("t", value="2024-01-03 00:00:00"), "EqualTo(t,2024-01-03") == [2]
    assert run(Filter("z", value="2024-01-03 00:00:00"), "GreaterThanOrEqual(z,") == [2]
    assert run(Filter("id", min=9.5, max=12), "GreaterThanOrEqual(id,10)") == [10, 11, 12]
    assert run(Filter("big", min=2 ** 53 + 1, max=2 ** 53 + 2), f"GreaterThanOrEqual(big,{2 ** 53 + 1})") == [1, 2]
    assert run(Filter("m", min=0.3, max=Decimal("0.8")), "GreaterThanOrEqual(m,0.30)") == [2, 3]
    assert run(Filter("d", min=0.97), "GreaterThanOrEqual(d,0.97)") == [97, 98, 99]
    for f, n in ((Filter("id", min=1e30), 0), (Filter("id", max=1e30), 100), (Filter("id", min=float("-inf")), 100), (Filter("d", value="x"), 0)):
        assert apply_filters(df, None, [f]).count() == n
