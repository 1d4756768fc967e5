"""Prediction matrix and junk detection on planted truth."""
import pytest
from pyspark.sql import functions as F

from tablescope.operators import predict as P
from tablescope.operators.filters import Filter
from tablescope.operators.junk import junk, verdicts


def _pairs(pr):
    return {(r.x, r.y): r for r in pr.pairs.collect()}


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("g"), (F.col("id") % 5).cast("string")).alias("grp"),
        F.concat(F.lit("b"), (F.col("id") % 5).cast("string")).alias("bucket"),
        F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("y"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("noise"))
    return df


def test_planted_dependencies(spark, planted):
    pr = P.predict(planted)
    p = _pairs(pr)
    assert p[("grp", "bucket")].score > 0.99 and p[("bucket", "grp")].score > 0.99
    assert p[("x", "y")].score > 0.99 and p[("y", "x")].score > 0.99
    assert p[("x", "y")].method == "spearman_sq"
    assert p[("grp", "noise")].score < 0.05


def test_roles_and_filter_scope(spark):
    df = spark.range(400).select(
        "id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("uniq_text"), F.lit("same").alias("always"),
        F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("grp"),
        (10.0 * (F.col("id") % 4) + F.pmod(F.xxhash64("id"), F.lit(10))).alias("val"))
    pr = P.predict(df)
    roles = {r.name: (r.role, r.reason) for r in pr.roles}
    assert roles["id"] == ("excluded", "id_like")
    assert roles["uniq_text"] == ("excluded", "high_cardinality")
    assert roles["always"] == ("excluded", "constant")
    assert _pairs(pr)[("grp", "val")].score > 0.8
    scoped = P.predict(df, filters=[Filter("grp", value="g0")])
    assert scoped.row_count == 100
    assert {r.name: r.reason for r in scoped.roles}["grp"] == "constant"


def test_role_ladder_and_pair_plan():
    from pyspark.sql import types as T
    profs = [P.Profile("a", T.LongType(), True, False, 100, 100), P.Profile("b", T.StringType(), True, False, 100, 600),
             P.Profile("c", T.StringType(), True, False, 100, 3), P.Profile("d", T.DoubleType(), True, False, 0, 0),
             P.Profile("e", T.DoubleType(), True, False, 100, 90), P.Profile("c", T.StringType(), True, True, 100, 3),
             P.Profile("f", T.BinaryType(), False, False, 100, 3)]
    roles = P.assign_roles(profs, 100)
    assert [r.reason for r in roles] == ["id_like", "high_cardinality", None, "all_null", None, "duplicate_name", "unsupported_type"]
    usable = [r for r in roles if r.role != "excluded"]
    plans = {(p.x, p.y): p.method for p in P.plan_pairs(usable)[0]}
    assert plans == {("c", "e"): "eta_sq", ("e", "c"): "binned_theil_u"}


def test_no_column_or_category_is_left_out_unless_asked():
    from pyspark.sql import types as T
    profs = [P.Profile(f"c{i}", T.DoubleType(), True, False, 100, 50) for i in range(25)]
    profs.append(P.Profile("wide", T.StringType(), True, False, 100_000, 20_000))
    roles = P.assign_roles(profs, 100_000)
    assert all(r.reason is None for r in roles)
    plans, skipped = P.plan_pairs(roles)
    assert len(plans) == 25 * 24 // 2 + 50 and not skipped
    limits = P.Limits(columns=20, cat_distinct=500)
    roles = P.assign_roles(profs, 100_000, limits)
    assert [r.reason for r in roles] == [None] * 20 + ["column_cap"] * 5 + ["high_cardinality"]


def test_a_skipped_pair_is_reported():
    from pyspark.sql import types as T
    rows = [P.RoleRow(n, T.StringType(), "cat", d, 0, None) for n, d in (("a", 300), ("b", 200))]
    plans, skipped = P.plan_pairs(rows, P.Limits(joint_cells=50_000))
    assert plans == [] and skipped == [("a", "b", "joint_cells"), ("b", "a", "joint_cells")]


def test_junk_fixture(spark):
    df = spark.range(200).select(
        "id", F.lit("fixed").alias("always"), F.lit(None).cast("string").alias("empty"),
        F.when(F.col("id") < 10, F.col("id").cast("string")).alias("sparse"),
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("grp"),
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("grp_copy"),
        F.when(F.col("id") == 7, "odd").otherwise("usual").alias("nearly"))
    rep = junk(df)
    cols = {r.column_name: r for r in rep.columns.collect()}
    assert (cols["always"].non_null, cols["empty"].non_null, cols["sparse"].non_null, cols["nearly"].top_count) == (200, 0, 10, 199)
    assert [(r.a, r.b) for r in rep.duplicates.collect()] == [("grp", "grp_copy")]
    v = {r.column_name: r.verdict for r in verdicts(rep).collect()}
    assert v["always"] == "constant" and v["empty"] == "all_null" and v["nearly"] == "near_constant" and v["sparse"] == "sparse"


def test_near_copy_is_not_a_duplicate(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("a"),
                                   F.when(F.col("id") == 12345, "x").otherwise(F.col("id").cast("string")).alias("b"))
    assert junk(df).duplicates.count() == 0


# ---- ranks of columns of few and of many values

def test_ranks_joined_and_broadcast_and_bins_without_a_join_give_the_same_scores(spark, monkeypatch):
    df = spark.range(400).select(
        F.when(F.col("id") % 7 != 0, F.col("id") * 3 % 211).alias("r0"), (F.pow("id", 2) % 97).alias("q"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 5 * 1.0).otherwise(float("nan")).alias("few"), F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("g"))
    got, plans, sums = [], [], P._rank_sums
    monkeypatch.setattr(P, "_rank_sums", lambda wide, *a: plans.append(wide._jdf.queryExecution().optimizedPlan().toString()) or sums(wide, *a))
    for values in (1_000_000, 50, 0):
        monkeypatch.setattr(P, "BROADCAST_VALUES", values)
        got.append({(r.x, r.y, r.method): (r.n, round(r.score, 9)) for r in P.predict(df).pairs.collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 12
    assert [p.count("strategy=broadcast") for p in plans] == [3, 1, 0]
