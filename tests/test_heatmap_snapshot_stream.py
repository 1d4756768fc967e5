"""Whole-job checks: each of them failed before its finding was settled."""
import datetime as dt

from pyspark.sql import functions as F

from tablescope.operators.tiles import heatmap_grid
from tablescope.plans import TABLES, catalog, tiling
from tablescope.session import scratch_path
from tablescope.streaming import events as EV

SF = "/root/testdata/sf0.001"


# ---- heatmap and snapshot

def test_heatmap_grid_gathers_no_axis_and_fills_zeros(spark):
    df = spark.createDataFrame([("a", f"y{i}") for i in range(50)] + [("b", "y0"), ("b", "y0"), (None, "z"), ("c", None)], "k string, v string")
    grid = heatmap_grid(df, "k", "v")
    assert "collect_set" not in grid._jdf.queryExecution().toString()
    got = {(r.x, r.y): r.value for r in grid.collect()}
    assert got == {("a", f"y{i}"): 1.0 for i in range(50)} | {("b", f"y{i}"): 2.0 if i == 0 else 0.0 for i in range(50)}


def test_heatmap_counts_all_orders(spark):
    total = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert sum(r.value for r in tiling.tile_heatmap_all(spark, SF).collect()) == total


def test_snapshot_restore_bundles_all_tables(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "restore", lambda s, b, f=catalog.restore: seen.append(f(s, b)) or seen[-1])
    rows = catalog.snapshot_restore(spark, SF).count()
    assert set(seen[0]) == set(TABLES) and rows == spark.read.parquet(f"{SF}/orders.parquet").count()


# ---- stream fold

def test_stream_fold_keeps_finished_runs_for_repeated_starts_and_ends(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[(1, t(0), "start", "/a", "a.db", None, "s"), (1, t(5), "end", None, None, 0, None),
                (2, t(2), "start", "/b", None, None, "s"), (2, t(4), "end", None, "b.db", 0, None)],
               [(1, t(10), "start", "/again", "x.db", None, "r"), (2, t(9), "end", None, "late.db", 3, None)],
               [(3, t(12), "start", "/c", None, None, "s"), (2, t(11), "start", "/b2", None, None, "s")]]
    names = "id long, ts timestamp_ntz, phase string, cwd string, db_path string, exit_code int, session string"
    base = scratch_path(spark, "fold-again")
    for rows in batches:
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(base + "/in")
    led = spark.createDataFrame([r for rows in batches for r in rows], names)
    out = EV.run_fold_stream(spark, base + "/in", led.schema, base + "/out", base + "/chk")
    got = out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")}).select(EV.fold(led).columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in EV.fold(led).collect()}
