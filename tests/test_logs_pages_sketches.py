"""Keyed logs, the format registry, keyset pages, digests instead of texts, sketches, evicted stream state."""
import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tablescope.operators.census import heavy_values
from tablescope.operators.pages import KEY, Cursor, Pages
from tablescope.operators.stats import Stats, sketch_quantiles, sketch_rank_error
from tablescope.plans import profiling
from tablescope.session import scratch_path
from tablescope.sources.format_registry import FormatRegistry
from tablescope.sources.keyedlog import KeyedLog, latest
from tablescope.streaming import events as EV

SF = "/root/testdata/sf0.001"


# ---- keyed log

def _sums(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("commit").alias("commit"))


def _read(log):
    return {r.k: r.n for r in _sums(log.rows()).collect()}


def test_a_numbered_commit_counts_once_also_after_compactions(spark):
    log = KeyedLog(spark, scratch_path(spark, "log"), "k string, n long")
    delta = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    assert _read(log) == {}
    assert log.commit(0, delta(("a", 1), (None, 2))) and log.commit(1, delta(("a", 5)))
    assert not log.commit(1, delta(("a", 100)))
    log.compact(_sums)
    assert _read(log) == {"a": 6, None: 2}
    assert not log.commit(0, delta(("a", 100)))
    assert log.commit(2, delta(("b", 3)))
    log.compact(_sums)
    log.compact(_sums)                              # nothing new: nothing happens
    assert log.commit(3, delta(("b", 1)))
    log.compact(_sums)
    assert _read(log) == {"a": 6, None: 2, "b": 4}
    assert log._published("commit") == [f"{3:012d}"] and len(log._published("base")) <= 2    # older folders are gone
    assert not any(log.commit(i, delta(("a", 100))) for i in range(4))


def test_a_commit_that_broke_off_is_not_read_and_a_late_one_is_not_lost(spark):
    path = scratch_path(spark, "log")
    log = KeyedLog(spark, path, "k string, v string")
    row = lambda v: spark.createDataFrame([("a", v)], "k string, v string")
    log.append(row("first"))
    late = "000000000002-" + "0" * 12               # a writer took its name, then a compaction came first
    log.append(row("second"))
    log.compact(lambda rows: latest(rows, ["k"]))
    log._write(late, row("late").union(spark.createDataFrame([("b", "late")], "k string, v string")))
    got = {r.k: r.v for r in latest(log.rows(), ["k"]).collect()}
    assert got == {"a": "second", "b": "late"}
    broken = log.append(row("broken"))
    os.remove(os.path.join(path.removeprefix("file:"), f"commit={broken}", "_SUCCESS"))
    assert {r.k: r.v for r in latest(log.rows(), ["k"]).collect()} == got


def test_a_batch_writes_its_own_keys_only(spark):
    base = scratch_path(spark, "profile")
    every = [(f"k{i}", 1.0) for i in range(500)]
    for rows in (every, [("k7", 2.0)], [(None, 4.0), ("k7", 1.0)]):
        spark.createDataFrame(rows, "k string, v double").coalesce(1).write.mode("append").parquet(base + "/in")

    def go(checkpoint):
        stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(base + "/in")
        out = EV.profile_log(spark, stream, "k", "v", base + "/log", base + checkpoint, compact_every=100)
        return {r.key: (r.n, r.total) for r in out.collect()}

    got = go("/chk")
    assert len(got) == 501 and got["k7"] == (3, 4.0) and got[None] == (1, 4.0) and got["k8"] == (1, 1.0)
    sizes = [spark.read.parquet(f"{base}/log/commit={i:012d}").count() for i in range(3)]
    assert sizes == [500, 1, 2]
    assert go("/other-chk") == got                  # every batch replayed


def test_registry_overwrites_removes_and_compacts(spark):
    reg = FormatRegistry(spark, scratch_path(spark, "formats"))
    assert reg.entries().count() == 0
    reg.set("db", "price", '{"prefix":"$"}', "t")
    reg.set("db", "price", '{"decimals":2}')
    reg.set("db", "price", '{"prefix":"€"}', "t")
    see = lambda: {(r.table, r.column): r.spec for r in reg.entries().collect()}
    assert see() == {("t", "price"): '{"prefix":"€"}', (None, "price"): '{"decimals":2}'}
    reg.remove("db", "price")
    reg.remove("db", "never there", "t")
    reg.compact()
    assert see() == {("t", "price"): '{"prefix":"€"}'}
    reg.set("db", "price", '{"group":true}')
    assert see()[None, "price"] == '{"group":true}'


# ---- keyset pages

def _expected(rows, down):
    """NULLs last both ways, NaN above all numbers."""
    number = lambda v: (1, 0.0) if math.isnan(v) else (0, v)
    some = [r for r in rows if r[0] is not None]
    some.sort(key=lambda r: (r[1] is None, r[1] or 0))
    some.sort(key=lambda r: number(r[0]), reverse=down)
    return some + sorted((r for r in rows if r[0] is None), key=lambda r: (r[1] is None, r[1] or 0))


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_from_a_cursor_are_the_sorted_rows(spark, direction):
    rng = random.Random(5)
    rows = [(rng.choice([None, float("nan"), 1.0, 2.5, -3.0, 7.0]), rng.choice([None, 1, 2, 3]), rng.choice("xy")) for _ in range(120)]
    df = spark.createDataFrame(rows + rows[:30], "v double, t int, c string").repartition(5)
    want = [(None if r[0] is None else str(r[0]), r[1]) for r in _expected(rows + rows[:30], direction == "desc")]
    pages, cursor, got = Pages(df, "v", direction, ["t"]), None, []
    while True:
        shown = pages.page(cursor, 13).collect()
        if not shown:
            break
        got += shown
        cursor = pages.after(shown, cursor)
    assert [(None if r.v is None else str(r.v), r.t) for r in got] == want
    assert sorted(map(str, ((r.v, r.t, r.c) for r in got))) == sorted(map(str, rows + rows[:30]))   # no row twice, none lost
    for offset in (0, 1, 77, 149):
        there = pages.page(pages.seek(offset), 13).collect()
        assert list(map(str, there)) == list(map(str, got[offset:offset + 13]))
    assert pages.seek(150) is None


def test_pages_without_a_sort_of_nothing_and_of_naive_times(spark):
    empty = spark.createDataFrame([], "a int, m map<string,int>")
    assert Pages(empty, "nothing").page().count() == 0 and Pages(empty).seek(0) is None
    times = spark.range(20).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-03-30 20:00:00").cast("timestamp_ntz")).alias("at"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        pages = Pages(times, "at")
        shown = pages.page(pages.seek(5), 3).collect()
        assert [r.at.hour for r in shown] == [1, 2, 3] and pages.page(pages.after(shown), 1).first().at.hour == 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_page_pushes_its_cursor_to_the_scan(spark):
    pages = Pages(spark.read.parquet(f"{SF}/orders.parquet"), "o_totalprice", "desc", ["o_orderkey"])
    page = pages.page(Cursor((1000.5, 7, 1)), 10)
    plan = spark._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(o_totalprice,1000.5)" in plan and "TakeOrderedAndProject" in plan


# ---- digests and sketches

def test_heavy_values_shuffle_no_whole_texts_and_equal_the_census(spark):
    long = "word " * 20000
    rows = [(long + str(i % 7),) for i in range(40)] + [("",)] * 3 + [(None,)] * 5 + [(f"once {i:03d}",) for i in range(30)] + [(long[:32] + chr(97 + i),) for i in range(20)]
    df = spark.createDataFrame(rows, "t string")
    for k in (1, 5, 12, 40, 200):
        st = Stats(df, top=k)
        assert sorted(map(tuple, st.top_long().collect())) == sorted(map(tuple, st.top().collect()))
    got = heavy_values(spark.createDataFrame([], "t string"), [("t", F.col("t"))], 3)
    assert got.count() == 0


def test_sketches_keep_their_rank_error_and_merge_groups(spark):
    rng = random.Random(1)
    rows = [(i % 3, rng.lognormvariate(0, 2)) for i in range(30000)] + [(0, None), (0, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    found = sketch_quantiles(df, ["v"], [0.1, 0.5, 0.99], by=["g"]).collect()
    assert len(found) == 9                          # the group without a value has no rows
    for r in found:
        values = [v for g, v in rows if g == r.g and v is not None and not math.isnan(v)]
        under, upto = sum(v < r.value for v in values) / len(values), sum(v <= r.value for v in values) / len(values)
        assert under - 2 * sketch_rank_error() <= r.p <= upto + 2 * sketch_rank_error()


def test_sketched_groups_are_checked_where_their_rows_lie(spark, monkeypatch):
    few = profiling.stats_quartiles_sketch(spark, SF)
    assert "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(profiling, "SKETCH_GROUPS", 0)
    many = profiling.stats_quartiles_sketch(spark, SF)
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(few.collect()) == sorted(many.collect()) and all(r.within_bound for r in few.collect())


# ---- stream state

def test_timers_evict_old_runs_from_the_state(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    names = "id long, ts timestamp_ntz, phase string, cwd string, db_path string, exit_code int, session string"
    base, held, name = scratch_path(spark, "evict"), [], "evicted_runs"
    deliveries = [[(i, at(0), "start", "/a", None, None, "s") for i in range(40)] + [(1, at(0.5), "end", None, None, 0, None)],
                  [(100, at(60), "start", "/b", None, None, "s")],
                  [(101, at(61), "start", "/c", None, None, "s"), (2, at(1), "end", None, None, 5, None)]]
    q = None
    for rows in deliveries:
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(base + "/in")
        if q is None:
            stream = spark.readStream.schema(names).parquet(base + "/in")
            q = (EV.fold_stream(stream, "1 hour").writeStream.outputMode("update").format("memory").queryName(name)
                 .option("checkpointLocation", base + "/chk").start())
        q.processAllAvailable()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    rows = spark.table(name).collect()
    assert held[0] >= 40 and held[-1] < 10          # runs and their timers are gone
    assert [r.running for r in rows if r.id == 2] == [True, True]     # its end came after the watermark; the timer's last word
    assert [r.running for r in rows if r.id == 1][-1] is False and {r.id for r in rows} == {*range(40), 100, 101}


class _Store:
    """A state store of one key that counts the messages to it."""
    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 3_600_000

    def getExpiryTimeInMs(self):
        return min(self.timers)


def test_the_fold_asks_its_state_once_a_bucket_and_not_once_a_run():
    row = Row("id", "at", "phase", "db_path", "cwd", "session", "exit_code")
    hour = 3_600_000_000
    store, fold = _Store(), EV.RunFold(2 * 3_600_000)
    fold.init(store)
    starts = [row(i, (i % 3 + 1) * hour, "start", None, "/a", "s", None) for i in range(500)]
    assert len(list(fold.handleInputRows((0,), iter(starts), store))) == 500 and store.calls <= 4
    ended = list(fold.handleInputRows((0,), iter([row(i, 4 * hour, "end", "e.db", None, None, i) for i in range(0, 500, 3)]), store))
    assert store.calls <= 8 and all((r.started, r.ended, r.exit_code, r.db_path) == (hour, 4 * hour, r.id, "e.db") for r in ended)
    assert store.timers == {3 * 3_600_000}                       # one timer, of the runs that are due first
    assert list(fold.handleExpiredTimer((0,), store, store)) == []   # they have ended
    store.timers.remove(3 * 3_600_000)                           # Spark drops a timer that has fired
    assert store.timers == {4 * 3_600_000}
    assert {r.id for r in fold.handleExpiredTimer((0,), store, store)} == {i for i in range(500) if i % 3 == 1}
