"""Display formats, fuzzy matching, event-log folds (batch and streaming)."""
import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import formats as FM
from tablescope.operators.fuzzy import closest_match
from tablescope.streaming import events as EV


def _one(spark, expr, value, dtype="double"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v"))).collect()[0][0]


def test_currency_symbols_and_fallback(spark):
    assert _one(spark, lambda c: FM.format_number_col(c, FM.currency("usd")), 1234.5) == "$1,234.50 USD"
    assert _one(spark, lambda c: FM.format_number_col(c, FM.currency("XYZ")), 1.0) == "XYZ 1.00 XYZ"
    assert _one(spark, lambda c: FM.format_number_col(c, FM.currency("JPY", 0)), 1234.4) == "¥1,234 JPY"


def test_duration_text(spark):
    cases = {45: "45s", 135: "2m 15s", 120: "2m", 3900: "1h 05m", -75: "-1m 15s", 0.4: "0s"}
    for v, want in cases.items():
        assert _one(spark, FM.duration_text, float(v)) == want


def test_slug(spark):
    for raw, want in {"  Hello, World!  ": "hello-world", "Ünïcode__Name": "n-code-name", "!!!": "session", "A--B": "a-b"}.items():
        assert _one(spark, FM.slug, raw, "string") == want


def test_link_template(spark):
    df = spark.createDataFrame([("a b/c", "x&y", None)], "user_uuid string, company string, n string")
    r = FM.link(df, "user_uuid", "https://h/{company}/u/{value}?n={n}&r={value:raw}&z={nope}",
                "user {value} at {company:url}").collect()[0]
    assert r.link_url == "https://h/x%26y/u/a%20b%2Fc?n=&r=a b/c&z={nope}"
    assert r.link_title == "user a b/c at x%26y"


def test_list_format(spark):
    dtp = T.ArrayType(T.DoubleType())
    df = spark.createDataFrame([([1.0, 10.0],), ([],), (None,)], "l array<double>")
    got = [r[0] for r in df.select(FM.list_text(F.col("l"), dtp.elementType, " ms")).collect()]
    assert got == ["1.0, 10.0 ms", "—", None]


def test_epoch_units_checked(spark):
    with pytest.raises(ValueError):
        FM.epoch_to_timestamp(F.col("x"), "ns")


def test_format_resolution_precedence(spark):
    comments = spark.createDataFrame([("db", "t", "price", 'tablescope:{"prefix": "$"}'), ("db", "t", "qty", "plain words"),
                                      ("db", "t", "ts", "")], "db string, table string, column string, spec string")
    reg = spark.createDataFrame([("db", None, "price", '{"suffix": "!"}', 1), ("db", None, "qty", '{"decimals": 0}', 1),
                                 ("db", "t", "ts", '{"tz": "utc"}', 1), ("db", "t", "ts", "", 2)],
                                "db string, table string, column string, spec string, seq long")
    got = {r.column: r.spec for r in FM.resolve_formats(comments, reg).collect()}
    assert got == {"price": '{"prefix": "$"}', "qty": '{"decimals": 0}'}


def test_closest_match_equals_brute_force(spark):
    import random
    rnd = random.Random(5)
    alpha = "abcde"
    vocab = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    queries = ["".join(rnd.choice(alpha.upper()) for _ in range(rnd.randint(1, 7))) for _ in range(200)]
    v = spark.createDataFrame([(w, i) for i, w in enumerate(vocab)], "w string, o long")
    q = spark.createDataFrame([(x,) for x in queries], "q string")
    got = {r.query: (r.w, r.distance) for r in closest_match(q, "q", v, "w", "o").collect()}

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a):
            cur = [i + 1]
            for j, cb in enumerate(b):
                cur.append(min(prev[j] + (ca != cb), prev[j + 1] + 1, cur[j] + 1))
            prev = cur
        return prev[-1]
    first = {}
    for i, w in enumerate(vocab):
        first.setdefault(w, i)
    want = {}
    for x in {s.lower() for s in queries}:
        best = min(((lev(x, w), first[w], w) for w in first), default=None)
        if best and best[0] <= 2:
            want[x] = (best[2], best[0])
    assert got == want


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, phase string, cwd string, db_path string, exit_code int, session string")


T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _t(m):
    return T0 + dt.timedelta(minutes=m)


LEDGER = [(1, _t(0), "start", "/a", None, None, "s1"), (1, _t(5), "end", None, "x.db", 0, None),
          (2, _t(1), "start", "/b", "y.db", None, "s1"), (3, _t(2), "end", None, None, 2, None),
          (4, _t(3), "bogus", None, None, None, None), (5, _t(4), "start", "/c", None, None, "s2"),
          (5, _t(9), "end", None, None, 3, None)]


def test_batch_fold(spark):
    got = {r.id: r for r in EV.fold(_ledger(spark, LEDGER)).collect()}
    assert set(got) == {1, 2, 5}
    assert got[1].db_path == "x.db" and got[1].exit_code == 0 and not got[1].running
    assert got[2].running and got[2].db_path == "y.db" and got[2].ended is None
    assert got[5].exit_code == 3


def test_streaming_fold_matches_batch_and_drops_late(spark):
    from tablescope.session import scratch_path
    base = scratch_path(spark, "fold-stream-test")
    src = os.path.join(base, "in")
    schema = _ledger(spark, LEDGER[:1]).schema
    batches = [LEDGER[:3], LEDGER[3:], [(9, _t(-600), "start", "/late", None, None, "s9"),
                                         (7, _t(700), "start", "/z", None, None, "s3")]]
    q = None
    out = "fold_stream_out"
    for i, b in enumerate(batches):
        _ledger(spark, b).coalesce(1).write.mode("append").parquet(src)
        if q is None:
            stream = spark.readStream.schema(schema).parquet(src)
            q = (EV.fold_stream(stream, watermark="1 hour").writeStream.outputMode("update").format("memory")
                 .queryName(out).option("checkpointLocation", os.path.join(base, "chk")).start())
        q.processAllAvailable()
    q.stop()
    rows = spark.table(out).collect()
    last = {}
    for r in rows:
        last[r.id] = r
    assert 9 not in last                                   # later than the watermark: dropped
    assert not last[1].running and last[1].db_path == "x.db"
    assert last[5].exit_code == 3 and 3 not in last        # end without start ignored
    assert last[7].running


def test_active_keys_and_history(spark):
    t = spark.createDataFrame([("a", _t(0), False), ("a", _t(5), True), ("b", _t(1), True), ("b", _t(6), False),
                               ("c", _t(2), False)], "key string, ts timestamp_ntz, forget boolean")
    assert {r.key for r in EV.active_keys(t).collect()} == {"b", "c"}
    h = EV.history(_ledger(spark, LEDGER), 3).collect()
    assert [r.id for r in h] == [5, 1, 5]


def test_bare_formats_reach_columns_without_comment_and_broken_json_is_none(spark):
    comments = spark.createDataFrame([("db", "t", "a", "{broken"), ("db", "t", "b", '{"x": 1}')], "db string, table string, column string, spec string")
    reg = spark.createDataFrame([("db", None, c, '{"bare": 1}', 1) for c in ("a", "b", "c")], "db string, table string, column string, spec string, seq long")
    every = spark.createDataFrame([("db", "t", c) for c in ("a", "b", "c", "d")], "db string, table string, column string")
    got = {r.column: r.spec for r in FM.resolve_formats(comments, reg, every).collect()}
    assert got == {"a": '{"bare": 1}', "b": '{"x": 1}', "c": '{"bare": 1}'}


def test_forget_records_are_no_phases_and_first_start_counts(spark):
    import datetime as dt
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, at(1), "start", "first", False), (1, at(2), "start", "second", None), (2, at(1), "start", "x", True)]
    led = (spark.createDataFrame(rows, "id long, ts timestamp_ntz, phase string, cwd string, forget boolean")
           .selectExpr("*", "cast(null as string) db_path", "cast(null as int) exit_code", "cwd as session"))
    got = EV.fold(led).collect()
    assert [(r.id, r.started, r.cwd, r.session, r.running) for r in got] == [(1, at(1), "first", "first", True)]


def test_profile_survives_restart_and_replay(spark):
    from tablescope.session import scratch_path
    base = scratch_path(spark, "profile-restart")
    schema = "k string, v double"

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")

    def go(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
        path = EV.stream_profile(spark, stream, "k", "v", base + "/out", base + checkpoint)
        return path, {r.key: (r.n, r.total) for r in spark.read.parquet(path).collect()}

    add(("a", 1.0), ("b", 2.0))
    add(("a", 3.0))
    assert go("/chk")[1] == {"a": (2, 4.0), "b": (1, 2.0)}
    add(("b", 5.0), (None, 1.0))
    path, got = go("/chk")                   # a new query from the same checkpoint
    assert path.endswith("/v2") and got == {"a": (2, 4.0), "b": (2, 7.0), None: (1, 1.0)}
    assert go("/other-chk")[1] == got        # every batch replayed over its own version
