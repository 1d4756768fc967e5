"""Ordered scans, timeline packing and sequence diagrams against brute force."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablescope.operators import sequence as SQ
from tablescope.operators import timeline as TM
from tablescope.operators.ordered import lay_out, ordered_scan


def test_ordered_scan_matches_windows_with_hot_key(spark):
    rnd = random.Random(3)
    rows = [(i, 7 if i < 3000 else rnd.randint(0, 50), rnd.random() * 100, None if i % 11 == 0 else float(i % 17))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k long, t double, v double")
    got = ordered_scan(df, ["k"], ["t", "id"], lags=["t"], sums=["id"], prior_max=["v"], partitions=13)
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = df.select("id", F.lag("t").over(w).alias("prev_t"),
                    F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_id"),
                    F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("pmax_v"))
    a = {r.id: (r.prev_t, r.cum_id, r.pmax_v) for r in got.collect()}
    b = {r.id: (r.prev_t, r.cum_id, r.pmax_v) for r in exp.collect()}
    assert a == b


def test_ordered_scan_null_keys_long_values_and_no_keys(spark):
    big = 2 ** 53 + 1
    rows = [(i, None if i % 3 else 1, None if i % 2 else "r", None if i % 7 == 0 else big + i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, run string, v long")
    for keys in (["k", "run"], ["k"], []):
        w = Window.partitionBy(*(keys or [F.col("id") * 0])).orderBy("id")
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        exp = df.select("*", F.lag("v").over(w), F.coalesce(F.sum("v").over(upto), F.lit(0)), F.max("v").over(before), F.sum("v").over(whole))
        for parts in (1, 7):
            got = ordered_scan(df, keys, ["id"], lags=["v"], sums=["v"], prior_max=["v"], totals=["v"], partitions=parts)
            assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, exp.collect()), key=lambda r: r[0])
    assert ordered_scan(df.limit(0), ["k"], ["id"], lags=["v"], sums=["v"]).count() == 0


def _greedy(bars):
    """The reference's rule, whole lane at once: sort by start (stable), lowest
    sublane whose end <= start, else a new one."""
    out = {}
    for lane in {b[1] for b in bars}:
        lst = sorted([b for b in bars if b[1] == lane], key=lambda b: (b[2], b[0]))
        ends = []
        for o, _, s, e in lst:
            k = next((i for i, end in enumerate(ends) if end <= s), None)
            if k is None:
                k = len(ends)
                ends.append(e)
            else:
                ends[k] = e
            out[o] = k
    return out


def test_sublanes_equal_whole_lane_greedy(spark):
    rnd = random.Random(11)
    bars = []
    for o in range(3000):
        lane = rnd.choice(["a", "a", "a", "b", "c"])          # a hot lane
        s = rnd.randint(0, 5000)
        bars.append((o, lane, float(s), float(s + rnd.choice([0, 1, 5, 20, 60, 300]))))
    df = spark.createDataFrame(bars, "ord long, lane string, s double, e double")
    got = {r.ord: r.sub for r in TM.sublanes(df).collect()}
    assert got == _greedy(bars)


def test_sublanes_over_many_ranges_equal_whole_lane_greedy(spark, monkeypatch):
    rnd = random.Random(12)
    bars = [(o, "one lane" if o % 4 else "b", float(o // 3), float(o // 3 + rnd.choice([0, 1, 2, 40, 300, 2000]))) for o in range(400)]
    df = spark.createDataFrame(bars, "ord long, lane string, s double, e double")
    for size in (60, 100):
        assert {r.ord: r.sub for r in TM.sublanes(df, range_bars=size).collect()} == _greedy(bars)
    assert TM.sublanes(df.limit(0)).count() == 0


def test_loess_between_vertices(spark):
    from tablescope.operators import series as SR
    rnd = random.Random(13)
    x = sorted(rnd.uniform(0, 100) for _ in range(150))
    y = [v * v / 50 + rnd.gauss(0, 1) for v in x]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double").repartition(3)
    every = {r.idx: r.fit for r in SR.loess(df, "x", "y").collect()}

    def direct(i, q=45):
        d = sorted(abs(v - x[i]) for v in x)[q - 1]
        w = [(1 - (abs(v - x[i]) / d) ** 3) ** 3 if abs(v - x[i]) < d else 0.0 for v in x]
        s0, su, sv = sum(w), sum(a * (v - x[i]) for a, v in zip(w, x)), sum(a * b for a, b in zip(w, y))
        suu, suv = sum(a * (v - x[i]) ** 2 for a, v in zip(w, x)), sum(a * (v - x[i]) * b for a, v, b in zip(w, x, y))
        return (sv - (s0 * suv - su * sv) / (s0 * suu - su * su) * su) / s0

    assert all(abs(every[i] - direct(i)) < 1e-8 for i in range(150))
    few = {r.idx: r.fit for r in SR.loess(df, "x", "y", vertices=12).collect()}
    nodes = [k * 149 // 11 for k in range(12)]
    for a, b in zip(nodes, nodes[1:]):
        for i in range(a, b + 1):
            assert abs(few[i] - (direct(a) + (x[i] - x[a]) / (x[b] - x[a]) * (direct(b) - direct(a)))) < 1e-8
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, 6.0)], "x double, y double")
    # one place only: the mean of the q - 1 = 1 points before and behind in order
    assert sorted(round(r.fit, 9) for r in SR.loess(same, "x", "y").collect()) == [3.0, 4.0, 5.0]


def test_deploy_timeline_fixture(spark):
    rows = [("build", "compile", 0.0, 30.0, "s1", None), ("build", "lint", 10.0, 25.0, "s2", None),
            ("test", "unit", 30.0, 60.0, "s3", "s1"), ("test", "e2e", 60.0, 90.0, "s4", "s1, s3,nope")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "ord long, lane string, task string, t0 double, t1 double, sid string, parent string")
    b = TM.bars(df, "lane", "task", "t0", "ord", end="t1", ident="sid", depends_on="parent")
    subs = {r.ord: r.sub for r in TM.sublanes(b).collect()}
    assert subs[0] != subs[1]
    assert {r.lane: r.lane_index for r in TM.lane_order(b).collect()} == {"build": 0, "test": 1}
    edges = sorted((r.from_id, r.to_id) for r in TM.dependency_edges(b).collect())
    assert edges == [("s1", "s3"), ("s1", "s4"), ("s3", "s4")]
    assert TM.parse_markers(["12|go", "|x", " 40 "]) == [("12", "go"), ("40", None)]
    m = {r.value for r in TM.markers(b, ["12|go", "500|far", "40"], numeric=True).collect()}
    assert m == {"12", "40"}


def test_end_before_start_and_bad_rows(spark):
    df = spark.createDataFrame([(0, "a", "x", 10.0, 5.0), (1, "a", "y", None, 3.0)], "ord long, l string, b string, s double, e double")
    r = TM.bars(df, "l", "b", "s", "ord", end="e").collect()
    assert [(x.ord, x.s, x.e) for x in r] == [(0, 10.0, 10.0)]


MESSAGES = [
    dict(seq=1, src="Web App", dst="API", label="GET /x", mtype="sync", grp=None, branch=None, src_type="actor"),
    dict(seq=2, src="API", dst="db", label="query\n  rows", mtype="weird", grp="alt:cache", branch="hit", src_type=None),
    dict(seq=3, src="db", dst="API", label="rows", mtype="reply", grp="alt:cache", branch=None, src_type="database"),
    dict(seq=4, src="API", dst="cache", label="fill", mtype="async", grp="alt:cache", branch="miss", src_type="boundary"),
    dict(seq=5, src="API", dst="", label="dropped", mtype="sync", grp=None, branch=None, src_type=None),
    dict(seq=6, src="API", dst="Web App", label="200", mtype="reply", grp="par:fanout", branch="a", src_type=None),
    dict(seq=7, src="API", dst="log", label="audit", mtype="lost", grp="par:fanout", branch="b", src_type=None),
    dict(seq=8, src="x!", dst="API", label="retry", mtype=None, grp="retry", branch=None, src_type="participant"),
]


def _document(spark, rows, **kw):
    df = spark.createDataFrame(rows, "seq long, src string, dst string, label string, grp string, branch string")
    msgs = SQ.messages(df, "src", "dst", "label", "seq", group="grp", branch="branch")
    return SQ.mermaid_documents(SQ.mermaid_lines(msgs, **kw)).collect()[0].document


def test_mermaid_alt_and_par_have_dividers(spark):
    rows = [(1, "A", "B", "ask", None, None), (2, "B", "A", "yes", "alt:answer", "good"), (3, "B", "A", "no", "alt:answer", "bad"),
            (4, "A", "B", "one", "par:both", "x"), (5, "A", "B", "two", "par:both", ""), (6, "A", "B", "three", "par:both", "y"), (7, "B", "A", "bye", None, None)]
    assert _document(spark, rows, autonumber=True) == """sequenceDiagram
  autonumber
  participant A
  participant B
  A->>B: ask
  alt answer
    B->>A: yes
  else bad
    B->>A: no
  end
  par both
    A->>B: one
    A->>B: two
  and y
    A->>B: three
  end
  B->>A: bye
"""


def test_mermaid_loop_opt_and_plain_groups_have_no_dividers(spark):
    for grp, head in (("loop:again", "loop again"), ("opt:maybe", "opt maybe"), ("odd thing", "loop odd thing")):
        rows = [(i, "A", "B", f"m{i}", grp, f"try{i}") for i in range(1, 4)]
        assert _document(spark, rows) == f"""sequenceDiagram
  participant A
  participant B
  {head}
    A->>B: m1
    A->>B: m2
    A->>B: m3
  end
"""


def test_mermaid_pages_join_to_the_document(spark):
    rows = [(i, "A", "B", f"m{i}", "alt:x" if i % 5 else None, f"b{i // 3}") for i in range(1, 40)]
    df = spark.createDataFrame(rows, "seq long, src string, dst string, label string, grp string, branch string")
    lines = SQ.mermaid_lines(SQ.messages(df, "src", "dst", "label", "seq", group="grp", branch="branch"))
    pages = SQ.mermaid_documents(lines, page_lines=7).orderBy("page").collect()
    assert [r.page for r in pages] == list(range(-(-lines.count() // 7))) and all(r.document.count("\n") <= 7 for r in pages)
    assert "".join(r.document for r in pages) == _document(spark, rows)
    assert SQ.mermaid_documents(lines.limit(0)).count() == 0


def test_scans_of_one_layout_equal_separate_scans(spark):
    rnd = random.Random(21)
    rows = [(i, None if i % 9 == 0 else 1 if i < 500 else rnd.randint(2, 9), rnd.choice([None, "a", "b"])) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k long, g string")
    def two(first):  # noqa: E306
        one = ordered_scan(first, ["k"], ["id"], lags=["g"], partitions=7).withColumn("same", F.col("g").eqNullSafe(F.col("prev_g")).cast("long"))
        return ordered_scan(one, ["k"], ["id"], sums=["same"], prior_max=["g"], partitions=7).select("id", "prev_g", "cum_same", "pmax_g")
    assert sorted(two(lay_out(df, ["k"], ["id"], 7)).collect()) == sorted(two(df).collect())


def test_frames_are_numbered_without_the_gaps(spark):
    rows = [(1, "A", "B", "m", None, None), (2, "A", "B", "m", "alt:x", "p"), (3, "A", "B", "m", None, None), (4, "A", "B", "m", "alt:x", "q")]
    df = spark.createDataFrame(rows, "seq long, src string, dst string, label string, grp string, branch string")
    got = SQ.frames(SQ.messages(df, "src", "dst", "label", "seq", group="grp", branch="branch")).collect()
    assert sorted((r.frame_no, r.first_ord) for r in got) == [(1, 2), (2, 4)]


def test_participants_and_frames(spark):
    df = spark.createDataFrame(MESSAGES, "seq long, src string, dst string, label string, mtype string, grp string, branch string, src_type string")
    msgs = SQ.messages(df, "src", "dst", "label", "seq", message_type="mtype", group="grp", branch="branch", from_type="src_type")
    parts = {r.name: (r.position, r.ptype) for r in SQ.participants(msgs).collect()}
    assert parts["Web App"] == (0, "actor") and parts["db"] == (2, "database")
    assert parts["API"] == (1, "boundary") and parts["cache"][1] is None   # a type belongs to its row's sender
    fr = sorted((r.kind, r.label, r.compartments) for r in SQ.frames(msgs).collect())
    assert fr == [("alt", "cache", 2), ("group", "retry", 1), ("par", "fanout", 2)]
    nums = [r.number for r in SQ.numbered(msgs).orderBy("ord").collect()]
    assert nums == list(range(1, 8))
