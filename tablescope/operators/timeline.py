"""Timeline (Gantt) tile data (2.H12-H16) and incident narratives.

* bars: end, or start + duration; end < start -> end = start; rows whose start
  or end cannot be read are dropped; numeric (relative seconds) or timestamp
  axis (epoch milliseconds); lanes in first-appearance order;
* sublanes: per lane, in start order, the lowest-index sublane whose last end
  <= start, else a new one.  Exact and parallel: a lane splits into *islands*
  where the running max end of earlier bars <= start (every sublane is free
  there, so packing restarts at 0); islands come from the skew-safe ordered
  scan.  An island is cut into ranges of ``RANGE_BARS`` bars in start order.  One
  job packs the first ranges of all islands side by side, the next one their
  second ranges, and so on; over a border go only the bars still open there,
  as (end, sublane), in a written table.  No task holds more than a range and
  the open bars in front of it, however long an island is;
* dependency edges: ``depends_on`` split on commas, trimmed, joined to ids
  (unmatched ids dropped; for a repeated id the last bar wins);
* event markers: ``VALUE`` or ``VALUE|label``, kept if inside the axis domain;
* incident narrative: time order per incident, date shown on the first row and
  whenever it changes.
"""
from __future__ import annotations

import heapq
from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.filters import col
from tablescope.operators.ordered import ordered_scan, value_ranks
from tablescope.session import scratch_path
from tablescope.types import is_numeric, is_temporal

_NUMERIC_TEXT = r"^\s*[+]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?\s*$"


def _epoch_ms(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c) / F.lit(1000.0)
    if isinstance(dt, T.DateType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                c.cast("timestamp_ntz")) / F.lit(1000.0)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c) / F.lit(1000.0)
    # text timestamps: parsed as timestamp_ntz
    return _epoch_ms(F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz"), T.TimestampNTZType())


def numeric_axis(df: DataFrame, start: str) -> bool:
    """Numeric (relative seconds) axis if the start column is numeric, or text
    whose every value reads as a plain number (no '-', ':' or 'T')."""
    dt = df.schema[start].dataType
    if is_numeric(dt):
        return True
    if is_temporal(dt):
        return False
    bad = df.where(col(start).isNotNull() & (F.trim(col(start).cast("string")) != "")
                   & ~col(start).cast("string").rlike(_NUMERIC_TEXT)).limit(1).count()
    return bad == 0


def bars(df: DataFrame, lane: str, label: str, start: str, order: str, end: str | None = None,
         duration: str | None = None, ident: str | None = None, depends_on: str | None = None,
         color: str | None = None) -> DataFrame:
    """(ord, lane, label, s, e, id, deps, category) -- s/e in axis units."""
    if (end is None) == (duration is None):
        raise ValueError("a timeline takes either end or duration")
    numeric = numeric_axis(df, start)
    sdt = df.schema[start].dataType

    def t(c: str) -> Column:
        if numeric:
            return col(c).cast("string").try_cast("double") if not is_numeric(df.schema[c].dataType) else col(c).cast("double")
        return _epoch_ms(col(c), df.schema[c].dataType)
    s = t(start)
    if end is not None:
        if is_temporal(sdt) != is_temporal(df.schema[end].dataType):
            raise ValueError("start and end must both be numeric or both be timestamps")
        e = t(end)
    else:
        if is_temporal(df.schema[duration].dataType):
            raise ValueError("duration must be numeric seconds, not a timestamp")
        d = col(duration).cast("double")
        e = s + (d if numeric else d * 1000.0)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    out = df.select(col(order).alias("ord"),
                    F.coalesce(col(lane).cast("string"), F.lit("")).alias("lane"),
                    F.coalesce(col(label).cast("string"), F.lit("")).alias("label"),
                    s.alias("s"), e.alias("e"),
                    (col(ident).cast("string") if ident else F.lit(None).cast("string")).alias("id"),
                    (col(depends_on).cast("string") if depends_on else F.lit(None).cast("string")).alias("deps"),
                    (col(color).cast("string") if color else F.lit(None).cast("string")).alias("category"))
    out = out.where(finite(F.col("s")) & finite(F.col("e")))
    return out.withColumn("e", F.greatest(F.col("e"), F.col("s")))


def lane_order(b: DataFrame) -> DataFrame:
    """(lane, lane_index): lanes by first appearance (smallest row order), 0-based,
    ranked with distributed prefix sums (no single-partition window)."""
    first = (b.groupBy("lane").agg(F.min("ord").alias("first_ord"))
             .select(F.lit(0).alias("g"), "lane", "first_ord", F.lit(1).cast("long").alias("n")))
    r = value_ranks(first, ["g"], "first_ord")
    return r.select("lane", F.col("before").alias("lane_index"))


#: bars of one island that are packed by one task at a time
RANGE_BARS = 10_000


def _pack(bars: pd.DataFrame, carried: pd.DataFrame | None, more: bool) -> pd.DataFrame:
    """The sublanes of one range (kind 0) and, if ``more`` bars may follow, what goes on to the next range:
    the bars still open (kind 1) and the number of sublanes so far (kind 1 without an end)."""
    bars = bars.sort_values(["s", "ord"], kind="stable")
    active: list[tuple[float, int]] = []   # (end, sublane) of bars still open
    free: list[int] = []
    nxt = 0
    if carried is not None and len(carried):
        opened = carried[carried["e"].notna()]
        active = list(zip(opened["e"].tolist(), opened["sub"].tolist()))
        nxt = int(carried.loc[carried["e"].isna(), "sub"].iloc[0])
        free = sorted(set(range(nxt)) - {k for _, k in active})
        heapq.heapify(active)
    subs = []
    starts, ends = bars["s"].tolist(), bars["e"].tolist()
    for s, e in zip(starts, ends):
        while active and active[0][0] <= s:
            heapq.heappush(free, heapq.heappop(active)[1])
        if free:
            k = heapq.heappop(free)
        else:
            k, nxt = nxt, nxt + 1
        subs.append(k)
        heapq.heappush(active, (e, k))
    out = pd.DataFrame({"kind": 0, "ord": bars["ord"], "lane": bars["lane"], "island": bars["island"], "e": float("nan"), "sub": subs})
    if more and len(bars):
        still = [(e, k) for e, k in active if e > starts[-1]] + [(float("nan"), nxt)]
        out = pd.concat([out, pd.DataFrame({"kind": 1, "ord": None, "lane": bars["lane"].iloc[0], "island": bars["island"].iloc[0],
                                            "e": [e for e, _ in still], "sub": [k for _, k in still]})])
    return out


def _packers(range_bars: int, more: bool):
    """The functions of a step: on a range alone, and on a range with what was carried to it."""
    def later(bars: pd.DataFrame, carried: pd.DataFrame | None) -> pd.DataFrame:
        return _pack(bars, carried, more and len(bars) >= range_bars)

    def first(bars: pd.DataFrame) -> pd.DataFrame:
        return later(bars, None)

    return first, later


def sublanes(b: DataFrame, range_bars: int = RANGE_BARS) -> DataFrame:
    """(ord, lane, sub): greedy lowest-free-sublane packing per lane."""
    spark = b.sparkSession
    one = b.select("ord", "lane", "s", "e", F.lit(1).alias("one"))
    scanned = ordered_scan(one, ["lane"], ["s", "ord"], prior_max=["e"], sums=["one"])
    opens = F.col("pmax_e").isNull() | (F.col("pmax_e") <= F.col("s"))
    marked = (scanned.withColumn("isl_start", opens.cast("long"))
              .withColumn("first", F.when(opens, F.col("cum_one"))))
    isl = ordered_scan(marked, ["lane"], ["s", "ord"], sums=["isl_start"], prior_max=["first"])
    place = F.col("cum_one") - F.coalesce("first", "pmax_first")
    laid = isl.select("ord", "lane", "s", "e", F.col("cum_isl_start").alias("island"),
                      F.floor(place / F.lit(range_bars)).cast("int").alias("step"))
    base = scratch_path(spark, "sublanes")
    laid.repartition("step", "lane", "island").write.partitionBy("step").parquet(f"{base}/bars")
    ord_type = b.schema["ord"].dataType.simpleString()
    schema = f"kind int, ord {ord_type}, lane string, island long, e double, sub int"
    packed = spark.read.schema(schema + ", step int").parquet
    bars_in = spark.read.schema(f"ord {ord_type}, lane string, s double, e double, island long, step int").parquet(f"{base}/bars")
    last = bars_in.agg(F.max("step")).first()[0]
    if last is None:
        return b.select("ord", "lane", F.lit(0).alias("sub"))
    carried = None
    for step in range(last + 1):
        group = bars_in.where(F.col("step") == step).groupBy("lane", "island")
        first, later = _packers(range_bars, step < last)
        done = group.applyInPandas(first, schema) if carried is None else \
            group.cogroup(carried.groupBy("lane", "island")).applyInPandas(later, schema)
        done.write.parquet(f"{base}/packed/step={step}")
        carried = packed(f"{base}/packed").where((F.col("step") == step) & (F.col("kind") == 1))
    return packed(f"{base}/packed").where("kind = 0").select("ord", "lane", "sub")


def dependency_edges(b: DataFrame) -> DataFrame:
    """(from_id, to_id, from_ord, to_ord): one edge per listed parent that exists."""
    ids = (b.where(F.col("id").isNotNull()).groupBy("id")
           .agg(F.max_by("ord", "ord").alias("from_ord")))           # last bar with an id wins
    wanted = (b.where(F.col("deps").isNotNull())
              .select("ord", "id", F.explode(F.split("deps", ",")).alias("p"))
              .select(F.col("ord").alias("to_ord"), F.col("id").alias("to_id"), F.trim("p").alias("from_id"))
              .where(F.col("from_id") != ""))
    return wanted.join(ids.withColumnRenamed("id", "from_id"), "from_id").select("from_id", "to_id", "from_ord", "to_ord")


def parse_markers(raw: Sequence[str]) -> list[tuple[str, str | None]]:
    """``VALUE`` or ``VALUE|label`` split at the first pipe; empty values dropped."""
    out = []
    for s in raw:
        v, lbl = (s.split("|", 1) + [None])[:2] if "|" in s else (s, None)
        v = v.strip()
        lbl = lbl.strip() if lbl is not None else None
        if v:
            out.append((v, lbl or None))
    return out


def markers(b: DataFrame, raw: Sequence[str], numeric: bool) -> DataFrame:
    """(value, label, frac) of markers inside the axis domain (frac in [-0.001, 1.001])."""
    spark = b.sparkSession
    dom = b.agg(F.min("s").alias("t0"), F.max("e").alias("t1")).collect()[0]
    rows = parse_markers(raw)
    m = spark.createDataFrame(rows, "value string, label string")
    if dom["t0"] is None:
        return m.select("value", "label", F.lit(None).cast("double").alias("frac")).limit(0)
    t0 = dom["t0"]
    t1 = dom["t1"] if dom["t1"] > t0 else t0 + 1
    t = F.col("value").try_cast("double") if numeric else _epoch_ms(F.try_to_timestamp("value").cast("timestamp_ntz"), T.TimestampNTZType())
    frac = (t - F.lit(t0)) / F.lit(t1 - t0)
    return m.select("value", "label", frac.alias("frac")).where(F.col("frac").between(-0.001, 1.001))


def incident(df: DataFrame, key: str | None, ts: str, order: str) -> DataFrame:
    """(key, ord, ts, day, show_date): date shown on the first row of an
    incident and wherever the day changes (skew-safe lag)."""
    base = df.select((col(key) if key else F.lit(0)).alias("key"), col(order).alias("ord"), col(ts).alias("ts"),
                     F.to_date(col(ts)).alias("day"))
    sc = ordered_scan(base, ["key"], ["ts", "ord"], lags=["day"])
    return sc.select("key", "ord", "ts", "day", (F.col("prev_day").isNull() | (F.col("prev_day") != F.col("day"))).alias("show_date"))
