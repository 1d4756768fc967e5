"""2.H12-H16  Timeline bars, sublanes, dependency edges, markers, incidents.

Bars come from ``events``: lane = event type, start = ts, duration = value
minutes, id = event_id, depends_on = "<event_id - 1>,<event_id + 1000000>"
(the second parent never exists and must be dropped)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import timeline as TM
from tablescope.plans import load, register


def event_bars(spark, sf):
    ev = load(spark, sf, "events").withColumn("dur", F.col("value") * 60).withColumn(
        "deps", F.concat_ws(",", (F.col("event_id") - 1).cast("string"), (F.col("event_id") + 1000000).cast("string")))
    return TM.bars(ev, lane="event_type", label="event_id", start="ts", order="event_id", duration="dur",
                   ident="event_id", depends_on="deps")


EPOCH_MS = "(epoch_us(ts) / 1000.0)"


@register("tile_timeline", f"""
SELECT event_id AS ord, event_type AS lane, CAST(event_id AS VARCHAR) AS label,
       CAST({EPOCH_MS} AS DOUBLE) AS s, CAST({EPOCH_MS} AS DOUBLE) + greatest(value * 60 * 1000.0, 0) AS e,
       CAST(l.lane_index AS BIGINT) AS lane_index
FROM events JOIN (SELECT lane, row_number() OVER (ORDER BY first_ord) - 1 AS lane_index
                  FROM (SELECT event_type AS lane, min(event_id) AS first_ord FROM events GROUP BY 1)) l
  ON events.event_type = l.lane""")
def tile_timeline(spark, sf):
    b = event_bars(spark, sf)
    return b.join(TM.lane_order(b), "lane").select("ord", "lane", "label", "s", "e", "lane_index")


SUBLANES_SQL = f"""
WITH RECURSIVE b AS (
  SELECT event_type AS lane, event_id AS ord, {EPOCH_MS} AS s, {EPOCH_MS} + greatest(value * 60 * 1000.0, 0) AS e,
         row_number() OVER (PARTITION BY event_type ORDER BY {EPOCH_MS}, event_id) AS rn
  FROM events),
r AS (
  SELECT lane, rn, ord, 0 AS sub, [e] AS ends FROM b WHERE rn = 1
  UNION ALL
  SELECT b.lane, b.rn, b.ord,
         coalesce(list_position(list_transform(r.ends, lambda x: x <= b.s), true), len(r.ends) + 1) - 1,
         CASE WHEN list_position(list_transform(r.ends, lambda x: x <= b.s), true) IS NULL THEN list_append(r.ends, b.e)
              ELSE list_transform(r.ends, lambda x, i: CASE WHEN i = list_position(list_transform(r.ends, lambda y: y <= b.s), true)
                                                       THEN b.e ELSE x END) END
  FROM r JOIN b ON b.lane = r.lane AND b.rn = r.rn + 1)
SELECT ord, lane, CAST(sub AS INTEGER) AS sub FROM r"""


@register("timeline_sublanes", SUBLANES_SQL)
def timeline_sublanes(spark, sf):
    """Greedy lowest-free-sublane packing; the oracle walks each lane bar by bar
    with a recursive query carrying the sublane end times."""
    return TM.sublanes(event_bars(spark, sf))


@register("timeline_edges", """
SELECT trim(p) AS from_id, CAST(e.event_id AS VARCHAR) AS to_id, CAST(trim(p) AS BIGINT) AS from_ord, e.event_id AS to_ord
FROM (SELECT event_id, unnest(string_split(CAST(event_id - 1 AS VARCHAR) || ',' || CAST(event_id + 1000000 AS VARCHAR), ',')) AS p
      FROM events) e
JOIN events x ON CAST(x.event_id AS VARCHAR) = trim(p)""")
def timeline_edges(spark, sf):
    return TM.dependency_edges(event_bars(spark, sf))


MARKERS = ["2024-01-05|deploy", "2024-01-20 12:00:00|incident", " 2030-01-01 |future", "|no value",
           "2024-01-15"]


@register("timeline_markers", f"""
WITH d AS (SELECT min(CAST({EPOCH_MS} AS DOUBLE)) AS t0, max(CAST({EPOCH_MS} AS DOUBLE) + greatest(value * 60000.0, 0)) AS t1 FROM events),
m AS (SELECT * FROM (VALUES ('2024-01-05', 'deploy'), ('2024-01-20 12:00:00', 'incident'), ('2030-01-01', 'future'),
                            ('2024-01-15', NULL)) v(value, label))
SELECT value, label, round((epoch_us(CAST(value AS TIMESTAMP)) / 1000.0 - t0) / (t1 - t0), 9) AS frac
FROM m, d WHERE (epoch_us(CAST(value AS TIMESTAMP)) / 1000.0 - t0) / (t1 - t0) BETWEEN -0.001 AND 1.001""")
def timeline_markers(spark, sf):
    out = TM.markers(event_bars(spark, sf), MARKERS, numeric=False)
    return out.select("value", "label", F.round("frac", 9).alias("frac"))


@register("tile_incident", """
SELECT user_id AS key, event_id AS ord, ts, CAST(ts AS DATE) AS day,
       coalesce(lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> CAST(ts AS DATE), true) AS show_date
FROM events""")
def tile_incident(spark, sf):
    return TM.incident(load(spark, sf, "events"), "user_id", "ts", "event_id")
