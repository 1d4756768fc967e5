"""2.J  Display formats, slugs and near-name matches."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import formats as FM
from tablescope.operators.fuzzy import closest_match
from tablescope.plans import load, register
from tablescope.session import scratch_path
from tablescope.sources.format_registry import KEY, FormatRegistry


@register("fmt_number", """
SELECT o_orderkey, 'n=' || printf('%.2f', o_totalprice) || ' pts' AS plain, format('{:,.2f}', o_totalprice) AS grouped,
       printf('%.1f', o_totalprice / 1000) || '%' AS pct
FROM orders""")
def fmt_number(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey",
                    FM.format_number_col(F.col("o_totalprice"), FM.Format(prefix="n=", suffix=" pts", decimals=2)).alias("plain"),
                    FM.format_number_col(F.col("o_totalprice"), FM.Format(decimals=2, group=True)).alias("grouped"),
                    FM.format_number_col(F.col("o_totalprice") / 1000, FM.percent(1)).alias("pct"))


@register("fmt_currency", """
SELECT c_custkey, '$' || format('{:,.2f}', c_acctbal) || ' USD' AS usd, '€' || format('{:,.2f}', c_acctbal) || ' EUR' AS eur,
       'CHF ' || format('{:,.0f}', c_acctbal) || ' CHF' AS chf
FROM customer""")
def fmt_currency(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", FM.format_number_col(F.col("c_acctbal"), FM.currency("usd")).alias("usd"),
                    FM.format_number_col(F.col("c_acctbal"), FM.currency("EUR")).alias("eur"),
                    FM.format_number_col(F.col("c_acctbal"), FM.currency("CHF", decimals=0)).alias("chf"))


@register("fmt_tz", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc,
       strftime(timezone('Australia/Brisbane', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS brisbane,
       strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS new_york
FROM events""")
def fmt_tz(spark, sf):
    ev = load(spark, sf, "events")
    dt = ev.schema["ts"].dataType
    return ev.select("event_id", FM.tz_text(F.col("ts"), dt, "utc").alias("utc"),
                     FM.tz_text(F.col("ts"), dt, "Australia/Brisbane").alias("brisbane"),
                     FM.tz_text(F.col("ts"), dt, "local", local_zone="America/New_York").alias("new_york"))


@register("fmt_epoch", """
SELECT event_id, make_timestamp(epoch_us(ts)) AS from_us, epoch_ms(epoch_us(ts) // 1000) AS from_ms,
       make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS from_s
FROM events""")
def fmt_epoch(spark, sf):
    ev = load(spark, sf, "events")
    us = FM.epoch_micros(F.col("ts"), ev.schema["ts"].dataType)
    ev = ev.select("event_id", us.alias("us"), F.floor(us / 1000).alias("ms"), F.floor(us / 1000000).alias("s"))
    return ev.select("event_id", FM.epoch_to_timestamp(F.col("us"), "us").alias("from_us"),
                     FM.epoch_to_timestamp(F.col("ms"), "ms").alias("from_ms"),
                     FM.epoch_to_timestamp(F.col("s"), "s").alias("from_s"))


@register("fmt_link", """
SELECT page_id, url, 'https://archive.example.org/pages/' || url_encode(CAST(page_id AS VARCHAR)) || '?src=' || url_encode(url)
         || '&raw=' || url AS link_url,
       'page ' || CAST(page_id AS VARCHAR) || ' of ' || url_encode(url) || ' {missing}' AS link_title
FROM pages""")
def fmt_link(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "url")
    return FM.link(p, "page_id", "https://archive.example.org/pages/{value}?src={url}&raw={url:raw}",
                   "page {value} of {url:url} {missing}")


@register("fmt_list", """
SELECT p_partkey, CASE WHEN len(w) = 0 THEN '—' ELSE array_to_string(w, ' / ') || ' (words)' END AS words
FROM (SELECT p_partkey, CASE WHEN p_size > 48 THEN []::VARCHAR[] ELSE string_split(p_name, ' ') END AS w FROM part)""")
def fmt_list(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 48, F.array().cast("array<string>"))
                                       .otherwise(F.split("p_name", " ")).alias("w"))
    return p.select("p_partkey", FM.list_text(F.col("w"), T.StringType(), " (words)", " / ").alias("words"))


def _dur_sql(v: str) -> str:
    s = f"CAST(round({v}) AS BIGINT)"
    a = f"abs({s})"
    return f"""(CASE WHEN {s} < 0 THEN '-' ELSE '' END) || CASE
  WHEN {a} < 60 THEN CAST({a} AS VARCHAR) || 's'
  WHEN {a} // 60 < 60 THEN CASE WHEN {a} % 60 <> 0 THEN CAST({a} // 60 AS VARCHAR) || 'm ' || lpad(CAST({a} % 60 AS VARCHAR), 2, '0') || 's'
                               ELSE CAST({a} // 60 AS VARCHAR) || 'm' END
  ELSE CAST({a} // 3600 AS VARCHAR) || 'h ' || lpad(CAST(({a} // 60) % 60 AS VARCHAR), 2, '0') || 'm' END"""


@register("fmt_duration", f"""
SELECT event_id, {_dur_sql('value')} AS short, {_dur_sql('value * 60')} AS minutes, {_dur_sql('value * -97')} AS negative
FROM events""")
def fmt_duration(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id", FM.duration_text(F.col("value")).alias("short"),
                     FM.duration_text(F.col("value") * 60).alias("minutes"),
                     FM.duration_text(F.col("value") * -97).alias("negative"))


@register("fmt_resolve", """
SELECT db, "table", "column", spec FROM (
  SELECT p_brand AS db, 't' || CAST(p_partkey % 7 AS VARCHAR) AS "table", 'c' || CAST(p_partkey AS VARCHAR) AS "column",
         CASE WHEN p_partkey % 6 = 0 AND p_partkey % 12 <> 0 THEN '{"prefix":"s"}'
              WHEN p_partkey % 8 = 0 THEN '{"decimals":' || CAST(p_size AS VARCHAR) || '}'
              WHEN p_partkey % 4 = 1 THEN '{"suffix":"c"}'
              WHEN p_partkey % 5 = 0 THEN '{"suffix":"b"}' END AS spec
  FROM part) WHERE spec IS NOT NULL""")
def fmt_resolve(spark, sf):
    """Every part is a column of a relation; most have a comment (marked, bare, plain words or broken JSON),
    some a bare-column entry, some a table-scoped one, of which half is deleted again."""
    key = F.col("p_partkey")
    text = key.cast("string")
    p = load(spark, sf, "part").select("p_partkey", "p_size", F.col("p_brand").alias("db"), F.concat(F.lit("t"), (key % 7).cast("string")).alias("table"),
                                       F.concat(F.lit("c"), text).alias("column"))
    spec = (F.when(key % 8 == 0, F.concat(F.lit('Size. tablescope:{"decimals":'), F.col("p_size").cast("string"), F.lit("}")))
            .when(key % 4 == 1, '{"suffix":"c"}').when(key % 4 == 2, "plain words").otherwise('{"suffix":'))
    comments = p.where(key % 8 != 7).select("db", "table", "column", spec.alias("spec"))
    entry = lambda rows, table, spec, seq: rows.select("db", table.cast("string").alias("table"), "column", F.lit(spec).alias("spec"), F.lit(seq).alias("seq"))
    registry = (entry(p.where(key % 5 == 0), F.lit(None), '{"suffix":"b"}', 1)
                .unionByName(entry(p.where(key % 6 == 0), F.col("table"), '{"prefix":"s"}', 1))
                .unionByName(entry(p.where(key % 12 == 0), F.col("table"), "", 2)))
    return FM.resolve_formats(comments, registry, p)


@register("fmt_registry", """
SELECT db, "table", "column", spec FROM (
  SELECT p_brand AS db, CASE WHEN p_partkey % 2 = 0 THEN 't' || CAST(p_partkey % 7 AS VARCHAR) END AS "table", 'c' || CAST(p_partkey AS VARCHAR) AS "column",
         CASE WHEN p_partkey % 10 = 4 THEN '{"suffix":"back"}' WHEN p_partkey % 5 = 4 THEN NULL
              WHEN p_partkey % 3 = 0 THEN '{"decimals":' || CAST(p_size AS VARCHAR) || '}' ELSE '{"group":true}' END AS spec
  FROM part) WHERE spec IS NOT NULL""")
def fmt_registry(spark, sf):
    """Formats for all parts written, a third overwritten, a fifth removed, half of those set again; folded into a base in between."""
    key = F.col("p_partkey")
    p = load(spark, sf, "part").select("p_partkey", "p_size", F.col("p_brand").alias("db"),
                                       F.when(key % 2 == 0, F.concat(F.lit("t"), (key % 7).cast("string"))).alias("table"),
                                       F.concat(F.lit("c"), key.cast("string")).alias("column"))
    registry = FormatRegistry(spark, scratch_path(spark, "format-registry"))
    registry.write(p.withColumn("spec", F.lit('{"group":true}')))
    registry.write(p.where(key % 3 == 0).withColumn("spec", F.concat(F.lit('{"decimals":'), F.col("p_size").cast("string"), F.lit("}"))))
    registry.compact()
    registry.write(p.where(key % 5 == 4).withColumn("spec", F.lit(None).cast("string")))
    registry.write(p.where(key % 10 == 4).withColumn("spec", F.lit('{"suffix":"back"}')))
    return registry.entries().select(*KEY, "spec")


@register("slugify", """
SELECT doc_id, CASE WHEN s = '' THEN 'session' ELSE s END AS slug
FROM (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS s FROM documents)""")
def slugify(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", FM.slug(F.col("text")).alias("slug"))


@register("closest_match", """
WITH v AS (SELECT w, min(item_id * 100000 + pos) AS vorder FROM
             (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w,
                     generate_subscripts(regexp_split_to_array(lower(text), '[^a-z]+'), 1) AS pos FROM benchmark)
           WHERE w <> '' GROUP BY w),
q AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS query FROM part),
c AS (SELECT query, w, vorder, levenshtein(query, w) AS d FROM q, v WHERE query <> '' AND abs(length(query) - length(w)) <= 2)
SELECT query, arg_min(w, d * 1e12 + vorder) AS match, CAST(min(d) AS INTEGER) AS distance FROM c WHERE d <= 2 GROUP BY query""")
def closest_match_q(spark, sf):
    vocab = (load(spark, sf, "benchmark")
             .select("item_id", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("pos", "w"))
             .where(F.col("w") != "")
             .groupBy("w").agg(F.min(F.col("item_id") * 100000 + F.col("pos") + 1).alias("vorder")))
    queries = (load(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("query"))
               .where(F.col("query") != "").distinct())
    return closest_match(queries, "query", vocab, "w", "vorder", max_distance=2).select(
        "query", F.col("w").alias("match"), "distance")
