"""Display formats as native column expressions (2.J).

A ``Format`` (prefix, suffix, decimals, thousands grouping, time zone, epoch
unit, link template, link title) becomes one string ``Column``; templates are
parsed once on the driver into a ``concat`` of literals and column texts.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.text import plain_number_text, text_of

# Fixed values (same as the reference): currency symbols; any other code is
# shown as "<CODE> " in front.  A currency format also adds " <CODE>" behind,
# groups thousands and shows 2 decimals unless decimals are set.
CURRENCY_SYMBOLS = {"USD": "$", "AUD": "$", "CAD": "$", "NZD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥",
                    "INR": "₹"}
EPOCH_UNITS = ("s", "ms", "us")
EMPTY_LIST = "—"


@dataclass(frozen=True)
class Format:
    prefix: str | None = None
    suffix: str | None = None
    decimals: int | None = None
    group: bool = False
    tz: str | None = None          # "local", "utc" or an IANA name
    epoch: str | None = None       # s | ms | us
    link: str | None = None
    link_title: str | None = None
    extra: dict = field(default_factory=dict, compare=False)


def currency(code: str, decimals: int | None = None) -> Format:
    code = code.upper()
    sym = CURRENCY_SYMBOLS.get(code, f"{code} ")
    return Format(prefix=sym, suffix=f" {code}", group=True, decimals=2 if decimals is None else decimals)


def percent(decimals: int | None = None) -> Format:
    return Format(suffix="%", decimals=decimals)


def number_text(c: Column, decimals: int | None, group: bool) -> Column:
    """Fixed decimals (rounded on the exact binary value, half-even on exact
    ties -- ``format_number``'s DecimalFormat) and optional thousands
    separators; without decimals the plain number text."""
    x = c.cast("double")
    if decimals is None and not group:
        return plain_number_text(c)
    d = 6 if decimals is None else int(decimals)
    t = F.format_number(x, d)
    if decimals is None:
        t = F.regexp_replace(t, r"\.?0+$", "")
    return t if group else F.regexp_replace(t, ",", "")


def format_number_col(c: Column, fmt: Format) -> Column:
    body = number_text(c, fmt.decimals, fmt.group)
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.concat(F.lit(fmt.prefix or ""), body, F.lit(fmt.suffix or "")))


_EPOCH_NTZ = "1970-01-01 00:00:00"
_MICROS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def epoch_to_timestamp(c: Column, unit: str) -> Column:
    """J4  Numeric epoch -> naive (UTC wall clock) timestamp; only s, ms and us
    are accepted.  Pure arithmetic on timestamp_ntz: the session zone plays no
    part."""
    if unit not in EPOCH_UNITS:
        raise ValueError(f"epoch unit must be s, ms or us (got {unit!r})")
    micros = (c.cast("double") * _MICROS[unit]).cast("long") if unit == "s" else c.cast("long") * _MICROS[unit]
    return F.timestamp_add("MICROSECOND", micros, F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))


def epoch_micros(c: Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch of a timestamp; naive timestamps are UTC."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def tz_text(c: Column, dtype: T.DataType, tz: str, local_zone: str = "UTC",
            pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """J3  Wall-clock text in a zone.  Naive timestamps are UTC; ``local`` is
    the viewer's zone, passed in as ``local_zone``."""
    zone = {"utc": "UTC", "local": local_zone}.get(tz.lower(), tz)
    if isinstance(dtype, T.TimestampNTZType):
        instant_utc = c
    elif isinstance(dtype, T.TimestampType):
        instant_utc = F.to_utc_timestamp(c, F.current_timezone())
    else:
        instant_utc = c.cast("timestamp_ntz")
    return F.date_format(F.from_utc_timestamp(instant_utc.cast("timestamp"), zone), pattern) \
        if not isinstance(dtype, T.TimestampNTZType) else \
        F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant_utc), pattern)


def url_component(c: Column) -> Column:
    """Percent-encode everything but the RFC 3986 unreserved set
    (A-Z a-z 0-9 - _ . ~), UTF-8; spaces as %20."""
    e = F.url_encode(c)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


_TOKEN = re.compile(r"\{([^{}:]+)(?::(raw|url))?\}")


def template(df_schema: T.StructType, tpl: str, value_col: str, encode_default: bool) -> Column:
    """J5  ``{value}`` / ``{column}`` with ``:raw`` / ``:url`` modifiers; a name
    matching no column stays literal text; NULL substitutes as ''."""
    names = set(df_schema.fieldNames())
    parts: list[Column] = []
    pos = 0
    for m in _TOKEN.finditer(tpl):
        parts.append(F.lit(tpl[pos:m.start()]))
        name, mod = m.group(1), m.group(2)
        target = value_col if name == "value" else name
        if target not in names:
            parts.append(F.lit(m.group(0)))
        else:
            t = F.coalesce(text_of(F.col(f"`{target}`"), df_schema[target].dataType), F.lit(""))
            enc = encode_default if mod is None else (mod == "url")
            parts.append(url_component(t) if enc else t)
        pos = m.end()
    parts.append(F.lit(tpl[pos:]))
    return F.concat(*parts)


def link(df: DataFrame, column: str, url: str, title: str | None = None) -> DataFrame:
    """(url, title) for a link column: URL substitutions encoded unless ``:raw``;
    title verbatim unless ``:url``; without a title the value's text is shown."""
    s = df.schema
    t = template(s, title, column, False) if title is not None else \
        F.coalesce(text_of(F.col(f"`{column}`"), s[column].dataType), F.lit(""))
    return df.select("*", template(s, url, column, True).alias("link_url"), t.alias("link_title"))


def list_text(c: Column, element: T.DataType, suffix: str = "", sep: str = ", ") -> Column:
    """J6  Elements joined, the suffix once at the end; an empty list shows '—'."""
    body = F.array_join(F.transform(c, lambda x: text_of(x, element)), sep, "NULL")
    return F.when(c.isNull(), F.lit(None)).when(F.size(c) == 0, F.lit(EMPTY_LIST)).otherwise(
        F.concat(body, F.lit(suffix)))


def duration_text(seconds: Column) -> Column:
    """J8  ``45s``, ``2m 15s``, ``2m``, ``1h 05m``, negatives with a leading '-'."""
    s = F.round(seconds.cast("double"), 0).cast("long")
    neg = F.when(s < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(s)
    m, sec = F.floor(a / 60).cast("long"), F.pmod(a, F.lit(60))
    h, mm = F.floor(m / 60).cast("long"), F.pmod(m, F.lit(60))
    body = (F.when(a < 60, F.concat(a.cast("string"), F.lit("s")))
            .when(m < 60, F.when(sec != 0, F.concat(m.cast("string"), F.lit("m "), F.lpad(sec.cast("string"), 2, "0"), F.lit("s")))
                  .otherwise(F.concat(m.cast("string"), F.lit("m"))))
            .otherwise(F.concat(h.cast("string"), F.lit("h "), F.lpad(mm.cast("string"), 2, "0"), F.lit("m"))))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")), F.lit("—")).otherwise(F.concat(neg, body))


def slug(c: Column) -> Column:
    """J9  ASCII alphanumerics lowercased, every other run -> '-', trimmed of
    dashes; empty -> 'session'."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", "-")), r"^-+|-+$", "")
    return F.when(s == "", F.lit("session")).otherwise(s)


COMMENT_MARKER = "tablescope:"


def parse_comment(comment: Column) -> Column:
    """A format spec in a column comment: ``tablescope:{...}`` anywhere, or a
    bare ``{...}`` comment; anything else, also text that is no JSON, is no format (NULL)."""
    i = F.instr(comment, COMMENT_MARKER)
    marked = F.trim(F.substr(comment, i + F.lit(len(COMMENT_MARKER)), F.length(comment)))
    bare = F.trim(comment)
    spec = F.when(i > 0, marked).when(bare.startswith("{"), bare)
    usable = ~F.coalesce(spec, F.lit("")).isin("", "{}") & F.try_parse_json(spec).isNotNull()
    return F.when(usable, spec)


def resolve_formats(comments: DataFrame, registry: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """J7  Effective format per (db, table, column).  Column comments give
    table-scoped formats, registry entries override them; a table-scoped entry
    (comment or registry) beats a bare ``column`` registry entry.  The latest
    registry write per key wins (upsert) and an empty spec deletes.

    ``comments``: (db, table, column, spec); ``registry``: (db, table, column,
    spec, seq) with ``table`` NULL for a bare-column entry; ``columns``: (db, table, column)
    of all relations, so that a bare entry reaches columns without a comment too."""
    latest = (registry.groupBy("db", "table", "column").agg(F.max_by("spec", "seq").alias("spec"))
              .where(F.col("spec").isNotNull() & (F.col("spec") != "")))
    scoped = latest.where(F.col("table").isNotNull()).withColumn("prio", F.lit(3))
    bare = latest.where(F.col("table").isNull()).drop("table")
    targets = comments.select("db", "table", "column")
    if columns is not None:
        targets = targets.unionByName(columns.select("db", "table", "column"))
    targets = targets.distinct()
    bare_hits = targets.join(bare, ["db", "column"]).withColumn("prio", F.lit(1))
    com = comments.withColumn("spec", parse_comment(F.col("spec"))).where(F.col("spec").isNotNull()).withColumn("prio", F.lit(2))
    allc = com.unionByName(bare_hits.select("db", "table", "column", "spec", "prio")).unionByName(
        scoped.select("db", "table", "column", "spec", "prio"))
    return allc.groupBy("db", "table", "column").agg(F.max_by("spec", "prio").alias("spec"))
