"""Faceted search with drill-sideways counts (2.D).

Each column's facet sees every filter *except its own*; the free-text search
applies throughout.  Instead of one query per column we build one boolean
flag per filtered column and derive ``keep_<col>`` (AND of the others), so

* range and time facets are conditional ``min/max`` in ONE aggregate pass;
* every values facet comes out of ONE value census (``groupBy(column, value)``
  with ``count_if(keep_col)``) -- the value universe is the whole table, so a
  value excluded by other columns' filters stays listed with count 0;
* time bins: one more pass, ``groupBy(column, date_trunc(gran))``.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.text import text_of
from tablescope.operators.census import census, top_k_per_group
from tablescope.operators.filters import Filter, build_clauses, col, normalize_contains, search_predicate
from tablescope.operators.ordered import ordered_scan
from tablescope.types import is_boolean, is_numeric, is_scalar_list, is_temporal, looks_like_id

TOP_VALUES = 12


def granularity(days: int | None) -> str:
    d = 0 if days is None else days
    if d <= 2:
        return "hour"
    if d <= 90:
        return "day"
    if d <= 1500:
        return "month"
    return "year"


@dataclass
class KeepFlags:
    """keep(column) = search AND the filters of every other column."""
    search: Column | None
    per_column: dict[str, Column]

    def keep(self, name: str) -> Column | None:
        parts = [c for n, c in self.per_column.items() if n != name]
        if self.search is not None:
            parts.append(self.search)
        return reduce(lambda a, b: a & b, parts) if parts else None


def keep_flags(schema: T.StructType, q: str | None, filters: Sequence[Filter]) -> KeepFlags:
    filters = normalize_contains(schema, filters)
    per: dict[str, Column] = {}
    for name in dict.fromkeys(f.column for f in filters):
        mine = [f for f in filters if f.column == name]
        cl = build_clauses(schema, None, mine)
        if cl:
            per[name] = reduce(lambda a, b: a & b, cl)
    return KeepFlags(search_predicate(schema, q), per)


def _with_flags(df: DataFrame, flags: KeepFlags) -> tuple[DataFrame, KeepFlags]:
    """The search and every column's filters as one boolean column each, so that a row's texts
    are searched once and not once for every facet."""
    prefix = "__keep"
    while any(c.startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    named = {f"{prefix}{i}": c for i, c in enumerate(flags.per_column.values())}
    held = {n: F.col(f"{prefix}{i}") for i, n in enumerate(flags.per_column)}
    search = None
    if flags.search is not None:
        named[prefix] = flags.search
        search = F.col(prefix)
    return (df.withColumns(named) if named else df), KeepFlags(search, held)


def _cond(keep: Column | None, c: Column) -> Column:
    return c if keep is None else F.when(keep, c)


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def facet_kinds(schema: T.StructType) -> dict[str, str]:
    """column -> 'time' | 'range' | 'values' (id-like numeric columns skipped)."""
    out = {}
    for f in schema.fields:
        if is_numeric(f.dataType) and looks_like_id(f.name):
            continue
        if is_temporal(f.dataType):
            out[f.name] = "time"
        elif is_numeric(f.dataType):
            out[f.name] = "range"
        else:
            out[f.name] = "values"
    return out


class Facets:
    """Lazy facet results for one (table, search, filters)."""

    def __init__(self, df: DataFrame, q: str | None = None, filters: Sequence[Filter] = (),
                 top: int = TOP_VALUES):
        self.schema = df.schema
        self.df, self.flags = _with_flags(df, keep_flags(self.schema, q, filters))
        self.kinds = facet_kinds(self.schema)
        self.top = top
        self._bounds = None
        self._census: dict = {}
        self._share = False

    # ---- range + time bounds: one aggregate pass ----
    def _bounds_frame(self) -> DataFrame:
        aggs = []
        for name, kind in self.kinds.items():
            c = col(name)
            k = self.flags.keep(name)
            if kind == "range":
                aggs += [F.min(_cond(k, c)).cast("double").alias(f"lo::{name}"),
                         F.max(_cond(k, c)).cast("double").alias(f"hi::{name}")]
            elif kind == "time":
                lo, hi = F.min(_cond(k, c)), F.max(_cond(k, c))
                aggs += [lo.cast("string").alias(f"lo::{name}"), hi.cast("string").alias(f"hi::{name}"),
                         F.datediff(F.to_date(hi), F.to_date(lo)).alias(f"days::{name}")]
            else:
                isn = c.isNull()
                aggs += [_count_if(isn if k is None else (isn & k)).alias(f"nulls::{name}"),
                         _count_if(isn).alias(f"anynull::{name}")]
        if not aggs:
            return None
        return self.df.agg(*aggs)

    def bounds(self) -> dict:
        if self._bounds is None:
            frame = self._bounds_frame()
            self._bounds = frame.collect()[0].asDict() if frame is not None else {}
        return self._bounds

    def ranges(self) -> DataFrame:
        """(column, min, max) for numeric non-id columns."""
        spark = self.df.sparkSession
        names = [n for n, k in self.kinds.items() if k == "range"]
        b = self.bounds()
        rows = [(n, b[f"lo::{n}"], b[f"hi::{n}"]) for n in names]
        return spark.createDataFrame(rows, "column_name string, min double, max double")

    def time_bounds(self) -> DataFrame:
        """(column, min, max, granularity) with min/max as text."""
        spark = self.df.sparkSession
        names = [n for n, k in self.kinds.items() if k == "time"]
        b = self.bounds()
        rows = [(n, b[f"lo::{n}"], b[f"hi::{n}"], granularity(b[f"days::{n}"])) for n in names]
        return spark.createDataFrame(rows, "column_name string, min string, max string, granularity string")

    def time_bins(self) -> DataFrame:
        """(column, bucket, cnt): counts per auto-granularity bucket."""
        names = [n for n, k in self.kinds.items() if k == "time"]
        if not names:
            return self.df.sparkSession.createDataFrame([], "column_name string, bucket string, cnt long")
        b = self.bounds()
        grans = {n: granularity(b[f"days::{n}"]) for n in names}
        parts = []
        for n in names:
            k = self.flags.keep(n)
            keep = col(n).isNotNull() if k is None else (col(n).isNotNull() & k)
            parts.append(F.struct(F.lit(n).alias("column_name"),
                                  F.date_trunc(grans[n], col(n).cast("timestamp_ntz")).alias("b"),
                                  keep.alias("keep")))
        stacked = self.df.select(F.inline(F.array(*parts))).where(F.coalesce(F.col("keep"), F.lit(False)))
        return (stacked.groupBy("column_name", "b").agg(F.count(F.lit(1)).alias("cnt"))
                .select("column_name", F.col("b").cast("string").alias("bucket"), "cnt"))

    # ---- values facets: one census ----
    def _value_columns(self, only: Sequence[str] | None = None) -> list[str]:
        names = [n for n, k in self.kinds.items() if k == "values"]
        return [n for n in names if only is None or n in only]

    def census(self, only: Sequence[str] | None = None) -> DataFrame:
        """Value census of the values-facet columns, built once per instance
        (persisted: values and totals both read it); call ``release()`` after."""
        key = tuple(self._value_columns(only))
        if not self._share:
            return self._build_census(only)
        if key not in self._census:
            self._census[key] = self._build_census(only).persist(StorageLevel.MEMORY_AND_DISK)
        return self._census[key]

    def release(self) -> None:
        for c in self._census.values():
            c.unpersist()
        self._census.clear()

    def _build_census(self, only: Sequence[str] | None = None) -> DataFrame:
        entries = []
        for n in self._value_columns(only):
            dt = self.schema[n].dataType
            if is_scalar_list(dt):
                et = dt.elementType
                entries.append((n, F.transform(col(n), _element_text(et)), self.flags.keep(n), True))
            else:
                entries.append((n, text_of(col(n), dt), self.flags.keep(n), False))
        return census(self.df, entries)

    def values(self, top: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
        """(column, value, cnt, rank): top values by filtered count desc, value asc."""
        k = top or self.top
        cen = self.census(only).select("column_name", "value", F.col("n_keep").alias("cnt"))
        return top_k_per_group(cen, ["column_name"], [F.col("cnt").desc(), F.col("value").asc()], k,
                               tie_key="value").select("column_name", "value", "cnt", "rank")

    def totals(self, only: Sequence[str] | None = None) -> DataFrame:
        """(column, total): distinct non-null values (elements for lists), unfiltered."""
        return self.census(only).groupBy("column_name").agg(F.count(F.lit(1)).alias("total"))

    def nulls(self, only: Sequence[str] | None = None) -> DataFrame:
        """(column_name, nulls, has_nulls, is_list, is_boolean): filtered NULL
        count and whether the column has NULLs at all (from the bounds pass)."""
        names = self._value_columns(only)
        spark = self.df.sparkSession
        b = self.bounds()
        rows = [(n, b[f"nulls::{n}"], b[f"anynull::{n}"] > 0, is_scalar_list(self.schema[n].dataType),
                 is_boolean(self.schema[n].dataType)) for n in names]
        return spark.createDataFrame(rows, "column_name string, nulls long, has_nulls boolean, is_list boolean, is_boolean boolean")

    def all(self) -> DataFrame:
        """Every facet in one long frame: (column, kind, label, cnt, lo, hi)."""
        spark = self.df.sparkSession
        schema = "column_name string, kind string, label string, cnt long, lo double, hi double"
        self._share = True   # values and totals read one persisted census
        parts = [spark.createDataFrame([], schema)]
        if any(k == "range" for k in self.kinds.values()):
            parts.append(self.ranges().select("column_name", F.lit("range").alias("kind"), F.lit(None).cast("string").alias("label"),
                                              F.lit(None).cast("long").alias("cnt"), F.col("min").alias("lo"), F.col("max").alias("hi")))
        if any(k == "time" for k in self.kinds.values()):
            tb = self.time_bounds()
            parts.append(tb.select("column_name", F.lit("time_min").alias("kind"), F.col("min").alias("label"),
                                   F.lit(None).cast("long").alias("cnt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
            parts.append(tb.select("column_name", F.lit("time_max").alias("kind"), F.col("max").alias("label"),
                                   F.lit(None).cast("long").alias("cnt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
            parts.append(self.time_bins().select("column_name", F.lit("time_bin").alias("kind"), F.col("bucket").alias("label"), "cnt",
                                                 F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
        if self._value_columns():
            parts.append(self.values().select("column_name", F.lit("value").alias("kind"), F.col("value").alias("label"), "cnt",
                                              F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
            parts.append(self.nulls().select("column_name", F.lit("nulls").alias("kind"), F.col("has_nulls").cast("string").alias("label"),
                                             F.col("nulls").alias("cnt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
            parts.append(self.totals().select("column_name", F.lit("total").alias("kind"), F.lit(None).cast("string").alias("label"),
                                              F.col("total").alias("cnt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
        try:
            # bounded result: (#columns x (top values + time bins + 3)) rows
            rows = reduce(DataFrame.unionByName, parts).collect()
        finally:
            self.release()
            self._share = False
        return spark.createDataFrame(rows, schema)


def _element_text(et):
    def make(x: Column) -> Column:
        return text_of(x, et)
    return make


def facets(df: DataFrame, q: str | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
    return Facets(df, q, filters).all()


def facet_values(df: DataFrame, column: str, q: str | None = None, filters: Sequence[Filter] = (),
                 limit: int | None = None) -> DataFrame:
    """All values of one column (show-all) in order, scoped by the other columns' filters;
    at most ``limit`` of them where one is given."""
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
    fc = Facets(df, q, filters)
    fc.kinds = {column: "values"}
    if limit is not None:
        return fc.values(top=limit, only=[column])
    every = fc.census([column]).select("column_name", "value", F.col("n_keep").alias("cnt"), (-F.col("n_keep")).alias("fewer"),
                                       F.lit(1).alias("one"))
    ranked = ordered_scan(every, ["column_name"], ["fewer", "value"], sums=["one"])
    return ranked.select("column_name", "value", "cnt", F.col("cum_one").cast("int").alias("rank"))

