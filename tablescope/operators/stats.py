"""Per-column statistics (2.E), all scoped by search + filters.

Pass 1 (one aggregate, partial aggregation on every executor): row count and,
per column, non-null count; numeric min/max/avg; temporal min/max (for the
timeline granularity); estimated distinct counts only where asked for.

Then, each a single job over the filtered table:

* exact distinct through the value census;
* quartiles: exact order statistics (linear interpolation) from the
  distributed prefix sum;
* 12-bin histograms (all numeric columns in one ``groupBy(column, bin)``);
* top values of non-numeric, non-temporal columns (census top-k);
* timeline bins of temporal columns (one ``groupBy(column, bucket)``).
"""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.text import key_text, text_of
from tablescope.operators.census import census, heavy_values, top_k_per_group
from tablescope.operators.facets import granularity
from tablescope.operators.filters import Filter, apply_filters, col
from tablescope.operators.ordered import order_quantiles, value_ranks
from tablescope.types import is_nested, is_numeric, is_temporal

HIST_BINS = 12
TOP_VALUES = 12
QUARTILES = (0.25, 0.5, 0.75)


class Stats:
    def __init__(self, df: DataFrame, q: str | None = None, filters: Sequence[Filter] = (),
                 estimate: bool = False, bins: int = HIST_BINS, top: int = TOP_VALUES):
        """``estimate`` asks for estimated distinct counts; they are exact otherwise, at every size."""
        self.source = df
        self.df = apply_filters(df, q, filters)
        self.schema = df.schema
        self.estimate = estimate
        self.bins = bins
        self.top_n = top
        self.numeric = [f.name for f in self.schema.fields if is_numeric(f.dataType)]
        self.temporal = [f.name for f in self.schema.fields if is_temporal(f.dataType)]
        self.categorical = [f.name for f in self.schema.fields if f.name not in self.numeric and f.name not in self.temporal]
        self._p1 = None

    # ---- pass 1 ----
    def pass1(self) -> dict:
        if self._p1 is None:
            aggs = [F.count(F.lit(1)).alias("n")]
            for i, f in enumerate(self.schema.fields):
                c = col(f.name)
                aggs.append(F.count(c).alias(f"nn{i}"))
                if self.estimate:
                    aggs.append(F.approx_count_distinct(F.to_json(c) if is_nested(f.dataType) else c).alias(f"nd{i}"))
                if f.name in self.numeric:
                    aggs += [F.min(c).cast("double").alias(f"mn{i}"), F.max(c).cast("double").alias(f"mx{i}"),
                             F.avg(c).alias(f"av{i}")]
                elif f.name in self.temporal:
                    aggs += [F.datediff(F.to_date(F.max(c)), F.to_date(F.min(c))).alias(f"days{i}")]
            self._p1 = self.df.agg(*aggs).collect()[0].asDict()
        return self._p1

    def _idx(self, name: str) -> int:
        return self.schema.fieldNames().index(name)

    def counts(self) -> DataFrame:
        """(column, rows, non_null, nulls)."""
        p = self.pass1()
        rows = [(f.name, p["n"], p[f"nn{i}"], p["n"] - p[f"nn{i}"]) for i, f in enumerate(self.schema.fields)]
        return self.df.sparkSession.createDataFrame(rows, "column_name string, rows long, non_null long, nulls long")

    def numeric_summary(self) -> DataFrame:
        """(column, min, max, avg) for numeric columns."""
        p = self.pass1()
        rows = [(n, p[f"mn{self._idx(n)}"], p[f"mx{self._idx(n)}"], p[f"av{self._idx(n)}"]) for n in self.numeric]
        return self.df.sparkSession.createDataFrame(rows, "column_name string, min double, max double, avg double")

    def _census(self, names: Sequence[str], display: bool = True) -> DataFrame:
        """Value census; ``display=False`` uses the cheap equality text (for counts).
        Inside ``report`` one shared, persisted census serves every caller."""
        if getattr(self, "_shared", None) is not None:
            return self._shared.where(F.col("column_name").isin(list(names)))
        txt = text_of if display else key_text
        entries = [(n, txt(col(n), self.schema[n].dataType), None, False) for n in names]
        return census(self.df, entries)

    def distinct(self) -> DataFrame:
        """(column, distinct, exact): counted exactly unless estimates were asked for."""
        names = self.schema.fieldNames()
        spark = self.df.sparkSession
        if self.estimate:
            p = self.pass1()
            return spark.createDataFrame([(n, p[f"nd{i}"], False) for i, n in enumerate(names)],
                                         "column_name string, distinct long, exact boolean")
        found = self._census(names, display=False).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"))
        # columns that are all NULL have no census rows
        every = spark.createDataFrame([(n,) for n in names], "column_name string")
        return every.join(found, "column_name", "left").select(
            "column_name", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"), F.lit(True).alias("exact"))

    def quartiles(self) -> DataFrame:
        """(column, q1, median, q3), exact (linear interpolation), from ranks: one plan at every size."""
        if not self.numeric:
            return self.df.sparkSession.createDataFrame([], "column_name string, q1 double, median double, q3 double")
        eq = exact_quantiles(self.df, self.numeric, QUARTILES)
        pick = lambda p: F.max(F.when(F.col("p") == F.lit(p), F.col("value")))
        return eq.groupBy("column_name").agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))

    def histogram(self) -> DataFrame:
        """(column, bin, lo, hi, cnt): equal-width bins on [min, max], the max
        folds into the last bin, empty bins kept.  A degenerate range (min ==
        max) is one bin holding every non-null value."""
        p = self.pass1()
        spark = self.df.sparkSession
        grid, structs = [], []
        for n in self.numeric:
            i = self._idx(n)
            lo, hi = p[f"mn{i}"], p[f"mx{i}"]
            if lo is None or hi is None:
                continue
            if lo < hi:
                width = (hi - lo) / self.bins
                grid += [(n, b + 1, lo + width * b, lo + width * (b + 1)) for b in range(self.bins)]
                b_expr = F.least(F.lit(self.bins), F.greatest(
                    F.lit(1), (F.floor((col(n) - F.lit(lo)) / F.lit(width)) + 1).cast("int")))
            else:
                grid.append((n, 1, lo, hi))
                b_expr = F.lit(1)
            structs.append(F.struct(F.lit(n).alias("column_name"), F.when(col(n).isNotNull(), b_expr).alias("bin")))
        schema = "column_name string, bin int, lo double, hi double"
        if not structs:
            return spark.createDataFrame([], schema + ", cnt long")
        counts = (self.df.select(F.inline(F.array(*structs))).where(F.col("bin").isNotNull())
                  .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("cnt")))
        # the grid is (#numeric columns x bins) rows: a proven small bound
        return (F.broadcast(spark.createDataFrame(grid, schema)).join(counts, ["column_name", "bin"], "left")
                .select("column_name", "bin", "lo", "hi", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt")))

    def top(self) -> DataFrame:
        """(column, value, cnt, rank): most frequent texts of non-numeric,
        non-temporal columns (nested ones included, as JSON text)."""
        if not self.categorical:
            return self.df.sparkSession.createDataFrame([], "column_name string, value string, cnt long, rank int")
        cen = self._census(self.categorical).select("column_name", "value", F.col("n").alias("cnt"))
        return top_k_per_group(cen, ["column_name"], [F.col("cnt").desc(), F.col("value").asc()], self.top_n,
                               tie_key="value").select("column_name", "value", "cnt", "rank")

    def top_long(self) -> DataFrame:
        """The same as ``top`` for columns of long texts: counted by digest, so no text is shuffled but those of the result."""
        if not self.categorical:
            return self.df.sparkSession.createDataFrame([], "column_name string, value string, cnt long, rank int")
        return heavy_values(self.df, [(n, text_of(col(n), self.schema[n].dataType)) for n in self.categorical], self.top_n)

    def timeline(self) -> DataFrame:
        """(column, bucket, cnt) per auto-granularity bucket of temporal columns."""
        p = self.pass1()
        spark = self.df.sparkSession
        if not self.temporal:
            return spark.createDataFrame([], "column_name string, bucket string, cnt long")
        structs = []
        for n in self.temporal:
            g = granularity(p[f"days{self._idx(n)}"])
            structs.append(F.struct(F.lit(n).alias("column_name"), F.date_trunc(g, col(n).cast("timestamp_ntz")).alias("b")))
        return (self.df.select(F.inline(F.array(*structs))).where(F.col("b").isNotNull())
                .groupBy("column_name", "b").agg(F.count(F.lit(1)).alias("cnt"))
                .select("column_name", F.col("b").cast("string").alias("bucket"), "cnt"))


def report(st: "Stats") -> DataFrame:
    """One row per column, the reference's column-stat shape: counts, distinct,
    numeric summary and quartiles, plus bounded arrays of histogram bins (12),
    top values (12) and timeline bins.  One census serves both the distinct
    counts and the top values; the result (one row per column) is materialised
    so the shared census can be released."""
    spark = st.df.sparkSession
    entries = [(n, text_of(col(n), st.schema[n].dataType) if n in st.categorical else key_text(col(n), st.schema[n].dataType),
                None, False) for n in st.schema.fieldNames()]
    st._shared = census(st.df, entries).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        arr = lambda df, fields, order: (df.groupBy("column_name")
                                         .agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("a")))
        out = (st.counts().join(st.distinct().drop("exact"), "column_name", "left")
               .join(st.numeric_summary(), "column_name", "left").join(st.quartiles(), "column_name", "left"))
        h = arr(st.histogram(), ["lo", "hi", "cnt"], ["bin"]).withColumnRenamed("a", "histogram")
        t = arr(st.top(), ["value", "cnt"], ["rank"]).withColumnRenamed("a", "top")
        tl = arr(st.timeline(), ["cnt"], ["bucket"]).withColumnRenamed("a", "timeline")
        order = spark.createDataFrame([(n, i) for i, n in enumerate(st.schema.fieldNames())], "column_name string, ord int")
        full = (out.join(h, "column_name", "left").join(t, "column_name", "left").join(tl, "column_name", "left")
                .join(order, "column_name").orderBy("ord").drop("ord"))
        schema = full.schema
        rows = full.collect()          # one row per column, bounded arrays
    finally:
        st._shared.unpersist()
        st._shared = None
    return spark.createDataFrame(rows, schema)


#: size parameter of a quantile sketch
SKETCH_K = 400


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """The share of rows by which the rank of a sketched quantile may be off, with 99 % confidence (published
    bound of the KLL sketch)."""
    return 2.296 / k ** 0.9723


def sketch_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """(by..., column_name, p, value): estimated quantiles of numeric columns, for all rows or each group, from one
    mergeable KLL sketch per column and group: one pass, a few kB shuffled per task and column,
    no sort.  ``value`` is a value of the column whose rank is off by ``sketch_rank_error(k)`` at most
    with 99 % confidence.  NULL and NaN are no values; a column without values has no rows."""
    structs = [F.struct(F.lit(n).alias("column_name"), col(n).cast("double").alias("v")) for n in columns]
    rows = df.select(*[col(c) for c in by], F.inline(F.array(*structs))).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sketches = rows.groupBy(*by, "column_name").agg(F.kll_sketch_agg_double("v", k).alias("sketch"))
    each = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs]
    return sketches.select(*[col(c) for c in by], "column_name", F.inline(F.array(*each)))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact ``quantile_cont`` of many numeric columns without holding a
    column's values in one task: census of ``(column, value) -> n``, exact
    prefix sums, and the two neighbouring order statistics of every quantile.
    Returns (column_name, p, value)."""
    structs = [F.struct(F.lit(n).alias("column_name"), col(n).cast("double").alias("v")) for n in columns]
    counts = (df.select(F.inline(F.array(*structs))).where(F.col("v").isNotNull())
              .groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n")))
    return order_quantiles(value_ranks(counts, ["column_name"], "v"), "column_name", "v", probs).withColumnRenamed("q", "value")
