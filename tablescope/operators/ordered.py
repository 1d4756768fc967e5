"""Skew-safe ordered scans: lag, running sum, running max and ranks per key.

``Window.partitionBy(key).orderBy(t)`` moves every row of a key into one task;
a key holding a third of the table would make that task hold a third of the
data.  One plan serves every size instead:

1. ``repartitionByRange(P, *keys, *order)`` samples the sort key, so a hot key
   is spread over several ranges; a reliable ``checkpoint`` fixes that layout,
   and every row carries the number of its range;
2. one aggregate per (range, key) takes what the scan has reached at its end:
   the last values, the sums and the maxima;
3. a window over those few rows (at most P per key) accumulates them: what a
   key brings into each of its later ranges;
4. these carried rows are put in front of the rows of their (range, key), and
   plain windows over (range, key) finish the scan.  A group is never larger
   than a range.

Keys and values may be NULL (NULL keys are one group, as in SQL); integers stay
exact.  The results equal the window functions over the whole key.

Scans:
* ``lags``: ``prev_<c>`` = value of ``c`` on the previous row of the same key;
* ``sums``: ``cum_<c>`` = running sum of ``c`` up to and including the row
  (NULLs count as 0; long for integers, else double);
* ``prior_max``: ``pmax_<c>`` = max of ``c`` over strictly earlier rows of the key;
* ``totals``: ``tot_<c>`` = sum of ``c`` over the whole key.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.census import checkpoint, default_buckets


#: columns of a layout: one group of all rows, and the range of the row
LAYOUT = ["__all", "__range"]


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The rows in ranges of (key, order), fixed by a checkpoint, with the ``LAYOUT`` columns.  Scans of it, and
    scans of their results, along the same keys and order need no further layout."""
    p = partitions or default_buckets(df.sparkSession)
    sort_cols = [F.col(f"`{c}`").asc_nulls_first() for c in (*keys, *order)]
    # a key column that is stored, so that no keys at all means one group and not one task
    return checkpoint(df.withColumn("__all", F.lit(0)).repartitionByRange(p, *sort_cols)
                      .withColumn("__range", F.spark_partition_id()))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: Sequence[str] = (),
                 sums: Sequence[str] = (), prior_max: Sequence[str] = (), totals: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """See module docstring.  ``order`` must make rows unique within a key for a
    deterministic result (add a row-order column).  Rows of ``lay_out`` are scanned
    in their ranges and keep the ``LAYOUT`` columns; others are laid out first."""
    types = {f.name: f.dataType for f in df.schema.fields}
    kept = set(LAYOUT) <= set(df.columns)
    laid = df if kept else lay_out(df, keys, order, partitions)
    columns = [c for c in laid.columns if c not in LAYOUT]
    group = [F.col(f"`{c}`") for c in (keys or ["__all"])]
    names = list(keys or ["__all"])

    lag_in = [F.col(f"`{c}`").alias(f"__lag_{c}") for c in lags]
    added = lambda c: F.col(f"`{c}`").cast(T.LongType() if isinstance(types[c], T.IntegralType) else T.DoubleType())
    sum_in = [added(c).alias(f"__sum_{c}") for c in sums]
    tot_in = [added(c).alias(f"__tot_{c}") for c in totals]
    max_in = [F.col(f"`{c}`").alias(f"__max_{c}") for c in prior_max]
    carried = [*(f"__lag_{c}" for c in lags), *(f"__sum_{c}" for c in sums), *(f"__max_{c}" for c in prior_max),
               *(f"__tot_{c}" for c in totals)]
    rows = laid.select("*", *lag_in, *sum_in, *max_in, *tot_in, F.lit(1).alias("__row"))

    last = F.max_by(F.struct(*[f"__lag_{c}" for c in lags]), F.struct(*[F.col(f"`{c}`") for c in order])).alias("last") if lags else None
    ends = rows.groupBy("__range", *group).agg(
        *([last] if lags else []), *[F.sum(f"__sum_{c}").alias(f"__sum_{c}") for c in sums],
        *[F.max(f"__max_{c}").alias(f"__max_{c}") for c in prior_max], *[F.sum(f"__tot_{c}").alias(f"__tot_{c}") for c in totals])
    whole = Window.partitionBy(*group)
    across = Window.partitionBy(*group).orderBy("__range")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        "__range", *group, F.lag("__range").over(across).alias("from"),
        *([F.lag("last").over(across).alias("last")] if lags else []),
        *[F.sum(f"__sum_{c}").over(earlier).alias(f"__sum_{c}") for c in sums],
        *[F.max(f"__max_{c}").over(earlier).alias(f"__max_{c}") for c in prior_max],
        *[F.sum(f"__tot_{c}").over(whole).alias(f"__tot_{c}") for c in totals])
    if not totals:   # nothing comes into a key's first range
        carry = carry.where(F.col("from").isNotNull())
    carry = carry.select("__range", *group, *[F.col("last")[f"__lag_{c}"].alias(f"__lag_{c}") for c in lags],
                         *carried[len(lags):],
                         F.lit(0).alias("__row"))

    inside = Window.partitionBy("__range", *group).orderBy("__row", *[F.col(f"`{c}`").asc_nulls_first() for c in order])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    both = rows.select("__range", "__row", *dict.fromkeys(["__all", *names, *columns]), *carried).unionByName(carry, allowMissingColumns=True)
    out = both.select(
        "__row", *(LAYOUT if kept else []), *[F.col(f"`{c}`") for c in columns],
        *[F.lag(f"__lag_{c}").over(inside).alias(f"prev_{c}") for c in lags],
        *[F.coalesce(F.sum(f"__sum_{c}").over(upto), F.lit(0)).alias(f"cum_{c}") for c in sums],
        *[F.max(f"__max_{c}").over(before).alias(f"pmax_{c}") for c in prior_max],
        *[F.first(f"__tot_{c}").over(upto).alias(f"tot_{c}") for c in totals])   # the carried row comes first
    return out.where("__row = 1").drop("__row")


def value_ranks(counts: DataFrame, key_cols: Sequence[str], value_col: str, n_col: str = "n",
                partitions: int | None = None) -> DataFrame:
    """Exact prefix sums of ``n`` ordered by ``value`` within each key.

    ``counts`` holds one row per ``(key..., value)`` with multiplicity ``n``.
    Adds ``before`` (rows with a smaller value in the same key) and ``tot`` (rows
    of the key); min rank = before + 1, average rank = before + (n + 1) / 2.
    """
    scanned = ordered_scan(counts, key_cols, [value_col], sums=[n_col], totals=[n_col], partitions=partitions)
    return (scanned.withColumn("before", F.col(f"cum_{n_col}") - F.col(n_col))
            .withColumnRenamed(f"tot_{n_col}", "tot").drop(f"cum_{n_col}"))


def order_quantiles(ranked: DataFrame, key: str, value_col: str, probs: Sequence[float]) -> DataFrame:
    """(key, p, q): ``quantile_cont`` of every key from the rows of ``value_ranks``.  A value knows from its
    rank whether it is one of the two order statistics of a quantile, so no target is joined."""
    hits = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("tot") - 1)
        for side, idx in (("lo", F.floor(pos)), ("hi", F.least(F.ceil(pos), F.col("tot") - 1))):
            hits.append(F.when((F.col("before") <= idx) & (idx < F.col("before") + F.col("n")), F.struct(
                F.lit(float(p)).alias("p"), F.lit(side).alias("side"), (pos - F.floor(pos)).alias("frac"), F.col(value_col).alias("v"))))
    met = ranked.select(key, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select(key, "h.*")
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("v")))
    return (met.groupBy(key, "p").agg(side("lo").alias("lo"), side("hi").alias("hi"), F.max("frac").alias("frac"))
            .select(key, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("q")))
