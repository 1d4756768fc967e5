"""Shared primitives: the value census and bounded top-k per group.

Value census
    ``stack`` the wanted columns into long form ``(column, value, keep)`` and
    aggregate once: ``groupBy(column, value)`` with ``count`` and
    ``count_if(keep)``.  Distinct counts, top values and modal values of every
    column come out of that one shuffle; map-side partial aggregation absorbs a
    hot value (one value holding a third of all rows costs one row per task).

Top-k per group
    ``row_number`` partitioned by the group alone would put every distinct
    value of a high-cardinality column in one task.  We take the top k inside
    ``(group, hash-bucket)`` partitions first (Spark plans this with a partial
    ``WindowGroupLimit`` before the exchange), then the exact top k per group
    over at most ``buckets * k`` candidates.
"""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablescope.session import ensure_checkpoint_dir


def default_buckets(spark: SparkSession) -> int:
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        n = 200
    return max(1, min(n, 4096))


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank", tie_key: str | None = None, buckets: int | None = None) -> DataFrame:
    """Exact top-k rows per group with a bounded second stage.

    ``order`` must be a total order (include a unique tie-breaker) for the
    result to be deterministic; ``tie_key`` names the column hashed into
    buckets (the value column, typically).
    """
    spark = df.sparkSession
    b = buckets or default_buckets(spark)
    gcols = [F.col(c) for c in group_cols]
    if tie_key is not None and b > 1:
        salted = df.withColumn("__bucket", F.pmod(F.xxhash64(F.col(tie_key)), F.lit(b)))
        w1 = Window.partitionBy(*gcols, F.col("__bucket")).orderBy(*order)
        df = (salted.withColumn("__rn", F.row_number().over(w1))
              .where(F.col("__rn") <= k).drop("__rn", "__bucket"))
    w2 = Window.partitionBy(*gcols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def census(df: DataFrame, entries: Sequence[tuple[str, Column, Column | None, bool]]) -> DataFrame:
    """Long-form value census.

    ``entries``: ``(name, text_expr, keep_expr, is_list)``.  For a list column
    ``text_expr`` is an array of element texts; each row counts once per
    distinct element.  Returns ``(column, value, n, n_keep)`` over non-null
    values; ``n_keep`` counts rows where the keep flag is true.
    """
    if not entries:
        raise ValueError("census needs at least one column")
    arrays = []
    for name, text, keep, is_list in entries:
        kp = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
        if is_list:
            arrays.append(F.transform(F.coalesce(F.array_distinct(text), F.array().cast("array<string>")),
                                      _element_struct(name, kp)))
        else:
            arrays.append(F.array(F.struct(F.lit(name).alias("column_name"), text.alias("value"), kp.alias("keep"))))
    stacked = df.select(F.inline(reduce(F.concat, arrays) if len(arrays) > 1 else arrays[0]))
    return (stacked.where(F.col("value").isNotNull())
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("keep")).alias("n_keep")))


def _element_struct(name: str, keep: Column):
    def make(e: Column) -> Column:
        return F.struct(F.lit(name).alias("column_name"), e.alias("value"), keep.alias("keep"))
    return make


#: leading characters of a text that take part in the order of equally frequent digests
LEAD = 32
#: so many candidate digests (under 100 bytes each) are broadcast to fetch their texts; more meet them in a join
CANDIDATE_ROWS = 100_000


def heavy_values(df: DataFrame, entries: Sequence[tuple[str, Column]], k: int) -> DataFrame:
    """(column_name, value, cnt, rank): the ``k`` most frequent texts of each column, ties by text,
    without a shuffle of whole texts.

    ``entries``: ``(name, text_expr)``.  Values are counted by their length, a 128-bit digest and their first
    ``LEAD`` characters.  The digests that can be among the first ``k`` (all that tie with the last
    of them in count and leading characters) get their texts in a second pass over the table.
    """
    ids = ["column_name", "size", "h1", "h2"]

    def stacked(with_text: bool) -> DataFrame:
        structs = [F.struct(F.lit(name).alias("column_name"), F.length(t).alias("size"), F.xxhash64(t).alias("h1"),
                            F.xxhash64(F.lit("second"), t).alias("h2"), (t if with_text else F.substring(t, 1, LEAD)).alias("text"))
                   for name, t in entries]
        return df.select(F.inline(F.array(*structs))).where(F.col("size").isNotNull())

    counts = stacked(False).groupBy(*ids, F.col("text").alias("lead")).agg(F.count(F.lit(1)).alias("cnt"))
    order = [F.col("cnt").desc(), F.col("lead").asc()]
    b = default_buckets(df.sparkSession)
    inside = Window.partitionBy("column_name", F.pmod("h1", F.lit(b))).orderBy(*order)
    first = counts.withColumn("place", F.rank().over(inside)).where(F.col("place") <= k)
    near = checkpoint(first.withColumn("place", F.rank().over(Window.partitionBy("column_name").orderBy(*order)))
                      .where(F.col("place") <= k).select(*ids, "cnt"))
    wanted = F.broadcast(near) if near.count() <= CANDIDATE_ROWS else near
    texts = stacked(True).join(wanted, ids).groupBy(*ids, "cnt").agg(F.any_value("text").alias("value"))
    return top_k_per_group(texts, ["column_name"], [F.col("cnt").desc(), F.col("value").asc()], k, tie_key="value").select("column_name", "value", "cnt", "rank")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
