"""Skew-proof building blocks shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablescope.session import ensure_checkpoint_dir

#: A key is hot when it holds more than this share of the left rows; so at most 200 keys are hot.
HOT_SHARE = 1 / 200
BLOOM_MAX_BITS = 1 << 27
BLOOM_SEEDS = (11, 12, 13)


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder: lineage ends here and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(df_or_spark, name: str) -> str:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder (columns are read as needed)."""
    path = shared_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(left: DataFrame, right: DataFrame, key: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique and whose rows are of fixed size.

    Keys with more than ``HOT_SHARE`` of the left rows meet a broadcast of their
    at most 1/HOT_SHARE right rows; all other keys meet in an ordinary join.
    ``left`` should be cheap to read twice (checkpointed or a projection of such).
    """
    counts = left.groupBy(key).count()
    if total is None:
        total = left.count()
    hot = [r[0] for r in counts.where(F.col("count") > max(100, int(total * HOT_SHARE))).where(F.col(key).isNotNull()).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (left.where(~is_hot).join(right.where(~is_hot), key, how)
            .unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)))


def maybe_in(keys: DataFrame, n: int):
    """A Bloom filter over the only column of ``keys`` (a long), of at most ``BLOOM_MAX_BITS`` bits.

    Returns a function from a long column to a boolean column: false means surely
    absent.  However many keys there are, its size is bounded; more keys only make
    it let more rows through.
    """
    bits = 1 << max(10, min(BLOOM_MAX_BITS, max(1, 16 * n)).bit_length() - 1)
    spark, name = keys.sparkSession, keys.columns[0]
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(name), F.lit(s)), F.lit(bits)) for s in BLOOM_SEEDS]))
    words = (keys.select(at.alias("at"))
             .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toPandas())
    table = np.zeros(bits >> 6, np.uint64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def probe(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for one in (a, b, c):
            at = one.to_numpy().astype(np.int64)
            out &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    def test(column: Column) -> Column:
        return probe(*[F.pmod(F.xxhash64(column, F.lit(s)), F.lit(bits)) for s in BLOOM_SEEDS])

    return test


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): every node (``node``) with the least node of its
    component (``part``).

    Each round moves every node to its least neighbour and contracts the graph.
    Nodes are digests, so their order is random and the graph shrinks by a constant
    factor a round.  Nodes without an edge to another one are left out.  Every frame is a
    written table, so that each join has two plain shuffles and Spark can split a skewed one.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mapping = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        if mapping is None:
            mapping = least.select(F.col("a").alias("node"), F.col("m").alias("part"))
        else:
            moved = mapping.withColumnRenamed("part", "a").join(least, "a", "left")
            mapping = written(moved.select("node", F.coalesce("m", "a").alias("part")), "parts")
        one = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("x"))
        ends = one.join(least, "a").select(F.col("x").alias("a"), F.col("m").alias("b"))
        edges = written(ends.where("a <> b").distinct(), "edges")
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("part"))
    return mapping
