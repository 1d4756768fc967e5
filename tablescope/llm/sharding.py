"""Sharding by jump consistent hashing.

The shard of a document is the jump hash of its id: no ring table, and when a shard is
appended only the rows that go into the new shard move.  The law is ``key``: id and
shard count decide, sizes are as even as hashing makes them.

Slots number the rows of a shard without gaps, and depend on the rows alone, not on how the
input is split.  Equal rows (id, size, checksum) are counted first and get consecutive
numbers, which are interchangeable.  Numbers are dealt in buckets: each shard is cut into
hash buckets of about ``BUCKET_ROWS`` rows, a bucket's distinct rows are ordered and take as many numbers as they
have copies, and a bucket starts where the counts of the earlier ones end.  A row
with very many copies is one row until its numbers are written, in chunks of ``CHUNK`` that
are spread over all tasks.  Only ids, sizes and checksums are shuffled, never texts.

Defined results: a null text has size 1 and a null checksum; a null id is a key of its
own (all null ids in one shard); equal rows get neighbouring slots,
every slot once; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope.llm.skew import cut, written
from tablescope.session import ship_package

SHARDS = 8
BUCKET_ROWS = 20_000
MIN_BUCKETS = 256
CHUNK = 10_000
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys onto 0..shards-1."""
    key, shard = keys.astype(np.uint64, copy=True), np.full(len(keys), -1, np.int64)
    live, jump = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        scale = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[live] = ((shard[live] + 1) * scale).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column of any type, by its text."""
    @F.pandas_udf("int")
    def jump(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy().view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null"))))


def assign_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
                  bucket_rows: int = BUCKET_ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard``."""
    ship_package(docs.sparkSession)
    slim = docs.select(docs[doc_id].alias("doc_id"), (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(docs[text].cast("binary")).alias("text_crc32"))
    same = ["doc_id", "size", "text_crc32"]
    distinct = slim.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    placed = written(distinct.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1)), "shards")
    buckets = max(MIN_BUCKETS, -(-placed.count() // (shards * bucket_rows)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(*same), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards x buckets fixed-size rows: one per BUCKET_ROWS documents
    starts = cut(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "bucket").orderBy(*same).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    first = (numbered.join(starts, ["shard", "bucket"])
             .select(*same, "shard", (F.col("start") + F.col("earlier")).cast("long").alias("slot"), "grown_shard", "n"))
    few = first.where(F.col("n") <= chunk)
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long")))
    many = (first.where(F.col("n") > chunk).select("*", cuts.alias("cut")).repartition(*same, "cut")
            .withColumn("slot", F.col("slot") + F.col("cut")).withColumn("n", F.least(F.col("n") - F.col("cut"), F.lit(chunk))).drop("cut"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return (few.unionByName(many).select("*", copies.alias("copy"))
            .select(*same, "shard", (F.col("slot") + F.col("copy")).alias("slot"), "grown_shard"))
