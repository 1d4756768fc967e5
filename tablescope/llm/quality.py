"""Quality rules: plain document rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``2 ** BUCKET_BITS`` buckets.  Two multinomials
over the buckets are counted in one pass: of the trusted target (documents labelled
with quality 1) and of the raw corpus (all documents).  A document's ratio is the mean
over its n-grams of log(target / raw); it is kept if the rules hold and the ratio is
at least ``THRESHOLD``, a fixed number, so the same text gets the same verdict under
the same counts.  Every document counts and every document is judged.

The counts of a task are sparse sums of at most 65,536 buckets, the table on the
driver has that size too, whatever the corpus.

Rules: fewer than 50 words, or over half of the words in repeated 3-word windows,
fail.  Defined results: a null or wordless text has no words, fails the rules and is
not kept; without target documents the ratio is 0; equal rows are judged alike;
several labels of one id count as the greatest; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from tablescope.llm.labelled import with_label
from tablescope.llm.textkernel import (KEEP_CASE, SPACED_WORDS, Block, Words, annotate, chunks, mix64, scan_words, windows)
from tablescope.session import ship_package

BUCKET_BITS = 16
#: the target multinomial has a prior of this many n-grams a bucket, dealt out as in the raw corpus
PRIOR = 5.0
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all words and word pairs of a block."""
    pair, at = windows(words.hash, words.row, 2)
    shift = np.uint64(64 - BUCKET_BITS)
    return (np.concatenate([words.row, words.row[at]]),
            np.concatenate([mix64(words.hash) >> shift, pair >> shift]).astype(np.int64))


def _count(batches):
    schema = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])
    target, raw = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        trusted = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        for block in chunks(batch.column(0)):
            row, bucket = ngram_buckets(scan_words(block, SPACED_WORDS, KEEP_CASE))
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[trusted[block.first + row]], minlength=len(raw))
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(target[some]), pa.array(raw[some])], schema=schema)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(block: Block, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same row."""
    out = np.zeros(block.rows, np.int64)
    several = np.flatnonzero(_per_row(block.data == 10, block.offsets))
    for i in several.tolist():
        lines = block.data[block.offsets[i]:block.offsets[i + 1]].tobytes().split(b"\n")
        seen: set[bytes] = set()
        for line in lines:
            if line.strip(b" \t\n\r\x0b\x0c"):
                if line in seen:
                    out[i] += 1
                else:
                    seen.add(line)
    return out


def repeated_words(words: Words, rows: int) -> np.ndarray:
    """Words inside 3-word windows that the row has twice or more."""
    h, at = windows(words.hash, words.row, 3)
    if not len(h):
        return np.zeros(rows, np.int64)
    key = mix64(h ^ mix64(words.row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = np.r_[False, key[order][1:] == key[order][:-1]]
    twice = np.zeros(len(h), bool)
    twice[order] = same | np.r_[same[1:], False]
    inside = np.zeros(len(words.row), bool)
    for k in range(3):
        inside[at[twice] + k] = True
    return np.bincount(words.row[inside], minlength=rows)


def _judge(ratio: np.ndarray | None):
    def run(column: pa.Array) -> list[pa.Array]:
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for block in chunks(column):
            words = scan_words(block, SPACED_WORDS, KEEP_CASE)
            n = np.bincount(words.row, minlength=block.rows)
            row, bucket = ngram_buckets(words)
            ngrams = np.bincount(row, minlength=block.rows)
            total = np.bincount(row, weights=ratio[bucket], minlength=block.rows) if ratio is not None else np.zeros(block.rows)
            figures = (n, _per_row(_LEAD[block.data] & SPACED_WORDS[block.data], block.offsets), _per_row(_SYMBOL[block.data], block.offsets),
                       duplicate_lines(block, words), repeated_words(words, block.rows), total / np.maximum(ngrams, 1))
            for part, one in zip(parts, figures):
                part.append(one)
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return [pa.array(np.concatenate(p) if p else np.zeros(0), k) for p, k in zip(parts, kinds)]
    return run


FIELDS = [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [StructField("ratio", DoubleType())]


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
                  keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Each document (kept columns in the struct ``row``) with its figures, ``base_failed``, ``ratio`` and ``kept``."""
    spark = docs.sparkSession
    ship_package(spark)
    marked = with_label(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")),
                        labels.select(labels[doc_id].alias("doc_id"), labels[label].alias("label")), F.col("label"))
    counted = (marked.select("text", (F.col("label") == 1).cast(BooleanType()).alias("trusted"))
               .mapInArrow(_count, "bucket int, target long, raw long").groupBy("bucket")
               .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas())
    target, raw = np.zeros(1 << BUCKET_BITS), np.ones(1 << BUCKET_BITS)
    target[counted["bucket"].to_numpy()] = counted["target"].to_numpy()
    raw[counted["bucket"].to_numpy()] += counted["raw"].to_numpy()
    ratio = None
    if target.sum() > 0:
        raw /= raw.sum()
        target += PRIOR * len(raw) * raw
        ratio = np.log(target / target.sum()) - np.log(raw)
    shared = spark.sparkContext.broadcast(ratio)
    judged = annotate(docs, text, docs.columns if keep is None else keep, FIELDS, lambda: _judge(shared.value))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= threshold))
