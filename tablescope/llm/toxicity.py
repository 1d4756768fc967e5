"""Toxicity from class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled documents, are compared word by word.
An expression is a word, its first six bytes or its first four bytes.  Each order has
its absolutely discounted share of the class; exactly the discounted mass (discount *
kinds / total) goes to the next coarser order, and behind the four bytes to counts
shared by both classes.  The discount lies between 0 and 1 and is estimated for each
class and order as n1 / (n1 + 2 * n2), from the expressions counted once and twice.
Counts are Kneser-Ney continuation counts of word pairs: after how many different left
neighbours the class has the word.  So a copied or repeated passage counts once.  (Raw
counts of word pairs as a top order were tried and dropped: in a corpus with groups of
copies every pair of a copied document is frequent in one class, and held-out recall
fell from 1.00 to 0.62.)

Copied documents still force a second, firm model beside it: a near copy of a toxic
training document brings ordinary rare words that only the toxic class has, once each.
The firm model discounts ``FIRM`` contexts and gives both classes the same mass, so it
hears only what a class has in more contexts; it adds evidence and takes none away.

The class counts come from all labelled training documents: one shuffle of distinct
word pairs, summed into a written table keyed by the full 64-bit hash of the word and
its first six bytes themselves.  No two expressions share an entry, whatever the
corpus.  Up to ``BROADCAST_WORDS`` distinct words the models are made on the driver and broadcast, 16 bytes for
each distinct expression; beyond that they are tables, and documents meet them in joins
(``toxicwords``), so that nothing that grows with the vocabulary leaves the executors.  Both
ways give the same scores.  A document's features are its length-normalised log-likelihood ratio and the excess under
each model, the sum of what single expressions exceed ``MARGIN``, by itself and for its
length; a logistic function turns them into a score.  It is fitted on about
``CALIBRATION_ROWS`` (all if there are fewer) of the training rows in every
``LEFT_OUT``-th place of a hash, whose features come from models that have not counted
them: a row's own rare words would speak for its class.  If these rows lack a class, it
is fitted on all training rows with the models of all.

Training rows: labelled rows whose crc32(doc_id as text) mod 3 is not 1.  Labels,
language, source and id are no inputs of a score.

Defined results: null and wordless texts score like a text without evidence; without
training rows of both classes every score is 0; a null id is never a training row
and not held out; equal rows score alike; an empty table gives no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from tablescope.llm import skew
from tablescope.llm.labelled import with_label
from tablescope.llm.textkernel import ALNUM_WORDS, FOLD_ASCII, Block, annotate, chunks, mix64, scan_words
from tablescope.session import ship_package

MARGIN = 2.0
THRESHOLD = 0.7
CALIBRATION_ROWS = 20_000
#: discount of the firm model, and its mass for the coarser order
FIRM = 8
FIRM_SHARE = 0.2
#: distinct words of training rows whose models may go to the driver (48 bytes each) and to the workers; more are joined
BROADCAST_WORDS = 2_000_000
#: one of so many training rows is left out of the model that calibrates on it
LEFT_OUT = 4
#: bits of a word pair: toxic and ordinary training rows, then those left out
PARTS = TOXIC, ORDINARY, LEFT_TOXIC, LEFT_ORDINARY = 1, 2, 4, 8


def expressions(block: Block):
    """(row, word hash, first six bytes, hash of the left word): a prefix is its folded bytes, the first one highest."""
    words = scan_words(block, ALNUM_WORDS)
    six = np.zeros(len(words.start), np.uint64)
    for k in range(6):
        at = words.start + k
        byte = FOLD_ASCII[block.data[np.minimum(at, max(len(block.data) - 1, 0))]].astype(np.uint64) if len(at) else six
        six = (six << np.uint64(8)) | np.where(at < words.end, byte, np.uint64(0))
    left = np.zeros(len(six), np.uint64)
    if len(six):
        left[1:] = np.where(words.row[1:] == words.row[:-1], words.hash[:-1], 0)
    return words.row, words.hash, six, left


def first_four(six: np.ndarray) -> np.ndarray:
    return six >> np.uint64(16)


def context_hash(left: np.ndarray) -> np.ndarray:
    return (mix64(left) >> np.uint64(33)).astype(np.int32)


def _pairs(batches):
    """Distinct (word, left context) of each block and who has it: a bit for each of ``PARTS``."""
    schema = pa.schema([("word", pa.int64()), ("six", pa.int64()), ("context", pa.int32()), ("who", pa.int32())])
    for batch in batches:
        part = np.where(batch.column(1).to_numpy(zero_copy_only=False) == 1, 0, 1) + 2 * batch.column(2).to_numpy(zero_copy_only=False)
        for block in chunks(batch.column(0)):
            row, word, six, left = expressions(block)
            if not len(word):
                continue
            context, who = context_hash(left), (1 << part[block.first + row]).astype(np.int32)
            order = np.argsort(mix64(word ^ (context.astype(np.uint64) << np.uint64(32))))
            word, six, context, who = word[order], six[order], context[order], who[order]
            opens = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(word[opens].view(np.int64)), pa.array(six[opens].view(np.int64)), pa.array(context[opens]),
                                              pa.array(np.bitwise_or.reduceat(who, opens))], schema=schema)


@dataclass
class Model:
    """Log-likelihood ratios by exact key: for each order ascending keys and their ratios (expressions x 2,
    under the estimated discounts and under ``FIRM``).

    A prefix has the ratio of the words behind it that no training row has: the share of
    such a word within its prefix is the same in both classes.
    """
    word: tuple[np.ndarray, np.ndarray]
    six: tuple[np.ndarray, np.ndarray]
    four: tuple[np.ndarray, np.ndarray]
    unseen: np.ndarray

    def ratios(self, word: np.ndarray, six: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios (words x 2), from the finest order that knows the word."""
        out, left = np.repeat(self.unseen[None], len(word), axis=0), np.arange(len(word))
        for (keys, ratio), key in ((self.word, word), (self.six, six), (self.four, first_four(six))):
            if not len(keys) or not len(left):
                continue
            distinct, back = np.unique(key[left], return_inverse=True)
            at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
            known = (keys[at] == distinct)[back]
            out[left[known]] = ratio[at[back[known]]]
            left = left[~known]
        return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """n1 / (n1 + 2 * n2) of each class (2 x expressions); a half where none is counted once or none twice."""
    once, twice = (counts == 1).sum(axis=1), (counts == 2).sum(axis=1)
    return np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)


def probabilities(counts: np.ndarray, coarser: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities (2 x expressions) of one order and the discounted mass of each class.
    ``coarser`` is what the next coarser order gives the expressions."""
    discount, total = discounts(counts)[:, None], counts.sum(axis=1, keepdims=True)
    mass = discount * (counts > 0).sum(axis=1, keepdims=True) / total
    return np.maximum(counts - discount, 0) / total + mass * coarser, mass


def firm_probabilities(counts: np.ndarray, coarser: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of the firm model: only counts above ``FIRM``, and one fixed mass for both classes."""
    kept = np.maximum(counts - FIRM, 0)
    return (1 - FIRM_SHARE) * kept / np.maximum(kept.sum(axis=1, keepdims=True), 1) + FIRM_SHARE * coarser, np.full((2, 1), FIRM_SHARE)


def build_model(word: np.ndarray, six: np.ndarray, counts: np.ndarray) -> Model:
    """From distinct words (hash, first six bytes) and their toxic and ordinary counts (2 x words)."""
    seen = counts.any(axis=0)
    word, six, counts = word[seen], six[seen], counts[:, seen]
    if not counts.sum(axis=1).all():
        none = (np.zeros(0, np.uint64), np.zeros((0, 2), np.float32))
        return Model(none, none, none, np.zeros(2, np.float32))

    def summed(key, counts):
        keys, back = np.unique(key, return_inverse=True)
        return keys, back, np.stack([np.bincount(back, c, len(keys)) for c in counts])

    six_keys, six_of, six_counts = summed(six, counts)
    four_keys, four_of, four_counts = summed(first_four(six_keys), six_counts)
    share = lambda c, coarser: c.sum(axis=0) / coarser.sum(axis=0)
    ratio = lambda p: np.log(p[0] / p[1]).astype(np.float32)
    columns = []
    for law in (probabilities, firm_probabilities):
        by_four, rest_four = law(four_counts, four_counts.sum(axis=0) / four_counts.sum())
        by_six, rest_six = law(six_counts, by_four[:, four_of] * share(six_counts, four_counts[:, four_of]))
        by_word, rest_word = law(counts, by_six[:, six_of] * share(counts, six_counts[:, six_of]))
        columns.append([ratio(by_word), ratio(rest_word * by_six), ratio(rest_word * rest_six * by_four), ratio(rest_word * rest_six * rest_four)])
    by_word, by_six, by_four, unseen = (np.stack(c, 1) for c in zip(*columns))
    order = np.argsort(word)
    return Model((word[order], by_word[order]), (six_keys, by_six), (four_keys, by_four), unseen[0])


def feature_columns(column: pa.Array, ratios) -> list[pa.Array]:
    """``FEATURES`` of each text; ``ratios(word, six)`` gives the ratios of words (words x 2)."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for block in chunks(column):
        row, word, six, _ = expressions(block)
        r, sure = ratios(word, six).T
        n = np.bincount(row, minlength=block.rows)
        for part, one in zip(parts, (n, np.bincount(row, weights=r, minlength=block.rows) / np.maximum(n, 1),
                                     np.bincount(row, weights=np.maximum(r - MARGIN, 0), minlength=block.rows),
                                     np.bincount(row, weights=np.maximum(sure - MARGIN, 0), minlength=block.rows))):
            part.append(one)
    return [pa.array(np.concatenate(p) if p else np.zeros(0), kind) for p, kind in zip(parts, (pa.int64(), *[pa.float64()] * 3))]


FEATURES = [StructField("n_words", LongType()), StructField("mean_ratio", DoubleType()), StructField("excess", DoubleType()),
            StructField("firm_excess", DoubleType())]


def _inputs(n, mean, excess, firm):
    by_length = lambda x: np.log1p(100 * x / np.maximum(n, 20))
    return np.stack([np.ones(len(n)), mean, np.log1p(excess), by_length(excess), np.log1p(firm), by_length(firm)], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic function."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def _broadcast_models(counted: DataFrame, classes: list[tuple[str, str]]) -> list:
    """For each pair of count columns the function (docs, text, keep) that gives features; the models are broadcast."""
    table = counted.toArrow()
    word, six = (table[c].to_numpy().view(np.uint64) for c in ("word", "six"))

    def scorer(names):
        shared = counted.sparkSession.sparkContext.broadcast(build_model(word, six, np.stack([table[c].to_numpy() for c in names])))
        return lambda docs, text, keep: annotate(docs, text, keep, FEATURES, lambda: lambda column: feature_columns(column, shared.value.ratios))
    return [scorer(names) for names in classes]


def _joined_models(counted: DataFrame, classes: list[tuple[str, str]]) -> list:
    """The same with models that stay tables."""
    from tablescope.llm import toxicwords   # built on this module

    def scorer(names):
        tables = toxicwords.ratio_tables(counted, *names)
        if tables is None:   # a class has no counts: no word has evidence
            return _broadcast_models(counted.limit(0), [names])[0]
        return lambda docs, text, keep: toxicwords.joined_features(docs, text, keep, tables)
    return [scorer(names) for names in classes]


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
                   keep: list[str] | None = None, threshold: float = THRESHOLD,
                   calibration_rows: int = CALIBRATION_ROWS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Each document (kept columns in the struct ``row``) with ``n_words``, ``held_out``, ``score`` and ``predicted``."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = docs.columns if keep is None else keep
    train = with_label(docs.where(training_rows(docs[doc_id])).select(docs[doc_id].alias("doc_id"), docs[text].alias("text")),
                       labels.select(labels[doc_id].alias("doc_id"), labels[label].alias("label")), F.col("label"), how="inner")
    left_out = F.coalesce(F.pmod(F.xxhash64(F.lit("left out"), "doc_id"), F.lit(LEFT_OUT)) == 0, F.lit(False))
    pairs = (train.select("text", "label", left_out.alias("left")).mapInArrow(_pairs, "word long, six long, context int, who int")
             .groupBy("word", "six", "context").agg(F.bit_or("who").alias("who")))
    had = lambda bits, name: F.count_if(F.col("who").bitwiseAND(bits) != 0).alias(name)
    counted = skew.written(pairs.groupBy("word", "six").agg(
        had(TOXIC | LEFT_TOXIC, "toxic"), had(ORDINARY | LEFT_ORDINARY, "ordinary"),
        had(TOXIC, "other_toxic"), had(ORDINARY, "other_ordinary")), "toxicity-words")
    scorers = _broadcast_models if counted.count() <= broadcast_words else _joined_models
    model, others = scorers(counted, [("toxic", "ordinary"), ("other_toxic", "other_ordinary")])

    def calibration(rows, known_to):
        # rows by a hash of their id, so many that about calibration_rows are taken whatever the corpus
        share = min(1.0, calibration_rows / max(1, rows.select("label").count()))
        sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        seen = known_to(sample.select("text", "label"), "text", ["label"]) \
            .select(F.col("row.label").alias("label"), *(f.name for f in FEATURES)).toPandas()
        y = (seen["label"].to_numpy() == 1).astype(float)
        if not 0 < y.sum() < len(y):
            return None
        return fit_logistic(_inputs(*(seen[f.name].to_numpy() for f in FEATURES)), y)

    weights = calibration(train.where(left_out), others)
    if weights is None:
        weights = calibration(train, model)
    scored = model(docs, text, [*keep, *([doc_id] if doc_id not in keep else [])])
    if weights is None:
        score = F.lit(0.0)
    else:
        w = [float(v) for v in weights]
        by_length = lambda c: F.log1p(100 * F.col(c) / F.greatest(F.col("n_words"), F.lit(20)))
        z = (F.lit(w[0]) + F.lit(w[1]) * F.col("mean_ratio") + F.lit(w[2]) * F.log1p("excess") + F.lit(w[3]) * by_length("excess")
             + F.lit(w[4]) * F.log1p("firm_excess") + F.lit(w[5]) * by_length("firm_excess"))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    held = F.coalesce(F.crc32(F.col("row")[doc_id].cast("string")) % 3 == 1, F.lit(False))
    return (scored.withColumn("held_out", held).withColumn("score", score)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
