"""The toxicity models as tables, for vocabularies too large for the driver and a broadcast.

The same probabilities as ``toxicity.build_model`` gives, by joins of the three orders:
only the sums of an order (totals, kinds, expressions counted once and twice) come to the
driver.  Documents are scored in blocks: a block's distinct words meet the ratios of the
corpus's distinct words in a join (a word once a block, so none is hot), and the ratios come back to the
block, which sums them per document.

A word is resolved once for the whole corpus: by itself, else by its first six bytes,
else by its first four, else by the ratio of unseen words.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tablescope.llm import skew, toxicity
from tablescope.llm.blockcount import new_block
from tablescope.llm.textkernel import _quoted, chunks

CLASSES = ("t", "o")
LAWS = {"ratio": "estimated", "sure": "firm"}
BLOCK = 1 << 20


@dataclass
class RatioTables:
    """(word, six, ratio, sure), (six, ratio, sure), (four, ratio, sure) and both ratios of an unseen word."""
    word: DataFrame
    six: DataFrame
    four: DataFrame
    unseen: tuple[float, float]


def _rates(table: DataFrame) -> dict[tuple[str, str], tuple[float, float, float]]:
    """(discount, scale of a discounted count, mass of the coarser order) of each law and class; empty if a class has no counts."""
    of = lambda c: (F.sum(c), F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2),
                    F.sum(F.greatest(F.col(c) - toxicity.FIRM, F.lit(0))))
    sums = list(table.agg(*of("t"), *of("o")).first())
    out = {}
    for c, (total, kinds, once, twice, kept) in zip(CLASSES, (sums[:5], sums[5:])):
        if not total:
            return {}
        discount = once / (once + 2 * twice) if once and twice else 0.5
        out["estimated", c] = (discount, 1 / total, discount * kinds / total)
        out["firm", c] = (float(toxicity.FIRM), (1 - toxicity.FIRM_SHARE) / max(kept, 1), toxicity.FIRM_SHARE)
    return out


def _probabilities(rates: dict, coarser) -> list[Column]:
    """Columns (law_class) of one order; ``coarser(name)`` is what the next coarser order gives the expression."""
    out = []
    for (law, c), (discount, scale, mass) in rates.items():
        name = f"{law}_{c}"
        out.append((F.greatest(F.col(c) - F.lit(discount), F.lit(0.0)) * F.lit(scale) + F.lit(mass) * coarser(name)).alias(name))
    return out


def _ratios(masses: dict[str, float]) -> list[Column]:
    return [F.log(F.col(f"{law}_t") / F.col(f"{law}_o") * F.lit(masses[law])).cast("float").alias(name) for name, law in LAWS.items()]


def ratio_tables(counted: DataFrame, toxic: str, ordinary: str) -> RatioTables | None:
    """From distinct words (word, six) and their counts in both classes; None if a class has no counts."""
    words = counted.select("word", "six", F.col(toxic).alias("t"), F.col(ordinary).alias("o")).where("t > 0 OR o > 0")
    added = [F.sum(c).alias(c) for c in CLASSES]
    four = F.shiftright("six", 16).alias("four")
    sixes = skew.written(words.groupBy("six").agg(*added), "toxicity-sixes")
    fours = skew.written(sixes.groupBy(four).agg(*added), "toxicity-fours")
    by_order = [_rates(table) for table in (words, sixes, fours)]
    if not all(by_order):
        return None
    # the toxic share of the mass in front of a coarser order over the ordinary one
    steps = [{law: rates[law, "t"][2] / rates[law, "o"][2] for law in LAWS.values()} for rates in by_order]
    behind = [{law: float(np.prod([s[law] for s in steps[:k]])) for law in LAWS.values()} for k in range(4)]
    both, total = F.col("t") + F.col("o"), sum(1 / by_order[2]["estimated", c][1] for c in CLASSES)
    p4 = fours.select("four", both.alias("n4"), *_probabilities(by_order[2], lambda _: both / F.lit(total)))
    p6 = skew.written(sixes.withColumn("four", four).join(p4, "four").select(
        "six", both.alias("n6"), *_probabilities(by_order[1], lambda name: F.col(name) * both / F.col("n4"))), "toxicity-six-shares")
    pw = words.join(p6, "six").select("word", "six", *_probabilities(by_order[0], lambda name: F.col(name) * both / F.col("n6")))
    return RatioTables(skew.written(pw.select("word", "six", *_ratios(behind[0])), "toxicity-word-ratios"),
                       p6.select("six", *_ratios(behind[1])), p4.select("four", *_ratios(behind[2])),
                       tuple(float(np.log(behind[3][law])) for law in LAWS.values()))


def resolved(vocabulary: DataFrame, tables: RatioTables) -> DataFrame:
    """(word, six, ratio, sure) of the distinct words (word, six): the finest order that knows a word answers."""
    vocabulary = skew.written(vocabulary.distinct(), "toxicity-vocabulary")
    names = ["word", "six", *LAWS]
    known = vocabulary.join(tables.word, ["word", "six"]).select(*names)
    rest = skew.written(vocabulary.join(tables.word, ["word", "six"], "left_anti"), "toxicity-unknown")
    by_six = rest.join(tables.six, "six").select(*names)
    last = rest.join(tables.six, "six", "left_anti").withColumn("four", F.shiftright("six", 16)).join(tables.four, "four", "left")
    by_four = last.select("word", "six", *[F.coalesce(name, F.lit(u).cast("float")).alias(name) for name, u in zip(LAWS, tables.unseen)])
    return known.unionByName(by_six).unionByName(by_four)


def joined_features(docs: DataFrame, text: str, keep: list[str], tables: RatioTables) -> DataFrame:
    """Each document (kept columns in the struct ``row``) with ``toxicity.FEATURES``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    packed = docs.select(F.struct(*[docs[_quoted(c)] for c in keep]).alias("row"), F.coalesce(docs[_quoted(text)], F.lit("")).alias("text"))
    row = StructField("row", packed.schema["row"].dataType)   # null beside a block's words
    asked = StructType([row, StructField("block", LongType()), StructField("text", StringType()),
                        StructField("words", BinaryType()), StructField("sixes", BinaryType())])
    asked_schema = to_arrow_schema(asked)

    def ask(batches):
        for batch in batches:
            for block in chunks(batch.column(1), BLOCK):
                name, many = new_block(), block.rows
                cut = lambda k: batch.column(k).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([cut(0), pa.array([name] * many, pa.int64()), cut(1),
                                                  pa.nulls(many, pa.binary()), pa.nulls(many, pa.binary())], schema=asked_schema)
                _, word, six, _ = toxicity.expressions(block)
                word, first = np.unique(word, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, asked_schema.field(0).type), pa.array([name], pa.int64()), pa.nulls(1, pa.string()),
                                                  pa.array([word.tobytes()], pa.binary()), pa.array([six[first].tobytes()], pa.binary())], schema=asked_schema)

    def unfold(batches):
        for batch in batches:
            for block, words, sixes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                word, six = (np.frombuffer(c.as_buffer(), np.int64) for c in (words, sixes))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), block, np.int64)), pa.array(word), pa.array(six)], names=["block", "word", "six"])

    staged = skew.written(packed.mapInArrow(ask, asked), "toxicity-blocks")
    words = staged.where("words is not null").select("block", "words", "sixes").mapInArrow(unfold, "block long, word long, six long")
    answers = words.join(resolved(words.select("word", "six"), tables), ["word", "six"]).select("block", "word", *LAWS)
    out = StructType([row, *toxicity.FEATURES])
    out_schema = to_arrow_schema(out)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        known, pair = right.column("word").to_numpy().view(np.uint64), np.stack([right.column(name).to_numpy() for name in LAWS], 1)
        order = np.argsort(known)
        known, pair = known[order], pair[order]

        def ratios(word, six):
            return pair[np.searchsorted(known, word)]

        found = toxicity.feature_columns(left.column("text").combine_chunks(), ratios)
        return pa.table([left.column("row").combine_chunks(), *found], schema=out_schema)

    documents = staged.where("words is null").select("row", "block", "text")
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, out)
