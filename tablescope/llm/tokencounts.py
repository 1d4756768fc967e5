"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches.  A batch holds, by source, language and
tokenizer version, the signed sums of its events: an insert adds a document and its
tokens, a delete subtracts them, a revision subtracts the old count and adds the new one
under the same or another tokenizer version.  Totals are the sums over all committed
batches, so batches may come in any order.

A commit is idempotent: a batch is written to the folder of its id by Spark's
committer, whose success mark makes it visible.  A batch whose mark is there is not
written again, whatever is offered under its id; a batch that broke off has no mark, is
ignored by readers and overwritten by the next try.  Folder names hold the ids in hex, so
any text is an id of its own (no id is taken for a path pattern).

``compact`` publishes, in the same folder, the sums of all committed batches together with
the ids they stand for.  The ids are written first, the sums' success mark makes both
visible at once: after a crash readers still see the batches themselves, and replays of
summed batches are refused before and after.

Defined results: events with a null source or language form groups of their own; null
token counts count 0 tokens; an event with an unknown kind is an error; repeated events
inside one batch all count (a batch is a set of facts, deduplicate before); a group
whose sums are all zero is left out of the totals; without batches there are no totals.
"""
from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm.skew import shared_path, written
from tablescope.session import ship_package

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"


def revision_of(before: DataFrame, after: DataFrame) -> DataFrame:
    """The events of a revision: the old counts deleted, the new ones inserted."""
    return before.withColumn("kind", F.lit("delete")).unionByName(after.withColumn("kind", F.lit("insert")))


class Rollup:
    """Additive totals of token counts in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "token-rollup")

    def _entry(self, batch: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(self._folder(batch))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _folder(self, batch: str, kind: str = "batch") -> str:
        return f"{self.path}/{kind}={batch.encode('utf-8', 'surrogatepass').hex()}"

    def _published(self, kind: str) -> list[str]:
        """Ids of the folders of a kind that have their success mark."""
        fs, where = self._entry("x")
        root, path = where.getParent(), self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
        return sorted(bytes.fromhex(p.getName()[len(kind) + 1:]).decode("utf-8", "surrogatepass") for p in found if fs.exists(path(p, "_SUCCESS")))

    def _summed(self) -> tuple[list[str], set[str]]:
        """Published compactions that no later one stands for, and the ids of everything they stand for."""
        sums, covers = self._published("sums"), {}
        for name in sums:
            covers[name] = {(r.kind, r.id) for r in self.spark.read.schema("kind string, id string").parquet(self._folder(name, "ids")).collect()}
        under = set().union(*covers.values()) if covers else set()
        return [n for n in sums if ("sums", n) not in under], {i for kind, i in under if kind == "batch"}

    def is_committed(self, batch: str) -> bool:
        return batch in self.committed()

    def committed(self) -> list[str]:
        """Ids of all committed batches, also of those that a compaction stands for."""
        return sorted(set(self._published("batch")) | self._summed()[1])

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Add ``events`` (source, lang, tokenizer, kind, tokens) as one batch; False if it was there already.

        ``kind`` is ``insert`` or ``delete``.
        """
        if not batch:
            raise ValueError(f"not a batch id: {batch!r}")
        if self.is_committed(batch):
            return False
        sign = (F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1)
                .otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null"))))))
        sums = events.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("documents"),
                                         F.sum(sign * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        sums.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        """documents and tokens by source, language and tokenizer over all committed batches."""
        tops, under = self._summed()
        folders = [self._folder(n, "sums") for n in tops] + [self._folder(b) for b in self._published("batch") if b not in under]
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*folders)
        return (rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                .where("documents <> 0 or tokens <> 0"))

    def compact(self, name: str) -> "Rollup":
        """Publish today's totals as compaction ``name`` of this rollup; its batches are read no more.

        A compaction of a name that is published already is left as it is.
        """
        if name in self._published("sums"):
            return self
        ids = [("batch", b) for b in self.committed()] + [("sums", n) for n in self._summed()[0]]
        self.spark.createDataFrame(ids, "kind string, id string").coalesce(1).write.mode("overwrite").parquet(self._folder(name, "ids"))
        self.totals().write.mode("overwrite").parquet(self._folder(name, "sums"))
        return self


def bpe_counter(rank_path: str, pattern: str):
    """A function that makes a token counter from a public byte-level BPE rank file."""
    def make():
        import base64
        import tiktoken
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return make


_made: dict[str, object] = {}


def count_tokens(docs: DataFrame, make_encoder, columns: Iterable[str], key: str) -> DataFrame:
    """``docs`` with a column ``<name>_tokens`` for each text column: its number of tokens, null for null."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _made.get(key)
        if encode is None:
            encode = _made[key] = make_encoder()
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return docs.withColumns({f"{c}_tokens": count(docs[c]) for c in columns})


def tidy(text):
    """Blanks before line ends removed, runs of blanks made one: what the revision recounts."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+(\n|$)", "$1"), r"[ \t]{2,}", " ")


def count_ledger(docs: DataFrame, make_encoder, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, source, lang, text digest, tokens, and the tokens of the tidied text
    (counted only where tidying changes it).  Texts are read once and not shuffled."""
    after = tidy(docs[text])
    base = docs.select(docs[doc_id].alias("doc_id"), docs["source"].alias("source"), docs["lang"].alias("lang"),
                       F.unhex(F.md5(docs[text])).alias("digest"), docs[text].alias("first"),
                       F.when(after != docs[text], after).alias("second"))
    counted = count_tokens(base, make_encoder, ["first", "second"], key)
    return written(counted.select("doc_id", "source", "lang", "digest", F.col("first_tokens").alias("tokens"),
                                  F.col("second_tokens").alias("tidied_tokens")), "ledger")
