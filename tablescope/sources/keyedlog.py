"""Keyed tables kept as an append-only log of commits.

A commit is a folder written by Spark's committer; its success mark makes it visible, so a
write that broke off is never read.  A commit holds the rows of its own keys only: its size
follows the change and not the table.  Readers see all commits and fold them (``rows`` has the
commit's name as column ``commit``; names ascend with time).

``compact`` publishes the folded rows as a base, with the names of the commits it stands for, and
drops the folders that the base before it stood for; readers that began before keep theirs.

Two ways to write:

* ``commit(number, rows)``: one writer that numbers its commits (a stream's batch id).  A number stands
  for the same rows for good: committed again, also after a compaction, it changes nothing.
* ``append(rows)``: any number of writers.  A commit that a compaction overtook is not lost: it is not among
  the names of the base.  Of two at the same moment the greater name counts as the later one.
"""
from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "commit"


class KeyedLog:
    """A log of commits under ``path``, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = [f.name for f in given.fields]
        self.schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in given.fields], T.StructField(COMMIT, T.StringType())])

    # ---- folders

    def _folder(self, kind: str, name: str) -> str:
        return f"{self.path}/{kind}={name}"

    def _fs(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _published(self, kind: str) -> list[str]:
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
        return sorted(p.getName()[len(kind) + 1:] for p in found if fs.exists(mark(p, "_SUCCESS")))

    def _drop(self, kind: str, name: str) -> None:
        fs, path = self._fs(self._folder(kind, name))
        fs.delete(path, True)

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the names of the commits it stands for."""
        bases = self._published("base")
        if not bases:
            return None, set()
        rows = self.spark.read.schema("name string").parquet(self._folder("names", bases[-1])).collect()   # folders, not rows
        return bases[-1], {r.name for r in rows}

    # ---- writing

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.columns, F.lit(name).alias(COMMIT)).write.mode("overwrite").parquet(self._folder("commit", name))

    def commit(self, number: int, rows: DataFrame) -> bool:
        """Commit ``rows`` under a number of the only writer; False if that number is committed already."""
        name = f"{number:012d}"
        _, folded = self._base()
        if name in self._published("commit") or name <= max(folded, default=""):
            return False
        self._write(name, rows)
        return True

    def append(self, rows: DataFrame) -> str:
        """Commit ``rows`` behind everything that is committed now; returns the commit's name."""
        _, folded = self._base()
        last = max([*self._published("commit"), *folded], default="0")
        name = f"{int(last.split('-')[0]) + 1:012d}-{uuid.uuid4().hex[:12]}"
        self._write(name, rows)
        return name

    # ---- reading

    def _folders(self) -> tuple[str | None, list[str]]:
        base, folded = self._base()
        return base, [n for n in self._published("commit") if n not in folded]

    def rows(self) -> DataFrame:
        """The rows of the newest base and of all commits it does not stand for."""
        base, fresh = self._folders()
        folders = ([self._folder("base", base)] if base else []) + [self._folder("commit", n) for n in fresh]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def compact(self, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Publish ``fold(rows())`` (columns of ``rows``) as the new base; without new commits nothing happens."""
        base, folded = self._base()
        there = self._published("commit")
        fresh = [n for n in there if n not in folded]
        if not fresh:
            return
        number = int(base.split("-")[0]) + 1 if base else 1
        name = f"{number:012d}-{uuid.uuid4().hex[:12]}"
        folders = ([self._folder("base", base)] if base else []) + [self._folder("commit", n) for n in fresh]
        # the greatest name stays known when its folder is gone
        names = sorted({*there, max([*folded, *there])})
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(self._folder("names", name))
        kept = fold(self.spark.read.schema(self.schema).parquet(*folders)).select(*self.columns, COMMIT)
        kept.write.parquet(self._folder("base", name))
        for old in folded & set(there):
            self._drop("commit", old)
        for old in self._published("base"):
            if base and old < base:
                self._drop("base", old)
                self._drop("names", old)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key (null is a key too) the row of the latest commit; of several in one commit the greatest."""
    rest = [c for c in rows.columns if c not in (*keys, COMMIT)]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(COMMIT, *rest)).alias("newest"))
    return newest.select(*keys, *[F.col("newest")[c].alias(c) for c in (*rest, COMMIT)])
