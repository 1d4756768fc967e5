"""Corpus-wide counts for blocks of documents, without a table of all keys anywhere.

Operators that need a corpus count for everything a document holds work in three steps:

1. A map writes, block after block, its documents (each with the positions of its keys in
   the block's key list) and one key row: the block's distinct keys, ordered by hash, with
   what the block adds to their counts.  A key stands once in a block however often its
   documents hold it, so no key is hot.
2. ``count_parts`` deals slices of the key lists by hash into parts of bounded size; one
   task adds up one part and answers every block with the counts of its slice.
3. ``answer_blocks`` brings documents and answers of a block together.

Blocks get random names when they are written, so a block of a lost task never mixes with
that of its second try.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tablescope.llm import skew
from tablescope.llm.textkernel import mix64
from tablescope.session import ship_package

#: bytes of keys that one part holds on average
PART_BYTES = 16 << 20
KEY_FIELDS = "block long, keys binary, n binary"


def new_block() -> int:
    return uuid.uuid4().int >> 65


def key_hash(keys: np.ndarray) -> np.ndarray:
    """The hash that orders and deals keys (unsigned integers, or rows of them: the first counts)."""
    return mix64(keys if keys.ndim == 1 else keys[:, 0])


def order_of(keys: np.ndarray) -> np.ndarray:
    """The order of a block's distinct keys: by hash (which is one to one), then by the other integers."""
    return np.argsort(key_hash(keys)) if keys.ndim == 1 else np.lexsort((*keys.T[:0:-1], key_hash(keys)))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their sums of ``n``, position of each input key among them)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable") if keys.ndim == 1 else np.lexsort(keys.T[::-1])
    laid = keys[order]
    changes = laid[1:] != laid[:-1]
    first = np.flatnonzero(np.r_[True, changes if keys.ndim == 1 else changes.any(axis=1)])
    group = np.zeros(len(keys), np.int64)
    group[first[1:]] = 1
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(group)
    return laid[first], np.add.reduceat(n[order], first), where


def _from_bytes(cell, dtype: np.dtype, width: int) -> np.ndarray:
    keys = np.frombuffer(cell.as_buffer() if cell.is_valid else b"", dtype)
    return keys if width == 1 else keys.reshape(-1, width)


def cells_of(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """``values`` between ``bounds`` (which leave nothing out) as one binary cell each, without a copy."""
    values = np.ascontiguousarray(values)
    kind, at = (pa.binary(), np.int32) if values.nbytes < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(at)), pa.py_buffer(values)])


def joined_cells(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values of all binary cells one behind the other, bounds of the cells); no cell is null."""
    lists, lengths = [], [np.zeros(1, np.int64)]
    for chunk in column.cast(pa.large_binary()).chunks:
        if len(chunk):
            _, at, body = chunk.buffers()
            ends = np.frombuffer(at, np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
            lists.append(np.frombuffer(body, np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8))
            lengths.append(np.diff(ends))
    return np.concatenate([np.zeros(0, np.uint8), *lists]).view(dtype), np.cumsum(np.concatenate(lengths)) // np.dtype(dtype).itemsize


def count_parts(blocks: DataFrame, dtype: str, width: int = 1, with_keys: bool = False,
                summary: Callable[[np.ndarray, np.ndarray], bytes] | None = None) -> DataFrame:
    """Answers (block, part, keys, counts) to the key rows (block, keys, n) of ``blocks``, as a written table.

    Keys are ``width`` unsigned integers of ``dtype`` each, ``n`` is int64.  ``summary`` turns a
    part's distinct keys and counts into bytes: they are the ``counts`` of an answer to block -1.
    """
    spark = blocks.sparkSession
    ship_package(spark)
    kind = np.dtype(dtype)
    total = blocks.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    edges = (np.arange(1, parts) * ((1 << 64) // parts)).astype(np.uint64)

    def deal(batches):
        for batch in batches:
            for block, keys, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                keys, n = _from_bytes(keys, kind, width), np.frombuffer(n.as_buffer(), np.int64)
                bounds = np.r_[0, np.searchsorted(key_hash(keys), edges), len(keys)]
                some = np.flatnonzero(np.diff(bounds)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()),
                    pa.array([keys[bounds[i]:bounds[i + 1]].tobytes() for i in some], pa.binary()),
                    pa.array([n[bounds[i]:bounds[i + 1]].tobytes() for i in some], pa.binary())], names=["block", "part", "keys", "n"])

    def add(table: pa.Table) -> pa.Table:
        lists = [_from_bytes(k, kind, width) for k in table.column("keys")]
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("n")])
        distinct, counts, where = summed(np.concatenate(lists), n)
        bounds, answers = np.cumsum([0, *map(len, lists)]), counts[where]
        out = [answers[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        names, part = table.column("block").to_pylist(), table.column("part")[0].as_py()
        keys = table.column("keys").to_pylist() if with_keys else [None] * len(out)
        if summary is not None:
            names, out, keys = [*names, -1], [*out, summary(distinct, counts)], [*keys, None]
        return pa.table({"block": pa.array(names, pa.int64()), "part": pa.array([part] * len(out), pa.int32()),
                         "keys": pa.array(keys, pa.binary()), "counts": pa.array(out, pa.binary())})

    dealt = blocks.select("block", "keys", "n").mapInArrow(deal, "block long, part int, keys binary, n binary")
    return skew.written(dealt.groupBy("part").applyInArrow(add, "block long, part int, keys binary, counts binary"), "block-answers")


def answer_blocks(docs: DataFrame, answers: DataFrame, schema: StructType,
                  finish: Callable[[pa.Table, bytes, bytes], pa.Table]) -> DataFrame:
    """``finish(documents, counts, keys)`` of every block: its documents, and the bytes of counts and keys in the block's order."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        counts = b"".join(c.as_buffer() for c in right.column("counts"))
        keys = b"".join(c.as_buffer() for c in right.column("keys") if c.is_valid)
        return finish(left, counts, keys)

    return docs.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(run, schema)


def pack_positions(position: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Ascending positions of each row (between ``bounds``) as differences, all first bytes in front of all second ones
    and so on, which compresses well."""
    step = np.diff(position, prepend=0).astype(np.int64)
    opens = bounds[:-1][np.diff(bounds) > 0]
    step[opens] = position[opens]
    cells = step.astype(np.uint32).view(np.uint8).reshape(-1, 4)
    return [cells[a:b].T.tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def unpack_positions(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all entries."""
    lists = []
    for cell in column:
        planes = np.frombuffer(cell.as_buffer(), np.uint8).reshape(4, -1)
        lists.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.int64))
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return row, np.concatenate(lists) if lists else np.zeros(0, np.int64)
