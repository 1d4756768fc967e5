"""Vectorised word scanning over Arrow string columns.

A task sees its rows as Arrow batches.  ``chunks`` cuts a string column into
bounded blocks of UTF-8 bytes, ``scan_words`` finds every word of a block and
hashes it to 64 bits, without a Python object per word.  Nulls are empty texts.
A text longer than the block is scanned in pieces cut between words, so memory
is bounded by the block size plus 24 bytes per word of one text.
"""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tablescope.session import ship_package

BLOCK_BYTES = 1 << 20

_BYTE = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes as they are.
FOLD_ASCII = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
KEEP_CASE = _BYTE.copy()
#: words are digits, letters a-z after folding, and everything beyond ASCII.
ALNUM_WORDS = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
#: words are runs without ASCII white space.
SPACED_WORDS = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have[:n]


@dataclass
class Words:
    """The words of a block in text order; ``start``/``end`` are byte offsets in the block."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


@dataclass
class Block:
    first: int            # first row in the batch
    data: np.ndarray      # UTF-8 bytes of the rows, one after another
    offsets: np.ndarray   # rows + 1 byte offsets

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole rows of at most ``limit`` bytes (a longer row is a block of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Block(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def _pieces(inside: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut positions that never split a word."""
    n, a = len(inside), 0
    while a < n:
        b = min(n, a + limit)
        if b < n and inside[b] and inside[b - 1]:
            gaps = np.flatnonzero(~inside[a:b])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(~inside[b:])
                b = b + int(later[0]) if len(later) else n
        yield a, b
        a = b


def scan_words(block: Block, word_bytes: np.ndarray, fold: np.ndarray = FOLD_ASCII, limit: int = BLOCK_BYTES) -> Words:
    """Every word of the block with a 64-bit hash of its folded bytes; a word never crosses rows."""
    inside_all = word_bytes[block.data]
    first_byte = np.zeros(len(block.data) + 1, bool)
    first_byte[block.offsets] = True
    starts, ends, hashes = [], [], []
    for a, b in _pieces(inside_all, limit):
        inside, row_start = inside_all[a:b], first_byte[a:b]
        before = np.empty(b - a, bool)
        before[0] = False
        before[1:] = inside[:-1]
        s = np.flatnonzero(inside & (~before | row_start))
        if not len(s):
            continue
        last = inside.copy()
        last[:-1] &= ~inside[1:] | row_start[1:]
        e = np.flatnonzero(last) + 1
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(LETTER[fold[block.data[a:b]]] * _power("up", _BASE, b - a), out=total[1:])
        h = (total[e] - total[s]) * _power("down", _INVERSE, b - a)[s]
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix64(h ^ (e - s).astype(np.uint64)))
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    start = np.concatenate(starts)
    row = np.searchsorted(block.offsets, start, side="right") - 1
    return Words(row, start, np.concatenate(ends), np.concatenate(hashes))


def windows(h: np.ndarray, row: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive words of a row, and the index of each run's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1:])
    out = np.full(len(at), np.uint64((salt * 0x9E3779B97F4A7C15 + n) % (1 << 64)), np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[at + k])
    return out, at


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, for spans that follow one another."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 20), side="right")))
        a, b = int(start[i]), int(end[j - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(LETTER[data[a:b]] * _power("up", _BASE, b - a), out=total[1:])
        h = (total[end[i:j] - a] - total[start[i:j] - a]) * _power("down", _INVERSE, b - a)[start[i:j] - a]
        out[i:j] = mix64(h ^ (end[i:j] - start[i:j]).astype(np.uint64))
        i = j
    return out


def code_point_offsets(block: Block, byte_positions: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position of the block."""
    lead = np.cumsum((block.data & 0xC0) != 0x80, dtype=np.int64)
    return np.where(byte_positions > 0, lead[np.maximum(byte_positions, 1) - 1] if len(lead) else 0, 0)


def give_back() -> None:
    """What this worker has freed goes back to the system, so that the next stage does not pay for the last one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):   # a C library without it
        pass


def annotate(df: DataFrame, text: str, keep: list[str], fields: list[StructField],
             make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Rows of ``df`` with new columns computed from ``text`` in Arrow batches.

    The kept input columns come back as one struct column ``row`` beside the new
    columns, so that no name of the input can clash with a result.  ``make`` runs
    once in each task and returns the batch function.  No shuffle.  A task gives back what an earlier
    stage left in its worker, and in the end what it has freed itself.
    """
    ship_package(df.sparkSession)
    packed = df.select(F.struct(*[df[_quoted(c)] for c in keep]).alias("row"), df[_quoted(text)].alias("text"))
    schema = StructType([packed.schema["row"], *fields])

    def run(batches):
        give_back()
        work = make()
        for batch in batches:
            arrays = work(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[f.name for f in schema.fields])
            del arrays
        del work
        give_back()

    return packed.mapInArrow(run, schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpack(df: DataFrame, *extra) -> DataFrame:
    """The kept input columns again as top-level columns, then the named extras."""
    inner = df.schema["row"].dataType.names
    return df.select(*[F.col("row")[c].alias(c) for c in inner], *extra)
