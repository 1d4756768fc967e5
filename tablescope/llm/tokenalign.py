"""Cross-tokenizer alignment by pointer jumping.

A text is encoded by a byte-level BPE (A) and by a SentencePiece BPE (B).  Tokens are byte
ranges; tokens of the two sides that overlap belong together, and so do chains of them.
Every token points to its farthest-right overlapping token: a token whose end is also an
end of the other side has none further right and is its group's terminal, any other points
to the token of the other side that holds its last byte, which ends behind it.  Replacing
every pointer by its pointer's pointer halves all chains; when nothing changes any more,
each token points to its terminal, which labels the group.  All units of a block
are labelled side by side in arrays.

A unit is a space with what follows, up to the next space behind a visible character.
Neither tokenizer has a token across the start of a unit (A splits there before it
merges, no piece of B has a space behind another character), so a text's tokens are
those of its units, and each distinct unit is encoded once in a worker while it is
remembered.  A text is never cut otherwise.

Links are all A-B token pairs of a group.  The count of an id pair is the number of
documents that hold it linked, over all documents; a link is best if its count is
the highest of its A id.  Counts are added up by ``blockcount``: no table of pairs is
collected or broadcast; only the highest count of each A id is (as many numbers as A has ids).

Defined results: null and empty texts, and texts whose joined token bytes of a side differ
from a space and the text, have no tokens: zeros and the empty group text.  Equal
rows give equal results, each counting as a document; an empty table gives no rows.
"""
from __future__ import annotations

import itertools
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tablescope.llm import skew
from tablescope.llm.blockcount import answer_blocks, count_parts, new_block, order_of, pack_positions, unpack_positions
from tablescope.llm.textkernel import _quoted, chunks, hash_spans
from tablescope.session import ship_package

#: documents are encoded in blocks of at most this many bytes (a longer one is a block of its own)
BLOCK = 1 << 20
#: bytes of units that a worker remembers
MEMORY = 96 << 20
#: units are encoded in batches of this many
BATCH_UNITS = 8192
#: links of this many token pairs are laid out at once
LINKS_AT_ONCE = 1 << 21


def byte_bpe_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import os
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        back = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        added = {t["content"] for t in json.load(open(a_path, encoding="utf-8")).get("added_tokens", [])}
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(back[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("pieces with a space behind another character are not supported")
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.mark = self.b.piece_to_id("▁")
        self.ids_b = len(names)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units that start with the space."""
        a = [e.ids for i in range(0, len(units), BATCH_UNITS) for e in self.a.encode_batch_fast(units[i:i + BATCH_UNITS], add_special_tokens=False)]
        # the model puts the space in front itself, but not before nothing
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        return a, [x if u != " " else [self.mark] for u, x in zip(units, b)]


def pointers(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For every token (first all of A, then all of B, each in order, over the same bytes) the farthest-right
    overlapping token; a B token with an end of A points to itself."""
    n = len(end_a)
    over_a = n + np.searchsorted(end_b, end_a)          # the B token that holds the last byte of an A token
    at_b = np.searchsorted(end_a, end_b)
    over_b = np.where(end_a[np.minimum(at_b, n - 1)] == end_b, n + np.arange(len(end_b)), at_b)
    return np.concatenate([over_a, over_b])


def terminals(pointer: np.ndarray) -> np.ndarray:
    """Successor doubling: the terminal of every token."""
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further


def group_labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers (0, 1, ... from the left) of the A and the B tokens."""
    if not len(end_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = terminals(pointers(end_a, end_b))
    _, label = np.unique(last, return_inverse=True)     # terminals are B tokens, numbered from the left
    return label[:len(end_a)], label[len(end_a):]


def linked_pairs(label_a, label_b, a, b, ids_b: int):
    """Distinct (group, id pair) with their token pairs: (group, pair, times), by group."""
    def distinct(label, ids, base):
        key, times = np.unique(label * base + ids, return_counts=True)
        return key // base, key % base, times

    base_a = int(a.max()) + 1 if len(a) else 1
    group_a, id_a, times_a = distinct(label_a, a, base_a)
    group_b, id_b, times_b = distinct(label_b, b, ids_b)
    from_b, to_b = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, side="right")
    width = to_b - from_b
    out, i = [], 0
    ends = np.cumsum(width)
    while i < len(group_a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LINKS_AT_ONCE, side="right")))
        left = np.repeat(np.arange(i, j), width[i:j])
        right = np.arange(len(left)) - np.repeat(ends[i:j] - width[i:j] - (ends[i - 1] if i else 0), width[i:j]) + from_b[left]
        out.append((group_a[left], id_a[left] * ids_b + id_b[right], times_a[left] * times_b[right]))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


class Units:
    """What is known of distinct units: counts, group text, and linked id pairs in flat arrays."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.figures = np.zeros((0, 5), np.int64)       # A tokens, B tokens, groups, links, whether both sides are exact
        self.at = np.zeros(1, np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def add(self, model: Pair, units: list[bytes]) -> None:
        a_lists, b_lists = model.encode([u.decode("utf-8", "surrogatepass") for u in units])
        exact = [b"".join(map(model.a_bytes.__getitem__, a)) == u == b"".join(map(model.b_bytes.__getitem__, b))
                 for a, b, u in zip(a_lists, b_lists, units)]
        a_lists = [x if ok else [] for x, ok in zip(a_lists, exact)]
        b_lists = [x if ok else [] for x, ok in zip(b_lists, exact)]
        many_a, many_b = (np.array([len(x) for x in lists], np.int64) for lists in (a_lists, b_lists))
        a, b = (np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(many.sum())) for lists, many in ((a_lists, many_a), (b_lists, many_b)))
        # units lie one behind another, so all of them are labelled at once
        label_a, label_b = group_labels(np.cumsum(model.a_size[a]), np.cumsum(model.b_size[b]))
        unit_a = np.repeat(np.arange(len(units)), many_a)
        groups = int(label_a[-1]) + 1 if len(label_a) else 0
        unit_of = np.zeros(groups, np.int64)
        unit_of[label_a] = unit_a
        in_a, in_b = np.bincount(label_a, minlength=groups), np.bincount(label_b, minlength=groups)
        texts = self._group_texts(a, b, in_a, in_b, unit_of, len(units))
        group, pair, times = linked_pairs(label_a, label_b, a, b, model.ids_b)
        key = np.lexsort((pair, unit_of[group])) if len(group) else np.zeros(0, np.int64)
        unit, pair, times = unit_of[group][key], pair[key], times[key]
        first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])]) if len(unit) else np.zeros(0, np.int64)
        if len(first):
            unit, pair, times = unit[first], pair[first], np.add.reduceat(times, first)
        start = len(self.texts)
        self.number.update((u, start + k) for k, u in enumerate(units))
        self.texts += texts
        by_unit = lambda weights: np.bincount(unit_of, weights, len(units)).astype(np.int64)
        figures = np.stack([many_a, many_b, by_unit(np.ones(groups)), by_unit(in_a * in_b), np.array(exact, np.int64)], 1)
        self.figures = np.concatenate([self.figures, figures])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(unit, minlength=len(units)))])
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])
        self.held += sum(map(len, units)) + sum(map(len, texts)) + 16 * len(pair) + 240 * len(units)

    @staticmethod
    def _group_texts(a, b, in_a, in_b, unit_of, units: int) -> list[str]:
        # all tokens in the order they are told, each with what follows it: , inside a side, | behind A, ; behind B
        ends_a, ends_b = np.cumsum(in_a), np.cumsum(in_b)
        groups = np.arange(len(in_a))
        side_a, side_b = np.repeat(2 * groups, in_a), np.repeat(2 * groups + 1, in_b)
        order = np.argsort(np.concatenate([side_a, side_b]), kind="stable")
        follows_a, follows_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        follows_a[ends_a - 1], follows_b[ends_b - 1] = 1, 2
        ids, follows = np.concatenate([a, b])[order], np.concatenate([follows_a, follows_b])[order]
        told, where = np.unique(ids * 3 + follows, return_inverse=True)
        names = np.array([f"{k // 3}{',|;'[k % 3]}" for k in told.tolist()], object)
        said = names[where].tolist()
        many = np.bincount(unit_of, in_a + in_b, units).astype(np.int64)
        ends = np.cumsum(many).tolist()
        return ["".join(said[j - m:j])[:-1] for j, m in zip(ends, many.tolist())]


def split_units(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all non-empty rows behind a space each, starts, ends, row) of their units."""
    filled = np.flatnonzero(np.diff(block.offsets))
    data = np.insert(block.data, block.offsets[filled], 32)
    opens_row = block.offsets[filled] + np.arange(len(filled))
    before, two = np.r_[np.uint8(0), data[:-1]], np.r_[np.zeros(2, np.uint8), data[:-2]] if len(data) > 1 else np.zeros(len(data), np.uint8)
    visible = ((before > 32) & (before < 127)) | ((two == 0xC3) & (before >= 0x80) & (before < 0xC0))
    opens = (data == 32) & visible
    opens[opens_row] = True
    start = np.flatnonzero(opens)
    row = filled[np.searchsorted(opens_row, start, side="right") - 1] if len(start) else start
    return data, start, np.r_[start[1:], len(data)] if len(start) else start, row


_kept: dict[tuple[str, str], tuple[Pair, Units]] = {}


def align_block(model: Pair, units: Units, block):
    """(figures, group texts, bounds, pairs, times) of a block's rows; pairs are distinct within a row, ascending."""
    data, start, end, row = split_units(block)
    _, first, back = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    distinct = [raw[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())]
    new = [u for u in distinct if u not in units.number]
    if new:
        units.add(model, new)
    unit = np.array([units.number[u] for u in distinct], np.int64)[back] if distinct else np.zeros(0, np.int64)
    figures = np.stack([np.bincount(row, units.figures[unit, k], block.rows) for k in range(4)], 1).astype(np.int64)
    exact = np.bincount(row, 1 - units.figures[unit, 4], block.rows) == 0
    figures[~exact] = 0
    bounds = np.searchsorted(row, np.arange(block.rows + 1)).tolist()
    listed = unit.tolist()
    texts = [";".join([units.texts[u] for u in listed[bounds[i]:bounds[i + 1]]]) if exact[i] else "" for i in range(block.rows)]
    # each (row, unit) once, then its pairs
    good = exact[row] if len(row) else np.zeros(0, bool)
    known = len(units.texts) or 1
    key, times = np.unique(row[good] * known + unit[good], return_counts=True)
    owner, unit = key // known, key % known
    many = units.at[unit + 1] - units.at[unit]
    at = np.repeat(units.at[unit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    owner, times, pair = np.repeat(owner, many), np.repeat(times, many) * units.times[at], units.pair[at]
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    if len(owner):
        opens = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])])
        owner, pair, times = owner[opens], pair[opens], np.add.reduceat(times, opens)
    return figures, texts, owner, pair, times


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
STAGED = [StructField("block", LongType()), *[StructField(n, LongType()) for n in FIGURES], StructField("groups", StringType()),
          StructField("positions", BinaryType()), StructField("times", BinaryType()), StructField("keys", BinaryType()), StructField("n", BinaryType())]


def _encode(a_path: str, b_path: str, schema: pa.Schema, row_type: pa.DataType):
    def run(batches):
        for batch in batches:
            for block in chunks(batch.column(1), BLOCK):
                model, units = _kept.get((a_path, b_path)) or (Pair(a_path, b_path), Units())
                if units.held > MEMORY:
                    units = Units()
                _kept[a_path, b_path] = model, units
                figures, texts, owner, pair, times = align_block(model, units, block)
                keys, where = np.unique(pair.astype(np.uint64), return_inverse=True)
                order = order_of(keys)
                spot = np.empty(len(keys), np.int64)
                spot[order] = np.arange(len(keys))
                position = spot[where]
                by = np.lexsort((position, owner))
                bounds = np.searchsorted(owner, np.arange(block.rows + 1))
                position, times = position[by], times[by].astype(np.int64)
                name, rows, none = new_block(), block.rows, pa.nulls
                cut = lambda x: [x[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                small = times.astype(np.uint32) if not len(times) or times.max() < 1 << 32 else times
                # one dtype a block: eight bytes only where a pair is linked very often
                cells = cut(small)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first, rows), pa.array([name] * rows, pa.int64()), *[pa.array(figures[:, k]) for k in range(4)],
                    pa.array(texts, pa.string()), pa.array(pack_positions(position, bounds), pa.binary()), pa.array(cells, pa.binary()),
                    none(rows, pa.binary()), none(rows, pa.binary())], schema=schema)
                n = np.bincount(where, minlength=len(keys))[order].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    none(1, row_type), pa.array([name], pa.int64()), *[none(1, pa.int64())] * 4, none(1, pa.string()), none(1, pa.binary()),
                    none(1, pa.binary()), pa.array([keys[order].tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], schema=schema)
    return run


def _highest(ids_b: int):
    def run(keys: np.ndarray, counts: np.ndarray) -> bytes:
        a, where = np.unique(keys.astype(np.int64) // ids_b, return_inverse=True)
        best = np.zeros(len(a), np.int64)
        np.maximum.at(best, where, counts)
        return np.stack([a, best], 1).tobytes()
    return run


def _unfold(batches):
    for batch in batches:
        for cell in batch.column(0):
            both = np.frombuffer(cell.as_buffer(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "best"])


def align_tokens(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None,
                 derive: dict[str, Column] | None = None) -> DataFrame:
    """Each document (kept columns in the struct ``row``) with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and the columns of ``derive``, computed from ``groups``.

    ``groups`` is the alignment itself: ids of A and of B, group after group, as ``a1,a2|b1;a3|b2,b3``.
    Without ``derive`` it is returned as it is.  Both paths must be readable by the workers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = docs.sparkSession
    ship_package(spark)
    keep = docs.columns if keep is None else keep
    derive = {"groups": F.col("groups")} if derive is None else derive
    packed = docs.select(F.struct(*[docs[_quoted(c)] for c in keep]).alias("row"), docs[_quoted(text)].alias("text"))
    fields = StructType([StructField("row", packed.schema["row"].dataType), *STAGED])
    arrow = to_arrow_schema(fields)
    encoded = packed.mapInArrow(_encode(a_path, b_path, arrow, arrow.field("row").type), fields)
    staged = skew.written(encoded.select("row", "block", *FIGURES, "positions", "times", "keys", "n", *[v.alias(f"derived_{k}") for k, v in derive.items()]), "aligned")
    import sentencepiece
    ids_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    answers = count_parts(staged.where("keys is not null"), "uint64", with_keys=True, summary=_highest(ids_b))
    # at most one row for each id of A
    best = (answers.where("block < 0").select("counts").mapInArrow(_unfold, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toPandas())
    table = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    table[best["a"].to_numpy(np.int64)] = best["best"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table)
    out = StructType([StructField("row", fields["row"].dataType), *[StructField(n, LongType()) for n in FIGURES],
                      StructField("n_best", LongType()), StructField("count_sum", LongType()),
                      *[StructField(f"derived_{k}", staged.schema[f"derived_{k}"].dataType) for k in derive]])

    def finish(documents: pa.Table, counted: bytes, keys: bytes) -> pa.Table:
        counts = np.frombuffer(counted, np.int64)
        a = np.frombuffer(keys, np.uint64).astype(np.int64) // ids_b
        is_best = counts == shared.value[a]
        row, at = unpack_positions(documents.column("positions"))
        sizes = np.bincount(row, minlength=documents.num_rows)
        times = [np.frombuffer(c.as_buffer(), np.uint32 if len(c.as_buffer()) == 4 * s else np.int64).astype(np.int64)
                 for c, s in zip(documents.column("times"), sizes.tolist())]
        times = np.concatenate(times) if times else np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        by_row = lambda x: (lambda c: c[ends[1:]] - c[ends[:-1]])(np.r_[0, np.cumsum(x)])
        figures = {"n_best": pa.array(by_row(times * is_best[at])), "count_sum": pa.array(by_row(times * counts[at]))}
        return pa.table({f.name: figures.get(f.name, documents.column(f.name) if f.name in documents.column_names else None) for f in out.fields})

    done = answer_blocks(staged.where("keys is null").drop("keys", "n"), answers, out, finish)
    return done.select("row", *FIGURES, "n_best", "count_sum", *[F.col(f"derived_{k}").alias(k) for k in derive])
