"""SentencePiece encoding and decoding with seeded merge-dropout.

The merges of a public BPE model with byte fallback are replayed by agenda: among all
adjacent pairs whose concatenation is a piece, the best-scored (then leftmost) is
taken; a hash of (left, right, place), keyed with seed, text and occurrence, decides whether
it is merged or skipped.  A skipped pair comes back only when a neighbour has changed.  With a
dropout of 0 the result is the model's own encoding.

A unit is a run of spaces with the characters behind it (no piece reaches further).
Every occurrence has a key of its own, by the text's digest and its place in the text, so
each draws its own skips.  What is shared is the agenda without skips, made once for each
distinct unit: an occurrence that skips none of its merges has its result, any other
replays the agenda under its key.  Units of up to ``SHORT`` symbols
run their agendas side by side in arrays, one step a round; longer ones on a heap.

Decoding concatenates the pieces' bytes; every text comes back exactly: a character
outside the vocabulary, and the model's own space mark as text, are encoded as bytes.

Defined results: a null text has a null id list, an empty text an empty one; equal texts
get equal ids under one seed; texts are encoded whole.
"""
from __future__ import annotations

import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField

from tablescope.llm.textkernel import Block, annotate, chunks, mix64

SPACE_MARK = 0x2581
LITERAL_MARK = 0x110000  # a space mark that stands in the text itself
DROPOUT = 0.1
SEED = 17
SHORT = 48
#: units are segmented in slices of at most this many characters
SLICE = 1 << 20
#: rows are encoded in blocks of at most this many bytes (a longer row is a block of its own)
ENCODE_BYTES = 1 << 19
#: a worker keeps the agendas without skips of at most this many units
CACHE_UNITS = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1) << np.int64(62)


class PieceModel:
    """Pieces, pair table and byte fallback of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model needs byte fallback to encode every text")
        if any(chr(SPACE_MARK) in names[i].lstrip(chr(SPACE_MARK)) for i in plain):
            raise ValueError("pieces that go on beyond a space are not supported")
        by_name = {names[i]: i for i in plain}
        # characters that occur only inside longer pieces get symbols of their own
        inner = sorted({c for n in by_name for c in n if c not in by_name})
        symbol = by_name | {c: size + k for k, c in enumerate(inner)}
        self.symbols = size + len(inner) + 1
        self.size = size
        self.of_char = np.full(LITERAL_MARK + 1, -1, np.int32)
        joins = set()
        for name in by_name:
            if len(name) == 1:
                self.of_char[ord(name)] = by_name[name]
            else:
                joins.update(map(ord, name))
        for c in inner:
            self.of_char[ord(c)] = symbol[c]
        #: characters that can be part of a longer piece
        self.joins = np.zeros(LITERAL_MARK + 1, bool)
        self.joins[list(joins)] = True
        order = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        pairs = {}
        for name, i in by_name.items():
            for k in range(1, len(name)):
                a, b = symbol.get(name[:k]), symbol.get(name[k:])
                if a is not None and b is not None:
                    pairs[a * self.symbols + b] = (order[i], i)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.pair_piece = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int32)
        # a direct table of the pairs; the few that share a slot with another are found by search
        slot = self._slot(self.pair_keys)
        self.slots = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.shared = np.zeros(1 << self.SLOT_BITS, bool)
        self.shared[slot[self.slots[slot] != np.arange(len(slot))]] = True
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = names[i].replace(chr(SPACE_MARK), " ").encode()
        for value, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([value])

    SLOT_BITS = 20

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _GOLD >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of adjacent symbols; rank ``NEVER`` where they make no piece."""
        key = left.astype(np.int64) * self.symbols + right
        slot = self._slot(key)
        at = self.slots[slot]
        known = (at >= 0) & (self.pair_keys[at] == key)
        other = np.flatnonzero(~known & self.shared[slot])
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.pair_keys, key[other]), len(self.pair_keys) - 1)
            known[other] = self.pair_keys[at[other]] == key[other]
        known &= (left >= 0) & (right >= 0)
        return np.where(known, self.pair_rank[at], NEVER), np.where(known, self.pair_piece[at], -1)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")[1:] if len(ids) else ""


def piece_model() -> str:
    """Path of the SentencePiece model (a file of the installed public tokenizers)."""
    return public_tokenizers.path("piece_bpe_32k.model")


_models: dict[str, PieceModel] = {}


def load_model(path: str) -> PieceModel:
    """The model, loaded once in each worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def step_code(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix64((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) + place.astype(np.uint64) * _GOLD


def skipped(key: np.ndarray, code: np.ndarray, dropout: float) -> np.ndarray:
    """Whether a candidate merge (its ``step_code``) is skipped, by a hash keyed with the occurrence (``key``)."""
    return (mix64(key + code) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < dropout


def merge_short(model: PieceModel, symbol: np.ndarray, unit: np.ndarray, key: np.ndarray, dropout: float, trace: list | None = None):
    """Agendas of many units side by side, one step of each a round.

    ``symbol`` and ``unit`` (ascending) are flat; ``key`` is per unit.  Returns flat
    (unit, symbol, place of the symbol's first character); ``trace`` gets the (unit, step
    code) of all merges.
    """
    place = np.arange(len(symbol)) - np.searchsorted(unit, unit)
    symbol = symbol.astype(np.int64)

    def candidates(at, last):
        rank, piece = model.pair(symbol[at], symbol[np.minimum(at + 1, len(symbol) - 1)])
        rank[last] = NEVER
        return rank, piece

    last = np.r_[unit[1:] != unit[:-1], True] if len(unit) else np.zeros(0, bool)
    rank, piece = candidates(np.arange(len(symbol)), last) if len(symbol) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    done: list[tuple] = []
    while len(symbol):
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        index = np.arange(len(symbol))
        best = np.minimum.reduceat(np.where(rank < NEVER, rank << 32 | index, NEVER), first)
        live = best < NEVER
        if not live.all():
            keep = np.repeat(live, np.diff(np.r_[first, len(symbol)]))
            done.append((unit[~keep], symbol[~keep], place[~keep]))
            moved = np.cumsum(keep) - 1
            best = best[live]
            at = moved[best & 0xFFFFFFFF]
            unit, symbol, place, rank, piece = unit[keep], symbol[keep], place[keep], rank[keep], piece[keep]
            if not len(symbol):
                break
        else:
            at = best & 0xFFFFFFFF
        if trace is not None:
            trace.append((unit[at], step_code(symbol[at], symbol[at + 1], place[at])))
        skip = skipped(key[unit[at]], step_code(symbol[at], symbol[at + 1], place[at]), dropout) if dropout else np.zeros(len(at), bool)
        rank[at[skip]] = NEVER
        at = at[~skip]
        if len(at):
            symbol[at] = piece[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            unit, symbol, place, rank, piece = unit[stay], symbol[stay], place[stay], rank[stay], piece[stay]
            at = moved[at]
            last = np.r_[unit[1:] != unit[:-1], True]
            before = at[(at > 0) & (unit[np.maximum(at, 1) - 1] == unit[at])] - 1
            changed = np.concatenate([at, before])
            rank[changed], piece[changed] = candidates(changed, last[changed])
    if not done:
        none = np.zeros(0, np.int64)
        return none, none, none
    unit, symbol, place = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(unit, kind="stable")
    return unit[order], symbol[order], place[order]


def merge_long(model: PieceModel, symbol: np.ndarray, key: int, dropout: float) -> tuple[list[int], list[int]]:
    """The same agenda on a heap, for one unit of any length: (symbols, places)."""
    n = len(symbol)
    value, following, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    keys = np.array([key], np.uint64)

    def lookup(a: int, b: int):
        k = value[a] * model.symbols + value[b]
        at = int(np.searchsorted(model.pair_keys, k))
        if value[a] >= 0 and value[b] >= 0 and at < len(model.pair_keys) and model.pair_keys[at] == k:
            return int(model.pair_rank[at]), int(model.pair_piece[at])
        return None

    rank, piece = model.pair(symbol[:-1].astype(np.int64), symbol[1:].astype(np.int64))
    agenda = [(int(r), a, a + 1, value[a], value[a + 1], int(p)) for a, (r, p) in enumerate(zip(rank.tolist(), piece.tolist())) if r < NEVER]
    heapq.heapify(agenda)
    while agenda:
        _, a, b, left, right, made = heapq.heappop(agenda)
        if not (alive[a] and b < n and alive[b] and following[a] == b and value[a] == left and value[b] == right):
            continue
        if dropout and skipped(keys, step_code(np.array([left]), np.array([right]), np.array([a])), dropout)[0]:
            continue
        value[a], alive[b], following[a] = made, False, following[b]
        if following[b] < n:
            before[following[b]] = a
        for x, y in ((before[a], a), (a, following[a])):
            if x >= 0 and y < n:
                found = lookup(x, y)
                if found:
                    heapq.heappush(agenda, (found[0], x, y, value[x], value[y], found[1]))
    left = [i for i in range(n) if alive[i]]
    return [value[i] for i in left], left


def _ids_of(model: PieceModel, unit, symbol, place, first_char, chars):
    """Flat piece ids of final symbols; symbols outside the vocabulary become bytes."""
    out = symbol.astype(np.int64)
    foreign = np.flatnonzero((symbol < 0) | (symbol >= model.size))
    if not len(foreign):
        return unit, out
    counts = np.ones(len(symbol), np.int64)
    raw = []
    for i in foreign.tolist():
        c = int(chars[first_char[unit[i]] + place[i]])
        encoded = chr(SPACE_MARK if c == LITERAL_MARK else c).encode("utf-8", "surrogatepass")
        raw.append(model.byte_ids[np.frombuffer(encoded, np.uint8)])
        counts[i] = len(encoded)
    flat = np.repeat(out, counts)
    starts = np.cumsum(counts) - counts
    for i, ids in zip(foreign.tolist(), raw):
        flat[starts[i]:starts[i] + len(ids)] = ids
    return np.repeat(unit, counts), flat


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one range after another."""
    return np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def encode_units(model: PieceModel, chars: np.ndarray, start: np.ndarray, key: np.ndarray, dropout: float,
                 cache: UnitCache, share: bool = True):
    """Piece ids of units given by their first characters and their occurrences' keys; returns (flat ids, ids per unit)."""
    size = np.diff(np.r_[start, len(chars)])
    if share:  # equal units share one agenda without skips: keyed by a 64-bit hash of their characters
        spread = mix64(chars.astype(np.uint64) + np.uint64(1))
        place = np.arange(len(chars)) - np.repeat(start, size)
        weighted = spread * (mix64(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1))
        digest = mix64(np.add.reduceat(weighted, start) + size.astype(np.uint64) * _GOLD)
    else:
        digest = np.arange(len(start)).astype(np.uint64)
    replay = (size > SHORT) & (dropout > 0)
    plain = np.flatnonzero(~replay)
    begin, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    if len(plain):
        distinct, pick, back = np.unique(digest[plain], return_index=True, return_inverse=True)
        known, at = cache.find(distinct)
        if not known.all():
            fresh, trace = plain[pick[~known]], []
            flat, many = _segment(model, chars, start[fresh], size[fresh], np.zeros(len(fresh), np.uint64), 0, trace)
            unit, code = (np.concatenate(x) for x in zip(*trace)) if trace else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            cache.add(distinct[~known], flat, many, code[np.argsort(unit, kind="stable")], np.bincount(unit, minlength=len(fresh)))
            known, at = cache.find(distinct)
        at = at[back]
        begin[plain], count[plain] = cache.begin[at], cache.count[at]
        if dropout:
            steps = cache.step_count[at]
            owner = np.repeat(plain, steps)
            replay[owner[skipped(key[owner], cache.steps[_ranges(cache.step_begin[at], steps)], dropout)]] = True
    ids, again = cache.ids, np.flatnonzero(replay)
    if len(again):
        flat, many = _segment(model, chars, start[again], size[again], key[again], dropout)
        begin[again], count[again] = len(ids) + np.cumsum(many) - many, many
        ids = np.concatenate([ids, flat])
    return ids[_ranges(begin, count)], count


def _segment(model, chars, first, width, key, dropout, trace=None):
    """Flat piece ids of units, and how many each has; ``trace`` gets the merges of the short ones."""
    short = width <= SHORT
    units, symbols, places = [], [], []
    some = np.flatnonzero(short)
    if len(some):
        u, s, p = merge_short(model, model.of_char[chars[_ranges(first[some], width[some])]], np.repeat(some, width[some]), key, dropout, trace)
        units.append(u), symbols.append(s), places.append(p)
    for k in np.flatnonzero(~short).tolist():
        s, p = merge_long(model, model.of_char[chars[first[k]:first[k] + width[k]]], int(key[k]), dropout)
        units.append(np.full(len(s), k)), symbols.append(np.array(s, np.int64)), places.append(np.array(p, np.int64))
    unit, symbol, place = np.concatenate(units), np.concatenate(symbols), np.concatenate(places)
    order = np.argsort(unit, kind="stable")
    unit, ids = _ids_of(model, unit[order], symbol[order], place[order], first, chars)
    return ids.astype(np.int32), np.bincount(unit, minlength=len(first))


class UnitCache:
    """Agendas without skips a worker has made, by digest of the unit: piece ids and step codes; emptied when it is full."""

    def __init__(self, most: int = CACHE_UNITS):
        self.most = most
        self.clear()

    def clear(self):
        self.keys, self.ids, self.steps = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.begin, self.count, self.step_begin, self.step_count = (np.zeros(0, np.int64) for _ in range(4))

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(digests), bool), np.zeros(len(digests), np.int64)
        at = np.minimum(np.searchsorted(self.keys, digests), len(self.keys) - 1)
        return self.keys[at] == digests, at

    def add(self, digests: np.ndarray, ids: np.ndarray, count: np.ndarray, steps: np.ndarray, step_count: np.ndarray) -> None:
        """Ascending new digests with their ids and step codes."""
        at = np.searchsorted(self.keys, digests)
        self.keys = np.insert(self.keys, at, digests)
        self.begin = np.insert(self.begin, at, len(self.ids) + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.step_begin = np.insert(self.step_begin, at, len(self.steps) + np.cumsum(step_count) - step_count)
        self.step_count = np.insert(self.step_count, at, step_count)
        self.ids, self.steps = np.concatenate([self.ids, ids]), np.concatenate([self.steps, steps])


_caches: dict[tuple, UnitCache] = {}


def encode_block(model: PieceModel, block: Block, seed: int, dropout: float,
                 cache: UnitCache | None = None, share: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets) of all rows of a block; every occurrence draws by itself."""
    cache = UnitCache() if cache is None or not share else cache
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.r_[0, np.cumsum((block.data & 0xC0) != 0x80)]
    bounds = lead[block.offsets]
    filled = np.flatnonzero(np.diff(bounds))
    points = np.where(points == SPACE_MARK, LITERAL_MARK, np.where(points == 32, SPACE_MARK, points))
    chars = np.insert(points, bounds[filled], SPACE_MARK)
    row_start = bounds[filled] + np.arange(len(filled))
    offsets = np.zeros(block.rows + 1, np.int64)
    if not len(filled):
        return np.zeros(0, np.int32), offsets
    joins = model.joins[chars]
    space = chars == SPACE_MARK
    opens = ~joins | (space & ~np.r_[False, space[:-1]]) | np.r_[True, ~joins[:-1]]
    opens[row_start] = True
    start = np.flatnonzero(opens)
    row = np.searchsorted(row_start, start, side="right") - 1
    texts = np.array([xxhash.xxh64_intdigest(block.data[block.offsets[i]:block.offsets[i + 1]], seed & 0xFFFFFFFFFFFFFFFF) for i in filled.tolist()], np.uint64)
    nth = np.arange(len(start)) - np.searchsorted(row, row)
    key = mix64(texts[row] + nth.astype(np.uint64) * _GOLD)
    parts, counts, a = [], [], 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + SLICE, side="right")) - 1) if start[-1] > start[a] + SLICE else len(start)
        begin, end = start[a], start[b] if b < len(start) else len(chars)
        ids, many = encode_units(model, chars[begin:end], start[a:b] - begin, key[a:b], dropout, cache, share)
        if not share:
            cache.clear()
        parts.append(ids.astype(np.int32))
        counts.append(many)
        a = b
    per_row = np.zeros(block.rows, np.int64)
    per_row[filled] = np.bincount(row, weights=np.concatenate(counts), minlength=len(filled)).astype(np.int64)
    np.cumsum(per_row, out=offsets[1:])
    return np.concatenate(parts), offsets


def _encode(path: str, seed: int, dropout: float):
    model = load_model(path)
    cache = _caches.setdefault((path, seed, dropout), UnitCache())

    def exact_rows(block: Block, flat: np.ndarray, offsets: np.ndarray) -> list[bool]:
        listed, out = flat.tolist(), []
        for i in range(block.rows):
            raw = b"".join(map(model.bytes_of.__getitem__, listed[offsets[i]:offsets[i + 1]]))[1:]
            out.append(raw == block.data[block.offsets[i]:block.offsets[i + 1]].tobytes())
        return out

    def run(column: pa.Array) -> list[pa.Array]:
        ids, sizes, exact = [], [], []
        for block in chunks(column, ENCODE_BYTES):
            if len(cache.keys) > cache.most:
                cache.clear()
            flat, offsets = encode_block(model, block, seed, dropout, cache=cache)
            right = exact_rows(block, flat, offsets)
            if not all(right):  # two units with one digest: without sharing
                flat, offsets = encode_block(model, block, seed, dropout, share=False)
                right = exact_rows(block, flat, offsets)
            exact += right
            ids.append(flat)
            sizes.append(np.diff(offsets))
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        missing = column.is_null().to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)),
                                         mask=pa.array(missing) if missing.any() else None)
        return [lists, pa.array(exact, pa.bool_())]
    return run


FIELDS = [StructField("piece_ids", ArrayType(IntegerType())), StructField("lossless", BooleanType())]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, seed: int = SEED,
                  dropout: float = DROPOUT) -> DataFrame:
    """Each document (kept columns in the struct ``row``) with ``piece_ids`` and ``lossless``: whether
    the ids decode to the text, checked for every row.

    ``model_path`` must be readable by the workers (a path of an installed package).
    """
    return annotate(docs, text, docs.columns if keep is None else keep, FIELDS, lambda: _encode(model_path, seed, dropout))


def decode_pieces(df: DataFrame, model_path: str, ids: str = "piece_ids") -> DataFrame:
    """``df`` as the struct column ``row`` with ``decoded``, the text of its id lists (null for null)."""
    import pandas as pd
    from tablescope.session import ship_package
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        model = load_model(model_path)
        return pd.Series([None if x is None else model.decode(x.tolist()) for x in lists])

    return df.select(F.struct(*[df[c].alias(c) for c in df.columns]).alias("row"), decode(df[ids]).alias("decoded"))
