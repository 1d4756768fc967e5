"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels that grow with their logarithm
(``thresholds``: 1, 2, 3, 4, 5, 7, 9, ...).  An n-gram of level q is put into a Bloom
filter q times, as (n-gram, 1) to (n-gram, q); its level is read by probing (n-gram, 1),
(n-gram, 2) and so on until a probe fails.  A probe never misses what was put in, so a
level can only be too high, and by one step less likely than by none.

The probability of a word behind another is smoothed by Dirichlet's prior:
(count of the pair + MU * probability of the word) / (count of the first word + MU), and that of a
word alone is (count + 0.1) / (N + 0.1 * (V + 1)).  A numerator takes the lower edge of its level
and a denominator the upper one, so probabilities do not exceed the exact model's but for wrong
hits (about one probe in 100).  A text begins behind a start mark (as many as there are training texts) and ends with the end token.

The filter grows with the corpus: ``BITS`` bits for each (n-gram, level).  It is built and
written in segments, by hash, each by one task of bounded size.  Up to ``BROADCAST_BYTES`` in
all it is broadcast and every task probes its own documents.  Beyond that no worker
gets more than one segment: probes of a block of documents are dealt to the segments
(each distinct n-gram of a block once), and the levels come back to the block.  Both
ways give the same scores.  Segments and blocks both grow with the corpus, so what is done
for each piece (a block's share of a segment) would grow with its square: n-grams are counted over
``FLUSH_TOKENS`` before they are dealt, blocks that are dealt hold ``DEALT_BLOCK``, and a segment takes all its pieces
at once.

The base score needs exact counts: words are keyed by 96 bits of two hashes and added up over
blocks (``blockcount``); nothing that grows with the vocabulary is collected.

Training rows: crc32(doc_id as text) mod 10 is not 0.

Defined results: a null text is an empty one and has the end token alone; a null id is
never a training row and not held out; equal texts score alike; repeated rows all count; an
empty table gives no rows; without training rows every probability is that of V = 0, N = 0.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from tablescope.llm import skew
from tablescope.llm.blockcount import (answer_blocks, cells_of, count_parts, joined_cells, key_hash, new_block, order_of, pack_positions, unpack_positions)
from tablescope.llm.textkernel import FOLD_ASCII, SPACED_WORDS, _quoted, chunks, give_back, mix64, scan_words
from tablescope.session import ship_package

BLOCK = 1 << 20
#: text of a block whose probes are dealt, tokens whose n-grams are counted before they are dealt, and keys probed at once
DEALT_BLOCK = 4 << 20
FLUSH_TOKENS = 1 << 20
PROBE_KEYS = 1 << 18
#: prior weight of the word alone (of 1, 2, 4, ... 64 the best on held-out rows)
MU = 16.0
#: growth of the thresholds from level to level
GROWTH = 1.25
LEVELS = 90
#: bits of the filter for each (n-gram, level), and bits set for each
BITS = 10
SET_BITS = 6
#: n-gram occurrences that one segment's task counts, at most and on average
SEGMENT_GRAMS = 3_000_000
BROADCAST_BYTES = 256 << 20
#: n-gram hashes travel in so many bytes; a segment's share of the hash comes on top
HASH_BYTES = 4
HASH_KIND = np.dtype(f"u{HASH_BYTES}")
_END, _START = np.uint64(0x51ED270B0A1F3C49), np.uint64(0x2545F4914F6CDD1D)
_PAIR, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E6C63D0876A9A47)
_LEVEL, _GOLD = 0xA0761D6478BD642F, 0x9E3779B97F4A7C15


def thresholds() -> np.ndarray:
    """The least count of each level, level 1 first."""
    out = [1]
    while len(out) < LEVELS:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * GROWTH))))
    return np.array(out, np.int64)


STEPS = thresholds()


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, counts, side="right")


def least_count(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, STEPS[np.maximum(level, 1) - 1], 0)


def most_count(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, STEPS[np.minimum(level, LEVELS - 1)] - 1, 0)


# ---- tokens

class Tokens:
    """Tokens of a block's rows, each row closed by the end token: row, key, second hash, whether the token ends it."""

    def __init__(self, block):
        words = scan_words(block, SPACED_WORDS)
        rows = block.rows
        at = np.searchsorted(words.row, np.arange(rows), side="right")
        self.row = np.insert(words.row, at, np.arange(rows))
        self.key = np.insert(words.hash, at, _END)
        # the second hash: length and both ends of the word, literally
        size = (words.end - words.start).astype(np.uint64)
        last = max(len(block.data) - 1, 0)
        letters = size.copy()
        for k in range(3):
            for spot in (words.start + k, words.end - 1 - k):
                letter = FOLD_ASCII[block.data[np.clip(spot, 0, last)]].astype(np.uint64) if len(size) else size
                letters = letters * np.uint64(257) + np.where((spot >= words.start) & (spot < words.end), letter, np.uint64(0))
        self.second = np.insert(mix64(letters * _SECOND), at, _END)
        self.ends = np.insert(np.zeros(len(size), bool), at, True)

    def pairs(self) -> np.ndarray:
        """Key of each token behind its left neighbour (the start mark in front of a row)."""
        left = np.r_[_START, self.key[:-1]]
        left[np.r_[True, self.ends[:-1]]] = _START
        return pair_key(left, self.key)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(mix64(left * _PAIR) + right)


# ---- the filter

def place(keys: np.ndarray, level: int, half: int, size) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits in it) of one half of each (n-gram, level) in a segment of ``size`` 64-bit words."""
    h = mix64(keys + np.uint64((level * _LEVEL + half * _GOLD) % (1 << 64)))
    mask = np.zeros(len(keys), np.uint64)
    for k in range(SET_BITS // 2):
        mask |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return ((h >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64), mask


def build_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64-bit words of a segment; a (n-gram, level) sets half of its bits in each of two words."""
    level = level_of(counts)
    words = np.zeros(max(1, -(-int(level.sum()) * BITS // 64)), np.uint64)
    for q in range(1, int(level.max(initial=0)) + 1):
        keys, level = keys[level >= q], level[level >= q]
        for half in (0, 1):
            at, mask = place(keys, q, half, np.uint64(len(words)))
            np.bitwise_or.at(words, at, mask)
    return words


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def inner(keys: np.ndarray) -> np.ndarray:
    """What is left of a key inside its segment."""
    return keys & np.uint64((1 << 8 * HASH_BYTES) - 1)


def sent(keys: np.ndarray) -> np.ndarray:
    """What travels of each key: the part inside its segment."""
    return keys.astype(HASH_KIND)


def segment_bounds(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment's keys begin among ascending ``keys``, and the end."""
    return np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))


class Filter:
    """Segments one behind the other, each from its place in ``starts`` on."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.starts, self.sizes = words, starts[:-1], np.diff(starts).astype(np.uint64)

    def levels(self, keys: np.ndarray, segment: np.ndarray | None = None) -> np.ndarray:
        """The level of each key: membership probes, level after level, until one fails."""
        one = len(self.sizes) == 1
        segment = 0 if one else segment_of(keys, len(self.sizes)) if segment is None else segment
        keys, size, start = inner(keys), self.sizes[segment], self.starts[segment]
        out, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            for half in (0, 1):
                at, mask = place(keys, q, half, size)
                held = np.flatnonzero((self.words[at + start] & mask) == mask)
                if len(held) < len(keys):
                    keys, left = keys[held], left[held]
                    if not one:
                        size, start = size[held], start[held]
            if not len(left):
                break
            out[left] = q
        return out


# ---- training

def _grams(segments: int):
    """Word and pair counts of the training rows, cut by segment, over ``FLUSH_TOKENS`` at a time."""
    names = ["part", "words", "words_n", "pairs", "pairs_n"]

    def counted(lists: list[np.ndarray]):
        laid = np.sort(np.concatenate(lists))
        first = np.flatnonzero(np.r_[True, laid[1:] != laid[:-1]])
        keys, n = laid[first], np.diff(first, append=len(laid))
        # a count travels in one byte; of a larger one there are several
        times = -(-n // 255)
        rest, last = n - 255 * (times - 1), np.cumsum(times) - 1
        keys, n = np.repeat(keys, times), np.full(int(times.sum()), 255, np.uint8)
        n[last] = rest
        return sent(keys), n, segment_bounds(keys, segments)

    def rows(words: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        lists = [counted(words), counted(pairs)]
        some = np.flatnonzero(sum(np.diff(bounds) for _, _, bounds in lists))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[cells_of(x, np.r_[bounds[some], bounds[-1]]) for keys, n, bounds in lists for x in (keys, n)]],
                                          names=names)

    def run(batches):
        words, pairs, held = [], [], 0
        for batch in batches:
            for block in chunks(batch.column(0), BLOCK):
                tokens = Tokens(block)
                words.append(tokens.key)
                pairs += [tokens.pairs(), np.full(block.rows, _START, np.uint64)]
                held += len(tokens.key)
                if held >= FLUSH_TOKENS:
                    yield rows(words, pairs)
                    words, pairs, held = [], [], 0
        if held:
            yield rows(words, pairs)
    return run


def _build(table: pa.Table) -> pa.Table:
    """A segment from all its counts, with the number of its words and their occurrences."""
    def total(name):
        keys, n = joined_cells(table.column(name), HASH_KIND)[0], joined_cells(table.column(f"{name}_n"), np.uint8)[0]
        if not len(keys):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        laid = np.sort(keys.astype(np.uint64) << np.uint64(8) | n)
        keys, n = laid >> np.uint64(8), (laid & np.uint64(255)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    (words, words_n), (pairs, pairs_n) = total("words"), total("pairs")
    made = build_segment(np.concatenate([words, pairs]), np.concatenate([words_n, pairs_n]))
    give_back()
    return pa.table({"part": table.column("part")[:1], "bits": pa.array([made.tobytes()], pa.binary()),
                     "words": pa.array([len(words)], pa.int64()), "tokens": pa.array([int(words_n.sum())], pa.int64())})


def training_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 != 0, F.lit(False))


def train_filter(docs: DataFrame, text: str = "text", segment_grams: int = SEGMENT_GRAMS) -> DataFrame:
    """The filter over all texts of ``docs`` as a written table (part, bits, words, tokens); ``part`` runs from 0 without gaps."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(docs[_quoted(text)], F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a token has two bytes at least in all but odd texts, and is counted as a word and in a pair
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // 2 // segment_grams))
    grams = texts.mapInArrow(_grams(segments), "part int, words binary, words_n binary, pairs binary, pairs_n binary")
    built = grams.groupBy("part").applyInArrow(_build, "part int, bits binary, words long, tokens long")
    every = spark.range(segments).select(F.col("id").cast("int").alias("part"))
    nothing = F.unhex(F.lit("00" * 8))
    return skew.written(every.join(built, "part", "left").select(
        "part", F.coalesce("bits", nothing).alias("bits"), F.coalesce("words", F.lit(0)).cast("long").alias("words"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "bloom-filter")


# ---- scoring

def block_order(keys: np.ndarray) -> np.ndarray:
    """``order_of`` by one sort, as nearly all hashes differ."""
    h = key_hash(keys)
    order = np.argsort(h)
    laid = h[order]
    return order_of(keys) if (laid[1:] == laid[:-1]).any() else order


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """The levels that a segment (``right``) gives to the keys of all pieces dealt to it."""
    if not left.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
    words = np.frombuffer(right.column("bits")[0].as_buffer(), np.uint64)
    one, (keys, bounds) = Filter(words, np.array([0, len(words)])), joined_cells(left.column("keys"), HASH_KIND)
    levels = np.concatenate([one.levels(keys[i:i + PROBE_KEYS].astype(np.uint64)) for i in range(0, len(keys), PROBE_KEYS)])
    return pa.table({"block": left.column("block"), "part": left.column("part"), "keys": pa.nulls(left.num_rows, pa.binary()), "counts": cells_of(levels, bounds)})


ROWS = [StructField("block", LongType()), StructField("held_out", BooleanType()), StructField("n_tokens", LongType()), StructField("score", DoubleType()),
        StructField("positions", BinaryType()), StructField("times", BinaryType()), StructField("keys", BinaryType()), StructField("n", BinaryType())]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending; position of each key among them)."""
    order = np.argsort(keys)
    laid = keys[order]
    opens = np.r_[True, laid[1:] != laid[:-1]] if len(laid) else np.zeros(0, bool)
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(opens) - 1
    return laid[opens], where


def log10_probability(tokens: Tokens, rows: int, words: np.ndarray, at_word: np.ndarray, levels, n: int, v: int) -> np.ndarray:
    """The model's log10 probability of each row; its tokens are ``words[at_word]``, ``levels`` gives the levels of keys."""
    pairs, at_pair = distinct(tokens.pairs())
    level = levels(np.concatenate([words, [_START], pairs])).astype(np.int64)
    word_level, start_level, pair_level = level[:len(words)], level[len(words)], level[len(words) + 1:]
    alone = (least_count(word_level) + 0.1)[at_word] / (n + 0.1 * (v + 1))
    opens = np.r_[True, tokens.ends[:-1]]
    before = most_count(np.r_[word_level, start_level])[np.where(opens, len(words), np.r_[0, at_word[:-1]])]
    p = (least_count(pair_level)[at_pair] + MU * alone) / (before + MU)
    return np.bincount(tokens.row, np.log10(p), rows)


def _scored_block(block, rows: pa.Array, trains: np.ndarray, held: pa.Array, levels, n: int, v: int, schema: pa.Schema, tokens: Tokens | None = None):
    """The record batches of a scored block: its documents, and its words with their training counts."""
    tokens = Tokens(block) if tokens is None else tokens
    words, where = distinct(tokens.key)
    score = log10_probability(tokens, block.rows, words, where, levels, n, v)
    first = np.empty(len(words), np.int64)
    first[where[::-1]] = np.arange(len(where))[::-1]
    # 96 bits of each word: its hash and half of the second one
    keys = np.stack([x.astype(np.uint32) for x in (words >> np.uint64(32), words, tokens.second[first])], 1)
    order = block_order(keys)
    spot = np.empty(len(keys), np.int64)
    spot[order] = np.arange(len(keys))
    where = spot[where]
    both = np.sort(tokens.row * len(keys) + where)
    opens = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    both, times = both[opens], np.diff(opens, append=len(both))
    owner, position = both // len(keys), both % len(keys)
    bounds = np.searchsorted(owner, np.arange(block.rows + 1))
    times = times.astype(np.uint32)
    count = np.bincount(where, trains[tokens.row], len(keys)).astype(np.int64)
    name, many, none = new_block(), block.rows, pa.nulls
    yield pa.RecordBatch.from_arrays([
        rows, pa.array([name] * many, pa.int64()), held, pa.array(np.bincount(tokens.row, minlength=many).astype(np.int64)), pa.array(score),
        pa.array(pack_positions(position, bounds), pa.binary()),
        pa.array([times[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()), none(many, pa.binary()), none(many, pa.binary())], schema=schema)
    yield pa.RecordBatch.from_arrays([
        none(1, schema.field(0).type), pa.array([name], pa.int64()), none(1, pa.bool_()), none(1, pa.int64()), none(1, pa.float64()), none(1, pa.binary()),
        none(1, pa.binary()), pa.array([keys[order].tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], schema=schema)


def _score_here(packed: DataFrame, bits: DataFrame, n: int, v: int, fields: StructType, schema: pa.Schema) -> DataFrame:
    """Every task probes a broadcast of the whole filter, whose size has been checked; it is given up when the scores are written."""
    cells = bits.select("part", "bits").toArrow().sort_by("part").column("bits")
    words = [np.frombuffer(c.as_buffer(), np.uint64) for c in cells]
    shared = packed.sparkSession.sparkContext.broadcast((np.concatenate(words), np.cumsum([0, *map(len, words)])))
    del cells, words

    def run(batches):
        give_back()
        levels = Filter(*shared.value).levels
        for batch in batches:
            trains = batch.column(2).to_numpy(zero_copy_only=False)
            for block in chunks(batch.column(1), BLOCK):
                part = slice(block.first, block.first + block.rows)
                yield from _scored_block(block, batch.column(0).slice(block.first, block.rows), trains[part], batch.column(3).slice(block.first, block.rows),
                                         levels, n, v, schema)

    scored = skew.written(packed.mapInArrow(run, fields), "lm-scored")
    shared.destroy()
    return scored


def _probed(tokens: Tokens) -> np.ndarray:
    """The distinct keys that a block probes, ascending."""
    keys = np.sort(np.concatenate([tokens.key, tokens.pairs(), [_START]]))
    return keys[np.r_[True, keys[1:] != keys[:-1]]]


def _score_dealt(packed: DataFrame, bits: DataFrame, segments: int, n: int, v: int, fields: StructType, schema: pa.Schema) -> DataFrame:
    """The probes of each block are dealt to the segments, and their levels come back to the block."""
    asked = StructType([fields["row"], *[StructField(name, kind) for name, kind in (
        ("block", LongType()), ("text", packed.schema["text"].dataType), ("trains", BooleanType()), ("held_out", BooleanType()), ("part", IntegerType()), ("keys", BinaryType()))]])
    from pyspark.sql.pandas.types import to_arrow_schema
    asked_schema = to_arrow_schema(asked)

    def ask(batches):
        for batch in batches:
            for block in chunks(batch.column(1), DEALT_BLOCK):
                name, many, none = new_block(), block.rows, pa.nulls
                cut = lambda k: batch.column(k).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([cut(0), pa.array([name] * many, pa.int64()), cut(1), cut(2), cut(3), none(many, pa.int32()), none(many, pa.binary())],
                                                 schema=asked_schema)
                keys = _probed(Tokens(block))
                bounds = segment_bounds(keys, segments)
                some = np.flatnonzero(np.diff(bounds))
                many = len(some)
                yield pa.RecordBatch.from_arrays([
                    none(many, asked_schema.field(0).type), pa.array([name] * many, pa.int64()), none(many, pa.string()), none(many, pa.bool_()), none(many, pa.bool_()),
                    pa.array(some, pa.int32()), cells_of(sent(keys), np.r_[bounds[some], bounds[-1]])], schema=asked_schema)

    staged = skew.written(packed.mapInArrow(ask, asked), "probes")
    answers = (staged.where("part is not null").select("block", "part", "keys").groupBy("part").cogroup(bits.select("part", "bits").groupBy("part"))
               .applyInArrow(_probe, "block long, part int, keys binary, counts binary"))

    def finish(documents: pa.Table, found: bytes, _: bytes) -> pa.Table:
        documents = documents.combine_chunks()
        text = documents.column("text").combine_chunks()
        out = []
        for block in chunks(text, 1 << 62):
            trains = documents.column("trains").to_numpy()
            one = lambda name: documents.column(name).combine_chunks()
            tokens = Tokens(block)
            keys = _probed(tokens)
            levels = np.frombuffer(found, np.uint8)
            out += _scored_block(block, one("row"), trains, one("held_out"), lambda k: levels[np.searchsorted(keys, k)], n, v, schema, tokens)
        return pa.Table.from_batches(out, schema=schema)

    return answer_blocks(staged.where("part is null").drop("part", "keys"), answers, fields, finish)


def _known_and_all(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return np.array([(counts > 0).sum(), counts.sum()], np.int64).tobytes()


def _unfold(batches):
    for batch in batches:
        both = np.array([np.frombuffer(c.as_buffer(), np.int64) for c in batch.column(0)], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["v", "n"])


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
                broadcast_bytes: int = BROADCAST_BYTES, segment_grams: int = SEGMENT_GRAMS) -> DataFrame:
    """Each document (kept columns in the struct ``row``) with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = docs.sparkSession
    ship_package(spark)
    keep = docs.columns if keep is None else keep
    trains = training_rows(docs[_quoted(doc_id)])
    bits = train_filter(docs.where(trains), text, segment_grams)
    size = bits.agg(F.count(F.lit(1)), F.sum(F.octet_length("bits")), F.sum("words"), F.sum("tokens")).first()
    segments, total, v, n = (int(x) for x in size)
    packed = docs.select(F.struct(*[docs[_quoted(c)] for c in keep]).alias("row"), F.coalesce(docs[_quoted(text)], F.lit("")).alias("text"),
                         trains.alias("trains"), F.coalesce(F.crc32(docs[_quoted(doc_id)].cast("string")) % 10 == 0, F.lit(False)).alias("held_out"))
    fields = StructType([StructField("row", packed.schema["row"].dataType), *ROWS])
    schema = to_arrow_schema(fields)
    if total <= broadcast_bytes:
        staged = _score_here(packed, bits, n, v, fields, schema)
    else:
        staged = skew.written(_score_dealt(packed, bits, segments, n, v, fields, schema), "lm-scored")
    answers = count_parts(staged.where("keys is not null"), "uint32", 3, summary=_known_and_all)
    known = answers.where("block < 0").select("counts").mapInArrow(_unfold, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    words, train_tokens = int(known[0] or 0), int(known[1] or 0)
    out = StructType([fields["row"], fields["held_out"], fields["n_tokens"], StructField("n_known", LongType()),
                      StructField("train_tokens", LongType()), StructField("base_score", DoubleType()), fields["score"]])

    def finish(documents: pa.Table, counted: bytes, _: bytes) -> pa.Table:
        counts = np.frombuffer(counted, np.int64)
        row, at = unpack_positions(documents.column("positions"))
        times = np.frombuffer(b"".join(c.as_buffer() for c in documents.column("times")), np.uint32).astype(np.float64)
        rows = documents.num_rows
        base = np.log10((counts + 0.1) / (train_tokens + 0.1 * (words + 1)))
        made = {"n_known": pa.array(np.bincount(row, times * (counts[at] > 0), rows).astype(np.int64)),
                "train_tokens": pa.array(np.full(rows, train_tokens, np.int64)), "base_score": pa.array(np.bincount(row, times * base[at], rows))}
        return pa.table({f.name: made.get(f.name, documents.column(f.name) if f.name in documents.column_names else None) for f in out.fields})

    return answer_blocks(staged.where("keys is null").drop("keys", "n"), answers, out, finish)
