"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded block of documents inside one Spark task.  Its words become
symbols of the benchmark vocabulary; words that no benchmark item uses cannot lie
in a match and only separate segments.  Over the segments the task builds a
suffix array, its Burrows-Wheeler transform, a wavelet matrix that answers rank
queries, and a sample of suffix positions.  All test phrases are searched
backwards at once; occurrences are located by stepping to the next sampled
suffix; the spans of all occurrences are merged per document.

The documents are never shuffled.  The phrases travel as broadcasts of at most
``PHRASE_BYTES`` of benchmark text each; a larger benchmark is worked off in as
many passes over a written intermediate table.

Defined results: a null or wordless text has ``n_words`` 0 and no hits; a null or
wordless item matches nothing; items that share a phrase are all reported; equal
rows give equal results and all stay; an empty benchmark hits nothing; an item
whose id is null is reported as ``null``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (ArrayType, LongType, StringType, StructField, StructType)

from tablescope.llm import skew
from tablescope.llm.textkernel import (ALNUM_WORDS, _quoted, annotate, chunks, code_point_offsets, scan_words)

WINDOW_WORDS = 13
SAMPLE_STEP = 8
PHRASE_BYTES = 32 << 20

SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
FIELDS = [StructField("n_words", LongType()), StructField("n_hit", LongType()),
          StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(SPAN))]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    opens = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    index = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, index, 0))
    tied = order[~(opens & np.r_[opens[1:], True])]
    step = 1
    while len(tied):
        ahead = tied + step
        key = rank[tied] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        group = key // (n + 1)
        index = np.arange(len(tied))
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_key = np.r_[True, key[1:] != key[:-1]]
        rank[tied] = group + np.maximum.accumulate(np.where(new_key, index, 0)) - np.maximum.accumulate(np.where(new_group, index, 0))
        tied = tied[~(new_key & np.r_[new_key[1:], True])]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Symbols 1..sigma-1; 0 ends a segment.  Queries are answered for many patterns at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        # each segment end gets an order of its own, so that copies differ beyond their ends
        keyed = symbols.astype(np.int64) + len(ends)
        keyed[ends] = np.arange(len(ends))
        order = suffix_array(keyed)
        self.n = n
        self.bwt = symbols[order - 1].astype(np.int64)  # position 0 wraps to the last end
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma))][:sigma]
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.split = [], []
        level = self.bwt
        self.base = np.zeros(sigma, np.int64)
        every = np.arange(sigma)
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b & 1).astype(bool)
            before = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            self.split.append(int(before[-1]))
            self.base = np.where(every >> b & 1, before[-1] + self.base - before[self.base], before[self.base])
            level = np.concatenate([level[~one], level[one]])
        starts = np.r_[True, symbols[:-1] == 0]
        self.sampled = (order % SAMPLE_STEP == 0) | starts[order]
        self.position = np.where(self.sampled, order, -1)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the transform before index ``upto``."""
        at = upto
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            before = self.zeros[k][at]
            at = np.where(symbol >> b & 1, self.split[k] + at - before, before)
        return at - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that begin with each pattern (a row of symbols), last symbol first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled suffix."""
        out = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.position[rows[done]] + steps
            left, rows = left[~done], rows[~done]
            c = self.bwt[rows]
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """Distinct word windows of benchmark items, by length, over a sorted vocabulary of word hashes."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int = WINDOW_WORDS):
        by_length: dict[int, tuple[list, list]] = {}
        seen: list[np.ndarray] = []
        for block in chunks(pa.array(texts, pa.large_string())):
            words = scan_words(block, ALNUM_WORDS)
            bounds = np.searchsorted(words.row, np.arange(block.rows + 1))
            seen.append(np.unique(words.hash))
            for i in range(block.rows):
                h = words.hash[bounds[i]:bounds[i + 1]]
                n = min(width, len(h))
                if n:
                    runs = np.lib.stride_tricks.sliding_window_view(h, n)
                    parts = by_length.setdefault(n, ([], []))
                    parts[0].append(runs)
                    parts[1].append(np.full(len(runs), block.first + i))
        self.ids = np.array(["null" if x is None else x for x in ids], object)
        self.vocabulary = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        self.groups = []
        for n, (runs, owner) in sorted(by_length.items()):
            symbols = np.searchsorted(self.vocabulary, np.concatenate(runs)) + 1
            distinct, which = np.unique(symbols, axis=0, return_inverse=True)
            owner, which = np.concatenate(owner), which.ravel()
            by = np.argsort(which, kind="stable")
            self.groups.append((n, distinct, np.searchsorted(which[by], np.arange(len(distinct) + 1)), owner[by]))
        self.shortest = self.groups[0][0] if self.groups else 0

    def find(self, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hit, and distinct (row, item) pairs, for the words of one shard."""
        hit = np.zeros(len(hashes), bool)
        none = np.zeros((0, 2), np.int64)
        if not len(hashes) or not self.groups:
            return hit, none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        # segments: runs of known words of one row, at least as long as the shortest phrase
        opens = known & np.r_[True, ~known[:-1] | (row[1:] != row[:-1])]
        run = np.cumsum(opens)
        size = np.bincount(run[known], minlength=run[-1] + 1)
        use = np.flatnonzero(known & (size[run] >= self.shortest))
        if not len(use):
            return hit, none
        last = np.r_[run[use][1:] != run[use][:-1], True]
        place = np.arange(len(use)) + np.r_[0, np.cumsum(last)[:-1]]
        symbols = np.zeros(len(use) + int(last.sum()), np.int64)
        symbols[place] = at[use] + 1
        word_at = np.full(len(symbols), -1, np.int64)
        word_at[place] = use
        index = FMIndex(symbols, len(self.vocabulary) + 1)
        edge = np.zeros(len(symbols) + 1, np.int64)
        pairs = []
        for n, patterns, owner_from, owners in self.groups:
            low, high = index.search(patterns)
            found = np.flatnonzero(high > low)
            count = (high - low)[found]
            if not len(found):
                continue
            which = np.repeat(found, count)
            rows = np.repeat(low[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            position = index.locate(rows)
            np.add.at(edge, position, 1)
            np.add.at(edge, position + n, -1)
            here = np.unique(np.stack([row[word_at[position]], which], 1), axis=0)
            width = owner_from[here[:, 1] + 1] - owner_from[here[:, 1]]
            item = owners[np.repeat(owner_from[here[:, 1]], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
            pairs.append(np.unique(np.stack([np.repeat(here[:, 0], width), item], 1), axis=0))
        covered = np.cumsum(edge[:-1]) > 0
        hit[word_at[covered & (word_at >= 0)]] = True
        return hit, np.unique(np.concatenate(pairs), axis=0) if pairs else none


def _spans(block, words, hit) -> dict[int, list[dict]]:
    """Merged spans in code points of each text, from the first hit word of a run to its last."""
    if not hit.any():
        return {}
    opens = hit & np.r_[True, ~hit[:-1] | (words.row[1:] != words.row[:-1])]
    closes = hit & np.r_[~hit[1:] | (words.row[1:] != words.row[:-1]), True]
    row = words.row[opens]
    origin = code_point_offsets(block, block.offsets[row])
    start = code_point_offsets(block, words.start[opens]) - origin
    end = code_point_offsets(block, words.end[closes]) - origin
    out: dict[int, list[dict]] = {}
    for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
        out.setdefault(r, []).append({"start": s, "end": e})
    return out


def _work(phrases):
    def run(column: pa.Array) -> list[pa.Array]:
        n_words, n_hit, items, spans = [], [], [], []
        for block in chunks(column):
            words = scan_words(block, ALNUM_WORDS)
            hit, pairs = phrases.find(words.row, words.hash)
            n_words.append(np.bincount(words.row, minlength=block.rows))
            n_hit.append(np.bincount(words.row[hit], minlength=block.rows))
            cut = np.searchsorted(pairs[:, 0], np.arange(block.rows + 1))
            merged = _spans(block, words, hit)
            for i in range(block.rows):
                items.append(sorted(set(phrases.ids[pairs[cut[i]:cut[i + 1], 1]])) if cut[i + 1] > cut[i] else [])
                spans.append(merged.get(i, []))
        total = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return [total(n_words), total(n_hit), pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return run


def phrase_blocks(benchmark: DataFrame, item_id: str, text: str, width: int, limit: int):
    """The benchmark in blocks of at most ``limit`` bytes of text (or one longer item each), one on the driver at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(text).isNotNull())
    for one_id, one in rows.toLocalIterator():
        if ids and size + len(one) > limit:
            yield Phrases(ids, texts, width)
            ids, texts, size = [], [], 0
        ids.append(one_id)
        texts.append(one)
        size += len(one)
    if ids:
        yield Phrases(ids, texts, width)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
                  item_id: str = "item_id", item_text: str = "text", width: int = WINDOW_WORDS,
                  phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Each document with ``n_words``, ``n_hit`` (words inside an occurrence of a
    benchmark window), ``items`` (sorted ids) and ``spans`` (merged, in code points).

    Kept input columns come back in the struct column ``row``.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    # one block needs no more than the kept columns; of several, every pass but the last is written with the text
    out = before = None
    for phrases in phrase_blocks(benchmark, item_id, item_text, width, phrase_bytes):
        if before is not None:
            out = skew.written(_pass(docs, out, text, keep, before), "decontamination-pass")
            before.unpersist()
        before = spark.sparkContext.broadcast(phrases)
    if before is not None and out is None:
        return annotate(docs, text, keep, FIELDS, lambda: _work(before.value))
    if out is not None:
        out = _pass(docs, out, text, keep, before).drop("text")
    if out is None:
        empty = spark.sparkContext.broadcast(Phrases([], []))
        out = annotate(docs, text, keep, FIELDS, lambda: _work(empty.value))
    return out


def _pass(docs: DataFrame, done: DataFrame | None, text: str, keep: list[str], shared) -> DataFrame:
    """The kept columns as ``row``, the results of the blocks up to this one, and the text as ``text``."""
    if done is None:
        asked = docs.select(F.struct(*[docs[_quoted(c)] for c in keep]).alias("row"), docs[_quoted(text)].alias("text"))
        found = annotate(asked, "text", ["row", "text"], FIELDS, lambda: _work(shared.value))
        return found.select(F.col("row.row").alias("row"), *(f.name for f in FIELDS), F.col("row.text").alias("text"))
    return _merge(annotate(done, "text", ["row", "text", *(f.name for f in FIELDS)], FIELDS, lambda: _work(shared.value)))


def _merge(df: DataFrame) -> DataFrame:
    """Old results (inside ``row``) joined with those of a further block: items united, overlapping
    spans merged.  Hit words are counted again from the merged spans."""
    old, both = F.col("row"), F.sort_array(F.concat(F.col("row.spans"), F.col("spans")))
    merged = F.aggregate(
        both, F.array().cast(ArrayType(SPAN)),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, -1)["start"].alias("start"),
                                  F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = old["text"]
    inner = F.aggregate(F.col("merged"), F.lit(0).cast("long"),
                        lambda n, s: n + F.regexp_count(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.lit(word)))
    full = (df.withColumn("merged", merged).withColumn("inner", inner)
            .withColumn("united", F.array_sort(F.array_union(old["items"], F.col("items")))))
    return full.select(F.col("row.row").alias("row"), "n_words", F.col("inner").alias("n_hit"), F.col("united").alias("items"),
                       F.col("merged").alias("spans"), text.alias("text"))


def contaminated() -> Column:
    """The contamination rule on a result of ``decontaminate``: a hit, and a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
