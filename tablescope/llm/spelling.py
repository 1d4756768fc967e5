"""Spelling variant grouping by a frequency-vector trie.

The vocabulary's letters are dealt into groups of about equal weight.  A word's vector
holds how many of its letters fall into each group; a trie arranges the words by the
successive counts, so words of one vector share a leaf.  One inserted letter raises one count by
one, one deleted letter lowers one, a replaced letter does both or neither: a
depth-first search from the root may spend a surplus of one and a deficit of one, and
the words of the leaves it reaches are verified letter by letter.  Paths are followed
in arrays; a full array is split and its parts are searched one after the other.

The trie is cut below its first ``depth`` counts, the fewest with which no subtree has more than
``SUBTREE_WORDS`` words, so the cut grows with the vocabulary.  A word stands in one subtree and is
looked for in every subtree its first counts can reach within the budget; each task
searches one subtree and returns, for each word looked for, a number and its best find, not the pairs.

Forms have at least twice the frequency of their variants, so following them ends; the last
one is found by pointer doubling over written tables.

Defined results: null texts and texts without a run have no words; a null id counts as the
text ``null``; all occurrences count, also those of repeated rows; an empty table has no
words.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tablescope.llm import skew
from tablescope.llm.textkernel import FOLD_ASCII, _quoted, chunks, hash_spans
from tablescope.session import ship_package

LEAST_LETTERS = 5
LEAST_TIMES = 3
#: one of so many (document, run) pairs loses a letter
DROPPED_ONE_IN = 97
GROUPS = 12
SUBTREE_WORDS = 20_000
#: paths or word pairs that are held at once
AT_ONCE = 1 << 18
#: words up to this length are compared in arrays
SHORT = 64
#: leaf pairs with more word pairs than this are narrowed by equal halves
HALVES_FROM = 4096


# ---- words of the texts

def scan_runs(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, row, start, end) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF."""
    data = FOLD_ASCII[block.data]
    lead = data == 0xC3                       # the first byte of U+00C0 to U+00FF, and of nothing else
    inside = ((data >= 97) & (data <= 122)) | lead
    inside[1:] |= lead[:-1]
    opens_row = np.zeros(len(data) + 1, bool)
    opens_row[block.offsets] = True
    start = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | opens_row[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (~np.r_[inside[1:], False] | opens_row[1:])) + 1 if len(data) else start
    return data, np.searchsorted(block.offsets, start, side="right") - 1, start, end


#: fixed value: the reversed polynomial of crc32
CRC_POLYNOMIAL = np.uint32(0xEDB88320)


def _crc_steps(most: int) -> np.ndarray:
    """For each number of bytes appended, what each byte of a crc32 becomes (numbers x 4 x 256)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ CRC_POLYNOMIAL, table >> 1)
    out = np.zeros((most + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, most + 1):
        out[n] = out[n - 1] >> np.uint32(8) ^ table[out[n - 1] & np.uint32(0xFF)]
    return out


CRC_BYTES = 96
_steps: list[np.ndarray] = []


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of joined byte strings from the crc32 of the first, that of the second and its length (up to ``CRC_BYTES``)."""
    if not _steps:
        _steps.append(_crc_steps(CRC_BYTES))
    out = second.copy()
    for k in range(4):
        out ^= _steps[0][length, k, first >> np.uint32(8 * k) & np.uint32(0xFF)]
    return out


def count_block(block, ids: list) -> dict[str, int]:
    """Words of at least ``LEAST_LETTERS`` letters with their occurrences; a hash of id and run decides which run loses a letter."""
    data, row, start, end = scan_runs(block)
    # a word comes from a run of as many letters, or of one more
    long = end - start >= LEAST_LETTERS
    row, start, end = row[long], start[long], end[long]
    if not len(start):
        return {}
    _, first, back = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    runs = [raw[start[i]:end[i]] for i in first.tolist()]
    run_crc = np.array([zlib.crc32(r) for r in runs], np.uint32)
    run_bytes = np.array([len(r) for r in runs], np.int64)
    letters = np.array([len(r.decode("utf-8")) for r in runs], np.int64)
    prefix = [f"{'null' if i is None else i}:".encode() for i in ids]
    prefix_crc = np.array([zlib.crc32(p) for p in prefix], np.uint32)
    key, times = np.unique(row * len(runs) + back, return_counts=True)
    owner, run = key // len(runs), key % len(runs)
    h = joined_crc(prefix_crc[owner], run_crc[run], np.minimum(run_bytes[run], CRC_BYTES))
    for k in np.flatnonzero(run_bytes[run] > CRC_BYTES).tolist():
        h[k] = zlib.crc32(runs[run[k]], int(prefix_crc[owner[k]]))
    drops = h % np.uint32(DROPPED_ONE_IN) == 0
    n = np.bincount(run[~drops], times[~drops], len(runs)).astype(np.int64)
    out = {runs[i].decode("utf-8"): int(n[i]) for i in np.flatnonzero((n > 0) & (letters >= LEAST_LETTERS)).tolist()}
    for k in np.flatnonzero(drops & (letters[run] > LEAST_LETTERS)).tolist():
        word = runs[run[k]].decode("utf-8")
        at = int(h[k]) % len(word)
        word = word[:at] + word[at + 1:]
        out[word] = out.get(word, 0) + int(times[k])
    return out


def _count(batches):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for block in chunks(batch.column(1), 4 << 20):
            found = count_block(block, ids[block.first:block.first + block.rows])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): all words of ``least_times`` occurrences or more, as a written table."""
    ship_package(docs.sparkSession)
    counted = docs.select(docs[_quoted(doc_id)].cast("string").alias("id"), docs[_quoted(text)].alias("text")).mapInArrow(_count, "word string, n long")
    return skew.written(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times), "vocabulary")


# ---- the trie

def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of each code point up to U+00FF: letters by falling frequency, each into the lightest group so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()  # at most 256 rows
    weight, out = [0] * groups, np.zeros(256, np.int64)
    for letter, n in sorted(((r.letter, r["count"]) for r in letters if r.letter), key=lambda x: (-x[1], x[0])):
        lightest = min(range(groups), key=lambda g: (weight[g], g))
        out[ord(letter)] = lightest
        weight[lightest] += n
    return out


def vectors(words: list[bytes], group_of: np.ndarray, groups: int) -> np.ndarray:
    """Letter-group counts (words x groups) of words in Latin-1."""
    size = np.array([len(w) for w in words], np.int64)
    group = group_of[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), size)
    return np.bincount(owner * groups + group, minlength=len(words) * groups).reshape(len(words), groups).astype(np.int32)


class Trie:
    """Distinct vectors as a trie: a node of a level is (its parent, its count), kept in ascending order."""

    def __init__(self, leaves: np.ndarray):
        self.levels = []
        above = np.zeros(len(leaves), np.int64)
        for k in range(leaves.shape[1]):
            key = above << 32 | leaves[:, k]
            nodes, above = np.unique(key, return_inverse=True)
            self.levels.append(nodes)
        self.leaf_of = np.empty(len(leaves), np.int64)
        self.leaf_of[above] = np.arange(len(leaves))

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is such a child, the child)."""
        nodes, key = self.levels[level], node << 32 | count
        at = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
        return (nodes[at] == key) & (count >= 0), at

    def search(self, asked: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, at_once: int = AT_ONCE):
        """Yields (asked vector, leaf) arrays: all leaves within the given budgets of each asked vector."""
        stack = [(0, np.arange(len(asked)), np.zeros(len(asked), np.int64), surplus, deficit)]
        while stack:
            level, who, node, more, less = stack.pop()
            if len(who) > at_once:
                half = len(who) // 2
                stack += [(level, *(x[part] for x in (who, node, more, less))) for part in (slice(half, None), slice(half))]
                continue
            if level == len(self.levels):
                if len(who):
                    yield who, self.leaf_of[node]
                continue
            count, found = asked[who, level].astype(np.int64), []
            for step in (0, 1, -1):
                can = np.flatnonzero(more > 0) if step > 0 else np.flatnonzero(less > 0) if step < 0 else np.arange(len(who))
                there, child = self.child(level, node[can], count[can] + step)
                can, child = can[there], child[there]
                found.append((who[can], child, more[can] - (step > 0), less[can] - (step < 0)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found))))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter leads from a to b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[same + 1:] == b[same + 1:] if len(a) == len(b) else a[same:] == b[same + 1:]


class Words:
    """Words in Latin-1 as letter matrices, flush left and flush right."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        wide = int(min(self.size.max(initial=1), SHORT))
        self.left, self.right = (np.zeros((len(words), wide), np.uint8) for _ in range(2))
        short = np.flatnonzero(self.size <= wide)
        letters = np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)
        size = self.size[short]
        owner, place = np.repeat(short, size), np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
        self.left[owner, place] = letters
        self.right[owner, wide - self.size[owner] + place] = letters

    def near(self, other: "Words", i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words i of this set and j of the other are one edit apart."""
        out = np.zeros(len(i), bool)
        short = (self.size[i] <= SHORT) & (other.size[j] <= SHORT)
        wide = min(self.left.shape[1], other.left.shape[1])
        a, b = i[short], j[short]
        # letters that agree from the left and from the right, up to the first that does not
        size, size_b = self.size[a], other.size[b]
        least = np.minimum(size, size_b)
        differ = self.left[a, :wide] != other.left[b, :wide]
        front = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        differ = self.right[a, -wide:] != other.right[b, -wide:]
        back = np.where(differ.any(axis=1), differ[:, ::-1].argmax(axis=1), wide)
        front, back = np.minimum(front, least), np.minimum(back, least)
        apart = np.abs(size - size_b)
        out[short] = np.where(apart == 0, (front + back == least - 1) & (front < least), (apart == 1) & (front + back >= least))
        for k in np.flatnonzero(~short).tolist():
            out[k] = one_edit(self.words[i[k]], other.words[j[k]])
        return out


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def word_pairs(left: Words, right: Words, a_from, a_to, b_from, b_to, at_once: int = AT_ONCE):
    """Yields (i, j): the word pairs of leaf pairs that are given as index ranges of both sides.

    In a pair of large leaves only words with an equal first or last half meet (one edit
    leaves one of the halves as it is), each pair once.
    """
    na, nb = a_to - a_from, b_to - b_from
    product = na * nb
    small = np.flatnonzero(product < HALVES_FROM)
    ends = np.cumsum(product[small])
    k = 0
    while k < len(small):
        m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + at_once, side="right")))
        at = small[k:m]
        i = _ranges(a_from[at], na[at])
        many = np.repeat(nb[at], na[at])
        yield np.repeat(i, many), _ranges(np.repeat(b_from[at], na[at]), many)
        k = m
    for k in np.flatnonzero(product >= HALVES_FROM).tolist():
        first: dict[tuple, list[int]] = {}
        b_words = range(int(b_from[k]), int(b_to[k]))
        least = min(len(left.words[a_from[k]]), len(right.words[b_from[k]]))
        half = least // 2
        for j in b_words:
            w = right.words[j]
            for key in ((0, w[:half]), (1, w[len(w) - (least - half):])):
                first.setdefault(key, []).append(j)
        i_out, j_out = [], []
        for i in range(int(a_from[k]), int(a_to[k])):
            w = left.words[i]
            front, back = first.get((0, w[:half]), ()), first.get((1, w[len(w) - (least - half):]), ())
            met = set(front).union(back)
            i_out += [i] * len(met)
            j_out += met
            if len(i_out) >= at_once:
                yield np.array(i_out, np.int64), np.array(j_out, np.int64)
                i_out, j_out = [], []
        if i_out:
            yield np.array(i_out, np.int64), np.array(j_out, np.int64)


def search_subtree(words: list[bytes], n: np.ndarray, asked: list[bytes], group_of: np.ndarray, groups: int, depth: int):
    """Near words of ``asked`` among ``words`` (one subtree): (position in asked, number, best n, best word) in lists."""
    def by_vector(listed: list[bytes]):
        v = vectors(listed, group_of, groups)
        order = np.lexsort(v.T[::-1])
        v = v[order]
        opens = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]).any(axis=1)])
        return order, v[opens], opens, np.r_[opens[1:], len(listed)]

    order, leaves, leaf_from, leaf_to = by_vector(words)
    order_asked, wanted, asked_from, asked_to = by_vector(asked)
    right, left = Words([words[i] for i in order.tolist()]), Words([asked[i] for i in order_asked.tolist()])
    times = n[order]
    by_word = np.argsort(np.array([words[i] for i in order.tolist()], object), kind="stable")
    place = np.empty(len(words), np.int64)
    place[by_word] = np.arange(len(words))
    trie = Trie(leaves[:, depth:])
    step = leaves[0, :depth] - wanted[:, :depth]       # what reaching the subtree has spent
    surplus, deficit = 1 - np.maximum(step, 0).sum(axis=1), 1 - np.maximum(-step, 0).sum(axis=1)
    number = np.zeros(len(asked), np.int64)
    best = np.full(len(asked), -1, np.int64)           # position of the best word among the sorted words
    for who, leaf in trie.search(wanted[:, depth:], surplus, deficit):
        for i, j in word_pairs(left, right, asked_from[who], asked_to[who], leaf_from[leaf], leaf_to[leaf]):
            ok = left.near(right, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            number += np.bincount(i, minlength=len(asked))
            rank = np.lexsort((place[j], -times[j], i))
            i, j = i[rank], j[rank]
            first = np.r_[True, i[1:] != i[:-1]]
            i, j = i[first], j[first]
            had = best[i]
            better = (had < 0) | (times[j] > times[had]) | ((times[j] == times[had]) & (place[j] < place[had]))
            best[i[better]] = j[better]
    hit = np.flatnonzero(number)
    return order_asked[hit].tolist(), number[hit].tolist(), times[best[hit]].tolist(), [right.words[k] for k in best[hit].tolist()]


def reachable(prefix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, prefixes) within a surplus of one and a deficit of one of each row's first counts."""
    depth, every = prefix.shape[1], np.arange(len(prefix))
    out = [(every, prefix)]
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up == down:
                continue
            moved = prefix.copy()
            if up >= 0:
                moved[:, up] += 1
            rows = every
            if down >= 0:
                rows = np.flatnonzero(prefix[:, down] > 0)
                moved = moved[rows]
                moved[:, down] -= 1
            out.append((rows, moved))
    return out


def near_words(words: DataFrame, groups: int = GROUPS, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): for each word that has near words their number and the most frequent (then the first) of them."""
    spark = words.sparkSession
    ship_package(spark)
    group_of = letter_groups(words, groups)

    def vector_of(batches):
        for batch in batches:
            if batch.num_rows:
                v = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()], group_of, groups)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(v.astype(np.int32)), pa.list_(pa.int32()))], names=["word", "n", "vector"])

    laid = skew.written(words.select("word", "n").mapInArrow(vector_of, "word string, n long, vector array<int>"), "vectors")
    depth = 0
    while depth < groups:
        most = laid.groupBy(F.slice("vector", 1, depth)).count().agg(F.max("count")).first()[0] if depth else laid.count()
        if (most or 0) <= subtree_words:
            break
        depth += 1

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = np.array(batch.column(2).to_pylist(), np.int32).reshape(batch.num_rows, groups)[:, :depth]
            word, n = batch.column(0), batch.column(1)
            keys = lambda v: pa.array([r.tobytes() for r in np.ascontiguousarray(v)], pa.binary())
            names = ["key", "word", "n"]
            yield pa.RecordBatch.from_arrays([keys(prefix), word, n], names=names)
            for rows, moved in reachable(prefix):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([keys(moved), word.take(pa.array(rows)), pa.nulls(len(rows), pa.int64())], names=names)

    def search(table: pa.Table) -> pa.Table:
        stands = table.column("n").is_valid()
        here, looked = table.filter(stands), table.filter(pa.compute.invert(stands))
        none = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
        if not here.num_rows or not looked.num_rows:
            return none
        asked = looked.column("word").to_pylist()
        at, number, best_n, best = search_subtree([w.encode("latin-1") for w in here.column("word").to_pylist()], here.column("n").to_numpy(),
                                                  [w.encode("latin-1") for w in asked], group_of, groups, depth)
        return pa.table({"word": pa.array([asked[i] for i in at], pa.string()), "n_near": pa.array(number, pa.int64()),
                         "best_n": pa.array(best_n, pa.int64()), "best": pa.array([b.decode("latin-1") for b in best], pa.string())})

    found = (laid.mapInArrow(route, "key binary, word string, n long").groupBy("key")
             .applyInArrow(search, "word string, n_near long, best_n long, best string"))
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
            .select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best")))


# ---- forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word that following forms leads to, by pointer doubling."""
    at = skew.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = skew.written(skew.hot_join(at, ahead, "root", how="left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_times: int = LEAST_TIMES,
                      groups: int = GROUPS, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """One row per word: ``word``, ``form`` (its near word of largest ``n``, if that is at least twice its own), ``root`` (where
    following forms ends), ``n``, ``n_near`` and ``form_n``."""
    words = vocabulary(docs, text, doc_id, least_times)
    near = near_words(words, groups, subtree_words)
    has_form = F.col("best_n") >= 2 * F.col("n")
    known = skew.written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n")), "forms")
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
