"""Near-duplicate classes with DartMinHash signatures and banded joining.

The weight of a word shingle is how often the text has it; similarity is the
weighted Jaccard similarity (sum of least weights over sum of greatest), five
words a shingle, 0.8 or more a link.  A class is a connected component of links.

Signature.  Over every shingle stands its weight axis, cut into the regions
[0,1), [1,2), [2,4), ...  Into each region darts fall as a Poisson process over
rank, all drawn from hashes of (shingle, region, number of the dart): a dart has
a rank, a height and one of ``k`` coordinates.  A text owns the darts below the
weights of its shingles; per coordinate the earliest dart counts.  Darts are
thrown up to rank (k ln k + 3k) / total weight, twice as far for the rare texts
with an empty coordinate.  Two texts agree in a coordinate with probability equal
to their similarity.

Joining.  ``BANDS`` bands of ``ROWS`` coordinates put texts into buckets.  A bucket's pivot
is its most central text, the one with the most bucket neighbours in all.  Every text is
compared exactly with the pivots of its buckets.  Two texts of one bucket are both
attached to its pivot, so what is left lies inside the families of the pivots: texts
that failed against their pivot are compared exactly with all texts of the family, in
blocks of at most ``BLOCK_TEXTS`` by ``BLOCK_TEXTS`` texts, which report a spanning
forest of their links, never pairs.  So no link between texts that share a bucket is lost.  At
similarity 0.8 a pair shares no bucket with probability (1 - 0.8^6)^40 = 5e-6.

Equal texts are one node (the MD5 digest of the text) from the start.

Defined results: a null text is a class of its own row; empty and wordless texts
are linked only with equal texts; a text of fewer than five words is one shingle
of all its words; equal rows share a class; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tablescope.llm.skew import components, maybe_in, written
from tablescope.llm.textkernel import ALNUM_WORDS, Block, chunks, give_back, mix64, scan_words, windows, annotate

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
BLOCK = 1 << 20
BLOCK_TEXTS = 96


def shingle_counts(block: Block, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), ordered by row and hash."""
    words = scan_words(block, ALNUM_WORDS)
    h, first = windows(words.hash, words.row, width)
    row = words.row[first]
    size = np.bincount(words.row, minlength=block.rows)
    for n in range(1, width):
        use = np.flatnonzero(size[words.row] == n) if len(words.row) else np.zeros(0, np.int64)
        if len(use):
            short, at = windows(words.hash[use], words.row[use], n)
            h, row = np.concatenate([h, short]), np.concatenate([row, words.row[use][at]])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    opens = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return row[opens], h[opens], np.diff(np.r_[opens, len(h)])


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows x k) of weighted sets given as (row, element, weight), and which rows have one."""
    signature = np.zeros((rows, k), np.uint64)
    total = np.bincount(row, weights=weight, minlength=rows)
    filled = total > 0
    # regions of the weight axis: [0,1), then [2^(j-1), 2^j) for j >= 1
    regions = np.where(weight > 1, 1 + np.ceil(np.log2(np.maximum(weight, 1))), 1).astype(np.int64)
    at = np.repeat(np.arange(len(row)), regions)
    j = np.arange(len(at)) - np.repeat(np.cumsum(regions) - regions, regions)
    height = np.where(j == 0, 1.0, 2.0 ** (j - 1))
    floor = np.where(j == 0, 0.0, height)
    key = mix64(element[at] + mix64(j.astype(np.uint64) + np.uint64(0x51ED270B)))
    owner, top = row[at], weight[at].astype(float)
    todo = filled.copy()
    reach = np.zeros(rows)
    reach[filled] = (k * np.log(k) + 3 * k) / total[filled]
    while todo.any():
        use = np.flatnonzero(todo[owner])
        rank, seed, cells, ranks, darts, number = np.zeros(len(use)), key[use], [], [], [], 0
        while len(use):
            number += 1
            draw = mix64(seed + np.uint64((number * 0x9E3779B97F4A7C15) % (1 << 64)))
            rank = rank - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / height[use]
            near = rank < reach[owner[use]]
            use, rank, seed, draw = use[near], rank[near], seed[near], draw[near]
            dart = mix64(draw ^ np.uint64(0xA5A5A5A55A5A5A5A))
            at_height = floor[use] + height[use] * ((mix64(dart) >> np.uint64(11)).astype(float) * 2.0 ** -53)
            below = at_height < top[use]
            cell = ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            cells.append(owner[use[below]] * k + cell[below])
            ranks.append(rank[below])
            darts.append(dart[below])
        cell, rank, dart = np.concatenate(cells), np.concatenate(ranks), np.concatenate(darts)
        best = np.full(rows * k, np.inf)
        np.minimum.at(best, cell, rank)
        first = rank == best[cell]
        whole = np.isfinite(best.reshape(rows, k)).all(axis=1) & todo
        flat = np.zeros(rows * k, np.uint64)
        flat[cell[first]] = dart[first]
        signature[whole] = flat.reshape(rows, k)[whole]
        todo &= ~whole
        reach[todo] *= 2
    return signature, filled


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band number is part of the key."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signature), bands)).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + signature[:, r:bands * rows:rows])
    return key


def _sketch(bands: int, rows: int, width: int):
    def run(column: pa.Array) -> list[pa.Array]:
        keys, sizes = [], []
        for block in chunks(column, BLOCK):
            row, h, weight = shingle_counts(block, width)
            signature, filled = dart_signatures(row, h, weight, block.rows, bands * rows)
            keys.append(band_keys(signature, bands, rows)[filled].ravel())
            sizes.append(np.where(filled, bands, 0))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))]
    return run


def similarities(a: pa.Array, b: pa.Array, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Exact weighted Jaccard similarity of the texts of each row."""
    a, b = a.cast(pa.large_string()), b.cast(pa.large_string())
    out = np.zeros(len(a))
    size = np.cumsum(pa.compute.binary_length(a).to_numpy() + pa.compute.binary_length(b).to_numpy())
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BLOCK, side="right")))
        n = j - i
        pair = pa.concat_arrays([a.slice(i, n), b.slice(i, n)])
        for block in chunks(pair, 1 << 62):
            row, h, weight = shingle_counts(block, width)
            side, row = row >= n, row % n
            total = np.bincount(row, weights=weight, minlength=n)
            order = np.lexsort((side, h, row))
            row, h, weight = row[order], h[order], weight[order]
            same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
            least = np.bincount(row[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=n)
            out[i:j] = np.where(total > 0, least / np.maximum(total - least, 1e-9), 0)
        i = j
    return out


def _compare(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``pairs`` (a, b) with the exact similarity of their texts.  ``b`` may be the pivot of very many
    pairs: the last join has two plain shuffles, of which Spark splits a skewed one."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarities(batch.column(2), batch.column(3), width))],
                                             names=["a", "b", "similarity"])
        give_back()

    return both.mapInArrow(run, StructType([both.schema["a"], both.schema["b"], StructField("similarity", DoubleType())]))


def cross_similarities(texts: pa.Array, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Exact similarities of the rows ``left`` with the rows ``right`` (a matrix)."""
    rows, hashes, weights = [], [], []
    for block in chunks(texts, BLOCK):
        row, h, weight = shingle_counts(block, width)
        rows.append(row + block.first), hashes.append(h), weights.append(weight)
    row, h, weight = np.concatenate(rows), np.concatenate(hashes), np.concatenate(weights)
    total = np.bincount(row, weights=weight, minlength=len(texts))
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    common = np.zeros((len(left), len(right)), np.float32)
    use = times[column] > 1  # a shingle of one text is common to none
    place_left, place_right = np.full(len(texts), -1), np.full(len(texts), -1)
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    row, column, weight = row[use], column[use], weight[use]
    steps = np.unique(weight)
    for step, below in zip(steps, np.r_[0, steps[:-1]]):  # min(u, v) as a sum over the weights both reach
        some = np.flatnonzero(weight >= step)
        names, at = np.unique(column[some], return_inverse=True)
        order = np.argsort(at, kind="stable")
        some, at = some[order], at[order]
        for first in range(0, len(names), 16_384):
            a, b = np.searchsorted(at, [first, first + 16_384])
            r, c = row[some[a:b]], at[a:b] - first
            one, two = np.zeros((len(left), 16_384), np.float32), np.zeros((len(right), 16_384), np.float32)
            in_left, in_right = place_left[r] >= 0, place_right[r] >= 0
            one[place_left[r[in_left]], c[in_left]] = 1
            two[place_right[r[in_right]], c[in_right]] = 1
            common += np.float32(step - below) * (one @ two.T)
    whole = total[left][:, None] + total[right][None, :] - common
    return np.where(whole > 0, common / np.maximum(whole, 1e-9), 0)


def _forest(width: int, similarity: float):
    """Links of one block of a family: a spanning forest of the strays' links with the members."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        give_back()
        texts = table.column("text").combine_chunks()
        stray = table.column("stray").to_numpy(zero_copy_only=False).astype(bool)
        nodes = table.column("node").to_pylist()
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        if not len(left) or not len(right):
            return schema.empty_table()
        # the exact sums are whole numbers below 2^24, the tolerance is for their ratio
        linked = np.argwhere(cross_similarities(texts, left, right, width) >= similarity - 1e-7)
        root = {n: n for n in nodes}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in linked.tolist():
            a, b = nodes[left[i]], nodes[right[j]]
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
                out.append((a, b))
        return pa.table([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], schema=schema)
    return run


def _family_links(compared: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links of texts that failed against their pivot with the other texts attached to it."""
    marked = compared.select(F.col("b").alias("pivot"), F.col("a").alias("node"), (F.col("similarity") < similarity).alias("failed"))
    sizes = (marked.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.count_if("failed").alias("strays"))
             .where("members > 1 and strays > 0")
             .select("pivot", F.ceil(F.col("members") / BLOCK_TEXTS).cast("int").alias("across"), F.ceil(F.col("strays") / BLOCK_TEXTS).cast("int").alias("down")))
    families = marked.join(written(sizes, "families"), "pivot")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    members = families.select("pivot", "node", F.lit(False).alias("stray"), numbers("down").alias("i"), spot("across").alias("j"))
    strays = families.where("failed").select("pivot", "node", F.lit(True).alias("stray"), spot("down").alias("i"), numbers("across").alias("j"))
    block = F.xxhash64("pivot", "i", "j").alias("block")
    dealt = written(members.unionByName(strays).select(block, "node", "stray"), "blocks")
    return dealt.join(texts, "node").groupBy("block").applyInArrow(_forest(width, similarity), "a binary, b binary")


def link_texts(docs: DataFrame, text: str, node: str, width: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """Links (a, b) between different texts: enough of them to connect every class."""
    sketched = annotate(docs.where(F.col(text).isNotNull()), text, [node], [StructField("keys", ArrayType(LongType()))],
                        lambda: _sketch(bands, rows, width))
    once = (sketched.select(F.col("row")[node].alias("node"), "keys").where(F.size("keys") > 0)
            .groupBy("node").agg(F.first("keys").alias("keys")))
    members = written(once.select("node", F.explode("keys").alias("bucket")), "members")
    buckets = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "buckets")
    together = written(members.join(buckets, "bucket"), "together")
    central = together.groupBy("node").agg(F.sum("texts").alias("degree"))
    ranked = written(together.join(central, "node").select("bucket", "node", "degree"), "ranked")
    pivots = written(ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top")).select("bucket", F.col("top.node").alias("pivot")), "pivots")
    pairs = ranked.join(pivots, "bucket").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    # the texts in pivot pairs are all that is ever compared
    met = pairs.select(F.xxhash64("a").alias("key")).unionByName(pairs.select(F.xxhash64("b").alias("key")))
    test = maybe_in(met, 2 * pairs.count())
    texts = (docs.select(F.col(node).alias("node"), F.col(text).alias("text")).where(F.col("text").isNotNull())
             .where(test(F.xxhash64("node"))).groupBy("node").agg(F.first("text").alias("text")))
    texts = written(texts, "texts")
    compared = written(_compare(pairs, texts, width), "compared")
    links = compared.where(F.col("similarity") >= similarity).select("a", "b")
    return written(links.unionByName(_family_links(compared, texts, width, similarity)), "links")


def _placed(source: DataFrame, width: int, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, part) for every document, and the classes of several documents."""
    links = link_texts(source, "text", "node", width, similarity, bands, rows)
    parts = components(links)
    ids = written(source.select("doc_id", "node"), "ids")
    placed = written(ids.join(parts, "node", "left").select("doc_id", "node", F.coalesce("part", "node").alias("part")), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    classes = (placed.where("part is not null").groupBy("part").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
                  .where("class_size > 1")
                  .select("part", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("class_node"), "class_size"))
    return placed, written(classes, "classes")


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.unhex(F.md5(docs[text])).alias("node"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS,
                    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (least id of its class) and ``class_size``
    (documents in it)."""
    placed, classes = _placed(_source(docs, doc_id, text), width, similarity, bands, rows)
    return (placed.join(classes, "part", "left")
            .select("doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).alias("class_size")))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS,
                similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one document of each class: the one with the least id (null ids last; of equal
    ids the least digest; of rows equal in both, one).  Null texts all stay.

    Documents that surely are in no class of several, by a Bloom filter over those that
    are, are not shuffled.
    """
    placed, classes = _placed(_source(docs, doc_id, text), width, similarity, bands, rows)
    mark = F.xxhash64("doc_id", "node")
    grouped = placed.join(classes, "part")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))
    decided = written(grouped.select(F.col("doc_id").alias("d"), F.col("node").alias("n"), mark.alias("mark"), stays.alias("stays")).distinct(), "decided")
    test = maybe_in(decided.select("mark"), decided.count())
    row = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row")
    tagged = docs.select(row, docs[doc_id].alias("doc_id"), F.unhex(F.md5(docs[text])).alias("node")).withColumn("mark", mark)
    tagged = tagged.withColumn("maybe", test(F.col("mark")))
    others = tagged.where("maybe").join(decided, (tagged["mark"] == decided["mark"]) & (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    single = others.where(F.col("stays").isNull()).select("row.*")
    kept = (others.where("stays").groupBy("d", "n").agg(F.first("row").alias("row")).select("row.*"))
    return tagged.where(~F.col("maybe")).select("row.*").unionByName(single).unionByName(kept)
