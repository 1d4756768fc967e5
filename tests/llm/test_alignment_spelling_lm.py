"""Token alignment, spelling variants and language-model scores against brute force, and on odd rows."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescope.llm import blockcount, bloomlm, piecewise, registry, spelling, textkernel, tokenalign, tokencounts

SF = "/root/testdata/sf0.001"
FOLD = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " ", "  two  spaces ", "\n\ttabs and more", "a ▁ mark", "<|endoftext|> <s> <0x41>", "é ß ﬁ 😀 x", "\x00 nul", "x" * 3000, "ÀÉ× îÿ÷",
       "don't  we'll\r\n\r\n  ok", "ab\u0085cd  ef", "word", "word"]


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "r") for i, t in enumerate(ODD)] + [(None, "no id word word word", 2, None), (3, "  two  spaces ", 3, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_links int, row string").repartition(3)


# ---- alignment

def brute_groups(rows):
    a_path, b_path = tokenalign.byte_bpe_file(), piecewise.piece_model()
    a_model, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_model.encode_special_tokens = True
    model = tokenalign.Pair(a_path, b_path)
    out = []
    for _, t in rows:
        groups = []
        if t:
            raw = (" " + t).encode()
            sides = [a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)]
            ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in zip((model.a_bytes, model.b_bytes), sides)]
            if all(b"".join(x[i] for i in ids) == raw for x, ids in zip((model.a_bytes, model.b_bytes), sides)):
                before = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(tuple([i for i, e in zip(ids, at) if before < e <= cut] for ids, at in zip(sides, ends)))
                    before = cut
        out.append(groups)
    return out


def brute_alignment(rows):
    groups = brute_groups(rows)
    links = [[(a, b) for x, y in g for a in x for b in y] for g in groups]
    count = collections.Counter(p for each in links for p in set(each))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    told = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for g in groups]
    return [(sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(p), sum(count[q] == best[q[0]] for q in p), sum(count[q] for q in p), t)
            for g, p, t in zip(groups, links, told)]


def test_alignment_equals_brute_force(spark, texts):
    texts = texts[:60]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.row.doc_id: tuple(r)[1:] for r in tokenalign.align_tokens(docs, tokenalign.byte_bpe_file(), piecewise.piece_model()).collect()}
    assert got == {i: w for (i, _), w in zip(texts, brute_alignment(texts))}


def test_alignment_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = tokenalign.align_tokens(odd, tokenalign.byte_bpe_file(), piecewise.piece_model()).collect()
    want = brute_alignment(rows)
    assert sorted((str(r.row.text), *tuple(r)[1:]) for r in got) == sorted((str(t), *w) for (_, t), w in zip(rows, want))
    assert sum(not w[0] for w in want) >= 3                      # null, empty, and a text with the mark itself
    assert tokenalign.align_tokens(odd.limit(0), tokenalign.byte_bpe_file(), piecewise.piece_model()).count() == 0


def test_alignment_query_derives_the_digest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.row.doc_id: r.groups for r in tokenalign.align_tokens(docs, tokenalign.byte_bpe_file(), piecewise.piece_model(), keep=["doc_id"]).collect()}
    for r in registry.op11_token_alignment(spark, SF).collect():
        assert r.groups_sha256 == (hashlib.sha256(told[r.doc_id].encode()).hexdigest() if told[r.doc_id] else "")


def test_pointers_double_to_the_terminals():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 400):
        ends = [np.unique(np.r_[rng.choice(np.arange(1, 4 * n), n), 4 * n]) for _ in range(2)]
        a, b = tokenalign.group_labels(*ends)
        cuts = np.intersect1d(*ends)
        assert a.tolist() == np.searchsorted(cuts, ends[0]).tolist() and b.tolist() == np.searchsorted(cuts, ends[1]).tolist()


# ---- spelling variants

def brute_spelling(rows):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        edits = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in letters} | \
                {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        near[w] = (edits & set(words)) - {w}
    best = {w: min(x, key=lambda v: (-words[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("subtree", [20_000, 40])
def test_spelling_variants_equal_brute_force(spark, texts, subtree):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = spelling.spelling_variants(docs, subtree_words=subtree)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == brute_spelling(texts)


def test_spelling_of_odd_rows_long_words_and_chains(spark, odd):
    long = "abcdefghij" * 9
    chain = [("chaina", 3), ("chainab", 6), ("chainabc", 13), ("chainabcd", 30), (long, 3), (long[:40] + long[41:], 9), ("anagram", 3), ("nagaram", 3)]
    rows = [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    rows = [(i, t) for i, t in rows if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in t.split())]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    assert got == brute_spelling([(r.doc_id, r.text) for r in docs.collect()])
    assert any(word == "chaina" and root == "chainabcd" for word, _, root, *_ in got)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_large_leaves_meet_by_halves():
    rng = np.random.default_rng(2)
    words = sorted({bytes(rng.permutation(list(b"abcdefg"))) for _ in range(300)})
    swapped = sorted({bytes(rng.permutation(list(b"abcdefh"))) for _ in range(300)})
    left, right = spelling.Words(words), spelling.Words(swapped)
    bounds = [np.array([x]) for x in (0, len(words), 0, len(swapped))]
    found = set()
    for i, j in spelling.word_pairs(left, right, *bounds, at_once=500):
        ok = left.near(right, i, j)
        found |= set(zip(i[ok].tolist(), j[ok].tolist()))
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(swapped) if spelling.one_edit(a, b)}


def test_joined_crc_is_the_crc_of_the_joined():
    rng = np.random.default_rng(1)
    parts = [(rng.bytes(rng.integers(0, 20)), rng.bytes(rng.integers(0, 90))) for _ in range(200)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in parts], np.uint32)
    assert spelling.joined_crc(crc(0), crc(1), np.array([len(b) for _, b in parts])).tolist() == [zlib.crc32(a + b) for a, b in parts]


# ---- language model

def brute_scores(rows):
    said = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [None]) for i, t in rows]
    trains = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in said]
    word, pair = collections.Counter(), collections.Counter()
    for (_, w), t in zip(said, trains):
        if t:
            word.update(w)
            pair.update(zip([0, *w], w))
    n, v = sum(word.values()), len(word)
    out = []
    for i, w in said:
        alone = [(word[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        behind = [sum(trains) if u == 0 else word[u] for u in [0, *w[:-1]]]
        exact = sum(math.log10((pair[u, x] + bloomlm.MU * p) / (b + bloomlm.MU)) for u, x, p, b in zip([0, *w], w, alone, behind))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(word[x] > 0 for x in w), n, sum(map(math.log10, alone)), exact))
    return out


def _check_scores(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    return np.array([g[6] for g in got]), np.array([w[6] for w in want]), np.array([w[2] for w in want])


def test_scores_equal_brute_force_in_both_ways(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    columns = ["row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    here = bloomlm.score_texts(docs, keep=["doc_id"]).select(*columns).collect()
    dealt = bloomlm.score_texts(docs, keep=["doc_id"], broadcast_bytes=0).select(*columns).collect()
    assert np.allclose(sorted(r.score for r in here), sorted(r.score for r in dealt))
    score, exact, tokens = _check_scores(here, brute_scores(texts))
    base = np.array([w[5] for w in sorted(brute_scores(texts), key=str)])
    # quantised down by a quarter at most; wrong hits lift single words
    assert (np.abs(score - exact) <= 0.12 * tokens + 8).all() and score.sum() > base.sum()


def test_scores_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = bloomlm.score_texts(odd).select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    _check_scores(got, brute_scores(rows))
    assert bloomlm.score_texts(odd.limit(0)).count() == 0
    alone = bloomlm.score_texts(odd.where("doc_id is null")).collect()        # no training row at all
    assert [r.train_tokens for r in alone] == [0] and alone[0].base_score == 0 and not alone[0].held_out


def test_filter_never_misses_and_seldom_invents():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 1 << 32, 60_000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(keys)) ** 2
    words = bloomlm.build_segment(keys[::2], counts[::2])
    held = bloomlm.Filter(words, np.array([0, len(words)]))
    none = np.zeros(len(keys[::2]), np.int64)
    level = held.levels(keys[::2], none)
    right = bloomlm.level_of(counts[::2])
    assert (level >= right).all() and (level == right).mean() > 0.97
    assert (held.levels(keys[1::2], none[:len(keys[1::2])]) > 0).mean() < 0.03
    assert (bloomlm.least_count(right) <= counts[::2]).all() and (bloomlm.most_count(right) >= counts[::2]).all()


def test_counts_of_small_blocks_are_dealt_together():
    """A segment gets one piece of many blocks, not one of each, with the same counts."""
    texts = [[f"the w{i % 900} the w{i % 7} x{i}" for i in range(k, 200_000, 5)] for k in range(5)]
    batches = [pa.RecordBatch.from_arrays([pa.array(t)], names=["text"]) for t in texts]
    segments = 40
    made = pa.Table.from_batches(bloomlm._grams(segments)(batches))
    blocks = [b for t in batches for b in textkernel.chunks(t.column(0), bloomlm.BLOCK)]
    assert len(blocks) > 4 and made.num_rows <= 2 * segments
    tokens = [bloomlm.Tokens(b) for b in blocks]
    keys, counts = np.unique(np.concatenate([t.key for t in tokens]), return_counts=True)
    assert counts.max() > 255
    part = bloomlm.segment_of(keys, segments)
    for i in range(segments):
        one = bloomlm._build(made.filter(pc.equal(made.column("part"), i)))
        assert one.column("words").to_pylist() == [int((part == i).sum())] and one.column("tokens").to_pylist() == [int(counts[part == i].sum())]
        words = np.frombuffer(one.column("bits")[0].as_buffer(), np.uint64)
        level = bloomlm.Filter(words, np.array([0, len(words)])).levels(keys[part == i])
        right = bloomlm.level_of(counts[part == i])
        assert (level >= right).all() and (level == right).mean() > 0.95


def test_a_segment_answers_all_its_pieces_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 32, 30_000, dtype=np.uint64))
    words = bloomlm.build_segment(keys, rng.geometric(0.3, len(keys)) ** 2)
    bounds = np.r_[0, np.sort(rng.integers(0, len(keys), 499)), len(keys)]      # some pieces are empty
    left = pa.table({"block": np.arange(500), "part": pa.array([3] * 500, pa.int32()), "keys": blockcount.cells_of(bloomlm.sent(keys), bounds)})
    right = pa.table({"part": pa.array([3], pa.int32()), "bits": pa.array([words.tobytes()], pa.binary())})
    levels, calls = bloomlm.Filter.levels, []
    monkeypatch.setattr(bloomlm.Filter, "levels", lambda self, k, *more: calls.append(len(k)) or levels(self, k, *more))
    monkeypatch.setattr(bloomlm, "PROBE_KEYS", 10_000)
    got = bloomlm._probe(pa.concat_tables([left.slice(0, 200), left.slice(200)]), right)
    assert len(calls) <= 3 and sum(calls) == len(keys)
    one = bloomlm.Filter(words, np.array([0, len(words)]))
    assert got.column("counts").to_pylist() == [levels(one, keys[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got.column("block").to_pylist() == list(range(500)) and set(got.column("part").to_pylist()) == {3}


# ---- rollups and the pipeline's clashes

def test_rollup_ids_are_no_path_patterns_and_compaction_survives(spark):
    rollup = tokencounts.Rollup(spark)
    load = spark.createDataFrame([("a", "en", "1", "insert", 10)], "source string, lang string, tokenizer string, kind string, tokens long")
    ids = ["2024-01", "2024-0?", "*", "[x]", "{a,b}", "%41", "a:b", "a/b", "é"]
    assert all(rollup.commit(i, load) for i in ids) and rollup.committed() == sorted(ids)
    tell = lambda: [(r.documents, r.tokens) for r in tokencounts.Rollup(spark, rollup.path).totals().collect()]
    assert tell() == [(len(ids), 10 * len(ids))]
    rollup.compact("one")
    assert tell() == [(len(ids), 10 * len(ids))] and not rollup.commit("*", load)
    assert rollup.commit("later", load) and tell() == [(len(ids) + 1, 10 * len(ids) + 10)]
    tokencounts.Rollup(spark, rollup.path).compact("two").compact("two")
    assert tell() == [(len(ids) + 1, 10 * len(ids) + 10)] and not rollup.commit("later", load)
    spark.createDataFrame([("batch", "2024-01")], "kind string, id string").write.parquet(rollup._folder("broken", "ids"))  # broke off before its sums
    assert tell() == [(len(ids) + 1, 10 * len(ids) + 10)]


def test_token_ledger_of_odd_rows(spark, odd):
    make = lambda: (lambda t: t.split())
    docs = odd.withColumn("source", F.lit("s")).withColumn("lang", F.lit(None).cast("string"))
    rows = tokencounts.count_ledger(docs, make, "words of a test").collect()
    assert sorted(str(r.tokens) for r in rows) == sorted(str(None if r.text is None else len(r.text.split())) for r in odd.collect())
    assert tokencounts.count_ledger(docs.limit(0), make, "words of a test").count() == 0


def test_pipeline_stages_with_clashing_names_and_no_rows(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name in ("redacted", "piece_ids", "lossless", "n_pieces", "row", "score"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES[2:]:
        out = stage(spark, docs, SF)
        assert len(set(out.columns)) == len(out.columns) and out.count() <= 40
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns
