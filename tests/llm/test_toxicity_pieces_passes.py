"""Whole-job checks of corpus operators: each of them failed before its finding was settled."""
import numpy as np
import pytest

from tablescope.llm import decontaminate, piecewise, registry, toxicity

SF = "/root/testdata/sf0.001"


# ---- toxicity

def _counts(rng, words):
    word = np.unique(rng.integers(1, 1 << 63, words, dtype=np.uint64))
    six = rng.integers(0, words // 8, len(word)).astype(np.uint64) << np.uint64(9)
    return word, six, np.stack([rng.geometric(0.6, len(word)) - 1, rng.geometric(0.3, len(word)) - 1]).astype(np.int64)


def test_toxicity_discounts_lie_under_one_and_mass_is_whole():
    _, _, counts = _counts(np.random.default_rng(3), 4000)
    d = toxicity.discounts(counts)
    assert (0 < d).all() and (d < 1).all()
    for k in (0, 1):
        assert d[k] == (counts[k] == 1).sum() / ((counts[k] == 1).sum() + 2 * (counts[k] == 2).sum())
    both = counts.sum(axis=0) / counts.sum()
    p, mass = toxicity.probabilities(counts, both)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(mass[:, 0], d * (counts > 0).sum(axis=1) / counts.sum(axis=1))


def test_toxicity_keeps_a_rare_word_in_a_fixed_phrase():
    word, six, counts = _counts(np.random.default_rng(4), 4000)
    counts[:, 7] = 3, 0                              # three left neighbours, as many as a fixed phrase has
    model = toxicity.build_model(word, six, counts)
    known, prefix_only = model.ratios(word[[7]], six[[7]])[0, 0], model.ratios(np.array([0], np.uint64), six[[7]])[0, 0]
    assert known > toxicity.MARGIN and known > prefix_only


def test_toxicity_words_never_share_an_entry():
    word, six, counts = _counts(np.random.default_rng(5), 3_000_000)   # more than 2 ** 20 words
    some = counts.any(axis=0)
    word, six, counts = word[some], six[some], counts[:, some]
    model = toxicity.build_model(word, six, counts)
    assert len(model.word[0]) == len(word)
    some = np.random.default_rng(6).permutation(len(word))[:200]
    six_keys, at = np.unique(six, return_inverse=True)
    sums = np.stack([np.bincount(at, c) for c in counts])
    four_keys, four_at = np.unique(toxicity.first_four(six_keys), return_inverse=True)
    fours = np.stack([np.bincount(four_at, c) for c in sums])
    p = toxicity.probabilities(fours, fours.sum(axis=0) / fours.sum())[0]
    p = toxicity.probabilities(sums, p[:, four_at] * sums.sum(axis=0) / fours.sum(axis=0)[four_at])[0]
    p = toxicity.probabilities(counts, p[:, at] * counts.sum(axis=0) / sums.sum(axis=0)[at])[0]
    assert np.allclose(model.ratios(word[some], six[some])[:, 0], np.log(p[0] / p[1])[some], rtol=1e-4, atol=1e-4)


def test_toxicity_backs_off_by_literal_prefix():
    from tablescope.llm.textkernel import chunks
    import pyarrow as pa
    block = next(chunks(pa.array(["Abcdefgh abcdefxy abcdzz ab"])))
    _, word, six, left = toxicity.expressions(block)
    as_bytes = [int(s).to_bytes(6, "big") for s in six]
    assert as_bytes == [b"abcdef", b"abcdef", b"abcdzz", b"ab\0\0\0\0"] and len(set(word.tolist())) == 4
    assert toxicity.first_four(six)[0] == toxicity.first_four(six)[2] and left[0] == 0 and left[1] == word[0]


# ---- decontamination

def test_registered_decontamination_in_several_passes(spark, monkeypatch):
    one = {tuple(r) for r in registry.op2_decontamination(spark, SF).collect()}
    whole, passes = decontaminate.decontaminate, []
    texts = [len(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    monkeypatch.setattr(decontaminate.skew, "written", lambda df, name, f=decontaminate.skew.written: passes.append(name) or f(df, name))
    monkeypatch.setattr(decontaminate, "decontaminate", lambda *a, **b: whole(*a, phrase_bytes=sum(texts) // 3, **b))
    assert {tuple(r) for r in registry.op2_decontamination(spark, SF).collect()} == one
    assert len(passes) >= 2


# ---- pieces

def _occurrences(word, texts, each, dropout=0.1):
    """Piece ids of every occurrence of a word in texts that differ in their first word."""
    import public_tokenizers
    import pyarrow as pa
    model = piecewise.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for block in piecewise.chunks(pa.array([f"{i}" + f" {word}" * each for i in range(texts)])):
        ids, at = piecewise.encode_block(model, block, 17, dropout, piecewise.UnitCache())
        for i in range(block.rows):
            found = []
            for k in ids[at[i]:at[i + 1]].tolist():
                if model.bytes_of[k].startswith(b" "):
                    found.append([])
                found[-1].append(k)
            out += [tuple(f) for f in found[1:]]
    return out


@pytest.mark.parametrize("word", ["a", "I"])
def test_a_word_of_one_merge_is_split_at_the_dropout_rate(word):
    got = _occurrences(word, 40, 200)
    assert len(got) == 8000 and abs(np.mean([len(g) > 1 for g in got]) - 0.1) < 0.015


def test_a_hot_word_has_many_segmentations_in_and_across_texts():
    assert len(set(_occurrences("international", 1, 2000, 0.3))) > 20
    assert len(set(_occurrences("international", 2000, 1, 0.3))) > 20


def _labelled(spark, odd_docs):
    """Toxic and ordinary documents with words of both, shared prefixes and odd rows among them; ids of all remainders."""
    mean, kind = ["idiot", "idiotic", "scumbag", "loser", "trash"], ["garden", "gardens", "river", "window", "teacher"]
    common = [f"common{i}" for i in range(12)]
    rows = []
    for i in range(240):
        words = mean if i % 3 == 0 else kind
        body = [w for k in range(9) for w in (common[(i * 5 + k * 7) % 12], words[(i + k * k) % 5])]
        rows.append((1000 + i, " ".join(body) + f" only{i % 37}", "en", "s", None, 7, "r"))
    docs = odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema))
    labels = spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(240)] + [(0, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_models_as_tables_score_like_broadcast_ones(spark, odd_docs):
    docs, labels = _labelled(spark, odd_docs)

    def scores(**how):
        got = toxicity.score_toxicity(docs, labels, **how).select("row.doc_id", "n_words", "held_out", "score", "predicted").collect()
        return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0))

    here, joined = scores(), scores(broadcast_words=0)
    assert len(here) == len(joined) == docs.count()
    for a, b in zip(here, joined):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-5 and a[4] == b[4]
    assert {r[4] for r in here if r[0] and r[0] >= 1000 and (r[0] - 1000) % 3 == 0} == {1}


def test_toxicity_tables_hold_the_ratios_of_the_model(spark):
    from tablescope.llm import toxicwords
    words = [("a", "idiot", 9, 1), ("b", "idioti", 3, 0), ("c", "idioti", 1, 2), ("d", "garden", 0, 7), ("e", "garage", 2, 2), ("f", "river", 1, 12)]
    code = lambda t: int.from_bytes(t.encode().ljust(6, b"\0"), "big")
    counted = spark.createDataFrame([(ord(w), code(s), t, o) for w, s, t, o in words], "word long, six long, toxic long, ordinary long")
    model = toxicity.build_model(np.array([ord(w[0]) for w in words], np.uint64), np.array([code(w[1]) for w in words], np.uint64),
                                 np.array([[w[2] for w in words], [w[3] for w in words]]))
    asked = [*words, ("z", "idioti"), ("y", "idiom"), ("x", "garnet"), ("w", "unseen")]
    vocabulary = spark.createDataFrame([(ord(w[0]), code(w[1])) for w in asked], "word long, six long")
    got = {r.word: (r.ratio, r.sure) for r in toxicwords.resolved(vocabulary, toxicwords.ratio_tables(counted, "toxic", "ordinary")).collect()}
    want = model.ratios(np.array([ord(w[0]) for w in asked], np.uint64), np.array([code(w[1]) for w in asked], np.uint64))
    for w, pair in zip(asked, want):
        assert np.allclose(got[ord(w[0])], pair, atol=1e-5), w


def test_toxicity_by_tables_on_missing_classes_and_empty_input(spark, odd_docs, empty_docs):
    one_class = spark.createDataFrame([(0, 1), (5, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd_docs, one_class, broadcast_words=0).collect()
    assert len(got) == odd_docs.count() and {r.score for r in got} == {0.0}
    assert toxicity.score_toxicity(empty_docs, one_class, broadcast_words=0).collect() == []
