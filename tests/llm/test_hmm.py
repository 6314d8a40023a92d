"""The hidden Markov language model next to sums over all paths and plain counts."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.llm import hmm
from hourloom.llm.base import fold_of
from hourloom.llm.queries import op11_hidden_markov_lm


def learn():
    return F.coalesce(fold_of("doc_id", 7) != 2, F.lit(True))


def some_chain(symbols, states, seed=1):
    rng = np.random.default_rng(seed)
    emit, move, start = rng.random((symbols, states)), rng.random((states, states)), rng.random(states)
    return hmm.Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(chain, text):
    for path in itertools.product(range(len(chain.start)), repeat=len(text)):
        p = chain.start[path[0]] * chain.emit[text[0], path[0]]
        for t in range(1, len(text)):
            p *= chain.move[path[t - 1], path[t]] * chain.emit[text[t], path[t]]
        yield path, p


@pytest.mark.parametrize("stretch", [1, 2, 3, 100])
def test_likelihood_and_counts_equal_sums_over_all_paths(monkeypatch, stretch):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", 4)
    chain = some_chain(5, 3)
    texts = [np.array(t, np.uint16) for t in ([0, 1, 2, 3, 4, 0, 2], [3], [4, 4, 1], [2, 0, 0, 1])]
    counts = np.zeros((5 + 3 + 2, 3))
    work = hmm.Stretches(chain, texts)
    work.expected(counts)
    want, logs = np.zeros_like(counts), []
    for text in texts:
        found = list(paths(chain, text))
        total = sum(p for _, p in found)
        logs.append(math.log(total))
        for path, p in found:
            want[8, path[0]] += p / total
            for t, s in enumerate(text):
                want[s, path[t]] += p / total
                if t:
                    want[5 + path[t - 1], path[t]] += p / total
    want[9, :2] = sum(logs), len(texts)
    assert np.allclose(work.log_likelihoods(), logs) and np.allclose(counts, want)


def test_stretches_change_nothing_on_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (5000, 1, 700, 4096, 1024)]
    chain = some_chain(50, 4)
    found = {}
    for stretch in (64, 1024, 10_000):
        monkeypatch.setattr(hmm, "STRETCH", stretch)
        counts = np.zeros((50 + 4 + 2, 4))
        work = hmm.Stretches(chain, texts)
        work.expected(counts)
        found[stretch] = np.append(counts, work.log_likelihoods())
    assert np.allclose(found[64], found[10_000]) and np.allclose(found[1024], found[10_000])


def test_rounds_never_lower_the_likelihood():
    rng = np.random.default_rng(5)
    texts = [rng.choice(20, 40, p=np.roll(np.arange(1, 21) / 210, 7 * (i % 3))).astype(np.uint16) for i in range(60)]
    chain, before = some_chain(20, 3), -np.inf
    for _ in range(8):
        counts = np.zeros((20 + 3 + 2, 3))
        hmm.Stretches(chain, texts).expected(counts)
        assert counts[24, 0] >= before - 1e-9
        before = counts[24, 0]
        chain = hmm.Chain(counts[23] / counts[23].sum(), counts[20:23] / counts[20:23].sum(1, keepdims=True), counts[:20] / counts[:20].sum(0))


def base_by_hand(rows):
    """n_tokens, n_known, training tokens and base score per row, word by word."""
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    learned = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    seen = Counter(w for t in learned for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    return [
        (i, len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)))
        for i, t in rows
    ]


def scored(docs, **conf):
    voc = hmm.vocabulary(docs, learn())
    encoded = hmm.encode(docs, voc, learn())
    chain = hmm.train(encoded, voc, start_rounds=3, rounds=1)
    return voc, chain, hmm.score(encoded, voc, chain)


def same(got, want):
    got = sorted(((*r[:4], round(r[4], 6)) for r in map(tuple, got)), key=repr)
    assert got == sorted(((*w[:4], round(w[4], 6)) for w in want), key=repr)


@pytest.mark.parametrize("carried", [hmm.CARRIED, 12, 0])
def test_base_scores_by_hand_whatever_is_joined(odd, rows, monkeypatch, carried):
    monkeypatch.setattr(hmm, "CARRIED", carried)
    got = scored(odd)[2].collect()
    same(got, base_by_hand([(i, t) for i, t, *_ in rows]))
    assert all(r.score < 0 for r in got)


def test_scores_do_not_depend_on_what_is_joined(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    voc = hmm.vocabulary(docs, learn())
    encoded = hmm.encode(docs, voc, learn())
    chain = hmm.train(encoded, voc, start_rounds=2, rounds=1)
    want = {r.doc_id: r.score for r in hmm.score(encoded, voc, chain).collect()}
    # The same own words, all others joined.
    fewer = hmm.Vocabulary(voc.counts, voc.tokens, voc.distinct, voc.carried[: hmm.OWN], voc.carried_counts[: hmm.OWN], voc.shared, voc.unseen)
    assert len(voc.carried) > hmm.OWN
    got = {r.doc_id: r.score for r in hmm.score(hmm.encode(docs, fewer, learn()), fewer, chain).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_states_give_one_to_all_words_and_the_unseen(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k))) for k in range(1, 40)], "doc_id long, text string")
    voc, chain, _ = scored(docs)
    counts = {r.word if isinstance(r.word, bytes) else bytes(r.word): r.c for r in voc.counts.collect()}
    own = {w: s for w, s in zip(voc.carried[: hmm.OWN], range(hmm.OWN), strict=False)}
    total = chain.emit[: len(own)].sum(0) + chain.emit[len(own) : hmm.OWN].sum(0)
    for s in range(hmm.ENDINGS):
        here = sum(c for w, c in counts.items() if w not in own and hmm.ending(w) == hmm.OWN + s)
        total = total + chain.emit[hmm.OWN + s] * (here + voc.unseen[s]) / (voc.shared[s] + voc.unseen[s])
    assert np.allclose(total, 1)


def test_endings_are_the_same_in_spark_and_python(spark):
    words = [b"a", "é".encode(), "naïve".encode(), b"\xf0\x9f\x98\x80", b"word", hmm.END, b"x" * 500]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select(hmm._ending("word")).collect()
    assert [r[0] for r in got] == [hmm.ending(w) for w in words]


def test_empty_table_and_one_that_teaches_nothing(spark, empty):
    assert scored(empty)[2].collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held, "some words")], "doc_id long, text string")
    (row,) = scored(docs)[2].collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score < 0


def test_clashing_columns_are_carried_and_ignored(odd):
    voc = hmm.vocabulary(odd, learn())
    encoded = hmm.encode(odd, voc, learn(), carry=("lang", "ids", "score", "text"))
    assert "symbols" in encoded.columns and encoded.filter("lang = 'fr'").count() == 4


def test_whole_query_beats_single_tokens_on_held_out_texts(spark, sf):
    got = op11_hidden_markov_lm(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same([r[:1] + r[2:] for r in got], base_by_hand(docs))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)

