"""Fingerprints, SimHash groups, classifiers and the pipeline against plain versions."""

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hourloom.llm import components, fingerprint, langid, quality, simhash, toxicity
from hourloom.llm.base import cut_points, fold_of, range_of
from hourloom.llm.queries import QUERIES

# --- fingerprints


def neighbours_by_hand(rows):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(order):
        half, after = len(t) // 2, order[(k + 1) % len(order)][1]
        out.append((i, len(t), t[: len(t) - half] + after[:half]))
    return out


def test_edited_neighbours(spark, odd, rows):
    got = fingerprint.edited_neighbours(odd).collect()
    want = neighbours_by_hand(rows)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(
        ((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in want), key=repr
    )
    texts = spark.createDataFrame([(k, e) for k, (_, _, e) in enumerate(want)], "doc_id long, text string")
    prints = {hashlib.sha256(want[r.doc_id][2].encode()).hexdigest(): r.fingerprint for r in fingerprint.fingerprint(texts).collect()}
    assert all(r.edited_fingerprint == prints[r.edited_sha256] for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[1].near_next == 1.0
    assert by_id[4].fingerprint == by_id[5].fingerprint and by_id[4].near_edited == 1.0
    assert 0.9 < by_id[6].near_edited <= 1 and by_id[8].near_next < 0.5


def test_one_row_and_none(spark, empty):
    one = fingerprint.edited_neighbours(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b c a b c"[:11]).hexdigest() or one.n_chars == 11
    assert fingerprint.edited_neighbours(empty).count() == 0


def test_order_does_not_matter_and_paragraphs_come_and_go(spark):
    docs = spark.createDataFrame(
        [(1, "one two three\nfour five\nsix"), (2, "six\none two three\nfour five"), (3, "one two three\nsix"), (4, "four five"), (5, "four five\nfour five")],
        "doc_id long, text string",
    )
    v = {r.doc_id: r for r in fingerprint.fingerprint(docs).collect()}
    assert v[1].fingerprint == v[2].fingerprint != v[3].fingerprint and v[4].fingerprint != v[5].fingerprint
    pair = spark.createDataFrame([(v[3].lanes, v[4].lanes, v[1].lanes)], "a array<long>, b array<long>, c array<long>")
    got = pair.select(
        (fingerprint.insert(F.col("a"), F.col("b")) == F.col("c")).alias("add"),
        (fingerprint.delete(F.col("c"), F.col("b")) == F.col("a")).alias("take"),
        (fingerprint.total([F.col("a"), F.col("b")]) == F.col("c")).alias("all"),
    ).first()
    assert got.add and got.take and got.all


def test_likeness_follows_the_share_of_common_text(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lines = [" ".join(word() for _ in range(12)) for _ in range(120)]
    docs = spark.createDataFrame([(1, "\n".join(lines[:80])), (2, "\n".join(lines[20:100])), (3, "\n".join(lines[80:]))], "doc_id long, text string")
    v = {r.doc_id: r.lanes for r in fingerprint.fingerprint(docs).collect()}
    pair = spark.createDataFrame([(v[1], v[2], v[3])], "a array<long>, b array<long>, c array<long>")
    near, far = pair.select(fingerprint.likeness(F.col("a"), F.col("b")), fingerprint.likeness(F.col("a"), F.col("c"))).first()
    assert 0.5 < near < 0.95 and far < 0.35


def test_the_fingerprint_plan_is_native_with_one_exchange(spark, odd, capsys):
    fingerprint.edited_neighbours(odd).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64])
def test_ranges(spark, n):
    df = spark.range(0, 100).select((F.col("id") * 3).alias("k")).union(spark.createDataFrame([(None,)], "k long"))
    cuts = cut_points(df, "k", n)
    got = df.select("k", range_of("k", cuts).alias("r")).collect()
    assert all(r.r == (0 if r.k is None else max(0, sum(c <= r.k for c in cuts) - 1)) for r in got)
    assert len(cuts) <= max(2, n) and cuts[0] == 0


# --- simhash


def simhash_by_hand(text, size=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(prints, keys, reach):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= reach:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(odd, empty, rows):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    prints = [simhash_by_hand(t) for _, t, *_ in rows]
    groups = groups_by_hand(prints, [r[0] for r in rows], simhash.MAX_BITS)
    assert sorted(got, key=repr) == sorted(((r[0], f"{p:016x}", g) for r, p, g in zip(rows, prints, groups, strict=True)), key=repr)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("depth", [0, 2, 6])
def test_all_links_are_found_in_crowds(spark, depth):
    rng = np.random.default_rng(depth)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = lambda c, k: c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64))
    # One crowd of near copies, chains, and strangers.
    crowd = [flips(centres[0], int(rng.integers(1, 4))) for _ in range(900)]
    chains = [flips(c, int(k)) for c in centres[1:30] for k in rng.integers(1, 9, 6)]
    values = sorted({int(np.uint64(x).view(np.int64)) for x in [*crowd, *chains, *centres, *rng.integers(0, 2**63, 800, dtype=np.uint64)]})
    df = spark.createDataFrame([(v,) for v in values], "_fp long")
    links = simhash.near_links(df, 4, depth)
    groups = {r.id: r.component for r in components.components(links).collect()}
    want = groups_by_hand([v % 2**64 for v in values], values, 4)
    assert [groups.get(v, v) for v in values] == want
    assert links.count() < 40 * len(values)


def test_components(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1400)]
    links = spark.createDataFrame([*path, *star, (7, 7), (5000, 4000), (4000, 5000)], "u long, v long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)} | {4000: 4000, 5000: 4000}


# --- language


@pytest.fixture(scope="module")
def table():
    texts = {"aa": "the cat sat on the mat and the dog ran " * 30, "bb": "der hund lief und die katze saß auf der matte " * 30}
    grams, counts = zip(*(np.unique(langid.grams(langid.normal_bytes(t)), return_counts=True) for t in texts.values()), strict=True)
    return langid.CodeTable(langid.Statistics(list(texts), list(grams), list(counts)))


def test_code_lengths_are_a_distribution_and_exact(table):
    assert np.allclose(np.exp2(-table.bits.reshape(-1, 256, 2).astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    # Escape by hand: the first context byte is the start mark, then "t" was seen once of once.
    text = "the cat sat on the mat and the dog ran " * 30
    b = langid._START + langid.normal_bytes(text)

    def bits(context, byte):
        for size in range(len(context), -1, -1):
            c = context[len(context) - size :]
            follow = [b[i + size] for i in range(langid.ORDER - size, len(b) - size) if b[i : i + size] == c and i + size >= langid.ORDER]
            if follow:
                return follow, size
        return [], 0

    @cache
    def probability(context, byte, size):
        if size < 0:
            return 1 / 256
        c = context[len(context) - size :]
        follow = [b[i] for i in range(langid.ORDER, len(b)) if b[i - size : i] == c]
        if not follow:
            return probability(context, byte, size - 1)
        total, kinds = len(follow), set(follow)
        if byte in kinds:
            return follow.count(byte) / (total + len(kinds))
        rest = sum(probability(context, x, size - 1) for x in range(256) if x not in kinds)
        return len(kinds) / (total + len(kinds)) * probability(context, byte, size - 1) / rest

    probe = b"cot"
    held = langid._START + probe
    want = -sum(np.log2(probability(held[i : i + 3], held[i + 3], 3)) for i in range(len(probe)))
    assert bits(held[:3], held[3])[1] == 3
    assert abs(table.code_lengths(probe)[0] - want) < 1e-3


def test_identify(table):
    assert langid.identify("the dog sat", table)[0] == "aa" and langid.identify("die katze", table)[0] == "bb"
    assert langid.identify("123 ...", table) == ("und", 0.0) == langid.identify(None, table) == langid.identify("", table)
    long = table.code_lengths(b"the cat " * 100_000)
    assert abs(long[0] / table.code_lengths(b"the cat " * 1000)[0] - 100) < 1


def test_table_stays_bounded(monkeypatch):
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    g, c = np.unique(langid.grams(noise), return_counts=True)
    monkeypatch.setattr(langid, "TABLE_BYTES", 2000 * 256 * 4)
    small = langid.CodeTable(langid.Statistics(["x"], [g], [c]))
    assert len(small.bits) <= 2000 * 256
    assert np.allclose(np.exp2(-small.bits.reshape(-1, 256).astype(np.float64)).sum(axis=1), 1, atol=1e-4)


def test_language_operator(odd, empty, rows):
    stats = langid.train(odd, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(odd, stats).collect()}
    assert stats.languages == ["en", "fr"] and langid.predict(odd, stats).count() == len(rows)
    assert got[5].lang_pred == got[4].lang_pred == got[10].lang_pred == "und" and got[6].lang_pred == "fr"
    none = langid.train(empty, F.lit(True))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


# --- classifiers


def area(y, s):
    y, s = np.asarray(y), np.asarray(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    docs = [[rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.integers(1, 9))] for _ in range(6)]
    net = toxicity._start(docs, np.array([0, 1, 0, 1, 0, 1.0]), rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    vocabulary, ids = toxicity._lookup(docs)
    window = np.concatenate([toxicity.windows(i) for i in ids])
    y = np.array([0, 1, 0, 1, 0, 1.0])

    def loss():
        x = net.inputs(vocabulary)[0]
        return float((np.logaddexp(0, z := toxicity.forward(net, window, toxicity.project(net, x))) - y * z).mean())

    x = net.inputs(vocabulary)[0]
    logit, saved = toxicity.forward(net, window, toxicity.project(net, x), keep=True)
    g, _ = toxicity.backward(net, x, saved, (toxicity._sigmoid(logit) - y) / len(y))
    for name, grad in g.items():
        v = net.weights[name]
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(3)]:
            old, e = v[at], 1e-3
            v[at] = old + e
            up = loss()
            v[at] = old - e
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-3 + 0.05 * abs(grad[at]), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 60, 61, 500):
        w = toxicity.windows(np.arange(n))
        assert set(w[w >= 0].tolist()) == set(range(n))
        assert all(set(a) & set(b) - {-1} for a, b in zip(w.tolist(), w.tolist()[1:], strict=False))


def made_documents(spark, n=500):
    rng = random.Random(9)
    clean = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(1, 150))]
        toxic = i % 4 == 0
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["scoundrel", "scoundrels", "blockhead"]))
        good = i % 3 != 0
        rows.append((i, " ".join(words) if good else " ### ".join(words) + " !!"))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_learns_words_in_long_texts(spark, odd, empty):
    docs, labels, known = made_documents(spark)
    net = toxicity.train(docs, labels, fold_of("doc_id", 4) != 2)
    score = {r.doc_id: r.score for r in toxicity.predict(docs, net).collect()}
    held = [k for k in known if zlib.crc32(str(k[0]).encode()) % 4 == 2]
    assert area([k[2] for k in held], [score[k[0]] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.predict(odd, net).collect())
    assert toxicity.predict(empty, net).count() == 0
    none = toxicity.train(docs, labels.filter("false"), F.lit(True))
    assert {r.score for r in toxicity.predict(odd, none).collect()} == {0.0}


def test_quality_votes(spark, odd, empty):
    docs, labels, known = made_documents(spark)
    model = quality.train(docs, labels.union(labels), fold_of("doc_id", 3) != 1)
    score = {r.doc_id: r.score for r in quality.predict(docs, model).collect()}
    held = [k for k in known if zlib.crc32(str(k[0]).encode()) % 3 == 1]
    assert area([k[1] for k in held], [score[k[0]] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.predict(odd, model).collect())
    assert quality.predict(empty, model).count() == 0
    none = quality.train(docs, labels.filter("false"), F.lit(True))
    assert {r.score for r in quality.predict(odd, none).collect()} == {0.5}


def test_neighbours_are_exact_with_ties():
    rng = np.random.default_rng(1)
    cosine = rng.integers(-3, 4, (40, 30)).astype(np.float32)
    for k in (1, 5, 29):
        want = np.sort(np.argsort(-cosine, axis=1, kind="stable")[:, :k], axis=1)
        assert (np.sort(quality._nearest(cosine, k), axis=1) == want).all()


# --- queries and pipeline


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op6_line_dedup", "op10_decontamination", "op13_hard_negatives")])
def test_queries_give_a_row_per_document(spark, sf, name):
    df = QUERIES[name](spark, sf)
    want = spark.read.parquet(f"{sf}/documents.parquet")
    assert df.select("doc_id").exceptAll(want.select("doc_id")).count() == 0 and df.count() == want.count()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs.columns
    left = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == want
        docs = docs.cache()
        left.append(docs.count())
    assert left[0] >= left[1] == left[2] > left[3] >= left[4] == left[5] > 0
    assert docs.filter(~F.col("round_trip")).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, sf, odd, empty):
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.select("doc_id").distinct().count() == docs.count()


def test_token_stage_has_one_python_worker_a_task(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    plan = corpus_pipeline.token_ids(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_worker_gives_back_what_it_held(monkeypatch):
    from hourloom.llm import base

    given = []
    monkeypatch.setattr(base, "_give_back", lambda: given.append(1))
    monkeypatch.setitem(base.sys.__dict__, "_hourloom_llm_cache", {("old",): 1})
    assert base.worker_cache(("new",), lambda: 2) == base.worker_cache(("new",), lambda: 3) == 2 and given
    base.forget_cached()
    assert list(base.sys.__dict__["_hourloom_llm_cache"]) == [("nothing",)]
