"""Cases in which an operator did less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hourloom.llm import fingerprint, langid, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=60):
    return " ".join(f"w{k}x{i * i % 97}" for i in range(n))


def test_unrelated_documents_without_an_id_or_under_one_id_stay(spark, sf):
    rows = [(None, prose(k), "en", "s", 1) for k in range(5)]
    rows += [(7, prose(10), "en", "s", 1), (7, prose(11), "en", "s", 1)]
    # Copies: of a null id, of a repeated id, and two equal rows.
    rows += [(3, prose(0), "en", "s", 1), (2, prose(10), "en", "s", 1), (8, prose(20), "en", "s", 1), (8, prose(20), "en", "s", 1)]
    got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, COLUMNS), sf).collect()
    want = [(None, prose(k)) for k in range(1, 5)] + [(3, prose(0)), (2, prose(10)), (7, prose(11)), (8, prose(20))]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)


def test_one_word_more_leaves_near_copies_alike(spark):
    rows = []
    for lines in (1, 4):
        text = "\n".join(prose(k, 240 // lines) for k in range(lines))
        rows += [(len(rows), text), (len(rows) + 1, "new " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v = {r.doc_id: r.lanes for r in fingerprint.fingerprint(docs).collect()}
    pair = spark.createDataFrame([(v[0], v[1]), (v[2], v[3])], "a array<long>, b array<long>")
    assert all(r[0] > 0.9 for r in pair.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect())


def test_runs_start_at_every_word(spark):
    rows = [("a b  c\td e\n\nf g",), ("",)]
    got = spark.createDataFrame(rows, "t string").select(fingerprint.units(F.col("t"))).collect()
    assert got[0][0] == ["\na b  c\td e", "\n", "\nf g", "a b c d", "b c d e", "f g"] and got[1][0] == ["\n"]


def test_half_a_window_of_words_lies_whole_in_a_window():
    for n in (33, 60, 61, 500):
        held = [set(w.tolist()) for w in toxicity.windows(np.arange(n))]
        size = toxicity.WINDOW // 2
        assert all(any(set(range(a, a + size)) <= w for w in held) for a in range(n - size + 1))


def counted(texts):
    grams, counts = zip(*(np.unique(langid.grams(langid.normal_bytes(t)), return_counts=True) for t in texts), strict=True)
    return langid.Statistics([f"l{i}" for i in range(len(texts))], list(grams), list(counts))


def test_code_lengths_do_not_depend_on_the_room_of_the_table(monkeypatch):
    rng = np.random.default_rng(1)
    stats = counted([" ".join("".join(rng.choice(list(letters), 4)) for _ in range(400)) for letters in ("abcdefg", "efghijké", "ghistuvж")])
    probes = ["abcd efgh ghis", "zebra 12 ж", "é" * 50, ""]
    whole = langid.CodeTable(stats)
    for rows in (1, 2, 5, 40, 200):
        monkeypatch.setattr(langid, "TABLE_BYTES", rows * 256 * 4 * 3)
        small = langid.CodeTable(stats)
        assert len(small.bits) <= rows * 256 and not whole.searched
        for p in probes:
            data = langid.normal_bytes(p)
            assert np.allclose(small.code_lengths(data), whole.code_lengths(data), rtol=1e-5, atol=1e-3)


def test_every_language_is_learned(spark):
    words = [f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)}" for k in range(70)]
    docs = spark.createDataFrame([(k, f"{w} {w}", f"l{k:02}") for k, w in enumerate(words)], "doc_id long, text string, lang string")
    stats = langid.train(docs, F.lit(True))
    assert stats.languages == [f"l{k:02}" for k in range(70)]
    assert all(r.lang_pred == f"l{r.doc_id:02}" for r in langid.predict(docs, stats).collect())
