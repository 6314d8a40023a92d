"""Byte pairs, lines, benchmark windows, pseudonyms and the token store against plain versions."""

import base64
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from hourloom.llm import bpe, decontam, linedup, pii, tokenstore

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(11)
HARD = [
    "", " ", "\n", " a", "a ", " \n a", "a  b\n c ", "I'll don't 's", "x" * 5000, "ab" * 700, "é" * 300, "😀" * 100,
    "".join(chr(RNG.randrange(32, 0x3000)) for _ in range(2000)),
    *["".join(RNG.choice(" \n\t  \x85\x1c a.,'sét1́") for _ in range(200)) for _ in range(60)],
]


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(bpe.ranks_of(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def decoder():
    with open(RANKS, "rb") as f:
        return bpe.Decoder(bpe.ranks_of(f.read()))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("text", HARD)
def test_bpe_equals_the_library(encoder, decoder, library, text):
    ids = encoder.encode([text])[0]
    assert ids == packed(library.encode_ordinary(text))
    assert decoder.decode(ids) == text.encode()


def test_merges_follow_leftmost_least_rank():
    # Ranks under which the order of merges matters: a new pair may rank below the one before it.
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 290, b"cab": 280, b"aa": 301, b"aaa": 270}
    enc = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    vocab = bpe.Vocabulary(ranks)
    for _ in range(200):
        word = "".join(RNG.choice("abc") for _ in range(RNG.randrange(1, 40)))
        assert bpe.merge_pieces([word.encode()], vocab)[0] == packed(enc.encode_ordinary(word))


def test_bpe_operator(odd, empty, rows, library):
    enc = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(enc, RANKS).collect()]
    want = [(i, len(x := library.encode_ordinary(t or "")), packed(x), (t or "").encode()) for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


# --- lines


def lines_by_hand(rows, least=3):
    holders, last = defaultdict(int), {}
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    rank = lambda i: -1 if i is None else i
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k] += 1
            last[k] = max(last.get(k, -1), rank(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or holders[key(x)] < least or rank(i) == last[key(x)]]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(odd, rows):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linedup.dedupe_lines(odd).collect()]
    assert sorted(got, key=repr) == lines_by_hand(rows)
    assert sum(r[2] for r in got) == 2


@pytest.mark.parametrize("batches", [1, 2, 5, 9])
def test_lines_do_not_depend_on_the_batches(spark, batches):
    rng = random.Random(batches)
    rows = [(i, "\n".join(rng.choice([f"line number {k} of the pool" for k in range(30)]) for _ in range(6))) for i in range(120)]
    rows += [(None, "line number 3 of the pool"), (None, "line number 3 of the pool")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linedup.dedupe_lines(docs, batches=batches).collect()]
    assert sorted(got, key=repr) == lines_by_hand(rows)


def test_runs_are_compacted_and_fresh_once(spark):
    runs = linedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, b"shared"), (k, bytes([k])), (k, bytes([max(0, k - 1)]))], "_key long, line binary").distinct())
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    merged = {bytes(r.line): (r.docs, r.last) for r in runs._merge(runs.rows()).collect()}
    assert merged[b"shared"] == (5, 4) and merged[b"\x02"] == (2, 3)
    assert runs.rows().filter("fresh").groupBy("line").count().filter("count > 1").count() == 0


def test_lines_of_an_empty_table(empty):
    assert linedup.dedupe_lines(empty).count() == 0


# --- benchmark


def windows_by_hand(rows, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = {}
    for item, t in items:
        w = words(t)
        if w:
            held[str(item)] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}
    out = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for item, wins in held.items():
            for win in wins:
                for a in range(len(w) - len(win) + 1):
                    if tuple(w[a : a + len(win)]) == win:
                        hit |= set(range(a, a + len(win)))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "alpha BETA, gamma"), (2, "one"), (10, "a line that several documents repeat in full zeta eta theta iota"),
    (3, None), (4, "!!!"), (5, "ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor"), (6, "Zoë"), (6, "x"), (None, "key"),
]


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 20])
def test_benchmark_windows(spark, odd, rows, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(odd, bench).collect()
    want = windows_by_hand(rows, [("null" if i is None else i, t) for i, t in ITEMS])
    merged = defaultdict(set)
    for i, t in ITEMS:
        merged["null" if i is None else i].add(t)
    # Two rows of item 6 are one item with the windows of both.
    both = windows_by_hand(rows, [("6", "Zoë")]), windows_by_hand(rows, [("6", "x")])
    for r in sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=repr):
        if r[0] != 8:
            assert r in want
        else:
            assert r[2] == sum(x[2] for part in both for x in part if x[0] == 8) and "6" in r[3]
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        for s in r.spans:
            piece = texts[r.doc_id].encode()[s.first_byte : s.end_byte].decode()
            assert len(decontam.words_of(piece)) == s.last_word - s.first_word + 1


def test_no_benchmark_and_no_documents(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(odd, none).filter("n_hit > 0").count() == 0
    assert decontam.contamination(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# --- pseudonyms

PRIVATE = (
    "Write to kim.07@mail3.example.com or +1 (415) 555-2671, (415) 555-2671; card 4111 1111 1111 1111 = 4111111111111111, "
    'not 4111111111111112; ssn 078-05-1120, ip 10.0.0.255, not 10.0.0.256; 2024-02-29, not 2024-02-30; 12/31/1999; token = "be8a8e7152a5c568b612dc7f4042dd9566113270"; '
    "IBAN DE89 3704 0044 0532 0130 00."
)


def test_pseudonyms_keep_format_link_and_restore():
    perm = pii.Permutation(b"k1")
    new, found = pii.pseudonymise(PRIVATE, perm)
    kinds = [k for k, _, _ in found]
    assert sorted(set(kinds)) == ["card", "date", "email", "iban", "ip", "phone", "secret", "ssn"] and len(kinds) == 11
    for value in ("kim.07", "555-2671", "4111 1111", "4111111111111111", "078-05-1120", "10.0.0.255", "2024-02-29", "12/31/1999", "be8a8e71", "3704 0044"):
        assert value not in new
    for value in ("4111111111111112", "10.0.0.256", "2024-02-30", "@mail3.example.com", "+1 (415)", "IBAN DE"):
        assert value in new
    cards = re.findall(r"card ([\d ]+) = (\d+)", new)[0]
    assert cards[0].replace(" ", "") == cards[1] and pii.luhn_digit(cards[1][:-1]) == cards[1][-1]
    assert pii.pseudonymise(new, perm, back=True)[0] == PRIVATE
    assert pii.pseudonymise(PRIVATE, pii.Permutation(b"k2"))[0] != new


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 997, 5000])
def test_feistel_is_a_permutation(n):
    perm = pii.Permutation(b"key")
    image = [perm.apply(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n))
    assert [perm.apply(y, n, "t", back=True) for y in image] == list(range(n))


def test_pseudonym_operator(spark, odd, empty, rows):
    got = pii.pseudonyms(odd, b"k")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((i, t) for i, t, *_ in rows), key=repr)
    docs = spark.createDataFrame([(1, PRIVATE), (2, "again 4111111111111111 and " + PRIVATE)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.pseudonyms(docs, b"k").collect()}
    assert texts[2].endswith(texts[1]) and re.search(r"again (\d+)", texts[2])[1] in texts[1]
    back = pii.pseudonyms(pii.pseudonyms(docs, b"k").drop("values"), b"k", restore=True)
    assert {r.text for r in back.collect()} == {PRIVATE, "again 4111111111111111 and " + PRIVATE}
    assert pii.pseudonyms(empty, b"k").count() == 0


def test_long_runs_are_scanned_in_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "A1" * 100_000, "1 " * 100_000):
        pii.pseudonymise(text, pii.Permutation(b"k"))


# --- token store


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", [*HARD, "Σίσυφος ΟΔΟΣ. ä ̈b \x1c x  \x85z <|endoftext|> Ŀ İ", "Foo, bar. Foo. foo!? Don't,"])
def test_words_give_the_ids_of_the_text(tokenizer, text):
    with open(WORDS, "rb") as f:
        enc = tokenstore.WordEncoder(f.read(), 2, 4)
    assert enc.encode([text])[0] == packed(tokenizer.encode(text, add_special_tokens=False).ids + [2])


def test_pieces_of_words_meet_the_merges_once(tokenizer, monkeypatch):
    with open(WORDS, "rb") as f:
        enc = tokenstore.WordEncoder(f.read(), 2, 4)
    met, one = [], enc._one
    monkeypatch.setattr(enc, "_one", lambda part: met.append(part) or one(part))
    for texts in (["Zürich Zürich, zürich!", ""], ["ZÜRICH, gate", "Gate! 日本 Σς"], ["zürich gate, 日本"]):
        want = [packed(tokenizer.encode(t, add_special_tokens=False).ids + [2]) for t in texts]
        assert enc.encode(texts) == want
    assert sorted(p for p in met if p) == ["!", ",", "gate", "zürich"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_the_index_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(-(2**62), 2**62, n)
    h = tokenstore.key_hash(keys, np.ones(n, bool), np.zeros(n, np.int64))
    slots = tokenstore.slots_of(h, tokenstore.build_index(h), n)
    assert sorted(slots.tolist()) == list(range(n))


@pytest.mark.parametrize("wanted", [1 << 30, 30_000])
def test_store(spark, odd, rows, tokenizer, wanted):
    store = tokenstore.write_store(odd, WORDS, 2, shard_bytes_wanted=wanted)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in store.read(odd).collect()]
    ids = sorted(((i, packed(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, x in ids:
        want.append((i, start, len(x) // 4, x))
        start += len(x) // 4
    assert sorted(got, key=lambda r: r[1]) == want
    assert store.get(8).astype("<u4").tobytes() == dict(ids)[8] and store.get(None) is not None
    assert store.get(9, 1) is not None and store.get(9, 2) is None and store.get(12345) is None
    missing = store.read(spark.createDataFrame([(777,)], "doc_id long")).collect()
    assert [(r.start, r.n_tokens, r.ids) for r in missing] == [(None, None, None)]


def test_empty_store(empty):
    store = tokenstore.write_store(empty, WORDS, 2)
    assert store.read(empty).count() == 0 and store.get(1) is None




def test_digits_of_other_scripts_are_text(spark):
    texts = ["1 ١٢٣-٤٥-٦٧٨٩", "١٩٢.١٦٨.١.١ and ２０２４-０１-０２", "+٤٩ ١٢٣ ٤٥٦٧", "٤١١١١١١١١١١١١١١١", "ssn 123-45-6789 ١"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonyms(docs, b"k").collect()}
    assert all(got[i].text == texts[i] and not got[i].values for i in range(4))
    assert [v["kind"] for v in got[4].values] == ["ssn"] and got[4].text.endswith(" ١")


def test_addresses_that_differ_in_case_stay_different():
    perm = pii.Permutation(b"k")
    names = ["a@b.co", "A@b.co", "Ab.c@b.co", "aB.c@b.co", "ab.c@b.co"]
    new = [pii.pseudonymise(n, perm)[0] for n in names]
    assert len(set(new)) == len(names)
    assert [pii.pseudonymise(n, perm, back=True)[0] for n in new] == names


def test_a_lookup_reads_a_few_ranges_of_a_shard():
    rng = np.random.default_rng(4)
    keys = [None, *range(0, 3000, 3), 6, 6]
    ids = [rng.integers(0, 60_000, rng.integers(1, 400)).astype("<u2").tobytes() for _ in keys]
    order = np.argsort([-1 if k is None else k for k in keys], kind="stable")
    keys, ids = [keys[i] for i in order], [ids[i] for i in order]
    data = tokenstore.shard_bytes(keys, ids, 2)
    read = []

    def by_range(start, length):
        read.append(length)
        return data[start : start + length]

    seen = {}
    for k, x in zip(keys, ids):
        copy = seen.get(k, 0)
        seen[k] = copy + 1
        read.clear()
        assert tokenstore.get_by_ranges(by_range, k, copy).tobytes() == x and sum(read) == 40 + 8 + 4 + 16 + len(x)
    assert tokenstore.get_by_ranges(by_range, 1) is None and tokenstore.get_by_ranges(by_range, 6, 3) is None


def test_tokenizers_that_do_not_encode_words_encode_whole_texts():
    import json

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        made = json.loads(f.read())
    assert tokenstore.encodes_words(made)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}):
        assert not tokenstore.encodes_words({**made, **change})
    kept = {**made, "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}]}}  # letters keep their case
    encoder = tokenstore.WordEncoder(json.dumps(kept).encode(), 2, 2)
    texts = ["Alpha beta, GAMMA!", "", "Zoë's 12"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == want
