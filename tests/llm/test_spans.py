"""Aligned tokens next to a plain count over whole texts."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourloom.llm import base, spans
from hourloom.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, op12_tokenizer_alignment

A, B = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL)
TEXTS = [
    "plain words, and 12 numbers' ends don't",
    "Zoë naïve façade 😀   x 日本語 ｆｕｌｌ",
    "line\nbreak\n\n two\tTabs \n end\n",
    " leading and trailing  ",
    "<|endoftext|> <s> </s> <unk> [CLS] <0x41>",
    "a▁b a▁ ▁",
    "\x00 \x01\x1f \x85\xa0  x​ y\x1cz a\x1c b",
    "é 한국어 한국 עברית 👩‍👩‍👧 \U0010ffff ﻿",
    "x" * 3000 + " " + "é" * 500,
    "",
    None,
    "plain words, and 12 numbers' ends don't",
    "\n", " ", "\n a", "a \n", "a\n", "\nb c",
]


class Plain:
    """Both tokenizers over a whole text, byte by byte."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes = spans.byte_of_character()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.bytes[c] for c in self.names[i])) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def ranges(tokens):
    at = 0
    for i, data in tokens:
        yield i, at, at + len(data)
        at += len(data)


def by_hand(rows):
    plain = Plain()
    made, counts = [], Counter()
    for i, text in rows:
        a, b = (list(ranges(t)) for t in plain.tokens(text))
        links, k = [], 0
        for x, lo, hi in a:  # a token of B that ends before this one begins meets no later one
            while k < len(b) and b[k][2] <= lo:
                k += 1
            for y, lo2, hi2 in b[k:]:
                if lo2 >= hi:
                    break
                links.append((x, y))
        cut, ends = [], {hi for *_, hi in a} & {hi for *_, hi in b}
        for tokens in (a, b):
            group, parts = [], []
            for x, _, hi in tokens:
                group.append(str(x))
                if hi in ends:
                    parts.append(",".join(group))
                    group = []
            cut.append(parts)
        cut = ["|".join(p) for p in zip(*cut, strict=True)]
        made.append((i, len(a), len(b), links, ";".join(cut)))
        counts.update(set(links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (i, n_a, n_b, groups.count(";") + bool(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), groups)
        for i, n_a, n_b, links, groups in made
    ]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def aligned(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in spans.align(docs, A, B).collect()), key=repr)


@pytest.mark.parametrize("carried", [spans.CARRIED_PAIRS, 40, 0])
def test_odd_texts_by_hand_whatever_is_joined(spark, monkeypatch, carried):
    monkeypatch.setattr(spans, "CARRIED_PAIRS", carried)
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (3, "another under a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert aligned(docs) == sorted(by_hand(rows), key=repr)


def test_whole_texts_and_stretches_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    want = aligned(docs)
    made = spans.Aligner(base.file_bytes(A), base.file_bytes(B))
    assert made.cuts
    made.cuts = False
    for i, t in enumerate(TEXTS):
        numbers, texts, _, pair = made.batch([t])
        expected = next(w for w in want if w[0] == i)
        assert [int(x[0]) for x in numbers] == [*expected[1:5]] and texts == [expected[7]] and len(pair) == expected[4]


def test_vocabularies_that_reach_over_a_blank_are_not_cut():
    made = json.loads(base.file_bytes(A))
    check = spans.Aligner._cuts_are_exact
    assert check(made, ["▁a", "▁▁", "b"])
    assert not check(made, ["a▁b"]) and not check(made, ["a\n"])
    assert not check({**made, "normalizer": {"type": "NFC"}}, ["a"])
    assert not check({**made, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, ["a"])


def test_forgetting_changes_nothing(spark, odd, monkeypatch):
    want = aligned(odd)
    monkeypatch.setattr(spans.Aligner, "full", lambda self: True)
    monkeypatch.setattr(spans, "KEPT", 5)
    made = spans.Aligner(base.file_bytes(A), base.file_bytes(B))
    texts = [r.text for r in odd.collect()]
    for t in texts * 2:
        made.forget(5)
        assert len(made.place) == len(made.groups) <= 5 and len(made.flat) == sum(made.n_links)
        numbers, groups, _, pair = made.batch([t])
        assert any(w[7] == groups[0] and w[4] == numbers[3][0] == len(pair) for w in want)
    assert aligned(odd) == want == sorted(by_hand([(r.doc_id, r.text) for r in odd.collect()]), key=repr)


def test_empty_table_and_carried_columns(odd, empty):
    assert aligned(empty) == []
    got = spans.align(odd, A, B, carry=("lang", "ids", "shard")).filter("doc_id = 8").first()
    assert (got.lang, got.ids, got.shard) == ("fr", "x", "x")


def test_whole_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if not t or len(t) < 5000]
    got = {r.doc_id: r for r in op12_tokenizer_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    plain = Plain()
    for i, t in docs:
        a, b = plain.tokens(t)
        assert (got[i].n_a, got[i].n_b) == (len(a), len(b))
    want = by_hand(short)
    for i, *_, groups in want:
        assert got[i].groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_new_stretches_are_met_in_the_order_of_the_texts():
    with open(public_tokenizers.path(BYTE_TOKENIZER), "rb") as a, open(public_tokenizers.path(PIECE_MODEL), "rb") as b:
        aligner = spans.Aligner(a.read(), b.read())
    words = [f"{c}{n}" for n in range(40) for c in "zyx"]
    aligner.batch([" ".join(words), None, "", " ".join(["new", *words[::-1]])])
    assert list(aligner.place) == [f" {w}" for w in [*words, "new"]]
