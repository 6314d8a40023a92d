"""Alignment of two tokenizers over the same text: groups of tokens that end together, and links that overlap.

Tokenizer A splits bytes (a ``tokenizers`` file of the byte-level kind), B pieces (a ``sentencepiece``
model, which puts a space before the text). Character offsets of A and the spans of B's immutable proto
cut a text coarsely; tokens that hold part of a character, or a single byte, are refined by the length of
their decoded bytes.

Both tokenizers start afresh at a blank or a line break between two visible characters, so a text is
cut there and every different stretch is aligned once per worker. Where the vocabularies rule that out
(a piece that reaches over a blank), or a stretch does not come back byte for byte, the whole text is
aligned at once. A text whose tokens do not give back space + text has no tokens.

Null and empty texts have no tokens. Rows are told apart by position, not by id. Columns other than the
key, the text and those to carry are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourloom.llm.base import bounded, file_bytes, frequent, small_batches, stored, worker_cache

BLANK = "▁"
END = itemgetter(1)
# Before a blank or line break that stands alone between visible characters.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# Stretches and characters of their groups that a worker remembers, how many stay when it forgets, and how many
# are aligned at once.
REMEMBERED, REMEMBERED_CHARS, KEPT, AT_ONCE = 220_000, 22_000_000, 80_000, 4096
# Pairs whose counts travel with the job; the others are joined.
CARRIED_PAIRS = 1 << 19
# Pairs that a task gathers before it adds them up.
PAIRS_AT_ONCE = 1_000_000
# Text that a task aligns at once: its groups, written out, are several times as long.
BYTES_AT_ONCE = 1 << 20


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the other bytes follow from 256 on in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _whole(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def stretches(text: str) -> list[str]:
    """Space + text, cut at every blank or line break that stands alone between visible characters."""
    words = [w if w[:1] == "\n" else " " + w for w in text.replace("\n", " \n").split(" ")]
    # As many as there are words: then no other white space lies between them.
    return words if len(words) == len(text.split()) else CUT.split(" " + text)


class Aligner:
    """Both tokenizers, and what they made of the stretches met so far."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_json.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        of = byte_of_character()
        vocab = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            a_bytes[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        b_bytes = [bytes([int(p[3:5], 16)]) if one else p.replace(BLANK, " ").encode() for p, one in zip(pieces, single, strict=True)]
        self.kinds = (
            _Kind(a_bytes, [_whole(t) for t in a_bytes], ",", "|"), _Kind(b_bytes, [not one for one in single], ",", ";")
        )
        self.cuts = self._cuts_are_exact(json.loads(byte_json), pieces)
        self.forget()

    @staticmethod
    def _cuts_are_exact(made: dict, pieces: list[str]) -> bool:
        """Whether no token of either kind can reach over a cut."""
        before = made.get("pre_tokenizer") or {}
        by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        return bool(
            by_words and not made.get("normalizer") and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
            and not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        )

    def forget(self, keep: int = 0) -> None:
        """Forget all stretches but the first ones, which hold the words that come up again and again."""
        if keep and sum(map(len, self.groups[:keep])) > REMEMBERED_CHARS // 2:
            keep = 0
        if not keep:
            self.place: dict[str, int] = {}
            self.good, self.n_a, self.n_b, self.n_groups, self.n_links = (array("q") for _ in range(5))
            self.groups: list[str] = []
            self.flat = array("q")  # the links of all stretches, one after the other
            self.chars = 0
            return
        self.place = dict(islice(self.place.items(), keep))
        del self.flat[sum(self.n_links[:keep]) :]
        for column in (self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.groups):
            del column[keep:]
        self.chars = sum(map(len, self.groups)) + sum(map(len, self.place))

    def full(self) -> bool:
        return len(self.place) > REMEMBERED or self.chars > REMEMBERED_CHARS

    def learn(self, new: list[str]) -> None:
        """Align stretches and remember them."""
        gc.disable()  # millions of small lists that live for a moment and hold no cycles
        try:
            # Regular: a blank or line break, then something with no white space at either end.
            plain, other = [], []
            for s in new:
                (plain if self.cuts and s[0] in " \n" and 1 < len(s) == len(s.strip()) + 1 else other).append(s)
            for k in range(0, len(plain), AT_ONCE):
                if not self._learn_joined(plain[k : k + AT_ONCE]):
                    other += plain[k : k + AT_ONCE]
            for k in range(0, len(other), AT_ONCE):
                self._learn_apart(other[k : k + AT_ONCE])
        finally:
            gc.enable()

    def _learn_joined(self, some: list[str]) -> bool:
        """Stretches one after the other, as one text: the tokenizers start afresh at each. False if bytes do not come back."""
        text = "".join(some)
        data = text.encode()
        by_a = self.a.encode(text, add_special_tokens=False)
        shift = int(text[0] == " ")
        by_b = self.b.encode(text[shift:], return_type="offset_mapping", return_bytes=True)
        ids = [by_a.ids, by_b["ids"]]
        ends = [np.fromiter(map(END, found), np.int64, len(found)) for found in (by_a.offsets, by_b["offsets"])]
        if not shift:  # the space that B puts before the text is not part of it
            del ids[1][0]
            ends[1] = ends[1][1:]
        if not all(kind.joined([own], [data])[0] for kind, own in zip(self.kinds, ids, strict=True)):
            return False
        byte_at = _bytes_before(text)
        tokens = [np.array(i, np.int64) for i in ids]
        coarse = [byte_at[ends[0]], ends[1] + shift]
        stop = [kind.ends(t, c) for kind, t, c in zip(self.kinds, tokens, coarse, strict=True)]
        until = byte_at[np.cumsum([len(s) for s in some])]
        of = [np.searchsorted(until, x, "left") for x in stop]
        self._remember(some, list(range(len(some))), tokens, of, stop)
        return True

    def _learn_apart(self, some: list[str]) -> None:
        """Stretches each by itself; those whose bytes do not come back have no tokens."""
        by_a = self.a.encode_batch(some, add_special_tokens=False)
        by_b = self.b.encode([s[1:] if s[:1] == " " else s for s in some], return_type="offset_mapping", return_bytes=True, num_threads=1)
        ids = [[e.ids for e in by_a], [e["ids"] for e in by_b]]
        ends = [[[end for _, end in e.offsets] for e in by_a], [[end for _, end in e["offsets"]] for e in by_b]]
        for i, s in enumerate(some):
            if s[:1] == " ":
                ends[1][i] = [end + 1 for end in ends[1][i]]
            elif ids[1][i] and self.kinds[1].bytes[ids[1][i][0]] == b" ":
                del ids[1][i][0], ends[1][i][0]
        data = [s.encode() for s in some]
        same = [kind.joined(own, data) for kind, own in zip(self.kinds, ids, strict=True)]
        kept = [i for i, both in enumerate(zip(*same, strict=True)) if all(both)]
        byte_at = _bytes_before("".join([some[i] for i in kept]))
        first_char = np.concatenate([[0], np.cumsum([len(some[i]) for i in kept])]).astype(np.int64)
        tokens, stop, of = [], [], []
        for side, kind in enumerate(self.kinds):
            size = np.array([len(ids[side][i]) for i in kept], np.int64)
            token = np.fromiter(chain.from_iterable(ids[side][i] for i in kept), np.int64, size.sum())
            coarse = np.fromiter(chain.from_iterable(ends[side][i] for i in kept), np.int64, len(token))
            own = np.repeat(np.arange(len(kept)), size)
            # A's offsets count characters, B's bytes.
            coarse = byte_at[first_char[own] + coarse] if side == 0 else byte_at[first_char[own]] + coarse
            tokens.append(token)
            of.append(own)
            stop.append(kind.ends(token, coarse))
        self._remember(some, kept, tokens, of, stop)

    def _remember(self, some: list[str], kept: list[int], tokens: list[np.ndarray], of: list[np.ndarray], stop: list[np.ndarray]) -> None:
        """Groups and links of many stretches at once, as if they were one text; only those ``kept`` have tokens."""
        common = [np.isin(stop[0], stop[1], assume_unique=True), np.isin(stop[1], stop[0], assume_unique=True)]
        begin = [np.concatenate([[0], s[:-1]]) if len(s) else s for s in stop]
        # Each place where a token of either kind begins is one link: the tokens that hold it.
        where = np.sort(np.concatenate(begin), kind="stable")  # two sorted runs
        where = where[np.diff(where, prepend=-1) > 0]
        a, b = (np.searchsorted(x, where, "right") - 1 for x in begin)
        pairs = tokens[0][a] << 32 | tokens[1][b]
        links = np.bincount(of[0][a], minlength=len(kept))
        groups = np.bincount(of[0][common[0]], minlength=len(kept))
        # Written per group: tokens of A, then of B, each with the mark that follows it.
        group = [np.cumsum(c) - c for c in common]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        marked = np.concatenate([kind.marked[np.where(c, 1, 0), t] for kind, c, t in zip(self.kinds, common, tokens, strict=True)])[order].tolist()
        written = "".join(marked)
        long = np.concatenate([kind.lengths[t] for kind, t in zip(self.kinds, tokens, strict=True)])
        until = np.cumsum(np.bincount(np.concatenate(of), long, len(kept)).astype(np.int64)).tolist()
        spread = np.zeros((4, len(some)), np.int64)
        n = [np.bincount(own, minlength=len(kept)) for own in of]
        spread[:, kept] = n[0], n[1], groups, links
        for column, values in zip((self.n_a, self.n_b, self.n_groups, self.n_links), spread, strict=True):
            column.frombytes(values.tobytes())
        good = np.zeros(len(some), np.int64)
        good[kept] = 1
        self.good.frombytes(good.tobytes())
        self.flat.frombytes(pairs.tobytes())
        texts = [""] * len(some)
        start = 0
        for i, end in zip(kept, until, strict=True):
            texts[i] = written[start : end - 1]
            start = end
        for s in some:
            self.place[s] = len(self.place)
        self.groups += texts
        self.chars += len(written) + sum(map(len, some))

    def batch(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Per text tokens of A and B, groups, links, and the groups' text; then of all links the text and the pair."""
        cut = [[] if not t else stretches(t) if self.cuts else [" " + t] for t in texts]
        self._meet(cut)
        place = self.place
        rows = [list(map(place.__getitem__, stretches)) for stretches in cut]
        of, at = _placed(rows)
        bad = np.unique(of[np.array(self.good, np.int64)[at] == 0]).tolist()
        for k in bad:
            self._meet([[" " + texts[k]]])
            i = place[" " + texts[k]]
            rows[k] = [i] if self.good[i] else []
        if bad:
            of, at = _placed(rows)
        size = np.array(self.n_links, np.int64)
        first = (np.cumsum(size) - size)[at]
        size = size[at]
        spot = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        numbers = [
            np.bincount(of, np.array(part, np.int64)[at], len(rows)).astype(np.int64)
            for part in (self.n_a, self.n_b, self.n_groups, self.n_links)
        ]
        groups = self.groups
        return numbers, [";".join([groups[i] for i in row]) for row in rows], np.repeat(of, size), np.frombuffer(self.flat, np.int64)[spot]

    def _meet(self, cut: list[list[str]]) -> None:
        # In the order of the texts, in which they lie side by side in memory.
        new = [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in self.place]
        if new:
            self.learn(new)


def _placed(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of all numbers in the rows one after the other, the row and the number."""
    of = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    return of, np.fromiter(chain.from_iterable(rows), np.int64, len(of))


def _bytes_before(text: str) -> np.ndarray:
    """Bytes of UTF-8 before each character, and in all."""
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))])


class _Kind:
    """What the tokens of one kind stand for, and how they are written."""

    def __init__(self, of: list[bytes], whole: list[bool], within: str, last: str):
        self.bytes, self.whole = of, np.array(whole)
        self.sizes = np.array([len(t) for t in of], np.int64)
        self.marked = np.array([[f"{i}{mark}" for i in range(len(of))] for mark in (within, last)], object)
        self.lengths = np.array([len(t) for t in self.marked[0]], np.int64)

    def joined(self, ids: list[list[int]], data: list[bytes]) -> list[bool]:
        """Whether the tokens of each stretch give back its bytes."""
        of = self.bytes
        return [b"".join([of[t] for t in own]) == d for own, d in zip(ids, data, strict=True)]

    def ends(self, tokens: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        """Where tokens end: the coarse cut where a token holds whole characters, else its bytes after the last such cut."""
        done = np.cumsum(self.sizes[tokens])
        sure = np.where(self.whole[tokens], np.arange(len(tokens)), -1)
        sure = np.maximum.accumulate(sure) if len(sure) else sure
        return np.where(sure >= 0, coarse[sure] + done - done[sure], done)


def _aligner(files: tuple[bytes, bytes]) -> Aligner:
    name = hashlib.blake2b(b"".join(files), digest_size=16).hexdigest()
    return worker_cache(("aligner", name), lambda: Aligner(*files))


def _ddl(df: DataFrame, skip: int) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[skip:])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (A's id times 2^32, plus B's), n: in how many rows the pair is linked; best: no pair of A's id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(("no aligner",), lambda: None)  # what the alignment remembered can go
        pairs, n, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            new = batch.column(0).flatten().to_numpy()  # the different pairs of every row
            pairs, n, waiting = np.concatenate([pairs, new]), np.concatenate([n, np.ones(len(new), np.int64)]), waiting + len(new)
            if waiting > PAIRS_AT_ONCE:
                pairs, n, waiting = *_added(pairs, n), 0
                if len(pairs) > PAIRS_AT_ONCE:
                    yield _counted(pairs, n)
                    pairs, n = pairs[:0], n[:0]
        yield _counted(*_added(pairs, n))

    sent = bounded(aligned.select("pairs")).mapInArrow(run, "pair long, n long")
    counts = sent.groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def _added(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(pairs, return_inverse=True)
    return found, np.bincount(place, n, len(found)).astype(np.int64)


def _counted(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def groups_and_links(docs: DataFrame, files: tuple[bytes, bytes], text: str = "text", key: str = "doc_id", carry: tuple = ()) -> DataFrame:
    """_row, key, carried columns, n_a, n_b, n_groups, n_links, groups, and the different linked pairs with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        for batch in small_batches(batches, 0, size=BYTES_AT_ONCE):
            if aligner.full():
                aligner.forget(KEPT)
            numbers, texts, of, pair = aligner.batch(batch.column(0).to_pylist())
            order = np.lexsort((pair, of))
            of, pair = of[order], pair[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(of))).astype(np.int32)
            offsets = pa.array(np.searchsorted(of[start], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pair[start], times)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(x) for x in numbers), pa.array(texts, pa.string()), *lists],
                names=[*batch.schema.names[1:], "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
            )

    df = docs.select(F.col(text).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"), key, *carry)
    more = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
    return bounded(df).mapInArrow(run, f"{_ddl(df, 1)}, {more}")


def align(docs: DataFrame, byte_json: str, piece_model: str, text: str = "text", key: str = "doc_id", carry: tuple = ()) -> DataFrame:
    """key, carried columns, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``a1,a2|b1;a3|b2,b3``).

    Texts are aligned once and stored with their pairs; the corpus' counts come from there. The counts of
    the most frequent pairs travel with the last pass; if those are not all, the other pairs meet theirs
    in a join.
    """
    files = (file_bytes(byte_json), file_bytes(piece_model))
    made = stored(groups_and_links(docs, files, text, key, carry), "aligned")
    counts = stored(pair_counts(made), "pair-counts")
    top, whole = frequent(counts, "n", CARRIED_PAIRS)
    carried = counts.filter(top).toArrow()
    order = np.argsort(carried["pair"].to_numpy())
    keys, docs_of, best_of = (carried[c].to_numpy()[order] for c in ("pair", "n", "best"))

    found = "struct<n_best:bigint,count_sum:bigint,pairs:array<bigint>,times:array<int>>"

    @F.arrow_udf(found)
    def counted(pairs: pa.Array, times: pa.Array) -> pa.Array:
        worker_cache(("no aligner",), lambda: None)
        rows = len(pairs)
        pair, many = pairs.flatten().to_numpy(), times.flatten().to_numpy()
        of = np.repeat(np.arange(rows), np.asarray(pa.compute.list_value_length(pairs)))
        spot = np.searchsorted(keys, pair)
        spot[spot == len(keys)] = 0
        here = keys[spot] == pair if len(keys) else np.zeros(len(pair), bool)
        sums = np.zeros((2, rows), np.int64)
        at, weight = spot[here], many[here].astype(np.int64)
        np.add.at(sums[0], of[here], weight * best_of[at])
        np.add.at(sums[1], of[here], weight * docs_of[at])
        offsets = pa.array(np.searchsorted(of[~here], np.arange(rows + 1)), pa.int32())
        rare = [pa.ListArray.from_arrays(offsets, pa.array(x[~here])) for x in (pair, many)]
        return pa.StructArray.from_arrays([pa.array(sums[0]), pa.array(sums[1]), *rare], ["n_best", "count_sum", "pairs", "times"])

    names = (key, *carry, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    # Only the pairs go through Python; the groups stay where they are.
    out = bounded(made).withColumn("_found", counted("pairs", "times")).select(
        "_row", key, *carry, "n_a", "n_b", "n_groups", "n_links", "groups", F.col("_found.n_best").alias("n_best"),
        F.col("_found.count_sum").alias("count_sum"), F.col("_found.pairs").alias("_pairs"), F.col("_found.times").alias("_times"),
    )
    if whole:
        return out.select(*names)
    out = stored(out, "aligned-carried")
    rare = out.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("_p"))
    rare = rare.select("_row", F.col("_p._pairs").alias("pair"), F.col("_p._times").alias("_m")).join(counts, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("_m")).otherwise(0)).alias("_best"), F.sum(F.col("_m") * F.col("n")).alias("_sum")
    )
    more = {"n_best": "_best", "count_sum": "_sum"}
    return out.join(rare, "_row", "left").select(
        *(F.col(c) if c not in more else (F.col(c) + F.coalesce(more[c], F.lit(0))).alias(c) for c in names)
    )
