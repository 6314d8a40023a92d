"""Byte-level BPE on length-bucketed padded matrices of numpy, equal to the usual encoder's ids.

A text is split by the tokenizer's pattern; each different piece that a worker does not remember is
encoded. Pieces are put into matrices by length (padded to the next power of two), a row per
piece. Each round every row merges its leftmost pair of minimum rank: ranks of neighbouring pairs come
from a hash table over (left id, right id), only the two pairs next to a merge are looked up again,
links to the next live part replace shifting, and rows that have no pair left leave the matrix; when
half of the parts are dead the matrix is compacted.

Defined results: a null text is an empty text; an empty text has no ids; every row is encoded for
itself, also when its key repeats.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.base import Remembered, bounded, file_bytes, small_batches, worker_cache

NO_PAIR = np.int32(2**31 - 1)
MATRIX_CELLS = 1 << 20
# Different words, and different pieces, whose ids a worker remembers.
CACHE_ENTRIES, CACHED_CHARS = 100_000, 64
# The characters with Unicode's property White_Space.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = re.compile(rf"[{WHITE}\x1c-\x1f]{{2}}|\A[{WHITE}\x1c-\x1f]|[{WHITE}\x1c-\x1f]\Z")
_SINGLE_SPACE = re.compile(rf"(?<=[^{WHITE}\x1c-\x1f]) (?=[^{WHITE}\x1c-\x1f])")


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Ranks by token, from lines of a base64 token and its rank."""
    lines = (line.split() for line in data.splitlines())
    return {base64.b64decode(line[0]): int(line[1]) for line in lines if line}


class Vocabulary:
    """Ranks, single bytes, and the hash table of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for t, rank in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        self._fill(keys, np.array(merged, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, self.longest_probe = self._slot(keys), 0
        while len(keys):
            self.longest_probe += 1
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.setdiff1d(np.arange(len(keys)), put, assume_unique=True)
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merged token, or NO_PAIR; either side may be -1 (nothing there)."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(keys.shape, NO_PAIR, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[todo] if keys.ndim == 1 else keys.reshape(-1)[todo]
        slot = self._slot(keys)
        flat = out.reshape(-1)
        for _ in range(self.longest_probe):
            held = self.keys[slot]
            hit = held == keys
            flat[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (held != -1)
            if not go.any():
                break
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


def _merge_matrix(rows: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids, as little-endian unsigned 32-bit integers, of pieces of similar length."""
    width = max(map(len, rows))
    n = len(rows)
    sizes = np.fromiter(map(len, rows), np.int64, n)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    ids = np.full((n, width + 1), -1, np.int32)
    inside = np.arange(width + 1)[None, :] < sizes[:, None]
    ids[inside] = vocab.byte_ids[flat]
    out = [b""] * n
    who = np.arange(n)
    while True:
        # A compacted matrix: all parts of a row stand side by side.
        rows_n, cols = ids.shape
        rank = np.full(ids.shape, NO_PAIR, np.int32)
        rank[:, :-1] = vocab.pair_ranks(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(rows_n, cols - 1)
        after = np.tile(np.arange(1, cols + 1, dtype=np.int32), (rows_n, 1))
        before = after - 2
        for _ in range(max(1, cols // 2)):
            at = rank.argmin(axis=1)
            r = np.arange(len(ids))
            best = rank[r, at]
            live = best != NO_PAIR
            if not live.any():
                break
            r, at, best = r[live], at[live], best[live]
            gone = after[r, at]
            nxt = after[r, gone]
            prev = before[r, at]
            ids[r, at] = best
            ids[r, gone] = -1
            rank[r, gone] = NO_PAIR
            after[r, at] = nxt
            inside = nxt < cols
            before[r[inside], nxt[inside]] = at[inside]
            right = np.where(inside, ids[r, np.minimum(nxt, cols - 1)], -1)
            rank[r, at] = vocab.pair_ranks(best, right)
            has = prev >= 0
            left = np.where(has, ids[r, np.maximum(prev, 0)], -1)
            new = vocab.pair_ranks(left, best)
            rank[r[has], prev[has]] = new[has]
        done = rank.min(axis=1) == NO_PAIR
        parts = ids[done]
        ends = (4 * (parts >= 0).sum(axis=1).cumsum()).tolist()
        flat = parts[parts >= 0].astype("<u4").tobytes()
        for i, a, b in zip(who[done].tolist(), [0, *ends], ends, strict=False):
            out[i] = flat[a:b]
        if done.all():
            return out
        ids, who = ids[~done], who[~done]
        alive = ids >= 0
        count = alive.sum(axis=1)
        packed = np.full((len(ids), int(count.max()) + 1), -1, np.int32)
        packed[np.arange(packed.shape[1])[None, :] < count[:, None]] = ids[alive]
        ids = packed


def merge_pieces(pieces: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of each piece, packed; a piece that is a token is that token."""
    out = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        rank = vocab.ranks.get(p)
        if rank is not None:
            out[i] = rank.to_bytes(4, "little")
        elif p:
            buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
    for bits, members in buckets.items():
        step = max(1, MATRIX_CELLS >> bits)
        for start in range(0, len(members), step):
            part = members[start : start + step]
            for i, ids in zip(part, _merge_matrix([pieces[i] for i in part], vocab), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Ids of texts; what a worker has met before, it looks up.

    A single space between two characters that are not white space always begins a piece, so a text
    falls into words that can be encoded one by one: the first as it is, the others behind a space.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocab = Vocabulary(ranks)
        # White space as the encoder's own engine has it (Unicode's property, without 0x1C-0x1F).
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.pieces = Remembered(CACHE_ENTRIES, CACHED_CHARS)
        self.words = Remembered(CACHE_ENTRIES, CACHED_CHARS)  # behind a space

    def _split(self, text: str) -> list[str]:
        if _GAP.search(text):
            return _SINGLE_SPACE.split(text)
        return text.split(" ")

    def _encode_new(self, words: list[str]) -> list[bytes]:
        split = [self.pattern.findall(w) for w in words]
        new = self.pieces.lacking(split)
        found = merge_pieces([p.encode() for p in new], self.vocab)
        self.pieces.update(zip(new, found, strict=True))
        get = self.pieces.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split]
        self.pieces.forget_long(new)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._split(t) for t in texts]
        firsts = self._encode_new([words[0] for words in split])
        rest = [words[1:] for words in split]
        new = self.words.lacking(rest)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            self.words.update(zip(part, self._encode_new([" " + w for w in part]), strict=True))
        get = self.words.__getitem__
        out = [first + b"".join(map(get, words)) for first, words in zip(firsts, rest, strict=True)]
        self.words.forget_long(new)
        return out


class Decoder:
    """The bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {rank: t for t, rank in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(key, n_tokens, ids) and the carried columns; ``ids`` are little-endian unsigned 32-bit integers."""
    held = docs.sparkSession.sparkContext.broadcast(file_bytes(path))
    rows = bounded(docs).select(
        F.col(text).alias("_text"), F.col(key).alias("_c0"), *[F.col(c).alias(f"_c{i + 1}") for i, c in enumerate(carry)]
    )
    n = 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(("bpe", path, pattern, len(held.value)), lambda: Encoder(ranks_of(held.value), pattern))
        for batch in small_batches(batches, 0, size=1 << 20):
            ids = encoder.encode([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *[batch.column(1 + i) for i in range(n)]],
                ["n_tokens", "ids", *[f"_c{i}" for i in range(n)]],
            )

    kinds = ", ".join(f"_c{i} {dict(rows.dtypes)[f'_c{i}']}" for i in range(n))
    out = rows.mapInArrow(run, f"n_tokens long, ids binary, {kinds}")
    return out.select(F.col("_c0").alias(key), "n_tokens", "ids", *[F.col(f"_c{i + 1}").alias(c) for i, c in enumerate(carry)])


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes that the ids stand for; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(file_bytes(path))
    names = encoded.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_cache(("tokens", path, len(held.value)), lambda: Decoder(ranks_of(held.value)))
        for batch in small_batches(batches, at):
            back = [None if x is None else decoder.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*names, "decoded"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes)
    return bounded(encoded).mapInArrow(run, f"{kinds}, decoded binary")
