"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

A text is normalised byte by byte: A-Z become a-z, ASCII bytes that are neither letters nor digits
become spaces, all others stay. Every byte keeps its place, so a word's span in the normalised text is
its span in the original. An item gives all windows of ``window`` words (one window if it has fewer);
the automaton holds the windows and is run once over the words of each document.

The benchmark goes to the workers in blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark
takes several passes, each with an automaton of bounded size.

Defined results: a null or empty text has no words; an item without words has no window; repeated
windows count for each item that has them; an item id that is null is 'null'; rows with the same key
are scanned one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.base import bounded, small_batches, worker_cache

WINDOW = 10
BLOCK_BYTES = 8 << 20
# Bytes 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F, after lower-casing A-Z, separate words.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)
SPAN = "struct<first_word:int,last_word:int,first_byte:int,end_byte:int>"
_SPAN = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("first_byte", pa.int32()), ("end_byte", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def windows_of(text: str | None, window: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def automaton(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton:
    """Keys are windows between single spaces; values are (number of words, ids of items)."""
    held: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(text, window):
            held.setdefault(w, set()).add(item)
    machine = ahocorasick.Automaton()
    for w, ids in held.items():
        machine.add_word(f" {w.decode()} ", (w.count(b" ") + 1, len(w.decode()) + 2, sorted(ids)))
    machine.make_automaton()
    return machine


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, hit words as merged ranges, items found)."""
    words = words_of(text)
    if not words or not len(machine):
        return len(words), [], set()
    joined = f" {b' '.join(words).decode()} "
    found = [(end - size + 1, n, ids) for end, (n, size, ids) in machine.iter(joined)]
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
    first = np.searchsorted(spaces, [at for at, _, _ in found]).tolist()
    spans = [(a, a + n - 1) for a, (_, n, _) in zip(first, found, strict=True)]
    return len(words), _merged(spans), {i for _, _, ids in found for i in ids}


def _byte_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets, in the original text, of ranges of words."""
    mask = np.frombuffer(text.encode().translate(TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(begin[a]), int(end[b])) for a, b in ranges]


def _scan_block(items: list[tuple[str, str]], window: int, carry: int, tag: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = worker_cache(("decontam", tag, window), lambda: automaton(items, window))
        for batch in small_batches(batches, 0):
            n_words, spans, found = [], [], []
            for text, old, had in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                n, ranges, items_found = scan(text, machine)
                n_words.append(n)
                ranges = _merged([(s["first_word"], s["last_word"]) for s in old] + ranges)
                cuts = _byte_spans(text, ranges) if ranges else []
                spans.append([
                    {"first_word": a, "last_word": b, "first_byte": x, "end_byte": y}
                    for (a, b), (x, y) in zip(ranges, cuts, strict=True)
                ])
                found.append(sorted({*had, *items_found}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _SPAN), pa.array(found, pa.list_(pa.string()))]
                + [batch.column(4 + i) for i in range(carry)],
                ["_text", "_n_words", "_spans", "_items"] + [f"_c{i}" for i in range(carry)],
            )

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, brought over one partition at a time."""
    block, size = [], 0
    for item, text in items.toLocalIterator():
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text.encode())
    yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(key, n_words, n_hit, items, spans) and the carried columns of every document.

    ``items``: ids, as sorted strings, of the items with an occurring window. ``spans``: merged ranges
    of hit words with their byte offsets in the original text.
    """
    names = ["_key", *[f"c{i}" for i in range(len(carry))]]
    out = bounded(docs).select(
        F.col(text).alias("_text"), F.lit(0).cast("long").alias("_n_words"),
        F.array().cast(f"array<{SPAN}>").alias("_spans"), F.array().cast("array<string>").alias("_items"),
        F.col(key).alias("_c0"), *[F.col(c).alias(f"_c{i + 1}") for i, c in enumerate(carry)],
    )
    kinds = ", ".join(f"_c{i} {dict(out.dtypes)[f'_c{i}']}" for i in range(len(names)))
    wanted = benchmark.filter(F.col(item_text).isNotNull()).select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")), F.col(item_text)
    )
    for block in _blocks(wanted):
        tag = hashlib.sha256(repr(block).encode()).hexdigest()
        out = out.mapInArrow(
            _scan_block(block, window, len(names), tag),
            f"_text string, _n_words long, _spans array<{SPAN}>, _items array<string>, {kinds}",
        )
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return out.select(
        F.col("_c0").alias(key), F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
        F.col("_items").alias("items"), F.col("_spans").alias("spans"),
        *[F.col(f"_c{i + 1}").alias(c) for i, c in enumerate(carry)],
    )
