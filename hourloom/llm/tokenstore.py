"""Token ids in binary shards with a minimal perfect hash index.

Documents are encoded, dealt to shards by ranges of their key and written in ascending order of it.
A shard is one file: header, index, then the raw ids of its documents. The index is a minimal perfect
hash (hash, then displace): a key's hash names a bucket, the bucket's displacement sends the key to a
slot of its own among exactly as many slots as keys, and the slot holds a 32-bit fingerprint of the key
and the place of its ids. A lookup takes the shard from the first keys of the shards, one
displacement and one slot; a key that is absent fails the fingerprint (but for one in 2^32).

Format, little-endian: 8 bytes ``HLTOKS01``; unsigned 64-bit: documents n, tokens, buckets b, bytes per
id; b signed 64-bit displacements; n unsigned 32-bit fingerprints, padded to 8 bytes; n unsigned 64-bit
first tokens; n unsigned 64-bit counts; the ids.

Where the tokenizer drops white space and encodes each word by itself, as its definition tells, words are
encoded once per worker and a text's ids are those of its words; other tokenizers encode whole texts.

Defined results: a null or empty text has only the end id; keys may repeat, the copies of a key are
numbered in the order of their ids; a null key comes before all others; an empty table has no shards.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm.base import Remembered, bounded, cut_points, file_bytes, range_of, shared_folder, small_batches, stored, worker_cache
from hourloom.llm.spans import byte_of_character

MAGIC = b"HLTOKS01"
SHARD_BYTES = 8 << 20  # of text, on average
KEYS_PER_BUCKET = 4
CACHE_WORDS, CACHED_CHARS = 300_000, 64
SEPARATORS = " \t\r\n"
# Letters up to U+00FF, then ASCII marks.
LATIN_WORD = "^(?P<body>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-/:-@\\[-`{-~]*)$"


# --- encoding -------------------------------------------------------------------------------------


# A tokenizer of this form lower-cases, drops white space and encodes each word by itself.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def encodes_words(made: dict) -> bool:
    """Whether ids of a text are the ids of its words; told from the tokenizer's definition."""
    normal = (made.get("normalizer") or {}).get("normalizers") or []
    before = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in normal] != WORD_NORMALIZERS or [x["type"] for x in before] != ["Split", "ByteLevel"]:
        return False
    split, level = before
    blanks = normal[1].get("pattern") == {"Regex": r"\s+"} and normal[1].get("content") == " "
    words = split.get("pattern") == {"Regex": WORD_PATTERN} and split.get("behavior") == "Removed" and split.get("invert")
    plain = not level.get("add_prefix_space") and not level.get("use_regex")
    return bool(blanks and words and plain and made["model"]["type"] == "BPE" and not made["model"].get("dropout"))


class WordEncoder:
    """Ids of texts from the ids of their words, where the tokenizer allows it; else of whole texts."""

    def __init__(self, definition: bytes, end_id: int, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = encodes_words(json.loads(definition))
        self.code = "H" if width == 2 else "I"
        self.end = self._bytes([end_id])
        self.pieces, self.others = (Remembered(CACHE_WORDS, CACHED_CHARS) for _ in range(2))
        self.character = {b: c for c, b in byte_of_character().items()}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _one(self, part: str) -> bytes:
        """Ids of one piece of a text that the merges see whole: letters in lower case, or marks."""
        if not part.isascii():
            part = "".join(map(self.character.__getitem__, part.encode()))
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(part)])

    def _ids(self, known: Remembered, words: pa.Array, learn: Callable[[list[str]], Iterator[bytes]]) -> list[bytes]:
        """Ids of different words, those of new ones by ``learn``."""
        asked = words.to_numpy(zero_copy_only=False).tolist()
        new = known.lacking([asked])
        known.update(zip(new, learn(new), strict=True))
        ids = [*map(known.__getitem__, asked)]
        known.forget_long(new)
        return ids

    def _of_pieces(self, words: list[str]) -> Iterator[bytes]:
        return map(self._one, words)

    def _of_others(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), 1024):
            got = self.tokenizer.encode_batch_fast(words[start : start + 1024], add_special_tokens=False)
            yield from (self._bytes(e.ids) for e in got)

    def _of_words(self, words: pa.Array) -> _Ids:
        """Ids of different words. Case does not count, and marks behind letters are a piece of their own.

        That is said of Latin letters up to U+00FF only, which have one lower case and no marks to join;
        their pieces go to the merges at once, all other words through the whole tokenizer.
        """
        cut = pc.extract_regex(words, LATIN_WORD)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        cut = cut.drop_null()
        body = pc.utf8_lower(cut.field("body")).dictionary_encode()
        marks = cut.field("marks").dictionary_encode()
        others = words.filter(pa.array(~plain))
        parts = [
            self._ids(self.pieces, body.dictionary, self._of_pieces), self._ids(self.pieces, marks.dictionary, self._of_pieces),
            self._ids(self.others, others, self._of_others),
        ]
        first = np.cumsum([0, *map(len, parts)])
        # Two pieces of every word; the second of the others is empty.
        place = np.full((len(words), 2), first[-1], np.int64)
        place[plain, 0] = body.indices.to_numpy()
        place[plain, 1] = marks.indices.to_numpy() + first[1]
        place[~plain, 0] = np.arange(len(others)) + first[2]
        pieces = _Ids.of([*parts[0], *parts[1], *parts[2], b""], self.code)
        return pieces.gathered(place.ravel(), np.arange(2, 2 * len(words) + 1, 2))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Ids of every text, as bytes. Each different word of the column is looked up once."""
        if not self.by_words:
            got = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return pa.array([self._bytes(e.ids) + self.end for e in got], pa.binary())
        for c in SEPARATORS[1:]:
            texts = pc.replace_substring(texts, c, " ")
        split = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        words = split.flatten().dictionary_encode()
        gc.disable()  # many small objects, no cycles
        try:
            known = self._of_words(words.dictionary)
        finally:
            gc.enable()
        # The end id is the last word of each text.
        known = _Ids(np.append(known.flat, np.frombuffer(self.end, self.code)), np.append(known.size, 1))
        word = np.insert(words.indices.to_numpy(), ends, len(known.size) - 1)
        found = known.gathered(word, ends + np.arange(1, len(ends) + 1))
        offsets = (np.concatenate([[0], np.cumsum(found.size)]) * found.flat.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(found.flat)])


@dataclass
class _Ids:
    """Ids of many words or texts one after the other, and how many each has."""

    flat: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, ids: list[bytes], code: str) -> _Ids:
        flat = np.frombuffer(b"".join(ids), code)
        return cls(flat, np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize)

    def gathered(self, place: np.ndarray, ends: np.ndarray) -> _Ids:
        """The ids at ``place`` one after the other; each result holds those up to one of ``ends``."""
        many = self.size[place]
        until = np.cumsum(many)
        spot = np.arange(many.sum()) + np.repeat((np.cumsum(self.size) - self.size)[place] - (until - many), many)
        return _Ids(self.flat[spot], np.diff(np.concatenate([[0], until])[ends], prepend=0))


def _encode(held, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hashlib.blake2b(held.value, digest_size=16).hexdigest()
        encoder = worker_cache(("words", name, end_id, width), lambda: WordEncoder(held.value, end_id, width))
        for batch in small_batches(batches, 2):
            ids = encoder.encode_column(pc.fill_null(batch.column(2), ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["shard", "_key", "ids"])

    return run


# --- minimal perfect hash -------------------------------------------------------------------------


def _mix(x: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mixer of hashes and seeds."""
    with np.errstate(over="ignore"):
        z = x + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hash(keys: np.ndarray, present: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key, present or null, number of the copy)."""
    h = _mix(keys.astype(np.int64).view(np.uint64), np.where(present, 1, 2).astype(np.uint64))
    return _mix(h, copies.astype(np.uint64) + np.uint64(3))


def build_index(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of different 64-bit hashes."""
    n = len(h)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    bucket = (_mix(h, 11) % np.uint64(buckets)).astype(np.int64)
    shift = np.zeros(buckets, np.int64)
    taken = np.zeros(n, bool)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.argsort(-np.diff(starts), kind="stable"):
        members = h[order[starts[b] : starts[b + 1]]]
        if len(members) < 2:
            break
        seed = 0
        while True:
            seeds = np.arange(seed, seed + 64, dtype=np.uint64)
            slots = (_mix(members[None, :], 100 + seeds[:, None]) % np.uint64(n)).astype(np.int64)
            fits = ~taken[slots].any(axis=1)
            fits &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
            good = np.flatnonzero(fits)
            if len(good):
                shift[b] = seed + int(good[0])
                taken[slots[good[0]]] = True
                break
            seed += 64
    # Buckets of one key take the slots that are left, named directly.
    singles = np.flatnonzero(np.diff(starts) == 1)
    shift[singles] = -1 - np.flatnonzero(~taken)[: len(singles)]
    return shift


def slots_of(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    d = shift[(_mix(h, 11) % np.uint64(len(shift))).astype(np.int64)]
    placed = (_mix(h, 100 + np.maximum(d, 0).astype(np.uint64)) % np.uint64(max(1, n))).astype(np.int64)
    return np.where(d < 0, -1 - d, placed)


def check_of(h: np.ndarray) -> np.ndarray:
    return (_mix(h, 23) >> np.uint64(32)).astype(np.uint32)


# --- shard files ----------------------------------------------------------------------------------


def copy_numbers(keys: np.ndarray, present: np.ndarray) -> np.ndarray:
    """0, 1, ... for the copies of a key, in the order in which they stand."""
    order = np.lexsort((np.arange(len(keys)), keys, present))
    k, p = keys[order], present[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    at = np.arange(len(k))
    out = np.empty(len(k), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def shard_bytes(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    n = len(keys)
    present = np.array([k is not None for k in keys], bool)
    numbers = np.array([k or 0 for k in keys], np.int64)
    h = key_hash(numbers, present, copy_numbers(numbers, present))
    counts = np.array([len(x) // width for x in ids], np.uint64)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint64)
    shift = build_index(h)
    slot = slots_of(h, shift, n)
    tables = [np.zeros(n, t) for t in (np.uint32, np.uint64, np.uint64)]
    for table, values in zip(tables, (check_of(h), firsts, counts), strict=True):
        table[slot] = values
    head = MAGIC + np.array([n, int(counts.sum()), len(shift), width], "<u8").tobytes()
    check = tables[0].astype("<u4").tobytes()
    parts = [head, shift.astype("<i8").tobytes(), check + b"\0" * (-len(check) % 8), *[t.astype("<u8").tobytes() for t in tables[1:]]]
    return b"".join(parts + ids)


class Shard:
    """An opened shard file; a lookup touches one displacement and one slot."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("this is no shard of token ids")
        self.n, self.tokens, buckets, self.width = np.frombuffer(data, "<u8", 4, 8).tolist()
        at = 40
        self.shift = np.frombuffer(data, "<i8", buckets, at)
        at += 8 * buckets
        self.check = np.frombuffer(data, "<u4", self.n, at)
        at += 4 * self.n + (-4 * self.n % 8)
        self.first = np.frombuffer(data, "<u8", self.n, at)
        self.count = np.frombuffer(data, "<u8", self.n, at + 8 * self.n)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.tokens, at + 16 * self.n)

    def find(self, keys: np.ndarray, present: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for keys that the shard does not hold."""
        if not self.n:
            return np.full(len(keys), -1)
        h = key_hash(keys, present, copies)
        slot = slots_of(h, self.shift, self.n)
        return np.where(self.check[slot] == check_of(h), slot, -1)

    def get(self, key: int | None, copy: int = 0) -> np.ndarray | None:
        slot = int(self.find(np.array([key or 0]), np.array([key is not None]), np.array([copy]))[0])
        return None if slot < 0 else self.ids[int(self.first[slot]) : int(self.first[slot] + self.count[slot])]


def get_by_ranges(read: Callable[[int, int], bytes], key: int | None, copy: int = 0) -> np.ndarray | None:
    """The ids of one key from a shard of which only the header, one displacement and one slot are read.

    ``read(start, length)`` gives a range of the file.
    """
    head = read(0, 40)
    if head[:8] != MAGIC:
        raise ValueError("this is no shard of token ids")
    n, _, buckets, width = np.frombuffer(head, "<u8", 4, 8).tolist()
    if not n:
        return None
    h = key_hash(np.array([key or 0]), np.array([key is not None]), np.array([copy]))
    bucket = int(_mix(h, 11)[0] % np.uint64(buckets))
    shift = np.frombuffer(read(40 + 8 * bucket, 8), "<i8")
    slot = int(slots_of(h, np.full(buckets, shift[0]), n)[0])
    at = 40 + 8 * buckets
    if np.frombuffer(read(at + 4 * slot, 4), "<u4")[0] != check_of(h)[0]:
        return None
    at += 4 * n + (-4 * n % 8)
    first, count = (int(np.frombuffer(read(at + 8 * k, 8), "<u8")[0]) for k in (slot, n + slot))
    return np.frombuffer(read(at + 16 * n + first * width, count * width), f"<u{width}")


def _system(uri: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)


def _write_file(uri: str, data: bytes) -> None:
    """Complete or not at all: a second attempt of the task replaces the file."""
    system, path = _system(uri)
    partial = f"{path}.{uuid.uuid4().hex}.part"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(partial) as out:
        out.write(data)
    if system.get_file_info(path).type != pa_fs.FileType.NotFound:
        system.delete_file(path)
    system.move(partial, path)


def _read_file(uri: str) -> bytes:
    system, path = _system(uri)
    with system.open_input_file(path) as f:
        return f.read()


def _shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.toks"


def _write_shards(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, ids = None, [], []

        def close() -> pa.RecordBatch:
            _write_file(_shard_uri(folder, shard), shard_bytes(keys, ids, width))
            tokens = sum(map(len, ids)) // width
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "docs", "tokens"])

        for batch in batches:
            for s, key, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard and keys:
                    yield close()
                    keys, ids = [], []
                shard = s
                keys.append(key)
                ids.append(x)
        if keys:
            yield close()

    return run


# --- the store ------------------------------------------------------------------------------------


@dataclass
class TokenStore:
    """Where the shards lie: first keys of the ranges, tokens before each shard."""

    folder: str
    cuts: list[int]
    starts: dict[int, int] = field(default_factory=dict)

    def shard_of(self, key: int | None) -> int:
        at = 0 if key is None else int(np.searchsorted(self.cuts, key, "right")) - 1
        return max(0, at)

    def get(self, key: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        at = self.shard_of(key)
        if at not in self.starts:
            return None
        system, path = _system(_shard_uri(self.folder, at))
        with system.open_input_file(path) as f:
            return get_by_ranges(lambda start, length: f.read_at(length, start), key, copy)

    def read(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, start, n_tokens, ids) of the keys, by lookups; copies of a key are numbered.

        ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned 32-bit
        integers. Keys that the store does not hold get nulls.
        """
        folder, starts = self.folder, self.starts
        dealt = keys.select(F.col(key).cast("long").alias("_key")).withColumn("shard", range_of("_key", self.cuts))

        def look_up(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            column = table.column("_key").combine_chunks()
            present = ~column.is_null().to_numpy(zero_copy_only=False)
            numbers = column.fill_null(0).to_numpy(zero_copy_only=False)
            if shard not in starts:
                nothing = [None] * len(numbers)
                return pa.table([column, pa.array(nothing, pa.int64()), pa.array(nothing, pa.int64()), pa.array(nothing, pa.binary())], ["_key", "start", "n_tokens", "ids"])
            held = Shard(_read_file(_shard_uri(folder, shard)))
            slot = held.find(numbers, present, copy_numbers(numbers, present))
            first, count = held.first[slot].astype(np.int64), held.count[slot].astype(np.int64)
            lost = slot < 0
            ids = [
                None if gone else held.ids[a : a + n].astype("<u4").tobytes()
                for a, n, gone in zip(first.tolist(), count.tolist(), lost.tolist(), strict=True)
            ]
            return pa.table(
                [column, pa.array(first + starts[shard], mask=lost), pa.array(count, mask=lost), pa.array(ids, pa.binary())],
                ["_key", "start", "n_tokens", "ids"],
            )

        # As many tasks as shards, however small the keys are.
        spread = dealt.repartition(max(1, 2 * len(starts)), "shard")
        found = spread.groupBy("shard").applyInArrow(look_up, "_key long, start long, n_tokens long, ids binary")
        return found.withColumnRenamed("_key", key)


def write_store(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2,
    shard_bytes_wanted: int = SHARD_BYTES,
) -> TokenStore:
    """Encode, write the shards and return the store. ``width`` is 2 for ids below 65536, else 4."""
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(file_bytes(tokenizer))
    rows = bounded(docs).select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    cuts = cut_points(rows, "_key", max(1, -(-size // shard_bytes_wanted)))
    folder = shared_folder(spark, "tokens")
    encoded = rows.select(range_of("_key", cuts).alias("shard"), "_key", "_text").mapInArrow(
        _encode(held, end_id, width), "shard int, _key long, ids binary"
    )
    # A task for each shard.
    dealt = encoded.repartitionById(max(1, len(cuts)), "shard")
    placed = dealt.sortWithinPartitions("shard", F.col("_key").asc_nulls_first(), "ids")
    written = stored(placed.mapInArrow(_write_shards(folder, width), "shard long, docs long, tokens long"), "manifest")
    starts, before = {}, 0
    # One row per shard file.
    for shard, tokens in sorted((r["shard"], r["tokens"]) for r in written.collect()):
        starts[shard] = before
        before += tokens
    return TokenStore(folder, cuts, starts)
