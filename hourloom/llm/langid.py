"""Language identification by prediction by partial matching over bytes.

For every language a context tree counts which byte follows each context of up to ``ORDER`` bytes in a
bounded sample of labelled documents. The statistics are then frozen. A byte that a context has seen
c of T times, with q different successors, has probability c / (T + q); any other byte costs an escape,
q / (T + q), and is predicted by the next shorter context, renormalised over the bytes that are not
excluded; the shortest context falls back to the uniform distribution. A text's score in a language is
its exact code length in bits, over the whole text; the shortest code wins, ties go to the first name.

The code lengths of the most frequent contexts are laid out as one table of bounded size with a column
per language, so that scoring is a lookup per byte. Contexts that no language has seen use their longest
known suffix. Bytes behind a context without room in the table are searched in sorted arrays of the
grams seen, language by language, which gives the same code lengths: every frozen count is used.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows without a language
are not learned from; if nothing could be learned every text is ``und``; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.base import bounded, small_batches, worker_cache

ORDER = 3
DOCS_PER_LANGUAGE = 600  # bound of the labelled sample
TABLE_BYTES = 48 << 20  # of the table; what does not fit is searched
UNKNOWN = "und"
_START = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")
_SLICE, _ROWS = 1 << 18, 1024
_SEARCHED = (1 << 16) - 1  # row number of contexts outside the table


def normal_bytes(text: str) -> bytes:
    return text.lower().encode()


def grams(data: bytes) -> np.ndarray:
    """Each byte behind its ORDER predecessors, as 32-bit numbers."""
    b = np.frombuffer(_START + data, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


@dataclass
class Statistics:
    """Frozen counts: for each language the grams seen and how often."""

    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]


def _context_counts(stats: Statistics, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Contexts of this order, and per language (position = context index * 256 + byte, count)."""
    mask = np.uint32((1 << (8 * (order + 1))) - 1)
    keys = [g & mask for g in stats.grams]
    contexts = np.unique(np.concatenate([k >> np.uint32(8) for k in keys]))
    out = []
    for k, n in zip(keys, stats.counts, strict=True):
        at = np.searchsorted(contexts, k >> np.uint32(8)) * 256 + (k & np.uint32(255)).astype(np.int64)
        places, back = np.unique(at, return_inverse=True)
        out.append((places, np.bincount(back, n).astype(np.float64)))
    return contexts, out


def _predictions(keep: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], parents: np.ndarray) -> np.ndarray:
    """Probabilities after the kept contexts: (context, byte, language)."""
    out = parents.astype(np.float64)
    for lang, (at, n) in enumerate(counts):
        first, last = np.searchsorted(at, [keep[0] * 256, keep[-1] * 256 + 256])
        at, n = at[first:last], n[first:last]
        row = np.searchsorted(keep, at // 256)
        ok = keep[np.minimum(row, len(keep) - 1)] == at // 256
        c = np.zeros((len(keep), 256))
        c[row[ok], at[ok] % 256] = n[ok]
        seen = c > 0
        t, q = c.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        lower = np.where(seen, 0.0, out[:, :, lang])
        rest = lower.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            # A context that has seen all bytes has nothing to escape to.
            escape = np.where(q < 256, q, 0)
            p = np.where(seen, c / (t + escape), escape / (t + escape) * lower / rest)
        out[:, :, lang] = np.where(t > 0, p, out[:, :, lang])
    return out


class Searched:
    """Exact code lengths of one language from sorted arrays of its grams and contexts, order by order."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        lower = None
        for order in range(ORDER + 1):
            keys, back = np.unique(gram & np.uint32((1 << (8 * (order + 1))) - 1), return_inverse=True)
            c = np.bincount(back, count)
            contexts, at = np.unique(keys >> np.uint32(8), return_inverse=True)
            t, q = np.bincount(at, c), np.bincount(at)
            # The suffix of a gram that was seen was seen too.
            below = np.full(len(keys), 1 / 256) if lower is None else lower[np.searchsorted(self.grams[-1], keys & np.uint32((1 << (8 * order)) - 1))]
            escape = np.where(q < 256, q, 0)
            rest = np.maximum(1e-300, 1 - np.bincount(at, below))
            lower = c / (t + escape)[at]
            self.grams.append(keys)
            self.bits.append(-np.log2(lower))
            self.contexts.append(contexts)
            self.escapes.append(np.where(escape > 0, -np.log2(np.maximum(1, escape) / (t + escape) / rest), 0.0))

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram."""
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            key = gram[todo] & np.uint32((1 << (8 * (order + 1))) - 1)
            at = np.minimum(np.searchsorted(self.grams[order], key), len(self.grams[order]) - 1)
            seen = self.grams[order][at] == key
            out[todo[seen]] += self.bits[order][at[seen]]
            todo, context = todo[~seen], key[~seen] >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            out[todo] += np.where(self.contexts[order][at] == context, self.escapes[order][at], 0.0)
        out[todo] += 8  # uniform over the bytes
        return out


class CodeTable:
    """Bits of every (context row, byte) in every language, and the way to those without a row."""

    def __init__(self, stats: Statistics):
        self.languages = stats.languages
        n_lang = len(stats.languages)
        # Row 0 is the uniform distribution; then the rows of the contexts, shorter ones first.
        room = min(_SEARCHED, max(1, TABLE_BYTES // (256 * 4 * n_lang)))
        # Filled in place; rows that are never reached take no memory.
        table, used = np.empty((room, 256, n_lang), np.float32), 1
        table[0] = 1 / 256
        step = max(1, 4 * _ROWS // n_lang)
        self.row_of = np.zeros(1, np.uint16)  # by context value, for the order so far
        self.searched: list[Searched] = []
        for order in range(ORDER + 1):
            contexts, counts = _context_counts(stats, order)
            keep = np.arange(len(contexts))
            if used + len(contexts) > room:
                weight = np.zeros(len(contexts))
                for at, n in counts:
                    weight += np.bincount(at // 256, n, len(contexts))
                keep = np.sort(np.argsort(-weight, kind="stable")[: max(0, room - used)])
            if order:
                self.row_of = np.tile(self.row_of, 256)
            # A context without room leaves none for longer ones, so the suffix of a kept context is kept.
            parents = self.row_of[contexts[keep]]
            for start in range(0, len(keep), step):
                part = slice(start, start + step)
                made = _predictions(keep[part], counts, table[parents[part]])
                table[used + start : used + start + len(made)] = made
            self.row_of[contexts] = _SEARCHED
            self.row_of[contexts[keep]] = used + np.arange(len(keep))
            used += len(keep)
        if (self.row_of == _SEARCHED).any():
            self.searched = [Searched(g, n) for g, n in zip(stats.grams, stats.counts, strict=True)]
        table = table[:used]
        np.log2(table, out=table)
        self.bits = np.negative(table, out=table).reshape(-1, n_lang)

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        out = np.zeros(len(self.languages))
        held = _START + data
        step = max(1, min(_SLICE, (1 << 22) // len(out)))
        for start in range(0, len(data), step):
            b = np.frombuffer(held, np.uint8)[start : start + step + ORDER].astype(np.int32)
            context = (b[:-3] << 16) | (b[1:-2] << 8) | b[2:-1]
            row, last = self.row_of[context], b[3:]
            if self.searched:
                rest = row == _SEARCHED
                gram, n = np.unique((context[rest].astype(np.uint32) << np.uint32(8)) | last[rest].astype(np.uint32), return_counts=True)
                out += [n @ one.lengths(gram) for one in self.searched]
                row, last = row[~rest], last[~rest]
            at = row.astype(np.int64) * 256 + last
            out += np.ones(len(at), np.float32) @ self.bits.take(at, axis=0)
        return out


def identify(text: str | None, table: CodeTable | None) -> tuple[str, float]:
    """(language, posterior under equal priors)."""
    if table is None or text is None or not _LETTER.search(text):
        return UNKNOWN, 0.0
    bits = table.code_lengths(normal_bytes(text))
    best = int(bits.argmin())
    return table.languages[best], float(1 / np.exp2(np.maximum(-1000.0, bits[best] - bits)).sum())


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1, size=1 << 20):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(grams(normal_bytes(text)))
        for lang, parts in by_lang.items():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Statistics:
    """Counts of a sample of about ``per_language`` documents of each language, drawn by a hash of the key."""
    rows = bounded(docs).filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("_text"), F.xxhash64(key).alias("_h")
    )
    # One row per language, beside rows that are not shuffled.
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = (F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("_n")) * (1 << 30)).cast("long")
    sample = rows.join(F.broadcast(sizes), "lang").filter(F.col("_h").bitwiseAND((1 << 30) - 1) < share)
    counted = sample.select("lang", "_text").mapInArrow(_count_grams, "lang string, gram long, n long")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return Statistics([], [], [])
    names = found.column("lang").combine_chunks().dictionary_encode()
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(names.indices.to_numpy(), kind="stable")
    picks = np.split(order, np.cumsum(np.bincount(names.indices.to_numpy()))[:-1])
    by_name = sorted(zip(names.dictionary.to_pylist(), picks, strict=True), key=lambda x: x[0])
    return Statistics([x for x, _ in by_name], [gram[p].astype(np.uint32) for _, p in by_name], [n[p] for _, p in by_name])


def predict(docs: DataFrame, stats: Statistics, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score) and the carried columns of every row."""
    held = docs.sparkSession.sparkContext.broadcast(stats)
    tag = (tuple(stats.languages), int(sum(int(c.sum()) for c in stats.counts)), sum(len(g) for g in stats.grams))
    rows = bounded(docs).select(F.col(text).alias("_text"), F.col(key).alias("_c0"), *[F.col(c).alias(f"_c{i + 1}") for i, c in enumerate(carry)])
    n = 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(("ppm", tag), lambda: CodeTable(held.value)) if held.value.languages else None
        for batch in small_batches(batches, 0):
            got = [identify(t.as_py(), table) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), *[batch.column(1 + i) for i in range(n)]],
                ["lang_pred", "score", *[f"_c{i}" for i in range(n)]],
            )

    kinds = ", ".join(f"_c{i} {dict(rows.dtypes)[f'_c{i}']}" for i in range(n))
    out = rows.mapInArrow(run, f"lang_pred string, score double, {kinds}")
    return out.select(F.col("_c0").alias(key), "lang_pred", "score", *[F.col(f"_c{i + 1}").alias(c) for i, c in enumerate(carry)])
