"""Quality by nearest neighbours among labelled latent-semantic vectors.

A document becomes counts of terms that do not depend on its language: trigrams of character classes,
and measures of repetition, case and marks in steps. A bounded sample of labelled documents gives the
weights of the terms and, by a singular value decomposition, a latent space of ``DIMS`` dimensions. The
sample's unit vectors and labels go to the workers; every document is compared with all of them by
cosine, in blocks, and its ``NEIGHBOURS`` nearest vote with their similarity as weight.

Defined results: a null text is an empty text and is scored like any other; a document with several
labels counts as good if one of them is 1; equal similarities go to the first vector in the order of
the sample, which is the order of a hash of the keys; without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.base import bounded, small_batches

SAMPLE = 1500  # bound of the labelled sample, in documents
DIMS, NEIGHBOURS, BLOCK = 24, 25, 512
CLASSES = 16
STEPS = 12


def _class_table() -> np.ndarray:
    """A class for every byte: letters by vowel and case, digits, spaces, marks one by one."""
    table = np.full(256, 15, np.uint16)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 14
        elif c.islower():
            table[b] = 0 if c in "aeiou" else 1
        elif c.isupper():
            table[b] = 2 if c in "AEIOU" else 3
        elif c.isdigit():
            table[b] = 4
        elif c == " ":
            table[b] = 5
        elif c == "\n":
            table[b] = 6
        elif c in ".,":
            table[b] = 7 + ".,".index(c)
        elif c in "!?":
            table[b] = 9
        elif c in "|#$%&*":
            table[b] = 10
        elif c in "<>{}[]()=/\\_@":
            table[b] = 11
        elif c in "'\"":
            table[b] = 12
        elif c in ":;-+":
            table[b] = 13
    return table


_CLASS = _class_table()
TRIGRAMS = CLASSES**3
N_MEASURES = 8
TERMS = TRIGRAMS + N_MEASURES * (STEPS + 1)
MEASURE_WEIGHT = 0.25


def _measures(data: bytes, classes: np.ndarray) -> list[float]:
    """Shares between 0 and 1."""
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    lines = data.split(b"\n")
    different = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    kinds = np.bincount(classes, minlength=CLASSES)
    letters = max(1, int(kinds[:4].sum() + kinds[14]))
    # Different words, compared with what a text of that length usually has.
    richness = different / n ** 0.85
    return [
        again / n, min(1.0, richness / 2), len(set(lines)) / len(lines), float(kinds[2] + kinds[3]) / letters,
        float(kinds[9:13].sum()) / size * 4, float(kinds[4]) / size * 4, float(kinds[5] + kinds[6]) / size * 2,
        min(1.0, np.log2(size) / 20),
    ]


def term_counts(text: str | None) -> np.ndarray:
    """The document's row of the term matrix: dampened counts, unit length in each part."""
    data = (text or "").encode()
    out = np.zeros(TERMS, np.float32)
    c = _CLASS[np.frombuffer(data, np.uint8)]
    if len(c) >= 3:
        counts = np.bincount((c[:-2] * 256 + c[1:-1] * 16 + c[2:]).astype(np.int64), minlength=TRIGRAMS)
        share = np.sqrt(counts / counts.sum())
        out[:TRIGRAMS] = share
    for i, x in enumerate(_measures(data, c)):
        # A share lies between two steps and counts for both.
        at = min(1.0, max(0.0, x)) * STEPS
        low = min(int(at), STEPS - 1)
        base = TRIGRAMS + i * (STEPS + 1) + low
        out[base], out[base + 1] = MEASURE_WEIGHT * (1 - (at - low)), MEASURE_WEIGHT * (at - low)
    return out


@dataclass
class Model:
    """Projection of term rows, and the labelled unit vectors."""

    mean: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        v = (rows - self.mean) @ self.projection
        return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of the neighbours' similarity that belongs to label 1."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        out = np.empty(len(rows))
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(rows), BLOCK):
            cosine = self.latent(rows[start : start + BLOCK]) @ self.vectors.T
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :k] if k == len(self.labels) else _nearest(cosine, k)
            weight = np.maximum(1e-6, np.take_along_axis(cosine, near, axis=1)).astype(np.float64)
            out[start : start + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k most similar; at equal similarity the first."""
    cut = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above = cosine > cut
    spare = k - above.sum(axis=1, keepdims=True)
    ties = cosine == cut
    take = above | (ties & (ties.cumsum(axis=1) <= spare))
    return np.nonzero(take)[1].reshape(len(cosine), k)


def fit(rows: np.ndarray, labels: np.ndarray, dims: int = DIMS) -> Model:
    if not len(rows):
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    spread = rows.std(axis=0) + 1e-3
    weight = 1 / np.sqrt(spread)
    mean = rows.mean(axis=0)
    centred = (rows - mean) * weight
    # Singular vectors of a wide matrix from the small matrix of its rows' products.
    values, left = np.linalg.eigh((centred @ centred.T).astype(np.float64))
    top = np.argsort(-values, kind="stable")[:dims]
    basis = (left[:, top].T @ centred) / np.sqrt(np.maximum(values[top], 1e-9))[:, None]
    projection = (weight[:, None] * basis.T).astype(np.float32)
    model = Model(mean.astype(np.float32), projection, np.zeros((0, 1), np.float32), labels)
    model.vectors = model.latent(rows).astype(np.float32)
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1, rows=256):
        rows = [term_counts(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["h", "terms", "label"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents that are first in the order of a hash of their keys."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & learn).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("label"))
    # Ids and labels only: a bounded number of rows, broadcast to the documents.
    picked = marked.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    rows = bounded(docs).select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")
    # Rows that share a key are one document, so that the sample is bounded however often a key repeats.
    rows = rows.groupBy("_key", "label").agg(F.min("_text").alias("_text"))
    found = rows.select(F.xxhash64("_key", "_text").alias("h"), "_text", F.col("label").cast("double")).mapInArrow(
        _terms, "h long, terms binary, label double"
    ).toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, TERMS), np.float32), np.zeros(0))
    order = np.argsort(found.column("h").to_numpy(), kind="stable")
    packed = found.column("terms")
    terms = np.empty((len(order), TERMS), np.float32)
    for row, at in enumerate(order.tolist()):
        terms[row] = np.frombuffer(packed[at].as_buffer(), np.float32)
    return fit(terms, found.column("label").to_numpy()[order])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, rows=BLOCK):
            rows = np.stack([term_counts(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(rows), pa.float64())], ["_key", "score"])

    rows = bounded(docs).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(run, f"_key {kind}, score double").withColumnRenamed("_key", key)
