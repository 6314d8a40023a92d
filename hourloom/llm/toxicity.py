"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words, and every window is scored. A word's input joins two
vectors: its own, if the word is in the learned vocabulary, and the mean of the vectors of its character
trigrams (hashed). Two gated recurrent layers read the window in either direction, attention pools
their states into one vector, and a linear unit gives the window's logit. A document's logit is the
largest of its windows; a fitted scale turns it into a probability.

Training sees a bounded sample of labelled documents. As the label belongs to the document, the window
that scores highest stands for it in each step (multiple instances), after a start in which words and
trigrams carry their smoothed log odds between the classes.

Defined results: a null or empty text is one window without words and is scored like any other; a
document with several labels counts as toxic if one of them is 1; without labels of both classes every
score is the share of label 1, or 0 if there is none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.base import bounded, small_batches, worker_cache

WINDOW, STRIDE = 32, 16  # any passage of up to 17 words lies whole in a window
SAMPLE = 2000  # bound of the labelled sample, in documents of each class
TRAIN_WINDOWS = 350  # bound of a document's windows in training, spread over the whole text
VOCABULARY, TRIGRAM_BUCKETS = 20_000, 1 << 13
WORD_DIMS = CHAR_DIMS = 4
HIDDEN, ATTENTION = 8, 8
EPOCHS, BATCH, RATE = 8, 64, 0.01
PRIOR, INPUT_RATE, DROP, HELD_OUT = 10, 0.1, 0.1, 0.25
_WORD = re.compile(r"[^\W_]+")
_BATCH_WINDOWS = 1024


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every character trigram of every word, word number of each)."""
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    with np.errstate(over="ignore"):
        h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = owner[:-2] == owner[2:]
    return (h[inside] >> np.uint64(64 - TRIGRAM_BUCKETS.bit_length() + 1)).astype(np.int64), owner[:-2][inside]


def window_starts(n_words: int, most: int | None = None) -> np.ndarray:
    """First words of the windows: every stride, until one reaches the end."""
    n = 1 if n_words <= WINDOW else 1 + -(-(n_words - WINDOW) // STRIDE)
    starts = np.arange(n) * STRIDE
    if most and n > most:
        starts = starts[np.linspace(0, n - 1, most).astype(int)]
    return starts


def windows(ids: np.ndarray, most: int | None = None) -> np.ndarray:
    """(window, place) -> word id; -1 where the text has ended."""
    at = window_starts(len(ids), most)[:, None] + np.arange(WINDOW)[None, :]
    padded = np.concatenate([ids, [-1]])
    return padded[np.minimum(at, len(ids))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Weights by name; ``words`` numbers the vocabulary."""

    words: dict[str, int]
    weights: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Input vectors of a list of words (one row if there is none), their numbers and trigrams."""
        words = words or [""]
        known = np.array([self.words.get(w, 0) for w in words], np.int64)
        grams, owner = trigram_buckets(words)
        n = np.maximum(1, np.bincount(owner, minlength=len(words)))
        chars = np.stack([np.bincount(owner, c[grams], len(words)) for c in self.weights["chars"].T], axis=1) / n[:, None]
        x = np.concatenate([self.weights["word"][known], chars], axis=1).astype(np.float32)
        return x, known, (grams, owner, n)


def _direction(x_zr, x_n, order, u_zr, u_n, alive, tape=None):
    """States of one layer, place by place; dead places keep the state."""
    n, steps = alive.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((steps, n, HIDDEN), np.float32)
    full = alive.all(axis=0)
    for t in range(steps):
        zr = x_zr.take(order[t], axis=0)
        zr += h @ u_zr
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        hu = h @ u_n
        c = x_n.take(order[t], axis=0)
        c += r * hu
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        if tape is not None:
            tape.append((h, z, r, hu, c))
        h = new if full[t] else np.where(alive[:, t : t + 1], new, h)
        states[t] = h
    return states


def _pool(states, alive, w):
    """Attention over the places: (pooled, weights, activations)."""
    a = np.tanh(states @ w["att_w"] + w["att_b"])
    e = a @ w["att_v"]
    e = np.where(alive.T, e, -30.0)
    e = np.exp(e - e.max(axis=0, keepdims=True))
    share = e / e.sum(axis=0, keepdims=True)
    return np.einsum("tn,tnh->nh", share, states), share, a


def project(net: Network, x: np.ndarray) -> list[np.ndarray]:
    """What the input rows add to the gates: forward and backward, (update, reset) and candidate."""
    w = net.weights
    return [x @ w[f"{side}_w{gate}"] + w[f"{side}_b{gate}"] for side in "fb" for gate in ("zr", "n")]


def forward(net: Network, ids: np.ndarray, gates: list[np.ndarray], keep: bool = False):
    """Logits of windows of word ids into the rows of ``gates``."""
    w = net.weights
    alive = ids >= 0
    steps = ids.shape[1]
    place = np.ascontiguousarray(np.maximum(ids, 0).T)
    tapes, both = ([], []), []
    for i, (side, tape) in enumerate(zip("fb", tapes, strict=True)):
        zr, n = gates[2 * i : 2 * i + 2]
        order = place if side == "f" else place[::-1]
        live = alive if side == "f" else alive[:, ::-1]
        states = _direction(zr, n, order, w[f"{side}_uzr"], w[f"{side}_un"], live, tape if keep else None)
        both.append(states if side == "f" else states[::-1])
    states = np.concatenate(both, axis=2)
    pooled, share, act = _pool(states, alive, w)
    logit = pooled @ w["out_w"] + w["out_b"][0]
    return (logit, (alive, place, tapes, states, pooled, share, act, steps)) if keep else logit


def backward(net: Network, x: np.ndarray, saved, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights and of the input rows."""
    w = net.weights
    alive, place, tapes, states, pooled, share, act, steps = saved
    g = {"out_w": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()])}
    d_pooled = d_logit[:, None] * w["out_w"][None, :]
    d_states = share[:, :, None] * d_pooled[None]
    d_share = (states * d_pooled[None]).sum(axis=2)
    d_e = share * (d_share - (share * d_share).sum(axis=0, keepdims=True))
    d_act = d_e[:, :, None] * w["att_v"] * (1 - act**2)
    g["att_v"] = np.einsum("tn,tna->a", d_e, act)
    g["att_w"] = np.einsum("tnh,tna->ha", states, d_act)
    g["att_b"] = d_act.sum(axis=(0, 1))
    d_states = d_states + d_act @ w["att_w"].T
    d_x = np.zeros_like(x)
    for side, tape in zip("fb", tapes, strict=True):
        part = d_states[:, :, :HIDDEN] if side == "f" else d_states[::-1, :, HIDDEN:]
        order = place if side == "f" else place[::-1]
        live = alive if side == "f" else alive[:, ::-1]
        u_zr, u_n = w[f"{side}_uzr"], w[f"{side}_un"]
        g_uzr, g_un = np.zeros_like(u_zr), np.zeros_like(u_n)
        d_zr_x = np.zeros((len(x), 2 * HIDDEN), np.float32)
        d_n_x = np.zeros((len(x), HIDDEN), np.float32)
        dh = np.zeros((place.shape[1], HIDDEN), np.float32)
        for t in reversed(range(steps)):
            h, z, r, hu, c = tape[t]
            dh = dh + part[t]
            on = live[:, t : t + 1]
            d_new = np.where(on, dh, 0)
            d_c = d_new * z * (1 - c**2)
            d_z = d_new * (c - h) * z * (1 - z)
            d_r = d_c * hu * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            g_uzr += h.T @ d_zr
            g_un += h.T @ (d_c * r)
            np.add.at(d_zr_x, order[t], d_zr)
            np.add.at(d_n_x, order[t], d_c)
            dh = np.where(on, dh * (1 - z) + d_zr @ u_zr.T + (d_c * r) @ u_n.T, dh)
        g[f"{side}_uzr"], g[f"{side}_un"] = g_uzr, g_un
        g[f"{side}_wzr"], g[f"{side}_wn"] = x.T @ d_zr_x, x.T @ d_n_x
        g[f"{side}_bzr"], g[f"{side}_bn"] = d_zr_x.sum(axis=0), d_n_x.sum(axis=0)
        d_x += d_zr_x @ w[f"{side}_wzr"].T + d_n_x @ w[f"{side}_wn"].T
    return g, d_x


def _start(docs: list[list[str]], labels: np.ndarray, rng) -> Network:
    """Small random weights; the first word and character dimension start at the log odds."""
    n1, n0 = labels.sum() + 1.0, (1 - labels).sum() + 1.0
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in zip(docs, labels, strict=True):
        seen[int(y)].update(set(words))
    share = n1 / (n1 + n0)
    # Log odds of rare words are drawn to zero by PRIOR imagined documents.
    odds = lambda a, b: np.log((a + PRIOR * share) / (b + PRIOR * (1 - share))) - np.log(n1 / n0)
    total = seen[0] + seen[1]
    ranked = sorted((w for w, n in total.items() if n >= 2), key=lambda w: (-abs(odds(seen[1][w], seen[0][w])), w))[: VOCABULARY - 1]
    words = {w: i + 1 for i, w in enumerate(ranked)}
    small = lambda *shape: (rng.normal(0, 0.3, shape)).astype(np.float32)
    w = {"word": small(len(words) + 1, WORD_DIMS) * 0.1, "chars": small(TRIGRAM_BUCKETS, CHAR_DIMS) * 0.1}
    for word, i in words.items():
        w["word"][i, 0] = odds(seen[1][word], seen[0][word]) / 2
    counts = np.zeros((2, TRIGRAM_BUCKETS))
    for y in (0, 1):
        vocabulary = list(seen[y])
        if vocabulary:
            grams, owner = trigram_buckets(vocabulary)
            counts[y] = np.bincount(grams, np.array([seen[y][v] for v in vocabulary])[owner], TRIGRAM_BUCKETS)
    rate = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    both = rate.sum(axis=0) * 25 / np.maximum(1e-9, rate.sum()) + 1e-4
    w["chars"][:, 0] = np.log((rate[1] + both) / (rate[0] + both)) / 2
    size = WORD_DIMS + CHAR_DIMS
    for side in "fb":
        w |= {f"{side}_wzr": small(size, 2 * HIDDEN), f"{side}_wn": small(size, HIDDEN), f"{side}_uzr": small(HIDDEN, 2 * HIDDEN), f"{side}_un": small(HIDDEN, HIDDEN), f"{side}_bzr": np.zeros(2 * HIDDEN, np.float32), f"{side}_bn": np.zeros(HIDDEN, np.float32)}
    w |= {"att_w": small(2 * HIDDEN, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": small(ATTENTION), "out_w": small(2 * HIDDEN), "out_b": np.array([-1.0], np.float32)}
    return Network(words, w)


def _lookup(docs: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """The different words, and each document as numbers into them."""
    index: dict[str, int] = {}
    out = [np.array([index.setdefault(w, len(index)) for w in words], np.int64) for words in docs]
    return list(index), out


def _logits(net: Network, ids: list[np.ndarray], gates: list[np.ndarray], most: int | None = None) -> list[np.ndarray]:
    """Window logits of each document; windows of equal length are scored together."""
    parts = [windows(i, most) for i in ids]
    if not parts:
        return []
    every = np.concatenate(parts)
    order = np.argsort((every >= 0).sum(axis=1), kind="stable")
    scored = np.empty(len(every), np.float32)
    for a in range(0, len(every), _BATCH_WINDOWS):
        pick = order[a : a + _BATCH_WINDOWS]
        scored[pick] = forward(net, every[pick], gates)
    return np.split(scored, np.cumsum([len(p) for p in parts])[:-1])


def _highest(net: Network, ids: list[np.ndarray], vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the highest window logit, and the words of that window."""
    every = _logits(net, ids, project(net, net.inputs(vocabulary)[0]), TRAIN_WINDOWS)
    top = [windows(i, TRAIN_WINDOWS)[int(s.argmax())] for i, s in zip(ids, every, strict=True)]
    return np.array([s.max() for s in every], np.float64), np.stack(top)


def _loss(logit: np.ndarray, labels: np.ndarray) -> float:
    return float((np.logaddexp(0, logit) - labels * logit).mean())


def fit(docs: list[list[str]], labels: np.ndarray, class_weight: tuple[float, float] = (1.0, 1.0), seed: int = 5) -> Network:
    """Train on documents given as words. ``class_weight``: how many documents of the labelled table each stands for.

    A part of the documents is held out: it chooses the epoch and fits the scale of the logits.
    """
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Network({}, {}, constant=float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    aside = rng.random(len(labels)) < HELD_OUT
    if len(set(labels[aside])) < 2 or len(set(labels[~aside])) < 2:
        aside[:] = False
    learn = np.flatnonzero(~aside)
    judge = np.flatnonzero(aside) if aside.any() else learn
    net = _start([docs[i] for i in learn], labels[learn], rng)
    vocabulary, ids = _lookup(docs)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step, best = 0, None
    for _ in range(EPOCHS):
        # The highest window stands for its document.
        _, top = _highest(net, [ids[i] for i in learn], vocabulary)
        order = rng.permutation(len(learn))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            window = top[pick]
            used, back = np.unique(np.maximum(window, 0), return_inverse=True)
            local = np.where(window < 0, -1, back.reshape(window.shape))
            x, known, (grams, owner, n) = net.inputs([vocabulary[i] for i in used] if len(vocabulary) else [])
            kept = (rng.random((len(x), 1)) >= DROP).astype(np.float32)
            x = x * kept
            logit, saved = forward(net, local, project(net, x), keep=True)
            d = ((_sigmoid(logit) - labels[learn[pick]]) / len(pick)).astype(np.float32)
            g, d_x = backward(net, x, saved, d)
            d_x *= kept
            g["word"], g["chars"] = np.zeros_like(net.weights["word"]), np.zeros_like(net.weights["chars"])
            np.add.at(g["word"], known, d_x[:, :WORD_DIMS])
            np.add.at(g["chars"], grams, (d_x[:, WORD_DIMS:] / n[:, None])[owner])
            g["word"][0] = 0
            step += 1
            for k, v in net.weights.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                rate = RATE * (INPUT_RATE if k in ("word", "chars") else 1)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        logit, _ = _highest(net, [ids[i] for i in judge], vocabulary)
        scale = _calibrate(logit, labels[judge], np.where(labels[judge] == 1, class_weight[1], class_weight[0]))
        a, b = _calibrate(logit, labels[judge], np.ones(len(judge)))
        loss = _loss(a * logit + b, labels[judge])
        if best is None or loss < best[0]:
            best = (loss, {k: v.copy() for k, v in net.weights.items()}, scale)
    _, net.weights, net.scale = best
    return net


def _calibrate(logit: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits by weighted logistic regression (damped Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        e, c = weight * (p - labels), weight * p * (1 - p) + 1e-9
        g = np.array([(e * logit).sum() + 1e-2 * (a - 1), e.sum()])
        h = np.array([[(c * logit**2).sum() + 1e-2, (c * logit).sum()], [(c * logit).sum(), c.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


class Scorer:
    """A network with the inputs of the words that a worker has met."""

    MOST_WORDS = 200_000

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.gates = project(self.net, self.net.inputs([""])[0]) if self.net.weights else []

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.net.constant is not None:
            return [self.net.constant] * len(texts)
        docs = [words_of(t) for t in texts]
        if len(self.index) > self.MOST_WORDS:
            self.clear()
        new = list(set().union(*docs).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            more = project(self.net, self.net.inputs(new)[0])
            self.gates = [np.concatenate(pair) for pair in zip(self.gates, more, strict=True)]
        get = self.index.__getitem__
        ids = [np.fromiter(map(get, words), np.int64, len(words)) for words in docs]
        a, b = self.net.scale
        highest = np.array([s.max() for s in _logits(self.net, ids, self.gates)], np.float64)
        return (1 / (1 + np.exp(-np.clip(a * highest + b, -30, 30)))).tolist()


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Network:
    """Fit on the documents of each class that are first in the order of a hash of their keys."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & learn).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("label"))
    sizes = {int(r["label"]): r["count"] for r in marked.groupBy("label").count().collect()}
    parts = [marked.filter(F.col("label") == y).orderBy(F.xxhash64("_key"), "_key").limit(sample) for y in (0, 1)]
    rows = bounded(docs).select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(parts[0].union(parts[1])), "_key")
    # Rows that share a key are one document, so that the sample is bounded however often a key repeats.
    rows = rows.groupBy("_key", "label").agg(F.min("_text").alias("_text"))
    most = TRAIN_WINDOWS * STRIDE + WINDOW

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                if len(words) > most:  # windows spread over the whole text
                    words = [w for a in window_starts(len(words), TRAIN_WINDOWS) for w in words[a : a + STRIDE]]
                found.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(2)], ["h", "words", "label"])

    got = rows.select(F.xxhash64("_key", "_text"), "_text", F.col("label").cast("double")).mapInArrow(split, "h long, words string, label double").toArrow()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    texts, y = got.column("words").to_pylist(), got.column("label").to_numpy()
    y = y[order]
    stands = tuple(sizes.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1))
    return fit([texts[i].split() for i in order], y, stands)


def predict(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    tag = (len(net.words), net.scale, net.constant)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("toxicity", tag), lambda: Scorer(held.value))
        for batch in small_batches(batches, 1):
            scores = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_key", "score"])

    rows = bounded(docs).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    return rows.mapInArrow(run, f"_key {kind}, score double").withColumnRenamed("_key", key)
