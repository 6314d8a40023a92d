"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by the forward recursion.

Tokens are the words of the text with A-Z lower-cased, then one end. A frequent word is a symbol of
its own; every other word has the symbol of its ending, and a probability within that symbol from its
count in the whole training corpus. Where a symbol's words end, unseen words begin: they share as much
as its words seen once, so that all probabilities of a state sum to one over known and unknown words.

The chain emits symbols, so the model is a table of states x symbols whose size does not follow the
corpus; the counts of all words stay a distributed table. The most frequent words travel with the
job, all others meet their counts in a join.

Rows are told apart by position, not by id: null and repeated ids are scored like any other, and a
null key learns. A null text has no words. Columns other than the key, the text and those to carry
are ignored. An empty table gives an empty one; a model that learned nothing is uniform.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.base import bounded, frequent, small_batches, stored

STATES = 10
# Words that are symbols of their own, and symbols that other words share by their ending.
OWN, ENDINGS = 8192, 1024
# Words whose counts travel with the job, and the longest of them in bytes; others are joined.
CARRIED, CARRIED_BYTES = 1 << 17, 64
# Steps of the recursion that are taken for many stretches of text side by side.
STRETCH, TOKENS_AT_ONCE = 1024, 800_000
# The start of the training: rounds over at most so many documents of at most so many tokens.
START_DOCUMENTS, START_TOKENS, START_ROUNDS, ROUNDS = 2000, 4096, 12, 3
# Expected counts are summed as whole multiples of this, so that no sum depends on its order.
GRAIN = 2.0**-16
PRIOR = 200.0
END = b" "
SYMBOLS = OWN + ENDINGS


def words_of(text: bytes) -> list[bytes]:
    """Words between white space of ASCII, with A-Z lower-cased."""
    return text.lower().split()


def ending(word: bytes) -> int:
    """The shared symbol of a word: a hash of its last two bytes, as in ``_ending``."""
    h = xxhash.xxh64_intdigest(word[-2:], 42)
    return OWN + (h - (1 << 64) if h >> 63 else h) % ENDINGS


def _ending(word: str) -> Column:
    return (F.lit(OWN) + F.pmod(F.xxhash64(F.substring(word, -2, 2)), F.lit(ENDINGS))).cast("int")


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


# --- words and their counts ---------------------------------------------------------------------------


def word_counts(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """word, c: how often the tokens of the learned documents hold it; ends included."""
    at_most = 300_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small_batches(batches, 0):
            for t in _texts(batch, "text"):
                seen.update(words_of(t))
            seen[END] += batch.num_rows
            if len(seen) > at_most:
                yield _counted(seen)
                seen = Counter()
        if seen:
            yield _counted(seen)

    learned = bounded(docs).filter(F.coalesce(learn, F.lit(True))).select(F.col(text).cast("string").alias("text"))
    parts = learned.mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("c"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
    )


@dataclass
class Vocabulary:
    """Counts of all words as a table; totals, the carried words and the sums of the shared symbols at hand."""

    counts: DataFrame
    tokens: int
    distinct: int
    carried: list[bytes]
    carried_counts: np.ndarray
    shared: np.ndarray  # tokens of each shared symbol's words
    unseen: np.ndarray  # the share of its unknown words, as a count

    @property
    def base(self) -> float:
        return float(self.tokens + self.distinct + 1)

    def symbols(self) -> np.ndarray:
        own = np.arange(min(OWN, len(self.carried)))
        rest = [ending(w) for w in self.carried[OWN:]]
        return np.concatenate([own, np.array(rest, dtype=int)]).astype(np.uint16)

    def within(self) -> np.ndarray:
        """log10 of the share of each symbol's unit count: 0 for own words."""
        out = np.zeros(SYMBOLS)
        out[OWN:] = -np.log10(self.shared + self.unseen)
        return out


def vocabulary(docs: DataFrame, learn: Column, text: str = "text") -> Vocabulary:
    """The counts of all learned tokens, stored, and what of them every task needs.

    The carried words are all above a count, found from a histogram of the counts' logarithms.
    """
    counts = stored(word_counts(docs, learn, text), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    top = counts.filter(frequent(counts, "c", CARRIED, F.octet_length("word") <= CARRIED_BYTES)[0]).toArrow()
    found = sorted(zip(top["c"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (x[1] != END, -x[0], x[1]))
    words, c = [w for _, w in found], np.array([n for n, _ in found], np.int64)
    shared, once = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy(_ending("word").alias("s")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect():
        shared[r.s - OWN], once[r.s - OWN] = r.n, r.once
    for w, n in zip(words[:OWN], c[:OWN].tolist(), strict=True):  # the end is the first word, if there is any
        shared[ending(w) - OWN] -= n
        once[ending(w) - OWN] -= n == 1
    return Vocabulary(
        counts, totals.tokens, totals.words, words, c, shared, np.maximum(once, 1.0)
    )


# --- texts as symbols ---------------------------------------------------------------------------------

_ENCODED = (
    "symbols binary, n_tokens long, n_known long, base double, within double, rare array<binary>, rare_n array<int>"
)


def encode(docs: DataFrame, voc: Vocabulary, learn: Column, text: str = "text", key: str = "doc_id", carry: tuple = ()) -> DataFrame:
    """One stored row per document: its symbols, what its carried words add, and its other words with counts."""
    words, base, own = voc.carried, voc.base, voc.symbols()
    logs = np.log10((voc.carried_counts + 1) / base)
    share = voc.within()
    inside = share[own] + np.where(own >= OWN, np.log10(np.maximum(voc.carried_counts, 1)), 0.0)
    unit = -math.log10(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(words)}
        for batch in small_batches(batches, 1):
            rows = []
            for t in _texts(batch, "_text"):
                tokens = words_of(t)
                tokens.append(END)
                at = np.array([place.get(w, -1) for w in tokens], dtype=np.int64)
                known = at >= 0
                ids = at[known]
                symbols = np.empty(len(at), np.uint16)
                symbols[known] = own[ids]
                lost = np.flatnonzero(~known)
                others = [tokens[i] for i in lost]
                symbols[lost] = [ending(w) for w in others]
                rare = Counter(others)
                rows.append((
                    symbols.tobytes(), len(tokens), len(ids),
                    math.fsum(logs[ids]) + len(others) * unit,
                    math.fsum(inside[ids]) + math.fsum(share[symbols[lost]]),
                    list(rare), list(rare.values()),
                ))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                kept + made, names=names + ["symbols", "n_tokens", "n_known", "base", "within", "rare", "rare_n"]
            )

    df = bounded(docs).select(
        F.monotonically_increasing_id().alias("_row"), F.col(text).cast("string").alias("_text"),
        F.coalesce(learn, F.lit(True)).alias("_learn"), key, *carry,
    )
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text"]
    return stored(df.mapInArrow(run, ", ".join(kept) + ", " + _ENCODED), "symbols")


# --- the chain ----------------------------------------------------------------------------------------


@dataclass
class Chain:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    @staticmethod
    def first(prior: np.ndarray, states: int = STATES, seed: int = 42) -> Chain:
        """States that differ at random and tend to stay."""
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * np.exp(rng.normal(0, 1, (len(prior), states)))
        move = rng.uniform(0.5, 1.5, (states, states)) + states * np.eye(states)
        start = rng.uniform(0.5, 1.5, states)
        return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Stretches:
    """Documents cut into stretches of bounded length that are worked on side by side, without any loss.

    What a later stretch must know of those before it (and a former of those behind it) goes through
    the products of their transition matrices, so the recursion stays exact however long a text is.
    """

    def __init__(self, chain: Chain, texts: list[np.ndarray]):
        self.chain = chain
        lengths = np.array([len(t) for t in texts], np.int64)
        self.flat = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
        parts = -(-lengths // STRETCH)
        self.doc = np.repeat(np.arange(len(texts)), parts)
        self.nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = np.cumsum(lengths) - lengths
        self.at = begins[self.doc] + self.nth * STRETCH
        self.size = np.minimum(STRETCH, lengths[self.doc] - self.nth * STRETCH)
        self.first = np.cumsum(parts) - parts  # a document's first stretch
        self.parts = parts
        k = len(chain.start)
        self.before = np.zeros((len(self.doc), k))  # forward vector at the last token before the stretch
        self.behind = np.ones((len(self.doc), k))  # backward vector at the last token of the stretch
        if (parts > 1).any():
            self._link()

    def _groups(self, which: np.ndarray, room: int) -> Iterator[np.ndarray]:
        """Stretches by falling length, in groups of bounded size."""
        order = which[np.argsort(-self.size[which], kind="stable")]
        i = 0
        while i < len(order):
            step = max(1, room // int(self.size[order[i]]))
            yield order[i : i + step]
            i += step

    def _steps(self, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each step the symbols of the stretches that are that long; those come first in the group."""
        size, at = self.size[group], self.at[group]
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for t in range(int(size[0])):
            yield t, self.flat[at[: active[t]] + t]

    def _enter(self, group: np.ndarray) -> np.ndarray:
        into = self.before[group] @ self.chain.move
        into[self.nth[group] == 0] = self.chain.start
        return into

    def _products(self, which: np.ndarray) -> np.ndarray:
        """Of each stretch the product of its steps' matrices, scaled; index: the stretch's place in ``which``."""
        move, emit = self.chain.move, self.chain.emit
        k = len(move)
        out = np.empty((len(which), k, k))
        place = np.empty(len(self.doc), np.int64)
        place[which] = np.arange(len(which))
        for group in self._groups(which, TOKENS_AT_ONCE):
            m = np.broadcast_to(np.eye(k), (len(group), k, k)).copy()
            for _, s in self._steps(group):
                n = len(s)
                x = (m[:n].reshape(n * k, k) @ move).reshape(n, k, k) * emit[s][:, None, :]
                m[:n] = x / x.max(axis=(1, 2), keepdims=True)
            out[place[group]] = m
        return out

    def _link(self) -> None:
        k = len(self.chain.start)
        long = np.flatnonzero(self.parts > 1)
        heads = self.first[long]
        ends = np.empty((len(self.doc), k))
        for group in self._groups(heads, TOKENS_AT_ONCE):
            x = self._enter(group)
            for t, s in self._steps(group):
                n = len(s)
                x = x if t == 0 else x[:n] @ self.chain.move  # all first stretches of long texts are full
                x = x * self.chain.emit[s]
                x /= x.sum(1, keepdims=True)
            ends[group] = x
        rest = np.flatnonzero(self.nth > 0)
        product = self._products(rest)
        place = np.empty(len(self.doc), np.int64)
        place[rest] = np.arange(len(rest))
        order = long[np.argsort(-self.parts[long], kind="stable")]
        for c in range(1, int(self.parts.max())):
            here = self.first[order[self.parts[order] > c]] + c
            self.before[here] = ends[here - 1]
            x = np.einsum("nk,nkj->nj", self.before[here], product[place[here]])
            ends[here] = x / x.sum(1, keepdims=True)
        for c in range(int(self.parts.max()) - 1, 0, -1):
            here = self.first[order[self.parts[order] > c]] + c
            x = np.einsum("nkj,nj->nk", product[place[here]], self.behind[here])
            self.behind[here - 1] = x / x.max(1, keepdims=True)

    def log_likelihoods(self) -> np.ndarray:
        """Natural logarithm of each document's probability."""
        out = np.zeros(len(self.parts))
        for group in self._groups(np.arange(len(self.doc)), TOKENS_AT_ONCE):
            x, total = self._enter(group), np.zeros(len(group))
            for t, s in self._steps(group):
                n = len(s)
                x = (x if t == 0 else x[:n] @ self.chain.move) * self.chain.emit[s]
                scale = x.sum(1)
                x /= scale[:, None]
                total[:n] += np.log(scale)
            np.add.at(out, self.doc[group], total)
        return out

    def expected(self, counts: np.ndarray) -> None:
        """Add the expected counts: rows of symbols, then of moves by state, then the starts and (log-likelihood, documents)."""
        move, emit = self.chain.move, self.chain.emit
        symbols, k = emit.shape
        moves = np.zeros((k, k))
        for group in self._groups(np.arange(len(self.doc)), TOKENS_AT_ONCE):
            x, alphas, scales, seen = self._enter(group), [], [], []
            for t, s in self._steps(group):
                x = (x if t == 0 else x[: len(s)] @ move) * emit[s]
                scale = x.sum(1)
                x = x / scale[:, None]
                alphas.append(x)
                scales.append(scale)
                seen.append(s)
                counts[symbols + k + 1, 0] += np.log(scale).sum()
            beta = self.behind[group]
            for t in range(len(seen) - 1, -1, -1):
                n, s, alpha = len(seen[t]), seen[t], alphas[t]
                gamma = alpha * beta[:n]
                norm = gamma.sum(1, keepdims=True)
                gamma /= norm
                w = emit[s] * beta[:n] / (scales[t][:, None] * norm)
                if t:
                    moves += alphas[t - 1][:n].T @ w
                else:
                    moves += self.before[group].T @ w  # zero for the first stretch of a text
                    counts[symbols + k] += gamma[self.nth[group] == 0].sum(0)
                beta[:n] = w @ move.T
                alphas[t] = gamma
            s = np.concatenate(seen)
            for j in range(k):
                counts[:symbols, j] += np.bincount(s, np.concatenate([g[:, j] for g in alphas]), symbols)
        counts[symbols : symbols + k] += moves * move
        counts[symbols + k + 1, 1] += len(self.parts)


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(data, np.uint16) for data in batch.column("symbols").to_pylist()]


def expected_counts(encoded: DataFrame, chain: Chain) -> np.ndarray:
    """One Baum-Welch pass over all rows: every task sends what it counted once, and Spark adds it up.

    The sums that reach the driver are states x symbols, whatever the corpus.
    """
    symbols, k = chain.emit.shape
    names = [f"k{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((symbols + k + 2, k))
        for batch in small_batches(batches, 0):
            Stretches(chain, _symbols(batch)).expected(counts)
        whole = np.rint(counts / GRAIN).astype(np.int64)
        some = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), *(pa.array(whole[some, j]) for j in range(k))], names=["at", *names]
        )

    sent = bounded(encoded.select("symbols")).mapInArrow(run, "at int, " + ", ".join(f"{n} long" for n in names))
    table = sent.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((symbols + k + 2, k))
    at = table["at"].to_numpy()
    for j, n in enumerate(names):
        out[at, j] = table[n].to_numpy()
    return out * GRAIN


def refitted(chain: Chain, counts: np.ndarray, prior: np.ndarray) -> Chain:
    """The chain that the expected counts call for, with a prior of a few tokens on every probability."""
    symbols, k = chain.emit.shape
    emit = counts[:symbols] + PRIOR * prior[:, None]
    move = counts[symbols : symbols + k] + 1 / k
    start = counts[symbols + k] + 1 / k
    return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(encoded: DataFrame, voc: Vocabulary, states: int = STATES, start_rounds: int = START_ROUNDS, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch: a starting point from a bounded sample of documents, then ``rounds`` over all that learn."""
    prior = np.zeros(SYMBOLS)
    own = min(OWN, len(voc.carried))
    prior[:own] = voc.carried_counts[:own]
    prior[OWN:] = voc.shared
    prior = (prior + 1) / (prior.sum() + SYMBOLS)
    chain = Chain.first(prior, states)
    learned = encoded.filter("_learn")
    few = learned.filter(F.octet_length("symbols") <= 2 * START_TOKENS).select("_row", "symbols")
    few = few.orderBy(F.xxhash64("symbols", "_row"), "_row").limit(START_DOCUMENTS)
    few = stored(few.repartition(8, "_row"), "symbols-start")
    for table, times in ((few, start_rounds), (learned, rounds)):
        for _ in range(times):
            chain = refitted(chain, expected_counts(table, chain), prior)
    return chain


def score(encoded: DataFrame, voc: Vocabulary, chain: Chain, key: str = "doc_id", carry: tuple = ()) -> DataFrame:
    """key, carried columns, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            found = Stretches(chain, _symbols(batch)).log_likelihoods() / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], names=[*batch.schema.names[1:], "_chain"])

    kept = encoded.select("symbols", "_row", key, *carry, "n_tokens", "n_known", "base", "within")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    chained = bounded(kept).mapInArrow(run, kinds + ", _chain double")
    unseen = encoded.sparkSession.createDataFrame(
        [(OWN + i, math.log10(u)) for i, u in enumerate(voc.unseen.tolist())], "_symbol int, _unseen double"
    )
    rare = encoded.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("_r"))
    rare = rare.select("_row", F.col("_r.rare").alias("word"), F.col("_r.rare_n").alias("_n"))
    rare = rare.join(voc.counts, "word", "left").withColumn("_symbol", _ending("word"))
    rare = rare.join(F.broadcast(unseen), "_symbol").groupBy("_row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("_n")).otherwise(0)).alias("_known"),
        F.sum(F.col("_n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("_counted"),
        F.sum(F.col("_n") * F.coalesce(F.log10(F.col("c").cast("double")), F.col("_unseen"))).alias("_shared"),
    )
    zero = F.lit(0.0)
    return chained.join(rare, "_row", "left").select(
        key, *carry, "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_counted", zero)).alias("base_score"),
        (F.col("_chain") + F.col("within") + F.coalesce("_shared", zero)).alias("score"),
    )
