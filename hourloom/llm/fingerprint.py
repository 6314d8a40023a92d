"""Homomorphic multiset hash of documents, in DataFrame operations only.

A document is the multiset of its paragraphs (lines). Every paragraph is hashed to a wide vector, and
the fingerprint is the sum of the vectors, lane by lane, modulo a power of two. Sums do not depend on
order, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector of a paragraph has two parts:

* ``EXACT`` lanes modulo 2^32: hash words of the whole paragraph. Equal multisets have equal lanes.
* ``LIKE`` lanes modulo 2^32: the sum, over the paragraph's runs of ``RUN`` words, of +1 or -1 as the
  bits of the run's hash say. A run starts at every word that has enough words after it, so a word more
  or less changes only the runs around it; a paragraph of fewer words is one run. The angle between two
  such sums estimates how many runs two documents share, with a standard error of about 1 / sqrt(LIKE).

Defined results: a null text is an empty text; an empty text is one empty paragraph; repeated
paragraphs and repeated rows count as often as they occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.base import cut_points, range_of

EXACT, LIKE = 8, 96
EXACT_BITS, LIKE_BITS = 32, 32
RUN = 4
_PAIR, _LOW = 0x0000000100000001, 0xFFFFFFFF


def units(text: Column) -> Column:
    """The paragraphs, each behind a newline, and their word runs."""
    paragraphs = F.split(text, "\n", -1)
    words = F.filter(F.transform(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0))), lambda w: F.size(w) > 0)
    # Places past the last word are null, and concat_ws leaves them out.
    runs = lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - RUN)), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(RUN)])
    )
    return F.concat(F.transform(paragraphs, lambda p: F.concat(F.lit("\n"), p)), F.flatten(F.transform(words, runs)))


def _hashes(unit: Column) -> list[Column]:
    """Hash words of a unit: p* of a whole paragraph, s* of a run, zero for the other kind."""
    whole, none = unit.startswith("\n"), F.lit(0).cast("long")
    return [
        (~whole).cast("long").alias("run"),
        *[F.when(whole, F.xxhash64(F.lit(i), unit)).otherwise(none).alias(f"p{i}") for i in range(EXACT // 2)],
        *[F.when(whole, none).otherwise(F.xxhash64(F.lit(100 + i), unit)).alias(f"h{i}") for i in range(-(-LIKE // 64))],
    ]


def _sums() -> list[Column]:
    """Sums over a group of hashed units; two lanes share a long, and no text is long enough for a carry."""
    sums = [F.sum("run").alias("runs")]
    for i in range(EXACT // 2):
        sums.append(F.sum(F.col(f"p{i}").bitwiseAND(_LOW)).alias(f"e{2 * i}"))
        sums.append(F.sum(F.shiftrightunsigned(f"p{i}", 32)).alias(f"e{2 * i + 1}"))
    for i in range(LIKE // 2):
        sums.append(F.sum(F.shiftrightunsigned(f"h{i // 32}", i % 32).bitwiseAND(_PAIR)).alias(f"s{i}"))
    return sums


def _lanes() -> Column:
    """The vector of a group from its sums."""
    exact = [F.col(f"e{i}").bitwiseAND((1 << EXACT_BITS) - 1) for i in range(EXACT)]
    like = []
    for i in range(LIKE // 2):
        for ones in (F.col(f"s{i}").bitwiseAND(_LOW), F.shiftrightunsigned(f"s{i}", 32)):
            like.append((ones * 2 - F.col("runs")).bitwiseAND((1 << LIKE_BITS) - 1))
    return F.array(*exact, *like)


def vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per group of ``keys`` with ``lanes``, the sum over the texts of the group."""
    rows = df.select(*keys, F.explode(units(F.coalesce(F.col(text), F.lit("")))).alias("_unit"))
    hashed = rows.select(*keys, *_hashes(F.col("_unit")))
    return hashed.groupBy(*keys).agg(*_sums()).select(*keys, _lanes().alias("lanes"))


def _modular(a: Column, b: Column, op) -> Column:
    both = F.zip_with(a, b, op)
    masked = lambda part, bits: F.transform(part, lambda x: x.bitwiseAND((1 << bits) - 1))
    return F.concat(masked(F.slice(both, 1, EXACT), EXACT_BITS), masked(F.slice(both, EXACT + 1, LIKE), LIKE_BITS))


def insert(lanes: Column, part: Column) -> Column:
    """Fingerprint after the paragraphs of ``part`` were added."""
    return _modular(lanes, part, lambda x, y: x + y)


def delete(lanes: Column, part: Column) -> Column:
    """Fingerprint after the paragraphs of ``part`` were taken away."""
    return _modular(lanes, part, lambda x, y: x - y)


def _packed(lanes: Column, first: int, n: int, bits: int) -> Column:
    """Hexadecimal digits of n lanes, 64 bits at a time."""
    per = 64 // bits

    def word(i: Column) -> Column:
        parts = [F.shiftleft(F.get(lanes, i + first + k), 64 - bits * (k + 1)) for k in range(per)]
        return F.lpad(F.hex(reduce(lambda x, y: x.bitwiseOR(y), parts)), 16, "0")

    return F.array_join(F.transform(F.array(*[F.lit(i) for i in range(0, n, per)]), word), "")


def as_text(lanes: Column) -> Column:
    """Lower-case hexadecimal digits of all lanes."""
    return F.lower(F.concat(_packed(lanes, 0, EXACT, EXACT_BITS), _packed(lanes, EXACT, LIKE, LIKE_BITS)))


def _signed(lanes: Column) -> Column:
    half = 1 << (LIKE_BITS - 1)
    return F.transform(
        F.slice(lanes, EXACT + 1, LIKE), lambda x: F.when(x >= half, x - 2 * half).otherwise(x).cast("double")
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the likeness lanes, at least 0."""
    return _near(a == b, _signed(a), _signed(b), _norm(_signed(a)), _norm(_signed(b)))


def _norm(signed: Column) -> Column:
    return F.sqrt(_dot(signed, signed))


def _near(same: Column, x: Column, y: Column, norm_x: Column, norm_y: Column) -> Column:
    size = norm_x * norm_y
    cosine = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(x, y) / size))).otherwise(0.0)
    return F.when(same, 1.0).otherwise(cosine)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lanes, fingerprint); rows with the same key form one multiset."""
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    return vectors(rows, [key], "_text").withColumn("fingerprint", as_text(F.col("lanes")))


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next text.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of
    the next document in ascending order of the key; the first follows after the last. Null keys come
    first, equal keys are ordered by their texts, a single row is followed by itself.

    The rows are dealt once, into ranges of the key; the first row of a range goes to the range before
    it as well. Texts, vectors and neighbours then meet without another exchange.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cuts = cut_points(rows, "_key", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = max(0, len(cuts) - 1)
    own = range_of("_key", cuts)
    first = F.coalesce(F.col("_key").isin(cuts[:1]) if cuts else F.lit(True), F.lit(True))
    before = F.when(first, last).when(F.element_at(F.array(*map(F.lit, cuts or [0])), own + 1) == F.col("_key"), own - 1)
    dealt = rows.withColumn(
        "_places",
        F.array(F.struct(own.alias("block"), F.lit(False).alias("extra")), F.struct(before.alias("block"), F.lit(True).alias("extra"))),
    ).select("_key", "_text", F.inline("_places")).filter(F.col("block").isNotNull())

    order = Window.partitionBy("block").orderBy(
        "extra", F.col("_key").asc_nulls_first(), F.xxhash64("_text"), "_text"
    )
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    placed = dealt.select(
        "block", "extra", "_key", "_text", n.cast("long").alias("n_chars"),
        F.row_number().over(order).alias("place"), F.lead("_text").over(order).alias("_next"),
    ).withColumn(
        "_edited",
        F.when(~F.col("extra"), F.concat(F.substring("_text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))),
    )
    texts = placed.select(
        "block", "extra", "_key", "n_chars", "place", F.sha2("_edited", 256).alias("edited_sha256"),
        F.posexplode(F.when(F.col("extra"), F.array("_text")).otherwise(F.array("_text", "_edited"))).alias("which", "_body"),
    )
    keys = ["block", "extra", "_key", "n_chars", "place", "edited_sha256", "which"]
    summed = vectors(texts, keys, "_body")
    along = Window.partitionBy("block").orderBy("place", "which")
    parts = summed.select(
        *keys, as_text(F.col("lanes")).alias("print"), _signed(F.col("lanes")).alias("signed")
    ).withColumn("norm", _norm(F.col("signed")))
    both = parts.select(
        "*", *[F.lead(c, n).over(along).alias(f"{c}_{n}") for n in (1, 2) for c in ("print", "signed", "norm")]
    ).filter((F.col("which") == 0) & ~F.col("extra"))
    near = lambda n: _near(F.col("print") == F.col(f"print_{n}"), F.col("signed"), F.col(f"signed_{n}"), F.col("norm"), F.col(f"norm_{n}"))
    return both.select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", F.col("print").alias("fingerprint"),
        F.col("print_1").alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"),
    )


def total(lanes: list[Column]) -> Column:
    """Fingerprint of all the paragraphs of several documents together."""
    return reduce(insert, lanes)
