"""Exact quantiles with linear interpolation, without gathering or sorting the values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.session import materialize

# Rank error of the bracketing sketch is at most n / ACCURACY; the first bracket leaves SLACK * n.
ACCURACY = 10_000
SLACK = 0.002
# Slices that a bracket is cut into in each pass, and groups whose brackets the driver may hold.
SLICES = 256
MOST_GROUPS = 10_000
# Where there are more groups: values of a group that is ordered at once.
FEW_VALUES = 10_000


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """Rows (by..., prob, quantile).

    A sketch first brackets each wanted rank. Every further pass counts the values below the
    bracket and in equal slices of it, and goes on with the slice that holds the rank, until that
    slice is a single value. Only counts per slice leave the tasks, so no task and no window ever
    sees more than ``FEW_VALUES`` values of a group, whatever their number; the answer is exact for any
    input. Null values are left out. The brackets of few groups travel with the passes. Of more than
    ``MOST_GROUPS`` groups the small ones are ordered, and the brackets of the others stay a table that
    meets the values in a join, so any number of groups will do.
    """
    by = by or []
    spark = df.sparkSession
    x = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_v")
    )
    clipped = [min(max(q + d, 0.0), 1.0) for q in probs for d in (-SLACK, SLACK)]
    sketch = F.percentile_approx("_v", clipped or [0.5], ACCURACY).alias("_edges")
    limits = [F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch]
    if by:
        sizes = materialize(x.groupBy(*by).agg(F.count("*").alias("_n")), "quantile-sizes")
        if sizes.count() > MOST_GROUPS:
            return _of_many_groups(x, sizes.where(F.col("_n") > FEW_VALUES), by, probs, limits)
    groups = x.groupBy(*by).agg(*limits).collect()
    groups = [g for g in groups if g["_n"]]

    open_, found = {}, {}
    for g, row in enumerate(groups):
        for i, q in enumerate(probs):
            pos = q * (row["_n"] - 1)
            for rank in {math.floor(pos), math.ceil(pos)}:
                open_[g, rank] = (row["_edges"][2 * i], row["_edges"][2 * i + 1])
    first = True
    while open_:
        counts = _slice_counts(x, by, groups, open_)
        again = {}
        for (g, rank), (lo, hi) in open_.items():
            below, slices = counts.get((g, rank), (0, []))
            if first and not below <= rank < below + sum(n for n, _, _ in slices):
                # The sketch missed: start from the whole range.
                again[g, rank] = (groups[g]["_min"], groups[g]["_max"])
                continue
            for n, least, most in slices:
                if rank < below + n:
                    if least == most:
                        found[g, rank] = least
                    else:
                        again[g, rank] = (least, most)
                    break
                below += n
        first = False
        open_ = again

    rows = []
    for g, row in enumerate(groups):
        for q in probs:
            pos = q * (row["_n"] - 1)
            a, z = found[g, math.floor(pos)], found[g, math.ceil(pos)]
            rows.append((*[row[c] for c in by], float(q), a + (z - a) * (pos - math.floor(pos))))
    fields = [df.schema[c] for c in by]
    schema = T.StructType([*fields, T.StructField("prob", T.DoubleType()), T.StructField("quantile", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def _slice() -> Column:
    """The slice of the bracket in which a value lies, -1 below it."""
    # Halves, so that the width of a bracket stays finite.
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    at = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * SLICES)
    inside = F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), at))
    return F.when(F.col("_v") < F.col("_lo"), -1).when(width <= 0, 0).otherwise(inside)


def _of_many_groups(x: DataFrame, large: DataFrame, by: list[str], probs: list[float], limits: list[Column]) -> DataFrame:
    """Groups of at most ``FEW_VALUES`` values are ordered after one exchange of the values; the larger ones are
    narrowed down by counting, so no task orders a group without a bound. ``large``: the keys of the latter.
    """
    keys = [f"_b{i}" for i in range(len(by))]
    x = x.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "_v")
    if large.isEmpty():
        return _ordered(x, keys, by, probs)
    large = large.select(*[F.col(c).alias(f"_l{k}") for c, k in zip(by, keys)])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_l{k}")) for k in keys])
    few, many = x.join(large, same, "left_anti"), x.join(large, same, "left_semi")
    return _ordered(few, keys, by, probs).unionByName(_narrowed(many, keys, by, probs, limits))


def _ordered(x: DataFrame, keys: list[str], by: list[str], probs: list[float]) -> DataFrame:
    """The ranks of small groups by their place in the order; values are exchanged once."""
    group = Window.partitionBy(*keys)
    at = x.withColumn("_i", F.row_number().over(group.orderBy("_v")) - 1).withColumn("_n", F.count("*").over(group))
    # The place as ``_narrowed`` computes it, in double precision.
    pos = [F.lit(float(q)) * (F.col("_n") - 1) for q in probs]
    ends = [
        F.max(F.when(F.col("_i") == end(p), F.col("_v"))).alias(f"_{side}{i}")
        for i, p in enumerate(pos) for side, end in (("a", F.floor), ("z", F.ceil))
    ]
    found = at.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)
    rows = F.explode(
        F.array(*[
            F.struct(
                F.lit(float(q)).alias("prob"),
                (F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * (p - F.floor(p))).alias("quantile"),
            )
            for i, (q, p) in enumerate(zip(probs, pos, strict=True))
        ])
    )
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], rows.alias("_w")).select(*by, "_w.prob", "_w.quantile")


def _narrowed(x: DataFrame, keys: list[str], by: list[str], probs: list[float], limits: list[Column]) -> DataFrame:
    """The same with brackets as a table by group; ranks that are found leave it, until it is empty.

    Values and brackets meet in a join by group, which Spark splits where a group is hot; a rank has at
    most ``SLICES`` + 1 rows of counts.
    """
    groups = materialize(x.groupBy(*keys).agg(*limits), "quantile-groups")
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(i).alias("i")) for i, q in enumerate(probs)])
    asked = groups.select(*keys, "_n", "_min", "_max", "_edges", F.explode(wanted).alias("_w")).select(
        "*", (F.col("_w.q") * (F.col("_n") - 1)).alias("_pos")
    )
    ends = F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos"))))
    ranks = asked.select(
        *keys, ends.alias("_r"), F.get("_edges", 2 * F.col("_w.i")).alias("_lo"),
        F.get("_edges", 2 * F.col("_w.i") + 1).alias("_hi"), "_min", "_max",
    )
    open_ = materialize(
        ranks.groupBy(*keys, "_r").agg(*[F.min(c).alias(c) for c in ("_lo", "_min")], *[F.max(c).alias(c) for c in ("_hi", "_max")]),
        "quantile-open",
    )
    found = []
    while not open_.isEmpty():
        here = open_.select(*[F.col(k).alias(f"_o{k}") for k in keys], "_r", "_lo", "_hi", "_min", "_max")
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys])
        counted = x.join(here, same & (F.col("_v") <= F.col("_hi"))).groupBy(*keys, "_r", _slice().alias("_s")).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
            F.first("_min").alias("_min"), F.first("_max").alias("_max"),
        )
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_r").orderBy("_s"))
        holds = (F.col("_s") >= 0) & (F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_n"))
        # Every rank has rows: a bracket ends at a value or at the group's largest.
        step = counted.withColumn("_upto", upto).groupBy(*keys, "_r").agg(
            F.max(F.when(holds, F.col("_least"))).alias("_least"), F.max(F.when(holds, F.col("_most"))).alias("_most"),
            F.first("_min").alias("_min"), F.first("_max").alias("_max"),
        )
        step = materialize(step, "quantile-step")
        found.append(step.where("_least = _most").select(*keys, "_r", F.col("_least").alias("_x")))
        # Where the sketch missed, the whole range is next.
        left = step.where("_least IS NULL OR _least < _most")
        open_ = left.select(
            *keys, "_r", F.coalesce("_least", "_min").alias("_lo"), F.coalesce("_most", "_max").alias("_hi"), "_min", "_max"
        )
    values = reduce(DataFrame.unionByName, found)
    for end, name in ((F.floor("_pos"), "_a"), (F.ceil("_pos"), "_z")):
        side = values.select(*[F.col(k).alias(f"_o{k}") for k in keys], F.col("_r").alias(f"_r{name}"), F.col("_x").alias(name))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys])
        asked = asked.join(side, same & (end == F.col(f"_r{name}"))).drop(*[f"_o{k}" for k in keys], f"_r{name}")
    part = F.col("_pos") - F.floor("_pos")
    return asked.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys)], F.col("_w.q").alias("prob"),
        (F.col("_a") + (F.col("_z") - F.col("_a")) * part).alias("quantile"),
    )


def _slice_counts(x: DataFrame, by: list[str], groups: list, open_: dict) -> dict:
    """For each (group, rank): values below its bracket, and (count, least, most) of its slices."""
    kinds = "_g int, _r long, _lo double, _hi double"
    brackets = [(*[groups[g][c] for c in by], g, r, lo, hi) for (g, r), (lo, hi) in open_.items()]
    fields = [T.StructField(f"_b{i}", x.schema[c].dataType) for i, c in enumerate(by)]
    schema = T.StructType([*fields, *T._parse_datatype_string(kinds).fields])
    side = F.broadcast(x.sparkSession.createDataFrame(brackets, schema))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    counted = (
        x.join(side, same & (F.col("_v") <= F.col("_hi")))
        .groupBy("_g", "_r", _slice().alias("_s"))
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        .collect()
    )
    out: dict = {}
    for row in sorted(counted, key=lambda row: row["_s"]):
        below, slices = out.setdefault((row["_g"], row["_r"]), (0, []))
        if row["_s"] < 0:
            out[row["_g"], row["_r"]] = (row["_n"], slices)
        else:
            slices.append((row["_n"], row["_least"], row["_most"]))
    return out
