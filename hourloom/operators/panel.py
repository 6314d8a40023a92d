"""Dense panels: one row per entity and time step, zero-filled, with lags.

A series is cut into blocks of whole days. Every block carries the last steps of the block before
it as a lead-in, so lags never look outside their block, one (entity, block) group is bounded by
the calendar, and a panel of few entities still spreads over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions import clock
from hourloom.operators.joins import bounded

EPOCH = date(1970, 1, 1)
BLOCK = "_block"


@dataclass(frozen=True)
class Span:
    """Closed time range of a panel at an hourly or daily step."""

    lo: str
    hi: str
    grain: str = "hour"
    block_days: int = 90

    @property
    def step(self) -> timedelta:
        return timedelta(hours=1) if self.grain == "hour" else timedelta(days=1)

    @property
    def n_steps(self) -> int:
        width = datetime.fromisoformat(self.hi) - datetime.fromisoformat(self.lo)
        return width // self.step + 1

    @property
    def blocks(self) -> tuple[int, int]:
        """First and last block number."""
        first, last = (
            (datetime.fromisoformat(x).date() - EPOCH).days // self.block_days
            for x in (self.lo, self.hi)
        )
        return first, last

    # SQL text of the bounds, for use inside expressions.

    def steps(self, n: int) -> str:
        return f"INTERVAL '{n}' {self.grain.upper()}"

    @property
    def first(self) -> str:
        return f"timestamp_ntz'{self.lo}'"

    @property
    def last(self) -> str:
        return f"timestamp_ntz'{self.hi}'"

    @property
    def block_start(self) -> str:
        return f"CAST(date_from_unix_date({BLOCK} * {self.block_days}) AS timestamp_ntz)"

    @property
    def block_end(self) -> str:
        """First step after the block."""
        return f"CAST(date_from_unix_date(({BLOCK} + 1) * {self.block_days}) AS timestamp_ntz)"

    def hours(self, like: DataFrame, ts: str = "datetime") -> DataFrame:
        """The time steps as a table of one column."""
        steps = f"explode(sequence({self.first}, {self.last}, {self.steps(1)})) AS {ts}"
        return like.sparkSession.range(1).selectExpr(steps)


def _spread(keys: DataFrame, *cols: str) -> DataFrame:
    """Key rows over all shuffle partitions.

    The number is given, not left to the planner: it would see a few small key rows and merge
    their partitions, though thousands of dense rows are about to grow from each.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, *cols)


def build_grid(keys: DataFrame, span: Span, ts: str = "datetime") -> DataFrame:
    """Every key row at every time step, generated row by row where the key lies."""
    steps = f"explode(sequence({span.first}, {span.last}, {span.steps(1)})) AS {ts}"
    return _spread(keys, *keys.columns).selectExpr("*", steps)


def _zero_filled(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.expr(f"CAST(coalesce({value}, 0) AS int)"))


def fill_grid(
    grid: DataFrame,
    counts: DataFrame,
    key: str = "station_id",
    ts: str = "datetime",
    value: str = "departures",
) -> DataFrame:
    """Counts on the grid, 0 where there was no event."""
    return _zero_filled(grid.join(counts.select(key, ts, value), [key, ts], "left"), value)


def _lead_in(df: DataFrame, ts: str, span: Span, longest: int) -> DataFrame:
    """Rows in every block they take part in: their own, and the next one's lead-in.

    The array is never empty; ``explode_outer`` keeps the planner from adding a filter on it below
    the counts, which would make their exchange differ from the one the grid uses.
    """
    late = f"{ts} >= {span.block_end} - {span.steps(longest)}"
    blocks = f"CASE WHEN {late} THEN array({BLOCK}, {BLOCK} + 1) ELSE array({BLOCK}) END"
    return df.withColumn(BLOCK, clock.block_of(ts, span.block_days)).withColumn(
        BLOCK, F.expr(f"explode_outer({blocks})")
    )


def _lagged(
    df: DataFrame, span: Span, key: str, ts: str, value: str, lags: tuple[int, ...]
) -> DataFrame:
    """Lags inside (entity, block); lead-in rows and rows without all lags go."""
    window = f"OVER (PARTITION BY {key}, {BLOCK} ORDER BY {ts})"
    made = {f"lag_{n}{span.grain[0]}": f"CAST(lag({value}, {n}) {window} AS float)" for n in lags}
    kept = [c for c in df.columns if c != BLOCK]
    return (
        df.selectExpr(*df.columns, *[f"{sql} AS {name}" for name, sql in made.items()])
        .where(f"{ts} >= {span.block_start} AND " + " AND ".join(f"{c} IS NOT NULL" for c in made))
        .select(*kept, *made)
    )


def _longest(lags: tuple[int, ...], span: Span) -> int:
    longest = max(lags)
    if longest * span.step > timedelta(days=span.block_days):
        raise ValueError(f"lag {longest} is longer than a block of {span.block_days} days")
    return longest


def add_lags(
    panel: DataFrame,
    span: Span,
    key: str = "station_id",
    ts: str = "datetime",
    value: str = "departures",
    lags: tuple[int, ...] = (1, 2, 24),
) -> DataFrame:
    """Lags of a dense panel in time order; rows without all of them are dropped."""
    return _lagged(_lead_in(panel, ts, span, _longest(lags, span)), span, key, ts, value, lags)


def dense_panel(
    keys: DataFrame,
    counts: DataFrame,
    span: Span,
    key: str = "station_id",
    ts: str = "datetime",
    value: str = "departures",
    lags: tuple[int, ...] = (1, 2, 24),
) -> DataFrame:
    """Grid, zero fill and lags in one plan.

    ``keys`` has one row per entity, or one per entity and block where only some blocks are wanted; its
    other columns ride along. Only key rows and counts are exchanged, by (entity, block). The dense rows are generated behind that exchange, and the grid
    join and the lag window both use its partitioning and sort order.
    """
    longest = _longest(lags, span)
    first, last = span.blocks
    start = f"greatest({span.block_start} - {span.steps(longest)}, {span.first})"
    stop = f"least({span.block_end} - {span.steps(1)}, {span.last})"
    every = f"explode(sequence({first}, {last})) AS {BLOCK}"
    blocks = keys if BLOCK in keys.columns else keys.selectExpr("*", every)
    steps = f"explode(sequence({start}, {stop}, {span.steps(1)})) AS {ts}"
    grid = _spread(blocks, key, BLOCK).selectExpr("*", steps)
    facts = _lead_in(counts.select(key, ts, value), ts, span, longest)
    filled = _zero_filled(grid.join(facts, [key, BLOCK, ts], "left"), value)
    return _lagged(filled, span, key, ts, value, lags)


def density_report(
    panel: DataFrame, span: Span, key: str = "station_id", ts: str = "datetime"
) -> DataFrame:
    """Rows against the rows a gap-free panel has.

    Rows are first counted per (entity, time step), so that no task sees a whole entity.
    """
    return (
        panel.groupBy(key, ts)
        .agg(F.count("*").alias("copies"))
        .groupBy(key)
        .agg(F.sum("copies").alias("n"), F.count("*").alias("n_times"))
        .agg(
            F.count("*").alias("n_keys"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum("n") - F.sum("n_times"), F.lit(0)).alias("n_duplicates"),
        )
        .withColumn("n_expected", F.col("n_keys") * F.lit(span.n_steps))
        .withColumn(
            "is_dense", (F.col("n_rows") == F.col("n_expected")) & (F.col("n_duplicates") == 0)
        )
    )


def join_span(
    df: DataFrame, hours: DataFrame, span: Span, ts: str = "datetime"
) -> DataFrame:
    """Left join with a table of one row per step of the span, which bounds its size."""
    return df.join(bounded(hours, span.n_steps), ts, "left")
