"""Forward fill along a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions import clock

_BLOCK = "_fill_block"


def forward_fill(
    df: DataFrame,
    ts: str,
    cols: list[str],
    default: float | None = None,
    block_days: int = 90,
) -> DataFrame:
    """Last non-null value up to each row; ``default`` before the first one.

    Meant for a table of one row per time step. The timeline is cut into blocks: values are carried
    inside each block by its own window, and from block to block over one row per block, of which a
    century has about 400 at the default length.
    """
    blocked = df.withColumn(_BLOCK, clock.block_of(ts, block_days))
    inside = Window.partitionBy(_BLOCK).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(_BLOCK)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_end_{c}") for c in cols])
        .select(
            _BLOCK,
            *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in cols],
        )
    )
    local = blocked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in cols})
    tail = [] if default is None else [F.lit(default)]
    filled = {
        c: F.coalesce(F.col(c), F.col(f"_in_{c}"), *tail).cast(df.schema[c].dataType) for c in cols
    }
    return local.join(F.broadcast(carried), _BLOCK, "left").withColumns(filled).select(*df.columns)
