"""Pages of a long list without a sort of the list: its rows lie on disk in an order, each with its place.

A place is the number of a task's range in its upper bits and the row's number within the range below them, so it grows along the
order but has gaps between ranges. Rows are counted by blocks of places; a page finds its blocks in these counts and reads only places
between two bounds, which Parquet's statistics of row groups and pages prune. Of a list under a filter the blocks are counted anew, by
one pass over the columns of the filter; nothing is sorted but the rows of the page's blocks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.operators.inventory import PAGE

PLACE = "_place"
#: A block is 2 ** BLOCK_BITS places: what the driver reads of a list is one number for each block.
BLOCK_BITS = 16


def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.shiftright(PLACE, BLOCK_BITS).alias("block")).agg(F.count(F.lit(1)).alias("n"))


def lay(df: DataFrame, order: list[Column], folder: str) -> None:
    """Write rows in an order that no two of them share, and the counts of their blocks. The folder must be new; `counts` comes last,
    so a folder that has it is whole."""
    df.orderBy(*order).withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    _counts(df.sparkSession.read.parquet(f"{folder}/rows").select(PLACE)).coalesce(1).write.parquet(f"{folder}/counts")


def page(spark: SparkSession, folder: str, offset: int = 0, limit: int = PAGE, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One page of the rows that `keep` keeps (None: all), in their order: at most 500, from a place that is not negative."""
    offset, limit = max(offset, 0), min(max(limit, 0), PAGE)
    rows = spark.read.parquet(f"{folder}/rows")
    columns = [c for c in rows.columns if c != PLACE]
    kept = keep(rows) if keep else rows
    blocks = sorted(tuple(r) for r in (_counts(kept) if keep else spark.read.parquet(f"{folder}/counts")).collect())
    ends = list(accumulate(n for _, n in blocks))
    if not limit or not ends or offset >= ends[-1]:
        return kept.where(F.lit(False)).select(*columns)
    first, last = bisect_right(ends, offset), min(bisect_left(ends, offset + limit), len(ends) - 1)
    over = offset - (ends[first - 1] if first else 0)
    low, high = blocks[first][0] << BLOCK_BITS, (blocks[last][0] + 1) << BLOCK_BITS
    if not keep:  # places of a block have no gaps, so the bounds can be those of the page's own rows
        low, over, high = low + over, 0, (blocks[last][0] << BLOCK_BITS) + offset + limit - (ends[last - 1] if last else 0)
    return kept.where((F.col(PLACE) >= low) & (F.col(PLACE) < high)).orderBy(PLACE).offset(over).limit(limit).select(*columns)
