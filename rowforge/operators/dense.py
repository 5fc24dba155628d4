"""Row positions 0, 1, ... for rows in the order of a key, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.sources.ranges import key_ranges
from rowforge.sources.staging import stage

ROWS_A_RANGE = 1_000_000


def placed_by(df: DataFrame, key: str = "i") -> DataFrame:
    """df with `_range`: near-equal ranges of `key`, in its order."""
    n = df.count()
    return key_ranges(df, key, max(1, -(-n // ROWS_A_RANGE))).place(df, key, "_range")


def range_starts(totals: DataFrame, value: str) -> DataFrame:
    """_range and `_start`: the sum of `value` over the ranges before it.  totals: a row a range, at most MOST_RANGES, so that
    one task can add them up; the result is broadcast."""
    return F.broadcast(totals.select("_range", (F.sum(value).over(Window.orderBy("_range")) - F.col(value)).alias("_start")))


def dense_index(df: DataFrame, key: str = "i") -> DataFrame:
    """df with `key` replaced by its rank from 0 (key: a unique bigint).

    Ranges of the key are numbered on their own; a range starts at the number of rows in those before it, which a small
    table joins to it."""
    rows = stage(df)
    placed = placed_by(rows, key)
    starts = range_starts(placed.groupBy("_range").agg(F.count("*").alias("_n")), "_n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return placed.withColumn("_rank", rank).join(starts, "_range").withColumn(key, (F.col("_rank") + F.col("_start")).cast("bigint")).select(*df.columns)
