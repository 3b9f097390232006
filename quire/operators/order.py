"""Running numbers and sums over whole tables, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most: their sums are broadcast, one row each.
MOST_RANGES = 1024


def _place(value: Column, bounds: list[float], lo: int, hi: int) -> Column:
    """The number of bounds up to a value, by halving."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value < bounds[mid], _place(value, bounds, lo, mid)).otherwise(_place(value, bounds, mid + 1, hi))


def ranges(df: DataFrame, value: Column) -> tuple[Column, int]:
    """The range that a number lies in, in order, and how many ranges there are: as many as shuffle partitions, of about as many rows each.

    Nulls are in the first, NaN in the last. Rows of one value are in one range.
    """
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    value = value.cast("double")
    steps = [k / n for k in range(1, n)]
    bounds = sorted(set(df.select(value.alias("q_value")).approxQuantile("q_value", steps, 0.25 / n))) if steps else []
    return F.when(value.isNull(), 0).otherwise(_place(value, bounds, 0, len(bounds))), len(bounds) + 1


def running_sum(df: DataFrame, order: Column, amount: Column, name: str, sample: DataFrame | None = None) -> DataFrame:
    """``name``: the sum of ``amount`` over all rows up to this in the order of a number, nulls first.

    Sums of ranges come before windows within them. The order must have no ties that matter. ``sample``: where the ranges are taken from, if not from the
    rows themselves (the rows that a table was aggregated from, which spares the aggregate a second time).
    """
    place, _ = ranges(df if sample is None else sample, order)
    df = df.withColumn("q_range", place).withColumn("q_amount", amount)
    sums = df.groupBy("q_range").agg(F.sum("q_amount").alias("q_sum"))
    before = F.sum("q_sum").over(Window.orderBy("q_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("q_range", F.coalesce(before, F.lit(0)).alias("q_before"))
    within = F.sum("q_amount").over(Window.partitionBy("q_range").orderBy(order.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.withColumn("q_within", within).join(F.broadcast(offsets), "q_range")
    return out.withColumn(name, F.col("q_before") + F.col("q_within")).drop("q_range", "q_amount", "q_within", "q_before")


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``name``: the number of each row from 1, in the order of a number without ties."""
    return running_sum(df, order, F.lit(1).cast("bigint"), name)
