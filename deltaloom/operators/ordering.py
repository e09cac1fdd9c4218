"""Global numbering and block-wise nested joins without a single hot task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaloom.plans.session import materialise

#: Rows of a nested join's smaller side that are broadcast at once.
BLOCK_ROWS = 10_000


def number_rows(rows: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Rows with their position (long) in a total order.

    Rows are ranged over partitions once, numbered within each, and shifted by the sizes of the partitions before: only
    one row for each partition is ordered globally.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("part_", before.alias("shift_")))  # one row for each partition
    nth = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return ranged.withColumn(name, nth).join(shifts, "part_").withColumn(name, (F.col(name) + F.col("shift_") + (start - 1)).cast("long")).drop("part_", "shift_")


def running_sum(rows: DataFrame, order: list[Column], column: str, name: str) -> DataFrame:
    """Rows with the sum (long) of a column over all rows up to their own in a total order.

    As in ``number_rows``, sums are made within ranges of rows, and shifted by those of the ranges before.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "summed")
    sizes = ranged.groupBy("part_").agg(F.sum(column).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("part_", before.alias("shift_")))  # one row for each range
    upto = F.sum(column).over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, upto).join(shifts, "part_").withColumn(name, (F.col(name) + F.col("shift_")).cast("long")).drop("part_", "shift_")


def block_join(rows: DataFrame, few: DataFrame, key: str, condition: Column, shape: Callable[[DataFrame], DataFrame] = lambda df: df, most: int = BLOCK_ROWS) -> DataFrame:
    """Join a stated set of rows to all rows by any condition, ``most`` of them at a time.

    ``few`` (hashed into blocks by ``key``) is broadcast block by block, so what is broadcast is bounded whatever its size; ``shape``
    is applied to each block's pairs before they are united.
    """
    blocks = max(1, -(-few.count() // most))
    out = None
    for k in range(blocks):
        part = few if blocks == 1 else few.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        met = shape(rows.join(F.broadcast(part), condition))
        out = met if out is None else out.unionByName(met)
    return out
