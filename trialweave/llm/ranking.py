"""Ranks within groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialweave.session import written

#: ``monotonically_increasing_id`` keeps the partition above this bit.
PLACE_BITS = 33


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str = "rank", rows: str = "rows",
           name: str = "ranked") -> DataFrame:
    """``df`` with the place of each row in its group, from 0, and the rows of the group.

    Nulls come first and are one group. Rows that tie in ``order`` get neighbouring places in any
    order. The rows are range-partitioned by group and order, so that a large group is spread over
    many partitions; the counts of (group, partition), one row each, say where a partition starts.
    No column of ``df`` may be called ``uid``, ``place``, ``part`` or like one of the results.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    table = written(
        df.withColumn("uid", F.monotonically_increasing_id())
        .repartitionByRange(*keys, F.col("uid").asc()).sortWithinPartitions(*keys, F.col("uid").asc())
        .drop("uid").withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", PLACE_BITS)
    cells = table.groupBy(*group, part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        *[F.col(c).alias(f"cell_{c}") for c in group], F.col("part").alias("cell_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias(rows))
    same = part == F.col("cell_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"cell_{c}"))
    return (table.join(cells, same).withColumn(rank, F.col("place") + F.col("shift"))
            .select(*df.columns, rank, rows))
