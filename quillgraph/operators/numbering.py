"""Running numbers and sums in order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, value: Column | None = None) -> DataFrame:
    """Rows with `name`: the sum of `value` (null counts as 0) over the earlier rows of the group in order; without a value, their number.

    Rows are dealt to ranges of (group, order), so a group of any size lies in many tasks; within a range the sums are a window, and a
    row for each range and group says how much came before it. Rows that are equal in group and order lie in one range, in any order.
    """
    value = F.lit(1).cast("long") if value is None else F.coalesce(value, F.lit(0))
    keys = [F.col(g).asc_nulls_first() for g in (*group, *order)] or [F.lit(0)]
    ranged = written(rows.withColumn("_value", value).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range", *group).orderBy(*(F.col(o).asc_nulls_first() for o in order)).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range", *group).agg(F.sum("_value").alias("_sum"))
    # A row for each range that a group lies in: as many as there are ranges, and one for each further group.
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("_range").alias("_r"), *(F.col(g).alias(f"_g_{g}") for g in group), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    same = F.col("_range") == F.col("_r")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    numbered = ranged.withColumn("_before", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(base, same)
    return numbered.select(*rows.columns, (F.col("_base") + F.col("_before")).alias(name))
