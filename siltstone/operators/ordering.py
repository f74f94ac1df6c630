"""Numbers and running sums over a total order, without bringing all rows into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import checked, fresh, materialise

ROWS_PER_RANGE = 1_000_000


def running(df: DataFrame, order: list[str], value: Column | None = None, into: str = "before", *, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``into``: the sum of ``value`` (default: the number of rows) over the rows that come before in ``order``; 0 for the first.

    The rows are cut into ranges of the order, whose sums, one row each, give every range its offset; within a range a window sums
    on. Columns of ``order`` should tell rows apart: rows that are equal in all of them fall into one range. An empty table gives no rows.
    """
    part, amount, above = fresh(df, "part", "amount", "above")
    ranges = max(1, math.ceil(df.count() / rows_per_range))
    given = df.withColumn(amount, F.lit(1).cast("long") if value is None else value)
    placed = materialise(given.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = placed.groupBy(part).agg(F.sum(amount).alias(above))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select(part, F.coalesce(F.sum(above).over(earlier), F.lit(0)).alias(above))
    within = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn(into, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return summed.join(F.broadcast(offsets), part).withColumn(into, F.col(into) + F.col(above)).select(*df.columns, into)


def within(df: DataFrame, by: list[str], order: list[str], value: Column | None = None, into: str = "before", *, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``running`` within each group of ``by``, from 0 in each. Null groups are one. No group is brought into one task."""
    summed = running(df, [*by, *order], value, into, rows_per_range=rows_per_range)
    if not by:
        return summed
    start, *names = fresh(summed, "start", *(f"{g}_of" for g in by))
    starts = materialise(summed.groupBy(*(F.col(g).alias(n) for g, n in zip(by, names))).agg(F.min(into).alias(start)), "starts")
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(by, names)]
    return summed.join(checked(starts), same).withColumn(into, F.col(into) - F.col(start)).select(*df.columns, into)
