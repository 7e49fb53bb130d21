"""Numbers of rows in an order over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Row numbers within a partition, as ``monotonically_increasing_id`` lays them out.
INNER_BITS = 33


def in_order(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: from 0 in ``order`` over all rows; rows that tie in it are numbered in any order.

    Rows are dealt to tasks by range and sorted there; what one task sums up is a count for each range.  The
    sorted rows are written, so numbers stay if a task runs again.
    """
    number, part, ahead, n = (f"__{c}_{name}" for c in ("number", "part", "ahead", "n"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id())
    placed = written(ranged, "in-order").withColumn(part, F.shiftright(number, INNER_BITS))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n)).select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    inner = F.col(number).bitwiseAND(F.lit((1 << INNER_BITS) - 1))
    return placed.join(F.broadcast(counts), part).withColumn(name, F.col(ahead) + inner).drop(number, part, ahead)
