"""Places in an order, for whole tables and for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import written


def positions(rows: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """Rows with `pos`, their place from 0 in their group by `order`, and `total`, the rows of the group.

    Rows are dealt by ranges over all tasks, so a group that holds most of them, or all, is spread; what meets for a group are
    counts, one for each range. Columns of the group are not null; ties in `order` fall in any order. No group: the whole table.
    """
    # A row's number holds its range in the upper bits and its place there in the lower ones.
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    numbered = written(dealt.withColumn("_row", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_row", 33))
    counts = numbered.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    of = ", ".join(f"`{g}`" for g in group) or "1"
    before = counts.selectExpr(
        *[f"`{g}`" for g in group], "_range", f"sum(_n) OVER (PARTITION BY {of} ORDER BY _range) - _n - _first AS _shift", f"sum(_n) OVER (PARTITION BY {of}) AS total"
    )
    placed = numbered.join(before, [*group, "_range"])
    return placed.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("pos"), "total")
