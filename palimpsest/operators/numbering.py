"""Consecutive numbers and running sums over all rows of a table, without a task that sees them all.

Rows belong to ordered cells of bounded size. Each cell's totals are added up over the cells before it, and rows
are numbered within their cell; only totals meet in one place, a row a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def numbered(rows: DataFrame, cell: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """``rows`` in order of ``cell``, then ``order``: their ``sequence`` from 0, and the ``weight`` of all rows before each as ``before``.

    The order must be a total one. Cells should hold what a task can sort.
    """
    weighed = rows.withColumn("__weight", (F.lit(0) if weight is None else weight).cast("long"))
    totals = weighed.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.sum("__weight").alias("__sum"))
    earlier = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    base = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = totals.select(*cell, base("__n").alias("__rows_before"), base("__sum").alias("__sum_before"))
    within = Window.partitionBy(*cell).orderBy(*order)
    inside = weighed.withColumn("__i", F.row_number().over(within) - 1).withColumn("__own", F.sum("__weight").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    placed = inside.join(offsets, cell)
    sequence, before = (F.col("__rows_before") + F.col("__i")).cast("long"), (F.col("__sum_before") + F.coalesce("__own", F.lit(0))).cast("long")
    return placed.select(*[c for c in rows.columns if c not in ("sequence", "before")], sequence.alias("sequence"), before.alias("before"))


def parts_of(rows: DataFrame, limit: int) -> DataFrame:
    """``part`` of rows of ``numbered``: a new one begins with the first row at or beyond each multiple of ``limit`` in ``before``.

    So a part holds less than ``limit`` beside its last row. Parts may be skipped by a row heavier than ``limit``.
    """
    return rows.withColumn("part", F.floor(F.col("before") / F.lit(limit)).cast("long"))
