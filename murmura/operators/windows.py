"""Operators over ordered or grouped rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import quoted


def zscore_within(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std (n - 1) within each group; 0 where that isn't defined (a single row, a constant).

    Moments are aggregated, map-side first, and joined back: a group of any size is split over tasks where a window over
    it would be one task's."""
    moments = df.groupBy(*map(quoted, group)).agg(*[f(quoted(c)).alias(f"__{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = df.join(moments, list(group))
    z = lambda i, c: F.coalesce(F.try_divide(quoted(c) - F.col(f"__m_{i}"), F.col(f"__s_{i}")), F.lit(0.0))
    return joined.select(*[z(columns.index(c), c).alias(c) if c in columns else quoted(c) for c in df.columns])


def moving_average(value: Column, order: W, rows: int = 3) -> Column:
    """Mean over the row and those before; null for the first rows - 1."""
    frame = order.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def perfect_prediction(df: DataFrame, columns: Sequence[str], order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Each column's value in the next row; null in the last."""
    w = W.partitionBy(*map(quoted, group)).orderBy(*map(quoted, order))
    return df.withColumns({c: F.lead(quoted(c)).over(w) for c in columns})


def residuals(predicted: DataFrame, actual: DataFrame, columns: Sequence[str], order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """prediction - next actual value, row by row; other columns are those of the prediction."""
    keys = [*group, *order]
    ahead = perfect_prediction(actual, columns, order, group).select(*map(quoted, keys), *[quoted(c).alias(f"__next_{i}") for i, c in enumerate(columns)])
    return predicted.join(ahead, keys).select(*[(quoted(c) - F.col(f"__next_{columns.index(c)}")).alias(c) if c in columns else quoted(c) for c in predicted.columns])


def call_interval(start: Column, w: W, digits: int = 5) -> Column:
    """Time since the call before; -1 for the first."""
    return F.coalesce(F.round(start - F.lag(start).over(w), digits), F.lit(-1.0))


def cumulative(value: Column, w: W, own: bool = True) -> Column:
    """Running sum with or without the row itself."""
    total = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0 if own else -1))
    return total if own else F.coalesce(total, F.lit(0))


def cyclic_by_rows(df: DataFrame, unit: Column, start: int, period: int, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """sin and cos columns of a cycle of ``period`` rows that begins at the first row whose unit equals ``start``; a cycle's
    last row is exactly (0, 1). Rows before it run the cycle backwards. A sequence without such a row raises."""
    w = W.partitionBy(*map(quoted, group)) if group else W.partitionBy(F.lit(0))
    place = F.row_number().over(w.orderBy(*map(quoted, order)))
    numbered = df.withColumn("__place", place).withColumn("__first", F.min(F.when(unit == start, F.col("__place"))).over(w))
    tick = F.pmod(F.col("__place") - F.col("__first"), F.lit(period))
    angle = 2 * 3.141592653589793 * tick / (period - 1)
    last = tick == period - 1
    checked = F.when(F.col("__first").isNull(), F.raise_error(F.lit(f"no row with unit {start}")).cast("double"))
    out = numbered.withColumn("sin", checked.when(last, 0.0).otherwise(F.sin(angle))).withColumn("cos", checked.when(last, 1.0).otherwise(F.cos(angle)))
    return out.drop("__place", "__first")


def local_maxima(df: DataFrame, x: str, y: str, value: str, size: int = 9, group: Sequence[str] = ()) -> DataFrame:
    """Keep a cell's value if it is the greatest of its size x size neighbourhood, else 0: two separable window passes."""
    half = size // 2
    g = [*map(quoted, group)]
    along = F.max(quoted(value)).over(W.partitionBy(*g, quoted(y)).orderBy(quoted(x)).rangeBetween(-half, half))
    rows = df.withColumn("__row_max", along)
    down = F.max("__row_max").over(W.partitionBy(*g, quoted(x)).orderBy(quoted(y)).rangeBetween(-half, half))
    return rows.withColumn("__max", down).withColumn(value, F.when(quoted(value) == F.col("__max"), quoted(value)).otherwise(F.lit(0.0))).drop("__row_max", "__max")
