"""Standardising and scaling, with parameters as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quoted
from .ranges import quantiles


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, scale): mean and population standard deviation; a constant column has scale 1."""
    stat = lambda c: F.struct(F.lit(c).alias("column"), F.avg(quoted(c)).alias("mean"), F.stddev_pop(quoted(c)).alias("scale"))
    rows = df.agg(F.array(*[stat(c) for c in columns]).alias("s")).select(F.inline("s"))
    return rows.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def _parameters(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["column"]: (r["mean"], r["scale"]) for r in scaler.collect()}  # a row a column


def standardise(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """(x - mean) / scale for the scaler's columns that are there; the others stay as they are, in place."""
    p = _parameters(scaler)
    return df.select(*[((quoted(c) - p[c][0]) / F.lit(p[c][1])).alias(c) if c in p and p[c][0] is not None else quoted(c) for c in df.columns])


def unstandardise(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """x * scale + mean, likewise."""
    p = _parameters(scaler)
    return df.select(*[(quoted(c) * p[c][1] + p[c][0]).alias(c) if c in p and p[c][0] is not None else quoted(c) for c in df.columns])


def min_max(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Into [low, high] by the least and greatest value of all the columns together; null if those are equal."""
    least, most = F.array_min(F.array(*[F.min(quoted(c)) for c in columns])), F.array_max(F.array(*[F.max(quoted(c)) for c in columns]))
    ends = df.agg(least.cast("double").alias("__low"), most.cast("double").alias("__high"))
    scaled = [(low + (high - low) * F.try_divide(quoted(c) - F.col("__low"), F.col("__high") - F.col("__low"))).alias(c) if c in columns else quoted(c) for c in df.columns]
    return df.crossJoin(F.broadcast(ends)).select(*scaled)  # one row


def median_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, scale): the mean, and the absolute median distance from it."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns])))
    medians = quantiles(long, ["column"], "value", [0.5]).select("column", F.col("value").alias("median"))
    means = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.avg(quoted(c)).alias("mean")) for c in columns]).alias("s")).select(F.inline("s"))
    return means.join(medians, "column", "left").select("column", "mean", F.abs(F.col("median") - F.col("mean")).alias("scale"))
