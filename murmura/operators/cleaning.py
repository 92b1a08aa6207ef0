"""Cleaning raw exports and profiling columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import FILTERS, PREEMPHASIS, encode, quoted, seconds_number
from ..schema import ADMINISTRATIVE
from .ranges import quantiles

STATISTICS = ("variance", "vars_normed", "stdev", "max", "min", "mean", "median")


def normalise_index(df: DataFrame) -> DataFrame:
    """Where an export has its index twice, the second one is the TimeIndex."""
    if "TimeIndex.1" not in df.columns:
        return df
    return df.drop("TimeIndex").withColumnRenamed("TimeIndex.1", "TimeIndex")


def drop_administrative(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*(ADMINISTRATIVE if names is None else names))


def numeric_categories(df: DataFrame, strict: bool = True) -> DataFrame:
    """Preemphasis, Filter and MaxSegLnght as numbers; those that aren't there are left out."""
    made = {"Preemphasis": lambda c: encode(c, PREEMPHASIS, strict), "Filter": lambda c: encode(c, FILTERS, strict), "MaxSegLnght": lambda c: seconds_number(c, strict), "MaxSegLngth": lambda c: seconds_number(c, strict)}
    return df.withColumns({c: f(quoted(c)) for c, f in made.items() if c in df.columns and dict(df.dtypes)[c] == "string"})


def profile(df: DataFrame, columns: Sequence[str], rank_with: Sequence[str] = ()) -> DataFrame:
    """One row a column: variance (n - 1), its rank among all columns as a share of their number (ties share the average
    rank), standard deviation, max, min, mean and median (exact); by descending variance. ``rank_with`` names columns that
    count in the ranking but aren't reported."""
    every = [*columns, *(c for c in rank_with if c not in columns)]
    stats = lambda c: F.struct(F.lit(c).alias("measure"), F.var_samp(quoted(c)).alias("variance"), F.stddev_samp(quoted(c)).alias("stdev"), F.max(quoted(c)).cast("double").alias("max"), F.min(quoted(c)).cast("double").alias("min"), F.avg(quoted(c)).alias("mean"))
    rows = df.agg(F.array(*[stats(c) for c in every]).alias("s")).select(F.inline("s"))
    # one row a column from here on
    ties = W.partitionBy("variance")
    rank = (F.rank().over(W.orderBy("variance")) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(W.partitionBy())
    ranked = rows.withColumn("vars_normed", F.when(F.col("variance").isNotNull(), rank))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), quoted(c).cast("double").alias("value")) for c in columns])))
    medians = quantiles(long, ["measure"], "value", [0.5]).select("measure", F.col("value").alias("median"))
    return ranked.where(F.col("measure").isin(*columns)).join(medians, "measure", "left").select("measure", *STATISTICS)


def profile_wide(stats: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Statistics as rows, measures as columns."""
    long = stats.unpivot(["measure"], list(STATISTICS), "Stats", "value")
    return long.groupBy("Stats").pivot("measure", list(measures)).agg(F.first("value"))


def cull(df: DataFrame, stats: DataFrame, threshold: float, positional: bool = False) -> DataFrame:
    """Drop columns whose normalised variance is below the threshold.

    positional: instead keep as many columns as reach it, the first ones. Columns without statistics stay."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is between 0 and 1")
    rank = {r["measure"]: r["vars_normed"] for r in stats.select("measure", "vars_normed").collect()}  # a row a column
    good = [c for c in df.columns if c in rank and (rank[c] or 0) >= threshold]
    if positional:
        good = [c for c in df.columns if c in rank][: len(good)]
    return df.select(*[quoted(c) for c in df.columns if c not in rank or c in good])


def unit_number(value: Column) -> Column:
    """The leading number of a text with a unit; null without."""
    return F.nullif(F.regexp_extract(value, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1), F.lit("")).try_cast("double")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
