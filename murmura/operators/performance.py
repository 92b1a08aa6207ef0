"""Predictions held against the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quoted
from .ranges import quantiles


def errors(joined: DataFrame, measures: Sequence[str], by: Sequence[str] = ("model_id",)) -> DataFrame:
    """(by, measure, rmse, min_abs_diff, max_abs_diff) of columns ``<m>_truth`` and ``<m>_pred``: one aggregation, whose few
    rows are then turned to long form."""
    gap = {m: quoted(f"{m}_truth") - quoted(f"{m}_pred") for m in measures}
    aggs = [F.struct(F.lit(m).alias("measure"), F.sqrt(F.avg(g * g)).alias("rmse"), F.min(F.abs(g)).alias("min_abs_diff"), F.max(F.abs(g)).alias("max_abs_diff")) for m, g in gap.items()]
    return joined.groupBy(*map(quoted, by)).agg(F.array(*aggs).alias("e")).select(*map(quoted, by), F.inline("e"))


def legacy_name(name: Column) -> Column:
    """Measure names as older result files have them: all letters of '_truth' cut off both ends."""
    return F.btrim(name, F.lit("_truth"))


def means(found: DataFrame) -> DataFrame:
    """Each measure's metrics as means over the models."""
    return found.groupBy("measure").agg(*[F.avg(m).alias(m) for m in ("rmse", "min_abs_diff", "max_abs_diff")])


def metric_matrix(found: DataFrame, metric: str, models: Sequence) -> DataFrame:
    """Measures by models."""
    return found.groupBy("measure").pivot("model_id", list(models)).agg(F.first(metric))


def squared_errors(joined: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return joined.select(*map(quoted, keys), *[((quoted(f"{m}_pred") - quoted(f"{m}_truth")) * (quoted(f"{m}_pred") - quoted(f"{m}_truth"))).alias(m) for m in measures])


def mean_errors(squared: DataFrame, index: str, measures: Sequence[str]) -> DataFrame:
    """(index, n, measures): mean squared errors by the call's place, and how many calls stand behind them."""
    return squared.groupBy(quoted(index)).agg(F.count("*").alias("n"), *[F.avg(quoted(m)).alias(m) for m in measures])


def clean_predictions(df: DataFrame) -> DataFrame:
    """chirp_idx is the context's size; keys as integers; no TimeIndex."""
    return df.drop("TimeIndex").withColumn("cntxt_sz", F.col("cntxt_sz").cast("bigint")).withColumn("chirp_idx", F.col("cntxt_sz")).withColumn("file_id", F.col("file_id").cast("bigint"))


def ensemble_variance(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Variance (n - 1) over the models of each call, by column, and their sum."""
    out = df.groupBy(*map(quoted, keys)).agg(*[F.var_samp(quoted(c)).alias(c) for c in columns])
    return out.withColumn("total", sum((quoted(c) for c in columns[1:]), quoted(columns[0])))


def clip_limits(df: DataFrame, column: str, low: float = 0.0005, high: float = 0.999) -> DataFrame:
    """Exact percentiles by linear interpolation."""
    found = quantiles(df, [], column, [low, high])
    return found.agg(F.max(F.when(F.col("share") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("share") == high, F.col("value"))).alias("high"))


def running_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*map(quoted, by)).agg(F.try_divide(F.sum(quoted(value) * quoted(weight)), F.sum(quoted(weight))).alias("mean"))


def loss_percentiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, quartiles, max and mean of the means of all columns without a missing value."""
    row = F.array(*[F.when(F.count(quoted(c)) == F.count("*"), F.avg(quoted(c))) for c in columns])
    each = df.agg(row.alias("m")).select(F.explode("m").alias("m")).where("m IS NOT NULL")
    return each.agg(F.min("m").alias("min"), F.percentile("m", 0.25).alias("q1"), F.percentile("m", 0.5).alias("median"), F.percentile("m", 0.75).alias("q3"), F.max("m").alias("max"), F.avg("m").alias("mean"))
