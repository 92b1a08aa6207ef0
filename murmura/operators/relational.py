"""Unions, joins, lookups, samples, top shares."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import species, time_from_name
from ..functions.scalars import quoted
from ..functions.times import cycle_columns, sunrise_sunset
from .ranges import number, number_within
from .shaping import Condition, condition

#: A lookup table of at most so many rows may be broadcast; Spark chooses for a longer one.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def concat(frames: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """UNION ALL. strict: names must be the same, in the same order (TypeError); else missing columns are null."""
    if not frames:
        raise ValueError("nothing to concatenate")
    if strict and any(f.columns != frames[0].columns for f in frames):
        raise TypeError("the frames' columns differ")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), frames)


def with_row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_num") -> DataFrame:
    """Dense numbers from 0 in an order without ties."""
    return number(df, order, name)


def lookup(df: DataFrame, dimension: DataFrame, on: Sequence[str], needed: str | None = None) -> DataFrame:
    """N:1 left join. ``needed`` names a column of the dimension; a row that finds none raises."""
    out = df.join(_small(dimension.withColumn("__found", F.lit(True))), list(on), "left")
    if needed:
        shown = F.concat_ws(",", *[quoted(c).cast("string") for c in on])
        kind = dict(dimension.dtypes)[needed]
        out = out.withColumn(needed, F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("unknown key "), shown)).cast(kind)).otherwise(quoted(needed)))
    return out.drop("__found")


def truth_with_predictions(truth: DataFrame, predictions: DataFrame, keys: Sequence[str], measures: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Inner join on the keys; measures are suffixed _truth and _pred. Repeated keys multiply; null keys match nothing."""
    t = truth.select(*map(quoted, keys), *[quoted(m).alias(f"{m}_truth") for m in measures])
    p = predictions.select(*map(quoted, keys), *map(quoted, more), *[quoted(m).alias(f"{m}_pred") for m in measures])
    return p.join(t, list(keys))


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(quoted(key)), key, "left_anti")


def listed(df: DataFrame, wanted: DataFrame, key: str, place: str) -> DataFrame:
    """Rows whose key is listed, with its place in the list; unknown names are dropped."""
    return df.join(_small(wanted.select(quoted(key), quoted(place))), key)


def in_all(df: DataFrame, member: Column, classes: Sequence, of: str) -> DataFrame:
    """Distinct ``of`` values that occur with every one of the classes."""
    met = df.where(member.isin(*classes)).groupBy(quoted(of)).agg(F.count_distinct(member).alias("__n"))
    return met.where(F.col("__n") == len(set(classes))).drop("__n")


def augment(df: DataFrame, dimension: DataFrame, file_id: str = "file_id", name: str = "Filename", low: str = "LowFreq", high: str = "HiFreq") -> DataFrame:
    """Columns rec_datetime, is_daytime, species, freq_mean and the cycles, from the recording's name."""
    out = lookup(df, dimension, [file_id], needed=name)
    out = out.withColumn("rec_datetime", time_from_name(quoted(name))).withColumn("species", species(quoted(name))).withColumn("freq_mean", (quoted(low) + quoted(high)) / 2)
    out = _with_sun(out, "rec_datetime")
    return out.withColumn("is_daytime", F.when(F.col("rec_datetime").isNotNull(), _daytime("rec_datetime"))).withColumns(cycle_columns(F.col("rec_datetime"))).drop("__rise", "__fall", name)


def _with_sun(df: DataFrame, at: str) -> DataFrame:
    """Columns __rise and __fall of the column ``at``'s day, computed once a day and joined back. A null check on them would
    be pushed below the distinct days and so solve the equations for each row: compare them with ``_daytime``."""
    dated = df.withColumn("__day", F.to_date(at))
    days = dated.select("__day").distinct()
    rise, fall = sunrise_sunset("__day")
    return dated.join(_small(days.select("__day", rise.alias("__rise"), fall.alias("__fall"))), "__day", "left").drop("__day")


def _daytime(at: str) -> Column:
    return F.coalesce(F.col(at).between(F.col("__rise"), F.col("__fall")), F.lit(False))


def daytime_only(df: DataFrame, name: str = "Filename") -> DataFrame:
    """Rows recorded between sunrise and sunset, both included."""
    timed = df.withColumn("__at", time_from_name(quoted(name)))
    return _with_sun(timed, "__at").where(_daytime("__at")).drop("__rise", "__fall", "__at")


def allocate(sizes: Mapping[object, int], needed: int, taken: int = 0) -> dict[object, int]:
    """How many rows to take from each source: the same share of each, rounded up."""
    available = sum(sizes.values()) - taken
    if available <= 0:
        raise ValueError("more rows are asked for than there are")
    return {k: math.ceil(needed / available * n) for k, n in sizes.items()}


def sample(df: DataFrame, n: int, seed: int, key: Sequence[str], cond: Condition | None = None) -> DataFrame:
    """Exactly n rows without replacement: those whose hashed keys come first. The same rows for the same seed, whatever
    the partitioning; more than there are is a ValueError."""
    rows = df if cond is None else df.where(condition(df, cond))
    if n > rows.count():
        raise ValueError(f"{n} rows are asked for, more than there are")
    return rows.orderBy(F.xxhash64(*map(quoted, key), F.lit(seed)), *map(quoted, key)).limit(n)


def stratified_sample(df: DataFrame, by: str, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Exactly n rows, from each stratum in proportion to its size; the surplus of rounding up is dropped at random."""
    sizes = {r[by]: r["count"] for r in df.groupBy(quoted(by)).count().collect()}  # a row a source
    if n > sum(sizes.values()):
        raise ValueError(f"{n} rows are asked for, more than there are")
    takes = df.sparkSession.createDataFrame([*allocate(sizes, n).items()], f"`{by}` {dict(df.dtypes)[by]}, __take long") if sizes else None
    if takes is None:
        return df
    dealt = df.withColumn("__dealt", F.xxhash64(*map(quoted, key), F.lit(seed)))
    ranked = number_within(dealt, by, ["__dealt", *key], "__r").join(_small(takes.withColumnRenamed(by, "__of")), quoted(by).eqNullSafe(F.col("__of")))
    chosen = ranked.where(F.col("__r") < F.col("__take")).drop("__r", "__take", "__of", "__dealt")
    return chosen.orderBy(F.xxhash64(*map(quoted, key), F.lit(seed + 1)), *map(quoted, key)).limit(n)


def top_shares(df: DataFrame, name: str, share: str, threshold: float) -> DataFrame:
    """The shortest run of the largest shares that reaches the threshold; all of them if none does."""
    w = W.orderBy(quoted(share).desc(), quoted(name)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(quoted(share)).over(w)).where(F.round(F.col("cumulative") - quoted(share), 12) < threshold)


def top_impact(df: DataFrame, name: str, share: str, threshold: float = 0.9, inclusive_extra: bool = False) -> DataFrame:
    """The features below the threshold's cumulative share and the one that crosses it; with one more if asked for."""
    w = W.orderBy(quoted(share).desc(), quoted(name))
    numbered = df.withColumn("cumulative", F.sum(quoted(share)).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__r", F.row_number().over(w))
    below = F.count(F.when(F.col("cumulative") < threshold, 1)).over(W.partitionBy())
    return numbered.withColumn("__below", below).where(F.col("__r") <= F.col("__below") + (2 if inclusive_extra else 1)).drop("__r", "__below")


def cull_thresholds(df: DataFrame, threshold: str, cut: float = 0.1, least: int = 10) -> DataFrame:
    """Points with a threshold of at least the highest cut among 0.10, 0.09, ... that leaves ``least`` points; a null
    threshold is dropped; up to ``least`` points are left alone."""
    if df.limit(least + 1).count() <= least:
        return df
    some = df.where(quoted(threshold).isNotNull())
    steps = [round(cut - i / 100, 2) for i in range(int(round(cut * 100)) + 1)]
    counts = some.agg(*[F.count(F.when(quoted(threshold) >= s, 1)).alias(f"n{i}") for i, s in enumerate(steps)]).first()
    chosen = next((s for i, s in enumerate(steps) if counts[i] >= least), None)
    return some if chosen is None else some.where(quoted(threshold) >= chosen)


def in_rounds(df: DataFrame, order: str, n: int, name: str = "batch") -> DataFrame:
    """Deal rows, in an order without ties, to n batches in turn, numbered from 1."""
    return number(df, [order], name).withColumn(name, (F.pmod(quoted(name), F.lit(n)) + 1).cast("int"))


def in_groups_of(df: DataFrame, order: str, size: int, name: str = "group") -> DataFrame:
    return number(df, [order], name).withColumn(name, F.floor(quoted(name) / size).cast("int"))
