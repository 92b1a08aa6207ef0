"""From raw recordings to model-ready sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import quoted
from .ranges import number, running


def configuration(df: DataFrame, file: str, minimum: int) -> DataFrame:
    """(parameter, value): longest recording, minimum length and number of files, before any row is dropped."""
    sizes = df.where(quoted(file).isNotNull()).groupBy(quoted(file)).count()
    row = sizes.agg(F.max("count").alias("max_length"), F.lit(minimum).cast("long").alias("min_length"), F.count("*").alias("num_files"))
    return row.unpivot([], ["max_length", "min_length", "num_files"], "parameter", "value")


def with_index(df: DataFrame, file: str, order: Sequence[str], name: str = "chirp_idx") -> DataFrame:
    """0-based place in the recording. The order must have no ties."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(quoted(file)).orderBy(*map(quoted, order))) - 1)


def file_ids(df: DataFrame, file: str, name: str = "file_id") -> DataFrame:
    """(file, id): files numbered from 0 in their order; numbers are given to the distinct names."""
    return number(df.select(quoted(file)).where(quoted(file).isNotNull()).distinct(), [file], name)


def sample_counts(df: DataFrame, file: str, minimum: int, index: str = "chirp_idx") -> DataFrame:
    """(file, n_samples, cum_samples, start): training prefixes of each recording, running total and total before it."""
    counts = df.groupBy(quoted(file)).agg((F.max(quoted(index)) - minimum + 2).cast("long").alias("n_samples"))
    return running(counts, file, {"cum_samples": "n_samples"}).withColumn("start", F.col("cum_samples") - F.col("n_samples"))


def assign_splits(files: DataFrame, splits: int, total: int | None = None, file: str = "file_id") -> DataFrame:
    """files with ``split``: whole recordings, so many to a split that about ``splits`` come out (the number is rounded half
    up, so it may be one more)."""
    total = files.count() if total is None else total
    each = max(1, math.floor((total + splits / 2) // splits))
    return files.withColumn("split", F.floor(quoted(file) / each).cast("int"))


def split_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("split").agg(F.sum("n_samples").alias("n_samples"))


def check_mapping(files: DataFrame, mapping: DataFrame) -> bool:
    """Whether the mapping's totals are those of the files."""
    found = split_totals(files).withColumnRenamed("n_samples", "found")
    return mapping.join(found, "split", "full").where("NOT (n_samples <=> found)").isEmpty()


def locate(samples: DataFrame, index: str, files: DataFrame, file: str = "file_id") -> DataFrame:
    """The recording and the place in it of running sample numbers: the largest start not above each, by a range join
    on equal steps of numbers."""
    step = 1024
    spans = files.where("n_samples > 0").withColumn("__step", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("start") + F.col("n_samples") - 1) / step))))
    asked = samples.withColumn("__step", F.floor(quoted(index) / step))
    met = asked.join(spans.select(quoted(file), "start", "n_samples", "__step"), "__step")
    return met.where((quoted(index) >= F.col("start")) & (quoted(index) < F.col("start") + F.col("n_samples"))).select(*[quoted(c) for c in samples.columns], quoted(file), (quoted(index) - F.col("start")).alias("within"))


def explode_prefixes(df: DataFrame, group: str, index: str, minimum: int, length: str = "__length") -> DataFrame:
    """Every prefix of each recording from ``minimum`` rows on, as rows with ``cntxt_sz`` = rows of the prefix - 1.

    The rows grow with the square of the recordings' lengths: consume them, don't store them."""
    sizes = df.groupBy(quoted(group)).agg((F.max(quoted(index)) + 1).alias(length))
    rows = df.join(sizes, group)
    ends = F.sequence(F.greatest(F.lit(minimum), quoted(index) + 1), F.col(length))
    some = rows.where(F.greatest(F.lit(minimum), quoted(index) + 1) <= F.col(length))
    return some.withColumn("__end", F.explode(ends)).withColumn("cntxt_sz", (F.col("__end") - 1).cast("int")).drop("__end")


def left_pad(df: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str], to: int, value: float | None = 0.0, rebase: str | None = None) -> DataFrame:
    """Each group as ``to`` rows, TimeIndex 0 .. to - 1, its own rows last and ``value`` (or null) before them; of longer
    groups the last rows. ``rebase`` names a column that counts from the group's least value."""
    k = [*map(quoted, keys)]
    sizes = df.groupBy(*k).agg((F.max(quoted(index)) + 1).alias("__n"), *([F.min(quoted(rebase)).alias("__base")] if rebase else []))
    rows = df.join(sizes, list(keys)).withColumn("TimeIndex", (quoted(index) - F.col("__n") + to).cast("int"))
    rows = rows.select(*k, "TimeIndex", *[(quoted(c) - F.col("__base") if c == rebase else quoted(c)).alias(c) for c in columns])
    grid = sizes.select(*k, F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias("TimeIndex"))
    padded = grid.join(rows.withColumn("__has", F.lit(True)), [*keys, "TimeIndex"], "left")
    return padded.select(*k, "TimeIndex", *[F.when(F.col("__has"), quoted(c)).otherwise(F.lit(value)).alias(c) for c in columns])


def flatten_by_length(df: DataFrame, group: str, index: str, columns: Sequence[str], length: int) -> DataFrame:
    """Recordings of exactly ``length`` rows as one row each, with columns ``<measure>_<i>``."""
    cells = [F.max(F.when(quoted(index) == i, quoted(c))).alias(f"{c}_{i}") for i in range(length) for c in columns]
    return df.groupBy(quoted(group)).agg(F.count("*").alias("__n"), *cells).where(F.col("__n") == length).drop("__n")


@dataclass
class IndexSplit:
    """Sizes of train, validation and test parts of samples numbered 0 .. total - 1; rests go to the test part."""

    total: int
    validation: float
    test: float

    def __post_init__(self):
        if self.validation + self.test >= 1:
            raise ValueError("nothing is left to train on")
        self.train_size, self.validation_size = int(self.total * (1 - self.validation - self.test)), int(self.total * self.validation)

    def part(self, index):
        return F.when(index < self.train_size, "train").when(index < self.train_size + self.validation_size, "val").otherwise("test")


def holdout(df: DataFrame, file: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) by whole files: the int(n * share) files whose names hash lowest are tested."""
    names = df.select(quoted(file).alias("__file")).distinct()
    n = int(names.count() * share)
    test = names.orderBy(F.xxhash64("__file", F.lit(seed)), "__file").limit(n)
    on = quoted(file) == F.col("__file")
    return df.join(test, on, "left_anti"), df.join(test, on, "left_semi")
