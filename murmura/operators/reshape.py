"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quoted
from ..schema import FAMILIES


def long_format(df: DataFrame, families: Mapping[str, Sequence[str]] | None = None, keys: Sequence[str] = ("chirp_num",)) -> DataFrame:
    """(keys, Measure_Type, Measure_Name, Measure_Value): a row for each measure and each time a family names it.

    Measures that aren't there are left out. One pass: the families' names are literals of the plan."""
    pairs = [(family, m) for family, names in (FAMILIES if families is None else families).items() for m in names if m in df.columns]
    cells = F.array(*[F.struct(F.lit(f).alias("Measure_Type"), F.lit(m).alias("Measure_Name"), quoted(m).cast("double").alias("Measure_Value")) for f, m in pairs])
    return df.select(*map(quoted, keys), F.inline(cells))


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "measure", value: str = "value") -> DataFrame:
    return df.unpivot([*map(quoted, keys)], [quoted(c) for c in columns], name, value)


def matrix(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """One row a ``row``, one column for each of the listed values of ``column``."""
    return df.groupBy(quoted(row)).pivot(column, list(columns)).agg(F.first(quoted(value)))


def square(df: DataFrame) -> DataFrame:
    """A matrix whose file had an index column: without the first column if that makes it square."""
    return df.drop(df.columns[0]) if df.count() == len(df.columns) - 1 else df


def pad_array(values, size: int, filler: float = -1):
    """An array of exactly ``size`` items, and which are real."""
    n = F.least(F.size(values), F.lit(size))
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler), size)), 1, size), F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i <= n)
