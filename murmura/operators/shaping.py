"""Choosing and arranging columns and rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.names import is_species
from ..functions.scalars import quoted
from ..schema import RANKED

Condition = Column | Callable[[DataFrame], Column]


def condition(df: DataFrame, cond: Condition) -> Column:
    """A condition, or one made from the whole frame by a function."""
    return cond(df) if callable(cond) and not isinstance(cond, Column) else cond


def project(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """Keep or drop named columns, in the frame's order; both given, or a name that isn't there, is a ValueError."""
    if include is not None and exclude is not None:
        raise ValueError("either include or exclude")
    missing = set(include or exclude or ()) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    keep = [c for c in df.columns if (include is None or c in include) and c not in (exclude or ())]
    return df.select(*map(quoted, keep))


def by_variance(measures: Sequence[str], drop_unknown: bool = True) -> list[str]:
    """Names in the fixed ranking's order; unknown ones are dropped, or follow in the order given."""
    known = [m for m in RANKED if m in measures]
    return known if drop_unknown else known + [m for m in measures if m not in RANKED]


def top_measures(df: DataFrame, ranks: int, keep: Sequence[str] = ()) -> DataFrame:
    """The first ``ranks`` measures of the ranking, then the kept columns that aren't among them, in the order given."""
    missing = set(keep) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    chosen = by_variance(df.columns)[:ranks]
    return df.select(*map(quoted, chosen + [k for k in keep if k not in chosen]))


def column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.select(quoted(name))


def numeric(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(f.name) for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


def between_columns(df: DataFrame, first: str, last: str) -> DataFrame:
    """The columns from one name to another, both included."""
    a, b = df.columns.index(first), df.columns.index(last)
    return df.select(*map(quoted, df.columns[a : b + 1]))


def to_front(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*map(quoted, [*names, *(c for c in df.columns if c not in names)]))


def beside(left: DataFrame, right: DataFrame, on: str = "row_num") -> DataFrame:
    """Glue two frames by an explicit row number."""
    return left.join(right, on)


def fill(df: DataFrame, value: float = 0) -> DataFrame:
    return df.fillna(value)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_empty(df: DataFrame, but: Sequence[str] = ("TimeIndex",)) -> DataFrame:
    """Drop rows that are null in every column but the named ones."""
    return df.na.drop("all", subset=[c for c in df.columns if c not in but])


def of_species(df: DataFrame, tag: str, name: str = "Filename") -> DataFrame:
    return df.where(is_species(quoted(name), tag))


def longer_than(df: DataFrame, minimum: int, group: Sequence[str]) -> DataFrame:
    """Rows of groups of more than ``minimum`` rows; a null key is no group.

    The sizes are aggregated before they are joined back, so a huge group is never one task's."""
    keyed = df.where(" AND ".join(f"`{g}` IS NOT NULL" for g in group))
    sizes = keyed.groupBy(*map(quoted, group)).count().where(F.col("count") > minimum).drop("count")
    return keyed.join(sizes, list(group), "left_semi")


def first_rows(df: DataFrame, n: int, order: Sequence[str] = ("row_num",)) -> DataFrame:
    return df.orderBy(*map(quoted, order)).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int | Column) -> DataFrame:
    """The first n rows of each group in an order that has no ties."""
    rank = F.row_number().over(W.partitionBy(*map(quoted, group)).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def detections_per_second(df: DataFrame, duration: str, score: str, x: str, file: str = "file", rate: int = 200) -> DataFrame:
    """Of each file the int(duration * rate) best scored detections, ties to the smaller x."""
    return top_per_group(df, [file], [quoted(score).desc(), quoted(x).asc()], F.floor(quoted(duration) * rate).cast("int"))


def inside_borders(df: DataFrame, start: str, duration: str, margin: float) -> DataFrame:
    """Detections that start at least ``margin`` from both ends of their file (both limits included)."""
    return df.where(quoted(start).between(F.lit(margin), quoted(duration) - margin))


def thin_labels(df: DataFrame, label: str, order: str, wanted: int) -> DataFrame:
    """Labels of an axis with all but about ``wanted`` blank: of n labels every (n // wanted)-th stays, the first doesn't."""
    from .ranges import number

    step = max(1, df.count() // wanted)
    at = F.col("__at")
    return number(df, [order], "__at").withColumn(label, F.when((at >= step) & (at % step == 0), quoted(label)).otherwise("")).drop("__at")
