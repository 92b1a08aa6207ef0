"""Running numbers and exact quantiles over a whole table without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import quoted


#: Rows of a range, on average, and how many ranges there are at most.
RANGE_ROWS, RANGES = 200_000, 1024


def _dealt(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``__range``: numbers in the order of the columns, all of which count, so that a frequent value of the first
    is many ranges. Cut by values drawn from the table (the distinct ones whose hashes are lowest, so the same however often
    the plan is run)."""
    spark = df.sparkSession
    ranges = ranges or min(RANGES, max(8, -(-df.count() // RANGE_ROWS)))
    value = F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(order)])
    drawn = df.select(value.alias("v")).distinct().select("v.*").orderBy(F.xxhash64(*[f"o{i}" for i in range(len(order))]), *[f"o{i}" for i in range(len(order))]).limit(ranges - 1)
    rows = drawn.collect()
    cuts = spark.createDataFrame(rows, drawn.schema).agg(F.sort_array(F.collect_list(F.struct(*drawn.columns))).alias("__cuts"))  # one row
    return df.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda b: b <= value))).drop("__cuts")


def number(df: DataFrame, order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """Dense numbers from 0 in an order without ties (nulls first): each range is numbered by itself, from the size of those
    before it."""
    dealt = _dealt(df, order, ranges)
    sizes = dealt.groupBy("__range").count()  # a row a range
    before = sizes.select("__range", (F.sum("count").over(W.orderBy("__range")) - F.col("count")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*map(quoted, order)))
    out = dealt.withColumn("__n", inside).join(F.broadcast(before), "__range")
    return out.withColumn(name, (F.col("__n") + F.col("__before") - 1).cast("long")).drop("__range", "__n", "__before")


def number_within(df: DataFrame, by: str, order: Sequence[str], name: str) -> DataFrame:
    """Dense numbers from 0 within each value of ``by``, in an order without ties; no value is one task's."""
    every = number(df, [by, *order], "__g")
    first = every.groupBy(quoted(by).alias("__by")).agg(F.min("__g").alias("__first"))
    return every.join(first, quoted(by).eqNullSafe(F.col("__by"))).withColumn(name, F.col("__g") - F.col("__first")).drop("__by", "__g", "__first")


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` (a row a value of ``order``) with each column of ``sums`` (new name: column) summed up to and with its row."""
    dealt = _dealt(df, [order])
    totals = dealt.groupBy("__range").agg(*[F.sum(quoted(c)).alias(f"__t{i}") for i, c in enumerate(sums.values())])  # a row a range
    down = F.desc if descending else F.asc
    so_far = W.orderBy(down("__range")).rowsBetween(W.unboundedPreceding, 0)
    before = totals.select("__range", *[(F.sum(f"__t{i}").over(so_far) - F.col(f"__t{i}")).alias(f"__b{i}") for i in range(len(sums))])
    inside = W.partitionBy("__range").orderBy(quoted(order).desc() if descending else quoted(order).asc()).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), "__range")
    return out.withColumns({n: F.sum(quoted(c)).over(inside) + F.col(f"__b{i}") for i, (n, c) in enumerate(sums.items())}).drop("__range", *[f"__b{i}" for i in range(len(sums))])


#: Values around a quantile that are looked at: about six in so many; all of fewer.
ACCURACY = 10_000


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(by, share, value): exact quantiles by linear interpolation, as ``percentile`` gives them; nulls don't count.

    An approximate quantile with a known error encloses each exact one between two values; only the distinct values between
    them, about six in ``accuracy``, are put in order, counted from those below. Two passes over ``df``; the first
    leaves a row a group."""
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.struct(F.coalesce(quoted(c).cast("string"), F.lit("")).alias("s"), quoted(c).isNull().alias("n")).alias(k) for c, k in zip(by, keys)], *[quoted(c).alias(f"__c{i}") for i, c in enumerate(by)], quoted(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    edge = 3.0 / accuracy
    ends = lambda s: F.struct(F.lit(float(s)).alias("share"), F.percentile_approx("__v", max(0.0, s - edge), accuracy).alias("low"), F.percentile_approx("__v", min(1.0, s + edge), accuracy).alias("high"))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), *[F.first(f"__c{i}").alias(f"__c{i}") for i in range(len(by))], F.array(*[ends(s) for s in shares]).alias("e"))
    place = F.col("e.share") * (F.col("n") - 1)
    groups = groups.select(*keys, *[f"__c{i}" for i in range(len(by))], "n", "least", "most", F.explode("e").alias("e"))
    # at a very small share, and of few values, the enclosing ones are the ends themselves
    few = F.col("n") <= accuracy
    low = F.when(few | (F.col("e.share") <= edge), F.col("least")).otherwise(F.col("e.low"))
    high = F.when(few | (F.col("e.share") >= 1 - edge), F.col("most")).otherwise(F.col("e.high"))
    groups = groups.select(*keys, *[F.col(f"__c{i}").alias(c) for i, c in enumerate(by)], F.col("e.share").alias("share"), place.alias("place"), low.alias("low"), high.alias("high"))
    asked = groups.groupBy(*keys).agg(F.collect_list(F.struct("share", "low", "high")).alias("asked"))
    held = rows.select(*keys, "__v").join(asked, keys) if keys else rows.select("__v").crossJoin(F.broadcast(asked))  # one row
    # below the low end a row counts, within it is kept
    held = held.select(*keys, F.inline(F.transform("asked", lambda a: F.struct(a["share"].alias("share"), F.when(F.col("__v") >= a["low"], F.col("__v")).alias("v"), (F.col("__v") <= a["high"]).alias("__in"))))).where("__in")
    counts = held.groupBy(*keys, "share", "v").agg(F.count("*").alias("c"))  # v is null for those below
    upto = F.sum("c").over(W.partitionBy(*keys, "share").orderBy(F.col("v").asc_nulls_first()))
    counts = counts.withColumn("upto", upto).where("v IS NOT NULL")
    found = counts.join(groups.select(*keys, "share", "place"), [*keys, "share"])
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("v")))
    both = found.groupBy(*keys, "share").agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"), F.first("place").alias("place"))
    part = F.col("place") - F.floor("place")
    exact = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    named = groups.select(*keys, *map(quoted, by), "share")
    return named.join(both.select(*keys, "share", exact.alias("value")), [*keys, "share"]).select(*map(quoted, by), "share", "value")
