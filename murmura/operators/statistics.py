"""Correlation, distances, moments, two-sample tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.distributions import f_upper, kolmogorov_upper, normal_quantile, normal_upper, studentized_range_upper, t_two_sided
from ..functions.scalars import quoted
from .ranges import quantiles, running


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r over the pairs that are complete; null where one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlate_with(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(measure, correlation, p_value) of every column with the target, in one pass.

    A target of two values counts as 0 (the smaller) and 1; the correlation is then point-biserial and has a p-value."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c != target] if columns is None else columns
    values = [r[0] for r in df.select(quoted(target)).where(quoted(target).isNotNull()).distinct().orderBy(quoted(target)).limit(3).collect()]
    two = len(values) == 2
    y = F.when(quoted(target) == F.lit(values[1]), 1.0).when(quoted(target).isNotNull(), 0.0) if two else quoted(target)
    found = df.agg(*[e for i, c in enumerate(columns) for e in (pearson(quoted(c), y).alias(f"r{i}"), F.count(F.when(quoted(c).isNotNull() & y.isNotNull(), 1)).alias(f"n{i}"))]).first()
    rows = []
    for i, c in enumerate(columns):
        r, n, p = found[f"r{i}"], found[f"n{i}"], None
        if two and r is not None and n > 2:
            p = 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        rows.append((c, r, p))
    return spark.createDataFrame(rows, "measure string, correlation double, p_value double")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, correlation) for all pairs, in one pass."""
    pairs = [*combinations(columns, 2)]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(quoted(a), quoted(b)).alias("correlation")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def _fold(a: Column, b: Column, cell) -> Column:
    return F.aggregate(F.zip_with(a, b, cell), F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


METRICS = {
    "euclidean": lambda a, b: F.sqrt(_fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))),
    "manhattan": lambda a, b: _fold(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
    "cosine": lambda a, b: 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))),
}


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays of the same length; cosine is null for a zero vector."""
    if metric not in METRICS:
        raise ValueError(f"metrics are {sorted(METRICS)}")
    return METRICS[metric](a, b)


def distances(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """Row by row distances of two frames that share keys."""
    pack = lambda df, name: df.select(*map(quoted, on), F.array(*[quoted(c).cast("double") for c in columns]).alias(name))
    return pack(left, "__a").join(pack(right, "__b"), list(on)).select(*map(quoted, on), distance(F.col("__a"), F.col("__b"), metric).alias("distance"))


def similarities_within(df: DataFrame, group: Sequence[str], key: str, columns: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """Distances of all pairs of rows of one (short) recording."""
    packed = df.select(*map(quoted, group), quoted(key).alias("__k"), F.array(*[quoted(c).cast("double") for c in columns]).alias("__v"))
    other = packed.withColumnsRenamed({"__k": "__l", "__v": "__w"})
    return packed.join(other, list(group)).where("__k < __l").select(*map(quoted, group), F.col("__k").alias(f"{key}_a"), F.col("__l").alias(f"{key}_b"), distance(F.col("__v"), F.col("__w"), metric).alias("distance"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, median, std, var, min, quartiles, max, skew and excess kurtosis (population) of a column."""
    c, names = quoted(column), {0.25: "q1", 0.5: "median", 0.75: "q3"}
    found = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.var_samp(c).alias("var"), F.min(c).alias("min"), F.max(c).alias("max"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"))
    quarters = quantiles(df, [], column, [*names]).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in names.items()])
    return found.crossJoin(F.broadcast(quarters)).select("n", "mean", "median", "std", "var", "min", "q1", "q3", "max", "skew", "kurtosis")  # one row each


def _moments(df: DataFrame, column: str, first: Column) -> list:
    c = quoted(column)
    parts = [F.when(first, c), F.when(~first, c)]
    r = df.agg(*[f(p).alias(f"{n}{i}") for i, p in enumerate(parts) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).first()
    return [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for i in (0, 1)]


def welch(df: DataFrame, column: str, first: Column) -> dict[str, float | None]:
    """Welch's t, degrees of freedom, two-sided p, and Cohen's d (over the mean of both variances)."""
    (n1, m1, v1), (n2, m2, v2) = _moments(df, column, first)
    if n1 < 2 or n2 < 2 or not v1 + v2:
        return {"t": None, "df": None, "p": None, "cohens_d": None}
    a, b = v1 / n1, v2 / n2
    t, free = (m1 - m2) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return {"t": t, "df": free, "p": t_two_sided(t, free), "cohens_d": (m1 - m2) / math.sqrt((v1 + v2) / 2)}


def pooled_t(df: DataFrame, column: str, first: Column) -> dict[str, float | None]:
    """Student's t with one variance for both samples: t, degrees of freedom, two-sided p."""
    (n1, m1, v1), (n2, m2, v2) = _moments(df, column, first)
    if n1 + n2 < 3 or not n1 or not n2:
        return {"t": None, "df": None, "p": None}
    free = n1 + n2 - 2
    pooled = ((n1 - 1) * (v1 or 0.0) + (n2 - 1) * (v2 or 0.0)) / free
    if not pooled:
        return {"t": None, "df": free, "p": None}
    t = (m1 - m2) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    return {"t": t, "df": free, "p": t_two_sided(t, free)}


def tukey(df: DataFrame, column: str, group: str) -> DataFrame:
    """(a, b, difference, q, p_value) of all pairs of groups' means (a before b): Tukey's honest significant difference, for
    unequal sizes by Kramer. One aggregation; a row a group reaches the driver."""
    kind = dict(df.dtypes)[group]
    rows = sorted((r[0], r["n"], r["m"], r["v"] or 0.0) for r in df.where(quoted(group).isNotNull()).groupBy(quoted(group)).agg(F.count(quoted(column)).alias("n"), F.avg(quoted(column)).alias("m"), F.var_samp(quoted(column)).alias("v")).where("n > 0").collect())
    free = sum(n for _, n, _, _ in rows) - len(rows)
    within = sum((n - 1) * v for _, n, _, v in rows) / free if free > 0 else 0.0
    out = []
    for (a, n1, m1, _), (b, n2, m2, _) in combinations(rows, 2):
        q = abs(m2 - m1) / math.sqrt(within / 2 * (1 / n1 + 1 / n2)) if within else None
        out.append((a, b, m2 - m1, q, None if q is None else studentized_range_upper(q, len(rows), free)))
    return df.sparkSession.createDataFrame(out, f"a {kind}, b {kind}, difference double, q double, p_value double")


def mann_whitney(df: DataFrame, column: str, first: Column) -> dict[str, float | None]:
    """U of the first sample and its two-sided p by the normal approximation, with corrections for ties and continuity."""
    u = cliffs_delta(df, column, first).first()
    ties = _values(df, column, first).agg(F.sum((F.col("a") + F.col("b")).cast("double") ** 3 - (F.col("a") + F.col("b"))).alias("t")).first()["t"]
    n1, n2 = u["n1"] or 0, u["n2"] or 0
    n = n1 + n2
    if not n1 or not n2:
        return {"u": None, "z": None, "p": None}
    spread = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if spread <= 0:
        return {"u": float(u["u"]), "z": 0.0, "p": 1.0}
    z = max(0.0, abs(float(u["u"]) - n1 * n2 / 2) - 0.5) / math.sqrt(spread)
    return {"u": float(u["u"]), "z": z, "p": min(1.0, 2 * normal_upper(z))}


def kolmogorov_smirnov_p(df: DataFrame, column: str, first: Column) -> dict[str, float | None]:
    """The two-sample statistic d and its p by the limiting distribution."""
    d = kolmogorov_smirnov(df, column, first).first()["d"]
    sizes = _values(df, column, first).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if d is None:
        return {"d": None, "p": None}
    return {"d": float(d), "p": kolmogorov_upper(float(d) * math.sqrt(sizes["a"] * sizes["b"] / (sizes["a"] + sizes["b"])))}


#: The Shapiro-Wilk test is defined for at most so many values.
SHAPIRO_VALUES = 5000


def shapiro(df: DataFrame, column: str) -> dict[str, float]:
    """Shapiro-Wilk's W and p by Royston's published approximation, over 3 to SHAPIRO_VALUES values (more are a ValueError, as
    for the test itself: take a sample)."""
    values = [r[0] for r in df.where(quoted(column).isNotNull()).select(quoted(column).cast("double")).limit(SHAPIRO_VALUES + 1).collect()]
    n = len(values)
    if not 3 <= n <= SHAPIRO_VALUES:
        raise ValueError(f"3 to {SHAPIRO_VALUES} values")
    x = sorted(values)
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    if not spread:
        return {"w": 1.0, "p": 1.0}
    m = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    square, u = sum(v * v for v in m), 1 / math.sqrt(n)
    poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
    # fixed values: the approximation's coefficients
    last = poly((m[-1] / math.sqrt(square), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
    if n == 3:
        weights = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    elif n <= 5:
        rest = math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        weights = [-last, *(v / rest for v in m[1:-1]), last]
    else:
        second = poly((m[-2] / math.sqrt(square), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
        rest = math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        weights = [-last, -second, *(v / rest for v in m[2:-2]), second, last]
    w = min(1.0, sum(a * v for a, v in zip(weights, x)) ** 2 / spread)
    if n == 3:
        return {"w": w, "p": min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))}
    if w == 1:
        return {"w": w, "p": 1.0}
    if n <= 11:
        gamma = poly((-2.273, 0.459), n)
        if math.log(1 - w) >= gamma:
            return {"w": w, "p": 0.0}
        y, mu, sigma = -math.log(gamma - math.log(1 - w)), poly((0.5440, -0.39978, 0.025054, -0.0006714), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        k = math.log(n)
        y, mu, sigma = math.log(1 - w), poly((-1.5861, -0.31082, -0.083751, 0.0038915), k), math.exp(poly((-0.4803, -0.082676, 0.0030302), k))
    return {"w": w, "p": normal_upper((y - mu) / sigma)}


def _values(df: DataFrame, column: str, first: Column) -> DataFrame:
    """(v, a, b): distinct values with their counts in both samples."""
    rows = df.where(quoted(column).isNotNull() & first.isNotNull())
    return rows.groupBy(quoted(column).alias("v")).agg(F.count(F.when(first, 1)).alias("a"), F.count(F.when(~first, 1)).alias("b"))


def cliffs_delta(df: DataFrame, column: str, first: Column) -> DataFrame:
    """(n1, n2, u, delta): Mann-Whitney's U and (wins - losses) / (n1 n2), from average ranks of distinct values."""
    placed = running(_values(df, column, first), "v", {"upto": "b"})
    u = placed.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * (F.col("upto") - F.col("b") / 2)).alias("u"))
    return u.select("n1", "n2", "u", (2 * F.try_divide(F.col("u"), F.col("n1") * F.col("n2")) - 1).alias("delta"))


def kolmogorov_smirnov(df: DataFrame, column: str, first: Column) -> DataFrame:
    """(d): the greatest difference of the two samples' distribution functions."""
    values = _values(df, column, first)
    ends = values.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))  # one row
    placed = running(values, "v", {"ua": "a", "ub": "b"}).crossJoin(F.broadcast(ends))
    return placed.select(F.abs(F.try_divide("ua", "na") - F.try_divide("ub", "nb")).alias("gap")).agg(F.max("gap").alias("d"))


def anova(df: DataFrame, column: str, group: str) -> dict[str, float | None]:
    """One-way analysis of variance: F and p."""
    parts = df.groupBy(quoted(group)).agg(F.count(quoted(column)).alias("n"), F.avg(quoted(column)).alias("m"), F.var_pop(quoted(column)).alias("v")).where("n > 0")
    r = parts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w")).first()
    if r["k"] < 2 or r["n"] <= r["k"] or not r["w"]:
        return {"f": None, "p": None}
    f = ((r["q"] - r["s"] ** 2 / r["n"]) / (r["k"] - 1)) / (r["w"] / (r["n"] - r["k"]))
    return {"f": f, "p": f_upper(f, r["k"] - 1, r["n"] - r["k"])}


def max_cell(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(row, column, value) of the greatest cell; the first in row-major order of equals."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    long = df.select(quoted(row).alias("row"), F.inline(cells)).where("value IS NOT NULL")
    return long.orderBy(F.desc("value"), "row", "i").limit(1).select("row", "column", "value")


def day_night(df: DataFrame, file: str, is_day: str) -> DataFrame:
    """(is_daytime, files, calls, mean, min and max length) by day and night, and in total (is_daytime null): recordings
    are counted first, then rolled up."""
    sizes = df.groupBy(quoted(file), quoted(is_day).alias("is_daytime")).agg(F.count("*").alias("n"))
    return sizes.rollup("is_daytime").agg(F.count("*").alias("files"), F.sum("n").alias("calls"), F.avg("n").alias("mean_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"))


def minute_histogram(df: DataFrame, time: str) -> DataFrame:
    """(minute 'HH:MM', n)."""
    return df.groupBy(F.date_format(quoted(time), "HH:mm").alias("minute")).agg(F.count("*").alias("n"))


def weekly_counts(df: DataFrame, day: str, label: str, labels: Sequence) -> DataFrame:
    """(week, a column for each label): counts in 7-day bins from the first day on, 0 where there are none."""
    first = df.agg(F.min(quoted(day)).alias("__first"))
    binned = df.crossJoin(F.broadcast(first)).withColumn("week", F.date_add("__first", (F.floor(F.datediff(quoted(day), F.col("__first")) / 7) * 7).cast("int")))  # one row
    return binned.groupBy("week").pivot(label, list(labels)).agg(F.count(F.lit(1))).fillna(0)


def row_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    total = sum((quoted(c) for c in columns[1:]), quoted(columns[0]))
    return df.withColumns({c: F.try_divide(quoted(c).cast("double"), total) for c in columns})
