"""Nested annotations: files with arrays of detections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import genus
from ..functions.scalars import class_id, quoted

ANNOTATION = "array<struct<class:string,start_time:double,end_time:double,low_freq:int,high_freq:int,class_prob:double,det_prob:double,individual:string,event:string>>"
DOCUMENT = f"id string, annotated boolean, duration double, issues boolean, time_exp double, class_name string, notes string, annotation {ANNOTATION}"


def filter_annotations(df: DataFrame, events: Sequence[str] | None = None, replace: Mapping[str, str] | None = None, to_genus: bool = False, drop_issues: bool = True) -> DataFrame:
    """Annotated files (without issues, if asked) with cleaned annotations: stripped class names, chosen events, classes
    renamed and cut to the genus. Files left without annotations stay."""
    out = df.where("annotated")
    if drop_issues:
        out = out.where("NOT coalesce(issues, false)")
    notes = F.col("annotation")
    if events is not None:
        notes = F.filter(notes, lambda a: a["event"].isin(*events))
    names = F.create_map(*[F.lit(x) for kv in (replace or {"": ""}).items() for x in kv])

    def clean(a: Column) -> Column:
        name = F.trim(a["class"])
        if replace:
            name = F.coalesce(F.try_element_at(names, name), name)
        return a.withField("class", genus(name) if to_genus else name)

    return out.withColumn("annotation", F.transform(notes, clean))


def explode_annotations(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("file"), "duration", F.posexplode("annotation").alias("place", "a")).select("file", "duration", "place", "a.*")


def with_class_ids(df: DataFrame, classes: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """class_id is the place in the list, -1 for others; ignored classes' rows go."""
    return df.where(~F.col("class").isin(*ignored) if ignored else F.lit(True)).withColumn("class_id", class_id(F.col("class"), list(classes)))


def parallel_arrays(df: DataFrame, group: str, columns: Sequence[str], order: str) -> DataFrame:
    """One row a file with parallel arrays, in order."""
    packed = F.array_sort(F.collect_list(F.struct(quoted(order), *[quoted(c) for c in columns if c != order])))
    rows = df.groupBy(quoted(group)).agg(packed.alias("__r"))
    return rows.select(quoted(group), *[F.col(f"__r.`{c}`").alias(f"{c}s") for c in columns])


def level_low_frequency(df: DataFrame, name: str) -> DataFrame:
    """One class's low_freq becomes its mean; high_freq its mean where it is below the mean low_freq. A mean high below
    the mean low raises."""
    means = df.where(F.col("class") == name).agg(F.avg("low_freq").alias("__low"), F.avg("high_freq").alias("__high"))
    means = means.withColumn("__low", F.when(F.col("__low") > F.col("__high"), F.raise_error(F.lit("mean low above mean high")).cast("double")).otherwise(F.col("__low")))
    mine = F.col("class") == name
    out = df.crossJoin(F.broadcast(means))  # one row
    out = out.withColumn("high_freq", F.when(mine & (F.col("high_freq") < F.col("__low")), F.col("__high")).otherwise(F.col("high_freq").cast("double")))
    return out.withColumn("low_freq", F.when(mine, F.col("__low")).otherwise(F.col("low_freq").cast("double"))).drop("__low", "__high")


def class_weights(df: DataFrame, name: str = "class") -> DataFrame:
    """(class, n, inverse_frequency): total / (classes * n)."""
    counts = df.groupBy(quoted(name)).agg(F.count("*").alias("n"))
    every = W.partitionBy()
    return counts.withColumn("inverse_frequency", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def genus_probabilities(df: DataFrame, keys: Sequence[str], name: str = "class", prob: str = "prob") -> DataFrame:
    """Class probabilities summed by genus."""
    return df.groupBy(*map(quoted, keys), genus(quoted(name)).alias("genus")).agg(F.sum(quoted(prob)).alias("prob"))


def overall_class(df: DataFrame, file: str, name: str, det: str, prob: str) -> DataFrame:
    """Detection-weighted class sums of a file, normalised to 1."""
    sums = df.groupBy(quoted(file), quoted(name)).agg(F.sum(quoted(det) * quoted(prob)).alias("weight"))
    return sums.withColumn("weight", F.try_divide("weight", F.sum("weight").over(W.partitionBy(quoted(file)))))


def unknown_classes(df: DataFrame, known: Sequence[str], name: str = "class") -> DataFrame:
    return df.agg(F.count(F.when(~quoted(name).isin(*known), 1)).alias("unknown"), F.count("*").alias("n"))


def merge_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Detections of a file's pieces together; pieces without any add nothing."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), chunks)


def combine_in_time(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two annotation groups in order of time; the second's individuals are numbered on from the first's."""
    top = first.agg((F.coalesce(F.max("individual"), F.lit(-1)) + 1).alias("__top"))
    moved = second.crossJoin(F.broadcast(top)).withColumn("individual", F.col("individual") + F.col("__top")).drop("__top")  # one row
    return first.unionByName(moved).orderBy("start_time")


def to_documents(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows of annotations as one document a file."""
    fields = ["class", "start_time", "end_time", "low_freq", "high_freq", "class_prob", "det_prob", "individual", "event"]
    one = F.struct(F.col("start_time"), F.struct(*[F.col(f"`{f}`") for f in fields]).alias("a"))
    return df.groupBy(quoted(file).alias("id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("annotation"))


def split_statistics(df: DataFrame, split: str, file: str, label: str) -> DataFrame:
    """(split, files, rows, labels) of each part of a data set."""
    return df.groupBy(quoted(split)).agg(F.count_distinct(quoted(file)).alias("files"), F.count("*").alias("rows"), F.count_distinct(quoted(label)).alias("labels"))
