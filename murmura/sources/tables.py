"""Tables by their file type."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import timestamp_in_name
from ..operators.relational import _small
from ..functions.scalars import none_for_nan, quoted
from .feather import register

Types = Mapping[str | int, str | T.DataType | Callable]


def file_type(path: str) -> str:
    for suffix, kind in ((".csv", "csv"), (".csv.gz", "csv"), (".feather", "feather"), (".parquet", "parquet")):
        if path.endswith(suffix):
            return kind
    raise TypeError(f"neither .csv, .csv.gz, .feather nor .parquet: {path}")


def cast_columns(df: DataFrame, types: Types, strict: bool = True) -> DataFrame:
    """Cast columns by name or place; an unknown one is a ValueError. A type may be a function of a text (a Python UDF, for
    what no expression can say). Not strict: what can't be cast is null."""
    made = {}
    for key, kind in types.items():
        if isinstance(key, int):
            if not 0 <= key < len(df.columns):
                raise ValueError(f"no column number {key}")
            key = df.columns[key]
        if key not in df.columns:
            raise ValueError(f"no column {key}")
        if callable(kind) and not isinstance(kind, (str, T.DataType)):
            made[key] = F.udf(kind, "string")(quoted(key).cast("string"))
        else:
            made[key] = quoted(key).cast(kind) if strict else quoted(key).try_cast(kind)
    return df.withColumns(made) if made else df


def read_table(spark: SparkSession, path: str, types: Types | None = None, rows: int | None = None, schema: str | None = None) -> DataFrame:
    """A .csv, .csv.gz, .feather or .parquet file (or folder of them); NaN is null. Columns of csv files are inferred unless
    a schema is given; types cast some of them."""
    kind = file_type(path)
    if kind == "csv":
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    elif kind == "feather":
        register(spark)
        df = spark.read.format("feather").load(path)
    else:
        df = spark.read.parquet(path)
    df = cast_columns(none_for_nan(df), types or {})
    return df if rows is None else df.limit(rows)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """By suffix, as a folder of that name. No index column is added. mode: 'errorifexists' or 'overwrite'."""
    kind = file_type(path)
    if kind == "csv":
        writer = df.write.mode(mode).option("header", True)
        (writer.option("compression", "gzip") if path.endswith(".gz") else writer).csv(path)
    elif kind == "feather":
        register(df.sparkSession)
        df.write.format("feather").mode("append" if mode == "errorifexists" else mode).save(path)
    else:
        df.write.mode(mode).parquet(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as texts."""
    return spark.read.text(path, wholetext=True)


def iterate(df: DataFrame) -> Iterator[list]:
    """The header, then the rows as lists, fetched a partition at a time (for looking, not for work)."""
    yield df.columns
    for row in df.toLocalIterator():
        yield list(row)


def read_exports(spark: SparkSession, folder: str, pattern: str = "*Parameters_*.txt", where: Column | None = None, schema: str | None = None) -> DataFrame:
    """All tab separated exports below a folder as one scan; trailing blanks in column names go."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("sep", "\t").option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(folder)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df if where is None else df.where(where)


def read_annotations(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """Annotation documents, a list in one file or a file each, with ``file_path``."""
    from ..operators.nested import DOCUMENT

    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file_path", F.concat(F.lit(folder), F.col("id")))


def read_detector_table(spark: SparkSession, folder: str) -> DataFrame:
    """A third-party detector's .ta tables (tab separated, a file a recording): times in s, frequencies in Hz, and all
    columns from the sixth on as one feature array."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.ta").option("sep", "\t").option("header", True).option("inferSchema", True).csv(folder)
    c = df.columns
    features = F.array(*[quoted(x).cast("double") for x in c[6:]])
    milli = lambda name: F.round(quoted(name) / 1000.0, 5)
    return df.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.ta$", ".wav").alias("file"), milli("StTime").alias("start_time"), F.round((quoted("StTime") + quoted("Dur")) / 1000.0, 5).alias("end_time"), (quoted("Fmin") * 1000).cast("int").alias("low_freq"), (quoted("Fmax") * 1000).cast("int").alias("high_freq"), features.alias("features"))


def batch_report(df: DataFrame, species: DataFrame, file: str, accepted: str, best: str, probability: str, use_best: bool = False) -> DataFrame:
    """(file, class, class_prob) of a batch report: the accepted call, or (where that is 'x' and it is asked for) the best
    guess, named by the species table (code, class); 'x' has probability 0."""
    code = F.when((quoted(accepted) == "x") & F.lit(use_best), quoted(best)).otherwise(quoted(accepted))
    prob = F.when(quoted(probability).cast("string") == "x", 0.0).otherwise(quoted(probability).cast("string").try_cast("double"))
    rows = df.select(quoted(file).alias("file"), code.alias("code"), prob.alias("class_prob"))
    return rows.join(_small(species), "code", "left").drop("code")


def measures_to_annotations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of measures as detections: ms to s, kHz to Hz, end = start + duration."""
    start = F.round(quoted("TimeInFile") / 1000.0, 5)
    return df.select(quoted("Filename").alias("file"), start.alias("start_time"), F.round(quoted("TimeInFile") / 1000.0 + quoted("CallDuration") / 1000.0, 5).alias("end_time"), (quoted("LowFreq") * 1000).cast("int").alias("low_freq"), (quoted("HiFreq") * 1000).cast("int").alias("high_freq"), F.round(quoted("Quality"), 3).alias("det_prob"), F.array(*[quoted(c).cast("double") for c in features]).alias("features"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.[wW][aA][vV]") -> DataFrame:
    """(path, modificationTime, length) of files below a folder; no contents are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def numbered_paths(folder: str, prefix: str, numbers: Sequence[int], suffix: str, digits: int | None = None) -> list[str]:
    return [f"{folder.rstrip('/')}/{prefix}{str(n).zfill(digits) if digits else n}{suffix}" for n in numbers]


def files_by_timestamp(listing: DataFrame, timestamp: str | None = None, prefix: str = "", suffix: str = "", latest: bool = False) -> DataFrame:
    """(path, stamp) of a listing's files with a timestamp in their names (that one, if given); the latest one or all."""
    name = F.element_at(F.split("path", "/"), -1)
    out = listing.select("path", timestamp_in_name(name).alias("stamp")).where(F.col("stamp").isNotNull() & F.startswith(name, F.lit(prefix)) & F.endswith(name, F.lit(suffix)))
    if timestamp is not None:
        out = out.where(F.col("stamp") == timestamp)
    return out.orderBy(F.desc("stamp"), "path").limit(1) if latest else out


def read_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prediction files of all models as one table."""
    from ..operators.performance import clean_predictions
    from ..operators.relational import concat

    return clean_predictions(concat([read_table(spark, p) for p in paths], strict=False))


def log_medians(spark: SparkSession, folder: str, prefix: str = "Median loss:") -> DataFrame:
    """(id, value) of lines with a prefix in logs named by a number, in its order."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder).withColumn("path", F.input_file_name())
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d+)", 1).try_cast("bigint")
    value = F.regexp_extract("value", f"^{prefix}\\s*([-+.0-9eE]+)", 1)
    return lines.where(value != "").select(number.alias("id"), value.cast("double").alias("value")).orderBy("id", "value")


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Whole recordings by split, a folder each."""
    df.repartition("split").write.mode(mode).partitionBy("split").parquet(path)


def write_detections(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Detections as csv (without nested columns) and as json documents by file."""
    from ..operators.nested import to_documents

    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    df.select(*map(quoted, flat)).write.mode(mode).option("header", True).csv(f"{path}/detections")
    to_documents(df).write.mode(mode).json(f"{path}/documents")
