"""Small column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of export categories.
PREEMPHASIS = {"low": 0, "medium": 1, "high": 2}
FILTERS = {"5 kHz": 0, "30 kHz anti-katydid": 1, "10 kHz cutoff": 2, "20 kHz anti-katydid": 3, "25 kHz ant-katydid": 4, "15 kHz cutoff": 5}


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def none_for_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing value: null in all float columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(quoted(c), F.lit(None).cast("double")) for c in floats}) if floats else df


def encode(value: Column, codes: dict[str, int], strict: bool = True) -> Column:
    """A category's code; an unknown one raises (null stays null), or is null."""
    known = reduce(lambda w, kv: w.when(value == kv[0], kv[1]), list(codes.items())[1:], F.when(value == next(iter(codes)), codes[next(iter(codes))]))
    if not strict:
        return known
    return F.when(value.isNotNull() & ~value.isin(*codes), F.raise_error(F.concat(F.lit("unknown category "), value)).cast("int")).otherwise(known)


def seconds_number(value: Column, strict: bool = True) -> Column:
    """The number in '0.5 sec'; anything else raises, or is null."""
    digits = F.regexp_extract(value, r"^([.\d]*) sec$", 1)
    number = F.nullif(digits, F.lit("")).try_cast("double")
    if not strict:
        return number
    return F.when(value.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("not a number of seconds: "), value)).cast("double")).otherwise(number)


def class_id(value: Column, classes: list[str]) -> Column:
    """Place in the list, -1 for others."""
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), value) - 1).cast("int")


def numeric_if_possible(value: Column) -> Column:
    """(long, double, string) struct with the first that fits."""
    whole = value.try_cast("bigint")
    return F.struct(whole.alias("whole"), F.when(whole.isNull(), value.try_cast("double")).alias("real"), F.when(value.try_cast("double").isNull(), value).alias("text"))


def parse_list(value: Column, kind: str = "array<int>") -> Column:
    """A list literal in a text; a trailing comma is tolerated, anything else malformed is null."""
    return F.from_json(F.regexp_replace(value, r",\s*\]", "]"), kind)


def f1(precision: Column, recall: Column) -> Column:
    """2pr / (p + r); null where that is 0 / 0."""
    return F.try_divide(2 * precision * recall, precision + recall)


def x_to_time(x: Column, rate: float, window: float, overlap: float) -> Column:
    """Seconds of a spectrogram column."""
    nfft = int(window * rate)
    step = nfft - int(overlap * nfft)
    return (x * step + int(overlap * nfft)) / float(rate)


def time_to_x(t: Column, rate: float, window: float, overlap: float) -> Column:
    nfft = int(window * rate)
    over = int(overlap * nfft)
    return F.floor((t * rate - over) / (nfft - over)).cast("int")


def bin_to_frequency(bin_no: Column, low: float, high: float, bins: int) -> Column:
    """Frequency of a spectrogram row, row 0 being the top, to 2 decimals."""
    step = (high - low) / float(bins)
    return F.round((bins - bin_no) * step + low, 2)


def detection_format(start: Column, end: Column, low: Column, high: Column, det: Column, class_probs: Column, classes: list[str]) -> list[Column]:
    """Rounded columns of a detection, with the class of the highest probability (first of equals)."""
    top = F.array_max(class_probs)
    label = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(class_probs, top).cast("int"))
    return [F.round(start, 4).alias("start_time"), F.round(end, 4).alias("end_time"), low.cast("int").alias("low_freq"), high.cast("int").alias("high_freq"), F.round(det, 3).alias("det_prob"), F.round(top, 3).alias("class_prob"), label.alias("class")]


def sibling_name(path: str, parts: dict[str, object] | None = None, prefix: str = "", suffix: str = "") -> str:
    """A file name beside ``path`` that carries its timestamp and ``_<quantity><name>`` parts."""
    import re
    from pathlib import PurePath

    found = re.findall(r"\d{4}-\d{2}-\d{2}T\d{2}_\d{2}_\d{2}", PurePath(path).name)
    extra = "".join(f"_{value}{name}" for name, value in (parts or {}).items())
    return str(PurePath(path).parent / f"{prefix}{'_' + found[-1] if found else ''}{extra}{suffix}")
