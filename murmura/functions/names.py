"""What recordings' file names say: time, species, timestamps of result files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The recorder's clock: this far behind UTC all year.
UTC_OFFSET_HOURS = 7
STAMP = r"(\d{4}-\d{2}-\d{2}T\d{2}_\d{2}_\d{2})"


def base_name(path: Column) -> Column:
    """The last part of a path with slashes or back-slashes."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def time_from_name(path: Column, strict: bool = True) -> Column:
    """Local time (no zone) of a recording from ``<site>_<x>YYYYMMDDThhmmssm<ms>``; no match raises, or is null."""
    name = base_name(path)
    pattern = r"^[^_]*_.(\d{8})T(\d{6})m\d{3}"
    digits = F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
    parsed = F.to_timestamp_ntz(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))
    if not strict:
        return parsed
    return F.when(digits == "", F.raise_error(F.concat(F.lit("no recording time in "), F.coalesce(path, F.lit("null")))).cast("timestamp_ntz")).otherwise(parsed)


def to_utc(local: Column) -> Column:
    return local + F.make_dt_interval(hours=F.lit(UTC_OFFSET_HOURS))


def species_list(name: Column) -> Column:
    """Tags between the first '-' and '.wav'; an empty list without any."""
    tags = F.regexp_extract(name, r"[^-]*-([^.]*)\.wav", 1)
    return F.when(tags == "", F.array().cast("array<string>")).otherwise(F.split(tags, "-"))


def species(name: Column) -> Column:
    """Distinct tags in order, joined by ','; a name without tags, or whose only tag is no species, is 'Unkn'."""
    joined = F.array_join(F.array_sort(F.array_distinct(species_list(name))), ",")
    return F.when(name.isNull() | joined.isin("", "LoF", "HiF", "HiLo"), "Unkn").otherwise(joined)


def is_species(name: Column, tag: str) -> Column:
    return F.contains(name, F.lit(f"-{tag}-")) | F.endswith(name, F.lit(f"-{tag}.wav"))


def species_code(name: Column) -> Column:
    """The four letters before '.wav'."""
    return F.nullif(F.regexp_extract(name, r"([A-Za-z]{4})\.wav$", 1), F.lit(""))


def genus(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def short_class(name: Column) -> Column:
    """The first three letters of each word."""
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 3)), " ")


def file_timestamp(t: Column) -> Column:
    """ISO time without fraction, with '_' for ':', as it stands in file names."""
    return F.date_format(t, "yyyy-MM-dd'T'HH_mm_ss")


def timestamp_in_name(name: Column) -> Column:
    """The last such time in a name; null without any."""
    return F.nullif(F.regexp_extract(name, f"^.*{STAMP}", 1), F.lit(""))


def timestamp_of(stamp: Column) -> Column:
    return F.to_timestamp(F.regexp_replace(stamp, "_", ":"), "yyyy-MM-dd'T'HH:mm:ss")


def first_integer(text: Column) -> Column:
    """The first integer in a text, such as a model's id; null without any."""
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).cast("bigint")


def is_duplicate_copy(name: Column) -> Column:
    """Copies that file managers number: 'x[2].wav'."""
    return name.rlike(r"\[\d+\]\.wav$")
