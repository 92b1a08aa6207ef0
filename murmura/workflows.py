"""Whole workflows, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalars import quoted
from .operators import cleaning, evaluation, ml, performance, relational, reshape, scaling, sequences, shaping, windows


@dataclass
class Prepared:
    """What sequence preparation yields: scaled rows with file_id, chirp_idx and split; small tables beside them."""

    rows: DataFrame
    configuration: DataFrame
    files: DataFrame
    mapping: DataFrame
    scaler: DataFrame


def prepare(exports: DataFrame, measures: Sequence[str], minimum: int, splits: int, file: str = "Filename", order: Sequence[str] = ("TimeInFile",), where: Column | None = None) -> Prepared:
    """Raw exports to model-ready splits: filter, length limit (strict), ids, indexes, scaling (keys left alone), whole
    recordings to splits. The order must have no ties within a recording."""
    rows = exports if where is None else exports.where(where)
    config = sequences.configuration(rows, file, minimum)
    rows = shaping.longer_than(rows.select(quoted(file), *map(quoted, dict.fromkeys([*order, *measures]))), minimum, [file])
    ids = sequences.file_ids(rows, file)
    rows = sequences.with_index(rows.join(ids, file), file, order)
    counts = sequences.sample_counts(rows, "file_id", minimum)
    files = sequences.assign_splits(counts, splits).join(ids, "file_id")
    scaler = scaling.fit_standard(rows, measures)
    scaled = scaling.standardise(rows, scaler).join(files.select("file_id", "split"), "file_id")
    return Prepared(scaled.withColumn("cntxt_sz", F.col("chirp_idx")), config, files, sequences.split_totals(files), scaler)


def clean_export(df: DataFrame, threshold: float | None = None, exclude: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, statistics): one index, numeric categories, no administrative columns, no empty rows; columns of low
    variance culled if a threshold is given."""
    rows = cleaning.drop_administrative(cleaning.numeric_categories(cleaning.normalise_index(df)), exclude)
    rows = shaping.drop_empty(rows)
    measures = [c for c in shaping.numeric(rows).columns if c != "TimeIndex"]
    stats = cleaning.profile(rows, measures, ["TimeIndex"] if "TimeIndex" in rows.columns else [])
    return (rows if threshold is None else cleaning.cull(rows, stats, threshold)), stats


def impute_and_reduce(df: DataFrame, features: Sequence[str], components: int | None = None, index: str = "TimeIndex") -> DataFrame:
    """Missing values as 0, then (if asked) principal components beside the index."""
    rows = shaping.fill(df)
    if components is None:
        return rows
    return ml.transform_components(rows, ml.fit_components(rows, features, components), [index])


def zscores_long(df: DataFrame, group: str, measures: Sequence[str], keys: Sequence[str], minimum: int = 1) -> DataFrame:
    """Measures standardised within their recording, by family, in long form."""
    rows = shaping.longer_than(df, minimum, [group]).select(*map(quoted, dict.fromkeys([group, *keys, *measures])))
    return reshape.long_format(windows.zscore_within(rows, [group], measures), keys=[group, *keys])


def prediction_errors(truth: DataFrame, predictions: DataFrame, measures: Sequence[str], scaler: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(errors by model and measure, their means) over all models at once; with a scaler in original units."""
    t = truth.select("file_id", "cntxt_sz", *map(quoted, measures))
    p = performance.clean_predictions(predictions)
    if scaler is not None:
        t, p = scaling.unstandardise(t, scaler), scaling.unstandardise(p, scaler)
    found = performance.errors(relational.truth_with_predictions(t, p, ["file_id", "cntxt_sz"], measures, ["model_id"]), measures)
    return found, performance.means(found)


def evaluate_detections(truth: DataFrame, predictions: DataFrame, durations: DataFrame, classes: int, tolerance: float = 0.01, margin: float = 0.01) -> DataFrame:
    """(mode, class_id, positives, average_precision, recall_at_95): 'detection', each class, and 'top_class', over
    detections and truths that start inside their file's borders. Classes without a truth have null scores."""
    inside = lambda df: shaping.inside_borders(df.join(durations, "file"), "start_time", "duration", margin).drop("duration")
    t, p = inside(truth), inside(predictions)
    runs = [("detection", None, t)] + [("per_class", k, t.where(F.col("class_id") == k)) for k in range(classes)] + [("top_class", None, t.where("class_id > -1"))]
    out = None
    for mode, k, positive in runs:  # a few modes, not rows
        n = positive.count()
        curve = evaluation.detection_curve(evaluation.match_detections(t, p, tolerance, mode, k), n)
        row = evaluation.interpolated_precision(curve).crossJoin(evaluation.recall_at(curve).toDF("recall_at_95"))
        keep = lambda c: F.when(F.lit(n) > 0, F.round(c, 5)).alias(c)  # noqa: B023, E731
        row = row.select(F.lit(mode).alias("mode"), F.lit(k).cast("int").alias("class_id"), F.lit(n).cast("long").alias("positives"), keep("average_precision"), keep("recall_at_95"))
        out = row if out is None else out.unionByName(row)
    return out
