"""Results as files: JSON records, presentation tables, one table for all models."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = ("precision", "recall", "f1_score", "support")


def numeric(text):
    """An int, else a float, else the text."""
    for kind in (int, float):
        try:
            return kind(text)
        except (TypeError, ValueError):
            continue
    return text


def report_to_json(report: DataFrame, matrix: DataFrame | None = None, notes: Mapping | None = None) -> str:
    """A classification report (a row a label) and its confusion matrix as one JSON text."""
    out = {"report": [r.asDict() for r in report.orderBy("label").collect()], "notes": dict(notes or {})}
    if matrix is not None:
        out["confusion"] = [r.asDict() for r in matrix.orderBy("truth", "predicted").collect()]
    return json.dumps(out, sort_keys=True)


def report_from_json(spark: SparkSession, text: str) -> dict:
    """{'report', 'confusion' (or None), 'notes'} of such a text; keys of notes that look like numbers are numbers."""
    data = json.loads(text)
    fields = [*SCORES, "accuracy", "balanced_accuracy"]
    rows = [(r["label"], *(r.get(c) for c in fields)) for r in data["report"]]
    report = spark.createDataFrame(rows, "label string, " + ", ".join(f"{c} double" for c in fields))
    matrix = data.get("confusion")
    if matrix is not None:
        cells = [(str(r["truth"]), str(r["predicted"]), float(r["n"])) for r in matrix]
        matrix = spark.createDataFrame(cells, "truth string, predicted string, n double")
    return {"report": report, "confusion": matrix, "notes": {numeric(k): v for k, v in data["notes"].items()}}


def report_table(report: DataFrame, names: Mapping | None = None, filler: str = "na") -> list[list[str]]:
    """Rows of texts for people: a label a row, then accuracy and balanced accuracy with fillers."""
    rows = sorted(report.collect(), key=lambda r: (" avg" in r["label"], r["label"]))  # a row a label
    named = lambda x: str((names or {}).get(numeric(x), x))
    table = [["label", *SCORES]]
    table += [[named(r["label"]), *(f"{r[c]:.6f}" if r[c] is not None else filler for c in SCORES[:3]), str(round(r["support"]))] for r in rows]
    if rows:
        table += [[c, filler, filler, f"{rows[0][c]:.6f}", filler] for c in ("accuracy", "balanced_accuracy")]
    return table


def as_csv(table: list[list[str]]) -> str:
    return "\n".join(",".join(r) for r in table) + "\n"


def as_markdown(table: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(table[0]), "|" + "-|" * len(table[0]), *map(line, table[1:])]) + "\n"


def save_performance(found: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Errors of all models, a folder a model."""
    found.write.mode(mode).partitionBy("model_id").parquet(path)


def load_performance(spark: SparkSession, path: str, models: list | None = None) -> DataFrame:
    """The models that are there, or some of them (only their folders are read)."""
    df = spark.read.parquet(path)
    return df if models is None else df.where(F.col("model_id").isin(models))
