"""Compositions, on small made recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura import workflows
from murmura.operators import evaluation, results


@pytest.fixture(scope="module")
def exports(spark):
    rng = np.random.default_rng(1)
    rows = [(f"f{n:02d}.wav", float(i * 100 + 7), float(rng.normal(40, 5)), float(rng.normal(20, 3))) for n in range(9) for i in range(n + 1)]
    return spark.createDataFrame(rows, "Filename string, TimeInFile double, HiFreq double, LowFreq double")


def test_prepare(spark, exports):
    got = workflows.prepare(exports, ["TimeInFile", "HiFreq", "LowFreq"], 3, 2)
    assert {r["parameter"]: r["value"] for r in got.configuration.collect()} == {"max_length": 9, "min_length": 3, "num_files": 9}
    files = got.files.orderBy("file_id").collect()
    assert [r["Filename"] for r in files] == [f"f{n:02d}.wav" for n in range(3, 9)] and [r["file_id"] for r in files] == list(range(6))
    assert [r["n_samples"] for r in files] == [2, 3, 4, 5, 6, 7] and files[-1]["cum_samples"] == 27
    assert [r["split"] for r in files] == [0, 0, 0, 1, 1, 1]
    assert {r["split"]: r["n_samples"] for r in got.mapping.collect()} == {0: 9, 1: 18}
    flat = got.rows.agg(F.avg("HiFreq"), F.stddev_pop("HiFreq"), F.count("*")).first()
    assert flat[0] == pytest.approx(0, abs=1e-9) and flat[1] == pytest.approx(1) and flat[2] == sum(range(4, 10))


def test_prediction_errors(spark):
    truth = spark.createDataFrame([(1, 3, 10.0), (1, 4, 20.0), (2, 3, 30.0)], "file_id long, cntxt_sz long, HiFreq double")
    predictions = spark.createDataFrame([(1.0, 3.0, "21", 11.0, 0), (1.0, 4.0, "21", 17.0, 0), (1.0, 3.0, "22", 10.0, 0), (9.0, 9.0, "22", 0.0, 0)], "file_id double, cntxt_sz double, model_id string, HiFreq double, TimeIndex int")
    found, means = workflows.prediction_errors(truth, predictions, ["HiFreq"])
    got = {r["model_id"]: r["rmse"] for r in found.collect()}
    assert got["21"] == pytest.approx(5**0.5) and got["22"] == 0 and means.first()["max_abs_diff"] == 1.5


def test_clean(spark):
    df = spark.createDataFrame([("a", "low", 1.0, 5.0, 0, 19), ("b", "high", 2.0, 5.0, 1, 20), ("c", None, None, None, None, 21)], "Filename string, Preemphasis string, x double, y double, z int, TimeIndex long")
    rows, stats = workflows.clean_export(df, 0.5, ["Filename"])
    assert "Preemphasis" in rows.columns and "y" not in rows.columns and rows.count() == 2
    assert workflows.impute_and_reduce(df.drop("Filename", "Preemphasis"), ["x", "y", "z"], 2).columns == ["TimeIndex", "comp0", "comp1"]


def test_detections(spark):
    truth = spark.createDataFrame([("f", i, float(i), i % 2) for i in range(1, 9)], "file string, id int, start_time double, class_id int")
    found = spark.createDataFrame([("f", i, i + 0.001, 0.9 - i / 100, [0.8, 0.1] if i % 2 == 0 else [0.1, 0.8]) for i in range(1, 9)] + [("f", 99, 9.9999, 0.99, [0.5, 0.5])], "file string, id int, start_time double, det_prob double, class_probs array<double>")
    got = workflows.evaluate_detections(truth, found, spark.createDataFrame([("f", 10.0)], "file string, duration double"), 3).collect()
    assert [(r["mode"], r["class_id"], r["positives"], r["average_precision"]) for r in got] == [("detection", None, 8, 1.0), ("per_class", 0, 4, 1.0), ("per_class", 1, 4, 1.0), ("per_class", 2, 0, None), ("top_class", None, 8, 1.0)]


def test_results(spark, tmp_path):
    matrix = evaluation.confusion(spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t int, p int"), "t", "p", [0, 1])
    report = evaluation.report(matrix)
    text = results.report_to_json(report, matrix, {"1": "Day"})
    back = results.report_from_json(spark, text)
    assert back["notes"] == {1: "Day"} and results.report_to_json(back["report"]) == results.report_to_json(report)
    table = results.report_table(report, {0: "Night", 1: "Day"})
    assert table[1][0] == "Night" and results.as_csv(table).startswith("label,precision") and results.as_markdown(table).splitlines()[1] == "|-|-|-|-|-|"
    errors = spark.createDataFrame([("21", "x", 1.0), ("22", "x", 2.0)], "model_id string, measure string, rmse double")
    results.save_performance(errors, str(tmp_path / "p"))
    assert results.load_performance(spark, str(tmp_path / "p"), [22]).count() == 1
