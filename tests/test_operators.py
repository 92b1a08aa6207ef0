"""Known values of single operators."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmura.functions import distributions, names, scalars, times
from murmura.operators import cleaning, evaluation, ml, performance, ranges, relational, reshape, scaling, sequences, shaping, statistics, windows


def one(df):
    return df.first()[0]


def col(spark, expr):
    return one(spark.range(1).select(expr))


def test_time_from_name(spark):
    text = lambda s: names.time_from_name(F.lit(s))
    assert col(spark, text("a/b\\barn1_D20220205T192049m784-HiF.wav")) == datetime(2022, 2, 5, 19, 20, 49)
    with pytest.raises(Exception):
        spark.range(1).select(text("33")).collect()
    assert col(spark, names.time_from_name(F.lit("33"), strict=False)) is None


@pytest.mark.parametrize("name, expected", [("x7_m1-HiF.wav", "Unkn"), ("x-Myca-Myca.wav", "Myca"), ("x-Tabr-Tabr-Tabr.wav", "Tabr"), ("x-Tabr-Myca-Laci.wav", "Laci,Myca,Tabr"), ("barn1_m898.wav", "Unkn"), (None, "Unkn")])
def test_species(spark, name, expected):
    assert col(spark, names.species(F.lit(name).cast("string"))) == expected


def test_sun(spark):
    rise, fall = times.sunrise_sunset("day")
    got = spark.sql("SELECT DATE'2022-02-05' AS day").select(rise.alias("rise"), fall.alias("fall")).first()
    assert (got["rise"], got["fall"]) == (datetime(2022, 2, 5, 8, 9), datetime(2022, 2, 5, 18, 38))


def test_the_sun_is_computed_once_a_day(spark):
    names_of = spark.range(3).selectExpr("concat('barn1_D2022020', id + 1, 'T192049m784.wav') AS Filename")
    for df in (relational.daytime_only(names_of), relational.augment(names_of.selectExpr("1L AS file_id", "1.0 AS LowFreq", "1.0 AS HiFreq"), names_of.selectExpr("1L AS file_id", "Filename")).select("is_daytime")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        solar = [line for line in plan.split("\n") if "acos" in line.lower()]
        assert len(solar) == 1 and "Aggregate [__day" in solar[0]


def test_no_single_partition_over_rows(spark):
    """Running sums, numbers and deals over a whole table go through ranges."""
    df = spark.range(1000).selectExpr("id", "id % 7 AS v", "id % 2 = 0 AS y", "cast(id % 3 AS double) AS g", "cast(hash(id) AS double) AS s")
    y, score = F.col("y"), F.col("s")
    curve = evaluation.pr_curve(df, y, score)
    made = [curve, evaluation.roc_auc(df, y, score), statistics.cliffs_delta(df, "s", y), statistics.kolmogorov_smirnov(df, "s", y), relational.in_rounds(df, "id", 4), relational.in_groups_of(df, "id", 4), relational.with_row_numbers(df, ["v", "id"]), evaluation.detection_curve(df.selectExpr("s AS confidence", "cast(y AS int) AS true_positive"), 500)]
    for out in made:
        out.collect()
        for window in [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]:
            parts = window[window.index("windowspecdefinition(") :]
            assert "__range" in parts, window  # over ranges' totals, or within a range
    # a frequent first value is cut by the other columns
    got = relational.with_row_numbers(df, ["g", "id"]).orderBy("g", "id").collect()
    assert [r["row_num"] for r in got] == list(range(1000))


@pytest.mark.parametrize("n", [0, 1, 2, 101, 12_000, 30_011])
def test_quantiles_are_exact(spark, n):
    shares = [0.0, 0.0005, 0.25, 0.5, 0.9995, 1.0]
    df = spark.range(n).selectExpr("cast(hash(id) % 5000 AS double) + (id % 3) AS v", "nullif(id % 2, 1) AS g")
    df = df.withColumn("v", F.when(F.col("v") % 11 != 0, F.col("v")))
    for by in ([], ["g"]):
        got = {(r["g"] if by else None, r["share"]): r["value"] for r in ranges.quantiles(df, by, "v", shares).collect()}
        expected = {(r["g"] if by else None, s): p for r in df.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect() for s, p in zip(shares, r["p"] or [])}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(expected[k], rel=1e-12) for k in got)


def test_tails_and_tests(spark):
    """Published critical values and examples."""
    assert distributions.studentized_range_upper(3.877, 3, 10) == pytest.approx(0.05, abs=5e-4)
    assert distributions.studentized_range_upper(3.633, 4, 1e9) == pytest.approx(0.05, abs=5e-4)
    assert distributions.kolmogorov_upper(1.3581) == pytest.approx(0.05, abs=1e-4)
    assert distributions.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    men = spark.createDataFrame([(float(x),) for x in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)], "x double")
    found = statistics.shapiro(men, "x")
    assert found["w"] == pytest.approx(0.79, abs=0.005) and found["p"] == pytest.approx(0.0067, abs=0.0006)
    with pytest.raises(ValueError):
        statistics.shapiro(men.limit(2), "x")
    two = spark.createDataFrame([(float(x), True) for x in (1, 2, 3, 4, 5)] + [(float(x), False) for x in (4, 6, 7, 8, 9, 10)], "x double, g boolean")
    u = statistics.mann_whitney(two, "x", F.col("g"))
    # u = 1.5 of 15 on average; spread: 30 / 12 * (12 - 6 / 110)
    assert u["u"] == 1.5 and u["z"] == pytest.approx(13 / math.sqrt(2.5 * (12 - 6 / 110))) and u["p"] == pytest.approx(0.0173, abs=1e-3)
    k = statistics.kolmogorov_smirnov_p(two, "x", F.col("g"))
    assert k["d"] == pytest.approx(5 / 6) and k["p"] == pytest.approx(distributions.kolmogorov_upper(5 / 6 * math.sqrt(30 / 11)))
    pairs = statistics.tukey(two.withColumn("k", F.when(F.col("x") > 8, "c").when(F.col("g"), "a").otherwise("b")), "x", "k").orderBy("a", "b").collect()
    assert [(r["a"], r["b"]) for r in pairs] == [("a", "b"), ("a", "c"), ("b", "c")] and all(0 <= r["p_value"] <= 1 for r in pairs) and pairs[1]["p_value"] < pairs[2]["p_value"]
    t = statistics.pooled_t(two, "x", F.col("g"))
    assert t["df"] == 9 and t["p"] == pytest.approx(distributions.t_two_sided(t["t"], 9))


def test_search_back_from_json(spark):
    table = spark.createDataFrame([(5.0, 2, 0.5), (5.0, 3, 0.25)], "perplexity double, n_clusters int, silhouette double")
    search = ml.ClusterSearch(table, 5.0, 2, 0.5, table, {"note": "x"})
    assert ml.read_search(spark, search.to_json()).to_json() == search.to_json()


def test_samples_in_strata(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 30 = 1 THEN null ELSE 'b' END AS s")
    got = relational.stratified_sample(df, "s", 300, 5, ["id"])
    counts = {r["s"]: r["count"] for r in got.groupBy("s").count().collect()}
    assert sum(counts.values()) == 300 and 98 <= counts["a"] <= 102 and got.select("id").distinct().count() == 300
    folds = ml.folds(df.where("s IS NOT NULL"), "s", "id", 4).groupBy("s", "fold").count().collect()
    assert {r["count"] for r in folds if r["s"] == "a"} == {250} and len(folds) == 8


def test_daytime_and_augment(spark):
    df = spark.createDataFrame([(1, 20.0, 40.0), (2, 10.0, 30.0)], "file_id long, LowFreq double, HiFreq double")
    files = spark.createDataFrame([(1, "barn1_D20220205T140541m784-Myca.wav"), (2, "barn1_D20220205T192049m784-HiF.wav")], "file_id long, Filename string")
    got = {r["file_id"]: r for r in relational.augment(df, files).collect()}
    assert got[1]["is_daytime"] and not got[2]["is_daytime"]
    assert got[1]["species"] == "Myca" and got[2]["species"] == "Unkn" and got[1]["freq_mean"] == 30
    assert got[1]["sin_month"] == pytest.approx(math.sin(2 * math.pi * 2 / 12))
    with pytest.raises(Exception):
        relational.augment(df, files.where("file_id = 1")).collect()
    assert relational.daytime_only(files).count() == 1


@pytest.mark.parametrize("unit, stamp, expected", [("hour", "2024-01-01 01:00:00", (0.2588, 0.9659)), ("day", "2024-01-01 00:00:00", (0.2079, 0.9781)), ("month", "2024-01-01 00:00:00", (0.5, 0.8660)), ("year", "2021-01-01 00:00:00", (0.5878, 0.8090))])
def test_cycles(spark, unit, stamp, expected):
    sin, cos = times.cycle(F.lit(stamp).cast("timestamp"), unit)
    assert (round(col(spark, sin), 4), round(col(spark, cos), 4)) == pytest.approx(expected, abs=1e-4)


def test_timestamps(spark):
    assert col(spark, names.timestamp_in_name(F.lit("a_2024-01-02T03_04_05_b_2025-01-02T03_04_05.csv"))) == "2025-01-02T03_04_05"
    assert col(spark, names.timestamp_in_name(F.lit("none"))) is None
    assert col(spark, names.timestamp_of(F.lit("2024-01-02T03_04_05"))) == datetime(2024, 1, 2, 3, 4, 5)
    assert scalars.sibling_name("/x/r_2024-01-02T03_04_05.csv", {"parts": 3}, "pca", ".json") == "/x/pca_2024-01-02T03_04_05_3parts.json"


def test_statistics_table(spark):
    rows = [(85.536, -0.876543, 0.726407, 0.111705, 19), (87.84, -1.688229, 0.836711, 0.015158, 20), (87.84, -1.688229, 0.836711, 0.015158, 21), (151.056, -3.604043, 0.855096, -0.027919, 22)]
    df = spark.createDataFrame(rows, "PrecedingIntrvl double, LnExpB_StartAmp double, Amp2ndMean double, LnExpA_EndAmp double, TimeIndex long")
    stats = {r["measure"]: r for r in cleaning.profile(df, df.columns[:4], ["TimeIndex"]).collect()}
    ranks = pd.DataFrame(rows, columns=df.columns).var().rank(pct=True)
    assert all(stats[c]["vars_normed"] == pytest.approx(ranks[c]) for c in df.columns[:4])
    assert all(stats[c]["variance"] == pytest.approx(pd.DataFrame(rows, columns=df.columns)[c].var()) for c in df.columns[:4])
    assert stats["PrecedingIntrvl"]["mean"] == pytest.approx(103.068) and stats["PrecedingIntrvl"]["median"] == pytest.approx(87.84)
    table = cleaning.profile(df, df.columns[:4], ["TimeIndex"])
    assert cleaning.cull(df, table, 0.4).columns == ["PrecedingIntrvl", "LnExpB_StartAmp", "LnExpA_EndAmp", "TimeIndex"]
    assert cleaning.cull(df, table, 0.4, positional=True).columns == ["PrecedingIntrvl", "LnExpB_StartAmp", "Amp2ndMean", "TimeIndex"]
    with pytest.raises(ValueError):
        cleaning.cull(df, table, 2)
    assert cleaning.profile_wide(table, df.columns[:4]).count() == 7


def test_categories(spark):
    df = spark.createDataFrame([("low", "10 kHz cutoff", "4.0 sec"), ("high", "5 kHz", ".5 sec")], "Preemphasis string, Filter string, MaxSegLnght string")
    assert [tuple(r) for r in cleaning.numeric_categories(df).collect()] == [(0, 2, 4.0), (2, 0, 0.5)]
    with pytest.raises(Exception):
        cleaning.numeric_categories(spark.createDataFrame([("odd",)], "Filter string")).collect()


def test_projection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert shaping.project(df, exclude=["b"]).columns == ["a", "c"]
    with pytest.raises(ValueError):
        shaping.project(df, include=["a"], exclude=["b"])
    with pytest.raises(ValueError):
        shaping.project(df, include=["z"])
    assert shaping.by_variance(["AmpVariance", "x", "LdgToFcAmp"], drop_unknown=False) == ["LdgToFcAmp", "AmpVariance", "x"]
    assert shaping.between_columns(df, "a", "b").columns == ["a", "b"]


def test_zscore_constant_and_single(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, 4.0), (3, 4.0)], "g int, x double")
    got = sorted((r["g"], round(r["x"], 6)) for r in windows.zscore_within(df, ["g"], ["x"]).collect())
    assert got == [(1, -0.707107), (1, 0.707107), (2, 0.0), (3, 0.0), (3, 0.0)]


def test_registration(spark):
    df = spark.createDataFrame([(i, i % 60) for i in range(120)], "i int, s int")
    got = windows.cyclic_by_rows(df, F.col("s"), 15, 60, ["i"]).orderBy("i").collect()
    assert (got[15]["sin"], got[15]["cos"]) == (0.0, 1.0) and (got[74]["sin"], got[74]["cos"]) == (0.0, 1.0)
    with pytest.raises(Exception):
        windows.cyclic_by_rows(df, F.col("s"), 99, 60, ["i"]).collect()


def test_local_maxima_brute(spark):
    grid = np.random.default_rng(1).random((20, 25))
    df = spark.createDataFrame([(x, y, float(grid[x, y])) for x in range(20) for y in range(25)], "x int, y int, v double")
    for r in windows.local_maxima(df, "x", "y", "v", 9).collect():
        near = grid[max(0, r["x"] - 4) : r["x"] + 5, max(0, r["y"] - 4) : r["y"] + 5]
        assert r["v"] == (grid[r["x"], r["y"]] if near.max() == grid[r["x"], r["y"]] else 0)


def test_splits(spark):
    files = spark.createDataFrame([(i,) for i in range(7)], "file_id long")
    assert [r["split"] for r in sequences.assign_splits(files, 3).orderBy("file_id").collect()] == [0, 0, 1, 1, 2, 2, 3]
    assert {r["split"] for r in sequences.assign_splits(files, 100).collect()} == set(range(7))
    train, test = sequences.holdout(files, "file_id", 0.3, 1)
    assert (train.count(), test.count()) == (5, 2)
    with pytest.raises(ValueError):
        sequences.IndexSplit(10, 0.5, 0.5)


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, g int")
    assert relational.sample(df, 7, 1, ["id"]).count() == 7
    assert [r[0] for r in relational.sample(df.repartition(5), 7, 1, ["id"]).collect()] == [r[0] for r in relational.sample(df, 7, 1, ["id"]).collect()]
    assert relational.stratified_sample(df, "g", 8, 1, ["id"]).count() == 8
    with pytest.raises(ValueError):
        relational.sample(df, 31, 1, ["id"])
    with pytest.raises(ValueError):
        relational.allocate({0: 0}, 1)
    with pytest.raises(TypeError):
        relational.concat([df, df.select("g", "id")])


def test_long_format_keeps_duplicates(spark):
    df = spark.createDataFrame([(0, 10.0, 20.0)], "chirp_num int, LedgeDuration double, Quality double")
    got = sorted((r["Measure_Type"], r["Measure_Name"]) for r in reshape.long_format(df).collect())
    assert got == [("knee_ledges", "LedgeDuration"), ("knee_ledges", "LedgeDuration"), ("quality", "Quality")]


def test_correlation(spark):
    df = spark.createDataFrame([(10, 100, 1000, 0), (20, 200, 2000, 1), (30, 300, 3000, 1), (40, 400, 500, 0)], "a int, b int, c int, y int")
    got = {r["measure"]: r for r in statistics.correlate_with(df, "a").collect()}
    assert got["b"]["correlation"] == pytest.approx(1) and got["b"]["p_value"] is None
    binary = {r["measure"]: r for r in statistics.correlate_with(df, "y").collect()}
    assert binary["a"]["correlation"] == pytest.approx(0) and binary["a"]["p_value"] == pytest.approx(1)
    constant = statistics.correlate_with(df.withColumn("k", F.lit(1)), "a", ["k"]).first()
    assert constant["correlation"] is None
    assert distributions.t_two_sided(2.0, 10) == pytest.approx(0.073388, abs=1e-6)


def test_distances(spark):
    a, b = F.array(F.lit(20), F.lit(30), F.lit(40)), F.array(F.lit(10), F.lit(20), F.lit(30))
    assert col(spark, statistics.distance(a, b)) == pytest.approx(17.320508)
    assert col(spark, statistics.distance(a, a)) == 0
    with pytest.raises(ValueError):
        statistics.distance(a, b, "odd")


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, b double")
    scaler = scaling.fit_standard(df, ["a", "b"])
    there = scaling.standardise(df, scaler)
    assert [r["a"] for r in there.orderBy("id").collect()] == [-1.0, 1.0]
    assert sorted(map(tuple, scaling.unstandardise(there, scaler).collect())) == sorted(map(tuple, df.collect()))


def test_confusion_of_one_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "c")], "t string, p string")
    got = {(r["truth"], r["predicted"]): r["n"] for r in evaluation.confusion(df, "t", "p", ["a"]).collect()}
    assert got == {("a", "a"): 1, ("^a", "a"): 1, ("a", "^a"): 0, ("^a", "^a"): 1}


def test_report_perfect(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (0, 0)], "t int, p int")
    got = {r["label"]: r for r in evaluation.report(evaluation.confusion(df, "t", "p", [0, 1])).collect()}
    assert got["0"]["precision"] == 1 and got["0"]["recall"] == pytest.approx(2 / 3) and got["1"]["precision"] == 0.5
    assert got["0"]["accuracy"] == 0.75 and got["0"]["balanced_accuracy"] == pytest.approx(5 / 6)


def test_matching_against_loop(spark):
    rng = np.random.default_rng(2)
    truth = [(f, i, float(rng.integers(0, 400)) / 10, int(rng.integers(-1, 3))) for f in range(3) for i in range(12)]
    preds = [(f, i, float(rng.integers(0, 400)) / 10, float(rng.random()), rng.random(3).tolist()) for f in range(3) for i in range(25)]
    t = spark.createDataFrame(truth, "file int, id int, start_time double, class_id int")
    p = spark.createDataFrame(preds, "file int, id int, start_time double, det_prob double, class_probs array<double>")
    for mode, which in (("detection", None), ("per_class", 1), ("top_class", None)):
        conf = {(f, i): (d if mode == "detection" else c[1] if mode == "per_class" else max(c)) for f, i, _, d, c in preds}
        usable = [x for x in truth if mode != "per_class" or x[3] in (1, -1)]
        taken, expected = set(), {}
        for f, i, s, _, c in sorted(preds, key=lambda x: (-conf[x[0], x[1]], x[1])):
            near = min(((abs(x[2] - s), x[1], x[3]) for x in usable if x[0] == f), default=None)
            hit = near is not None and near[0] <= 1.05 and (f, near[1]) not in taken
            if hit:
                taken.add((f, near[1]))
                if near[2] == -1 and mode != "detection":
                    continue
            expected[f, i] = int(hit and (mode != "top_class" or near[2] == int(np.argmax(c))))
        got = {(r["file"], r["id"]): r["true_positive"] for r in evaluation.match_detections(t, p, 1.05, mode, which).collect()}
        assert got == expected


def test_assign_greedy(spark):
    box = "file int, id int, start_time double, end_time double, low_freq int, high_freq int"
    t = spark.createDataFrame([(0, 0, 0.0, 1.0, 0, 10, "a"), (0, 1, 0.1, 1.1, 0, 10, "b")], box + ", class string")
    p = spark.createDataFrame([(0, 0, 0.05, 1.05, 0, 10), (0, 1, 5.0, 6.0, 0, 10), (0, 2, 0.0, 1.0, 0, 10)], box)
    got = {r["id"]: r["class"] for r in evaluation.assign_to_truth(t, p, 0.3).collect()}
    assert got == {2: "a", 0: "b", 1: None}


def test_errors_names(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (1, 1.0, 1.0)], "model_id int, Bndwdth_truth double, Bndwdth_pred double")
    got = performance.errors(df, ["Bndwdth"]).first()
    assert got["rmse"] == pytest.approx(math.sqrt(2)) and (got["min_abs_diff"], got["max_abs_diff"]) == (0, 2)
    assert col(spark, performance.legacy_name(F.lit("Bndwdth_truth"))) == "Bndwd"


def test_components(spark, tmp_path):
    rows = [(10, 100, 1000, 1), (20, 200, 2000, 4), (30, 300, 3000, 2)]
    df = spark.createDataFrame(rows, "a int, b int, c int, i int")
    pca = ml.fit_components(df, ["a", "b", "c", "i"])
    assert pca.ratios[0] == pytest.approx(0.999997938, abs=1e-8)
    x = np.array(rows, float)
    got = np.array([list(r) for r in ml.transform_components(df, pca).collect()])
    assert np.allclose(got[:, :2] ** 2 if False else got, (x - x.mean(axis=0)) @ pca.weights.T)
    pca.save(spark, str(tmp_path / "pca"))
    again = ml.Components.load(spark, str(tmp_path / "pca"))
    assert np.allclose(again.weights, pca.weights) and np.allclose(again.eigenvalues, pca.eigenvalues)
    assert sum(s for _, s in ml.feature_powers(pca)) == pytest.approx(1)
    assert ml.needed_dimensions(pca, 90)[0] == 1


def test_clusters_and_classes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y), int(i % 2)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 1, (40, 2)), rng.normal(20, 1, (40, 2))])[rng.permutation(80)])]
    df = spark.createDataFrame(rows, "id int, x double, y double, odd int")
    made, _ = ml.cluster(df, ["x", "y"], 2)
    assert ml.silhouette(made, ["x", "y"], "id") > 0.8
    coded = df.withColumn("right", F.when(F.col("x") > 10, "r").otherwise("l"))
    out = ml.classify(coded, ["x", "y"], "right", "id", k=2)
    assert out["predictions"].count() == 80 and out["report"].where("label = 'r'").first()["f1_score"] > 0.95
    with pytest.raises(NotImplementedError):
        ml.classify(df.withColumn("c", F.col("id") % 3), ["x"], "c", "id")
    few = df.where("odd = 0 OR id < 10")
    assert {r[0]: r[1] for r in ml.smote(few, ["x", "y"], "odd", "id").groupBy("odd").count().collect()} == {0: 40, 1: 40}
    with pytest.raises(TypeError):
        ml.tsne(df, ["x", "y"], "id", 5)
    assert ml.tsne(df, ["x", "y"], "id", 5.0, rows=30, iterations=50).count() == 30


def test_smote_neighbours_are_the_class_s_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4500, 2))
    df = spark.createDataFrame([(i, float(a), float(b), 0) for i, (a, b) in enumerate(x)] + [(i, 0.0, 0.0, 1) for i in range(4500, 9500)], "id int, x double, y double, c int")
    made = np.array([(r["x"], r["y"]) for r in ml.smote(df, ["x", "y"], "c", "id").where("c = 0").collect()])
    old = set(map(tuple, x.tolist()))
    new = np.array([m for m in made.tolist() if tuple(m) not in old])
    assert len(made) == 5000 and len(new) == 500
    near = np.stack([np.argsort(((x - v) ** 2).sum(axis=1), kind="stable")[1:6] for v in x])
    ends = np.concatenate([x[:, None].repeat(5, 1).reshape(-1, 2), x[near].reshape(-1, 2)], axis=1)
    for v in new:  # on the line from a row to one of its five nearest of the whole class
        a, b = ends[:, :2], ends[:, 2:]
        t = ((v - a) * (b - a)).sum(axis=1) / ((b - a) ** 2).sum(axis=1)
        off = np.abs(a + t[:, None] * (b - a) - v).max(axis=1)
        assert ((off < 1e-9) & (t > -1e-9) & (t < 1 + 1e-9)).any()


def test_silhouette_is_over_all_rows(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(6000, 3)), rng.integers(0, 3, 6000)
    x[:, 0] += c
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, c))], "id int, x double, y double, z double, cluster int")
    sums = np.zeros((6000, 3))
    for i, v in enumerate(x):
        sums[i] = np.bincount(c, np.sqrt(((x - v) ** 2).sum(axis=1)), 3)
    size, at = np.bincount(c), np.arange(6000)
    a, other = sums[at, c] / (size[c] - 1), sums / size
    other[at, c] = np.inf
    b = other.min(axis=1)
    expected = ((b - a) / np.maximum(a, b)).mean()
    assert ml.silhouette(df, ["x", "y", "z"], "id") == pytest.approx(expected, abs=1e-9)
    assert ml.silhouette(df, ["x", "y", "z"], "id", block=1500) == pytest.approx(expected, abs=1e-9)


def test_learning_queries_use_whole_embeddings(spark, data):
    from murmura import catalogue

    table = spark.read.parquet(f"{data}/embeddings.parquet")
    size = len(table.first()["embedding"])
    assert catalogue.queries()["pca_needed_dims"](spark, data).count() == size
    assert catalogue.queries()["tsne"](spark, data).count() == min(1000, table.count())


def test_row_numbers_with_nulls_and_a_hot_value(spark):
    rows = [(None, 0), ("b", 1), ("a", 2)] + [("hot", i) for i in range(3, 400)] + [("z", 1000 - i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(7)
    got = [(r["k"], r["i"]) for r in relational.with_row_numbers(df, ["k", "i"]).orderBy("row_num").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert relational.with_row_numbers(df.where("false"), ["k", "i"]).count() == 0
