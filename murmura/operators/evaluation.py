"""Classifiers and detectors held against the truth."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import f1, quoted
from .ranges import running


def _labels(spark: SparkSession, labels: Sequence) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(labels)], f"place int, label {'string' if isinstance(labels[0], str) else 'long'}")


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence, normalise: str | None = None) -> DataFrame:
    """(truth, predicted, n) for all pairs of the listed labels; a single label stands against '^' + itself.

    normalise: 'true' (rows), 'pred' (columns) or 'all'; null where there is nothing to divide by."""
    spark = df.sparkSession
    t, p = quoted(truth), quoted(predicted)
    if len(labels) == 1:
        one = labels[0]
        labels = [one, f"^{one}"]
        t, p = (F.when(c == one, one).otherwise(labels[1]) for c in (t, p))
    kind = "string" if isinstance(labels[0], str) else "long"
    counts = df.groupBy(t.cast(kind).alias("truth"), p.cast(kind).alias("predicted")).agg(F.count("*").alias("n"))
    one = _labels(spark, labels).select(F.col("label").alias("truth"))
    grid = one.crossJoin(_labels(spark, labels).select(F.col("label").alias("predicted")))  # labels by labels
    full = grid.join(counts, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if normalise is None:
        return full
    over = {"true": W.partitionBy("truth"), "pred": W.partitionBy("predicted"), "all": W.partitionBy()}[normalise]
    return full.withColumn("n", F.try_divide(F.col("n").cast("double"), F.sum("n").over(over)))


def confusion_with_background(df: DataFrame, truth: str, predicted: str, labels: Sequence[str], background: str = "background", normalise: str | None = None) -> DataFrame:
    """Of a detector: null truths (detections of nothing) are the background row, null predictions (what was missed) its
    column."""
    named = df.withColumn("__t", F.coalesce(quoted(truth), F.lit(background))).withColumn("__p", F.coalesce(quoted(predicted), F.lit(background)))
    return confusion(named, "__t", "__p", [*labels, background], normalise)


def row_normalise(matrix: DataFrame, row: str, value: str) -> DataFrame:
    """Cells as shares of their row; null in empty rows."""
    return matrix.withColumn(value, F.try_divide(quoted(value).cast("double"), F.sum(quoted(value)).over(W.partitionBy(quoted(row)))))


def report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1_score, support, accuracy, balanced_accuracy) from counts (truth, predicted, n): a row a
    label, then 'macro avg' and 'weighted avg'. What can't be divided is 0, as is usual in reports."""
    m = matrix.select(F.col("truth").cast("string").alias("truth"), F.col("predicted").cast("string").alias("predicted"), F.col("n").cast("double").alias("n"))
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0.0))
    rows = m.groupBy(F.col("truth").alias("label")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    cols = m.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("named"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = rows.join(cols, "label").select("label", zero(F.try_divide("tp", "named")).alias("precision"), zero(F.try_divide("tp", "support")).alias("recall"), "support", "tp")
    each = each.withColumn("f1_score", zero(f1(F.col("precision"), F.col("recall"))))
    scores = ("precision", "recall", "f1_score")
    weighted = lambda c: zero(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")))
    totals = each.agg(zero(F.try_divide(F.sum("tp"), F.sum("support"))).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.sum("support").alias("support"), *[F.avg(c).alias(f"m_{c}") for c in scores], *[weighted(c).alias(f"w_{c}") for c in scores])
    average = lambda name, k: totals.select(F.lit(name).alias("label"), *[F.col(f"{k}_{c}").alias(c) for c in scores], "support")
    every = each.select("label", *scores, "support").unionByName(average("macro avg", "m")).unionByName(average("weighted avg", "w"))
    return every.crossJoin(F.broadcast(totals.select("accuracy", "balanced_accuracy")))  # one row


def mean_report(reports: DataFrame) -> DataFrame:
    """Reports of several folds (with a ``fold`` column) as one of means."""
    return reports.groupBy("label").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1_score", "support", "accuracy", "balanced_accuracy")])


def pr_curve(df: DataFrame, truth: Column, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tp, fp, precision, recall, f1) at each distinct score, from the highest down. Scores are counted first,
    so that what is summed in order has a row a score."""
    counts = df.select(*map(quoted, by), score.alias("threshold"), truth.cast("int").alias("y")).where("threshold IS NOT NULL AND y IS NOT NULL").groupBy(*map(quoted, by), "threshold").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    if by:
        down = W.partitionBy(*map(quoted, by)).orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
        placed = counts.withColumns({"tp": F.sum("p").over(down), "every": F.sum("n").over(down), "positives": F.sum("p").over(W.partitionBy(*map(quoted, by)))})
    else:
        ends = counts.agg(F.sum("p").alias("positives"))  # one row
        placed = running(counts, "threshold", {"tp": "p", "every": "n"}, descending=True).crossJoin(F.broadcast(ends))
    out = placed.select(*map(quoted, by), "threshold", "tp", (F.col("every") - F.col("tp")).alias("fp"), "positives")
    out = out.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("positives")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).drop("positives")


def average_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, average_precision): sum of recall steps times precision."""
    down = W.partitionBy(*map(quoted, by)).orderBy(F.desc("threshold"))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0))
    return curve.withColumn("__s", step * F.col("precision")).groupBy(*map(quoted, by)).agg(F.sum("__s").alias("average_precision"))


def interpolated_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, average_precision) with each precision raised to the greatest at any higher recall."""
    w = W.partitionBy(*map(quoted, by)).orderBy(F.desc("threshold"))
    envelope = F.max("precision").over(w.rowsBetween(0, W.unboundedFollowing))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))
    return curve.withColumn("__s", step * envelope).groupBy(*map(quoted, by)).agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias("average_precision"))


def recall_at(curve: DataFrame, precision: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(by, recall): at the last point, going down the scores, whose precision is greater; 0 if there is none."""
    return curve.groupBy(*map(quoted, by)).agg(F.coalesce(F.min_by("recall", F.when(F.col("precision") > precision, F.col("threshold"))), F.lit(0.0)).alias("recall"))


def best_point(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The point of the greatest f1; of equals that with the lowest threshold."""
    key = F.struct(F.col("f1"), -F.col("threshold"))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.when(F.col("f1").isNotNull(), key))
    return curve.groupBy(*map(quoted, by)).agg(best.alias("b")).select(*map(quoted, by), "b.*")


def mean_average_precision(each: DataFrame) -> DataFrame:
    return each.agg(F.avg("average_precision").alias("mean_average_precision"), F.count("average_precision").alias("classes"))


def positional_mean(curve: DataFrame, fold: str) -> DataFrame:
    """Folds' curves averaged point by point, from the lowest threshold up, as far as the shortest goes."""
    placed = curve.withColumn("place", F.row_number().over(W.partitionBy(quoted(fold)).orderBy("threshold")))
    folds = placed.groupBy(quoted(fold)).count().agg(F.min("count").alias("__least"))
    return placed.crossJoin(F.broadcast(folds)).where("place <= __least").groupBy("place").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def roc_auc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """(auc) by average ranks."""
    counts = df.select(score.alias("v"), truth.cast("int").alias("y")).where("v IS NOT NULL AND y IS NOT NULL").groupBy("v").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    placed = running(counts, "v", {"upto": "n"})
    wins = placed.withColumn("w", F.col("p") * (F.col("upto") - F.col("n") / 2))
    return wins.agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("n")).alias("auc"))


def majority(df: DataFrame, group: str, label: str) -> DataFrame:
    """Each group's commonest label; of equals the first in order."""
    counts = df.groupBy(quoted(group), quoted(label)).agg(F.count("*").alias("n"))
    w = W.partitionBy(quoted(group)).orderBy(F.desc("n"), quoted(label))
    return counts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def hit_rates(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    """(label, hit_rate in % to 3 decimals, false_positive_rate) by label; one pass."""
    t, p = quoted(truth), quoted(predicted)
    cell = lambda x: F.struct(F.lit(x).alias("label"), F.round(100 * F.try_divide(F.count(F.when((t == x) & (p == x), 1)), F.count(F.when(t == x, 1))), 3).alias("hit_rate"), F.try_divide(F.count(F.when((t != x) & (p == x), 1)), F.count(F.when(t != x, 1))).alias("false_positive_rate"))
    return df.agg(F.array(*[cell(x) for x in labels]).alias("c")).select(F.inline("c"))


def binarise(truth: Column, classes: Sequence) -> list[Column]:
    return [F.when(truth == c, 1).otherwise(0).alias(f"is_{c}") for c in classes]


# --- detections --------------------------------------------------------------------------------------------------------


def box_iou(a: str, b: str, frequency_scale: float = 1e7) -> Column:
    """Intersection over union of two boxes, structs of start_time, end_time, low_freq and high_freq."""
    f = lambda s, n: F.col(f"{s}.{n}") / (frequency_scale if n.endswith("freq") else 1.0)
    wide = F.greatest(F.least(f(a, "end_time"), f(b, "end_time")) - F.greatest(f(a, "start_time"), f(b, "start_time")), F.lit(0.0))
    high = F.greatest(F.least(f(a, "high_freq"), f(b, "high_freq")) - F.greatest(f(a, "low_freq"), f(b, "low_freq")), F.lit(0.0))
    area = lambda s: F.abs((f(s, "end_time") - f(s, "start_time")) * (f(s, "high_freq") - f(s, "low_freq")))
    inter = wide * high
    return F.when(inter == 0, 0.0).otherwise(F.try_divide(inter, area(a) + area(b) - inter))


def overlapping(truth: DataFrame, predictions: DataFrame, file: str = "file", cell: float = 1.0) -> DataFrame:
    """(file, t, p, iou) of all overlapping boxes of a file. Boxes are dealt to time cells, so that a long file is many
    groups; a pair is taken in the first cell both are in."""
    deal = lambda df, n: df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(f"{n}.start_time") / cell), F.floor(F.greatest(F.col(f"{n}.end_time"), F.col(f"{n}.start_time")) / cell))))
    t = deal(truth.select(quoted(file), F.struct(*truth.columns).alias("t")), "t")
    p = deal(predictions.select(quoted(file), F.struct(*predictions.columns).alias("p")), "p")
    met = t.join(p, [file, "__cell"]).where(F.col("__cell") == F.floor(F.greatest(F.col("t.start_time"), F.col("p.start_time")) / cell))
    return met.withColumn("iou", box_iou("t", "p")).where("iou > 0").drop("__cell")


def assign_to_truth(truth: DataFrame, predictions: DataFrame, threshold: float, file: str = "file", key: str = "id") -> DataFrame:
    """Predictions with ``class`` from the truth they are assigned to: each truth, in order of its key, takes the free
    prediction of the greatest overlap (the first of equals) if that is above the threshold. Greedy within a file, over
    its overlapping pairs only."""
    pairs = overlapping(truth, predictions, file).select(quoted(file), F.col(f"t.{key}").alias("t"), F.col(f"p.{key}").alias("p"), F.col("t.class").alias("class"), "iou")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used = [], set()
        for _, rows in pdf.sort_values(["t", "iou", "p"], ascending=[True, False, True]).groupby("t", sort=True):
            free = rows[~rows["p"].isin(used)]
            if len(free) and free["iou"].iloc[0] > threshold:
                used.add(free["p"].iloc[0])
                out.append(free.iloc[0])
        return pd.DataFrame(out, columns=pdf.columns)[[file, "p", "class"]].rename(columns={"p": key, "class": "assigned"})

    kinds = dict(predictions.dtypes)
    assigned = pairs.groupBy(quoted(file)).applyInPandas(run, f"`{file}` {kinds[file]}, `{key}` {kinds[key]}, assigned string")
    out = predictions.join(assigned, [file, key], "left")
    return out.withColumn("class", F.coalesce("assigned", quoted("class"))).drop("assigned") if "class" in predictions.columns else out.withColumnRenamed("assigned", "class")


def nearest_truth(predictions: DataFrame, truth: DataFrame, tolerance: float, file: str = "file", key: str = "id") -> DataFrame:
    """(file, id, truth_id, gap): each prediction's nearest truth by start within the tolerance (included), of equals the
    one with the smaller key. Starts are dealt to cells as long as the tolerance; a prediction looks at three."""
    t = truth.select(quoted(file), quoted(key).alias("truth_id"), F.col("start_time").alias("__t"), F.floor(F.col("start_time") / tolerance).alias("__cell"))
    p = predictions.select(quoted(file), quoted(key), F.col("start_time").alias("__p")).withColumn("__c", F.floor(F.col("__p") / tolerance))
    p = p.withColumn("__cell", F.explode(F.array(F.col("__c") - 1, F.col("__c"), F.col("__c") + 1)))
    met = p.join(t, [file, "__cell"]).withColumn("gap", F.abs(F.col("__p") - F.col("__t"))).where(F.col("gap") <= tolerance)
    best = F.min(F.struct("gap", "truth_id")).alias("b")
    return met.groupBy(quoted(file), quoted(key)).agg(best).select(quoted(file), quoted(key), "b.truth_id", "b.gap")


def match_detections(truth: DataFrame, predictions: DataFrame, tolerance: float, mode: str = "detection", class_of_interest: int | None = None, file: str = "file", key: str = "id") -> DataFrame:
    """(file, id, confidence, true_positive) of the predictions that count.

    Each prediction is held against its nearest truth within the tolerance; of those that share a truth the most confident
    has it (ties to the smaller key), the others are false. That is what going through all predictions by falling
    confidence gives, as a prediction never falls back on another truth: so a window does, and no loop.
    Modes: 'detection'; 'per_class' (confidence of one class; truths of that class and generic ones, -1); 'top_class'
    (must name the truth's class). Outside 'detection' a prediction that takes a generic truth doesn't count.
    truth: file, id, start_time, class_id; predictions: file, id, start_time, det_prob, class_probs."""
    t, p = truth, predictions
    if mode == "detection":
        p = p.withColumn("confidence", F.col("det_prob"))
    elif mode == "per_class":
        p = p.withColumn("confidence", F.coalesce(F.get("class_probs", F.lit(class_of_interest)), F.lit(0.0)))
        t = t.where(F.col("class_id").isin(class_of_interest, -1))
    elif mode == "top_class":
        p = p.withColumn("confidence", F.array_max("class_probs")).withColumn("__top", F.array_position("class_probs", F.array_max("class_probs")) - 1)
    else:
        raise ValueError(f"no mode {mode}")
    near = nearest_truth(p, t, tolerance, file, key)
    classes = t.select(quoted(file), quoted(key).alias("truth_id"), "class_id")
    met = p.join(near, [file, key], "left").join(classes, [file, "truth_id"], "left")
    first = F.row_number().over(W.partitionBy(quoted(file), "truth_id").orderBy(F.desc("confidence"), quoted(key))) == 1
    met = met.withColumn("__has", F.col("truth_id").isNotNull() & first)
    right = F.col("__has") & ((F.col("class_id") == F.col("__top")) if mode == "top_class" else F.lit(True))
    ignored = F.col("__has") & (F.col("class_id") == -1) if mode != "detection" else F.lit(False)
    return met.where(~ignored).select(quoted(file), quoted(key), "confidence", right.cast("int").alias("true_positive"))


def detection_curve(matched: DataFrame, positives: int) -> DataFrame:
    """(threshold, tp, fp, precision, recall) by distinct confidence; ``positives`` truths were to be found."""
    counts = matched.groupBy(F.col("confidence").alias("threshold")).agg(F.sum("true_positive").alias("p"), F.count("*").alias("n"))
    placed = running(counts, "threshold", {"tp": "p", "every": "n"}, descending=True)
    out = placed.select("threshold", "tp", (F.col("every") - F.col("tp")).alias("fp"))
    return out.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.lit(positives)))


def threshold_places(curve: DataFrame, thresholds: Sequence[float] = tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """(cut, above): for each cut how many detections are above it."""
    total = [F.struct(F.lit(c).alias("cut"), F.coalesce(F.max(F.when(F.col("threshold") > c, F.col("tp") + F.col("fp"))), F.lit(0)).alias("above")) for c in thresholds]
    return curve.agg(F.array(*total).alias("c")).select(F.inline("c"))


def file_accuracy(truth: DataFrame, predictions: DataFrame, thresholds: int | None = None, file: str = "file") -> DataFrame:
    """Accuracy over files whose truth is of one known class: the class of the greatest mean probability; or, with
    ``thresholds``, of the greatest sum of probabilities above a cut, the best of so many cuts between the least and the
    greatest probability (the lowest of equals). (threshold, accuracy, files)."""
    known = truth.groupBy(quoted(file)).agg(F.collect_set("class_id").alias("c")).where(F.size("c") == 1).select(quoted(file), F.element_at("c", 1).alias("truth")).where("truth <> -1")
    long = predictions.select(quoted(file), F.posexplode("class_probs").alias("class_id", "prob"))
    if thresholds is None:
        scores = long.groupBy(quoted(file), "class_id").agg(F.avg("prob").alias("score")).withColumn("threshold", F.lit(None).cast("double"))
    else:
        ends = long.agg(F.min("prob").alias("__lo"), F.max("prob").alias("__hi"))
        cuts = ends.select(F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("__i"), "__lo", "__hi").select((F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / thresholds).alias("threshold"))
        scores = long.crossJoin(F.broadcast(cuts)).groupBy(quoted(file), "class_id", "threshold").agg(F.sum(F.when(F.col("prob") >= F.col("threshold"), F.col("prob")).otherwise(0.0)).alias("score"))  # ten cuts
    named = scores.groupBy(quoted(file), "threshold").agg(F.max_by("class_id", F.struct("score", -F.col("class_id"))).alias("named"))
    rates = known.join(named, file, "left").groupBy("threshold").agg(F.avg((F.col("named") == F.col("truth")).cast("double")).alias("accuracy"), F.count("*").alias("files"))
    return rates.orderBy(F.desc("accuracy"), "threshold").limit(1)
