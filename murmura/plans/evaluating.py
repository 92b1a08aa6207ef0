"""Classifiers and detections against the truth; nested annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import parse_list
from ..operators import evaluation, nested, relational
from . import query

_CM = "WITH l AS (SELECT * FROM (VALUES (0), (1), (2)) v(x)), g AS (SELECT a.x AS truth, b.x AS predicted FROM l a, l b), c AS (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL), f AS (SELECT g.truth::BIGINT AS truth, g.predicted::BIGINT AS predicted, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (truth, predicted))"


@query(f"{_CM} SELECT * FROM f")
def confusion(t):
    return evaluation.confusion(t.labels, "quality", "toxic", [0, 1, 2])


@query(f"{_CM} SELECT truth, predicted, round(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 6) AS n FROM f")
def confusion_normalised(t):
    return evaluation.confusion(t.labels, "quality", "toxic", [0, 1, 2], "true").withColumn("n", F.round("n", 6))


@query(f"""
{_CM}, e AS (SELECT truth::VARCHAR AS label, sum(n) FILTER (truth = predicted) AS tp, sum(n) AS support, (SELECT sum(n) FROM f g WHERE g.predicted = f.truth) AS named FROM f GROUP BY truth),
p AS (SELECT label, coalesce(tp / nullif(named, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support, tp FROM e),
q AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM p),
a AS (SELECT sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy FROM q),
r AS (SELECT label, precision, recall, f1_score, support FROM q UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM q
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support) FROM q)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support::DOUBLE AS support, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM r, a
""")
def classification_report(t):
    out = evaluation.report(evaluation.confusion(t.labels, "quality", "toxic", [0, 1, 2]))
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "accuracy", "balanced_accuracy")])


_PR = """
WITH s AS (SELECT quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id)), c AS (SELECT x AS threshold, sum(y) AS p, count(*) AS n FROM s GROUP BY x),
k AS (SELECT threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w - sum(p) OVER w)::BIGINT AS fp, sum(p) OVER () AS pos FROM c WINDOW w AS (ORDER BY threshold DESC)),
r AS (SELECT threshold, tp, fp, tp / (tp + fp)::DOUBLE AS precision, tp / pos::DOUBLE AS recall FROM k), f AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM r)
"""


def _curve(t):
    return evaluation.pr_curve(t.labels.join(t.documents, "doc_id"), F.col("quality"), F.col("n_chars"))


@query(f"{_PR} SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def pr_curve(t):
    return _curve(t).select("threshold", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
{_PR}, w AS (SELECT *, recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS step, max(precision) OVER (ORDER BY threshold DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM f)
SELECT round(sum(step * precision), 6) AS average_precision, round(sum(step * env), 6) AS interpolated, round(coalesce((SELECT recall FROM f WHERE precision > 0.8 ORDER BY threshold LIMIT 1), 0), 6) AS recall_at FROM w
""")
def average_precision(t):
    c = _curve(t)
    one = evaluation.average_precision(c).crossJoin(evaluation.interpolated_precision(c).toDF("interpolated")).crossJoin(evaluation.recall_at(c, 0.8).toDF("recall_at"))
    return one.select(*[F.round(x, 6).alias(x) for x in one.columns])


@query(f"{_PR} SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def best_f1(t):
    return evaluation.best_point(_curve(t)).select("threshold", F.round("f1", 6).alias("f1"))


@query(f"{_PR} SELECT round((SELECT count(*) FILTER (a.x > b.x) + count(*) FILTER (a.x = b.x) / 2.0 FROM s a, s b WHERE a.y = 1 AND b.y = 0) / (SELECT count(*) FILTER (y = 1) * count(*) FILTER (y = 0) FROM s), 6) AS auc")
def roc_auc(t):
    return evaluation.roc_auc(t.labels.join(t.documents, "doc_id"), F.col("quality"), F.col("n_chars")).withColumn("auc", F.round("auc", 6))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def majority_vote(t):
    return evaluation.majority(t.events, "user_id", "event_type")


_HIT = " UNION ALL ".join(f"SELECT {x}::BIGINT AS label, round(100.0 * count(*) FILTER (quality = {x} AND toxic = {x}) / nullif(count(*) FILTER (quality = {x}), 0), 3) AS hit_rate, round(count(*) FILTER (quality <> {x} AND toxic = {x}) / nullif(count(*) FILTER (quality <> {x}), 0)::DOUBLE, 6) AS false_positive_rate FROM labels" for x in (0, 1))


@query(_HIT)
def hit_rates(t):
    out = evaluation.hit_rates(t.labels, "quality", "toxic", [0, 1])
    return out.select(F.col("label").cast("long").alias("label"), "hit_rate", F.round("false_positive_rate", 6).alias("false_positive_rate"))


@query(f"{_PR}, n AS (SELECT threshold, recall FROM f WHERE recall IS NOT NULL), cuts AS (SELECT max(c) AS cut FROM (SELECT round(0.1 - i / 100.0, 2) AS c FROM range(11) t(i)) WHERE (SELECT count(*) FROM n WHERE recall >= c) >= 10) SELECT threshold FROM n, cuts WHERE recall >= cut")
def cull_thresholds(t):
    return relational.cull_thresholds(_curve(t).select("threshold", "recall"), "recall").select("threshold")


_BOX = "SELECT user_id AS file, event_id AS id, floor((epoch(ts) % 86400) / 40) / 10 AS start_time, floor((epoch(ts) % 86400) / 40) / 10 + 2.5 AS end_time, 10000 + event_id % 7 * 1000 AS low_freq, 20000 + event_id % 11 * 1000 AS high_freq, (event_id % 4 - 1)::INT AS class_id, value FROM events"
_BOXES = f"WITH x AS ({_BOX}), t AS (SELECT * FROM x WHERE id % 2 = 0), p AS (SELECT * FROM x WHERE id % 2 = 1)"


def _boxes(t):
    start = F.floor((F.unix_timestamp("ts") % 86400) / 40) / 10
    x = t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("id"), start.alias("start_time"), (start + 2.5).alias("end_time"), (10000 + F.col("event_id") % 7 * 1000).alias("low_freq"), (20000 + F.col("event_id") % 11 * 1000).alias("high_freq"), (F.col("event_id") % 4 - 1).cast("int").alias("class_id"), "value")
    x = x.withColumn("class", F.concat(F.lit("c"), F.col("class_id").cast("string")))
    return x.where("id % 2 = 0"), x.where("id % 2 = 1")


@query(f"""
{_BOXES}, i AS (SELECT t.file, t.id AS t_id, p.id AS p_id, greatest(least(t.end_time, p.end_time) - greatest(t.start_time, p.start_time), 0) AS w, greatest(least(t.high_freq, p.high_freq) - greatest(t.low_freq, p.low_freq), 0) / 1e7 AS h,
  2.5 * (t.high_freq - t.low_freq) / 1e7 AS area_t, 2.5 * (p.high_freq - p.low_freq) / 1e7 AS area_p FROM t JOIN p ON t.file = p.file AND p.start_time BETWEEN t.start_time - 2.6 AND t.start_time + 2.6)
SELECT file, t_id, p_id, round(w * h / (area_t + area_p - w * h), 6) AS iou FROM i WHERE round(w, 9) > 0 AND h > 0
""")
def box_iou_join(t):
    truth, predicted = _boxes(t)
    keep = ["file", "id", "start_time", "end_time", "low_freq", "high_freq"]
    met = evaluation.overlapping(truth.select(*keep), predicted.select(*keep))
    return met.select("file", F.col("t.id").alias("t_id"), F.col("p.id").alias("p_id"), F.round("iou", 6).alias("iou")).where(F.round(F.least("t.end_time", "p.end_time") - F.greatest("t.start_time", "p.start_time"), 9) > 0)


_NEAR = "n AS (SELECT p.file, p.id, t.id AS truth_id, round(abs(p.start_time - t.start_time), 6) AS gap, row_number() OVER (PARTITION BY p.file, p.id ORDER BY abs(p.start_time - t.start_time), t.id) AS r FROM p JOIN t ON p.file = t.file AND abs(p.start_time - t.start_time) <= 3.05)"


@query(f"{_BOXES}, {_NEAR} SELECT file, id, truth_id, gap FROM n WHERE r = 1")
def nearest_affinity(t):
    truth, predicted = _boxes(t)
    return evaluation.nearest_truth(predicted, truth, 3.05).withColumn("gap", F.round("gap", 6))


_MATCH = f"{_BOXES}, {_NEAR}, m AS (SELECT p.file, p.id, p.value AS confidence, n.truth_id, t.class_id, row_number() OVER (PARTITION BY p.file, n.truth_id ORDER BY p.value DESC, p.id) AS r FROM p LEFT JOIN n ON n.file = p.file AND n.id = p.id AND n.r = 1 LEFT JOIN t ON t.file = p.file AND t.id = n.truth_id), d AS (SELECT file, id, confidence, (truth_id IS NOT NULL AND r = 1)::INT AS true_positive FROM m)"


def _matched(t):
    truth, predicted = _boxes(t)
    return evaluation.match_detections(truth, predicted.withColumn("det_prob", F.col("value")), 3.05)


@query(f"{_MATCH} SELECT * FROM d")
def match_detections(t):
    return _matched(t)


@query(f"{_MATCH}, c AS (SELECT confidence AS threshold, sum(true_positive) AS p, count(*) AS n FROM d GROUP BY 1), k AS (SELECT threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w - sum(p) OVER w)::BIGINT AS fp FROM c WINDOW w AS (ORDER BY threshold DESC)) SELECT threshold, tp, fp, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (SELECT count(*) FROM t)::DOUBLE, 6) AS recall FROM k")
def detection_curve(t):
    out = evaluation.detection_curve(_matched(t), _boxes(t)[0].count())
    return out.select("threshold", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query()
def greedy_match(t):
    truth, predicted = _boxes(t)
    return evaluation.assign_to_truth(truth.drop("value", "class_id"), predicted.drop("value", "class_id", "class"), 0.3)


@query("""
WITH t AS (SELECT l_orderkey AS file, min(l_linenumber % 3) AS truth FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 3) = 1),
s AS (SELECT l_orderkey AS file, avg(l_discount) AS c0, avg(l_tax) AS c1, avg(l_quantity / 1000) AS c2 FROM lineitem GROUP BY 1)
SELECT round(avg((CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END = truth)::INT), 6) AS accuracy, count(*) AS files FROM t JOIN s USING (file)
""")
def file_accuracy(t):
    truth = t.lineitem.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") % 3).alias("class_id"))
    predicted = t.lineitem.select(F.col("l_orderkey").alias("file"), F.array("l_discount", "l_tax", F.col("l_quantity") / 1000).alias("class_probs"))
    return evaluation.file_accuracy(truth, predicted).select(F.round("accuracy", 6).alias("accuracy"), "files")


@query("""
WITH t AS (SELECT l_orderkey AS file, min(l_linenumber % 3) AS truth FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 3) = 1),
p AS (SELECT l_orderkey AS file, unnest([0, 1, 2]) AS k, unnest([floor(l_discount * 64) / 64, floor(l_tax * 64) / 64, floor(l_quantity) / 1024]) AS v FROM lineitem),
c AS (SELECT i, (SELECT min(v) FROM p) + ((SELECT max(v) FROM p) - (SELECT min(v) FROM p)) * i / 10 AS threshold FROM range(10) r(i)),
s AS (SELECT file, k, threshold, sum(CASE WHEN v >= threshold THEN v ELSE 0 END) AS score FROM p, c GROUP BY ALL),
n AS (SELECT file, threshold, arg_max(k, (score, -k)) AS named FROM s GROUP BY ALL)
SELECT round(threshold, 9) AS threshold, round(avg((named = truth)::INT), 6) AS accuracy, count(*) AS files FROM t JOIN n USING (file) GROUP BY threshold ORDER BY 2 DESC, 1 LIMIT 1
""")
def file_accuracy_sweep(t):
    truth = t.lineitem.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") % 3).alias("class_id"))
    # binary fractions: their sums are exact, so equal ones tie in any order
    predicted = t.lineitem.select(F.col("l_orderkey").alias("file"), F.array(F.floor(F.col("l_discount") * 64) / 64, F.floor(F.col("l_tax") * 64) / 64, F.floor("l_quantity") / 1024).alias("class_probs"))
    return evaluation.file_accuracy(truth, predicted, thresholds=10).withColumns({c: F.round(c, n) for c, n in (("threshold", 9), ("accuracy", 6))})


def _documents(t):
    """Orders as annotation documents."""
    note = F.struct(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("class"), F.col("l_quantity").alias("start_time"), (F.col("l_quantity") + 1).alias("end_time"), F.col("l_linenumber").cast("int").alias("low_freq"), F.col("l_linenumber").cast("int").alias("high_freq"), F.col("l_discount").alias("class_prob"), F.col("l_tax").alias("det_prob"), F.lit("0").alias("individual"), F.when(F.col("l_linenumber") > 2, "Echolocation").otherwise("Social").alias("event"))
    notes = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(note).alias("annotation"))
    return notes.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") != "P").alias("annotated"), F.lit(10.0).alias("duration"), (F.col("o_orderkey") % 9 == 0).alias("issues"), "annotation")


@query("SELECT o_orderkey::VARCHAR AS file, l_returnflag AS class, l_quantity AS start_time, l_linenumber AS low_freq FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND o_orderkey % 9 <> 0 AND l_linenumber > 2")
def nested_explode(t):
    out = nested.filter_annotations(_documents(t), events=["Echolocation"], to_genus=True)
    return nested.explode_annotations(out).select("file", "class", "start_time", "low_freq")


@query("SELECT l_returnflag AS class, count(*) AS n, round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*))::DOUBLE, 6) AS inverse_frequency FROM lineitem GROUP BY 1")
def inverse_frequency(t):
    return nested.class_weights(t.lineitem, "l_returnflag").select(F.col("l_returnflag").alias("class"), "n", F.round("inverse_frequency", 6).alias("inverse_frequency"))


@query("SELECT p_brand, split_part(p_type, ' ', 1) AS genus, round(sum(p_retailprice), 4) AS prob FROM part GROUP BY ALL")
def genus_rollup(t):
    return nested.genus_probabilities(t.part, ["p_brand"], "p_type", "p_retailprice").withColumn("prob", F.round("prob", 4))


@query("WITH s AS (SELECT l_returnflag AS file, l_linestatus AS class, sum(l_quantity * l_discount) AS w FROM lineitem GROUP BY ALL) SELECT file, class, round(w / sum(w) OVER (PARTITION BY file), 6) AS weight FROM s")
def weighted_class(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("class"), "l_quantity", "l_discount")
    return nested.overall_class(rows, "file", "class", "l_quantity", "l_discount").withColumn("weight", F.round("weight", 6))


@query("SELECT p_type LIKE 'PROMO%' AS promo, count(*) FILTER (p_size NOT IN (1, 2, 3)) AS unknown, count(*) AS n FROM part GROUP BY 1")
def unknown_classes(t):
    rows = t.part.select(F.startswith("p_type", F.lit("PROMO")).alias("promo"), F.col("p_size").alias("class"))
    parts = [nested.unknown_classes(rows.where(F.col("promo") == p), [1, 2, 3]).withColumn("promo", F.lit(p)) for p in (True, False)]
    return nested.merge_chunks(parts).where("n > 0").select("promo", "unknown", "n")


@query("WITH m AS (SELECT avg(p_size) AS lo, avg(p_retailprice) AS hi FROM part WHERE p_brand = 'Brand#11') SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN round(lo, 6) ELSE p_size::DOUBLE END AS low_freq, CASE WHEN p_brand = 'Brand#11' AND p_retailprice < lo THEN round(hi, 6) ELSE p_retailprice END AS high_freq FROM part, m")
def level_frequency(t):
    rows = t.part.select("p_partkey", F.col("p_brand").alias("class"), F.col("p_size").alias("low_freq"), F.col("p_retailprice").alias("high_freq"))
    return nested.level_low_frequency(rows, "Brand#11").select("p_partkey", F.round("low_freq", 6).alias("low_freq"), F.round("high_freq", 6).alias("high_freq"))


@query("SELECT event_id, 0 AS place, (props->>'$.k')::INT AS x FROM events UNION ALL SELECT event_id, 1, (props->>'$.k')::INT + 1 FROM events")
def json_list_cells(t):
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(F.lit("["), k.cast("string"), F.lit(", "), (k + 1).cast("string"), F.lit(", ]"))
    return t.events.select("event_id", F.posexplode(parse_list(text)).alias("place", "x"))
