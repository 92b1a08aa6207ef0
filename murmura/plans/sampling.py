"""Reports, folds and holdouts on the driver's tables: what their SQL can say of random choices is their sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, relational, sequences, shaping
from ..sources import tables
from . import query


@query("WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)) SELECT n - floor(n * 0.25)::BIGINT AS train, floor(n * 0.25)::BIGINT AS test, 0::BIGINT AS both, (SELECT count(*) FROM events WHERE user_id IS NOT NULL) AS rows FROM n")
def holdout_sizes(t):
    train, test = sequences.holdout(t.events.where("user_id IS NOT NULL"), "user_id", 0.25, 7)
    users = train.groupBy("user_id").agg(F.lit(1).alias("a"), F.count("*").alias("x")).join(test.groupBy("user_id").agg(F.lit(1).alias("b"), F.count("*").alias("y")), "user_id", "full")
    return users.agg(F.count("a").alias("train"), F.count("b").alias("test"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("both"), (F.sum(F.coalesce("x", F.lit(0))) + F.sum(F.coalesce("y", F.lit(0)))).alias("rows"))


_FOLDS = "c AS (SELECT l_linenumber AS fold, l_returnflag AS truth, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS predicted, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL)"


@query(f"WITH {_FOLDS}, t AS (SELECT fold, truth AS label, sum(n) FILTER (truth = predicted) AS tp, sum(n) AS support FROM c GROUP BY ALL), p AS (SELECT fold, predicted AS label, sum(n) AS named FROM c GROUP BY ALL) SELECT label, round(avg(coalesce(tp / named::DOUBLE, 0)), 6) AS precision, round(avg(coalesce(tp / support::DOUBLE, 0)), 6) AS recall, round(avg(support), 6) AS support FROM t LEFT JOIN p USING (fold, label) GROUP BY label")
def mean_report(t):
    rows = t.lineitem.where(F.col("l_returnflag").isin("A", "N")).withColumn("predicted", F.when(F.col("l_linestatus") == "O", "N").otherwise("A"))
    folds = [r[0] for r in rows.select("l_linenumber").distinct().collect()]  # seven
    each = [evaluation.report(evaluation.confusion(rows.where(F.col("l_linenumber") == k), "l_returnflag", "predicted", ["A", "N"])).withColumn("fold", F.lit(k)) for k in folds]
    found = evaluation.mean_report(relational.concat(each)).where(~F.col("label").endswith(" avg"))
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "support")])


@query("SELECT p_name AS file, CASE WHEN p_size % 4 = 0 THEN 'x' ELSE p_brand END AS class, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE p_retailprice END AS class_prob, p_partkey FROM (SELECT p_partkey::VARCHAR AS p_name, p_partkey, p_size, p_brand, p_retailprice FROM part)")
def batch_report(t):
    none = F.col("p_size") % 4 == 0
    rows = t.part.select(F.col("p_partkey").cast("string").alias("File"), F.when(none, "x").otherwise(F.lower("p_brand")).alias("Accp"), F.lit("?").alias("Best"), F.when(none, "x").otherwise(F.col("p_retailprice").cast("string")).alias("Prob"))
    names = t.part.select(F.lower("p_brand").alias("code"), F.col("p_brand").alias("class")).distinct().unionByName(t.part.sparkSession.createDataFrame([("x", "x")], "code string, class string"))
    return tables.batch_report(rows, names, "File", "Accp", "Best", "Prob").withColumn("p_partkey", F.col("file").cast("long"))


@query("SELECT o_orderkey::VARCHAR AS file, round(o_custkey / 1000.0::DOUBLE, 5) AS start_time, round(o_custkey / 1000.0::DOUBLE + (o_orderkey % 9) / 1000.0::DOUBLE, 5) AS end_time, ((o_orderkey % 50) * 1000)::INT AS low_freq, ((o_orderkey % 50 + 5) * 1000)::INT AS high_freq, 0.25::DOUBLE AS det_prob, o_totalprice AS feature FROM orders")
def measures_as_annotations(t):
    low = F.col("o_orderkey") % 50
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("Filename"), F.col("o_custkey").alias("TimeInFile"), (F.col("o_orderkey") % 9).alias("CallDuration"), low.alias("LowFreq"), (low + 5).alias("HiFreq"), F.lit(0.25).alias("Quality"), "o_totalprice")
    return tables.measures_to_annotations(rows, ["o_totalprice"]).withColumn("feature", F.get("features", F.lit(0))).drop("features")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%URGENT%'")
def species_rows(t):
    name = F.concat(F.lit("a-"), F.regexp_replace("o_orderpriority", "[^A-Z]", ""), F.lit(".wav"))
    return shaping.of_species(t.orders.select("o_orderkey", name.alias("Filename")), "URGENT").select("o_orderkey")


@query("SELECT o_custkey, o_orderstatus, o_totalprice FROM orders")
def column_range(t):
    return shaping.between_columns(t.orders, "o_custkey", "o_totalprice")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey FROM customer), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey FROM orders) SELECT i - 1 AS row_num, c_custkey, o_orderkey FROM a JOIN b USING (i)")
def glued_columns(t):
    left = relational.with_row_numbers(t.customer.select("c_custkey"), ["c_custkey"])
    return shaping.beside(left, relational.with_row_numbers(t.orders.select("o_orderkey"), ["o_orderkey"]))
