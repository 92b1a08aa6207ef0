"""Unions, joins, samples, correlations, distances, two-sample tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import performance, relational, shaping, statistics
from . import query

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def concat_union(t):
    return relational.concat([t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(t):
    return relational.not_in(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderkey, r_regionkey * 10 AS place FROM orders JOIN region ON r_regionkey = o_orderkey % 7")
def listed_join(t):
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("k"))
    return relational.listed(rows, t.region.select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") * 10).alias("place")), "k", "place").drop("k")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lookup_broadcast(t):
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return relational.lookup(t.supplier.select("s_suppkey", "s_nationkey"), nation, ["s_nationkey"], needed="n_name").select("s_suppkey", "n_name")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_num FROM events")
def row_numbers(t):
    return relational.with_row_numbers(t.events.select("event_id"), ["event_id"])


@query()
def sample_n(t):
    return relational.sample(t.events, 100, seed=7, key=["event_id"], cond=lambda df: df["value"] > 1)


@query()
def stratified_sample(t):
    return relational.stratified_sample(t.events, "event_type", 90, seed=7, key=["event_id"])


@query("""
WITH b AS (SELECT p_brand, sum(p_retailprice) AS s FROM part GROUP BY 1), r AS (SELECT p_brand, s / (SELECT sum(s) FROM b) AS share FROM b),
c AS (SELECT *, sum(share) OVER (ORDER BY share DESC, p_brand ROWS UNBOUNDED PRECEDING) AS cumulative FROM r)
SELECT p_brand, round(share, 6) AS share, round(cumulative, 6) AS cumulative FROM c WHERE round(cumulative - share, 12) < 0.5
""")
def top_share_features(t):
    shares = t.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("s"))
    total = shares.agg(F.sum("s").alias("total"))
    shares = shares.crossJoin(F.broadcast(total)).select("p_brand", (F.col("s") / F.col("total")).alias("share"))
    return relational.top_shares(shares, "p_brand", "share", 0.5).select("p_brand", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def topk_per_group(t):
    return shaping.top_per_group(t.events.select("event_id", "user_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3)


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) % 4 + 1 AS batch, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 4)::INT AS \"group\" FROM supplier")
def dealt_batches(t):
    rows = relational.in_rounds(t.supplier.select("s_suppkey"), "s_suppkey", 4)
    return relational.in_groups_of(rows, "s_suppkey", 4).withColumn("batch", F.col("batch").cast("long"))


_JOIN = "SELECT (l_suppkey % 5)::BIGINT AS model_id, l_extendedprice AS price_truth, l_quantity * p_retailprice AS price_pred, l_discount AS rate_truth, l_tax AS rate_pred FROM lineitem JOIN part ON l_partkey = p_partkey"
_ERR = " UNION ALL ".join(f"SELECT model_id, '{m}' AS measure, round(sqrt(avg(({m}_truth - {m}_pred) ** 2)), 6) AS rmse, round(min(abs({m}_truth - {m}_pred)), 6) AS min_abs_diff, round(max(abs({m}_truth - {m}_pred)), 6) AS max_abs_diff FROM j GROUP BY 1" for m in ("price", "rate"))


def _errors(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_suppkey") % 5).alias("model_id"), F.col("l_extendedprice").alias("price_truth"), (F.col("l_quantity") * F.col("p_retailprice")).alias("price_pred"), F.col("l_discount").alias("rate_truth"), F.col("l_tax").alias("rate_pred"))
    return performance.errors(joined, ["price", "rate"])


_METRICS = ("rmse", "min_abs_diff", "max_abs_diff")


@query(f"WITH j AS ({_JOIN}) {_ERR}")
def truth_pred_perf(t):
    return _errors(t).select("model_id", "measure", *[F.round(m, 6).alias(m) for m in _METRICS])


@query(f"WITH j AS ({_JOIN}), e AS ({_ERR}) SELECT measure, round(avg(rmse), 4) AS rmse, round(avg(min_abs_diff), 4) AS min_abs_diff, round(avg(max_abs_diff), 4) AS max_abs_diff FROM e GROUP BY 1")
def model_means(t):
    return performance.means(_errors(t)).select("measure", *[F.round(m, 4).alias(m) for m in _METRICS])


@query(f"WITH j AS ({_JOIN}), e AS ({_ERR}) SELECT measure, {', '.join(f'max(rmse) FILTER (model_id = {i}) AS \"{i}\"' for i in range(5))} FROM e GROUP BY 1")
def pivot_models(t):
    return performance.metric_matrix(_errors(t).withColumn("rmse", F.round("rmse", 6)), "rmse", list(range(5)))


@query("SELECT a.event_id, a.value AS value_truth, b.value AS value_pred FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id = b.event_id + 150 WHERE b.event_id % 2 = 0")
def truth_join(t):
    keys = ["user_id", "event_id"]
    truth, predicted = t.events.select(*keys, "value"), t.events.where("event_id % 2 = 0").select("user_id", (F.col("event_id") + 150).alias("event_id"), "value")
    return relational.truth_with_predictions(truth, predicted, keys, ["value"]).select("event_id", "value_truth", "value_pred")


@query("SELECT l_orderkey, round(var_samp(l_quantity), 9) AS l_quantity, round(var_samp(l_discount), 9) AS l_discount, round(var_samp(l_quantity) + var_samp(l_discount), 9) AS total FROM lineitem GROUP BY 1")
def ensemble_variance(t):
    out = performance.ensemble_variance(t.lineitem, ["l_orderkey"], ["l_quantity", "l_discount"])
    return out.select("l_orderkey", *[F.round(c, 9).alias(c) for c in ("l_quantity", "l_discount", "total")])


@query("SELECT round(quantile_cont(value, 0.0005), 6) AS low, round(quantile_cont(value, 0.999), 6) AS high FROM events")
def clip_limits(t):
    return performance.clip_limits(t.events, "value").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS mean FROM events GROUP BY 1")
def running_mean(t):
    return performance.running_mean(t.events, "value", "user_id", ["event_type"]).withColumn("mean", F.round("mean", 6))


_MEANS = " UNION ALL ".join(f"SELECT avg({c}) AS m FROM lineitem" for c in MEASURES)


@query(f"WITH e AS ({_MEANS}) SELECT round(min(m), 5) AS min, round(quantile_cont(m, 0.25), 5) AS q1, round(quantile_cont(m, 0.5), 5) AS median, round(quantile_cont(m, 0.75), 5) AS q3, round(max(m), 5) AS max, round(avg(m), 5) AS mean FROM e")
def loss_percentiles(t):
    out = performance.loss_percentiles(t.lineitem, MEASURES)
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@query("WITH c AS (SELECT p_partkey AS row, 0 AS i, 'p_size' AS \"column\", p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 1, 'p_retailprice', p_retailprice FROM part) SELECT row, \"column\", value FROM c ORDER BY value DESC, row, i LIMIT 1")
def max_cell(t):
    return statistics.max_cell(t.part, "p_partkey", ["p_size", "p_retailprice"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS measure, round(corr({c}, l_quantity), 6) AS correlation FROM lineitem" for c in MEASURES[1:]))
def corr_one_vs_all(t):
    return statistics.correlate_with(t.lineitem, "l_quantity", MEASURES[1:]).select("measure", F.round("correlation", 6).alias("correlation"))


@query("SELECT 'n_chars' AS measure, round(corr(n_chars, quality), 6) AS correlation FROM labels JOIN documents USING (doc_id)")
def point_biserial(t):
    return statistics.correlate_with(t.labels.join(t.documents, "doc_id"), "quality", ["n_chars"]).select("measure", F.round("correlation", 6).alias("correlation"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]))
def corr_matrix(t):
    return statistics.correlation_matrix(t.lineitem, MEASURES).withColumn("correlation", F.round("correlation", 6))


@query("""
WITH m AS (SELECT avg(value) AS a, count(*) AS n FROM events), c AS (SELECT avg((value - a) ** 2) AS m2, avg((value - a) ** 3) AS m3, avg((value - a) ** 4) AS m4 FROM events, m)
SELECT count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(var_samp(value), 6) AS var, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max, (SELECT round(m3 / m2 ** 1.5, 6) FROM c) AS skew, (SELECT round(m4 / m2 ** 2 - 3, 6) FROM c) AS kurtosis FROM events
""")
def summary_moments(t):
    out = statistics.summary(t.events, "value")
    return out.select("n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "var", "q1", "q3", "skew", "kurtosis")])


_TWO = "WITH s AS (SELECT value AS v, event_type = 'click' AS g FROM events), m AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS v FROM s GROUP BY g), x AS (SELECT a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2 FROM m a, m b WHERE a.g AND NOT b.g)"


@query(f"{_TWO} SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df, round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS cohens_d FROM x")
def welch_cohen(t):
    r = statistics.welch(t.events, "value", F.col("event_type") == "click")
    spark = t.events.sparkSession
    return spark.createDataFrame([(r["t"], r["df"], r["cohens_d"])], "t double, df double, cohens_d double").select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round("cohens_d", 6).alias("cohens_d"))


@query(f"{_TWO}, p AS (SELECT count(*) FILTER (a.v > b.v) AS w, count(*) FILTER (a.v = b.v) AS e FROM s a, s b WHERE a.g AND NOT b.g) SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, (w + e / 2.0)::DOUBLE AS u, round(2 * (w + e / 2.0) / (n1 * n2) - 1, 6) AS delta FROM p, x")
def cliffs_delta(t):
    return statistics.cliffs_delta(t.events, "value", F.col("event_type") == "click").withColumn("delta", F.round("delta", 6)).withColumn("u", F.col("u").cast("double"))


@query(f"{_TWO}, c AS (SELECT v, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM s GROUP BY v), k AS (SELECT abs(sum(a) OVER (ORDER BY v) / (SELECT n1 FROM x) - sum(b) OVER (ORDER BY v) / (SELECT n2 FROM x)) AS gap FROM c) SELECT round(max(gap), 6) AS d FROM k")
def kolmogorov_smirnov(t):
    return statistics.kolmogorov_smirnov(t.events, "value", F.col("event_type") == "click").withColumn("d", F.round("d", 6))


@query("""
WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS a, sum(n * v) AS w FROM g)
SELECT round((SELECT sum(g.n * (g.m - s.a) ** 2) FROM g, s) / (k - 1) / (w / (n - k)), 6) AS f FROM s
""")
def anova(t):
    r = statistics.anova(t.events, "value", "event_type")
    return t.events.sparkSession.createDataFrame([(r["f"],)], "f double").select(F.round("f", 6).alias("f"))


_V = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"{_V} SELECT a.vec_id, round(list_distance(a.e, b.e), 6) AS euclidean, round(1 - list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 6) AS cosine, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS manhattan FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def distances(t):
    a, b = t.embeddings.select("vec_id", F.col("embedding").alias("a")), t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    d = lambda m: F.round(statistics.distance(F.col("a"), F.col("b"), m), 6).alias(m)
    return a.join(b, "vec_id").select("vec_id", d("euclidean"), d("cosine"), d("manhattan"))


@query("SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, abs(length(a.role) - length(b.role))::DOUBLE AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def similarities_within(t):
    rows = t.conversations.select("conv_id", "turn", F.length("role").alias("n"))
    return statistics.similarities_within(rows, ["conv_id"], "turn", ["n"])
