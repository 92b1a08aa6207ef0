"""Operators on names, cells, axes, splits and reports, each on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, scalars
from ..operators import cleaning, evaluation, nested, performance, relational, reshape, sequences, shaping, statistics
from ..schema import RANKED
from . import query


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H_%M_%S') AS stamp, floor(epoch(ts))::BIGINT AS back FROM events")
def file_timestamps(t):
    rows = t.events.select("event_id", names.file_timestamp(F.col("ts")).alias("stamp"))
    found = names.timestamp_in_name(F.concat(F.lit("run_"), "stamp", F.lit("_12x.csv")))
    return rows.select("event_id", "stamp", F.unix_timestamp(names.timestamp_of(found)).alias("back"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END::BIGINT AS whole, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey + 0.5 END::DOUBLE AS real, CASE WHEN o_orderkey % 3 = 2 THEN 'x' || o_orderkey END AS text FROM orders")
def numeric_cells(t):
    key = F.col("o_orderkey")
    cell = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(key.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("x"), key.cast("string")))
    return t.orders.select("o_orderkey", scalars.numeric_if_possible(cell).alias("c")).select("o_orderkey", "c.*")


@query("SELECT l_orderkey, l_linenumber, (l_linenumber * 128 + 384) / 256000.0::DOUBLE AS seconds, floor((l_discount * 256000 - 384) / 128)::INT AS x, round((64 - l_linenumber) * 1718.75 + 10000, 2)::DOUBLE AS hertz FROM lineitem")
def spectrogram_axes(t):
    x = F.col("l_linenumber")
    made = scalars.x_to_time(x, 256000, 0.002, 0.75), scalars.time_to_x(F.col("l_discount"), 256000, 0.002, 0.75), scalars.bin_to_frequency(x, 10000, 120000, 64)
    return t.lineitem.select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(made, ("seconds", "x", "hertz"))])


@query("SELECT o_orderkey, round(o_totalprice::DOUBLE, 4) AS start_time, round(o_totalprice::DOUBLE + 1, 4) AS end_time, (o_custkey % 97)::INT AS low_freq, (o_custkey % 97 + 5)::INT AS high_freq, (o_orderkey % 8) / 8.0::DOUBLE AS det_prob, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS class_prob, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS class FROM orders")
def detection_rows(t):
    probs = F.array(F.lit(0.5), F.when(F.col("o_orderkey") % 3 == 0, 0.25).otherwise(0.75), F.lit(0.125))
    start, low = F.col("o_totalprice").cast("double"), F.col("o_custkey") % 97
    return t.orders.select("o_orderkey", *scalars.detection_format(start, start + 1, low, low + 5, F.col("o_orderkey") % 8 / 8, probs, ["a", "b", "c"]))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1")
def parallel_lists(t):
    rows = nested.parallel_arrays(t.events, "user_id", ["event_id", "event_type"], "event_id")
    return rows.select("user_id", F.array_join("event_types", ",").alias("types"), F.array_join("event_ids", ",").alias("ids"))


_LANG = "s AS (SELECT lang, quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL), c AS (SELECT lang, x, sum(y) AS p, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT lang, x, p, sum(p) OVER w AS tp, sum(n) OVER w AS every, sum(p) OVER (PARTITION BY lang) AS pos FROM c WINDOW w AS (PARTITION BY lang ORDER BY x DESC)), a AS (SELECT lang, CASE WHEN min(pos) > 0 THEN sum(p / nullif(pos, 0)::DOUBLE * tp / every) END AS ap FROM k GROUP BY 1)"


@query(f"WITH {_LANG} SELECT round(avg(ap), 6) AS mean_average_precision, count(ap) AS classes FROM a")
def mean_ap(t):
    rows = t.labels.join(t.documents, "doc_id").where("lang IS NOT NULL")
    each = evaluation.average_precision(evaluation.pr_curve(rows, F.col("quality"), F.col("n_chars"), ["lang"]), ["lang"])
    return evaluation.mean_average_precision(each).withColumn("mean_average_precision", F.round("mean_average_precision", 6))


@query("WITH a AS (SELECT l_orderkey, l_extendedprice::DOUBLE AS start_time, l_suppkey % 5 AS individual FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_orderkey, l_extendedprice::DOUBLE AS start_time, l_suppkey % 5 AS individual FROM lineitem WHERE l_linenumber = 2) SELECT * FROM a UNION ALL SELECT l_orderkey, start_time, individual + (SELECT max(individual) + 1 FROM a) FROM b")
def combined_in_time(t):
    rows = t.lineitem.select("l_linenumber", "l_orderkey", F.col("l_extendedprice").cast("double").alias("start_time"), (F.col("l_suppkey") % 5).alias("individual"))
    of = lambda n: rows.where(F.col("l_linenumber") == n).drop("l_linenumber")
    return nested.combine_in_time(of(1), of(2))


_SHARES = "WITH b AS (SELECT p_brand, sum(p_retailprice) AS s FROM part GROUP BY 1), r AS (SELECT p_brand, s / (SELECT sum(s) FROM b) AS share FROM b), c AS (SELECT *, sum(share) OVER w AS cumulative, row_number() OVER w AS place FROM r WINDOW w AS (ORDER BY share DESC, p_brand ROWS UNBOUNDED PRECEDING))"


@query(f"{_SHARES} SELECT p_brand, round(share, 6) AS share FROM c WHERE place <= (SELECT count(*) FROM c WHERE cumulative < 0.6) + 1")
def top_impact(t):
    brands = t.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("s"))
    total = brands.agg(F.sum("s").alias("total"))
    shares = brands.crossJoin(F.broadcast(total)).select("p_brand", (F.col("s") / F.col("total")).alias("share"))
    return relational.top_impact(shares, "p_brand", "share", 0.6).select("p_brand", F.round("share", 6).alias("share"))


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (SELECT count(*) FROM orders) AS n FROM orders) SELECT o_orderkey, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS part FROM n")
def index_split(t):
    rows = relational.with_row_numbers(t.orders.select("o_orderkey"), ["o_orderkey"], "i")
    n = t.orders.count()
    split = sequences.IndexSplit(n, 0.2, 0.1)
    split.train_size, split.validation_size = n * 7 // 10, n * 2 // 10  # in whole numbers, as SQL has them
    return rows.select("o_orderkey", split.part(F.col("i")).alias("part"))


_STATS = ["l_quantity", "l_extendedprice"]


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS m, max({c})::DOUBLE AS max, min({c})::DOUBLE AS min, avg({c}) AS mean, median({c})::DOUBLE AS median FROM lineitem" for c in _STATS) + "), l AS (UNPIVOT p ON max, min, mean, median INTO NAME s VALUE v) SELECT s AS \"Stats\", " + ", ".join(f"round(max(v) FILTER (m = '{c}'), 6) AS {c}" for c in _STATS) + " FROM l GROUP BY s")
def stats_by_row(t):
    wide = cleaning.profile_wide(cleaning.profile(t.lineitem, _STATS), _STATS)
    return wide.where(F.col("Stats").isin("max", "min", "mean", "median")).select("Stats", *[F.round(c, 6).alias(c) for c in _STATS])


_ERRORS = "SELECT l_orderkey, l_linenumber, round(power(l_discount - l_tax, 2), 9) AS v FROM lineitem"


def _squared(t):
    joined = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_tax").cast("double").alias("v_truth"), F.col("l_discount").cast("double").alias("v_pred"))
    return performance.squared_errors(joined, ["l_orderkey", "l_linenumber"], ["v"])


@query(_ERRORS)
def squared_errors(t):
    return _squared(t).withColumn("v", F.round("v", 9))


@query("SELECT l_linenumber, count(*) AS n, round(avg(power(l_discount - l_tax, 2)), 8) AS v FROM lineitem GROUP BY 1")
def mean_errors(t):
    return performance.mean_errors(_squared(t), "l_linenumber", ["v"]).withColumn("v", F.round("v", 8))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def first_rows(t):
    return shaping.first_rows(t.orders.select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down")), 10, ["down", "o_orderkey"]).drop("down")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 - 5")
def inside_borders(t):
    return shaping.inside_borders(t.lineitem.withColumn("dur", F.lit(40)), "l_quantity", "dur", 5).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, (event_type = 'click')::INT AS is_click, (event_type = 'view')::INT AS is_view FROM events")
def one_vs_rest(t):
    return t.events.select("event_id", *evaluation.binarise(F.col("event_type"), ["click", "view"]))


@query(f'SELECT l_discount AS "{RANKED[2]}", l_tax AS "{RANKED[9]}", l_orderkey, l_linenumber FROM lineitem')
def top_measures(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_quantity").alias(RANKED[30]), F.col("l_tax").alias(RANKED[9]), "l_linenumber", F.col("l_discount").alias(RANKED[2]))
    return shaping.top_measures(rows, 2, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey AS file_id, l_linenumber::BIGINT AS cntxt_sz, l_linenumber::BIGINT AS chirp_idx FROM lineitem")
def clean_predictions(t):
    return performance.clean_predictions(t.lineitem.select(F.lit(1).alias("TimeIndex"), F.col("l_orderkey").cast("double").alias("file_id"), F.col("l_linenumber").cast("string").alias("cntxt_sz")))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS files, count(*) AS rows, count(DISTINCT l_linestatus) AS labels FROM lineitem GROUP BY 1")
def split_statistics(t):
    return nested.split_statistics(t.lineitem, "l_returnflag", "l_orderkey", "l_linestatus")


@query("WITH n AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, (SELECT count(*) FROM nation) // 6 AS s FROM nation) SELECT n_nationkey, CASE WHEN i >= s AND i % s = 0 THEN n_name ELSE '' END AS n_name FROM n")
def thinned_labels(t):
    return shaping.thin_labels(t.nation.select("n_nationkey", "n_name"), "n_name", "n_nationkey", 6)


@query("WITH m AS (SELECT CASE WHEN l_linenumber < 5 THEN l_returnflag ELSE 'background' END AS truth, CASE WHEN l_quantity < 40 THEN l_linestatus ELSE 'background' END AS predicted FROM lineitem), l AS (SELECT * FROM (VALUES ('A'), ('N'), ('O'), ('R'), ('F'), ('background')) v(x)), c AS (SELECT truth, predicted, count(*) AS n FROM m GROUP BY ALL) SELECT a.x AS truth, b.x AS predicted, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.truth = a.x AND c.predicted = b.x")
def detector_confusion(t):
    rows = t.lineitem.select(F.when(F.col("l_linenumber") < 5, F.col("l_returnflag")).alias("t"), F.when(F.col("l_quantity") < 40, F.col("l_linestatus")).alias("p"))
    return evaluation.confusion_with_background(rows, "t", "p", ["A", "N", "O", "R", "F"])


@query("WITH g AS (SELECT event_type = 'click' AS g, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), a AS (SELECT * FROM g WHERE g), b AS (SELECT * FROM g WHERE NOT g) SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS t, a.n + b.n - 2 AS df FROM a, b")
def pooled_t(t):
    r = statistics.pooled_t(t.events, "value", F.col("event_type") == "click")
    return t.events.sparkSession.createDataFrame([(r["t"], r["df"])], "t double, df long").select(F.round("t", 6).alias("t"), "df")


@query("WITH g AS (SELECT event_type AS k, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), w AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS w FROM g) SELECT a.k AS a, b.k AS b, round(b.m - a.m, 6) AS difference, round(abs(b.m - a.m) / sqrt(w / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q FROM g a JOIN g b ON a.k < b.k, w")
def tukey(t):
    return statistics.tukey(t.events, "value", "event_type").select("a", "b", F.round("difference", 6).alias("difference"), F.round("q", 6).alias("q"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.01 AND l_tax > 0")
def complete_rows(t):
    null_if = lambda c, low: F.when(F.col(c) > low, F.col(c)).alias(c)
    return shaping.drop_incomplete(t.lineitem.select("l_orderkey", "l_linenumber", null_if("l_quantity", 10), null_if("l_discount", 0.01), null_if("l_tax", 0))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey, -1.0::DOUBLE AS third, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS real FROM orders")
def padded_lists(t):
    values = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double"))).otherwise(F.array(F.col("o_custkey").cast("double")))
    padded, is_real = reshape.pad_array(values, 3, -1.0)
    rows = t.orders.select("o_orderkey", "o_custkey", padded.alias("v"), is_real.alias("m"))
    return rows.select("o_orderkey", "o_custkey", F.get("v", F.lit(2)).alias("third"), F.size(F.filter("m", lambda x: x)).alias("real"))
