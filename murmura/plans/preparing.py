"""Sequence preparation, cleaning, scaling, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.names import first_integer
from ..operators import cleaning, reshape, scaling, sequences, shaping, windows
from . import query

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_Z = ", ".join(f"CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0 END AS {c}" for c in MEASURES)


@query(f"""
WITH s AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
z AS (SELECT {', '.join(KEYS)}, {_Z} FROM s WHERE n > 1 WINDOW w AS (PARTITION BY l_orderkey))
SELECT {', '.join(KEYS)}, 'measures' AS "Measure_Type", m AS "Measure_Name", round(v, 6) AS "Measure_Value"
FROM z UNPIVOT (v FOR m IN ({', '.join(MEASURES)}))
""")
def seq_zscore(t):
    rows = shaping.longer_than(t.lineitem, 1, ["l_orderkey"]).select(*KEYS, *MEASURES)
    long = reshape.long_format(windows.zscore_within(rows, ["l_orderkey"], MEASURES), {"measures": MEASURES}, KEYS)
    return long.withColumn("Measure_Value", F.round("Measure_Value", 6))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS chirp_idx, dense_rank() OVER (ORDER BY user_id) - 1 AS file_id FROM events")
def seq_index_and_ids(t):
    rows = sequences.with_index(t.events, "user_id", ["ts"]).withColumn("chirp_idx", F.col("chirp_idx").cast("long"))
    return rows.join(sequences.file_ids(t.events, "user_id"), "user_id").select("event_id", "chirp_idx", "file_id")


@query(f"SELECT {', '.join(KEYS)} FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n > 5")
def min_length_filter(t):
    return shaping.longer_than(t.lineitem, 5, ["l_orderkey"]).select(*KEYS)


@query("""
WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT 'max_length' AS parameter, max(n) AS value FROM s UNION ALL SELECT 'min_length', 20 UNION ALL SELECT 'num_files', count(*) FROM s
""")
def config_kv(t):
    return sequences.configuration(t.events, "user_id", 20)


_COUNTS = "WITH c AS (SELECT user_id, count(*) - 1 - 5 + 2 AS n_samples FROM events GROUP BY 1), s AS (SELECT user_id, n_samples, (sum(n_samples) OVER (ORDER BY user_id))::BIGINT AS cum_samples FROM c)"


def _counts(t):
    return sequences.sample_counts(sequences.with_index(t.events, "user_id", ["ts"]), "user_id", 5)


@query(f'{_COUNTS} SELECT user_id, n_samples, cum_samples, cum_samples - n_samples AS "start" FROM s')
def samples_prefix_sum(t):
    return _counts(t)


@query(f"{_COUNTS}, d AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS file_id, count(*) OVER () AS total FROM s) SELECT user_id, file_id, floor(file_id / greatest(1, floor((total + 2.0) / 4)))::INT AS split FROM d")
def split_assignment(t):
    return sequences.assign_splits(sequences.file_ids(t.events, "user_id"), 4)


@query(f"{_COUNTS}, d AS (SELECT n_samples, dense_rank() OVER (ORDER BY user_id) - 1 AS file_id, count(*) OVER () AS total FROM s) SELECT floor(file_id / greatest(1, floor((total + 2.0) / 4)))::INT AS split, sum(n_samples)::BIGINT AS n_samples FROM d GROUP BY 1")
def split_totals(t):
    return sequences.split_totals(_counts(t).join(sequences.assign_splits(sequences.file_ids(t.events, "user_id"), 4), "user_id"))


@query(f'{_COUNTS} SELECT e.event_id, s.user_id, e.event_id - (s.cum_samples - s.n_samples) AS "within" FROM events e JOIN s ON e.event_id >= s.cum_samples - s.n_samples AND e.event_id < s.cum_samples')
def sample_lookup(t):
    return sequences.locate(t.events.select("event_id"), "event_id", _counts(t), "user_id")


_CONV = "WITH c AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx, length(role) AS m, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


def _turns(t):
    return sequences.with_index(t.conversations, "conv_id", ["turn"], "idx").select("conv_id", "idx", F.length("role").cast("double").alias("m"))


@query(f"{_CONV} SELECT c.conv_id, c.idx, (l.len - 1)::INT AS cntxt_sz FROM c, LATERAL (SELECT unnest(range(2, c.n + 1)) AS len) l WHERE c.idx < l.len")
def prefix_explosion(t):
    return sequences.explode_prefixes(_turns(t), "conv_id", "idx", 2).select("conv_id", "idx", "cntxt_sz")


@query(f'{_CONV}, g AS (SELECT DISTINCT conv_id, n, unnest(range(6))::INT AS ti FROM c) SELECT g.conv_id, g.ti AS "TimeIndex", coalesce(c.m, 0)::DOUBLE AS m FROM g LEFT JOIN c ON c.conv_id = g.conv_id AND c.idx - c.n + 6 = g.ti')
def left_pad(t):
    return sequences.left_pad(_turns(t), ["conv_id"], "idx", ["m"], 6)


@query(f"{_CONV} SELECT conv_id, {', '.join(f'max(CASE WHEN idx = {i} THEN m END)::DOUBLE AS m_{i}' for i in range(4))} FROM c WHERE n = 4 GROUP BY conv_id")
def flatten_by_length(t):
    return sequences.flatten_by_length(_turns(t), "conv_id", "idx", ["m"], 4)


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS measure, var_samp({c}) AS variance, stddev_samp({c}) AS stdev, max({c}) AS max, min({c}) AS min, avg({c}) AS mean, median({c}) AS median FROM lineitem" for c in MEASURES)


@query(f"""
WITH s AS ({_STATS})
SELECT measure, round(variance, 4) AS variance, (rank() OVER (ORDER BY variance) + (count(*) OVER (PARTITION BY variance) - 1) / 2.0) / count(*) OVER () AS vars_normed,
  round(stdev, 6) AS stdev, max, min, round(mean, 6) AS mean, round(median, 6) AS median FROM s
""")
def column_stats(t):
    out = cleaning.profile(t.lineitem, MEASURES)
    return out.select("measure", F.round("variance", 4).alias("variance"), "vars_normed", F.round("stdev", 6).alias("stdev"), "max", "min", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def cull_low_variance(t):
    rows = t.lineitem.select("l_orderkey", *MEASURES)
    return cleaning.cull(rows, cleaning.profile(rows, MEASURES), 0.6)


@query("SELECT p_size, p_partkey, p_retailprice FROM part")
def project_include_exclude(t):
    return shaping.to_front(shaping.numeric(shaping.project(t.part, exclude=["p_name", "p_type"])), ["p_size"])


@query("SELECT event_id, nullif(event_type, 'click') AS event_type, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events WHERE event_type <> 'click' OR event_id % 3 > 0")
def drop_all_null(t):
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    return shaping.drop_empty(rows, ["event_id"])


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 0) AS value FROM events")
def fill_null(t):
    return shaping.fill(t.events.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value")))


@query("SELECT o_orderkey, (coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), 0) - 1)::INT AS code, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS status FROM orders")
def encode_categories(t):
    return t.orders.select("o_orderkey", scalars.class_id(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("code"), scalars.encode(F.col("o_orderstatus"), {"F": 0, "O": 1, "P": 2}).alias("status"))


@query("SELECT p_partkey, (p_size / 2.0)::DOUBLE AS seconds, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '')::BIGINT AS number FROM part")
def unit_suffix_parse(t):
    text = F.concat((F.col("p_size") / 2).cast("string"), F.lit(" sec"))
    return t.part.select("p_partkey", scalars.seconds_number(text).alias("seconds"), first_integer(F.col("p_brand")).alias("number"))


_P = {c: f"(SELECT avg({c}) FROM lineitem)" for c in MEASURES}


@query(f"SELECT {', '.join(KEYS)}, {', '.join(f'round(({c} - {_P[c]}) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}' for c in MEASURES)} FROM lineitem")
def standardise(t):
    out = scaling.standardise(t.lineitem.select(*KEYS, *MEASURES), scaling.fit_standard(t.lineitem, MEASURES))
    return out.select(*KEYS, *[F.round(c, 6).alias(c) for c in MEASURES])


@query(f"SELECT {', '.join(KEYS)}, {', '.join(f'round({c}, 6) AS {c}' for c in MEASURES)} FROM lineitem")
def inverse_standard(t):
    scaler = scaling.fit_standard(t.lineitem, MEASURES)
    out = scaling.unstandardise(scaling.standardise(t.lineitem.select(*KEYS, *MEASURES), scaler), scaler)
    return out.select(*KEYS, *[F.round(c, 6).alias(c) for c in MEASURES])


@query("SELECT p_partkey, round((p_size - lo) / (hi - lo), 6) AS p_size, round((p_retailprice - lo) / (hi - lo), 6) AS p_retailprice FROM part, (SELECT least(min(p_size), min(p_retailprice)) AS lo, greatest(max(p_size), max(p_retailprice)) AS hi FROM part)")
def min_max(t):
    out = scaling.min_max(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(abs(median({c}) - avg({c})), 6) AS scale FROM lineitem" for c in MEASURES))
def median_scale(t):
    return scaling.median_scale(t.lineitem, MEASURES).select("column", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query('SELECT p_partkey, \'size\' AS "Measure_Type", \'p_size\' AS "Measure_Name", p_size::DOUBLE AS "Measure_Value" FROM part UNION ALL SELECT p_partkey, \'both\', \'p_size\', p_size FROM part UNION ALL SELECT p_partkey, \'both\', \'p_retailprice\', p_retailprice FROM part UNION ALL SELECT p_partkey, \'both\', \'p_size\', p_size FROM part')
def long_format(t):
    return reshape.long_format(t.part, {"size": ["p_size", "missing"], "both": ["p_size", "p_retailprice", "p_size"]}, ["p_partkey"])


@query("SELECT event_id, CASE WHEN n = 3 THEN round(a, 6) END AS avg3 FROM (SELECT event_id, avg(value) OVER w AS a, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))")
def moving_avg(t):
    from pyspark.sql import Window as W

    return t.events.select("event_id", F.round(windows.moving_average(F.col("value"), W.partitionBy("user_id").orderBy("ts")), 6).alias("avg3"))


@query("SELECT user_id, event_id, round(value - lead(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS value FROM events")
def lead_residual(t):
    rows = t.events.select("user_id", "event_id", "value")
    return windows.residuals(rows, rows, ["value"], ["event_id"], ["user_id"]).withColumn("value", F.round("value", 6))


@query("SELECT event_id, coalesce(round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 5), -1) AS gap FROM events")
def call_interval(t):
    from pyspark.sql import Window as W

    return t.events.select("event_id", windows.call_interval(F.col("value"), W.partitionBy("user_id").orderBy("ts")).alias("gap"))


_GRID = "SELECT (l_partkey % 40)::BIGINT AS x, (l_suppkey % 25)::BIGINT AS y, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2"


@query(f"WITH g AS ({_GRID}), a AS (SELECT *, max(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS r FROM g), b AS (SELECT *, max(r) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM a) SELECT x, y, CASE WHEN v = m THEN v ELSE 0 END AS v FROM b")
def local_max_nms(t):
    grid = t.lineitem.groupBy((F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 25).alias("y")).agg(F.max("l_extendedprice").alias("v"))
    return windows.local_maxima(grid, "x", "y", "v", 9)
