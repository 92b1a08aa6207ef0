"""Time and name features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import names, times
from ..operators import relational, windows
from . import query

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


@query("SELECT o_orderkey, epoch(date_trunc('second', o_orderdate))::BIGINT AS recorded FROM orders")
def name_time_parse(t):
    name = F.concat(F.lit("c:\\data\\barn1_D"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("m784-HiF.wav"))
    return t.orders.select("o_orderkey", names.time_from_name(name).alias("at")).select("o_orderkey", F.expr(f"timestampdiff(SECOND, {_EPOCH}, at)").alias("recorded"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'Unkn' ELSE array_to_string(list_sort(list_distinct([substr(n_name, 1, 4), substr(r_name, 1, 4), substr(n_name, 1, 4)])), ',') END AS species,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE substr(n_name, 1, 4) END AS code
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def species_tags(t):
    a, b = F.substring("n_name", 1, 4), F.substring("r_name", 1, 4)
    name = F.when(F.col("n_nationkey") % 5 == 0, F.lit("x-HiF1.wav")).otherwise(F.concat(F.lit("x7-"), a, F.lit("-"), b, F.lit("-"), a, F.lit(".wav")))
    name = F.when(F.col("n_nationkey") % 5 == 0, F.lit("x-HiF.wav")).otherwise(name)
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", names.species(name).alias("species"), names.species_code(name).alias("code"))


def _cycle(unit: str, part: str, period: int, suffix: str) -> str:
    return ", ".join(f"round({f}(2 * pi() * ({part}) / {period}), 6) AS {f}_{suffix}" for f in ("sin", "cos"))


@query(f"SELECT event_id, {_cycle('hour', 'hour(ts)', 24, 'hr')}, {_cycle('day', 'day(ts)', 30, 'day')}, {_cycle('month', 'month(ts)', 12, 'month')}, {_cycle('year', 'year(ts) % 10', 10, 'year')} FROM events")
def cyclic_time(t):
    return t.events.select("event_id", *[F.round(c, 6).alias(n) for n, c in times.cycle_columns(F.col("ts")).items()])


@query("""
WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
f AS (SELECT *, min(CASE WHEN p % 5 = 3 THEN p END) OVER (PARTITION BY user_id) AS f FROM p),
k AS (SELECT event_id, ((p - f) % 8 + 8) % 8 AS k FROM f)
SELECT event_id, CASE WHEN k = 7 THEN 0 ELSE round(sin(2 * pi() * k / 7), 6) END AS sin, CASE WHEN k = 7 THEN 1 ELSE round(cos(2 * pi() * k / 7), 6) END AS cos FROM k
""")
def cyclic_registration(t):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts"))
    rows = t.events.withColumn("unit", place % 5)
    out = windows.cyclic_by_rows(rows, F.col("unit"), 3, 8, ["ts"], ["user_id"])
    return out.select("event_id", F.round("sin", 6).alias("sin"), F.round("cos", 6).alias("cos"))


@query("SELECT event_id, (floor((floor(epoch(ts)) + 30) / 60) * 60)::BIGINT AS minute FROM events")
def round_time(t):
    return t.events.select("event_id", F.unix_timestamp(times.round_time(F.col("ts"), 60)).alias("minute"))


def _solar_sql() -> str:
    """Sunrise and sunset of each day by the same published equations, a step of common tables at a time."""
    rad = f"{math.radians(1)!r}"
    lat, zen = math.radians(times.LATITUDE), math.radians(times.ZENITH)
    steps = ["d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)", "x0 AS (SELECT day, rising, date_diff('day', DATE '1970-01-01', day) * 86400.0 AS midnight, date_diff('day', DATE '1970-01-01', day) * 86400.0 + (7 + CASE WHEN rising THEN 6 ELSE 18 END) * 3600.0 AS at_ FROM d, (VALUES (true), (false)) v(rising))"]
    for i in range(3):
        steps += [
            f"a{i} AS (SELECT *, (at_ / 86400.0 + 2440587.5 - 2451545.0) / 36525.0 AS c FROM x{i})",
            f"b{i} AS (SELECT *, ((280.46646 + c * (36000.76983 + c * 0.0003032)) % 360.0) * {rad} AS l, (357.52911 + c * (35999.05029 - c * 0.0001537)) * {rad} AS m, 0.016708634 - c * (0.000042037 + c * 0.0000001267) AS e, (125.04 - c * 1934.136) * {rad} AS o FROM a{i})",
            f"c{i} AS (SELECT *, l + (sin(m) * (1.914602 - c * (0.004817 + c * 0.000014)) + sin(2 * m) * (0.019993 - c * 0.000101) + sin(3 * m) * 0.000289) * {rad} - 0.00569 * {rad} - sin(o) * 0.00478 * {rad} AS s, (23.0 + (26.0 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60.0) / 60.0 + cos(o) * 0.00256) * {rad} AS t FROM b{i})",
            f"e{i} AS (SELECT *, asin(sin(t) * sin(s)) AS dec, tan(t / 2) * tan(t / 2) AS y FROM c{i})",
            f"f{i} AS (SELECT *, 4 / {rad} * (y * sin(2 * l) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l) - 0.5 * y * y * sin(4 * l) - 1.25 * e * e * sin(2 * m)) AS eq, acos({math.cos(zen)!r} / ({math.cos(lat)!r} * cos(dec)) - {math.tan(lat)!r} * tan(dec)) / {rad} AS ha FROM e{i})",
            f"x{i + 1} AS (SELECT day, rising, midnight, midnight + (720 - 4 * ({times.LONGITUDE} + CASE WHEN rising THEN ha ELSE -ha END) - eq) * 60 AS at_ FROM f{i})",
        ]
    return "WITH " + ",\n".join(steps) + ", l AS (SELECT day, rising, floor((floor(at_) - 25200 + 30) / 60) * 60 AS at_ FROM x3), sun AS (SELECT day, max(at_) FILTER (rising) AS rise, max(at_) FILTER (NOT rising) AS fall FROM l GROUP BY day)"


@query(_solar_sql() + " SELECT strftime(day, '%Y-%m-%d') AS day, rise::BIGINT AS rise, fall::BIGINT AS fall FROM sun")
def sun_times(t):
    days = t.events.select(F.to_date("ts").alias("day")).distinct()
    rise, fall = times.sunrise_sunset("day")
    unix = lambda c: F.expr(f"timestampdiff(SECOND, {_EPOCH}, {c})")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), rise.alias("r"), fall.alias("f")).select("day", unix("r").alias("rise"), unix("f").alias("fall"))


@query(_solar_sql() + " SELECT event_id FROM events JOIN sun ON CAST(ts AS DATE) = day WHERE floor(epoch(ts)) BETWEEN rise AND fall")
def daytime_filter(t):
    rows = t.events.select("event_id", F.concat(F.lit("barn1_D"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("m784.wav")).alias("Filename"))
    return relational.daytime_only(rows).select("event_id")


@query("SELECT strftime(ts, '%H:%M') AS minute, count(*) AS n FROM events GROUP BY 1")
def minute_histogram(t):
    from ..operators.statistics import minute_histogram as histogram

    return histogram(t.events, "ts")


@query("""
WITH s AS (SELECT user_id, hour(ts) BETWEEN 6 AND 17 AS is_daytime, count(*) AS n FROM events GROUP BY ALL)
SELECT is_daytime, count(*) AS files, sum(n)::BIGINT AS calls, round(avg(n), 6) AS mean_length, min(n) AS min_length, max(n) AS max_length FROM s GROUP BY ROLLUP (is_daytime)
""")
def day_night_rollup(t):
    from ..operators.statistics import day_night

    rows = t.events.withColumn("day", F.hour("ts").between(6, 17))
    return day_night(rows, "user_id", "day").withColumn("mean_length", F.round("mean_length", 6))


_TYPES = ["click", "purchase", "view"]
_WEEK = "WITH f AS (SELECT min(CAST(ts AS DATE)) AS f FROM events), w AS (SELECT strftime(f + ((CAST(ts AS DATE) - f) // 7 * 7)::INT, '%Y-%m-%d') AS week, event_type FROM events, f), c AS (SELECT week, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS \"{x}\"" for x in _TYPES) + " FROM w GROUP BY week)"


def _weekly(t):
    from ..operators.statistics import weekly_counts as weekly

    return weekly(t.events.withColumn("day", F.to_date("ts")), "day", "event_type", _TYPES).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query(f"{_WEEK} SELECT * FROM c")
def weekly_counts(t):
    return _weekly(t)


@query(f"{_WEEK} SELECT week, " + ", ".join(f'round("{x}" / nullif("{_TYPES[0]}" + "{_TYPES[1]}" + "{_TYPES[2]}", 0)::DOUBLE, 6) AS "{x}"' for x in _TYPES) + " FROM c")
def weekly_proportions(t):
    from ..operators.statistics import row_shares

    return row_shares(_weekly(t), _TYPES).select("week", *[F.round(x, 6).alias(x) for x in _TYPES])


@query("SELECT DISTINCT a.l_suppkey FROM lineitem a WHERE month(l_shipdate) = 2 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND month(b.l_shipdate) = 3) AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND month(b.l_shipdate) = 7)")
def intersect_months(t):
    return relational.in_all(t.lineitem, F.month("l_shipdate"), [2, 3, 7], "l_suppkey")
