"""Registered queries over the supplied tables, and the SQL they are held against."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import parsers, stats, text
from ..operators import alerts, baselines, detectors, ordered, query, state, templates
from ..operators.assemble import assemble, indented
from ..operators.detectors import DetectorConfig
from ..operators.events import event_view
from ..session import scratch
from ..streaming import live

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: The event view in SQL.
EVENTS = """WITH e AS (SELECT event_id AS seq, ts, epoch_us(ts) AS us, 'user-' || (user_id % 20) AS source,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'notice' ELSE 'info' END AS level,
  event_type || ' user ' || user_id || ' value ' || value AS message, event_type || ' user <*> value <*>' AS template_text,
  json_extract_string(props, '$.k') AS k, value, event_type, user_id FROM events)"""


def registered(sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Register a function of the event view; `sql` may use the view as e."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(event_view(spark, sf_dir))

        _queries[f.__name__] = run
        if sql is not None:
            _oracles[f.__name__] = f"{EVENTS} {sql}"
        return run

    return add


def on_table(name: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _queries[f.__name__] = run
        if sql is not None:
            _oracles[f.__name__] = sql
        return run

    return add


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


SINCE, UNTIL = 1704412800.0, 1705622400.0  # 2024-01-05 and 2024-01-19


# ---- filters, groups, top-n, histograms -------------------------------------------------


@registered(f"SELECT seq, us, level, source FROM e WHERE us >= {int(SINCE)}000000 AND us < {int(UNTIL)}000000 AND level = 'error'")
def q_filter_time_level(e: DataFrame) -> DataFrame:
    return query.execute(e, query.QuerySpec(since=SINCE, until=UNTIL, level="error")).select("seq", micros(F.col("ts")).alias("us"), "level", "source")


@registered("SELECT seq, k FROM e WHERE k = '42'")
def q_filter_field_pair(e: DataFrame) -> DataFrame:
    return query.execute(e, query.QuerySpec(field="k", field_value="42")).select("seq", F.col("fields")["k"].alias("k"))


@registered("SELECT seq FROM e WHERE k = '7'")
def q_filter_field_value(e: DataFrame) -> DataFrame:
    return query.execute(e, query.QuerySpec(field_value="7")).select("seq")


@registered("SELECT seq FROM e WHERE k IS NOT NULL")
def q_filter_field_present(e: DataFrame) -> DataFrame:
    return query.execute(e, query.QuerySpec(field="k")).select("seq")


@registered("SELECT seq, message FROM e WHERE lower(message) LIKE '%user 7 %'")
def q_free_text(e: DataFrame) -> DataFrame:
    return query.execute(e, query.QuerySpec(text="USER 7 ")).select("seq", "message")


@registered("SELECT seq FROM e WHERE contains(template_text, 'purchase')")
def q_filter_template(e: DataFrame) -> DataFrame:
    return query.execute(e, query.QuerySpec(template="purchase")).select("seq")


@registered("SELECT count(*) FILTER (WHERE level = 'error') AS matched, count(*) AS scanned FROM e")
def q_matched_scanned(e: DataFrame) -> DataFrame:
    return query.counters(e, query.parse_query({"level": " Error ", "text": ""}))


@registered("SELECT level AS key, count(*) AS n FROM e GROUP BY 1")
def q_agg_level(e: DataFrame) -> DataFrame:
    return query.aggregate(e, "level")


@registered("SELECT template_text AS key, count(*) AS n FROM e GROUP BY 1")
def q_agg_template(e: DataFrame) -> DataFrame:
    return query.aggregate(e, "template")


@registered("SELECT source AS key, count(*) AS n FROM e GROUP BY 1")
def q_agg_source(e: DataFrame) -> DataFrame:
    return query.aggregate(e, "source")


@registered("SELECT coalesce(CASE WHEN k = '42' THEN NULL ELSE k END, '(none)') AS key, count(*) AS n FROM e GROUP BY 1")
def q_agg_missing_bucket(e: DataFrame) -> DataFrame:
    return query.aggregate(e.withColumn("fields", F.map_filter("fields", lambda _, v: v != "42")), "field:k")


@registered("SELECT source AS key, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, key LIMIT 5")
def q_topn(e: DataFrame) -> DataFrame:
    return query.top_n(query.aggregate(e, "source"), 5)


_HISTOGRAM = """, b AS (SELECT min(us) / 1e6 AS low, max(us) / 1e6 AS high FROM e), n AS (SELECT greatest(1, CAST(ceil((high - low) / 21600.0) AS BIGINT)) AS n, low FROM b),
  c AS (SELECT least(CAST(floor((us / 1e6 - low) / 21600.0) AS BIGINT), n - 1) AS bucket, count(*) AS n FROM e, n GROUP BY 1),
  h AS (SELECT g.bucket, low + g.bucket * 21600.0 AS start, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(n)) AS bucket, low FROM n) g LEFT JOIN c ON c.bucket = g.bucket)"""


@registered(f"{_HISTOGRAM} SELECT bucket, round(start, 3) AS start, n FROM h")
def q_histogram_zero_fill(e: DataFrame) -> DataFrame:
    return query.histogram(e, 21600.0).withColumn("start", F.round("start", 3))


@registered(f"""{_HISTOGRAM} SELECT bucket, n, repeat('█', CAST((n * 320 + peak) // (2 * peak) AS INT) // 8) ||
  ['', '▏', '▎', '▍', '▌', '▋', '▊', '▉'][1 + CAST((n * 320 + peak) // (2 * peak) AS INT) % 8] AS bar FROM h, (SELECT max(n) AS peak FROM h)""")
def q_histogram_bars(e: DataFrame) -> DataFrame:
    return query.bars(query.histogram(e, 21600.0)).select("bucket", "n", "bar")


@registered("SELECT seq, message FROM e WHERE level = 'error' ORDER BY seq DESC LIMIT 25")
def q_last_n(e: DataFrame) -> DataFrame:
    return query.last_n(query.execute(e, query.QuerySpec(level="error")), 25).select("seq", "message")


@registered("SELECT template_text AS key, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM e), 6) AS percent FROM e GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def q_summary(e: DataFrame) -> DataFrame:
    return query.summary(e)


# ---- index ----------------------------------------------------------------------------------


@registered("SELECT count(*) AS lines, 0::BIGINT AS unparsed, count(*) FILTER (WHERE level = 'error') AS errors, count(DISTINCT template_text) AS templates, arg_min(us, seq) AS first_us, arg_max(us, seq) AS last_us FROM e")
def i_totals(e: DataFrame) -> DataFrame:
    return query.totals(e).select("lines", "unparsed", "errors", "templates", micros(F.col("first_ts")).alias("first_us"), micros(F.col("last_ts")).alias("last_us"))


@registered("SELECT l AS level, count(e.seq) AS n, round(count(e.seq) * 100.0 / (SELECT count(*) FROM e), 6) AS percent FROM (SELECT unnest(['trace', 'debug', 'info', 'notice', 'warning', 'error', 'critical', '-']) AS l) LEFT JOIN e ON e.level = l GROUP BY 1")
def i_level_totals(e: DataFrame) -> DataFrame:
    return query.level_totals(e)


@registered("SELECT seq, source FROM e ORDER BY seq DESC LIMIT 1000")
def i_ring_newest(e: DataFrame) -> DataFrame:
    return query.last_n(e, 1000).select("seq", "source")


@registered("""SELECT template_text, minute, n FROM (SELECT template_text, us // 60000000 AS minute, count(*) AS n, row_number() OVER (PARTITION BY template_text ORDER BY us // 60000000 DESC) AS r FROM e GROUP BY 1, 2) WHERE r <= 60""")
def i_template_minutes(e: DataFrame) -> DataFrame:
    return query.template_minutes(e)


@registered("SELECT seq, left(message, 12) AS message, k FROM e")
def i_storage_caps(e: DataFrame) -> DataFrame:
    return query.capped(e, text=12).select("seq", "message", F.col("fields")["k"].alias("k"))


@registered("SELECT count(*) AS lines, count(*) AS parsed_ok, 0::BIGINT AS unparsed, count(*) FILTER (WHERE seq % 5 IN (1, 3)) AS truncated, count(*) FILTER (WHERE seq % 5 IN (2, 3)) AS invalid_utf8, count(*) FILTER (WHERE level = 'error') AS errors, greatest(count(*) - 100, 0) AS evicted FROM e")
def i_engine_counters(e: DataFrame) -> DataFrame:
    return query.engine_counters(e.withColumn("flags", (F.col("seq") % 5).cast("int")), ring=100)


@registered("SELECT us // 60000000 AS minute, count(*) AS n FROM e GROUP BY 1 ORDER BY 1 DESC LIMIT 120")
def i_volume_series(e: DataFrame) -> DataFrame:
    return query.minute_volume(e, 120)


@registered(f"""SELECT count(*) AS lines, 0::BIGINT AS unparsed, 0.0::DOUBLE AS unparsed_percent, round(count(*) FILTER (WHERE level = 'error') * 100.0 / count(*), 6) AS error_percent, count(DISTINCT template_text) AS templates,
  count(*) FILTER (WHERE value >= 200 AND us >= {int(SINCE)}000000 AND us < {int(UNTIL)}000000) AS alerts FROM e""")
def q_report(e: DataFrame) -> DataFrame:
    return query.report(e, e.filter("value >= 200").select((F.unix_micros("ts") / 1e6).alias("at")), SINCE, UNTIL)


@registered("SELECT us // 60000000 AS minute, count(*) AS n FROM e GROUP BY 1 ORDER BY 1 DESC LIMIT 180")
def i_minute_volume(e: DataFrame) -> DataFrame:
    return query.minute_volume(e)


@registered("SELECT avg(n) AS rate FROM (SELECT us // 1000000 AS s, count(*) AS n FROM e GROUP BY 1 ORDER BY 1 DESC LIMIT 121) WHERE s < (SELECT max(us) // 1000000 FROM e)")
def i_ingest_rate(e: DataFrame) -> DataFrame:
    return query.ingest_rate(e)


@registered(""", m AS (SELECT template_text, us // 60000000 AS minute, count(*) AS n FROM e GROUP BY ALL), l AS (SELECT template_text, arg_max(n, minute) AS rate_per_min FROM m GROUP BY 1)
  SELECT template_text, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM e), 6) AS share, any_value(rate_per_min) AS rate_per_min, arg_max(us, seq) AS last_us,
  round((SELECT count(*) * 100.0 FROM e WHERE level = 'error') / (SELECT count(*) FROM e), 6) AS error_percent, 0.0::DOUBLE AS unparsed_percent FROM e JOIN l USING (template_text) GROUP BY template_text ORDER BY count DESC, template_text LIMIT 12""")
def i_snapshot(e: DataFrame) -> DataFrame:
    return query.snapshot(e).withColumn("last_us", micros(F.col("last_seen"))).drop("last_seen")


# ---- statistics -------------------------------------------------------------------------


@registered("SELECT template_text, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM e GROUP BY 1")
def f_median_mad(e: DataFrame) -> DataFrame:
    middle = ordered.medians(e, "template_text", F.col("value"))
    apart = e.join(middle, "template_text").select("template_text", F.abs(F.col("value") - F.col("median")).alias("apart"))
    return middle.join(ordered.medians(apart, "template_text", F.col("apart"), "mad"), "template_text").select("template_text", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@registered("""SELECT seq, round((value - m) / greatest(1.4826 * abs(d), 1e-9), 6) AS z FROM e JOIN (SELECT source AS s, median(value) AS m, mad(value) AS d FROM e GROUP BY 1) ON s = source""")
def f_robust_z(e: DataFrame) -> DataFrame:
    middle = ordered.medians(e, "source", F.col("value"), "m")
    apart = e.join(middle, "source").select("source", F.abs(F.col("value") - F.col("m")).alias("apart"))
    spread = middle.join(ordered.medians(apart, "source", F.col("apart"), "d"), "source")
    return e.join(spread, "source").select("seq", F.round(stats.robust_z(F.col("value"), F.col("m"), F.col("d")), 6).alias("z"))


@registered("""SELECT source, round(CASE WHEN v <= 0 THEN 0 ELSE (k1 / n1 - k2 / n2) / sqrt(v) END, 6) AS z FROM (SELECT *, (k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2) AS v FROM (
  SELECT source, count(*) FILTER (WHERE level = 'error' AND seq % 2 = 0)::DOUBLE AS k1, count(*) FILTER (WHERE seq % 2 = 0)::DOUBLE AS n1, count(*) FILTER (WHERE level = 'error' AND seq % 2 = 1)::DOUBLE AS k2, count(*) FILTER (WHERE seq % 2 = 1)::DOUBLE AS n2 FROM e GROUP BY 1)) WHERE n1 > 0 AND n2 > 0""")
def f_two_proportion_z(e: DataFrame) -> DataFrame:
    error, even = F.col("level") == "error", F.col("seq") % 2 == 0
    g = e.groupBy("source").agg(F.count_if(error & even).alias("k1"), F.count_if(even).alias("n1"), F.count_if(error & ~even).alias("k2"), F.count_if(~even).alias("n2"))
    return g.select("source", F.round(stats.two_proportion_z(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2")), 6).alias("z")).dropna()


_MW = """g AS (SELECT {keys}, count(*) FILTER (WHERE recent) AS n1, count(*) FILTER (WHERE NOT recent) AS n2, sum(CASE WHEN recent THEN r ELSE 0 END) AS ranks, sum(t * t - 1) AS ties FROM (
    SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {keys}, value) AS t FROM s) GROUP BY {keys}),
  w AS (SELECT *, n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0))) AS v, ranks - n1 * (n1 + 1) / 2.0 AS uu FROM g WHERE n1 > 0 AND n2 > 0)"""


@registered(f", s AS (SELECT source, value, seq % 3 = 0 AS recent FROM e), {_MW.format(keys='source')} SELECT source, n1, n2, round(uu, 6) AS u, round(CASE WHEN v <= 0 THEN 0 ELSE (uu - n1 * n2 / 2.0) / sqrt(v) END, 6) AS z FROM w")
def f_mann_whitney(e: DataFrame) -> DataFrame:
    return detectors.mann_whitney(e.select("source", "value", (F.col("seq") % 3 == 0).alias("recent")), ["source"])


@registered("SELECT seq, CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'anomalous' WHEN value >= 50 THEN 'elevated' ELSE 'normal' END AS severity FROM e")
def f_severity(e: DataFrame) -> DataFrame:
    return e.select("seq", stats.severity(F.col("value"), 50.0, 100.0, 200.0).alias("severity"))


@registered("SELECT (isodow(ts) - 1) * 24 + hour(ts) AS slot, count(*) AS n FROM e GROUP BY 1")
def f_hour_of_week(e: DataFrame) -> DataFrame:
    return e.groupBy(stats.hour_of_week(F.col("ts")).alias("slot")).agg(F.count("*").alias("n"))


# ---- baselines ----------------------------------------------------------------------------------

_VOLUME = ", v AS (SELECT template_text, us // 3600000000 AS bucket, count(*) AS n FROM e GROUP BY 1, 2)"


@registered(f"""{_VOLUME}, r AS (SELECT template_text, (bucket + 72) % 168 AS slot, n, row_number() OVER (PARTITION BY template_text, (bucket + 72) % 168 ORDER BY bucket DESC) AS b FROM v)
  SELECT template_text, slot, round(median(n), 6) AS median, round(mad(n::DOUBLE), 6) AS mad, count(*) AS samples FROM r WHERE b <= 64 GROUP BY 1, 2""")
def b_volume_slot(e: DataFrame) -> DataFrame:
    return baselines.volume_baseline(baselines.hourly_volume(e)).select("template_text", "slot", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.col("samples").cast("long").alias("samples"))


def _intervals(e: DataFrame) -> DataFrame:
    return e.filter("value > 300").select((F.floor(F.unix_micros("ts") / 3_600_000_000) - 1).alias("start"), (F.floor(F.unix_micros("ts") / 3_600_000_000) + 2).alias("end")).distinct()


_INTERVALS = """, x AS (SELECT DISTINCT us // 3600000000 - 1 AS s, us // 3600000000 + 2 AS t FROM e WHERE value > 300),
  m AS (SELECT min(s) AS "start", max(t) AS "end" FROM (SELECT s, t, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (ORDER BY s, t) AS island FROM (SELECT s, t, max(t) OVER (ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)) GROUP BY island)"""


@registered(f'{_INTERVALS} SELECT "start", "end" FROM m')
def b_exclusion_merge(e: DataFrame) -> DataFrame:
    return baselines.merged_intervals(_intervals(e))


@registered(f'{_VOLUME}{_INTERVALS} SELECT template_text, bucket, n FROM v WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM m ORDER BY "end" DESC LIMIT 100) f WHERE bucket >= f."start" AND bucket < f."end")')
def b_exclusion_anti(e: DataFrame) -> DataFrame:
    return baselines.excluded(baselines.hourly_volume(e), baselines.merged_intervals(_intervals(e)))


@registered("""SELECT round(least((SELECT min(us) FROM e WHERE us >= (SELECT min(us) FROM e) + 86400000000), (SELECT tm FROM (SELECT min(us) AS tm, row_number() OVER (ORDER BY min(us)) AS r FROM e GROUP BY (isodow(ts) - 1) * 24 + hour(ts)) WHERE r = 24)) / 1e6, 3) AS warm_at""")
def b_warmup(e: DataFrame) -> DataFrame:
    return baselines.warmed_up_at(e, 86400.0).select(F.round("warm_at", 3).alias("warm_at"))


# ---- detectors --------------------------------------------------------------------------------


def _bands(z: str, a: float, b: float, c: float) -> str:
    return f"CASE WHEN {z} >= {c} THEN 'critical' WHEN {z} >= {b} THEN 'anomalous' WHEN {z} >= {a} THEN 'elevated' ELSE 'normal' END"


_LADDER = """, h AS (SELECT *, list_sort(list(n) OVER (PARTITION BY template_text, bucket % 24 ORDER BY bucket ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)) AS l,
    {weeks} OVER (PARTITION BY template_text, (bucket + 72) % 168 ORDER BY bucket ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS w FROM {volumes}),
  g AS (SELECT *, list_aggregate(w, 'median') AS wm, l[len(l) // 2 + 1]::DOUBLE AS hi, l[(len(l) - 1) // 2 + 1]::DOUBLE AS lo, coalesce(len(w), 0) >= 3 AS weekly FROM h),
  s AS (SELECT template_text, bucket, n, CASE WHEN weekly THEN wm ELSE hi END AS expected, CASE WHEN weekly THEN greatest(list_aggregate(list_transform(w, lambda x: abs(x - wm)), 'median'), wm * 0.05) ELSE greatest(hi - lo, hi * 0.5) END AS spread, CASE WHEN weekly THEN 'week' ELSE 'day' END AS basis FROM g WHERE weekly OR len(l) > 0),
  z AS (SELECT template_text, bucket, n, expected, round((n - expected) / greatest(1.4826 * greatest(spread, sqrt(expected), 2.0), 1e-9), 6) AS z, basis FROM s)
  SELECT *, CASE WHEN n >= 5 THEN {bands} ELSE 'normal' END AS severity FROM z"""


@registered(_VOLUME + _LADDER.format(weeks="list(n)", volumes="v", bands=_bands("z", 4, 6, 10)))
def d_volume_hour_of_day(e: DataFrame) -> DataFrame:
    return detectors.volume(e)


@registered(""", q AS (SELECT *, us // 3600000000 AS bucket, CASE WHEN seq % 50 = 0 THEN seq + 400 ELSE seq END AS place FROM e),
  v AS (SELECT template_text, bucket, count(*) AS n FROM (SELECT *, max(bucket) OVER (ORDER BY place, seq) AS latest FROM q) WHERE bucket >= latest GROUP BY ALL)"""
            + _LADDER.format(weeks="list(n)", volumes="v", bands=_bands("z", 4, 6, 10)))
def d_volume_on_time(e: DataFrame) -> DataFrame:
    """Every fiftieth event comes 400 places late; those whose hour is over then don't count."""
    place = F.struct(F.when(F.col("seq") % 50 == 0, F.col("seq") + 400).otherwise(F.col("seq")), "seq")
    return detectors.volume(baselines.on_time(e.withColumn("seq", place)))


@registered(f"{_VOLUME}{_INTERVALS}, y AS (SELECT *, EXISTS (SELECT 1 FROM (SELECT * FROM m ORDER BY \"end\" DESC LIMIT 100) f WHERE bucket >= f.\"start\" AND bucket < f.\"end\") AS gone FROM v)"
            + _LADDER.format(weeks="list(n) FILTER (WHERE NOT gone)", volumes="y", bands=_bands("z", 4, 6, 10)))
def d_volume_exclusions(e: DataFrame) -> DataFrame:
    """Hours of excluded spans are scored but are no part of the hour-of-week baselines."""
    return detectors.volume(e, exclusions=baselines.merged_intervals(_intervals(e)))


@registered(f""", v AS (SELECT us // 3600000000 AS bucket, count(*) AS n FROM e GROUP BY 1),
  h AS (SELECT *, list(n) OVER (PARTITION BY (bucket + 72) % 168 ORDER BY bucket ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS l FROM v),
  s AS (SELECT bucket, n, list_aggregate(l, 'median') AS median, list_aggregate(list_transform(l, lambda x: abs(x - list_aggregate(l, 'median'))), 'median') AS mad FROM h WHERE len(l) >= 3),
  z AS (SELECT *, round((n - median) / greatest(1.4826 * greatest(mad, median * 0.05, sqrt(median), 2.0), 1e-9), 6) AS z FROM s) SELECT *, CASE WHEN n >= 5 THEN {_bands('z', 4, 6, 10)} ELSE 'normal' END AS severity FROM z""")
def d_volume_global(e: DataFrame) -> DataFrame:
    return detectors.volume_global(e)


_SPARSE = DetectorConfig(error_window_s=21600, error_baseline_s=108000, error_min_total=5, error_min_errors=1, error_bands=(1.0, 2.0, 3.0), silence_min_count=20, silence_factor=4.0, silence_min_missed=4.0, novel_window_s=864000.0, gram_gap_s=7200.0, gram_baseline=2, gram_min=3, error_tick_s=3600, shift_bands=(1.0, 2.0, 3.0), shift_cooldown_s=86400.0, shift_rebound_s=259200.0,
                         silence_check_s=1800.0, silence_peers=3, silence_peer_share=0.5, gram_window_s=864000.0, gram_cooldown_s=172800.0)
_WARM = 1704672000.0  # 2024-01-08


@registered(f""", c AS (SELECT us // 21600000000 * 21600 AS start, count(*) AS total, count(*) FILTER (WHERE level = 'error') AS errors FROM e GROUP BY 1),
  w AS (SELECT g.start, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors FROM (SELECT unnest(range(min(start), max(start) + 1, 21600)) AS start FROM c) g LEFT JOIN c ON c.start = g.start),
  b AS (SELECT *, sum(total) OVER p AS base_total, sum(errors) OVER p AS base_errors FROM w WINDOW p AS (ORDER BY start RANGE BETWEEN 108000 PRECEDING AND 1 PRECEDING)),
  v AS (SELECT *, (errors + base_errors) / (total + base_total)::DOUBLE AS p FROM b WHERE total >= 5 AND base_total >= 5 AND base_errors >= 1),
  z AS (SELECT start, total, errors, base_total::BIGINT AS base_total, base_errors::BIGINT AS base_errors, round(CASE WHEN p * (1 - p) <= 0 THEN 0 ELSE (errors / total::DOUBLE - base_errors / base_total::DOUBLE) / sqrt(p * (1 - p) * (1.0 / total + 1.0 / base_total)) END, 6) AS z FROM v)
  SELECT *, {_bands('z', 1, 2, 3)} AS severity FROM z""")
def d_error_rate(e: DataFrame) -> DataFrame:
    return detectors.error_rate(e, _SPARSE)


@registered(f""", b AS (SELECT event_type AS key, value, (row_number() OVER (PARTITION BY event_type ORDER BY seq) - 1) // 30 AS o FROM e),
  f AS (SELECT key, o AS block FROM b GROUP BY 1, 2 HAVING count(*) = 30 AND o > 0), s AS (SELECT b.key, block, value, o = block AS recent FROM b JOIN f ON b.key = f.key AND o BETWEEN block - 3 AND block),
  {_MW.format(keys='key, block')}, z AS (SELECT key, block, n1, n2, round(uu, 6) AS u, round(CASE WHEN v <= 0 THEN 0 ELSE (uu - n1 * n2 / 2.0) / sqrt(v) END, 6) AS z FROM w) SELECT *, {_bands('abs(z)', 3.5, 5, 9)} AS severity FROM z""")
def d_numeric_shift(e: DataFrame) -> DataFrame:
    return detectors.numeric_shift(e.select(F.col("event_type").alias("key"), "seq", "value"))


@registered(f""", h AS (SELECT (min(us) + max(us)) // 2 AS mid FROM e), o AS (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY us DESC, value DESC) AS r FROM e, h WHERE us < mid),
  b AS (SELECT event_type AS key, value, (row_number() OVER (PARTITION BY event_type ORDER BY seq) - 1) // 30 AS o FROM e, h WHERE us >= mid),
  f AS (SELECT key, o AS block FROM b GROUP BY 1, 2 HAVING count(*) = 30),
  s AS (SELECT b.key, block, value, o = block AS recent FROM b JOIN f ON b.key = f.key AND block > 0 AND o BETWEEN block - 3 AND block
    UNION ALL SELECT key, 0, value, true FROM b WHERE o = 0 AND key IN (SELECT key FROM f WHERE block = 0) AND key IN (SELECT key FROM o GROUP BY 1 HAVING count(*) >= 30)
    UNION ALL SELECT key, 0, value, false FROM o WHERE r <= 98 AND key IN (SELECT key FROM f WHERE block = 0) AND key IN (SELECT key FROM o GROUP BY 1 HAVING count(*) >= 30)),
  {_MW.format(keys='key, block')}, z AS (SELECT key, block, n1, n2, round(uu, 6) AS u, round(CASE WHEN v <= 0 THEN 0 ELSE (uu - n1 * n2 / 2.0) / sqrt(v) END, 6) AS z FROM w) SELECT *, {_bands('abs(z)', 3.5, 5, 9)} AS severity FROM z""")
def d_numeric_shift_resumed(e: DataFrame) -> DataFrame:
    """The later half of the time, whose first blocks are held against the samples that the earlier half has left in the state."""
    early, late = _halves(e)
    rows = lambda part: part.select(F.col("event_type").alias("key"), "seq", (F.unix_micros("ts") / 1e6).alias("at"), "value")
    kept = state.trimmed(state.numeric_state(rows(early))).select("key", "at", "value")
    return detectors.numeric_shift(rows(late).select("key", "seq", "value"), saved=kept)


def _halves(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    mid = e.agg(F.floor((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2).alias("_mid"))
    both = e.join(F.broadcast(mid))
    early = F.unix_micros("ts") < F.col("_mid")
    return both.filter(early).drop("_mid"), both.filter(~early).drop("_mid")


@registered(f""", h AS (SELECT (min(us) + max(us)) // 2 AS mid FROM e), c AS (SELECT us // 21600000000 * 21600 AS start, us >= mid AS late, count(*) AS total, count(*) FILTER (WHERE level = 'error') AS errors FROM e, h GROUP BY ALL),
  m AS (SELECT start, max(total) AS total, arg_max(errors, total) AS errors, bool_or(late) AS late FROM c GROUP BY 1),
  b AS (SELECT *, sum(total) OVER p AS base_total, sum(errors) OVER p AS base_errors FROM m WINDOW p AS (ORDER BY start RANGE BETWEEN 108000 PRECEDING AND 1 PRECEDING)),
  v AS (SELECT *, (errors + base_errors) / (total + base_total)::DOUBLE AS p FROM b WHERE late AND total >= 5 AND base_total >= 5 AND base_errors >= 1),
  z AS (SELECT start, total, errors, base_total::BIGINT AS base_total, base_errors::BIGINT AS base_errors, round(CASE WHEN p * (1 - p) <= 0 THEN 0 ELSE (errors / total::DOUBLE - base_errors / base_total::DOUBLE) / sqrt(p * (1 - p) * (1.0 / total + 1.0 / base_total)) END, 6) AS z FROM v)
  SELECT *, {_bands('z', 1, 2, 3)} AS severity FROM z""")
def d_error_rate_resumed(e: DataFrame) -> DataFrame:
    """The later half of the time, whose first windows are held against those that the earlier half has left in the state."""
    early, late = _halves(e)
    kept = state.trimmed(state.error_state(detectors.seen_windows(early, _SPARSE.error_window_s)))
    return detectors.error_rate(late, _SPARSE, kept.select(F.col("at").alias("start"), F.col("value").alias("total"), F.col("more").alias("errors")))


def _novel(e: DataFrame) -> DataFrame:
    """Templates of their own for users, so that some appear late."""
    return e.withColumn("template_text", F.concat_ws(" ", "event_type", F.lit("user"), "user_id"))


@registered(f""", t AS (SELECT *, event_type || ' user ' || user_id AS tt FROM e), f AS (SELECT tt, min(us) AS f FROM t GROUP BY 1 HAVING min(us) > {int(_WARM)}000000),
  c AS (SELECT t.tt AS template_text, round(f / 1e6, 3) AS first_at, count(*) AS n FROM t JOIN f ON t.tt = f.tt AND us <= f + 864000000000 GROUP BY 1, f) SELECT *, CASE WHEN n >= 20 THEN 'anomalous' ELSE 'elevated' END AS severity FROM c WHERE n >= 2""")
def d_new_template(e: DataFrame) -> DataFrame:
    return detectors.new_templates(_novel(e), _WARM, _SPARSE).withColumn("first_at", F.round("first_at", 3))


@registered(f""", r AS (SELECT template_text, seq, us / 1e6 AS tm, row_number() OVER w AS seen, min(us / 1e6) OVER (PARTITION BY template_text ORDER BY seq) AS f, lead(us / 1e6) OVER w AS nx, (SELECT max(us) / 1e6 FROM e) AS en FROM e WINDOW w AS (PARTITION BY template_text ORDER BY seq)),
  g AS (SELECT template_text, seq, seen, coalesce(nx, en) - tm AS gap, (tm - f) / (seen - 1) AS iv FROM r WHERE seen >= 20)
  SELECT template_text, seq, seen, round(gap, 6) AS gap, round(iv, 6) AS interval, {_bands('round(gap, 6) / round(iv, 6)', 10, 25, 50)} AS severity FROM g WHERE gap > 4 * iv AND gap >= 4 * iv""")
def d_stopped_template(e: DataFrame) -> DataFrame:
    return detectors.stopped_templates(e, _SPARSE)


@registered(f""", r AS (SELECT source, seq, us / 1e6 AS tm, template_text AS c, lag(template_text, 2) OVER w AS a, lag(template_text) OVER w AS b, lag(us / 1e6, 2) OVER w AS t0, lag(us / 1e6) OVER w AS t1 FROM e WINDOW w AS (PARTITION BY source ORDER BY seq)),
  k AS (SELECT a, b, c, count(*) AS n FROM r WHERE a IS NOT NULL AND tm <= {_WARM} GROUP BY ALL), l AS (SELECT a, b, c, count(*) AS n, min(seq) AS first_seq FROM r WHERE a IS NOT NULL AND tm > {_WARM} AND tm - t1 <= 7200 AND t1 - t0 <= 7200 AND a <> b AND b <> c AND a <> c GROUP BY ALL)
  SELECT l.a, l.b, l.c, l.n, first_seq, coalesce(k.n, 0) AS baseline FROM l LEFT JOIN k USING (a, b, c) WHERE coalesce(k.n, 0) <= 2 AND l.n >= 3""")
def d_rare_sequences(e: DataFrame) -> DataFrame:
    return detectors.rare_sequences(e, _WARM, _SPARSE)


@registered(f""", t AS (SELECT *, event_type || (user_id % 3) AS tt FROM e),
  r AS (SELECT source, seq, us / 1e6 AS tm, tt AS c, lag(tt, 2) OVER w AS a, lag(tt) OVER w AS b, lag(us / 1e6, 2) OVER w AS t0, lag(us / 1e6) OVER w AS t1 FROM t WINDOW w AS (PARTITION BY source ORDER BY seq)),
  k AS (SELECT a, b, c, count(*) AS n FROM r WHERE a IS NOT NULL AND tm <= 1704153600 GROUP BY ALL), l AS (SELECT a, b, c, count(*) AS n, min(seq) AS first_seq FROM r WHERE a IS NOT NULL AND tm > 1704153600 AND tm - t1 <= 604800 AND t1 - t0 <= 604800 AND a <> b AND b <> c AND a <> c GROUP BY ALL)
  SELECT l.a, l.b, l.c, l.n, first_seq, coalesce(k.n, 0) AS baseline FROM l LEFT JOIN k USING (a, b, c) WHERE coalesce(k.n, 0) <= 2 AND l.n >= 2""")
def d_rare_sequences_often(e: DataFrame) -> DataFrame:
    """A short warm-up and many templates: most triples are rare in it and come back."""
    rare = dataclasses.replace(_SPARSE, gram_gap_s=604_800.0, gram_min=2)
    return detectors.rare_sequences(e.withColumn("template_text", F.concat("event_type", (F.col("user_id") % 3).cast("string"))), 1704153600.0, rare)


@registered(f""", t AS (SELECT us // 21600000000 * 21600 AS start, least(((us % 21600000000) // 3600000000 + 1) * 3600, 21600) AS after, count(*) AS n, count(*) FILTER (WHERE level = 'error') AS k FROM e GROUP BY ALL),
  c AS (SELECT start, after, sum(n) OVER w AS total, sum(k) OVER w AS errors FROM t WINDOW w AS (PARTITION BY start ORDER BY after)),
  b AS (SELECT start, sum(n) OVER p AS bt, sum(k) OVER p AS be FROM (SELECT start, sum(n) AS n, sum(k) AS k FROM t GROUP BY 1) WINDOW p AS (ORDER BY start RANGE BETWEEN 108000 PRECEDING AND 1 PRECEDING)),
  v AS (SELECT *, (errors + be) / (total + bt)::DOUBLE AS p FROM c JOIN b USING (start) WHERE total >= 5 AND bt >= 5 AND be >= 1),
  z AS (SELECT *, round(CASE WHEN p * (1 - p) <= 0 THEN 0 ELSE (errors / total::DOUBLE - be / bt::DOUBLE) / sqrt(p * (1 - p) * (1.0 / total + 1.0 / bt)) END, 6) AS z FROM v),
  f AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY after) AS r FROM z WHERE z >= 1)
  SELECT start, after, total::BIGINT AS total, errors::BIGINT AS errors, bt::BIGINT AS base_total, be::BIGINT AS base_errors, z, {_bands('z', 1, 2, 3)} AS severity FROM f WHERE r = 1""")
def d_error_alerts(e: DataFrame) -> DataFrame:
    return detectors.error_alerts(e, _SPARSE)


@registered(f""", r AS (SELECT template_text, seq, us / 1e6 AS tm, row_number() OVER w AS seen, min(us / 1e6) OVER (PARTITION BY template_text ORDER BY seq) AS f, lead(us / 1e6) OVER w AS nx FROM e WINDOW w AS (PARTITION BY template_text ORDER BY seq)),
  x AS (SELECT min(us) / 1e6 AS s, max(us) / 1e6 AS t FROM e),
  g AS (SELECT template_text, seq, seen, tm, (tm - f) / seen AS iv, coalesce(nx, t) AS til, s FROM r, x WHERE seen >= 20 AND tm > f),
  h AS (SELECT *, tm + iv * 4.0 * 0.5 AS half FROM g WHERE coalesce(til, 0) > tm + iv * 4.0 * 0.5),
  n AS (SELECT *, s + (floor((tm + iv * 4.0 - s) / 1800.0) + 1) * 1800.0 AS chk FROM h),
  q AS (SELECT n.template_text, n.seq, n.seen, n.tm, n.iv, n.chk, (SELECT count(*) FROM g WHERE g.seen = 20 AND g.tm < n.chk) AS peers,
    (SELECT count(*) FROM h WHERE h.half < n.chk AND h.til >= n.chk) AS silent FROM n WHERE n.chk <= n.til)
  SELECT template_text, seq, seen, round(chk, 3) AS "check", round((chk - tm) / iv, 6) AS ratio, peers, silent, {_bands('round((chk - tm) / iv, 6)', 10, 25, 50)} AS severity FROM q WHERE NOT (peers > 3 AND silent / peers > 0.5)""")
def d_stopped_alerts(e: DataFrame) -> DataFrame:
    return detectors.stopped_alerts(e, _SPARSE)


@registered(f""", r AS (SELECT template_text, seq, us / 1e6 AS tm, row_number() OVER w AS seen, min(us / 1e6) OVER (PARTITION BY template_text ORDER BY seq) AS f, lead(us / 1e6) OVER w AS nx FROM t WINDOW w AS (PARTITION BY template_text ORDER BY seq)),
  x AS (SELECT min(us) / 1e6 AS s, max(us) / 1e6 AS t FROM e),
  v AS (SELECT template_text, us // 3600000000 AS bucket, count(*) AS n FROM t GROUP BY ALL),
  g AS (SELECT template_text, seq, seen, tm, (tm - f) / seen AS iv, coalesce(nx, t) AS til, s FROM r, x WHERE seen >= 20 AND tm > f),
  h AS (SELECT *, tm + iv * 4.0 * 0.5 AS half FROM g WHERE til > tm + iv * 4.0 * 0.5),
  c AS (SELECT *, unnest(range(floor(tm / 3600)::BIGINT, floor(til / 3600)::BIGINT + 1)) AS hr FROM g WHERE til - tm >= 1800),
  d AS (SELECT *, (SELECT median(n) FROM v WHERE v.template_text = c.template_text AND (v.bucket - hr) % 168 = 0 AND v.bucket < hr) AS m1,
    (SELECT median(n) FROM v WHERE v.template_text = c.template_text AND (v.bucket - floor(tm / 3600)::BIGINT) % 168 = 0 AND v.bucket < hr) AS m2 FROM c),
  i AS (SELECT *, coalesce(3600.0 / coalesce(m1, m2), iv) AS held FROM d),
  j AS (SELECT *, greatest(s + (floor((tm + held * 4.0 - s) / 1800.0) + 1) * 1800.0, s + ceil((hr * 3600.0 - s) / 1800.0) * 1800.0) AS chk FROM i),
  n AS (SELECT template_text, seq, any_value(seen) AS seen, any_value(tm) AS tm, min(chk) AS chk, arg_min(held, chk) AS held FROM j WHERE chk <= til AND chk < (hr + 1) * 3600.0 GROUP BY ALL),
  q AS (SELECT n.*, (SELECT count(*) FROM g WHERE g.seen = 20 AND g.tm < n.chk) AS peers, (SELECT count(*) FROM h WHERE h.half < n.chk AND h.til >= n.chk) AS silent FROM n)
  SELECT template_text, seq, seen, round(chk, 3) AS "check", round((chk - tm) / held, 6) AS ratio, peers, silent, {_bands('round((chk - tm) / held, 6)', 10, 25, 50)} AS severity FROM q WHERE NOT (peers > 3 AND silent / peers > 0.5)""".replace(", r AS (SELECT template_text", ", t AS (SELECT * REPLACE (event_type AS template_text) FROM e), r AS (SELECT template_text", 1))
def d_stopped_by_slot(e: DataFrame) -> DataFrame:
    """Silences held against the median of the hour of the week at the check, else at the last sighting, else the mean rate."""
    return detectors.stopped_alerts(e.withColumn("template_text", F.col("event_type")), _SPARSE, by_slot=True)


@registered()
def d_shift_alerts(e: DataFrame) -> DataFrame:
    """Cooldown and rebound depend on the alert before; tests hold them against a plain loop."""
    return detectors.shift_alerts(e.select(F.col("event_type").alias("key"), "seq", (F.unix_micros("ts") / 1e6).alias("at"), "value"), _SPARSE)


@registered()
def d_rare_sequence_alerts(e: DataFrame) -> DataFrame:
    """Cooldown and hourly cap depend on the alert before; tests hold them against a plain loop."""
    return detectors.rare_sequence_alerts(e, _WARM, _SPARSE)


# ---- lines, assembly, parsing -------------------------------------------------------------------


def _rendered(e: DataFrame, line: Column) -> DataFrame:
    return e.select("seq", "source", line.alias("text"))


_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _parsed(e: DataFrame, line: Column, name: str, custom: str | None = None, **columns: Column) -> DataFrame:
    parser = next(p for p in parsers.registry(2024, custom) if p.name == name)
    rows = parsers.parse_lines(_rendered(e, line), [parser]).filter("parser is not null")
    return rows.select("seq", micros(F.col("ts")).alias("us"), "level", "message", *[c.alias(n) for n, c in columns.items()])


@registered("SELECT seq, us, level, message, user_id::VARCHAR AS user, value FROM e")
def p_json(e: DataFrame) -> DataFrame:
    line = F.to_json(F.struct(F.date_format("ts", _STAMP).alias("timestamp"), F.upper("level").alias("Level"), F.col("message").alias("msg"), F.struct("user_id", "value").alias("req")))
    return _parsed(e, line, "json", user=F.col("fields")["req.user_id"], value=F.col("numeric")["req.value"])


@registered("SELECT seq, us, level, message, user_id::VARCHAR AS user, value FROM e")
def p_logfmt(e: DataFrame) -> DataFrame:
    line = F.concat(F.lit("ts="), F.date_format("ts", _STAMP), F.lit(" level="), F.upper("level"), F.lit(' msg="'), "message", F.lit('" user='), "user_id", F.lit(" value="), "value")
    return _parsed(e, line, "logfmt", user=F.col("fields")["user"], value=F.col("numeric")["value"])


@registered("SELECT seq, us // 1000000 * 1000000 AS us, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' END AS level, 'GET /' || event_type || ' HTTP/1.1' AS message, '/' || event_type AS path, user_id::DOUBLE AS bytes FROM e")
def p_access(e: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "503").when(F.col("event_type") == "purchase", "404").otherwise("200")
    line = F.concat(F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'"), F.lit('] "GET /'), "event_type", F.lit(' HTTP/1.1" '), status, F.lit(" "), "user_id", F.lit(' "-" "agent" 0.25'))
    return _parsed(e, line, "access_combined", path=F.col("fields")["path"], bytes=F.col("numeric")["bytes"])


@registered("SELECT seq, us, CASE user_id % 8 WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' WHEN 7 THEN 'debug' ELSE 'critical' END AS level, message, event_type AS program, user_id::DOUBLE AS pid FROM e")
def p_syslog5424(e: DataFrame) -> DataFrame:
    line = F.concat(F.lit("<"), F.col("user_id") % 8 + 16, F.lit(">1 "), F.date_format("ts", _STAMP), F.lit(" host "), "event_type", F.lit(" "), "user_id", F.lit(" - - "), "message")
    return _parsed(e, line, "syslog", program=F.col("fields")["program"], pid=F.col("numeric")["pid"])


@registered("SELECT seq, us // 1000000 * 1000000 AS us, NULL::VARCHAR AS level, message, event_type AS program, user_id::VARCHAR AS pid FROM e")
def p_syslog3164(e: DataFrame) -> DataFrame:
    line = F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host "), "event_type", F.lit("["), "user_id", F.lit("]: "), "message")
    return _parsed(e, line, "syslog", program=F.col("fields")["program"], pid=F.col("fields")["pid"])


@registered("SELECT seq, us, level, message, source AS component FROM e")
def p_custom(e: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.date_format("ts", _STAMP), F.lit("] "), F.upper("level"), F.lit(" "), "source", F.lit(": "), "message")
    return _parsed(e, line, "custom", r"\[(?P<ts>[^\]]+)\] (?P<level>[A-Z]+) (?P<component>[\w-]+): (?P<message>.*)", component=F.col("fields")["component"])


@registered("SELECT seq, us // 1000000 * 1000000 AS us, 'debug' AS level, event_type AS message, value::VARCHAR AS plain, user_id AS n, '{\"a\":[1,\"x\"],\"b\":' || user_id || '}' AS deep, 3 AS fields, 1 AS numbers FROM e")
def p_json_ranks(e: DataFrame) -> DataFrame:
    """`time` before `ts`, `event` before `text`, keys without case, numbers apart from their spellings, sorted compact objects, no nulls."""
    line = F.concat(F.lit('  {"ts":1,"time":'), F.unix_seconds("ts"), F.lit(',"text":"no","Event":"'), "event_type", F.lit('","LVL":"dbg","s":"'), "value", F.lit('","N":'), "user_id", F.lit(',"o":{"d":{"b":'), "user_id", F.lit(',"a":[1,"x"]},"z":null},"y":null}  '))
    fields = F.col("fields")
    return _parsed(e, line, "json", plain=fields["s"], n=F.col("numeric")["N"].cast("long"), deep=fields["o.d"], fields=F.size(fields), numbers=F.size("numeric"))


@registered("""SELECT seq, us, 'debug' AS level, 'it''s ' || event_type || ' "x"' AS message, 'a' || chr(9) || 'b\\' AS tabbed, NULL::VARCHAR AS bad, value AS n, 3 AS fields FROM e""")
def p_logfmt_quotes(e: DataFrame) -> DataFrame:
    """Single quotes, escapes, the first of several messages and the last of other keys, ill-formed values, empty ones."""
    line = F.concat(F.lit("eventtime="), F.date_format("ts", _STAMP), F.lit(" LVL=DBG msg='it\\'s "), "event_type", F.lit(' \\"x\\"\' text=no a.b="a\\tb\\\\" n=1 n='), "value", F.lit(' empty= ok=1 bad="open'))
    fields = F.col("fields")
    return _parsed(e, line, "logfmt", tabbed=fields["a.b"], bad=fields["bad"], n=F.col("numeric")["n"], fields=F.size(fields))


@registered("SELECT seq, us // 1000000 * 1000000 - 7200000000 AS us, NULL::VARCHAR AS level, '' AS message, '-' AS method, '-' AS referer, 1 AS numbers, 10 AS fields FROM e")
def p_access_dashes(e: DataFrame) -> DataFrame:
    """A request time and size of '-', an empty request, an offset, blanks at the ends."""
    line = F.concat(F.lit("  10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0200'"), F.lit('] "" 200 - "" "agent" -  '))
    fields = F.col("fields")
    return _parsed(e, line, "access_combined", method=fields["method"], referer=fields["referer"], numbers=F.size("numeric"), fields=F.size(fields))


@registered("""SELECT seq, CASE seq % 3 WHEN 0 THEN us WHEN 1 THEN us // 1000000 * 1000000 END AS us, CASE seq % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'critical' END AS level,
  CASE seq % 3 WHEN 2 THEN '' ELSE message END AS message, CASE seq % 3 WHEN 1 THEN NULL ELSE user_id::DOUBLE END AS pid FROM e""")
def p_syslog_variants(e: DataFrame) -> DataFrame:
    """Another version with structured data, a classic line with a priority, no time, no message and a priority out of range."""
    line = (
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit("<11>2 "), F.date_format("ts", _STAMP), F.lit(" host app "), "user_id", F.lit(' ID [x@1 a="b"] '), "message"))
        .when(F.col("seq") % 3 == 1, F.concat(F.lit("<0>"), F.lower(F.date_format("ts", "MMM d HH:mm:ss")), F.lit(" host app: "), "message"))
        .otherwise(F.concat(F.lit("<999>1 - host app "), "user_id", F.lit(" - -")))
    )
    return _parsed(e, line, "syslog", pid=F.col("numeric")["pid"])


@registered("""SELECT CASE seq % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'logfmt' WHEN 2 THEN 'access_combined' WHEN 3 THEN 'syslog' WHEN 4 THEN 'closest access_combined 0.20' ELSE 'none' END AS verdict, count(*) AS n FROM e GROUP BY 1""")
def p_errors(e: DataFrame) -> DataFrame:
    """Who complains about broken lines; lines that nobody complains about name the closest format."""
    part = lambda i: F.col("seq") % 6 == i
    line = F.when(part(0), F.concat(F.lit('{"msg": "'), "message")).when(part(1), F.concat(F.lit("9bad="), "user_id")).when(part(2), F.concat(F.lit('"GET /'), "user_id", F.lit('" 200')))
    line = line.when(part(3), "Oct 99 25:00:00 h p[1]: m").when(part(4), "").otherwise(F.col("message"))
    rows = _rendered(e, line)
    parsed = parsers.parse_lines(rows.filter("seq % 6 <> 4"), parsers.registry(2024))
    # Without the parser that would complain, its score alone tells what the line is like.
    quiet = [dataclasses.replace(p, complaint=lambda *_: F.lit(None).cast("string")) for p in parsers.registry(2024)]
    parsed = parsed.unionByName(parsers.parse_lines(rows.filter("seq % 6 = 4").withColumn("text", F.lit('"GET /x" 200 .')), quiet))
    error = F.col("parse_error")
    verdict = F.when(error.contains("closest"), F.concat_ws(" ", F.lit("closest"), F.regexp_extract(error, r"is (\w+) ", 1), F.regexp_extract(error, r"\((.*)\)", 1)))
    verdict = verdict.when(error.startswith("no parser"), "none").otherwise(F.regexp_extract(error, r"^(\w+):", 1))
    return parsed.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@registered("SELECT CASE seq % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'logfmt' ELSE 'unparsed' END AS parser, count(*) AS n FROM e GROUP BY 1")
def p_fallthrough(e: DataFrame) -> DataFrame:
    line = F.when(F.col("seq") % 3 == 0, F.to_json(F.struct(F.col("message").alias("msg")))).when(F.col("seq") % 3 == 1, F.concat(F.lit('msg="'), "message", F.lit('"'))).otherwise(F.col("message"))
    parsed = parsers.parse_lines(_rendered(e, line), parsers.registry(2024))
    return parsed.groupBy(F.coalesce("parser", "parse_status").alias("parser")).agg(F.count("*").alias("n"))


@registered("SELECT seq, level FROM e")
def p_levels(e: DataFrame) -> DataFrame:
    spelled = F.when(F.col("level") == "error", " ERR ").when(F.col("level") == "warning", "Warn").when(F.col("level") == "info", "information").otherwise(F.col("level"))
    return e.select("seq", text.level_of(spelled).alias("level"))


@registered("SELECT seq, CASE seq % 4 WHEN 0 THEN us WHEN 1 THEN us // 1000 * 1000 ELSE us // 1000000 * 1000000 END AS us FROM e")
def p_timestamps(e: DataFrame) -> DataFrame:
    spelled = F.when(F.col("seq") % 4 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSSSSS")).when(F.col("seq") % 4 == 1, F.unix_millis("ts").cast("string")).when(F.col("seq") % 4 == 2, F.unix_seconds("ts").cast("string")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    return e.select("seq", micros(text.timestamp_of(spelled)).alias("us"))


_LINES = """WITH l AS (SELECT 'doc-' || doc_id AS source, unnest(range(len(s))) AS seq, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"""


def _document_lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.lit("doc-"), "doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).withColumn("text", F.when(F.col("seq") % 3 == 2, F.concat(F.lit("  "), "text")).otherwise(F.col("text")))


@on_table("documents", f"""{_LINES}, i AS (SELECT source, seq, CASE WHEN seq % 3 = 2 THEN '  ' || text ELSE text END AS text FROM l), n AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^[ \\t]') THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY seq) AS ev FROM i)
  SELECT source, min(seq) AS seq, string_agg(text, chr(10) ORDER BY seq) AS text, count(*) AS n_lines FROM n GROUP BY source, ev""")
def a_assemble(docs: DataFrame) -> DataFrame:
    return assemble(_document_lines(docs), (indented,)).withColumn("seq", F.col("seq").cast("long"))


@on_table("documents", f"""{_LINES}, n AS (SELECT *, CASE WHEN seq = 0 THEN 0 ELSE seq // 4 END AS part FROM l) SELECT source, min(seq) AS seq, count(*) AS n_lines FROM n GROUP BY source, part""")
def a_line_cap(docs: DataFrame) -> DataFrame:
    lines = _document_lines(docs).withColumn("text", F.concat(F.lit(" "), "text"))
    return assemble(lines, (indented,), max_lines=4).select("source", F.col("seq").cast("long").alias("seq"), "n_lines")


@registered("SELECT seq, event_type || ' user <*> value <*>' AS masked FROM e")
def t_mask(e: DataFrame) -> DataFrame:
    return e.select("seq", F.array_join(text.masked(text.tokens(F.col("message"))), " ").alias("masked"))


@registered("SELECT seq, '<*> user <*> value <*>' AS template_text, 1::BIGINT AS template_id, event_type || ' ' || user_id || ' ' || value AS params FROM e")
def t_cluster(e: DataFrame) -> DataFrame:
    found = templates.template_events(e.select("seq", "message"))
    return found.select("seq", "template_text", "template_id", F.array_join("params", " ").alias("params"))


@registered("""SELECT seq, CASE seq % 3 WHEN 0 THEN 'load ' || CASE WHEN seq < other THEN opens ELSE '<*>' END || ' from disk now' WHEN 1 THEN event_type || ' ' || event_type || ' done' ELSE 'user <*> gone' END AS text_then,
    CASE seq % 3 WHEN 0 THEN 'load ' || opens || ' from disk now' WHEN 1 THEN event_type || ' ' || event_type || ' done' ELSE 'user <*> gone' END AS template_key,
    CASE seq % 3 WHEN 0 THEN 'load <*> from disk now' WHEN 1 THEN event_type || ' ' || event_type || ' done' ELSE 'user <*> gone' END AS template_text,
    dense_rank() OVER (ORDER BY first) AS template_id
  FROM (SELECT *, min(seq) OVER (PARTITION BY CASE seq % 3 WHEN 1 THEN event_type ELSE (seq % 3)::VARCHAR END) AS first,
      (SELECT arg_min(event_type, seq) FROM e WHERE seq % 3 = 0) AS opens,
      (SELECT min(seq) FROM e WHERE seq % 3 = 0 AND event_type <> (SELECT arg_min(event_type, seq) FROM e WHERE seq % 3 = 0)) AS other FROM e)""")
def t_cluster_asof(e: DataFrame) -> DataFrame:
    """Messages that form seven templates, one of which widens: its text as of each event, at its beginning and in the end."""
    kind = F.col("event_type")
    message = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("load "), kind, F.lit(" from disk now"))).when(F.col("seq") % 3 == 1, F.concat(kind, F.lit(" "), kind, F.lit(" done"))).otherwise(F.concat(F.lit("user "), "user_id", F.lit(" gone")))
    return templates.template_events(e.select("seq", message.alias("message"))).select("seq", "text_then", "template_key", "template_text", "template_id")


@registered("SELECT '<*> user <*> value <*>' AS template_text, count(*) AS count, min(us) AS first_us, max(us) AS last_us, (SELECT string_agg(message, '|' ORDER BY seq) FROM (SELECT * FROM e ORDER BY seq LIMIT 3)) AS samples FROM e")
def t_table(e: DataFrame) -> DataFrame:
    table = templates.template_table(templates.template_events(e.select("seq", "ts", "message")))
    return table.select("template_text", "count", micros(F.col("first_seen")).alias("first_us"), micros(F.col("last_seen")).alias("last_us"), F.array_join("sample_values", "|").alias("samples"))


@registered("""SELECT template_text, count(*) AS count FROM (SELECT event_type || ' user ' || user_id AS template_text, us, min(seq) OVER (PARTITION BY event_type, user_id) AS id FROM e) GROUP BY template_text, id ORDER BY max(us) DESC, count DESC, id DESC LIMIT 50""")
def t_retained(e: DataFrame) -> DataFrame:
    per = _novel(e).groupBy("template_text").agg(F.max("ts").alias("last_seen"), F.count("*").alias("count"), F.min("seq").alias("template_id"))
    return templates.retained(per, 50).select("template_text", "count")


@registered("SELECT seq, '{' || event_type || '} user {' || user_id || '} value {*}' AS shown FROM e")
def t_render(e: DataFrame) -> DataFrame:
    words = F.split(F.lit("<*> user <*> value <*>"), " ")
    return e.select("seq", templates.rendered(words, F.array("event_type", F.col("user_id").cast("string"))).alias("shown"))


# ---- alerts -----------------------------------------------------------------------------


def _alerts(e: DataFrame) -> DataFrame:
    banded = e.select("seq", "template_text", F.col("source").alias("group_key"), (F.unix_micros("ts") / 1e6).alias("at"), stats.severity(F.col("value"), 50.0, 100.0, 200.0).alias("severity"))
    return banded.filter("severity <> 'normal'")


@registered()
def l_throttle(e: DataFrame) -> DataFrame:
    """Sequential by nature; tests hold it against a plain loop."""
    return alerts.throttle(_alerts(e), 86400.0)


@registered("""SELECT seq, printf('a-%06d', row_number() OVER (ORDER BY us, seq)) AS id FROM e WHERE value >= 50""")
def l_ids(e: DataFrame) -> DataFrame:
    return alerts.numbered(_alerts(e)).select("seq", "id")


@registered(""", a AS (SELECT seq, us / 1e6 AS at, event_type AS detector, user_id AS t FROM e)
  SELECT a.t AS template_id, a.at, a.detector, 't' || a.t || '-' || CAST(floor(least(a.at, min(b.at)) / 7200.0) AS BIGINT) AS incident FROM a JOIN a b ON a.t = b.t AND abs(a.at - b.at) <= 7200 AND a.detector <> b.detector GROUP BY 1, 2, 3""")
def l_incident(e: DataFrame) -> DataFrame:
    rows = e.select(F.col("user_id").alias("template_id"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_type").alias("detector"))
    return alerts.incidents(rows, 7200.0)


@registered("""SELECT a.seq AS alert_id, string_agg(left(x.message, 240), chr(10) ORDER BY x.seq) AS examples FROM e a JOIN (SELECT *, row_number() OVER (PARTITION BY template_text ORDER BY seq) AS kk FROM e) x ON x.template_text = a.template_text AND x.seq <= a.seq
  JOIN (SELECT seq AS s, row_number() OVER (PARTITION BY template_text ORDER BY seq) AS r FROM e) y ON y.s = a.seq WHERE a.value >= 200 AND x.kk > y.r - 3 GROUP BY 1""")
def l_evidence(e: DataFrame) -> DataFrame:
    raised = e.filter("value >= 200").select(F.col("seq").alias("alert_id"), "seq", "template_text")
    return alerts.evidence(raised, e)


@registered("""SELECT seq, '{"id":' || seq || ',"detector":"' || event_type || '","incident":null}' AS payload FROM e""")
def l_payload(e: DataFrame) -> DataFrame:
    rows = e.select("seq", F.col("seq").alias("id"), F.col("event_type").alias("detector"), F.lit(None).cast("string").alias("incident"))
    return rows.select("seq", alerts.payload(["id", "detector", "incident"]).alias("payload"))


@registered(""", a AS (SELECT event_type AS detector, seq, us / 1e6 AS tm FROM e WHERE value > 150), l AS (SELECT event_type AS kind, seq AS id, us / 1e6 - 600 AS s, us / 1e6 + 600 AS t FROM e WHERE value > 250),
  m AS (SELECT detector, a.seq, min(l.id) AS id FROM a LEFT JOIN l ON detector = kind AND tm BETWEEN s - 1800 AND t + 1800 GROUP BY 1, 2), g AS (SELECT detector, count(*) AS n, count(id) AS h, count(DISTINCT id) AS f FROM m GROUP BY 1), w AS (SELECT kind, count(*) AS n FROM l GROUP BY 1)
  SELECT coalesce(detector, kind) AS detector, round(coalesce(h / g.n, 0), 6) AS precision, round(coalesce(f / w.n, 0), 6) AS recall FROM g FULL JOIN w ON detector = kind""")
def e_precision_recall(e: DataFrame) -> DataFrame:
    at = F.unix_micros("ts") / 1e6
    raised = e.filter("value > 150").select(F.col("event_type").alias("detector"), F.col("seq").alias("alert_id"), at.alias("at"))
    labels = e.filter("value > 250").select(F.col("event_type").alias("kind"), F.col("seq").alias("label_id"), (at - 600).alias("start"), (at + 600).alias("end"))
    return alerts.precision_recall(raised, labels)


@registered("""SELECT round(n / h, 6) AS rate, round(least(4.0, greatest(0.5, sqrt(n / h / 2.0))), 6) AS scale, round(6.0 * least(4.0, greatest(0.5, sqrt(n / h / 2.0))), 1) AS volume_anomalous_z
  FROM (SELECT count(*) AS n, 720.0::DOUBLE AS h FROM e WHERE value >= 50)""")
def l_suggest(e: DataFrame) -> DataFrame:
    found = alerts.suggested_thresholds(_alerts(e), 720 * 3600.0, 2.0)
    return found.select(F.round("rate", 6).alias("rate"), F.round("scale", 6).alias("scale"), "volume_anomalous_z")


@registered("""SELECT seq, CASE event_type WHEN 'error' THEN 'critical' ELSE 'elevated' END || ' [' || event_type || '] template ''' || template_text || '''' || chr(10) || 'baseline: ' || chr(10) || 'observed: ' || value || chr(10) || 'deviation: ' || chr(10) || 'threshold: ' || chr(10) ||
  'window: ' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.000Z') || ' .. ' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS explain, CASE event_type WHEN 'error' THEN '!!' ELSE '+' END AS marker, value::VARCHAR AS observed FROM e""")
def l_explain(e: DataFrame) -> DataFrame:
    hour = F.unix_seconds(F.date_trunc("hour", "ts")).cast("double")
    rows = e.select("seq", "template_text", F.col("event_type").alias("detector"), F.when(F.col("event_type") == "error", "critical").otherwise("elevated").alias("severity"), F.col("value").cast("string").alias("observed_desc"), hour.alias("window_start"), hour.alias("window_end"))
    got = alerts.described(rows)
    return got.select("seq", "explain", F.get_json_object("payload", "$.marker").alias("marker"), F.get_json_object("payload", "$.observed.desc").alias("observed"))


@registered()
def l_sticky_incident(e: DataFrame) -> DataFrame:
    """An incident's id depends on the alerts before; tests hold it against a plain loop."""
    rows = e.select(F.col("user_id").alias("template_id"), (F.unix_micros("ts") / 1e6).alias("at"), "seq", F.col("event_type").alias("detector"))
    return alerts.sticky_incidents(rows, 7200.0)


@registered(f"""{_VOLUME}, r AS (SELECT template_text, (bucket + 72) % 168 AS slot, bucket, n, row_number() OVER (PARTITION BY template_text, (bucket + 72) % 168 ORDER BY bucket DESC) AS b FROM v){_INTERVALS}
  SELECT template_text AS key, slot::INT AS slot, bucket * 3600.0::DOUBLE AS at, n::DOUBLE AS value FROM r WHERE b <= 64 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM m ORDER BY "start" DESC LIMIT 100) f WHERE bucket >= f."start" AND bucket < f."end")""")
def b_state_trim(e: DataFrame) -> DataFrame:
    spans = baselines.merged_intervals(_intervals(e)).select((F.col("start") * 3600).alias("start"), (F.col("end") * 3600).alias("end"))
    kept = state.trimmed(state.volume_state(baselines.hourly_volume(e)).unionByName(state.exclusion_state(spans)))
    return kept.filter("kind = 'volume'").select("key", "slot", "at", "value")


@registered(f"""{_VOLUME}, k AS (SELECT template_text AS key, (bucket + 72) % 168 AS slot, bucket * 3600.0::DOUBLE AS "at", n::DOUBLE AS value, row_number() OVER (PARTITION BY template_text, (bucket + 72) % 168 ORDER BY bucket DESC) AS b FROM v),
  s AS (SELECT key, slot::INT AS slot, "at", value, 6 + octet_length(encode(key)) + 28 AS bytes, row_number() OVER (PARTITION BY key ORDER BY "at") AS pass FROM k WHERE b <= 64),
  c AS (SELECT *, sum(bytes) OVER (ORDER BY pass, key) - bytes AS before, sum(bytes) OVER () AS whole FROM s)
  SELECT key, slot, "at", value FROM c WHERE whole - before <= 20000""")
def b_state_bytes(e: DataFrame) -> DataFrame:
    """The state under 20,000 bytes: the oldest sample of each key goes, pass by pass."""
    kept = state.within_bytes(state.trimmed(state.volume_state(baselines.hourly_volume(e))), 20_000)
    return kept.select("key", "slot", "at", "value")


@registered(f""", t AS (SELECT us, event_type || ' ' || translate(user_id::VARCHAR, '0123456789', 'abcdefghij') AS k FROM e),
  w AS (SELECT tm FROM (SELECT min(us) AS tm, row_number() OVER (ORDER BY min(us)) AS r FROM t GROUP BY (us // 3600000000 + 72) % 168) WHERE r = 24),
  f AS (SELECT k, min(us) AS f FROM t GROUP BY 1), x AS (SELECT max(us) // 1000 AS late FROM t),
  c AS (SELECT k, f, count(*) AS n FROM f JOIN t USING (k) WHERE us <= f + 864000000000 AND f > (SELECT tm FROM w) GROUP BY ALL)
  SELECT k AS template_key, f AS first_us, least(n, 20) AS n, CASE WHEN n >= 20 THEN 'anomalous' ELSE 'elevated' END AS severity FROM c, x WHERE n >= 2 AND (n >= 20 OR (f + 864000000000 + 999) // 1000 + 1 <= late)""")
def s_live_new_templates(e: DataFrame) -> DataFrame:
    """The events as lines through the live engine, as a stream that ends with them: templates that are new after the warm-up, once their span
    is over or they have come very often."""
    spark = e.sparkSession
    folder = scratch(spark, "live")
    words = F.concat("event_type", F.lit(" "), F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij"))
    line = F.concat(F.lit("ts="), F.date_format("ts", _STAMP), F.lit(" level="), "level", F.lit(' msg="'), words, F.lit('"'))
    e.select("source", "seq", line.alias("text")).write.parquet(f"{folder}/lines")
    stream = spark.readStream.schema("source string, seq long, text string").parquet(f"{folder}/lines")
    settings = Settings(warmup_seconds=1e9, detectors=_SPARSE)  # the warm-up ends with the 24th hour of the week
    live.run(stream, folder, settings, trigger={"availableNow": True}, flush_s=0.0).awaitTermination()
    found = spark.read.parquet(f"{folder}/alerts").filter("detector = 'new_template'")
    return found.select(F.substring_index("group_key", ":", -1).alias("template_key"), F.round(F.col("at") * 1e6).cast("long").alias("first_us"), F.col("observed_value").cast("long").alias("n"), "severity")


@registered("SELECT seq, lag(seq) OVER (PARTITION BY source ORDER BY seq) AS before FROM e")
def w_lag(e: DataFrame) -> DataFrame:
    return e.select("seq", F.lag("seq").over(Window.partitionBy("source").orderBy("seq")).alias("before"))


@registered("SELECT level, source, count(*) AS n, grouping(level) + 2 * grouping(source) AS g FROM e GROUP BY CUBE (level, source)")
def g_cube(e: DataFrame) -> DataFrame:
    return e.cube("level", "source").agg(F.count("*").alias("n"), (F.grouping("level").cast("long") + 2 * F.grouping("source").cast("long")).alias("g"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
