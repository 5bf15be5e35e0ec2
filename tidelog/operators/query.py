"""Filters, grouped counts, histograms and reports over the event table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BUCKETS = 100_000


class QueryError(ValueError):
    """A query parameter that can't be understood; `kind` says which."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class QuerySpec:
    """What to look for; unset parts match everything. Times are epoch seconds, [since, until)."""

    since: float | None = None
    until: float | None = None
    level: str | None = None
    template_id: int | None = None
    template: str | None = None
    field: str | None = None
    field_value: str | None = None
    text: str | None = None


def parse_query(params: Mapping[str, str]) -> QuerySpec:
    """A spec from texts; blank values count as unset."""
    kinds = {"since": float, "until": float, "template_id": int}
    got = {}
    for name, value in params.items():
        if name not in QuerySpec.__dataclass_fields__:
            raise QueryError("unknown", f"unknown parameter {name}")
        if not str(value).strip():
            continue
        try:
            got[name] = kinds.get(name, str)(value)
        except ValueError as e:
            raise QueryError(name, f"{name}: not a number: {value}") from e
    if "level" in got:
        got["level"] = got["level"].strip().lower()
    return QuerySpec(**got)


def predicate(spec: QuerySpec) -> Column:
    """One condition, in terms that reach the scan where they can."""
    parts = [F.lit(True)]
    if spec.since is not None:
        parts.append(F.col("ts") >= F.timestamp_micros(F.lit(int(spec.since * 1e6))))
    if spec.until is not None:
        parts.append(F.col("ts") < F.timestamp_micros(F.lit(int(spec.until * 1e6))))
    if spec.level is not None:
        parts.append(F.lower("level") == spec.level)
    if spec.template_id is not None:
        parts.append(F.col("template_id") == spec.template_id)
    if spec.template is not None:
        parts.append(F.col("template_text").contains(spec.template))
    if spec.field is not None and spec.field_value is not None:
        parts.append(F.try_element_at("fields", F.lit(spec.field)) == spec.field_value)
    elif spec.field is not None:
        parts.append(F.map_contains_key("fields", spec.field))
    elif spec.field_value is not None:
        parts.append(F.array_contains(F.map_values("fields"), spec.field_value))
    if spec.text is not None:
        needle = spec.text.lower()
        parts.append(F.lower("message").contains(needle) | F.lower("raw_line").contains(needle))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def execute(events: DataFrame, spec: QuerySpec) -> DataFrame:
    """The bare condition: a filter drops rows for which it is null, and the scan can use its parts."""
    return events.filter(predicate(spec))


def counters(events: DataFrame, spec: QuerySpec) -> DataFrame:
    return events.agg(F.count_if(F.coalesce(predicate(spec), F.lit(False))).alias("matched"), F.count("*").alias("scanned"))


def aggregate(events: DataFrame, by: str) -> DataFrame:
    """(key, n) by level, template or source, or by any key of `fields` as `field:NAME`; blanks are `(none)`."""
    columns = {"level": F.col("level"), "template": F.col("template_text"), "source": F.col("source")}
    if by.startswith("field:"):
        columns[by] = F.try_element_at("fields", F.lit(by[6:]))
    if by not in columns:
        raise QueryError("group", f"can't group by {by}")
    return events.groupBy(F.coalesce(F.nullif(columns[by], F.lit("")), F.lit("(none)")).alias("key")).agg(F.count("*").alias("n"))


def top_n(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "key").limit(max(n, 0))


def histogram(events: DataFrame, bucket_s: float, since: float | None = None, until: float | None = None) -> DataFrame:
    """(bucket, start, n) of equal spans from `since` to `until`, empty ones too; the last is closed on the right."""
    if bucket_s <= 0:
        raise QueryError("bucket", "a bucket must be positive")
    epoch = F.unix_micros("ts") / 1e6
    found = events.agg(F.min(epoch).alias("low"), F.max(epoch).alias("high")).first() if since is None or until is None else None
    low = since if since is not None else found.low
    high = until if until is not None else found.high
    spark = events.sparkSession
    if low is None or high is None or high < low:
        return spark.createDataFrame([], "bucket long, start double, n long")
    n = max(1, -int(-(high - low) // bucket_s))
    if n > MAX_BUCKETS:
        raise QueryError("bucket", f"{n} buckets; {MAX_BUCKETS} at most")
    place = F.least(F.floor((epoch - low) / bucket_s), F.lit(n - 1))
    counts = events.filter((epoch >= low) & (epoch <= high)).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(n).withColumnRenamed("id", "bucket").join(F.broadcast(counts), "bucket", "left").select("bucket", (F.lit(float(low)) + F.col("bucket") * bucket_s).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def bars(counts: DataFrame, width: int = 20) -> DataFrame:
    """A bar in eighth blocks for each count, the largest being `width` wide."""
    peak = counts.agg(F.max("n").alias("peak"))
    eighths = F.floor((F.col("n") * width * 16 + F.col("peak")) / (2 * F.col("peak")))
    rest = F.array(*map(F.lit, ["", "▏", "▎", "▍", "▌", "▋", "▊", "▉"]))
    bar = F.when(F.col("peak") > 0, F.concat(F.repeat(F.lit("█"), (eighths / 8).cast("int")), F.get(rest, (eighths % 8).cast("int")))).otherwise("")
    return counts.join(F.broadcast(peak)).withColumn("bar", bar).drop("peak")


def last_n(events: DataFrame, n: int) -> DataFrame:
    """The newest n rows."""
    return events.orderBy(F.desc("seq")).limit(max(n, 0))


def totals(events: DataFrame) -> DataFrame:
    """Lifetime counters; first and last time go by arrival."""
    return events.agg(
        F.count("*").alias("lines"), F.count_if(F.col("parse_status") != "ok").alias("unparsed"), F.count_if(F.col("level").isin("error", "critical")).alias("errors"),
        F.count_distinct("template_text").alias("templates"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"),
    )


#: Levels from the least to the gravest.
LEVELS = ("trace", "debug", "info", "notice", "warning", "error", "critical")


def level_totals(events: DataFrame) -> DataFrame:
    """(level, n, percent) of every level, those that no event has too, and of events without one, whose level is `-`."""
    known = F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("-").alias("level")
    counts = events.groupBy(known).agg(F.count("*").alias("n"))
    every = events.sparkSession.createDataFrame([(x,) for x in (*LEVELS, "-")], "level string")
    whole = events.agg(F.count("*").alias("whole"))
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "level", "left").join(F.broadcast(whole)).select("level", n.alias("n"), F.round(n * 100.0 / F.greatest("whole", F.lit(1)), 6).alias("percent"))


def summary(events: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent templates with their share of all lines."""
    counts = aggregate(events, "template")
    whole = events.agg(F.count("*").alias("whole"))
    return top_n(counts, top).join(F.broadcast(whole)).select("key", "n", F.round(F.col("n") * 100.0 / F.col("whole"), 6).alias("percent"))


def capped(events: DataFrame, text: int = 512, fields: int = 16) -> DataFrame:
    """Storage caps of the index: text lengths, and the first fields of a line in its own order, keys and values cut too."""
    few = F.transform(F.slice(F.map_entries("fields"), 1, fields), lambda e: F.struct(F.left(e["key"], F.lit(text)), F.left(e["value"], F.lit(text))))
    return events.withColumns({"message": F.left("message", F.lit(text)), "raw_line": F.left("raw_line", F.lit(text)), "fields": F.map_from_entries(few)})


def engine_counters(events: DataFrame, ring: int = 100_000) -> DataFrame:
    """One row of lifetime counters: lines, parsed and unparsed ones, flagged ones (`flags` as line sources give
    them; without that column 0), error-level events, and what a ring of so many events has evicted."""
    flag = lambda bit: F.count_if(F.col("flags").bitwiseAND(bit) > 0) if "flags" in events.columns else F.lit(0).cast("long")
    lines = F.count("*")
    return events.agg(
        lines.alias("lines"), F.count_if(F.col("parse_status") == "ok").alias("parsed_ok"), F.count_if(F.col("parse_status") != "ok").alias("unparsed"), flag(1).alias("truncated"), flag(2).alias("invalid_utf8"),
        F.count_if(F.col("level").isin("error", "critical")).alias("errors"), F.greatest(lines - ring, F.lit(0)).alias("evicted"),
    )


def report(events: DataFrame, alerts: DataFrame, since: float | None = None, until: float | None = None) -> DataFrame:
    """One row: lines, unparsed ones and their percentage, error-level events in percent of the parsed ones, distinct
    templates, and the alerts (at) of [since, until)."""
    whole = events.agg(
        F.count("*").alias("lines"), F.count_if(F.col("parse_status") != "ok").alias("unparsed"), F.count_if(F.col("level").isin("error", "critical")).alias("_errors"), F.count_distinct("template_text").alias("templates"),
    )
    span = F.lit(True)
    if since is not None:
        span = span & (F.col("at") >= since)
    if until is not None:
        span = span & (F.col("at") < until)
    percent = lambda n, of: F.round(n * 100.0 / F.greatest(of, F.lit(1)), 6)
    both = whole.join(F.broadcast(alerts.filter(span).agg(F.count("*").alias("alerts"))))
    return both.select("lines", "unparsed", percent(F.col("unparsed"), F.col("lines")).alias("unparsed_percent"), percent(F.col("_errors"), F.col("lines") - F.col("unparsed")).alias("error_percent"), "templates", "alerts")


def template_minutes(events: DataFrame, keep: int = 60) -> DataFrame:
    """Counts of each template's newest `keep` observed minutes."""
    minute = F.floor(F.unix_micros("ts") / 60_000_000).alias("minute")
    counts = events.groupBy("template_text", minute).agg(F.count("*").alias("n"))
    return counts.withColumn("back", F.row_number().over(Window.partitionBy("template_text").orderBy(F.desc("minute")))).filter(F.col("back") <= keep).drop("back")


def minute_volume(events: DataFrame, keep: int = 180) -> DataFrame:
    """(minute, n) of the newest observed minutes."""
    minute = F.floor(F.unix_micros("ts") / 60_000_000).alias("minute")
    return events.groupBy(minute).agg(F.count("*").alias("n")).orderBy(F.desc("minute")).limit(keep)


def ingest_rate(events: DataFrame, seconds: int = 120) -> DataFrame:
    """One row: mean events a second over the newest observed seconds but the last, which may not be over."""
    per_second = events.groupBy(F.floor(F.unix_micros("ts") / 1_000_000).alias("second")).agg(F.count("*").alias("n"))
    newest = per_second.orderBy(F.desc("second")).limit(seconds + 1)
    last = newest.agg(F.max("second").alias("last"))
    return newest.join(F.broadcast(last)).filter("second < last").agg(F.avg("n").alias("rate"))


def snapshot(events: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent templates: count, share of all lines, events in their newest minute, last time, and
    beside them the error and unparsed shares of the whole."""
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    minutes = events.groupBy("template_text", minute.alias("minute")).agg(
        F.count("*").alias("n"), F.max_by("ts", "seq").alias("at"), F.max("seq").alias("seq"),
        F.count_if(F.col("level").isin("error", "critical")).alias("errors"), F.count_if(F.col("parse_status") != "ok").alias("unparsed"))
    per = minutes.groupBy("template_text").agg(F.sum("n").alias("count"), F.max_by("n", "minute").alias("rate_per_min"), F.max_by("at", "seq").alias("last_seen"), F.sum("errors").alias("errors"), F.sum("unparsed").alias("unparsed"))
    whole = per.agg(F.sum("count").alias("_lines"), F.sum("errors").alias("_errors"), F.sum("unparsed").alias("_unparsed"))
    few = per.orderBy(F.desc("count"), "template_text").limit(top).drop("errors", "unparsed").join(F.broadcast(whole))
    percent = lambda n, of: F.round(F.col(n) * 100.0 / F.greatest(of, F.lit(1)), 6)
    return few.select("template_text", "count", percent("count", F.col("_lines")).alias("share"), "rate_per_min", "last_seen", percent("_errors", F.col("_lines") - F.col("_unparsed")).alias("error_percent"), percent("_unparsed", F.col("_lines")).alias("unparsed_percent"))
