"""The six detectors, each from events to scored rows or alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import robust_z, severity, sorted_median, two_proportion_z
from ..functions.text import bound
from .baselines import RING, hourly_volume, marked_excluded, prior_statistics
from .ordered import positions, running_sums, walk


@dataclass(frozen=True)
class DetectorConfig:
    """Thresholds and spans (seconds); bands are (elevated, anomalous, critical)."""

    volume_min: int = 5
    volume_bands: tuple[float, float, float] = (4.0, 6.0, 10.0)
    error_window_s: int = 60
    error_baseline_s: int = 300
    error_min_total: int = 20
    error_min_errors: int = 3
    error_bands: tuple[float, float, float] = (3.0, 4.0, 8.0)
    shift_block: int = 30
    shift_baseline_blocks: int = 3
    shift_bands: tuple[float, float, float] = (3.5, 5.0, 9.0)
    novel_window_s: float = 60.0
    novel_min: int = 2
    novel_many: int = 20
    novel_grace_s: float = 0.0
    silence_factor: float = 10.0
    silence_min_count: int = 200
    silence_min_missed: float = 50.0
    gram_gap_s: float = 2.0
    gram_baseline: int = 2
    gram_min: int = 4
    error_tick_s: int = 5
    shift_cooldown_s: float = 60.0
    shift_rebound_s: float = 7200.0
    silence_check_s: float = 30.0
    silence_peers: int = 4
    silence_peer_share: float = 0.3
    gram_component_min: int = 5
    gram_window_s: float = 600.0
    gram_cooldown_s: float = 900.0
    gram_hourly: int = 3
    gram_share: float = 0.6


#: Samples that an hour-of-week slot needs before it is a baseline.
SLOT_SAMPLES = 3


def _volumes(events: DataFrame, history: DataFrame | None, exclusions: DataFrame | None) -> DataFrame:
    """Hourly volumes with their slots; `old` ones come from an earlier run's state, `excluded` ones are scored but no baseline."""
    rows = hourly_volume(events).withColumn("old", F.lit(False))
    if history is not None:
        rows = rows.unionByName(history.select("template_text", F.col("bucket").cast("long").alias("bucket"), F.col("n").cast("long").alias("n"), F.lit(True).alias("old")))
        rows = rows.groupBy("template_text", "bucket").agg(F.max_by("n", ~F.col("old")).alias("n"), F.min("old").alias("old"))  # a bucket of both counts as seen now
    rows = rows.withColumn("excluded", F.lit(False)) if exclusions is None else marked_excluded(rows, exclusions)
    return rows.withColumns({"hour": F.col("bucket") % 24, "slot": (F.col("bucket") + 72) % 168})


def volume(events: DataFrame, config: DetectorConfig = DetectorConfig(), history: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """Hourly counts scored against the most seasonal baseline there is: their hour of the week with
    SLOT_SAMPLES or more, or else the same hour of day before (of this run), whose spread is half of the
    median at least. Every spread is the square root of the median and 2 at least.

    `history` (template_text, bucket, n) is what an earlier run has kept; `exclusions` (start, end), in
    hours, keep their hours out of the hour-of-week baselines.
    """
    rows = _volumes(events, history, exclusions)
    by_slot = prior_statistics(rows, ["hour", "slot"], usable=~F.col("excluded"), name="slot_")
    scored = prior_statistics(by_slot, ["hour"], usable=~F.col("old"), name="day_")
    ordered, n = F.array_sort("day_history"), F.size("day_history")
    upper = F.get(ordered, F.floor(n / 2).cast("int")).cast("double")
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int")).cast("double")
    weekly = F.col("slot_samples") >= SLOT_SAMPLES
    expected = F.when(weekly, F.col("slot_median")).otherwise(upper)
    spread = F.when(weekly, F.greatest("slot_mad", F.col("slot_median") * 0.05)).otherwise(F.greatest(upper - lower, upper * 0.5))
    z = robust_z(F.col("n").cast("double"), F.col("expected"), F.greatest("spread", F.sqrt("expected"), F.lit(2.0)))
    return (
        scored.filter(~F.col("old")).withColumns({"expected": expected, "spread": spread}).filter("expected is not null")
        .select("template_text", "bucket", "n", "expected", F.round(z, 6).alias("z"), F.when(weekly, "week").otherwise("day").alias("basis"))
        .withColumn("severity", F.when(F.col("n") >= config.volume_min, severity(F.col("z"), *config.volume_bands)).otherwise("normal"))
    )


def volume_global(events: DataFrame, config: DetectorConfig = DetectorConfig(), history: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """All events' hourly counts against their own hour of the week before, with SLOT_SAMPLES samples or more."""
    rows = _volumes(events.withColumn("template_text", F.lit("__all__")), history if history is None else history.filter("template_text = '__all__'"), exclusions)
    scored = prior_statistics(rows, ["slot"], usable=~F.col("excluded")).filter(~F.col("old"))
    spread = F.greatest("mad", F.col("median") * 0.05, F.sqrt("median"), F.lit(2.0))
    z = F.round(robust_z(F.col("n").cast("double"), F.col("median"), spread), 6)
    hot = F.when(F.col("n") >= config.volume_min, severity(z, *config.volume_bands)).otherwise("normal")
    return scored.filter(F.col("samples") >= SLOT_SAMPLES).select("bucket", "n", "median", "mad", z.alias("z"), hot.alias("severity"))


def seen_windows(events: DataFrame, window_s: int) -> DataFrame:
    """(start, total, errors) of the windows of an absolute grid that have events."""
    start = F.floor(F.unix_micros("ts") / (1_000_000 * window_s)) * window_s
    return events.groupBy(start.alias("start")).agg(F.count("*").alias("total"), F.count_if(F.col("level").isin("error", "critical")).alias("errors"))


def error_windows(events: DataFrame, window_s: int) -> DataFrame:
    """(start, total, errors) on an absolute grid, empty windows too, between those that have events."""
    found = seen_windows(events, window_s)
    low, high = found.agg(F.min("start"), F.max("start")).first()
    if low is None:
        return found
    # A range of rows, spread over tasks: one bad time makes it long, but not one row wide.
    grid = events.sparkSession.range(int(low), int(high) + 1, window_s).withColumnRenamed("id", "start")
    return grid.join(found, "start", "left").select("start", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("errors", F.lit(0)).alias("errors"))


def with_base(windows: DataFrame, history: DataFrame | None, span_s: int) -> DataFrame:
    """`windows` (start, total, errors) with base_total and base_errors, of the windows that begin in the `span_s` seconds before. `history` is
    windows of an earlier run; of one that both have, the larger counts. Windows that have events, not events, are ordered as a whole, so
    that a single bad time costs one row."""
    rows = windows.withColumn("_old", F.lit(False))
    if history is not None:
        old = history.select(F.col("start").cast("long").alias("start"), F.col("total").cast("long").alias("total"), F.col("errors").cast("long").alias("errors"), F.lit(True).alias("_old"))
        rows = rows.unionByName(old).groupBy("start").agg(F.max("total").alias("total"), F.max_by("errors", "total").alias("errors"), F.min("_old").alias("_old"))
    before = Window.orderBy("start").rangeBetween(-span_s, -1)
    return rows.withColumns({"base_total": F.sum("total").over(before), "base_errors": F.sum("errors").over(before)}).filter("not _old").drop("_old")


def error_rate(events: DataFrame, config: DetectorConfig = DetectorConfig(), history: DataFrame | None = None) -> DataFrame:
    """Windows whose error share is scored against the windows of the time before, of an earlier run's `history` too."""
    base = with_base(seen_windows(events, config.error_window_s), history, config.error_baseline_s)
    z = two_proportion_z(F.col("errors"), F.col("total"), F.col("base_errors"), F.col("base_total"))
    usable = (F.col("total") >= config.error_min_total) & (F.col("base_total") >= config.error_min_total) & (F.col("base_errors") >= config.error_min_errors)
    return base.filter(usable).select("start", "total", "errors", "base_total", "base_errors", F.round(z, 6).alias("z")).withColumn("severity", severity(F.col("z"), *config.error_bands))


def mann_whitney(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n1, n2, u, z) of the samples marked `recent` against the others: average ranks,
    tie-corrected, without continuity correction; z is 0 without variance. Needs both sides."""
    # Counts per distinct value cross the shuffle; their running sums are worked out by ranges of (keys, value), whatever a key's share.
    counted = samples.groupBy(*keys, "value").agg(F.count_if("recent").alias("_c1"), F.count("*").alias("_c")).withColumn("_below", F.col("_c"))
    summed = running_sums(counted, [*keys, "value"], ["_below"])
    c1, c = F.col("_c1"), F.col("_c")
    g = summed.groupBy(*keys).agg(
        F.sum(c1).alias("n1"), F.sum(c - c1).alias("n2"), F.min(F.col("_below") - c).alias("_first"),
        F.sum(c1 * (F.col("_below") - (c - 1) / 2.0)).alias("_ranks"), F.sum(F.pow(c, F.lit(3)) - c).alias("_ties"),
    ).filter("n1 > 0 and n2 > 0").withColumn("_ranks", F.col("_ranks") - F.col("n1") * F.col("_first"))
    n = F.col("n1") + F.col("n2")
    u = F.col("_ranks") - F.col("n1") * (F.col("n1") + 1) / 2.0
    variance = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.when(n > 1, F.col("_ties") / (n * (n - 1))).otherwise(0.0))
    z = F.when(variance <= 0, 0.0).otherwise((u - F.col("n1") * F.col("n2") / 2.0) / F.sqrt(variance))
    return g.select(*keys, "n1", "n2", F.round(u, 6).alias("u"), F.round(z, 6).alias("z"))


def blocks(samples: DataFrame, config: DetectorConfig) -> DataFrame:
    """`samples` (key, seq, ...) with the number of their block within their key."""
    return positions(samples, ["seq"], "block", by="key").withColumn("block", F.floor((F.col("block") - 1) / config.shift_block))


#: Newest samples of a key that are kept between runs.
NUMERIC_KEPT = 128


def numeric_shift(samples: DataFrame, config: DetectorConfig = DetectorConfig(), saved: DataFrame | None = None) -> DataFrame:
    """Each full block of a key's values (key, seq, value) against the blocks before it.

    The first block has none in this run; it is scored against the newest of `saved` (key, at, value), an earlier run's
    samples, as many as the kept ring has beside the block, if they are a block at least.
    """
    blocked = blocks(samples, config)
    full = blocked.groupBy("key", "block").count().filter(F.col("count") == config.shift_block).select("key", "block")
    spread = blocked.select("key", "value", F.col("block").alias("_of"), F.explode(F.sequence("block", F.col("block") + config.shift_baseline_blocks)).alias("block"))
    both = spread.join(full.filter("block > 0"), ["key", "block"], "left_semi").withColumn("recent", F.col("_of") == F.col("block")).drop("_of")
    if saved is not None:
        newest = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("value"))  # a ring of a bounded length a key
        ring = saved.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= NUMERIC_KEPT - config.shift_block)
        first = full.filter("block = 0").join(ring.groupBy("key").count().filter(F.col("count") >= config.shift_block), "key", "left_semi")
        old = ring.join(first, "key").select("key", "block", "value", F.lit(False).alias("recent"))
        own = blocked.join(first, ["key", "block"], "left_semi").select("key", "block", "value", F.lit(True).alias("recent"))
        both = both.select("key", "block", "value", "recent").unionByName(own).unionByName(old)
    return mann_whitney(both, ["key", "block"]).withColumn("severity", severity(F.abs("z"), *config.shift_bands))


def new_templates(events: DataFrame, warm_at: float, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Templates first seen after the warm-up, and its grace, with their count in the time after."""
    epoch = F.unix_micros("ts") / 1e6
    settled = F.col("first_at") > warm_at
    if config.novel_grace_s > 0:  # seen within the grace, a template is known
        settled = F.col("first_at") > warm_at + config.novel_grace_s
    first = events.groupBy("template_text").agg(F.min(epoch).alias("first_at")).filter(settled)
    counted = events.withColumn("_at", epoch).join(first, "template_text").filter(F.col("_at") <= F.col("first_at") + config.novel_window_s).groupBy("template_text", "first_at").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= config.novel_min).withColumn("severity", F.when(F.col("n") >= config.novel_many, "anomalous").otherwise("elevated"))


def stopped_templates(events: DataFrame, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Silences of established templates: gaps beyond the factor of the mean interval so far, in which
    enough events were due. The end of the table ends the last gap."""
    order = Window.partitionBy("template_text").orderBy("seq")
    end = events.agg(F.max(F.unix_micros("ts") / 1e6).alias("_end"))
    rows = events.withColumn("at", F.unix_micros("ts") / 1e6).withColumns({"seen": F.row_number().over(order), "first_at": F.min("at").over(order), "next_at": F.lead("at").over(order)})
    gap = F.coalesce("next_at", "_end") - F.col("at")
    interval = (F.col("at") - F.col("first_at")) / (F.col("seen") - 1)
    scored = rows.join(F.broadcast(end)).filter(F.col("seen") >= config.silence_min_count).withColumns({"gap": gap, "interval": interval})
    silent = scored.filter((F.col("gap") > config.silence_factor * F.col("interval")) & (F.col("gap") >= config.silence_min_missed * F.col("interval")))
    return silent.select("template_text", "seq", "seen", F.round("gap", 6).alias("gap"), F.round("interval", 6).alias("interval"), severity(F.col("gap") / F.col("interval"), 10.0, 25.0, 50.0).alias("severity"))


def rare_sequences(events: DataFrame, warm_at: float, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Triples of templates in a row within a source, hardly known from the warm-up, that then come often.

    A pause beyond the gap breaks a row after the warm-up. Counts of the warm-up's triples meet
    the later ones in a join.
    """
    order = Window.partitionBy("source").orderBy("seq")
    rows = events.select("source", "seq", (F.unix_micros("ts") / 1e6).alias("at"), F.col("template_text").alias("c"))
    rows = rows.withColumns({"a": F.lag("c", 2).over(order), "b": F.lag("c", 1).over(order), "t0": F.lag("at", 2).over(order), "t1": F.lag("at", 1).over(order)}).filter("a is not null")
    known = rows.filter(F.col("at") <= warm_at).groupBy("a", "b", "c").agg(F.count("*").alias("baseline"))
    unbroken = (F.col("at") - F.col("t1") <= config.gram_gap_s) & (F.col("t1") - F.col("t0") <= config.gram_gap_s)
    later = rows.filter((F.col("at") > warm_at) & unbroken & (F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c"))).groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return later.join(known, ["a", "b", "c"], "left").withColumn("baseline", F.coalesce("baseline", F.lit(0))).filter((F.col("baseline") <= config.gram_baseline) & (F.col("n") >= config.gram_min))


# ---- from scores to alerts: partial windows, cooldowns, guards ----------------------------------


def error_alerts(events: DataFrame, config: DetectorConfig = DetectorConfig(), history: DataFrame | None = None) -> DataFrame:
    """The first moment of each window at which its counts so far give an alert: checked every
    `error_tick_s` seconds of the window, and at its end. Ticks are counted before they are ordered. `history` is an
    earlier run's windows (start, total, errors)."""
    width, tick = config.error_window_s, config.error_tick_s
    second = F.unix_micros("ts") / 1e6
    start = (F.floor(second / width) * width).alias("start")
    ticks = events.withColumn("_at", second).groupBy(start, F.least((F.floor((F.col("_at") % width) / tick) + 1) * tick, F.lit(width)).alias("after")).agg(
        F.count("*").alias("n"), F.count_if(F.col("level").isin("error", "critical")).alias("k"))
    so_far = Window.partitionBy("start").orderBy("after")
    partial = ticks.withColumns({"total": F.sum("n").over(so_far), "errors": F.sum("k").over(so_far)})
    windows = ticks.groupBy("start").agg(F.sum("n").alias("total"), F.sum("k").alias("errors"))
    base = with_base(windows, history, config.error_baseline_s).select("start", "base_total", "base_errors")
    z = two_proportion_z(F.col("errors"), F.col("total"), F.col("base_errors"), F.col("base_total"))
    usable = (F.col("total") >= config.error_min_total) & (F.col("base_total") >= config.error_min_total) & (F.col("base_errors") >= config.error_min_errors)
    scored = partial.join(base, "start").filter(usable).withColumn("z", F.round(z, 6)).filter(F.col("z") >= config.error_bands[0])
    first = scored.groupBy("start").agg(F.min_by(F.struct("after", "total", "errors", "base_total", "base_errors", "z"), "after").alias("f"))
    return first.select("start", "f.*").withColumn("severity", severity(F.col("z"), *config.error_bands))


class _Shift:
    at, up = float("-inf"), None


def shift_alerts(samples: DataFrame, config: DetectorConfig = DetectorConfig(), saved: DataFrame | None = None) -> DataFrame:
    """Alerts from numeric shifts (key, seq, at, value), with an earlier run's `saved` samples: none within the cooldown of a key's last one, nor in
    the other direction within the rebound span. Only blocks that score high are walked."""
    ends = blocks(samples.select("key", "at", "seq"), config).groupBy("key", "block").agg(F.max_by("at", "seq").alias("at"))
    high = numeric_shift(samples, config, saved).filter(F.abs("z") >= config.shift_bands[0]).join(ends, ["key", "block"])

    def step(last: _Shift, row) -> list[tuple]:
        since, up = row.at - last.at, row.z > 0
        if since < config.shift_cooldown_s or (last.up is not None and up != last.up and since < config.shift_rebound_s):
            return []
        last.at, last.up = row.at, up
        return [(row.key, row.block, row.at, row.z, row.severity, "increase" if up else "decrease")]

    return walk(high.select("key", "block", "at", "z", "severity"), "key", ["at", "block"], "key string, block long, at double, z double, severity string, direction string", _Shift, step)


def noticed_by_slot(gaps: DataFrame, events: DataFrame, config: DetectorConfig) -> DataFrame:
    """`gaps` with `check` and the interval that held there: the first check at which a silence is long enough for the template's rate.

    The rate is the median of its hourly counts at the check's hour of the week, of hours before; without any, at the hour of the
    week of its last sighting; else its mean rate. It is constant within an hour, so a gap meets the hours that it spans, and of each
    slot the history of RING counts at most, cut at the moment in a list.
    """
    volumes = hourly_volume(events).withColumn("slot", (F.col("bucket") + 72) % 168)
    past = volumes.groupBy("template_text", "slot").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("past"))
    hour = lambda c: F.floor(c / 3600)
    last = gaps.withColumns({"last_hour": hour(F.col("at")), "bucket": F.explode(F.sequence(hour(F.col("at")), hour(F.col("until"))))})
    at_check, at_last = past.withColumnRenamed("past", "here"), past.withColumnRenamed("past", "there")
    both = last.withColumns({"slot": (F.col("bucket") + 72) % 168, "last_slot": (F.col("last_hour") + 72) % 168})
    both = both.join(at_check, ["template_text", "slot"], "left").join(at_last.withColumnRenamed("slot", "last_slot"), ["template_text", "last_slot"], "left")

    def middle(name: str) -> Column:
        before = F.transform(F.filter(name, lambda v: v["bucket"] < F.col("bucket")), lambda v: v["n"])
        return bound(before, lambda x: sorted_median(F.when(F.size(x) > RING, F.slice(x, -RING, RING)).otherwise(x)))

    rate = F.coalesce(F.when(middle("here") > 0, middle("here")), F.when(middle("there") > 0, middle("there")))
    held = F.coalesce(3600.0 / rate, F.col("interval"))
    grid = lambda x, f: F.col("_start") + f((x - F.col("_start")) / config.silence_check_s) * config.silence_check_s
    due = F.col("at") + F.col("held") * max(config.silence_factor, config.silence_min_missed)
    check = F.greatest(F.col("_start") + (F.floor((due - F.col("_start")) / config.silence_check_s) + 1) * config.silence_check_s, grid(F.col("bucket") * 3600.0, F.ceil))
    found = both.withColumn("held", held).withColumn("check", check).filter((F.col("check") <= F.col("until")) & (F.col("check") < (F.col("bucket") + 1) * 3600.0))
    first = found.groupBy("template_text", "seq").agg(F.min(F.struct("check", "held")).alias("_f")).select("template_text", "seq", "_f.check", F.col("_f.held").alias("held"))
    return gaps.join(first, ["template_text", "seq"]).drop("interval").withColumnRenamed("held", "interval")


def stopped_alerts(events: DataFrame, config: DetectorConfig = DetectorConfig(), by_slot: bool = False) -> DataFrame:
    """Silences as they are noticed: on a grid of `silence_check_s` from the first event, at the first check at
    which the gap is long enough for the mean rate so far and enough events were due; with `by_slot`, for the rate at that hour
    of the week (noticed_by_slot).

    None when over `silence_peer_share` of more than `silence_peers` established templates are silent for
    half as long at that check, which is then something of the whole stream; a silence is judged
    once. Long gaps alone are swept in order, by ranges of time, not events.
    """
    order = Window.partitionBy("template_text").orderBy("seq")
    ends = events.agg(F.min(F.unix_micros("ts") / 1e6).alias("_start"), F.max(F.unix_micros("ts") / 1e6).alias("_end"))
    rows = events.select("template_text", "seq", (F.unix_micros("ts") / 1e6).alias("at")).withColumns({"seen": F.row_number().over(order), "first_at": F.min("at").over(order), "next_at": F.lead("at").over(order)})
    known = rows.filter((F.col("seen") >= config.silence_min_count) & (F.col("at") > F.col("first_at")))
    gaps = known.join(F.broadcast(ends)).withColumn("interval", (F.col("at") - F.col("first_at")) / F.col("seen")).withColumn("until", F.coalesce("next_at", "_end"))
    half = gaps.withColumn("half", F.col("at") + F.col("interval") * config.silence_factor * 0.5).filter(F.col("until") > F.col("half"))
    due = F.col("at") + F.col("interval") * max(config.silence_factor, config.silence_min_missed)
    check = F.col("_start") + (F.floor((due - F.col("_start")) / config.silence_check_s) + 1) * config.silence_check_s
    noticed = half.withColumn("check", check).filter(F.col("check") <= F.col("until"))
    if by_slot:  # at any rate that held before: no gap is too short for a busy hour of the week
        long = gaps.filter(F.col("until") - F.col("at") >= config.silence_check_s)
        noticed = noticed_by_slot(long, events, config)
    # At a time: what was established and fell silent before it, less what ended before it.
    established = known.filter(F.col("seen") == config.silence_min_count)
    change = lambda t, order, peers, silent: (t.alias("t"), F.lit(order).alias("o"), F.lit(peers).alias("peers"), F.lit(silent).alias("silent"))
    none = (F.lit(None).cast("string").alias("template_text"), F.lit(None).cast("long").alias("seq"))
    sweep = (
        noticed.select(*change(F.col("check"), 0, 0, 0), "template_text", "seq")
        .unionByName(established.select(*change(F.col("at"), 1, 1, 0), *none))
        .unionByName(half.select(*change(F.col("half"), 1, 0, 1), *none))
        .unionByName(half.select(*change(F.col("until"), 1, 0, -1), *none))
    )
    peers = running_sums(sweep, ["t", "o"], ["peers", "silent"]).filter("template_text is not null").select("template_text", "seq", "peers", "silent")
    judged = noticed.join(peers, ["template_text", "seq"]).filter(~((F.col("peers") > config.silence_peers) & (F.col("silent") / F.col("peers") > config.silence_peer_share)))
    gap = F.col("check") - F.col("at")
    ratio = F.round(gap / F.col("interval"), 6)
    return judged.select("template_text", "seq", "seen", F.round("check", 3).alias("check"), ratio.alias("ratio"), "peers", "silent", severity(ratio, 10.0, 25.0, 50.0).alias("severity"))


class _Gram:
    def __init__(self) -> None:
        self.times: list[float] = []
        self.fired = float("-inf")


class _Hour:
    def __init__(self) -> None:
        self.times: list[float] = []


def rare_sequence_alerts(events: DataFrame, warm_at: float, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Rows of three distinct templates within a source that the warm-up hardly knows, neither whole nor by
    its neighbours, of templates seen often enough by then, while no template makes up most of the
    last `gram_window_s` (in whole tenths of it). `gram_min` of them in that span raise an alert;
    then the triple rests for the cooldown, and all sources together raise `gram_hourly` an hour at most.

    Counts are joined, not broadcast; only rows that qualify are walked, by triple. The cap is a greedy walk in the order
    of time over what the triples raise, one row in each cooldown of a triple.
    """
    order = Window.partitionBy("source").orderBy("seq")
    rows = events.select("source", "seq", (F.unix_micros("ts") / 1e6).alias("at"), F.col("template_text").alias("c"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source", "c").orderBy("seq")))
    rows = rows.withColumns({"a": F.lag("c", 2).over(order), "b": F.lag("c", 1).over(order), "ka": F.lag("k", 2).over(order), "kb": F.lag("k", 1).over(order), "t0": F.lag("at", 2).over(order), "t1": F.lag("at", 1).over(order)})
    learnt = rows.filter((F.col("at") <= warm_at) & F.col("a").isNotNull()).groupBy("source", "a", "b", "c").agg(F.count("*").alias("n"))
    grams = learnt.filter(F.col("n") > config.gram_baseline).select("source", "a", "b", "c")
    pair = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("c").alias("y"))))
    pairs = learnt.select("source", pair.alias("p"), "n").groupBy("source", "p.x", "p.y").agg(F.sum("n").alias("n")).filter(F.col("n") > config.gram_baseline)
    distinct = (F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c"))
    unbroken = (F.col("at") - F.col("t1") <= config.gram_gap_s) & (F.col("t1") - F.col("t0") <= config.gram_gap_s) & (F.col("t0") > warm_at)
    common = F.least("ka", "kb", "k") >= config.gram_component_min
    found = rows.filter(distinct & unbroken & common)
    found = found.join(grams, ["source", "a", "b", "c"], "left_anti")
    found = found.join(pairs.select("source", F.col("x").alias("a"), F.col("y").alias("b")), ["source", "a", "b"], "left_anti")
    found = found.join(pairs.select("source", F.col("x").alias("b"), F.col("y").alias("c")), ["source", "b", "c"], "left_anti")
    bin_s = config.gram_window_s / 10
    slot = F.floor(F.col("at") / bin_s)
    binned = rows.filter(F.col("at") > warm_at).groupBy("source", "c", slot.alias("bin")).agg(F.count("*").alias("n"))
    recent = binned.select("source", "c", F.explode(F.sequence("bin", F.col("bin") + 9)).alias("bin"), "n").groupBy("source", "bin", "c").agg(F.sum("n").alias("n"))
    flooded = recent.groupBy("source", "bin").agg((F.max("n") / F.sum("n")).alias("share")).filter(F.col("share") > config.gram_share)
    calm = found.withColumn("bin", slot).join(flooded, ["source", "bin"], "left_anti")

    def gather(g: _Gram, row) -> list[tuple]:
        g.times = [t for t in (*g.times, row.at) if t >= row.at - config.gram_window_s]
        if len(g.times) < config.gram_min or row.at - g.fired < config.gram_cooldown_s:
            return []
        n, g.fired, g.times = len(g.times), row.at, []
        return [(row.source, row.seq, row.at, row.gram, n)]

    def cap(h: _Hour, row) -> list[tuple]:
        h.times = [t for t in h.times if t >= row.at - 3600.0]
        if len(h.times) >= config.gram_hourly:
            return []
        h.times.append(row.at)
        return [(row.source, row.seq, row.at, row.gram, row.n)]

    schema = "source string, seq long, at double, gram string, n long"
    text = F.concat_ws(" > ", "a", "b", "c")
    raised = walk(calm.select("source", "seq", "at", text.alias("gram"), F.to_json(F.array("source", "a", "b", "c")).alias("key")), "key", ["seq"], schema, _Gram, gather)
    return walk(raised.withColumn("whole", F.lit(0)), "whole", ["at", "source", "seq"], schema, _Hour, cap)
