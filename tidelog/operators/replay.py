"""From lines to alerts that went out: assembly, parsing, templates, detectors, throttling, incidents."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import parsers
from ..session import stored
from . import alerts, assemble, baselines, detectors, state, templates


def events_of(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Events of lines (source, seq, text). A record without a time of its own has none and is counted, but
    no detector sees it. Records and parsed rows are stored, as several steps read each."""
    records = stored(assemble.assemble(lines), "records")
    known = parsers.registry(settings.year, settings.custom_pattern or None)
    parsed = parsers.parse_lines(records, known, parsers.detect(records, known))
    return templates.template_events(stored(parsed.withColumn("raw_line", F.left("text", F.lit(2048))).drop("text"), "parsed"))


def named_by(events: DataFrame) -> Column:
    return F.col("template_key") if "template_key" in events.columns else F.col("template_text")


def by_key(events: DataFrame) -> DataFrame:
    """Events whose template_text is the key that a template keeps, where they have one."""
    return events.withColumn("template_text", named_by(events))


def detect_all(events: DataFrame, settings: Settings = Settings(), saved: DataFrame | None = None) -> DataFrame:
    """(detector, severity, template_text, group_key, at, z, window_start, window_end, baseline_desc,
    baseline_value, observed_desc, observed_value, deviation_desc, threshold_desc, threshold_value) of all six
    detectors after the warm-up. One stream has one order: that of `seq` within a source. Volumes that an
    earlier run has `saved` are baselines too, and what lies in saved exclusions is none."""
    c = settings.detectors
    timed = by_key(events).filter("ts is not null")
    warm = baselines.warmed_up_at(timed, settings.warmup_seconds).first()[0]
    if warm is None:
        warm = float("inf")

    past = spans = samples = windows = None
    if saved is not None:
        past = saved.filter("kind = 'volume'").select(F.col("key").alias("template_text"), F.floor(F.col("at") / 3600).alias("bucket"), F.col("value").alias("n"))
        samples = saved.filter("kind = 'numeric'").select("key", "at", "value")
        windows = saved.filter("kind = 'error'").select(F.col("at").alias("start"), F.col("value").alias("total"), F.col("more").alias("errors"))
        spans = saved.filter("kind = 'exclusion'").select((F.col("at") / 3600).alias("start"), (F.col("value") / 3600).alias("end"))

    def raised(rows: DataFrame, detector: str, template: str, start: str, at: str, *, z: str = "null", unit: str = "z", baseline: tuple[str, str], observed: tuple[str, str], threshold: float, group: str | None = None) -> DataFrame:
        number = lambda e: F.expr(e).cast("double")
        words = lambda e: F.expr(e).cast("string")
        key: Column = words(group or template)
        return rows.select(
            F.lit(detector).alias("detector"), "severity", words(template).alias("template_text"), F.concat_ws(":", F.lit(detector), key).alias("group_key"),
            number(at).alias("at"), number(z).alias("z"), number(start).alias("window_start"), number(at).alias("window_end"),
            words(baseline[0]).alias("baseline_desc"), number(baseline[1]).alias("baseline_value"), words(observed[0]).alias("observed_desc"), number(observed[1]).alias("observed_value"),
            F.concat(F.lit(f"{unit} = "), F.format_number(number(z), 2)).alias("deviation_desc"), F.lit(f"{threshold:g} or more").alias("threshold_desc"), F.lit(float(threshold)).alias("threshold_value"),
        )

    hot = "severity <> 'normal'"
    values = timed.select("template_text", "seq", "ts", F.explode("numeric").alias("name", "value"))
    numeric = values.select(F.to_json(F.array("template_text", "name")).alias("key"), "seq", (F.unix_micros("ts") / 1e6).alias("at"), "value")
    shifts = detectors.shift_alerts(numeric, c, samples).withColumn("of", F.from_json("key", "array<string>"))
    punctual = baselines.on_time(timed)
    hour = {"start": "bucket * 3600", "at": "(bucket + 1) * 3600", "z": "z", "observed": ("concat(n, ' in an hour')", "n"), "threshold": c.volume_bands[0]}
    share = "concat(round(100 * {0} / {1}, 1), ' % errors of ', {1})"
    found = [
        raised(detectors.volume(punctual, c, past, spans).filter(hot), "volume", "template_text", baseline=("concat(expected, if(basis = 'week', ' at this hour of the week', ' at this hour of day'))", "expected"), **hour),
        raised(detectors.volume_global(punctual, c, past, spans).filter(hot), "volume", "'__all__'", baseline=("concat(median, ' at this hour of the week')", "median"), **hour),
        raised(detectors.error_alerts(timed, c, windows).filter(hot), "error_rate", "null", "start", "start + after", z="z", baseline=(share.format("base_errors", "base_total"), "base_errors / base_total"), observed=(share.format("errors", "total"), "errors / total"), threshold=c.error_bands[0]),
        raised(shifts, "numeric_shift", "of[0]", "at", "at", z="z", group="concat_ws(':', of)", baseline=("concat('earlier values of ', of[1])", "null"), observed=("concat(of[1], ' shows ', direction)", "null"), threshold=c.shift_bands[0]),
        raised(detectors.new_templates(timed, warm, c), "new_template", "template_text", "first_at", "first_at", unit="times", baseline=("'never seen'", "0"), observed=("concat(n, ' times')", "n"), threshold=c.novel_min),
        raised(detectors.stopped_alerts(timed, c, by_slot=True).filter(hot), "stopped_template", "template_text", "check", "check", z="ratio", unit="intervals", baseline=("concat('seen ', seen, ' times')", "seen"), observed=("concat('silent for ', round(ratio, 1), ' intervals')", "ratio"), threshold=c.silence_factor),
        raised(detectors.rare_sequence_alerts(timed, warm, c).withColumn("severity", F.lit("anomalous")), "rare_sequence", "gram", "at", "at", unit="times", baseline=("'hardly known'", f"{c.gram_baseline}"), observed=("concat(n, ' times')", "n"), threshold=c.gram_min),
    ]
    return functools.reduce(DataFrame.unionByName, found).filter(F.col("at") > warm)


def replay(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The alerts that go out, numbered, with examples, payload and explanation. Raised alerts are stored, as
    throttling, incidents and evidence all read them. With a baseline_path, volumes, numeric samples and error
    windows of earlier replays are read there first, and all of them saved as a new version once the alerts are raised."""
    path = settings.baseline_path
    table = state.StateTable(events.sparkSession, path) if path else None
    saved = stored(table.load(), "saved") if table else None
    raised = stored(detect_all(events, settings, saved).withColumn("seq", F.xxhash64("detector", "group_key", "at")), "raised")
    named = by_key(events)
    if table is not None:
        timed = named.filter("ts is not null")
        whole = timed.withColumn("template_text", F.lit("__all__"))
        values = timed.select("template_text", (F.unix_micros("ts") / 1e6).alias("at"), F.explode("numeric").alias("name", "value"))
        fresh = [
            state.volume_state(baselines.hourly_volume(timed)), state.volume_state(baselines.hourly_volume(whole)), state.error_state(detectors.seen_windows(timed, settings.detectors.error_window_s)),
            state.numeric_state(values.select(F.to_json(F.array("template_text", "name")).alias("key"), "at", "value")),
        ]
        kept = state.resumed(saved, functools.reduce(DataFrame.unionByName, fresh))
        table.save(state.within_bytes(state.trimmed(kept, settings.baseline_max_rows), settings.baseline_max_bytes))
    ids = events.select(named_by(events).alias("template_text"), "template_id", F.col("template_text").alias("final_text")).distinct()
    out = alerts.throttle(raised, settings.throttle_window_s).filter("emitted").drop("at", "severity")
    whole = raised.join(out, ["group_key", "seq"]).join(ids, "template_text", "left")
    clustered = alerts.sticky_incidents(whole).select("template_id", "seq", "incident")
    micros = lambda at: (at * 1_000_000).cast("long").alias("seq")
    asked, lines = whole.select("template_text", micros(F.col("at")), F.col("seq").alias("alert_id")), named.select("template_text", F.unix_micros("ts").alias("seq"), "message")
    out = whole.join(clustered, ["template_id", "seq"], "left").withColumn("template_text", F.coalesce("final_text", "template_text")).drop("final_text")
    for shown in (alerts.example_lines(asked, lines), alerts.lines_before(asked, lines)):
        out = out.join(shown.withColumnRenamed("alert_id", "seq"), "seq", "left")
    return alerts.described(alerts.numbered(out))
