"""Operators against worked examples and plain loops."""

import gzip

import pytest
from pyspark.sql import functions as F

from tidelog.functions import parsers, text
from tidelog.operators import alerts, assemble, query, templates
from tidelog.operators.detectors import error_rate, mann_whitney
from tidelog.operators.events import event_view
from tidelog.sources.lines import read_lines, stream_lines, write_json_lines
from tidelog.streaming.windows import error_window_stream, hourly_volume_stream


def lines(spark, *texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, seq long, text string")


def test_assembles_traces_and_json(spark):
    got = assemble.assemble(lines(spark, "start", "\tat a.b(C.java:1)", "Caused by: x", "next", "{", '  "a": 1', "}", "last")).orderBy("seq").collect()
    assert [(r.seq, r.n_lines) for r in got] == [(0, 3), (3, 4), (7, 1)]
    assert got[0].text == "start\n\tat a.b(C.java:1)\nCaused by: x"


def test_unterminated(spark):
    cases = {'{"a": 1}': False, '{"a": "x': True, '{"a": [1, 2}': True, r'{"a": "\""}': False, "[": True, '{"a": "{"}': False}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", assemble.unterminated(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == cases


def drain(messages):
    found, out = [], []
    for m in messages:
        shape = ["<*>" if any(c.isdigit() for c in t) or t == "<*>" else t for t in m.split()]
        for k, t in enumerate(found):
            differ = [i for i in range(len(shape)) if len(t) == len(shape) and t[i] != shape[i]]
            if len(t) == len(shape) and (2 * len(differ) < len(shape) or not shape):
                for i in differ:
                    t[i] = "<*>"
                out.append(k)
                break
        else:
            found.append(shape)
            out.append(len(found) - 1)
    return [(k + 1, " ".join(found[k])) for k in out]


def test_templates_match_a_loop(spark):
    words = ["open", "close", "file", "socket", "of", "user", "7", "x9", "ok", "bad"]
    messages = [" ".join(words[(i * p + j * q) % 10] for j in range(1 + i % 5)) for i, (p, q) in enumerate([(a % 7 + 1, a % 3 + 1) for a in range(120)])] + ["", "  "]
    df = spark.createDataFrame(list(enumerate(messages)), "seq long, message string")
    got = [(r.template_id, r.template_text) for r in templates.template_events(df).orderBy("seq").collect()]
    assert got == drain(messages)


def test_throttle_matches_a_loop(spark):
    rank = {"normal": 0, "elevated": 1, "anomalous": 2, "critical": 3}
    rows = [(f"g{i % 3}", i, float(i * 37 % 1000), ["elevated", "anomalous", "critical"][i * 7 % 3]) for i in range(200)]
    got = {r.seq: (r.emitted, r["count"], r.suppressed) for r in alerts.throttle(spark.createDataFrame(rows, "group_key string, seq long, at double, severity string"), 100.0).collect()}
    state, want = {}, {}
    for g, seq, at, s in sorted(rows, key=lambda r: (r[2], r[1])):
        last_at, last_rank, held, n = state.get(g, (None, -1, 0, 0))
        out = last_at is None or rank[s] > last_rank or at - last_at >= 100
        want[seq] = (out, n + 1, held if out else 0)
        state[g] = (at, rank[s], 0, n + 1) if out else (last_at, last_rank, held + 1, n + 1)
    assert got == want


def test_mann_whitney_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, False), ("b", 5.0, True), ("b", 5.0, False)], "k string, value double, recent boolean")
    assert {r.k: (r.u, r.z) for r in mann_whitney(df, ["k"]).collect()} == {"a": (0.0, -1.0), "b": (0.5, 0.0)}


def test_error_surge(spark):
    e = spark.range(960).select(F.timestamp_seconds(F.col("id") + 1_767_225_600).alias("ts"), F.when((F.col("id") % 100 == 0) | ((F.col("id") >= 600) & (F.col("id") < 660) & (F.col("id") % 6 == 0)), "error").otherwise("info").alias("level"))
    assert [r.start for r in error_rate(e).filter("severity <> 'normal'").collect()] == [1_767_225_600 + 600]


def test_formats_are_told_apart(spark):
    samples = {
        "json": '{"msg": "x", "level": "warn"}', "logfmt": "ts=2026-01-01T00:00:00Z level=info msg=x", "access_combined": '1.2.3.4 - - [01/Jan/2026:00:00:00 +0000] "GET / HTTP/1.1" 200 5',
        "syslog": "<34>1 2026-01-01T00:00:00Z h app 7 - - hello",
    }
    for name, line in samples.items():
        assert parsers.detect(lines(spark, line, line), parsers.registry(2026)) == name
    old = "<34>Jan  2 03:04:05 h su[9]: hello"
    got = parsers.parse_lines(lines(spark, *samples.values(), old, "plain"), parsers.registry(2026)).orderBy("seq").collect()
    assert [r.parser for r in got] == [*samples, "syslog", None]
    assert [r.level for r in got] == ["warning", "info", None, "critical", "critical", None]
    assert all(r.parse_error is None for r in got[:-1]) and "no format resembles" in got[-1].parse_error


def test_scores_have_their_tiers(spark):
    cases = {
        "json": {'{"a": 1}': 0.6, '{"MSG": 1}': 0.95, '{"a": ]}': 0.15, '{"a": "': 0.05, "[1]": 0.0},
        "logfmt": {"a=1 b=2": 0.9, "a=1 b": 0.7, "msg=x plain words here": 0.9, 'a="open': 0.0, "words": 0.0, "a='x y' b": 0.7},
        "access_combined": {'x "GET /" 200 y': 0.2, '"GET" x': 0.0},
        "syslog": {"<34>1 what": 0.4, "Jan  2 03:04 x": 0.5, "<34>x": 0.0, "Jan  2 03:04:05 h su[9]: m": 0.95},
    }
    for name, want in cases.items():
        parser = [p for p in parsers.registry(2026) if p.name == name]
        for line, score in want.items():
            assert parsers.scores(lines(spark, line), parser)[name] == score, (name, line)
    assert parsers.detect(lines(spark, "plain words"), parsers.registry(2026)) is None


def test_a_locked_parser_has_the_last_word(spark):
    """A broken line of the locked format is not read by another parser; a line of another format is."""
    rows = lines(spark, '{"a": x=1', "k=v", "<34>1 2026-01-01T00:00:00Z h app 7 - - hello")
    free = [r.parser for r in parsers.parse_lines(rows, parsers.registry(2026)).orderBy("seq").collect()]
    got = parsers.parse_lines(rows, parsers.registry(2026), "json").orderBy("seq").collect()
    assert free == ["logfmt", "logfmt", "syslog"] and [r.parser for r in got] == [None, "logfmt", "syslog"]
    assert got[0].parse_error.startswith("json: ") and got[0].parse_status == "unparsed" and got[0].message == '{"a": x=1'
    with pytest.raises(ValueError, match="named groups"):
        parsers.registry(2026, "no groups")


def test_timestamps(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00,5+02:00",), ("1767225600",), ("1767225600123",), ("nonsense",), (None,)], "t string")
    got = [r.u for r in df.select(F.unix_micros(text.timestamp_of(F.col("t"))).alias("u")).collect()]
    assert got == [1767218400500000, 1767225600000000, 1767225600123000, None, None]


def test_query_errors():
    with pytest.raises(query.QueryError):
        query.parse_query({"since": "soon"})
    with pytest.raises(query.QueryError):
        query.parse_query({"colour": "red"})
    assert query.parse_query({"level": " ERROR ", "text": " "}) == query.QuerySpec(level="error")


def test_filters_reach_the_scan(spark):
    e = event_view(spark, "/root/testdata/sf0.001")
    found = query.execute(e, query.QuerySpec(since=1704412800.0, until=1705622400.0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    counts = query.counters(e.withColumn("level", F.nullif("level", F.lit("info"))), query.QuerySpec(level="error")).first()
    assert counts.scanned == e.count() and counts.matched == e.filter("level = 'error'").count()


def test_long_lines_are_cut_by_bytes(spark, tmp_path):
    euro = "x" * 32_767 + "€" * 30_000 + "end"
    (tmp_path / "a.log").write_text(f"short\n{euro}\n")
    rows = sorted(read_lines(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert len({r.seq for r in rows}) == len(rows) and rows[0].text == "short"
    assert "".join(r.text for r in rows[1:]) == euro and all(len(r.text.encode()) <= 32_768 and r.valid_utf8 and r.flags == 1 for r in rows[1:])
    assert rows[1].text == "x" * 32_767 and len(rows) == 5


def test_line_sources_and_sink(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\n" + b"x" * 40_000 + b"\n\xff\n")
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"zip\n"))
    rows = read_lines(spark, str(tmp_path), "*.log*").collect()
    assert {r.text for r in rows if r.source == "b.log.gz"} == {"zip"}
    assert [r.flags for r in rows if r.text in ("one", "two")] == [0, 0]
    assert "".join(r.text for r in rows if r.flags & 1) == "x" * 40_000
    assert [r.valid_utf8 for r in rows if r.flags & 2] == [False]
    write_json_lines(spark.range(2), str(tmp_path / "out"))
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {'{"id":0}', '{"id":1}'}
    q = stream_lines(spark, str(tmp_path)).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tailed").count() == len(rows)


def test_streams_equal_batch(spark, tmp_path):
    from tidelog.operators.detectors import error_windows
    from tidelog.operators.events import event_view

    e = event_view(spark, "/root/testdata/sf0.001").select("seq", "ts", "template_text", "level")
    e.repartitionByRange(1, "seq").sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, df in (("hours", hourly_volume_stream(stream())), ("windows", error_window_stream(stream(), "6 hours"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(90)
    hours = {(r.template_text, r.start): r.n for r in spark.table("hours").collect()}
    batch = {(r.template_text, r.start): r.n for r in e.groupBy("template_text", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n")).collect()}
    assert hours and all(batch[k] == n for k, n in hours.items()) and len(hours) >= len(batch) - 5
    closed = {int(r.start.timestamp()): (r.total, r.errors) for r in spark.table("windows").collect()}
    whole = {r.start: (r.total, r.errors) for r in error_windows(e, 21600).collect()}
    assert closed and all(v in whole.values() for v in closed.values())
