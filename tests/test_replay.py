"""Sources that grow, hooks, settings, saved state, ordered walks and whole replays."""

import http.server
import io
import json
import os
import random
import socket
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog import __main__ as cli
from tidelog import config
from tidelog.functions import parsers
from tidelog.operators import alerts, assemble, ordered, replay, state
from tidelog.sources import corpus, hooks, spool, tail, targets
from tidelog.streaming.alerts import deliver, throttle_stream

ALERTS = "group_key string, seq long, at double, severity string"


def test_walk_keeps_order_and_drops_null_keys(spark):
    rows = spark.createDataFrame([(f"k{i % 3}", 99 - i) for i in range(99)] + [(None, 1)], "k string, n long").repartition(5)
    step = lambda seen, row: seen.append(row.n) or [(row.k, row.n, len(seen))]
    got = ordered.walk(rows, "k", ["n"], "k string, n long, place long", list, step, lambda seen: [("end", max(seen), len(seen))]).collect()
    assert sorted(r.place for r in got if r.k == "end") == [33, 33, 33] and len(got) == 102
    for k in ("k0", "k1", "k2"):
        mine = sorted((r.place, r.n) for r in got if r.k == k)
        assert [n for _, n in mine] == sorted(n for _, n in mine)


def test_byte_cap_cuts_greedily(spark):
    texts = ["head", *[" " + "x" * 39] * 5, "next", " " + "y" * 200, " z"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, seq long, text string")
    got = assemble.assemble(df, max_bytes=100).orderBy("seq").collect()
    assert [(r.seq, r.n_lines) for r in got] == [(0, 3), (3, 2), (5, 1), (6, 1), (7, 1), (8, 1)]
    assert "\n".join(r.text for r in got) == "\n".join(texts)


def test_throttle_forgets_idle_groups(spark):
    rows = [("g", 1, 0.0, "elevated"), ("g", 2, 10.0, "elevated"), ("g", 3, 700.0, "elevated"), (None, 4, 0.0, "critical")]
    got = alerts.throttle(spark.createDataFrame(rows, ALERTS)).orderBy("seq").collect()
    assert [(r.emitted, r["count"], r.suppressed, r.first_seen) for r in got] == [(True, 1, 0, 0.0), (False, 2, 0, 0.0), (True, 1, 0, 700.0)]


def test_sticky_incidents(spark):
    rows = [(1, 100.0, 1, "a"), (1, 130.0, 2, "b"), (1, 200.0, 3, "a"), (1, 900.0, 4, "a"), (2, 100.0, 5, "a"), (2, 110.0, 6, "a"), (None, 1.0, 7, "a")]
    got = {r.seq: r.incident for r in alerts.sticky_incidents(spark.createDataFrame(rows, "template_id long, at double, seq long, detector string")).collect()}
    assert got == {1: "t1-0", 2: "t1-0", 3: "t1-0", 4: None, 5: None, 6: None}


def test_stream_throttle_equals_batch(spark, tmp_path):
    rows = [(f"g{i % 3}", i, float(i * 5), ["elevated", "anomalous", "critical"][i * 7 % 3]) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[40 * part : 40 * part + 40], ALERTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(ALERTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = throttle_stream(stream, 100.0).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    plain = lambda df: {(r.group_key, r.seq, r.emitted, r["count"], r.suppressed, r.first_seen) for r in df.collect()}
    assert plain(spark.table("throttled")) == plain(alerts.throttle(spark.createDataFrame(rows, ALERTS), 100.0))


def test_saved_state_resumes(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert state.load(spark, folder).count() == 0
    samples = spark.createDataFrame([("k", float(i), i * 1.0) for i in range(200)], "key string, at double, value double")
    spans = spark.createDataFrame([(150.0, 160.0)], "start double, end double")
    first = state.trimmed(state.numeric_state(samples.filter("at < 120")))
    state.save(first, folder, 1)
    assert state.load(spark, folder).count() == 120
    whole = state.resumed(state.load(spark, folder), state.numeric_state(samples.filter("at >= 100")).unionByName(state.exclusion_state(spans)))
    state.save(whole, folder, 2)
    kept = [r["at"] for r in state.load(spark, folder).filter("kind = 'numeric'").orderBy("at").collect()]
    assert kept == [float(x) for x in range(72, 200) if not 150 <= x < 160]
    assert state.trimmed(whole, max_rows=60).filter("kind = 'numeric'").agg(F.min("at")).first()[0] > 72


def test_hooks(spark, tmp_path):
    out = tmp_path / "out"
    cat = hooks.Command([sys.executable, "-c", f"import sys; open({str(out)!r}, 'a').write(sys.stdin.read())"])
    assert hooks.attempt(cat, "{}\n") is None and out.read_text() == "{}\n"
    assert "code 3" in hooks.attempt(hooks.Command([sys.executable, "-c", "raise SystemExit(3)"]), "")
    assert "still running" in hooks.attempt(hooks.Command([sys.executable, "-c", "import time; time.sleep(9)"], timeout_s=0.2), "")
    assert hooks.attempt(hooks.Command(["/no/such/program"]), "").startswith("FileNotFoundError")
    assert hooks.attempt(hooks.dry(hooks.Command(["/no/such/program"])), "") is None
    posted = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            posted.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(204 if self.path == "/ok" else 500)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}"
    assert hooks.attempt(hooks.Post(f"{address}/ok"), '{"a": 1}') is None and posted == [b'{"a": 1}']
    assert "500" in hooks.attempt(hooks.Post(f"{address}/no"), "{}")
    server.shutdown()
    got = hooks.deliveries(spark.createDataFrame([("x\n",), ("y\n",)], "payload string"), [hooks.Command(["/no/such/program"]), cat]).collect()
    assert sorted((r.sent, r.failed) for r in got) == [(0, 2), (2, 0)] and sorted(out.read_text().split()) == ["x", "y", "{}"]


def test_stream_delivers_to_hooks(spark, tmp_path):
    out = tmp_path / "got"
    spark.createDataFrame([("one\n",), ("two\n",)], "payload string").write.parquet(str(tmp_path / "in"))
    hook = hooks.Command([sys.executable, "-c", f"import sys; open({str(out)!r}, 'a').write(sys.stdin.read())"])
    q = deliver(spark.readStream.schema("payload string").parquet(str(tmp_path / "in")), [hook], str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sorted(out.read_text().split()) == ["one", "two"]


def test_tail_follows_growth_and_rotation(tmp_path):
    path = tmp_path / "a.log"
    reader = tail.TailReader({"path": str(path)})
    read = lambda a, b: [t for p in reader.partitions(a, b) for _, t in reader.read(p)]
    none = reader.latestOffset()
    assert none == reader.initialOffset()
    path.write_bytes(b"one\r\ntwo\nhal")
    first = reader.latestOffset()
    assert read(none, first) == ["one", "two"]
    with path.open("ab") as f:
        f.write(b"f\n\xff\n")
    second = reader.latestOffset()
    assert read(first, second) == ["half", "\ufffd"] and read(second, second) == []
    with path.open("ab") as f:
        f.write(b"late\nlast")
    os.rename(path, tmp_path / "a.log.1")
    path.write_bytes(b"new\n")
    third = reader.latestOffset()
    assert read(second, third) == ["late", "last", "new"]
    path.write_bytes(b"n\n")
    assert read(third, reader.latestOffset()) == ["n"]


def test_tail_splits_into_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "RANGE_BYTES", 7)
    path = tmp_path / "a.log"
    lines = [f"line {i} " + "x" * (i % 5) for i in range(50)]
    path.write_text("\n".join(lines) + "\n")
    reader = tail.TailReader({"path": str(path)})
    assert [t for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for _, t in reader.read(p)] == lines


def test_tail_as_a_stream(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\n")
    q = tail.stream_tail(spark, str(path)).writeStream.format("memory").queryName("grown").start()
    q.processAllAvailable()
    with path.open("a") as f:
        f.write("three\npart")
    q.processAllAvailable()
    q.stop()
    assert [(r.source, r.text) for r in spark.table("grown").orderBy("seq").collect()] == [("a.log", "one"), ("a.log", "two"), ("a.log", "three")]


def test_sockets_and_standard_input_are_spooled(tmp_path):
    server = spool.LineServer("127.0.0.1", 0, str(tmp_path / "tcp")).start()
    for words in (b"one\ntwo\nhalf", b"three\n"):
        with socket.create_connection(server.server_address) as s:
            s.sendall(words)
    ends = time.monotonic() + 10
    while server.spool.size < 14 and time.monotonic() < ends:
        time.sleep(0.05)
    server.stop()
    assert sorted("".join(p.read_text() for p in (tmp_path / "tcp").glob("tcp*.log")).split()) == ["one", "three", "two"]
    ours, theirs = os.pipe()
    live = spool.LiveSpool(os.fdopen(ours, "rb"), str(tmp_path / "live"), max_age_s=0.2).start()
    os.write(theirs, b"first\nhal")
    ends = time.monotonic() + 10
    while not list((tmp_path / "live").glob("stdin*.log")) and time.monotonic() < ends:
        time.sleep(0.05)
    assert [p.read_text() for p in (tmp_path / "live").glob("stdin*.log")] == ["first\n"] and not live.ended.is_set()  # before the end
    os.write(theirs, b"f\n")
    os.close(theirs)
    assert live.ended.wait(10) and sorted("".join(p.read_text() for p in (tmp_path / "live").glob("stdin*.log")).split()) == ["first", "half"]
    spool.spool_stream(io.BytesIO(b"a\nb"), str(tmp_path / "in"))
    assert [p.read_text() for p in (tmp_path / "in").glob("stdin*.log")] == ["a\nb\n"]


def test_targets():
    parse = targets.Target.parse
    assert [parse(x).kind for x in ("-", "stdin", "dir:/x", "tcp:h:1", "/a/b.log")] == ["stdin", "stdin", "dir", "tcp", "file"]
    for bad in ("tcp:h", "tcp:h:x", "tcp::1"):
        with pytest.raises(ValueError):
            parse(bad)


def test_settings():
    got = config.settings({"warmup_seconds": 60, "detectors": {"volume_bands": [1, 2, 3.5]}, "hooks": [{"type": "exec", "argv": ["true"]}]})
    assert got.warmup_seconds == 60.0 and got.detectors.volume_bands == (1.0, 2.0, 3.5) and got.hooks == (hooks.Command(["true"]),)
    for bad in (
        {"colour": 1}, {"detectors": {"nope": 1}}, {"warmup_seconds": "x"}, {"warmup_seconds": True}, {"warmup_seconds": -1}, {"detectors": {"volume_bands": [3, 2, 1]}},
        {"detectors": {"error_window_s": 0}}, {"hooks": [{"type": "mail"}]}, {"hooks": [{"type": "exec", "argv": []}]}, {"hooks": [{"type": "webhook", "url": "ftp://x"}]}, {"hooks": [{"type": "exec", "argv": ["a"], "timeout_s": 0}]},
    ):
        with pytest.raises(config.ConfigError):
            config.settings(bad)


def test_suggested_thresholds(spark):
    got = alerts.suggested_thresholds(spark.range(40), 36_000.0, 1.0).first()
    assert (got.rate, got.scale, got.volume_anomalous_z) == (4.0, 2.0, 12.0)
    assert alerts.suggested_thresholds(spark.range(0), 36_000.0, 1.0).first().scale is None


def test_access_lines_are_cut_into_parts(spark):
    lines = {
        '1.2.3.4 - bob [01/Jan/2026:00:00:00 +0000] "GET /a HTTP/1.1" 200 -': ["1.2.3.4", "-", "bob", "01/Jan/2026:00:00:00 +0000", "GET /a HTTP/1.1", "200", "-", None, None, None],
        '  h i "u" [1/Feb/2026:10:00:01 -0130] "" 503 12 "http://r" "an agent" 0.25 ': ["h", "i", '"u"', "1/Feb/2026:10:00:01 -0130", None, "503", "12", "http://r", "an agent", "0.25"],
        'h - - [01/Jan/2026:00:00:00 +0000] "GET" 200 5 1.5': ["h", "-", "-", "01/Jan/2026:00:00:00 +0000", "GET", "200", "5", None, None, "1.5"],
    }
    broken = ['h - - [01/Jan/2026:00:00:00 +0000] "GET" 20 5', 'h - [01/Jan/2026:00:00:00 +0000] "GET" 200 5', 'h - - [01/Jan/2026 00:00:00 +0000] "GET" 200 5', 'h - - [01/Jan/2026:00:00:00 +0000] "GET" 200 x', 'h - - [01/Jan/2026:00:00:00 +0000] GET 200 5', 'h\t - - [01/Jan/2026:00:00:00 +0000] "GET" 200 5', ""]
    df = spark.createDataFrame([(x,) for x in [*lines, *broken]], "t string")
    got = {r.t: r.p for r in df.select("t", parsers.access_parts(F.col("t"))["parts"].alias("p")).collect()}
    assert got == lines | dict.fromkeys(broken)


def test_syslog_lines_are_cut_into_parts(spark):
    new = {
        "<34>1 2026-01-01T00:00:00Z host app 7 ID1 - hello  world": ["34", "1", "2026-01-01T00:00:00Z", "host", "app", "7", "ID1", "hello  world"],
        '<165>2 - h a p m [x@1 a="b"][y c="d]"] msg [z]': ["165", "2", "-", "h", "a", "p", "m", "msg [z]"],
        "<9>1 - h a p m [sd]": ["9", "1", "-", "h", "a", "p", "m", None], "<9>1 - h a p m -": ["9", "1", "-", "h", "a", "p", "m", None],
        "<9>1 - h a p m x": None, "<9999>1 - h a p m -": None, "<9>123 - h a p m -": None, "<9>1 - h a p m": None,
    }
    old = {
        "<34>Jan  2 03:04:05 host su[9]: hello": ["34", "Jan", "2", "03:04:05", "host", "su", "9", "hello"], "Oct 11 22:14:15 m prog:x": [None, "Oct", "11", "22:14:15", "m", "prog", None, "x"],
        "Oct 11 22:14:15 m a b: x": None, "Oct 11 22:14:15 m prog[x]: y": None, "Oct 11 22:14 m prog: y": None, "Oct 111 22:14:15 m prog: y": None, "Oct 11 22:14:15 m prog": None,
    }
    for cut, want in ((parsers.rfc5424, new), (parsers.rfc3164, old)):
        df = spark.createDataFrame([(x,) for x in want], "t string")
        assert {r.t: r.p for r in df.select("t", cut(F.col("t")).alias("p")).collect()} == want


def test_lines_of_stack_traces(spark):
    more = ["    at com.foo.Bar(B.java:1)", "\tat\tx", '  File "a.py", line 3, in f', "Caused by: x", "  Caused by: y", "  ... 12 more", "... 3 more)", "Traceback (most recent call last):", "ValueError: x", "java.lang.RuntimeException", "a.Error"]
    other = ["at x", "    at  x", '  File "", line 3', 'File "a.py", line 3', '  File "a.py", line x', "... more", "  ... x more", "... 3 moreover", " Traceback (most recent call last):", "Error: x", "xErrors", "java.lang.RuntimeExceptioné", "9Error", ""]
    df = spark.createDataFrame([(x,) for x in [*more, *other]], "t string")
    got = {r.t: r.p for r in df.select("t", assemble.stack_frame(F.col("t")).alias("p")).collect()}
    assert got == dict.fromkeys(more, True) | dict.fromkeys(other, False)
    partial = {"  }": True, "}],": True, "\t] }": True, "[": True, '{"a": [1': True, "]x": False, '{"a": 1}': False, "x {": False, "": False}
    df = spark.createDataFrame([(x,) for x in partial], "t string")
    assert {r.t: r.p for r in df.select("t", assemble.json_partial(F.col("t")).alias("p")).collect()} == partial


def test_no_filter_repeats_the_parse(spark):
    """A filter on the verdict stays above what the parsers need of a line."""
    rows = spark.createDataFrame([("s", 1, '{"a": 1}')], "source string, seq long, text string")
    plan = parsers.parse_lines(rows, parsers.registry(2026)).filter("parser is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") <= 2 or plan.count("parse_json") <= 4
    assert [line for line in plan.splitlines() if "Generate explode" in line]


def test_replay_finds_the_labelled_anomalies(spark, tmp_path):
    made = corpus.Corpus(120_000)
    events = replay.events_of(corpus.generate(spark, made))
    events.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    assert events.count() == 120_000 and events.filter("parse_status <> 'ok'").count() == 0
    out = replay.replay(events)
    out.write.parquet(str(tmp_path / "alerts"))
    out = spark.read.parquet(str(tmp_path / "alerts"))
    scored = {r.detector: (r.precision, r.recall) for r in alerts.precision_recall(out.withColumn("alert_id", F.col("seq")), corpus.labels(spark, made)).collect()}
    assert set(scored) == set(corpus.KINDS) and all(recall == 1.0 for _, recall in scored.values()), scored
    assert all(scored[k][0] == 1.0 for k in ("volume", "new_template", "stopped_template", "rare_sequence")), scored
    rows = [(r.id, json.loads(r.payload), r.explain) for r in out.collect()]
    assert sorted(i for i, _, _ in rows) == [f"a-{n:06d}" for n in range(1, len(rows) + 1)]
    found = next(p for _, p, _ in rows if p["detector"] == "new_template")
    assert found["template_id"] and found["baseline"]["desc"] == "never seen" and found["threshold"]["value"] == 2.0 and "mayday" in found["examples"][0]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    bad = tmp_path / "bad.toml"
    bad.write_text("colour = 1")
    good = tmp_path / "good.toml"
    good.write_text('warmup_seconds = 10\n[[hooks]]\ntype = "exec"\nargv = ["true"]\n')
    assert cli.main(["nonsense"]) == cli.USAGE
    assert cli.main(["--config", str(bad), "config", "validate"]) == cli.BAD_CONFIG
    assert cli.main(["--config", str(good), "config", "validate"]) == cli.OK
    assert cli.main(["--config", str(good), "hooks", "test"]) == cli.OK
    assert cli.main(["query", str(tmp_path / "missing.log")]) == cli.FAILED
    log = tmp_path / "a.log"
    log.write_text("".join(f"ts=2026-01-01T00:00:{i:02d}Z level={'error' if i % 10 == 0 else 'info'} msg=hello n={i}\n" for i in range(60)))
    assert cli.main(["query", str(log), "--where", "colour=red"]) == cli.USAGE
    capsys.readouterr()
    assert cli.main(["query", str(log), "--where", "level=error", "--by", "level"]) == cli.OK
    assert "error\t6" in capsys.readouterr().out
    assert cli.main(["summary", str(log)]) == cli.OK
    assert "60\t0\t0.0\t10.0\t1\t0" in capsys.readouterr().out
    assert cli.main(["query", str(log), "--where", "level=error", "--limit", "2"]) == cli.OK
    assert capsys.readouterr().out.count("error\ta.log\thello") == 2


def test_live_run_gives_the_alerts_of_a_replay(spark, tmp_path, capsys, monkeypatch):
    """Three runs on one state: a template that is new in the second raises its alert once its minute is over, and a hook gets it."""
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    logs, got = tmp_path / "logs", tmp_path / "got"
    logs.mkdir()
    conf = tmp_path / "c.toml"
    code = f"import sys; open({str(got)!r}, 'a').write(sys.stdin.read() + chr(10))"
    conf.write_text(f'warmup_seconds = 60\n[[hooks]]\ntype = "exec"\nargv = [{json.dumps(sys.executable)}, "-c", {json.dumps(code)}]\n')
    line = lambda second, words: f"ts=2026-01-01T00:{second // 60:02d}:{second % 60:02d}Z level=info msg={json.dumps(words)}\n"
    (logs / "a.log").write_text("".join(line(s, "steady work goes on") for s in range(0, 300, 2)))
    args = ["--config", str(conf), "run", f"dir:{logs}", "--state", f"file://{tmp_path}/state", "--once"]
    assert cli.main(args) == cli.OK and capsys.readouterr().out == ""
    (logs / "b.log").write_text("".join(line(s, "mayday something burns") for s in range(400, 430, 10)))
    assert cli.main(args) == cli.OK and capsys.readouterr().out == ""
    (logs / "c.log").write_text(line(500, "steady work goes on"))
    assert cli.main(args) == cli.OK
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [p["detector"] for p in out] == ["new_template"] and json.loads(got.read_text())["id"] == out[0]["id"]
    assert out[0]["template"] == "mayday something burns" and out[0]["observed"]["value"] == 3.0 and out[0]["examples"][-1] == "mayday something burns"
    (logs / "d.log").write_text(line(540, "mayday something smokes") + line(700, "steady work goes on"))
    assert cli.main(args) == cli.OK and capsys.readouterr().out == ""


def test_saved_volumes_are_baselines(spark, tmp_path):
    """A replay of the later weeks with what the earlier ones saved scores as a replay of all."""
    from tidelog.operators import detectors

    hours = [(f"t{k}", h, (20 if (h + k) % 168 else 400) + h % 7) for k in range(2) for h in range(0, 168 * 5)]
    rows = spark.createDataFrame(hours, "template_text string, bucket long, n int")
    events = rows.select("template_text", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i"), F.timestamp_seconds(F.col("bucket") * 3600).alias("ts"))
    whole = {(r.template_text, r.bucket): (r.expected, r.z) for r in detectors.volume(events).filter(f"bucket >= {168 * 4} and basis = 'week'").collect()}
    early, late = events.filter(F.col("ts") < F.timestamp_seconds(F.lit(168 * 4 * 3600))), events.filter(F.col("ts") >= F.timestamp_seconds(F.lit(168 * 4 * 3600)))
    from tidelog.operators import baselines

    state.save(state.trimmed(state.volume_state(baselines.hourly_volume(early))), f"file://{tmp_path}/state")
    saved = state.load(spark, f"file://{tmp_path}/state").filter("kind = 'volume'").select(F.col("key").alias("template_text"), F.floor(F.col("at") / 3600).alias("bucket"), F.col("value").alias("n"))
    resumed = {(r.template_text, r.bucket): (r.expected, r.z) for r in detectors.volume(late, history=saved).filter("basis = 'week'").collect()}
    assert len(whole) == 2 * 168 and resumed == whole
    alone = detectors.volume(late).filter("basis = 'week'")
    assert alone.isEmpty()


def test_a_state_table_heals(spark, tmp_path):
    """Versions are pruned; one that is cut short or unreadable is put aside and the one before it is used."""
    folder = f"file://{tmp_path}/state"
    table = state.StateTable(spark, folder, keep=3)
    assert table.load().isEmpty() and table.versions() == []
    rows = lambda n: state.numeric_state(spark.createDataFrame([("k", float(i), float(n)) for i in range(n)], "key string, at double, value double"))
    for n in range(1, 6):
        assert table.save(rows(n), n) == n
    assert table.versions() == [3, 4, 5] and sorted(p.name for p in (tmp_path / "state").iterdir() if not p.name.startswith(".")) == sorted(f"{a}{v}{b}" for v in (3, 4, 5) for a, b in (("version-", ""), ("manifest-", ".json")))
    assert table.load().count() == 5
    for part in (tmp_path / "state/version-5").glob("part-*"):
        part.write_bytes(b"no parquet")
    for part in (tmp_path / "state/version-5").glob(".part-*"):
        part.unlink()
    (tmp_path / "state/manifest-4.json").write_text(json.dumps({"rows": 99, "checksum": "0"}))
    assert table.load().count() == 3 and len(table.set_aside) == 2 and table.versions() == [3]
    assert {p.name for p in (tmp_path / "state").glob("corrupt-*")} == {"corrupt-5", "corrupt-5.json", "corrupt-4", "corrupt-4.json"}
    rows(8).write.parquet(f"{folder}/version-2")  # left by a save that failed
    table.save(rows(7), 6)
    assert table.load().count() == 7 and table.versions() == [3, 6] and not (tmp_path / "state/version-2").exists()


def test_trim_by_bytes_takes_the_oldest_of_every_key(spark):
    """As a loop does that drops one sample of each key a pass, then error windows, and never exclusions."""
    r = random.Random(3)
    rows = [("numeric", f"k{r.randrange(4)}" * r.randrange(1, 3), 0, float(i), float(r.randrange(9)), None) for i in range(80)]
    rows += [("error", "", 0, float(i), 1.0, 0.0) for i in range(5)] + [("exclusion", "", 0, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, state.SCHEMA)
    size = lambda x: len(x[0]) + len(x[1]) + 28
    for most in (10**6, 2000, 500, 130, 0):
        left = sorted(rows, key=lambda x: (x[0], x[1], x[3]))
        while sum(map(size, left)) > most:
            turn = [k for k in sorted({x[1] for x in left if x[0] == "numeric"})]
            before = len(left)
            for k in turn:
                if sum(map(size, left)) > most:
                    left.remove(min((x for x in left if x[:2] == ("numeric", k)), key=lambda x: x[3]))
            if not turn and (errors := [x for x in left if x[0] == "error"]):
                left.remove(min(errors, key=lambda x: x[3]))
            if len(left) == before:
                break
        got = sorted((tuple(x) for x in state.within_bytes(df, most).collect()), key=lambda x: (x[0], x[1], x[3]))
        assert got == left


def test_medians_of_hot_groups(spark):
    import statistics

    r = random.Random(5)
    rows = [(r.choice("aaaaab"), r.choice([None, 1.0, 2.0, r.random()])) for _ in range(400)] + [("c", 7.0), ("d", None), (None, 3.0), (None, 4.0)]
    got = {x.g: x.m for x in ordered.medians(spark.createDataFrame(rows, "g string, v double").repartition(6), "g", F.col("v"), "m").collect()}
    want = {g: statistics.median(v for k, v in rows if k == g and v is not None) for g in ("a", "b", "c", None)}
    assert got == pytest.approx(want)


def test_years_and_far_times(spark):
    """Classic syslog lines are of the clock's year, and one line of long ago costs one window, not all between."""
    import datetime

    from tidelog.operators import detectors

    row = spark.createDataFrame([("s", 1, "Jan  2 03:04:05 h su[9]: hello")], "source string, seq long, text string")
    parsed = parsers.parse_lines(row, parsers.registry(config.Settings().year)).first()
    assert parsed.ts.year == datetime.datetime.now(datetime.UTC).year
    events = spark.range(200).select(F.timestamp_seconds(F.when(F.col("id") == 0, 0).otherwise(1_767_225_600 + F.col("id"))).alias("ts"), F.when(F.col("id") % 7 == 0, "error").otherwise("info").alias("level"))
    assert detectors.error_rate(events).count() >= 2


def test_lines_before_an_alert(spark):
    events = spark.createDataFrame([(k, "ab"[k % 3 == 0], f"line {k}") for k in range(20)], "seq long, template_text string, message string")
    raised = spark.createDataFrame([(1, 8, "b"), (2, 2, "b"), (3, 0, "a")], "alert_id long, seq long, template_text string")
    got = {r.alert_id: r.evidence_before for r in alerts.lines_before(raised, events).collect()}
    assert got == {1: [f"line {k}" for k in (6, 5, 4, 3, 2)], 2: ["line 0"]}


def test_positions_and_running_sums(spark):
    r = random.Random(2)
    rows = [(k, r.choice("aab"), r.randrange(50)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, key string, n long").repartition(5)
    got = {x.id: x.p for x in ordered.positions(df, ["n", "id"], "p").collect()}
    order = sorted(rows, key=lambda x: (x[2], x[0]))
    assert got == {x[0]: k + 1 for k, x in enumerate(order)}
    within = {x.id: x.p for x in ordered.positions(df, ["n", "id"], "p", by="key").collect()}
    assert within == {x[0]: k + 1 for key in "ab" for k, x in enumerate(x for x in order if x[1] == key)}
    sums = {x.id: x.n for x in ordered.running_sums(df.withColumn("m", F.col("n")), ["m", "id"], ["n"]).collect()}
    total, want = 0, {}
    for x in order:
        total += x[2]
        want[x[0]] = total
    assert sums == want
