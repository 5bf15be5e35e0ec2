"""The memory check: a run of its own writes an event log, whose peaks are held against ceilings."""

import os
import subprocess
import sys
from pathlib import Path

from tidelog import __main__ as cli
from tidelog import memory

ROOT = Path(__file__).resolve().parent.parent
RUN = """
import sys
from pyspark.sql import SparkSession
from tidelog.operators import query, replay
from tidelog.sources import corpus
from tidelog.session import SEMANTIC
spark = (SparkSession.builder.master("local[2]").config("spark.driver.memory", "2g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.dir", sys.argv[1])
         .config(map=SEMANTIC).getOrCreate())
events = replay.events_of(corpus.generate(spark, corpus.Corpus(150_000), 8))
assert query.totals(events).first().lines == 150_000
spark.stop()
"""


def test_a_run_stays_below_its_ceiling(spark, tmp_path, monkeypatch, capsys):
    """150,000 lines are assembled, parsed and clustered within 1.5 GB of heap; a ceiling that is too low is reported."""
    logs = tmp_path / "events"
    logs.mkdir()
    subprocess.run([sys.executable, "-c", RUN, f"file://{logs}"], check=True, timeout=300, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True)
    found = {(r.executor, r.metric): r.bytes for r in memory.peaks(spark, str(logs)).collect()}
    heap = found["driver", "JVMHeapMemory"]
    assert 10 << 20 < heap and found["driver", "TaskExecutionMemory"] > 0
    assert memory.above(spark, str(logs), 1536 << 20).isEmpty()
    assert [(r.metric, r.bytes) for r in memory.above(spark, str(logs), heap - 1).collect()] == [("JVMHeapMemory", heap)]
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["memory", str(logs), "--ceiling-mb", "1536"]) == cli.OK
    assert cli.main(["memory", str(logs), "--ceiling-mb", "1"]) == cli.FAILED and "JVMHeapMemory" in capsys.readouterr().out
