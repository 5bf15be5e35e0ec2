"""How much memory a run took, read from the event logs that Spark wrote of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of a task's end.
TASK_END = "Event string, `Task Info` struct<`Executor ID`: string>, `Task Executor Metrics` map<string, bigint>, `Task Metrics` struct<`Peak Execution Memory`: bigint, `Memory Bytes Spilled`: bigint>"


def peaks(spark: SparkSession, logs: str) -> DataFrame:
    """(executor, metric, bytes): the most that each executor had of each memory metric when a task ended, and that a task had of Spark's
    execution memory (`TaskExecutionMemory`) and spilled from memory (`TaskSpilled`). `logs` is a file or folder of uncompressed event logs
    (spark.eventLog.enabled, spark.eventLog.compress=false); with spark.executor.processTreeMetrics.enabled Python workers are among the
    metrics. Lines of other events aren't parsed."""
    ends = spark.read.text(logs).filter(F.contains("value", F.lit('"Event":"SparkListenerTaskEnd"')))
    task = ends.select(F.from_json("value", TASK_END).alias("t"))
    own = F.create_map(F.lit("TaskExecutionMemory"), F.col("t.Task Metrics.Peak Execution Memory"), F.lit("TaskSpilled"), F.col("t.Task Metrics.Memory Bytes Spilled"))
    metrics = F.map_concat(F.coalesce("t.Task Executor Metrics", F.create_map().cast("map<string,bigint>")), own)
    rows = task.select(F.col("t.Task Info.Executor ID").alias("executor"), F.explode(metrics).alias("metric", "bytes"))
    return rows.groupBy("executor", "metric").agg(F.max("bytes").alias("bytes"))


def above(spark: SparkSession, logs: str, ceiling: int, metrics: tuple[str, ...] = ("JVMHeapMemory",)) -> DataFrame:
    """The executors and metrics of `peaks` beyond a ceiling in bytes."""
    return peaks(spark, logs).filter(F.col("metric").isin(*metrics) & (F.col("bytes") > ceiling))
