"""The event table over the supplied stream table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as log events: seq, ts, source, level, message, template_text, fields, value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user-"), F.col("user_id") % 20).alias("source"),
        F.when(kind == "error", "error").when(kind == "purchase", "warning").when(kind == "signup", "notice").otherwise("info").alias("level"),
        F.concat(kind, F.lit(" user "), "user_id", F.lit(" value "), "value").alias("message"),
        F.concat(kind, F.lit(" user <*> value <*>")).alias("template_text"),
        F.from_json("props", "map<string,string>").alias("fields"),
        F.lit("ok").alias("parse_status"), "value", "event_type", "user_id",
    ).withColumn("raw_line", F.col("message"))
