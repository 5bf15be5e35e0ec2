"""Raw lines from files and folders, in batch or as a stream, and JSON lines out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a line beyond which it is marked, and the flag bits.
MAX_LINE_BYTES = 32_768
TRUNCATED, INVALID_UTF8 = 1, 2


def pieces(text: Column) -> Column:
    """A text cut where MAX_LINE_BYTES bytes are full, between characters."""
    data, size = F.encode(text, "UTF-8"), F.octet_length(text)
    inside = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")  # noqa: E731  a byte within a character
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        full = s["at"] + MAX_LINE_BYTES
        end = F.when(full >= size, size).otherwise(full - F.when(~inside(full), 0).when(~inside(full - 1), 1).when(~inside(full - 2), 2).otherwise(3))
        piece = F.decode(F.substring(data, s["at"] + 1, end - s["at"]), "UTF-8")
        return F.struct(end.alias("at"), F.when(s["at"] < size, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    rounds = F.ceil(size / (MAX_LINE_BYTES - 3)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), rounds), state, step, lambda s: s["out"])


#: What a spool adds to the name of a source: the time at which the file begins, in nanoseconds, and a random part.
SPOOLED = r"-(\d{20})-[0-9a-f]{8}\.log$"


def in_file_order(text: DataFrame) -> DataFrame:
    """(source, seq, value) of a stream of files, each of which a micro-batch reads whole. A line's number is the byte at which its
    split begins and its place there, which rises along a file; files of a spool are one source, and begin with their time."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[tuple, int] = {}
        for rows in batches:
            split = rows.groupby(["name", "begin"], sort=False)
            seen = [at.get(k, 0) for k in zip(rows["name"], rows["begin"], strict=True)]
            seq = rows["begin"] + split.cumcount() + seen
            for k, n in split.size().items():
                at[k] = at.get(k, 0) + n
            spooled = rows["name"].str.extract(SPOOLED)[0]
            yield pd.DataFrame({"source": rows["name"].map(lambda n: re.sub(SPOOLED, "", n)), "seq": seq + spooled.fillna("0").astype("int64"), "value": rows["value"]})

    named = text.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("begin"), F.make_valid_utf8("value").alias("value"))
    return named.mapInPandas(number, "source string, seq long, value string")


def cut_lines(rows: DataFrame) -> DataFrame:
    """(source, seq, text, valid_utf8, flags) of (source, seq, value): a trailing carriage return goes; long lines are cut into
    pieces of MAX_LINE_BYTES bytes at most, which are flagged and numbered in order from their line's number on. Numbers must
    leave room for that, as byte offsets do; with none, rows are numbered as they stand."""
    clean = rows.select("source", "seq", F.regexp_replace("value", "\r$", "").alias("text"))
    long = F.octet_length("text") > MAX_LINE_BYTES
    cut = clean.select("source", F.col("seq").alias("_seq"), long.alias("_long"), F.posexplode(F.when(long, pieces(F.col("text"))).otherwise(F.array("text"))).alias("_piece", "text"))
    valid = ~F.contains(F.col("text"), F.lit("�"))
    flags = F.when(F.col("_long"), TRUNCATED).otherwise(0) + F.when(valid, 0).otherwise(INVALID_UTF8)
    seq = F.col("_seq") + F.col("_piece") if rows.isStreaming else F.monotonically_increasing_id()
    return cut.withColumn("seq", seq).select("source", "seq", "text", valid.alias("valid_utf8"), flags.alias("flags"))


def framed(text: DataFrame) -> DataFrame:
    """The lines of text files, with their files' names as sources."""
    return cut_lines(in_file_order(text) if text.isStreaming else text.select(F.col("_metadata.file_name").alias("source"), F.lit(None).cast("long").alias("seq"), "value"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All lines of a file or folder; gzip is transparent, file names are sources."""
    return framed(spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(path))


def stream_lines(spark: SparkSession, folder: str, pattern: str = "*.log*", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; files per trigger are the back-pressure."""
    return framed(spark.readStream.option("lineSep", "\n").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).text(folder))


def write_json_lines(rows: DataFrame, folder: str) -> None:
    """One JSON object a line, nulls included."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(folder)
