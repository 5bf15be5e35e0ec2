"""A growing file as a stream: byte ranges that end with a line are the offsets."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .lines import cut_lines

#: Bytes of one read task.
RANGE_BYTES = 16 << 20


class ByteRange(InputPartition):
    """Lines that begin in a part of a file; of one that was rotated away, with a last line that has no end."""

    def __init__(self, path: str, start: int, end: int, rotated: bool = False):
        self.path, self.start, self.end, self.rotated = path, start, end, rotated


class TailReader(DataSourceStreamReader):
    """Offsets are (inode, whole bytes). A file that shrank is read from its start. With a new inode, what was
    not read of the one before is read first, its last line too, if it has been renamed within the folder; then the
    new file from its start."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"inode": 0, "end": 0}

    def latestOffset(self) -> dict:
        try:
            with Path(self.path).open("rb") as f:
                stat = os.fstat(f.fileno())
                end = stat.st_size
                while end > 0:  # back to the last line end
                    begin = max(0, end - 65_536)
                    f.seek(begin)
                    at = f.read(end - begin).rfind(b"\n")
                    if at >= 0:
                        return {"inode": stat.st_ino, "end": begin + at + 1}
                    end = begin
                return {"inode": stat.st_ino, "end": 0}
        except FileNotFoundError:
            return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        same = start["inode"] == end["inode"]
        begin = start["end"] if same and start["end"] <= end["end"] else 0
        parts = []
        if not same and start["inode"]:
            for old in Path(self.path).parent.iterdir():
                if old.is_file() and (stat := old.stat()).st_ino == start["inode"]:
                    parts = [ByteRange(str(old), at, min(at + RANGE_BYTES, stat.st_size), True) for at in range(start["end"], stat.st_size, RANGE_BYTES)]
        return parts + [ByteRange(self.path, at, min(at + RANGE_BYTES, end["end"])) for at in range(begin, end["end"], RANGE_BYTES)]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        """Lines that begin in the range, as in any split of a text file."""
        with Path(part.path).open("rb") as f:
            at = part.start
            if at > 0:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < part.end:
                line = f.readline()
                if not line.endswith(b"\n") and not (part.rotated and line):
                    return
                # What was left of a file that was rotated away comes before the new one, whose offsets begin at 0 again.
                yield at - (1 << 62 if part.rotated else 0), line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "seq long, text string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def stream_tail(spark: SparkSession, path: str) -> DataFrame:
    """(source, seq, text, valid_utf8, flags) of a file that grows at a shared path; seq is the line's byte offset. Long lines are cut
    and flagged as those of other sources."""
    spark.dataSource.register(Tail)
    rows = spark.readStream.format("tail").option("path", path).load()
    return cut_lines(rows.select(F.lit(Path(path).name).alias("source"), "seq", F.col("text").alias("value")))
