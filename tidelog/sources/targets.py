"""What a target on the command line stands for: `-` or `stdin`, `dir:PATH`, `tcp:HOST:PORT`, else a file."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .lines import read_lines, stream_lines
from .spool import LineServer, LiveSpool, spool_stream
from .tail import stream_tail


@dataclass(frozen=True)
class Target:
    kind: str
    value: str = ""

    @classmethod
    def parse(cls, text: str) -> Target:
        if text in ("-", "stdin"):
            return cls("stdin")
        kind, _, value = text.partition(":")
        if kind == "tcp":
            host, _, port = value.rpartition(":")
            if not port.isdigit() or not host:
                raise ValueError(f"tcp:HOST:PORT expected, got {text}")
        return cls(kind, value) if kind in ("dir", "tcp") else cls("file", text)


def read(spark: SparkSession, target: Target, spool: str) -> DataFrame:
    """All lines there are now. Standard input is spooled to the shared folder first."""
    if target.kind == "tcp":
        raise ValueError("a socket has no end; use a stream")
    if target.kind == "stdin":
        spool_stream(sys.stdin.buffer, spool)
        return read_lines(spark, spool, "*.log")
    if not Path(target.value).exists() and "://" not in target.value:
        raise FileNotFoundError(target.value)
    return read_lines(spark, target.value, "*.log*") if target.kind == "dir" else read_lines(spark, target.value)


def stream(spark: SparkSession, target: Target, spool: str, once: bool = False) -> DataFrame:
    """Lines as they come; standard input is read to its end first if it is to be followed `once`."""
    if target.kind == "file":
        return stream_tail(spark, target.value)
    if target.kind == "dir":
        return stream_lines(spark, target.value)
    if target.kind == "tcp":
        host, _, port = target.value.rpartition(":")
        Path(spool).mkdir(parents=True, exist_ok=True)
        LineServer(host, int(port), spool).start()
    elif once:
        spool_stream(sys.stdin.buffer, spool)
    else:
        LiveSpool(sys.stdin.buffer, spool).start()
    return stream_lines(spark, spool, "*.log")
