"""Lines that arrive at one machine, written to a shared folder that a stream reads.

Standard input and sockets can't be read again after a failure; files can. Each file is
written under a hidden name and renamed when whole, so a stream never sees half of one.
"""

from __future__ import annotations

import socketserver
import threading
import time
import uuid
from pathlib import Path
from typing import BinaryIO


class Spool:
    """Whole lines into files of about `max_bytes` bytes, or `max_age_s` seconds, under `folder`."""

    def __init__(self, folder: str, name: str, max_bytes: int = 8 << 20, max_age_s: float = 5.0):
        self.folder, self.name, self.max_bytes, self.max_age_s = Path(folder), name, max_bytes, max_age_s
        self.folder.mkdir(parents=True, exist_ok=True)
        self.lock, self.file, self.size, self.opened, self.n = threading.Lock(), None, 0, 0.0, 0

    def write(self, line: bytes) -> None:
        with self.lock:
            if self.file is None:
                self.path = self.folder / f"{self.name}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.log"
                self.hidden = self.path.with_name("." + self.path.name)
                self.file, self.size, self.opened = self.hidden.open("wb"), 0, time.monotonic()
            self.file.write(line if line.endswith(b"\n") else line + b"\n")
            self.size += len(line)
            if self.size >= self.max_bytes or time.monotonic() - self.opened >= self.max_age_s:
                self._roll()

    def roll(self) -> None:
        with self.lock:
            self._roll()

    def _roll(self) -> None:
        if self.file is not None:
            self.file.close()
            self.hidden.rename(self.path)
            self.file = None


def spool_stream(stream: BinaryIO, folder: str, name: str = "stdin") -> None:
    """All lines of a stream until it ends."""
    spool = Spool(folder, name)
    for line in stream:
        spool.write(line)
    spool.roll()


class LiveSpool:
    """Lines of a stream into a spool as they come, by a thread of its own; a file is there `max_age_s` seconds after its first line at the
    latest, whether others follow or not."""

    def __init__(self, stream: BinaryIO, folder: str, name: str = "stdin", max_age_s: float = 1.0):
        self.stream, self.spool, self.ended = stream, Spool(folder, name, max_age_s=max_age_s), threading.Event()

    def start(self) -> LiveSpool:
        for work in (self._read, self._age):
            threading.Thread(target=work, daemon=True).start()
        return self

    def _read(self) -> None:
        try:
            for line in iter(self.stream.readline, b""):
                self.spool.write(line)
        finally:
            self.spool.roll()
            self.ended.set()

    def _age(self) -> None:
        while not self.ended.wait(self.spool.max_age_s / 4):
            if self.spool.file is not None and time.monotonic() - self.spool.opened >= self.spool.max_age_s:
                self.spool.roll()


class LineServer(socketserver.ThreadingTCPServer):
    """Many clients' lines into a spool; what a client leaves without a line end is discarded."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, host: str, port: int, folder: str):
        self.spool = Spool(folder, f"tcp-{port}")
        super().__init__((host, port), _Client)

    def start(self) -> LineServer:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def service_actions(self) -> None:
        if self.spool.file is not None and time.monotonic() - self.spool.opened >= self.spool.max_age_s:
            self.spool.roll()

    def stop(self) -> None:
        self.shutdown()
        self.server_close()
        self.spool.roll()


class _Client(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        for line in self.rfile:
            if line.endswith(b"\n"):
                self.server.spool.write(line)
