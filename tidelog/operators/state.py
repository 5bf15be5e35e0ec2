"""Baselines kept between runs: volumes, numeric samples, error windows and exclusions in one table."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, stored
from .baselines import RING
from .ordered import running_sums

#: Newest samples kept of each kind and key.
KEEP = {"volume": RING, "numeric": 128, "error": 512, "exclusion": 100}
SCHEMA = "kind string, key string, slot int, at double, value double, more double"


def volume_state(volumes: DataFrame) -> DataFrame:
    """Rows of hourly volumes (template_text, bucket, n)."""
    slot = ((F.col("bucket") + 72) % 168).cast("int")
    return volumes.select(F.lit("volume").alias("kind"), F.col("template_text").alias("key"), slot.alias("slot"), (F.col("bucket") * 3600.0).alias("at"), F.col("n").cast("double").alias("value"), F.lit(None).cast("double").alias("more"))


def numeric_state(samples: DataFrame) -> DataFrame:
    """Rows of numeric samples (key, at, value)."""
    return samples.select(F.lit("numeric").alias("kind"), "key", F.lit(0).alias("slot"), "at", F.col("value").cast("double").alias("value"), F.lit(None).cast("double").alias("more"))


def error_state(windows: DataFrame) -> DataFrame:
    """Rows of error windows (start, total, errors)."""
    return windows.select(F.lit("error").alias("kind"), F.lit("").alias("key"), F.lit(0).alias("slot"), F.col("start").cast("double").alias("at"), F.col("total").cast("double").alias("value"), F.col("errors").cast("double").alias("more"))


def exclusion_state(intervals: DataFrame) -> DataFrame:
    """Rows of intervals (start, end) in seconds."""
    return intervals.select(F.lit("exclusion").alias("kind"), F.lit("").alias("key"), F.lit(0).alias("slot"), F.col("start").cast("double").alias("at"), F.col("end").cast("double").alias("value"), F.lit(None).cast("double").alias("more"))


def trimmed(state: DataFrame, max_rows: int | None = None, max_keys: int = 20_000) -> DataFrame:
    """The newest samples of each key and slot, without those that an exclusion covers, of the `max_keys`
    keys seen last; with `max_rows`, the same newest share of every key's samples."""
    ring = Window.partitionBy("kind", "key", "slot").orderBy(F.desc("at"), F.desc("value"))
    kept = F.element_at(F.create_map(*[F.lit(x) for kv in KEEP.items() for x in kv]), F.col("kind"))
    newest = state.withColumn("_back", F.row_number().over(ring)).filter(F.col("_back") <= kept).drop("_back")
    spans = newest.filter("kind = 'exclusion'").select(F.col("at").alias("_start"), F.col("value").alias("_end"))  # at most 100
    clean = newest.join(F.broadcast(spans), (F.col("kind") != "exclusion") & (F.col("at") >= F.col("_start")) & (F.col("at") < F.col("_end")), "left_anti")
    last = clean.groupBy("kind", "key").agg(F.max("at").alias("_last"), F.count("*").alias("_weight"))
    # The newest keys by a top-n; the rest are forgotten.
    keys = last.orderBy(F.desc("_last"), F.desc("_weight"), "kind", "key").limit(max_keys).select("kind", "key")
    out = clean.join(keys, ["kind", "key"], "left_semi")
    if max_rows is None:
        return out
    whole = out.agg(F.count("*").alias("_whole"))
    share = F.least(F.lit(1.0), F.lit(float(max_rows)) / F.greatest("_whole", F.lit(1)))
    ranked = out.withColumns({"_back": F.row_number().over(ring), "_size": F.count("*").over(Window.partitionBy("kind", "key", "slot"))})
    return ranked.join(F.broadcast(whole)).filter(F.col("_back") <= F.greatest(F.lit(1.0), F.floor(F.col("_size") * share))).drop("_back", "_size", "_whole")


def within_bytes(state: DataFrame, most: int) -> DataFrame:
    """`state` without its oldest samples, so that it has `most` bytes at most: in passes, each of which takes the oldest sample of every key
    in the order of keys, and error windows after all others; exclusions stay.

    A row counts as its texts and 28 bytes. Rows are put in the order in which they would go, their bytes summed up by ranges
    of that order, and the cut found in the sums: a water level, without a loop.
    """
    size = F.octet_length("kind") + F.octet_length("key") + 28
    oldest = Window.partitionBy("kind", "key").orderBy("at", "slot", "value")  # rings, of a bounded length a key
    sized = state.withColumn("_size", size.cast("long"))
    fixed = sized.filter("kind = 'exclusion'")
    ranked = sized.filter("kind <> 'exclusion'").withColumns({"_pass": F.row_number().over(oldest), "_late": F.when(F.col("kind") == "error", 1).otherwise(0)})
    summed = running_sums(ranked.withColumn("_upto", F.col("_size")), ["_late", "_pass", "kind", "key"], ["_upto"])
    whole = sized.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_whole"))
    kept = summed.join(F.broadcast(whole)).filter(F.col("_whole") - (F.col("_upto") - F.col("_size")) <= most)
    return kept.select(state.columns).unionByName(fixed.select(state.columns))


class StateTable:
    """Versions of a state below a folder: whole snapshots, each with a manifest that tells its rows and their checksum.

    A version counts once its manifest has its name. A version that can't be read, or isn't what its manifest says, is
    put aside under another name, and the one before it is used; `set_aside` names it. Saving keeps the `keep` newest versions,
    in files of about `file_rows` rows, and deletes older ones and what was left by a save that failed.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3, file_rows: int = 1_000_000):
        self.spark, self.folder, self.keep, self.file_rows = spark, folder.rstrip("/"), keep, file_rows
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.set_aside: list[str] = []

    def _path(self, name: str) -> Any:
        return self.hadoop.Path(f"{self.folder}/{name}")

    def _names(self) -> list[str]:
        root = self.hadoop.Path(self.folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(root)) if self.fs.exists(root) else []

    def versions(self) -> list[int]:
        """Those that have a manifest, in order."""
        return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    @staticmethod
    def _checked(rows: DataFrame) -> dict:
        n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
        return {"rows": n, "checksum": str(total or 0)}

    def _read(self, version: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/version-{version}")

    def save(self, state: DataFrame, version: int | None = None) -> int:
        version = time.time_ns() // 1_000_000 if version is None else version
        rows = stored(state.select(*[part.split()[0] for part in SCHEMA.split(", ")]), "state")
        said = self._checked(rows)
        rows.coalesce(max(1, -(-said["rows"] // self.file_rows))).write.mode("overwrite").parquet(f"{self.folder}/version-{version}")
        out = self.fs.create(self._path(f".manifest-{version}"), True)
        try:
            out.write(bytearray(json.dumps(said).encode()))
        finally:
            out.close()
        self.fs.delete(self._path(f"manifest-{version}.json"), False)
        self.fs.rename(self._path(f".manifest-{version}"), self._path(f"manifest-{version}.json"))
        self.prune()
        discard(rows)
        return version

    def prune(self) -> None:
        known = self.versions()
        for version in known[: -self.keep]:
            self.fs.delete(self._path(f"manifest-{version}.json"), False)
        for name in self._names():
            if name.startswith("version-") and int(name.removeprefix("version-")) not in known[-self.keep :] and known and int(name.removeprefix("version-")) < known[-1]:
                self.fs.delete(self._path(name), True)

    def load(self) -> DataFrame:
        """The newest version that is whole; an empty table where there is none."""
        for version in reversed(self.versions()):
            try:
                stream = self.fs.open(self._path(f"manifest-{version}.json"))
                said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
                rows = self._read(version)
                if self._checked(rows) == said:
                    return rows
            except Exception as e:  # noqa: BLE001  whatever is wrong with it, it isn't the state
                self.set_aside.append(f"version-{version}: {type(e).__name__}")
            else:
                self.set_aside.append(f"version-{version}: not what its manifest says")
            self.fs.rename(self._path(f"version-{version}"), self._path(f"corrupt-{version}"))
            self.fs.rename(self._path(f"manifest-{version}.json"), self._path(f"corrupt-{version}.json"))
        return self.spark.createDataFrame([], SCHEMA)


def save(state: DataFrame, folder: str, version: int | None = None) -> int:
    """A new version of the table in a folder."""
    return StateTable(state.sparkSession, folder).save(state, version)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole version; a folder never written to gives an empty table."""
    return StateTable(spark, folder).load()


def resumed(saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """Saved and fresh rows as if they had come in one run; a sample of both counts once."""
    return trimmed(saved.unionByName(fresh).distinct())
