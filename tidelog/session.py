"""Session settings, and the way this package reaches the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent

#: What results depend on.
SEMANTIC = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}

_shipped: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("tidelog")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config(map=SEMANTIC).getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on, and send the package to Python workers that can't import it."""
    for key, value in SEMANTIC.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and context.applicationId not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="tidelog-ship-")) / "tidelog.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in (ROOT / "tidelog").rglob("*.py"):
                z.write(p, p.relative_to(ROOT))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared spark.checkpoint.dir; on one machine, a temporary one where none is set."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and not re.match(r"local($|\[)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidelog-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/tidelog/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a write go as soon as the table is there (a runtime setting of Spark).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that only tables stored later were made from. Nothing is deleted outside scratch()."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in table.inputFiles() if "/tidelog/" in f}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
