"""Session settings and lineage cuts that every operator shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Texts may be over 100 kB long, so a batch stays in the tens of MB.
ARROW_ROWS = 500

#: Days after which what a killed driver left in the shared folder is removed.
SWEEP_DAYS = 7

_own_dir: list[str] = []
_runs: set[str] = set()
_scopes: list[list[str]] = []


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests, benches and scripts."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", partitions)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Settings that operators with Python stages rely on; they apply to the running session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:  # Python workers import this package, wherever the driver was started
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="lexmill-"))
    return f"file://{_own_dir[0]}"


def scratch_path(spark: SparkSession, label: str, outer: bool = False) -> str:
    """A new path below the shared folder; it is removed at the end of the `scope` around it (with `outer`, of the next one), else when the driver ends.

    What drivers that were killed have left is removed after SWEEP_DAYS, by the next one.
    """
    base = f"{shared_dir(spark)}/lexmill"
    run = f"{base}/{spark.sparkContext.applicationId}"
    if run not in _runs:
        _runs.add(run)
        _sweep(spark, base)
        atexit.register(_remove, spark, run)
    path = f"{run}/{label}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if outer else _scopes
    for paths in scopes[-1:]:
        paths.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables cut inside when the block ends. What was derived from them must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def files(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _sweep(spark: SparkSession, base: str) -> None:
    store, place = files(spark, base)
    if store.exists(place):
        for found in store.listStatus(place):
            if found.getModificationTime() < 1000 * (time.time() - SWEEP_DAYS * 86_400):
                store.delete(found.getPath(), True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        store, place = files(spark, path)
        store.delete(place, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def cut(df: DataFrame, label: str, outer: bool = False, codec: str | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: it is computed once, and lost executors cost a reread.

    With `outer`, it outlives the `scope` around it; `codec` names the compression, if not the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label, outer)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """What changes when the files at a path do: their number, size and latest time."""
    store, place = files(spark, path)
    summary, status = store.getContentSummary(place), store.getFileStatus(place)
    return f"{summary.getFileCount()}-{summary.getLength()}-{status.getModificationTime()}"


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
