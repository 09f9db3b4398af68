"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger(__name__)
#: Settings that the engine relies on; build() applies them, a given session keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Settings of show_whole.
DISPLAY = {"spark.sql.repl.eagerEval.enabled": "true", "spark.sql.repl.eagerEval.maxNumRows": "1000", "spark.sql.repl.eagerEval.truncate": "1000"}


def build(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, then conf (dots written as in Spark)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all of Spark runs on this machine, a temporary folder
    is set and used; on a cluster, whose machines would each have one of their own, that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        d = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def jpath(spark: SparkSession, path: str):
    """(file system, Hadoop path) of path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def show_whole(spark: SparkSession) -> None:
    """Notebooks and the shell show rows of any width and texts whole, without an action being asked for."""
    for k, v in DISPLAY.items():
        spark.conf.set(k, v)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = jpath(spark, path)
    fs.delete(p, True)


_open = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What scratch and stage make in this thread within the scope goes at its end, for work that is repeated for ever."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            try:
                remove(spark, path)
            except Exception:
                LOG.warning("could not remove %s", path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the scope, or else when this process ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if scopes := _open.__dict__.get("scopes"):
        scopes[-1].append(path)
        return path

    def clean(pid: int = os.getpid()) -> None:
        try:
            if os.getpid() == pid and spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:
            pass

    atexit.register(clean)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and the loss of an executor costs nothing before it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
