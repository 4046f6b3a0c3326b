"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "doctables", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the library defaults; keyword dots are written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Only when a local session names none (tests) a folder of this machine is set; on a cluster that is an error, since executors
    would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="doctables-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


# the tables of each open scope of passing(), the innermost scope last, and the paths of stored frames
_PASSING: list[list[str]] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end, not when the driver happens to collect garbage.

    Only for what is planned anew each time it runs, like a write: a frame that ran here would have to make its shuffles again.
    """
    was = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, was)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are removed at the end, but those to ``keep``, which belong to the scope around.

    So nothing lazy that reads one of them may leave the scope. After an error they stay.
    """
    _PASSING.append([])
    try:
        yield
    except BaseException:
        _PASSING.pop()
        raise
    _remove(spark, _PASSING.pop())


def drop(*stored_frames: DataFrame) -> None:
    """Remove the tables of frames that :func:`stored` returned, when nothing reads them any more."""
    for df in stored_frames:
        _remove(df.sparkSession, [_PATHS.pop(df)])


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps plan on a table instead of on all that made it.

    The table stays, unless it is stored inside :func:`passing`; with ``keep`` it belongs to the scope around the innermost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    if len(_PASSING) > keep:
        _PASSING[-1 - keep].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
