"""Session settings and the shared work folder. No session is created here."""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # All times are UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins shuffle by all their keys: rows of one series spread by time as well.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on; call before building any plan."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_local_base: str | None = None
_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_made() -> None:
    """Work folders go when the process ends, wherever the shared folder is."""
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; its shared folder is cleared by whoever set it
            return


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor sees, below ``spark.checkpoint.dir``; it goes when the process ends.

    A machine-local folder is used only where the master is local and the setting is absent.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="skyseries-")
            atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
        base = _local_base
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of `shared_dir`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_cleared(spark: SparkSession):
    """While the block runs, the shuffle files of every statement go when it ends, not when the driver happens to collect it.

    What was planned inside is to be run inside, and once: a frame that runs again makes its shuffles anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def broadcasts_measured(spark: SparkSession):
    """While the block runs, only what was counted while a query ran is broadcast, never what the planner guesses from files.

    Files of keys and labels are many times smaller than what the driver builds for a broadcast of them. What was planned
    inside is to be run inside.
    """
    key, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit, given = spark.conf.get(key), spark.conf.get(measured, None)
    if limit == "-1":
        yield
        return
    spark.conf.set(measured, given or limit)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, limit)
        if given is None:
            spark.conf.unset(measured)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df``, computed once and written to ``path``.

    What reads them has a short plan, a size the planner knows, and does not depend on executors staying alive.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, purpose: str):
    """`written` below the shared folder for as long as the block runs."""
    path = shared_dir(df.sparkSession, purpose)
    try:
        yield written(df, path)
    finally:
        remove(df.sparkSession, path)
        _made[:] = [made for made in _made if made[1] != path]
