"""Streams of messages: every micro-batch runs the batch plan and becomes one batch of the store.

Progress is committed after the batch is stored. A batch that fails half-way runs again under the same
number and replaces what it wrote, so each message takes effect once. Late and repeated values are
always accepted and overwrite; there is no watermark, because the state is the store itself.
"""

import time
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skyseries import session
from skyseries.plans.ingest import SideTables, ingest_batch
from skyseries.plans.qc_ingest import qc_batch
from skyseries.sources.store import Store

# Fixed value: minutes after which side tables are read again.
REFRESH_MINUTES = 30


class Refreshed:
    """A value that is loaded again when it is older than ``minutes``; asked once per micro-batch."""

    def __init__(self, load: Callable, minutes: float = REFRESH_MINUTES, clock: Callable = time.monotonic):
        self._load, self._seconds, self._clock = load, minutes * 60, clock
        self._value, self._loaded_at = None, None

    def get(self):
        now = self._clock()
        if self._loaded_at is None or now - self._loaded_at >= self._seconds:
            self._value, self._loaded_at = self._load(), now
        return self._value


class Versions:
    """Side tables as versions in a store: `sides/<family>/version=<v>/<table>`, and a marker per batch of the one it saw.

    A version is complete before a batch is marked with it, and is never changed.
    """

    def __init__(self, root: str, load: Callable[[], SideTables], minutes: float = REFRESH_MINUTES, clock: Callable = time.monotonic,
                 family: str = "observations"):
        self._root, self._load, self._seconds, self._clock, self._family = f"{root}/sides/{family}", load, minutes * 60, clock, family
        self._loaded_at = None

    def of_batch(self, store: Store, batch: int) -> SideTables:
        """The version that a batch saw when it arrived; a batch that arrives now sees the newest, or a new one."""
        seen = store.side_versions(self._family)
        now = self._clock()
        if batch in seen:
            return self._read(store, seen[batch])
        if self._loaded_at is None or now - self._loaded_at >= self._seconds or not seen:
            version = 1 + max(seen.values(), default=0)
            side = self._load()
            for f in fields(SideTables):
                getattr(side, f.name).write.mode("overwrite").parquet(f"{self._root}/version={version}/{f.name}")
            self._loaded_at = now
        else:
            version = max(seen.values())
        store.mark_side_version(self._family, batch, version)
        return self._read(store, version)

    def _read(self, store: Store, version: int) -> SideTables:
        path = f"{self._root}/version={version}"
        return SideTables(**{f.name: store.spark.read.parquet(f"{path}/{f.name}") for f in fields(SideTables)})


class Held:
    """Loads side tables and keeps what they held then: every use until the next load reads the same rows.

    The rows are written to the shared folder, so a database is asked once per load and a batch sees one state of it.
    """

    def __init__(self, spark: SparkSession, load: Callable[[], SideTables]):
        self._spark, self._load, self._path = spark, load, None

    def __call__(self) -> SideTables:
        path = session.shared_dir(self._spark, "side-tables")
        tables = {f.name: getattr(side, f.name) for side in [self._load()] for f in fields(SideTables)}
        held = SideTables(**{name: session.written(df, f"{path}/{name}") for name, df in tables.items()})
        if self._path:
            session.remove(self._spark, self._path)
        self._path = path
        return held


def _start(messages: DataFrame, run_batch, checkpoint: str, trigger: dict) -> StreamingQuery:
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder: without one it would read anew and replace stored batches")
    session.prepare(messages.sparkSession)
    writer = messages.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_stream(store: Store, messages: DataFrame, side: Callable[[], SideTables], checkpoint: str,
                  first_batch: int | None = None, refresh_minutes: float = REFRESH_MINUTES, **trigger) -> StreamingQuery:
    """Observation messages into the store. The only writer of the series registry while it runs.

    ``side`` loads the catalogue and permits. They are kept in the store as versions: a new one is taken when the last is
    ``refresh_minutes`` old, and a batch that runs again sees the version of its arrival. ``checkpoint`` is where progress
    is kept; give the same folder to go on after a stop. Batches are numbered from the first number that is free in the
    store when the stream starts for the first time, or from ``first_batch``. Further options are those of the trigger;
    without any, the stream stops when it has read what there is.
    """
    versions = Versions(store.root, side, refresh_minutes)
    first = first_batch if first_batch is not None else store.stream_start(checkpoint, "observations") if checkpoint else 0

    def run(df, batch_id):
        own = Store(df.sparkSession, store.root)
        ingest_batch(own, df, versions.of_batch(own, first + batch_id), first + batch_id)

    return _start(messages, run, checkpoint, trigger)


def qc_stream(store: Store, messages: DataFrame, checkpoint: str, first_batch: int | None = None, retry: bool = True,
              side: Callable[[], SideTables] | None = None, refresh_minutes: float = REFRESH_MINUTES, **trigger) -> StreamingQuery:
    """Quality-control messages into the flag table; only reads the series registry. With ``side``, permits are looked at.

    Batches are numbered as by `ingest_stream`, among those of control records.
    """
    versions = Versions(store.root, side, refresh_minutes, family="control") if side else None
    first = first_batch if first_batch is not None else store.stream_start(checkpoint, "control") if checkpoint else 0

    def run(df, batch_id):
        own = Store(df.sparkSession, store.root)
        qc_batch(own, df, first + batch_id, versions.of_batch(own, first + batch_id) if versions else None, retry)

    return _start(messages, run, checkpoint, trigger)
