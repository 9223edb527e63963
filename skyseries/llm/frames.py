"""Small Spark helpers of this subpackage: given tables, written intermediate tables, batches."""

import atexit
import ctypes
import gc
import shutil
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from skyseries import session

_written: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this package's code to the executors, once per application; their Python finds it wherever it started."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(session.__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="code-")
        # Executors fetch it from here for as long as the driver runs.
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / "skyseries-code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, Path(root.name) / file.relative_to(root))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its shared folder is cleared by whoever set it
            return


class Written:
    """Tables of one run below the shared folder; each cuts the lineage of what reads it.

    ``drop`` removes one as soon as nothing reads it any more, the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base, self._parts = spark, session.shared_dir(spark, purpose), 0
        _written.append((spark, self.base))

    def put(self, df: DataFrame) -> DataFrame:
        self._parts += 1
        path = f"{self.base}/{self._parts}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _delete(self.spark, df._written_at)


@contextmanager
def plain_caches():
    """While a task fills large caches of plain values, there is nothing for the cycle collector to find in them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def give_back() -> None:
    """Return what Python and Arrow have freed to the system; else the driver holds it for all that comes after."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        return


def by_bytes(batches, column: str, limit: int = 1 << 20):
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes in each; one longer row stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
