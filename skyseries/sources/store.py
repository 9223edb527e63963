"""The stored tables: append logs of parquet, one folder per batch and attempt, and markers of what counts.

    <root>/<table>/batch=<n>/attempt=<k>/[obs_bucket=<year>/obs_month=<yyyymm>/ or key_bucket=<b>/]*.parquet
    <root>/_commits/<n>-<k>-<group of tables>      what counts
    <root>/_commits/<n>-<k>-top<id>                the largest series id of a batch
    <root>/_folds/<table>/<n>                      which folder holds each month after folding
    <root>/_ranges                                 first years of the storage ranges, if they are not the usual ones

A batch is written as a whole under a new attempt, then one marker makes all its tables count at once: readers see a batch
completely or not at all, and a batch that runs again replaces its former attempt in the same way. Files are only ever
created, which every file system does atomically. A batch number belongs to the group of tables that took it first.

A log holds at most one row per key and batch; reads keep the row that arrived last. Values are further split by year range
and month of their time, which is what prunes a read over a time range or at an instant; the registry by a hash of station,
type, level and sensor, so that a batch looks up its labels in their buckets alone. Beside the values of each batch stands
the newest of every series in it.
"""

import hashlib
import json
import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyseries import schema, session
from skyseries.functions.times import BUCKET_YEARS, bucket_filter, month_filter, obs_bucket, obs_month
from skyseries.operators import registry as reg
from skyseries.operators.qc import PAYLOAD
from skyseries.operators.skew import keys_equal
from skyseries.operators.slices import newest_of_batch, newest_writes
from skyseries.operators.upsert import VALUE_KEY, latest_wins

SCHEMAS = {
    "registry": f"{schema.REGISTRY}, key_bucket INT",
    "data": schema.DATA,
    "nonscalar_data": schema.NONSCALAR_DATA,
    "qc_flags": schema.QC_FLAGS,
    "rejects": schema.REJECTS,
    "qc_rejects": schema.REJECTS,
    "receipts": schema.RECEIPTS,
    "quarantine": schema.QUARANTINE,
    "qc_state": schema.QC_STATE,
    "newest": schema.NEWEST,
}
VALUE_PAYLOAD = {"data": ["obsvalue"], "nonscalar_data": ["obsvalue"], "qc_flags": PAYLOAD}
PLACE = ["obs_bucket", "obs_month"]

# Tables that are written and numbered together.
FAMILIES = {
    "observations": ("registry", "data", "nonscalar_data", "receipts", "rejects"),
    "control": ("qc_flags", "quarantine", "qc_rejects", "qc_state"),
}
GROUPS = {
    **FAMILIES, "load": ("registry", "data", "rejects"),
    **{table: (table,) for table in SCHEMAS if table != "newest"},
}
# A marker of this kind says that the batches of a family up to its number are folded into one.
FOLDED = "folded"
TOP, NEWEST = "top", "newest"
# Newest rows of so many batches are merged into one set.
NEWEST_BATCHES = 16
# Attempts from here on are months folded in place.
FOLD_ATTEMPT = 1_000_000


class Store:
    """Tables below one root folder, on a file system that all executors share. One writer per family at a time.

    ``ranges`` are the first years of the storage ranges of a new store, the last one being the end; a store that holds
    something keeps its own.
    """

    def __init__(self, spark: SparkSession, root: str, ranges: list[int] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        kept = self._read("_ranges")
        self.ranges = json.loads(kept) if kept else list(ranges or BUCKET_YEARS)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _files(self, name: str):
        """A file or folder of the store, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._files(folder)
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return [name for name in names if not name.startswith(".")]

    def _create(self, name: str, text: str = "") -> None:
        path, files = self._files(name)
        out = files.create(path, False)
        if text:
            out.write(bytearray(text.encode()))
        out.close()

    def _read(self, name: str) -> str | None:
        path, files = self._files(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commits(self) -> list[tuple[int, int, str]]:
        """Batch, attempt and group of every marker."""
        parts = [name.split("-", 2) for name in self._names("_commits")]
        return [(int(batch), int(attempt), group) for batch, attempt, group in parts]

    def _mark(self, batch: int, attempt: int, group: str) -> None:
        self._create(f"_commits/{batch}-{attempt}-{group}")

    def batches(self, table: str, commits: list | None = None) -> dict[int, int]:
        """The batches of a table that count, each with its attempt."""
        found: dict[int, int] = {}
        for batch, attempt, group in self._commits() if commits is None else commits:
            if table in GROUPS.get(group, ()):
                found[batch] = max(attempt, found.get(batch, 0))
        return found

    def first_free(self, family: str = "observations") -> int:
        """The first number after all batches of a family's tables, whoever wrote them."""
        members = set(FAMILIES[family])
        return 1 + max((b for b, _, group in self._commits() if members & set(GROUPS.get(group, ()))), default=-1)

    def stream_start(self, checkpoint: str, family: str) -> int:
        """Number of the first batch of the stream with this checkpoint folder: found once, kept over restarts."""
        name = hashlib.sha256(f"{family} {checkpoint}".encode()).hexdigest()[:24]
        for found in self._names("_streams"):
            if found.startswith(f"{name}-"):
                return int(found.rsplit("-", 1)[1])
        first = self.first_free(family)
        self._create(f"_streams/{name}-{first}")
        return first

    def side_versions(self, family: str) -> dict[int, int]:
        """The version of the side tables that each batch of a family's stream saw."""
        return {int(b): int(v) for b, v in (name.split("-") for name in self._names(f"_sides/{family}"))}

    def mark_side_version(self, family: str, batch: int, version: int) -> None:
        self._create(f"_sides/{family}/{batch}-{version}")

    def top_id(self) -> int:
        """The largest series id that was given, from the markers alone."""
        commits = self._commits()
        counted = {(b, a) for b, a, group in commits if "registry" in GROUPS.get(group, ())}
        return max((int(group[len(TOP):]) for b, a, group in commits if group.startswith(TOP) and (b, a) in counted), default=0)

    def _put(self, table: str, df: DataFrame, batch: int, attempt: int, more: bool = False) -> None:
        fields = self.spark.createDataFrame([], SCHEMAS[table]).schema.fields
        place = PLACE if table in VALUE_PAYLOAD else ["key_bucket"] if table == "registry" else []
        if table in VALUE_PAYLOAD and not set(PLACE) <= set(df.columns):
            time = F.col("obstime")
            df = df.withColumns({"obs_bucket": obs_bucket(time, self.ranges), "obs_month": obs_month(time, self.ranges)})
        elif table == "registry":
            df = df.withColumn("key_bucket", reg.key_bucket())
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields if f.name != "batch"])
        if table == "registry":
            # Buckets stand together; a large one is split, small ones share a task.
            rows = rows.hint("rebalance", "key_bucket")
        if place:
            rows = rows.sortWithinPartitions(*place, *(VALUE_KEY if table in VALUE_PAYLOAD else ["timeseries"]))
        # What an attempt without a marker has left goes, also where a session overwrites partitions one by one.
        writer = rows.write.mode("append" if more else "overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*place) if place else writer).parquet(f"{self._path(table)}/batch={batch}/attempt={attempt}")

    def _attempt(self, table: str, batch: int, attempt: int) -> DataFrame:
        """The rows of one attempt, whether it counts or not."""
        path = f"{self._path(table)}/batch={batch}/attempt={attempt}"
        return self.spark.read.schema(SCHEMAS[table]).option("basePath", self._path(table)).parquet(path)

    def write_all(self, tables: dict[str, DataFrame | list[DataFrame]], batch: int) -> None:
        """One batch of several tables, written side by side; it counts when all are there. Any failure is raised.

        A number that another group of tables holds is refused where both write a table. A function in place of a table is
        called with the attempt when the others are written, and makes its table from those. Of a list of frames, each is
        written when the one before is there; a key is in one of them only. Values outside the storage ranges are not stored.
        """
        batch, commits = int(batch), self._commits()
        group = next(name for name, members in GROUPS.items() if set(members) == set(tables))
        for family, members in FAMILIES.items():
            folded = [b for b, _, kind in commits if kind == f"{FOLDED}-{family}"]
            folded += [fold["upto"] for fold in map(self._fold, members) if fold]
            if folded and batch <= max(folded) and set(members) & set(tables):
                raise ValueError(f"batches up to {max(folded)} are folded into one, {batch} cannot be written")
        holder = next((g for b, _, g in commits if b == batch and g != group and set(GROUPS.get(g, ())) & set(tables)), None)
        if holder:
            raise ValueError(f"batch {batch} was written as {holder}, it cannot be written as {group}")
        attempt = 1 + max((a for b, a, _ in commits if b == batch and a < FOLD_ATTEMPT), default=0)
        if not commits and self.ranges != list(BUCKET_YEARS) and self._read("_ranges") is None:
            self._create("_ranges", json.dumps(self.ranges))
        top = []

        def write(item):
            table, shares = item
            for i, df in enumerate(shares if isinstance(shares, list) else [shares]):
                self._put(table, df, batch, attempt, **({"more": True} if i else {}))
            if table == "registry":
                top.append(self._attempt(table, batch, attempt).agg(F.max("timeseries")).first()[0])
            elif table == "data":
                inside = self._attempt(table, batch, attempt).where(F.col("obs_month").isNotNull())
                self._put("newest", newest_of_batch(inside), batch, attempt)

        ready = {table: df for table, df in tables.items() if not callable(df)}
        with ThreadPoolExecutor(len(ready)) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(write), ready.items()))
        for table in tables.keys() - ready.keys():
            write((table, tables[table](attempt)))
        for table in tables.keys() & VALUE_PAYLOAD.keys():
            path, files = self._files(f"{table}/batch={batch}/attempt={attempt}/obs_bucket=__HIVE_DEFAULT_PARTITION__")
            files.delete(path, True)
        for number in filter(None, top):
            self._mark(batch, attempt, f"{TOP}{number}")
        self._mark(batch, attempt, group)
        if "data" in tables:
            self._merge_newest()

    def write(self, table: str, df: DataFrame, batch: int) -> None:
        """One batch of one table."""
        self.write_all({table: df}, batch)

    def log(self, table: str, before: int | None = None, only: int | None = None) -> DataFrame:
        """All rows of a table that count, or those of the batches before one, or of one; empty when there are none."""
        return self._log(table, before, only).drop("key_bucket")

    def _log(self, table: str, before: int | None = None, only: int | None = None) -> DataFrame:
        counted, fold = self.batches(table), self._fold(table)
        upto = fold["upto"] if fold else -1
        if (before is not None and before <= upto) or (only is not None and only <= upto):
            raise ValueError(f"{table}: batches up to {upto} are folded by month")
        chosen = {b: a for b, a in counted.items() if b > upto and (before is None or b < before) and only in (None, b)}
        paths = sorted(set(fold["months"].values())) if fold and only is None else []
        paths = [f"{self._path(table)}/{p}" for p in paths]
        paths += [f"{self._path(table)}/batch={b}/attempt={a}" for b, a in sorted(chosen.items())]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = self.spark.read.schema(SCHEMAS[table]).option("basePath", self._path(table)).parquet(*paths)
        return rows.drop("attempt")

    def registry(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All series, or those of some key buckets, of which alone the files are read."""
        rows = self._log("registry", before)
        if buckets is not None:
            rows = rows.where(F.col("key_bucket").isin(buckets))
        return rows.drop("key_bucket")

    def timeseries(self) -> DataFrame:
        return reg.timeseries_table(self.registry())

    def labels_met(self, buckets: list[int] | None = None) -> DataFrame:
        return reg.labels_met(self.registry(buckets=buckets))

    def labels_source(self) -> DataFrame:
        return reg.labels_source(self.registry())

    def value_log(self, table: str = "data", start=None, end=None, months: list[int] | None = None) -> DataFrame:
        """Rows of a value log in a closed time range, or of some months (`yyyymm`), reading only the months it touches."""
        rows = self.log(table)
        if months is not None:
            rows = rows.where(F.col("obs_month").isin(months))
        if start is not None or end is not None:
            rows = rows.where(bucket_filter(start, end, ranges=self.ranges) & month_filter(start, end))
        if start is not None:
            rows = rows.where(F.col("obstime") >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col("obstime") <= F.lit(end))
        return rows

    def current(self, log: DataFrame, table: str = "data") -> DataFrame:
        """Last write of every series and time of a part of a value log; as it is if a single batch or fold holds all."""
        fold = self._fold(table)
        later = [b for b in self.batches(table) if not fold or b > fold["upto"]]
        if len(later) + bool(fold) <= 1:
            return log.select(*VALUE_KEY, *VALUE_PAYLOAD[table])
        return current(log, table)

    def values(self, table: str = "data", start=None, end=None) -> DataFrame:
        """Current value of every series and time in a closed time range."""
        return self.current(self.value_log(table, start, end), table)

    def _newest_state(self, before: int | None = None) -> tuple[str | None, dict[int, int]]:
        """The merged set of newest rows that still holds, and the batches after it."""
        commits = self._commits()
        counted = {b: a for b, a in self.batches("data", commits).items() if before is None or b < before}
        merged = {(b, a): group[len(NEWEST):] for b, a, group in commits if group.startswith(NEWEST)}
        for b, a in sorted(merged, reverse=True):
            if b in counted and merged[b, a] == _state({n: k for n, k in counted.items() if n <= b}):
                return f"batch={b}/attempt={a}", {n: k for n, k in counted.items() if n > b}
        return None, counted

    def newest(self, before: int | None = None) -> DataFrame:
        """The newest writes of every series, from the rows kept beside each batch, or each one before a batch.

        No value log is read. A late value changes nothing unless it is the newest of its series; of several writes at the
        newest time the last counts.
        """
        base, after = self._newest_state(before)
        parts = [f"{self._path('newest')}/batch={b}/attempt={a}" for b, a in sorted(after.items())]
        rows = self.spark.createDataFrame([], SCHEMAS["newest"])
        for paths, root in ((parts, "newest"), ([f"{self._path('newest_merged')}/{base}"] if base else [], "newest_merged")):
            if paths:
                found = self.spark.read.schema(SCHEMAS["newest"]).option("basePath", self._path(root)).parquet(*paths)
                rows = rows.unionByName(found.drop("attempt"))
        return rows

    def _merge_newest(self) -> None:
        """Merge the newest rows of batches into one set when there are many; a set holds until a batch below it changes."""
        commits = self._commits()
        counted, (_, after) = self.batches("data", commits), self._newest_state()
        if len(after) < NEWEST_BATCHES:
            return
        batch = max(counted)
        attempt = 1 + max((a for b, a, group in commits if b == batch and group.startswith(NEWEST)), default=0)
        merged = newest_writes(self.newest()).select("timeseries", "obstime", "obsvalue", "arrival")
        merged.write.mode("overwrite").parquet(f"{self._path('newest_merged')}/batch={batch}/attempt={attempt}")
        self._mark(batch, attempt, f"{NEWEST}{_state(counted)}")

    def waiting(self, seen: int) -> DataFrame:
        """Control records whose series was not registered by batch ``seen``."""
        known = reg.labels_met(self.registry(before=seen + 1)).select(*reg.MET_KEY).distinct().hint("merge")
        kept = self.log("quarantine").alias("q")
        return kept.join(known.alias("r"), keys_equal("q", "r", reg.MET_KEY, reg.NULLABLE), "left_anti")

    def seen_registry(self, before: int | None = None) -> int:
        """The newest registry batch that the last control batch, or the last one before a batch, has seen; -1: none."""
        numbers = [b for b in self.batches("qc_state") if before is None or b < before]
        return self.log("qc_state", only=max(numbers)).first().registry_batch if numbers else -1

    def _fold(self, table: str) -> dict | None:
        """The last fold of a value table: `upto`, and the folder of each month."""
        if table not in VALUE_PAYLOAD:
            return None
        numbers = [int(n) for n in self._names(f"_folds/{table}")]
        if not numbers:
            return None
        fold = json.loads(self._read(f"_folds/{table}/{max(numbers)}"))
        return {"upto": fold["upto"], "months": {int(m): path for m, path in fold["months"].items()}, "number": max(numbers)}

    def months_of(self, table: str, batch: int) -> list[int]:
        """The months that a batch has values in, from its folders."""
        counted = self.batches(table)
        return sorted(self._months(table, batch, counted[batch])) if batch in counted else []

    def _months(self, table: str, batch: int, attempt: int) -> dict[int, str]:
        """The months of one batch and their folders."""
        path, files = self._files(f"{table}/batch={batch}/attempt={attempt}/obs_bucket=*/obs_month=*")
        out = {}
        for status in files.globStatus(path) or ():
            folder = status.getPath()
            bucket, month = folder.getParent().getName(), folder.getName()
            out[int(month.split("=")[1])] = f"batch={batch}/attempt={attempt}/{bucket}/{month}"
        return out

    def fold_months(self, table: str = "data", upto: int | None = None) -> list[int]:
        """Fold the batches of a value table in place, month by month, and give the months that were rewritten.

        A month that several batches hold is rewritten with the last write of every key; one that a single batch or an
        earlier fold holds keeps its files. ``upto`` is the last batch to fold, by default the last but one, so that a
        stream can still run its newest batch again; folded batches cannot be written again. Afterwards a read opens one
        folder for each month and those of the batches since. The old folders are left for their readers.
        """
        fold, counted = self._fold(table), self.batches(table)
        numbers = sorted(b for b in counted if not fold or b > fold["upto"])
        numbers = [b for b in numbers if b <= upto] if upto is not None else numbers[:-1]
        if not numbers:
            return []
        held = {month: [path] for month, path in fold["months"].items()} if fold else {}
        for batch in numbers:
            for month, path in self._months(table, batch, counted[batch]).items():
                held.setdefault(month, []).append(path)
        several = sorted(month for month, paths in held.items() if len(paths) > 1)
        end, number = numbers[-1], fold["number"] + 1 if fold else 1
        owners = {month: paths[0] for month, paths in held.items()}
        if several:
            paths = [f"{self._path(table)}/{p}" for month in several for p in held[month]]
            rows = self.spark.read.schema(SCHEMAS[table]).option("basePath", self._path(table)).parquet(*paths)
            last = latest_wins(rows, VALUE_KEY, "arrival", [*VALUE_PAYLOAD[table], "arrival"])
            last = last.withColumn("obs_month", obs_month(F.col("obstime"), self.ranges))
            self._put(table, last.hint("rebalance", "obs_month"), end, FOLD_ATTEMPT + number)
            made = self._months(table, end, FOLD_ATTEMPT + number)
            owners.update({month: made[month] for month in several})
        self._create(f"_folds/{table}/{number}", json.dumps({"upto": end, "months": owners}))
        return several

    def compact_into(self, root: str, upto: int | None = None, control_upto: int | None = None, ranges: list[int] | None = None) -> "Store":
        """A new store with everything this one holds, its first batches folded into one, and give that store.

        Observations and control records are numbered apart: ``upto`` and ``control_upto`` name the last batch to fold of
        each, by default the newest. The folded rows carry that number, later batches keep theirs; the new store refuses
        to write a folded batch again. Values keep their arrival, so late writes go on to win. Of the control records
        that waited, those still waiting are kept. The rows are range-partitioned by month, series and time, so files
        have equal size even if one series holds most of the rows. With ``ranges`` the new store has other storage
        ranges. Point readers and writers at the new root.
        """
        target = Store(self.spark, root, ranges or self.ranges)
        seen = self.seen_registry()
        for (family, tables), end in zip(FAMILIES.items(), (upto, control_upto)):
            numbers = sorted(set().union(*(self.batches(table) for table in tables)))
            if not numbers:
                continue
            end = numbers[-1] if end is None else int(end)
            with session.broadcasts_measured(self.spark):
                if numbers[0] <= end:
                    target.write_all({table: self._folded(table, end, seen) for table in tables}, end)
                    target._mark(end, 0, f"{FOLDED}-{family}")
                for number in numbers:
                    if number > end:
                        target.write_all({table: self.log(table, only=number).drop(*PLACE) for table in tables}, number)
        return target

    def _folded(self, table: str, end: int, seen: int) -> DataFrame:
        rows = self.log(table, before=end + 1)
        if table in VALUE_PAYLOAD:
            last = latest_wins(rows, VALUE_KEY, "arrival", [*VALUE_PAYLOAD[table], "arrival"])
            return last.repartitionByRange(obs_month(F.col("obstime"), self.ranges), *VALUE_KEY)
        if table == "quarantine":
            return self.waiting(seen).where(F.col("batch") <= end)
        if table == "qc_state":
            return rows.agg(F.max("registry_batch").alias("registry_batch"))
        return rows


def _state(batches: dict[int, int]) -> str:
    """A short name for a set of batches and their attempts."""
    return f"{zlib.crc32(json.dumps(sorted(batches.items())).encode()):08x}"


def current(log: DataFrame, table: str = "data") -> DataFrame:
    """Last write of every series and time of a value log."""
    return latest_wins(log, VALUE_KEY, "arrival", VALUE_PAYLOAD[table])
