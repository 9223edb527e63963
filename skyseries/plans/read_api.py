"""The three reads over a store, for one key and in bulk."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries import session
from skyseries.functions.times import obs_month
from skyseries.operators import series as ops
from skyseries.operators import slices
from skyseries.operators.registry import labels_and_places
from skyseries.operators.skew import lookup_join
from skyseries.sources.store import Store

# Fixed value: how far back the newest values are looked for unless asked otherwise.
DEFAULT_AGE = timedelta(hours=3)


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def headers(store: Store, now=None, first_only: bool = True) -> DataFrame:
    session.prepare(store.spark)
    return ops.headers_of(labels_and_places(store.registry()), now or utc_now(), first_only)


def _aware(time):
    """Times come back from a UTC session without zone."""
    return time if time is None or time.tzinfo else time.replace(tzinfo=timezone.utc)


def _from_micros(value: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=value)


def series(store, station_id, param_id, start=None, end=None, resolution=None, now=None, strict=True):
    """One series over a closed range, raw or on a regular grid: `(ranges, rows)`.

    ``ranges`` is the header with the range that was used, ``rows`` the values. An unknown station or
    parameter is an error. The bounds are known
    before the read is planned, so it touches only the year ranges and row groups it needs.
    """
    keyed = (F.col("station_id") == station_id) & (F.col("param_id") == param_id)
    ranges = ops.with_range(headers(store, now).where(keyed), start, end)
    row = ranges.select("timeseries", F.unix_micros("first").alias("a"), F.unix_micros("last").alias("z")).first()
    if row is None:
        raise ValueError(f"no series for station {station_id} and parameter {param_id}")
    log = store.value_log("data", _from_micros(row.a), _from_micros(row.z))
    values = store.current(log.where(F.col("timeseries") == row.timeseries))
    if resolution is None:
        return ranges, ops.irregular(values, ranges)
    return ranges, ops.regular(values, ranges, resolution, strict)


def series_bulk(store, keys=None, start=None, end=None, resolution=None, now=None, strict=True, first_only=True,
                sliced: bool = False):
    """As `series`, for all series or for those of ``keys`` `(station_id, param_id)`, in one plan."""
    head = headers(store, now, first_only)
    if keys is not None:
        head = head.join(keys.select("station_id", "param_id").distinct(), ["station_id", "param_id"], "left_semi")
    ranges = ops.with_range(head, start, end)
    # Cut the log down before folding it: to the given range, and to the chosen series.
    log = store.value_log("data", _aware(start), _aware(end))
    if keys is not None:
        log = lookup_join(log, ranges.select("timeseries"), ["timeseries"], "left_semi", sliced=sliced)
    if resolution is None:
        inside = lookup_join(log, ranges.select("timeseries", "first", "last"), ["timeseries"], "inner", sliced=sliced)
        return ranges, store.current(inside.where(F.col("obstime").between(F.col("first"), F.col("last"))))
    return ranges, ops.regular(store.current(log), ranges, resolution, strict)


def timeslice(store: Store, instant, param_id: int) -> DataFrame:
    """Every series of a parameter at exactly one time."""
    session.prepare(store.spark)
    instant = _aware(instant)
    return slices.timeslice(store.values("data", instant, instant), labels_and_places(store.registry()), None, instant, param_id)


def timeslices(store: Store, requests: DataFrame, sliced: bool = False) -> DataFrame:
    """Slices for many `(ts, param_id)`; only the requested months are read and only rows at the requested times folded."""
    session.prepare(store.spark)
    instants = requests.select(F.col("ts").alias("obstime")).distinct()
    # The months of the requests: at most twelve for each year that a store covers.
    month = obs_month(F.col("obstime").cast("timestamp"), store.ranges).alias("m")
    months = sorted(r.m for r in instants.select(month).distinct().collect() if r.m is not None)
    log = store.value_log("data", months=months)
    at_instants = store.current(lookup_join(log, instants, ["obstime"], "left_semi", sliced=sliced))
    return slices.timeslices(at_instants, labels_and_places(store.registry()), None, requests, sliced)


def latest(store: Store, newer_than=None, now=None, from_log: bool = False) -> DataFrame:
    """Newest number of every series after a time, three hours ago unless given.

    It comes from the newest rows that are kept beside each batch; with ``from_log`` from the values themselves.
    """
    session.prepare(store.spark)
    newer_than = _aware(newer_than) or (now or utc_now()) - DEFAULT_AGE
    rows = store.value_log("data", start=newer_than) if from_log else store.newest()
    newest = slices.newest_from_log(rows, newer_than)
    return slices.latest(newest, labels_and_places(store.registry()))


def write_answers(answers: DataFrame, path: str, order: str | None = None) -> None:
    """JSON answers as lines of text, one answer or part per line; with ``order``, such as `part_no`, in one order over all files.
    """
    if order:
        answers = answers.repartitionByRange(order).sortWithinPartitions(order)
    answers.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
