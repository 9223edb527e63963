"""One series, or many, over a time range: headers, raw values, and regular grids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries.functions.times import step_seconds
from skyseries.operators.grid import fill_grid
from skyseries.operators.skew import lookup_join

# Fixed value: start of a series without start.
EARLIEST = "1950-01-01 00:00:00"

HEADER = ["timeseries", "fromtime", "totime", "station_id", "param_id", "lvl", "sensor", "loc"]


def series_headers(series: DataFrame, labels_met: DataFrame, now, first_only: bool = True) -> DataFrame:
    """Header of the series of every station and parameter, with missing bounds filled in.

    Where several series share station and parameter, the one with the smallest id is taken, or with
    ``first_only=False`` all are.
    """
    return headers_of(series.join(labels_met, F.col("id") == F.col("timeseries")), now, first_only)


def headers_of(labelled: DataFrame, now, first_only: bool = True) -> DataFrame:
    """As `series_headers`, of series and labels in one row."""
    time_type = dict(labelled.dtypes)["fromtime"]
    headers = labelled.select(
        "timeseries",
        F.coalesce("fromtime", F.lit(EARLIEST).cast(time_type)).alias("fromtime"),
        F.coalesce("totime", F.lit(now).cast(time_type)).alias("totime"),
        "station_id", "param_id", "lvl", "sensor", "loc",
    )
    if not first_only:
        return headers
    rest = [c for c in HEADER if c not in ("station_id", "param_id")]
    picked = headers.groupBy("station_id", "param_id").agg(F.min_by(F.struct(*rest), "timeseries").alias("h"))
    return picked.select("station_id", "param_id", "h.*").select(*HEADER)


def with_range(headers: DataFrame, start=None, end=None) -> DataFrame:
    """Add the queried range `(first, last)`: given bounds, or those of the series."""
    time_type = dict(headers.dtypes)["fromtime"]
    return headers.withColumns({
        "first": F.lit(start).cast(time_type) if start is not None else F.col("fromtime"),
        "last": F.lit(end).cast(time_type) if end is not None else F.col("totime"),
    })


def irregular(data: DataFrame, ranges: DataFrame, sliced: bool = False) -> DataFrame:
    """Observations inside the closed range of their series."""
    bounds = ranges.select("timeseries", "first", "last")
    inside = lookup_join(data, bounds, ["timeseries"], "inner", sliced=sliced).where(
        F.col("obstime").between(F.col("first"), F.col("last"))
    )
    return inside.select("timeseries", "obstime", "obsvalue")


def regular(data: DataFrame, ranges: DataFrame, resolution: str, strict: bool = True, sliced: bool = False) -> DataFrame:
    """Every slot of the grid of every series, with the value at that time or NULL."""
    bounds = ranges.select("timeseries", "first", "last")
    return fill_grid(bounds, data, step_seconds(resolution, strict), ["timeseries"], sliced=sliced)
