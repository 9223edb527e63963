"""Across all series: the values at one instant, and the newest value of each."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries.operators.skew import lookup_join
from skyseries.operators.upsert import packed_order


def newest_per_series(data: DataFrame, newer_than) -> DataFrame:
    """Newest observation of each series after a time; the filter works below the aggregate.

    One fixed-width order column and payload: aggregated by hash, partially before the shuffle.
    """
    recent = data.where(F.col("obstime") > F.lit(newer_than))
    return recent.groupBy("timeseries").agg(
        F.max_by("obsvalue", "obstime").alias("obsvalue"), F.max("obstime").alias("obstime")
    )


def newest_from_log(log: DataFrame, newer_than) -> DataFrame:
    """As `newest_per_series`, on a log that may hold older writes of the same time."""
    recent = log.where(F.col("obstime") > F.lit(newer_than))
    order = packed_order(F.unix_micros("obstime"), F.col("arrival"))
    return recent.groupBy("timeseries").agg(F.max_by("obsvalue", order).alias("obsvalue"), F.max("obstime").alias("obstime"))


def newest_of_batch(rows: DataFrame) -> DataFrame:
    """As `newest_writes`, of rows in which no series has a time twice: the time alone decides."""
    return rows.where(F.col("obstime").isNotNull()).groupBy("timeseries").agg(
        F.max("obstime").alias("obstime"), F.max_by("obsvalue", "obstime").alias("obsvalue"), F.max_by("arrival", "obstime").alias("arrival")
    )


def newest_writes(log: DataFrame) -> DataFrame:
    """The newest write of each series `(timeseries, obstime, obsvalue, arrival)`: the last one at its newest time."""
    order = packed_order(F.unix_micros("obstime"), F.col("arrival"))
    return log.where(F.col("obstime").isNotNull()).groupBy("timeseries").agg(
        F.max("obstime").alias("obstime"), F.max_by("obsvalue", order).alias("obsvalue"), F.max_by("arrival", order).alias("arrival")
    )


def places(labels_met: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Station, parameter and location of every labelled series; without ``series`` the labels carry `loc` themselves."""
    if series is None:
        return labels_met.select("timeseries", "station_id", "param_id", "loc")
    located = series.select(F.col("id").alias("timeseries"), "loc")
    return labels_met.select("timeseries", "station_id", "param_id").join(located, "timeseries")


def with_place(values: DataFrame, labels_met: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Join one-row-per-series values to their labels and location; unlabelled series drop out."""
    return values.join(places(labels_met, series), "timeseries")


def place_rows(values: DataFrame, labels_met: DataFrame, series: DataFrame | None = None, sliced: bool = False) -> DataFrame:
    """As `with_place`, for values of which one series may have most."""
    return lookup_join(values, places(labels_met, series), ["timeseries"], "inner", sliced=sliced)


def latest(newest: DataFrame, labels_met: DataFrame, series: DataFrame | None = None) -> DataFrame:
    placed = with_place(newest, labels_met, series)
    return placed.select("timeseries", "station_id", "param_id", "obsvalue", "obstime", "loc")


def timeslice(data: DataFrame, labels_met: DataFrame, series: DataFrame, instant, param_id: int) -> DataFrame:
    """Value, station and location of every series of a parameter at exactly one time."""
    at_instant = data.where(F.col("obstime") == F.lit(instant)).select("timeseries", "obsvalue")
    placed = with_place(at_instant, labels_met.where(F.col("param_id") == param_id), series)
    return placed.select("timeseries", "station_id", "obsvalue", "loc")


def timeslices(data, labels_met, series, requests, sliced: bool = False) -> DataFrame:
    """Slices for many `(ts, param_id)` requests in one pass over the data.

    The data are first cut down to the requested instants, then labelled, then matched to the
    requested parameters.
    """
    wanted = requests.distinct()
    instants = wanted.select(F.col("ts").alias("obstime")).distinct()
    at_instants = lookup_join(data.select("timeseries", "obstime", "obsvalue"), instants, ["obstime"], "left_semi", sliced=sliced)
    placed = place_rows(at_instants, labels_met, series, sliced).withColumnRenamed("obstime", "ts")
    matched = lookup_join(placed, wanted, ["ts", "param_id"], "left_semi", sliced=sliced)
    return matched.select("ts", "param_id", "timeseries", "station_id", "obsvalue", "loc")
