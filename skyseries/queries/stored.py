"""A store with the hourly values of all observations, and the three reads over it."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from skyseries import session
from skyseries.operators.upsert import VALUE_KEY, latest_wins
from skyseries.plans import read_api
from skyseries.plans.bulk_load import bulk_load
from skyseries.queries.mapping import HOURLY_SQL, OBS_SQL, ntz, obs, on_the_hour
from skyseries.sources.store import Store

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)


def loaded_store(spark, sf_dir) -> Store:
    """One series per station and parameter, its last value of every hour."""
    found = obs(spark, sf_dir)
    null = F.lit(None)
    registry = found.groupBy("timeseries", "station_id", "param_code", "param_id", "type_id").agg(
        F.date_trunc("hour", F.min_by("obstime", "seq")).alias("fromtime")
    ).withColumns({c: null for c in ("lvl", "sensor", "totime", "loc", "deactivated")})
    hours = latest_wins(on_the_hour(found), VALUE_KEY, "seq", ["obsvalue"])
    store = Store(spark, session.shared_dir(spark, "loaded"))
    bulk_load(store, registry, hours.withColumn("obstime", F.col("obstime").cast("timestamp")), batch=0)
    return store


def first_series(store, param_id=None):
    """Station and parameter of the first series, of one parameter if given."""
    labels = store.labels_met() if param_id is None else store.labels_met().where(F.col("param_id") == param_id)
    row = labels.orderBy("timeseries").first()
    return row.station_id, row.param_id


def values(rows, time="obstime"):
    return rows.select("timeseries", ntz(time), F.col("obsvalue").cast("double").alias("obsvalue"))


def series_irregular(spark, sf_dir):
    """Raw values of the first series of purchases between two times."""
    store = loaded_store(spark, sf_dir)
    start, end = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (5, 25))
    return values(read_api.series(store, *first_series(store, 3), start, end, now=NOW)[1])


# Stored values are single precision.
SINGLE = "cast(cast(obsvalue as real) as double)"
IRREGULAR_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL}
select timeseries, obstime, {SINGLE} as obsvalue from hourly
where timeseries = (select min(timeseries) from obs where param_id = 3) and obstime between timestamp '2024-01-05' and timestamp '2024-01-25'"""


def read_series(spark, sf_dir):
    """Hourly grid of the first series of all, over its own whole range."""
    store = loaded_store(spark, sf_dir)
    return values(read_api.series(store, *first_series(store), resolution="PT1H", now=NOW)[1], "slot")


READ_SERIES_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL},
one as (select timeseries, date_trunc('hour', arg_min(obstime, seq)) as a from obs where timeseries = (select min(timeseries) from obs) group by 1),
slots as (select timeseries, unnest(generate_series(a, timestamp '2024-02-01', interval 1 hour)) as slot from one)
select s.timeseries, slot, {SINGLE} as obsvalue from slots s left join hourly h on s.timeseries = h.timeseries and s.slot = h.obstime"""


def read_series_bulk(spark, sf_dir):
    """Raw values of all series between two times."""
    start, end = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (5, 25))
    return values(read_api.series_bulk(loaded_store(spark, sf_dir), start=start, end=end, now=NOW)[1])


READ_BULK_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL}
select timeseries, obstime, {SINGLE} as obsvalue from hourly where obstime between timestamp '2024-01-05' and timestamp '2024-01-25'"""


def read_timeslices(spark, sf_dir):
    """Slices for every hour and parameter at which some value was above 300."""
    requests = on_the_hour(obs(spark, sf_dir)).where("obsvalue > 300").select(F.col("obstime").cast("timestamp").alias("ts"), "param_id")
    found = read_api.timeslices(loaded_store(spark, sf_dir), requests)
    return found.select(ntz("ts"), "param_id", "timeseries", "station_id", F.col("obsvalue").cast("double").alias("obsvalue"))


READ_TIMESLICES_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL},
labels as (select distinct timeseries, cast(station_id as integer) as station_id, param_id from obs),
requests as (select distinct date_trunc('hour', obstime) as ts, param_id from obs where obsvalue > 300)
select ts, labels.param_id, timeseries, station_id, {SINGLE} as obsvalue
from hourly join labels using (timeseries) join requests on ts = obstime and requests.param_id = labels.param_id"""


def read_latest(spark, sf_dir):
    """Newest value of every series since three hours before the last night of the month."""
    found = read_api.latest(loaded_store(spark, sf_dir), datetime(2024, 1, 30, 21))
    return found.select("timeseries", "station_id", "param_id", ntz("obstime"), F.col("obsvalue").cast("double").alias("obsvalue"))


READ_LATEST_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL},
labels as (select distinct timeseries, cast(station_id as integer) as station_id, param_id from obs)
select timeseries, station_id, param_id, max(obstime) as obstime, arg_max({SINGLE}, obstime) as obsvalue
from hourly join labels using (timeseries) where obstime > timestamp '2024-01-30 21:00:00' group by 1, 2, 3"""


QUERIES = {
    "q_series_irregular": (series_irregular, IRREGULAR_SQL),
    "q_read_series": (read_series, READ_SERIES_SQL),
    "q_read_series_bulk": (read_series_bulk, READ_BULK_SQL),
    "q_read_timeslices": (read_timeslices, READ_TIMESLICES_SQL),
    "q_read_latest": (read_latest, READ_LATEST_SQL),
}
