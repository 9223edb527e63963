"""The given tables read as observations, series and station metadata.

`events` plays observations (user = station, event type = parameter), `customer` and `nation` play
station metadata: every station has one series per parameter.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE_ID = 501
# Parameter codes in the order of their ids, which start at 1.
CODES = ["click", "error", "purchase", "signup", "view"]

PARAM_CASE = "case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end"

# The same views as common table expressions of the check texts.
OBS_SQL = f"""obs as (
  select user_id as station_id, event_type as param_code, {PARAM_CASE} as param_id, {TYPE_ID} as type_id,
         user_id * 10 + {PARAM_CASE} as timeseries, ts as obstime, value as obsvalue, props as obstext, event_id as seq
  from events)"""
PLACES_SQL = """places as (
  select c_custkey as station_id, 59 + c_nationkey * 0.5::double as lat, 4 + n_regionkey * 0.5::double as lon
  from customer join nation on c_nationkey = n_nationkey),
met as (
  select station_id * 10 + p as timeseries, station_id, cast(p as integer) as param_id, lat, lon
  from places, unnest([1, 2, 3, 4, 5]) as t(p))"""
HOURLY_SQL = """hourly as (
  select timeseries, date_trunc('hour', obstime) as obstime, arg_max(obsvalue, seq) as obsvalue
  from obs group by 1, 2)"""


def rfc3339_sql(time: str) -> str:
    """Check text for the text form of a time, with as many digits of fraction as it needs."""
    whole, milli, micro = ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%gZ", "%Y-%m-%dT%H:%M:%S.%fZ")
    return (
        f"case when epoch_us({time}) % 1000000 = 0 then strftime({time}, '{whole}') "
        f"when epoch_us({time}) % 1000 = 0 then strftime({time}, '{milli}') else strftime({time}, '{micro}') end"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def param_id(code):
    number = F
    for i, name in enumerate(CODES[:-1], start=1):
        number = number.when(code == name, F.lit(i))
    return number.otherwise(F.lit(len(CODES)))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = param_id(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("station_id"),
        F.col("event_type").alias("param_code"),
        number.alias("param_id"),
        F.lit(TYPE_ID).alias("type_id"),
        (F.col("user_id") * 10 + number).alias("timeseries"),
        F.col("ts").alias("obstime"),
        F.col("value").alias("obsvalue"),
        F.col("props").alias("obstext"),
        F.col("event_id").alias("seq"),
    )


def on_the_hour(observations: DataFrame) -> DataFrame:
    return observations.withColumn("obstime", F.date_trunc("hour", "obstime").cast("timestamp_ntz"))


def series_tables(spark: SparkSession, sf_dir: str):
    """`(series, labels_met)`: five series for each station of the metadata tables."""
    places = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    lat = (59 + F.col("c_nationkey") * 0.5).cast("double")
    lon = (4 + F.col("n_regionkey") * 0.5).cast("double")
    numbers = F.explode(F.array(*[F.lit(i) for i in range(1, len(CODES) + 1)]))
    placed = places.select(F.col("c_custkey").alias("station_id"), lat.alias("lat"), lon.alias("lon"))
    registry = placed.select("*", numbers.alias("param_id")).select(
        "station_id", "param_id", F.struct("lat", "lon").alias("loc"),
        (F.col("station_id") * 10 + F.col("param_id")).alias("timeseries"),
    )
    series = registry.select(F.col("timeseries").alias("id"), "loc")
    return series, registry.select("timeseries", "station_id", "param_id")


def ntz(column):
    """Times leave the queries without zone, as in the given tables."""
    return F.col(column).cast("timestamp_ntz").alias(column)


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")
