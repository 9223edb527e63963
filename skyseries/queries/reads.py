"""Reads: one series, one instant, newest values, and their nested answers."""

from pyspark.sql import functions as F

from skyseries.operators import documents, series, slices
from skyseries.operators.upsert import VALUE_KEY, latest_wins
from skyseries.queries.mapping import (
    HOURLY_SQL, OBS_SQL, PLACES_SQL, at, obs, on_the_hour, rfc3339_sql, series_tables, table,
)

NEWER_THAN = "2024-01-30 21:00:00"
INSTANT = "2024-01-10 12:00:00"
NOW = "2024-01-20 00:00:00"


def hourly(spark, sf_dir):
    """Current value of every series and hour."""
    return latest_wins(on_the_hour(obs(spark, sf_dir)), VALUE_KEY, "seq", ["obsvalue"])


def latest_per_series(spark, sf_dir):
    newest = slices.newest_per_series(obs(spark, sf_dir), at(NEWER_THAN))
    stations, met = series_tables(spark, sf_dir)
    return slices.latest(newest, met, stations).select(
        "timeseries", "station_id", "param_id", "obsvalue", "obstime", F.col("loc.lat").alias("lat"), F.col("loc.lon").alias("lon")
    )


LATEST_SQL = f"""
with {OBS_SQL}, {PLACES_SQL},
newest as (
  select distinct on (timeseries) timeseries, obstime, obsvalue from obs
  where obstime > timestamp '{NEWER_THAN}' order by timeseries, obstime desc)
select timeseries, met.station_id, met.param_id, obsvalue, obstime, lat, lon from newest join met using (timeseries)"""


def timeslice(spark, sf_dir):
    # The hour is a range of the stored time, which the scan can skip by.
    observations = obs(spark, sf_dir).where(
        (F.col("obstime") >= at(INSTANT)) & (F.col("obstime") < at(INSTANT) + F.expr("interval 1 hour"))
    )
    data = latest_wins(on_the_hour(observations), VALUE_KEY, "seq", ["obsvalue"])
    stations, met = series_tables(spark, sf_dir)
    return slices.timeslice(data, met, stations, at(INSTANT), 3).select(
        "timeseries", "station_id", "obsvalue", F.col("loc.lat").alias("lat"), F.col("loc.lon").alias("lon")
    )


TIMESLICE_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL}, {PLACES_SQL}
select timeseries, met.station_id, obsvalue, lat, lon from hourly join met using (timeseries)
where obstime = timestamp '{INSTANT}' and met.param_id = 3"""


def timeslices_bulk(spark, sf_dir):
    """Slices for every hour and parameter at which some value was above 300."""
    requests = on_the_hour(obs(spark, sf_dir)).where("obsvalue > 300").select(F.col("obstime").alias("ts"), "param_id")
    stations, met = series_tables(spark, sf_dir)
    found = slices.timeslices(hourly(spark, sf_dir), met, stations, requests)
    return found.select("ts", "param_id", "timeseries", "station_id", "obsvalue", F.col("loc.lat").alias("lat"))


TIMESLICES_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL}, {PLACES_SQL},
requests as (select distinct date_trunc('hour', obstime) as ts, param_id from obs where obsvalue > 300)
select ts, met.param_id, timeseries, met.station_id, obsvalue, lat
from hourly join met using (timeseries) join requests on ts = obstime and requests.param_id = met.param_id"""


def first_processed(spark, sf_dir):
    """Series and labels as ingest would have made them: start is the first processed time."""
    found = obs(spark, sf_dir).groupBy("timeseries", "station_id", "param_id").agg(
        F.min_by("obstime", "seq").alias("fromtime")
    )
    unknown = F.lit(None)
    rows = found.select(
        "*", unknown.cast("timestamp_ntz").alias("totime"), unknown.cast("string").alias("loc"),
        unknown.cast("int").alias("lvl"), unknown.cast("int").alias("sensor"),
    )
    stored = rows.select(F.col("timeseries").alias("id"), "fromtime", "totime", "loc")
    return stored, rows.select("timeseries", "station_id", "param_id", "lvl", "sensor")


def series_default_range(spark, sf_dir):
    """Raw values of all series, each from its own start to the time of asking."""
    stored, met = first_processed(spark, sf_dir)
    ranges = series.with_range(series.series_headers(stored, met, NOW))
    return series.irregular(obs(spark, sf_dir), ranges)


DEFAULT_RANGE_SQL = f"""
with {OBS_SQL}, starts as (select timeseries, arg_min(obstime, seq) as fromtime from obs group by 1)
select timeseries, obstime, obsvalue from obs join starts using (timeseries)
where obstime between coalesce(fromtime, timestamp '1950-01-01') and timestamp '{NOW}'"""


def series_header(spark, sf_dir):
    """Headers where station and parameter have up to three series, one per level."""
    leveled = obs(spark, sf_dir).withColumn("lvl", F.pmod("seq", F.lit(3)).cast("int"))
    found = leveled.groupBy("station_id", "param_id", "lvl").agg(F.min_by("obstime", "seq").alias("fromtime")).select(
        "*", ((F.col("station_id") * 10 + F.col("param_id")) * 3 + F.col("lvl")).alias("timeseries")
    )
    # Some series have no start.
    start = F.when(F.col("timeseries") % 5 != 0, F.col("fromtime"))
    null = F.lit(None)
    stored = found.select(
        F.col("timeseries").alias("id"), start.alias("fromtime"), null.cast("timestamp_ntz").alias("totime"),
        null.cast("string").alias("loc"),
    )
    met = found.select("timeseries", "station_id", "param_id", "lvl", null.cast("int").alias("sensor"))
    return series.series_headers(stored, met, NOW).drop("loc")


HEADER_SQL = f"""
with {OBS_SQL},
leveled as (
  select station_id, param_id, cast(seq % 3 as integer) as lvl, arg_min(obstime, seq) as fromtime from obs group by 1, 2, 3),
numbered as (select *, (station_id * 10 + param_id) * 3 + lvl as timeseries from leveled),
picked as (select *, row_number() over (partition by station_id, param_id order by timeseries) as n from numbered)
select timeseries, coalesce(case when timeseries % 5 <> 0 then fromtime end, timestamp '1950-01-01') as fromtime,
       timestamp '{NOW}' as totime, station_id, param_id, lvl, cast(null as integer) as sensor
from picked where n = 1"""


def series_regular(spark, sf_dir):
    """Hourly grid of one station, gaps included."""
    station = on_the_hour(obs(spark, sf_dir).where("station_id = 7")).withColumn("timeseries", F.col("station_id"))
    values = latest_wins(station, VALUE_KEY, "seq", ["obsvalue"])
    ranges = station.select("timeseries").distinct().select(
        "timeseries", at("2024-01-10 00:00:00").alias("first"), at("2024-01-12 00:30:00").alias("last")
    )
    return series.regular(values, ranges, "PT1H").select("timeseries", "slot", "obsvalue")


REGULAR_SQL = f"""
with {OBS_SQL},
h as (select date_trunc('hour', obstime) as t, arg_max(obsvalue, seq) as obsvalue from obs where station_id = 7 group by 1),
g as (select unnest(generate_series(timestamp '2024-01-10', timestamp '2024-01-12 00:30:00', interval 1 hour)) as slot
      where exists (select 1 from obs where station_id = 7))
select cast(7 as bigint) as timeseries, slot, obsvalue from h right join g on slot = t"""


def daily_orders(spark, sf_dir):
    """Orders as daily series, one per customer: `(ranges, values)`."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("timeseries"), F.col("o_orderdate").alias("obstime"),
        F.col("o_totalprice").alias("obsvalue"), F.col("o_orderkey").alias("seq"),
    )
    ranges = orders.groupBy("timeseries").agg(F.min("obstime").alias("first"), F.max("obstime").alias("last"))
    return ranges, latest_wins(orders, VALUE_KEY, "seq", ["obsvalue"])


def cents(column: str):
    """Exact sums in both engines: whole hundredths."""
    return F.sum(F.round(F.col(column) * 100).cast("bigint")).cast("bigint")


def series_regular_bulk(spark, sf_dir):
    """Daily grids of all series from first to last day, summed up per year."""
    ranges, values = daily_orders(spark, sf_dir)
    slots = series.regular(values, ranges, "P1D")
    return slots.groupBy("timeseries", F.year("slot").alias("year")).agg(
        F.count(F.lit(1)).alias("n_slots"), F.count("obsvalue").alias("n_values"), cents("obsvalue").alias("cents"),
        F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
    )


REGULAR_BULK_SQL = """
with h as (select o_custkey as k, o_orderdate as d, arg_max(o_totalprice, o_orderkey) as v from orders group by 1, 2),
b as (select k, min(d) as a, max(d) as z from h group by 1),
g as (select k, unnest(generate_series(a, z, interval 1 day)) as d from b)
select g.k as timeseries, cast(year(g.d) as integer) as year, count(*) as n_slots, count(v) as n_values,
       cast(sum(cast(round(v * 100) as bigint)) as bigint) as cents, min(g.d) as first_slot, max(g.d) as last_slot
from g left join h on g.k = h.k and g.d = h.d group by 1, 2"""


def series_regular_minutely(spark, sf_dir):
    """Minutely grids of five long series, each with a fifth of all rows, summed up per day."""
    minutes = obs(spark, sf_dir).select(
        F.col("param_id").cast("bigint").alias("timeseries"),
        F.date_trunc("minute", "obstime").cast("timestamp_ntz").alias("obstime"), "obsvalue", "seq",
    )
    ranges = minutes.groupBy("timeseries").agg(F.min("obstime").alias("first"), F.max("obstime").alias("last"))
    slots = series.regular(latest_wins(minutes, VALUE_KEY, "seq", ["obsvalue"]), ranges, "PT1M")
    return slots.groupBy("timeseries", F.date_trunc("day", "slot").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("n_slots"), F.count("obsvalue").alias("n_values"), cents("obsvalue").alias("cents")
    )


REGULAR_MINUTELY_SQL = f"""
with {OBS_SQL},
h as (select cast(param_id as bigint) as k, date_trunc('minute', obstime) as t, arg_max(obsvalue, seq) as v from obs group by 1, 2),
b as (select k, min(t) as a, max(t) as z from h group by 1),
g as (select k, unnest(generate_series(a, z, interval 1 minute)) as t from b)
select g.k as timeseries, cast(date_trunc('day', g.t) as timestamp) as day, count(*) as n_slots, count(v) as n_values,
       cast(sum(cast(round(v * 100) as bigint)) as bigint) as cents
from g left join h on g.k = h.k and g.t = h.t group by 1, 2"""


# Small parts, so that the test tables have answers of several parts.
PART_ROWS = 20


def series_document(spark, sf_dir):
    """JSON answers of all raw hourly series."""
    stored, met = first_processed(spark, sf_dir)
    headers = series.series_headers(stored, met, NOW)
    answers = documents.irregular_documents(hourly(spark, sf_dir), headers, PART_ROWS)
    return documents.series_json(answers)


# Parts: days of a series are filled up until PART_ROWS rows have gone before; their numbers have no gaps.
SERIES_DOCUMENT_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL},
heads as (select timeseries, station_id, param_id, arg_min(obstime, seq) as fromtime from obs group by 1, 2, 3),
days as (select timeseries, date_trunc('day', obstime) as day, count(*) as n from hourly group by 1, 2),
filled as (
  select timeseries, day, coalesce(sum(n) over (partition by timeseries order by day
         rows between unbounded preceding and 1 preceding), 0) // {PART_ROWS} as part from days),
parts as (
  select timeseries, day, cast(dense_rank() over (partition by timeseries order by part) - 1 as integer) as part_no from filled),
totals as (select timeseries, max(part_no) + 1 as n_parts from parts group by 1),
arrays as (
  select timeseries, part_no, string_agg(cast(obsvalue as varchar), ',' order by obstime) as data,
         string_agg('"' || strftime(obstime, '%Y-%m-%dT%H:%M:%SZ') || '"', ',' order by obstime) as times
  from hourly h join parts p using (timeseries) where day = date_trunc('day', h.obstime) group by 1, 2)
select timeseries, part_no, '{{"tseries":[{{"regularity":"Irregular","data":[' || data || '],"header":{{"ts_id":' || timeseries
  || ',"fromtime":"' || {rfc3339_sql("fromtime")}
  || '","totime":"2024-01-20T00:00:00Z","station_id":' || station_id || ',"param_id":' || param_id
  || ',"lvl":null,"sensor":null,"location":null}},"timestamps":[' || times || ']}}],"part":' || part_no || ',"parts":' || n_parts || '}}' as json
from arrays join heads using (timeseries) join totals using (timeseries)"""


def regular_document(spark, sf_dir):
    """Regular answers of all daily series, by their array lengths, sums and edges."""
    ranges, values = daily_orders(spark, sf_dir)
    null = F.lit(None).cast("int")
    heads = ranges.select(
        "timeseries", "first", "last", F.col("first").alias("fromtime"), F.col("last").alias("totime"),
        F.col("timeseries").alias("station_id"), F.lit(1).alias("param_id"), null.alias("lvl"), null.alias("sensor"),
        null.alias("loc"),
    )
    answers = documents.regular_documents(values, heads, "P1D", part_rows=500)
    total = F.aggregate(
        F.filter("data", lambda v: v.isNotNull()), F.lit(0).cast("bigint"), lambda s, v: s + F.round(v * 100).cast("bigint")
    )
    return answers.select(
        "timeseries", "part_no", "n_parts", "start_time", F.size("data").cast("bigint").alias("n_slots"), total.alias("cents"),
        F.get("data", F.lit(0)).alias("first_value"), F.col("header.totime").alias("totime"),
    )


REGULAR_DOCUMENT_SQL = """
with h as (select o_custkey as k, o_orderdate as d, arg_max(o_totalprice, o_orderkey) as v from orders group by 1, 2),
b as (select k, min(d) as a, max(d) as z from h group by 1),
g as (select k, a, z, unnest(generate_series(a, z, interval 1 day)) as d from b),
s as (select g.k, g.a, g.z, g.d, v, cast(date_diff('day', a, g.d) // 500 as integer) as part_no
      from g left join h on g.k = h.k and g.d = h.d)
select k as timeseries, part_no, cast((date_diff('day', min(a), z)) // 500 + 1 as integer) as n_parts, strftime(min(d), '%Y-%m-%dT%H:%M:%SZ') as start_time, count(*) as n_slots,
       cast(coalesce(sum(cast(round(v * 100) as bigint)), 0) as bigint) as cents, arg_min_null(v, d) as first_value,
       strftime(z, '%Y-%m-%dT%H:%M:%SZ') as totime
from s group by k, part_no, z"""


def timeslice_document(spark, sf_dir):
    """JSON answers for every hour and parameter, and for the same hours a year later, which have no values."""
    stations, met = series_tables(spark, sf_dir)
    data = hourly(spark, sf_dir)
    placed = slices.place_rows(data, met, stations).withColumnRenamed("obstime", "ts")
    years = F.explode(F.array(F.col("obstime"), F.col("obstime") + F.expr("interval 1 year"))).alias("ts")
    hours = on_the_hour(obs(spark, sf_dir)).select("obstime").distinct().select(years)
    requests = hours.select("ts", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("param_id"))
    return documents.timeslice_json(documents.timeslice_documents(placed, requests))


TIMESLICE_DOCUMENT_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL}, {PLACES_SQL},
hours as (select distinct date_trunc('hour', obstime) as ts from obs),
requests as (
  select t.ts, cast(p as integer) as param_id from (select ts from hours union all select ts + interval 1 year from hours) t, unnest([1, 2, 3, 4, 5]) as u(p)),
found as (
  select obstime as ts, met.param_id,
    string_agg('{{"station_id":' || met.station_id || ',"value":' || obsvalue || ',"loc":{{"lat":' || lat || ',"lon":' || lon || '}}}}',
       ',' order by timeseries) as data
  from hourly join met using (timeseries) group by obstime, met.param_id)
select ts, param_id, cast(0 as integer) as part_no,
  '{{"tslices":[{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","param_id":' || param_id || ',"data":['
  || coalesce(data, '') || ']}}],"part":0,"parts":1}}' as json
from requests left join found using (ts, param_id)"""


def latest_document(spark, sf_dir):
    """JSON answer with the newest value of every series."""
    newest = slices.newest_per_series(obs(spark, sf_dir), at("2024-01-01 00:00:00"))
    stations, met = series_tables(spark, sf_dir)
    return documents.latest_json(documents.latest_documents(slices.latest(newest, met, stations), part_rows=100))


LATEST_DOCUMENT_SQL = f"""
with {OBS_SQL}, {PLACES_SQL},
newest as (select timeseries, max(obstime) as obstime, arg_max(obsvalue, obstime) as obsvalue from obs group by 1),
placed as (select *, timeseries // 100 as block from newest join met using (timeseries)),
blocks as (select block, block % {documents.ID_RANGES} as r, count(*) as n from placed group by 1),
filled as (select block, r, coalesce(sum(n) over (partition by r order by block rows between unbounded preceding and 1 preceding), 0) // 100 as part
           from blocks),
parts as (select block, dense_rank() over (order by r, part) - 1 as part_no from filled),
answers as (
  select part_no, string_agg('{{"value":' || obsvalue || ',"timestamp":"' || {rfc3339_sql("obstime")}
    || '","station_id":' || station_id || ',"loc":{{"lat":' || lat || ',"lon":' || lon || '}}}}', ',' order by timeseries) as data
  from placed join parts using (block) group by 1
  union all select 0, '' where not exists (select 1 from placed))
select cast(part_no as integer) as part_no,
  '{{"data":[' || data || '],"part":' || part_no || ',"parts":' || (select count(*) from answers) || '}}' as json from answers"""


QUERIES = {
    "q_latest_per_series": (latest_per_series, LATEST_SQL),
    "q_timeslice": (timeslice, TIMESLICE_SQL),
    "q_timeslices_bulk": (timeslices_bulk, TIMESLICES_SQL),
    "q_series_default_range": (series_default_range, DEFAULT_RANGE_SQL),
    "q_series_header": (series_header, HEADER_SQL),
    "q_series_regular": (series_regular, REGULAR_SQL),
    "q_series_regular_bulk": (series_regular_bulk, REGULAR_BULK_SQL),
    "q_series_regular_minutely": (series_regular_minutely, REGULAR_MINUTELY_SQL),
    "q_series_document": (series_document, SERIES_DOCUMENT_SQL),
    "q_regular_document": (regular_document, REGULAR_DOCUMENT_SQL),
    "q_timeslice_document": (timeslice_document, TIMESLICE_DOCUMENT_SQL),
    "q_latest_document": (latest_document, LATEST_DOCUMENT_SQL),
}
