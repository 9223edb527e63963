"""Stores over time: loads beside streams, folds, newest values, versions of permits, audits of a batch, message sources."""

import math
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyseries import schema, session
from skyseries.functions.times import obs_bucket, range_years
from skyseries.operators import access, documents, registry
from skyseries.operators.upsert import VALUE_KEY, latest_wins
from skyseries.plans import audits, read_api
from skyseries.plans.bulk_load import bulk_load
from skyseries.plans.ingest import SideTables, ingest_batch
from skyseries.queries.decoding import QC_MERGE_SQL, merged_flags, params, qc_messages
from skyseries.queries.identity import PERMITS_SQL, permit_tables
from skyseries.queries.mapping import HOURLY_SQL, OBS_SQL, TYPE_ID, ntz, obs, on_the_hour, table
from skyseries.queries.stored import SINGLE
from skyseries.queries.writes import BY_ARRIVAL, WAVE, hour_messages, side_tables, stored, stored_sql
from skyseries.sources.messages import from_topic, read_message_files, spread
from skyseries.sources.store import Store
from skyseries.streaming.jobs import ingest_stream


def stored_numbers(store):
    """Numbers of a store under their labels."""
    return stored(store).where("obstext is null").drop("obstext", "sensor", "lvl")


def empty_texts():
    return {c: F.lit(None) for c in ("totime", "loc", "deactivated", "lvl", "sensor")}


def hours_of(spark, sf_dir, where):
    """Hourly values of some observations, as a bulk load takes them."""
    last = latest_wins(on_the_hour(obs(spark, sf_dir)).where(where), VALUE_KEY, "seq", ["obsvalue"])
    return last.withColumn("obstime", F.col("obstime").cast("timestamp"))


def labels_of(spark, sf_dir, where):
    found = obs(spark, sf_dir).where(where).groupBy("timeseries", "station_id", "param_code", "param_id", "type_id")
    return found.agg(F.min("obstime").alias("fromtime")).withColumns(empty_texts())


def message_stream(spark, messages, parts):
    """Messages written to a folder and read from it as a stream of that many micro-batches."""
    arrivals = session.shared_dir(spark, "arrivals")
    for part in messages:
        spread(part).write.mode("append").parquet(arrivals)
    n_files = len(spark.read.schema(schema.MESSAGES).parquet(arrivals).inputFiles())
    return spark.readStream.schema(schema.MESSAGES).option("maxFilesPerTrigger", math.ceil(n_files / parts)).parquet(arrivals)


def load_then_stream(spark, sf_dir):
    """The first half of the month as a bulk load, then all messages of the second by a stream: neither takes the other's number."""
    store = Store(spark, session.shared_dir(spark, "both"))
    early = "obstime < timestamp_ntz'2024-01-16 00:00:00'"
    bulk_load(store, labels_of(spark, sf_dir, early), hours_of(spark, sf_dir, early), batch=0)
    late = hour_messages(spark, sf_dir).join(obs(spark, sf_dir).where(f"not ({early})").select("seq"), F.col("message_seq") % WAVE == F.col("seq"))
    source = message_stream(spark, [late.select("message_seq", "msg")], 1)
    everyone = lambda: SideTables(params(spark), *open_tables(spark, sf_dir))
    ingest_stream(store, source, everyone, checkpoint=session.shared_dir(spark, "progress")).awaitTermination()
    return stored_numbers(store)


def open_tables(spark, sf_dir):
    """Permits under which every station is open."""
    none, _ = permit_tables(spark, sf_dir)
    stations = obs(spark, sf_dir).select(F.col("station_id").cast("int").alias("station_id")).distinct()
    return none.limit(0), stations.withColumn("permit_id", F.lit(1))


# The stream writes later; within the stream the larger number wins, which is that of the first wave.
LOAD_SQL = f"""
with {OBS_SQL},
t as (select *, date_trunc('hour', obstime) as hour, obstime >= timestamp '2024-01-16' as late,
             seq + case when seq % 2 = 1 then {WAVE} else 0 end as number from obs)
select cast(station_id as integer) as station_id, param_code, hour as obstime, cast(cast(
    coalesce(arg_max(obsvalue, number) filter (late), arg_max(obsvalue, seq) filter (not late)) as real) as double) as obsvalue
from t group by 1, 2, 3"""


def registry_buckets(spark, sf_dir):
    """Three batches of messages: every label tuple has one id, all ids differ, and each lies in its key bucket."""
    store = Store(spark, session.shared_dir(spark, "buckets"))
    side = side_tables(spark, sf_dir)
    for batch in range(3):
        ingest_batch(store, spread(hour_messages(spark, sf_dir).drop("wave").where(F.col("message_seq") % 3 == batch)), side, batch)
    rows = store._log("registry").withColumn("right", F.col("key_bucket") == registry.key_bucket())
    tuples = rows.groupBy("station_id", "param_code", "sensor", "lvl").agg(
        F.count(F.lit(1)).alias("n_ids"), F.bool_and("right").alias("in_bucket"), F.min("timeseries").alias("id"))
    # The ids are one run of numbers from 1 on.
    top = rows.select("timeseries").distinct().agg(F.count(F.lit(1)).alias("ids"), F.max("timeseries").alias("top")).select((F.col("ids") == F.col("top")).alias("dense"))
    return tuples.select("station_id", "param_code", "sensor", "lvl", "n_ids", "in_bucket", F.lit(top.first().dense).alias("dense"))


BUCKETS_SQL = f"""
with s as ({stored_sql('seq')})
select distinct station_id, param_code, sensor, lvl, 1::bigint as n_ids, true as in_bucket, true as dense from s"""


def latest_incremental(spark, sf_dir):
    """Newest values kept beside twenty batches, the second half of them late, one written twice: without reading values."""
    store = Store(spark, session.shared_dir(spark, "newest"))
    hours = on_the_hour(obs(spark, sf_dir)).withColumn("day", F.dayofmonth("obstime"))
    # Odd days first, then the even ones, which are late.
    order = [*range(1, 32, 2), *range(2, 32, 2)]
    for batch, days in enumerate([order[i: i + 2] for i in range(0, 31, 2)] + [[31]]):
        last = latest_wins(hours.where(F.col("day").isin(days)), VALUE_KEY, "seq", ["obsvalue"])
        rows = last.withColumn("arrival", F.lit(batch))
        if batch == 5:
            store.write("data", rows.withColumn("obsvalue", F.lit(-1.0)), batch)
        if batch == 16:
            # The last day again, with other values, and only of some series.
            rows = rows.where("timeseries % 2 = 0").withColumn("obsvalue", F.col("obsvalue") + 1)
        store.write("data", rows, batch)
    labels = labels_of(spark, sf_dir, "true")
    store.write("registry", labels, 0)
    found = read_api.latest(store, datetime(2024, 1, 25))
    return found.select("timeseries", "station_id", "param_id", ntz("obstime"), F.col("obsvalue").cast("double").alias("obsvalue"))


LATEST_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL},
labels as (select distinct timeseries, cast(station_id as integer) as station_id, param_id from obs),
again as (select timeseries, obstime, case when day(obstime) = 31 and timeseries % 2 = 0 then obsvalue + 1 else obsvalue end as obsvalue from hourly)
select timeseries, station_id, param_id, max(obstime) as obstime, arg_max({SINGLE}, obstime) as obsvalue
from again join labels using (timeseries) where obstime > timestamp '2024-01-25' group by 1, 2, 3"""


def fold_months(spark, sf_dir):
    """Four batches of order dates, folded in place after the third: only months that several hold are written anew."""
    store = Store(spark, session.shared_dir(spark, "folds"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("timeseries"), F.col("o_orderdate").cast("timestamp").alias("obstime"), F.col("o_totalprice").alias("obsvalue"), "o_orderkey",
    )
    for batch in range(4):
        part = orders.where(F.col("o_orderkey") % 4 == batch).where((F.col("o_orderkey") % 4 != 1) | (F.month("obstime") < 4))
        rows = latest_wins(part, VALUE_KEY, "o_orderkey", ["obsvalue"]).withColumn("arrival", F.lit(batch))
        store.write("data", rows, batch)
        if batch == 2:
            store.fold_months("data", upto=1)
    store.fold_months("data", upto=2)
    return store.values("data").select("timeseries", ntz("obstime"), F.col("obsvalue").cast("double").alias("obsvalue"))


FOLD_SQL = """
with o as (select *, o_orderkey % 4 as batch from orders where o_orderkey % 4 <> 1 or month(o_orderdate) < 4)
select o_custkey as timeseries, o_orderdate as obstime, cast(cast(arg_max(o_totalprice, batch * 1000000000000 + o_orderkey) as real) as double) as obsvalue
from o group by 1, 2"""


# First arrivals of the versions of the permits, as event numbers in hundredths of the table.
VERSION_SHARES = (0, 35, 70)


def permits_as_of(spark, sf_dir):
    """Observations of the series that were open when they arrived; each third of the events meets other permits."""
    events = obs(spark, sf_dir)
    n = events.agg(F.max("seq")).first()[0] + 1
    starts = [n * share // 100 for share in VERSION_SHARES]
    param_permits, station_permits = permit_tables(spark, sf_dir)
    version = F.explode(F.array(*[F.lit(i) for i in range(len(starts))])).alias("version")
    # Every version turns all permits around.
    turned = F.pmod(F.col("permit_id") + F.col("version"), F.lit(2)).cast("int")
    both = [t.select("*", version).withColumn("permit_id", turned) for t in (param_permits, station_permits)]
    found = access.open_as_of(events, "seq", starts, *both)
    return found.where("is_open").select("seq", "station_id", "param_id", "version", "obstime", "obsvalue")


AS_OF_SQL = f"""
with {OBS_SQL}, {PERMITS_SQL},
n as (select max(seq) + 1 as n from obs),
starts as (select n * share // 100 as start, v from n, (values (0, 0), (35, 1), (70, 2)) as t(share, v)),
keyed as (select obs.*, v from obs asof join starts on obs.seq >= starts.start),
decided as (
  select k.station_id, k.type_id, k.param_id, k.v, coalesce(arg_min((pp.permit_id + k.v) % 2, pp.ord), any_value((sp.permit_id + k.v) % 2), 0) = 1 as is_open
  from (select distinct station_id, type_id, param_id, v from keyed) k
  left join pp on k.station_id = pp.station_id and pp.type_id in (0, k.type_id) and pp.param_id in (0, k.param_id)
  left join sp on k.station_id = sp.station_id group by 1, 2, 3, 4)
select seq, station_id, param_id, cast(v as integer) as version, obstime, obsvalue
from keyed join decided using (station_id, type_id, param_id, v) where is_open"""


def refresh_stream(spark, sf_dir):
    """Two micro-batches with a refresh of the permits in between, which closes what was open and opens the rest."""
    store, progress = Store(spark, session.shared_dir(spark, "refreshed")), session.shared_dir(spark, "progress")
    messages = hour_messages(spark, sf_dir)
    loads = []

    def load():
        loads.append(1)
        side = side_tables(spark, sf_dir)
        turned = F.pmod(F.col("permit_id") + len(loads) - 1, F.lit(2)).cast("int")
        return SideTables(side.params, *(t.withColumn("permit_id", turned) for t in (side.param_permits, side.station_permits)))

    source = message_stream(spark, [messages.where(F.col("wave") == wave).drop("wave") for wave in (0, 1)], 2)
    ingest_stream(store, source, load, checkpoint=progress, refresh_minutes=0).awaitTermination()
    return stored_numbers(store)


REFRESH_SQL = f"""
with {OBS_SQL}, {PERMITS_SQL},
t as (select *, 1 - seq % 2 as wave, {BY_ARRIVAL} as arrival from obs),
decided as (
  select k.station_id, k.param_id, k.wave, coalesce(arg_min((pp.permit_id + k.wave) % 2, pp.ord), any_value((sp.permit_id + k.wave) % 2), 0) = 1 as is_open
  from (select distinct station_id, param_id, wave from t) k
  left join pp on k.station_id = pp.station_id and pp.type_id in (0, {TYPE_ID}) and pp.param_id in (0, k.param_id)
  left join sp on k.station_id = sp.station_id group by 1, 2, 3)
select cast(station_id as integer) as station_id, param_code, date_trunc('hour', obstime) as obstime,
  cast(cast(arg_max(obsvalue, arrival) as real) as double) as obsvalue
from t join decided using (station_id, param_id, wave) where is_open group by 1, 2, 3"""


def audit_delta(spark, sf_dir):
    """The audit of three loads, summed up from what each of them changed."""
    items = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") != 13, F.col("l_partkey")).alias("timeseries"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linenumber") == 7, F.col("l_shipdate") + F.expr("interval 12000 days")).otherwise(F.col("l_shipdate")).cast("timestamp").alias("obstime"),
        F.col("l_extendedprice").alias("obsvalue"),
    )
    part = table(spark, sf_dir, "part").where("p_size > 5").select(
        F.col("p_partkey").alias("timeseries"), F.col("p_size").alias("station_id"), F.lit(TYPE_ID).alias("type_id"), F.lit("P").alias("param_code"),
        F.lit(1).alias("param_id"), F.lit(None).cast("timestamp").alias("fromtime"),
    ).withColumns(empty_texts())
    store = Store(spark, session.shared_dir(spark, "deltas"))
    changes = []
    for batch in range(3):
        # Most parts are registered after their first values.
        bulk_load(store, part.where(F.col("timeseries") % 3 == batch), items.where(F.col("line") % 3 == batch), batch)
        changes.append(audits.audit_batch(store, batch))
    return audits.added(*changes)


AUDIT_DELTA_SQL = """
with v as (select case when l_quantity <> 13 then l_partkey end as k, l_linenumber % 3 as batch,
                  case when l_linenumber = 7 then l_shipdate + interval 12000 day else l_shipdate end as t from lineitem),
loaded as (select distinct k, t, batch from v where year(t) >= 1950 and year(t) < 2030),
s as (select p_partkey as id, p_size from part where p_size > 5)
select 'duplicate_key' as audit, (select count(*) from (select k, t from loaded group by 1, 2 having count(*) > 1)) as n
union all select 'rejected', (select count(*) from v where year(t) < 1950 or year(t) >= 2030)
union all select 'orphan_series', count(distinct k) from loaded where k not in (select id from s)
union all select 'orphan_label', 0
union all select 'null_key', count(*) from loaded where k is null
union all select 'uncovered_time', 0
union all select 'ambiguous_label', count(*) from (select p_size from s group by 1 having count(*) > 1)"""


def partition_ranges(spark, sf_dir):
    """Line items per storage range; the ranges are a table, made of the years of the orders and one that is split off."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).where("year % 2 = 0")
    last = table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") + 1).alias("year"))
    edges = last.agg(F.max("year").alias("year")).unionByName(years.agg((F.min("year") + 1).cast("int").alias("year")))
    ranges = range_years(years.unionByName(edges))
    rows = table(spark, sf_dir, "lineitem").select(obs_bucket(F.col("l_shipdate"), ranges).alias("obs_bucket"))
    return rows.groupBy("obs_bucket").agg(F.count(F.lit(1)).alias("n"))


RANGES_SQL = """
with years as (select distinct year(o_orderdate) as y from orders where year(o_orderdate) % 2 = 0),
starts as (select y from years union select min(y) + 1 from years),
ends as (select max(year(l_shipdate)) + 1 as y from lineitem)
select cast((select max(s.y) from starts s where s.y <= year(l_shipdate)) as integer) as obs_bucket, count(*) as n
from lineitem group by 1"""


def latest_export(spark, sf_dir):
    """The newest value of every series as parts of bounded size; put together they are in the order of the series."""
    newest = hours_of(spark, sf_dir, "true").groupBy("timeseries").agg(F.max("obstime").alias("obstime"), F.max_by("obsvalue", "obstime").alias("obsvalue"))
    labels = labels_of(spark, sf_dir, "true").select("timeseries", F.col("station_id").cast("int").alias("station_id"), F.lit(None).cast(schema.LOCATION).alias("loc"))
    parts = documents.latest_documents(newest.join(labels, "timeseries"), part_rows=2000)
    sizes = parts.select("part_no", F.size("data").alias("n"))
    before = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = parts.join(offsets, "part_no").select("offset", F.posexplode("data").alias("pos", "d"))
    return placed.select((F.col("offset") + F.col("pos")).alias("place"), "d.station_id", "d.timestamp", F.col("d.value").alias("value"))


EXPORT_SQL = f"""
with {OBS_SQL}, {HOURLY_SQL},
newest as (select timeseries, max(obstime) as obstime, arg_max(obsvalue, obstime) as value from hourly group by 1)
select row_number() over (order by timeseries) - 1 as place, cast(timeseries // 10 as integer) as station_id,
  strftime(obstime, '%Y-%m-%dT%H:%M:%SZ') as timestamp, value from newest"""


def message_files(spark, sf_dir):
    """Messages as text files: orders of forty customers of a nation in each, one line per order, read and stored."""
    inbox = session.shared_dir(spark, "inbox")
    placed = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    line = F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit(","), F.col("o_totalprice").cast("string"))
    station = (F.floor(F.col("c_custkey") / 1000) * 100 + F.col("c_nationkey")).alias("station")
    # Later lines of a message win.
    lines = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"))))["line"]
    bodies = placed.groupBy(station).agg(F.array_join(lines, "\n").alias("body"))
    text = F.concat(F.lit("kldata/nationalnr="), "station", F.lit(f"/type={TYPE_ID}/messageid="), "station", F.lit("\npurchase\n"), "body")
    bodies.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(inbox)
    stations = bodies.select(F.col("station").cast("int").alias("station_id"), F.lit(1).alias("permit_id"))
    store = Store(spark, session.shared_dir(spark, "files"))
    ingest_batch(store, spread(read_message_files(spark, inbox)), SideTables(params(spark), open_tables(spark, sf_dir)[0], stations), batch=0)
    return stored_numbers(store)


FILES_SQL = """
select cast(c_custkey // 1000 * 100 + c_nationkey as integer) as station_id, 'purchase' as param_code, o_orderdate as obstime,
  cast(cast(arg_max(o_totalprice, o_orderkey) as real) as double) as obsvalue
from orders join customer on o_custkey = c_custkey group by 1, 3"""


def topic_records(spark, sf_dir):
    """Flags of the records of a topic with two partitions, one far ahead in its offsets: what arrived last wins."""
    messages = qc_messages(spark, sf_dir)
    number, ahead = F.col("message_seq"), F.floor(F.col("message_seq") / 2) % 2
    records = messages.select(
        ahead.cast("int").alias("partition"), (number + ahead * 10**9).alias("offset"), F.col("value").cast("binary").alias("value"),
        F.timestamp_seconds(1_700_000_000 + number).alias("timestamp"),
    )
    return merged_flags(from_topic(records, n_partitions=2))


QUERIES = {
    "q_load_then_stream": (load_then_stream, LOAD_SQL),
    "q_registry_buckets": (registry_buckets, BUCKETS_SQL),
    "q_latest_incremental": (latest_incremental, LATEST_SQL),
    "q_fold_months": (fold_months, FOLD_SQL),
    "q_permits_as_of": (permits_as_of, AS_OF_SQL),
    "q_refresh_stream": (refresh_stream, REFRESH_SQL),
    "q_audit_delta": (audit_delta, AUDIT_DELTA_SQL),
    "q_partition_ranges": (partition_ranges, RANGES_SQL),
    "q_latest_export": (latest_export, EXPORT_SQL),
    "q_message_files": (message_files, FILES_SQL),
    "q_topic_records": (topic_records, QC_MERGE_SQL),
}
