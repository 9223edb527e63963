"""Upserts, late data, whole ingest into a store, and the same by stream."""

import math

from pyspark.sql import functions as F

from skyseries import schema, session
from skyseries.operators import registry
from skyseries.operators.qc import PAYLOAD
from skyseries.operators.skew import lookup_join
from skyseries.operators.upsert import VALUE_KEY, latest_wins
from skyseries.plans.ingest import SideTables, ingest_batch
from skyseries.plans.qc_ingest import qc_batch
from skyseries.queries.decoding import params, qc_messages
from skyseries.queries.identity import PERMITS_SQL, permit_tables
from skyseries.queries.mapping import OBS_SQL, TYPE_ID, ntz, obs, on_the_hour, table
from skyseries.sources.messages import spread
from skyseries.sources.store import Store
from skyseries.streaming.jobs import ingest_stream, qc_stream

# The messages of the first wave have larger numbers than those of the second, which come later all the same.
WAVE = 2**40


def upsert_latest_wins(spark, sf_dir):
    hours = on_the_hour(obs(spark, sf_dir))
    return latest_wins(hours, ["station_id", "param_code", "obstime"], "seq", ["obsvalue"])


UPSERT_SQL = f"""
with {OBS_SQL}
select station_id, param_code, date_trunc('hour', obstime) as obstime, arg_max(obsvalue, seq) as obsvalue from obs group by 1, 2, 3"""


def upsert_nonscalar(spark, sf_dir):
    hours = on_the_hour(obs(spark, sf_dir))
    return latest_wins(hours, VALUE_KEY, "seq", ["obstext"], unique=True)


NONSCALAR_SQL = f"""
with {OBS_SQL}
select timeseries, date_trunc('hour', obstime) as obstime, arg_max(obstext, seq) as obstext from obs group by 1, 2"""


def upsert_null_wins(spark, sf_dir):
    """Daily values of which every fifth write is NULL: the last write counts even then."""
    daily = obs(spark, sf_dir).withColumns({
        "obstime": F.date_trunc("day", "obstime").cast("timestamp_ntz"),
        "obsvalue": F.when(F.col("seq") % 5 != 0, F.col("obsvalue")),
    })
    return latest_wins(daily, VALUE_KEY, "seq", ["obsvalue", "obstext"], unique=True)


NULL_WINS_SQL = f"""
with {OBS_SQL}
select timeseries, date_trunc('day', obstime) as obstime, arg_max_null(case when seq % 5 <> 0 then obsvalue end, seq) as obsvalue,
       arg_max(obstext, seq) as obstext from obs group by 1, 2"""


def late_overwrite(spark, sf_dir):
    """Two batches in a stored log, the second one late for every time it touches and with the smaller numbers."""
    store = Store(spark, session.shared_dir(spark, "late"))
    hours = on_the_hour(obs(spark, sf_dir))
    for wave in (0, 1):
        writes = hours.where(F.col("seq") % 2 == 1 - wave).withColumn("seq", F.col("seq") + (1 - wave) * WAVE)
        last = latest_wins(writes, VALUE_KEY, "seq", ["obsvalue"])
        store.write("data", last.withColumn("arrival", F.lit(wave)), wave)
    return store.values("data").select("timeseries", ntz("obstime"), F.col("obsvalue").cast("double").alias("obsvalue"))


# What comes later wins: the second wave, and within a wave the larger number.
BY_ARRIVAL = f"seq + case when seq % 2 = 0 then {WAVE} else 0 end"
# Stored values are single precision.
LATE_SQL = f"""
with {OBS_SQL}
select timeseries, date_trunc('hour', obstime) as obstime, cast(cast(arg_max(obsvalue, {BY_ARRIVAL}) as real) as double) as obsvalue
from obs group by 1, 2"""


def hour_messages(spark, sf_dir):
    """One message per event, its time cut to the hour so that many write the same key, in two waves."""
    hours = obs(spark, sf_dir)
    text = F.concat(
        F.lit("kldata/nationalnr="), F.col("station_id"), F.lit("/type=501/messageid="), F.col("seq"), F.lit("\n"),
        F.col("param_code"), F.lit(",TXT(1,2)\n"), F.date_format("obstime", "yyyyMMddHH"), F.lit("0000,"),
        F.col("obsvalue").cast("string"), F.lit(","), F.col("obstext"),
    )
    late = 1 - F.col("seq") % 2
    return hours.select((F.col("seq") + (1 - late) * WAVE).alias("message_seq"), text.alias("msg"), late.alias("wave"))


def wave_messages(spark, sf_dir, wave):
    return spread(hour_messages(spark, sf_dir).where(F.col("wave") == wave).drop("wave"))


def side_tables(spark, sf_dir):
    return SideTables(params(spark), *permit_tables(spark, sf_dir))


def stored(store):
    """Numbers and texts of a store under their labels."""
    # There are as many labels as series, far more than their files seem to hold.
    labels = store.registry().select("timeseries", "station_id", "param_code", "sensor", "lvl").hint("merge")
    columns = ["station_id", "param_code", "sensor", "lvl", ntz("obstime")]
    none = F.lit(None)
    numbers = store.values("data").join(labels, "timeseries").select(
        *columns, F.col("obsvalue").cast("double").alias("obsvalue"), none.cast("string").alias("obstext")
    )
    texts = store.values("nonscalar_data").join(labels, "timeseries").select(
        *columns, none.cast("double").alias("obsvalue"), F.col("obsvalue").alias("obstext")
    )
    return numbers.unionByName(texts)


def ingest_store(spark, sf_dir):
    """Messages through decoding, access rule, registry and upsert in one batch, and read back."""
    store = Store(spark, session.shared_dir(spark, "ingest"))
    ingest_batch(store, spread(hour_messages(spark, sf_dir).drop("wave")), side_tables(spark, sf_dir), batch=0)
    return stored(store)


def stream_equals_batch(spark, sf_dir):
    """The same messages as files that arrive in two waves, ingested in micro-batches."""
    arrivals = session.shared_dir(spark, "arrivals")
    messages = hour_messages(spark, sf_dir)
    for wave in (0, 1):
        spread(messages.where(F.col("wave") == wave).drop("wave")).write.mode("append").parquet(arrivals)
    n_files = len(spark.read.schema(schema.MESSAGES).parquet(arrivals).inputFiles())
    source = spark.readStream.schema(schema.MESSAGES).option("maxFilesPerTrigger", math.ceil(n_files / 2)).parquet(arrivals)
    store = Store(spark, session.shared_dir(spark, "streamed"))
    progress = session.shared_dir(spark, "progress")
    ingest_stream(store, source, lambda: side_tables(spark, sf_dir), checkpoint=progress).awaitTermination()
    return stored(store)


def stored_sql(arrival: str) -> str:
    return f"""
with {OBS_SQL}, {PERMITS_SQL},
kept as (select obs.*, {arrival} as arrival from obs
         join opened using (station_id, type_id, param_id) where is_open),
texts as (
  select obs.*, {arrival} as arrival from obs
  join (select k.station_id, coalesce(arg_min(pp.permit_id, pp.ord), any_value(sp.permit_id), 0) = 1 as is_open
        from (select distinct station_id from obs) k
        left join pp on k.station_id = pp.station_id and pp.type_id in (0, 501) and pp.param_id in (0, 9)
        left join sp on k.station_id = sp.station_id group by 1) t on t.station_id = obs.station_id where t.is_open)
select cast(station_id as integer) as station_id, param_code, null::integer as sensor, null::integer as lvl,
       date_trunc('hour', obstime) as obstime, cast(cast(arg_max(obsvalue, arrival) as real) as double) as obsvalue,
       null::varchar as obstext from kept group by 1, 2, 5
union all
select cast(station_id as integer), 'TXT', 1, 2, date_trunc('hour', obstime), null, arg_max(obstext, arrival) from texts group by 1, 5"""


# Within one batch the larger number wins, which the first wave has.
INGEST_SQL = stored_sql(f"seq + case when seq % 2 = 1 then {WAVE} else 0 end")
STREAM_SQL = stored_sql(BY_ARRIVAL)


def qc_store(spark, sf_dir):
    """Control records of all events in two batches, the first before any series is known.

    The second half of the month arrives first and waits for the series; records of parameters without
    series wait on.
    """
    store = Store(spark, session.shared_dir(spark, "control"))
    later = "obstime >= timestamp_ntz'2024-01-16 00:00:00'"
    qc_batch(store, spread(qc_messages(spark, sf_dir, where=later)), batch=0)
    levels = F.explode(F.array(F.lit(None).cast("int"), F.lit(1)))
    registered = obs(spark, sf_dir).where("param_id <> 5").groupBy("station_id", "param_code", "param_id").agg(
        F.min("obstime").alias("fromtime")
    ).select("*", F.lit(501).alias("type_id"), levels.alias("lvl"), F.lit(None).cast("int").alias("sensor"))
    null = F.lit(None)
    unset = {"totime": null, "loc": null, "deactivated": null}
    store.write("registry", registry.assign_ids(registered).withColumns(unset), 0)
    qc_batch(store, spread(qc_messages(spark, sf_dir, where=f"not ({later})")), batch=1)
    return flags(store).unionByName(records(store.waiting(store.seen_registry()), "waiting"))


def records(rows, status):
    doubles = [F.col(c).cast("double").alias(c) for c in PAYLOAD[:2]]
    return rows.select("station_id", "param_id", "lvl", ntz("obstime"), *doubles, *PAYLOAD[2:], F.lit(status).alias("status"))


def flags(store):
    """Control records of a store under their labels."""
    labels = store.labels_met().select("timeseries", "station_id", "param_id", "lvl").hint("merge")
    return records(store.values("qc_flags").join(labels, "timeseries"), "stored")


# Stored values are single precision.
QC_STORE_SQL = f"""
with {OBS_SQL},
t as (select *, cast(nullif(seq % 2, 0) as integer) as lvl, date_trunc('second', obstime) as at_second,
             cast(cast(obsvalue as real) as double) as single from obs)
select cast(station_id as integer) as station_id, param_id, lvl, at_second as obstime, arg_max(single, seq) as original,
       null::double as corrected, 'c<1' as controlinfo, 'u' || max(seq) as useinfo, null::integer as cfailed, 'stored' as status
from t where param_id <> 5 group by 1, 2, 3, 4
union all
select cast(station_id as integer), param_id, lvl, at_second, single, null, 'c<1', 'u' || seq, null, 'waiting' from t where param_id = 5
union all
select cast(station_id as integer), 77, lvl, at_second, 10, single, 'c<1', null, null, 'waiting' from t"""


def qc_stream_late_series(spark, sf_dir):
    """Control records as a stream of one micro-batch per wave, half of the series registered only after the first one.

    Records of closed series are rejected, those of open ones wait until their series is there; parameter 5 never is. Three
    batches without messages at the end add nothing.
    """
    store, arrivals, progress = (session.shared_dir(spark, name) for name in ("streamed", "arrivals", "progress"))
    store = Store(spark, store)
    side = side_tables(spark, sf_dir)
    known = obs(spark, sf_dir).groupBy("station_id", "param_code", "param_id").agg(F.min("obstime").alias("fromtime")).select(
        "*", F.lit(501).alias("type_id"), F.lit(None).cast("int").alias("sensor"),
        F.explode(F.array(F.lit(None).cast("int"), F.lit(1))).alias("lvl"),
    )
    null = F.lit(None)
    unset = {"totime": null, "loc": null, "deactivated": null}
    source = spark.readStream.schema(schema.QC_MESSAGES).option("maxFilesPerTrigger", 8)
    top = 0
    for wave, registered in enumerate(("param_id in (1, 2)", "param_id in (3, 4)", "false")):
        new = registry.assign_ids(known.where(registered), after=top).withColumns(unset)
        store.write("registry", new, wave)
        top = store.registry().agg(F.max("timeseries")).first()[0] or 0
        messages = qc_messages(spark, sf_dir, where=f"pmod(seq, 3) = {wave}")
        spread(messages, 8).write.mode("append").parquet(arrivals)
        qc_stream(store, source.parquet(arrivals), checkpoint=progress, side=lambda: side).awaitTermination()
    last = max(store.batches("qc_state"))
    for batch in (1, 2, 3):
        qc_batch(store, spark.createDataFrame([], schema.QC_MESSAGES), last + batch, side)
    refused = store.log("qc_rejects").select(
        *[null.cast(t).alias(c) for c, t in (("station_id", "int"), ("param_id", "int"), ("lvl", "int"), ("obstime", "timestamp_ntz"))],
        *[null.cast("double").alias(c) for c in PAYLOAD[:2]], F.col("code").alias("controlinfo"), F.col("detail").alias("useinfo"),
        null.cast("int").alias("cfailed"), F.lit("rejected").alias("status"),
    )
    return flags(store).unionByName(records(store.waiting(store.seen_registry()), "waiting")).unionByName(refused)


QC_STREAM_SQL = f"""
with {OBS_SQL}, {PERMITS_SQL},
keys as (select distinct station_id, p as param_id from obs, unnest([1, 2, 3, 4, 5, 77]) as u(p)),
opens as (
  select k.station_id, k.param_id, coalesce(arg_min(pp.permit_id, pp.ord), any_value(sp.permit_id), 0) = 1 as is_open
  from keys k left join pp on k.station_id = pp.station_id and pp.type_id in (0, {TYPE_ID}) and pp.param_id in (0, k.param_id)
  left join sp on k.station_id = sp.station_id group by 1, 2),
t as (select *, cast(nullif(seq % 2, 0) as integer) as lvl, date_trunc('second', obstime) as at_second,
             cast(cast(obsvalue as real) as double) as single from obs),
records as (
  select station_id, param_id, lvl, at_second, single as original, null::double as corrected, 'u' || seq as useinfo, seq from t
  union all select station_id, 77, lvl, at_second, 10, single, null, seq from t),
sorted as (
  select r.*, case when param_id in (1, 2) or param_id in (3, 4) and (is_open or seq % 3 > 0) then 'stored' when is_open then 'waiting' else 'rejected' end as status
  from records r join opens using (station_id, param_id))
select cast(station_id as integer) as station_id, cast(param_id as integer) as param_id, lvl, at_second as obstime,
  original, corrected, 'c<1' as controlinfo, useinfo, null::integer as cfailed, status
from sorted where status = 'waiting'
union all
select cast(station_id as integer), cast(param_id as integer), lvl, at_second, arg_max(original, (seq % 3) * {WAVE} + seq), null,
  'c<1', arg_max(useinfo, (seq % 3) * {WAVE} + seq), null, 'stored'
from sorted where status = 'stored' group by 1, 2, 3, 4
union all
select null, null, null, null, null, null, 'CLOSED_SERIES', station_id || '/{TYPE_ID}/' || param_id, null, 'rejected' from sorted where status = 'rejected'"""


def compact_store(spark, sf_dir):
    """A store that is folded while control records wait, written on, and folded again: nothing is lost or numbered twice."""
    store = Store(spark, session.shared_dir(spark, "first"))
    side = side_tables(spark, sf_dir)
    qc_batch(store, spread(qc_messages(spark, sf_dir)), batch=0)
    ingest_batch(store, wave_messages(spark, sf_dir, 0), side, batch=0)
    store = store.compact_into(session.shared_dir(spark, "second"))
    ingest_batch(store, wave_messages(spark, sf_dir, 1), side, batch=1)
    qc_batch(store, spark.createDataFrame([], schema.QC_MESSAGES), batch=1)
    store = store.compact_into(session.shared_dir(spark, "third"))
    none = F.lit(None)
    codes = store.registry().select("timeseries", "station_id", "param_code", "sensor", "lvl").hint("merge")
    found = store.values("qc_flags").join(codes, "timeseries").select(
        "station_id", "param_code", "sensor", "lvl", ntz("obstime"), F.col("original").cast("double").alias("obsvalue"), F.col("useinfo").alias("obstext")
    )
    counts = store.registry().agg((F.count("timeseries") - F.countDistinct("timeseries")).alias("n")).select(F.lit("ids twice").alias("kind"), "n")
    counts = counts.unionByName(store.log("receipts").agg(F.count("message_seq").alias("n")).select(F.lit("receipts").alias("kind"), "n"))
    summed = counts.select(
        none.cast("int").alias("station_id"), none.cast("string").alias("param_code"), none.cast("int").alias("sensor"),
        none.cast("int").alias("lvl"), none.cast("timestamp_ntz").alias("obstime"), F.col("n").cast("double").alias("obsvalue"),
        F.col("kind").alias("obstext"),
    )
    return stored(store).unionByName(found).unionByName(summed)


COMPACT_SQL = f"""{STREAM_SQL}
union all
select cast(station_id as integer), param_code, null, null, date_trunc('second', obstime),
  cast(cast(arg_max(obsvalue, seq) as real) as double), 'u' || max(seq)
from kept where seq % 2 = 0 group by 1, 2, 5
union all select null, null, null, null, null, 0, 'ids twice'
union all select null, null, null, null, null, (select count(*) from obs), 'receipts'"""


def skewed_lookup(spark, sf_dir):
    """Line items and their part, every part that has more than four of them cut into slices."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return lookup_join(items, part, ["p_partkey"], sliced=True, rows_per_task=4)


SKEWED_SQL = "select l_orderkey, l_linenumber, l_partkey as p_partkey, p_size from lineitem left join part on l_partkey = p_partkey"


QUERIES = {
    "q_upsert_latest_wins": (upsert_latest_wins, UPSERT_SQL),
    "q_upsert_nonscalar": (upsert_nonscalar, NONSCALAR_SQL),
    "q_upsert_null_wins": (upsert_null_wins, NULL_WINS_SQL),
    "q_late_overwrite": (late_overwrite, LATE_SQL),
    "q_ingest_store": (ingest_store, INGEST_SQL),
    "q_stream_equals_batch": (stream_equals_batch, STREAM_SQL),
    "q_qc_store": (qc_store, QC_STORE_SQL),
    "q_qc_stream": (qc_stream_late_series, QC_STREAM_SQL),
    "q_compact_store": (compact_store, COMPACT_SQL),
    "q_skewed_lookup": (skewed_lookup, SKEWED_SQL),
}
