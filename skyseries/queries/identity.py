"""Access rule, series registry and resolution."""

from pyspark.sql import functions as F

from skyseries.operators import access, registry
from skyseries.queries.mapping import CODES, OBS_SQL, TYPE_ID, obs, table


def permit_tables(spark, sf_dir):
    """Permits of both kinds for the stations of `customer`, by the remainder of the station id."""
    stations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id"), "c_nationkey")
    station = F.col("station_id")

    def permit(type_id, param_id, permit_id, order):
        return F.struct(
            F.lit(type_id).alias("type_id"), F.lit(param_id).alias("param_id"),
            (permit_id if not isinstance(permit_id, int) else F.lit(permit_id)).cast("int").alias("permit_id"),
            F.lit(order).alias("ord"),
        )

    alternating = F.call_function("div", station, F.lit(4)) % 2
    lists = (
        F.when(station % 4 == 0, F.array(permit(0, 0, alternating, 0)))
        .when(station % 4 == 1, F.array(permit(TYPE_ID, 2, 0, 0), permit(0, 0, 1, 1)))
        .when(station % 4 == 2, F.array(permit(0, 3, 1, 0), permit(999, 0, 0, 1)))
    )
    param_permits = stations.select("station_id", F.inline(lists))
    station_permits = stations.where(station % 5 != 0).select("station_id", (F.col("c_nationkey") % 2).alias("permit_id"))
    return param_permits, station_permits


PERMITS_SQL = f"""pp as (
  select c_custkey as station_id, 0 as type_id, 0 as param_id, (c_custkey // 4) % 2 as permit_id, 0 as ord from customer where c_custkey % 4 = 0
  union all select c_custkey, {TYPE_ID}, 2, 0, 0 from customer where c_custkey % 4 = 1
  union all select c_custkey, 0, 0, 1, 1 from customer where c_custkey % 4 = 1
  union all select c_custkey, 0, 3, 1, 0 from customer where c_custkey % 4 = 2
  union all select c_custkey, 999, 0, 0, 1 from customer where c_custkey % 4 = 2),
sp as (select c_custkey as station_id, c_nationkey % 2 as permit_id from customer where c_custkey % 5 <> 0),
opened as (
  select k.station_id, k.type_id, k.param_id, coalesce(arg_min(pp.permit_id, pp.ord), any_value(sp.permit_id), 0) = 1 as is_open
  from (select distinct station_id, type_id, param_id from obs) k
  left join pp on k.station_id = pp.station_id and (pp.type_id = 0 or pp.type_id = k.type_id)
              and (pp.param_id = 0 or pp.param_id = k.param_id)
  left join sp on k.station_id = sp.station_id group by 1, 2, 3)"""


def permit_filter(spark, sf_dir):
    opened = access.filter_open(obs(spark, sf_dir), *permit_tables(spark, sf_dir))
    return opened.select("seq", "station_id", "param_id", "obstime", "obsvalue")


PERMIT_SQL = f"""
with {OBS_SQL}, {PERMITS_SQL}
select seq, obs.station_id, obs.param_id, obstime, obsvalue from obs join opened using (station_id, type_id, param_id) where is_open"""


def open_series(spark, sf_dir):
    keys = obs(spark, sf_dir).select(*access.KEY).distinct()
    return access.open_flags(keys, *permit_tables(spark, sf_dir))


OPEN_SQL = f"with {OBS_SQL}, {PERMITS_SQL} select station_id, type_id, param_id, is_open from opened"


def leveled(spark, sf_dir):
    """Observations with a level from 1 to 2 or none, and no sensor."""
    level = F.when(F.col("seq") % 3 != 0, (F.col("seq") % 3).cast("int"))
    return obs(spark, sf_dir).withColumns({"lvl": level, "sensor": F.lit(None).cast("int")})


LEVELED_SQL = "leveled as (select *, cast(nullif(seq % 3, 0) as integer) as lvl, null::integer as sensor from obs)"


def series_registry(spark, sf_dir):
    """Registry after two batches: series of signups first, then all others that are new.

    The second batch brings every series again; only new label tuples get an id.
    """
    observations = leveled(spark, sf_dir)
    columns = ["timeseries", *registry.SOURCE_KEY, "param_id", "fromtime"]
    first_keys = registry.distinct_series(observations.where("param_code = 'signup'"), ["seq"])
    first = registry.assign_ids(first_keys).select(*columns)
    top = first.agg(F.coalesce(F.max("timeseries"), F.lit(0))).first()[0]
    new = registry.missing_series(registry.distinct_series(observations, ["seq"]), first)
    return first.unionByName(registry.assign_ids(new, after=top).select(*columns))


# The order of ids: hash of the label tuple.
_HASH = "md5(concat_ws('|', station_id, type_id, param_code, coalesce(lvl::varchar, '-'), coalesce(sensor::varchar, '-')))"
REGISTRY_SQL = f"""
with {OBS_SQL}, {LEVELED_SQL},
keys as (select station_id, type_id, param_code, lvl, sensor, param_id, arg_min(obstime, seq) as fromtime
         from leveled group by all)
select row_number() over (order by case when param_code = 'signup' then 0 else 1 end, {_HASH}) as timeseries,
       station_id, type_id, param_code, lvl, sensor, param_id, fromtime from keys"""


def station_registry(spark, sf_dir):
    """Registered series of every customer: each parameter without level and at level 1."""
    numbers = F.explode(F.array(*[F.struct(F.lit(c).alias("param_code"), F.lit(i).alias("param_id")) for i, c in enumerate(CODES, 1)]))
    levels = F.explode(F.array(F.lit(None).cast("int"), F.lit(1)))
    stations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id"), numbers.alias("p"))
    rows = stations.select("station_id", "p.param_code", "p.param_id", levels.alias("lvl"))
    return rows.select(
        ((F.col("station_id") * 10 + F.col("param_id")) * 2 + F.coalesce("lvl", F.lit(0))).alias("timeseries"),
        "station_id", F.lit(TYPE_ID).alias("type_id"), "param_code", "param_id", "lvl", F.lit(None).cast("int").alias("sensor"),
    )


STATION_REGISTRY_SQL = f"""reg as (
  select (c_custkey * 10 + p) * 2 + coalesce(l, 0) as timeseries, c_custkey as station_id, {TYPE_ID} as type_id,
         list_extract({CODES!r}, p) as param_code, p as param_id, l as lvl, null::integer as sensor
  from customer, unnest([1, 2, 3, 4, 5]) as t(p), unnest([null, 1]) as u(l))"""


def series_resolve(spark, sf_dir):
    """Series id of every observation by its label tuple; level 2 is not registered."""
    unresolved = leveled(spark, sf_dir).drop("timeseries")
    return registry.resolve_series(unresolved, station_registry(spark, sf_dir)).select("seq", "timeseries")


RESOLVE_SQL = f"""
with {OBS_SQL}, {LEVELED_SQL}, {STATION_REGISTRY_SQL}
select seq, min(reg.timeseries) as timeseries from leveled o left join reg on o.station_id = reg.station_id and o.type_id = reg.type_id
  and o.param_code = reg.param_code and o.lvl is not distinct from reg.lvl and o.sensor is not distinct from reg.sensor group by 1"""


def qc_resolve(spark, sf_dir):
    """Series of control records where every label tuple belongs to two series: the smaller id counts."""
    once = registry.labels_met(station_registry(spark, sf_dir))
    twice = once.unionByName(once.withColumn("timeseries", F.col("timeseries") + 5_000_000_000))
    found = registry.resolve_met(leveled(spark, sf_dir).drop("timeseries"), twice)
    return found.select("seq", "timeseries", F.col("timeseries").isNull().alias("in_quarantine"))


QC_RESOLVE_SQL = f"""
with {OBS_SQL}, {LEVELED_SQL}, {STATION_REGISTRY_SQL},
met as (select timeseries, station_id, param_id, type_id, lvl, sensor from reg
        union all select timeseries + 5000000000, station_id, param_id, type_id, lvl, sensor from reg)
select seq, min(met.timeseries) as timeseries, min(met.timeseries) is null as in_quarantine
from leveled o left join met on o.station_id = met.station_id and o.type_id = met.type_id
  and o.param_id = met.param_id and o.lvl is not distinct from met.lvl and o.sensor is not distinct from met.sensor group by 1"""


QUERIES = {
    "q_permit_filter": (permit_filter, PERMIT_SQL),
    "q_open_series": (open_series, OPEN_SQL),
    "q_series_registry": (series_registry, REGISTRY_SQL),
    "q_series_resolve": (series_resolve, RESOLVE_SQL),
    "q_qc_resolve": (qc_resolve, QC_RESOLVE_SQL),
}
