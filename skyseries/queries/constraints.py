"""Audits of the given tables, with faults planted by rule."""

from pyspark.sql import functions as F

from skyseries.operators import integrity
from skyseries.queries.identity import LEVELED_SQL, leveled
from skyseries.queries.mapping import OBS_SQL, obs, on_the_hour, table


def audit_unique(spark, sf_dir):
    found = integrity.duplicate_keys(on_the_hour(obs(spark, sf_dir)), ["timeseries", "obstime"])
    return found.select("timeseries", "obstime", "n")


UNIQUE_SQL = f"""
with {OBS_SQL}
select timeseries, date_trunc('hour', obstime) as obstime, count(*) as n from obs group by 1, 2 having count(*) > 1"""


def audit_orphans(spark, sf_dir):
    """Orders of customers that a list of those in credit lacks."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return integrity.orphans(table(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey")


ORPHANS_SQL = """
select o_custkey, count(*) as n from orders
where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0) group by 1"""


def audit_nulls(spark, sf_dir):
    holes = obs(spark, sf_dir).select(
        F.when(F.col("seq") % 13 != 0, F.col("obstime")).alias("obstime"),
        F.when(F.col("seq") % 11 != 0, F.col("timeseries")).alias("timeseries"),
        "obsvalue",
    )
    return integrity.null_counts(holes, ["timeseries", "obstime", "obsvalue"])


NULLS_SQL = f"""
with {OBS_SQL},
counts as (select count(*) as n_rows, count(*) filter (seq % 11 = 0) as t, count(*) filter (seq % 13 = 0) as o,
                  count(*) filter (obsvalue is null) as v from obs)
select 'timeseries' as column_name, t as n_null, n_rows from counts
union all select 'obstime', o, n_rows from counts union all select 'obsvalue', v, n_rows from counts"""


def audit_labels(spark, sf_dir):
    """Label tuples that several series share when their level is left out."""
    series = leveled(spark, sf_dir).groupBy("station_id", "param_id", "type_id", "lvl", "sensor").agg(
        F.min("seq").alias("timeseries")
    )
    return integrity.ambiguous_labels(series, ["station_id", "param_id", "type_id", "sensor"])


LABELS_SQL = f"""
with {OBS_SQL}, {LEVELED_SQL},
series as (select station_id, param_id, type_id, lvl, sensor, min(seq) as timeseries from leveled group by 1, 2, 3, 4, 5)
select station_id, param_id, type_id, sensor, count(*) as n_series, min(timeseries) as first_timeseries
from series group by 1, 2, 3, 4 having count(*) > 1"""


def partition_bucket(spark, sf_dir):
    """Line items per storage range, their dates spread from 1935 to 2061 by decades."""
    decades = F.make_dt_interval((F.col("l_orderkey") % 13 - 6).cast("int") * 3650)
    moved = table(spark, sf_dir, "lineitem").select((F.col("l_shipdate") + decades).alias("obstime"))
    return integrity.bucket_counts(moved)


BUCKET_SQL = """
with moved as (select l_shipdate + to_days(cast((l_orderkey % 13 - 6) * 3650 as integer)) as t from lineitem)
select cast(case when year(t) < 1950 or year(t) >= 2030 then null when year(t) < 2000 then 1950 when year(t) < 2010 then 2000
       when year(t) < 2015 then 2010 else year(t) end as integer) as obs_bucket, count(*) as n from moved group by 1"""


QUERIES = {
    "q_audit_unique": (audit_unique, UNIQUE_SQL),
    "q_audit_orphans": (audit_orphans, ORPHANS_SQL),
    "q_audit_nulls": (audit_nulls, NULLS_SQL),
    "q_audit_labels": (audit_labels, LABELS_SQL),
    "q_partition_bucket": (partition_bucket, BUCKET_SQL),
}
