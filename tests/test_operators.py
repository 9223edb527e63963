"""Operators against plain Python on small random data, with every size limit forced low as well."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyseries import schema, session
from skyseries.functions.times import BUCKET_YEARS, bucket_filter, obs_bucket, obs_month, rfc3339, utc_date
from skyseries.operators import access, grid, integrity, registry, skew, synth
from skyseries.operators.series import series_headers, with_range
from skyseries.operators.upsert import latest_wins, packed_order
from tests.support import PARAM_PERMITS, STATION_PERMITS, rows


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_spreads_heavy_keys(spark, how):
    draw = random.Random(how)
    facts = [(draw.choice([1, 1, 1, 1, 2, 3, None, 9]), i) for i in range(400)]
    lookup = {1: "a", 2: "b", None: "n", 5: "e"}
    expected = [
        (k, i, lookup.get(k)) for k, i in facts if how == "left" or (k in lookup) == (how != "left_anti")
    ]
    if how in ("left_semi", "left_anti"):
        expected = [row[:2] for row in expected]
    big = spark.createDataFrame(facts, "k int, i int")
    small = spark.createDataFrame(list(lookup.items()), "k int, name string")
    for sliced, rows_per_task in ((False, 10), (True, 10), (True, 10_000)):
        got = skew.lookup_join(big, small, ["k"], how, null_safe=["k"], sliced=sliced, rows_per_task=rows_per_task)
        assert Counter(tuple(r) for r in got.collect()) == Counter(expected)


def test_parts_are_bounded_and_complete(spark):
    draw = random.Random(3)
    data = [(draw.choice("aaab"), draw.randrange(60), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, block int, i int")
    parts = rows(skew.collect_parts(df, ["g"], "block", F.struct("block", "i"), 40))
    flat = [(g, p, b, i) for g, p, _, found in parts for b, i in found]
    for g in "ab":
        assert [p for h, p, _, _ in parts if h == g] == list(range(len([h for h, *_ in parts if h == g])))
        assert {n for h, _, n, _ in parts if h == g} == {len([h for h, *_ in parts if h == g])}
    assert sorted((g, b, i) for g, _, b, i in flat) == sorted(data)
    largest = max(Counter((g, b) for g, b, _ in data).values())
    sizes = Counter((g, p) for g, p, _, _ in flat)
    assert max(sizes.values()) < 40 + largest and len(sizes) > 2
    for g in "ab":
        whole = [(b, i) for h, _, b, i in flat if h == g]
        assert whole == sorted(whole)


STEPS = {"PT1M": 60, "PT1H": 3600, "P1D": 86400}


@pytest.mark.parametrize("name", STEPS)
def test_grid_against_plain_python(spark, name):
    draw, step = random.Random(name), timedelta(seconds=STEPS[name])
    bounds, values, expected = [], [], []
    for series in range(6):
        first = datetime(1969, 12, 30) + timedelta(seconds=draw.randrange(10**5)) + series * timedelta(days=9000)
        last = first + step * draw.randrange(3500) + timedelta(seconds=draw.randrange(STEPS[name])) if series else first - step
        bounds.append((series, first, last))
        stored = {}
        for _ in range(60):
            time = first + step * draw.randrange(-5, 3600) + draw.choice([timedelta(0), timedelta(seconds=7)])
            stored[time] = draw.choice([None, 1.5, 2.5])
        values += [(series, t, v) for t, v in stored.items()]
        slot, n = first, 0
        while slot <= last:
            expected.append((series, n, slot, stored.get(slot)))
            slot, n = slot + step, n + 1
    ranges = spark.createDataFrame(bounds, "timeseries long, first timestamp, last timestamp")
    data = spark.createDataFrame(values, "timeseries long, obstime timestamp, obsvalue double")
    for sliced in (False, True):
        got = grid.fill_grid(ranges, data, STEPS[name], ["timeseries"], sliced=sliced)
        assert rows(got, "timeseries", "slot_no") == expected
    bare = grid.grid_slots(ranges, STEPS[name], ["timeseries"])
    assert rows(bare, "timeseries", "slot_no") == [e[:3] for e in expected]


def is_open(param_permits, station_permits, station, type_id, param):
    """The rule in plain Python."""
    listed = sorted((p for p in param_permits if p[0] == station), key=lambda p: p[4])
    for _, t, p, permit, _ in listed:
        if t in (0, type_id) and p in (0, param):
            return permit == 1
    return dict(station_permits).get(station) == 1


def test_access_rule(spark):
    keys = spark.createDataFrame([(s, 0, 0) for s in (0, 10000, 10001, 20000)] + [(20001, 0, 1)], "station_id int, type_id int, param_id int")
    found = access.open_flags(
        keys, spark.createDataFrame(PARAM_PERMITS, schema.PARAM_PERMITS), spark.createDataFrame(STATION_PERMITS, schema.STATION_PERMITS)
    )
    assert {r.station_id: r.is_open for r in found.collect()} == {0: False, 10000: False, 10001: True, 20000: False, 20001: True}


def test_access_rule_against_plain_python(spark):
    draw = random.Random(5)
    permits = [(draw.randrange(6), draw.choice([0, 0, 1, 2]), draw.choice([0, 0, 1, 2]), draw.choice([0, 1, 1, 3]), i) for i in range(40)]
    stations = [(s, draw.choice([0, 1, 2])) for s in range(2, 9)]
    keys = [(s, t, p) for s in range(10) for t in range(4) for p in range(4)]
    tables = spark.createDataFrame(permits, schema.PARAM_PERMITS), spark.createDataFrame(stations, schema.STATION_PERMITS)
    df = spark.createDataFrame(keys, "station_id int, type_id int, param_id int")
    expected = {k: is_open(permits, stations, *k) for k in keys}
    for sliced in (False, True):
        assert {tuple(r)[:3]: r.is_open for r in access.open_flags(df, *tables, sliced=sliced).collect()} == expected
    kept = access.filter_open(df.withColumn("i", F.lit(1)), *tables)
    assert {tuple(r)[:3] for r in kept.collect()} == {k for k, v in expected.items() if v}


def test_ids_are_dense_and_repeatable(spark):
    observations = spark.range(3000).select(
        (F.col("id") % 50).cast("int").alias("station_id"), F.lit(501).alias("type_id"),
        F.concat(F.lit("P"), F.col("id") % 7).alias("param_code"), (F.col("id") % 7).cast("int").alias("param_id"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")).alias("lvl"), F.lit(None).cast("int").alias("sensor"),
        F.timestamp_seconds(F.col("id") * 60 % 997).alias("obstime"), F.col("id").alias("seq"),
    )
    first = registry.assign_ids(registry.distinct_series(observations.where("id % 50 < 20"), ["seq"]))
    n = first.count()
    again = registry.missing_series(registry.distinct_series(observations, ["seq"]), first)
    both = first.unionByName(registry.assign_ids(again, after=n))
    found = both.collect()
    assert sorted(r.timeseries for r in found) == list(range(1, 1051))
    assert len({(r.station_id, r.param_code, r.lvl) for r in found}) == 1050
    assert rows(both) == rows(first.unionByName(registry.assign_ids(again.repartition(13), after=n)))
    # Resolving gives each tuple its id, whatever the join.
    plain = {(r.station_id, r.param_code, r.lvl): r.timeseries for r in found}
    for sliced in (False, True):
        resolved = registry.resolve_series(observations, both, sliced=sliced).collect()
        assert len(resolved) == 3000
        assert all(r.timeseries == plain[r.station_id, r.param_code, r.lvl] for r in resolved)


def exploded_registry(spark):
    """A registry that the planner takes for a single small row, and one observation of it."""
    labels = spark.range(1).select(
        F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("station_id"), F.lit(501).alias("type_id"), F.lit("TA").alias("param_code"),
        F.lit(211).alias("param_id"), F.lit(None).cast("int").alias("lvl"), F.lit(None).cast("int").alias("sensor"),
    )
    return labels.withColumn("timeseries", F.col("station_id").cast("bigint") * 10), labels.where("station_id in (7, 2000)")


def last_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if "Join" in line)


@pytest.mark.parametrize("sliced", [False, True])
def test_control_records_meet_an_exploded_registry_by_shuffle(spark, sliced):
    labels, records = exploded_registry(spark)
    found = registry.resolve_met(records, labels, sliced)
    assert "SortMergeJoin" in last_join(found)
    assert sorted(r.timeseries for r in found.collect()) == [70, 20000]


@pytest.mark.parametrize("sliced", [False, True])
def test_observations_meet_an_exploded_registry_by_shuffle(spark, sliced):
    labels, observations = exploded_registry(spark)
    found = registry.resolve_series(observations, labels, sliced)
    assert "SortMergeJoin" in last_join(found)
    assert sorted(r.timeseries for r in found.collect()) == [70, 20000]


def test_dates_are_those_of_the_calendar(spark):
    edges = [datetime(y, m, d, *t) for y in (1899, 1950, 1969, 1970, 2000, 2024, 2100) for m, d, t in (
        (1, 1, ()), (2, 28, (23, 59, 59, 999999)), (3, 1, ()), (12, 31, ()), (12, 31, (23, 59, 59, 999999)))]
    df = spark.createDataFrame([(t,) for t in [*edges, None]], "t timestamp")
    assert [r[0] for r in df.select(utc_date(F.col("t"))).collect()] == [*[t.date() for t in edges], None]


def test_start_of_a_series_is_its_first_processed_time(spark):
    data = [(1, 501, "TA", 211, None, None, datetime(2024, 1, 2), 10), (1, 501, "TA", 211, None, None, datetime(2024, 1, 1), 11)]
    df = spark.createDataFrame(
        data, "station_id int, type_id int, param_code string, param_id int, lvl int, sensor int, obstime timestamp, seq int"
    )
    assert registry.distinct_series(df, ["seq"]).first().fromtime == datetime(2024, 1, 2)


def test_last_write_wins_as_a_whole_row(spark):
    writes = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 3, None, "c"), (1, 2, 6.0, None), (2, 1, 7.0, "d")], "k int, seq int, v double, t string")
    once = latest_wins(writes, ["k"], "seq", ["v", "t"])
    assert rows(once) == [(1, None, "c"), (2, 7.0, "d")]
    assert rows(latest_wins(writes, ["k"], "seq", ["v"])) == [(1, None), (2, 7.0)]
    assert rows(latest_wins(writes.union(writes), ["k"], ["k", "seq"], ["v", "t"])) == rows(once)


def test_packed_order_sorts_like_its_parts_and_aggregates_by_hash(spark, capsys):
    data = [(1, 2**62, 5, 7, 1.0), (1, 2**62, 6, 0, 2.0), (1, -3, 9, 9, 3.0), (2, 4, 0, 999_999_999, 4.0), (2, 4, 1, 0, None)]
    df = spark.createDataFrame(data, "k int, a long, b int, c int, v double")
    last = latest_wins(df, ["k"], packed_order(F.col("a"), F.col("b"), F.col("c")), ["v"])
    assert rows(last) == [(1, 2.0), (2, None)]
    last.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_equal_rows_of_a_heavy_key_part(spark):
    facts = spark.range(4000).select(F.lit(1).alias("k")).repartition(4)
    joined = skew.lookup_join(facts, spark.createDataFrame([(1, "a")], "k int, name string"), ["k"], sliced=True, rows_per_task=100)
    assert joined.count() == 4000
    heavy_keys = spark.range(30_000).select((F.col("id") % 1500).alias("k"))
    names = spark.range(1500).select(F.col("id").alias("k"), F.col("id").alias("name"))
    found = skew.lookup_join(heavy_keys, names, ["k"], sliced=True, rows_per_task=5)
    assert found.where("k = name").count() == 30_000


def test_headers_fill_missing_bounds(spark):
    series = spark.createDataFrame(
        [(2, None, None, None), (1, datetime(2024, 1, 1), None, None), (3, None, datetime(2024, 5, 1), None)],
        "id long, fromtime timestamp, totime timestamp, loc string",
    )
    labels = spark.createDataFrame([(1, 7, 211, 0, 0), (2, 7, 211, 1, 1), (3, 8, 211, None, None)],
                                   "timeseries long, station_id int, param_id int, lvl int, sensor int")
    now = datetime(2024, 6, 1)
    first = series_headers(series, labels, now)
    assert rows(first.select("timeseries", "fromtime", "totime")) == [
        (1, datetime(2024, 1, 1), now), (3, datetime(1950, 1, 1), datetime(2024, 5, 1))
    ]
    assert series_headers(series, labels, now, first_only=False).count() == 3
    ranged = with_range(first, start=datetime(2024, 2, 1))
    assert rows(ranged.select("first", "last")) == [(datetime(2024, 2, 1), datetime(2024, 5, 1)), (datetime(2024, 2, 1), now)]


def test_storage_ranges(spark):
    times = [datetime(y, 1, 1) for y in (1949, 1950, 1999, 2000, 2009, 2010, 2014, 2015, 2016, 2029, 2030)] + [datetime(1999, 12, 31, 23, 59, 59)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp").withColumn("obs_bucket", obs_bucket(F.col("t")))
    found = {r.t: r.obs_bucket for r in df.collect()}
    assert [found[t] for t in times] == [None, 1950, 1950, 2000, 2000, 2010, 2010, 2015, 2016, 2029, None, 1950]
    for start in (None, *times):
        for end in (None, *times):
            inside = (F.col("t") >= (start or datetime(1950, 1, 1))) & (F.col("t") <= (end or datetime(2030, 1, 1)))
            stored = df.where(F.col("obs_bucket").isNotNull())
            if start in times[::4] or end in times[::4]:
                assert stored.where(inside).where(~bucket_filter(start, end)).count() == 0


def test_time_text(spark):
    df = spark.sql("select explode(array(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:00.5', timestamp'1969-01-01 00:00:00.000001')) t")
    assert [r[0] for r in df.select(rfc3339(F.col("t"))).collect()] == [
        "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.500Z", "1969-01-01T00:00:00.000001Z"
    ]


def test_audits(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, t), (1, t), (2, t), (None, t), (3, None), (3, datetime(2031, 1, 1))], "timeseries long, obstime timestamp"
    )
    assert rows(integrity.value_faults(df, ["timeseries", "obstime"])) == [("duplicate_key", 1), ("null_key", 2), ("uncovered_time", 1)]
    known = spark.createDataFrame([(1,), (2,)], "id long")
    assert rows(integrity.orphans(df, "timeseries", known, "id")) == [(3, 2)]


def test_synthetic_series_look_as_asked(spark):
    specs = synth.series_specs(spark.range(20_000), mean_length=100).cache()
    kinds = {r.step: r["count"] for r in specs.groupBy("step").count().collect()}
    assert all(6200 < n < 7100 for n in kinds.values()) and len(kinds) == 3
    r = specs.where("step < 86400").selectExpr(
        "avg((unix_seconds(endtime) - unix_seconds(fromtime)) / step) AS length", "avg(2023.84 - year(endtime)) AS age", "min(fromtime) AS first"
    ).first()
    assert 95 < r.length < 105 and 3.8 < r.age < 4.9 and r.first >= datetime(1950, 1, 1)
    for column in ("station_id", "param_id", "type_id"):
        low, high, n = specs.agg(F.min(column), F.max(column), F.countDistinct(column)).first()
        assert (low, high, n) == (1000, 1999, 1000)
    observed = synth.observations(specs.where("id < 60"))
    expected = specs.where("id < 60 and fromtime <= endtime").selectExpr(
        "sum(1 + (unix_seconds(endtime) - unix_seconds(fromtime)) div step)"
    ).first()[0]
    assert observed.count() == expected == observed.select("timeseries", "obstime").distinct().count()
    assert {r.obsvalue for r in observed.select("obsvalue").distinct().collect()} == {i * 0.5 for i in range(30)}


def test_permits_of_many_stations_are_not_broadcast(spark):
    stations = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("station_id"))
    permits = stations.select("station_id", F.lit(0).alias("type_id"), F.lit(0).alias("param_id"), (F.col("station_id") % 2).alias("permit_id"), F.lit(0).alias("ord"))
    keys = stations.where("station_id in (7, 8, 3000)").select("station_id", F.lit(501).alias("type_id"), F.lit(211).alias("param_id"))
    found = access.open_flags(keys, permits.where("station_id < 100"), stations.withColumn("permit_id", F.lit(1)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Both kinds are joined by shuffle, though the planner takes them for a single row.
    assert plan.count("SortMergeJoin") == 2
    assert sorted((r.station_id, r.is_open) for r in found.collect()) == [(7, True), (8, False), (3000, True)]


def test_last_writes_of_texts_are_not_broadcast(spark, tmp_path):
    writes = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (1, 2, "b"), (None, 1, "d")], "k int, seq int, t string")
    writes.write.parquet(f"{tmp_path}/writes")
    last = latest_wins(spark.read.parquet(f"{tmp_path}/writes"), ["k"], "seq", ["t"])
    assert "SortMergeJoin" in last_join(last)
    assert sorted(rows(last), key=repr) == [(1, None), (None, "d")]


def test_only_measured_sizes_are_broadcast(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/ids")
    ids, key = spark.read.parquet(f"{tmp_path}/ids"), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    assert "BroadcastHashJoin" in last_join(ids.join(ids.withColumnRenamed("id", "other"), F.col("id") == F.col("other")))
    with session.broadcasts_measured(spark), session.broadcasts_measured(spark):
        joined = ids.join(ids.withColumnRenamed("id", "other"), F.col("id") == F.col("other"))
        assert "SortMergeJoin" in last_join(joined)
        # What turns out small while the query runs is broadcast all the same.
        assert joined.count() == 5 and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == before
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def test_storage_ranges_are_found_without_the_calendar(spark):
    ends = [datetime(y, 1, 1) + timedelta(microseconds=d) for y in (1950, 2000, 2019, 2029, 2030) for d in (-1, 0)]
    df = spark.createDataFrame([(t,) for t in [*ends, None]], "t timestamp")
    for kind in ("timestamp", "timestamp_ntz", "date"):
        placed = df.select(F.col("t").cast(kind).alias("t")).select(F.year("t").alias("year"), obs_bucket(F.col("t")).alias("b"), obs_month(F.col("t")).alias("m"))
        for year, bucket, month in placed.collect():
            inside = year is not None and 1950 <= year < 2030
            assert bucket == (max(y for y in BUCKET_YEARS if y <= year) if inside else None)
            assert month is None if not inside else month // 100 == year and month % 100 in (1, 12)
    # A load asks it of very many values.
    assert "year(" not in df.select(obs_bucket(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
