"""Stores over time: numbers of groups, key buckets, folds, newest values, versions of side tables, audits of a batch."""

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skyseries import schema
from skyseries.functions.times import obs_bucket, range_start, range_years
from skyseries.operators import access, documents, registry, synth
from skyseries.operators.upsert import latest_wins
from skyseries.plans import audits, qc_ingest, read_api
from skyseries.plans import bulk_load as bulk
from skyseries.plans.bulk_load import audit_store, bulk_load
from skyseries.plans.ingest import ingest_batch
from skyseries.plans.qc_ingest import qc_batch
from skyseries.queries import synthetic
from skyseries.sources import messages as sources
from skyseries.sources import store as stores
from skyseries.sources.store import Store
from skyseries.streaming.jobs import Versions, ingest_stream
from tests.support import HOUR, NEW_YEAR, message, messages, rows, side_tables

VALUES = "timeseries bigint, obstime timestamp, obsvalue double"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store")


def write(store, batch, *values):
    """Values `(series, time, value)` as one batch."""
    df = store.spark.createDataFrame(list(values), VALUES).coalesce(1)
    store.write("data", df.withColumn("arrival", F.lit(batch)), batch)


def labels(spark, *ids, station=20001):
    rows = [(i, station, 501, f"P{i}", i, None, None, None, None, None, None, 0) for i in ids]
    return spark.createDataFrame(rows, schema.REGISTRY).drop("batch")


def files(df):
    return {f.split("/batch=", 1)[1] for f in df.inputFiles()}


def opened(df):
    """Files that a scan really lists, after pruning by partition."""
    scan = df._jdf.queryExecution().executedPlan()
    scan = scan if "FileSourceScan" in scan.getClass().getSimpleName() else scan.collectLeaves().head()
    return df.select(F.input_file_name().alias("f")).distinct().collect(), scan


def test_load_and_stream_keep_their_numbers(spark, store, tmp_path):
    values = spark.createDataFrame([(7, NEW_YEAR + i * HOUR, float(i)) for i in range(10)], VALUES)
    bulk_load(store, labels(spark, 7), values, batch=0)
    with pytest.raises(ValueError, match="written as load"):
        ingest_batch(store, messages(spark, message(20001, 501, ["TA"], NEW_YEAR, HOUR, 1, ["3"])), side_tables(spark), 0)
    assert store.values("data").count() == 10
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def run(number, value):
        (inbox / f"{number}.txt").write_text(message(20001, 501, ["TA"], NEW_YEAR + number * HOUR, HOUR, 1, [value]))
        stream = sources.stream_message_files(spark, str(inbox))
        ingest_stream(store, stream, lambda: side_tables(spark), checkpoint=f"{tmp_path}/progress").awaitTermination()

    run(1, "5")
    # A load in between does not move the numbers of a stream that goes on.
    bulk_load(store, labels(spark, 9), spark.createDataFrame([(9, NEW_YEAR, 1.0)], VALUES), batch=50)
    run(2, "6")
    assert sorted(store.batches("receipts")) == [1, 2] and sorted(store.batches("data")) == [0, 1, 2, 50]
    assert [r.timeseries for r in store.registry().orderBy("timeseries").collect()] == [7, 8, 9]
    assert store.values("data").where("timeseries = 7").count() == 10
    assert rows(store.values("data").where("timeseries = 8").select("obsvalue")) == [(5.0,), (6.0,)]
    # Another stream starts behind everything.
    assert store.stream_start("another", "observations") == 51 == store.stream_start("another", "observations")


def test_a_batch_of_one_series_opens_one_key_bucket(spark, store):
    many = [message(20000 + i, 501, ["TA", "CI"], NEW_YEAR, HOUR, 1) for i in range(1, 60)]
    side = side_tables(spark, station_permits=[(20000 + i, 1) for i in range(1, 60)])
    ingest_batch(store, messages(spark, *many), side, 0)
    assert store.registry().count() == 118 and store.top_id() == 118
    key = store.registry().where("station_id = 20007 and param_code = 'TA'")
    buckets = registry.buckets_of(key)
    assert len(buckets) == 1
    pruned = store.registry(buckets=buckets)
    found, scan = opened(pruned)
    assert {f.f.split("key_bucket=")[1].split("/")[0] for f in found} == {str(buckets[0])}
    assert "key_bucket" in str(scan.metadata().apply("PartitionFilters"))
    # What is read in that bucket is enough to know the series again, by both kinds of labels.
    ingest_batch(store, messages(spark, message(20007, 501, ["TA"], NEW_YEAR, HOUR, 2), first_seq=100), side, 1)
    assert store.registry().count() == 118
    assert store.labels_met(buckets).where("station_id = 20007").count() == 2


def test_new_ids_come_from_markers_alone(spark, store, monkeypatch):
    side = side_tables(spark)
    ingest_batch(store, messages(spark, message(20001, 501, ["TA"], NEW_YEAR, HOUR, 1)), side, 0)
    scans = []
    whole = Store.registry
    monkeypatch.setattr(Store, "registry", lambda self, before=None, buckets=None: scans.append(buckets) or whole(self, before, buckets))
    ingest_batch(store, messages(spark, message(20001, 501, ["CI"], NEW_YEAR, HOUR, 1), first_seq=9), side, 1)
    assert scans and all(b is not None for b in scans)
    assert sorted(r.timeseries for r in whole(store).collect()) == [1, 2]


def test_folding_leaves_months_of_one_batch_alone(spark, store):
    month = lambda m: datetime(2024, m, 5)
    write(store, 0, (1, month(1), 1.0), (1, month(2), 1.0), (2, month(2), 1.5))
    write(store, 1, (1, month(2), 2.0), (1, month(3), 2.0))
    write(store, 2, (1, month(3), 3.0), (3, month(4), 3.0))
    write(store, 3, (1, month(1), 4.0))
    before, answers = files(store.log("data")), rows(store.values("data"))
    assert store.fold_months("data", upto=1) == [202402]
    assert rows(store.values("data")) == answers
    after = files(store.log("data"))
    kept = {f for f in before if "obs_month=202402" not in f}
    assert kept <= after and not any(f.startswith("0/attempt=1/") and "obs_month=202402" in f for f in after)
    assert store.log("data").where("obs_month = 202402").count() == 2
    # Folded again: only the months that later batches touch; by default the newest batch stays as it is.
    assert store.fold_months("data") == [202403]
    assert rows(store.values("data")) == answers
    assert {f for f in files(store.log("data")) if "obs_month=202402" in f} == {f for f in after if "obs_month=202402" in f}
    assert store.fold_months("data") == []
    with pytest.raises(ValueError, match="folded"):
        write(store, 2, (1, month(3), 9.0))
    with pytest.raises(ValueError, match="folded"):
        store.log("data", before=1)
    write(store, 4, (1, month(2), 5.0))
    assert rows(store.values("data").where("timeseries = 1").orderBy("obstime").select("obsvalue")) == [(v,) for v in (3.0, 4.0, 5.0)]
    folded = store.compact_into(f"{store.root}-next")
    assert rows(folded.values("data")) == rows(store.values("data"))


def test_text_values_are_folded_too(spark, store):
    side = side_tables(spark)
    for batch, text in enumerate("abc"):
        ingest_batch(store, messages(spark, message(20001, 501, ["KLOBS"], NEW_YEAR, HOUR, 2, [text]), first_seq=batch), side, batch)
    assert store.fold_months("nonscalar_data") == [202401]
    assert rows(store.values("nonscalar_data").select("obsvalue")) == [("c",), ("c",)]


def test_newest_values_without_the_log(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "NEWEST_BATCHES", 3)
    days = [5, 20, 7, 20, 3, 28, 28, 1]
    for batch, day in enumerate(days):
        write(store, batch, (1, datetime(2024, 1, day), float(batch)), (2 + batch % 2, datetime(2024, 1, day), 0.5 * batch))
    store.write("registry", labels(spark, 1, 2, 3), 0)

    def both(since):
        answers = [rows(read_api.latest(store, since, from_log=log).drop("loc")) for log in (False, True)]
        assert answers[0] == answers[1]
        return answers[0]

    assert len(both(datetime(2024, 1, 2))) == 3 and both(datetime(2024, 1, 29)) == []
    # The newest of all is written again: later in the same place, earlier in another.
    write(store, 6, (1, datetime(2024, 1, 28), 60.0))
    assert (1, 20001, 1, 60.0, datetime(2024, 1, 28), ) == both(datetime(2024, 1, 2))[0][:5]
    write(store, 5, (1, datetime(2024, 1, 2), 50.0))
    both(datetime(2024, 1, 1))
    write(store, 8, (1, datetime(2024, 1, 28), None))
    assert both(datetime(2024, 1, 2))[0][3] is None
    read = read_api.latest(store, datetime(2024, 1, 2)).inputFiles()
    assert read and not any("/data/" in f for f in read)
    # Merged sets stand in for the batches below them.
    base, after = store._newest_state()
    assert base and len(after) < len(days)
    assert store.newest().count() < store.log("data").count()


def test_slices_far_apart_open_their_months_only(spark, store):
    for batch, year in enumerate((1951, 1970, 1990, 2010, 2029)):
        write(store, batch, *[(1, datetime(year, m, 1), float(year)) for m in range(1, 13)])
    store.write("registry", labels(spark, 1), 0)
    wanted = spark.createDataFrame([(datetime(1951, 3, 1), 1), (datetime(2029, 5, 1), 1), (datetime(1700, 1, 1), 1)], "ts timestamp, param_id int")
    found = read_api.timeslices(store, wanted)
    assert sorted(r.obsvalue for r in found.collect()) == [1951.0, 2029.0]
    log = store.value_log("data", months=[195103, 202905])
    names, scan = opened(log)
    assert {n.f.split("obs_month=")[1][:6] for n in names} == {"195103", "202905"}
    assert len(names) == 2 and "obs_month" in str(scan.metadata().apply("PartitionFilters"))
    assert read_api.timeslices(store, wanted.limit(0)).count() == 0


def test_wide_payloads_are_fetched_once(spark, capsys):
    writes = spark.createDataFrame(
        [(1, 1, 5, "a", None), (1, 2, 4, "b", 2.0), (1, 2, 6, None, 3.0), (2, 1, 1, "x", 1.0), (None, 1, 1, "n", 1.0), (None, 3, 1, "m", None)],
        "k int, high bigint, low bigint, text string, number double",
    )
    for order in (["high", "low"], F.col("high") * 100 + F.col("low")):
        last = latest_wins(writes, ["k"], order, ["text", "number"])
        assert sorted(map(tuple, last.collect()), key=repr) == [(1, None, 3.0), (2, "x", 1.0), (None, "m", None)]
        last.explain()
        assert "SortAggregate" not in capsys.readouterr().out
    # Of ties one row comes back, always the same, and equal rows are one.
    tied = writes.withColumns({"high": F.lit(1), "low": F.lit(1)})
    one = [sorted(map(tuple, latest_wins(tied.repartition(n), ["k"], ["high"], ["text"]).collect()), key=repr) for n in (1, 3)]
    assert one[0] == one[1] and [k for k, _ in one[0]] == [1, 2, None]
    assert latest_wins(tied.unionByName(tied), ["k"], ["high", "low"], ["text"]).count() == 3


def test_a_batch_that_runs_again_sees_the_permits_of_its_arrival(spark, store):
    now, opens = [0.0], [1]

    def load():
        return side_tables(spark, station_permits=[(20001, opens[0])])

    versions = Versions(store.root, load, minutes=30, clock=lambda: now[0])
    is_open = lambda batch, v=versions: v.of_batch(store, batch).station_permits.first().permit_id
    assert is_open(0) == 1
    opens[0], now[0] = 0, 60.0
    assert is_open(1) == 1
    now[0] = 1900.0
    assert [is_open(b) for b in (2, 1, 0, 2)] == [0, 1, 1, 0]
    opens[0] = 1
    # A process that starts anew loads anew, but not for a batch that has arrived already.
    restarted = Versions(store.root, load, minutes=30, clock=lambda: now[0])
    assert is_open(2, restarted) == 0 and is_open(3, restarted) == 1 and is_open(2, versions) == 0


def test_as_of_permits(spark):
    observed = spark.createDataFrame([(1, 5, 2, a) for a in (0, 9, 10, 19, 20)] + [(3, 5, 2, 25)], "station_id int, type_id int, param_id int, at bigint")
    param = spark.createDataFrame([(1, 0, 0, 1, 0, 0), (1, 0, 0, 0, 0, 1), (3, 5, 2, 1, 0, 1)], f"{schema.PARAM_PERMITS}, version int")
    station = spark.createDataFrame([(1, 1, 1), (3, 1, 0)], f"{schema.STATION_PERMITS}, version int")
    found = access.open_as_of(observed, "at", [9, 20], param, station)
    assert rows(found.select("station_id", "at", "is_open")) == [(1, 0, False), (1, 9, True), (1, 10, True), (1, 19, True), (1, 20, False), (3, 25, True)]


def test_changes_of_batches_add_up_to_the_audit(spark, store):
    day = lambda d: datetime(2024, 2, d)
    batches = [
        ([1, 2], [(1, day(1), 1.0), (4, day(1), 1.0), (None, day(2), 0.0), (1, datetime(1949, 1, 1), 1.0)]),
        ([3, 5], [(1, day(1), 2.0), (2, day(1), 1.0), (4, day(9), 1.0), (6, datetime(2024, 5, 1), 1.0)]),
        ([4], [(1, day(1), 3.0), (2, day(1), 3.0), (6, datetime(2023, 1, 1), 2.0), (8, None, 2.0)]),
    ]
    changes = []
    for batch, (ids, values) in enumerate(batches):
        # Two series of one label tuple are ambiguous.
        own = labels(spark, *ids).withColumns({"param_id": F.lit(1), "station_id": F.when(F.col("timeseries") < 4, 1).otherwise(F.col("timeseries")).cast("int")})
        bulk_load(store, own, spark.createDataFrame(values, VALUES), batch)
        changes.append(audits.audit_batch(store, batch))
        whole = {r.audit: r.n for r in audit_store(store).collect()}
        assert {r.audit: r.n for r in audits.added(*changes).collect()} == whole
    assert whole["duplicate_key"] == 2 and whole["orphan_series"] == 1 and whole["ambiguous_label"] == 1 and whole["rejected"] == 2


def test_an_audit_reads_only_the_months_of_its_batch(spark, store):
    write(store, 0, *[(1, datetime(2024, m, 1), 1.0) for m in range(1, 13)])
    write(store, 1, (1, datetime(2024, 7, 1), 2.0))
    assert store.months_of("data", 1) == [202407]
    names, _ = opened(store.value_log("data", months=store.months_of("data", 1)))
    assert len(names) == 2


def test_ranges_are_data(spark, tmp_path):
    years = spark.createDataFrame([(2010,), (1990,), (2005,), (2005,), (None,), (2030,)], "year int")
    assert range_years(years) == [1990, 2005, 2010, 2030]
    with pytest.raises(ValueError):
        range_years(years.where("year = 1990"))
    starts = [3, 5, 8, 13, 21]
    found = spark.range(0, 30).select("id", range_start(F.col("id"), starts).alias("s")).collect()
    assert all(r.s == max((s for s in starts if s <= r.id), default=None) for r in found)
    times = spark.createDataFrame([(datetime(y, 6, 1),) for y in (1989, 1990, 2004, 2005, 2029, 2030)], "t timestamp")
    assert [r[0] for r in times.select(obs_bucket(F.col("t"), range_years(years))).collect()] == [None, 1990, 1990, 2005, 2010, None]
    # A store keeps its ranges, and takes others by compaction.
    store = Store(spark, f"{tmp_path}/own", ranges=[1900, 1950, 2100])
    write(store, 0, (1, datetime(1910, 1, 1), 1.0), (1, datetime(2050, 1, 1), 2.0))
    again = Store(spark, f"{tmp_path}/own")
    assert again.ranges == [1900, 1950, 2100] and again.log("data").select("obs_bucket").distinct().count() == 2
    late = datetime(2049, 1, 1, tzinfo=timezone.utc)
    assert again.values("data", late).count() == 1
    write(again, 1, (2, datetime(2050, 1, 1), 2.0))
    for upto in (0, 1):
        split = again.compact_into(f"{tmp_path}/split{upto}", upto=upto, ranges=[1900, 2000, 2040, 2060])
        assert sorted(r.obs_bucket for r in split.log("data").collect()) == [1900, 2040, 2040] and split.values("data", late).count() == 2


def test_a_load_makes_its_values_once(spark, store):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    times = [NEW_YEAR + i * HOUR for i in range(40)] + [NEW_YEAR, datetime(1949, 1, 1), datetime(1949, 1, 1), None]
    values = spark.createDataFrame([(i % 3, t, float(i)) for i, t in enumerate(times)], VALUES)
    stored = bulk_load(store, labels(spark, 0, 1, 2), values.mapInArrow(counted, VALUES), 0, partitions=5)
    assert made.value == len(times)
    assert stored == {"stored": 40 + (40 % 3 != 0), "repeated": 0 if 40 % 3 else 1}
    assert store.log("rejects").count() == 3
    assert not [n for n in store._names("data/batch=0/attempt=1") if "HIVE" in n]
    assert store.newest().count() == 3


def test_answers_in_one_order(spark, tmp_path):
    newest = spark.createDataFrame([(i * 7919 % 1000, 5, i, 1.0 * i) for i in range(400)] + [(10**15, 5, 1, 9.0)], "timeseries bigint, station_id int, param_id int, obsvalue double")
    newest = newest.dropDuplicates(["timeseries"]).withColumn("station_id", (F.col("timeseries") % 99991).cast("int"))
    newest = newest.withColumns({"obstime": F.lit(NEW_YEAR), "loc": F.lit(None).cast(schema.LOCATION)})
    parts = documents.latest_documents(newest.repartition(5), part_rows=30).orderBy("part_no").collect()
    assert [p.part_no for p in parts] == list(range(len(parts))) and {p.n_parts for p in parts} == {len(parts)}
    together = [d.station_id for p in parts for d in p.data]
    assert together == [r.station_id for r in newest.orderBy("timeseries").collect()] and len(together) == newest.count()
    answers = documents.latest_json(documents.latest_documents(newest, part_rows=30))
    read_api.write_answers(answers.repartition(4), f"{tmp_path}/answers", order="part_no")
    lines = [line for file in sorted((tmp_path / "answers").glob("part-*")) for line in file.read_text().splitlines()]
    assert [f'"part":{i},' in line for i, line in enumerate(lines)] == [True] * len(parts)


def test_topic_records_are_numbered_by_arrival(spark):
    at = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    records = spark.createDataFrame([(0, 5, b"a", at(3)), (1, 900, b"b", at(1)), (0, 6, b"c", at(3)), (1, 901, b"d", at(9)), (0, 7, b"e", None)],
                                    "partition int, offset long, value binary, timestamp timestamp")
    found = sources.from_topic(records, n_partitions=2)
    assert [r.value for r in found.orderBy("message_seq").collect()] == ["e", "b", "a", "c", "d"]


def test_control_records_find_their_series_in_their_buckets(spark, store, monkeypatch):
    monkeypatch.setattr(qc_ingest, "FEW_SERIES", 0)
    side = side_tables(spark)
    ingest_batch(store, messages(spark, message(20001, 12, ["RR_1", "RR_1(2,3)"], NEW_YEAR, HOUR, 1)), side, 0)
    text = ('<?xml?><checked><station val="20001"><typeid val="12"><obstime val="2024-01-01 00:00:00"><tbtime val="">'
            '<sensor val="2"><level val="3"><kvdata paramid="106"><original>4</original></kvdata></level></sensor></tbtime></obstime></typeid></station></checked>')
    qc_batch(store, spark.createDataFrame([(0, text)], schema.QC_MESSAGES), 0)
    series = {(r.sensor, r.lvl): r.timeseries for r in store.registry().collect()}
    assert [r.timeseries for r in store.values("qc_flags").collect()] == [series[2, 3]]


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in blocks.mkString("\n").split("\n") if name.startswith("shuffle_")}


def test_a_load_in_rounds_stores_the_same_and_leaves_no_shuffle_files(spark, tmp_path):
    given = [(k, t, float(i)) for i in range(3) for k in (None, *range(1, 9)) for t in (
        datetime(1949, 12, 31), datetime(1960, 5, 1, i), datetime(2024, 1, 1), datetime(2031, 1, 1), None
    )]
    values = spark.createDataFrame(given, VALUES).repartition(3)
    found = []
    for rounds in (1, 3):
        store, before = Store(spark, f"{tmp_path}/{rounds}"), shuffle_files(spark)
        counts = bulk_load(store, labels(spark, *range(1, 9)), values, 0, rounds=rounds)
        for _ in range(100):  # files are deleted in the background
            left = shuffle_files(spark) - before
            if not left:
                break
            time.sleep(0.1)
        assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
        refused = rows(store.log("rejects").select("code", "detail"))
        found.append((counts, sorted(rows(store.log("data")), key=str), refused, sorted(rows(store.newest()), key=str)))
    assert found[0] == found[1] and found[0][0] == {"stored": 36, "repeated": 18} and len(found[0][2]) == 81


def test_the_synthetic_load_goes_by_rounds_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(synthetic, "MEAN_LENGTH", 100)
    ids = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "c_custkey long")
    ids.write.parquet(f"{tmp_path}/customer.parquet")
    specs = synthetic.specs(spark, str(tmp_path))
    n = specs.agg(F.sum(synth.n_values())).first()[0]
    assert n == synth.observations(specs).count()
    once = rows(synthetic.bulk_load_buckets(spark, str(tmp_path)))
    made = []
    monkeypatch.setattr(bulk, "ROUND_VALUES", n // 3 + 1)
    monkeypatch.setattr(Store, "_put", lambda self, *args, put=Store._put, **more: (made.append((args[0], more)), put(self, *args, **more))[1])
    again = synthetic.bulk_load_buckets(spark, str(tmp_path))
    assert rows(again) == once
    assert [m for t, m in made if t == "data"] == [{}, {"more": True}, {"more": True}]
    # Stored values are summed up before they meet their labels.
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("count(1)")
