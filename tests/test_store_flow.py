"""Messages in, answers out, on a store in a scratch folder."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skyseries import schema
from skyseries.operators import documents
from skyseries.plans import read_api
from skyseries.plans.bulk_load import audit_store, bulk_load
from skyseries.plans.ingest import ingest_batch, with_param_ids
from skyseries.plans.qc_ingest import qc_batch
from skyseries.queries.writes import stored
from skyseries.sources.store import Store
from tests.support import HOUR, MINUTE, NEW_YEAR, PARAM_IDS, STATION_PERMITS, message, messages, rows, side_tables


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


def ingest(store, *texts, batch=0, stations=(), **kwargs):
    side = side_tables(store.spark, station_permits=[*STATION_PERMITS, *((s, 1) for s in stations)])
    ingest_batch(store, messages(store.spark, *texts, first_seq=batch * 100), side, batch, **kwargs)


def receipts(store):
    return rows(store.log("receipts").select("message_seq", "message", "message_id", "res", "retry"))


NOW = datetime.now(timezone.utc).replace(second=0, microsecond=0)
THIS_HOUR = NOW.replace(minute=0, tzinfo=None)
# Scenario name to (station, columns, texts); all in one store, each with stations of its own.
REGULAR = {
    "numbers": (30001, ["TA", "TGX"], ["0", "0"]),
    "sensor and level": (30002, ["TA(1,1)", "TGX"], ["0", "0"]),
    "number and text": (30003, ["KLOBS", "TA"], ["test", "0"]),
}
AT = NEW_YEAR + HOUR


@pytest.fixture(scope="module")
def scenarios(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("scenarios")))
    ingest(
        store,
        message(20001, 501, ["TGM", "TGX"], NEW_YEAR, HOUR, 48),
        *[message(station, 501, columns, THIS_HOUR - 11 * HOUR, HOUR, 12, texts) for station, columns, texts in REGULAR.values()],
        message(40001, 508, ["TA", "TGX"], NOW.replace(tzinfo=None) - 3 * HOUR, MINUTE, 180),
        message(40002, 508, ["TA", "TGX"], datetime(2020, 1, 1), MINUTE, 180),
        message(50001, 501, ["IR"], AT - HOUR, HOUR, 2),
        message(50002, 508, ["IR"], AT - HOUR, MINUTE, 120),
        message(60001, 501, ["CI"], NEW_YEAR, HOUR, 100),
        stations=[30001, 30002, 30003, 40001, 40002, 50001, 50002, 60001],
    )
    return store


def test_every_message_is_answered(scenarios):
    assert receipts(scenarios) == [(i, "", 23, 0, False) for i in range(9)]


@pytest.mark.parametrize("code", ["TGM", "TGX"])
def test_irregular_series(scenarios, code):
    _, values = read_api.series(scenarios, 20001, PARAM_IDS[code])
    assert rows(values.select("obstime")) == [(NEW_YEAR + i * HOUR,) for i in range(48)]


@pytest.mark.parametrize("name", REGULAR)
def test_regular_series(scenarios, name):
    station, columns, _ = REGULAR[name]
    for column in columns:
        code = column.split("(")[0]
        ranges, slots = read_api.series(scenarios, station, PARAM_IDS[code], resolution="PT1H", now=NOW)
        got = rows(slots.select("slot", "obsvalue"))
        start = THIS_HOUR - 11 * HOUR
        assert [t for t, _ in got] == [start + i * HOUR for i in range(12)]
        assert [v for _, v in got] == ([None] * 12 if code == "KLOBS" else [0.0] * 12)
        _, values = read_api.series(scenarios, station, PARAM_IDS[code], now=NOW)
        document = json.loads(documents.series_json(documents.regular_documents(values, ranges, "PT1H")).first().json)
        (answer,) = document["tseries"]
        assert list(answer) == ["regularity", "data", "header", "start_time", "time_resolution"]
        assert answer["regularity"] == "Regular" and answer["time_resolution"] == "PT1H"
        assert len(answer["data"]) == 12 and answer["start_time"] == f"{start:%Y-%m-%dT%H:%M:%S}Z"
        expected_ids = (1, 1) if "(" in column else (None, None)
        assert (answer["header"]["sensor"], answer["header"]["lvl"]) == expected_ids


def test_regular_documents_of_empty_and_nameless_ranges(spark):
    day = [NEW_YEAR + i * 24 * HOUR for i in range(5)]
    ranges = [(1, day[0], day[4]), (2, day[3], day[1]), (None, day[0], day[2]), (3, None, None), (4, day[0], day[0])]
    heads = spark.createDataFrame(ranges, "timeseries bigint, first timestamp, last timestamp").selectExpr(
        "*", "first as fromtime", "last as totime", "timeseries as station_id", "1 as param_id", "null as lvl", "null as sensor", "null as loc",
    )
    values = spark.createDataFrame([(1, day[3], 4.0), (1, day[0], 1.0), (None, day[0], 9.0), (2, day[3], 9.0)], "timeseries bigint, obstime timestamp, obsvalue double")
    found = documents.regular_documents(values, heads, "P1D", part_rows=2)
    # Filled arrays are joined to nothing: values meet their ranges, then their blocks.
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("Join" in line for line in plan.splitlines()) == 2
    got = {(r.timeseries, r.part_no): (r.n_parts, r.data, r.start_time) for r in found.collect()}
    assert got == {
        (1, 0): (3, [1.0, None], "2024-01-01T00:00:00Z"), (1, 1): (3, [None, 4.0], "2024-01-03T00:00:00Z"),
        (1, 2): (3, [None], "2024-01-05T00:00:00Z"), (2, 0): (1, [], "2024-01-04T00:00:00Z"),
        (None, 0): (2, [], "2024-01-01T00:00:00Z"), (3, 0): (1, [], None), (4, 0): (1, [None], "2024-01-01T00:00:00Z"),
    }


@pytest.mark.parametrize("station, param", [(99999, 211), (20001, 999)])
def test_unknown_series_is_an_error(scenarios, station, param):
    with pytest.raises(ValueError):
        read_api.series(scenarios, station, param)


@pytest.mark.parametrize("newer_than, expected", [(None, 2), (datetime(2021, 1, 1), 2), (datetime(2019, 1, 1), 4)])
def test_latest(scenarios, newer_than, expected):
    newest = read_api.latest(scenarios, newer_than, now=NOW).where("station_id in (40001, 40002)")
    got = newest.collect()
    assert len(got) == expected
    assert {r.obstime for r in got if r.station_id == 40001} == {NOW.replace(tzinfo=None) - MINUTE}
    answers = documents.latest_json(documents.latest_documents(newest)).collect()
    assert [len(json.loads(a.json)["data"]) for a in answers] == [expected]
    parts = documents.latest_documents(newest, part_rows=1).orderBy("part_no").collect()
    assert [(p.part_no, p.n_parts, len(p.data)) for p in parts] == [(i, expected, 1) for i in range(expected)]


def test_an_empty_latest_is_an_answer(scenarios):
    nothing = read_api.latest(scenarios, datetime(2029, 1, 1))
    (answer,) = documents.latest_json(documents.latest_documents(nothing)).collect()
    assert json.loads(answer.json) == {"data": [], "part": 0, "parts": 1}


def test_timeslice(scenarios):
    one = read_api.timeslice(scenarios, AT, PARAM_IDS["IR"])
    assert sorted(r.station_id for r in one.collect()) == [50001, 50002]


def test_timeslices_in_bulk(scenarios, tmp_path):
    number = PARAM_IDS["IR"]
    wanted = scenarios.spark.createDataFrame([(AT, number), (AT + MINUTE, number), (AT, 999)], "ts timestamp, param_id int")
    bulk = read_api.timeslices(scenarios, wanted)
    assert rows(bulk.groupBy("ts", "param_id").count()) == [(AT, number, 2), (AT + MINUTE, number, 1)]
    by_join = read_api.timeslices(scenarios, wanted, sliced=True)
    assert rows(by_join.drop("loc")) == rows(bulk.drop("loc"))
    answers = documents.timeslice_json(documents.timeslice_documents(bulk, wanted))
    read_api.write_answers(answers, f"{tmp_path}/answers")
    texts = [json.loads(r.value) for r in scenarios.spark.read.text(f"{tmp_path}/answers").collect()]
    assert all((t["part"], t["parts"]) == (0, 1) for t in texts)
    first, empty, second = sorted((t["tslices"][0] for t in texts), key=lambda a: (a["timestamp"], a["param_id"]))
    assert empty == {"timestamp": "2024-01-01T01:00:00Z", "param_id": 999, "data": []}
    assert first["timestamp"] == "2024-01-01T01:00:00Z" and first["param_id"] == number
    assert [d["station_id"] for d in first["data"]] == [50001, 50002]
    assert second["data"] == [{"station_id": 50002, "value": 0.0, "loc": None}]


def test_irregular_document_parts_hold_everything(scenarios):
    ranges, values = read_api.series(scenarios, 60001, PARAM_IDS["CI"])
    (whole,) = documents.series_json(documents.irregular_documents(values, ranges)).collect()
    answer = json.loads(whole.json)["tseries"][0]
    assert list(answer) == ["regularity", "data", "header", "timestamps"]
    assert len(answer["data"]) == 100 and answer["timestamps"][1] == "2024-01-01T01:00:00Z"
    parts = documents.irregular_documents(values, ranges, part_rows=30).orderBy("part_no").collect()
    assert [len(p.data) for p in parts] == [48, 24, 24, 4]
    assert [t for p in parts for t in p.timestamps] == answer["timestamps"]


CHECKED_AT = datetime(2021, 3, 9, 18, 20)


def control(corrected, hours=(0,), param=PARAM_IDS["RR_1"]):
    """A document of one station with a record for each hour."""
    records = "".join(
        f'<obstime val="{CHECKED_AT + hour * HOUR:%Y-%m-%d %H:%M:%S}"><tbtime val="-"><sensor val="0"><level val="0">'
        f'<kvdata paramid="{param}"><original>{hour + 0.5}</original><corrected>{corrected}</corrected>'
        f"<controlinfo>c{hour}</controlinfo><useinfo>u</useinfo><cfailed>{hour}</cfailed></kvdata></level></sensor></tbtime></obstime>"
        for hour in hours
    )
    return f'<?xml version="1.0"?>\n<checked><station val="20001"><typeid val="12">{records}</typeid></station></checked>'


def checked_series(first=CHECKED_AT - HOUR, n=6):
    return message(20001, 12, ["RR_1"], first, HOUR, n)


def qc_messages(store, *texts, first_seq=0):
    return store.spark.createDataFrame([(first_seq + i, t) for i, t in enumerate(texts)], schema.QC_MESSAGES)


def flags(store):
    return rows(store.values("qc_flags").drop("timeseries"))


def test_quality_control_record(store):
    ingest(store, checked_series())
    qc_batch(store, qc_messages(store, control(2, hours=(0, 1))), 0)
    expected = [(CHECKED_AT + h * HOUR, h + 0.5, 2.0, f"c{h}", "u", h) for h in (0, 1)]
    assert flags(store) == expected
    # The whole row is overwritten, also by NULL.
    qc_batch(store, qc_messages(store, control("", hours=(1,)), first_seq=1), 1)
    assert flags(store) == [expected[0], (*expected[1][:2], None, *expected[1][3:])]


def test_quality_control_record_waits_for_its_series(store):
    qc_batch(store, qc_messages(store, control(2), "no xml"), 0)
    assert flags(store) == [] and store.log("quarantine").count() == 1
    assert [r.code for r in store.log("qc_rejects").collect()] == ["NO_XML"]
    # Batches without messages neither find it nor write it again.
    for batch in (1, 2, 3):
        qc_batch(store, qc_messages(store), batch)
    assert flags(store) == [] and store.log("quarantine").count() == 1
    ingest(store, checked_series())
    qc_batch(store, qc_messages(store), 4)
    assert len(flags(store)) == 1 and store.waiting(store.seen_registry()).count() == 0
    qc_batch(store, qc_messages(store), 5)
    assert store.log("qc_flags").count() == 1
    qc_batch(store, qc_messages(store, control(3, param=PARAM_IDS["TGX"]), first_seq=3), 6, retry=False)
    assert store.waiting(store.seen_registry()).count() == 0


def test_a_record_that_waited_does_not_overwrite_a_later_one(store):
    """One series gets its flag from batch 1; the record of batch 0, resolved in batch 2, is the older one."""
    qc_batch(store, qc_messages(store, control(2), first_seq=9), 0)
    qc_batch(store, qc_messages(store, control(7), first_seq=1), 1)
    ingest(store, checked_series())
    qc_batch(store, qc_messages(store), 2)
    assert [f[2] for f in flags(store)] == [7.0]


def test_records_of_closed_series_leave(store):
    side = side_tables(store.spark, station_permits=[(20001, 0)])
    qc_batch(store, qc_messages(store, control(2, hours=(0, 1))), 0, side)
    assert store.log("quarantine").count() == 0
    assert [(r.code, r.detail) for r in store.log("qc_rejects").collect()] == [("CLOSED_SERIES", "20001/12/106")] * 2


def snapshot(store):
    return {
        "registry": rows(store.registry().drop("loc", "batch")),
        "data": rows(store.values("data")),
        "text": rows(store.values("nonscalar_data")),
        "receipts": receipts(store),
        "rejects": rows(store.log("rejects").drop("batch")),
    }


def three_batches(store, **kwargs):
    ingest(store, message(20001, 501, ["TA", "KLOBS(1,2)"], NEW_YEAR, HOUR, 4, ["1.5", "a"]),
           message(20000, 501, ["TA"], NEW_YEAR, HOUR, 4), "broken", batch=0, **kwargs)
    ingest(store, message(20001, 501, ["TA", "TGX"], NEW_YEAR + 2 * HOUR, HOUR, 4, ["2.5", "nan"]), batch=1, **kwargs)
    last_batch(store, **kwargs)


def last_batch(store, **kwargs):
    ingest(store, message(20001, 501, ["TA"], datetime(1949, 12, 31, 23), HOUR, 2, ["7"]),
           message(20002, 501, ["TA"], NEW_YEAR - HOUR, HOUR, 2, ["8"]), batch=2, **kwargs)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Three batches; read by the tests below, never written."""
    store = Store(spark, str(tmp_path_factory.mktemp("written")))
    three_batches(store)
    return store


def test_batches_overwrite_register_and_reject(written):
    got = snapshot(written)
    assert [r[0] for r in got["registry"]] == [1, 2, 3, 4]
    assert sorted((r[1], r[3]) for r in got["registry"]) == [
        (20001, "KLOBS"), (20001, "TA"), (20001, "TGX"), (20002, "TA")
    ]
    ta = written.registry().where("station_id = 20001 and param_code = 'TA'").first()
    # The first processed time, not the smallest.
    assert ta.fromtime == NEW_YEAR
    values = {r.obstime: r.obsvalue for r in written.values("data").where(F.col("timeseries") == ta.timeseries).collect()}
    assert values == {
        datetime(1950, 1, 1): 7.0, **{NEW_YEAR + i * HOUR: v for i, v in enumerate([1.5, 1.5, 2.5, 2.5, 2.5, 2.5])}
    }
    assert len(got["text"]) == 4
    assert [(r[0], r[1]) for r in got["rejects"]] == [(2, "NO_INDICATOR"), (200, "OUT_OF_RANGE")]
    assert [(r[0], r[3]) for r in got["receipts"]] == [(0, 0), (1, 0), (2, 1), (100, 0), (200, 1), (201, 0)]


def test_large_side_tables_and_repeated_batches_give_the_same(written, store):
    three_batches(store, sliced=True)
    # The last batch runs twice.
    last_batch(store)
    # As text, for not-a-number is unequal to itself.
    assert str(snapshot(store)) == str(snapshot(written))


def test_compaction_keeps_every_answer(written, tmp_path):
    folded = written.compact_into(f"{tmp_path}/folded", upto=2)
    before, after = snapshot(written), snapshot(folded)
    assert {t: str(rows) for t, rows in after.items()} == {t: str(rows) for t, rows in before.items()}
    # A folded store is written on, with ids after all that were given; what is folded is not written again.
    ingest(folded, message(20001, 501, ["TA", "RR_1"], NEW_YEAR, HOUR, 1, ["9", "4"]), batch=3)
    assert folded.values("data", NEW_YEAR, NEW_YEAR).where("obsvalue = 9").count() == 1
    assert sorted(r.timeseries for r in folded.registry().collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="folded"):
        ingest(folded, message(20001, 501, ["CI"], NEW_YEAR, HOUR, 1), batch=1)
    # Batches after the folded ones keep their numbers.
    part = written.compact_into(f"{tmp_path}/part", upto=0)
    assert sorted(part.batches("data")) == [0, 1, 2]
    assert {t: str(rows) for t, rows in snapshot(part).items()} == {t: str(rows) for t, rows in before.items()}


def test_compaction_keeps_what_waits(store, tmp_path):
    qc_batch(store, qc_messages(store, control(2)), 0)
    qc_batch(store, qc_messages(store, control(3, hours=(1,)), first_seq=5), 4)
    ingest(store, message(20001, 501, ["TA"], NEW_YEAR, HOUR, 1), batch=0)
    folded = store.compact_into(f"{tmp_path}/folded")
    assert folded.waiting(folded.seen_registry()).count() == 2 and sorted(folded.batches("qc_flags")) == [4]
    ingest(folded, checked_series(), batch=1)
    qc_batch(folded, qc_messages(folded), 5)
    again = folded.compact_into(f"{tmp_path}/again")
    assert [f[0] for f in flags(again)] == [CHECKED_AT, CHECKED_AT + HOUR]
    assert again.log("quarantine").count() == 0 and receipts(again) == receipts(folded)


def test_late_writes_win_by_arrival(store):
    """The later batch wins, though its message has the smaller number."""
    side = side_tables(store.spark)
    for batch, (number, value) in enumerate([(900, "1"), (3, "2")]):
        ingest_batch(store, messages(store.spark, message(20001, 501, ["TA", "KLOBS"], NEW_YEAR, HOUR, 1, [value, value]), first_seq=number), side, batch)
    assert [r.obsvalue for r in store.values("data").collect()] == [2.0]
    assert [r.obsvalue for r in store.values("nonscalar_data").collect()] == ["2"]


def test_a_batch_counts_as_a_whole(store, monkeypatch):
    three_batches(store)
    before = snapshot(store)
    whole = Store._put

    def failing(self, table, *rest):
        if table == "receipts":
            raise OSError("no space")
        whole(self, table, *rest)

    monkeypatch.setattr(Store, "_put", failing)
    for batch in (2, 3):
        with pytest.raises(OSError):
            ingest(store, message(20002, 501, ["CI"], NEW_YEAR, HOUR, 3, ["5"]), batch=batch)
        assert str(snapshot(store)) == str(before)


def test_reads_prune_year_ranges(written, capsys):
    start, end = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 2, tzinfo=timezone.utc)
    written.value_log("data", start, end).explain("formatted")
    plan = capsys.readouterr().out
    filters = plan.split("PartitionFilters:")[1].split("]")[0]
    assert "obs_bucket" in filters and "obs_month" in filters
    assert "GreaterThanOrEqual(obstime" in plan


def test_a_short_read_opens_the_files_of_its_month(store, tmp_path):
    for batch, month in enumerate((1, 2, 3)):
        ingest(store, message(20001, 501, ["TA"], datetime(2024, month, 1), timedelta(days=1), 28), batch=batch)
    hour = datetime(2024, 2, 10, tzinfo=timezone.utc)
    for one in (store, store.compact_into(f"{tmp_path}/folded")):
        assert len(one.log("data").inputFiles()) >= 3
        read = one.value_log("data", hour, hour + HOUR)
        opened = read.select(F.input_file_name().alias("f")).distinct().collect()
        assert len(opened) == 1 and "obs_month=202402" in opened[0].f
        # All that the scan selects, not only what has rows.
        scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
        listed = str(scan.metadata().apply("PartitionFilters"))
        assert "obs_month" in listed


def test_bulk_series_equal_single_series(written):
    now = (NEW_YEAR + 12 * HOUR).replace(tzinfo=timezone.utc)
    for resolution in (None, "PT1H"):
        ranges, bulk = read_api.series_bulk(written, resolution=resolution, now=now)
        bulk = bulk.join(ranges.select("timeseries", "station_id", "param_id"), "timeseries")
        for station, code in ((20001, "TA"), (20002, "TA"), (20001, "KLOBS")):
            _, one = read_api.series(written, station, PARAM_IDS[code], resolution=resolution, now=now)
            mine = bulk.where((F.col("station_id") == station) & (F.col("param_id") == PARAM_IDS[code]))
            assert rows(mine.select(*one.columns)) == rows(one)
    keys = written.spark.createDataFrame([(20002, 211)], "station_id int, param_id int")
    _, chosen = read_api.series_bulk(written, keys, start=NEW_YEAR, end=NEW_YEAR + timedelta(days=1), now=now)
    assert rows(chosen.select("obstime", "obsvalue")) == [(NEW_YEAR, 8.0)]


def test_zero_ids_match_quality_control_on_request(store):
    """`RR_1(0,0)` is sensor 0, level 0 unless asked otherwise; control records read 0 as "not given"."""
    text = message(20001, 12, ["RR_1(0,0)"], CHECKED_AT, HOUR, 1)
    ingest(store, text, batch=0)
    assert [(r.sensor, r.lvl) for r in store.registry().collect()] == [(0, 0)]
    ingest(store, text, batch=1, zero_ids_are_null=True)
    qc_batch(store, qc_messages(store, control(2)), 0)
    assert [r.timeseries for r in store.values("qc_flags").collect()] == [2]


def test_bulk_load_stores_or_refuses_every_value(store):
    times = [NEW_YEAR, NEW_YEAR, NEW_YEAR + HOUR, datetime(1949, 12, 31), datetime(2030, 1, 1), None]
    values = store.spark.createDataFrame([(1, t, float(i)) for i, t in enumerate(times)], "timeseries long, obstime timestamp, obsvalue double")
    registry = store.spark.createDataFrame([], schema.REGISTRY).drop("batch")
    assert bulk_load(store, registry, values, 0) == {"stored": 2, "repeated": 1}
    assert rows(store.values("data")) == [(1, NEW_YEAR, 1.0), (1, NEW_YEAR + HOUR, 2.0)]
    assert [r.code for r in store.log("rejects").collect()] == ["OUT_OF_RANGE"] * 3
    assert {r.audit: r.n for r in audit_store(store).collect()} == {
        "duplicate_key": 0, "null_key": 0, "uncovered_time": 0, "orphan_series": 1, "orphan_label": 0, "ambiguous_label": 0, "rejected": 3
    }


def test_values_stay_where_they_are_when_they_meet_a_small_catalogue(spark):
    rows_of_one = spark.range(800).repartition(8).select("id", F.lit("TA").alias("param_code"))
    params = spark.createDataFrame([(211, "TA"), (212, "TB")], "id int, param_code string")
    # One code: by a shuffle, one task would hold all of it and all groups made after it.
    assert "Exchange hashpartitioning(param_code" not in with_param_ids(rows_of_one, params, True)._jdf.queryExecution().toString()
    for few in (True, False):
        found = with_param_ids(rows_of_one, params, few)
        assert found.where("param_id = 211").count() == 800 and found.columns == ["id", "param_code", "param_id"]
    assert with_param_ids(rows_of_one, params, True).select(F.spark_partition_id().alias("p")).distinct().count() == 8
    assert with_param_ids(rows_of_one, params, True, sliced=True).count() == 800
    assert with_param_ids(rows_of_one, params.where("id = 212"), True).count() == 0


def test_nothing_is_broadcast_by_the_size_of_its_files(store, tmp_path, monkeypatch):
    seen, write_all = [], Store.write_all

    def watched(self, tables, batch):
        seen.append((sorted(tables)[0], store.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")))
        return write_all(self, tables, batch)

    monkeypatch.setattr(Store, "write_all", watched)
    ingest(store, message(20001, 501, ["TA", "KLOBS"], NEW_YEAR, HOUR, 3, ["1", "a"]))
    ingest(store, message(20001, 501, ["TA", "KLOBS"], NEW_YEAR + HOUR, HOUR, 3, ["2", "b"]), batch=1)
    qc_batch(store, store.spark.createDataFrame([], schema.QC_MESSAGES), batch=0)
    folded = store.compact_into(f"{tmp_path}/folded")
    assert [found for _, found in seen] == ["-1"] * 5
    for one in (store, folded):
        read = stored(one)
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
        assert [(r.obsvalue, r.obstext) for r in read.orderBy("obstime", "obstext").collect()] == [
            (1.0, None), (None, "a"), (2.0, None), (None, "b"), (2.0, None), (None, "b"), (2.0, None), (None, "b")
        ]
