"""Streams of message files: equal to a batch, restarted, and with side tables that change."""

from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException

from skyseries import schema
from skyseries.sources import messages as sources
from skyseries.sources.store import Store
from skyseries.streaming.jobs import Held, Refreshed, ingest_stream, qc_stream
from tests.support import HOUR, NEW_YEAR, message, rows, side_tables


def put(folder, number, text):
    folder.mkdir(exist_ok=True)
    (folder / f"message-{number}.txt").write_text(text, encoding="utf-8")


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    inbox, store = tmp_path / "inbox", Store(spark, f"{tmp_path}/store")

    def run():
        stream = sources.stream_message_files(spark, str(inbox), files_per_batch=10)
        ingest_stream(store, stream, lambda: side_tables(spark), checkpoint=f"{tmp_path}/progress").awaitTermination()

    put(inbox, 1, message(20001, 501, ["TA", "KLOBS"], NEW_YEAR, HOUR, 3, ["1", "a"]))
    put(inbox, 2, "no message")
    run()
    assert rows(store.values("data").select("obstime", "obsvalue")) == [(NEW_YEAR + i * HOUR, 1.0) for i in range(3)]
    # A late message overwrites; the older ones are not read again.
    put(inbox, 3, message(20001, 501, ["TA"], NEW_YEAR + HOUR, HOUR, 1, ["2"]))
    run()
    assert [r.obsvalue for r in store.values("data").orderBy("obstime").collect()] == [1.0, 2.0, 1.0]
    assert rows(store.log("receipts").select("message_seq", "res", "batch")) == [(1, 0, 0), (2, 1, 0), (3, 0, 1)]
    # The same messages in one batch.
    batch = sources.read_message_files(spark, str(inbox))
    assert sorted(r.message_seq for r in batch.collect()) == [1, 2, 3]

    control = tmp_path / "control"
    put(control, 1, '<?xml?><checked><station val="20001"><typeid val="501"><obstime val="2024-01-01 01:00:00"><tbtime val="">'
                    '<sensor val="0"><level val="0"><kvdata paramid="211"><original>2</original></kvdata></level></sensor>'
                    "</tbtime></obstime></typeid></station></checked>")
    flags = sources.stream_message_files(spark, str(control), "value")
    qc_stream(store, flags, checkpoint=f"{tmp_path}/flags").awaitTermination()
    assert [(r.obstime, r.original) for r in store.values("qc_flags").collect()] == [(datetime(2024, 1, 1, 1), 2.0)]


def test_failed_batch_runs_again_and_counts_once(spark, tmp_path, monkeypatch):
    inbox, store = tmp_path / "inbox", Store(spark, f"{tmp_path}/store")
    put(inbox, 1, message(20001, 501, ["TA", "CI"], NEW_YEAR, HOUR, 3, ["1", "2"]))

    def run():
        stream = sources.stream_message_files(spark, str(inbox))
        ingest_stream(store, stream, lambda: side_tables(spark), checkpoint=f"{tmp_path}/progress").awaitTermination()

    whole = Store._put

    def failing(self, table, *rest):
        if table == "receipts":
            raise OSError("no space")
        whole(self, table, *rest)

    monkeypatch.setattr(Store, "_put", failing)
    with pytest.raises(StreamingQueryException):
        run()
    # Series and values may be written already, but nothing counts without the answers.
    assert store.registry().count() == store.log("data").count() == store.log("receipts").count() == 0
    monkeypatch.setattr(Store, "_put", whole)
    run()
    assert rows(store.registry().select("timeseries")) == [(1,), (2,)]
    assert store.log("data").count() == 6 and store.values("data").count() == 6
    assert rows(store.log("receipts").select("message_seq", "res", "batch")) == [(1, 0, 0)]


def test_side_tables_are_read_again_when_old():
    time, loads = [0.0], []
    table = Refreshed(lambda: loads.append(time[0]) or len(loads), minutes=30, clock=lambda: time[0])
    seen = []
    for minute in (0, 10, 29.9, 30, 45, 61):
        time[0] = minute * 60
        seen.append(table.get())
    assert seen == [1, 1, 1, 2, 2, 3]


def test_side_tables_are_held_until_the_next_load(spark, tmp_path):
    """A snapshot: what changes at the source is seen by the next load and not before, and is read once per load."""
    def stored(permit):
        spark.createDataFrame([(20001, permit)], schema.STATION_PERMITS).write.mode("overwrite").parquet(f"{tmp_path}/permits")

    loads = []

    def load():
        loads.append(1)
        tables = side_tables(spark)
        tables.station_permits = spark.read.parquet(f"{tmp_path}/permits")
        return tables

    stored(1)
    held = Held(spark, load)
    first = held()
    stored(0)
    assert rows(first.station_permits) == [(20001, 1)] and rows(first.params)
    assert rows(held().station_permits) == [(20001, 0)] and len(loads) == 2


@pytest.mark.parametrize("checkpoint", [None, ""])
def test_a_stream_needs_its_progress(spark, tmp_path, checkpoint):
    """Without one, a second start would read anew and replace what is stored."""
    put(tmp_path / "inbox", 1, "x")
    stream = sources.stream_message_files(spark, str(tmp_path / "inbox"))
    store = Store(spark, f"{tmp_path}/store")
    with pytest.raises(ValueError, match="checkpoint"):
        ingest_stream(store, stream, lambda: side_tables(spark), checkpoint=checkpoint)
    with pytest.raises(ValueError, match="checkpoint"):
        qc_stream(store, stream, checkpoint=checkpoint)


def test_numbers_come_from_all_digits_or_the_time_of_change(spark, tmp_path):
    names = ["20240101_001.txt", "20240101_002.txt", "a-0007.txt", "plain.txt", "1" * 30 + ".txt"]
    for name in names:
        (tmp_path / name).write_text("x")
    found = sources.read_message_files(spark, str(tmp_path))
    numbers = sorted(r.message_seq for r in found.collect())
    assert numbers[:3] == [7, 20240101001, 20240101002] and numbers[3] > 10**15
    assert sources.repeated_messages(found.unionByName(found)).count() == len(set(numbers))
    assert sources.spread(found, 3).rdd.getNumPartitions() == 3


def test_topic_records_become_messages(spark):
    records = spark.createDataFrame(
        [(0, 0, b"a"), (1, 0, b"b"), (0, 1, "æ".encode()), (1, 1, b"\xff")], "partition int, offset long, value binary"
    )
    found = sources.from_topic(records, n_partitions=2)
    assert rows(found, "message_seq") == [(0, "a"), (1, "b"), (2, "æ"), (3, None)]
    options = sources.kafka_options(["one:9092", "two:9092"], "checked", (0, 1), 500)
    assert options["assign"] == '{"checked":[0,1]}' and options["startingOffsets"] == "earliest"
    assert options["kafka.bootstrap.servers"] == "one:9092,two:9092" and options["maxOffsetsPerTrigger"] == "500"


def test_stream_needs_no_watermark(spark, tmp_path):
    put(tmp_path / "inbox", 1, "x")
    stream = sources.stream_message_files(spark, str(tmp_path / "inbox"))
    assert stream.isStreaming and stream.columns == ["message_seq", "msg"]


@pytest.mark.parametrize("text", ["x,TA,air,t", "1,TA,air,yes", "1,,air,t"])
def test_malformed_catalogue_rows_abort(spark, tmp_path, text):
    from skyseries.sources.catalogue import code_sets, read_params

    (tmp_path / "params.csv").write_text(f"id,code,element,scalar\n1,TA,a,t\n2,KLOBS,b,f\n5,TA,last row wins,f\n{text}\n")
    with pytest.raises(Exception, match="bad catalogue row"):
        read_params(spark, str(tmp_path / "params.csv")).collect()
    with pytest.raises(Exception, match="bad catalogue row"):
        code_sets(read_params(spark, str(tmp_path / "params.csv")))


def test_catalogue_and_permit_files(spark, tmp_path):
    from skyseries.sources.catalogue import code_sets, read_params
    from skyseries.sources.permits import read_permits_parquet

    (tmp_path / "params.csv").write_text("a,b,c,d\n9,TA,first,t\n2,KLOBS,b,f\n5,TA,last row wins,f\n")
    params = read_params(spark, str(tmp_path / "params.csv"))
    assert rows(params, "id") == [(2, "KLOBS", "b", False), (5, "TA", "last row wins", False)]
    assert code_sets(params) == ([], ["KLOBS", "TA"]) and code_sets(params, limit=1) is None
    spark.createDataFrame([(1, 0, 2, 1)], "stationid int, message_formatid int, paramid int, permitid int").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(1, 1)], "stationid int, permitid int").write.parquet(f"{tmp_path}/s")
    by_param, by_station = read_permits_parquet(spark, f"{tmp_path}/p", f"{tmp_path}/s")
    assert rows(by_param) == [(1, 0, 2, 1, 0)] and rows(by_station) == [(1, 1)]
