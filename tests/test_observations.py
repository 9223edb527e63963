"""Decoding of observation messages, by code lists in the query and by join with the catalogue."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skyseries import schema
from skyseries.functions.times import compact_time, dashed_time
from skyseries.operators import observations
from skyseries.sources.catalogue import code_sets
from tests.support import PARAMS, messages, rows

HEAD = "kldata/nationalnr=7042/type=330/messageid=812\n"
T, T0 = "20190817153000", datetime(2019, 8, 17, 15, 30)

# Message, fault code or None, text of the fault or the id of the message.
OUTCOMES = [
    # headers: what has to be there, in any order, and what may be
    ("weather/nationalnr=7042/type=330\nTGM\n" + T + ",4", "NO_INDICATOR", "kldata indicator missing or out of order"),
    ("nationalnr=7042/kldata/type=330\nTGM\n" + T + ",4", "NO_INDICATOR", "kldata indicator missing or out of order"),
    ("kldata/type=61/nationalnr=4410\nTGM\n" + T + ",4", None, 0),
    ("kldata/nationalnr=4410/messageid=77/type=61\nTGM\n" + T + ",4", None, 77),
    ("kldata/add/type=61/messageid=78/nationalnr=4410\nTGM\n" + T + ",4", None, 78),
    ('kldata/type=61/nationalnr=4410/received_time="1999-12-31 at noon"\nTGM\n' + T + ",4", None, 0),
    ("kldata/type=61/sent/nationalnr=4410\nTGM", "UNEXPECTED_FIELD", "unexpected field in kldata header format: sent"),
    ("kldata/type=61/nationalnr=4410/height=12\nTGM", "UNEXPECTED_FIELD", "unexpected field in kldata header format: height=12"),
    ("kldata/type=61", "MISSING_STATION", "missing field `nationalnr` in kldata header"),
    ("kldata/nationalnr=4410", "MISSING_TYPE", "missing field `type` in kldata header"),
    ("kldata/add", "MISSING_STATION", "missing field `nationalnr` in kldata header"),
    ("kldata/nationalnr=8/type=9/messageid=-4\nTGM", "BAD_HEADER_VALUE", "invalid value -4 in kldata header for key messageid"),
    ("kldata/nationalnr=3000000000/type=9\nTGM", "BAD_HEADER_VALUE", "invalid value 3000000000 in kldata header for key nationalnr"),
    ("kldata/nationalnr=8/type=9 \nTGM", "BAD_HEADER_VALUE", "invalid value 9  in kldata header for key type"),
    ("kldata/nationalnr=/type=west\nTGM", "BAD_HEADER_VALUE", "invalid value  in kldata header for key nationalnr"),
    ("kldata/nationalnr=8/type=4/type=+9/messageid=6/messageid=0000000000000000000031\nTGM\n" + T + ",4", None, 31),
    # the first fault in reading order counts
    ("kldata/north/type=south", "UNEXPECTED_FIELD", "unexpected field in kldata header format: north"),
    ("kldata/type=south/north", "BAD_HEADER_VALUE", "invalid value south in kldata header for key type"),
    # whole messages
    ("", "TOO_FEW_LINES", "kldata message contained too few lines"),
    ("\n", "NO_INDICATOR", "kldata indicator missing or out of order"),
    (HEAD[:-1], "TOO_FEW_LINES", "kldata message contained too few lines"),
    (HEAD, "TOO_FEW_LINES", "kldata message contained too few lines"),
    (HEAD + "RR_1,TGX(2,9)", "EMPTY_BODY", "empty row in kldata csv"),
    (HEAD + "RR_1\n" + T, "EMPTY_BODY", "empty row in kldata csv"),
    (HEAD + "()\n" + T, "EMPTY_BODY", "empty row in kldata csv"),
    (HEAD + "()\n" + T + ",4", "TOO_MANY_VALUES", "more values than columns in kldata csv"),
    (HEAD + "RR_1\n" + T + ",4\n\n", "BAD_TIME", "premature end of input"),
    (HEAD + "RR_1\n20190017153000,4", "BAD_TIME", "input is out of range"),
    (HEAD + "RR_1\n20190631153000,4", "BAD_TIME", "input is out of range"),
    (HEAD + "RR_1\n" + T + "9,4", "BAD_TIME", "trailing input"),
    (HEAD + "RR_1\n201908-7153000,4", "BAD_TIME", "input contains invalid characters"),
    (HEAD + "RR_1\n" + T + ",4,5", "TOO_MANY_VALUES", "more values than columns in kldata csv"),
    (HEAD + "RR_1\n" + T + ",dry,5", "BAD_NUMBER", "value dry could not be parsed as float"),
    (HEAD + "RR_1\n" + T + ",", "BAD_NUMBER", "value  could not be parsed as float"),
    (HEAD + "RR_1\n" + T + ",4d", "BAD_NUMBER", "value 4d could not be parsed as float"),
    (HEAD + "RR_1\n" + T + ",4\nlate,4\n" + T + ",dry", "BAD_TIME", "input contains invalid characters"),
    (HEAD + "RR_1(2,88888888888)\n" + T + ",4", "BAD_COLUMN", "sensor or level out of range in kldata column line"),
    # unknown codes are faults of the catalogue, found after the body
    (HEAD + "MOON,RR_1\n" + T + ",full,4", "UNKNOWN_PARAM", "unrecognised param_code 'MOON'"),
    (HEAD + "MOON,RR_1\n" + T + ",full,dry", "BAD_NUMBER", "value dry could not be parsed as float"),
    (HEAD + "RR_1,MOON\n" + T + ",4", None, 812),
    (HEAD + "RR_1(3.5,1)\n" + T + ",4,5,6", "UNKNOWN_PARAM", "unrecognised param_code '3.5'"),
    (HEAD + "RR_1,TGX,TGM\r\n" + T + ",0.25,-7,31\r\n" + T + ",Inf,+NaN,7.e2\r\n", None, 812),
]

# Message and its rows: row, column, time, code, sensor, level, number, text.
VALUES = [
    (HEAD + "RR_1,TGX\n" + T + ",0.25,-7\n20190817160000,0.5,31", [
        (0, 0, T0, "RR_1", None, None, 0.25, None), (0, 1, T0, "TGX", None, None, -7.0, None),
        (1, 0, datetime(2019, 8, 17, 16), "RR_1", None, None, 0.5, None), (1, 1, datetime(2019, 8, 17, 16), "TGX", None, None, 31.0, None),
    ]),
    (HEAD + "TGM(4,6),KLOBS(5,7)\n" + T + ",12.75,half past three", [
        (0, 0, T0, "TGM", 4, 6, 12.75, None), (0, 1, T0, "KLOBS", 5, 7, None, "half past three"),
    ]),
    # short rows leave out their last columns; a text may be empty
    (HEAD + "KLOBS,RR_1(0,0),TGX\n" + T + ",,3\n" + T + ",noon", [
        (0, 0, T0, "KLOBS", None, None, None, ""), (0, 1, T0, "RR_1", 0, 0, 3.0, None), (1, 0, T0, "KLOBS", None, None, None, "noon"),
    ]),
    (HEAD + "TGX(8,9),TGX\n" + T + ",5,6", [(0, 0, T0, "TGX", 8, 9, 5.0, None), (0, 1, T0, "TGX", None, None, 6.0, None)]),
]


@pytest.fixture(scope="module", params=["in the query", "by join"])
def decoding(spark, request):
    params = spark.createDataFrame(PARAMS, schema.PARAMS)
    codes = code_sets(params, limit=50 if request.param == "in the query" else 3)
    assert (codes is None) == (request.param == "by join")
    return lambda *texts: observations.decode(messages(spark, *texts), params, codes, "double")


def test_outcomes(decoding):
    decoded = decoding(*[case[0] for case in OUTCOMES])
    receipts = rows(observations.receipts(decoded.messages))
    rejects = {r.message_seq: r for r in observations.rejects(decoded).collect()}
    for (text, code, detail), (seq, message, message_id, res, retry) in zip(OUTCOMES, receipts, strict=True):
        assert retry is False
        if code is None:
            assert (message, message_id, res, seq in rejects) == ("", detail, 0, False), text
        else:
            assert (message, message_id, res) == (f"parse error: {detail}", 0, 1), text
            assert (rejects[seq].code, rejects[seq].detail) == (code, detail), text
    # No value of a rejected message is left.
    assert {r.message_seq for r in decoded.observations.collect()} == {i for i, c in enumerate(OUTCOMES) if c[1] is None}


def test_values(decoding):
    found = decoding(*[text for text, _ in VALUES]).observations.select(
        "message_seq", "row_no", "col_no", "obstime", "param_code", "sensor", "lvl", "value_num", "value_text"
    )
    expected = [(i, *row) for i, (_, values) in enumerate(VALUES) for row in values]
    assert rows(found, "message_seq", "row_no", "col_no") == expected


def test_times(spark):
    cases = {
        "20240229235959": datetime(2024, 2, 29, 23, 59, 59), "2024022923595": datetime(2024, 2, 29, 23, 59, 5),
        "20240229235960": datetime(2024, 3, 1), "2024 2 9 3 5 9": datetime(2024, 2, 9, 3, 5, 9), "20230229000000": None,
        "20240101240000": None, "202401010000": None, "20240101000000 ": None, "2024-01-01": None, "": None,
    }
    dashed = {
        "2024-06-06 06:00:00": datetime(2024, 6, 6, 6), "2024-6-6 6:0:1": datetime(2024, 6, 6, 6, 0, 1),
        "2024-06-06T06:00:00": None, "2024-06-31 06:00:00": None, "2024-06-06 06:00": None, "24-06-06 06:00:00.5": None,
        # a gap in the clocks of some zones, but not in UTC
        "2024-03-31 02:30:00": datetime(2024, 3, 31, 2, 30),
    }
    for parse, table in ((compact_time, cases), (dashed_time, dashed)):
        df = spark.createDataFrame([(t,) for t in table], "t string")
        assert {r.t: r.p for r in df.select("t", parse(F.col("t")).alias("p")).collect()} == table


def test_message_order_decides_only_ties(spark, decoding):
    texts = [text for text, _ in VALUES]
    forward = decoding(*texts).observations.drop("message_seq")
    backward = decoding(*reversed(texts)).observations.drop("message_seq")
    assert rows(forward) == rows(backward)
