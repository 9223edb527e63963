"""Decoding: messages are written out of `events`, one per event, and decoded again.

Each message has the event's value under its parameter, a text column, and a second, shorter row one
hour later.
"""

from pyspark.sql import functions as F

from skyseries.operators import observations, qc
from skyseries.operators.skew import lookup_join
from skyseries.operators.upsert import latest_wins, route_values
from skyseries.queries.mapping import CODES, OBS_SQL, ntz, obs
from skyseries.sources.messages import spread
from skyseries.sources.catalogue import code_sets, parse_params

# Catalogue: the five parameters and the text parameter, as the CSV has them.
CATALOGUE = [(str(i), code, f"element_{code}", "t") for i, code in enumerate(CODES, start=1)]
CATALOGUE.append(("9", "TXT", "element_text", "f"))


def params(spark, without=()):
    raw = spark.createDataFrame(
        [row for row in CATALOGUE if row[1] not in without], "id string, param_code string, element_id string, is_scalar string"
    )
    return parse_params(raw)


def compact(time):
    return F.date_format(time, "yyyyMMddHHmmss")


def good_messages(spark, sf_dir):
    second_time = F.col("obstime") + F.expr("interval 1 hour")
    text = F.concat(
        F.lit("kldata/nationalnr="), F.col("station_id"), F.lit("/type=501/add/messageid="), F.col("seq"), F.lit("\n"),
        F.col("param_code"), F.lit(",TXT(1,2)\n"),
        compact("obstime"), F.lit(","), F.col("obsvalue").cast("string"), F.lit(","), F.col("obstext"), F.lit("\n"),
        compact(second_time), F.lit(","), F.col("obsvalue").cast("string"), F.lit("\n"),
    )
    return obs(spark, sf_dir).select(F.col("seq").alias("message_seq"), text.alias("msg"))


def decoded(spark, messages, without=()):
    catalogue = params(spark, without)
    return observations.decode(spread(messages), catalogue, code_sets(catalogue), number_type="double")


def obs_parse(spark, sf_dir):
    rows = decoded(spark, good_messages(spark, sf_dir)).observations
    return rows.select(
        "message_seq", "row_no", "col_no", "station_id", "type_id", "message_id", ntz("obstime"), "param_code", "sensor",
        "lvl", "value_num", "value_text",
    )


PARSE_SQL = f"""
with {OBS_SQL},
cells as (
  select seq, 0 as row_no, 0 as col_no, station_id, obstime, param_code, null::integer as sensor, null::integer as lvl,
         obsvalue as num, null::varchar as txt from obs
  union all select seq, 0, 1, station_id, obstime, 'TXT', 1, 2, null, obstext from obs
  union all select seq, 1, 0, station_id, obstime + interval 1 hour, param_code, null, null, obsvalue, null from obs)
select seq as message_seq, row_no, col_no, cast(station_id as integer) as station_id, 501 as type_id, seq as message_id,
       date_trunc('second', obstime) as obstime, param_code, sensor, lvl, num as value_num, txt as value_text from cells"""


# One kind of message per remainder of the event id: (text after `{head}` and friends, code, detail, row, column).
FAULTS = [
    ("{head}\n{cols}\n{time},{value},{text}\n", None, None, None, None),
    ("nodata\n{cols}\n{time},{value},{text}", "NO_INDICATOR", "kldata indicator missing or out of order", 0, -1),
    ("{head}/more\n{cols}\n{time},{value}", "UNEXPECTED_FIELD", "unexpected field in kldata header format: more", 0, 4),
    ("kldata/nationalnr=x{seq}/type=501\n{cols}\n{time},{value}", "BAD_HEADER_VALUE",
     "invalid value x{seq} in kldata header for key nationalnr", 0, 1),
    ("kldata/messageid={seq}\n{cols}\n{time},{value}", "MISSING_STATION", "missing field `nationalnr` in kldata header", 1, 0),
    ("kldata/nationalnr={seq}\n{cols}\n{time},{value}", "MISSING_TYPE", "missing field `type` in kldata header", 1, 1),
    ("{head}", "TOO_FEW_LINES", "kldata message contained too few lines", 0, 0),
    ("{head}\n{cols}\n{time},{value},{text}\n\n", "BAD_TIME", "premature end of input", 1, -1),
    ("{head}\n{cols}\n{time},{value},{text},{value}", "TOO_MANY_VALUES", "more values than columns in kldata csv", 0, 2),
    ("{head}\n{cols}\n{time}\n", "EMPTY_BODY", "empty row in kldata csv", 0, 0),
    ("{head}\n{cols}\n{time},{value}\n{time}, {value}", "BAD_NUMBER", "value  {value} could not be parsed as float", 1, 0),
    # Read as text, which is no fault of the body; the catalogue is asked afterwards.
    ("{head}\nnew_{code},{cols}\n{time},a,{value}", "UNKNOWN_PARAM", "unrecognised param_code 'new_{code}'", 0, 0),
    # A time of 13 digits ends with a one-digit second.
    ("{head}\r\n{cols}\r\n{short_time}5,{value},{text}\r\n", None, None, None, None),
]


def _fill(template, values):
    """Concatenation of the template's fixed text and the given column for every name in braces."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), values[name]]
    return F.concat(*pieces, F.lit(rest))


def faulty_messages(spark, sf_dir):
    text = {
        "seq": F.col("seq").cast("string"),
        "head": F.concat(F.lit("kldata/nationalnr="), F.col("station_id"), F.lit("/type=501/messageid="), F.col("seq")),
        "cols": F.concat(F.col("param_code"), F.lit(",TXT(1,2)")),
        "time": compact("obstime"),
        "short_time": F.date_format("obstime", "yyyyMMddHHmm"),
        "value": F.col("obsvalue").cast("string"),
        "text": F.col("obstext"),
        "code": F.col("param_code"),
    }
    kind = F.col("seq") % len(FAULTS)
    msg = F
    for i, fault in enumerate(FAULTS):
        msg = msg.when(kind == i, _fill(fault[0], text))
    return obs(spark, sf_dir).select(F.col("seq").alias("message_seq"), msg.alias("msg"))


def obs_rejects(spark, sf_dir):
    found = observations.rejects(decoded(spark, faulty_messages(spark, sf_dir)))
    return found.select("message_seq", "code", "detail", "row_no", "col_no", "retry")


def _sql_text(template):
    names = {"{seq}": "seq", "{value}": "obsvalue", "{code}": "param_code"}
    text = "'" + template.replace("'", "''") + "'"
    for mark, column in names.items():
        text = text.replace(mark, f"' || {column} || '")
    return text


def _case(index, wrap=lambda x: x):
    tests = [f"when {i} then {wrap(f[index])}" for i, f in enumerate(FAULTS) if f[index] is not None]
    return f"case seq % {len(FAULTS)} {' '.join(tests)} end"


REJECTS_SQL = f"""
with {OBS_SQL},
found as (select seq as message_seq, {_case(1, repr)} as code, {_case(2, _sql_text)} as detail,
                 {_case(3)} as row_no, {_case(4)} as col_no, false as retry from obs)
select * from found where code is not null"""


def ingest_receipts(spark, sf_dir):
    return observations.receipts(decoded(spark, faulty_messages(spark, sf_dir)).messages)


RECEIPTS_SQL = f"""
with {OBS_SQL}, found as (select seq, {_case(2, _sql_text)} as detail from obs)
select seq as message_seq, coalesce('parse error: ' || detail, '') as message,
       case when detail is null then seq else 0 end as message_id, cast(detail is not null as integer) as res, false as retry
from found"""


def obs_typed(spark, sf_dir):
    """Values of the faultless messages by the table they are stored in."""
    scalar, text = route_values(decoded(spark, faulty_messages(spark, sf_dir)).observations)
    return scalar.select(
        "message_seq", ntz("obstime"), "param_code", F.lit("data").alias("stored_in"), "obsvalue",
        F.lit(None).cast("string").alias("obstext"),
    ).unionByName(text.select(
        "message_seq", ntz("obstime"), "param_code", F.lit("nonscalar_data").alias("stored_in"),
        F.lit(None).cast("double").alias("obsvalue"), F.col("obsvalue").alias("obstext"),
    ))


TYPED_SQL = f"""
with {OBS_SQL}, good as (
  select *, case seq % 13 when 0 then date_trunc('second', obstime) else date_trunc('minute', obstime) + interval 5 second end as t
  from obs where seq % 13 in (0, 12))
select seq as message_seq, t as obstime, param_code, 'data' as stored_in, obsvalue, null::varchar as obstext from good
union all select seq, t, 'TXT', 'nonscalar_data', null, obstext from good"""


def param_lookup(spark, sf_dir):
    """Ids of the decoded parameters; messages with a code the catalogue lacks are gone as a whole."""
    catalogue = params(spark, without=("signup",))
    rows = decoded(spark, good_messages(spark, sf_dir), without=("signup",)).observations
    ids = catalogue.select("param_code", F.col("id").alias("param_id"), "element_id")
    # Far fewer codes than tasks: the catalogue goes to the values.
    found = lookup_join(rows, F.broadcast(ids), ["param_code"], "inner")
    return found.select("message_seq", "row_no", "col_no", "param_code", "param_id", "element_id", "is_scalar")


LOOKUP_SQL = f"""
with {OBS_SQL}, known as (select * from obs where param_code <> 'signup')
select seq as message_seq, r as row_no, 0 as col_no, param_code, param_id, 'element_' || param_code as element_id, true as is_scalar
from known, unnest([0, 1]) as t(r)
union all select seq, 0, 1, 'TXT', 9, 'element_text', false from known"""


# Quality control: one document per event with two records; escaped quotes and line breaks as they arrive.
def _qc_record(param, original, corrected, use):
    return F.concat(
        F.lit('<kvdata paramid=\\"'), param, F.lit('\\"><original>'), original, F.lit("</original>\n<corrected>"), corrected,
        F.lit("</corrected><controlinfo>c&lt;1</controlinfo><useinfo>"), use, F.lit("</useinfo><cfailed></cfailed></kvdata>"),
    )


def qc_messages(spark, sf_dir, faulty=False, where="true"):
    """``where`` picks the observations written about. ``faulty`` plants an unreadable time, a missing declaration, broken XML or a bad number."""
    seq, value = F.col("seq"), F.col("obsvalue").cast("string")
    time = F.date_format("obstime", "yyyy-MM-dd HH:mm:ss")
    kind = seq % 7 if faulty else F.lit(0).cast("bigint")
    records = F.concat(
        _qc_record(F.col("param_id").cast("string"), value, F.lit(""), F.concat(F.lit("u"), seq)),
        _qc_record(F.lit("77"), F.when(kind == 4, "ten").otherwise("10"), value, F.lit("")),
    )
    block = F.concat(
        F.lit('<obstime val=\\"'), time, F.lit('\\"><tbtime val=\\"x\\"><sensor val=\\"0\\"><level val=\\"'), seq % 2,
        F.lit('\\">\n'), records, F.lit('</level><level val=\\"5\\"/></sensor></tbtime></obstime>'),
    )
    unreadable = F.lit('<obstime val=\\"noon\\"><tbtime val=\\"x\\"><sensor val=\\"1\\"><level val=\\"1\\"/></sensor></tbtime></obstime>')
    body = F.concat(
        F.lit('<checked producer=\\"here\\"><station val=\\"'), F.col("station_id"), F.lit('\\"><typeid val=\\"501\\">'),
        F.when(kind == 1, unreadable).otherwise(""), block, F.lit("</typeid></station></checked>"),
    )
    declared = F.concat(F.lit('  <?xml version=\\"1.0\\"?>\n'), body)
    text = (
        F.when(kind == 2, body).when(kind == 3, F.substring(declared, 1, F.length(declared) - 30))
        .when(kind == 5, F.lit('<?xml?><checked><station val="1"></station></checked>'))
        .when(kind == 6, F.lit('<?xml?><checked><station val="one"><typeid val="1"/></station></checked>'))
        .otherwise(declared)
    )
    return obs(spark, sf_dir).where(where).select(seq.alias("message_seq"), text.alias("value"))


def qc_parse(spark, sf_dir):
    records = qc.decode_qc(spread(qc_messages(spark, sf_dir)), "double").records
    return records.withColumn("obstime", ntz("obstime")).drop("doc_pos")


QC_PARSE_SQL = f"""
with {OBS_SQL}, t as (select *, date_trunc('second', obstime) as at_second, cast(nullif(seq % 2, 0) as integer) as lvl from obs)
select seq as message_seq, cast(station_id as integer) as station_id, param_id, type_id, null::integer as sensor, lvl,
       at_second as obstime, obsvalue as original, null::double as corrected, 'c<1' as controlinfo, 'u' || seq as useinfo,
       null::integer as cfailed from t
union all select seq, cast(station_id as integer), 77, type_id, null, lvl, at_second, 10, obsvalue, 'c<1', null, null from t"""


def qc_rejects(spark, sf_dir):
    return qc.decode_qc(spread(qc_messages(spark, sf_dir, faulty=True))).rejects


QC_REJECTS_SQL = """
select event_id as message_seq, case event_id % 7 when 1 then 'BAD_TIME' when 2 then 'NO_XML' when 3 then 'BAD_XML'
  when 4 then 'BAD_NUMBER' when 5 then 'MISSING_ELEMENT' else 'BAD_ID' end as code,
  case when event_id % 7 = 1 then 'noon' end as detail
from events where event_id % 7 <> 0"""


def qc_merge(spark, sf_dir):
    """Flags per series tuple and hour: the last record wins with all its columns, NULLs included."""
    return merged_flags(qc_messages(spark, sf_dir))


def merged_flags(messages):
    records = qc.decode_qc(spread(messages), "double").records
    hours = records.withColumn("obstime", F.date_trunc("hour", "obstime"))
    keys = ["station_id", "param_id", "type_id", "lvl", "obstime"]
    merged = latest_wins(hours, keys, ["message_seq", "doc_pos"], qc.PAYLOAD)
    return merged.withColumn("obstime", ntz("obstime"))


QC_MERGE_SQL = f"""
with {OBS_SQL}, t as (
  select *, date_trunc('hour', date_trunc('second', obstime)) as h, cast(nullif(seq % 2, 0) as integer) as lvl from obs)
select cast(station_id as integer) as station_id, param_id, type_id, lvl, h as obstime, arg_max(obsvalue, seq) as original,
       null::double as corrected, 'c<1' as controlinfo, arg_max('u' || seq, seq) as useinfo, null::integer as cfailed
from t group by 1, 2, 3, 4, 5
union all select cast(station_id as integer), 77, type_id, lvl, h, 10, arg_max(obsvalue, seq), 'c<1', null, null from t group by 1, 3, 4, 5"""


QUERIES = {
    "q_obs_parse": (obs_parse, PARSE_SQL),
    "q_obs_rejects": (obs_rejects, REJECTS_SQL),
    "q_ingest_receipts": (ingest_receipts, RECEIPTS_SQL),
    "q_obs_typed": (obs_typed, TYPED_SQL),
    "q_param_lookup": (param_lookup, LOOKUP_SQL),
    "q_qc_parse": (qc_parse, QC_PARSE_SQL),
    "q_qc_rejects": (qc_rejects, QC_REJECTS_SQL),
    "q_qc_merge": (qc_merge, QC_MERGE_SQL),
}
