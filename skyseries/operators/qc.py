"""Quality-control messages: nested XML to one row per control record.

`<station val> <typeid val> <obstime val> <tbtime val> <sensor val> <level val> <kvdata paramid>`, with
the payload in child elements of the innermost one. A message that cannot be read as a whole is
rejected; an unreadable observation time skips only its own block. Nothing is shuffled.
"""

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyseries.functions.numbers import is_float, strict_float, strict_int
from skyseries.functions.times import dashed_time, is_plain_time

PAYLOAD = ["original", "corrected", "controlinfo", "useinfo", "cfailed"]

# Attributes start with an underscore. Everything is read as text and typed by the strict grammar.
# The corrupt-record field has to be the last one, or valid documents lose their other fields.
_RECORD = "kvdata: array<struct<_paramid: string, " + ", ".join(f"{c}: string" for c in PAYLOAD) + ">>"
_LEVEL = f"level: array<struct<_val: string, {_RECORD}>>"
_SENSOR = f"sensor: array<struct<_val: string, {_LEVEL}>>"
_TBTIME = f"tbtime: array<struct<_val: string, {_SENSOR}>>"
_OBSTIME = f"obstime: array<struct<_val: string, {_TBTIME}>>"
_TYPEID = f"typeid: array<struct<_val: string, {_OBSTIME}>>"
XML_SCHEMA = f"struct<station: array<struct<_val: string, {_TYPEID}>>, _corrupt_record: string>"


@dataclass
class DecodedQc:
    """``records``: good control records; ``rejects``: whole messages and skipped time blocks."""

    records: DataFrame
    rejects: DataFrame


def _zero_to_null(text: Column) -> Column:
    return F.when(~text.isin("0", ""), strict_int(text))


def _malformed(text: Column, is_well_formed: Column) -> Column:
    return text.isNotNull() & (text != "") & ~is_well_formed


def _record_fault(k: Column) -> Column:
    return F.when(strict_int(k["_paramid"]).isNull(), "BAD_ID").when(
        _malformed(k["original"], is_float(k["original"]))
        | _malformed(k["corrected"], is_float(k["corrected"]))
        | _malformed(k["cfailed"], strict_int(k["cfailed"]).isNotNull()),
        "BAD_NUMBER",
    )


def _child_faults(children: Column, own_fault, grandchildren: str | None, deeper, required=True) -> Column:
    """First fault of a level of the tree: missing children, a fault of a child, or one below it."""

    def check(child):
        if grandchildren is None:
            return own_fault(child)
        return F.coalesce(own_fault(child), deeper(child[grandchildren]))

    first = F.array_min(F.transform(children, check))
    missing = F.lit("MISSING_ELEMENT") if required else F.lit(None).cast("string")
    return F.when(children.isNull() | (F.size(children) == 0), missing).otherwise(first)


def _id_fault(node: Column) -> Column:
    return F.when(strict_int(node["_val"]).isNull(), "BAD_ID")


def _text_fault(node: Column) -> Column:
    return F.when(node["_val"].isNull(), "MISSING_ELEMENT")


def _optional_id_fault(node: Column) -> Column:
    return F.when(_malformed(node["_val"], strict_int(node["_val"]).isNotNull()), "BAD_ID")


def _tree_fault(stations: Column) -> Column:
    def records(x):
        return _child_faults(x, _record_fault, None, None, required=False)

    def levels(x):
        return _child_faults(x, _optional_id_fault, "kvdata", records)

    def sensors(x):
        return _child_faults(x, _optional_id_fault, "level", levels)

    def tbtimes(x):
        return _child_faults(x, _text_fault, "sensor", sensors)

    def obstimes(x):
        return _child_faults(x, _text_fault, "tbtime", tbtimes)

    def typeids(x):
        return _child_faults(x, _id_fault, "obstime", obstimes)

    return _child_faults(stations, _id_fault, "typeid", typeids)


def _unreadable_times(stations: Column) -> Column:
    """One fault per time block whose time cannot be read."""

    def block_faults(blocks):
        bad = F.filter(blocks, lambda o: ~is_plain_time(o["_val"]) & dashed_time(o["_val"]).isNull())
        return F.transform(bad, lambda o: F.struct(F.lit("BAD_TIME").alias("code"), o["_val"].alias("detail")))

    return F.flatten(F.transform(stations, lambda s: F.flatten(F.transform(s["typeid"], lambda t: block_faults(t["obstime"])))))


# White space at the ends, and the characters deleted everywhere.
WHITE_SPACE = " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000"
DELETED = ["\n", "\\"]


def clean_text(value: Column) -> Column:
    # Trimming at the end looks at every character before, so it is asked only where there is something to trim.
    blank_end = reduce(lambda a, b: a | b, [value.endswith(c) for c in WHITE_SPACE])
    text = F.ltrim(F.when(blank_end, F.rtrim(value, F.lit(WHITE_SPACE))).otherwise(value), F.lit(WHITE_SPACE))
    for character in DELETED:
        # Splitting at one character is the faster way to delete it.
        text = F.array_join(F.split(text, re.escape(character)), "")
    return text


def after_declaration(text: Column) -> Column:
    """What follows the XML declaration; NULL without one."""
    end = F.locate("?>", text)
    return F.when(text.startswith("<?xml") & (end > 0), F.substring(text, end + 2, F.length(text)))


def _nodes(df: DataFrame, array: str, name: str) -> DataFrame:
    """One row per element of a list; `doc_pos` grows by the position of the element."""
    rows = df.select("*", F.posexplode_outer(array).alias("pos", name)).where(F.col(name).isNotNull())
    return rows.withColumn("doc_pos", F.array_append("doc_pos", F.col("pos"))).drop("pos")


def checked_documents(messages: DataFrame) -> DataFrame:
    """One row per message `(message_seq, value)`: its tree `stations`, the code of its fault, and all its `faults`."""
    texts = messages.select("message_seq", clean_text(F.col("value")).alias("text"))
    xml = texts.select("message_seq", after_declaration(F.col("text")).alias("xml")).select(
        "message_seq", F.col("xml").isNotNull().alias("has_envelope"), F.from_xml("xml", XML_SCHEMA).alias("doc")
    )
    checked = xml.select(
        "message_seq",
        F.col("doc.station").alias("stations"),
        F.when(~F.col("has_envelope"), "NO_XML")
        .when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(), "BAD_XML")
        .otherwise(_tree_fault(F.col("doc.station")))
        .alias("code"),
    )
    # Found while the tree is at hand: the rejects are then made without reading it again.
    no_detail = F.lit(None).cast("string")
    return checked.withColumn("faults", F.when(
        F.col("code").isNotNull(), F.array(F.struct("code", no_detail.alias("detail")))
    ).otherwise(_unreadable_times(F.col("stations"))))


def decode_checked(checked: DataFrame, number_type: str = "float") -> DecodedQc:
    """The result of `checked_documents` to control records and rejects."""
    good = checked.select(
        "message_seq",
        F.when(F.col("code").isNull(), F.col("stations")).alias("stations"),
        F.array().cast("array<int>").alias("doc_pos"),
    )
    blocks = _nodes(_nodes(_nodes(good, "stations", "s"), "s.typeid", "t"), "t.obstime", "o").select(
        "message_seq",
        "doc_pos",
        F.col("s._val").alias("station"),
        F.col("t._val").alias("type"),
        F.col("o._val").alias("raw_time"),
        dashed_time(F.col("o._val")).alias("obstime"),
        F.col("o.tbtime").alias("tbtime"),
    )
    timed = blocks.where(F.col("obstime").isNotNull())
    leaves = _nodes(_nodes(_nodes(_nodes(timed, "tbtime", "b"), "b.sensor", "se"), "se.level", "l"), "l.kvdata", "k")

    def payload(name):
        return F.nullif(F.col(f"k.{name}"), F.lit(""))

    records = leaves.select(
        "message_seq",
        "doc_pos",
        strict_int(F.col("station")).alias("station_id"),
        strict_int(F.col("k._paramid")).alias("param_id"),
        strict_int(F.col("type")).alias("type_id"),
        _zero_to_null(F.col("se._val")).alias("sensor"),
        _zero_to_null(F.col("l._val")).alias("lvl"),
        "obstime",
        strict_float(payload("original"), number_type).alias("original"),
        strict_float(payload("corrected"), number_type).alias("corrected"),
        payload("controlinfo").alias("controlinfo"),
        payload("useinfo").alias("useinfo"),
        strict_int(payload("cfailed")).alias("cfailed"),
    )
    # The outer form, for the same reason as in the observation decoder: one evaluation of the XML.
    rejects = checked.select("message_seq", F.inline_outer("faults")).where(F.col("code").isNotNull())
    return DecodedQc(records=records, rejects=rejects)


def decode_qc(messages: DataFrame, number_type: str = "float") -> DecodedQc:
    """Messages to control records and rejects; `doc_pos` sorts records in document order."""
    return decode_checked(checked_documents(messages), number_type)
