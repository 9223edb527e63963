"""Observation messages: text to typed rows, with whole-message rejection.

A message is a header line, a line of column names and a CSV body:

    kldata/nationalnr=<station>/type=<type>/messageid=<id>
    <code>[(<sensor>,<level>)],<code>...
    <yyyyMMddHHmmss>,<value>,<value>...

The first fault in reading order rejects the whole message. Everything up to the explode works inside
the message row, so decoding shuffles nothing.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyseries.functions.numbers import is_float, strict_float, strict_int, strict_unsigned
from skyseries.functions.times import compact_time, compact_time_fault
from skyseries.operators.skew import lookup_join

# Words of the header line and the pattern of a column name.
INDICATOR = "kldata"
IGNORED_FIELD = "add"
STATION_KEY, TYPE_KEY, ID_KEY, TIME_KEY = "nationalnr", "type", "messageid", "received_time"
COLUMN_PATTERN = r"([^(),]+)(\(([0-9]+),([0-9]+)\))?"

# The wording of the receipts. Two texts stand before and after the value they complain about.
WORDING = {
    "NO_INDICATOR": "kldata indicator missing or out of order",
    "UNEXPECTED_FIELD": "unexpected field in kldata header format: ",
    "BAD_HEADER_VALUE": ("invalid value ", " in kldata header for key "),
    "MISSING_STATION": "missing field `nationalnr` in kldata header",
    "MISSING_TYPE": "missing field `type` in kldata header",
    "TOO_FEW_LINES": "kldata message contained too few lines",
    "BAD_COLUMN": "sensor or level out of range in kldata column line",
    "TOO_MANY_VALUES": "more values than columns in kldata csv",
    "EMPTY_BODY": "empty row in kldata csv",
    "BAD_NUMBER": ("value ", " could not be parsed as float"),
    "UNKNOWN_PARAM": ("unrecognised param_code '", "'"),
}
PARSE_ERROR = "parse error: "
OUT_OF_RANGE = "OUT_OF_RANGE"

# Header lines that surely have no fault; the others are looked at field by field.
PLAIN_HEADER = (
    f"^{INDICATOR}(/({IGNORED_FIELD}|({STATION_KEY}|{TYPE_KEY})=[+-]?[0-9]{{1,9}}|{ID_KEY}=[0-9]{{1,18}}|{TIME_KEY}=[^/]*))*$"
)

# Stages in the order in which a message is read; the smallest (stage, row, col) names the fault.
HEADER, LINES, BODY, EMPTY, CATALOGUE, STORAGE = range(6)


@dataclass
class Decoded:
    """``messages``: one row per message with its fault or NULL; ``observations``: rows of faultless ones."""

    messages: DataFrame
    observations: DataFrame


def fault(stage, row_no, col_no, code: str, detail) -> Column:
    def number(x):
        return x.cast("int") if isinstance(x, Column) else F.lit(x)

    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(
        F.lit(stage).alias("stage"),
        number(row_no).alias("row_no"),
        number(col_no).alias("col_no"),
        F.lit(code).alias("code"),
        detail.alias("detail"),
    )


def _lines(msg: Column) -> Column:
    """Lines of a text; a final line break starts no further line."""
    # Split on one plain character: a pattern would be compiled anew for every message.
    parts = F.split(F.replace(msg, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _header_faults(fields: Column) -> Column:
    def check(field, i):
        pair = F.split(field, "=", 2)
        key, value = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        unknown = value.isNull() | ~key.isin(STATION_KEY, TYPE_KEY, ID_KEY, TIME_KEY)
        bad_value = (key.isin(STATION_KEY, TYPE_KEY) & strict_int(value).isNull()) | (
            (key == ID_KEY) & strict_unsigned(value).isNull()
        )
        return (
            F.when((i == 0) | (field == IGNORED_FIELD), None)
            .when(
                unknown,
                fault(HEADER, 0, i, "UNEXPECTED_FIELD",
                      F.concat(F.lit(WORDING["UNEXPECTED_FIELD"]), field)),
            )
            .when(
                bad_value,
                fault(HEADER, 0, i, "BAD_HEADER_VALUE",
                      F.concat(F.lit(WORDING["BAD_HEADER_VALUE"][0]), value, F.lit(WORDING["BAD_HEADER_VALUE"][1]), key)),
            )
        )

    return F.transform(fields, check)


def _header_value(header: Column, key: str) -> Column:
    """Text of the last field with this key, empty without one."""
    return F.regexp_extract(header, f"(?s)^.*/{key}=([^/]*)", 1)


def _columns() -> Column:
    """Code, sensor and level of every column name, from the lists `codes` and `pairs`."""
    none = F.lit(None).cast("int")

    def column(code, i):
        pair = F.get("pairs", i)
        numbers = F.split(F.translate(pair, "()", ""), ",")
        sensor, lvl = strict_int(F.get(numbers, F.lit(0))), strict_int(F.get(numbers, F.lit(1)))
        # The pattern lets only digits through, so a missing number is one that is too large.
        return F.when(
            pair == "", F.struct(code.alias("code"), none.alias("sensor"), none.alias("lvl"), F.lit(False).alias("bad"))
        ).otherwise(
            F.struct(code.alias("code"), sensor.alias("sensor"), lvl.alias("lvl"), (sensor.isNull() | lvl.isNull()).alias("bad"))
        )

    return F.transform("codes", column)


def _structure(messages: DataFrame) -> DataFrame:
    """Header, columns, and body lines with their time; faults of the first three stages but numbers."""
    lines = messages.select("message_seq", _lines(F.col("msg")).alias("lines"))
    split = lines.select(
        "message_seq",
        F.size("lines").alias("n_lines"),
        F.coalesce(F.get("lines", F.lit(0)), F.lit("")).alias("header"),
        F.coalesce(F.get("lines", F.lit(1)), F.lit("")).alias("names"),
        F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))).alias("body"),
    )
    # What the expressions below use more than once is made one step earlier, or each use repeats it.
    texts = split.select(
        "*",
        _header_value(F.col("header"), STATION_KEY).alias("station_text"),
        _header_value(F.col("header"), TYPE_KEY).alias("type_text"),
        _header_value(F.col("header"), ID_KEY).alias("id_text"),
        F.regexp_extract_all("names", F.lit(COLUMN_PATTERN), F.lit(1)).alias("codes"),
        F.regexp_extract_all("names", F.lit(COLUMN_PATTERN), F.lit(2)).alias("pairs"),
    )
    parsed = texts.select(
        "n_lines", "message_seq", "header",
        strict_int(F.col("station_text")).alias("station_id"),
        strict_int(F.col("type_text")).alias("type_id"),
        F.coalesce(strict_unsigned(F.col("id_text")), F.lit(0)).alias("message_id"),
        _columns().alias("columns"),
        F.transform("body", _body_row).alias("rows"),
    )

    def lacks(key):
        return ~F.col("header").contains(f"/{key}=")

    fields = F.split("header", "/")
    header_faults = F.concat(
        F.when(F.col("header").rlike(PLAIN_HEADER), F.array()).otherwise(_header_faults(fields)),
        F.array(
            F.when(F.get(fields, F.lit(0)) != INDICATOR,
                   fault(HEADER, 0, -1, "NO_INDICATOR", WORDING["NO_INDICATOR"])),
            F.when(lacks(STATION_KEY),
                   fault(HEADER, 1, 0, "MISSING_STATION", WORDING["MISSING_STATION"])),
            F.when(lacks(TYPE_KEY),
                   fault(HEADER, 1, 1, "MISSING_TYPE", WORDING["MISSING_TYPE"])),
        ),
    )
    line_faults = F.array(
        # Without a first line there is no header to complain about.
        F.when(F.col("n_lines") == 0,
               fault(HEADER, -1, 0, "TOO_FEW_LINES", WORDING["TOO_FEW_LINES"])),
        F.when(F.col("n_lines") < 2,
               fault(LINES, 0, 0, "TOO_FEW_LINES", WORDING["TOO_FEW_LINES"])),
        F.when(F.exists("columns", lambda c: c["bad"]),
               fault(LINES, 0, 1, "BAD_COLUMN", WORDING["BAD_COLUMN"])),
    )
    body_faults = F.transform(
        "rows",
        lambda r: F.when(r["obstime"].isNull(),
                         fault(BODY, r["row_no"], -1, "BAD_TIME", compact_time_fault(r["raw_time"])))
        .when(F.size(r["cells"]) - 1 > F.size("columns"),
              fault(BODY, r["row_no"], F.size("columns"), "TOO_MANY_VALUES", WORDING["TOO_MANY_VALUES"])),
    )
    empty = F.array(
        F.when(~F.exists("rows", lambda r: F.size(r["cells"]) > 1),
               fault(EMPTY, 0, 0, "EMPTY_BODY", WORDING["EMPTY_BODY"]))
    )
    return parsed.select(
        "message_seq", "message_id", "station_id", "type_id", "columns", "rows",
        F.concat(header_faults, line_faults, body_faults, empty).alias("faults"),
    )


def _body_row(line: Column, row_no: Column) -> Column:
    """A body line: its time, and its cells with the time as cell 0."""
    raw_time = F.substring_index(line, ",", 1)
    return F.struct(
        row_no.alias("row_no"),
        raw_time.alias("raw_time"),
        compact_time(raw_time).alias("obstime"),
        F.split(line, ",").alias("cells"),
    )


def _number_fault(row_no, col_no, text) -> Column:
    return fault(BODY, row_no, col_no, "BAD_NUMBER",
                 F.concat(F.lit(WORDING["BAD_NUMBER"][0]), text, F.lit(WORDING["BAD_NUMBER"][1])))


def _unknown_fault(row_no, col_no, code) -> Column:
    return fault(CATALOGUE, row_no, col_no, "UNKNOWN_PARAM",
                 F.concat(F.lit(WORDING["UNKNOWN_PARAM"][0]), code, F.lit(WORDING["UNKNOWN_PARAM"][1])))


def _explode_values(base: DataFrame, number_type: str) -> DataFrame:
    """One row per value, in message order; `value_num` is NULL where the text is no number."""
    # The outer form keeps the optimizer from evaluating the whole decoding once more in a filter
    # below the generator; the filter after it drops the empty row.
    rows = base.select("*", F.explode_outer("rows").alias("r")).drop("rows").where(F.col("r.row_no").isNotNull())
    values = rows.select("*", F.posexplode_outer("r.cells").alias("cell_no", "value_text")).where(
        F.col("cell_no") > 0
    ).withColumn("col_no", F.col("cell_no") - 1)
    column = F.get("columns", F.col("col_no"))
    return values.select(
        "message_seq", F.col("r.row_no").alias("row_no"), "col_no", "station_id", "type_id", "message_id",
        F.col("r.obstime").alias("obstime"), column["code"].alias("param_code"),
        column["sensor"].alias("sensor"), column["lvl"].alias("lvl"),
        strict_float(F.col("value_text"), number_type).alias("value_num"), "value_text",
    )


def checked_messages(messages: DataFrame, codes=None) -> DataFrame:
    """One row per message `(message_seq, msg)`: its decoded lines and its first fault.

    ``codes`` is the `(scalar, text)` code lists of the catalogue as given by `catalogue.code_sets`, or
    None when it is too large to hold in a query; values are then checked by `decode_checked`.
    """
    base = _structure(messages)
    if codes is None:
        return base.withColumn("fault", F.array_min("faults")).drop("faults")
    base = base.withColumn("kinds", F.transform("columns", lambda c: _kind(c["code"], codes)))

    def value_faults(r):
        def check(value, cell_no):
            kind = F.get("kinds", cell_no - 1)
            code = F.get("columns", cell_no - 1)["code"]
            return F.when((cell_no > 0) & (kind != "text"),
                          F.when((kind == "number") & ~is_float(value), _number_fault(r["row_no"], cell_no - 1, value))
                          .when(kind == "unknown", _unknown_fault(r["row_no"], cell_no - 1, code)))

        return F.array_min(F.transform(r["cells"], check))

    return base.select(
        "message_seq", "message_id", "station_id", "type_id", "columns", "rows",
        F.array_min(F.concat("faults", F.transform("rows", value_faults))).alias("fault"),
    )


def _kind(code: Column, codes) -> Column:
    scalar, text = codes
    kind = F.lit("unknown")
    if text:
        kind = F.when(code.isin(text), "text").otherwise(kind)
    return F.when(code.isin(scalar), "number").otherwise(kind) if scalar else kind


def decode_checked(checked: DataFrame, params: DataFrame, codes=None, number_type: str = "float") -> Decoded:
    """The result of `checked_messages`, made with the same ``codes``, to observations and outcomes."""
    if codes is None:
        return _decode_by_join(checked, params, number_type)
    good = checked.withColumn("rows", F.when(F.col("fault").isNull(), F.col("rows"))).drop("fault")
    values = _explode_values(good, number_type)
    return Decoded(
        messages=checked.select("message_seq", "message_id", "fault"),
        observations=_typed(values.withColumn("is_scalar", _kind(F.col("param_code"), codes) == "number")),
    )


def decode(messages: DataFrame, params: DataFrame, codes=None, number_type: str = "float") -> Decoded:
    """Messages to typed observations and per-message outcomes, with the catalogue ``params``."""
    return decode_checked(checked_messages(messages, codes), params, codes, number_type)


def _typed(values: DataFrame) -> DataFrame:
    return values.withColumn("value_num", F.when(F.col("is_scalar"), F.col("value_num"))).withColumn(
        "value_text", F.when(~F.col("is_scalar"), F.col("value_text"))
    )


def _decode_by_join(checked: DataFrame, params: DataFrame, number_type: str) -> Decoded:
    catalogue = params.select("param_code", "is_scalar")
    values = lookup_join(_explode_values(checked.drop("fault"), number_type), catalogue, ["param_code"])
    value_fault = F.when(
        F.col("is_scalar") & F.col("value_num").isNull(),
        _number_fault(F.col("row_no"), F.col("col_no"), F.col("value_text")),
    ).when(F.col("is_scalar").isNull() & F.col("param_code").isNotNull(),
           _unknown_fault(F.col("row_no"), F.col("col_no"), F.col("param_code")))
    first_value_fault = (
        values.select("message_seq", value_fault.alias("value_fault"))
        .where(F.col("value_fault").isNotNull())
        .groupBy("message_seq")
        .agg(F.min("value_fault").alias("value_fault"))
    )
    outcome = checked.join(first_value_fault, "message_seq", "left").select(
        "message_seq", "message_id",
        F.array_min(F.array("fault", "value_fault")).alias("fault"),
    )
    rejected = outcome.where(F.col("fault").isNotNull()).select("message_seq")
    return Decoded(messages=outcome, observations=_typed(values.join(rejected, "message_seq", "left_anti")))


def rejects(decoded: Decoded) -> DataFrame:
    """One row per rejected message: the first fault in reading order."""
    # Inlining evaluates the fault once; a filter on it would repeat the decoding below.
    faults = decoded.messages.select("message_seq", F.inline_outer(F.array("fault")))
    return faults.where(F.col("code").isNotNull()).select(
        "message_seq", "code", "detail", "row_no", "col_no", F.lit(False).alias("retry")
    )


def receipts(messages: DataFrame) -> DataFrame:
    """One answer per message: result 0 and the id, or 1, id 0 and the fault."""
    faults = messages.select("message_seq", "message_id", F.inline_outer(F.array("fault")))
    failed = F.col("code").isNotNull()
    return faults.select(
        "message_seq",
        F.when(failed, F.concat(F.lit(PARSE_ERROR), F.col("detail"))).otherwise("").alias("message"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("message_id")).alias("message_id"),
        failed.cast("int").alias("res"),
        # Sending a faulty message again would not help.
        F.lit(False).alias("retry"),
    )


def null_zero_ids(observations: DataFrame) -> DataFrame:
    """Optional rule: sensor and level 0 mean "not given", as in quality-control messages."""
    return observations.withColumns(
        {c: F.when(F.col(c) != 0, F.col(c)) for c in ("sensor", "lvl")}
    )
