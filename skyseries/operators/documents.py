"""Nested answers as JSON text.

An answer whose array would be long comes in numbered parts of bounded size, so that no task ever
collects a whole series; an answer of ordinary size is a single part 0. Every answer says in its text which part it is and
how many there are. What has no values has an answer all the same, with an empty array.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyseries.functions.times import floor_div, micros, rfc3339, step_seconds
from skyseries.operators.grid import SECOND_US, filled_blocks
from skyseries.operators.skew import collect_parts, part_numbers

PART_ROWS = 50_000
# Ranges of series ids whose parts are numbered side by side.
ID_RANGES = 4096
DAY_US = 86_400 * 1_000_000
JSON_OPTIONS = {"ignoreNullFields": "false"}


def _number(value: Column) -> Column:
    """JSON has no not-a-number and no infinity."""
    infinity = F.lit("Infinity").cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != infinity), value)


def _part() -> list[Column]:
    return [F.col("part_no").alias("part"), F.col("n_parts").alias("parts")]


def _header() -> Column:
    return F.struct(
        F.col("timeseries").alias("ts_id"),
        rfc3339(F.col("fromtime")).alias("fromtime"),
        rfc3339(F.col("totime")).alias("totime"),
        "station_id", "param_id", "lvl", "sensor", F.col("loc").alias("location"),
    )


def irregular_documents(values: DataFrame, headers: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """`(timeseries, part_no, n_parts, regularity, data, header, timestamps)`, arrays sorted by time.

    Series and time are unique and times have whole seconds, so a day of a series is a bounded block.
    """
    days = values.withColumn("day", floor_div(micros(F.col("obstime")), DAY_US))
    arrays = collect_parts(days, ["timeseries"], "day", F.struct("obstime", "obsvalue"), part_rows)
    # An existing series without values in range has one empty document.
    joined = headers.join(arrays, "timeseries", "left").withColumn("rows", F.coalesce("rows", F.array()))
    return joined.select(
        "timeseries",
        F.coalesce("part_no", F.lit(0)).alias("part_no"),
        F.coalesce("n_parts", F.lit(1)).alias("n_parts"),
        F.lit("Irregular").alias("regularity"),
        F.col("rows.obsvalue").alias("data"),
        _header().alias("header"),
        F.transform("rows", lambda r: rfc3339(r["obstime"])).alias("timestamps"),
    )


def regular_documents(data: DataFrame, ranges: DataFrame, resolution: str, part_rows: int = PART_ROWS,
                      strict: bool = True, sliced: bool = False) -> DataFrame:
    """`(timeseries, part_no, n_parts, regularity, data, header, start_time, time_resolution)`.

    ``data`` are the current values of the series. The position in the array carries the time;
    `start_time` is that of the first slot of the part. A part is a block of the grid.
    """
    step = step_seconds(resolution, strict)
    # The header goes with the blocks while they are small; an empty range has one block without slots.
    bounds = ranges.select("timeseries", "first", "last", F.struct(*ranges.columns).alias("head"))
    blocks = filled_blocks(bounds, data, step, ["timeseries"], slots_per_block=part_rows, sliced=sliced, carried="head")
    start = F.timestamp_micros(F.col("origin") + F.col("block") * (part_rows * step * SECOND_US))
    joined = blocks.select("head.*", "origin", "block", "data")
    n_parts = floor_div(micros(F.col("last")) - micros(F.col("first")), part_rows * step * SECOND_US) + 1
    return joined.select(
        "timeseries",
        F.coalesce("block", F.lit(0)).cast("int").alias("part_no"),
        F.greatest(n_parts, F.lit(1)).cast("int").alias("n_parts"),
        F.lit("Regular").alias("regularity"),
        F.coalesce("data", F.array()).alias("data"),
        _header().alias("header"),
        rfc3339(F.coalesce(start, F.col("first").cast("timestamp"))).alias("start_time"),
        F.lit(resolution).alias("time_resolution"),
    )


def series_json(documents: DataFrame) -> DataFrame:
    """One JSON answer per series and part."""
    fields = [c for c in documents.columns if c not in ("timeseries", "part_no", "n_parts")]
    clean = documents.withColumn("data", F.transform("data", _number))
    answer = F.struct(F.array(F.struct(*fields)).alias("tseries"), *_part())
    return clean.select("timeseries", "part_no", F.to_json(answer, JSON_OPTIONS).alias("json"))


def timeslice_documents(slices: DataFrame, requests: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """`(ts, param_id, part_no, n_parts, data)` with the elements `(station_id, value, loc)` sorted by series.

    A series occurs once per slice, so a range of ids is a bounded block. ``requests`` `(ts, param_id)` without values
    have one empty document each.
    """
    blocks = slices.withColumn("id_block", floor_div(F.col("timeseries"), part_rows))
    element = F.struct("timeseries", "station_id", F.col("obsvalue").alias("value"), "loc")
    parts = collect_parts(blocks, ["ts", "param_id"], "id_block", element, part_rows)
    if requests is not None:
        parts = requests.select("ts", "param_id").distinct().join(parts, ["ts", "param_id"], "left")
    data = F.transform("rows", lambda r: F.struct(r["station_id"].alias("station_id"), r["value"].alias("value"), r["loc"].alias("loc")))
    return parts.select(
        "ts", "param_id", F.coalesce("part_no", F.lit(0)).alias("part_no"), F.coalesce("n_parts", F.lit(1)).alias("n_parts"),
        F.coalesce(data, F.array()).alias("data"),
    )


def timeslice_json(documents: DataFrame) -> DataFrame:
    data = F.transform(
        "data",
        lambda r: F.struct(r["station_id"].alias("station_id"), _number(r["value"]).alias("value"), r["loc"].alias("loc")),
    )
    slices = F.array(F.struct(rfc3339(F.col("ts")).alias("timestamp"), "param_id", data.alias("data"))).alias("tslices")
    return documents.select("ts", "param_id", "part_no", F.to_json(F.struct(slices, *_part()), JSON_OPTIONS).alias("json"))


def latest_documents(newest: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """`(part_no, n_parts, data)` with the elements `(value, timestamp, station_id, loc)`, sorted by series over all parts.

    Parts are numbered within ranges of ids, side by side, and the ranges one after the other by prefix sums: only
    `ID_RANGES` sizes meet in one task. Without any value there is one empty document.
    """
    id_block = floor_div(F.col("timeseries"), part_rows)
    edges = newest.agg(F.struct(F.min(id_block).alias("low"), F.max(id_block).alias("high")).alias("edges")).scalar()
    width = (edges["high"] - edges["low"] + 1).cast("double")
    id_range = F.floor((F.col("id_block") - edges["low"]) * (F.lit(float(ID_RANGES)) / width)).cast("int")
    blocks = newest.withColumn("id_block", id_block).withColumn("id_range", id_range)
    numbers = part_numbers(blocks, ["id_range"], "id_block", part_rows)
    sizes = numbers.groupBy("id_range").agg(F.max("n_parts").alias("own"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("id_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "id_range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"), F.sum("own").over(every).alias("all")
    )
    numbers = numbers.join(F.broadcast(offsets), "id_range").select(
        "id_range", "id_block", (F.col("offset") + F.col("part_no")).cast("int").alias("part_no"), F.col("all").cast("int").alias("n_parts")
    )
    element = F.struct(
        "timeseries", F.col("obsvalue").alias("value"), rfc3339(F.col("obstime")).alias("timestamp"), "station_id", "loc"
    )
    parts = collect_parts(blocks, ["id_range"], "id_block", element, part_rows, numbers)
    data = F.transform(
        "rows",
        lambda r: F.struct(
            r["value"].alias("value"), r["timestamp"].alias("timestamp"),
            r["station_id"].alias("station_id"), r["loc"].alias("loc"),
        ),
    )
    filled = parts.select("part_no", "n_parts", data.alias("data"))
    # The empty document stands where there is no part 0.
    nothing = F.array().cast(filled.schema["data"].dataType)
    base = newest.sparkSession.range(1).select(F.lit(0).alias("part_no"), F.lit(1).alias("n_parts"), nothing.alias("data"))
    empty = base.join(numbers.where("part_no = 0").select("part_no").distinct(), "part_no", "left_anti")
    return filled.unionByName(empty)


def latest_json(documents: DataFrame) -> DataFrame:
    data = F.transform(
        "data",
        lambda r: F.struct(
            _number(r["value"]).alias("value"), r["timestamp"].alias("timestamp"),
            r["station_id"].alias("station_id"), r["loc"].alias("loc"),
        ),
    )
    return documents.select("part_no", F.to_json(F.struct(data.alias("data"), *_part()), JSON_OPTIONS).alias("json"))
