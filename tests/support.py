"""Fixtures written for these tests: a small catalogue, permits, and a message builder."""

from datetime import datetime, timedelta

from skyseries import schema
from skyseries.plans.ingest import SideTables

# (id, code, element, scalar). Only the codes and the id of RR_1 are fixed; the other ids are free.
PARAMS = [
    (211, "TA", "air_temperature", True),
    (222, "TGM", "ground_temperature_mean", True),
    (225, "TGX", "ground_temperature_max", True),
    (106, "RR_1", "precipitation_1h", True),
    (15, "CI", "cloud_index", True),
    (18, "IR", "rain_intensity", True),
    (9001, "KLOBS", "clock_observed", False),
]
PARAM_IDS = {code: number for number, code, _, _ in PARAMS}
PARAM_PERMITS = [(10000, 0, 0, 0, 0), (10001, 0, 0, 1, 0)]
STATION_PERMITS = [(10000, 1), (10001, 0), (20000, 0), (20001, 1), (20002, 1)]


def side_tables(spark, param_permits=PARAM_PERMITS, station_permits=STATION_PERMITS):
    return SideTables(
        spark.createDataFrame(PARAMS, schema.PARAMS),
        spark.createDataFrame(param_permits, schema.PARAM_PERMITS),
        spark.createDataFrame(station_permits, schema.STATION_PERMITS),
    )


def message(station, type_id, columns, start, step, length, values=None, message_id=23):
    """Text of a message with one row per step; ``values`` is one text per column."""
    values = values or ["0"] * len(columns)
    lines = [f"kldata/nationalnr={station}/type={type_id}/messageid={message_id}", ",".join(columns)]
    lines += [",".join([f"{start + step * i:%Y%m%d%H%M%S}", *values]) for i in range(length)]
    return "\n".join(lines)


def messages(spark, *texts, first_seq=0):
    return spark.createDataFrame([(first_seq + i, t) for i, t in enumerate(texts)], schema.MESSAGES)


HOUR, MINUTE = timedelta(hours=1), timedelta(minutes=1)
NEW_YEAR = datetime(2024, 1, 1)


def rows(df, *order):
    """Rows as plain tuples, sorted by the given columns or by all."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
