"""Open-access rule: which series may be stored.

A permit names a station, a type and a parameter; type or parameter 0 stands for all. The first permit
of a station, in list order, that covers the series decides; without one the permit of the station
does; without that the series is closed. Permit 1 means open.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries.functions.times import MOST_RANGES, range_start
from skyseries.operators.skew import lookup_join

OPEN_PERMIT = 1
ANY = 0
KEY = ["station_id", "type_id", "param_id"]


def open_flags(keys: DataFrame, param_permits: DataFrame, station_permits: DataFrame, sliced: bool = False, by=()):
    """Add `is_open` to distinct `(station_id, type_id, param_id)` keys, or to those and the columns ``by``.

    Every key looks up its four possible permits (exact, any parameter, any type, any of both), so the
    work is four lookups per key, however many permits a station has. Permits have the columns ``by`` too. They may come from
    anywhere, and there may be as many as stations, so none are broadcast.
    """
    by = list(by)
    first = param_permits.groupBy(*KEY, *by).agg(F.min(F.struct("ord", "permit_id")).alias("permit"))
    any_id = F.lit(ANY).cast("int")
    probes = keys.select(
        *KEY, *by,
        F.explode(
            F.array_distinct(
                F.array(*[
                    F.struct(t.cast("int").alias("t"), p.cast("int").alias("p"))
                    for t in (F.col("type_id"), any_id)
                    for p in (F.col("param_id"), any_id)
                ])
            )
        ).alias("probe"),
    ).select(
        "station_id", *by,
        F.col("probe.t").alias("type_id"),
        F.col("probe.p").alias("param_id"),
        F.col("type_id").alias("own_type"),
        F.col("param_id").alias("own_param"),
    )
    decided = (
        lookup_join(probes, first, [*KEY, *by], "inner", sliced=sliced, shuffled=True)
        .groupBy("station_id", *by, F.col("own_type").alias("type_id"), F.col("own_param").alias("param_id"))
        .agg(F.min("permit").alias("permit"))
    )
    stations = station_permits.groupBy("station_id", *by).agg(F.max("permit_id").alias("station_permit"))
    with_station = lookup_join(keys, stations, ["station_id", *by], sliced=sliced, shuffled=True)
    # One row per key on both sides, so no key is heavy here.
    return with_station.join(decided, [*KEY, *by], "left").select(
        *keys.columns,
        (F.coalesce("permit.permit_id", "station_permit", F.lit(0)) == OPEN_PERMIT).alias("is_open"),
    )


def filter_open(observations: DataFrame, param_permits, station_permits, sliced: bool = False) -> DataFrame:
    """Keep the observations of open series; the rule runs once per distinct key."""
    keys = observations.select(*KEY).distinct()
    opened = open_flags(keys, param_permits, station_permits, sliced).where("is_open").select(*KEY)
    return lookup_join(observations, opened, KEY, "left_semi", sliced=sliced)


def open_as_of(observations: DataFrame, arrival: str, versions: list, param_permits: DataFrame, station_permits: DataFrame,
               sliced: bool = False) -> DataFrame:
    """Observations with `is_open` by the permits that held when they arrived.

    ``versions`` are the sorted first arrivals of the versions of the permits; both permit tables carry theirs in `version`
    (0, 1, ...). An observation finds its version by binary search, and each key is looked up once for each version it has
    arrived under. What came before the first version is closed.
    """
    if len(versions) > MOST_RANGES:
        raise ValueError(f"at most {MOST_RANGES} versions go into one plan, {len(versions)} were given")
    version = range_start(F.col(arrival), versions)
    numbers = F.create_map(*[F.lit(x) for i, start in enumerate(versions) for x in (start, i)])
    known = observations.withColumn("version", numbers[version])
    keys = known.where("version is not null").select(*KEY, "version").distinct()
    flags = open_flags(keys, param_permits, station_permits, sliced, by=["version"])
    joined = lookup_join(known, flags, [*KEY, "version"], "left", sliced=sliced)
    return joined.withColumn("is_open", F.coalesce("is_open", F.lit(False)))
