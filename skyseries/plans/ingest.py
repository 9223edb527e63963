"""One batch of observation messages, from text to the store."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries import session
from skyseries.functions.times import BUCKET_YEARS, obs_bucket
from skyseries.operators import access, observations, registry
from skyseries.operators.skew import keys_equal, lookup_join
from skyseries.operators.upsert import VALUE_KEY, latest_wins, packed_order, route_values
from skyseries.sources.catalogue import code_sets
from skyseries.sources.store import Store

# Order in which the values of a batch are written.
ORDER = ["message_seq", "row_no", "col_no"]


@dataclass
class SideTables:
    """What ingest looks up: the catalogue and the two permit tables."""

    params: DataFrame
    param_permits: DataFrame
    station_permits: DataFrame


def written_order():
    return packed_order(*[F.col(c) for c in ORDER])


def known_series(registered: DataFrame, keys: DataFrame) -> DataFrame:
    """The smallest id of each registered tuple of ``keys``."""
    wanted = keys.select(*registry.SOURCE_KEY).alias("k")
    found = registered.select("timeseries", *registry.SOURCE_KEY).alias("r").join(
        wanted, keys_equal("r", "k", registry.SOURCE_KEY, registry.NULLABLE), "left_semi"
    )
    return found.groupBy(*registry.SOURCE_KEY).agg(F.min("timeseries").alias("timeseries"))


def with_param_ids(rows: DataFrame, params: DataFrame, few: bool, sliced: bool = False) -> DataFrame:
    """Values with the id of their parameter.

    A catalogue of ``few`` codes, as `code_sets` bounds them, goes to every task: there are far fewer codes than tasks, so a
    shuffle by code would bring all values, and all that groups by labels after it, into a handful of tasks.
    """
    ids = params.select("param_code", F.col("id").alias("param_id"))
    return lookup_join(rows, F.broadcast(ids) if few else ids, ["param_code"], "inner", sliced=sliced and not few)


def new_series(store: Store, keys: DataFrame, known: DataFrame) -> DataFrame:
    """Registry rows for the tuples of ``keys`` that are not ``known``, numbered after every id of the store."""
    null = F.lit(None)
    new = registry.assign_ids(registry.missing_series(keys, known), after=store.top_id())
    return new.withColumns({"totime": null, "loc": null, "deactivated": null})


def ingest_batch(store: Store, messages: DataFrame, side: SideTables, batch: int, sliced: bool = False,
                 zero_ids_are_null: bool = False) -> None:
    """Decode, filter, resolve and store one batch of `(message_seq, msg)`; safe to repeat.

    The messages are decoded once. The distinct label tuples go through the access rule and the registry, of which only
    the key buckets of these tuples are read; the values meet the result in one join, whose rows are written once and then
    divided among the tables. By default sensor and level 0 are ids like any other here, though quality-control messages
    read them as "not given"; ``zero_ids_are_null`` unifies that.
    """
    session.prepare(store.spark)
    codes = code_sets(side.params)
    with session.broadcasts_measured(store.spark), session.staged(observations.checked_messages(messages, codes), "decoded") as checked:
        decoded = observations.decode_checked(checked, side.params, codes)
        rows = observations.null_zero_ids(decoded.observations) if zero_ids_are_null else decoded.observations
        typed = with_param_ids(rows, side.params, codes is not None, sliced)
        seen = registry.distinct_series(typed, written_order())
        # The values are passed once for the keys and once for the join; what follows from the keys is small.
        with session.staged(seen, "keys") as keys:
            flags = access.open_flags(keys.select(*access.KEY).distinct(), side.param_permits, side.station_permits, sliced)
            opened = keys.join(flags.where("is_open").drop("is_open"), access.KEY, "left_semi")
            registered = store.registry(buckets=registry.buckets_of(keys))
            known = known_series(registered, opened)
            new = new_series(store, opened, known)
            # One row per tuple. Ids follow from the keys alone, so both uses of the new ones give the same.
            wanted = known.unionByName(new.select(*registry.SOURCE_KEY, "timeseries"))
            labelled = lookup_join(typed, wanted, registry.SOURCE_KEY, "inner", registry.NULLABLE, sliced)
            with session.staged(labelled, "labelled") as labelled:
                # A batch that runs again keeps the series it has registered.
                own = store.log("registry", only=batch).drop("batch")
                tables = {"registry": own.unionByName(new.select(*own.columns)), **stored_tables(decoded, labelled, batch, store.ranges)}
                store.write_all(tables, batch)


def stored_tables(decoded: observations.Decoded, labelled: DataFrame, batch: int, ranges: list[int] = BUCKET_YEARS) -> dict[str, DataFrame]:
    """The resolved values, and what became of every message."""
    inside = F.coalesce(obs_bucket(F.col("obstime"), ranges).isNotNull(), F.lit(False))
    scalar, text = route_values(labelled.where(inside))
    arrival = F.lit(batch).cast("bigint").alias("arrival")

    outside = out_of_range(labelled.where(~inside))
    first_outside = outside.groupBy("message_seq").agg(F.min("fault").alias("outside"))
    final = decoded.messages.join(first_outside, "message_seq", "left").withColumn("fault", F.coalesce("fault", "outside"))
    not_retried = F.lit(False).alias("retry")
    rows_outside = outside.select("message_seq", "fault.code", "fault.detail", "fault.row_no", "fault.col_no", not_retried)
    return {
        "data": latest_wins(scalar, VALUE_KEY, written_order(), ["obsvalue"]).select("*", arrival),
        "nonscalar_data": latest_wins(text, VALUE_KEY, written_order(), ["obsvalue"]).select("*", arrival),
        "receipts": observations.receipts(final),
        "rejects": observations.rejects(decoded).unionByName(rows_outside),
    }


def out_of_range(rows: DataFrame) -> DataFrame:
    """Values whose time no storage range covers: refused one by one, the rest of the message stays."""
    found = observations.fault(
        observations.STORAGE, F.col("row_no"), F.col("col_no"), observations.OUT_OF_RANGE,
        F.concat(F.lit("no storage range for time "), F.col("obstime").cast("string")),
    )
    return rows.select("message_seq", found.alias("fault"))
