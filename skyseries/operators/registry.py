"""Series identity: resolve label tuples to series ids and create ids on first sight."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyseries.operators.skew import keys_equal, lookup_join

SOURCE_KEY = ["station_id", "type_id", "param_code", "lvl", "sensor"]
MET_KEY = ["station_id", "param_id", "type_id", "lvl", "sensor"]
NULLABLE = ("lvl", "sensor")

# New keys are numbered in buckets named by the first hex digits of a hash: at most 16^3 of them.
BUCKET_DIGITS = 3


def distinct_series(observations: DataFrame, order, extra=("param_id",)) -> DataFrame:
    """One row per label tuple with `fromtime`, the time of its first observation in ``order``: columns or one expression.
    """
    rank = order if isinstance(order, Column) else F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = F.min_by("obstime", rank).alias("fromtime")
    return observations.groupBy(*SOURCE_KEY, *extra).agg(first)


def missing_series(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """The label tuples that are not registered yet; one row per tuple on both sides."""
    known = registry.select(*SOURCE_KEY)
    return keys.alias("k").join(known.alias("r"), keys_equal("k", "r", SOURCE_KEY, SOURCE_KEY), "left_anti")


# What labels of both kinds share; NULL is a value like any other.
BUCKET_KEY = ["station_id", "type_id", "lvl", "sensor"]
KEY_BUCKETS = 64


def key_bucket():
    """Bucket of a label tuple in the stored registry."""
    null_safe = [F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**40))) for c in BUCKET_KEY]
    return F.pmod(F.xxhash64(*null_safe), F.lit(KEY_BUCKETS)).cast("int")


def buckets_of(keys: DataFrame) -> list[int]:
    """The buckets that label tuples lie in: at most `KEY_BUCKETS` numbers."""
    return sorted(r[0] for r in keys.select(key_bucket().alias("b")).distinct().collect())


def key_hash(columns):
    """Hash text of a label tuple, the same in every run."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))


def assign_ids(keys: DataFrame, after: int = 0, columns=SOURCE_KEY) -> DataFrame:
    """Number distinct keys `after + 1, after + 2, ...` in the order of their hash.

    The keys are numbered inside hash buckets in parallel; only the bucket sizes (at most 4096 rows)
    are summed up in one task. Ids depend on the keys alone, so a task that runs again gives the same.
    """
    hashed = keys.withColumn("hash", key_hash(columns)).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    sizes = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    in_bucket = Window.partitionBy("bucket").orderBy("hash", *columns)
    numbered = hashed.withColumn("rank", F.row_number().over(in_bucket))
    return numbered.join(F.broadcast(offsets), "bucket").select(
        (F.lit(after) + F.col("offset") + F.col("rank")).cast("bigint").alias("timeseries"), *keys.columns
    )


def resolve_series(observations: DataFrame, registry: DataFrame, sliced: bool = False, stored: bool = False) -> DataFrame:
    """Add `timeseries` by label tuple, NULL when the tuple is not registered.

    Only a ``stored`` registry, of which the planner knows the size from its files, may be broadcast.
    """
    lookup = registry.groupBy(*SOURCE_KEY).agg(F.min("timeseries").alias("timeseries"))
    return lookup_join(observations, lookup, SOURCE_KEY, null_safe=NULLABLE, sliced=sliced, shuffled=not stored)


def resolve_met(records: DataFrame, labels_met: DataFrame, sliced: bool = False, stored: bool = False) -> DataFrame:
    """Add `timeseries` to control records: the smallest id with this label tuple, NULL without one; see `resolve_series`."""
    lookup = labels_met.groupBy(*MET_KEY).agg(F.min("timeseries").alias("timeseries"))
    return lookup_join(records, lookup, MET_KEY, null_safe=NULLABLE, sliced=sliced, shuffled=not stored)


def timeseries_table(registry: DataFrame) -> DataFrame:
    return registry.select(F.col("timeseries").alias("id"), "fromtime", "totime", "loc", "deactivated")


def labels_and_places(registry: DataFrame) -> DataFrame:
    """`labels_met` and `timeseries` in one row per series."""
    return registry.select(
        "timeseries", "station_id", "param_id", "type_id", "lvl", "sensor", "fromtime", "totime", "loc", "deactivated"
    )


def labels_met(registry: DataFrame) -> DataFrame:
    return registry.select("timeseries", "station_id", "param_id", "type_id", "lvl", "sensor")


def labels_source(registry: DataFrame) -> DataFrame:
    return registry.select(
        "timeseries", F.col("station_id").alias("nationalnummer"), "type_id", "param_code", "lvl", "sensor"
    )
