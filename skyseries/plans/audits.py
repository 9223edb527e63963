"""What one batch changes in the audits of a store, at the cost of the months and key buckets it touches."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries import session
from skyseries.functions.times import obs_bucket
from skyseries.operators import registry
from skyseries.operators.skew import keys_equal
from skyseries.operators.upsert import VALUE_KEY
from skyseries.sources.store import Store


def _rows_per_key(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*VALUE_KEY).agg(F.count(F.lit(1)).alias(name))


def _value_changes(store: Store, batch: int) -> DataFrame:
    """Keys that become duplicates, and rows with faults of their own: one row of changes."""
    own = _rows_per_key(store.log("data", only=batch), "own").alias("b")
    older = store.value_log("data", months=store.months_of("data", batch)).where(F.col("batch") < batch).alias("o")
    same = keys_equal("o", "b", VALUE_KEY, VALUE_KEY)
    before = _rows_per_key(older.join(own, same, "left_semi"), "before").alias("o")
    counted = own.join(before, same, "left").select("b.*", F.coalesce("o.before", F.lit(0)).alias("before"))
    null_key = F.col("timeseries").isNull() | F.col("obstime").isNull()
    uncovered = F.col("obstime").isNotNull() & obs_bucket(F.col("obstime"), store.ranges).isNull()
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("own"))), F.lit(0)).cast("bigint")
    return counted.agg(
        F.count_if((F.col("before") <= 1) & (F.col("before") + F.col("own") > 1)).alias("duplicate_key"),
        total(null_key).alias("null_key"), total(uncovered).alias("uncovered_time"),
    )


def _orphan_changes(store: Store, batch: int) -> DataFrame:
    """Series that have values and no registration since this batch, less those it has registered.

    Which series have values is seen from the newest rows kept beside the batches.
    """
    has_values = store.newest(before=batch).where("timeseries is not null").select("timeseries").distinct()
    own_values = store.log("data", only=batch).where("timeseries is not null").select("timeseries").distinct()
    own_labels = store.log("registry", only=batch).select("timeseries").distinct()
    # A row for each series the batch touches; of the registry before, only their ids are looked up.
    touched = own_values.withColumn("v", F.lit(1)).join(own_labels.withColumn("l", F.lit(1)), "timeseries", "full")
    ids = store.registry(before=batch).select("timeseries").join(touched.select("timeseries"), "timeseries", "left_semi").distinct()
    seen = touched.join(has_values.withColumn("hv", F.lit(1)), "timeseries", "left").join(ids.withColumn("hl", F.lit(1)), "timeseries", "left")
    v, label, had_v, had_l = (F.col(c).isNotNull() for c in ("v", "l", "hv", "hl"))
    was = had_v & ~had_l
    now = (had_v | v) & ~(had_l | label)
    return seen.agg((F.count_if(now) - F.count_if(was)).alias("orphan_series"))


def _label_changes(store: Store, batch: int) -> DataFrame:
    """Label tuples that become ambiguous; only the key buckets of the batch's own tuples are read."""
    own = registry.labels_met(store.log("registry", only=batch))
    older = registry.labels_met(store.registry(before=batch, buckets=registry.buckets_of(own)))
    tuples = own.select(*registry.MET_KEY).distinct()
    same = keys_equal("o", "t", registry.MET_KEY, registry.MET_KEY)
    both = own.withColumn("old", F.lit(0)).unionByName(older.alias("o").join(tuples.alias("t"), same, "left_semi").withColumn("old", F.lit(1)))
    sizes = both.groupBy(*registry.MET_KEY).agg(F.sum("old").alias("before"), F.count(F.lit(1)).alias("after"))
    return sizes.agg(F.count_if((F.col("before") <= 1) & (F.col("after") > 1)).alias("ambiguous_label"))


def audit_batch(store: Store, batch: int) -> DataFrame:
    """By how much a batch changes each number of `bulk_load.audit_store`: `(audit, n)`.

    Added to the audit of the batches before, it gives the audit of all up to this one. Read are the batch itself, the
    older values of its months, the registry in its key buckets and the ids of the series it touches.
    """
    session.prepare(store.spark)
    # Labels and series are one table here, so no label lacks its series.
    rejected = store.log("rejects", only=batch).agg(F.count(F.lit(1)).alias("rejected"), F.lit(0).alias("orphan_label"))
    parts = []
    for changes in (_value_changes(store, batch), _orphan_changes(store, batch), _label_changes(store, batch), rejected):
        pairs = F.array(*[F.struct(F.lit(c).alias("audit"), F.col(c).cast("bigint").alias("n")) for c in changes.columns])
        parts.append(changes.select(F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def added(*audits: DataFrame) -> DataFrame:
    """Audits or their changes, summed up."""
    return reduce(DataFrame.unionByName, audits).groupBy("audit").agg(F.sum("n").alias("n"))
