"""One batch of quality-control messages, from XML to the flag table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries import session
from skyseries.operators import access
from skyseries.operators.qc import PAYLOAD, checked_documents, decode_checked
from skyseries.operators.registry import MET_KEY, NULLABLE, buckets_of, labels_met, resolve_met
from skyseries.operators.skew import keys_equal
from skyseries.operators.upsert import VALUE_KEY, latest_wins
from skyseries.plans.ingest import SideTables
from skyseries.sources.store import Store

ORDER = ["arrival", "message_seq", "doc_pos"]
CLOSED = "CLOSED_SERIES"
# A registry of so many series is read whole.
FEW_SERIES = 1_000_000


def released(store: Store, batch: int, seen: int, newest: int) -> DataFrame:
    """Records of earlier batches whose series was registered after registry batch ``seen``."""
    older = store.log("quarantine", before=batch).drop("batch")
    if newest <= seen:
        return older.limit(0)
    # What was registered since; the batches before are not read.
    new = labels_met(store.registry().where(F.col("batch") > seen)).select(*MET_KEY).distinct()
    return older.alias("q").join(new.alias("r"), keys_equal("q", "r", MET_KEY, NULLABLE), "left_semi")


def closed_records(misses: DataFrame, side: SideTables | None) -> DataFrame:
    """``misses`` with `closed`: no permit opens the series, so it will never be registered."""
    if side is None:
        return misses.withColumn("closed", F.lit(False))
    flags = access.open_flags(misses.select(*access.KEY).distinct(), side.param_permits, side.station_permits)
    return misses.join(flags, access.KEY, "left").withColumn("closed", ~F.coalesce("is_open", F.lit(False))).drop("is_open")


def qc_batch(store: Store, messages: DataFrame, batch: int, side: SideTables | None = None, retry: bool = True,
             sliced: bool = False) -> None:
    """Decode, resolve and store one batch of `(message_seq, value)`; safe to repeat.

    Records whose series is unknown are kept aside, once, and taken up by the first batch after their series was
    registered, unless ``retry`` is off. With ``side``, records of series that no permit opens are rejected instead of
    waiting. A record counts from the batch it arrived with: one that waited never overwrites a later one.
    """
    session.prepare(store.spark)
    # What the registry holds now is what this batch sees, and says so.
    newest = max(store.batches("registry"), default=-1)
    seen = store.seen_registry(before=batch)
    arrival = F.lit(batch).cast("bigint")
    with session.broadcasts_measured(store.spark), session.staged(checked_documents(messages), "documents") as checked:
        decoded = decode_checked(checked)
        records = decoded.records.withColumn("arrival", arrival)
        older = released(store, batch, seen, newest) if retry else records.limit(0)
        both = records.unionByName(older.select(*records.columns))
        # Finding the buckets takes a pass over the records, which a small registry is not worth.
        buckets = buckets_of(both) if store.top_id() > FEW_SERIES else None
        resolved = resolve_met(both, store.labels_met(buckets), sliced, stored=True)
        with session.staged(resolved, "resolved") as resolved:
            misses = closed_records(resolved.where(F.col("timeseries").isNull() & (F.col("arrival") == arrival)), side)
            null = F.lit(None).cast("int")
            unplaced = {"row_no": null, "col_no": null, "retry": F.lit(False)}
            series = F.concat_ws("/", "station_id", "type_id", "param_id")
            closed = misses.where("closed").select("message_seq", F.lit(CLOSED).alias("code"), series.alias("detail"))
            store.write_all({
                "qc_flags": latest_wins(resolved.where(F.col("timeseries").isNotNull()), VALUE_KEY, ORDER, [*PAYLOAD, "arrival"]),
                "quarantine": misses.where(~F.col("closed") & F.lit(retry)),
                "qc_rejects": decoded.rejects.unionByName(closed).withColumns(unplaced),
                "qc_state": store.spark.range(1).select(F.lit(newest).cast("bigint").alias("registry_batch")),
            }, batch)
