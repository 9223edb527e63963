"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skyseries.llm.frames import Written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b, both bigint); the component is its smallest node.

    Each step hangs neighbours below the smallest one in sight, so a chain of length n is flat after about log n steps.
    Steps are written to the shared folder: nothing is computed twice and lost executors cost one step. Smallest
    neighbours are found with partial aggregates, so a node with very many neighbours is no bottleneck.
    """
    written = Written(edges.sparkSession, "components")
    now, state = _put(written, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while state != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after, state = _put(written, small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        written.drop(now)
        now = after
    own = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own.select("node", F.col("node").alias("component")))


def _put(written: Written, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells whether a step has changed them, observed on the way."""
    mixed, seen = F.xxhash64("u", "v"), Observation()
    sums = [F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright(mixed, 32)).alias("high")]
    out = written.put(edges.observe(seen, F.count(F.lit(1)).alias("n"), *sums))
    return out, (seen.get["n"], seen.get["low"], seen.get["high"])
