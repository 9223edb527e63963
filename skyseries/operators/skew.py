"""Joins and groupings that hold when one key owns a large share of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where keys are sliced, those with more fact rows than this are spread over several tasks.
ROWS_PER_TASK = 5_000_000


def keys_equal(left: str, right: str, on, null_safe=()) -> Column:
    """Equality of the named columns of two aliased frames; NULL equals NULL for ``null_safe`` ones."""
    tests = []
    for name in on:
        a, b = F.col(f"{left}.{name}"), F.col(f"{right}.{name}")
        tests.append(a.eqNullSafe(b) if name in null_safe else a == b)
    return reduce(lambda a, b: a & b, tests)


def lookup_join(facts, lookup, on, how="left", null_safe=(), sliced: bool = False, rows_per_task=ROWS_PER_TASK,
                shuffled: bool = False):
    """Join many fact rows to a lookup frame that has at most one row per key.

    The planner chooses by the bytes it sees, before and while the query runs: a small lookup side is broadcast, a larger
    one is joined by shuffle, and tasks that turn out large are split. ``sliced`` does the splitting beforehand, for
    plans in which that cannot be done at run time: every key with more than ``rows_per_task`` fact rows is cut into
    slices, by a hash of the fact row and the partition it stands in, so that equal rows part as well; its lookup row is
    repeated once per slice. ``how`` is inner, left, left_semi or left_anti. ``shuffled`` joins by shuffle in any case: for
    lookup frames whose size the planner takes for far smaller than it is, such as those that were exploded.
    """
    extra = [c for c in lookup.columns if c not in on]
    if how in ("left_semi", "left_anti"):
        extra = []
    kept = [F.col(f"f.{c}") for c in facts.columns] + [F.col(f"l.{c}") for c in extra]
    if shuffled:
        lookup = lookup.hint("merge")
    if not sliced:
        return facts.alias("f").join(lookup.alias("l"), keys_equal("f", "l", on, null_safe), how).select(*kept)

    # At most one heavy key per rows_per_task facts.
    heavy = (
        facts.groupBy(*on)
        .count()
        .where(F.col("count") > rows_per_task)
        .select(*on, F.ceil(F.col("count") / rows_per_task).cast("int").alias("slices"))
    )

    def with_slices(df):
        matched = df.alias("d").join(heavy.alias("h"), keys_equal("d", "h", on, on), "left")
        return matched.select("d.*", F.coalesce("h.slices", F.lit(1)).alias("slices"))

    place = F.xxhash64(*facts.columns, "standing")
    sliced_facts = with_slices(facts.withColumn("standing", F.spark_partition_id())).withColumn(
        "slice", F.pmod(place, F.col("slices")).cast("int")
    )
    sliced_lookup = with_slices(lookup).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )
    if shuffled:
        sliced_lookup = sliced_lookup.hint("merge")
    joined = sliced_facts.alias("f").join(
        sliced_lookup.alias("l"), keys_equal("f", "l", [*on, "slice"], null_safe), how
    )
    return joined.select(*kept)


def part_numbers(df: DataFrame, group, block, max_rows: int) -> DataFrame:
    """``group``, ``block``, `part_no`, `n_parts`: whole neighbouring blocks share a part until it has ``max_rows`` rows.

    Only the sizes of the blocks meet per group.
    """
    sizes = df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.withColumn("part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / max_rows).cast("int"))
    # Numbers without gaps, where one block fills several parts.
    dense = numbered.withColumn("part_no", (F.dense_rank().over(whole.orderBy("part")) - 1).cast("int"))
    return dense.select(*group, block, "part_no", (F.max("part_no").over(whole) + 1).alias("n_parts"))


def collect_parts(df: DataFrame, group, block, element: Column, max_rows: int, numbers: DataFrame | None = None) -> DataFrame:
    """Sorted arrays of ``element`` per group, in numbered parts: ``group``, `part_no`, `n_parts`, `rows`.

    ``block`` names a column that cuts a group into pieces of bounded size, in output order; a part stays below
    ``max_rows`` plus one block. The numbers are made from the sizes of the blocks, so the rows are shuffled once, to
    their parts. Elements of a part are sorted, and begin with what orders the blocks. ``numbers`` may be given.
    """
    keys = [*group, block]
    df = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    numbers = part_numbers(df, group, block, max_rows) if numbers is None else numbers
    placed = df.select(*keys, element.alias("element")).join(numbers, keys)
    return placed.groupBy(*group, "part_no", "n_parts").agg(F.sort_array(F.collect_list("element")).alias("rows"))
