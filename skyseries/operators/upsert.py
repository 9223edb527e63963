"""Insert-or-overwrite as an aggregate: the last write of a key wins as a whole row."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyseries.operators.skew import keys_equal

VALUE_KEY = ["timeseries", "obstime"]


def packed_order(high: Column, *low: Column) -> Column:
    """One number that orders like its parts, the first one first.

    ``high`` is any BIGINT; the others are from 0 and have 18 digits together, in equal shares. As a number of fixed
    width it is compared inside a hash aggregate, where a struct would be sorted.
    """
    digits = 18 // max(1, len(low))
    order = high.cast("decimal(38,0)") * F.lit(Decimal(10) ** (digits * len(low)))
    for place, part in enumerate(reversed(low)):
        order = order + part.cast("decimal(38,0)") * F.lit(Decimal(10) ** (digits * place))
    return order.cast("decimal(38,0)")


_FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _fixed_width(df: DataFrame, columns) -> bool:
    kinds = dict(df.dtypes)
    return all(kinds[c] in _FIXED or kinds[c].startswith("decimal") for c in columns)


def packed_pair(high: Column, low: Column) -> Column:
    """Two BIGINT from 0 as one number that orders like the pair."""
    return (high.cast("decimal(38,0)") * F.lit(Decimal(10) ** 19) + low.cast("decimal(38,0)")).cast("decimal(38,0)")


def _whole_numbers(df: DataFrame, columns) -> bool:
    return all(dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for c in columns)


def latest_wins(writes: DataFrame, keys, order, payload, unique: bool = False) -> DataFrame:
    """Keep, per key, the payload of the write that is last in ``order`` (columns that are never NULL, or an expression).

    A NULL payload of the last write wins over older values. A payload of fixed width is aggregated by hash, collapsed per
    task before the shuffle. Of a wider one, such as texts, a hash aggregate finds only when the last write of each key
    was, and the payload is fetched by that once; of several writes in one place the larger of the further order columns
    wins, then a hash of the payload. ``unique`` says that the order never ties, which saves looking. There are about as many
    last writes as writes, so these are joined by shuffle, however small the planner takes them for.
    """
    columns = [order] if isinstance(order, str) else [] if isinstance(order, Column) else list(order)
    if len(columns) > 1 and _whole_numbers(writes, columns[:2]):
        lead, rest = packed_pair(*[F.col(c).cast("bigint") for c in columns[:2]]), columns[2:]
    else:
        lead, rest = order if isinstance(order, Column) else F.col(columns[0]), columns[1:]
    ranked = writes.select(*keys, *[c for c in (*payload, *rest) if c not in keys], lead.alias("_lead"))
    if not rest and _fixed_width(ranked, ["_lead", *payload]):
        return ranked.groupBy(*keys).agg(*[F.max_by(c, "_lead").alias(c) for c in payload])
    last = ranked.groupBy(*keys).agg(F.max("_lead").alias("_lead")).hint("merge")
    on = [*keys, "_lead"]
    found = ranked.alias("w").join(last.alias("l"), keys_equal("w", "l", on, keys), "left_semi")
    if unique:
        return found.select(*keys, *payload)
    one = Window.partitionBy(*on).orderBy(*[F.desc(c) for c in rest], F.xxhash64(*payload), *payload)
    return found.withColumn("_place", F.row_number().over(one)).where(F.col("_place") == 1).select(*keys, *payload)


def route_values(observations: DataFrame):
    """Split typed observations into the number table and the text table."""
    common = [c for c in observations.columns if c not in ("value_num", "value_text", "is_scalar")]
    scalar = observations.where("is_scalar").select(*common, F.col("value_num").alias("obsvalue"))
    text = observations.where("not is_scalar").select(*common, F.col("value_text").alias("obsvalue"))
    return scalar, text
