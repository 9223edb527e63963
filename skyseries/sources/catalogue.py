"""The parameter catalogue: code, id, element name, and whether values are numbers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyseries.functions.numbers import strict_int

# A catalogue up to this many codes is put into the query itself.
MAX_CODES = 10_000

CSV_COLUMNS = "id STRING, param_code STRING, element_id STRING, is_scalar STRING"


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Read the CSV, by position and with a header row; a malformed row aborts the read.

    Among repeated codes the last row of the file wins.
    """
    raw = spark.read.schema(CSV_COLUMNS).option("header", True).option("enforceSchema", True).csv(path)
    # Where a row stands: its file, the start of its split, and its place in the split.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return parse_params(raw.select("*", place.alias("place")), "place")


def parse_params(raw: DataFrame, order: str = "id") -> DataFrame:
    """Type the four text columns; of repeated codes the row that is last in ``order`` wins."""
    number = strict_int(F.col("id"))
    bad = number.isNull() | F.col("param_code").isNull() | ~F.coalesce(F.col("is_scalar").isin("t", "f"), F.lit(False))
    complaint = F.concat_ws(",", F.lit("bad catalogue row"), "id", "param_code", "element_id", "is_scalar")
    # As a filter the check stays, whichever columns are used later.
    checked = raw.where(F.when(bad, F.raise_error(complaint).cast("boolean")).otherwise(True))
    row = F.struct(number.alias("id"), "element_id", (F.col("is_scalar") == "t").alias("is_scalar"))
    rank = number if order == "id" else F.col(order)
    last = checked.groupBy("param_code").agg(F.max_by(row, rank).alias("last"))
    return last.select("last.id", "param_code", "last.element_id", "last.is_scalar")


def code_sets(params: DataFrame, limit: int = MAX_CODES):
    """`(scalar codes, text codes)` for `observations.decode`, or None beyond ``limit`` codes."""
    rows = params.select("param_code", "is_scalar").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return (
        sorted(r.param_code for r in rows if r.is_scalar),
        sorted(r.param_code for r in rows if not r.is_scalar),
    )
