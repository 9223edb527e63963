"""The two permit tables, from a database or from a snapshot."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_permits_jdbc(spark: SparkSession, url: str, param_table: str, station_table: str, properties: dict | None = None):
    """`(param_permits, station_permits)` as they stand in the database now.

    The tables or views have the columns `stationid, message_formatid, paramid, permitid` and `stationid, permitid`.
    """
    def table(name):
        return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**(properties or {})).load()

    return param_permits(table(param_table)), station_permits(table(station_table))


def read_permits_parquet(spark: SparkSession, param_path: str, station_path: str):
    """The same from snapshots with the database's column names, the first with an optional `ord`."""
    return param_permits(spark.read.parquet(param_path)), station_permits(spark.read.parquet(station_path))


def param_permits(rows: DataFrame) -> DataFrame:
    """The database gives no order among the permits of a station; without `ord` they all tie."""
    order = F.col("ord") if "ord" in rows.columns else F.lit(0)
    return rows.select(
        F.col("stationid").cast("int").alias("station_id"),
        F.col("message_formatid").cast("int").alias("type_id"),
        F.col("paramid").cast("int").alias("param_id"),
        F.col("permitid").cast("int").alias("permit_id"),
        order.cast("int").alias("ord"),
    )


def station_permits(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("stationid").cast("int").alias("station_id"), F.col("permitid").cast("int").alias("permit_id"))
