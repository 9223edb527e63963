"""Message sources, as a batch or as a stream, in the columns the decoders read.

`message_seq` orders the messages of a batch and comes from the source itself: all digits of a file's name in their order,
or its time of change where that gives no number, or partition and offset of a topic. It should be unique;
`repeated_messages` shows where it is not.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyseries.operators.integrity import duplicate_keys

# The file stream needs the schema given; the whole file is one message.
TEXT_SCHEMA = "value STRING"
# Records of one millisecond are told apart by so many bits; the rest of a number holds milliseconds until 2039.
TIE_BITS = 22


def _numbered(files: DataFrame, column: str) -> DataFrame:
    digits = F.regexp_replace(F.col("_metadata.file_name"), "[^0-9]", "").try_cast("bigint")
    changed = F.unix_micros("_metadata.file_modification_time")
    return files.select(F.coalesce(digits, changed).alias("message_seq"), F.col("value").alias(column))


def repeated_messages(messages: DataFrame) -> DataFrame:
    """Numbers that several messages have, with how many."""
    return duplicate_keys(messages, ["message_seq"])


def spread(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """Deal messages out over ``parts`` tasks, by default one per core.

    Decoding costs far more than moving the text; a source of few partitions, such as a two-part topic, needs it.
    """
    return messages.repartition(parts or messages.sparkSession.sparkContext.defaultParallelism, "message_seq")


def read_message_files(spark: SparkSession, path: str, column: str = "msg") -> DataFrame:
    """One message per text file; ``column`` is `msg` for observations, `value` for quality control."""
    return _numbered(spark.read.text(path, wholetext=True), column)


def stream_message_files(spark: SparkSession, path: str, column: str = "msg", files_per_batch: int = 10_000):
    """As `read_message_files`, for files that keep arriving."""
    files = (
        spark.readStream.format("text").schema(TEXT_SCHEMA)
        .option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return _numbered(files, column)


def kafka_options(brokers, topic: str, partitions=(0, 1), max_offsets: int | None = None) -> dict:
    """Options of a topic read from the earliest offset; later positions come from the checkpoint."""
    assigned = ",".join(str(int(p)) for p in partitions)
    options = {
        "kafka.bootstrap.servers": ",".join(brokers),
        "assign": f'{{"{topic}":[{assigned}]}}',
        "startingOffsets": "earliest",
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def stream_topic(spark: SparkSession, brokers, topic: str, partitions=(0, 1), column="value", max_offsets=None):
    """Messages of a topic, spread over all cores. Needs Spark's Kafka package on the class path."""
    options = kafka_options(brokers, topic, partitions, max_offsets)
    return spread(from_topic(spark.readStream.format("kafka").options(**options).load(), len(partitions), column))


def from_topic(records: DataFrame, n_partitions: int, column: str = "value") -> DataFrame:
    """Topic records `(partition, offset, value)` to messages, in the order of their arrival if they carry a `timestamp`.

    The number is then made of the millisecond and, within one, of offset and partition; without times the offsets of
    the partitions interleave. A value that is no UTF-8 text becomes NULL, which the decoder rejects.
    """
    seq = F.col("offset") * n_partitions + F.col("partition")
    if "timestamp" in records.columns:
        inside = F.pmod(seq, F.lit(1 << TIE_BITS))
        seq = F.coalesce(F.shiftleft(F.unix_millis(F.col("timestamp").cast("timestamp")), TIE_BITS) + inside, seq)
    return records.select(
        seq.cast("bigint").alias("message_seq"), F.try_validate_utf8(F.col("value").cast("string")).alias(column)
    )
