"""Raw records: JSON Lines files as a table or a stream, and Kafka where its connector is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings

JSONL_SCHEMA = "etiqueta string, key string, timestamp_ms long, headers map<string, string>, value string, partition int, offset long, arrival_time timestamp"
#: Seconds that "now" lies after the latest record of a file.
NOW_MARGIN_SECONDS = 5


def read_jsonl(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Records of JSON Lines files, with the file and block that each came from. At most the first ``most`` lines by file, if asked.

    Lines may lack partition, offset and arrival_time; ``with_arrival`` fills them in.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = spark.read.schema(JSONL_SCHEMA).json(path).select("*", *split).where("value is not null")
    if most is None:
        return rows
    return _in_file_order(rows).orderBy("_line").limit(most).drop("_line")


def _in_file_order(rows: DataFrame) -> DataFrame:
    """``_line``: rises with file name, place of the block in its file, and line in the block.

    Spark deals files to its tasks by size, so its row numbers alone do not follow the files' order. There is one row
    for each block in the window, whatever the size of the files.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id() % (1 << 33))
    blocks = rows.select("_file", "_block").distinct().withColumn("_at", F.row_number().over(Window.orderBy("_file", "_block")).cast("long"))
    return numbered.join(blocks, ["_file", "_block"]).withColumn("_line", F.col("_at") * (1 << 33) + F.col("_row")).drop("_row", "_at")


def stream_jsonl(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(JSONL_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path).where("value is not null")


def reference_now(records: DataFrame) -> DataFrame:
    """One row with ``now``: the greatest record time and five seconds, so that clock checks of a file can be repeated."""
    latest = F.coalesce(F.max("timestamp_ms"), F.lit(0))
    return records.agg(F.timestamp_millis(latest + NOW_MARGIN_SECONDS * 1000).alias("now"))


def with_arrival(records: DataFrame, now) -> DataFrame:
    """key, value, partition, arrival and arrival_time of records; ``now`` stands in for missing arrival times.

    Records without an offset arrive in the order of their files' names and lines; in a stream, which has no row numbers, in
    the order of their times.
    """
    if {"_file", "_block"} <= set(records.columns):
        records, order = _in_file_order(records), F.col("_line")
    else:
        order = F.col("timestamp_ms")
    return records.select(
        F.col("key"),
        F.col("value"),
        F.coalesce("partition", F.lit(0)).alias("partition"),
        F.coalesce(F.col("offset"), order).alias("arrival"),
        F.coalesce(F.col("arrival_time"), F.lit(now)).alias("arrival_time"),
    )


def kafka_options(settings: Settings, topics: list[str], starting: str = "earliest", ending: str | None = None, max_per_trigger: int | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": settings.kafka_bootstrap_servers, "subscribe": ",".join(topics), "startingOffsets": starting}
    if ending:
        options["endingOffsets"] = ending
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def kafka_records(rows: DataFrame) -> DataFrame:
    """The columns of Spark's Kafka source as records; the record's time is the producer's create time."""
    return rows.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        "value",
        "partition",
        F.col("offset").alias("arrival"),
        F.current_timestamp().alias("arrival_time"),
        F.unix_millis("timestamp").alias("timestamp_ms"),
    )


def read_kafka(spark: SparkSession, settings: Settings, topics: list[str], ending: str = "latest") -> DataFrame:
    """A bounded read; the session needs Spark's Kafka connector."""
    return kafka_records(spark.read.format("kafka").options(**kafka_options(settings, topics, ending=ending)).load())


def stream_kafka(spark: SparkSession, settings: Settings, topics: list[str], max_per_trigger: int | None = None) -> DataFrame:
    """An unbounded read; the session needs Spark's Kafka connector."""
    return kafka_records(spark.readStream.format("kafka").options(**kafka_options(settings, topics, max_per_trigger=max_per_trigger)).load())


def route(messages: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aggregates, rejects, unreadable) of a log that carries both output topics; unreadable values are no JSON object."""
    parsed = F.try_parse_json(F.try_validate_utf8(F.col("value").cast("string")))
    readable = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    marked = messages.withColumn("_readable", readable)
    pick = lambda condition: marked.where(condition).drop("_readable")
    aggregates, dlq = F.col("topic") == settings.aggregates_topic, F.col("topic") == settings.dlq_topic
    return pick(F.col("_readable") & aggregates), pick(F.col("_readable") & dlq), pick(~F.col("_readable"))
