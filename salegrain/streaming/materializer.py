"""The materializer: a log that carries results and rejects, merged into the keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.state import latest_per_key
from ..sources.records import route
from .keyed_table import MergedLog, RejectTable, ResultTable

#: Topics as (name of the setting, partitions, configuration): sales by store, results compacted by key, rejects; fixed values.
TOPICS = (
    ("sales_topic", 4, {"retention.ms": 86_400_000}),
    ("aggregates_topic", 4, {"cleanup.policy": "compact"}),
    ("dlq_topic", 2, {"retention.ms": 604_800_000}),
)


def topic_commands(settings: Settings) -> list[str]:
    """The commands that make the topics with Kafka's own command-line tool."""
    made = f"kafka-topics.sh --bootstrap-server {settings.kafka_bootstrap_servers} --create --if-not-exists"
    config = lambda options: " ".join(f"--config {name}={value}" for name, value in options.items())
    return [f"{made} --topic {getattr(settings, name)} --partitions {n} {config(options)}" for name, n, options in TOPICS]


def partition_of(topic: str, settings: Settings, key: Column) -> Column:
    """The partition that a key goes to, by the topic's number of partitions."""
    numbers = {getattr(settings, name): n for name, n, _ in TOPICS}
    return F.pmod(F.crc32(key.cast("binary")), F.lit(numbers[topic])).cast("int")

PANE_JSON = (
    "aggregate_id string, store_id string, window_start string, window_end string, pane_index bigint, pane_timing string, is_first boolean, is_last boolean, "
    "ticket_count bigint, total_amount_gs bigint, items bigint, avg_ticket_gs bigint, by_payment_gs map<string,bigint>, duplicates_discarded bigint, emitted_at string"
)
REJECT_JSON = "motivo string, detalle string, key string, rechazado_en string, mensaje_original string, event_id string, event_time string, amount_gs bigint"


def read_topic_folders(spark: SparkSession, settings: Settings, path: str, most: int | None = None) -> DataFrame:
    """A stream over folders of keyed JSON records below ``path``, named by the topics of results and rejects.

    Partitions go by key, offsets by the file's time and the line's number in it; ``most``: files of a micro-batch.
    """
    # a folder that nothing was sent to yet is an empty one
    for topic in (settings.aggregates_topic, settings.dlq_topic):
        spark.createDataFrame([], "key string, value string, line long").write.mode("append").json(f"{path}/{topic}")
    files = spark.readStream.schema("key string, value string, line long").option("maxFilesPerTrigger", most or 1000).json(f"{path}/*/")
    topic = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    written = F.unix_millis("_metadata.file_modification_time")
    rows = files.select(topic.alias("topic"), "key", "value", (written * 1_000_000 + F.col("line")).alias("arrival"))
    partition = F.coalesce(*[F.when(F.col("topic") == t, partition_of(t, settings, F.col("key"))) for t in (settings.aggregates_topic, settings.dlq_topic)])
    return rows.select("topic", "key", "value", partition.alias("partition"), "arrival")


def pane_messages(aggregates: DataFrame) -> DataFrame:
    """Result rows of messages (value, partition, arrival); payments become sorted JSON text."""
    parsed = aggregates.select(F.from_json(F.col("value").cast("string"), PANE_JSON).alias("p"), "partition", "arrival")
    paid = F.transform(F.array_sort(F.map_entries("p.by_payment_gs")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"].cast("string")))
    names = [column.split()[0] for column in PANE_JSON.split(", ")]
    columns = [F.concat(F.lit("{"), F.array_join(paid, ","), F.lit("}")).alias(n) if n == "by_payment_gs" else F.col(f"p.{n}").alias(n) for n in names]
    return parsed.select(*columns, F.col("arrival"))


def reject_messages(rejects: DataFrame) -> DataFrame:
    parsed = rejects.select(F.from_json(F.col("value").cast("string"), REJECT_JSON).alias("r"), "partition", "arrival")
    return parsed.select("r.*", "partition", "arrival")


class Materializer:
    """Tables below a path: results, rejects, offsets and counters. ``take`` is a ``foreachBatch`` function.

    A batch's offsets and counts are written after its results, so a batch that fails is taken again as a whole, and
    one that is taken twice changes nothing: at least once delivery, exactly once effect.
    """

    def __init__(self, spark: SparkSession, settings: Settings, path: str):
        self.settings = settings
        self.results, self.rejects = ResultTable(spark, f"{path}/results"), RejectTable(spark, f"{path}/rejects")
        self.places = MergedLog(spark, f"{path}/offsets", lambda rows: latest_per_key(rows, ["topic", "partition"], ["batch", "offset"]))
        self.counters = MergedLog(spark, f"{path}/counters", lambda rows: rows.groupBy("outcome").agg(F.sum("n").alias("n")))

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Messages with topic, value, partition and arrival (the offset)."""
        batch.persist()
        aggregates, dead, unreadable = route(batch, self.settings)
        self.results.append(pane_messages(aggregates), batch_id)
        self.rejects.append(reject_messages(dead), batch_id)
        places = batch.select("topic", "partition", F.col("arrival").alias("offset"), F.lit(batch_id).cast("long").alias("batch"))
        self.places.append(latest_per_key(places, ["topic", "partition"], ["batch", "offset"]), batch_id)
        kinds = {"upsert": aggregates, "rechazo": dead, "ilegible": unreadable}
        counts = [part.groupBy(F.lit(kind).alias("outcome")).agg(F.count("*").alias("n")) for kind, part in kinds.items()]
        self.counters.append(counts[0].unionByName(counts[1]).unionByName(counts[2]), batch_id)
        batch.unpersist()

    def offsets(self) -> DataFrame | None:
        """The last offset taken of each (topic, partition)."""
        rows = self.places.read()
        return None if rows is None else rows.drop("batch")

    def outcomes(self) -> DataFrame | None:
        """Messages by outcome, over all batches."""
        return self.counters.read()

    def start(self, messages: DataFrame, path: str, **trigger):
        trigger = trigger or {"processingTime": f"{self.settings.early_firing_seconds} seconds"}
        return messages.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger).foreachBatch(self.take).start()
