"""Sales records derived from the ``events`` test table, with duplicates, late rows and broken events in known places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import prepare
from ..functions.times import iso_utc, plus_seconds
from ..operators.lateness import running_max_before

PAYMENT_OF = {"view": "cash", "click": "card", "purchase": "qr", "signup": "transfer", "error": "cripto"}


def sales_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record that arrives: the event's fields, source partition, arrival order and arrival time."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    amount = F.round(F.col("value") * 100).cast("bigint") * 10
    payment: Column = F.element_at(F.create_map(*[F.lit(x) for pair in PAYMENT_OF.items() for x in pair]), F.col("event_type"))
    rows = events.select(
        i.alias("n"),
        ts.alias("ts"),
        F.concat(F.lit("E-"), i.cast("string")).alias("event_id"),
        F.concat(F.lit("S"), (1 + F.col("user_id") % 6).cast("string")).alias("key"),
        F.when(i % 89 == 0, plus_seconds(ts, 600)).when(i % 103 == 0, plus_seconds(ts, -172_800)).otherwise(ts).alias("event_time"),
        F.when(i % 101 == 0, -amount).otherwise(amount).alias("amount_gs"),
        (1 + i % 5).cast("bigint").alias("items"),
        payment.alias("payment"),
        F.when(i % 97 == 0, 99).when(i % 5 == 0, 1).otherwise(2).cast("bigint").alias("version_in"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        (i * 10 + F.when(i % 50 == 7, 303).otherwise(0)).cast("bigint").alias("arrival"),
    )
    resent = rows.where(F.col("n") % 20 == 0).withColumn("arrival", F.col("n") * 10 + 25)
    every = rows.unionByName(resent)
    seen = running_max_before(every, "ts", "arrival", [], "_before")
    return seen.withColumn("arrival_time", plus_seconds(F.greatest("ts", "_before"), 5)).drop("_before")


def sale_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as raw records: key, JSON value, partition, arrival, arrival_time, and ``n``."""
    rows = sales_columns(spark, sf_dir)
    n = F.col("n").cast("string")
    channel = F.when(F.col("version_in") == 2, F.when(F.col("n") % 10 == 3, F.lit("delivery")).otherwise(F.lit("store")))
    payload = F.struct(
        "amount_gs", channel.alias("channel"), "items", "payment", F.lit("pos-01").alias("pos_id"), F.col("key").alias("store_id"), F.concat(F.lit("T-"), n).alias("ticket_id")
    )
    event = F.struct(
        "event_id", iso_utc(F.col("event_time")).alias("event_time"), F.lit("sale.confirmed").alias("event_type"), "key", payload.alias("payload"), F.col("version_in").alias("schema_version")
    )
    return rows.select("key", F.to_json(event).alias("value"), "partition", "arrival", "arrival_time", "n")


def malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each event, spoilt in one of the ways of ``SPOILT`` by its number; the last way is none."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    texts = F.array(*[F.lit(text) for text, _, _ in SPOILT])
    value = F.element_at(texts, (F.col("event_id") % len(SPOILT) + 1).cast("int"))
    return events.select(F.lit("S1").alias("key"), value.alias("value"), F.lit(0).alias("partition"), F.col("event_id").cast("long").alias("arrival"), F.lit(NOON).cast("timestamp").alias("arrival_time"))


NOON = "2026-09-21 12:00:00"
_PAYLOAD = '{"store_id":"S1","pos_id":"p","ticket_id":"t","amount_gs":1000,"items":1,"payment":"qr"}'
_EVENT = '{"schema_version":2,"event_id":"e","event_type":"sale.confirmed","event_time":"2026-09-21T11:59:00.000Z","key":"S1","payload":%s}'
_PLAIN = _EVENT % _PAYLOAD

#: (message, reason, detail): a message for each check of the contract, with what it must say of it; the last one is valid.
SPOILT = (
    ('{"schema_version"', "json_invalido", "invalid JSON or UTF-8"),
    ("[1, 2]", "no_es_objeto", "array<bigint>"),
    ("{}", "campos_faltantes", "schema_version,event_id,event_type,event_time,key,payload"),
    (_PLAIN.replace('"event_id":"e",', ""), "campos_faltantes", "event_id"),
    (_PLAIN.replace('version":2', 'version":"2"'), "version_no_soportada", '"2"'),
    (_PLAIN.replace('version":2', 'version":true'), "version_no_soportada", "true"),
    (_PLAIN.replace("sale.confirmed", "sale.voided"), "event_type_desconocido", "sale.voided"),
    (_PLAIN.replace('"event_id":"e"', '"event_id":""'), "event_id_invalido", '""'),
    (_PLAIN.replace("2026-09-21T11:59:00.000Z", "yesterday"), "event_time_invalido", "yesterday"),
    (_EVENT % '"text"', "payload_invalido", "string"),
    (_EVENT % "{}", "payload_incompleto", "store_id,pos_id,ticket_id,amount_gs,items,payment"),
    (_PLAIN.replace('"key":"S1"', '"key":"S9"'), "clave_inconsistente", "key=S9 store=S1"),
    (_PLAIN.replace("1000", '"1000"'), "monto_invalido", '"1000"'),
    (_PLAIN.replace("1000", "0"), "monto_invalido", "0"),
    (_PLAIN.replace('items":1', 'items":0'), "items_invalido", "0"),
    (_PLAIN.replace('items":1', 'items":1.5'), "items_invalido", "1.5"),
    (_PLAIN.replace('"qr"', '"cripto"'), "metodo_pago_desconocido", "cripto"),
    (_PLAIN, "", ""),
)
