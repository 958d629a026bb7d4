"""Contract and clock checks over raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import contract
from ..functions.times import epoch_seconds

#: Columns a raw record needs: key and value (bytes or text), source partition, arrival order in it, and arrival time.
RECORD_COLUMNS = ("key", "value", "partition", "arrival", "arrival_time")


def clock_reject(event_time: Column, now: Column, settings: Settings) -> Column:
    """struct(motivo, detalle) of an event too far ahead of or behind ``now``; exactly at a limit passes."""
    ahead = epoch_seconds(event_time) - epoch_seconds(now)
    seconds = lambda x, word: F.concat(F.format_string("%.0f", x), F.lit(f"s {word}"))
    return F.when(
        ahead > settings.max_future_skew_seconds, F.struct(F.lit("reloj_futuro").alias("motivo"), seconds(ahead, "adelantado").alias("detalle"))
    ).when(ahead < -settings.max_past_skew_seconds, F.struct(F.lit("reloj_pasado").alias("motivo"), seconds(-ahead, "atrasado").alias("detalle")))


def validate(records: DataFrame, settings: Settings) -> DataFrame:
    """Records with ``sale`` (the typed event, null where the contract is broken) and ``reject`` (motivo, detalle; null where valid).

    Each step is a one-row ``inline`` into flat columns: projections that Catalyst may not merge, so that a value is parsed
    once, and checked once, however many columns are read from the result.
    """
    raw = F.struct(F.col("key").alias("key"), F.col("value").alias("value")).alias("raw")
    place = ["raw", "partition", "arrival", "arrival_time"]
    parsed = records.select(raw, "partition", "arrival", "arrival_time", F.inline(F.array(F.struct(contract.parsed(F.col("value")).alias("v")))))
    judged = parsed.select(*place, "v", F.inline(F.array(contract.reject(F.col("v")))))
    valid = F.col("motivo").isNull()
    typed = judged.select(*place, "motivo", "detalle", F.inline(F.array(F.when(valid, contract.sale(F.col("v"))))))
    fields = [name for name in typed.columns if name not in (*place, "motivo", "detalle")]
    broken = F.when(~valid, F.struct("motivo", "detalle"))
    clock = F.when(valid, clock_reject(F.col("event_time"), F.col("arrival_time"), settings))
    return typed.select(*place, F.when(valid, F.struct(*fields)).alias("sale"), F.coalesce(broken, clock).alias("reject"))
