"""The reusable core without input or output: records to results, invalid records and too-late ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.times import iso_utc
from ..operators.aggregate import sales_per_window
from ..operators.lateness import mark_too_late
from ..operators.validate import validate

LATE_REASON = "demasiado_tardio"


@dataclass(frozen=True)
class Core:
    """Accepted sales, final results, and all rejects as they go to the dead-letter log; lazy, over one judged table."""

    accepted: DataFrame
    results: DataFrame
    rejected: DataFrame

    @property
    def invalid(self) -> DataFrame:
        return self.rejected.where(F.col("motivo") != LATE_REASON)

    @property
    def very_late(self) -> DataFrame:
        return self.rejected.where(F.col("motivo") == LATE_REASON)

    def rejects(self) -> DataFrame:
        return self.rejected


def accepted_sales(judged: DataFrame) -> DataFrame:
    """The columns that results need of accepted rows; the raw message stays behind before any shuffle."""
    sale = [F.col(f"sale.{name}").alias(name) for name in ("key", "event_id", "event_time", "amount_gs", "items", "payment", "channel", "version_in")]
    return judged.where("reject is null").select(*sale, "partition", "arrival", "arrival_time")


def reject_rows(judged: DataFrame) -> DataFrame:
    """motivo, detalle, key, rechazado_en, mensaje_original, event fields where the contract held, and the record's place."""
    return judged.where("reject is not null").select(
        "reject.motivo",
        "reject.detalle",
        F.col("raw.key").cast("string").alias("key"),
        iso_utc(F.col("arrival_time")).alias("rechazado_en"),
        F.make_valid_utf8(F.col("raw.value").cast("string")).alias("mensaje_original"),
        F.col("sale.event_id").alias("event_id"),
        F.col("sale.event_time_text").alias("event_time"),
        F.col("sale.amount_gs").alias("amount_gs"),
        "partition",
        "arrival",
    )


def judge(records: DataFrame, settings: Settings, scope: list[str] | None = None) -> DataFrame:
    """Records with typed sale and reject: contract, clocks, lateness, in this order."""
    return mark_too_late(validate(records, settings), settings, scope)


def core_of(judged: DataFrame, settings: Settings) -> Core:
    """The core over judged records. Where several of its tables are used, write ``judged`` first and read it again."""
    accepted = accepted_sales(judged)
    return Core(accepted, sales_per_window(accepted, settings.window_seconds), reject_rows(judged))


def build_core(records: DataFrame, settings: Settings, scope: list[str] | None = None) -> Core:
    """The batch core over records (key, value, partition, arrival, arrival_time)."""
    return core_of(judge(records, settings, scope), settings)
