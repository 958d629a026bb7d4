"""Too-late events: those far behind the latest event seen before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.times import epoch_seconds


def running_max_before(rows: DataFrame, value: str, order: str, scope: list[str], out: str, chunk: int = 100_000) -> DataFrame:
    """``out``: the greatest ``value`` among the rows of the same scope before this one in ``order`` (a unique long), else null.

    A prefix maximum in two levels, so that one long scope does not become one long task: rows are windowed within
    chunks of ``chunk`` positions of ``order``, and only one row for each chunk is windowed over the whole scope.
    """
    piece = rows.withColumn("_chunk", F.floor(F.col(order) / chunk))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = before.partitionBy(*scope) if scope else before
    tops = piece.groupBy(*scope, "_chunk").agg(F.max(value).alias("_top"))
    tops = tops.select(*scope, "_chunk", F.max("_top").over(before).alias("_earlier"))
    inside = Window.partitionBy(*scope, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = piece.withColumn("_within", F.max(value).over(inside)).join(tops, [*scope, "_chunk"])
    return joined.withColumn(out, F.greatest("_earlier", "_within")).drop("_chunk", "_earlier", "_within")


def too_late_reject(event_time: Column, latest: Column, settings: Settings) -> Column:
    """struct(motivo, detalle) of an event before ``latest`` minus the horizon; exactly at the horizon passes."""
    beyond = epoch_seconds(latest) - settings.late_horizon_seconds - epoch_seconds(event_time)
    detail = F.concat(F.format_string("%.0f", beyond), F.lit("s más allá del horizonte"))
    return F.when(beyond > 0, F.struct(F.lit("demasiado_tardio").alias("motivo"), detail.alias("detalle")))


def mark_too_late(validated: DataFrame, settings: Settings, scope: list[str] | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """``validated`` with a reject for events that are too late in their scope (by default the source partition).

    Rejected rows lie below the running maximum, so the maximum over all valid, plausible rows is that of the accepted.
    ``earlier`` (the scope's columns, latest) holds the latest accepted event times of what came before these rows.
    """
    scope = ["partition"] if scope is None else scope
    plausible = F.when(F.col("reject").isNull(), F.col("sale.event_time"))
    seen = running_max_before(validated.withColumn("_event_time", plausible), "_event_time", "arrival", scope, "_latest")
    if earlier is not None:
        known = earlier.select(*scope, F.col("latest").alias("_known"))
        seen = seen.join(known, scope, "left").withColumn("_latest", F.greatest("_latest", "_known")).drop("_known")
    late = F.when(F.col("reject").isNull(), too_late_reject(F.col("sale.event_time"), F.col("_latest"), settings))
    return seen.withColumn("reject", F.coalesce("reject", late)).drop("_event_time", "_latest")
