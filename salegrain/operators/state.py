"""Versioned results, replay-safe: the last state of each key, and what was applied on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of missing pane fields.
DEFAULTS = {"items": 0, "avg_ticket_gs": 0, "by_payment_gs": "{}", "duplicates_discarded": 0, "pane_index": 0, "pane_timing": "UNKNOWN", "is_last": False, "emitted_at": ""}
#: A result's identity, which later panes never change.
FIXED = ("store_id", "window_start", "window_end")


def version(*then: str) -> Column:
    """Order of a result's versions: more tickets, then a later pane; ties go to the later arrival."""
    return F.struct(F.col("ticket_count"), F.col("pane_index"), *[F.col(name) for name in then])


def with_defaults(panes: DataFrame) -> DataFrame:
    return panes.select(*[F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in panes.columns])


def final_state(panes: DataFrame, key: str = "aggregate_id", order: str = "arrival") -> DataFrame:
    """The winning row of each key: the greatest version, and of equal ones the last to arrive. Replays change nothing."""
    rest = [c for c in panes.columns if c != key]
    best = panes.groupBy(key).agg(F.max_by(F.struct(*rest), version(order)).alias("best"))
    return best.select(key, "best.*")


def panes_received(panes: DataFrame, key: str = "aggregate_id", order: str = "arrival") -> DataFrame:
    """key, panes_recibidos: the first row and every row not older than the version stored when it arrived."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = panes.select(key, order, version().alias("_version"), F.max(version()).over(before).alias("_stored"))
    applied = F.col("_stored").isNull() | (F.col("_version") >= F.col("_stored"))
    return seen.groupBy(key).agg(F.count_if(applied).alias("panes_recibidos"), F.count_if(~applied).alias("panes_ignorados"))


def settle(panes: DataFrame, key: str = "aggregate_id", order: str = "arrival") -> DataFrame:
    """The winning row of each key with panes_recibidos and panes_ignorados: ``final_state`` and ``panes_received`` in one pass."""
    rest = [c for c in panes.columns if c != key]
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = panes.withColumn("_stored", F.max(version()).over(before))
    applied = F.col("_stored").isNull() | (version() >= F.col("_stored"))
    best = F.max_by(F.struct(*rest), version(order)).alias("best")
    found = seen.groupBy(key).agg(best, F.count_if(applied).alias("panes_recibidos"), F.count_if(~applied).alias("panes_ignorados"))
    return found.select(key, "best.*", "panes_recibidos", "panes_ignorados")


def upsert(stored: DataFrame, panes: DataFrame, key: str = "aggregate_id", order: str = "arrival") -> DataFrame:
    """The table after a batch: ``stored`` (with panes_recibidos) full-outer joined with each key's winner of the batch.

    A batch row counts as received where its version is not older than all before it, the stored one first.
    """
    old = stored.select(key, F.struct("ticket_count", "pane_index").alias("_old"), F.col("panes_recibidos").alias("_received"))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = panes.join(old, key, "left").withColumn("_stored", F.greatest("_old", F.max(version()).over(before)))
    rows = rows.withColumn("_applied", F.col("_stored").isNull() | (version() >= F.col("_stored")))
    rest = [c for c in panes.columns if c not in (key, order)]
    batch = rows.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.when(F.col("_applied"), version(order))).alias("_new"),
        F.count_if("_applied").alias("_n"),
    )
    columns = [c for c in stored.columns if c not in (key, "panes_recibidos")]
    joined = stored.join(batch, key, "full_outer")
    take = F.col("_n") > 0
    chosen = [
        F.when(F.coalesce(take, F.lit(False)) & (F.lit(c not in FIXED) | F.col("panes_recibidos").isNull()), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns
    ]
    received = (F.coalesce("panes_recibidos", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long")
    return joined.select(key, *chosen, received.alias("panes_recibidos"))


def dedup_rejects(rejects: DataFrame, order: tuple[str, ...] = ("partition", "arrival")) -> DataFrame:
    """Rejects once each, the first in ``order``: by (motivo, event_id, mensaje_original) where there is an event id, else by (partition, arrival)."""
    anonymous = F.col("event_id").isNull()
    place = F.when(anonymous, F.concat_ws(":", F.col("partition").cast("string"), F.col("arrival").cast("string")))
    keys = ["motivo", "event_id", "mensaje_original"]
    rest = [c for c in rejects.columns if c not in (*keys, *order)]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    found = rejects.withColumn("_place", place).groupBy(*keys, "_place").agg(first)
    return found.select(*[c if c in keys else f"_first.{c}" for c in rejects.columns])


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("motivo").agg(F.count("*").alias("n"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a compacted log, or the offsets consumed."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")
