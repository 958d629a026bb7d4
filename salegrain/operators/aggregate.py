"""Sales per store and fixed window, each event id counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import aggregate_id, iso_utc, plus_seconds, window_start


def windowed(sales: DataFrame, seconds: int) -> DataFrame:
    """Sales with the start of their window as ``window``."""
    return sales.withColumn("window", window_start(F.col("event_time"), seconds))


def first_by_arrival(sales: DataFrame, by: list[str]) -> DataFrame:
    """One row for each event id in a group: the amount, items and payment of its first arrival, and how often it came.

    A map-side combined aggregate on (group, event id): the dedup level of every total.
    """
    first = F.min(F.struct("arrival", "amount_gs", "items", "payment"))
    found = sales.groupBy(*by, "event_id").agg(first.alias("first"), F.count("*").alias("copies"))
    return found.select(*by, "event_id", "first.*", "copies")


def payment_json(by_payment: Column) -> Column:
    """A JSON object of an array of (payment, total), sorted by payment."""
    entries = F.transform(F.array_sort(by_payment), lambda x: F.concat(F.lit('"'), x["payment"], F.lit('":'), x["total"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def half_even_average(total: Column, count: Column) -> Column:
    return F.when(count == 0, F.lit(0)).otherwise(F.bround(total / count, 0)).cast("long")


def totals(unique: DataFrame, by: list[str]) -> DataFrame:
    """Tickets, amounts, items, average, amounts by payment and discarded duplicates of deduplicated events.

    Payments are summed first, on (group, payment), so the last level sees at most one row for each of them.
    """
    paid = unique.groupBy(*by, "payment").agg(
        F.count("*").alias("tickets"), F.sum("amount_gs").alias("total"), F.sum("items").alias("items"), F.sum(F.col("copies") - 1).alias("duplicates")
    )
    grouped = paid.groupBy(*by).agg(
        F.sum("tickets").alias("ticket_count"),
        F.sum("total").alias("total_amount_gs"),
        F.sum("items").alias("items"),
        F.collect_list(F.struct("payment", "total")).alias("_paid"),
        F.sum("duplicates").alias("duplicates_discarded"),
    )
    average = half_even_average(F.col("total_amount_gs"), F.col("ticket_count"))
    return grouped.select(*by, "ticket_count", "total_amount_gs", "items", average.alias("avg_ticket_gs"), payment_json(F.col("_paid")).alias("by_payment_gs"), "duplicates_discarded")


def with_window_names(rows: DataFrame, seconds: int) -> DataFrame:
    """Rows keyed by (key, window) with aggregate_id, store_id, window_start and window_end as text."""
    rest = [c for c in rows.columns if c not in ("key", "window")]
    return rows.select(
        aggregate_id(F.col("key"), F.col("window")).alias("aggregate_id"),
        F.col("key").alias("store_id"),
        iso_utc(F.col("window")).alias("window_start"),
        iso_utc(plus_seconds(F.col("window"), seconds)).alias("window_end"),
        *rest,
    )


def sales_per_window(sales: DataFrame, seconds: int) -> DataFrame:
    """The final result for each store and window of accepted sales."""
    unique = first_by_arrival(windowed(sales, seconds), ["key", "window"])
    return with_window_names(totals(unique, ["key", "window"]), seconds)


def merge_partials(partials: DataFrame, by: list[str]) -> DataFrame:
    """Merge accumulators: rows (group, event_id, arrival, amount, items, payment, copies) of several parts into one each.

    Copies add up and the earliest arrival wins, so an id that two parts hold is one ticket and one more duplicate.
    """
    first = F.min(F.struct("arrival", "amount_gs", "items", "payment"))
    found = partials.groupBy(*by, "event_id").agg(first.alias("first"), F.sum("copies").alias("copies"))
    return found.select(*by, "event_id", "first.*", "copies")
