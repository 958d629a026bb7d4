"""One query for each operator group over the ``events`` test table, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PRODUCTION, Settings
from ..functions.times import epoch_seconds, iso_utc
from ..operators import aggregate, report, state
from ..operators.validate import validate
from ..sources import generator
from ..sources.records import read_jsonl, reference_now, with_arrival
from ..sources.sinks import aggregate_records, reject_records
from ..sources.test_tables import SPOILT, malformed_records, sale_records, sales_columns
from .core import build_core, judge

W = PRODUCTION.window_seconds
#: Arrivals in a simulated pane.
CHUNK = 50


def _core(spark: SparkSession, sf_dir: str):
    return build_core(sale_records(spark, sf_dir), PRODUCTION)


def contract_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate(sale_records(spark, sf_dir), PRODUCTION)
    contract = F.when(F.col("sale").isNull(), F.col("reject.motivo")).otherwise("valido")
    return checked.groupBy(contract.alias("motivo")).agg(F.count("*").alias("n"))


def contract_upgrade_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    sale = validate(sale_records(spark, sf_dir), PRODUCTION).where("sale is not null").select("sale.*")
    return sale.groupBy("version_in", "schema_version", "channel").agg(F.count("*").alias("n"), F.sum("amount_gs").alias("amount_gs"))


def clock_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate(sale_records(spark, sf_dir), PRODUCTION).where("sale is not null")
    return checked.groupBy(F.coalesce("reject.motivo", F.lit("plausible")).alias("motivo")).agg(F.count("*").alias("n"))


def too_late_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _core(spark, sf_dir).very_late
    return late.select("event_id", "partition", "arrival", F.col("detalle"))


def side_output_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = _core(spark, sf_dir)
    sides = {"valid": core.accepted, "invalid": core.invalid, "very_late": core.very_late}
    counts = [side.groupBy(F.lit(name).alias("side")).agg(F.count("*").alias("n")) for name, side in sides.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def sales_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core(spark, sf_dir).results


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = aggregate.first_by_arrival(aggregate.windowed(_core(spark, sf_dir).accepted, W), ["key", "window"])
    return unique.where("copies > 1").select("key", iso_utc(F.col("window")).alias("window_start"), "event_id", "arrival", "amount_gs", "copies")


def partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = aggregate.windowed(_core(spark, sf_dir).accepted, W)
    parts = aggregate.first_by_arrival(sales.withColumn("part", F.col("arrival") % 3), ["part", "key", "window"])
    merged = aggregate.merge_partials(parts, ["key", "window"])
    return aggregate.with_window_names(aggregate.totals(merged, ["key", "window"]), W)


def payment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = aggregate.first_by_arrival(aggregate.windowed(_core(spark, sf_dir).accepted, W), ["key", "window"])
    paid = unique.groupBy("key", "window", "payment").agg(F.sum("amount_gs").alias("total_gs"))
    return paid.select("key", iso_utc(F.col("window")).alias("window_start"), "payment", "total_gs")


def avg_ticket_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _core(spark, sf_dir).results
    return results.select("aggregate_id", "ticket_count", "total_amount_gs", "avg_ticket_gs")


def ingest_delay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _core(spark, sf_dir).accepted
    behind = F.greatest(F.lit(0), F.unix_millis("arrival_time") - F.unix_millis("event_time"))
    return accepted.agg(F.count("*").alias("n"), F.min(behind).alias("min_ms"), F.max(behind).alias("max_ms"), F.sum(behind).alias("sum_ms"))


def pane_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulating panes in batch: each chunk of arrivals that touches a result gives one pane with the totals so far."""
    sales = aggregate.windowed(_core(spark, sf_dir).accepted, W)
    firsts = F.row_number().over(Window.partitionBy("key", "window", "event_id").orderBy("arrival")) == 1
    marked = sales.withColumn("first", firsts.cast("long")).withColumn("chunk", F.floor(F.col("arrival") / CHUNK))
    chunks = marked.groupBy("key", "window", "chunk").agg(
        F.sum("first").alias("t"), F.sum(F.col("first") * F.col("amount_gs")).alias("g"), F.sum(1 - F.col("first")).alias("d"), F.max("arrival").alias("arrival")
    )
    so_far = Window.partitionBy("key", "window").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    index = F.row_number().over(Window.partitionBy("key", "window").orderBy("chunk")) - 1
    panes = chunks.select(
        "key",
        "window",
        index.cast("long").alias("pane_index"),
        F.sum("t").over(so_far).alias("ticket_count"),
        F.sum("g").over(so_far).alias("total_amount_gs"),
        F.sum("d").over(so_far).alias("duplicates_discarded"),
        "arrival",
    )
    return aggregate.with_window_names(panes, W)


def pane_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panes as they reach the sink: with a stale copy of every third, and an empty pane after every fifth; the panes are computed once."""
    panes = pane_rows(spark, sf_dir)
    copy = lambda shift, share: F.struct(F.lit(shift).cast("long").alias("shift"), F.lit(share).cast("long").alias("share"))
    stale, empty = F.when(F.col("pane_index") % 3 == 0, copy(1_000_003, 1)), F.when(F.col("pane_index") % 5 == 0, copy(2_000_003, 0))
    rows = panes.select("*", F.inline(F.array_compact(F.array(copy(0, 1), stale, empty))))
    shared = {c: F.col(c) * F.col("share") for c in ("ticket_count", "total_amount_gs")}
    return rows.withColumns(shared | {"arrival": F.col("arrival") + F.col("shift")}).drop("shift", "share")


def _twice(rows: DataFrame) -> DataFrame:
    """Every row twice, as a replay delivers it; what the rows come from is computed once."""
    return rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))


def final_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.final_state(pane_log(spark, sf_dir))


def panes_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.panes_received(pane_log(spark, sf_dir))


def replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    panes = _twice(pane_log(spark, sf_dir))
    return state.final_state(panes.withColumn("arrival", F.col("arrival") + F.col("_copy") * 10_000_000)).drop("arrival", "_copy")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects twice over, as a replay delivers them."""
    return _twice(_core(spark, sf_dir).rejects()).drop("_copy")


def reject_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.dedup_rejects(dead_letters(spark, sf_dir)).select("motivo", "event_id", "event_time", "amount_gs", "key")


def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.reject_counts(state.dedup_rejects(dead_letters(spark, sf_dir)))


def latest_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales_columns(spark, sf_dir).select(F.lit(PRODUCTION.sales_topic).alias("topic"), "partition", F.col("arrival").alias("offset"), (F.col("arrival") % 7).alias("step"))
    return state.latest_per_key(rows, ["topic", "partition"], ["step", "offset"])


def compacted_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = pane_log(spark, sf_dir).select("aggregate_id", "arrival", "pane_index", "ticket_count")
    return state.latest_per_key(log, ["aggregate_id"], ["arrival"])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.settle(pane_log(spark, sf_dir))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("aggregate_id", "window_start", "window_end", "ticket_count", "total_amount_gs", "pane_index", "panes_recibidos")
    return report.result_rows(_results(spark, sf_dir)).select(*columns)


def store_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.result_rows(_results(spark, sf_dir), "S3").select("aggregate_id", "ticket_count", "total_amount_gs")


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("panes_recibidos"), F.lit(0)).alias("applied"), F.coalesce(F.sum("panes_ignorados"), F.lit(0)).alias("ignored")
    )


def partition_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.partition_skew(sale_records(spark, sf_dir))


def smoke_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core(spark, sf_dir).results.agg(F.sum("ticket_count").alias("tickets"), F.sum("duplicates_discarded").alias("duplicates"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record of the test stream was made as, told from the records themselves: its version, its place and whether its sale came before."""
    rows = sale_records(spark, sf_dir)
    version = F.get_json_object("value", "$.schema_version").cast("int")
    place, n = F.col("arrival") - F.col("n") * 10, F.col("n")
    label = F.when(place == 25, "DUPLICADO").when(n % 50 == 7, "TARDIO").when(version == 99, "INVALIDO:version_desconocida").otherwise("OK")
    return rows.groupBy(label.alias("etiqueta")).agg(F.count("*").alias("n"))


def lateness_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far accepted sales lie behind their arrival, by minute."""
    accepted = _core(spark, sf_dir).accepted
    minutes = F.floor((epoch_seconds(F.col("arrival_time")) - epoch_seconds(F.col("event_time"))) / 60).cast("long")
    return accepted.groupBy("key", minutes.alias("minutes_behind")).agg(F.count("*").alias("n"))


def global_scope_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too-late counts where the running maximum is taken over all partitions."""
    judged = judge(sale_records(spark, sf_dir), PRODUCTION, scope=[])
    return judged.where("reject.motivo = 'demasiado_tardio'").groupBy("partition").agg(F.count("*").alias("n"))


def stream_sales_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of partial accumulators, in four micro-batches."""
    from ..streaming.jobs import run_windowed_totals

    return run_windowed_totals(spark, sale_records(spark, sf_dir), PRODUCTION)[0]


def stream_too_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that stream sends to the reject table, with its messages."""
    from ..streaming.jobs import run_windowed_totals

    late = run_windowed_totals(spark, sale_records(spark, sf_dir), PRODUCTION)[1].where("motivo = 'demasiado_tardio'")
    return late.select("motivo", "detalle", "event_id", "event_time", "amount_gs", "partition", "arrival", F.get_json_object("mensaje_original", "$.event_id").alias("sent_id"))


#: Micro-batches of the registered pane jobs.
BATCHES = 4


def stream_panes_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pane job's result table after four micro-batches."""
    from ..streaming.jobs import pane_results, run_panes

    panes = pane_results(spark, run_panes(spark, sale_records(spark, sf_dir), PRODUCTION, BATCHES))
    return panes.select("aggregate_id", "ticket_count", "total_amount_gs", "items", "duplicates_discarded", "by_payment_gs")


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pane job's reject table: broken, implausible, too late and expired records."""
    from ..streaming.jobs import pane_rejects, run_panes

    rejects = pane_rejects(spark, run_panes(spark, sale_records(spark, sf_dir), PRODUCTION, BATCHES))
    cause = F.when(F.col("detalle").startswith("window expired"), "expired").otherwise("judged")
    return rejects.select("motivo", cause.alias("cause"), "event_id", "amount_gs", "key", F.get_json_object("mensaje_original", "$.key").alias("sent_key"))


def _scenario(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Settings]:
    """The test stream with every ninth record one micro-batch late and every 31st two, and windows as long as half a micro-batch.

    The windows follow from the span of the table, so that all sizes meet early, on-time, late and expired panes.
    """
    rows = sale_records(spark, sf_dir)
    first, last, low, high = rows.agg(F.min("arrival_time"), F.max("arrival_time"), F.min("arrival"), F.max("arrival")).first()
    size = max(60, int((last - first).total_seconds()) // (2 * BATCHES))
    settings = replace(PRODUCTION, window_seconds=size, allowed_lateness_seconds=size, max_past_skew_seconds=40 * size)
    stretch = (high - low + 1) // BATCHES
    lag = F.when(F.col("n") % 9 == 4, stretch).when(F.col("n") % 31 == 5, 2 * stretch).otherwise(0)
    return rows.withColumn("arrival", (F.col("arrival") + lag) * 10_000_000 + F.col("n")), settings


def stream_pane_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pane of a job whose records come in late by whole micro-batches: EARLY, ON_TIME, LATE and closing panes."""
    from ..streaming.jobs import pane_history, run_panes

    records, settings = _scenario(spark, sf_dir)
    panes = pane_history(spark, run_panes(spark, records, settings, BATCHES, heuristic=False))
    columns = ("aggregate_id", "pane_index", "pane_timing", "is_first", "is_last", "ticket_count", "total_amount_gs", "items", "duplicates_discarded")
    return panes.select(*columns)


def stream_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales of that job that came after their windows' expiry."""
    from ..streaming.jobs import pane_rejects, run_panes

    records, settings = _scenario(spark, sf_dir)
    rejects = pane_rejects(spark, run_panes(spark, records, settings, BATCHES, heuristic=False)).where("detalle like 'window expired%'")
    return rejects.select("motivo", "event_id", "amount_gs", "arrival")


def malformed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's first failing check of records that are spoilt in every way it knows."""
    checked = validate(malformed_records(spark, sf_dir), PRODUCTION)
    rows = checked.where("reject is not null and sale is null")
    return rows.groupBy("reject.motivo", "reject.detalle").agg(F.count("*").alias("n"))


def sorted_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as keyed compact JSON with sorted names, as they go to a topic."""
    return aggregate_records(_core(spark, sf_dir).results)


def reject_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys under which rejects go out, and which fields their JSON holds."""
    records = reject_records(_core(spark, sf_dir).rejects())
    fields = F.array_join(F.json_object_keys("value"), ",")
    return records.groupBy("key", fields.alias("fields"), F.get_json_object("value", "$.motivo").alias("motivo")).agg(F.count("*").alias("n"))


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test stream written as JSON Lines without offsets, read back in file order, and through the core; "now" from the records."""
    from ..streaming.jobs import work_dir

    path = work_dir(spark, "lines")
    rows = sale_records(spark, sf_dir)
    line = F.struct(F.lit("OK").alias("etiqueta"), "key", F.unix_millis("arrival_time").alias("timestamp_ms"), "value", "partition", F.date_format("arrival_time", TIME).alias("arrival_time"))
    ordered = rows.repartitionByRange(5, "arrival").sortWithinPartitions("arrival")
    ordered.select(F.to_json(line).alias("value")).write.text(path)
    records = read_jsonl(spark, path)
    found = build_core(with_arrival(records, F.lit(None).cast("timestamp")), PRODUCTION)
    now = reference_now(records).select(iso_utc(F.col("now")).alias("now"))
    results = found.results.select("aggregate_id", "ticket_count", "total_amount_gs", "duplicates_discarded")
    return results.withColumn("now", now.scalar())


TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and rejects as messages of both topics, every fifth result twice, every 50th message unreadable."""
    core = _core(spark, sf_dir)
    results, rejects = aggregate_records(core.results.withColumn("pane_index", F.lit(0))), reject_records(core.rejects())
    every = results.select(F.lit(PRODUCTION.aggregates_topic).alias("topic"), "key", "value").unionByName(rejects.select(F.lit(PRODUCTION.dlq_topic).alias("topic"), "key", "value"))
    number = lambda text: F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    mark = number(F.concat("key", F.get_json_object("value", "$.window_start"))) % 50
    marked = every.withColumn("mark", mark)
    broken = marked.withColumn("value", F.when(F.col("mark") == 0, F.lit("{")).otherwise(F.col("value")))
    copies = F.when(F.col("mark") % 5 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copied = broken.withColumn("copy", F.explode(copies))
    return copied.select("topic", "key", "value", F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("arrival"), (number(F.col("key")) % 3).alias("part"))


def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of both topics through the materializer, one batch delivered twice: outcomes, and rows of each table."""
    from ..streaming.jobs import work_dir
    from ..streaming.materializer import Materializer

    job = Materializer(spark, PRODUCTION, work_dir(spark, "materialized"))
    messages = _topics(spark, sf_dir)
    for batch, (part, copies) in enumerate([(0, 1), (1, 2), (2, 1)]):
        for _ in range(copies):
            job.take(messages.where(F.col("part") == part).drop("part"), batch)
    tables = {"results": job.results.read(), "rejects": job.rejects.read(), "defaults": job.results.read().where("pane_timing = 'UNKNOWN' and not is_last and emitted_at = ''")}
    counts = [table.agg(F.count("*").alias("n")).select(F.lit(name).alias("outcome"), "n") for name, table in tables.items()]
    received = job.results.read().agg(F.sum("panes_recibidos").alias("n")).select(F.lit("panes_recibidos").alias("outcome"), "n")
    return reduce(DataFrame.unionByName, [job.outcomes(), received, *counts])


#: A run of the workload generator: start, seconds, sales a second, rates.
RUN = (datetime(2026, 9, 21, 10, 0, tzinfo=UTC), 1800.0, 4.0, generator.Rates(0.05, 0.10, 0.03, 0.01, 0.06))


def generated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated run, written and read as JSON Lines: what each record was made as, and what the contract says of it."""
    from ..streaming.jobs import work_dir

    settings, path = Settings(), work_dir(spark, "run")
    start, seconds, rate, rates = RUN
    generator.write_lines(generator.log_lines(generator.messages(generator.run_intents(spark, settings, start, seconds, rate, rates))), path)
    judged = validate(with_arrival(read_jsonl(spark, path), F.lit(None).cast("timestamp")), settings)
    labels = read_jsonl(spark, path).groupBy("etiqueta").agg(F.count("*").alias("n"))
    reasons = judged.groupBy(F.coalesce("reject.motivo", F.lit("valido")).alias("etiqueta")).agg(F.count("*").alias("n"))
    return labels.unionByName(reasons)


def generated_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales of a generated run by store, terminal, payment, version and channel."""
    start, seconds, rate, rates = RUN
    intents = generator.run_intents(spark, Settings(), start, seconds, rate, rates).where("label in ('OK', 'DESORDEN')")
    sales = intents.select("number", *[column.alias(name) for name, column in generator.sale_fields(7).items()])
    channel = F.when(F.col("version") == 2, F.col("channel"))
    return sales.groupBy("store", "terminal", "payment", "version", channel.alias("channel")).agg(
        F.count("*").alias("n"), F.sum("items").alias("items"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sales_per_window, contract_reason_counts, contract_upgrade_v1, clock_plausibility, too_late_running_max, side_output_split, dedup_first_wins, partial_merge,
        payment_breakdown, avg_ticket_half_even, ingest_delay_stats, final_state_upsert, panes_received, replay_state, reject_dedup, reject_summary, latest_offsets,
        compacted_latest, report_rows, store_report, report_summary, partition_skew, smoke_totals, label_counts, lateness_overview, global_scope_late,
        stream_sales_per_window, stream_too_late, stream_panes_final_state, stream_rejects, stream_pane_sequence, stream_expired, malformed_reasons, sorted_json_rows,
        reject_keys, jsonl_round_trip, materialized, generated_labels, generated_sales,
    )
} | {"pane_sequence": pane_rows}

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_iso = partial(_ISO.format)

def _judged(past: str = "INTERVAL 1 DAY") -> str:
    """The stream as a table, and what contract, clocks and lateness say of each record; ``past``: how old a sale may be."""
    return f"""
WITH raw AS (
  SELECT event_id AS n, CAST(ts AS TIMESTAMP) AS ts, 'E-' || event_id AS event_id, 'S' || (1 + user_id % 6) AS key,
    CASE WHEN event_id % 89 = 0 THEN ts + INTERVAL 10 MINUTE WHEN event_id % 103 = 0 THEN ts - INTERVAL 2 DAY ELSE ts END AS event_time,
    CAST(round(value * 100) AS BIGINT) * 10 * CASE WHEN event_id % 101 = 0 THEN -1 ELSE 1 END AS amount_gs, 1 + event_id % 5 AS items,
    CASE event_type WHEN 'view' THEN 'cash' WHEN 'click' THEN 'card' WHEN 'purchase' THEN 'qr' WHEN 'signup' THEN 'transfer' ELSE 'cripto' END AS payment,
    CASE WHEN event_id % 97 = 0 THEN 99 WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS version_in, user_id % 4 AS partition,
    event_id * 10 + CASE WHEN event_id % 50 = 7 THEN 303 ELSE 0 END AS arrival
  FROM events
), every AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (n * 10 + 25 AS arrival) FROM raw WHERE n % 20 = 0),
sales AS (SELECT *, max(ts) OVER (ORDER BY arrival) + INTERVAL 5 SECOND AS arrival_time FROM every),
checked AS (
  SELECT *, CASE WHEN version_in = 99 THEN 'version_no_soportada' WHEN amount_gs <= 0 THEN 'monto_invalido'
    WHEN payment = 'cripto' THEN 'metodo_pago_desconocido' END AS contract FROM sales
), clocked AS (
  SELECT *, CASE WHEN contract IS NOT NULL THEN NULL WHEN event_time > arrival_time + INTERVAL 120 SECOND THEN 'reloj_futuro'
    WHEN event_time < arrival_time - {past} THEN 'reloj_pasado' END AS clock FROM checked
), seen AS (
  SELECT *, max(CASE WHEN contract IS NULL AND clock IS NULL THEN event_time END)
    OVER (PARTITION BY partition ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest,
    max(CASE WHEN contract IS NULL AND clock IS NULL THEN event_time END)
    OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_of_all
  FROM clocked
), judged AS (
  SELECT *, coalesce(contract, clock, CASE WHEN event_time < latest - INTERVAL 5400 SECOND THEN 'demasiado_tardio' END) AS motivo FROM seen
)"""

_ACCEPTED = """
, accepted AS (
  SELECT *, time_bucket(INTERVAL 1 HOUR, event_time) AS w FROM judged WHERE motivo IS NULL
)"""

_RANKED = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY key, w, event_id ORDER BY arrival) AS r FROM accepted)"""

_SALES = _judged() + _ACCEPTED + _RANKED

_TOTALS = f"""
, paid AS (
  SELECT key, w, payment, sum(CASE WHEN r = 1 THEN amount_gs END) AS total FROM ranked GROUP BY ALL HAVING count_if(r = 1) > 0
), jsons AS (SELECT key, w, '{{' || string_agg('"' || payment || '":' || CAST(total AS BIGINT), ',' ORDER BY payment) || '}}' AS j FROM paid GROUP BY ALL),
totals AS (
  SELECT key, w, count_if(r = 1) AS ticket_count, CAST(sum(CASE WHEN r = 1 THEN amount_gs END) AS BIGINT) AS total_amount_gs,
    CAST(sum(CASE WHEN r = 1 THEN items END) AS BIGINT) AS items, count_if(r > 1) AS duplicates_discarded
  FROM ranked GROUP BY ALL
), results AS (
  SELECT t.key || '|' || {_iso("t.w")} AS aggregate_id, t.key AS store_id, {_iso("t.w")} AS window_start, {_iso("t.w + INTERVAL 1 HOUR")} AS window_end,
    ticket_count, total_amount_gs, items, CAST(round_even(total_amount_gs / ticket_count, 0) AS BIGINT) AS avg_ticket_gs, j AS by_payment_gs, duplicates_discarded
  FROM totals t JOIN jsons x ON t.key = x.key AND t.w = x.w
)"""

_PANES = f"""
, chunks AS (
  SELECT key, w, arrival // {CHUNK} AS chunk, count_if(r = 1) AS t, coalesce(sum(CASE WHEN r = 1 THEN amount_gs END), 0) AS g, count_if(r > 1) AS d, max(arrival) AS arrival
  FROM ranked GROUP BY ALL
), panes AS (
  SELECT key || '|' || {_iso("w")} AS aggregate_id, key AS store_id, {_iso("w")} AS window_start, {_iso("w + INTERVAL 1 HOUR")} AS window_end,
    row_number() OVER (PARTITION BY key, w ORDER BY chunk) - 1 AS pane_index, CAST(sum(t) OVER s AS BIGINT) AS ticket_count, CAST(sum(g) OVER s AS BIGINT) AS total_amount_gs,
    CAST(sum(d) OVER s AS BIGINT) AS duplicates_discarded, arrival
  FROM chunks WINDOW s AS (PARTITION BY key, w ORDER BY chunk)
), log AS (
  SELECT * FROM panes
  UNION ALL SELECT * REPLACE (arrival + 1000003 AS arrival) FROM panes WHERE pane_index % 3 = 0
  UNION ALL SELECT * REPLACE (arrival + 2000003 AS arrival, 0 AS ticket_count, 0 AS total_amount_gs) FROM panes WHERE pane_index % 5 = 0
), final AS (
  SELECT * EXCLUDE (b) FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY ticket_count DESC, pane_index DESC, arrival DESC) AS b FROM log) WHERE b = 1
), stored AS (
  SELECT *, max(ticket_count * 1000000 + pane_index) OVER (PARTITION BY aggregate_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM log
), received AS (
  SELECT aggregate_id, count_if(v IS NULL OR ticket_count * 1000000 + pane_index >= v) AS panes_recibidos, count_if(v IS NOT NULL AND ticket_count * 1000000 + pane_index < v) AS panes_ignorados
  FROM stored GROUP BY ALL
)"""

_RESULT = "SELECT * FROM results"

#: Micro-batches of the registered streams by arrival, the watermark that each one sees (in ms), and sales after their window's expiry.
_STREAMED = (
    _judged()
    + f"""
, ends AS (SELECT min(arrival) AS low, max(arrival) AS high FROM sales),
batched AS (SELECT *, (arrival - low) * {BATCHES} // (high - low + 1) AS b, time_bucket(INTERVAL 1 HOUR, event_time) AS w FROM judged, ends),
marks AS (SELECT x.b, max(epoch_ms(y.event_time)) AS mark FROM (SELECT unnest(range({BATCHES})) AS b) x LEFT JOIN batched y ON y.b < x.b AND y.contract IS NULL AND y.clock IS NULL GROUP BY 1),
timed AS (SELECT *, motivo IS NULL AND coalesce(mark >= epoch_ms(w) + 5400000, false) AS expired FROM batched JOIN marks USING (b)),
accepted AS (SELECT * FROM timed WHERE motivo IS NULL AND NOT expired)"""
)

#: The scenario of late micro-batches: rows by phase of their window, the panes they bring about, and the totals at each.
_SCENARIO = (
    _judged("INTERVAL 1 SECOND * (SELECT 40 * size FROM span)").replace(
        "checked AS (", f"span AS (SELECT greatest(60, CAST(floor(epoch(max(arrival_time)) - epoch(min(arrival_time))) AS BIGINT) // {2 * BATCHES}) AS size, min(arrival) AS low, max(arrival) AS high FROM sales),\nchecked AS (", 1
    )
    + f"""
, moved AS (
  SELECT *, (arrival + CASE WHEN n % 9 = 4 THEN 1 WHEN n % 31 = 5 THEN 2 ELSE 0 END * ((high - low + 1) // {BATCHES})) * 10000000 + n AS a, size * 1000 AS ms
  FROM judged, span
), edges AS (SELECT min(a) AS alow, max(a) AS ahigh FROM moved),
batched AS (
  SELECT *, (a - alow) * {BATCHES} // (ahigh - alow + 1) AS b, epoch_ms(event_time) // ms * ms AS w FROM moved, edges WHERE contract IS NULL AND clock IS NULL
), marks AS (SELECT x.b, max(epoch_ms(y.event_time)) AS mark FROM (SELECT unnest(range({BATCHES + 1})) AS b) x LEFT JOIN batched y ON y.b < x.b GROUP BY 1),
placed AS (
  SELECT *, CASE WHEN mark >= w + 2 * ms THEN 'expired' WHEN mark >= w + ms THEN 'late' ELSE 'open' END AS phase FROM batched JOIN marks USING (b)
), kept AS (SELECT *, row_number() OVER (PARTITION BY key, w, event_id ORDER BY a) AS r FROM placed WHERE phase <> 'expired'),
windows AS (
  SELECT key, w, ms, min(CASE WHEN phase = 'open' THEN a END) AS opened, max(a) AS last_a,
    (SELECT min(b) FROM marks WHERE mark >= w + ms) AS b_end, (SELECT min(b) FROM marks WHERE mark >= w + 2 * ms) AS b_gone
  FROM kept GROUP BY ALL
), shown AS (
  SELECT key, w, b, 1 AS seq, max(a) AS a, 'EARLY' AS timing, false AS closes FROM kept WHERE phase = 'open' GROUP BY ALL
  UNION ALL
  SELECT k.key, k.w, k.b, 0, k.a, CASE WHEN (x.opened IS NULL OR k.b = x.b_end) AND row_number() OVER (PARTITION BY k.key, k.w ORDER BY k.a) = 1 THEN 'ON_TIME' ELSE 'LATE' END, false
  FROM kept k JOIN windows x ON k.key = x.key AND k.w = x.w WHERE k.phase = 'late'
  UNION ALL
  SELECT key, w, b_end, 2, (SELECT max(a) FROM kept k WHERE k.key = x.key AND k.w = x.w AND k.b <= x.b_end), 'ON_TIME', false
  FROM windows x WHERE opened IS NOT NULL AND b_end IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.key = x.key AND k.w = x.w AND k.phase = 'late' AND k.b = x.b_end)
  UNION ALL
  SELECT key, w, b_gone, 3, last_a, 'LATE', true FROM windows WHERE b_gone IS NOT NULL
), numbered AS (SELECT *, row_number() OVER (PARTITION BY key, w ORDER BY b, seq, a) - 1 AS i FROM shown),
figures AS (
  SELECT p.key, p.w, p.i, p.timing, p.closes, count_if(k.r = 1) AS ticket_count, CAST(sum(CASE WHEN k.r = 1 THEN k.amount_gs END) AS BIGINT) AS total_amount_gs,
    CAST(sum(CASE WHEN k.r = 1 THEN k.items END) AS BIGINT) AS items, count_if(k.r > 1) AS duplicates_discarded
  FROM numbered p JOIN kept k ON k.key = p.key AND k.w = p.w AND k.a <= p.a GROUP BY ALL
)"""
)


def _number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def _draw(seed: str, salt: str, number: str) -> str:
    return f"{_number(f"'{seed}:{salt}:' || CAST({number} AS BIGINT)")} / 4294967296.0"


_RUN = f"""WITH broken AS (SELECT ['json_corrupto', 'monto_negativo', 'sin_payload', 'reloj_futuro', 'version_desconocida', 'pago_desconocido'] AS kinds,
  ['json_invalido', 'monto_invalido', 'campos_faltantes', 'reloj_futuro', 'version_no_soportada', 'metodo_pago_desconocido'] AS reasons),
ticks AS (
  SELECT id, CASE WHEN id / 4.0 % 60 BETWEEN 15 AND 25 THEN 0 ELSE (75 - id / 4.0 % 60) % 60 END AS wait,
    {", ".join(f"{_draw('7', f'run {salt}', 'id')} AS {salt}" for salt in ("disorder", "duplicates", "very_late", "late", "broken", "kind"))}
  FROM range(7200) t(id)
)"""

ORACLE_SQL: dict[str, str] = {
    "sales_per_window": _SALES + _TOTALS + _RESULT,
    "partial_merge": _SALES + _TOTALS + _RESULT,
    "contract_reason_counts": _SALES + "SELECT coalesce(contract, 'valido') AS motivo, count(*) AS n FROM checked GROUP BY ALL",
    "contract_upgrade_v1": _SALES
    + """SELECT version_in, 2 AS schema_version, CASE WHEN version_in = 1 THEN 'store' WHEN n % 10 = 3 THEN 'delivery' ELSE 'store' END AS channel,
    count(*) AS n, CAST(sum(amount_gs) AS BIGINT) AS amount_gs FROM checked WHERE contract IS NULL GROUP BY 1, 2, 3""",
    "clock_plausibility": _SALES + "SELECT coalesce(clock, 'plausible') AS motivo, count(*) AS n FROM clocked WHERE contract IS NULL GROUP BY ALL",
    "too_late_running_max": _SALES
    + """SELECT event_id, partition, arrival, printf('%.0f', (epoch_us(latest) - epoch_us(event_time)) / 1e6 - 5400) || 's más allá del horizonte' AS detalle
    FROM judged WHERE motivo = 'demasiado_tardio'""",
    "side_output_split": _SALES
    + """SELECT CASE WHEN motivo IS NULL THEN 'valid' WHEN motivo = 'demasiado_tardio' THEN 'very_late' ELSE 'invalid' END AS side, count(*) AS n FROM judged GROUP BY ALL""",
    "dedup_first_wins": _SALES
    + f"""SELECT key, {_iso("w")} AS window_start, event_id, min(arrival) AS arrival, arg_min(amount_gs, arrival) AS amount_gs, count(*) AS copies
    FROM ranked GROUP BY key, w, event_id HAVING count(*) > 1""",
    "payment_breakdown": _SALES + _TOTALS + f"""SELECT key, {_iso("w")} AS window_start, payment, CAST(total AS BIGINT) AS total_gs FROM paid""",
    "avg_ticket_half_even": _SALES + _TOTALS + "SELECT aggregate_id, ticket_count, total_amount_gs, avg_ticket_gs FROM results",
    "ingest_delay_stats": _SALES
    + """SELECT count(*) AS n, min(ms) AS min_ms, max(ms) AS max_ms, CAST(sum(ms) AS BIGINT) AS sum_ms
    FROM (SELECT greatest(0, epoch_us(arrival_time) // 1000 - epoch_us(event_time) // 1000) AS ms FROM accepted)""",
    "pane_sequence": _SALES + _PANES + "SELECT * FROM panes",
    "final_state_upsert": _SALES + _PANES + "SELECT * FROM final",
    "panes_received": _SALES + _PANES + "SELECT * FROM received",
    "replay_state": _SALES + _PANES + "SELECT * EXCLUDE (arrival) FROM final",
    "reject_dedup": _SALES
    + f"""SELECT motivo, CASE WHEN contract IS NULL THEN event_id END AS event_id, CASE WHEN contract IS NULL THEN {_iso("event_time")} END AS event_time,
    CASE WHEN contract IS NULL THEN amount_gs END AS amount_gs, key
    FROM (SELECT *, row_number() OVER (PARTITION BY motivo, event_id ORDER BY arrival) AS copy FROM judged WHERE motivo IS NOT NULL) WHERE contract IS NOT NULL OR copy = 1""",
    "reject_summary": _SALES
    + """SELECT motivo, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY motivo, event_id ORDER BY arrival) AS copy FROM judged WHERE motivo IS NOT NULL)
    WHERE contract IS NOT NULL OR copy = 1 GROUP BY ALL""",
    "latest_offsets": _SALES
    + f"""SELECT '{PRODUCTION.sales_topic}' AS topic, partition, arg_max(arrival, (arrival % 7) * 100000000000 + arrival) AS "offset",
    max(arrival % 7) AS step FROM sales GROUP BY partition""",
    "compacted_latest": _SALES
    + _PANES
    + "SELECT aggregate_id, arrival, pane_index, ticket_count FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY arrival DESC) AS b FROM log) WHERE b = 1",
    "report_rows": _SALES
    + _PANES
    + """SELECT aggregate_id, window_start, window_end, ticket_count, total_amount_gs, pane_index, panes_recibidos FROM final JOIN received USING (aggregate_id)
    ORDER BY window_start, store_id""",
    "store_report": _SALES + _PANES + "SELECT aggregate_id, ticket_count, total_amount_gs FROM final WHERE store_id = 'S3' ORDER BY window_start",
    "report_summary": _SALES
    + _PANES
    + "SELECT count(*) AS rows, CAST(sum(panes_recibidos) AS BIGINT) AS applied, CAST(sum(panes_ignorados) AS BIGINT) AS ignored FROM received",
    "partition_skew": _SALES
    + "SELECT partition, key, count(*) AS n, CAST(count(*) * 10000 // (SELECT count(*) FROM sales) AS BIGINT) AS share_bp FROM sales GROUP BY ALL",
    "smoke_totals": _SALES + _TOTALS + "SELECT CAST(sum(ticket_count) AS BIGINT) AS tickets, CAST(sum(duplicates_discarded) AS BIGINT) AS duplicates FROM results",
    "label_counts": _SALES
    + """SELECT CASE WHEN arrival = n * 10 + 25 THEN 'DUPLICADO' WHEN n % 50 = 7 THEN 'TARDIO' WHEN n % 97 = 0 THEN 'INVALIDO:version_desconocida' ELSE 'OK' END AS etiqueta,
    count(*) AS n FROM sales GROUP BY ALL""",
    "lateness_overview": _SALES
    + """SELECT key, CAST(floor((epoch_us(arrival_time) / 1e6 - epoch_us(event_time) / 1e6) / 60) AS BIGINT) AS minutes_behind, count(*) AS n FROM accepted GROUP BY ALL""",
    "global_scope_late": _SALES
    + "SELECT partition, count(*) AS n FROM judged WHERE contract IS NULL AND clock IS NULL AND event_time < latest_of_all - INTERVAL 5400 SECOND GROUP BY ALL",
    "stream_sales_per_window": _SALES + _TOTALS + _RESULT,
    "stream_too_late": _SALES
    + f"""SELECT motivo, printf('%.0f', (epoch_us(latest) - epoch_us(event_time)) / 1e6 - 5400) || 's más allá del horizonte' AS detalle, event_id, {_iso("event_time")} AS event_time,
    amount_gs, partition, arrival, event_id AS sent_id
    FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS copy FROM judged WHERE motivo = 'demasiado_tardio') WHERE copy = 1""",
    "stream_panes_final_state": _STREAMED + _RANKED + _TOTALS + "SELECT aggregate_id, ticket_count, total_amount_gs, items, duplicates_discarded, by_payment_gs FROM results",
    "stream_rejects": _STREAMED
    + """, late AS (SELECT * REPLACE ('demasiado_tardio' AS motivo), CASE WHEN motivo IS NULL THEN 'expired' ELSE 'judged' END AS cause FROM timed WHERE motivo = 'demasiado_tardio' OR expired),
    once AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY b, arrival) AS copy FROM late),
    early AS (SELECT *, 'judged' AS cause, row_number() OVER (PARTITION BY motivo, event_id ORDER BY arrival) AS copy FROM timed WHERE motivo <> 'demasiado_tardio')
    SELECT motivo, cause, event_id, amount_gs, key, key AS sent_key FROM once WHERE copy = 1
    UNION ALL SELECT motivo, cause, CASE WHEN contract IS NULL THEN event_id END, CASE WHEN contract IS NULL THEN amount_gs END, key, key FROM early WHERE contract IS NOT NULL OR copy = 1""",
    "stream_pane_sequence": _SCENARIO
    + """SELECT key || '|' || strftime(make_timestamp(w * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS aggregate_id, i AS pane_index, timing AS pane_timing, i = 0 AS is_first, closes AS is_last,
    ticket_count, total_amount_gs, items, duplicates_discarded FROM figures""",
    "stream_expired": _SCENARIO
    + "SELECT 'demasiado_tardio' AS motivo, event_id, arg_min(amount_gs, a) AS amount_gs, min(a) AS arrival FROM placed WHERE phase = 'expired' GROUP BY event_id",
    "malformed_reasons": "WITH ways(i, motivo, detalle) AS (VALUES "
    + ", ".join(f"({i}, '{reason}', '{detail}')" for i, (_, reason, detail) in enumerate(SPOILT))
    + f") SELECT motivo, detalle, count(*) AS n FROM events JOIN ways ON event_id % {len(SPOILT)} = i WHERE motivo <> '' GROUP BY ALL",
    "sorted_json_rows": _SALES
    + _TOTALS
    + """SELECT aggregate_id AS key, '{"aggregate_id":"' || aggregate_id || '","avg_ticket_gs":' || avg_ticket_gs || ',"by_payment_gs":' || by_payment_gs || ',"duplicates_discarded":' || duplicates_discarded
    || ',"items":' || items || ',"schema_version":1,"store_id":"' || store_id || '","ticket_count":' || ticket_count || ',"total_amount_gs":' || total_amount_gs
    || ',"window_end":"' || window_end || '","window_start":"' || window_start || '"}' AS value FROM results""",
    "reject_keys": _SALES
    + """SELECT key, 'amount_gs,detalle,event_id,event_time,key,mensaje_original,motivo,rechazado_en' AS fields, motivo, count(*) AS n FROM judged WHERE motivo IS NOT NULL GROUP BY ALL""",
    "jsonl_round_trip": _SALES
    + _TOTALS
    + f"""SELECT aggregate_id, ticket_count, total_amount_gs, duplicates_discarded,
    (SELECT {_iso("date_trunc('milliseconds', max(arrival_time)) + INTERVAL 5 SECOND")} FROM sales) AS now FROM results""",
    "materialized": _SALES
    + _TOTALS
    + f""", marked AS (SELECT *, {_number("aggregate_id || window_start")} % 50 AS mark FROM results),
    counts AS (SELECT count_if(mark <> 0) AS results, count_if(mark = 0) AS broken, count_if(mark <> 0) + count_if(mark % 5 = 1) AS upserts FROM marked),
    dead AS (SELECT count(*) AS n, count_if(contract IS NOT NULL OR copy = 1) AS kept
      FROM (SELECT *, row_number() OVER (PARTITION BY motivo, event_id ORDER BY arrival) AS copy FROM judged WHERE motivo IS NOT NULL))
    SELECT unnest(['upsert', 'rechazo', 'ilegible', 'panes_recibidos', 'results', 'rejects', 'defaults']) AS outcome,
      CAST(unnest([upserts, dead.n, broken, upserts, results, kept, results]) AS BIGINT) AS n FROM counts, dead""",
    "generated_labels": _RUN
    + """, labels AS (
      SELECT CASE WHEN disorder < 0.1 THEN 'DESORDEN' ELSE 'OK' END AS label FROM ticks
      UNION ALL SELECT 'DUPLICADO' FROM ticks WHERE duplicates < 0.05
      UNION ALL SELECT 'MUY_TARDIO' FROM ticks WHERE very_late < 0.01
      UNION ALL SELECT 'TARDIO' FROM ticks WHERE late < 0.03 AND id / 4.0 + wait <= 1800
      UNION ALL SELECT 'INVALIDO:' || kinds[1 + CAST(floor(kind * 6) AS INT)] FROM ticks, broken WHERE broken < 0.06
    ), said AS (SELECT label AS etiqueta FROM labels UNION ALL SELECT coalesce(reasons[list_position(kinds, replace(label, 'INVALIDO:', ''))], 'valido') FROM labels, broken)
    SELECT etiqueta, count(*) AS n FROM said GROUP BY ALL""",
    "generated_sales": f"""WITH drawn AS (SELECT id * 3 AS number, {", ".join(f"{_draw('7', salt, 'id * 3')} AS u_{salt}" for salt in ("store", "terminal", "items", "payment", "version", "channel"))}
      FROM range(7200) t(id)), sales AS (
      SELECT *, CASE WHEN u_store < 0.3 THEN 'S1' WHEN u_store < 0.55 THEN 'S2' WHEN u_store < 0.7 THEN 'S3' WHEN u_store < 0.85 THEN 'S4' WHEN u_store < 0.95 THEN 'S5' ELSE 'S6' END AS store,
        'pos-0' || CAST(1 + floor(u_terminal * 3) AS INT) AS terminal, CAST(floor(-2.5 * ln(1 - u_items)) + 1 AS BIGINT) AS items,
        CASE WHEN u_payment < 0.35 THEN 'cash' WHEN u_payment < 0.75 THEN 'card' WHEN u_payment < 0.95 THEN 'qr' ELSE 'transfer' END AS payment,
        CASE WHEN u_version < 0.2 THEN 1 ELSE 2 END AS version FROM drawn
    ), named AS (SELECT *, CASE WHEN version = 2 THEN CASE WHEN u_channel < 0.9 THEN 'store' ELSE 'delivery' END END AS channel,
        store || '-' || terminal || '-' || lpad(CAST(number AS VARCHAR), 6, '0') AS event_id FROM sales)
    SELECT store, terminal, payment, version, channel, count(*) AS n, CAST(sum(items) AS BIGINT) AS items, min(event_id) AS first_id, max(event_id) AS last_id FROM named GROUP BY 1, 2, 3, 4, 5""",
}
