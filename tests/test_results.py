"""Windows, totals, versioned state, reject dedup, reports and files."""

import random

import pytest
from .helpers import SETTINGS, at, records, sale
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salegrain.config import Settings
from salegrain.functions.times import iso_utc, window_start
from salegrain.operators import aggregate, report, state
from salegrain.plans.core import build_core
from salegrain.sources import sinks
from salegrain.sources.records import route

PANE = "aggregate_id string, pane_index long, pane_timing string, ticket_count long, total_amount_gs long, arrival long"


def results(spark, events):
    return {r.aggregate_id: r for r in build_core(records(spark, events), SETTINGS).results.collect()}


CORE = [("S1-1", "10:00:05", "S1", 100000), ("S1-2", "10:00:15", "S1", 200000), ("S1-1", "10:00:05", "S1", 100000), ("S2-1", "10:00:20", "S2", 70000), ("S1-3", "10:01:02", "S1", 30000)]


def test_results_by_store_and_window(spark):
    found = results(spark, [sale(i, f"{t}.000", s, a) for i, t, s, a in CORE])
    got = {k: (r.ticket_count, r.total_amount_gs, r.duplicates_discarded) for k, r in found.items()}
    assert got == {f"S1|{at('10:00:00.000')}": (2, 300000, 1), f"S2|{at('10:00:00.000')}": (1, 70000, 0), f"S1|{at('10:01:00.000')}": (1, 30000, 0)}
    assert found[f"S1|{at('10:00:00.000')}"].window_end == at("10:01:00.000")


def test_order_of_arrival_does_not_change_results(spark):
    events = [sale(i, f"{t}.000", s, a) for i, t, s, a in CORE]
    first = results(spark, events)
    random.Random(1).shuffle(events)
    assert results(spark, events) == first


def test_combine(spark):
    events = [sale("a", amount=100000, payment="card"), sale("b", amount=50000, payment="cash"), sale("a", amount=7, payment="qr")]
    (r,) = results(spark, events).values()
    assert (r.ticket_count, r.total_amount_gs, r.items, r.avg_ticket_gs, r.by_payment_gs, r.duplicates_discarded) == (2, 150000, 4, 75000, '{"card":100000,"cash":50000}', 1)


def test_merging_parts_counts_overlaps_once(spark):
    parts = spark.createDataFrame([("k", "a", 1, 100, 1, "card", 1), ("k", "b", 2, 50, 1, "cash", 1), ("k", "a", 3, 100, 1, "card", 1)], "key string, event_id string, arrival long, amount_gs long, items long, payment string, copies long")
    r = aggregate.totals(aggregate.merge_partials(parts, ["key"]), ["key"]).first()
    assert (r.ticket_count, r.total_amount_gs, r.duplicates_discarded) == (2, 150, 1)


def test_average_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (5, 2), (0, 0), (7, 3)], "t long, n long")
    assert [r[0] for r in df.select(aggregate.half_even_average(F.col("t"), F.col("n"))).collect()] == [0, 2, 2, 0, 2]


def test_windows_are_aligned_to_the_epoch(spark):
    df = spark.sql("SELECT timestamp'1969-12-31 23:59:59.5' AS t UNION ALL SELECT timestamp'2026-09-21 10:00:00' UNION ALL SELECT timestamp'2026-09-21 10:00:59.999999'")
    got = sorted(r[0] for r in df.select(iso_utc(window_start(F.col("t"), 60))).collect())
    assert got == ["1969-12-31T23:59:00.000Z", at("10:00:00.000"), at("10:00:00.000")]
    assert spark.sql("SELECT timestamp'2026-09-21 10:00:59.999999' AS t").select(iso_utc(F.col("t"))).first()[0] == at("10:00:59.999")


def panes(spark, versions, start=0):
    rows = [("k", i, "LATE", n, n * 10000, start + j) for j, (i, n) in enumerate(versions)]
    return spark.createDataFrame(rows, PANE)


@pytest.mark.parametrize(
    ("versions", "tickets", "received"),
    [([(0, 3), (1, 5)], 5, 2), ([(2, 7), (2, 7), (1, 5)], 7, 2), ([(0, 15), (0, 0)], 15, 1), ([(4, 20), (0, 21)], 21, 2), ([(0, 1), (1, 2), (2, 3)] * 2, 3, 4)],
)
def test_versions(spark, versions, tickets, received):
    rows = panes(spark, versions)
    assert state.final_state(rows).first().ticket_count == tickets
    assert state.panes_received(rows).first().panes_recibidos == received
    stored = rows.drop("arrival").limit(0).withColumn("panes_recibidos", F.lit(0).cast("long"))
    for cut in range(len(versions) + 1):
        table = state.upsert(stored, panes(spark, versions[:cut]))
        table = state.upsert(table, panes(spark, versions[cut:], 100))
        assert (table.first().ticket_count, table.first().panes_recibidos) == (tickets, received)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), min_size=1, max_size=6), st.randoms())
def test_replays_and_orders_give_one_state(spark, versions, rng):
    again = versions + versions[: rng.randint(0, len(versions))]
    rng.shuffle(again)
    key = lambda rows: [(r.ticket_count, r.pane_index) for r in state.final_state(rows).collect()]
    assert key(panes(spark, versions)) == key(panes(spark, again)) == [max((n, i) for i, n in versions)]


def test_rejects_are_kept_once(spark):
    rows = [("m", "e", "x", 0, 1), ("m", "e", "x", 0, 2), ("m", None, "x", 0, 3), ("m", None, "x", 0, 4), ("m", None, "x", 0, 4), ("n", "e", "x", 0, 5)]
    df = spark.createDataFrame(rows, "motivo string, event_id string, mensaje_original string, partition int, arrival long")
    assert {r.motivo: r.n for r in state.reject_counts(state.dedup_rejects(df)).collect()} == {"m": 3, "n": 1}


def test_missing_pane_fields_get_defaults(spark):
    df = spark.createDataFrame([("k", None, None)], "aggregate_id string, pane_timing string, items long")
    assert tuple(state.with_defaults(df).first()) == ("k", "UNKNOWN", 0)


def test_report(spark):
    rows = panes(spark, [(0, 3), (1, 5)])
    table = state.final_state(rows).join(state.panes_received(rows), "aggregate_id").selectExpr("*", "'w' window_start", "'x' window_end", "'S1' store_id", "0 duplicates_discarded")
    rejects = spark.createDataFrame([("m", "d", None, None, "t")], "motivo string, detalle string, event_id string, event_time string, rechazado_en string")
    text = report.report(table, rejects)
    assert "k            | w" in text and '"panes_aplicados_acumulados": 2' in text and '"m": 1' in text
    assert report.format_table(table.limit(0), report.RESULT_COLUMNS) == "(sin filas)"
    assert report.result_rows(table, "S2").count() == 0


def test_outgoing_records(spark):
    core = build_core(records(spark, [sale(), "{"]), SETTINGS)
    out = sinks.aggregate_records(core.results).first()
    assert out.key == f"S1|{at('10:09:00.000')}" and '"by_payment_gs":{"card":100000}' in out.value and out.value.startswith('{"aggregate_id":')
    bad = sinks.reject_records(core.rejects()).first()
    assert bad.key == "S1" and '"event_id":null' in bad.value
    nameless = core.rejects().withColumn("key", F.lit(None).cast("string"))
    assert sinks.reject_records(nameless).first().key == "sin-clave"


def test_messages_are_routed_by_topic(spark):
    s = Settings()
    df = spark.createDataFrame([(s.aggregates_topic, '{"a":1}'), (s.dlq_topic, "{}"), (s.dlq_topic, "[1]"), (s.aggregates_topic, "{")], "topic string, value string")
    assert [part.count() for part in route(df, s)] == [1, 1, 2]


def test_settings_from_the_environment():
    found = Settings.from_env({"WINDOW_SECONDS": "3600", "SQLITE_PATH": "x", "KAFKA_TOPICO_DLQ": "d", "OTHER": "1"})
    assert (found.window_seconds, found.table_path, found.dlq_topic, found.late_horizon_seconds) == (3600, "x", "d", 3630)
