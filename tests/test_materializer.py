"""Messages of both output topics into the keyed tables, with replays."""

import json

from .helpers import SETTINGS

from salegrain.streaming.materializer import Materializer

MESSAGES = "topic string, value string, partition int, arrival long"


def pane(index, tickets, timing="LATE", key="S1|w", **more):
    body = {"aggregate_id": key, "store_id": "S1", "window_start": "w", "window_end": "x", "pane_index": index, "pane_timing": timing, "ticket_count": tickets}
    return json.dumps(body | {"total_amount_gs": tickets * 10000, "by_payment_gs": {"qr": 1, "card": tickets}} | more)


def reject(event_id, reason="reloj_futuro"):
    return json.dumps({"motivo": reason, "event_id": event_id, "mensaje_original": "{}", "rechazado_en": "t"})


def messages(spark, values, start=0):
    a, d = SETTINGS.aggregates_topic, SETTINGS.dlq_topic
    return spark.createDataFrame([(d if t == "d" else a, v, i % 2, start + i) for i, (t, v) in enumerate(values)], MESSAGES)


def test_batches_are_routed_and_replays_change_nothing(spark, tmp_path):
    job = Materializer(spark, SETTINGS, f"{tmp_path}/m")
    first = messages(spark, [("a", pane(0, 3, "EARLY")), ("a", pane(1, 5)), ("d", reject("e1")), ("a", "{broken"), ("d", reject(None)), ("a", pane(0, 2, key="S2|w"))])
    job.take(first, 0)
    job.take(first, 0)
    job.take(messages(spark, [("a", pane(0, 0)), ("d", reject("e1")), ("d", reject(None)), ("a", pane(0, 21))], start=6), 1)
    rows = {r.aggregate_id: r for r in job.results.read().collect()}
    assert {k: (r.ticket_count, r.pane_index, r.panes_recibidos) for k, r in rows.items()} == {"S1|w": (21, 0, 3), "S2|w": (2, 0, 1)}
    assert rows["S1|w"].by_payment_gs == '{"card":21,"qr":1}' and rows["S1|w"].emitted_at == ""
    assert sorted(r.event_id or "" for r in job.rejects.read().collect()) == ["", "", "e1"]
    assert {r.outcome: r.n for r in job.outcomes().collect()} == {"upsert": 5, "rechazo": 4, "ilegible": 1}
    assert {(r.topic == SETTINGS.dlq_topic, r.partition): r.offset for r in job.offsets().collect()} == {(False, 0): 6, (False, 1): 9, (True, 0): 8, (True, 1): 7}


def test_a_second_table_from_the_same_log_is_equal(spark, tmp_path):
    values = [("a", pane(i, n)) for i, n in [(0, 1), (1, 4), (1, 4), (2, 4), (0, 0)]]
    stream = f"{tmp_path}/in"
    messages(spark, values).coalesce(1).write.json(stream)
    states = []
    for name in ("one", "two"):
        job = Materializer(spark, SETTINGS, f"{tmp_path}/{name}")
        source = spark.readStream.schema(MESSAGES).json(stream)
        job.start(source, f"{tmp_path}/{name}", availableNow=True).awaitTermination()
        states.append([tuple(r) for r in job.results.read().collect()])
    assert states[0] == states[1] and len(states[0]) == 1
