"""Builders of sale records for the tests."""

import json
from datetime import UTC, datetime, timedelta

from salegrain.config import Settings

NOW = datetime(2026, 9, 21, 10, 10, tzinfo=UTC)
SETTINGS = Settings()
RECORDS = "key string, value binary, partition int, arrival long, arrival_time timestamp"


def at(clock):
    """A UTC time on the test day."""
    return f"2026-09-21T{clock}Z"


def sale(event_id="S1-1", event_time="10:09:30.000", store="S1", amount=100000, payment="card", items=2, version=2, **payload):
    body = {"store_id": store, "pos_id": "pos-01", "ticket_id": f"T-{event_id}", "amount_gs": amount, "items": items, "payment": payment, "channel": "store"}
    time = at(event_time) if isinstance(event_time, str) and event_time[:2].isdigit() and event_time[2:3] == ":" and len(event_time) >= 8 else event_time
    return {"schema_version": version, "event_id": event_id, "event_type": "sale.confirmed", "event_time": time, "key": store, "payload": body | payload}


def without(event, *path):
    *outer, last = path
    inner = event
    for name in outer:
        inner = inner[name]
    del inner[last]
    return event


def records(spark, values, now=NOW, partition=0, start=0):
    """Records in order of arrival; values are events, texts, or bytes."""
    encode = lambda v: v if isinstance(v, bytes) else (v if isinstance(v, str) else json.dumps(v)).encode()
    rows = [("S1", bytearray(encode(v)), partition, start + i, now) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RECORDS)


def shift(seconds):
    return (NOW + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
