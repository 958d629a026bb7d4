"""Contract reasons, version upgrade, clocks and lateness, on literal events."""

import json

import pytest
from .helpers import NOW, SETTINGS, at, records, sale, shift, without

from salegrain.operators.validate import validate
from salegrain.plans.core import build_core, judge

CASES = [
    ("valid", sale(), None),
    ("no payload", without(sale(), "payload"), "campos_faltantes"),
    ("no key", without(sale(), "key"), "campos_faltantes"),
    ("version 99", sale(version=99), "version_no_soportada"),
    ("version true", sale(version=True), "version_no_soportada"),
    ("version 2.0", json.dumps(sale()).replace('"schema_version": 2', '"schema_version": 2.0'), "version_no_soportada"),
    ("version text", sale(version="2"), "version_no_soportada"),
    ("other type", sale() | {"event_type": "sale.cancelled"}, "event_type_desconocido"),
    ("empty id", sale() | {"event_id": ""}, "event_id_invalido"),
    ("null id", sale() | {"event_id": None}, "event_id_invalido"),
    ("number id", sale() | {"event_id": 7}, "event_id_invalido"),
    ("time word", sale(event_time="ayer"), "event_time_invalido"),
    ("time only", sale(event_time="T10:00"), "event_time_invalido"),
    ("year only", sale(event_time="2026"), "event_time_invalido"),
    ("time number", sale(event_time=20260921), "event_time_invalido"),
    ("naive time", sale(event_time="2026-09-21T10:09:30"), None),
    ("offset time", sale(event_time="2026-09-21T07:09:30-03:00"), None),
    ("payload null", sale() | {"payload": None}, "payload_incompleto"),
    ("payload empty list", sale() | {"payload": []}, "payload_incompleto"),
    ("payload text", sale() | {"payload": "abc"}, "payload_invalido"),
    ("payload number", sale() | {"payload": 5}, "payload_invalido"),
    ("no ticket", without(sale(), "payload", "ticket_id"), "payload_incompleto"),
    ("other store", sale(store_id="S9"), "clave_inconsistente"),
    ("negative amount", sale(amount=-5), "monto_invalido"),
    ("zero amount", sale(amount=0), "monto_invalido"),
    ("amount true", sale(amount=True), "monto_invalido"),
    ("amount text", sale(amount="5"), "monto_invalido"),
    ("amount beyond a long", sale(amount=10**25), "monto_invalido"),
    ("amount half", sale(amount=0.5), None),
    ("items 0", sale(items=0), "items_invalido"),
    ("items 3.0", json.dumps(sale(items=3)).replace('"items": 3', '"items": 3.0'), "items_invalido"),
    ("items true", sale(items=True), "items_invalido"),
    ("payment", sale(payment="cripto"), "metodo_pago_desconocido"),
    ("amount before items", sale(amount=-1, items=0, payment="x"), "monto_invalido"),
    ("truncated", '{"schema_version": 2, "event_id"', "json_invalido"),
    ("not utf-8", b'{"a": "\xff"}', "json_invalido"),
    ("null", "null", "no_es_objeto"),
    ("array", "[1]", "no_es_objeto"),
    ("number", "3", "no_es_objeto"),
    ("future", sale(event_time="10:30:00.000"), "reloj_futuro"),
    ("future limit", sale(event_time=shift(120)), None),
    ("future beyond", sale(event_time=shift(120.001)), "reloj_futuro"),
    ("past limit", sale(event_time=shift(-86400)), None),
    ("past beyond", sale(event_time=shift(-86400.001)), "reloj_pasado"),
    ("duplicate keys", json.dumps(sale())[:-1] + ', "schema_version": 1}', None),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = validate(records(spark, [value for _, value, _ in CASES]), SETTINGS).orderBy("arrival").collect()
    return dict(zip([name for name, _, _ in CASES], rows, strict=True))


@pytest.mark.parametrize(("name", "reason"), [(name, reason) for name, _, reason in CASES])
def test_reason(judged, name, reason):
    row = judged[name]
    assert (row.reject and row.reject.motivo) == reason
    assert (row.sale is None) == (reason is not None and not reason.startswith("reloj"))


def test_details_name_the_missing_fields(spark):
    event = without(without(sale(), "payload", "pos_id"), "payload", "amount_gs")
    rows = validate(records(spark, [event, without(without(sale(), "key"), "payload")]), SETTINGS).orderBy("arrival").collect()
    assert [r.reject.detalle for r in rows] == ["pos_id,amount_gs", "key,payload"]


def test_upgrade_sets_only_absent_fields(spark):
    old = without(sale(version=1), "payload", "channel")
    kept = sale(version=1, channel="delivery")
    new = without(sale(), "payload", "channel")
    rows = validate(records(spark, [old, kept, new]), SETTINGS).orderBy("arrival").collect()
    assert [(r.sale.channel, r.sale.schema_version, r.sale.produced_at) for r in rows] == [("store", 2, None), ("delivery", 2, None), (None, 2, None)]


def test_fractions_are_cut_off(spark):
    rows = validate(records(spark, [sale(amount=2.9), sale(amount=0.5), sale(amount=1e6)]), SETTINGS).orderBy("arrival").collect()
    assert [r.sale.amount_gs for r in rows] == [2, 0, 1000000]


def test_too_late_is_behind_the_latest_before(spark):
    times = ["10:05:00", "10:00:00", "10:03:31", "10:03:30", "10:03:29.999"]
    rows = judge(records(spark, [sale(f"S1-{i}", f"{t}" if "." in t else f"{t}.000") for i, t in enumerate(times)]), SETTINGS).orderBy("arrival").collect()
    assert [r.reject and r.reject.motivo for r in rows] == [None, "demasiado_tardio", None, None, "demasiado_tardio"]


def test_lateness_is_judged_in_each_partition(spark):
    a = records(spark, [sale("a", "10:05:00.000")], partition=0)
    b = records(spark, [sale("b", "10:00:00.000")], partition=1, start=10)
    both = a.unionByName(b)
    assert build_core(both, SETTINGS).very_late.count() == 0
    assert build_core(both, SETTINGS, scope=[]).very_late.count() == 1


def test_implausible_times_do_not_move_the_latest(spark):
    values = [sale("a", "10:05:00.000"), sale("b", "10:30:00.000"), sale("c", "10:04:00.000")]
    assert build_core(records(spark, values), SETTINGS).very_late.count() == 0


def test_side_outputs(spark):
    core = build_core(records(spark, [sale(), "{", sale(event_time="10:30:00.000"), without(sale(), "payload", "amount_gs")]), SETTINGS)
    assert core.accepted.count() == 1
    assert sorted(r.motivo for r in core.invalid.collect()) == ["json_invalido", "payload_incompleto", "reloj_futuro"]
    row = core.rejects().where("motivo = 'reloj_futuro'").first()
    assert (row.event_id, row.event_time, row.amount_gs, row.key) == ("S1-1", at("10:30:00.000"), 100000, "S1")
    assert row.rechazado_en == "2026-09-21T10:10:00.000Z" and json.loads(row.mensaje_original)["event_id"] == "S1-1"


def test_running_max_in_chunks(spark):
    from salegrain.operators.lateness import running_max_before

    rows = [(k % 3, i, (i * 7919) % 101) for i in range(300) for k in range(3)]
    df = spark.createDataFrame(rows, "scope int, pos long, value long")
    for chunk in (7, 1000):
        found = running_max_before(df, "value", "pos", ["scope"], "top", chunk).collect()
        for r in found:
            assert r.top == max(((i * 7919) % 101 for i in range(r.pos)), default=None)


def test_now_is_fixed(spark):
    assert validate(records(spark, [sale()]), SETTINGS).first().arrival_time.replace(tzinfo=NOW.tzinfo) == NOW
