"""The workload generator, the demo, and the smoke run."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from .helpers import NOW, SETTINGS
from pyspark.sql import functions as F

from salegrain import cli
from salegrain.operators.validate import validate
from salegrain.sources import generator as gen
from salegrain.sources.records import read_jsonl, reference_now, with_arrival


def made(spark, intents, seed=7):
    rows = spark.createDataFrame(intents, gen.INTENTS)
    return gen.messages(rows, seed).orderBy("sent", "number", "label").collect()


def test_sales_repeat_for_a_seed_and_have_unique_ids(spark):
    intents = [(i, "OK", NOW, NOW) for i in range(400)]
    rows = made(spark, intents)
    assert rows == made(spark, intents) and [r.value for r in rows] != [r.value for r in made(spark, intents, seed=8)]
    assert len({r.event_id for r in rows}) == 400
    sales = [json.loads(r.value) for r in rows]
    assert {s["schema_version"] for s in sales} == {1, 2} and all("channel" not in s["payload"] for s in sales if s["schema_version"] == 1)
    assert {s["payload"]["channel"] for s in sales if s["schema_version"] == 2} == {"store", "delivery"}
    assert all(s["payload"]["amount_gs"] >= 5000 and s["payload"]["amount_gs"] % 1000 == 0 and s["payload"]["items"] >= 1 for s in sales)
    assert {s["key"] for s in sales} == {name for name, _ in gen.STORES} and {s["payload"]["pos_id"] for s in sales} == {"pos-01", "pos-02", "pos-03"}


def test_shares(spark):
    """Stores, payments, versions, items and amounts come out as their fixed values say."""
    n = 40_000
    rows = spark.range(n).withColumnRenamed("id", "number").select(*[c.alias(k) for k, c in gen.sale_fields(3).items()])
    share = lambda column: {r[0]: r["count"] / n for r in rows.groupBy(column).count().collect()}
    for column, want in (("store", gen.STORES), ("payment", gen.PAYMENTS)):
        assert share(column) == pytest.approx(dict(want), abs=0.01)
    assert share("version")[1] == pytest.approx(0.2, abs=0.01) and share("channel")["store"] == pytest.approx(0.9, abs=0.01)
    items, price = rows.agg(F.avg("items"), F.expr("median(amount / items)")).first()
    assert items == pytest.approx(1 / (1 - 2.718281828 ** (-1 / 2.5)), abs=0.05) and price == pytest.approx(120_000, rel=0.03)


def test_broken_sales_have_their_reasons(spark):
    rows = made(spark, [(1, f"INVALIDO:{kind}", NOW, NOW + timedelta(seconds=i)) for i, kind in enumerate(gen.BROKEN_KINDS)])
    records = spark.createDataFrame([(r.key, bytearray(r.value.encode()), 0, i, NOW) for i, r in enumerate(rows)], "key string, value binary, partition int, arrival long, arrival_time timestamp")
    found = validate(records, SETTINGS).orderBy("arrival").collect()
    assert [r.reject.motivo for r in found] == ["json_invalido", "monto_invalido", "campos_faltantes", "reloj_futuro", "version_no_soportada", "metodo_pago_desconocido"]


def test_late_times():
    start = datetime(2026, 9, 21, 10, 10, tzinfo=UTC).timestamp()
    assert [gen.until_settled(start + s, SETTINGS) for s in (5, 15, 18, 25, 40)] == [10, 0, 0, 0, 35]
    assert gen.late_range(SETTINGS) == (2, 58) and gen.too_late_range(SETTINGS) == (120, 210)
    assert gen.late_is_possible(SETTINGS) and not gen.late_is_possible(type(SETTINGS)(allowed_lateness_seconds=19))


def test_runs_make_every_label(spark):
    rates = gen.Rates(0.3, 0.3, 0.3, 0.2, 0.3)
    rows = gen.messages(gen.run_intents(spark, SETTINGS, NOW, 200, 4.0, rates)).collect()
    assert {r.label.split(":")[0] for r in rows} == {"OK", "DESORDEN", "DUPLICADO", "TARDIO", "MUY_TARDIO", "INVALIDO"}
    main = {r.event_id: r for r in rows if r.label in ("OK", "DESORDEN")}
    assert len(main) == 800
    size = SETTINGS.window_seconds
    for r in rows:
        at, sent = (t.replace(tzinfo=None) for t in (r.at, r.sent))
        behind = (sent - at).total_seconds()
        if r.label == "DUPLICADO":
            assert (r.value, r.at) == (main[r.event_id].value, main[r.event_id].at) and behind <= 7
        elif r.label == "TARDIO":
            into = sent.replace(tzinfo=UTC).timestamp() % size
            assert 15 <= into <= 25 and 2 <= behind - into <= 58
        elif r.label == "MUY_TARDIO":
            assert 120 <= behind <= 210
        elif r.label == "DESORDEN":
            assert 2 <= behind <= 9
    assert gen.run_intents(spark, SETTINGS, NOW, 0, 4.0, rates).count() == 0


@pytest.mark.parametrize("watched", [False, True])
def test_demo_counts(watched):
    asked = []
    seen = (lambda end: asked.append(end) or len(asked) >= 3) if watched else None
    steps = list(gen.script(gen.DEMO, SETTINGS, NOW + timedelta(seconds=3), seen=seen))
    count = lambda label: sum(s.label.startswith(label) for s in steps)
    assert [count(x) for x in ("DUPLICADO", "DESORDEN", "TARDIO", "MUY_TARDIO", "INVALIDO")] == [3, 5, 1, 1, 6]
    assert count("OK") >= 123 and (len(asked) == 3) == watched
    times = [s.at for s in steps if s.label == "DESORDEN"]
    assert times == sorted(times, reverse=True)
    assert [s.label.split(":")[1] for s in steps if ":" in s.label] == list(gen.BROKEN_KINDS)
    late = next(s for s in steps if s.label == "TARDIO")
    assert not watched or asked[0] - timedelta(seconds=58) <= late.at <= asked[0] - timedelta(seconds=2)
    again = [s.number for s in steps if s.label == "DUPLICADO"]
    assert all(sum(s.number == n for s in steps) == 2 for n in again)


def test_a_late_sale_waits_no_longer_than_its_horizon():
    steps = list(gen.script(gen.DEMO[3:4], SETTINGS, NOW + timedelta(seconds=3), seen=lambda end: False))
    assert steps[-1].label == "TARDIO" and (steps[-1].sent - NOW).total_seconds() < 60 + 90 + 5


def test_the_watcher_reads_the_result_table(spark):
    end = NOW + timedelta(minutes=1)
    text = end.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    table = spark.createDataFrame([(text, "EARLY"), ("other", "LATE")], "window_end string, pane_timing string")
    assert not gen.OnTimeWatcher(lambda: None)(end) and not gen.OnTimeWatcher(lambda: table)(end)
    assert gen.OnTimeWatcher(lambda: table.withColumn("pane_timing", F.lit("ON_TIME")))(end)


def test_wrong_clocks_keep_the_record_time(spark):
    (row,) = made(spark, [(1, "INVALIDO:reloj_futuro", NOW, NOW)])
    assert row.at.replace(tzinfo=None) == NOW.replace(tzinfo=None) and json.loads(row.value)["event_time"] == "2026-09-21T10:20:00.000Z"


def test_offsets_follow_the_time_of_sending(spark):
    sent = gen.messages(gen.run_intents(spark, SETTINGS, NOW, 300, 4.0, gen.USUAL))
    rows = gen.log_lines(sent, 3).orderBy("partition", "offset").collect()
    for p in range(3):
        own = [r for r in rows if r.partition == p]
        assert [r.offset for r in own] == list(range(len(own))) and [r.sent for r in own] == sorted(r.sent for r in own)


def test_run_file_and_batch_job(spark, tmp_path):
    counts = gen.write_run(spark, f"{tmp_path}/run.jsonl", SETTINGS, NOW, 120)
    assert counts["enviados"] == sum(counts["por_etiqueta"].values()) > 480
    rows = read_jsonl(spark, f"{tmp_path}/run.jsonl")
    assert rows.count() == counts["enviados"] and reference_now(rows).first().now is not None
    core = cli.run_batch(spark, f"{tmp_path}/run.jsonl", f"{tmp_path}/out", SETTINGS)
    assert core.results.count() == spark.read.json(f"{tmp_path}/out/agregados.jsonl").count() > 0
    assert spark.read.json(f"{tmp_path}/out/rechazos.jsonl").count() == core.rejects().count() > 0
    assert read_jsonl(spark, f"{tmp_path}/run.jsonl", most=7).count() == 7


def test_records_without_offsets_arrive_by_file_and_line(spark, tmp_path):
    for name, n in (("b", 3), ("a", 2), ("c", 4000)):
        with open(f"{tmp_path}/{name}.jsonl", "w") as file:
            file.writelines(json.dumps({"key": "S1", "value": f"{name}{i}", "timestamp_ms": 1}) + "\n" for i in range(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = with_arrival(read_jsonl(spark, str(tmp_path)), F.lit(None).cast("timestamp")).orderBy("arrival").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == ["a0", "a1", "b0", "b1", "b2", *[f"c{i}" for i in range(4000)]]


def test_commands_from_stream_to_materialized_tables(spark, tmp_path, capsys):
    gen.write_run(spark, f"{tmp_path}/in/run.jsonl", SETTINGS, NOW, 60, rates=gen.Rates(duplicates=0.1, broken=0.1))
    assert cli.main(["stream", f"{tmp_path}/in", f"{tmp_path}/table", "--available-now", "--publish", f"{tmp_path}/topics"]) == 0
    assert cli.main(["report", f"{tmp_path}/table"]) == 0
    shown = capsys.readouterr().out
    assert "== resumen ==" in shown and '"version_no_soportada"' in shown and "EARLY" in shown
    assert cli.main(["materialize", f"{tmp_path}/topics", f"{tmp_path}/kept", "--available-now", "--report", "--most", "2"]) == 0
    again = capsys.readouterr().out
    figures = lambda text: json.loads(text[text.index("{\n") :])
    assert figures(again) == figures(shown)
    assert cli.main(["report", f"{tmp_path}/kept", "--kind", "materialized"]) == 0


def test_topics_are_made_as_laid_out(capsys):
    assert cli.main(["topics"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 3 and "--partitions 4 --config cleanup.policy=compact" in lines[1] and "--partitions 2 --config retention.ms=604800000" in lines[2]


def test_smoke(spark):
    assert cli.run_smoke(spark, SETTINGS)["passed"]


def test_demo_and_command_line(spark, tmp_path, capsys):
    assert cli.main(["generate", f"{tmp_path}/d.jsonl", "--mode", "demo"]) == 0
    counts = json.loads(capsys.readouterr().out)
    assert counts["por_etiqueta"]["DUPLICADO"] == 3
    assert sum(1 for _ in open(f"{tmp_path}/d.jsonl")) == counts["enviados"]
