"""Command line: generate a workload, run the batch or streaming job over files or Kafka, report, smoke test.

``python -m salegrain.cli generate|batch|stream|materialize|report|topics|smoke --help``
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings, prepare
from .operators import report as reports
from .plans.core import core_of, judge
from .sources import generator, sinks
from .sources.records import read_jsonl, reference_now, stream_jsonl, stream_kafka, with_arrival
from .streaming.jobs import work_dir


def session(name: str) -> SparkSession:
    return prepare(SparkSession.builder.appName(name).getOrCreate())


def run_batch(spark: SparkSession, source: str, out: str, settings: Settings, most: int | None = None):
    """Results and rejects of JSON Lines files as two folders of one JSON Lines file each; returns the core over what was written.

    "Now" is the greatest record time and five seconds, so that a file gives the same result at any time. Records are judged
    once, and the judged table is written; at most the first ``most`` records are taken, if asked.
    """
    records = read_jsonl(spark, source, most)
    now = reference_now(records).first()["now"]
    arrived = with_arrival(records.withColumn("arrival_time", F.lit(None).cast("timestamp")), now)
    path = work_dir(spark, "judged")
    judge(arrived, settings).write.parquet(path)
    core = core_of(spark.read.parquet(path), settings)
    sinks.write_jsonl(core.results, f"{out}/{sinks.AGGREGATES_DIR}")
    sinks.write_jsonl(core.rejects().drop("partition", "arrival"), f"{out}/{sinks.REJECTS_DIR}")
    return core


def run_smoke(spark: SparkSession, settings: Settings) -> dict:
    """The known batch through the batch job, and its four invariants."""
    folder = work_dir(spark, "smoke")
    sent = generator.messages(generator.step_intents(spark, generator.smoke_steps(settings, datetime.now(UTC))))
    generator.write_lines(generator.log_lines(sent, partitions=1), f"{folder}/in")
    core = run_batch(spark, f"{folder}/in", f"{folder}/out", settings)
    totals = core.results.agg(F.sum("ticket_count"), F.sum("duplicates_discarded")).first()
    found = {"tickets": totals[0], "duplicates": totals[1], "very_late": core.very_late.count(), "invalid": core.invalid.count()}
    return found | {"passed": found == {"tickets": 50, "duplicates": 3, "very_late": 1, "invalid": 3}}


def show_tables(results, rejects) -> None:
    if results is None or rejects is None:
        print("(sin filas)")
    else:
        print(reports.report(results, rejects))


def run_generate(spark: SparkSession, options, settings: Settings) -> dict:
    now = datetime.now(UTC)
    if options.mode == "run":
        rates = generator.Rates() if options.only_valid else generator.USUAL
        return generator.write_run(spark, options.out, settings, now, options.seconds, options.rate, rates, options.seed)
    steps = generator.smoke_steps(settings, now) if options.mode == "smoke" else list(generator.script(generator.DEMO, settings, now, options.seed))
    return generator.write_steps(spark, options.out, steps, options.seed, partitions=1 if options.mode == "smoke" else 4)


def run_stream(spark: SparkSession, options, settings: Settings) -> None:
    from .streaming.jobs import start_pane_job

    if options.source == "kafka":
        records = stream_kafka(spark, settings, [settings.sales_topic], options.most)
    else:
        records = with_arrival(stream_jsonl(spark, options.source), datetime.now(UTC))
    publish = {"kafka": sinks.to_kafka(settings), None: None}.get(options.publish, sinks.to_folders(options.publish or ""))
    trigger = {"availableNow": True} if options.available_now else {}
    for query in start_pane_job(records, settings, options.table, publish=publish, **trigger):
        query.awaitTermination()


def run_materialize(spark: SparkSession, options, settings: Settings) -> None:
    """The topics of results and rejects into keyed tables, then the report; at most about ``most`` messages in a micro-batch."""
    from .streaming.materializer import Materializer, read_topic_folders

    job = Materializer(spark, settings, options.table)
    if options.source == "kafka":
        messages = stream_kafka(spark, settings, [settings.aggregates_topic, settings.dlq_topic], options.most)
    else:
        messages = read_topic_folders(spark, settings, options.source, options.most)
    trigger = {"availableNow": True} if options.available_now else {}
    job.start(messages, options.table, **trigger).awaitTermination()
    outcomes = job.outcomes()
    print(json.dumps({r["outcome"]: r["n"] for r in outcomes.collect()} if outcomes is not None else {}))
    if options.report:
        show_tables(job.results.read(), job.rejects.read())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="salegrain")
    commands = top.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate")
    make.add_argument("out")
    make.add_argument("--mode", choices=("run", "demo", "smoke"), default="run")
    make.add_argument("--rate", type=float, default=4.0)
    make.add_argument("--seconds", type=float, default=60.0)
    make.add_argument("--seed", type=int, default=7)
    make.add_argument("--only-valid", action="store_true")
    batch = commands.add_parser("batch")
    batch.add_argument("source")
    batch.add_argument("out")
    batch.add_argument("--most", type=int, help="take the first so many records")
    stream = commands.add_parser("stream")
    stream.add_argument("source", help="folder of JSON Lines files, or kafka")
    stream.add_argument("table")
    stream.add_argument("--available-now", action="store_true")
    stream.add_argument("--publish", help="also send results and rejects: kafka, or a folder for one folder a topic")
    stream.add_argument("--most", type=int, help="records of a micro-batch, from Kafka")
    tables = commands.add_parser("materialize")
    tables.add_argument("source", help="folder with one folder a topic, or kafka")
    tables.add_argument("table")
    tables.add_argument("--available-now", action="store_true")
    tables.add_argument("--most", type=int, help="messages (Kafka) or files of a micro-batch")
    tables.add_argument("--report", action="store_true")
    show = commands.add_parser("report")
    show.add_argument("table")
    show.add_argument("--kind", choices=("job", "materialized"), default="job")
    commands.add_parser("topics", help="print the commands that make the topics")
    commands.add_parser("smoke")
    return top


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    settings = Settings.from_env()
    if options.command == "topics":
        from .streaming.materializer import topic_commands

        print("\n".join(topic_commands(settings)))
        return 0
    spark = session(settings.job_name)
    if options.command == "generate":
        print(generator.printed(run_generate(spark, options, settings)))
    elif options.command == "batch":
        core = run_batch(spark, options.source, options.out, settings, options.most)
        print(json.dumps({"results": core.results.count(), "rejects": core.rejects().count()}))
    elif options.command == "smoke":
        found = run_smoke(spark, settings)
        print(json.dumps(found))
        return 0 if found["passed"] else 1
    elif options.command == "stream":
        run_stream(spark, options, settings)
    elif options.command == "materialize":
        run_materialize(spark, options, settings)
    else:
        from .streaming.jobs import pane_rejects, pane_results
        from .streaming.keyed_table import RejectTable

        rejects = pane_rejects(spark, options.table) if options.kind == "job" else RejectTable(spark, f"{options.table}/rejects").read()
        show_tables(pane_results(spark, options.table), rejects)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
