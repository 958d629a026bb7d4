"""Settings of the sales-per-window engine."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

#: Environment names that differ from the field's name in capitals.
_ENV = {
    "sales_topic": "KAFKA_TOPICO_VENTAS",
    "aggregates_topic": "KAFKA_TOPICO_AGREGADOS",
    "dlq_topic": "KAFKA_TOPICO_DLQ",
    "table_path": "SQLITE_PATH",
    "job_name": "BEAM_JOB_NAME",
}


@dataclass(frozen=True)
class Settings:
    """Window, lateness and clock limits in seconds; names of topics and places."""

    window_seconds: int = 60
    allowed_lateness_seconds: int = 30
    early_firing_seconds: int = 10
    max_future_skew_seconds: int = 120
    max_past_skew_seconds: int = 86_400
    kafka_bootstrap_servers: str = "kafka:9092"
    sales_topic: str = "ventas.confirmadas.v1"
    aggregates_topic: str = "ventas.por_ventana.v1"
    dlq_topic: str = "ventas.dlq.v1"
    table_path: str = "tmp/ventas"
    job_name: str = "ventas-por-ventana"

    @property
    def late_horizon_seconds(self) -> int:
        """How far an event may lie behind the latest one before it is too late."""
        return self.window_seconds + self.allowed_lateness_seconds

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        found = {f.name: env[_ENV.get(f.name, f.name.upper())] for f in fields(cls) if _ENV.get(f.name, f.name.upper()) in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{name: kinds[name](value) for name, value in found.items()})


#: Production values: hourly windows, half an hour of lateness, early results each five minutes.
PRODUCTION = Settings(window_seconds=3600, allowed_lateness_seconds=1800, early_firing_seconds=300)


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings the engine relies on: UTC, and the last of duplicate JSON keys wins."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark
