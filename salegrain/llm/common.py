"""Shared folder, scratch tables and text rules used by the text operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word or pad a line.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWEST_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset in local mode (tests) a temporary folder is made and set once per session; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="salegrain-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of an Arrow batch on its way to a Python worker. Batches of long texts would else be 64 MB, held by the JVM and
#: by the worker at once for each core.
ARROW_BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def workers_can_import(spark: SparkSession) -> None:
    """Put this package's folder on the Python workers' path, as local runs from other folders need it.

    A cluster gets the package by ``--py-files`` or an installation.
    """
    bound_batches(spark)
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


ROWS_PER_FILE = 100_000


def files_for(rows: int) -> int:
    """In how many files at most so many rows are written, where there are as many partitions."""
    return max(1, -(-rows // ROWS_PER_FILE))


_made: list[Scratch] = []


@atexit.register
def _drop_scratch() -> None:
    """At the end of the application its scratch tables go, as far as its session still runs."""
    for scratch in _made:
        if scratch.spark.sparkContext._jsc is not None:
            for name in list(scratch.tables):
                scratch.drop(name)
            scratch.drop("")


class Scratch:
    """Written tables below the shared folder: they cut lineage and outlive lost executors.

    A result is lazy and reads its last tables whenever it is used, so these stay until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self.tables: dict[str, str] = {}
        _made.append(self)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
        """Write and read again. ``rows`` is a bound on the rows that come out of the last shuffle, where it is known:
        a table is then written in files of up to ``ROWS_PER_FILE``, not in one for each shuffle partition."""
        if rows is not None:
            df = df.coalesce(files_for(rows))
        writer = df.write.mode("errorifexists").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.path}/{name}")
        self.names.add(name)
        return self.read(name, df)

    def write_bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
        """Write an external table, bucketed and sorted by ``keys``; read it with ``bucketed``."""
        table = f"salegrain_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
        self.names.add(name)
        self.tables[name] = table

    def bucketed(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now; it does so when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        for name in self.names - set(names):
            self.drop(name)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        self.names.discard(name)
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    pure = F.octet_length(text) == F.length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use in higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents_of(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text and two key columns: ``_id`` (null id: the smallest long) and ``_th`` (hash of the text).

    (``_id``, ``_th``) finds a row again after a shuffle, also where ids are null or repeated. With ``carry`` the columns
    besides text come along in a struct ``_row``, where no name can clash.
    """
    rest = [F.col(f"`{name}`") for name in docs.columns if name != "text"]
    return docs.select(
        *([F.struct(*rest).alias("_row")] if carry else []),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID)).alias("_id"),
        F.xxhash64("text").alias("_th"),
    )


def id_ranges(docs: DataFrame, parts: int) -> Column:
    """0 .. parts - 1 by rising ``_id`` of ``docs``: equal ids, also very many, are in one range.

    The bounds are approximate quantiles of the ids alone, so ranges are of about equal size.
    """
    bounds = sorted({min(int(b), 2**63 - 1) for b in docs.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.01)}) if parts > 1 else []
    return sum(((F.col("_id") > bound).cast("int") for bound in bounds), F.lit(0))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; the fold 1 is held out from every training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
