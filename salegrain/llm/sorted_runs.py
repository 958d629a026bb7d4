"""A log-structured index: immutable sorted runs in levels, merged when a level is full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Aggregates by name, and how two values of them are joined; a null stands for no value.
_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}
_JOINED = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}


class SortedRuns:
    """Runs of aggregated rows, bucketed by their key and sorted by it within each bucket.

    A run is a table of ``buckets`` files (by default as many as there are shuffle partitions when the index is made), so
    that a run is joined with a run, and runs are merged, bucket by bucket: neither reads shuffle nor sort, only a new
    batch is shuffled, once, after it was combined on the map side.

    ``merge`` names, for each value column, the aggregate ("sum", "min", "max") that joins two runs' values. A level that
    holds ``fanout`` runs is merged into one run of the next level before the next run comes, so each row is rewritten
    once a level: O(log n) times in all. Keys are unique in a run and not null. An empty batch gives an empty run.

    Two runs are merged by a full outer join of their buckets; from the third on Spark shuffles, so ``fanout`` is best 2.
    (A union of bucketed tables would be aggregated without a shuffle too, but Spark 4.1 then gives wrong sums where it reads them unbucketed.)
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], merge: dict[str, str], fanout: int = 2, buckets: int | None = None):
        # a bucket is one file, so its rows are in order
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.scratch = Scratch(spark, name)
        self.keys, self.merge, self.fanout = keys, merge, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def stage(self, batch: DataFrame) -> str:
        """Aggregate a batch to unique keys and write it as a run that is not yet part of the index; its name."""
        return self._write(self._merged(batch))

    def push(self, staged: str) -> None:
        """Take a staged run into the index; full levels are merged first."""
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            level += 1
        for full in reversed(range(level)):
            self._compact(self.levels[full], full + 1)
        self.levels[0].append(staged)

    def add(self, batch: DataFrame) -> None:
        self.push(self.stage(batch))

    def compact(self) -> None:
        """Merge all runs into one."""
        if sum(map(len, self.levels)) > 1:
            self._compact([run for runs in self.levels for run in runs], len(self.levels))

    def clear(self) -> None:
        """Delete all runs."""
        for run in [run for level in self.levels for run in level]:
            self.scratch.drop(run)
        self.levels = [[]]

    def table(self, run: str) -> DataFrame:
        return self.scratch.bucketed(run)

    def runs(self) -> list[DataFrame]:
        """The runs of the index, oldest first."""
        return [self.table(run) for level in reversed(self.levels) for run in level]

    def read(self) -> DataFrame:
        """All runs, of which there is at least one, as one table with unique keys."""
        return self._joined(self.runs())

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[_AGGREGATE[how](column).alias(column) for column, how in self.merge.items()])

    def _joined(self, runs: list[DataFrame]) -> DataFrame:
        out, *rest = runs
        for run in rest:
            pair = out.alias("x").join(run.hint("merge").alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in self.keys], "full_outer")
            both = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
            out = pair.select(*[F.coalesce(*both(k)).alias(k) for k in self.keys], *[_JOINED[how](*both(c)).alias(c) for c, how in self.merge.items()])
        return out

    def _write(self, merged: DataFrame) -> str:
        self._made += 1
        name = f"run-{self._made}"
        self.scratch.write_bucketed(merged, name, self.keys, self.buckets)
        return name

    def _compact(self, runs: list[str], level: int) -> None:
        runs = list(runs)
        made = self._write(self._joined([self.table(run) for run in runs]))
        self.levels = [[run for run in kept if run not in runs] for kept in self.levels]
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(made)
        for run in runs:
            self.scratch.drop(run)
