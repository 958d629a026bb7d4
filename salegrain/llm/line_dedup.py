"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, ascii_lower, documents_of, id_ranges, let
from .sorted_runs import SortedRuns


def line_hashes(text: Column, min_chars: int) -> Column:
    """Sorted array of (h1, h2, pos, first) of the lines whose key has at least ``min_chars`` code points.

    The key is the line stripped of ASCII white space and with A-Z lower-cased. h1 and h2 are independent 64-bit
    hashes of it, used as one 128-bit key. ``first`` marks one line of each key in the document.
    """
    keys = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda line: let(F.trim(line, F.lit(ASCII_SPACE)), lambda t: F.when(F.length(t) >= min_chars, ascii_lower(t))),
    )
    hashed = F.transform(
        keys,
        lambda key, i: F.when(
            key.isNotNull(), F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(8), key).alias("h2"), i.alias("pos"))
        ),
    )
    return let(
        F.sort_array(F.filter(hashed, lambda x: x.isNotNull())),
        lambda found: F.transform(
            found,
            lambda x, j: F.struct(
                x.h1.alias("h1"),
                x.h2.alias("h2"),
                x.pos.alias("pos"),
                ((j == 0) | (F.get(found, j - 1).h1 != x.h1) | (F.get(found, j - 1).h2 != x.h2)).cast("int").alias("first"),
            ),
        ),
    )


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines at the sorted positions in ``dropped``, in time linear in the text."""

    def cut(lines: Column) -> Column:
        spans = F.arrays_zip(
            F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1)).alias("a"),
            F.concat(dropped, F.array(F.size(lines))).alias("b"),
        )
        return F.flatten(F.transform(spans, lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"])))

    return F.array_join(let(F.split(text, "\n", -1), cut), "\n")


class LineIndex:
    """Incremental index of line keys: in how many documents a key stands, and which one keeps its lines.

    Batches come from the largest ids down. ``add`` merge-anti-joins a batch with each run of the index: keys that no run
    holds are seen for the first time, so the batch's largest id keeps them; other keys only add to the number of
    documents. Then the batch becomes a run itself. Which lines go is known when the last batch is in, as a key's
    ``min_docs``-th document may come late: ``dropped`` is that correction.
    """

    def __init__(self, spark, min_chars: int = 40, min_docs: int = 5, fanout: int = 2):
        self.min_chars, self.min_docs = min_chars, min_docs
        self.runs = SortedRuns(spark, "line-runs", ["h1", "h2"], {"n_docs": "sum", "last_id": "max"}, fanout)
        self.scratch = Scratch(spark, "line-batches")
        self.keepers: list[DataFrame] = []
        self._corrections = 0

    def hashes(self, docs: DataFrame) -> DataFrame:
        """_id, _th, h1, h2, pos, first for every long line of ``docs`` (doc_id, text)."""
        return documents_of(docs).select("_id", "_th", F.inline(line_hashes(F.col("text"), self.min_chars)))

    def unseen(self, staged: str) -> DataFrame:
        """The rows of a staged run whose keys no run of the index holds."""
        new = self.runs.table(staged)
        for run in self.runs.runs():
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return new

    def add(self, hashes: DataFrame) -> None:
        """Take in a batch of ``hashes``, all with smaller ids than those before."""
        staged = self.runs.stage(hashes.select("h1", "h2", F.col("first").cast("long").alias("n_docs"), F.col("_id").alias("last_id")))
        new = self.unseen(staged).select("h1", "h2", "last_id")
        self.keepers.append(self.scratch.write(new, f"keepers-{len(self.keepers)}", rows=self.runs.table(staged).count()))
        self.runs.push(staged)

    def dropped(self, hashes: DataFrame) -> DataFrame:
        """_id, _th, positions (sorted) of lines whose key is common and whose document does not keep it."""
        keepers = self.keepers[0]
        for more in self.keepers[1:]:
            keepers = keepers.unionByName(more)
        common = self.runs.read().where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        # written, so that the next join has two shuffles and a line of very many documents is dealt to several tasks
        self._corrections += 1
        common = self.scratch.write(keepers.join(common.hint("merge"), ["h1", "h2"]), f"common-{self._corrections}")
        return (
            hashes.join(common.hint("merge"), ["h1", "h2"])
            .where(F.col("_id") != F.col("last_id"))
            .groupBy("_id", "_th")
            .agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
        )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2, carry: bool = False) -> DataFrame:
    """doc_id, kept (the text without repeated lines), n_lines, n_dropped for every row of ``docs``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least ``min_chars`` code
    points found in at least ``min_docs`` documents loses all its lines but those of the largest doc_id that holds it.
    Null and empty texts are one empty line. Each row counts as a document; a null doc_id counts as the smallest; rows
    with the same largest doc_id all keep the line. Texts are split and joined whole, however long. An empty table gives no rows. Other
    columns, whatever their names, are ignored, or come along in a struct ``_row`` with ``carry``.

    The line hashes are written once, in ``batches`` of falling ids, and each batch meets the runs of those before.
    """
    spark = docs.sparkSession
    index = LineIndex(spark, min_chars, min_docs, fanout)
    ranges = id_ranges(documents_of(docs).select("_id"), batches)
    hashes = index.hashes(docs).withColumn("batch", ranges)
    hashes = index.scratch.write(hashes, "hashes", partition_by="batch")
    for batch in reversed(range(batches)):
        index.add(hashes.where(F.col("batch") == batch))
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = documents_of(docs, carry).join(index.dropped(hashes.drop("batch")).hint("merge"), ["_id", "_th"], "left")
    return joined.select(
        *(["_row"] if carry else []),
        "doc_id",
        F.when(F.col("dropped").isNull(), text).otherwise(without_lines(text, F.col("dropped"))).alias("kept"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
