"""Substring dedup: a log-structured index of window fingerprints, merge-joined with new batches and verified.

A window is ``window`` consecutive words. Of its sub-windows of ``gram`` words the one with the least hash is its
anchor (the leftmost of equals), so equal windows have equal anchors at equal places, and neighbouring windows mostly
share one. The index holds anchors, not windows: about one for each eight words. The windows that share an anchor
occurrence, taken together, are its context; contexts are told apart by a second 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents_of, id_ranges
from .sorted_runs import SortedRuns
from .words import SPACED, Words, mix, powers, slices, text_arrays

_U = np.uint64
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 2**64)
#: A place in a document as one long: the first word, and in the last four bits the number of further windows.
_SPAN, _MORE = 4, 15


class Fingerprints:
    """Rolling hashes over the words of some texts."""

    def __init__(self, words: Words, window: int, gram: int, hashes: np.ndarray | None = None):
        self.words, self.window, self.gram = words, window, gram
        self.hashes = words.hashes() if hashes is None else hashes
        n = len(self.hashes)
        self.sums = np.append(_U(0), np.cumsum(self.hashes * powers(_STEP, n)))
        self.back = powers(_BACK, n + 1)

    def ranges(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences first .. after - 1."""
        return mix((self.sums[after] - self.sums[first]) * self.back[first])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, last window, place of the anchor), words counted through all texts."""
        bounds, n = self.words.bounds, len(self.hashes)
        width = self.window - self.gram + 1
        if n < self.window:
            return (np.empty(0, np.int64),) * 4
        at = np.arange(n - self.gram + 1)
        grams = self.ranges(at, at + self.gram)
        best, off = grams[: n - self.window + 1].copy(), np.zeros(n - self.window + 1, np.int8)
        for k in range(1, width):
            other = grams[k : k + len(best)]
            less = other < best
            np.copyto(best, other, where=less)
            off[less] = k
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(best)]
        start = np.flatnonzero(np.arange(len(best)) + self.window <= bounds[1:][text])
        text, place = text[start], start + off[start]
        if not len(start):
            return (np.empty(0, np.int64),) * 4
        new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        return text[first], start[first], start[last], place[first]


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*text_arrays(batch.column("text")), SPACED)
            prints = Fingerprints(words, window, gram)
            text, low, high, place = prints.anchors()
            anchor = prints.ranges(place, place + gram) if len(place) else np.empty(0, _U)
            context = prints.ranges(low, high + window) if len(place) else np.empty(0, _U)
            context = mix(context + ((high - low) * window + (place - low)).astype(_U))
            loc = ((low - words.bounds[text]) << _SPAN) | (high - low)
            keys = [batch.column(name).to_numpy(zero_copy_only=False)[text] for name in ("_id", "_th", "batch")]
            columns = [pa.array(c, pa.int64()) for c in (anchor.view(np.int64), context.view(np.int64), *keys[:2], loc)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys[2], pa.int32())], names=["a", "c", "_id", "_th", "loc", "batch"])

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*text_arrays(batch.column("text")), SPACED)
            prints = Fingerprints(words, window, window)
            check = Fingerprints(words, window, window, mix(prints.hashes + _U(0x2545F4914F6CDD1D)))
            parts = []
            for r, locs in enumerate(batch.column("locs")):
                loc = locs.values.to_numpy(zero_copy_only=False)
                span = (loc & _MORE) + 1
                start = np.repeat(loc >> _SPAN, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
                parts.append((np.full(len(start), r), start, start + words.bounds[r]))
            row, start, at = (np.concatenate(column) for column in zip(*parts, strict=True))
            keys = [batch.column(name).to_numpy(zero_copy_only=False)[row] for name in ("_id", "_th")]
            columns = [prints.ranges(at, at + window).view(np.int64), check.ranges(at, at + window).view(np.int64), *keys, start << _SPAN]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["w1", "w2", "_id", "_th", "loc"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, n_words, n_removed = [], [], []
            for text, locs in zip(batch.column("text"), batch.column("locs"), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if locs.is_valid:
                    loc = locs.values.to_numpy(zero_copy_only=False)
                    low = loc >> _SPAN
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, low, 1)
                    np.add.at(change, low + (loc & _MORE) + window, -1)
                    stays = np.cumsum(change[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    words = [word for word, stay in zip(words, stays.tolist(), strict=True) if stay]
                kept.append(b" ".join(words))
                n_words.append(len(words) + gone)
                n_removed.append(gone)
            columns = [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "n_words", "n_removed"])

    return run


class SubstringIndex:
    """The historical index: for each anchor its occurrences' number, first place, and least and greatest context.

    Batches come by rising ids, so that what the index holds starts earlier than what comes. Runs are bucketed by anchor:
    a batch is shuffled once, to become a run, and meets the runs of the index without a shuffle or a sort.
    """

    def __init__(self, spark: SparkSession, window: int = 20, gram: int = 6, fanout: int = 2):
        if not gram <= window <= gram + 15:
            raise ValueError("a window has 1 to 16 sub-windows")
        self.window, self.gram = window, gram
        merge = {"n": "sum", "c_min": "min", "c_max": "max", "first": "min"}
        self.runs = SortedRuns(spark, "substring-runs", ["a"], merge, fanout)

    def anchors(self, docs: DataFrame) -> DataFrame:
        """a, c, _id, _th, loc, batch for every anchor occurrence of ``docs`` (_id, _th, batch, text)."""
        return docs.select("_id", "_th", "batch", "text").mapInArrow(_anchor_rows(self.window, self.gram), _ANCHORS)

    def meet(self, staged: str) -> DataFrame:
        """The anchors of a staged batch that stand more than once in index and batch, by merge joins with each run.

        a, mixed (several contexts so far), first (the earliest place), and for anchors that the index knew with one
        context only and that are mixed now, that context ``c_old``, whose first place is ``first``.
        """
        met = self.runs.table(staged).select("a", *[F.col(c).alias(f"{c}_0") for c in _STATE])
        runs = self.runs.runs()
        for i, run in enumerate(runs, 1):
            met = met.join(run.select("a", *[F.col(c).alias(f"{c}_{i}") for c in _STATE]).hint("merge"), "a", "left")
        over = lambda how, name, of: how(*of, F.lit(None)) if (of := [F.col(f"{name}_{i}") for i in of]) else F.lit(None).cast("long")
        old, every = range(1, len(runs) + 1), range(len(runs) + 1)
        c_min, c_max = over(F.least, "c_min", every), over(F.greatest, "c_max", every)
        was_one = over(F.least, "c_min", old) == over(F.greatest, "c_max", old)
        n = sum((F.coalesce(f"n_{i}", F.lit(0)) for i in every), F.lit(0))
        mixed = c_min != c_max
        state = met.select("a", n.alias("n"), mixed.alias("mixed"), F.least(*[F.col(f"first_{i}") for i in every], F.lit(None)).alias("first"), F.when(mixed & was_one, over(F.least, "c_min", old)).alias("c_old"))
        return state.where("n > 1").drop("n")

    def add(self, staged: str) -> None:
        """Take the batch into the index; full levels are compacted."""
        self.runs.push(staged)

    def stage(self, anchors: DataFrame) -> str:
        """Write a batch's anchors as a sorted run that is not yet part of the index."""
        place = F.struct("_id", "_th", "loc").alias("first")
        return self.runs.stage(anchors.select("a", F.lit(1).cast("long").alias("n"), F.col("c").alias("c_min"), F.col("c").alias("c_max"), place))


_ANCHORS = "a long, c long, _id long, _th long, loc long, batch int"
_STATE = ("n", "c_min", "c_max", "first")


def dedup_substrings(docs: DataFrame, window: int = 20, gram: int = 6, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, kept, n_words, n_removed for every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space. Every word goes that lies in a window of ``window`` words whose
    sequence also starts earlier: in a smaller doc_id, or earlier in the same document; ``kept`` joins the others by
    one space. Windows are judged on the input. Null and empty texts, and texts shorter than a window, lose nothing. A null doc_id counts as the
    smallest. Identical rows are one document and lose the same words; other rows that share an id, however many, go by
    the hash of their text. A text is never cut, so a worker's memory holds about 100 bytes for each byte of the longest. Other columns, whatever their names, are
    ignored. An empty table gives no rows.

    Anchors are written once, in batches of rising ids. Each batch is merge-joined with the index so far and then added to it: an
    anchor that had one context until then is settled by that. For anchors with several, each context's first occurrence is verified
    window by window on two independent 64-bit hashes, and its other occurrences are repeats as a whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    source = documents_of(docs)
    index = SubstringIndex(spark, window, gram, fanout)
    ranges = id_ranges(source.select("_id"), batches)
    occurrences = scratch.write(index.anchors(source.withColumn("batch", ranges)), "anchors", partition_by="batch")
    met = None
    for batch in range(batches):
        staged = index.stage(occurrences.where(F.col("batch") == batch))
        known = scratch.write(index.meet(staged).withColumn("batch", F.lit(batch)), f"met-{batch}", rows=index.runs.table(staged).count())
        met = known if met is None else met.unionByName(known)
        index.add(staged)
        scratch.release()
    index.runs.clear()

    place = ["_id", "_th", "loc"]
    found = occurrences.join(met.select("a", "batch", "mixed", "first").hint("merge"), ["a", "batch"])
    again = F.struct(*place) != F.col("first")
    found = found.select(*[F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("a", "c")], *place, "mixed").where(F.col("mixed") | again)
    found = scratch.write(found, "found")
    scratch.drop("anchors")
    scratch.release()
    settled = found.where(~F.col("mixed")).select(*place)
    mixed = found.where("mixed").select("a", "c", *place)
    earlier = met.where("c_old is not null").select("a", F.col("c_old").alias("c"), "first.*")
    firsts = mixed.unionByName(earlier).groupBy("a", "c").agg(F.min(F.struct(*place)).alias("first"))
    firsts = scratch.write(firsts, "firsts", rows=found.count())
    for batch in range(batches):
        scratch.drop(f"met-{batch}")
    again = mixed.join(firsts.hint("merge"), ["a", "c"]).where(F.struct(*place) != F.col("first")).select(*place)
    asked = firsts.select("first.*").groupBy("_id", "_th").agg(F.collect_set("loc").alias("locs"))
    windows = source.select("_id", "_th", "text").join(asked.hint("merge"), ["_id", "_th"])
    windows = scratch.write(windows.mapInArrow(_window_rows(window), "w1 long, w2 long, _id long, _th long, loc long"), "windows")
    scratch.release()
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct(*place)).alias("first"), F.max(F.struct(*place)).alias("last")).where("first != last")
    earliest = scratch.write(earliest.drop("last"), "earliest", rows=windows.count())
    single = windows.join(earliest.hint("merge"), ["w1", "w2"]).where(F.struct(*place) != F.col("first")).select(*place)
    gone = settled.unionByName(again).unionByName(single).groupBy("_id", "_th").agg(F.collect_set("loc").alias("locs"))
    judged = source.select("doc_id", "_id", "_th", "text").join(gone.hint("merge"), ["_id", "_th"], "left")
    return judged.select("doc_id", "text", "locs").mapInArrow(_cut(window), "doc_id long, kept string, n_words long, n_removed long")
