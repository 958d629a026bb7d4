"""Benchmark decontamination: suffix arrays of training shards, searched for every test suffix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM_FOLDED, Words, slices, text_arrays


class TestSuffixes:
    """The words of test items as ids from 1 on, item after item, each followed by 0."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        column = pa.array([text or "" for _, text in items], pa.string())
        words = Words(*text_arrays(column), ALNUM_FOLDED)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        self.names = [name for name, _ in items]
        ids, starts, lengths, owners = [], [], [], []
        at = 0
        for item in range(len(items)):
            own = np.searchsorted(self.vocabulary, hashes[words.bounds[item] : words.bounds[item + 1]]) + 1
            if n := len(own):
                w = min(window, n)
                first = np.arange(n - w + 1)
                starts.append(at + first)
                lengths.append(np.full(len(first), w))
                owners.append(np.full(len(first), item))
            ids.append(np.append(own, 0))
            at += n + 1
        join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        self.ids, self.starts, self.lengths, self.owners = join(ids), join(starts), join(lengths), join(owners)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.longest = int(self.lengths.max()) if len(self.lengths) else 0


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the non-zero ``ids``, sorted by what follows them up to a 0, told apart to ``depth`` ids at least.

    Prefix doubling: after round r the ranks order suffixes by their first 2**r ids.
    """
    rank = ids.astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        after[rank == 0] = 0
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)
        rank = np.where(ids == 0, 0, rank + 1)
        step *= 2
    places = np.flatnonzero(ids)
    return places[np.argsort(rank[places], kind="stable")]


def search(ids: np.ndarray, order: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix, the range of ``order`` whose suffixes start with its window (binary search, all at once)."""

    def insert(right: bool) -> np.ndarray:
        low, high = np.zeros(len(test.starts), np.int64), np.full(len(test.starts), len(order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            place = order[np.minimum(middle, len(order) - 1)]
            sign = np.zeros(len(place), np.int64)  # of the text's suffix against the test's
            for k in range(test.longest):
                here = ids[np.minimum(place + k, len(ids) - 1)] * (place + k < len(ids))
                there = test.ids[np.minimum(test.starts + k, len(test.ids) - 1)]
                sign = np.where((sign == 0) & (k < test.lengths), np.sign(here - there), sign)
            below = (sign < 0) | ((sign == 0) & right)
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    return insert(False), insert(True)


def shard_matches(words: Words, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, suffix): the shard's words at which the window of a test suffix occurs.

    Only runs of words that occur in the tests go into the suffix array: no window reaches beyond one.
    """
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(test.starts) or not len(words.starts):
        return nothing
    hashes = words.hashes()
    found = np.minimum(np.searchsorted(test.vocabulary, hashes), len(test.vocabulary) - 1)
    known = test.vocabulary[found] == hashes
    edge = np.zeros(len(known) + 1, bool)
    edge[words.bounds] = True
    begin = np.flatnonzero(known & (np.append(True, ~known[:-1]) | edge[:-1]))
    end = np.flatnonzero(known & (np.append(~known[1:], True) | edge[1:])) + 1
    long = end - begin >= test.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return nothing
    size = end - begin + 1
    source = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    last = np.cumsum(size) - 1
    ids = found[np.minimum(source, len(found) - 1)] + 1
    ids[last] = 0
    order = suffix_array(ids, test.longest)
    low, high = search(ids, order, test)
    count = high - low
    suffix = np.repeat(np.arange(len(count)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return source[order[low[suffix] + inside]], suffix


def longest_matches(place: np.ndarray, suffix: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place, length) of the longest verbatim matches: occurrences of an item's windows one word apart are one match."""
    item, start = test.owners[suffix], test.starts[suffix]
    order = np.lexsort((place, place - start, item))
    item, start, place, width = item[order], start[order], place[order], test.lengths[suffix][order]
    if not len(place):
        return item, place, width
    new = np.append(True, (item[1:] != item[:-1]) | (np.diff(place) != 1) | (np.diff(start) != 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    return item[first], place[first], place[last] - place[first] + width[last]


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("_id", pa.int64()), ("_th", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64())]
    + [("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))]
)
_DDL = "doc_id long, _id long, _th long, n_words long, n_hit long, items array<string>, matches array<struct<item_id: string, start: long, length: long>>"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: TestSuffixes = shared.value
        for batch in slices(batches, "text", 1 << 20):
            words = Words(*text_arrays(batch.column("text")), ALNUM_FOLDED)
            n = np.diff(words.bounds)
            item, place, length = longest_matches(*shard_matches(words, test), test)
            change = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(change, place, 1)
            np.add.at(change, place + length, -1)
            hit = np.append(0, np.cumsum(np.cumsum(change[:-1]) > 0))
            n_hit = hit[words.bounds[1:]] - hit[words.bounds[:-1]]
            items: list[list[str]] = [[] for _ in n]
            matches: list[list[dict]] = [[] for _ in n]
            row = np.searchsorted(words.bounds, place, "right") - 1
            for i, r, p, k in zip(item.tolist(), row.tolist(), (place - words.bounds[row]).tolist(), length.tolist(), strict=True):
                matches[r].append({"item_id": test.names[i], "start": p, "length": k})
            for r in set(row.tolist()):
                items[r] = sorted({m["item_id"] for m in matches[r]})
            columns = [batch.column("doc_id"), batch.column("_id"), batch.column("_th"), n, n_hit, items, matches]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The test items as broadcasts of at most ``block_bytes`` of text each (one item at least)."""
    spark = benchmark.sparkSession
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text"))
    total = tests.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    rows = lambda block: [(r[0], r[1]) for r in tests.where(F.col("block") == block).select("item_id", "text").collect()]
    return [spark.sparkContext.broadcast(TestSuffixes(rows(block), window)) for block in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), matches (item_id, start word, words), contaminated for every row of ``docs``.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``window``
    consecutive words of an item; an item with fewer words, but one at least, is one window. A document's word is hit
    where it lies in an occurrence of a window. Null texts have no words and hit nothing; items without words match
    nothing; a null item_id is named ''. Repeated items count once by their id. Each row of ``docs`` gets one result,
    repeated or not. Very long texts are searched whole; of matches that start at one place each item has its longest. Other columns, whatever
    their names, are ignored. An empty ``docs`` gives no rows; with an empty ``benchmark`` nothing is hit.

    Each task builds suffix arrays of its own shard of documents, a MB of text at a time, and searches them for all
    test suffixes, so no text is shuffled. The test items are broadcast in blocks of at most ``block_bytes`` of text; where there
    is more than one block, each document's matches are put together by its key.
    """
    shared = _blocks(benchmark, window, block_bytes)
    blocks = len(shared)
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64("text").alias("_th"),
        "text",
    )
    parts = [source.mapInArrow(_scan(block), _DDL) for block in shared]
    if blocks == 1:
        out = parts[0]
    else:
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        places = lambda m: F.sequence(m.start, m.start + m.length - 1)
        out = (
            every.groupBy("_id", "_th")
            .agg(
                F.first("doc_id").alias("doc_id"),
                F.first("n_words").alias("n_words"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"),
                F.count("*").alias("_n"),
            )
            .withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.transform("matches", places)))).cast("long"))
            .withColumn("_n", F.explode(F.sequence(F.lit(1), F.expr(f"_n div {blocks}"))))
        )
    return out.select("doc_id", "_id", "_th", "n_words", "n_hit", "items", "matches", (F.col("n_hit") > 0).alias("contaminated"))


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: TestSuffixes = shared.value
        for batch in slices(batches, "text", 1 << 20):
            words = Words(*text_arrays(batch.column("text")), ALNUM_FOLDED)
            place, _ = shard_matches(words, test)
            keep = np.ones(batch.num_rows, bool)
            keep[np.searchsorted(words.bounds, place, "right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of an item (see ``decontaminate``).

    Rows with null texts stay. Blocks of test items filter one after the other; nothing is shuffled.
    """
    for block in _blocks(benchmark, window, block_bytes):
        docs = docs.mapInArrow(_clean(block), docs.schema)
    return docs
