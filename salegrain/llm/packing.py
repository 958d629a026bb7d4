"""Vector best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST_ID, Scratch
from .words import slices

#: Pre-tokenization pattern of the byte-level vocabulary; a fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Strings that are one token wherever they stand, beside the vocabulary's ranks; a fixed value of the public tokenizer.
SPECIAL = {"<|endoftext|>": 50256}
_encodings: dict[int, object] = {}


def encoding(vocabulary: bytes):
    """The byte-level BPE whose ranks are the lines "base64 rank" of ``vocabulary``; made once a process."""
    import tiktoken

    key = zlib.crc32(vocabulary)
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encodings[key]


def token_ids(encoder, text: str) -> list[int]:
    """The ids of a text; special strings in it are their own ids."""
    if any(special in text for special in SPECIAL):
        return encoder.encode(text, allowed_special="all")
    return encoder.encode_ordinary(text)


_PIECES = pa.schema([("doc_id", pa.int64()), ("_id", pa.int64()), ("_th", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, _id long, _th long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: one, or pieces of ``most`` of which the first may be shorter."""
    if n <= most:
        return [(0, n)]
    first = n % most
    return [(0, first)] * bool(first) + [(start, most) for start in range(first, n, most)]


def _tokenize(vocabulary, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary.value)
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in _PIECES]
            keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_id", "_th")), strict=True)
            for key, text in zip(keys, batch.column("text"), strict=True):
                ids = np.array([*token_ids(encoder, text.as_py() or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), most)):
                    row = (*key, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return run


@dataclass
class Capacity:
    """What a sequence holds: tokens, documents, and attention cost (the sum of squared lengths)."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def best_fit(counts: dict[int, int], capacity: Capacity, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, int]:
    """Pack ``counts[length]`` items of each length; returns events (length, rank, n, bin, offset) and the number of bins.

    Items go by falling length. Each takes, among the bins that hold it under every constraint, the one with the least
    weighted norm of what would be left (rule "norm") or the greatest weighted product of demand and residue (rule
    "dot"), all as shares of the capacity; a new bin opens where none fits. An event places the items of one length
    ranked rank .. rank + n - 1 into the bins bin .. bin + n - 1, at the same offset in each. Bins with the same
    residue are kept as intervals of bin numbers, so the work depends on the number of lengths, not of items.
    """
    total = capacity.vector()
    scale, weight = total.astype(float), np.asarray(weights)
    groups: dict[tuple[int, int, int], list[list[int]]] = {}
    events: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > total).any():
            raise ValueError(f"an item of {length} tokens exceeds the capacity {total.tolist()}")
        left, rank = counts[length], 0

        def fill(residue: tuple, first: int, n: int, each: int, length=length, need=need) -> None:
            nonlocal rank, left
            after = tuple(int(x) for x in np.array(residue) - each * need)
            for k in range(each):
                events.append((length, rank, n, first, int(total[0] - residue[0]) + k * length))
                rank += n
            left -= n * each
            groups.setdefault(after, []).append([first, first + n])

        while left:
            keys = np.array(list(groups) or np.empty((0, 3)), np.int64).reshape(-1, 3)
            fits = np.flatnonzero((keys >= need).all(1))
            if len(fits):
                rest = (keys[fits] - need) / scale
                score = (weight * rest**2).sum(1) if rule == "norm" else -(weight * (need / scale) * (keys[fits] / scale)).sum(1)
                residue = tuple(int(x) for x in keys[fits[int(score.argmin())]])
                each = int((np.array(residue) // need).min())
                interval = groups[residue].pop()
                if not groups[residue]:
                    del groups[residue]
                size = interval[1] - interval[0]
                whole = min(size, left // each)
                if not whole:
                    each, whole = left, 1
                if whole < size:
                    groups.setdefault(residue, []).append([interval[0] + whole, interval[1]])
                fill(residue, interval[0], whole, each)
            else:
                each = int((total // need).min())
                whole = left // each
                if not whole:
                    each, whole = left, 1
                bins += whole
                fill(tuple(int(x) for x in total), bins - whole, whole, each)
    return np.array(events, np.int64).reshape(-1, 5), bins


#: How many salts of a length are summed up in one group.
SALTS_IN_BLOCK = 10_000

_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events, reach = shared.value  # sorted by (length, rank); reach: length << 40 | rank, as one key
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(reach, (length << 40) + rank, "right") - 1
            sequence = events[at, 3] + rank - events[at, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequence, pa.int64()), pa.array(events[at, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PLACED.split(", ")])

    return run


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 2, capacity: Capacity | None = None, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``.

    A text's ids are those of the byte-level BPE in ``vocabulary_path`` (lines "base64 rank"), the strings of ``SPECIAL`` as
    ids of their own, then ``end_id``. Null and empty texts are ``end_id`` alone. A document of more than
    ``capacity.tokens`` ids, however long, is cut into pieces of that many, the first of which may be shorter. Pieces go to sequences
    by ``best_fit``, under the limits of ``capacity`` (by default only tokens bind); offsets in a sequence are gapless.
    Repeated rows and null ids are packed like any other; pieces of equal length are interchangeable, and ties of the score go to the residue that
    came up first. Other columns, whatever their names, are ignored. An empty table gives no rows.

    Only the number of pieces of each length (at most ``capacity.tokens`` numbers) comes to the driver, and the
    plan of at most some thousand events goes back. Ranks within a length are taken in salted groups of about 200 pieces, and the
    groups' sizes are summed up in two levels, so that a length that most pieces have is not one task.
    """
    spark = docs.sparkSession
    capacity = capacity or Capacity()
    with open(vocabulary_path, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID)).alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").alias("text")
    )
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(source.mapInArrow(_tokenize(vocabulary, end_id, capacity.tokens), _PIECES_DDL), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    events, _ = best_fit(counts, capacity, weights, rule)
    events = events[np.lexsort((events[:, 1], events[:, 0]))]
    shared = spark.sparkContext.broadcast((events, (events[:, 0] << 40) + events[:, 1]))
    salts = F.array(*[F.lit(math.ceil(counts.get(n, 1) / 200)) for n in range(1, capacity.tokens + 1)])
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_id", "_th", "piece", F.monotonically_increasing_id()), F.element_at(salts, F.col("length").cast("int"))))
    salted = scratch.write(salted, "salted")
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sizes = scratch.write(sizes.withColumn("_block", F.floor(F.col("_salt") / SALTS_IN_BLOCK)), "sizes")
    before = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("length", "_block").agg(F.sum("_n").alias("_n")).select("length", "_block", before(["length"], "_block").alias("_base"))
    sizes = sizes.withColumn("_before", before(["length", "_block"], "_salt")).join(blocks, ["length", "_block"])
    sizes = sizes.select("length", "_salt", (F.col("_base") + F.col("_before")).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("_id", "_th", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("rank"))
    return ranked.mapInArrow(_place(shared), _PLACED)
