"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold
from .summing import partition_sums
from .words import _BASE, _INVERSE, _powers, mix, slices, text_arrays

_U = np.uint64


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[33:128], out[48:58], out[10] = MARK, DIGIT, LINE
    out[65:91] = out[97:123] = out[128:] = WORD
    return out


BLANK, WORD, DIGIT, MARK, LINE = range(5)
_KIND = _kinds()
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_VALUES = mix(_FOLDED.astype(_U) + _U(1)) | _U(1)
_CAPITAL = ((np.arange(256) >= 65) & (np.arange(256) < 91)).astype(np.int64)
#: Tokens that stand for a word in capitals and for a word that repeats the one before it.
_SHOUTED, _REPEATED = _U(0xC1), _U(0xC2)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and each text's bounds: words (A-Z lower-cased), numbers by their length, marks, line ends.

    A word wholly in capitals A-Z, and a word equal to the token before it, are tokens of their own.
    """
    kind = _KIND[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    cut = offsets[:-1][offsets[:-1] < len(kind)]
    new[cut] = True
    start = np.flatnonzero(new)
    if not len(start):
        return np.empty(0, _U), np.zeros(len(offsets), np.int64)
    n = len(data)
    value = np.add.reduceat(_VALUES[data] * _powers(_BASE, n), start) * _powers(_INVERSE, n)[start]
    capitals = np.add.reduceat(_CAPITAL[data], start)
    length = np.diff(np.append(start, n))
    keep = kind[start] > BLANK
    start, value, capitals, length = start[keep], mix(value[keep]), capitals[keep], length[keep]
    kind = kind[start]
    value[kind == DIGIT] = mix(np.minimum(length[kind == DIGIT], 8).astype(_U))
    value[(kind == WORD) & (capitals == length) & (length > 1)] = _SHOUTED
    again = np.zeros(len(value), bool)
    again[1:] = (value[1:] == value[:-1]) & (kind[1:] == WORD)
    value[again] = _REPEATED
    return value, np.searchsorted(start, offsets)


@dataclass(frozen=True)
class Indexing:
    """Size of the word vectors: hash slots for words, dimensions, non-zeros of an index vector, words to either side."""

    slots: int = 1 << 13
    dims: int = 48
    nonzeros: int = 2
    reach: int = 2

    def vectors(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The dimension and sign of each slot's non-zeros."""
        h = mix(np.arange(self.slots, dtype=_U) * _U(7) + _U(3))
        dims = [((h >> _U(8 * i)) % _U(self.dims)).astype(np.int64) for i in range(self.nonzeros)]
        return dims, [1.0 - 2.0 * ((h >> _U(48 + i)) & _U(1)) for i in range(self.nonzeros)]


def context_sums(docs: DataFrame, indexing: Indexing) -> np.ndarray:
    """For each word slot, the sum of the index vectors of all neighbours in all texts of ``docs``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        dims, signs = indexing.vectors()
        total = np.zeros(indexing.slots * indexing.dims)
        for batch in slices(batches, "text"):
            value, bounds = tokens(*text_arrays(batch.column("text")))
            slot = (value % _U(indexing.slots)).astype(np.int64)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for step in range(1, indexing.reach + 1):
                same = owner[:-step] == owner[step:]
                left, right = slot[:-step][same], slot[step:][same]
                for word, near in ((left, right), (right, left)):
                    for dim, sign in zip(dims, signs, strict=True):
                        total += np.bincount(word * indexing.dims + dim[near], sign[near], len(total))
        return total

    return partition_sums(docs.select("text"), sums, indexing.slots * indexing.dims).reshape(indexing.slots, indexing.dims)


@dataclass
class QualityModel:
    """Word vectors and the network: tanh layer, logistic output, divided by a temperature."""

    words: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None

    def pooled(self, column: pa.Array) -> np.ndarray:
        """The mean word vector of each text; zero where there is no token."""
        value, bounds = tokens(*text_arrays(column))
        n = np.diff(bounds)
        out = np.zeros((len(n), self.words.shape[1]))
        slot = (value % _U(len(self.words))).astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        for at in range(0, len(slot), 1 << 16):
            own = owner[at : at + (1 << 16)]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[first]] += np.add.reduceat(self.words[slot[at : at + (1 << 16)]], first, axis=0, dtype=np.float64)
        return out / np.maximum(1, n)[:, None]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(column)) / self.temperature, -30, 30)))


def fit_network(model: QualityModel, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> None:
    """Train with Adam on four fifths of the rows and fit the temperature on the last fifth."""
    if len(y) < 10 or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    model.mean, model.scale = x[used].mean(0), x[used].std(0) + 1e-6
    z = (x - model.mean) / model.scale
    dims = x.shape[1]
    params = [rng.normal(0, dims**-0.5, (dims, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            h = np.tanh(z[batch] @ params[0] + params[1])
            slope = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - y[batch]) / len(batch)
            back = np.outer(slope, params[2]) * (1 - h * h)
            grads = [z[batch].T @ back + 1e-4 * params[0], back.sum(0), h.T @ slope + 1e-4 * params[2], np.array([slope.sum()])]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - 2e-3 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    model.layers = params
    logits = model.logits(x[held])
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logits / temperature).mean() for temperature in grid]
    model.temperature = float(grid[int(np.argmin(loss))])


#: How many rows of one id the sample takes at most.
COPIES = 4


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = 10_000, indexing: Indexing = Indexing()) -> QualityModel:
    """Word vectors from all texts of ``docs``; the network from at most ``sample`` labelled rows outside the held-out fold.

    ``labels`` (doc_id, quality): null labels and ids are left out, of conflicting labels the mean is rounded. The
    sample takes the ids with the least hash (ties by id); of rows that share an id at most ``COPIES`` count, by the hash of
    their texts. With fewer than ten
    labelled rows or labels of one kind only, every score is their mean; without any it is 0.5. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sums = context_sums(texts, indexing)
    model = QualityModel((sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))).astype(np.float32))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_fold(F.col("doc_id")) != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pooled = [row.tobytes() for row in shared.value.pooled(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), batch.column("doc_id"), pa.array(pooled, pa.binary())], names=["_label", "doc_id", "pooled"])

    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    joined = texts.join(F.broadcast(known), "doc_id").withColumn("_copy", copy).where(F.col("_copy") <= COPIES).select("_label", "doc_id", "text")
    rows = sorted((r["doc_id"], r["pooled"], r["_label"]) for r in joined.mapInArrow(run, "_label int, doc_id long, pooled binary").collect())
    x = np.array([np.frombuffer(r[1]) for r in rows]).reshape(len(rows), indexing.dims)
    fit_network(model, x, np.array([r[2] for r in rows], float))
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score for every row of ``docs`` (doc_id, text): the probability of label 1, also of null and empty texts.

    Repeated rows and null ids are treated like any row; equal texts have equal scores. Very long texts are pooled whole, in blocks. Other
    columns, whatever their names, are ignored. An empty table gives no rows. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(shared.value.score(batch.column("text")) >= least))

    return docs.mapInArrow(run, docs.schema)
