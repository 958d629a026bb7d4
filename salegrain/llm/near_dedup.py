"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges, an exact join for crowds, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .summing import partition_sums
from .words import SPACED_FOLDED, Words, mix, slices, text_arrays

_U = np.uint64


@dataclass(frozen=True)
class Banding:
    """Bins of a permutation, how many bands of how many rows are cut from them, how many permutations there are, how
    many members a bucket may have to be settled pair by pair, and how many centres a larger one gets."""

    bins: int = 256
    rows: int = 6
    bands: int = 42
    permutations: int = 1
    small: int = 8
    centres: int = 8


#: For buckets too large to be settled by a few centres: a band is shared by far more similar texts only. It joins most
#: components at little cost; those that it leaves apart are joined exactly.
FINE = Banding(rows=16, bands=16, permutations=13, small=16)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the sorted distinct shingle hashes of each text, text after text.

    A text of fewer words than ``width`` has its whole sequence as one shingle; a text without words has none.
    """
    h = words.hashes()
    n = np.diff(words.bounds)
    rolled = h + _U(width) if len(h) else h
    for k in range(1, width):
        after = np.zeros_like(h)
        after[:-k] = h[k:] if k < len(h) else 0
        rolled = mix(rolled * _U(0xD1342543DE82EF95) + after) if len(h) else h
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - words.bounds[:-1][row] if len(h) else row
    full = place + width <= n[row]
    values, owners = rolled[full], row[full]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.empty(len(short), _U)
        for i, r in enumerate(short):
            x = np.full(1, n[r], _U)
            for value in h[words.bounds[r] : words.bounds[r + 1]]:
                x = mix(x * _U(0xD1342543DE82EF95) + value)
            extra[i] = x[0]
        values, owners = np.append(values, extra), np.append(owners, short)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    keep = np.append(True, (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])) if len(values) else np.empty(0, bool)
    values, owners = values[keep], owners[keep]
    return values, np.searchsorted(owners, np.arange(len(n) + 1))


def _probes(bins: int, tries: int) -> np.ndarray:
    at = np.arange(tries * bins, dtype=_U).reshape(tries, bins)
    return (mix(at + _U(0x5851F42D4C957F2D)) % _U(bins)).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures, a row for each text with shingles; rows of others are zero.

    The bin of a shingle is given by its hash's leading bits, its rank by the hash itself: each bin keeps its
    least. An empty bin borrows from the bin that the first successful probe of a hash sequence of its own names (optimal
    densification); after 64 probes it takes the next filled bin to its right.
    """
    n = len(bounds) - 1
    out = np.zeros((n, bins), _U)
    filled = np.zeros((n, bins), bool)
    if len(values):
        owner = np.repeat(np.arange(n), np.diff(bounds))
        slot = owner * bins + (values >> _U(64 - bins.bit_length() + 1)).astype(np.int64)
        first = np.append(True, slot[1:] != slot[:-1])
        out.reshape(-1)[slot[first]] = values[first]
        filled.reshape(-1)[slot[first]] = True
    source, had = out.copy(), filled.copy()
    some = had.any(1)
    for tries, probe in enumerate(_probes(bins, 64)):
        lacking = np.flatnonzero(some & ~filled.all(1))
        if not len(lacking):
            break
        take = had[lacking][:, probe] & ~filled[lacking]
        got = mix(source[lacking][:, probe] + _U(tries + 1))
        block = out[lacking]
        block[take] = got[take]
        out[lacking] = block
        filled[lacking] |= take
    for r in np.flatnonzero(some & ~filled.all(1)):
        place = np.flatnonzero(had[r])
        empty = np.flatnonzero(~filled[r])
        out[r, empty] = mix(source[r, place[np.searchsorted(place, empty) % len(place)]] + _U(65))
    return out


def band_hashes(values: np.ndarray, bounds: np.ndarray, banding: Banding) -> np.ndarray:
    """A row of band hashes for each text; bands of different numbers never share a hash."""
    parts = []
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for k in range(banding.permutations):
        if k:
            values = mix(values + _U(k))
            values = values[np.lexsort((values, owner))]
        cut = signatures(values, bounds, banding.bins)[:, : banding.bands * banding.rows].reshape(-1, banding.bands, banding.rows)
        x = np.broadcast_to(np.arange(1, banding.bands + 1, dtype=_U) + _U(1000 * k + 100_000 * banding.rows), cut.shape[:2])
        for row in range(banding.rows):
            x = mix(x * _U(0xD1342543DE82EF95) + cut[:, :, row])
        parts.append(x)
    return np.concatenate(parts, axis=1)


_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def _sign(banding: Banding, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, bounds = shingle_sets(Words(*text_arrays(batch.column("text")), SPACED_FOLDED), width)
            n = np.diff(bounds)
            sums = [np.append(np.cumsum(mix(values + _U(salt))), _U(0)) for salt in (11, 29)]
            keys = []
            for s in sums:
                whole = np.append(_U(0), s[:-1])
                keys.append((whole[bounds[1:]] - whole[bounds[:-1]]).view(np.int64))
            bands = band_hashes(values, bounds, banding).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands.shape[1], pa.int32()), pa.array(bands.reshape(-1)))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


_PREFIXES = "doc_id long, k1 long, k2 long, n long, parity array<long>, places array<int>, sigs array<long>"
PARITY_BITS = 512
#: Slots in which shingles are counted, to tell the frequent ones.
SLOTS = 1 << 16
#: Members of a posting list that one task compares with all others of the list.
LIST_PART = 1024


def _slots(values: np.ndarray) -> np.ndarray:
    return (mix(values + _U(57)) % _U(SLOTS)).astype(np.int64)


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(SLOTS)
        for batch in slices(batches, "text"):
            values, _ = shingle_sets(Words(*text_arrays(batch.column("text")), SPACED_FOLDED), width)
            total += np.bincount(_slots(values), minlength=SLOTS)
        return total

    return run


def _prefixes(width: int, percent: int, counts):
    """Each text's rarest shingles with their places, and its parity: bit i tells whether an odd number of its shingles hash to i.

    Rarity is a fixed order of all shingles, by the count of their slot and then by their hash, so similar sets share one
    of the first n - ceil(percent * n / 100) + 1. Shingles that are alone in their slot are shared with no other text and left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, bounds = shingle_sets(Words(*text_arrays(batch.column("text")), SPACED_FOLDED), width)
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(n)), n)
            bit = (mix(values + _U(43)) % _U(PARITY_BITS)).astype(np.int64)
            odd = np.bincount(owner * PARITY_BITS + bit, minlength=len(n) * PARITY_BITS) & 1
            parity = np.packbits(odd.astype(np.uint8)).view(np.int64)
            count = counts.value[_slots(values)]
            order = np.lexsort((values, count, owner))
            place = np.arange(len(values)) - bounds[:-1][owner]
            keep = (place < (n - (percent * n + 99) // 100 + 1)[owner]) & (count[order] > 1)
            kept = np.append(0, np.cumsum(np.bincount(owner[keep], minlength=len(n))))
            keys = []
            for salt in (11, 29):
                s = np.append(_U(0), np.cumsum(mix(values + _U(salt))))
                keys.append(pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)))
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (PARITY_BITS // 64), pa.int32()), pa.array(parity)),
                pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(place[keep], pa.int32())),
                pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(values[order][keep].view(np.int64))),
            ]
            columns = [batch.column("doc_id"), *keys, pa.array(n, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n", "parity", "places", "sigs"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a"), "text_b"):
            sets = [shingle_sets(Words(*text_arrays(batch.column(c)), SPACED_FOLDED), width) for c in ("text_a", "text_b")]
            linked = np.empty(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (values[bounds[i] : bounds[i + 1]] for values, bounds in sets)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return run


class _Confirmed:
    """Candidate edges confirmed on full sets, each pair once."""

    def __init__(self, scratch: Scratch, width: int, percent: int):
        self.scratch, self.width, self.percent = scratch, width, percent
        self.judged: DataFrame | None = None
        self._n = 0

    def test(self, pairs: DataFrame, texts: DataFrame) -> None:
        """Judge ``pairs`` (a, b: ids) with the texts of their rows; pairs judged before are left out."""
        self._n += 1
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.judged is not None:
            pairs = pairs.join(self.judged.select("a", "b"), ["a", "b"], "left_anti")
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
        )
        found = both.mapInArrow(_confirm(self.width, self.percent), "a long, b long, linked boolean")
        found = self.scratch.write(found, f"judged-{self._n}")
        self.judged = found if self.judged is None else self.judged.unionByName(found)

    def links(self) -> DataFrame:
        return self.judged.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _shared_buckets(scratch: Scratch, buckets: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """bucket, doc_id, n, central: members of buckets of n > 1. ``central`` sums up n over a document's buckets; it is
    greatest in the middle of a group of copies."""
    sizes = scratch.write(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), f"{name}-sizes", rows=rows)
    shared = scratch.write(buckets.join(sizes.hint("merge"), "bucket"), f"{name}-shared", rows=rows)
    rows = shared.count()
    central = scratch.write(shared.groupBy("doc_id").agg(F.sum("n").alias("central")), f"{name}-central", rows=rows)
    return scratch.write(shared.join(central, "doc_id").select("bucket", "doc_id", "n", "central"), name, rows=rows)


def _star(scratch: Scratch, shared: DataFrame, name: str) -> DataFrame:
    """Edges of each bucket's members to its most central member."""
    most = F.max(F.struct("central", (-F.col("doc_id")).alias("low"))).alias("most")
    centres = scratch.write(shared.groupBy("bucket").agg(most).select("bucket", (-F.col("most.low")).alias("b")), f"{name}-centres", rows=shared.count())
    return shared.join(centres.hint("merge"), "bucket").where(F.col("doc_id") != F.col("b")).select(F.col("doc_id").alias("a"), "b")


def _divided(scratch: Scratch, shared: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """The members, with their component so far, of buckets that hold several components."""
    placed = shared.join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = shared.count()
    placed = scratch.write(placed, f"{name}-placed", rows=rows)
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    several = scratch.write(several, f"{name}-several", rows=rows)
    return scratch.write(placed.join(several.hint("merge"), "bucket"), f"{name}-divided", rows=rows)


def _several_stars(scratch: Scratch, divided: DataFrame, banding: Banding, name: str) -> DataFrame:
    """Edges between components within a bucket: each pair of a small bucket's, and in larger ones every member's to
    ``centres`` centres, the most central of as many random parts of the bucket."""
    slot = F.when(F.col("n") <= banding.small, F.col("doc_id")).otherwise(F.pmod(F.xxhash64("bucket", "doc_id"), F.lit(banding.centres)))
    best = F.max(F.struct("central", "doc_id", "component")).alias("best")
    chosen = divided.groupBy("bucket", slot.alias("slot")).agg(best)
    chosen = scratch.write(chosen.select("bucket", F.col("best.doc_id").alias("b"), F.col("best.component").alias("b_component")), f"{name}-chosen", rows=divided.count())
    apart = (F.col("component") != F.col("b_component")) & ((F.col("n") > banding.small) | (F.col("doc_id") < F.col("b")))
    edges = divided.join(chosen.hint("merge"), "bucket").where(apart)
    return edges.select(F.col("doc_id").alias("a"), "b")


def _exact_pairs(scratch: Scratch, texts: DataFrame, parts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different components that may be similar; no similar pair is missing.

    Similar sets share one of their rarest shingles. Rarity is told by counts in ``SLOTS`` slots, a table of fixed size that
    every task gets. Of the pairs that share one, those go on whose
    lengths, places of the shared shingle and parities allow the similarity: bits by which two parities differ are never
    more than the shingles by which the sets do. Only lists of a shingle that hold several components are joined,
    long ones by several tasks.
    """
    row = ["doc_id", "k1", "k2", "n"]
    counts = scratch.spark.sparkContext.broadcast(partition_sums(texts.select("text"), _counts(width), SLOTS))
    sets = texts.mapInArrow(_prefixes(width, percent, counts), _PREFIXES).groupBy(*row)
    sets = scratch.write(sets.agg(*[F.first(c).alias(c) for c in ("parity", "places", "sigs")]), "sets")
    placed = sets.join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    prefix = placed.select(*row, "parity", "component", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("sigs").alias("sig"))))
    prefix = scratch.write(prefix.withColumn("rest", F.col("n") - F.col("place")).drop("place"), "prefix")
    several = prefix.groupBy("sig").agg(F.count("*").alias("f"), F.min("component").alias("low"), F.max("component").alias("high"))
    several = scratch.write(several.where("low < high").select("sig", F.ceil(F.col("f") / LIST_PART).alias("tasks")), "lists")
    lists = scratch.write(prefix.join(several.hint("merge"), "sig"), "listed")

    def side(name: str, task: Column) -> DataFrame:
        return lists.select("sig", task.alias("task"), *[F.col(c).alias(f"{c}_{name}") for c in ("doc_id", "n", "rest", "component", "parity")])

    one = side("a", F.pmod(F.xxhash64("doc_id", "k1"), "tasks"))
    other = side("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
    both = F.col("n_a") + F.col("n_b")
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    may = (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b"))
    may &= 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    may &= (100 + percent) * F.least("rest_a", "rest_b") >= percent * both
    may &= (100 + percent) * differ <= (100 - percent) * both
    keys = [one[c] == other[c] for c in ("sig", "task")]
    return one.join(other.hint("merge"), [*keys, may]).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, banding: Banding = Banding(), fine: Banding = FINE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    A text's set holds its distinct shingles of ``width`` words (runs of anything but ASCII white space, A-Z
    lower-cased); a shorter text has its whole sequence as one shingle, a text without words or a null text has none
    and links with nothing. Documents link where 100 * intersection >= ``percent`` * union. component_id is the smallest
    doc_id reachable, kept whether it is the row's own. Rows that share a doc_id are one node. A row with a null doc_id
    links with nothing: its component_id is null and it is kept. Very long texts are hashed whole. Of equally central members of a
    bucket the smallest id is the centre, which changes no result. Other columns, whatever their names, are ignored. An empty table gives no rows.

    Equal sets (by size and 128-bit hash) are one class, and only a class's smallest id goes on. Members of a bucket get
    edges to its most central member: n - 1 for a bucket of n. Of buckets that then still hold several components, those
    of at most ``banding.small`` members get all edges between components. Members of larger ones are hashed again
    into ``fine`` bands, whose buckets are small also within a crowd of half-similar texts, and get edges between components to
    ``fine.centres`` centres. What is left of them, members of buckets still divided, is joined exactly. So two similar
    texts end in one component wherever they share a bucket of ``banding``, whatever ``fine`` finds. Every edge is confirmed on the
    full sets; those of buckets grow with the number of members.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    signed = scratch.write(source.mapInArrow(_sign(banding, width), _SIGNED), "signed")
    able = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    equal = ["k1", "k2", "n_shingles"]
    n = signed.count()
    classes = scratch.write(able.groupBy(*equal).agg(F.min("doc_id").alias("rep")), "classes", rows=n)
    members = able.select("doc_id", *equal).join(classes.hint("merge"), equal).select("doc_id", "rep")
    members = scratch.write(members.distinct(), "members", rows=n)
    firsts = able.join(classes.select(*equal, F.col("rep").alias("doc_id")), [*equal, "doc_id"])
    buckets = scratch.write(firsts.select("doc_id", F.explode("bands").alias("bucket")), "buckets", rows=n * banding.bands)
    shared = _shared_buckets(scratch, buckets, "coarse", n * banding.bands)
    scratch.drop("buckets")
    scratch.drop("coarse-shared")
    # every candidate is one of these: their texts are shuffled once, and kept
    candidates = scratch.write(shared.select("doc_id").distinct(), "candidates", rows=shared.count())
    texts = scratch.write(source.join(candidates.hint("merge"), "doc_id"), "texts")
    scratch.release()

    confirmed = _Confirmed(scratch, width, percent)
    confirmed.test(_star(scratch, shared, "coarse"), texts)
    parts = connected_components(confirmed.links(), scratch, "first")
    divided = _divided(scratch, shared, parts, "coarse")
    confirmed.test(_several_stars(scratch, divided.where(F.col("n") <= banding.small), banding, "coarse"), texts)
    crowd = scratch.write(divided.where(F.col("n") > banding.small).select("doc_id").distinct(), "crowd", rows=divided.count())
    crowded = shared.where(F.col("n") > banding.small)
    again = texts.join(crowd, "doc_id").mapInArrow(_sign(fine, width), _SIGNED).select("doc_id", F.explode("bands").alias("bucket"))
    again = scratch.write(again, "again")
    shared = _shared_buckets(scratch, again.distinct(), "fine", again.count())
    confirmed.test(_several_stars(scratch, _divided(scratch, shared, parts, "fine"), fine, "fine"), texts)
    parts = connected_components(confirmed.links(), scratch, "second")
    left = _divided(scratch, crowded, parts, "left").select("doc_id").distinct()
    left = scratch.write(texts.join(left, "doc_id"), "left-texts")
    confirmed.test(_exact_pairs(scratch, left, parts, width, percent), texts)

    parts = connected_components(confirmed.links(), scratch, "last").withColumnRenamed("node", "rep")
    scratch.keep("signed", "members", *[name for name in scratch.names if name.startswith("last-edges")])
    found = members.join(parts, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    found = found.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
