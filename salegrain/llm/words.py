"""Words of Arrow text columns as numpy arrays: spans and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    if n:
        out[0] = 1
        out[1:] = _U(base)
        np.multiply.accumulate(out, out=out)
    return out


class Alphabet:
    """Which bytes of UTF-8 make words, and whether A-Z count as a-z."""

    def __init__(self, word_bytes: np.ndarray, fold_case: bool):
        self.is_word = word_bytes
        codes = np.arange(256)
        if fold_case:
            codes[65:91] += 32
        self.values = np.where(word_bytes, mix(codes.astype(_U) + _U(1)) | _U(1), _U(0))


def _no_space() -> np.ndarray:
    out = np.ones(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = False
    return out


def _alphanumeric() -> np.ndarray:
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


#: Words are runs of anything but ASCII white space.
SPACED = Alphabet(_no_space(), fold_case=False)
SPACED_FOLDED = Alphabet(_no_space(), fold_case=True)
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
ALNUM_FOLDED = Alphabet(_alphanumeric(), fold_case=True)

_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if n > 1 << 20:
        return powers(base, n)
    if base not in _cache or len(_cache[base]) < n:
        _cache[base] = powers(base, 1 << (n - 1).bit_length())
    return _cache[base][:n]


class Words:
    """The words of some texts. ``bounds[i]:bounds[i + 1]`` are those of text i; spans are byte positions in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
        self.data = data
        inside = alphabet.is_word[data]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cut] = inside[cut]
        self.starts = np.flatnonzero(begins)
        ends = inside
        last = ends[cut[cut > 0] - 1]
        following = ~inside[1:]
        ends[:-1] &= following
        ends[cut[cut > 0] - 1] = last
        self.ends = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._alphabet = alphabet

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, _U)
        terms = self._alphabet.values[self.data]
        terms *= _powers(_BASE, len(terms))
        sums = np.add.reduceat(terms, self.starts)
        # where a word is cut by the end of its text, no separator of value 0 stands between: reduceat stops there anyway
        sums *= _powers(_INVERSE, len(terms))[self.starts]
        return mix(sums)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Record batches whose texts have at most ``limit`` bytes together, or a single row.

    A worker's arrays have some 100 bytes for each byte of text, so this bounds its memory.
    """
    for batch in batches:
        _, offsets = text_arrays(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end
