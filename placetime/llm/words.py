"""Words of whole texts as arrays: spans, hashes and shingles, computed on the bytes of an Arrow column.

All functions work on a slice of consecutive texts laid end to end (`data`) and the positions
where each begins (`offsets`, one more than there are texts), so the cost per word is a few array
operations. Nulls count as empty texts. A slice holds about `SLICE_BYTES`, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_BASE = int(_rng.integers(0, 2**63, dtype=U64)) * 8 + 5
_BASE &= 2**64 - 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes between words: white space alone, or everything in ASCII but digits and letters.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = [not chr(b).isalnum() for b in range(0x80)]


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # the words of text i are bounds[i]:bounds[i + 1]
    hashes: np.ndarray
    sums: np.ndarray  # running sums from which the hash of any span follows


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, data, offsets) of consecutive runs of texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(SLICE_BYTES.bit_length(), n.bit_length())
    if size not in _powers:
        if len(_powers) > 1:
            _powers.clear()

        def table(base: int) -> np.ndarray:
            out = np.ones(size, U64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U64(pow(base, done, 2**64))
                done *= 2
            return out

        _powers[size] = table(_BASE), table(_INVERSE)
    return _powers[size]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANK, fold: bool = True) -> Words:
    """The words of each text; with `fold`, hashes take A-Z as a-z."""
    n = len(data)
    inside = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = True
        np.logical_not(inside[:-1], out=before[1:])
    after = np.empty(n, bool)
    if n:
        after[-1] = True
        np.logical_not(inside[1:], out=after[:-1])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    power, _ = _power(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[LOWER[data] if fold else data] * power[:n], out=sums[1:])
    found = Words(starts, ends, np.searchsorted(starts, offsets), np.zeros(0, U64), sums)
    return found._replace(hashes=span_hashes(found, starts, ends))


def span_hashes(found: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of any spans of the slice; equal bytes (folded as the words were) give equal hashes."""
    _, inverse = _power(len(found.sums) - 1)
    return mix((found.sums[ends] - found.sums[starts]) * inverse[starts])


def text_hash(text: str) -> int:
    """The hash that `words` gives a word with these letters."""
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    found = words(data, offsets, np.zeros(256, bool))
    return int(found.hashes[0]) if len(data) else 0


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text, in order; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, U64)
    if n < size:
        return mix((hashes * _PLACE[:n]).sum(dtype=U64, keepdims=True) + _PLACE[32 + n])
    total = hashes[: n - size + 1] * _PLACE[0]
    for k in range(1, size):
        total = total + hashes[k : n - size + 1 + k] * _PLACE[k]
    return mix(total)


def run_shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """As `shingles`, but texts shorter than `size` have none."""
    return shingles(hashes, size) if len(hashes) >= size else np.zeros(0, U64)
