"""Words of a batch of texts as arrays: byte spans, 64-bit hashes and five-word shingles, computed for all rows at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that are hashed at a time.
PIECE = 1 << 20
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_TAIL = np.zeros(256, dtype=bool)
_TAIL[[0x2C, 0x2E]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _letters(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=U)
    if fold:
        codes[65:91] += U(32)
    return mix(codes + U(0x632BE59BD9B4E019))


_TABLES = {True: _letters(True), False: _letters(False)}


def powers(base: U, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + 1), base, dtype=U)
        known[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(known)
    return known[:n]


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # first byte of each word in data
    ends: np.ndarray
    counts: np.ndarray  # words of each row
    data: np.ndarray  # all bytes of the batch


def words(texts: pa.Array, fold: bool = True, tails: bool = False) -> Words:
    """Words of all rows in order; null texts have none. fold: A-Z count as a-z. tails: a full stop or comma that ends a word after an ASCII letter or digit is a word of its own."""
    column = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, dtype=np.int64)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, dtype=np.uint8)[bounds[0] : bounds[-1]] if buffer is not None and bounds[-1] > bounds[0] else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    inner = np.unique(bounds)
    hashes, starts, ends = [], [], []
    at, letters = 0, _TABLES[fold]
    while at < len(data):
        to = _piece_end(data, inner, at)
        piece = data[at:to]
        gap = _BREAK[piece]
        cuts = inner[np.searchsorted(inner, at, "left") : np.searchsorted(inner, to, "left")] - at
        before, after = np.empty(len(piece), dtype=bool), np.empty(len(piece), dtype=bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
        if tails and len(piece) > 1:
            tail = np.flatnonzero(_TAIL[piece[1:]] & _ALNUM[piece[:-1]]) + 1
            last_byte = np.concatenate([gap[1:], [True]])
            last_byte[cuts[cuts > 0] - 1] = True
            tail = tail[last_byte[tail]]
            before[tail] = after[tail - 1] = True
        before[cuts] = True
        after[cuts[cuts > 0] - 1] = True
        first, last = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        sums = np.zeros(len(piece) + 1, dtype=U)
        np.cumsum(letters[piece] * powers(_BASE, len(piece)), out=sums[1:])
        value = (sums[last] - sums[first]) * powers(_INVERSE, len(piece))[first]
        hashes.append(mix(value + (last - first).astype(U) * U(0xD6E8FEB86659FD93)))
        starts.append(first + at)
        ends.append(last + at)
        at = to
    empty = np.zeros(0, dtype=np.int64)
    every = np.concatenate([empty, *starts])
    counts = np.diff(np.searchsorted(every, bounds, "left"))
    return Words(np.concatenate([empty.astype(U), *hashes]), every, np.concatenate([empty, *ends]), counts, data)


def _piece_end(data: np.ndarray, bounds: np.ndarray, at: int) -> int:
    """Where the piece that begins at this byte ends: at white space or at the end of a row."""
    to = at + PIECE
    if to >= len(data):
        return len(data)
    row_end = int(bounds[np.searchsorted(bounds, to, "left")])
    while to < row_end:
        found = np.flatnonzero(_BREAK[data[to : min(to + 65536, row_end)]])
        if len(found):
            return to + int(found[0])
        to = min(to + 65536, row_end)
    return row_end


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each row, in order, and how many each row has.
    A row of fewer words has one shingle, of all its words, or none if not `short`; a row without words has none."""
    n = np.maximum(counts - (size - 1), (counts > 0) if short else 0)
    ends = np.cumsum(counts)
    total = int(n.sum())
    first = np.repeat(ends - counts - (np.cumsum(n) - n), n) + np.arange(total)
    limit = np.repeat(ends, n)
    out = np.zeros(total, dtype=U)
    for j in range(size):
        at = first + j
        inside = at < limit
        out = mix(out * U(0xA24BAED4963EE407) + np.where(inside, hashes[np.minimum(at, len(hashes) - 1)] if total else U(0), U(j + 1)))
    return out, n


def runs(hashes: np.ndarray, counts: np.ndarray, length: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `length` words of each row, and how many each row has; each is what `shingles` of `size` gives a row of just these words."""
    n = np.maximum(counts - (length - 1), 0)
    total = int(n.sum())
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(total)
    out = np.zeros(total, dtype=U)
    for j in range(size):
        out = mix(out * U(0xA24BAED4963EE407) + (hashes[first + j] if j < length else U(j + 1)))
    return out, n


def rows_of(counts: np.ndarray) -> np.ndarray:
    """The row number of each of the counted items."""
    return np.repeat(np.arange(len(counts)), counts)


def signed(x: np.ndarray) -> pa.Array:
    """Hashes as the column type long."""
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
