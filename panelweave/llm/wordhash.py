"""Vectorised words and word hashes over Arrow text columns, for use inside Spark tasks.

A column of texts is walked in slices of whole documents (a slice holds ``SLICE_BYTES`` or one longer document), so
memory follows the slice and the longest document, not the batch. Words are runs of bytes of a class; classes that
keep every byte from 0x80 up never cut a UTF-8 character. A word's hash joins two polynomials of its bytes modulo the
prime 2**31 - 1, 62 bits in all, and is finished by a mixer, so every word costs the same few array operations. (A
polynomial modulo a power of two would not do: Thue-Morse words and their complements collide under every base.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 400_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are not white space: everything but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: 0-9, a-z (after lower-casing; A-Z are lower by then) and everything from 0x80 up.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: shifts and odd multipliers, each step one-to-one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_PRIME = (1 << 31) - 1
#: Bytes whose words are hashed together; powers are kept up to so many. Sums of byte values times powers (below 2**40) of up to
#: ``_UNREDUCED`` bytes stay below 2**63.
_RUN = 1 << 18
_UNREDUCED = 1 << 23


class _Powers:
    """Powers of a number modulo ``_PRIME`` and of its inverse; those that only a longer word needs are not kept."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, _PRIME)
        self.tables = [np.ones(1, dtype=np.uint64) for _ in self.bases]

    def of(self, n: int) -> list[np.ndarray]:
        out = []
        for k, base in enumerate(self.bases):
            held = self.tables[k]
            while len(held) < n:
                held = np.concatenate([held, held * np.uint64(pow(base, len(held), _PRIME)) % np.uint64(_PRIME)])
            if len(held) <= 2 * _RUN:
                self.tables[k] = held
            out.append(held[:n])
        return out


_POWERS = [_Powers(1_403_580_769), _Powers(728_919_667)]


@dataclass
class Words:
    """The words of a slice of documents; ``first`` has the index of each document's first word, and the total."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole texts; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield slice(at, to), raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words_of(column: pa.Array, letters: np.ndarray = NOT_SPACE) -> Iterator[Words]:
    """Lower-case A-Z, cut words and hash them, slice by slice."""
    for rows, raw, off in text_slices(column):
        low = LOWER[raw]
        inside = letters[low]
        edge = np.empty(len(low) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = (inside[0], inside[-1]) if len(low) else (False, False)
        # A word never goes on into the next document.
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(low))]
        both = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, np.repeat(np.unique(both), 2)]))
        starts, ends = at[0::2], at[1::2]
        hashes = span_hashes(low, starts, ends)
        yield Words(rows, low, starts, ends, hashes, np.searchsorted(starts, off))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans ascend and do not overlap. They are hashed in runs of ``_RUN`` bytes or one longer span."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + _RUN, "right")), at + 1)
        base = int(starts[at])
        out[at:to] = _run_hashes(raw[base : int(ends[to - 1])], starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def _run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    value = raw.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(starts), dtype=np.uint64)
    for powers in _POWERS:
        up, down = powers.of(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        each = value * up[:-1]
        np.cumsum(each if len(raw) <= _UNREDUCED else each % np.uint64(_PRIME), out=total[1:])
        own = (total[ends] - total[starts]) % np.uint64(_PRIME) * down[starts] % np.uint64(_PRIME)
        out = (out << np.uint64(31)) | own
    return mix64(out)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring words (len - size + 1 of them, also across documents)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = _ODD
    for j in range(size):
        out += hashes[j : j + n] * factor
        factor = np.uint64((int(factor) * 0x9E3779B97F4A7C15 + 2 * j) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix64(out)
