"""Words and lines of Arrow text columns as 64-bit hashes, computed on whole buffers with numpy.

A word is a run of bytes other than space and ``\\x09``-``\\x0D``. The hash of a run of bytes is a
polynomial modulo 2**64 over random byte values; prefix sums give the hash of any run in constant
time, and so for runs of words. Two runs count as equal when their mixed 64-bit hashes are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Documents are taken together up to so many bytes; a longer one is cut at white space.
BLOCK = 1 << 21

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values(lower: bool) -> np.ndarray:
    of = np.arange(256)
    if lower:
        of = np.where((of >= 65) & (of <= 90), of + 32, of)
    return mix(of.astype(_U) + _U(1000)) | _U(1)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, BLOCK) + 1, base, _U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[: n + 1]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of each run values[start:end]."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(_BASE, len(values))[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(values))[starts] + (ends - starts).astype(_U))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null has no bytes."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most BLOCK bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield a, b
        a = b


def _cuts(data: np.ndarray) -> list[int]:
    """Where to cut a long document: after white space, at least every BLOCK bytes if there is any."""
    cuts = [0]
    while len(data) - cuts[-1] > BLOCK:
        at = cuts[-1] + BLOCK
        while at < len(data):
            gaps = np.flatnonzero(SPACE[data[at : at + BLOCK]])
            if len(gaps):
                at += int(gaps[0]) + 1
                break
            at = min(at + BLOCK, len(data))
        cuts.append(at)
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return cuts


@dataclass
class Words:
    """Words of some documents: hash, first byte and end in the block, and where each document's begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """The words of the documents data[offsets[i]:offsets[i + 1]]."""
    if len(offsets) == 2 and len(data) > BLOCK:
        cuts = _cuts(data)
        found = [_words(data[a:b], np.array([0, b - a]), lower) for a, b in zip(cuts, cuts[1:])]
        hashes = np.concatenate([x.hashes for x in found])
        starts = np.concatenate([x.starts + a for x, a in zip(found, cuts)])
        ends = np.concatenate([x.ends + a for x, a in zip(found, cuts)])
        return Words(hashes, starts, ends, np.array([0, len(hashes)]))
    return _words(data, offsets, lower)


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)  # a word can begin here
    after = np.empty(len(data), bool)  # a word can end here
    if len(data):
        before[0], after[-1] = True, True
        before[1:] = ~solid[:-1]
        after[:-1] = ~solid[1:]
        before |= edge[:-1]
        after |= edge[1:]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    hashes = run_hashes(_VALUES[lower][data], starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``size`` words within one document."""
    n = len(found.hashes)
    first = np.arange(max(0, n - size + 1))
    if not len(first):
        return np.zeros(0, _U), first
    left = np.repeat(found.offsets[1:], np.diff(found.offsets))[first] - first
    first = first[left >= size]
    return run_hashes(found.hashes, first, first + size), first


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags[offsets[i]:offsets[i + 1]]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
