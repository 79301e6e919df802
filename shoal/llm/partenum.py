"""PartEnum signatures of sets: equal for at least one signature whenever two sets are similar.

Sets of sizes in one band ``[2**j, 2**(j+1))`` share a scheme: the domain is dealt into ``n1``
first-level parts of ``n2`` second-level parts each, and every subset of ``n2 - k2`` second-level
parts of a first-level part gives one signature, a hash of the set's elements inside the subset.
A difference of ``d`` elements spoils at most ``spoiled(d)`` of the signatures of both sets, so
under any common order of signatures the first ``spoiled(d) + 1`` of two similar sets must meet.
The order puts signatures with an element that is not frequent first. Two sets of different
bands meet in the scheme of the smaller one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import comb

import numpy as np

from shoal.llm.common import mixed


@dataclass(frozen=True)
class Scheme:
    """Parameters of the band ``[2**band, 2**(band + 1))``."""

    band: int
    n1: int
    n2: int
    k2: int

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n2), self.n2 - self.k2))

    def spoiled(self, differences: int) -> int:
        """The most signatures that so many differing elements can touch."""
        size = self.n2 - self.k2
        left = [comb(self.n2 - j, size) for j in range(self.n2 + 1)]
        total, rest = 0, differences
        # The first difference in a part touches most signatures, each further one fewer.
        for j in range(self.n2):
            used = min(rest, self.n1)
            total += used * (left[j] - left[j + 1])
            rest -= used
        return total


def scheme(band: int) -> Scheme:
    top = 1 << (band + 1)
    if band <= 1:
        return Scheme(band, 1, 1, 0)  # up to three elements: similar sets are equal
    if band == 2:
        return Scheme(band, 4, 1, 0)
    if top <= 64:
        # Small sets: two of three second-level parts, for signatures of several elements.
        return Scheme(band, top * 3 // 16 + 1, 3, 1)
    return Scheme(band, top * 3 // 8, 1, 0)


@cache
def _salts(s: Scheme, subset: int) -> np.ndarray:
    return mixed(np.arange(s.n1, dtype=np.uint64) * np.uint64(64) + np.uint64(subset) + np.uint64(s.band << 40))


@cache
def _plan(band: int) -> tuple[Scheme, list[tuple[int, ...]]]:
    s = scheme(band)
    return s, s.subsets


def differences(a: int, b: int, p: int = 4, q: int = 5) -> int:
    """The most elements in which sets of sizes ``a`` and ``b`` differ at a similarity of ``p / q``."""
    return (q - p) * (a + b) // (q + p)


def signatures(elements: np.ndarray, frequent: np.ndarray, p: int = 4, q: int = 5) -> np.ndarray:
    """Signatures of a set (distinct 64-bit elements) for the similarity ``p / q``; frequent is sorted."""
    n = len(elements)
    if n == 0:
        return np.empty(0, np.uint64)
    own = n.bit_length() - 1
    least = -(-n * p // q)  # the smallest partner
    rare = np.ones(n, bool)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        rare = frequent[place] != elements
    out = []
    for band in range(least.bit_length() - 1, own + 1):
        # In its own band the set meets partners up to q / p of its size, in a lower one only smaller sets.
        partner = n * q // p if band == own else (1 << (band + 1)) - 1
        out.append(_of_scheme(elements, rare, band, differences(n, partner, p, q)))
    return np.concatenate(out)


def _of_scheme(elements: np.ndarray, rare: np.ndarray, band: int, d: int) -> np.ndarray:
    s, subsets = _plan(band)
    spread = mixed(elements ^ np.uint64(0xA5A5A5A5 + band))
    cells = s.n1 * s.n2
    cell = ((spread >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)
    if cells < 1 << 16:
        cell = cell.astype(np.uint16)  # sorted by radix
    order = np.argsort(cell, kind="stable")
    ends = np.searchsorted(cell[order], np.arange(cells + 1))
    # The low bits of the spread are independent of the cell and serve as the summed hash.
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((spread * np.uint64(0xD6E8FEB86659FD93))[order], dtype=np.uint64)])
    sums = (total[ends[1:]] - total[ends[:-1]]).reshape(s.n1, s.n2)
    few = np.concatenate([[0], np.cumsum(rare[order])])
    few = (few[ends[1:]] - few[ends[:-1]]).reshape(s.n1, s.n2)
    made, common = [], []
    for k, subset in enumerate(subsets):
        held = sums[:, subset[0]]
        for c in subset[1:]:
            held = mixed(held) + sums[:, c]
        made.append(mixed(held ^ _salts(s, k)))
        common.append(few[:, list(subset)].sum(axis=1) == 0)
    # A signature without a rare element has its highest bit set, so it comes last in the common order.
    made = np.concatenate(made) >> np.uint64(1) | np.concatenate(common).astype(np.uint64) << np.uint64(63)
    first = s.spoiled(d) + 1
    return made if first >= len(made) else np.partition(made, first - 1)[:first]


# Least bits of a parity sketch, and bits per element of larger sets (at least).
SKETCH_BITS, SKETCH_SHARE = 2048, 2


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of ``n`` elements: a power of two, so that wider sketches fold to narrower ones."""
    return max(SKETCH_BITS, 1 << (SKETCH_SHARE * n - 1).bit_length())


def parity_sketch(elements: np.ndarray) -> bytes:
    """A bit per hash value: whether an odd number of elements has it.

    An element in one set only changes one bit, so two sketches differ in at most as many bits as the sets do in
    elements: a pair whose sketches differ in more cannot be similar. The width follows the size of the set: in a
    narrow sketch large sets that share nothing would differ in half of the bits at most.
    """
    bits = sketch_bits(len(elements))
    odd = np.bincount(((elements >> np.uint64(30)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of a sketch as the sketches of ``words`` longs that the same sets would have."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


class Sketches:
    """Sketches of any widths, held in one matrix per width."""

    def __init__(self, sketches: list[bytes]):
        self.words = np.fromiter((len(x) // 8 for x in sketches), np.int64, len(sketches))
        self.place = np.zeros(len(sketches), np.int64)
        self.rows = {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.place[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(sketches[i] for i in own.tolist()), np.uint64).reshape(len(own), w)

    def differing(self, at: np.ndarray, others: Sketches, to: np.ndarray) -> np.ndarray:
        """Bits in which sketch ``at[i]`` and sketch ``to[i]`` of ``others`` differ, in the narrower width."""
        out = np.zeros(len(at), np.int64)
        pairs = self.words[at] * (1 << 32) + others.words[to]
        for pair in np.unique(pairs).tolist():
            own = np.flatnonzero(pairs == pair)
            w, v = pair >> 32, pair & 0xFFFFFFFF
            a = folded(self.rows[w][self.place[at[own]]], min(w, v))
            b = folded(others.rows[v][others.place[to[own]]], min(w, v))
            out[own] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out
