"""Minimal acyclic transducers: sorted keys in, a compact automaton that maps every key to its place out.

A key is a byte string. Keys are added in order; once a key leaves a branch behind, the branch is final and is
replaced by an equal one if there is one, so that equal endings are stored once. Every arc carries how many
keys come before it in its state, so the sum along a key's path is its lexicographic ordinal.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Transducer:
    """Arcs sorted by ``state * 256 + byte``; ``final[s]`` says that a key may end in state ``s``."""

    arcs: np.ndarray
    targets: np.ndarray
    before: np.ndarray
    final: np.ndarray
    start: int
    keys: int

    @classmethod
    def build(cls, keys: Iterable[bytes]) -> Transducer:
        """From distinct keys in ascending order."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ...))
        size: list[int] = []  # keys below a state

        def settled(node: list) -> int:
            """The number of the state equal to ``node``, a list [final, arcs]."""
            shape = (node[0], tuple(node[1]))
            number = known.get(shape)
            if number is None:
                number = known[shape] = len(states)
                states.append(shape)
                size.append(node[0] + sum(size[t] for _, t in shape[1]))
            return number

        # The path of the last key: its nodes are still open.
        path: list[list] = [[0, []]]
        last = b""
        added = 0
        for key in keys:
            if added and key <= last:
                raise ValueError("keys must ascend")
            common = 0
            for x, y in zip(key, last):
                if x != y:
                    break
                common += 1
            for depth in range(len(last), common, -1):
                done = settled(path.pop())
                path[depth - 1][1].append((last[depth - 1], done))
            path += [[0, []] for _ in range(len(key) - common)]
            path[-1][0] = 1
            last = key
            added += 1
        for depth in range(len(last), 0, -1):
            done = settled(path.pop())
            path[depth - 1][1].append((last[depth - 1], done))
        start = settled(path.pop())
        arcs, targets, before = [], [], []
        for s, (final, out) in enumerate(states):
            passed = final
            for byte, t in out:
                arcs.append(s << 8 | byte)
                targets.append(t)
                before.append(passed)
                passed += size[t]
        return cls(
            np.array(arcs, np.int64),
            np.array(targets, np.int32),
            np.array(before, np.int64),
            np.array([f for f, _ in states], bool),
            start,
            added,
        )

    def to_bytes(self) -> bytes:
        head = np.array([len(self.arcs), len(self.final), self.start, self.keys], np.int64)
        return b"".join(x.tobytes() for x in (head, self.arcs, self.before, self.targets, self.final))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        n, m, start, keys = np.frombuffer(data, np.int64, 4).tolist()
        at = 32
        parts = []
        for kind, count in ((np.int64, n), (np.int64, n), (np.int32, n), (bool, m)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        arcs, before, targets, final = parts
        return cls(arcs, targets, before, final, start, keys)

    def step(self, states: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states (-1: none) and the keys passed over."""
        wanted = states.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.arcs, wanted), max(len(self.arcs) - 1, 0))
        if not len(self.arcs):
            return np.full(len(states), -1), np.zeros(len(states), np.int64)
        hit = self.arcs[at] == wanted
        return np.where(hit, self.targets[at], -1), np.where(hit, self.before[at], 0)

    def after(self, prefix: bytes) -> tuple[int, int] | None:
        """The state behind ``prefix`` and the keys before it; None if no key begins so."""
        state, passed = self.start, 0
        for b in prefix:
            nxt, over = self.step(np.array([state]), np.array([b]))
            if nxt[0] < 0:
                return None
            state, passed = int(nxt[0]), passed + int(over[0])
        return state, passed

    def ordinals(self, words: list[bytes], begin: tuple[int, int] | None = None) -> np.ndarray:
        """The ordinal of each word (behind ``begin``, as ``after`` gives it), -1 where it is no key.

        All words go through the automaton together, one byte of each at a time.
        """
        state0, passed0 = begin or (self.start, 0)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lengths) - lengths
        states = np.full(len(words), state0, np.int64)
        passed = np.full(len(words), passed0, np.int64)
        live = np.flatnonzero(lengths > 0)
        depth = 0
        while len(live):
            nxt, over = self.step(states[live], text[first[live] + depth])
            states[live] = nxt
            passed[live] += over
            depth += 1
            live = live[(nxt >= 0) & (lengths[live] > depth)]
        ends = np.zeros(len(words), bool)
        there = states >= 0
        ends[there] = self.final[states[there]]
        return np.where(ends, passed, -1)
