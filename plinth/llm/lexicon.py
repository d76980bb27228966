"""A minimal acyclic transducer from words to token ids, in memory-mapped arrays.

Words are added in byte order and finished suffixes are shared through a
register, so the automaton is minimal. Every edge carries an output; the sum of
the outputs along a word's path is the word's rank, and the rank finds its ids
in one flat array. The file holds plain little-endian arrays after a header, so
a reader maps it instead of parsing it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

MAGIC = b"PLEX1\x00\x00\x00"
_PARTS = ("first", "label", "target", "output", "final", "offset", "ids")
_TYPES = {"first": "<i4", "label": "<u1", "target": "<i4", "output": "<i4", "final": "<u1", "offset": "<i4", "ids": "<i4"}


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file for (word, ids) pairs; of a repeated word the first pair counts, order does not matter."""
    entries: dict[bytes, list[int]] = {}
    for word, ids in words:
        entries.setdefault(word, ids)
    order = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    below: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (at := register.get(key)) is None:
            at = register[key] = len(states)
            states.append(key)
            below.append(node[0] + sum(below[t] for _, t in node[1]))
        return at

    path: list[list] = [[False, []]]
    last = b""

    def fold(depth: int) -> None:
        while len(path) - 1 > depth:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))

    for word in order:
        common = next((i for i, (x, y) in enumerate(zip(last, word)) if x != y), min(len(last), len(word)))
        fold(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    fold(0)
    root = freeze(path[0])

    first, label, target, output = [0], [], [], []
    for final, edges in states:
        rank = int(final)
        for byte, to in edges:
            label.append(byte)
            target.append(to)
            output.append(rank)
            rank += below[to]
        first.append(len(label))
    offset = np.cumsum([0, *(len(entries[w]) for w in order)])
    parts = {"first": first, "label": label, "target": target, "output": output, "final": [f for f, _ in states], "offset": offset, "ids": [i for w in order for i in entries[w]]}
    blobs = [np.asarray(parts[k], dtype=_TYPES[k]).tobytes() for k in _PARTS]
    return MAGIC + struct.pack("<8q", root, *map(len, blobs)) + b"".join(b + bytes(-len(b) % 8) for b in blobs)


class Lexicon:
    """Lookups in a mapped file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        self.root, *sizes = struct.unpack("<8q", raw[8:72].tobytes())
        #: Edges of the states that a lookup has come through: state * 256 + label -> target * 256, output.
        self.edges: dict[int, tuple[int, int]] = {}
        self.seen: set[int] = set()
        at = 72
        for name, size in zip(_PARTS, sizes):
            setattr(self, name, memoryview(raw[at : at + size].view(_TYPES[name])))
            at += size + -size % 8

    def __len__(self) -> int:
        return len(self.offset) - 1

    @property
    def states(self) -> int:
        return len(self.final)

    def _edge(self, at: int, byte: int) -> tuple[int, int] | None:
        """The edge of a state that edges has not shown; reads the state's edges when it is new."""
        if at in self.seen:
            return None
        self.seen.add(at)
        lo, hi = self.first[at >> 8], self.first[(at >> 8) + 1]
        for label, target, output in zip(self.label[lo:hi], self.target[lo:hi], self.output[lo:hi]):
            self.edges[at | label] = (target << 8, output)
        return self.edges.get(at | byte)

    def get(self, word: bytes) -> list[int] | None:
        """The ids of word, or None if the automaton does not hold it."""
        at, rank, known = self.root << 8, 0, self.edges
        for byte in word:
            step = known.get(at | byte) or self._edge(at, byte)
            if step is None:
                return None
            at, output = step
            rank += output
        if not self.final[at >> 8]:
            return None
        return self.ids[self.offset[rank] : self.offset[rank + 1]].tolist()
