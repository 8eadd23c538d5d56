"""Minimal acyclic transducer: words to numbers, in one block of bytes that can be memory-mapped.

Sorted words are added one by one; as soon as a suffix can no longer change, it is
replaced by an equal state that is already there. Every arc carries how many words
lie before the ones below it, so the outputs on a word's path add up to its number,
and states are shared as if there were no outputs at all.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from array import array
from collections.abc import Sequence


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self) -> None:
        self.arcs: list[tuple[int, _State]] = []
        self.final, self.number, self.words = False, -1, 0


def compile_words(words: Sequence[bytes], outputs: Sequence[bytes]) -> bytes:
    """The automaton of sorted, distinct `words`, each with its output bytes."""
    made: list[_State] = []
    known: dict[tuple, _State] = {}
    path = [_State()]

    def settle(state: _State) -> _State:
        """`state`, finished, or an equal one; its number orders children before parents."""
        key = (state.final, tuple((label, below.number) for label, below in state.arcs))
        if (there := known.get(key)) is None:
            state.number = len(made)
            state.words = state.final + sum(below.words for _, below in state.arcs)
            made.append(state)
            known[key] = there = state
        return there

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = settle(path.pop())
            path[-1].arcs[-1] = (path[-1].arcs[-1][0], done)

    before = b""
    for word in words:
        shared = len(os.path.commonprefix([before, word]))
        close(shared)
        for byte in word[shared:]:
            below = _State()
            path[-1].arcs.append((byte, below))
            path.append(below)
        path[-1].final = True
        before = word
    close(0)
    root = settle(path[0])

    first, final, labels, targets, adds = array("I"), bytearray(), bytearray(), array("I"), array("I")
    for state in made:
        first.append(len(labels))
        final.append(state.final)
        passed = int(state.final)
        for label, below in state.arcs:
            labels.append(label)
            targets.append(below.number)
            adds.append(passed)
            passed += below.words
    first.append(len(labels))
    ends = array("I", [0])
    for out in outputs:
        ends.append(ends[-1] + len(out))
    parts = [first.tobytes(), targets.tobytes(), adds.tobytes(), ends.tobytes(), bytes(final), bytes(labels), b"".join(outputs)]
    return struct.pack("<8I", root.number, *map(len, parts)) + b"".join(parts)


class Transducer:
    """Look-ups in compiled bytes, mapped from a nameless file so that the system shares and evicts its pages."""

    def __init__(self, compiled: bytes) -> None:
        with tempfile.TemporaryFile() as file:
            file.write(compiled)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self._root, *sizes = struct.unpack_from("<8I", self._map)
        view, at, parts = memoryview(self._map), 32, []
        for size in sizes:
            parts.append((at, view[at:at + size]))
            at += size
        self._first, self._targets, self._adds, self._ends = (p.cast("I") for _, p in parts[:4])
        self._final = parts[4][1]
        self._labels, self._outputs = parts[5][0], parts[6][0]

    def get(self, word: bytes) -> bytes | None:
        """The output of `word`, or None if the automaton does not accept it."""
        state, number, base, find, first = self._root, 0, self._labels, self._map.find, self._first
        for i in range(len(word)):
            arc = find(word[i:i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number += self._adds[arc]
            state = self._targets[arc]
        if not self._final[state]:
            return None
        return self._map[self._outputs + self._ends[number]:self._outputs + self._ends[number + 1]]

    @property
    def states(self) -> int:
        return len(self._first) - 1
