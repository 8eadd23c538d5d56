"""Suffix automaton over sequences of integers, with the order of the first sequence that holds each state's strings."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """All substrings of the sequences added; they must come in ascending order, so that a state's first order is its least."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, arcs: dict[int, int], link: int, length: int, first: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, state: int, arc: int, below: int) -> int:
        """A state for the strings of `below` that are as short as `state` and `arc` make them."""
        copy = self._state(dict(self.next[below]), self.link[below], self.length[state] + 1, self.first[below])
        while state >= 0 and self.next[state].get(arc) == below:
            self.next[state][arc] = copy
            state = self.link[state]
        self.link[below] = copy
        return copy

    def add(self, sequence: Sequence[int], order: int) -> None:
        last = 0
        for symbol in sequence:
            there = self.next[last].get(symbol)
            if there is not None:
                last = there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
                continue
            new = self._state({}, 0, self.length[last] + 1, order)
            state = last
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                below = self.next[state][symbol]
                self.link[new] = below if self.length[below] == self.length[state] + 1 else self._split(state, symbol, below)
            last = new

    def first_orders(self, sequence: Sequence[int], window: int) -> list[int | None]:
        """For each window of the sequence the least order of a sequence that holds it, None where none does.

        The matching statistic at a position is the longest suffix read so far that the automaton holds.
        """
        state, matched, out = 0, 0, []
        following, link, length, first = self.next, self.link, self.length, self.first
        for at, symbol in enumerate(sequence):
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
            matched = min(matched, length[state])
            if at >= window - 1:
                out.append(first[state] if matched >= window else None)
        return out
