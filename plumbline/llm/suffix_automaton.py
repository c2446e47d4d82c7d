"""A suffix automaton over the word sequences of one reference shard."""

from __future__ import annotations


class SuffixAutomaton:
    """Generalised suffix automaton; sequences are added in ascending order of their owner.

    Every state knows the owner under which its sequences were first seen, which is the
    smallest one because of that order.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _state(self, moves: dict, length: int, link: int, first: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, before: int, word, target: int) -> int:
        """The state for the sequence of ``before`` and ``word``: ``target`` or its clone."""
        if self.length[target] == self.length[before] + 1:
            return target
        clone = self._state(dict(self.next[target]), self.length[before] + 1, self.link[target], self.first[target])
        self.link[target] = clone
        while before >= 0 and self.next[before].get(word) == target:
            self.next[before][word] = clone
            before = self.link[before]
        return clone

    def add(self, words: list, owner: int) -> None:
        last, moves, link = 0, self.next, self.link
        for word in words:
            known = moves[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
                continue
            new = self._state({}, self.length[last] + 1, 0, owner)
            state = last
            while state >= 0 and word not in moves[state]:
                moves[state][word] = new
                state = link[state]
            if state >= 0:
                link[new] = self._split(state, word, moves[state][word])
            last = new

    def stream(self, words: list, depth: int):
        """Matching statistics: for each word that ends a match of ``depth`` words or more,
        its number and the first owner of the last ``depth`` words."""
        state, matched = 0, 0
        moves, link, length, first = self.next, self.link, self.length, self.first
        for i, word in enumerate(words):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            to = moves[state].get(word)
            if to is None:
                state, matched = 0, 0
                continue
            state, matched = to, matched + 1
            if matched >= depth:
                at = state
                while length[link[at]] >= depth:
                    at = link[at]
                yield i, first[at]
