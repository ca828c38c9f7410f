"""Many literal patterns in one pass over a text: a trie with failure links."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


def folded(text: str) -> str:
    """Each character without case, one for one."""
    return "".join(map(_fold, text)) if not text.isascii() else text.lower()


def _fold(c: str) -> str:
    upper = c.upper()
    lower = upper.lower() if len(upper) == 1 else c
    return lower if len(lower) == 1 else c


class Automaton:
    """found(text) gives the values of all patterns that occur in it."""

    def __init__(self, patterns: Iterable[tuple[str, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.values: list[frozenset[int]] = [frozenset()]
        for pattern, value in patterns:
            at = 0
            for c in pattern:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.values.append(frozenset())
                at = self.next[at][c]
            self.values[at] |= {value}
        self.fail = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:  # breadth first: what a node falls back on is done before it
            at = waiting.popleft()
            for c, child in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0)
                self.values[child] |= self.values[self.fail[child]]
                waiting.append(child)

    def found(self, text: str) -> set[int]:
        at, hits = 0, set(self.values[0])
        for c in text:
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            if self.values[at]:
                hits |= self.values[at]
        return hits
