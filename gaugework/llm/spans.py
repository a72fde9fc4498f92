"""Spans (kind, start, end) in a text, in code points: their order, their text form, and blanking them out."""

from __future__ import annotations

import bisect
import hashlib

Span = tuple[str, int, int]


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in in_order(spans, kinds))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Covered:
    """Which places spans take; asking and adding go with the logarithm of their number."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, z in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], z)
            else:
                self.starts.append(a)
                self.ends.append(z)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        """A span that meets none yet."""
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def replaced(text: str, spans: list[Span], mark: str) -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for _, a, z in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join([*out, text[at:]])
