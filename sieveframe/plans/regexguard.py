"""Patterns that may backtrack catastrophically: an unbounded repetition inside one that is repeated without bound.

The pattern is read into a tree of groups first; then the tree is asked which group is repeated without bound and holds
something that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_PIECE = re.compile(r"(?P<escape>\\.)|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<open>\((?:\?(?:P?<\w+>|<?[=!]|[:>]))?)|(?P<close>\))|(?P<one>.)", re.DOTALL)
_ENDLESS = re.compile(r"[*+]|\{\d+,\}")


@dataclass
class _Part:
    begin: int
    end: int = 0
    endless: bool = False
    inside: list[_Part] = field(default_factory=list)

    def parts(self) -> Iterator[_Part]:
        """This and all below it, inner ones first."""
        for part in self.inside:
            yield from part.parts()
        yield self


def _read(pattern: str) -> list[_Part]:
    """The closed parts of a pattern: groups, and single pieces that are repeated without bound."""
    levels, at = [_Part(0)], 0
    while piece := _PIECE.match(pattern, at):
        at = piece.end()
        if piece["open"]:
            levels.append(_Part(piece.start()))
            continue
        done = levels.pop() if piece["close"] and len(levels) > 1 else _Part(piece.start())
        repeat = _ENDLESS.match(pattern, at)
        if repeat:
            at = repeat.end()
        done.end, done.endless = at, repeat is not None
        if done.endless or done.inside or piece["close"]:
            levels[-1].inside.append(done)
    return [part for level in levels for part in level.inside]


def unsafe_part(pattern: str) -> str | None:
    """The repeated group at fault, or None. Unbalanced patterns are left for the engine to report."""
    for whole in _read(pattern):
        for part in whole.parts():
            if part.endless and any(p.endless for within in part.inside for p in within.parts()):
                return pattern[part.begin : part.end]
    return None
