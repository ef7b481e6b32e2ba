"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is a list of alternatives, each a set of trigrams that all occur in a matching text (lower-cased A-Z); None means
that nothing can be demanded. It is derived from the parsed expression: stretches whose possible strings are few are
spelled out; where a stretch ends, its strings' trigrams become one demand; demands of several stretches are combined.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from itertools import product

MOST_STRINGS = 64
MOST_CLASS = 12

Query = list[frozenset[str]]


def _fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _demand(strings: set[str]) -> Query | None:
    """Any of the strings: one alternative each; nothing if one is too short to hold a trigram."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    return sorted({x | y for x, y in product(a, b)}, key=sorted)


def _class(items) -> set[str] | None:
    chars: set[str] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            chars.add(_fold(chr(value)))
        elif kind is kinds.RANGE and value[1] - value[0] < MOST_CLASS:
            chars.update(_fold(chr(c)) for c in range(value[0], value[1] + 1))
        else:
            return None
    return chars if len(chars) <= MOST_CLASS else None


class _Walk:
    """Reads nodes one after the other: `open` are the strings of the current stretch, `query` what is demanded so far."""

    def __init__(self):
        self.open: set[str] = {""}
        self.query: Query | None = None

    def close(self, rest: set[str] | None = None) -> None:
        self.query = _both(self.query, _demand(self.open))
        self.open = rest or {""}

    def add(self, strings: set[str]) -> None:
        longer = {a + b for a in self.open for b in strings}
        if len(longer) <= MOST_STRINGS:
            self.open = longer
        else:
            self.close(strings)

    def read(self, nodes) -> None:
        for kind, value in nodes:
            if kind is kinds.LITERAL:
                self.add({_fold(chr(value))})
            elif kind is kinds.IN and (chars := _class(value)):
                self.add(chars)
            elif kind is kinds.SUBPATTERN:
                self.read(value[-1])
            elif kind is kinds.BRANCH:
                self._branch([_walked(b) for b in value[1]])
            elif kind is kinds.MAX_REPEAT:
                self._repeat(*value)
            elif kind is not kinds.AT:
                self.close()

    def _branch(self, walks: list[_Walk]) -> None:
        if all(w.query is None and "" not in w.open for w in walks) and len(strings := set().union(*(w.open for w in walks))) <= MOST_STRINGS and not any(w.cut for w in walks):
            self.add(strings)
            return
        self.close()
        demands = []
        for w in walks:
            w.close()
            demands.append(w.query)
        if all(demands):
            self.query = _both(self.query, [s for d in demands for s in d])

    def _repeat(self, least: int, most: int, nodes) -> None:
        inner = _walked(nodes)
        whole = inner.query is None and not inner.cut
        if whole and least == 0 and most == 1 and len(inner.open) < MOST_STRINGS:
            self.add(inner.open | {""})
        elif whole and least == most == 1:
            self.add(inner.open)
        elif whole and least >= 1 and len(inner.open) == 1:
            self.add({s * min(least, 64) for s in inner.open})
            if most != least or least > 64:
                self.cut_here()
        else:
            self.close()
            if least:
                inner.close()
                self.query = _both(self.query, inner.query)
            self.cut = True

    def cut_here(self) -> None:
        self.close()
        self.cut = True

    cut = False


def _walked(nodes) -> _Walk:
    walk = _Walk()
    for node in nodes:
        before = walk.query
        walk.read([node])
        if walk.query is not before or node[0] in (kinds.ANY, kinds.NOT_LITERAL) or node[0] is kinds.IN and not _class(node[1]):
            walk.cut = True
    return walk


def query(pattern: str) -> Query | None:
    """The trigram query of a regular expression."""
    walk = _Walk()
    walk.read(parser.parse(pattern))
    walk.close()
    return walk.query
