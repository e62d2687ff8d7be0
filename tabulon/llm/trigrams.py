"""Boolean trigram queries from regular expressions.

A query is a list of clauses, one of which must hold; a clause is a set of
trigrams that must all occur in the lower-cased text.  ``None`` means that no
trigram is mandatory and every text has to be scanned.
"""

from __future__ import annotations

import re._parser as parser

#: More alternatives than this in one run, and the run ends early (a weaker,
#: still necessary condition).
MAX_STRINGS = 64

Query = list[frozenset[str]] | None


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _of_strings(strings: set[str]) -> Query:
    clauses = [_grams(s) for s in strings]
    if not all(clauses):
        return None
    return [c for c in set(clauses) if not any(d < c for d in clauses)]


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    if len(a) * len(b) > MAX_STRINGS:
        return min(a, b, key=len)
    return list({x | y for x in a for y in b})


def _or(queries: list[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    return list({c for q in queries for c in q})


class _Walk:
    """Runs of text that is known exactly, and the query of the runs so far."""

    def __init__(self):
        self.run: set[str] = {""}
        self.query: Query = None
        self.open = False

    def end_run(self):
        self.query = _and(self.query, _of_strings(self.run))
        self.run = {""}

    def extend(self, strings: set[str]):
        if len(self.run) * len(strings) > MAX_STRINGS:
            self.end_run()
            self.open = True  # what follows is no longer all of a string
        self.run = {a + b for a in self.run for b in strings}


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is parser.LITERAL:
            out.add(chr(arg).lower())
        elif op is parser.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 4 else None


def _strings(tree) -> set[str] | None:
    """All strings that ``tree`` matches, lower-cased, if they are few."""
    walk = _Walk()
    _sequence(tree, walk)
    return walk.run if walk.query is None and not walk.open else None


def _sequence(tree, walk: _Walk):
    for op, arg in tree:
        if op is parser.LITERAL:
            walk.extend({chr(arg).lower()})
        elif op is parser.IN and (found := _members(arg)):
            walk.extend(found)
        elif op is parser.SUBPATTERN:
            _sequence(arg[-1], walk)
        elif op is parser.BRANCH:
            each = [_strings(x) for x in arg[1]]
            if all(x is not None for x in each):
                walk.extend(set().union(*each))
            else:
                walk.end_run()
                walk.open = True
                walk.query = _and(walk.query, _or([_tree_query(x) for x in arg[1]]))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
            low, high, body = arg
            each = _strings(body)
            if each is not None and (low, high) == (0, 1):
                walk.extend(each | {""})
                continue
            if each is not None:
                for _ in range(min(low, 8)):
                    walk.extend(each)
            walk.end_run()
            walk.open = True
        elif op is not parser.AT:
            walk.end_run()
            walk.open = True


def _tree_query(tree) -> Query:
    walk = _Walk()
    _sequence(tree, walk)
    walk.end_run()
    return walk.query


def trigram_query(pattern: str) -> Query:
    """The trigram query that every text with a match of ``pattern`` meets."""
    return _tree_query(parser.parse(pattern))
