"""Literals that any match of a regular expression must hold, so that texts without them need not be searched.

An expression's literals are alternatives: every match holds one of them. They
come from its parse tree: of a sequence the best of its parts, of alternatives
all of theirs, of a repetition that must occur what is repeated. Searching for a
few literals costs far less than an alternation, and most texts hold none.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter literals occur in too many texts to be worth a look; more alternatives cost too much.
SHORTEST, MOST = 3, 40


def better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """Of two sets of alternatives the one whose shortest literal is longer, then the smaller."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def of_sequence(nodes) -> frozenset | None:
    best, run = None, ""

    def ended() -> None:
        nonlocal best, run
        if len(run) >= SHORTEST:
            best = better(best, frozenset([run]))
        run = ""

    for op, value in nodes:
        if op is C.LITERAL:
            run += chr(value)
            continue
        ended()
        if op is C.SUBPATTERN:
            best = better(best, of_sequence(value[3]))
        elif op is C.BRANCH:
            parts = [of_sequence(part) for part in value[1]]
            if all(parts) and len(union := frozenset().union(*parts)) <= MOST:
                best = better(best, union)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            best = better(best, of_sequence(value[2]))
        elif op is C.ATOMIC_GROUP:
            best = better(best, of_sequence(value))
    ended()
    return best


def mandatory(pattern: str) -> frozenset | None:
    """Lower-case alternatives, one of which the lower case of every match holds; None where the expression has no such."""
    found = of_sequence(parser.parse(pattern))
    return found and frozenset(x.lower() for x in found)


def minimal(literals: Iterable[str]) -> list[str]:
    """Without those that hold another one."""
    every = sorted(set(literals), key=lambda x: (len(x), x))
    return [x for i, x in enumerate(every) if not any(y in x for y in every[:i])]


def may_match(low: Column, patterns: list[str]) -> Column:
    """Whether a text in lower case holds a literal of any of the patterns; true throughout where one has none."""
    found = [mandatory(p) for p in patterns]
    if not all(found):
        return F.lit(True)
    out = F.lit(False)
    for x in minimal(frozenset().union(*found)):
        out = out | F.contains(low, F.lit(x))
    return out


def guarded(low: Column, patterns: list[str], search) -> Column:
    """Whether search(pattern) holds for any pattern; each is tried only in texts, in lower case, that may match it."""
    out = F.lit(False)
    for p in patterns:
        out = out | (may_match(low, [p]) & search(p))
    return out
