"""Cheap necessary conditions for regular expressions.

``java.util.regex`` tries every alternative at every position, which costs microseconds per
character for a large pack.  Most lines hold none of the words a pattern cannot do without, and
a byte search for those words is far cheaper.  The words are read off the parsed pattern when
the plan is built; a pattern without such words simply gets no pre-test.
"""

from __future__ import annotations

import re
import re._constants as sc
import re._parser as sp
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, let, matches_any

MIN_LENGTH = 2


def required_literals(pattern: str) -> frozenset[str] | None:
    """Lower-cased words of which every match contains at least one; None when there are none."""
    if re.search(r"\[:\^?\w+:\]", pattern):  # a POSIX class, which Python reads as a set of letters
        return None
    try:
        tree = sp.parse(pattern)
    except Exception:  # syntax of another dialect: no pre-test
        return None
    return _best(tree)


def _best(seq) -> frozenset[str] | None:
    options: list[frozenset[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= MIN_LENGTH:
            options.append(frozenset([run]))
        run = ""

    for op, arg in seq:
        if op is sc.LITERAL:
            run += chr(arg).lower()
            continue
        if op is sc.AT:  # zero width
            continue
        close()
        found = None
        if op is sc.SUBPATTERN:
            found = _best(arg[-1])
        elif op is sc.BRANCH:
            parts = [_best(b) for b in arg[1]]
            found = frozenset().union(*parts) if all(parts) else None
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[0] >= 1:
            found = _best(arg[2])
        if found:
            options.append(found)
    close()
    # long words are selective; among equals, few words are cheap
    return max(options, key=lambda o: (min(len(w) for w in o), -len(o)), default=None)


def _minimal(words: set[str]) -> list[str]:
    """Words that contain no other word of the set (the shorter one already covers them)."""
    return sorted(w for w in words if not any(o != w and o in w for o in words))


# Letters that fold to an ASCII one by some rules only.
_FOLDED = {"i": "[iıİ]"}
# Java's white space has one character more than RE2's, and one letter is lower-cased to an ASCII one but not folded to it;
# a line that holds them is kept for Java to judge.
RARE = r"[\x0bİ]"


def word_search(patterns: Iterable[str]) -> str | None:
    """One RE2 alternation of the words of all patterns, to be used ignoring case; None where a pattern has no such words.

    Every text that any of the patterns matches is found by it; it may find more.
    """
    words: set[str] = set()
    for p in patterns:
        need = required_literals(p)
        if need is None:
            return None
        words |= need
    return "|".join("".join(_FOLDED.get(ch, re.escape(ch)) for ch in w) for w in _minimal(words))


def line_searches(patterns: Iterable[str]) -> list[str]:
    """RE2 patterns of which one at least is found in every line that any of the patterns matches.

    Mostly the patterns themselves, RE2 being the dialect they are written in.  Where Java may see more than
    RE2 in the same text (letters beyond ASCII, Unicode classes, ``\\v``), the pattern's words stand in.
    """
    out = [RARE]
    for p in patterns:
        same = p.isascii() and not re.search(r"\\[pPvQX]", p)
        try:
            pc.match_substring_regex(pa.array([""]), p)
        except pa.ArrowInvalid:
            same = False
        out.append(p if same else f"(?i:{word_search([p])})")
    return list(dict.fromkeys(out))


def guarded_match(c: Column, patterns: Iterable[str], flags: str = "") -> Column:
    """``matches_any`` behind word tests; same answer, usually much cheaper.

    A pattern is tried only where one of its own words stands; patterns without such words are tried last, together.
    """
    tested: dict[tuple[str, ...], list[str]] = {}
    free: list[str] = []
    for p in patterns:
        need = required_literals(p)
        if need is None:
            free.append(flags + p)
        else:
            tested.setdefault(tuple(_minimal(set(need))), []).append(flags + p)
    # bound once: the lower-cased text is shared by all searches
    words = let(F.lower(c), lambda low: any_of(any_of(low.contains(w) for w in need) & matches_any(c, some) for need, some in tested.items())) if tested else None
    rest = [matches_any(c, free)] if free else []
    return any_of([*([words] if tested else []), *rest])
