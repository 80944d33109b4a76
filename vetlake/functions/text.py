"""Text predicates and scalars as native Column expressions.

Patterns are written once in RE2 syntax (the reference dialect and the one DuckDB
uses).  ``jrx`` adapts them to java.util.regex so ``rlike`` gives the same answers:
``(?d)`` makes only ``\\n`` a line terminator, and ``\\b`` becomes an ASCII boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space a trim removes.
WS = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# Blank line, or first visible characters are a comment marker.
BLANK_OR_COMMENT = rf"^[{WS}]*(?:$|#|//|/\*|\*|--)"

# Code points used to hide or reorder text.
HIDDEN_CHARS = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{202A}-\x{202E}\x{2066}-\x{2069}]"

# Phrases that try to override the instructions above them.
PROMPT_OVERRIDE = [
    "ignore previous instructions", "ignore all previous", "disregard previous instructions",
    "reveal system prompt", "print system prompt", "developer message", "bypass approval",
    "bypass sandbox", "do not ask user", "without user confirmation", "override system",
    "越过审批", "绕过审批", "忽略之前的指令", "忽略上面的指令", "泄露系统提示词",
]


# POSIX class -> java.util.regex name
_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}


def _posix(m: re.Match) -> str:
    if m[2] not in _POSIX:
        raise ValueError(f"unknown character class [:{m[2]}:]")
    name = _POSIX[m[2]]
    return name if not m[1] else name.swapcase()[:2] + name[2:]


def jrx(pattern: str) -> str:
    """RE2 pattern -> equivalent java.util.regex pattern; a ``ValueError`` where there is none.

    POSIX classes get their Java names, named groups become plain ones, and ignoring case covers
    letters beyond ASCII where the pattern has such letters.
    """
    if r"\C" in pattern or re.search(r"\(\?[a-zA-Z]*U", pattern):
        raise ValueError(f"pattern uses syntax without an equivalent: {pattern}")
    pattern = re.sub(r"\[:(\^?)(\w+):\]", _posix, pattern)
    pattern = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
    if not pattern.isascii():
        pattern = re.sub(r"\(\?([ms]*)i([ms]*)(?=[:)-])", r"(?\1iu\2", pattern)
    return "(?d)" + pattern.replace(r"\b", ASCII_BOUNDARY)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(jrx(pattern))


def matches_any(c: Column, patterns: Iterable[str]) -> Column:
    """Any of several patterns, as one alternation: one expression node instead of many.

    Generated methods stay small enough for the JIT; flags given inside a pattern stay local
    to its group.
    """
    return c.rlike("|".join(f"(?:{jrx(p)})" for p in patterns))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(value: Column) -> Column:
    """Generator form of a computed column: later expressions see an attribute, not a formula.

    Use as ``df.select(..., bound(expr).alias("c"))`` for a costly column that many predicates
    read; otherwise filters pushed through the projection repeat the formula once per use.
    """
    return F.explode(F.array(value))


def any_of(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds)


def all_of(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds)


def ws_trim(c: Column) -> Column:
    """Trim all Unicode white space (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def has_text(c: Column) -> Column:
    """Something is left after trimming; stops at the first such character."""
    return c.rlike(rf"[^{WS}]")


def has_any(lowered: Column, keys: Iterable[str]) -> Column:
    """Any key is a substring; the column is already lower-cased.

    Longer lists bind the text once and search it per word: a byte search costs far less than an
    alternation, and binding keeps the lower-casing from being repeated.
    """
    words = [k.lower() for k in keys]
    if len(words) > 3:
        return let(lowered, lambda t: any_of(t.contains(w) for w in words))
    return any_of(lowered.contains(w) for w in words)


def contains_any(c: Column, keys: Iterable[str]) -> Column:
    """Case-folded any-substring test."""
    return has_any(F.lower(c), keys)


def is_comment_line(line: Column) -> Column:
    """First visible characters are ``#``, ``//``, ``/*``, ``*`` or ``--``."""
    return matches(line, rf"^[{WS}]*(?:#|//|/\*|\*|--)")


def is_code_line(line: Column) -> Column:
    """Neither blank nor comment-like."""
    return ~matches(line, BLANK_OR_COMMENT)


def is_log_only_line(line: Column) -> Column:
    """Logging call that neither assigns, sets, caches nor stores anything."""
    low = F.lower(line)
    return has_any(low, ["log_event(", "logger.", "log."]) & ~has_any(low, ["=", "set", "cache", "store"])


# License wording.
LICENSE_NOTICE = ["mit license", "apache license", "bsd license", "mpl-2.0", "mozilla public license", "spdx", "copyright"]
LICENSE_NOTICE_BLOCKERS = [
    "verify", "validate", "activation", "activate", "entitlement", "subscription",
    "校验", "验证", "激活", "授权", "订阅", "localhost", "127.0.0.1", "bypass", "绕过",
]
LICENSE_WORDS = ["license", "licence", "许可证", "授权"]
LICENSE_SIGNALS = [
    "verify", "validate", "activation", "activate", "entitlement", "subscription",
    "校验", "验证", "激活", "订阅", "localhost", "127.0.0.1", "http://", "license_server", "license server",
    "endpoint", "server", "url", "env", "mock", "验证失败", "fail open", "fail_open", "bypass", "绕过",
    "skip", "continue", "ignore",
]


def is_license_notice(c: Column) -> Column:
    """Open-source notice text without validation or bypass vocabulary."""
    low = F.lower(c)
    return has_any(low, LICENSE_NOTICE) & ~has_any(low, LICENSE_NOTICE_BLOCKERS)


def is_license_config(text: Column) -> Column:
    """License word plus a validation, server or bypass word; notices and comments excluded."""
    low = F.lower(text)
    return is_code_line(text) & ~is_license_notice(text) & has_any(low, LICENSE_WORDS) & has_any(low, LICENSE_SIGNALS)


def prompt_override(c: Column) -> Column:
    return contains_any(c, PROMPT_OVERRIDE)


# Spellings of the three severities.
SEVERITY_SPELLINGS = {
    "high": ["high", "high risk", "critical", "严重", "严重风险", "高", "高风险"],
    "medium": ["medium", "medium risk", "中", "中风险"],
    "low": ["low", "low risk", "低", "低风险"],
}


def normalize_severity(c: Column) -> Column:
    """English and Chinese spellings -> high/medium/low; empty -> low; unknown kept."""
    key = F.lower(ws_trim(c))
    out = F.when(F.coalesce(key, F.lit("")) == "", F.lit("low"))
    for name, spellings in SEVERITY_SPELLINGS.items():
        out = out.when(key.isin(spellings), F.lit(name))
    return out.otherwise(c)


def clean_array(arr: Column) -> Column:
    """Trim, drop empty, keep first occurrence, preserve order."""
    return F.array_distinct(F.filter(F.transform(arr, ws_trim), lambda x: x != ""))


def split_ids(c: Column) -> Column:
    """Comma list -> trimmed distinct ids in order of first occurrence."""
    return clean_array(F.split(F.coalesce(c, F.lit("")), ",", -1))


def split_permissions(c: Column) -> Column:
    """Comma list -> trimmed non-empty items; repeats kept."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ",", -1), ws_trim), lambda x: x != "")


def char_entropy(c: Column) -> Column:
    """Shannon entropy per character; 0.0 for empty text."""
    return _entropy(c, F.length(c))


def byte_entropy(c: Column) -> Column:
    """Character frequencies divided by the *byte* length (differs for non-ASCII text)."""
    return _entropy(c, F.octet_length(c))


def _entropy(c: Column, total: Column) -> Column:
    # Sorted characters put equal ones side by side; a back-reference cuts the runs, so the
    # only lambda work left is one step per distinct character:
    # -sum(k/t * log2(k/t)) = (n*log2(t) - sum(k*log2(k))) / t
    ordered = F.array_join(F.sort_array(F.split(c, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    weighted = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r).cast("double")))
    n, t = F.length(c).cast("double"), total.cast("double")
    return F.when(n > 0, (n * F.log2(t) - weighted) / t + F.lit(0.0)).otherwise(F.lit(0.0))


# The two halves of the alphabet exchanged.
ROT13_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT13_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def rot13(c: Column) -> Column:
    return F.translate(c, ROT13_FROM, ROT13_TO)


def code_window(lines: Column, line_no: Column, radius: int, joiner: str = "\n") -> Column:
    """Lines ``line_no ± radius`` (1-based) joined to one text."""
    start = F.greatest(line_no - radius, F.lit(1))
    stop = F.least(line_no + radius, F.size(lines))
    return F.array_join(F.slice(lines, start, stop - start + 1), joiner)


def code_snippet(lines: Column, first: Column, last: Column, radius: int) -> Column:
    """Numbered context block; hit lines ``first..last`` carry the ``> `` marker."""
    start = F.greatest(first - radius, F.lit(1))
    stop = F.least(last + radius, F.size(lines))
    body = F.transform(
        F.sequence(start, stop),
        lambda i: F.concat(
            F.when((i >= first) & (i <= last), F.lit("> ")).otherwise(F.lit("  ")),
            # right-align in four places; longer numbers are printed whole
            F.when(i < 10000, F.lpad(i.cast("string"), 4, " ")).otherwise(i.cast("string")),
            F.lit(" | "), F.get(lines, i - 1), F.lit("\n"),
        ),
    )
    return F.array_join(body, "")


def hit_lines(lines: Column, predicate) -> Column:
    """1-based numbers of the lines satisfying ``predicate``; stays inside the file's row."""
    flagged = F.transform(lines, lambda l, i: F.when(predicate(l), i + 1))
    return F.filter(flagged, lambda x: x.isNotNull())


def hit_islands(hits: Column) -> Column:
    """Sorted line numbers -> array of (line_start, line_end) for consecutive runs."""
    starts = F.filter(hits, lambda h, i: (i == 0) | (F.get(hits, i - 1) < h - 1))
    ends = F.filter(hits, lambda h, i: (i == F.size(hits) - 1) | (F.get(hits, i + 1) > h + 1))
    return F.arrays_zip(starts.alias("line_start"), ends.alias("line_end"))
