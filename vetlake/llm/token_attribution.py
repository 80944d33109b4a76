"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole.  Its tokens are consecutive byte spans, and so are its sections;
both are mapped to characters, and the two lists of spans are joined by interval: every pair of a token
and a section that share a character.  A token inside one section is that section's.  A token that
crosses a boundary is allocated by an explicit rule:

* ``majority``  the section with most of its characters; of equal shares the earlier one (the default),
* ``start``     the section with its first character,
* ``split``     each section its share of the token's characters, so counts are fractions.

A token that ends inside a character counts that character with the token that begins it.  Sections cover
the text: sentences with the blank that ends them, lines, or what ``sections`` returns.

The join is local to a document (two sorted lists, one binary search per section), and no text is
shuffled.

Defined cases.  Null or empty text: one empty section, 0 tokens.  Null ``doc_id``: counted, id null.
Repeated rows: each is returned.  Very long texts: encoded whole, in memory in proportion to them;
very long runs of white space are encoded as the one piece they are (see ``Encoder``).  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import whole_text

RULES = ("majority", "start", "split")
# What the tokenizer's pattern takes for white space.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_BLANK = re.compile(f"[{_BLANK}]{{2000,}}")


class Encoder:
    """Byte-level BPE that also gives the bytes of every token.

    The pattern takes a run of white space as one piece, less its last character if text follows.
    Where a run is so long that matching it would exhaust the matcher's stack, that piece is cut
    out and encoded by itself: the same tokens.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = [len(x) for x in ranks]

    def ids(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for run in _LONG_BLANK.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > at:
                parts.append(self._ordinary(text[at : run.start()]))
            parts.append(np.array(self._encoding._encode_single_piece(text[run.start() : stop]), np.int64))
            at = stop
        if at < len(text):
            parts.append(self._ordinary(text[at:]))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _ordinary(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def token_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Length of each token in bytes; together they are the text."""
        return self._bytes[ids]


_BY_PATH: dict[str, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _BY_PATH:
        _BY_PATH[path] = Encoder(path, pattern)
    return _BY_PATH[path]


def line_starts(text: str) -> np.ndarray:
    """Sections that are lines, each with its line end: where they start, in characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate(([0], np.flatnonzero(codes == 10) + 1)) if len(codes) else np.zeros(1, np.int64)


def sentence_starts(text: str) -> np.ndarray:
    """Sections that are sentences: they end with a line end, or with the blank after ``.``, ``!`` or ``?``."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = codes == 10
    ends[1:] |= (codes[1:] == 32) & ((codes[:-1] == 46) | (codes[:-1] == 33) | (codes[:-1] == 63))
    return np.concatenate(([0], np.flatnonzero(ends) + 1))


def token_spans(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token.

    A token has the characters that begin in it; one that only continues a character has that one.
    """
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(begins)))  # characters that begin before a byte
    stop = np.cumsum(sizes)
    first, last = before[stop - sizes], before[stop] - 1
    return np.minimum(first, np.maximum(last, 0)), last


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and, of these, how many tokens that cross a boundary touch it."""
    own, end = np.searchsorted(starts, first, side="right") - 1, np.searchsorted(starts, last, side="right") - 1
    crossing = np.flatnonzero(end > own)
    counts = np.bincount(np.delete(own, crossing) if len(crossing) else own, minlength=len(starts)).astype(np.float64)
    touched = np.zeros(len(starts), np.int64)
    edges = np.append(starts, np.iinfo(np.int64).max)
    if rule == "majority":  # most tokens that cross a boundary cross one
        two = crossing[end[crossing] == own[crossing] + 1]
        a = own[two]
        left, right = edges[a + 1] - first[two], last[two] + 1 - edges[a + 1]
        counts += np.bincount(np.where(left >= right, a, a + 1), minlength=len(starts))
        touched += np.bincount(a, minlength=len(starts)) + np.bincount(a + 1, minlength=len(starts))
        crossing = np.setdiff1d(crossing, two, assume_unique=True)
    for t in crossing:
        a, b = own[t], end[t]
        share = np.minimum(edges[a + 1 : b + 2], last[t] + 1) - np.maximum(edges[a : b + 1], first[t])
        touched[a : b + 1] += share > 0
        if rule == "majority":
            counts[a + int(np.argmax(share))] += 1  # the first of the largest
        elif rule == "start":
            counts[a] += 1
        else:
            counts[a : b + 1] += share / share.sum()
    return counts, touched


_COLUMNS = "section int, first_char long, n_chars long, n_tokens double, n_crossing long"


def count_tokens(docs: DataFrame, rule: str = "majority", sections: Callable[[str], np.ndarray] = sentence_starts, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document and section: ``doc_id, section, first_char, n_chars, n_tokens, n_crossing``.

    ``n_crossing`` counts the tokens that touch the section and another one.  ``vocabulary`` is a file of
    ranks for ``tiktoken``, ``pattern`` its pre-tokenizer; both default to the public byte-level BPE.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    import public_tokenizers

    path, pat = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vetlake.llm.token_attribution import encoder

        encode = encoder(path, pat)
        for batch in batches:
            sizes: list[int] = []
            parts: list[tuple] = []
            for text in batch.column("text"):
                x = text.as_py()
                starts = sections(x)
                first, last = token_spans(x.encode(), encode.token_bytes(encode.ids(x)))
                counts, touched = attribute(first, last, starts, rule)
                parts.append((np.arange(len(starts), dtype=np.int32), starts.astype(np.int64), np.diff(np.append(starts, len(x))), counts, touched))
                sizes.append(len(starts))
            if parts:
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), *[pa.array(np.concatenate(c)) for c in zip(*parts)]], names=["doc_id", "section", "first_char", "n_chars", "n_tokens", "n_crossing"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_COLUMNS).fields])
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(count, schema)
