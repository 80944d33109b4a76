"""License scans as an exact set-similarity join of text blocks with license notices.

Blocks are all runs of ``BLOCK`` words that start at multiples of ``STRIDE``; a notice of up to ``STRIDE`` words
standing in a text lies whole in one of them.  A longer notice, such as the text of a whole license, has blocks
of its own, whose stride is the least multiple of ``STRIDE`` by a power of two that holds it.  A block meets a notice if it
contains at least ``THRESHOLD`` of the notice's different words and each of its ``TELLING`` words beside a neighbour it has
in the notice: siblings differ in one word, which no containment below 1 can see, and which may stand in the block by chance.

The words of all notices are counted over the whole corpus (at most one row per notice word and task
is shuffled) and ordered from rare to frequent.  A notice of ``n`` words that needs ``a`` of them in a block
must share one of its ``n - a + 1`` rarest: only these *prefix* words are looked up, so blocks without one are
never formed.  A block with fewer than ``a`` notice words fails by length; while its words are matched
in order, a notice is dropped as soon as the words left on either side cannot make up ``a``.  What is left
is counted exactly.  The filters lose nothing.

Notices are a fixed list; the join is local to a document and no text is shuffled.

Defined cases.  Null or empty text: no words, no labels.  Null ``doc_id``: scanned, id null.
Repeated rows: each is returned.  A very long text: memory in proportion to it, time in proportion to its
words.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

BLOCK = 64
STRIDE = 32
THRESHOLD = Fraction(4, 5)

# Phrases whose places are counted, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# The opening words of common license notices.
NOTICES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

# The words of whole licenses and of the notice that one of them asks for.
NOTICES += [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
     "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
     "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
     "other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
     "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
     "either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the "
     "above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
     "disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied "
     "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be "
     "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
     "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
     "software even if advised of the possibility of such damage"),
]

# Words that tell sibling licenses apart.
TELLING = frozenset("affero apache bsd commons creative isc lesser library mit mozilla nc nd program sa".split())

_NOT_WORD = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8, with A-Z in lower case."""
    return text.encode().lower().translate(_NOT_WORD).split()


def count_words(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of ``vocabulary`` occurs in all texts; its size bounds what is collected."""
    known = frozenset(w.encode() for w in vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(filter(known.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    sums = docs.select(whole_text().alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in sums.collect()}


def telling_pairs(text: str) -> list[tuple[str, str | None, str | None]]:
    """Every place of a telling word in a notice: the word, the one before and the one after."""
    words: list = [None, *text.split(), None]
    return [(w, words[i - 1], words[i + 1]) for i, w in enumerate(words) if w in TELLING]


def stride_of(text: str) -> int:
    """The least stride that holds a notice."""
    stride = STRIDE
    while stride < len(text.split()):
        stride *= 2
    return stride


class NoticeIndex:
    """Notices with their words from rare to frequent, and the prefix words that lead to them."""

    def __init__(self, notices: list[tuple[str, str]], frequency: dict[str, int], threshold: Fraction, stride: int = STRIDE):
        self.stride = stride
        vocabulary = sorted({w for _, text in notices for w in text.split()}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w.encode(): k for k, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in notices]
        self.ranks = [sorted({self.rank[w.encode()] for w in text.split()}) for _, text in notices]
        self.sets = [frozenset(r) for r in self.ranks]
        self.need = [ceil(threshold * len(r)) for r in self.ranks]
        none = lambda w: w and w.encode()
        self.telling: list[dict[bytes, list[tuple]]] = []
        for _, text in notices:
            places: dict[bytes, list[tuple]] = {}
            for w, before, after in telling_pairs(text):
                places.setdefault(w.encode(), []).append((none(before), none(after)))
            self.telling.append(places)
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (ranks, need) in enumerate(zip(self.ranks, self.need)):
            for place, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(r, []).append((k, place))

    def matches(self, block: set[int]) -> list[tuple[int, int]]:
        """Notices that ``block`` (ranks of its notice words) contains sufficiently, with the words shared."""
        ordered = sorted(block)
        shared: dict[int, int] = {}
        for i, r in enumerate(ordered):
            for k, place in self.prefix.get(r, ()):
                if shared.get(k, 0) + min(len(self.ranks[k]) - place, len(ordered) - i) >= self.need[k]:
                    shared[k] = shared.get(k, 0) + 1
        exact = [(k, len(self.sets[k] & block)) for k in shared]
        return [(k, n) for k, n in exact if n >= self.need[k]]

    def told(self, words: list[bytes], first: int, notice: int) -> bool:
        """Whether each telling word of the notice stands in the block at ``first`` beside one of its neighbours."""
        stop = min(len(words), first + 2 * self.stride)
        for word, places in self.telling[notice].items():
            at = first - 1
            while True:
                try:
                    at = words.index(word, at + 1, stop)
                except ValueError:
                    return False
                before, after = words[at - 1] if at else None, words[at + 1] if at + 1 < len(words) else None
                if any(b is not None and b == before or a is not None and a == after for b, a in places):
                    break
        return True

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """``(first word, notice, words shared)`` of every block that meets a notice."""
        hits = [(i, self.rank[w]) for i, w in enumerate(words) if w in self.rank]
        blocks: dict[int, set[int]] = {k: set() for i, r in hits if r in self.prefix for k in (i // self.stride - 1, i // self.stride) if k >= 0}
        if blocks:
            for i, r in hits:
                for k in (i // self.stride - 1, i // self.stride):
                    if k in blocks:
                        blocks[k].add(r)
        return [(k * self.stride, notice, n) for k in sorted(blocks) for notice, n in self.matches(blocks[k]) if self.told(words, k * self.stride, notice)]


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand one after the other."""
    out = []
    for phrase, label in phrases:
        at = -1
        for _ in range(words.count(phrase[0])):
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                out.append((at, label))
    return out


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<first_word:long,label:string,containment:double>>"


def indexes(notices: list[tuple[str, str]], frequency: dict[str, int], threshold: Fraction) -> list[NoticeIndex]:
    """One index per stride, the shortest first."""
    strided: dict[int, list[tuple[str, str]]] = {}
    for label, text in notices:
        strided.setdefault(stride_of(text), []).append((label, text))
    return [NoticeIndex(some, frequency, threshold, stride) for stride, some in sorted(strided.items())]


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per document: phrase places, labels, score and the ``blocks`` that meet a notice.

    ``score`` is 1 where a phrase stands, else the largest containment of a block that meets a notice, else 0.
    """
    every = indexes(notices, count_words(docs, sorted({w for _, text in notices for w in text.split()})), threshold)
    phrases = [(p.encode().split(), label) for p, label in PHRASES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column("text"):
                words = words_of(text.as_py())
                base = phrase_places(words, phrases)
                blocks = [(at, index.labels[k], n / len(index.ranks[k])) for index in every for at, k, n in index.scan(words)]
                starts, own = [at for at, _ in base], {label for _, label in base}
                row = (
                    len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {b[1] for b in blocks})),
                    1.0 if base else max((b[2] for b in blocks), default=0.0), [{"first_word": a, "label": x, "containment": c} for a, x, c in blocks],
                )
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_RESULT).fields])
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(scan, schema)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


LICENSE_SQL = f"""
WITH notice(k, label, stride, word) AS (VALUES {_values([(k, label, stride_of(text), w) for k, (label, text) in enumerate(NOTICES) for w in sorted(set(text.split()))])}),
telling(k, stride, word, before, after) AS (VALUES {_values([(k, stride_of(text), w, b or '', a or '') for k, (_, text) in enumerate(NOTICES) for w, b, a in telling_pairs(text)])}),
sizes AS (SELECT k, count(*) AS size, (SELECT count(DISTINCT word) FROM telling t WHERE t.k = notice.k) AS n_telling FROM notice GROUP BY k),
w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w),
l AS (SELECT *, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lag(word, 1) OVER o AS w0 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, unnest(list_filter([CASE WHEN word = 'gnu' AND w1 = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' END, CASE WHEN word = 'apache' AND w1 = 'license' THEN 'apache' END,
  CASE WHEN word = 'cc' AND w1 = 'by' THEN 'cc-by' END, CASE WHEN word = 'mit' AND w1 = 'license' THEN 'mit' END], lambda x: x IS NOT NULL)) AS label FROM l),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS base FROM p GROUP BY doc_id),
h AS (SELECT doc_id, n.k, n.label, n.word, unnest([i // n.stride - 1, i // n.stride]) AS b FROM u JOIN notice n ON u.word = n.word),
m AS (SELECT doc_id, b, k, any_value(label) AS label, count(DISTINCT word) AS shared FROM h WHERE b >= 0 GROUP BY doc_id, b, k),
th AS (SELECT doc_id, t.k, t.word, unnest([i // t.stride - 1, i // t.stride]) AS b FROM l JOIN telling t ON l.word = t.word AND (l.w0 = t.before OR l.w1 = t.after)),
tm AS (SELECT doc_id, b, k, count(DISTINCT word) AS told FROM th GROUP BY doc_id, b, k),
f AS (SELECT m.doc_id, count(*) AS n_blocks, list(label) AS own, max(shared / size) AS best FROM m JOIN sizes USING (k) LEFT JOIN tm ON tm.doc_id = m.doc_id AND tm.b = m.b AND tm.k = m.k
  WHERE 5 * shared >= 4 * size AND coalesce(told, 0) = n_telling GROUP BY m.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(base, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN f USING (doc_id)
"""
