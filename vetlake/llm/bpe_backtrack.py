"""BPE encoding in linear time by backtracking, and decoding with an offset table.

Encoding a piece never replays its merges.  An Aho-Corasick automaton over the reversed vocabulary reads
the reversed piece once and gives, for every position, the longest token that starts there.  The encoder
walks forward and takes the longest token whose predecessor tolerates it; where none does, it goes on
to the longest shorter prefix that is a token, and from a dead end it takes the last token back and
marks the place.  No place is entered again once it is marked, so the work is linear in the piece.

Two neighbours tolerate each other if merging their joint text gives just these two.  That is read from
the merge table alone: undo the later of the two tokens again and again, and see whether a merge across
the border would have come before the merge that used up a side.  Answers are kept in a
pair-compatibility table of at most ``PAIRS_KEPT`` entries.  This gives exact merges for a vocabulary
whose tokens are each made by one merge of earlier tokens and encode to themselves; a table that breaks
the first rule is refused, and the tests check the second for the public one.

Decoding gathers slices of one byte string: token i stands at ``offsets[i]:offsets[i + 1]``, followed by
the blank that the tokenizer puts between tokens when it has no decoder of its own.

Normalising and cutting a text into pieces is not merging and is left to the tokenizer file's own rules.
Both are local to runs without white space, so ids of such a chunk are remembered per worker; with
``CHUNKS_KEPT`` of them the worker starts anew, and long chunks are encoded each time.  A task holds one batch of
texts, these tables and at most ``OUT_BYTES`` (or one document) of output.

Defined cases.  Null or empty text: no ids, empty decoded text.  Null ``doc_id``: encoded, id null.
Repeated rows: each is returned.  Very long texts and pieces: whole, in memory in proportion.  Special
tokens written in a text get their id, as the library does.  Ids that the vocabulary lacks are skipped
when decoding; null ids give an empty text.  Empty table: no rows.  Other columns are ignored by
``encode`` and carried by ``decode``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text
from .packing import default_tokenizer
from .word_tokens import ALPHABET, ChunkIds

PAIRS_KEPT = 300_000
CHUNKS_KEPT = 500_000
OUT_BYTES = 8 << 20  # of a batch that leaves a task
# the last character of a word is another symbol than the same character inside a word
_LAST = 0x1000


class Merges:
    """What a merge table says about tokens: how they split, which prefixes they have, who may stand together."""

    def __init__(self, model: dict):
        end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        made = {a + b: k for k, (a, b) in enumerate(pairs)}
        if len(made) != len(pairs) or any(made.get(p, -1) >= k for k, pair in enumerate(pairs) for p in pair):
            raise ValueError("each token must come from one merge of earlier tokens")
        # order of creation; single characters come first
        base = [t for t in vocab if t not in made]
        order = base + [a + b for a, b in pairs]
        self.first_made = len(base)
        self.ids = [vocab[t] for t in order]
        number = {t: n for n, t in enumerate(order)}
        self.left = [-1] * len(base) + [number[a] for a, _ in pairs]
        self.right = [-1] * len(base) + [number[b] for _, b in pairs]
        self.joined = {(number[a], number[b]): len(base) + k for k, (a, b) in enumerate(pairs)}
        spelled = [t[: -len(end) - 1] + chr(ord(t[-len(end) - 1]) + _LAST) if end and t.endswith(end) and len(t) > len(end) else t for t in order]
        self.marks_end = bool(end)
        self.size = [len(s) for s in spelled]
        known = {s: n for n, s in enumerate(spelled)}
        #: the longest proper prefix that is a token too
        self.shorter = [next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1) for s in spelled]
        self.spelled = spelled
        self._compatible: dict[int, bool] = {}

        import ahocorasick

        self._backward = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, s in enumerate(spelled):
            self._backward.add_word(s[::-1], n)
        self._backward.make_automaton()

    def symbols(self, piece: str) -> str:
        return piece[:-1] + chr(ord(piece[-1]) + _LAST) if self.marks_end else piece

    def longest(self, symbols: str) -> list[int]:
        """For every position the longest token that starts there (-1: none)."""
        best, size, top = [-1] * len(symbols), self.size, len(symbols) - 1
        for at, n in self._backward.iter(symbols[::-1]):
            at = top - at
            if best[at] < 0 or size[n] > size[best[at]]:
                best[at] = n
        return best

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of ``a`` followed by ``b`` end with just these two."""
        pair = a << 32 | b
        got = self._compatible.get(pair)
        if got is None:
            got = self._undo(a, b)
            if len(self._compatible) < PAIRS_KEPT:
                self._compatible[pair] = got
        return got

    def _undo(self, a: int, b: int) -> bool:
        # a token is used up by the merge that makes the next one on its edge; of equal merges the left one comes first
        used_a = used_b = len(self.size)
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < used_a and across <= used_b:
                return False
            if max(a, b) < self.first_made:
                return True
            if a > b:
                used_a, a = a, self.right[a]
            else:
                used_b, b = b, self.left[b]

    def encode(self, symbols: str) -> list[int]:
        """Numbers of the tokens of one piece, in the order of merging them."""
        longest, size, shorter = self.longest(symbols), self.size, self.shorter
        open_, n = bytearray(b"\1") * (len(symbols) + 1), len(symbols)
        taken: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and not (open_[at + size[token]] and (not taken or self.compatible(taken[-1], token))):
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            elif taken:
                open_[at] = 0
                token = taken.pop()
                at -= size[token]
            else:
                raise ValueError("a character is not in the vocabulary")
        return taken


# small Latin letters, which no normal form changes: such a chunk is one piece
_ONE_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


class Encoder(ChunkIds):
    """chunk without white space (bytes) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self._specials = {t["content"]: int(t["id"]) for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._specials, key=len, reverse=True))) + ")") if self._specials else None

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CHUNKS_KEPT:
            self.clear()
        return super().__missing__(chunk)

    def _encode(self, chunk: bytes) -> bytes:
        out: list[int] = []
        merges = self.merges
        if _ONE_WORD(chunk):
            got = merges.encode(merges.symbols(chunk.decode("latin-1").translate(ALPHABET)))
            return np.array([merges.ids[n] for n in got], "<u4").tobytes()
        text, t = chunk.decode(), self._tokenizer
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self._specials:
                out.append(self._specials[part])
            elif part:
                for piece, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part)):
                    out.extend(merges.ids[n] for n in merges.encode(merges.symbols(piece)))
        return np.array(out, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        # a capital with a combining mark may have no composed form where the small letter has one
        raw = text.encode()
        if b"\xcc" in raw or b"\xcd" in raw:
            return b"".join(map(self.__getitem__, raw.split()))
        return super().text(text)


class OffsetTable:
    """Bytes of every token, one after the other, each with a blank behind it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder"):
            raise ValueError("the offset table is for tokenizers whose tokens are joined by blanks")
        tokens = {n: t.encode() + b" " for t, n in spec["model"]["vocab"].items()} | {int(t["id"]): t["content"].encode() + b" " for t in spec["added_tokens"]}
        size = np.zeros(max(tokens) + 1, np.int64)
        size[list(tokens)] = [len(t) for t in tokens.values()]
        self.offsets = np.concatenate(([0], np.cumsum(size)))
        self.bytes = np.frombuffer(b"".join(tokens[n] for n in sorted(tokens)), np.uint8)

    def decode(self, packed: bytes, some: int = 1 << 16) -> str:
        """Text of packed ids, gathered ``some`` ids at a time."""
        ids = np.frombuffer(packed, "<u4")
        whole = b"".join([self._gather(ids[i : i + some]) for i in range(0, len(ids), some)])
        return whole[:-1].decode("utf-8", "replace")  # no blank behind the last

    def _gather(self, ids: np.ndarray) -> bytes:
        ids = ids[ids < len(self.offsets) - 1].astype(np.int64)
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        stop = np.cumsum(size)
        return self.bytes[np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - size), size)].tobytes()


_ENCODERS: dict[str, Encoder] = {}
_TABLES: dict[str, OffsetTable] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def offset_table(path: str) -> OffsetTable:
    if path not in _TABLES:
        _TABLES[path] = OffsetTable(path)
    return _TABLES[path]


def _in_parts(rows: Iterator[tuple], sizes) -> Iterator[list[tuple]]:
    """Rows in lists of about ``OUT_BYTES``."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += sizes(row)
        if held >= OUT_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def _encoded(docs: DataFrame, path: str, with_text: bool) -> DataFrame:
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if with_text else [])]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vetlake.llm.bpe_backtrack import _in_parts, encoder, offset_table

        ids, table = encoder(path), offset_table(path) if with_text else None

        def row(x: pa.Scalar) -> tuple:
            packed = ids.text(x.as_py())
            return (packed, table.decode(packed)) if table else (packed,)

        for batch in batches:
            at = 0
            for part in _in_parts(map(row, batch.column("text")), lambda r: sum(map(len, r))):
                columns = [pa.array([len(r[0]) // 4 for r in part], pa.int64()), pa.array([r[0] for r in part], pa.binary())]
                if table:
                    columns.append(pa.array([r[1] for r in part], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), *columns], names=names)
                at += len(part)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` per document; ``ids`` are packed little-endian unsigned 32-bit integers."""
    return _encoded(docs, tokenizer or default_tokenizer(), False)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``encode`` with the text that the ids decode to, in the same worker."""
    return _encoded(docs, tokenizer or default_tokenizer(), True)


def decode(encoded: DataFrame, tokenizer: str | None = None, column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its packed ``ids``, special tokens included."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vetlake.llm.bpe_backtrack import _in_parts, offset_table

        table = offset_table(path)
        for batch in batches:
            at = 0
            for part in _in_parts((table.decode(x.as_py() or b"") for x in batch.column("ids")), len):
                some = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(part, pa.string())], names=[*batch.schema.names, column])
                at += len(part)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())]))


def id_list(encoded: DataFrame) -> DataFrame:
    """``doc_id, position, id``: the packed ids as rows, for joins with other tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py() or b"", "<u4") for x in batch.column("ids")]
            sizes = [len(x) for x in ids]
            if sum(sizes):
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                place = np.concatenate([np.arange(n) for n in sizes])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), pa.array(place, pa.int64()), pa.array(np.concatenate(ids).astype(np.int64))], names=["doc_id", "position", "id"])

    schema = T.StructType([encoded.schema["doc_id"], T.StructField("position", T.LongType()), T.StructField("id", T.LongType())])
    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, schema)
