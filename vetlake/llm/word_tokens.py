"""Ids of a tokenizer that drops white space, with a bounded memory of chunks that a task gives back.

White space never joins or shapes tokens there, so the ids of a text are those of its chunks in a row.
Where the file's rules say that a run of letters is one piece, a chunk of Latin letters goes to its merges directly.
A task encodes a chunk when it first meets it and remembers it, up to ``CACHE_CHUNKS`` short chunks; later
ones are encoded each time.  At its end the task forgets them: its worker process lives on, and would hold them
through every later stage.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_CHUNKS = 700_000
_LONGEST_KEPT = 48
# cut off only after a letter or digit, where the tokenizer starts a new piece anyway
_TAIL = b".,!?;:#*$%&"
# rules under which a run of letters is one piece, lowered and spelled in the byte alphabet
_LETTER_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
# ASCII and Latin-1 letters, which no normal form changes and which have one small letter each
_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
# the byte alphabet: printable Latin characters stand for themselves, all other bytes follow from 256 on
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPELLED = [chr(ALPHABET.get(b, b)) for b in range(256)]


class ChunkIds(dict):
    """chunk (bytes) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = all(spec.get(k) == v for k, v in _LETTER_RULES.items()) and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        # an added token may stand anywhere, inside words too
        self._merge = self._tokenizer.model.tokenize if plain and not any(_WORD(t["content"].encode()) for t in spec["added_tokens"]) else None

    def __enter__(self) -> ChunkIds:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def _encode(self, chunk: bytes) -> bytes:
        if self._merge and _WORD(chunk):
            word = chunk.decode().lower()
            got = self._merge(word if word.isascii() else "".join([_SPELLED[b] for b in word.encode()]))
            return b"".join([t.id.to_bytes(4, "little") for t in got])
        ids = self._tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def __missing__(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(_TAIL)
        if core and len(core) < len(chunk):
            last = core[-4:].decode(errors="replace")[-1]
            # Latin, Greek and Cyrillic letters: every Unicode version agrees on these
            if last.isascii() and last.isalnum() or "À" <= last < "԰" and last.isalpha():
                ids = self[core] + self[chunk[len(core) :]]
            else:
                ids = self._encode(chunk)
        else:
            ids = self._encode(chunk)
        if len(chunk) <= _LONGEST_KEPT and len(self) < CACHE_CHUNKS:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text.  The tokenizer ignores case; lowering ASCII first makes chunks meet."""
        raw = text.encode()
        low = raw.lower()
        # special tokens are spelled in lower case and must not arise by lowering
        return b"".join(map(self.__getitem__, (raw if b"<|" in low else low).split()))


_BY_PATH: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    if path not in _BY_PATH:
        _BY_PATH[path] = ChunkIds(path)
    return _BY_PATH[path]
