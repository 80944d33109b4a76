"""Base64 / hex / rot13 recovery as native Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HIDDEN_CHARS, has_any, let, matches, prompt_override, rot13, ws_trim

# Token shapes.
BASE64_TOKEN = r"[A-Za-z0-9+/]{20,}={0,2}"
HEX_TOKEN = r"(?i)(?<![0-9A-Za-z_])[0-9a-f]{24,}+(?![0-9A-Za-z_])"
HEX_CANDIDATE = r"(?i)(?:\\x[0-9a-f]{2}){8,}|(?:0x)?[0-9a-f]{32,}"
LONG_TOKEN = 48
# What makes decoded text worth keeping.
INTERESTING_WORDS = ["http", "https", "fetch", "exec", "eval", "system", "bash", "sh ", "cmd", "token", "secret",
                     "password", "api", "curl", "wget", "socket", "process.env"]
INTERESTING_CHARS = r"[/\\(){}\[\]:=;.]"
NOT_PRINTABLE = r"[^\n\r\t -~]"


def interesting(c: Column) -> Column:
    return has_any(F.lower(c), INTERESTING_WORDS) | c.rlike(INTERESTING_CHARS)


def base64_bytes(token: Column) -> Column:
    """Padded standard base64 -> bytes, or null."""
    ok = (F.length(token) % 4 == 0) & token.rlike(r"^[A-Za-z0-9+/]*={0,2}$")
    return F.when(ok, F.try_to_binary(token, F.lit("base64")))


def hex_bytes(token: Column) -> Column:
    ok = (F.length(token) % 2 == 0) & token.rlike(r"^[0-9A-Fa-f]+$")
    return F.when(ok, F.try_to_binary(token, F.lit("hex")))


def readable(raw: Column) -> Column:
    """Bytes -> trimmed text of at least 8 bytes, valid UTF-8 and at least 85 % printable; else null."""
    def check(text: Column) -> Column:
        size = F.octet_length(text)
        printable = F.length(F.regexp_replace(text, NOT_PRINTABLE, ""))
        ok = (size >= 8) & (printable * 100 >= F.length(text) * 85)
        return F.when(ok, F.replace(text, F.lit("\x00"), F.lit("")))

    valid = lambda b: F.when((F.octet_length(b) >= 8) & F.is_valid_utf8(b.cast("string")), let(ws_trim(b.cast("string")), check))
    return let(raw, valid)


def decode_once(token: Column) -> Column:
    """One layer: struct(technique, text); both null when nothing decodes. Base64 wins over hex."""
    both = F.struct(readable(base64_bytes(token)).alias("b64"), readable(hex_bytes(token)).alias("hexed"))
    return let(both, lambda x: F.struct(
        F.when(x["b64"].isNotNull(), F.lit("base64")).when(x["hexed"].isNotNull(), F.lit("hex")).alias("technique"),
        F.coalesce(x["b64"], x["hexed"]).alias("text"),
    ))


def decode_layers(token: Column) -> Column:
    """All nested layers -> array of ``technique[depth]: text``; layer 1 must look interesting.

    The chain is carried in an accumulator so each layer is decoded once.  A layer has at most three quarters
    of the bytes of the one around it and at least 8, which bounds the depth by the length of the token.
    """
    start = F.struct(ws_trim(token).alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, depth: Column) -> Column:
        def grow(d: Column) -> Column:
            entry = F.concat(d["technique"], F.lit("["), depth.cast("string"), F.lit("]: "), d["text"])
            keep = d["text"].isNotNull() & ((depth > 1) | interesting(d["text"]))
            return F.struct(d["text"].alias("cur"), F.when(keep, F.array_append(acc["out"], entry)).otherwise(acc["out"]).alias("out"))

        return F.when(acc["cur"].isNotNull(), let(decode_once(acc["cur"]), grow)).otherwise(acc)

    deepest = F.greatest(F.lit(1), F.coalesce(F.ceil(F.log(F.greatest(F.octet_length(token), F.lit(8)) / 8) / math.log(4 / 3)).cast("int"), F.lit(1)) + 1)
    return F.array_distinct(F.aggregate(F.sequence(F.lit(1), deepest), start, step, lambda acc: acc["out"]))


def _mostly_printable(raw: Column) -> Column:
    kept = F.length(F.regexp_replace(raw.cast("string"), NOT_PRINTABLE, ""))
    return F.when(kept > 0.85 * F.octet_length(raw), raw.cast("string"))


def _loose_base64(token: Column) -> Column:
    """Padded or unpadded base64."""
    body = F.regexp_replace(token, "=+$", "")
    pad = (4 - F.length(body) % 4) % 4
    ok = (pad < 3) & ((F.length(token) == F.length(body)) | (F.length(token) % 4 == 0))
    return F.when(ok, F.try_to_binary(F.concat(body, F.repeat(F.lit("="), pad)), F.lit("base64")))


def decoded_candidates(c: Column) -> Column:
    """Readable decodings of every base64-like and hex-like token."""
    b64 = F.transform(F.regexp_extract_all(c, F.lit(BASE64_TOKEN), F.lit(0)), lambda t: _mostly_printable(_loose_base64(t)))
    raw_hex = F.transform(
        F.regexp_extract_all(c, F.lit(HEX_CANDIDATE), F.lit(0)),
        lambda t: F.regexp_replace(t, r"(?i)\\x|0x", ""),
    )
    hexed = F.transform(raw_hex, lambda t: _mostly_printable(hex_bytes(t)))
    return F.filter(F.concat(b64, hexed), lambda x: x.isNotNull())


def decoded_prompt_override(c: Column) -> Column:
    """An encoded token decodes (directly or through rot13) to an override phrase."""
    found = F.exists(decoded_candidates(c), lambda x: prompt_override(x) | prompt_override(rot13(x)))
    # cheap guard: no token-like run means nothing to decode
    return F.when(c.rlike(r"[A-Za-z0-9+/]{20}|(?i:(?:\\x[0-9a-f]{2}){8})"), found).otherwise(F.lit(False))


def any_prompt_override(c: Column) -> Column:
    return prompt_override(c) | decoded_prompt_override(c)


def has_hidden_chars(c: Column) -> Column:
    return matches(c, HIDDEN_CHARS)
