"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

One Aho-Corasick automaton per task finds all keywords in the ASCII-lower-cased text;
an expression is tried only at the places its keywords stand.  Digit runs have no
keyword: a run of 32 hexadecimal digits covers two neighbouring places out of every
sixteenth byte, so only where both are such digits is the run measured.

Base kinds (fixed patterns): assign, access, hex.  Further kinds of the method, each
checked beyond its pattern: ``github`` and ``npm`` tokens (six base-62 digits of the CRC-32
of the 30 characters before), ``jwt`` (header and payload decode to JSON objects) and
``pem`` (a private-key block with its end line).

Spans are (kind, start, end) in code points, end exclusive.  Defined results: a null
or empty text has no spans; texts are scanned whole, in time that grows with their length; overlapping spans of different
kinds are all reported, redaction merges them; equal rows give equal results.
"""
from __future__ import annotations

import base64
import binascii
import json
import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tablescope.session import ship_package

#: fixed patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
PEM = re.compile(r"-----BEGIN ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY)-----(?:(?!-----)[A-Za-z0-9+/=\s:,-])*-----END \1-----")
#: a run in which, if one jwt place does not match, no later one does: the part must reach the run's end
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("github", "npm", "jwt", "pem")
KINDS = BASE_KINDS + METHOD_KINDS
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("akia",),
            "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "jwt": ("eyj",), "pem": ("-----begin ",)}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
REDACTED = "[SECRET]"


def _crc_digits(body: str) -> str:
    value, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE_62[digit] + out
    return out


def _json_object(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


#: kind -> (anchored expression, what a match must also satisfy)
CHECKS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= MIN_VALUE),
    "access": (ACCESS, lambda m: len(m[0]) >= MIN_ACCESS),
    "github": (GITHUB, lambda m: _crc_digits(m[1]) == m[2]),
    "npm": (NPM, lambda m: _crc_digits(m[1]) == m[2]),
    "jwt": (JWT, lambda m: _json_object(m[1]) and _json_object(m[2])),
    "pem": (PEM, lambda m: True),
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


_IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_STRIDE = MIN_HEX // 2


def hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of maximal runs of at least ``MIN_HEX`` lower-case hexadecimal digits."""
    data = np.frombuffer(raw, np.uint8)
    probe = _IS_HEX[data[::_STRIDE]]
    out, reached = [], 0
    for k in np.flatnonzero(probe[:-1] & probe[1:]).tolist():
        at = k * _STRIDE
        if at < reached:
            continue
        start, end = at, at
        while start > reached and _IS_HEX[data[start - 1]]:
            start -= 1
        while end < len(raw):  # in steps, so that very long runs stay cheap
            stop = np.flatnonzero(~_IS_HEX[data[end:end + 4096]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(raw), end + 4096)
        reached = end
        if end - start >= MIN_HEX:
            out.append((start, end))
    return out


def find_secrets(text: str | None, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans, by start, then by kind as listed."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower()
    folded = lower.decode("utf-8", "surrogatepass") if len(raw) != len(text) else lower.decode("ascii")
    spans, reached = [], dict.fromkeys(CHECKS, 0)
    hits = sorted((last + 1 - size, kind) for last, (kind, size) in words.iter(folded))
    for start, kind in hits:
        if start < reached[kind]:
            continue
        expression, holds = CHECKS[kind]
        match = expression.match(text, start)
        if match:
            reached[kind] = match.end()
            if holds(match):
                spans.append((start, kind, match.end()))
        elif kind == "jwt":
            reached[kind] = JWT_RUN.match(text, start).end()
    for start, end in hex_runs(raw):
        if len(raw) != len(text):
            begin = len(raw[:start].decode("utf-8", "surrogatepass"))
            start, end = begin, begin + end - start
        spans.append((start, "hex", end))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return [(kind, start, end) for start, kind, end in spans]


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = REDACTED) -> str:
    """The text with every merged span replaced."""
    merged: list[list[int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, at = [], 0
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
FOUND = StructType([StructField("spans", ArrayType(SPAN)), StructField("redacted", StringType())])


def scan_secrets(docs: DataFrame, text: str = "text", mark: str = REDACTED) -> DataFrame:
    """``docs`` as the struct column ``row`` with ``spans`` (kind, start, end) and ``redacted``: the
    text without the spans, null where there are none."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        words = automaton()
        found = [find_secrets(t, words) for t in texts]
        return pd.DataFrame({"spans": [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found],
                             "redacted": [redact(t, f, mark) if f else None for t, f in zip(texts, found)]})

    row = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row")
    return docs.select(row, scan(docs[text]).alias("found")).select("row", "found.spans", "found.redacted")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
