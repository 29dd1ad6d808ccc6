"""Secrets in texts, with structural confirmation of encoded candidates.

Three base kinds are patterns alone: ``assign`` (a named secret with a value),
``access`` (access key ids) and ``hex`` (long hexadecimal runs). Candidates in
base64 or hex are decoded, and reported only if the bytes parse as what they
claim to be: ``key`` is a private key (DER with nested lengths that fit, or the
length-prefixed OpenSSH form), ``signed`` a token whose header and claims are
JSON and whose header names an algorithm.

Defined results: a null text counts as empty and has no spans; spans are in
code points, end exclusive, ordered by start, then kind as in KINDS; spans of
different kinds may overlap; texts of any length are scanned whole; repeated
rows are scanned one by one; a null
doc_id is passed through; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows

KINDS = ("assign", "access", "hex", "key", "signed")
BASE_KINDS = KINDS[:3]
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----([^-]*)-----END \1-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{44,}={0,2}")
# a key's first line where base64 is wrapped, and the lines after it; line ends may be escaped, lines quoted or indented
_LINE_END = r"(?:\\+[rn]|[\r\n])"
_ESCAPED_END = re.compile(r"(?:\\+r)?\\+n|\\+r|\r\n?")
_FIRST_LINE = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\n)|(?<=\\r))(?:M[A-Za-z0-9+/]{15,}|b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]*)(?=[ \t\"',;]*" + _LINE_END + ")")
_NEXT_LINE = re.compile(r"[ \t\"',;]*" + _LINE_END + r"(?:[ \t\"',;>#*]|" + _LINE_END + r")*([A-Za-z0-9+/]+={0,2})")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at ``at``; None if its length doesn't fit before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n]), at + n
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill start to end exactly."""
    found = []
    while start < end:
        if (x := _element(data, start, end)) is None:
            return None
        found.append(x)
        start = x[2]
    return found


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are a private key: OpenSSH, PKCS #1, PKCS #8 (plain or encrypted) or SEC 1."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at, parts = len(magic), 0
        for part in range(6):  # cipher, kdf, its options, number of keys, public part, private part
            if at + 4 > len(data):
                return False
            size = int.from_bytes(data[at : at + 4])
            at += 4 if part == 3 else 4 + size
            parts += at <= len(data)
        return parts == 6 and at == len(data)
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    inside = _children(data, outer[1], outer[2])
    if not inside:
        return False
    tags = [x[0] for x in inside]
    algorithm = lambda x: bool((y := _children(data, x[1], x[2])) and y[0][0] == 0x06)
    if tags == [0x30, 0x04]:
        return algorithm(inside[0])
    if tags[0] != 0x02 or inside[0][2] - inside[0][1] != 1:
        return False
    version = data[inside[0][1]]
    if tags[1:3] == [0x30, 0x04]:
        return version in (0, 1) and algorithm(inside[1])
    if tags[1:2] == [0x04]:
        return version == 1 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return version in (0, 1) and len(tags) in (9, 10) and all(t == 0x02 for t in tags[:9])


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _needed(data: bytes) -> int | None:
    """Bytes of the key that begins with ``data``, as far as its start tells; None if it can't be a key."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at = len(magic)
        for part in range(6):
            if at + 4 > len(data):
                return at + 4
            at += 4 if part == 3 else 4 + int.from_bytes(data[at : at + 4])
        return at
    if len(data) < 6 or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    return None if n > 4 else 2 + n + (int.from_bytes(data[2 : 2 + n]) if n else data[1])


def _wrapped_key(text: str, start: int, end: int) -> int | None:
    """End of the key whose base64 goes on over lines after the line from start to end."""
    lines = [text[start:end]]
    chars, need = end - start, 0
    while need * 4 <= (len(text) - start) * 3 + 4:  # the rest of the text has room for it
        while chars * 3 < need * 4:
            if (m := _NEXT_LINE.match(text, end)) is None:
                return None
            lines.append(m[1])
            end, chars = m.end(), chars + len(m[1].rstrip("="))
        joined = "".join(lines).rstrip("=")
        data = _decoded(joined[: len(joined) // 4 * 4] if not need else joined)
        if data is None or (more := _needed(data)) is None:
            return None
        if len(data) >= more > 0:
            return end if is_private_key(data) else None
        need = more
    return None


def _object(text: str) -> dict | None:
    try:
        found = json.loads(_decoded(text, url=True) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in the text."""
    text = text or ""
    found = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "key")):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    keys: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            body = _ESCAPED_END.sub("\n", m[2])
            body = body.rpartition("\n\n")[2] if ":" in body else body  # headers end at an empty line
            if (data := _decoded(body)) and is_private_key(data):
                keys.append((m.start(), m.end()))
    inside = lambda m: any(a <= m.start() < b for a, b in keys)
    for m in _FIRST_LINE.finditer(text):
        if not inside(m) and (end := _wrapped_key(text, *m.span())):
            keys.append((m.start(), end))
    if any(len(w) >= 44 for w in text.split()):
        for m in _BASE64.finditer(text):
            if not inside(m) and (data := _decoded(m[0])) and is_private_key(data):
                keys.append(m.span())
        for m in _ANY_HEX.finditer(text):
            if not inside(m) and len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
                keys.append(m.span())
    found += [("key", a, b) for a, b in keys]
    if "." in text and ("ey" in text or "ew" in text):
        for m in _SIGNED.finditer(text):
            head = _object(m[1])
            if head and isinstance(head.get("alg"), str) and _object(m[2]) is not None:
                found.append(("signed", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with MASK in place of each run of overlapping spans."""
    if not spans:
        return text
    runs: list[list[int]] = []
    for _, start, end in spans:
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    ends = [0, *(b for _, b in runs)]
    return "".join(text[at:a] + MASK for at, (a, _) in zip(ends, runs)) + text[ends[-1] :]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the array of its spans, for each row."""
    return map_rows(docs.select("doc_id", "text"), f"doc_id bigint, spans {SPANS}", lambda: lambda rows: [(i, [dict(zip(("kind", "start", "end"), s)) for s in find_spans(t)]) for i, t in rows])


def summary(spans: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and the text form of all spans."""
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return spans.select("doc_id", *map(count, BASE_KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else masked(t, find_spans(t))).astype(object)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret masked and n_chars, if there, set anew where a text changed."""
    clean = free_name(docs, "clean")
    out = docs.withColumn(clean, _masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(clean) == F.col("text"), F.col("n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.col(clean)).select(*docs.columns)
