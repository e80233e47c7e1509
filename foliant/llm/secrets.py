"""Secret scan with structural confirmation.

Base kinds are found by pattern: ``assign``, ``access``, ``hex``. Then base64 and hexadecimal candidates are decoded and looked into before they
are reported:

* ``pem``: an armoured block, with or without header lines, whose body decodes to DER with nested lengths that fit, or to a private OpenSSH container;
* ``der``: a run of base64 or hexadecimal that decodes to a DER sequence whose nested lengths fill it;
* ``ssh``: a run that decodes to length-prefixed strings of which the first names a key type;
* ``jwt``: three dotted base64url parts of which the first is a JSON object with ``alg``, and the second a JSON object;
* ``enc``: a run that decodes to printable ASCII in which a base kind is found, at once or after decoding what is found inside, up to ``DEPTH`` layers.

Candidates are the longest runs of the standard or the URL-safe alphabet of ``LEAST_RUN`` characters or more: what decodes to fewer than 12 bytes can hold no
base kind (the shortest, ``token=`` and six characters, has 12) and no DER key. Base64 that is wrapped over lines without armour is joined where every line but
the last has the same length of 64 or 76 characters; the last may be as long, or be left out.

Spans are code points, end exclusive. Defined results: null and empty texts have no spans; repeated rows give a row each; an empty
table none. Spans that begin together are ordered by kind, then end. Other columns, whatever their names, are ignored. Whole texts are read whatever their length, in time that grows with it: every pattern begins
where its run begins and takes a run once.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, map_rows, texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "der", "ssh", "jwt", "enc")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters at least: a longest run fails or passes as a whole
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a candidate, at least.
LEAST_RUN = 16
#: Layers of encoding that are looked into.
DEPTH = 3
#: Longest runs of either alphabet; those with characters of both are neither's.
BASE64_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}")
STANDARD_RUN = re.compile(rf"[A-Za-z0-9+/]{{{LEAST_RUN},}}={{0,2}}")
HEX_RUN = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{{2 * LEAST_RUN - 8},}}")
#: Three dotted parts; a run of the alphabet is entered at its start alone.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
BEGIN, END = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,64})-----"), "-----END {}-----"
HEADER = re.compile(r"(?m)^[A-Za-z-]{1,64}: .*$")
#: A line that is full at one of the widths, and what may follow a run of such lines.
FULL_LINE = re.compile(r"(?m)^(?:[A-Za-z0-9+/]{76}|[A-Za-z0-9+/]{64})(?=\r?$)")
TAIL = re.compile(r"\r?\n([A-Za-z0-9+/]{1,76}={0,2})")
PRINTABLE = re.compile(rb"[\t\n\r -~]{12,}\Z")
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH = b"openssh-key-v1\0"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    low += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return low + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Where the contents at a length byte begin, and how long they are."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 128:
        return at + 1, first
    n = first & 127
    if not 1 <= n <= 4 or at + 1 + n > len(data) or data[at + 1] == 0:
        return None
    return at + 1 + n, int.from_bytes(data[at + 1 : at + 1 + n], "big")


def is_der(data: bytes) -> bool:
    """One sequence that fills the data, whose members fill it, down to the nested sequences."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    todo = [(0, len(data), True)]
    seen = 0
    while todo:
        at, end, alone = todo.pop()
        members = 0
        while at < end:
            tag = data[at]
            if tag & 0x1F == 0x1F or tag == 0 or not (found := der_length(data, at + 1)):
                return False
            body, size = found
            if body + size > end or tag == 2 and not size:
                return False
            if tag & 0x20:
                todo.append((body, body + size, False))
            at, members, seen = body + size, members + 1, seen + 1
        if alone and members != 1:
            return False
    return seen >= 3


def is_ssh(data: bytes) -> bool:
    """Length-prefixed strings to the end, the first a key type; or the private container."""
    if data.startswith(OPENSSH):
        return len(data) > len(OPENSSH) + 16
    at, parts = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(parts) >= 2 and parts[0] in SSH_TYPES


def unbase64(run: str, url: bool = False) -> bytes | None:
    run = run.rstrip("=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode((run.translate({45: 43, 95: 47}) if url else run) + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def json_object(data: bytes | None) -> dict | None:
    try:
        x = json.loads(data or b"")
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def decoded_kind(data: bytes | None, depth: int = DEPTH) -> str | None:
    if not data:
        return None
    if is_der(data):
        return "der"
    if is_ssh(data):
        return "ssh"
    if PRINTABLE.match(data):
        text = data.decode("ascii")
        if base_spans(text) or depth > 1 and confirmed_spans(text, depth - 1):
            return "enc"
    return None


def run_kind(run: str, depth: int) -> str | None:
    """Of a run in either alphabet."""
    url = "-" in run or "_" in run
    if url and ("+" in run or "/" in run):
        return None
    return decoded_kind(unbase64(run, url), depth)


def armoured(text: str) -> list[tuple[int, int, str]]:
    """Blocks whose bodies confirm. A block begins at the last BEGIN before its END, so that every part of the text is read once."""
    out, begins = [], list(BEGIN.finditer(text))
    for m, stop in zip(begins, [m.start() for m in begins[1:]] + [len(text)]):
        end = text.find(close := END.format(m[1]), m.end(), stop)
        if end < 0:
            continue
        body = HEADER.sub("", text[m.end() : end].replace("\\r", "\r").replace("\\n", "\n"))
        data = unbase64("".join(body.split()))
        if data and (is_der(data) or is_ssh(data)):
            out.append((m.start(), end + len(close), "pem"))
    return out


def wrapped(text: str) -> Iterator[tuple[int, list[int]]]:
    """Runs of full lines of one width: where each starts, and where it may end, with the shorter line after it first. Every line is read once."""
    start = end = width = 0
    for m in chain(FULL_LINE.finditer(text), (None,)):
        if m and width == m.end() - m.start() and text[end : m.start()] in ("\n", "\r\n"):
            end = m.end()
            continue
        if width:
            tail = TAIL.match(text, end)
            yield start, [tail.end(), end] if tail and len(tail[1]) <= width else [end]
        if m:
            start, end = m.span()
            width = end - start


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, int, str]]:
    out = armoured(text) if "-----BEGIN " in text else []
    if "eyJ" in text:
        for m in JWT.finditer(text):
            h = json_object(unbase64(m[1], True))
            if h and isinstance(h.get("alg"), str) and json_object(unbase64(m[2], True)) is not None:
                out.append((m.start(), m.end(), "jwt"))
    for m in BASE64_RUN.finditer(text):
        if kind := run_kind(m[0], depth):
            out.append((m.start(), m.end(), kind))
        elif "-" in m[0] or "_" in m[0]:  # hyphens and underscores may stand around a run of the standard alphabet
            out += [(m.start() + p.start(), m.start() + p.end(), kind) for p in STANDARD_RUN.finditer(m[0]) if (kind := run_kind(p[0], depth))]
    for m in HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := decoded_kind(bytes.fromhex(m[0]), depth)):
            out.append((m.start(), m.end(), kind))
    if "\n" in text:
        for start, ends in wrapped(text):
            for end in ends:
                if kind := decoded_kind(unbase64("".join(text[start:end].split())), depth):
                    out.append((start, end, kind))
                    break
    return out


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind in the order of KINDS, then end."""
    return sorted(set(base_spans(text) + confirmed_spans(text)), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end)."""

    def start():
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t)] for t in texts(batch)]
            return pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(found, pa.list_(span))})

        return step

    return map_rows(doc_rows(docs), start, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
