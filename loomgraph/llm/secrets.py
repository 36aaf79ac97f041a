"""Secret scan with structural confirmation.

Three plain patterns give the base spans.  The method adds spans: runs that look like base64 or hex,
key blocks and dotted tokens are decoded, and only what parses is reported - a private key's nested
DER lengths, a key file's length-prefixed fields, a signed token's JSON header and encoded parts.  What a
key block calls itself proves nothing.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that the structural part adds.
ADDED_KINDS = ("private_key", "public_key", "ssh_key", "signed_token", "encoded_text")
KINDS = BASE_KINDS + ADDED_KINDS
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}(?:\.[A-Za-z0-9_-]*){0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\\[nrt]|\s)*Proc-Type: 4,ENCRYPTED(?:\\[nrt]|\s)+DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,32}(?=[\s\\]))?([A-Za-z0-9+/=\s\\]{16,}?)-----END \1-----")
#: A part of a dotted token; tokens start at any "eyJ", which is the base64 of {".
PART = re.compile(r"[A-Za-z0-9_-]*")
#: Line breaks in a key block, also as two-character escapes.
PEM_BREAK = re.compile(r"(?:\\[nrt]|[\s\\])+")
#: Usual white space, which isprintable() refuses.
SPACES = str.maketrans("\t\n\r\f", "    ")
#: Fixed value: how the key files of one format begin.
OPENSSH = b"openssh-key-v1\0"
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
HEX_ANY = re.compile(r"[0-9A-Fa-f]{24,}")

JSON = json.JSONDecoder()
FIRST_KEY = re.compile(r'\{"[^"\\\x00-\x1f]*"\s*:')
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The contract's spans: leftmost non-overlapping matches of each pattern, failing ones dropped."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of [0-9a-f]+ is maximal, so runs of 24 or more are the matches that pass
    found += [("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text)]
    return found


def der_kind(data: bytes) -> str | None:
    """What a DER encoding is, if all nested lengths add up: a private or a public key."""

    def items(at: int, end: int, depth: int) -> list | None:
        out = []
        while at < end:
            if at + 2 > end or depth > 8:
                return None
            tag, size = data[at], data[at + 1]
            at += 2
            if size >= 0x80:
                width = size & 0x7F
                if not 0 < width <= 4 or at + width > end:
                    return None
                size = int.from_bytes(data[at : at + width], "big")
                at += width
            if at + size > end:
                return None
            inner = items(at, at + size, depth + 1) if tag & 0x20 else data[at : at + size]
            if inner is None:
                return None
            out.append((tag, inner))
            at += size
        return out

    if len(data) < 16 or data[0] != 0x30:
        return None
    tree = items(0, len(data), 0)
    if not tree or len(tree) != 1 or not isinstance(tree[0][1], list):
        return None
    body = tree[0][1]
    tags = [t for t, _ in body]
    if tags[:1] == [0x02] and len(body[0][1]) == 1:  # a version first: a private key
        return "private_key" if len(tags) >= 9 and set(tags) == {0x02} or tags[1:2] in ([0x04], [0x30]) else None
    if tags in ([0x30, 0x03], [0x30, 0x04]) and body[0][1] and body[0][1][0][0] == 0x06:  # an algorithm first
        return "public_key" if tags[1] == 0x03 else "private_key"  # the latter is encrypted
    return None


def fields_of(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Fields, each after its length in four bytes, and where they end; None if a length leads beyond the data."""
    fields = []
    while at + 4 <= len(data) and (most is None or len(fields) < most):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def ssh_kind(data: bytes) -> str | None:
    """A key file's format: all fields parse, and they fill the data."""
    if data.startswith(OPENSSH):
        head = fields_of(data, len(OPENSSH), 3)  # cipher, key derivation and its options
        if head is None or len(head[0]) < 3 or not re.fullmatch(rb"[a-z0-9@.-]{4,40}", head[0][0]):
            return None
        keys = int.from_bytes(data[head[1] : head[1] + 4], "big")
        body = fields_of(data, head[1] + 4)
        whole = body and body[1] == len(data) and keys >= 1 and len(body[0]) == keys + 1
        return "private_key" if whole and all(ssh_kind(k) == "ssh_key" for k in body[0][:-1]) else None
    found = fields_of(data)
    named = found and found[0] and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}", found[0][0])
    return "ssh_key" if named and found[1] == len(data) and len(found[0]) >= 2 else None


def packet_kind(data: bytes) -> str | None:
    """A secret-key packet at the start: its tag, a length that fits, and a known version."""
    if len(data) < 8 or not data[0] & 0x80:
        return None
    if data[0] & 0x40:
        tag = data[0] & 0x3F
        width, size = (1, data[1]) if data[1] < 192 else (2, (data[1] - 192 << 8) + data[2] + 192) if data[1] < 224 else (5, int.from_bytes(data[2:6], "big"))
    else:
        tag, width = data[0] >> 2 & 0x0F, 1 << (data[0] & 3)
        size = int.from_bytes(data[1 : 1 + width], "big") if width < 8 else 0
    return "private_key" if tag == 5 and 16 <= size <= len(data) - 1 - width and 3 <= data[1 + width] <= 6 else None


def unbase64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def plain_text(data: bytes) -> str | None:
    """Decoded UTF-8 of printable characters and usual white space, or None."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None
    return text if text.translate(SPACES).isprintable() else None


def structure(data: bytes, depth: int = 0) -> str | None:
    """The kind of decoded bytes, or None.  Text that holds a base span counts, and so does text with added spans."""
    kind = der_kind(data) or ssh_kind(data)
    text = None if kind or depth > 1 else plain_text(data)
    if not text:
        return kind
    if ASSIGN.search(text) or ACCESS.search(text):
        return "encoded_text"
    inner = added_spans(text, depth + 1)
    return inner[0][0] if inner else None


class _Run:
    """A run that token headers may begin in: for each alignment it is decoded once."""

    def __init__(self, text: str, end: int):
        self.text, self.end, self.decoded = text, end, {}

    def header(self, at: int) -> dict | None:
        """The JSON object that the characters from ``at`` to the run's end encode."""
        if at % 4 not in self.decoded:
            self.decoded[at % 4] = at, (unbase64(self.text[at : self.end]) or b"").decode("latin-1")
        base, data = self.decoded[at % 4]
        place = (at - base) // 4 * 3
        if not data.endswith("}") or not FIRST_KEY.match(data, place):  # most starts need no parser
            return None
        try:
            found, end = JSON.raw_decode(data, place)
        except (ValueError, RecursionError):
            return None
        return found if isinstance(found, dict) and end == len(data) else None


def token_spans(text: str) -> list[Span]:
    """Signed tokens, wherever they begin in a run of characters.

    Three dotted parts: a JSON header that names an algorithm, then a payload and a signature that decode;
    only a token of no algorithm may have an empty signature.
    """
    found: list[Span] = []
    at, run = text.find("eyJ"), None
    while at >= 0:
        if run is None or at >= run.end:
            run = _Run(text, PART.match(text, at).end())
            parts, end = [], run.end
            while len(parts) < 2 and text[end : end + 1] == ".":
                start, end = end + 1, PART.match(text, end + 1).end()
                parts.append(text[start:end])
            good = len(parts) == 2 and bool(unbase64(parts[0])) and unbase64(parts[1]) is not None
        if not good:
            at = text.find("eyJ", run.end)  # no token begins in this part
            continue
        header = run.header(at)
        if header and isinstance(header.get("alg"), str) and (parts[1] or header["alg"] == "none"):
            found.append(("signed_token", at, end))
            at = text.find("eyJ", end)
        else:
            at = text.find("eyJ", at + 1)
    return found


def added_spans(text: str, depth: int = 0) -> list[Span]:
    """Candidates that decode and parse; ``depth`` counts the encodings that ``text`` was in."""
    found: list[Span] = token_spans(text)
    starts, ends = [a for _, a, _ in found], [b for *_, b in found]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = unbase64(PEM_BREAK.sub("", m[3])) or b""
            if m[2]:  # encrypted as its fields say: whole cipher blocks are all that can be confirmed
                kind = "private_key" if data and len(data) % 8 == 0 else None
            elif m[1].startswith("PGP"):
                kind = packet_kind(unbase64(PEM_BREAK.sub("", m[3].strip()[:-5])) or data)
            else:
                kind = structure(data, depth)
            if kind:
                found.append((kind, m.start(), m.end()))
    for m in ENCODED.finditer(text):
        before = bisect_right(starts, m.start()) - 1
        if before >= 0 and m.start() < ends[before]:
            continue
        first = m[0].split(".")[0]
        data = unbase64(first)
        kind = structure(data, depth) if data else None
        if kind:
            found.append((kind, m.start(), m.start() + len(first)))
    for m in HEX_ANY.finditer(text):
        odd = len(m[0]) % 2
        for a, b in ((m.start(), m.end() - odd), (m.start() + odd, m.end()))[: 1 + odd]:
            kind = structure(bytes.fromhex(text[a:b]), depth)
            if kind:
                found.append((kind, a, b))
                break
    return list(dict.fromkeys(found))


def listed(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            added = added_spans(text)
            rows.append([{"kind": k, "start": a, "stop": b, "base": i < len(base)} for i, (k, a, b) in enumerate(base + added)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): every row's secrets as structs (kind, start, stop, base), whole texts scanned.

    Places are code points, ``stop`` exclusive.  ``base`` tells the plain patterns' spans from those
    that the structural part adds.  A null text is empty, null ids and repeated rows stay, an empty
    table gives an empty result, other columns are ignored.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
