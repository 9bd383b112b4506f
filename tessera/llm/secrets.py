"""Secret scanning with structural confirmation.

Three pattern kinds (assignments, access key ids, long hex runs) are the base.
Further kinds are reported only once their structure is confirmed: base64 or
hex candidates are decoded and must parse as a key encoding (DER with nested
lengths that fill it exactly, or an SSH wire key whose length fields do) or as
a signed token (base64url JSON header that names an algorithm, JSON payload).

Lines of code between PEM markers may be indented and of any length, and their
breaks may be escaped as in JSON. A run of lines may hold several keys; each is
reported.

A byte-level test decides cheaply whether a text can hold a kind at all; only
then its pattern runs. Everything is per row: no shuffle, whole texts. Runs of
code are decoded once per alignment, and a place is parsed only if its first
bytes nest like a key's, so time stays in proportion to the text.

Defined cases: null and empty texts have no span, an empty table gives no row;
positions count code points, end exclusive; texts of any length are read whole;
rows come back once each, also repeated ones; `redact` passes all columns on.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_mask

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: The order of kinds that start at one place.
KINDS = ("assign", "access", "hex", "signed_token", "private_key", "public_key", "certificate")

#: Shortest header of a token: {"alg":""} in base64url.
HEADER = 14
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:\s|\\[nr])*+(?:[A-Za-z0-9-]+:[^\n]*+\n\s*+)*+((?:[A-Za-z0-9+/\s]|\\[nr])++={0,2})(?:\s|\\[nr])*+-----END ")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{4,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*={0,2}")
ANYHEX = re.compile(r"(?:[0-9a-fA-F]{2}){24,}")
#: Shortest run of base64 or hex characters worth decoding, line breaks included.
RUN = 48
#: Values that a key or certificate may consist of, all levels together.
MAX_VALUES = 10_000

_HEX_RUN = byte_mask("0123456789abcdef")
_CODE_RUN = byte_mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_LINES_RUN = _CODE_RUN | byte_mask("\r\n")


def _table(mask: np.ndarray) -> bytes:
    return bytes(np.where(mask, ord("1"), ord("0")).astype(np.uint8))


_HEX_TABLE, _CODE_TABLE, _LINES_TABLE = _table(_HEX_RUN), _table(_CODE_RUN), _table(_LINES_RUN)

# Fixed values of the DER and SSH formats: object identifiers of key types, and wire names.
KEY_OIDS = {
    "2a864886f70d010101": "RSA",
    "2a8648ce3d0201": "EC",
    "2b6570": "Ed25519",
    "2b656e": "X25519",
    "2a8648ce380401": "DSA",
}
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH = b"openssh-key-v1\0"


def _head(data, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at a place, if its length is in the shortest form and fits."""
    if end - at < 2:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80 or n > 1 and size >> 8 * (n - 1) == 0:
            return None
    return (tag, at, at + size) if at + size <= end else None


def der(data, at: int = 0, end: int | None = None, depth: int = 0, left: list[int] | None = None) -> list | None:
    """[(tag, content or children)] if data[at:end] is whole DER values, else None."""
    end = len(data) if end is None else end
    left = [MAX_VALUES] if left is None else left
    out = []
    while at < end:
        left[0] -= 1
        head = _head(data, at, end) if depth <= 24 and left[0] >= 0 else None
        if head is None:
            return None
        tag, start, at = head
        if tag & 0x20:
            inner = der(data, start, at, depth + 1, left)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, bytes(data[start:at])))
    return out


def _nests(data) -> int | None:
    """Size of the DER sequence that the bytes begin, if its first value is a number or a sequence that fits as in a key."""
    n = len(data)
    if n < 16 or data[0] != 0x30 or not (outer := _head(data, 0, 1 << 40)):
        return None
    _, at, end = outer
    inner = _head(data, at, end) if at + 6 <= n else None
    if inner is None or inner[0] not in (0x02, 0x30) or inner[0] == 0x02 and inner[2] - inner[1] < 1:
        return None
    if inner[0] == 0x02 and inner[2] - inner[1] == 1:  # the version, and what follows it
        ahead = _head(data, inner[2], end) if inner[2] + 6 <= n else None
        return end if ahead and ahead[0] in (0x02, 0x04, 0x30) else None
    if inner[0] == 0x30:
        ahead = _head(data, inner[1], inner[2]) if inner[1] + 6 <= n else None
        return end if ahead and ahead[0] in (0x02, 0x06, 0xA0) else None
    return end if inner[2] - inner[1] >= 64 else None


def der_kind(data: bytes) -> str | None:
    """private_key, public_key or certificate, by the nested structure."""
    if len(data) < 16 or data[0] != 0x30:
        return None
    top = der(data)
    if not top or len(top) != 1:
        return None
    body = top[0][1]
    tags = [t for t, _ in body]
    named = lambda x: isinstance(x, list) and x and x[0][0] == 0x06 and x[0][1].hex() in KEY_OIDS
    if tags[:1] == [0x02] and len(body[0][1]) == 1:
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return "private_key"  # the nine integers of an RSA key
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and named(body[1][1]):
            return "private_key"  # version, algorithm, octets
        if len(tags) >= 2 and tags[1] == 0x04 and body[0][1] == b"\1" and len(body[1][1]) in (28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return "private_key"  # an elliptic-curve key
        if len(tags) == 6 and set(tags) == {0x02}:
            return "private_key"  # the six integers of a DSA key
    if tags == [0x30, 0x03] and named(body[0][1]) and body[1][1][:1] == b"\0":
        return "public_key"
    if tags == [0x02, 0x02] and len(body[0][1]) >= 64 and 1 <= len(body[1][1]) <= 8:
        return "public_key"
    if tags == [0x30, 0x30, 0x03] and len(body[0][1]) >= 6:
        return "certificate"
    return None


def ssh_kind(data: bytes) -> str | None:
    if data.startswith(OPENSSH):
        fields, at = 0, len(OPENSSH)
        while fields < 3 and at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            fields += 1
        return "private_key" if fields == 3 and at + 4 <= len(data) else None
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return "public_key" if at == len(data) and len(fields) >= 2 and fields[0] in SSH_NAMES else None


def decoded(code: str) -> bytes | None:
    code = re.sub(r"\\[nr]|\s", "", code).rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(code) % 4 == 1:
        return None
    try:
        return base64.b64decode(code + "=" * (-len(code) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def token_ok(code: str) -> bool:
    """A signed token: JSON header that names an algorithm, JSON object as payload, a signature unless none is used."""
    head, body, mark = code.split(".")
    try:
        header, payload = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict) and (bool(mark) and decoded(mark) is not None or header["alg"].lower() == "none")


def base_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """The three pattern kinds; positions in code points."""
    out = []
    if b":" in raw or b"=" in raw:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if raw.translate(_HEX_TABLE).find(b"1" * MIN_HEX) >= 0:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return out


def confirmed_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """Spans of the structural kinds."""
    out = []
    code = raw.translate(_CODE_TABLE)
    if b"." in raw and code.find(b"1" * HEADER) >= 0:
        at = 0
        while m := TOKEN.search(text, at):
            if token_ok(m[0]):
                out.append(("signed_token", m.start(), m.end()))
                at = m.end()
            else:
                at = m.end(1) + 1  # the second part may be a header
    if b"-----BEGIN " in raw:
        for m in PEM.finditer(text):
            data = decoded(m[1])
            if data and (kind := der_kind(data) or ssh_kind(data)):
                out.append((kind, m.start(1), m.start(1) + len(m[1].rstrip())))
    if raw.translate(_LINES_TABLE).find(b"1" * RUN) < 0:
        return out
    found = set(out)
    for m in ANYHEX.finditer(text):
        data = bytes.fromhex(m[0])
        if kind := der_kind(data) or ssh_kind(data):
            found.add((kind, m.start(), m.end()))
    for m in BASE64.finditer(text):
        if m.end() - m.start() < RUN:
            continue
        # A run of lines may begin or end with plain words: any first and last line may bound the code.
        lines = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer(r"\S+", m[0])]
        found.update(_keys_of_lines(text, lines))
    return list(found)


class _Code:
    """A run of base64 lines as one string, decoded once for each of its four alignments."""

    def __init__(self, code: str):
        self.code = code.translate(str.maketrans("-_", "+/"))
        self.phases: dict[int, bytes] = {}

    def bytes_at(self, at: int, size: int) -> memoryview:
        """The bytes that the code from a place on decodes to, as far as there are so many."""
        phase = at % 4
        if phase not in self.phases:
            whole = self.code[phase:].rstrip("=")
            whole = whole[: len(whole) - (len(whole) % 4 == 1)]
            self.phases[phase] = base64.b64decode(whole + "=" * (-len(whole) % 4))
        start = (at - phase) // 4 * 3
        return memoryview(self.phases[phase])[start : start + size]


def _ssh_size(code: _Code, at: int) -> int | None:
    """Bytes of the SSH key whose code begins at a place, by its length fields."""

    def number(where: int) -> int | None:
        data = code.bytes_at(at, where + 4)[where:]
        return int.from_bytes(data, "big") if len(data) == 4 else None

    head = bytes(code.bytes_at(at, 30))
    if head.startswith(OPENSSH):
        where, kinds, keys = len(OPENSSH), "fff#", None
    elif name := next((x for x in SSH_NAMES if head.startswith(len(x).to_bytes(4, "big") + x)), None):
        where, kinds, keys = 0, "f" * (5 if name == b"ssh-dss" else 2 if name == b"ssh-ed25519" else 3), 0
    else:
        return None
    for kind in kinds:
        if (size := number(where)) is None:
            return None
        where += 4 + (size if kind == "f" else 0)
        keys = size if kind == "#" else keys
    if head.startswith(OPENSSH):
        for _ in range(keys + 1):  # public keys, and the private part
            if (size := number(where)) is None:
                return None
            where += 4 + size
    return where


def _keys_of_lines(text: str, lines: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The keys that runs of the lines decode to; a key's length fields say where it must end."""
    code = _Code("".join(text[a:b] for a, b in lines))
    first = [0]
    for a, b in lines:
        first.append(first[-1] + b - a)
    out, i = [], 0
    while i < len(lines):
        head = code.bytes_at(first[i], 24)
        need = _nests(head) if head[:1] == b"\x30" else _ssh_size(code, first[i])
        if need:
            j = bisect_left(first, first[i] + -(-need * 4 // 3))
            # Padding may follow the key's last character on its line.
            if j < len(first) and (pad := first[j] - first[i] - -(-need * 4 // 3)) <= 2 and code.code[first[j] - pad : first[j]] in ("", "=", "=="):
                data = code.bytes_at(first[i], need)
                if len(data) == need and (kind := der_kind(data) or ssh_kind(bytes(data))):
                    out.append((kind, lines[i][0], lines[j - 1][1]))
                    i = j - 1
        elif bytes(head).startswith(OPENSSH) and ssh_kind(bytes(code.bytes_at(first[i], 4096))):
            out.append(("private_key", lines[i][0], lines[-1][1]))  # a cut key, up to the end of the run
            break
        i += 1
    return out


_ORDER = {k: i for i, k in enumerate(KINDS)}


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start and then by kind."""
    raw = text.encode("utf-8", "surrogatepass")
    key = lambda x: (x[1], _ORDER[x[0]])
    base = sorted(base_spans(text, raw), key=key)
    return base, sorted(base + confirmed_spans(text, raw), key=key)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, every = [], []
        for value in batch.column(batch.num_columns - 1):
            a, b = spans_of(value.as_py() or "")
            base.append(a)
            every.append(b)
        count = lambda kind: pa.array([sum(k == kind for k, _, _ in x) for x in base], pa.int64())
        shas = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*columns, count("assign"), count("access"), count("hex"), pa.array(shas), pa.array([joined(x) for x in every])],
            names=[*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    df = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(_scan, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by the mask; all columns come back.

    Overlapping spans are one; the rest of the text and null texts stay as they are.
    """
    names = docs.columns
    at = names.index("text")
    inner = docs.select(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") if i == at else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = batch.column(at).to_pylist(), False
            for i, text in enumerate(texts):
                if text and (spans := spans_of(text)[1]):
                    texts[i], changed = masked(text, spans, mask), True
            columns = [pa.array(texts, pa.string()) if j == at and changed else batch.column(j) for j in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = inner.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, end in sorted((a, b) for _, a, b in spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
