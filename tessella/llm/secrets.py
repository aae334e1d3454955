"""Secret scan with structural confirmation.

Candidates are maximal runs of token characters that look encoded, such runs
joined over line breaks where one begins a key, PEM blocks (also with escaped
line breaks, quotes or marks of comments) and assignments of hex strings. A
candidate is reported only after its content has been decoded and parsed: ASN.1 key encodings and OpenSSH blobs whose nested
lengths must close exactly, signed-token headers that must be JSON with an
algorithm, key identifiers whose alphabet and checksum must agree, and hex
strings that decode to the length and the spread of bytes of a raw key.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textvec as tv

RESULT = "doc_id bigint, kind string, detail string, start bigint, length int, digest string"
MIN_RUN = 16

_TOKEN = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-.":
    _TOKEN[_c] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----(.*?)-----END \1-----", re.S)
#: What may end the name of a credential.
_NAMES = re.compile(rb"(?:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|private[_-]?key)$", re.I)
_HEX = re.compile(rb"[0-9a-fA-F]{16,}")
_JWT = re.compile(rb"([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_ACCESS_ID = re.compile(rb"(?<![A-Z0-9])(AKIA|ASIA)([A-Z2-7]{16})(?![A-Z0-9])")
_CHECKED = re.compile(rb"(?<![A-Za-z0-9])(gh[pousr])_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{32,}={0,2}")
_BASE64_PIECE = re.compile(rb"[A-Za-z0-9+/_-]+={0,2}")
_HEX_PIECE = re.compile(rb"[0-9a-fA-F]+")
#: Between two lines of wrapped data: a real or an escaped line break, with the marks of string literals, continuations, quotes and comments.
_BREAK = re.compile(rb"[\"'`]?[ \t]*[+.,]?[ \t]*(?:(?:\\+r)?\\+n|\\+r|\\?\r?\n)(?:[\"'`]?[ \t]*[+.,]?[ \t]*\\?\r?\n)?[ \t>|#*]*(?:[+.][ \t]*(?=[\"'`])|//[ \t]+)?[\"'`]?")
#: The beginning of a private key in DER: a sequence (group 1 ends its length) that begins with a version or another sequence.
_DER_KEY = re.compile(rb"(\x30(?:[\x00-\x7f]|\x81.|\x82..|\x83...|\x84....))(?:\x02\x01[\x00\x01]|\x30)", re.S)
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CURVES = {bytes.fromhex("2a8648ce3d030107"): "P-256", bytes.fromhex("2b81040022"): "P-384", bytes.fromhex("2b81040023"): "P-521", bytes.fromhex("2b8104000a"): "secp256k1"}
_KEY_TYPES = {bytes.fromhex("2a864886f70d010101"): "RSA", bytes.fromhex("2a8648ce3d0201"): "EC", bytes.fromhex("2b6570"): "Ed25519", bytes.fromhex("2b656e"): "X25519", bytes.fromhex("2a8648ce380401"): "DSA"}


def b64decode(data: bytes) -> bytes | None:
    """Standard or URL-safe base64 with or without padding; None if it isn't."""
    data = re.sub(rb"\s+", b"", data).rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(data) % 4 == 1:
        return None
    try:
        return base64.b64decode(data + b"=" * (-len(data) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes) -> list[tuple[int, bytes]] | None:
    """The top-level (tag, value) elements, if definite lengths fill data exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80:
                return None
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def private_key(data: bytes) -> str | None:
    """The kind of private key that data encodes in DER, every nested length checked."""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or (parts := der(top[0][1])) is None:
        return None
    tags = [t for t, _ in parts]
    if len(parts) >= 9 and tags[:9] == [2] * 9 and parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 64:
        return "PKCS#1 RSA"
    if len(parts) >= 6 and tags[:6] == [2] * 6 and parts[0][1] == b"\0" and len(parts[1][1]) >= 64:
        return "DSA"
    if tags[:2] == [2, 4] and parts[0][1] == b"\1" and len(parts[1][1]) in (28, 32, 48, 66):
        for tag, value in parts[2:]:
            if tag == 0xA0 and (oid := der(value)) and oid[0][0] == 6:
                return f"SEC1 EC {_CURVES.get(oid[0][1], 'other curve')}"
        return "SEC1 EC"
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1"):
        algorithm = der(parts[1][1])
        if not algorithm or algorithm[0][0] != 6:
            return None
        kind = _KEY_TYPES.get(algorithm[0][1])
        inner = der(parts[2][1])
        if kind in ("RSA", "EC") and private_key(parts[2][1]) is None:
            return None
        return f"PKCS#8 {kind}" if kind and inner is not None else None
    if tags[:2] == [0x30, 4] and (algorithm := der(parts[0][1])) and algorithm[0] == (6, bytes.fromhex("2a864886f70d01050d")):
        return "PKCS#8 encrypted"
    return None


def openssh_key(data: bytes) -> str | None:
    """The key type of an OpenSSH private key blob whose length-prefixed fields close exactly."""
    if not data.startswith(b"openssh-key-v1\0"):
        return None
    at, fields = 15, []

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    for _ in range(3):
        if (field := take()) is None:
            return None
        fields.append(field)
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 64:
        return None
    public = [take() for _ in range(count)]
    if None in public or take() is None or at != len(data):
        return None
    n = int.from_bytes(public[0][:4], "big")
    name = public[0][4 : 4 + n]
    return f"OpenSSH {name.decode()}" if name.isascii() and 4 + n <= len(public[0]) and re.fullmatch(rb"[a-z0-9@.-]+", name) else None


def signed_token(head: bytes, body: bytes, signature: bytes) -> str | None:
    """The algorithm of a JSON web token with a parsable header and body and a signature of the right length."""
    try:
        header = json.loads(b64decode(head) or b"")
        claims = json.loads(b64decode(body) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return None
    raw, alg = b64decode(signature) if signature else b"", header["alg"]
    sizes = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
    if raw is None or (alg in sizes and len(raw) not in sizes[alg]) or (alg[:2] in ("RS", "PS") and len(raw) < 128) or (alg != "none" and not raw):
        return None
    return alg


def assigned(text: bytes, at: int) -> bool:
    """Whether the value at `at` is given to a credential: name, quote, = or : or := or => or a blank, "bearer", quote, with any blanks between."""

    def back(at: int, marks: bytes) -> int:
        while at and text[at - 1] in marks:
            at -= 1
        return at

    blank, quote = b" \t\r\n\f\v", b"\"'`"
    at -= at > 0 and text[at - 1] in quote
    end = back(at, blank)
    if end < at and text[max(0, end - 6) : end].lower() == b"bearer":
        at = end - 6
        end = back(at, blank)
    sign = 2 if text[max(0, end - 2) : end] in (b":=", b"=>") else 1 if text[max(0, end - 1) : end] in (b"=", b":") else 0
    if not sign and end == at:
        return False
    at = back(end - sign, blank)
    at -= at > 0 and text[at - 1] in b"\"'"
    return _NAMES.search(text[max(0, at - 16) : at]) is not None  # the longest name has 13 bytes


def raw_key(digits: bytes) -> str | None:
    """Whether an even run of hex digits decodes to bytes as spread as a random key's: at least 8 bytes, most of them distinct, not all ASCII text, no arithmetic run."""
    if len(digits) % 2 or (digits.upper() != digits and digits.lower() != digits):
        return None
    data = bytes.fromhex(digits.decode())
    steps = {(b - a) & 255 for a, b in zip(data, data[1:])}
    if len(data) < 8 or len(set(data)) < 0.6 * min(len(data), 64) or len(steps) < 3 or all(32 <= b < 127 for b in data):
        return None
    return f"hex {len(data)} bytes"


def unwrap(body: bytes) -> bytes:
    """A PEM body from a string literal, a quote or a comment: escapes undone, marks at both ends of a line taken off."""
    body = re.sub(rb"\\+u00([0-7][0-9a-fA-F])", lambda m: bytes.fromhex(m[1].decode()), body)
    body = re.sub(rb"(?:\\+r)?\\+n|\\+r|\r\n?", b"\n", body)
    lines = re.sub(rb"\\+t", b" ", body).replace(b"\\", b"").split(b"\n")
    full = [x for x in lines if x.strip()]
    if full and all(x[:1] == full[0][:1] for x in full) and full[0][:1] in (b"+", b"-"):  # a diff
        lines = [x[1:] for x in lines]
    lines = [re.sub(rb"^[\s>|#*;,\"'`]*(?:[+.]\s*(?=[\"'`])|(?://|--)\s+)?[\s\"'`]*|(?:[\"'`]\s*[+.]?)?[\s,;&)]*$", b"", x) for x in lines]
    return b"\n".join(lines)


def _size(data: bytes) -> int | None:
    """The length of the key that data begins with, by its outer lengths; None if data is too short or begins no key."""
    if data.startswith(b"openssh-key-v1\0"):
        at, left = 15, 3
        while left:
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            left -= 1
        count = int.from_bytes(data[at : at + 4], "big")
        at += 4
        for _ in range(count + 1 if count <= 64 else 0):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at if at <= len(data) else None
    if not (m := _DER_KEY.match(data)):
        return None
    return m.end(1) + int.from_bytes(data[2 : m.end(1)], "big") if data[1] & 0x80 else 2 + data[1]


def wrapped(text: bytes, start: int, hexadecimal: bool) -> tuple[str, int] | None:
    """The key type and the end of a private key in base64 or hex that begins at start and goes on over line breaks."""
    piece, step = (_HEX_PIECE, 2) if hexadecimal else (_BASE64_PIECE, 4)

    def decoded(data: bytes) -> bytes:
        data = data[: len(data) // step * step]
        return (bytes.fromhex(data.decode()) if hexadecimal else b64decode(data)) or b""

    m = piece.match(text, start)
    head = decoded(m[0][:64])
    ssh = head.startswith(b"openssh-key-v1\0")
    if not ssh and not _DER_KEY.match(head):
        return None
    need = None if ssh else _size(head)
    chars = lambda n: 2 * n if hexadecimal else -(-n * 4 // 3)
    lines, have = [m], len(m[0].rstrip(b"="))
    while (need is None or have < chars(need)) and (gap := _BREAK.match(text, lines[-1].end())) and (m := piece.match(text, gap.end())):
        lines.append(m)
        have += len(m[0].rstrip(b"="))
    if ssh and (need := _size(decoded(b"".join(m[0].rstrip(b"=") for m in lines)))) is None:
        return None
    body, have = [], 0
    for m in lines:
        body.append(m[0])
        have += len(m[0].rstrip(b"="))
        if have >= chars(need):
            break
    if have != chars(need):
        return None
    data = bytes.fromhex(b"".join(body).decode()) if hexadecimal else b64decode(b"".join(body))
    kind = data and (private_key(data) or openssh_key(data))
    return (kind, m.end()) if kind else None


def scan(text: bytes, at: np.ndarray | None = None) -> list[tuple[str, str, int, int]]:
    """(kind, detail, start, length) of all confirmed secrets of one text, in byte positions; at: (start, end) of the runs to look at."""
    found: list[tuple[str, str, int, int]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, detail: str, start: int, end: int) -> None:
        if not any(a < end and start < b for a, b in taken):
            taken.append((start, end))
            found.append((kind, detail, start, end - start))

    if b"PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            body = m[2].split(b"\n\n")[-1] if b":" in m[2] else m[2]
            data = b64decode(body)
            if data is None:
                body = unwrap(m[2])
                data = b64decode(body.split(b"\n\n")[-1] if b":" in body else body)
            if data and (kind := private_key(data) or openssh_key(data)):
                add("private_key", kind, *m.span())
            elif data and b"ENCRYPTED" in m[2] and len(data) % 8 == 0:
                add("private_key", "PEM encrypted", *m.span())
    for start, end in runs(text) if at is None else at.tolist():
        if text[start - 1 : start] == b"\\" and text[start] in b"nrt":  # of an escaped line break
            start += 1
        run = text[start:end]
        for m in _ACCESS_ID.finditer(run):
            add("access_key_id", f"{m[1].decode()} {int.from_bytes(base64.b32decode(m[2]), 'big') >> 39 & (1 << 40) - 1}", start + m.start(), start + m.end())
        for m in _CHECKED.finditer(run):
            crc, code = zlib.crc32(m[2]), ""
            for _ in range(6):
                crc, r = divmod(crc, 62)
                code = _BASE62[r] + code
            if code.encode() == m[3]:
                add("checksummed_token", m[1].decode(), start + m.start(), start + m.end())
        for m in _JWT.finditer(run):
            if alg := signed_token(*m.groups()):
                add("signed_token", alg, start + m.start(), start + m.end())
        for m in _HEX.finditer(run):
            if m.start() and run[m.start() - 1 : m.start()].isalnum() or run[m.end() : m.end() + 1].isalnum():
                continue
            data = bytes.fromhex(m[0].decode()) if len(m[0]) % 2 == 0 else b""
            if data and (kind := private_key(data) or openssh_key(data)):
                add("private_key", f"hex {kind}", start + m.start(), start + m.end())
            elif start + m.end() == end and (more := wrapped(text, start + m.start(), True)):
                add("private_key", f"hex {more[0]}", start + m.start(), more[1])
            elif assigned(text, start + m.start()) and (kind := raw_key(m[0])):
                add("assigned_key", kind, start + m.start(), start + m.end())
        for m in _BASE64.finditer(run):
            data = b64decode(m[0])
            if data and (kind := private_key(data) or openssh_key(data)):
                add("private_key", f"base64 {kind}", start + m.start(), start + m.end())
            elif start + m.end() == end and (more := wrapped(text, start + m.start(), False)):
                add("private_key", f"base64 {more[0]}", start + m.start(), more[1])
    return found


def _runs(buf: np.ndarray, off: np.ndarray | None = None) -> np.ndarray:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _TOKEN[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if off is not None and len(off) > 2:  # a run may not cross from one row to the next
        cuts = off[1:-1]
        crossing = cuts[(cuts < len(buf))]
        crossing = crossing[(inside[crossing] == 1) & (inside[crossing + 1] == 1)]
        starts, ends = np.sort(np.concatenate([starts, np.unique(crossing)])), np.sort(np.concatenate([ends, np.unique(crossing)]))
    long = ends - starts >= MIN_RUN
    starts, ends = starts[long], ends[long]
    if len(starts) == 0:
        return np.zeros((0, 2), np.int64)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf], dtype=np.int64)])
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf], dtype=np.int64)])
    # Encoded bytes have a digit, or two capitals; ordinary long words have neither.
    likely = (digits[ends] > digits[starts]) | (upper[ends] - upper[starts] >= 2)
    return np.column_stack([starts[likely], ends[likely]])


def runs(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of at least MIN_RUN token characters that may be encoded data."""
    return [tuple(r) for r in _runs(np.frombuffer(text, np.uint8)).tolist()]


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        texts = tv.as_array(batch.column(1))
        rows, kinds, details, starts, sizes, digests = [], [], [], [], [], []
        for first, stop in tv.row_chunks(texts):
            buf, off = tv.buffers(texts.slice(first, stop - first))
            spans = _runs(buf, off)
            # PEM headers hold no long run of their own when the body is in short lines; their dashes do.
            owner = np.searchsorted(off, spans[:, 0], "right") - 1 if len(spans) else np.zeros(0, np.int64)
            data = buf.tobytes()
            pem = {int(np.searchsorted(off, m.start(), "right")) - 1 for m in re.finditer(rb"PRIVATE KEY-----", data)}
            for r in sorted(pem | set(owner.tolist())):
                mine = spans[owner == r] if len(owner) < 64 else spans[np.searchsorted(owner, r, "left") : np.searchsorted(owner, r, "right")]
                text = data[off[r] : off[r + 1]]
                for kind, detail, at, size in scan(text, mine - off[r]):
                    rows.append(r + first)
                    kinds.append(kind)
                    details.append(detail)
                    starts.append(at)
                    sizes.append(size)
                    digests.append(hashlib.sha256(text[at : at + size]).hexdigest()[:16])
        if rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(kinds), pa.array(details), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests)],
                names=["doc_id", "kind", "detail", "start", "length", "digest"],
            )


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per confirmed secret: RESULT.

    start and length count UTF-8 bytes of the text; digest is the beginning of the
    secret's SHA-256, so reports never hold the secret itself. Kinds:
    private_key (PEM, base64 or hex around a DER or OpenSSH key whose nested
    lengths close), signed_token, access_key_id (detail: the account number its
    base32 part encodes), checksummed_token, and assigned_key (a hex string of
    random-looking bytes assigned to a credential's name). Candidates that don't
    parse are not reported. Null and empty texts give no row, null ids stay null,
    repeated rows report each, other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan_batches, RESULT)
