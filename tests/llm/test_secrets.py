from __future__ import annotations

import base64
import json
import random
import zlib

import pytest

from tessella.llm import secrets
from tests.llm import data

RNG = random.Random(8)
BYTES = lambda n: RNG.randbytes(n)


def tlv(tag: int, value: bytes) -> bytes:
    n = len(value)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + value


def rsa() -> bytes:
    return tlv(0x30, tlv(2, b"\0") + tlv(2, b"\0" + BYTES(128)) + tlv(2, b"\1\0\1") + b"".join(tlv(2, b"\1" + BYTES(63)) for _ in range(6)))


def pkcs8() -> bytes:
    return tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")) + b"\5\0") + tlv(4, rsa()))


def sec1() -> bytes:
    return tlv(0x30, tlv(2, b"\1") + tlv(4, BYTES(32)) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))))


def openssh() -> bytes:
    s = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(s(b"ssh-ed25519") + s(BYTES(32))) + s(BYTES(120))


def pem(label: str, body: bytes) -> str:
    text = base64.b64encode(body).decode()
    return f"-----BEGIN {label}-----\n" + "\n".join(text[i : i + 64] for i in range(0, len(text), 64)) + f"\n-----END {label}-----"


def token(header: dict, size: int = 32) -> str:
    enc = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join([enc(json.dumps(header).encode()), enc(json.dumps({"sub": "1", "name": "somebody"}).encode()), enc(BYTES(size))])


def checked(kind: str = "ghp") -> str:
    body = "".join(RNG.choice("abcdefghijABCDEF0123456789") for _ in range(30))
    crc, code = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, r = divmod(crc, 62)
        code = secrets._BASE62[r] + code
    return f"{kind}_{body}{code}"


GOOD = {
    "rsa": (pem("RSA PRIVATE KEY", rsa()), "private_key"), "pkcs8": (pem("PRIVATE KEY", pkcs8()), "private_key"), "ec": (pem("EC PRIVATE KEY", sec1()), "private_key"), "openssh": (pem("OPENSSH PRIVATE KEY", openssh()), "private_key"),
    "bare base64": ("key: " + base64.b64encode(pkcs8()).decode(), "private_key"), "hex": (sec1().hex(), "private_key"), "jwt": (token({"alg": "HS256", "typ": "JWT"}), "signed_token"), "access id": ("AKIA" + "".join(RNG.choice("ABCDEFGHIJ234567") for _ in range(16)), "access_key_id"),
    "checksum": (checked(), "checksummed_token"), "assigned": ('secret = "' + bytes(RNG.sample(range(256), 20)).hex() + '"', "assigned_key"),
}
BAD = {
    "truncated key": pem("RSA PRIVATE KEY", rsa()[:-9]), "wrong inner length": pem("PRIVATE KEY", pkcs8().replace(b"\2\1\0", b"\2\2\0", 1)), "not a key": pem("PRIVATE KEY", BYTES(300)), "no algorithm": token({"typ": "JWT"}), "short signature": token({"alg": "HS256"}, 20),
    "wrong checksum": checked()[:-1] + "!", "hash in prose": "commit " + BYTES(20).hex(), "sequence": "password = 0123456789abcdef0123456789abcdef", "base64 text": base64.b64encode(b"just some ordinary words in a row, nothing else here at all").decode(), "long word": "abcdefghijklmnopqrstuvwxyz" * 4, "lower id": "akia" + "a" * 16,
}


@pytest.mark.parametrize("name", GOOD)
def test_confirmed(name):
    text, kind = GOOD[name]
    whole = f"before\n{text}\nafter".encode()
    found = secrets.scan(whole)
    assert [f[0] for f in found] == [kind]
    _, _, start, size = found[0]
    assert 7 <= start and start + size <= len(whole) - 6


@pytest.mark.parametrize("name", BAD)
def test_not_confirmed(name):
    assert secrets.scan(f"before {BAD[name]} after".encode()) == []


def test_scan_of_batches_equals_scan_of_each_text(spark):
    rng = random.Random(3)
    pool = [t for t, _ in GOOD.values()] + list(BAD.values()) + [data.prose("de", 50, k) for k in range(9)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 6))), "en", "s") for i in range(150)]
    got = sorted((r["doc_id"], r["kind"], r["detail"], r["start"], r["length"]) for r in secrets.find_secrets(data.documents(spark, rows)).collect())
    want = sorted((i, *f) for i, t, *_ in rows for f in secrets.scan(t.encode()))
    assert got == want and len(want) > 100


def test_awkward_rows(spark):
    key = GOOD["jwt"][0]
    rows = [*data.awkward_rows(), (40, key, "en", "s"), (40, key, "en", "s"), (None, key, "en", "s"), (41, data.prose("en", 50_000, 1) + "\n" + key, "en", "s"), (42, "é" + key[:-1], "en", "s")]
    docs = data.with_clashes(data.documents(spark, rows))
    got = sorted((r["doc_id"] or 0, r["kind"]) for r in secrets.find_secrets(docs).collect())
    assert got == [(0, "signed_token"), (40, "signed_token"), (40, "signed_token"), (41, "signed_token")]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def lines(text: str, width: int, sep: str = "\n") -> str:
    return sep.join(text[i : i + width] for i in range(0, len(text), width))


B64 = lambda b: base64.b64encode(b).decode()
WRAPPED = {
    "escaped PEM in JSON": json.dumps({"private_key": pem("PRIVATE KEY", pkcs8()) + "\n"}), "doubly escaped": json.dumps(json.dumps({"k": pem("RSA PRIVATE KEY", rsa())})), "escaped CRLF": json.dumps(pem("EC PRIVATE KEY", sec1()).replace("\n", "\r\n")),
    "escaped slashes": json.dumps(pem("OPENSSH PRIVATE KEY", openssh())).replace("/", "\\/"), "joined literals": '"' + pem("PRIVATE KEY", pkcs8()).replace("\n", '\\n" +\n  "') + '"', "quoted mail": "> " + pem("RSA PRIVATE KEY", rsa()).replace("\n", "\n> "), "diff": "+" + pem("RSA PRIVATE KEY", rsa()).replace("\n", "\n+"),
    "base64 at 76": lines(B64(pkcs8()), 76), "base64 at 64": "data:\n" + lines(B64(rsa()), 64), "base64 CRLF": lines(B64(sec1()), 64, "\r\n"), "base64 escaped": '{"k": "' + lines(B64(pkcs8()), 64, "\\n") + '"}', "base64 indented": "key: |\n  " + lines(B64(openssh()), 64, "\n  "), "escaped start": '"a\\n' + lines(B64(pkcs8()), 76, "\\n") + '"',
    "hex at 60": lines(pkcs8().hex(), 60), "hex at 64": lines(sec1().hex(), 64), "openssh hex": lines(openssh().hex(), 64),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_keys_over_line_breaks(name):
    for _ in range(2):
        whole = f"before\n{WRAPPED[name]}\nafter".encode()
        found = secrets.scan(whole)
        assert [f[0] for f in found] == ["private_key"]
        assert 7 <= found[0][2] and found[0][2] + found[0][3] <= len(whole) - 6


@pytest.mark.parametrize("name", ["truncated", "noise", "broken"])
def test_wrapped_data_that_is_no_key(name):
    text = {"truncated": lines(B64(pkcs8()[:-9]), 76), "noise": lines(B64(BYTES(3000)), 76), "broken": lines(B64(pkcs8()), 76).replace("\n", "\n\n!", 3)}[name]
    assert secrets.scan(f"before\n{text}\nafter".encode()) == []


def slow_scan(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, length) by trying every span between two bytes of another alphabet, without regular expressions or run tables.

    It knows keys in one run of hex or base64, signed tokens, access ids, checked tokens and assigned hex strings.
    """
    alnum = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out, taken = [], []

    def spans(alphabet: bytes, least: int):
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in alphabet:
                end += 1
            if end - at >= least:
                yield at, end
            at = max(end, at + 1)

    def add(kind: str, a: int, b: int) -> None:
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            out.append((kind, a, b - a))

    outside = lambda i: not (0 <= i < len(text)) or text[i] not in alnum
    for a, b in spans(alnum, 20):  # ids of 20 capitals and digits
        if b - a == 20 and text[a : a + 4] in (b"AKIA", b"ASIA") and all(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for c in text[a + 4 : b]):
            add("access_key_id", a, b)
    for a in range(len(text) - 39):  # prefix, 30 characters, 6 of a checksum
        if text[a : a + 2] == b"gh" and text[a + 2] in b"pousr" and text[a + 3] == 95 and outside(a - 1) and outside(a + 40) and all(c in alnum for c in text[a + 4 : a + 40]):
            crc, code = zlib.crc32(text[a + 4 : a + 34]), b""
            while len(code) < 6:
                crc, r = divmod(crc, 62)
                code = secrets._BASE62[r].encode() + code
            if code == text[a + 34 : a + 40]:
                add("checksummed_token", a, a + 40)
    for a, b in spans(alnum + b"-_.", 12):
        parts = text[a:b].split(b".")
        if len(parts) == 3 and len(parts[0]) >= 8 and len(parts[1]) >= 2 and secrets.signed_token(*parts):
            add("signed_token", a, b)
    for a, b in spans(b"0123456789abcdefABCDEF", 16):
        if not outside(a - 1) or not outside(b) or (b - a) % 2:
            continue
        data = bytes.fromhex(text[a:b].decode())
        before = text[:a].decode("latin-1").rstrip("\"'`").rstrip()
        if before.lower().endswith("bearer"):
            before = before[:-6].rstrip()
        name = before.rstrip("=:>").rstrip().rstrip("\"'").lower()
        if secrets.private_key(data):
            add("private_key", a, b)
        elif any(name.endswith(x) for x in ("pass", "password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "auth", "authorization", "credential", "private_key", "private-key", "privatekey")) and secrets.raw_key(text[a:b]):
            add("assigned_key", a, b)
    for a, b in spans(alnum + b"+/=", 32):
        data = secrets.b64decode(text[a:b])
        if data and (secrets.private_key(data) or secrets.openssh_key(data)):
            add("private_key", a, b)
    return out


def test_query_equals_a_slow_scan(spark):
    rng = random.Random(12)
    key = lambda: bytes(rng.sample(range(256), 20)).hex()
    pool = [lambda: base64.b64encode(pkcs8()).decode(), lambda: rsa().hex(), lambda: token({"alg": "HS256"}), lambda: token({"alg": "HS256"}, 20), checked, lambda: checked()[:-1] + "!", lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)), lambda: "AKIA0" + "A" * 15,
        lambda: f'secret = "{key()}"', lambda: f"db_password:{key()}", lambda: f"token" + " " * rng.randint(1, 90) + f"= {key()}", lambda: f'"Authorization": "Bearer {" " * 60}{key()}"', lambda: f"commit {key()}", lambda: f"api_key := '{key()}'", lambda: BYTES(40).hex(), lambda: B64(BYTES(90)), lambda: data.prose("de", 30, rng.randint(0, 99)), lambda: B64(pkcs8()[:-5])]
    rows = [(i, " ; ".join(rng.choice(pool)() for _ in range(rng.randint(0, 6))), "en", "s") for i in range(160)]
    got = sorted((r["doc_id"], r["kind"], r["start"], r["length"]) for r in secrets.find_secrets(data.documents(spark, rows)).collect())
    assert got == sorted((i, *f) for i, t, *_ in rows for f in slow_scan(t.encode())) and len(got) > 150
