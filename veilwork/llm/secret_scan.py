"""Secret scans that report a candidate only after its structure is confirmed.

Assignments, access keys and hex strings are found by their shape. Beyond them, candidates are
decoded from base64 or hex and parsed: private keys in DER (every nested length must fit, the
children must be those of a known key encoding, an RSA modulus must be the product of its primes)
or in OpenSSH's own encoding, bare or between PEM lines, and signed tokens whose header names an
algorithm, whose payload is an object and whose signature has that algorithm's length.

Texts of a batch are searched end to end, a NUL between them, which no pattern can cross. Every
pattern is linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernel import parts

#: Found by shape, in the order in which kinds of one start are listed.
SHAPES = ["assign", "access", "hex"]
#: Confirmed by structure.
CONFIRMED = ["jwt", "pem", "key64", "keyhex"]
KINDS = SHAPES + CONFIRMED

_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])eyJ([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_PEM = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----([^-\0]*+(?:-(?!----)[^-\0]*+)*+)-----END \1-----")
_KEY64 = re.compile(rb"(?:M|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/]{39,}={0,2}")
_BASE64 = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
_HEXES = frozenset(b"0123456789abcdefABCDEF")
_KEYHEX = re.compile(rb"(?:30|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]7631)[0-9a-fA-F]{62,}")

INTEGER, OCTETS, OBJECT_ID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
OPENSSH = b"openssh-key-v1\0"
#: Bytes of a signature by algorithm; RSA's follow the key and have at least these.
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
RSA_SIGNATURE = 128


def der_items(raw: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill `raw` exactly, None if their lengths don't fit."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            size = int.from_bytes(raw[at:at + n], "big")
            # Lengths are definite and written as short as can be.
            if not 1 <= n <= 4 or at + n > len(raw) or raw[at] == 0 or size < 0x80:
                return None
            at += n
        if at + size > len(raw):
            return None
        out.append((tag, raw[at:at + size]))
        at += size
    return out


def der_key(raw: bytes) -> bool:
    """Whether `raw` is a private key in DER: PKCS#1, PKCS#8 (also encrypted), SEC 1 or DSA."""
    outer = der_items(raw)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]

    def named(content: bytes) -> bool:
        inner = der_items(content)
        return bool(inner) and inner[0][0] == OBJECT_ID and len(inner[0][1]) > 2

    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:
        return named(items[0][1]) and len(items[1][1]) >= 16
    if tags[0] != INTEGER or len(items[0][1]) != 1 or items[0][1][0] > 1:
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:
        return named(items[1][1]) and len(items[2][1]) >= 16
    if tags[1:2] == [OCTETS]:
        return items[0][1] == b"\1" and 16 <= len(items[1][1]) <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if set(tags[:6]) == {INTEGER} and len(tags) >= 6:
        numbers = [int.from_bytes(c, "big") for _, c in items[:9]]
        if len(tags) >= 9 and set(tags[:9]) == {INTEGER}:
            return numbers[1].bit_length() >= 256 and numbers[4] * numbers[5] == numbers[1]
        return len(tags) == 6 and numbers[1].bit_length() >= 512 and numbers[2] > 1 and (numbers[1] - 1) % numbers[2] == 0
    return False


def openssh_key(raw: bytes) -> bool:
    """Whether `raw` is a private key as OpenSSH writes it; nested lengths must fill it exactly."""
    if not raw.startswith(OPENSSH):
        return False
    at, values = len(OPENSSH), []

    def string() -> bool:
        nonlocal at
        size = int.from_bytes(raw[at:at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        values.append(raw[at + 4:at + 4 + size])
        at += 4 + size
        return True

    if not (string() and string() and string()) or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or not all(string() for _ in range(keys + 1)):
        return False
    kind = values[3]
    size = int.from_bytes(kind[:4], "big")
    return at == len(raw) and bool(values[0]) and 0 < size <= len(kind) - 4 and kind[4:4 + size].isascii()


def private_key(raw: bytes) -> bool:
    return der_key(raw) or openssh_key(raw)


def from_base64(value: bytes, url: bool = False) -> bytes | None:
    """The bytes that a base64 string stands for, padded or not; None if it can't be one."""
    value = value.rstrip(b"=")
    if len(value) % 4 == 1:
        return None
    try:
        return base64.b64decode(value + b"=" * (-len(value) % 4), b"-_" if url else None, validate=True)
    except binascii.Error:
        return None


def signed_token(header: bytes, payload: bytes, signature: bytes) -> bool:
    """Whether the three parts of a token are a header with an algorithm, an object and a fitting signature."""
    parsed = []
    for part in (header, payload):
        raw = from_base64(part, url=True)
        try:
            parsed.append(json.loads(raw.decode()) if raw else None)
        except (ValueError, RecursionError):
            return False
    sealed = from_base64(signature, url=True)
    if not all(isinstance(p, dict) for p in parsed) or not sealed:
        return False
    algorithm = parsed[0].get("alg")
    if algorithm in SIGNATURES if isinstance(algorithm, str) else False:
        return len(sealed) in SIGNATURES[algorithm]
    return algorithm in ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512") and len(sealed) >= RSA_SIGNATURE


def pem_key(body: bytes) -> bool:
    """Whether a PEM body is a private key; header lines of encrypted keys come before a blank line."""
    body = body.replace(b"\\r", b"").replace(b"\\n", b"\n").replace(b"\r", b"")
    sealed = b"ENCRYPTED" in body and b"\n\n" in body
    if sealed:
        body = body.split(b"\n\n", 1)[1]
    raw = from_base64(b"".join(body.split()))
    return bool(raw) and (private_key(raw) or sealed and len(raw) >= 64 and len(raw) % 8 == 0)


def hex_runs(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of [0-9a-f] with at least `least` characters."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:103] = True
    change = np.flatnonzero(np.diff(table[data], prepend=False, append=False))
    starts, ends = change[::2], change[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def scan_bytes(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of all secrets in the bytes, by start, then kind."""
    raw = data.tobytes()
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(raw)]
    found += [(a, b, 2) for a, b in zip(*(x.tolist() for x in hex_runs(data, 24)))]
    found += [(m.start(), m.end(), 3) for m in _JWT.finditer(raw) if signed_token(b"eyJ" + m[1], m[2], m[3])]
    blocks = [(m.start(), m.end(), 4) for m in _PEM.finditer(raw) if pem_key(m[2])]
    inner = []
    for m in _KEY64.finditer(raw):
        if m.start() and raw[m.start() - 1] in _BASE64:
            continue
        value = from_base64(m[0])
        if value and private_key(value):
            inner.append((m.start(), m.end(), 5))
    for m in _KEYHEX.finditer(raw):
        # The run before a candidate is none of it, and a last odd digit is not either.
        if not (m.start() and raw[m.start() - 1] in _HEXES) and len(m[0]) % 2 == 0 and private_key(bytes.fromhex(m[0].decode())):
            inner.append((m.start(), m.end(), 6))
    # The body of a reported block is not reported again.
    found += blocks + [x for x in inner if not any(a <= x[0] and x[1] <= b for a, b, _ in blocks)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text + NUL) -> id and spans in code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for i, j, data, offsets in parts(batch.column(1)):
            found = scan_bytes(data)
            sizes = np.zeros(j - i, np.int64)
            kinds, starts, ends = [], np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            if found:
                first, last, number = np.array(found, np.int64).T
                rows = np.searchsorted(offsets, first, "right") - 1
                sizes = np.bincount(rows, minlength=j - i)
                kinds = [KINDS[k] for k in number.tolist()]
                for row in np.unique(rows).tolist():
                    a, b = offsets[row], offsets[row + 1]
                    points = np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))
                    mine = slice(*np.searchsorted(rows, [row, row + 1]))
                    starts[mine], ends[mine] = points[first[mine] - a], points[last[mine] - a]
            bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts), pa.array(ends)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds), values)], ["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) per row: kind, start and end (code points, end exclusive) by start, then kind.

    Kinds by shape, leftmost and not overlapping within a kind: `assign` (a name such as password
    or api_key in either case, a colon or equals sign, a value of 6 or more characters; a shorter
    value uses up its match), `access` (AKIA and 16 or more of [A-Z0-9]), `hex` (24 or more of
    [0-9a-f]). Kinds by structure, as the module says: `jwt`, `pem`, `key64`, `keyhex`; the body of
    a reported `pem` is not reported again. Kinds may overlap each other.

    Whole texts are searched whatever their length, in linear time; a task holds about 4 MB of
    texts, or one longer text. Null and empty texts have no spans. Each row is answered for
    itself, so ties, null and repeated ids change nothing. Other columns are ignored, whatever
    their names; an empty table gives an empty result. No shuffle.
    """
    source = docs.select(F.col(id_col).alias("id"), F.concat(F.col(text), F.lit("\0")).alias("text"))
    found = source.mapInArrow(_scan, f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")
    return found.withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
