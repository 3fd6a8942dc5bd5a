"""Operator 11. Secrets, confirmed by their structure.

Plain patterns give assignments, access keys and hex strings. Beyond these, runs of base64 or hex that may
hold a secret are decoded and parsed, and reported only if the parse holds:

* ``private_key``: DER whose nested lengths fit exactly and whose fields are those of an RSA, DSA or EC key,
  of PKCS#8 (plain with the key inside, or encrypted), or the length-prefixed OpenSSH container.
  Base64 may be wrapped, also by written-out line ends; PEM lines around the key belong to the span.
  PEM that is encrypted as a whole counts when its cipher is named and whole blocks follow.
* ``signed_token``: three base64url parts, the first an object that names a signature algorithm, the second
  an object, the third as long as signatures of that algorithm are.

Both are also found in base64 or hex of a text that holds them, up to three layers deep. Public
keys, certificates, unsigned tokens and random strings of the right alphabet are no secrets.

Spans are code points, end exclusive. A null or empty text has no spans. Every row gives one row, also
repeated ones and those without id; only the id and the text are read. Texts are searched whole, one at
a time, in time proportional to their length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table, text_of

ASSIGN, ACCESS, HEX, KEY, TOKEN = "assign", "access", "hex", "private_key", "signed_token"
#: All kinds in the order of the report.
KINDS = (ASSIGN, ACCESS, HEX, KEY, TOKEN)
#: Layers of base64 or hex that are opened.
LAYERS = 3

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.I | re.A)
_ASSIGNED = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
_ANY_HEX = re.compile("[0-9A-Fa-f]{16,}")

_LINE = r"(?:\r?\n[ \t>]*|(?:\\r)?\\n)"
#: Starts of a DER sequence, of an OpenSSH key, of PEM and of a token in base64, with the rest of a line.
_BASE64 = re.compile(r"(?:M[A-P]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi|ZXlK)[A-Za-z0-9+/_-]{14,}+")
_BEFORE = re.compile(r"[A-Za-z0-9+/\\]")
_DIGITS = re.compile("[A-Za-z0-9+/_-]++")
_MORE = re.compile(rf"{_LINE}([A-Za-z0-9+/_-]++)")
#: Bytes of the longest key encoding.
KEY_BYTES = 1 << 16
#: The same starts in hex.
_HEX_STARTS = ("30", "6f70656e7373682d6b65792d763100", "2d2d2d2d2d424547494e", "65794a")
_TOKEN_STARTS = ("eyJ", "eyA", "ewo", "ew0")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]++")
_HEAD = re.compile(rf"-----BEGIN [A-Z0-9 ]{{0,40}}-----(?:{_LINE}|[ \t])*\Z")
_FOOT = re.compile(rf"(?:=|{_LINE}|[ \t]){{0,20}}-----END [A-Z0-9 ]{{0,40}}-----")
_ENCRYPTED = re.compile(
    rf"-----BEGIN ([A-Z0-9 ]{{0,20}}PRIVATE KEY)-----{_LINE}Proc-Type: 4,ENCRYPTED{_LINE}"
    rf"DEK-Info: ([A-Z0-9-]{{3,30}}),([0-9A-Fa-f]{{16,32}}){_LINE}{{1,2}}"
    rf"((?:[A-Za-z0-9+/]++{_LINE})*+[A-Za-z0-9+/]++={{0,2}}){_LINE}?-----END \1-----")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    detail: str | None


class Item(NamedTuple):
    """A DER element: tag, and where its content lies."""

    tag: int
    start: int
    end: int


def element(data: bytes, at: int, end: int) -> Item | None:
    """The DER element at a place, if its length is well formed and it ends before ``end``."""
    if end - at < 2:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        wide = size & 0x7F
        if not 1 <= wide <= 4 or end - start < wide:
            return None
        size = int.from_bytes(data[start:start + wide], "big")
        if size < 0x80 or size < 1 << 8 * (wide - 1):  # a shorter form would do
            return None
        start += wide
    return Item(tag, start, start + size) if size <= end - start else None


def elements(data: bytes, at: int, end: int) -> list[Item] | None:
    """Elements that fill a content exactly."""
    found = []
    while at < end:
        item = element(data, at, end)
        if item is None or len(found) == 16:
            return None
        found.append(item)
        at = item.end
    return found


_INT, _BITS, _OCTETS, _NULL, _OID, _SEQ = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30
#: Object identifiers, in DER: kinds of keys, and the families of password encryption.
_RSA, _DSA, _EC = (bytes.fromhex(x) for x in (
    "2a864886f70d010101", "2a8648ce380401", "2a8648ce3d0201"))
_RAW = {bytes.fromhex("2b65") + bytes([n]): (name, size) for n, name, size in (
    (0x6E, "x25519", 32), (0x6F, "x448", 56), (0x70, "ed25519", 32), (0x71, "ed448", 57))}
_SEALED = tuple(bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01"))


def _number(data: bytes, item: Item) -> int:
    return int.from_bytes(data[item.start:item.end], "big")


def der_key(data: bytes) -> tuple[str, int] | None:
    """What private key the data starts with, and its length."""
    whole = element(data, 0, len(data))
    if whole is None or whole.tag != _SEQ:
        return None
    name = _fields(data, whole)
    return (name, whole.end) if name else None


def _fields(data: bytes, whole: Item) -> str | None:
    parts = elements(data, whole.start, whole.end)
    if not parts or len(parts) < 2:
        return None
    tags = [p.tag for p in parts]
    if tags == [_SEQ, _OCTETS]:
        inner = elements(data, parts[0].start, parts[0].end)
        sealed = inner and inner[0].tag == _OID and data[inner[0].start:inner[0].end].startswith(
            _SEALED)
        return "encrypted pkcs8" if sealed and parts[1].end - parts[1].start >= 16 else None
    if tags[0] != _INT or not 1 <= parts[0].end - parts[0].start <= 2:
        return None
    version = _number(data, parts[0])
    if any(p.tag == _INT and p.start == p.end for p in parts):
        return None
    if tags[:9] == [_INT] * 9 and version in (0, 1) and tags[9:] in ([], [_SEQ]):
        bits = _number(data, parts[1]).bit_length()
        return f"rsa {bits}" if bits >= 256 else None
    if tags == [_INT] * 6 and version == 0:
        bits = _number(data, parts[1]).bit_length()
        return f"dsa {bits}" if bits >= 256 else None
    if tags[:2] == [_INT, _OCTETS] and version == 1 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        inner = [elements(data, p.start, p.end) for p in parts[2:]]
        size = parts[1].end - parts[1].start
        fits = all(i and len(i) == 1 and i[0].tag in (_OID, _BITS, _SEQ) for i in inner)
        return f"ec {8 * size}" if 16 <= size <= 66 and fits else None
    if tags[:3] == [_INT, _SEQ, _OCTETS] and version in (0, 1) and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        kind = elements(data, parts[1].start, parts[1].end)
        if not kind or kind[0].tag != _OID:
            return None
        oid, box = data[kind[0].start:kind[0].end], parts[2]
        inner = element(data, box.start, box.end)
        if inner is None or inner.end != box.end:
            return None
        if oid in _RAW:
            name, size = _RAW[oid]
            return f"pkcs8 {name}" if inner.tag == _OCTETS and inner.end - inner.start == size \
                else None
        if oid == _DSA:
            return "pkcs8 dsa" if inner.tag == _INT else None
        name = _fields(data, inner) if inner.tag == _SEQ else None
        if oid in (_RSA, _EC):
            right = name and name.startswith("rsa" if oid == _RSA else "ec ")
            return f"pkcs8 {name}" if right else None
        return f"pkcs8 {name}" if name else None
    return None


_OPENSSH = b"openssh-key-v1\0"


def openssh_key(data: bytes) -> tuple[str, int] | None:
    """An OpenSSH container: names, options, public keys and the private part, by their lengths."""
    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)

    def number() -> int | None:
        nonlocal at
        at += 4
        return int.from_bytes(data[at - 4:at], "big") if at <= len(data) else None

    def string() -> bytes | None:
        nonlocal at
        size = number()
        if size is None or size > len(data) - at:
            return None
        at += size
        return data[at - size:at]

    cipher, kdf, options, count = string(), string(), string(), number()
    if None in (cipher, kdf, options, count) or not 1 <= count <= 16:
        return None
    kinds = []
    for _ in range(count):
        public = string()
        size = int.from_bytes(public[:4], "big") if public and len(public) > 4 else 0
        if not 3 <= size <= len(public or b"") - 4:
            return None
        kinds.append(public[4:4 + size].decode("ascii", "replace"))
    private = string()
    if not private or len(private) % 8:
        return None
    if cipher == b"none":  # the same number twice, then the key's own name
        size = int.from_bytes(private[8:12], "big")
        if private[:4] != private[4:8] or private[12:12 + size] != kinds[0].encode():
            return None
    return f"openssh {kinds[0]}", at


def private_key(data: bytes) -> tuple[str, int] | None:
    return der_key(data) or openssh_key(data)


#: Bytes of a signature: exact, or the least for RSA.
_SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96,
           "ES512": 132, "EdDSA": (64, 114)}
_SIGNED_RSA = {f"{a}{n}" for a in ("RS", "PS") for n in (256, 384, 512)}


def _part(text: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def _object(text: str) -> dict | None:
    try:
        value = json.loads(_part(text) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(head: str, claims: str, signature: str) -> str | None:
    """The algorithm of a signed token, if its three parts hold together."""
    header = _object(head)
    algorithm = header.get("alg") if header and "enc" not in header else None
    if not isinstance(algorithm, str) or _object(claims) is None:
        return None
    size = len(_part(signature) or b"")
    if algorithm in _SIGNED_RSA:
        return algorithm if size >= 128 and size % 64 == 0 else None
    wanted = _SIGNED.get(algorithm, ())
    return algorithm if size in (wanted if isinstance(wanted, tuple) else (wanted,)) else None


def _tokens(text: str) -> Iterator[Span]:
    at = 0
    while m := _TOKEN.search(text, at):
        start = m.start()
        head, claims, signature = m[0].split(".")
        at = start + len(head) + 1
        if algorithm := signed_token(head, claims, signature):
            at = m.end()
            yield Span(TOKEN, start, at, algorithm)


def _decoded(digits: str) -> bytes:
    """Bytes of base64 digits; a last short group counts if it is a whole byte."""
    digits = digits.replace("-", "+").replace("_", "/")
    digits = digits[:len(digits) - (len(digits) % 4 == 1)]
    return base64.b64decode(digits + "=" * (-len(digits) % 4))


def _run(text: str, start: int, most: float) -> tuple[str, int]:
    """Up to ``most`` digits from a place on, over line ends, and where they end."""
    m = _DIGITS.match(text, start)
    parts, n, end = [m[0]], len(m[0]), m.end()
    while n < most and (m := _MORE.match(text, end)):
        parts.append(m[1])
        n, end = n + len(m[1]), m.end()
    over = max(0, n - int(min(most, n)))
    return "".join(parts)[:n - over], end - over


def _wrapped(text: str, start: int, end: int) -> tuple[int, int]:
    """The span with PEM lines around it."""
    if head := _HEAD.search(text, max(0, start - 200), start):
        if foot := _FOOT.match(text, end):
            return head.start(), foot.end()
    return start, end


def _in_base64(text: str, layers: int) -> Iterator[Span]:
    done = 0
    for m in _BASE64.finditer(text):
        start = m.start()
        inside_run = start and _BEFORE.match(text, start - 1) and text[max(0, start - 2):start] != r"\n"
        if inside_run or start < done:
            continue
        if m[0][0] == "M":
            # the declared length says how many digits belong to the key
            opening = _decoded(m[0][:16])
            whole = element(opening, 0, KEY_BYTES)
            if whole is None or opening[whole.start] not in (_INT, _SEQ):
                continue
            size = whole.end
        elif m[0][0] == "b":
            found = openssh_key(_decoded(_run(text, start, KEY_BYTES * 4 // 3)[0]))
            size = found[1] if found else 0
        else:
            token = m[0][0] == "Z"
            digits, end = (m[0], m.end()) if token else _run(text, start, float("inf"))
            done = end
            if found := _inside(_decoded(digits), layers):
                yield Span(found.kind, start, end, f"base64 of {found.detail}")
            continue
        digits, end = _run(text, start, -(-size * 4 // 3))
        if found := private_key(_decoded(digits)):
            end += next(i for i in range(3) if i == 2 or text[end + i:end + i + 1] != "=")
            first, done = _wrapped(text, start, end)
            yield Span(KEY, first, done, found[0])


def _in_hex(text: str, start: int, end: int, layers: int) -> Iterator[Span]:
    run = text[start:end].lower()
    if not run.startswith(_HEX_STARTS):
        return
    data = bytes.fromhex(run[:len(run) // 2 * 2])
    if found := private_key(data):
        name, size = found
        yield Span(KEY, start, start + 2 * size, f"hex of {name}")
    elif found := _inside(data, layers):
        yield Span(found.kind, start, end, f"hex of {found.detail}")


def _inside(data: bytes, layers: int) -> Span | None:
    """The first confirmed secret in decoded text."""
    if layers <= 0:
        return None
    text = data.decode("utf-8", "replace")
    return next((s for s in structured(text, layers - 1)), None)


def structured(text: str, layers: int = LAYERS) -> Iterator[Span]:
    """Secrets that are confirmed by their structure, by kind of encoding."""
    yield from _in_base64(text, layers)
    for m in _ANY_HEX.finditer(text):
        yield from _in_hex(text, *m.span(), layers)
    if any(start in text for start in _TOKEN_STARTS):
        yield from _tokens(text)
    if "Proc-Type" in text:
        for m in _ENCRYPTED.finditer(text):
            digits = "".join(_DIGITS.findall(m[4].replace(r"\r", "").replace(r"\n", "")))
            if len(digits) % 4 != 1 and (size := len(_decoded(digits))) >= 64 and size % 8 == 0:
                yield Span(KEY, *m.span(), f"encrypted pem {m[2]}")


def base_spans(text: str, raw: bytes) -> Iterator[Span]:
    """Matches of the plain patterns, leftmost and not overlapping, by kind."""
    low = raw.lower()
    if any(word in low for word in _ASSIGNED):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                yield Span(ASSIGN, *m.span(), None)
    if b"AKIA" in raw:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield Span(ACCESS, *m.span(), None)
    for m in _HEX.finditer(text):
        yield Span(HEX, *m.span(), None)


def spans_of(raw: bytes) -> list[Span]:
    """All spans of a text in UTF-8, by start and kind; equal ones once."""
    text = raw.decode("utf-8", "replace")
    found = {s[:3]: s for s in (*structured(text), *base_spans(text, raw))}
    return sorted(found.values(), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("detail", pa.string())]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, and ``found``, its spans with kind and detail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[s._asdict() for s in spans_of(raw.as_py())] for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, _FOUND)], ["doc_id", "found"])

    return docs.select(docs[key].cast("long").alias("doc_id"),
                       text_of(docs[text]).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, "
             "found array<struct<kind: string, start: long, end: long, detail: string>>")


def op11_structured_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"].isin(ASSIGN, ACCESS, HEX))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")

    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", number(ASSIGN).alias("n_assign"), number(ACCESS).alias("n_access"),
        number(HEX).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(found).alias("spans"), number(KEY).alias("n_private_key"),
        number(TOKEN).alias("n_signed_token"))


QUERIES = {"op11_structured_secrets": op11_structured_secrets}
ORACLES: dict[str, str] = {}
