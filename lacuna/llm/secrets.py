"""Secret scan with structural confirmation: patterns find candidates, parsers decide what they are."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from lacuna.llm.texts import by_text

# the three base kinds; group 2 of an assignment is its value
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Kinds in the order that breaks ties of a start: base kinds, then confirmed structures.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
RANK = {k: i for i, k in enumerate(KINDS)}

# candidates of the confirmed kinds: dotted base64url, armoured blocks, runs of base64 or hex
# a token has three parts, an encrypted one five, of which the second is empty where the key is agreed on or given
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+))?(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")
# lines of headers may stand before the block
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----((?:\s*[A-Za-z][A-Za-z0-9-]*:[^\n\\]*(?:\n|\\n))*)([A-Za-z0-9+/=\s\\]*?)-----END \1-----")
SEALED = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,([0-9A-Fa-f]{16,32})\s")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
# what encodes a sequence, a length or the magic begins with one of three letters: with the URL alphabet, and over line ends
BASE64_URL = re.compile(r"(?<![A-Za-z0-9_-])[MAb][A-Za-z0-9_-]{39,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[MAb](?:[A-Za-z0-9+/]{59,79}\r?\n[A-Za-z0-9+/])+[A-Za-z0-9+/]{0,79}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}(?![0-9A-Fa-f])")

#: Levels of nested lengths that are followed; deeper ones are read as plain content.
DEPTH = 16


def from_base64(text: str) -> bytes | None:
    """Standard or URL alphabet, padded or not."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The tag-length-value elements that fill ``data`` exactly, or None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n = int.from_bytes(data[at : at + size], "big")
            at += size
            if n < 0x80 or n >> (8 * (size - 1)) == 0:  # not the shortest form
                return None
        if at + n > len(data):
            return None
        found.append((tag, data[at : at + n]))
        at += n
    return found


def nested(data: bytes, depth: int = 0) -> bool:
    """True when every constructed element is filled by its parts."""
    parts = elements(data)
    if parts is None:
        return False
    return all(not tag & 0x20 or depth >= DEPTH or nested(content, depth + 1) for tag, content in parts)


def is_key(data: bytes) -> bool:
    """A private or public key encoding: one sequence with consistent lengths that begins as one of
    version and integers (RSA, DSA), version and algorithm (PKCS 8), version and octets (EC), or algorithm and bits."""
    outer = elements(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1 or not nested(data):
        return False
    parts = elements(outer[0][1])
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and len(parts[0][1]) == 1 and parts[0][1][0] <= 1:
        if tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04]:
            return len(parts[1 if tags[1] == 0x04 else 2][1]) >= 16
        return len(tags) >= 6 and set(tags) == {0x02} and all(len(c) >= 1 for _, c in parts)
    if tags == [0x30, 0x03]:
        algorithm = elements(parts[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(parts[1][1]) >= 17
    return set(tags) == {0x02} and len(tags) == 2 and len(parts[0][1]) >= 64


def is_public(data: bytes) -> bool:
    """Whether a confirmed key encoding holds a public key: algorithm and bits, modulus and exponent, or fields without the magic."""
    if data[:1] != b"\x30":
        return not data.startswith(b"openssh-key-v1\0")
    tags = [t for t, _ in elements(elements(data)[0][1])]
    return tags == [0x30, 0x03] or tags == [0x02, 0x02]


def is_sealed(headers: str, data: bytes) -> bool:
    """An encrypted block whose headers name its cipher and start value: whole cipher blocks."""
    found = SEALED.search(headers)
    return "ENCRYPTED" in headers and found is not None and len(data) >= 64 and len(data) % (len(found.group(1)) // 2) == 0


def is_ssh(data: bytes) -> bool:
    """The private key container with its magic, or a public key: length-prefixed fields that fill the data."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        fields, rest = prefixed(data[len(magic) :], 3)
        return fields is not None and fields[0].isascii() and len(rest) >= 8
    fields, rest = prefixed(data, None)
    return bool(fields) and len(fields) >= 2 and not rest and re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def prefixed(data: bytes, count: int | None) -> tuple[list[bytes] | None, bytes]:
    fields, at = [], 0
    while at < len(data) and (count is None or len(fields) < count):
        if at + 4 > len(data):
            return None, b""
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return None, b""
        fields.append(data[at : at + n])
        at += n
    return (fields if count is None or len(fields) == count else None), data[at:]


def is_token(header: str, payload: str, encrypted: bool) -> bool:
    """A JSON header that names its algorithm, and a JSON object behind it, or of five parts a header that names its encryption too."""
    try:
        head = json.loads(from_base64(header) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
        return False
    if "enc" in head or encrypted:
        return "enc" in head
    try:
        return isinstance(json.loads(from_base64(payload) or b""), dict)
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> tuple[list[tuple[int, int, str]], int]:
    """Spans of confirmed structures, and how many of them are public keys."""
    out, taken, public = [], [], 0
    at = 0
    while m := DOTTED.search(text, at):
        at = m.end(1)  # a part that is no header may stand before one
        if is_token(m.group(1), m.group(2), m.group(5) is not None):
            at = m.end()
            out.append((m.start(), at, "jwt"))
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            data = from_base64(re.sub(r"\\n|\\r|\s", "", m.group(3)))
            plain = data and (is_key(data) or is_ssh(data))
            if data and (plain or "ENCRYPTED" in m.group(1) and nested(data) or is_sealed(m.group(2), data)):
                out.append((m.start(), m.end(), "pem"))
                taken.append((m.start(), m.end()))
                public += bool(plain) and is_public(data)
    for pattern, decode in ((WRAPPED, lambda x: from_base64(re.sub(r"\s", "", x))), (BASE64, from_base64), (BASE64_URL, lambda x: from_base64(x) if "-" in x or "_" in x else None),
                            (HEX_ANY, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            if any(a <= m.start() < b for a, b in taken):
                continue
            data = decode(m.group(0))
            if data and data[0] in (0x30, 0x00, 0x6F):  # a sequence, a length, or the magic
                kind = "der" if is_key(data) else "ssh" if is_ssh(data) else None
                if kind:
                    out.append((m.start(), m.end(), kind))
                    taken.append((m.start(), m.end()))
                    public += is_public(data)
    return out, public


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], RANK[s[2]], s[1])))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts per kind, ``base_sha256`` and ``spans`` of every row.

    Base kinds are the patterns above. A candidate of another kind is reported only if it decodes and its
    structure holds: a signed token's JSON header, a key's nested lengths, an SSH key's fields. Spans are
    kind:start:end in code points, end exclusive. Null and empty texts have none; rows are independent,
    so repeated rows and null keys stay as they are; other columns are left out.
    """
    def make():
        def work(texts):
            columns = {f"n_{k}": [] for k in KINDS} | {"n_public": [], "base_sha256": [], "spans": []}
            for t in texts:
                base = base_spans(t)
                confirmed, public = confirmed_spans(t)
                spans = base + confirmed
                columns["n_public"].append(public)
                for k in KINDS:
                    columns[f"n_{k}"].append(sum(s[2] == k for s in spans))
                columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns["spans"].append(joined(spans))
            return columns

        return work

    counts = ", ".join(f"n_{k} bigint" for k in (*KINDS, "public"))
    return by_text(df, [key], text, make, f"{counts}, base_sha256 string, spans string")


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """The text with every span of ``scan`` replaced; overlapping spans are replaced together."""
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
