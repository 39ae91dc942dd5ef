"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits, checksum validation.

One pass of an Aho-Corasick automaton over the ASCII-lowered text yields keyword hits; only there is an
expression tried, anchored at the hit.  ``AUTOMATON`` holds the keywords of every kind and, for hexadecimal
runs, all four-digit hexadecimal strings (generated by rule).  Tokens that embed a checksum or a checkable
structure count only if it holds: private keys by their DER or OpenSSH lengths, those enciphered under PEM headers
(Proc-Type, DEK-Info) by whole cipher blocks.

Results for special cases: a null text counts as empty (no spans); an empty table gives an empty result;
rows are independent, so repeated rows repeat their result; very long texts are scanned whole, in time linear in their
length; spans of equal start come in the order of ``KINDS``; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lumenqc.llm.common import nothing_kept, slices

# The base kinds and their patterns.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
FORGE = re.compile(r"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++")
JWT_PART = re.compile(r"[A-Za-z0-9_-]++")
PEM_HEADER = r"(?:(?:Proc-Type|DEK-Info):\s*+\S++\s*+|[A-Za-z][A-Za-z0-9-]*+:(?:[^\r\n-]|-(?!----BEGIN))*+(?:\r?\n[\x20\t]++(?:[^\r\n-]|-(?!----BEGIN))*+)*+\s++)"
PEM = re.compile(rf"-----BEGIN (?P<label>(?:[A-Z]+ )?PRIVATE KEY)-----\s*+(?P<head>{PEM_HEADER}*+)(?P<body>[A-Za-z0-9+/=\s]+)-----END (?P=label)-----")
ENCRYPTED = re.compile(r"Proc-Type:\s*4,ENCRYPTED\s")
DEK = re.compile(r"DEK-Info:\s*([A-Za-z0-9-]+),((?:[0-9A-Fa-f]{2})+)\s")
OPENSSH = b"openssh-key-v1\0"
TAGGED = (b"aes128-gcm@openssh.com", b"aes256-gcm@openssh.com", b"chacha20-poly1305@openssh.com")  # 16 bytes of tag follow the key
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "forge", "jwt", "pem")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge", "npm_": "forge",
    "eyj": "jwt", "-----begin": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_automaton = None


def automaton():
    """Built once in each Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word in map("".join, itertools.product("0123456789abcdef", repeat=4)):
            made.add_word(word, (4, "hex"))
        for word, kind in KEYWORDS.items():
            made.add_word(word, (len(word), kind))
        made.make_automaton()
        _automaton = made
    return _automaton


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def forge_checksum(m: re.Match) -> bool:
    """The last six characters are the base-62 CRC-32 of the thirty before them."""
    return base62(zlib.crc32(m[2].encode()), 6) == m[3]


def jwt_header(m: re.Match) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def der_length(body: bytes) -> bool:
    """One DER sequence whose embedded length is the body's own."""
    if len(body) < 4 or body[0] != 0x30:
        return False
    if body[1] < 0x80:
        return 2 + body[1] == len(body)
    n = body[1] & 0x7F
    return 1 <= n <= 4 and 2 + n + int.from_bytes(body[2 : 2 + n], "big") == len(body)


def openssh_lengths(body: bytes) -> bool:
    """The magic, then cipher, derivation, its options, a count, so many public keys and the private part, which fill the body by their lengths."""
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        start = at + 4
        at = start + int.from_bytes(body[at:start], "big")
        return body[start:at] if start <= len(body) and at <= len(body) else None

    head = [field() for _ in range(3)]
    if not body.startswith(OPENSSH) or None in head:
        return False
    keys = int.from_bytes(body[at : at + 4], "big")
    at += 4
    for _ in range(keys + 1):
        if not field():
            return False
    return keys > 0 and at + 16 * (head[0] in TAGGED) == len(body)


def enciphered(head: str, body: bytes) -> bool:
    """The headers name a cipher and its start value, and the body is whole blocks, where the cipher makes such."""
    m = DEK.search(head)
    return bool(m and body) and (not m[1].upper().endswith("-CBC") or len(body) % (len(m[2]) // 2) == 0)


def private_key(m: re.Match) -> bool:
    """The body decodes to what its headers or its own lengths say."""
    try:
        body = base64.b64decode("".join(m["body"].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if ENCRYPTED.search(m["head"]):
        return enciphered(m["head"], body)
    return der_length(body) or openssh_lengths(body)


#: Kind: anchored pattern and what a match must pass.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 16),
    "hex": (HEX, lambda m: m.end() - m.start() >= 32),
    "forge": (FORGE, forge_checksum),
    "jwt": (JWT, jwt_header),
    "pem": (PEM, private_key),
}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so offsets stay
    past = dict.fromkeys(KINDS, 0)  # end of the last match of a kind, failing ones too
    found = []
    for last, (size, kind) in automaton().iter(lowered):
        at = last - size + 1
        if at < past[kind]:
            continue
        pattern, valid = RULES[kind]
        if m := pattern.match(text, at):
            past[kind] = m.end()
            if valid(m):
                found.append((at, m.end(), kind))
        elif kind == "jwt" and text.startswith("eyJ", at):  # what else begins in this run of characters ends where it ends, and fails as well
            past[kind] = JWT_PART.match(text, at).end()
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by ``[kind]``; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for batch in slices(batches):
            rows = [scan(t or "") for t in batch.column(1).to_pylist()]
            base = [[s for s in r if s[2] in BASE_KINDS] for r in rows]
            counts = [pa.array([sum(s[2] == k for s in r) for r in base], pa.int64()) for k in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string()), pa.array(list(map(joined, rows)), pa.string())],
                names=[id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    kept = docs.select(id_col, text_col)
    kind = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by its kind in brackets; all columns stay as they are otherwise."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for batch in slices(batches):
            texts = [t if t is None else redact(t, scan(t)) for t in batch.column(where).to_pylist()]
            arrays = [*batch.columns]
            arrays[where] = pa.array(texts, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
