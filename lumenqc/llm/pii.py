"""Personal data, also where it is disguised, with offsets into the source.

Identifiers are found in the text as it stands (the base spans).  Then transducers undo disguises: look-alike
and full-width characters, digits spelled as words, and "at" and "dot" written out.  Each step knows which source
characters its output stands for, so identifiers found in the normalised text are mapped back; those that use a
disguise and lie in no base span of their kind are added.  A base span that is a fragment of one stays beside it.

A spaced "at" counts before a domain with a disguised dot, and before a plain one after a local part with a separator
inside ("john.smith at example.com", but then also "sign-up at example.com"; "meet at example.com" is none).  Digit
words count in runs of three, and shorter beside a dot or other digits; both readings are searched.

Special cases: a null text counts as empty; rows are independent, so repeated rows repeat their result; long runs
of digits or of address characters cost time in proportion to their length; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
# The base patterns, in parts that are tried without running back over long runs.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Letters of other scripts that look like Latin ones, as pairs.
LOOK_ALIKES = "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ӏl АA ВB ЕE КK МM НH ОO РP СC ТT ХX αa οo νv ρp τt υu ΑA ΒB ΕE ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ΖZ ı i"
# Digits as words.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def alike() -> dict[int, str]:
    """Full-width ASCII, decimal digits of any script, and the look-alikes: each one character for one."""
    made = {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
    made |= {c: str(unicodedata.decimal(chr(c))) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}
    made |= {ord(pair[0]): pair[1] for pair in LOOK_ALIKES.split() if len(pair) == 2}
    return made | {0xFE52: ".", 0x3002: ".", 0xFF61: ".", 0xFE6B: "@", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0xA0: " ", 0x202F: " ", 0x2009: " "}


ALIKE = alike()
DISGUISED = re.compile("[" + "".join(map(re.escape, map(chr, ALIKE))) + "]")
WORD = "|".join(SPELLED)
RUN = rf"(?<![A-Za-z0-9])(?:plus[\x20-]+)?(?:{WORD})(?:[\x20,.-]{{1,2}}(?:{WORD})){{2,}}(?![A-Za-z0-9])"
ANY_RUN = rf"(?<![A-Za-z0-9])(?:plus[\x20-]+)?(?:{WORD})(?:[\x20,-]{{1,2}}(?:{WORD}))*(?![A-Za-z0-9])"  # a full stop stays one
OPEN, CLOSE = r"\x20?[\(\[\{<]\x20?", r"\x20?[\)\]\}>]\x20?"
DOT = rf"(?:{OPEN}(?:dot|\.){CLOSE}|\x20dot\x20)"
PLAIN_AT = rf"\x20at\x20(?=(?:[A-Za-z0-9-]++\.)*+[A-Za-z0-9-]++{DOT}[A-Za-z0-9])"
MAYBE_AT = r"(?<=[A-Za-z0-9])\x20at\x20(?=(?:[A-Za-z0-9-]++\.)+[A-Za-z])"  # counts after a separated local part
REST = rf"(?P<at>{OPEN}(?:at|@){CLOSE}|{PLAIN_AT})|(?P<maybe>{MAYBE_AT})|(?P<dot>(?<=[A-Za-z0-9]){DOT}(?=[A-Za-z0-9]))"
REWRITES = re.compile(rf"(?P<run>{RUN})|{REST}", re.IGNORECASE | re.ASCII)
SHORT_TOO = re.compile(rf"(?P<run>{ANY_RUN})|{REST}", re.IGNORECASE | re.ASCII)
SEPARATED = re.compile(r"[A-Za-z0-9][._%+-]+[A-Za-z0-9]+\Z")
# What a run of one or two words must stand beside.
BEFORE = re.compile(rf"(?:[0-9][\x20,.-]{{1,2}}|(?:{WORD})\.)\Z", re.IGNORECASE | re.ASCII)
BEHIND = re.compile(rf"[\x20,.-]{{1,2}}[0-9]|\.(?:{WORD})(?![A-Za-z0-9])|{DOT}[A-Za-z0-9]", re.IGNORECASE | re.ASCII)
# Quick tests before the expressions: each finds all that they can match.
BRACKETS = re.compile(r"[\(\[\{<]\x20?(?:at|@|dot|\.)\x20?[\)\]\}>]")
MIDDLE = re.compile(rf"[\x20,.-](?:{WORD})[\x20,.-]{{1,2}}(?:{WORD})", re.IGNORECASE | re.ASCII)  # of any run
ENDS = "|".join(rf"(?<={word}[\x20,.-])" for word in SPELLED)
BESIDE = re.compile(rf"[0-9][\x20,.-]{{1,2}}(?:{WORD})|\.(?:{WORD})|plus[\x20-]+(?:{WORD})|[\x20,.-](?=[\x20,.-]?[0-9])(?:{ENDS})")
RUN_PARTS = re.compile(rf"plus|{WORD}", re.IGNORECASE | re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Before an @ the match can start only at the first of the address characters that run up to it."""
    past, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > past and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                past = m.end()
        at = text.find("@", max(at + 1, past))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """A run of dotted numbers holds a match for each four of them."""
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(a, b, kind) for kind, find in FINDERS.items() for a, b in find(text)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


class Normalised:
    """A text after the transducers; ``segments`` are (place, length, source place, source length), in order.

    ``short``: runs of one or two spelled digits count too, beside other digits or full stops.
    """

    def __init__(self, source: str, short: bool = False) -> None:
        plain = source if source.isascii() else source.translate(ALIKE)
        self.source, self.plain = source, plain
        out, self.segments, self.at, past, dotted = [], [], 0, 0, False

        def emit(text: str, a: int, b: int) -> None:
            out.append(text)
            self.segments.append((self.at, len(text), a, b - a))
            self.at += len(text)

        for m in (SHORT_TOO if short else REWRITES).finditer(plain) if short or rewritable(plain) else ():
            if m["maybe"] and not separated(plain, past, m.start(), dotted):
                continue
            if short and m["run"] and not (dotted and past == m.start() or counts(plain, m)):
                continue
            emit(plain[past : m.start()], past, m.start())
            past, dotted = m.end(), bool(m["dot"])
            if m["run"]:
                for w in RUN_PARTS.finditer(m["run"]):
                    word = w[0].lower()
                    emit(SPELLED.get(word, "+"), m.start() + w.start(), m.start() + w.end())
            else:
                emit("." if m["dot"] else "@", m.start(), m.end())
        emit(plain[past:], past, len(plain))
        self.text = "".join(out)
        self.starts = [s[0] for s in self.segments]

    def back(self, a: int, b: int) -> tuple[int, int, bool]:
        """The source span of text[a:b], and whether it was disguised."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        (p, n, s, m), (q, k, t, l) = self.segments[i], self.segments[j]
        start, end = (s if n != m else s + a - p), (t + l if k != l else t + b - q)
        return start, end, self.text[a:b] != self.source[start:end]


def separated(text: str, past: int, end: int, dotted: bool) -> bool:
    """Whether the address characters that run up to ``end`` have a separator inside, be it a dot undone at ``past``."""
    start = end
    while start > past and text[start - 1] in LOCAL:
        start -= 1
    return dotted and start == past or bool(SEPARATED.search(text, start, end))


def counts(text: str, m: re.Match) -> bool:
    """Whether a run has three digits, starts with plus, or stands beside other digits or full stops."""
    words = RUN_PARTS.findall(m["run"])
    return len(words) > 2 or words[0].lower() == "plus" or bool(BEFORE.search(text, max(0, m.start() - 8), m.start()) or BEHIND.match(text, m.end()))


def dotted(low: str) -> bool:
    return " dot " in low or bool(BRACKETS.search(low))


def rewritable(text: str) -> bool:
    """Whether anything to rewrite can be in the text at all."""
    low = text.lower()
    return " at " in low or dotted(low) or bool(MIDDLE.search(text))


def shortened(text: str) -> bool:
    """Whether a short run can be in the text at all."""
    low = text.lower()
    return dotted(low) or bool(BESIDE.search(low))


def readings(text: str) -> Iterator[Normalised]:
    """The text normalised, without and with short runs: these can also lengthen an identifier beyond what it may be."""
    disguised = not text.isascii() and DISGUISED.search(text)
    if disguised or rewritable(text):
        yield Normalised(text)
    if shortened(text.translate(ALIKE) if disguised else text):
        yield Normalised(text, short=True)


def spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans and those that were disguised and don't lie within a base span of their kind."""
    found, starts = set(), {k: [x for x, _, of in base if of == k] for k in KINDS}
    ends = {k: [y for _, y, of in base if of == k] for k in KINDS}

    def within(start: int, end: int, kind: str) -> bool:
        """Spans of a kind don't overlap, so only the last one that begins so early can hold it."""
        at = bisect_right(starts[kind], start) - 1
        return at >= 0 and end <= ends[kind][at]

    for normal in readings(text):
        if normal.text == text:
            continue
        for a, b, kind in base_spans(normal.text):
            start, end, changed = normal.back(a, b)
            if changed and not within(start, end, kind):
                found.add((start, end, kind))
    return sorted({*base, *found}, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if found else base


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = list(map(base_spans, texts))
            counts = [pa.array([sum(s[2] == k for s in r) for r in base], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string())
            every = pa.array([joined(spans(t, r)) for t, r in zip(texts, base, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, every], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
