"""Personal data, also in disguise: normalised, detected, and mapped back to the characters of the source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Letters and digits that look like ASCII ones. Each is one code point, as is what it stands for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Fullwidth forms lie 0xFEE0 above ASCII.
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
#: Characters without a width.
INVISIBLE = "​‌‍⁠﻿­"
#: Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_TRANSLATE = str.maketrans(HOMOGLYPHS)
_LOOKALIKE = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_DIGIT_WORD = "|".join(DIGITS)
#: Four digits or groups of digits in a row, or more, of which one at least is spelled before the last three; groups before it belong to it.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ \t,-]{{1,3}})?(?:[0-9]{{1,6}}[ \t,-]{{1,3}}){{0,6}}(?:{_DIGIT_WORD})(?:[ \t,-]{{1,3}}(?:{_DIGIT_WORD}|[0-9]{{1,6}})(?![A-Za-z0-9])){{3,}}", re.IGNORECASE)
_SPELLED_ONE = re.compile(rf"plus[ \t,-]+|{_DIGIT_WORD}|[0-9]|[ \t,-]+", re.IGNORECASE)
_HINT_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_DIGIT_WORD})[ \t,-]{{1,3}}(?:{_DIGIT_WORD}|[0-9])(?![A-Za-z0-9])", re.IGNORECASE)
#: at and dot in brackets, or as words between parts of a name that ends in a spelled dot.
_AT = re.compile(r"[ \t]{0,3}(?:\([ \t]?at[ \t]?\)|\[[ \t]?at[ \t]?\]|\{[ \t]?at[ \t]?\}|<[ \t]?at[ \t]?>)[ \t]{0,3}", re.IGNORECASE)
_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]{0,3}(?:\([ \t]?dot[ \t]?\)|\[[ \t]?dot[ \t]?\]|\{[ \t]?dot[ \t]?\}|<[ \t]?dot[ \t]?>|[ \t]dot[ \t])[ \t]{0,3}(?=[A-Za-z0-9])", re.IGNORECASE)
_WORD_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}at[ \t]{1,3}(?=[A-Za-z0-9-]{1,63}\.[A-Za-z0-9])", re.IGNORECASE)
_HINT_AT = re.compile(r"[(\[{<] ?(?:at|dot) ?[)\]}>]|[ \t]dot[ \t]", re.IGNORECASE)

#: The base patterns, anchored so that each runs in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_HINT_IP = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(divmod(2 * int(d), 10)[0] + 2 * int(d) % 10 for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @ with a domain, back over the characters of a local part, but not into the match before."""
    last = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                yield start, m.end()
                last = m.end()


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text) if _HINT_IP.search(text) else ():
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def _spelled(piece: str) -> str:
    """A digit for its word, + for "plus" and what parts it from the digits, a hyphen for any other gap."""
    return "+" if piece[0] in "pP" else DIGITS.get(piece.lower(), piece if piece.isdigit() else "-")


class Transduced:
    """A text as rewritten step by step, with the source span of each of its pieces.

    Only what a step changes is recorded, so that an unchanged text costs nothing: pieces are
    (start in the new text, end, start in the old, end), in order.
    """

    def __init__(self, source: str):
        self.text, self.steps = source, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace non-overlapping spans (start, end, new), in order."""
        if not edits:
            return
        out, pieces, at, size = [], [], 0, 0
        for start, end, new in edits:
            out += self.text[at:start], new
            size += start - at
            pieces.append((size, size + len(new), start, end))
            size, at = size + len(new), end
        out.append(self.text[at:])
        self.text = "".join(out)
        self.steps.append(pieces)

    def source_spans(self, spans: list[Span]) -> list[Span]:
        """The spans of the source that spans of the present text, in order, came from."""
        for pieces in reversed(self.steps):
            back, k = [], 0
            for start, end in spans:
                while k < len(pieces) and pieces[k][1] <= start:
                    k += 1
                j = k
                shift = pieces[k - 1][3] - pieces[k - 1][1] if k else 0
                old_start = pieces[k][2] if k < len(pieces) and pieces[k][0] <= start else start + shift
                while j < len(pieces) and pieces[j][0] < end:
                    j += 1
                if j > k and pieces[j - 1][1] >= end:
                    old_end = pieces[j - 1][3]
                else:
                    old_end = end + (pieces[j - 1][3] - pieces[j - 1][1] if j else 0)
                back.append((old_start, old_end))
            spans = back
        return spans


def transduce(text: str) -> Transduced | None:
    """The text without its disguises, or None if it shows no sign of any."""
    ascii_only = text.isascii()
    lookalike = not ascii_only and _LOOKALIKE.search(text)
    hidden = not ascii_only and _INVISIBLE.search(text)
    spelled, at_dot = _HINT_SPELLED.search(text), _HINT_AT.search(text)
    if not (lookalike or hidden or spelled or at_dot):
        return None
    t = Transduced(text)
    if hidden:
        t.rewrite([(*m.span(), "") for m in _INVISIBLE.finditer(t.text)])
    if lookalike:  # one code point for one: spans stay
        t.text = t.text.translate(_TRANSLATE)
    if spelled or lookalike or hidden:
        t.rewrite([(m.start() + one.start(), m.start() + one.end(), _spelled(one[0])) for m in _SPELLED.finditer(t.text) for one in _SPELLED_ONE.finditer(m[0])])
    if at_dot or lookalike or hidden:
        t.rewrite([(*m.span(), "@") for m in _AT.finditer(t.text)])
        if _HINT_AT.search(t.text):
            t.rewrite([(*m.span(), ".") for m in _DOT.finditer(t.text)])
            t.rewrite([(*m.span(), "@") for m in _WORD_AT.finditer(t.text)])
    return t if t.steps or lookalike else None


def detect(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans by kind, and the further spans that only the normalised text shows.

    A further span is one whose source span meets no base span, of any kind, and no further
    one before it.
    """
    text = text or ""
    base = {kind: list(find(text)) for kind, find in FINDERS.items()}
    more: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if (t := transduce(text)) is not None:
        taken = sorted(s for spans in base.values() for s in spans)
        for kind, find in FINDERS.items():
            more[kind] = _apart(t.source_spans(list(find(t.text))), taken)
            taken = sorted(taken + more[kind])
    return base, more


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    out, k, furthest = [], 0, -1
    for start, end in spans:
        while k < len(taken) and taken[k][0] < end:
            furthest, k = max(furthest, taken[k][1]), k + 1
        if furthest <= start:
            out.append((start, end))
    return out


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found, base) per row of docs. found: all spans (kind, start, end, disguised) by kind, then start.

    Offsets are code points of the source text, the end is exclusive. Base spans are matches of the
    plain patterns; disguised ones are added only where no base span lies. Null texts
    count as empty; repeated rows are searched each; an empty table gives no rows. Each row
    stands alone, so nothing is shuffled and a task holds one batch of texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, more = detect(text.as_py())
                rows.append([{"kind": k, "start": s, "end": e, "disguised": d} for k in KINDS for s, e, d in sorted([(*x, False) for x in base[k]] + [(*x, True) for x in more[k]])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["id", "found"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, found array<struct<kind:string,start:int,end:int,disguised:boolean>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (kind, start, end) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += text[at:start], f"[{kind.upper()}]"
            at = end
    return "".join([*out, text[at:]])
