"""Personal data in texts, disguised or not, with spans in the source.

Plain identifiers are matched in the text as it is. A transducer then writes a normalised copy in
which homoglyphs are Latin letters, spelled digits are digits and at/dot disguises are signs; each
of its characters keeps the span of source characters it stands for, so identifiers found there map
back to spans of the source. Spans are code points, end exclusive.

Defined results: a null or empty text has no spans; a null id stays null; repeated rows give repeated
results; equal spans of two tapes count once; a text of any length is scanned whole, in time in
proportion to it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")
# A match never starts inside a run of digits, so that the scan of a long run stays linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")

# Letters and signs that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "ı": "i", "ɡ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
# Full-width forms and the digits of other scripts follow a rule.
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
HOMOGLYPHS |= {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966) for d in range(10)}
# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: Characters that are written and read as nothing.
INVISIBLE = "​‌‍⁠﻿­"
_ODD = re.compile("[" + "".join(map(re.escape, [*HOMOGLYPHS, *INVISIBLE])) + "]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPOKEN = re.compile(rf"(?:\bplus\s+)?\b(?:{_WORD}|[0-9]+)(?:[\s,.-]{{1,3}}(?:{_WORD}|[0-9]+))+\b", re.I)
#: The same across parentheses, as phone numbers have them.
_BRACKETED = re.compile(rf"(?:\bplus[\s(]+)?\b(?:{_WORD}|[0-9]+)(?:[\s,.()-]{{1,3}}(?:{_WORD}|[0-9]+))+\b", re.I)
_SPOKEN_WORD = re.compile(rf"\b(?:{_WORD})\b", re.I)
_SPOKEN_ANY = re.compile(rf"\b(?:plus|{_WORD})\b", re.I)
_TOKEN = re.compile(rf"plus|{_WORD}|[0-9]+", re.I)
#: Spaces before a marker are taken by _signs; a pattern that starts with them would try each space of a long run.
_MARKED = re.compile(r"(?:\[[ ]*(at|dot|@|\.)[ ]*\]|\([ ]*(at|dot|@|\.)[ ]*\)|\{[ ]*(at|dot|@|\.)[ ]*\}|<[ ]*(at|dot|@|\.)[ ]*>|(?<=[ ])(at)(?=[ ]+[A-Za-z0-9-]+[ ]+dot[ ])|(?<=[ ])(dot)(?=[ ])|(?<=[ ])(@)(?=[ ]))[ ]*", re.I)
_HINT = re.compile(r"[\[({<] *(?:at|dot|@|\.) *[\])}>]|\bdot\b| @ ", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def plain(text: str) -> list[Span]:
    """Identifiers that stand undisguised: leftmost, non-overlapping per kind; matches that fail a check are dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tape:
    """A normalised text; starts[i] and ends[i] tell which source characters its i-th stands for."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None):
        self.text = text
        self.starts = array("q", range(len(text))) if starts is None else starts
        self.ends = array("q", range(1, len(text) + 1)) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replaces [start, end) by a string, for edits in order; each new character stands for all that it replaced."""
        text, starts, ends, at = [], array("q"), array("q"), 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            starts += self.starts[at:s] + self.starts[s : s + 1] * len(new)
            ends += self.ends[at:s] + self.ends[e - 1 : e] * len(new)
            at = e
        return Tape("".join([*text, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:])


def _glyphs(tape: Tape) -> Tape:
    return tape.rewrite([(*m.span(), HOMOGLYPHS.get(m[0], "")) for m in _ODD.finditer(tape.text)])


def _digits(tape: Tape, runs: re.Pattern, words: re.Pattern, least: int) -> Tape:
    """Runs that hold at least so many of ``words``, with digits among them, become digits; separators in a run vanish."""
    edits = []
    for m in runs.finditer(tape.text):
        if len(words.findall(m[0])) < least:
            continue
        at = None
        for t in _TOKEN.finditer(tape.text, *m.span()):
            if at is not None and t.start() > at:
                gap = tape.text[at : t.start()].strip()
                edits.append((at, t.start(), "." if gap == "." else ""))
            word = t[0].lower()
            if not word[0].isdigit():
                edits.append((*t.span(), "+" if word == "plus" else SPELLED[word]))
            at = t.end()
    return tape.rewrite(edits)


def _signs(tape: Tape) -> Tape:
    edits, done = [], 0
    for m in _MARKED.finditer(tape.text):
        sign, start = next(g for g in m.groups() if g).lower(), m.start()
        while start > done and tape.text[start - 1] == " ":
            start -= 1
        done = m.end()
        edits.append((start, done, {"at": "@", "dot": "."}.get(sign, sign)))
    return tape.rewrite(edits)


def normalised(text: str) -> list[Tape]:
    """What the transducers make of a text, where it differs: only the runs that are plainly spelled, then all that hold a spelled digit or sign, then those across parentheses.

    A number may stand beside an ordinary "one", so the later ones add to the earlier ones.
    """
    base = Tape(text) if not _ODD.search(text) else _glyphs(Tape(text))
    tapes = [base]
    if _SPOKEN_ANY.search(base.text):
        tapes = [_digits(base, *how) for how in ((_SPOKEN, _SPOKEN_WORD, 3), (_SPOKEN, _SPOKEN_ANY, 1), (_BRACKETED, _SPOKEN_ANY, 1))]
    if _HINT.search(base.text):
        tapes = [_signs(t) for t in tapes]
    seen = {text}
    return [t for t in tapes if not (t.text in seen or seen.add(t.text))]


def detect(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), each by start, then kind. A disguised one that overlaps a plain one of its kind, or one of an earlier tape, is left out."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(plain(text), key=order)
    more: list[Span] = []
    # Spans of a kind never overlap, so a new one needs to be held against its neighbours alone.
    taken = {kind: [(s, e) for k, s, e in base if k == kind] for kind in KINDS}
    for tape in normalised(text):
        for kind, a, b in plain(tape.text):
            s, e, had = tape.starts[a], tape.ends[b - 1], taken[kind]
            at = bisect.bisect_left(had, (s, e))
            if (at == 0 or had[at - 1][1] <= s) and (at == len(had) or had[at][0] >= e):
                had.insert(at, (s, e))
                more.append((kind, s, e))
    return base, sorted(base + more, key=order)


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count per kind and base_sha256 of the plain spans, spans (all) and n_disguised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, texts in common.by_text(batches):
            out = {k: [] for k in ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised")}
            for doc, text in zip(ids, texts):
                base, every = detect(text)
                out["doc_id"].append(doc)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(b[0] == k for b in base))
                out["base_sha256"].append(hashlib.sha256(_said(base).encode()).hexdigest())
                out["spans"].append(_said(every))
                out["n_disguised"].append(len(every) - len(base))
            yield out

    return common.map_batches(common.texts(docs, id_col, text_col), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def mask(text: str, sign: str = "#") -> str:
    """``text`` with every character of a span, spaces too, replaced."""
    chars = list(text)
    for _, s, e in detect(text)[1]:
        chars[s:e] = sign * (e - s)
    return "".join(chars)
