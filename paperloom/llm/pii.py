"""Personal data in whole texts, also where it is disguised; spans are those of the source.

A disguise is undone by transducers that keep, for every character they put out, where it came
from: look-alike characters become the ones they imitate and invisible ones vanish; runs of
spelled digits become digits; written-out ``at`` and ``dot`` become ``@`` and ``.``. The same
detectors then read the result, and what they find is mapped back to the source's characters.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the known kinds, in order.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Where a run of digits fails from its first one it fails from all, so it is tried once.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``EMAIL`` finds them: read back from each @, so long words are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[Span]:
    """(start, kind, end) of all identifiers by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
                if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                    found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other alphabets and the Latin ones they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ⅼ": "l",
    "․": ".", "。": ".", "‧": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
# The digits' names in the languages of the corpus.
DIGIT_NAMES = [
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "zwo", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
]
_NAMES = {name: str(d) for d, names in enumerate(DIGIT_NAMES) for name in names}
_AT, _DOT, _PLUS = ("at", "arroba", "arobase", "klammeraffe"), ("dot", "punkt", "punto", "point"), ("plus", "más")
#: Spelled or single digits that make a number: as many as the shortest address has.
LEAST_DIGITS = 4


@functools.cache
def _folds() -> dict[str, str]:
    """Characters that imitate an ASCII one, and invisible ones, with what they stand for."""
    folds = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf":
            folds[c] = ""
        elif kind == "Nd":
            folds[c] = str(unicodedata.digit(c))
        elif kind[0] in "LNPSZ":
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and "!" <= plain <= "~":
                folds[c] = plain
    return folds | LOOKALIKES


def _alternatives(words: tuple[str, ...] | list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"


_NAME = _alternatives(list(_NAMES))
_STEP = rf"(?:{_NAME}|[0-9]{{1,4}})"
_JOIN = r"(?:[\s,_/-]{1,3})"
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:{_alternatives(_PLUS)}[\s]+)?{_STEP}(?:(?:{_JOIN}|{_JOIN}{_alternatives(_DOT)}{_JOIN}){_STEP})+(?![^\W_])",
    re.IGNORECASE,
)
_SPELLED_HINT = re.compile(rf"(?<![^\W_]){_NAME}[\s,_/-]{{1,3}}{_STEP}(?![^\W_])", re.IGNORECASE)
_PARTS = re.compile(rf"{_alternatives(_PLUS)}|{_alternatives(_DOT)}|{_STEP}", re.IGNORECASE)
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_WRAPPED_AT = re.compile(rf"\s{{0,3}}{_OPEN}(?:{_alternatives(_AT)}|@){_CLOSE}\s{{0,3}}|(?<=[^\W_])_at_(?=[^\W_])", re.IGNORECASE)
_WRAPPED_DOT = re.compile(rf"\s{{0,3}}{_OPEN}(?:{_alternatives(_DOT)}|\.){_CLOSE}\s{{0,3}}|(?<=[^\W_])_dot_(?=[^\W_])", re.IGNORECASE)
#: ``name at host dot tld``: a bare *at* counts only with a written-out dot behind it.
_BARE = re.compile(
    rf"(?<=[A-Za-z0-9])(\s+{_alternatives(_AT)}\s+|\s*@\s*)[A-Za-z0-9-]+(?:(?:\s+{_alternatives(_DOT)}\s+|\s*\.\s*)[A-Za-z0-9-]+)*?(?:\s+{_alternatives(_DOT)}\s+|\s+\.\s+)[A-Za-z0-9-]+(?:\s+{_alternatives(_DOT)}\s+[A-Za-z0-9-]+)*",
    re.IGNORECASE,
)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\s{1,3}@\s{0,3}|\s{0,3}@\s{1,3})(?=[A-Za-z0-9-]+\.[A-Za-z0-9])")
_BARE_DOT = re.compile(rf"\s+{_alternatives(_DOT)}\s+|\s+\.\s+|\s+\.|\.\s+", re.IGNORECASE)
_HINT = re.compile(rf"{_OPEN}(?:{_alternatives(_AT + _DOT)}|@|\.){_CLOSE}|_(?:at|dot)_|\s@|@\s|\s{_alternatives(_DOT)}\s", re.IGNORECASE)


class Traced:
    """A text, where each of its characters came from, and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str, list[tuple[int, int]] | None]]) -> None:
        """Replace places (start, end, text, own places of its characters) in ascending order."""
        if not edits:
            return
        text, starts, ends, new, at = [], [], [], bytearray(), 0
        for a, b, put, places in edits:
            text.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            new.extend(self.new[at:a])
            text.append(put)
            for i in range(len(put)):
                p, q = places[i] if places else (a, b)
                starts.append(self.starts[p])
                ends.append(self.ends[q - 1])
                new.append(1)
            at = b
        text.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        new.extend(self.new[at:])
        self.text, self.starts, self.ends, self.new = "".join(text), starts, ends, new


def _spelled(text: str) -> list[tuple]:
    edits = []
    for m in _SPELLED.finditer(text):
        put, places, named = [], [], 0
        for p in _PARTS.finditer(text, m.start(), m.end()):
            word = p[0].lower()
            named += word in _NAMES or word in _DOT
            for i, c in enumerate("+" if word in _PLUS else "." if word in _DOT else _NAMES.get(word, word)):
                put.append(c)
                places.append((p.start() + i, p.start() + i + 1) if word.isdigit() else p.span())
        if named and sum(map(str.isdigit, put)) >= LEAST_DIGITS:
            edits.append((m.start(), m.end(), "".join(put), places))
    return edits


def undo(text: str) -> Traced | None:
    """The text without disguises; none if it has no sign of any."""
    odd = not text.isascii() and not _folds().keys().isdisjoint(text)
    if not (odd or _HINT.search(text) or _SPELLED_HINT.search(text)):
        return None
    out = Traced(text)
    if odd:
        folds = _folds()
        out.rewrite([(i, i + 1, folds[c], None) for i, c in enumerate(text) if c in folds])
    out.rewrite(_spelled(out.text))
    out.rewrite([(m.start(), m.end(), ".", None) for m in _WRAPPED_DOT.finditer(out.text)])
    out.rewrite([(m.start(), m.end(), "@", None) for m in _WRAPPED_AT.finditer(out.text)])
    edits = []
    for m in _BARE.finditer(out.text):
        edits.append((*m.span(1), "@", None))
        edits.extend((d.start(), d.end(), ".", None) for d in _BARE_DOT.finditer(out.text, m.end(1), m.end()))
    out.rewrite(edits)
    out.rewrite([(m.start(), m.end(), "@", None) for m in _SPACED_AT.finditer(out.text)])
    return out


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only show once disguises are undone, at their place in the text."""
    clear = undo(text)
    if clear is None:
        return []
    found = []
    for a, kind, b in detect(clear.text):
        if any(clear.new[a:b]) or clear.ends[b - 1] - clear.starts[a] != b - a:
            start, end = clear.starts[a], clear.ends[b - 1]
            if not any(k == kind and s <= start and end <= e for s, k, e in base):
                found.append((start, kind, end))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_pii(documents: DataFrame) -> DataFrame:
    """``doc_id``, counts of each kind, ``base_sha256`` and ``spans`` of every document.

    Counts and hash cover what the patterns find in the text as it stands; ``spans`` also has
    what was disguised, under the same kinds. Null texts count as empty; a text without
    findings has empty ``spans`` and the hash of the empty string. Repeated rows repeat their
    result; other columns are ignored.
    """
    counts = [f"n_{k}" for k in KINDS]
    kind = pa.struct([*((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string())])

    @F.arrow_udf(f"struct<{', '.join(f'{c}: bigint' for c in counts)}, base_sha256: string, spans: string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for value in texts:
                text = value.as_py()
                base = detect(text)
                row: dict[str, object] = {c: sum(k == i for _, k, _ in base) for i, c in enumerate(counts)}
                row["base_sha256"] = hashlib.sha256(listed(base).encode()).hexdigest()
                row["spans"] = listed(base + disguised(text, base))
                rows.append(row)
            yield pa.array(rows, kind)

    found = documents.select("doc_id", scan(F.coalesce("text", F.lit(""))).alias("found"))
    return found.select("doc_id", "found.*")
