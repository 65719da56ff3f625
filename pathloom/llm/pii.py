"""Personal data behind disguises, with spans in source characters.

A chain of transducers rewrites a text and remembers for every rewritten character which source characters it came
from: look-alike letters and digits become ASCII, invisible characters go, spelled digits become digits, and the
usual covers of ``@`` and ``.`` come off. The detectors run on the plain text and on the rewritten one; spans of the
second are mapped back and added where the plain text showed nothing of that kind.

Defined results: a null text is empty; rows come back one for one; a disguise counts only if what it hides passes
the same test as plain data.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

from pyspark.sql import DataFrame

from pathloom.llm.common import map_texts, span_type

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plain identifiers, leftmost and non-overlapping per kind."""
    found = []
    if "@" in text:
        floor = 0  # what is local to an address cannot reach back over an earlier @ or match
        for m in _DOMAIN.finditer(text):
            at = m.start()
            floor = max(floor, text.rfind("@", floor, at) + 1)
            start = floor + len(text[floor:at].rstrip(_LOCAL))
            if start < at:
                found.append(("email", start, m.end()))
                floor = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


# Cyrillic and Greek letters that look like ASCII ones, each with its look-alike.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "α": "a", "ο": "o", "ρ": "p", "ν": "v",
    "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
_HIDDEN = "­​‌‍⁠﻿"
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
            "seven": "7", "eight": "8", "nine": "9"}
# the other languages of the corpus: German, French, Spanish
_SPELLED |= {w: str(n) for words in (
    "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve") for n, w in enumerate(words.split())}
_SPELLED |= {"zwo": "2", "fuenf": "5"}


def _alike() -> dict[str, str]:
    table = dict(_ALIKE) | {c: "" for c in _HIDDEN}
    table |= {chr(0xFEE0 + i): chr(i) for i in range(0x21, 0x7F)}  # full-width forms of ASCII
    table |= {c: str(unicodedata.digit(c)) for c in map(chr, range(0x80, 0x20000))
              if unicodedata.category(c) == "Nd"}  # digits of other scripts
    return table


ALIKE = _alike()
_ALIKE_RUN = re.compile("[" + "".join(map(re.escape, ALIKE)) + "]+")
_ONE = rf"(?<![^\W\d_])(?:{'|'.join(_SPELLED)})(?![^\W\d_])"
_GAP = r"[\s,-]{0,3}"
_SOME_SPELLED = re.compile(rf"{_ONE}{_GAP}(?:{_ONE}|[0-9])|(?<=[0-9]){_GAP}{_ONE}")
_SPELLED_RUN = re.compile(rf"(?:{_ONE}|[0-9]++)(?:{_GAP}(?:{_ONE}|[0-9]++))+", re.I)
_RUN_PART = re.compile(rf"{_ONE}|[0-9]++", re.I)
_PLUS = re.compile(r"\b(?:plus|más)\s(?=[0-9])", re.I)
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|(?<=[A-Za-z0-9_%+-])\sat\s(?!(?:the|an?|this|that|my|your|our)\s)"
                 r"(?=[A-Za-z0-9-]{1,63}(?:\sdot\s|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]))", re.I)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|(?<=[A-Za-z0-9-])\sdot\s(?=[A-Za-z0-9])", re.I)


class Trace:
    """A rewritten text that knows where in the source each piece came from.

    ``cuts[i]`` is where piece i begins in the text, ``source[i]`` the source span it stands for and ``same[i]``
    whether it stands there unchanged.
    """

    def __init__(self, text: str):
        self.text, self.cuts, self.source, self.same = text, [0], [(0, len(text))], [True]
        self.changed = False

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source span of text[start:end], of one character at least."""
        i, j = (bisect.bisect_right(self.cuts, x) - 1 for x in (start, end - 1))
        first = self.source[i][0] + (start - self.cuts[i] if self.same[i] else 0)
        last = self.source[j][0] + (end - self.cuts[j]) if self.same[j] else self.source[j][1]
        return first, last

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the text, in order, by other strings of at most one piece each."""
        if not edits:
            return
        pieces, at = [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            while at < start:  # what stays keeps its pieces
                i = bisect.bisect_right(self.cuts, at) - 1
                stop = min(start, self.cuts[i + 1] if i + 1 < len(self.cuts) else len(self.text))
                pieces.append((self.text[at:stop], self.back(at, stop), self.same[i]))
                at = stop
            if start < end and new:
                pieces.append((new, self.back(start, end), False))
            at = end
        self.text = "".join(p[0] for p in pieces)
        self.cuts, n = [], 0
        for p in pieces:
            self.cuts.append(n)
            n += len(p[0])
        self.source, self.same, self.changed = [p[1] for p in pieces], [p[2] for p in pieces], True


def _digits(text: str) -> list[tuple[int, int, str]]:
    """Edits that write out the spelled digits of each run; the gaps beside them go, those between written ones stay."""
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        at = run.start()  # end of what came before in the run
        ended = False  # whether that was a spelled digit
        for m in _RUN_PART.finditer(text, run.start(), run.end()):
            spelled = not m[0].isdigit()
            if spelled:  # re.I also takes the long s and the dotted and dotless i of other alphabets
                word = m[0].casefold().replace("ı", "i").replace("\u0307", "")
                edits.append((at, m.end(), _SPELLED[word]))
            elif ended and at < m.start():
                edits.append((at, m.start(), ""))
            at, ended = m.end(), spelled
    return edits


def deobfuscate(text: str) -> Trace | None:
    """The rewritten text, or None where no transducer has anything to do."""
    trace = Trace(text)
    if not text.isascii() and _ALIKE_RUN.search(text):
        trace.rewrite([(m.start() + i, m.start() + i + 1, ALIKE[c]) for m in _ALIKE_RUN.finditer(text)
                       for i, c in enumerate(m[0])])
    low = trace.text.lower()
    if _SOME_SPELLED.search(low):
        trace.rewrite(_digits(trace.text))
        trace.rewrite([(*m.span(), "+") for m in _PLUS.finditer(trace.text)])
    if "dot" in low or "(at" in low or "[at" in low or re.search(r"[\[({<]\s?(?:at|[@.])\s?[\])}>]", low):
        trace.rewrite([(*m.span(), "@") for m in _AT.finditer(trace.text)])
        trace.rewrite([(*m.span(), ".") for m in _DOT.finditer(trace.text)])
    return trace if trace.changed else None


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) sorted by start, then kind; disguised ones only where no plain one overlaps."""
    plain = detect(text)
    found = [(*s, True) for s in plain]
    if (trace := deobfuscate(text)) is not None:
        for kind, start, end in detect(trace.text):
            a, b = trace.back(start, end)
            if not any(k == kind and s < b and a < e for k, s, e in plain):
                found.append((kind, a, b, False))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_pii(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the sorted ``spans`` of each whole text."""

    def make():
        import pyarrow as pa

        names = ("kind", "start", "end", "base")
        return lambda texts: [pa.array([[dict(zip(names, s)) for s in find(t.as_py())] for t in texts], span_type())]

    return map_texts(docs, text_col, "spans array<struct<kind:string,start:int,end:int,base:boolean>>", make, keep)


def mask(text: str) -> str:
    """The text with every identifier replaced by its kind in angle brackets; of overlapping ones the first stays."""
    out, at = [], 0
    for kind, start, end, _ in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        elif end > at:  # overlaps what is masked already: its rest goes too
            at = end
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with masked texts; null stays null and all other columns stay as they are."""
    from pyspark.sql import functions as F

    def make():
        import pyarrow as pa

        return lambda texts: [pa.array([mask(t.as_py()) for t in texts], pa.string())]

    others = [c for c in docs.columns if c != text_col]
    kept = docs.select(*others, F.col(text_col), F.col(text_col).isNull().alias("__null"))
    out = map_texts(kept, text_col, "__masked string", make, [*others, "__null"])
    return out.select(*[F.when(~F.col("__null"), F.col("__masked")).alias(c) if c == text_col else F.col(f"`{c}`")
                        for c in docs.columns])
