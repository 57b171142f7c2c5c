"""Personal data: offset-preserving deobfuscation before detection.

Each text is searched twice. The base detectors read it as it is. Then a cascade of transducers rewrites it, keeping for every
output character the span of source characters it stands for: homoglyphs and full-width forms become ASCII, invisible
characters vanish, character references of @ and '.' are read, spelled digits become digits, letters and signs inside numbers become what they
stand for, and at/dot disguises become @ and '.'. The same detectors read the rewritten
text, and their spans are mapped back to the source. A mapped span is added if the transducers changed something inside it and the spans of its
kind that it meets are parts of it (a base detector may find the undisguised part of an address); base spans always stay. A bare "at" before plain dots is read as a sign only after a name
with an inner dot, underscore or plus: `jane at example.com` has no span, since prose says "see us at example.com" ("arroba" is always read).

Defined results: null and empty texts have no spans; repeated rows are separate rows; other columns are ignored; rows of a
null doc_id are kept. Texts are read whole. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, mapped, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Characters that look like ASCII ones, and what they look like.
LOOKALIKES = {
    c: plain
    for plain, alike in {
        "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
        "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іιıⅰ", "j": "ј", "k": "кκ", "l": "ⅼӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ",
        "w": "ԝ", "x": "хχ", "y": "уγ", "3": "З",
        ".": "․﹒。｡∙", ",": "‚", "@": "＠﹫", "-": "–—‐‑‒−﹣－",
    }.items()
    for c in alike
}
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = frozenset("­​‌‍⁠﻿")

_NUMERAL = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_BLANK_DOT = r"[\x20\t]+(?:dot|punkt|punto|point)[\x20\t]+"
#: A digit, or numerals written together ("sixtwo") that end where the word ends.
_UNIT = rf"(?:(?:{_NUMERAL})+(?![^\W\d_])|[0-9])"
#: Three or more of them in a row (digits may stand among them), so that a lone "one" stays a word.
SPELLED = re.compile(rf"(?<![^\W\d_]){_UNIT}(?:(?:[\x20.,()+-]{{0,3}}|{_BLANK_DOT}){_UNIT})" r"{2,}", re.I)
TOKEN = re.compile(rf"{_NUMERAL}|[0-9]", re.I)
#: An address with a spelled at: bracketed anywhere, or bare where a spelled dot and a label follow. With plain dots only, "at" is mostly a
#: word ("see us at example.com"); it is read as a sign after a name with an inner dot, underscore or plus, "arroba" after any.
AT = re.compile(r"(?<![\x20\t])[\x20\t]*+[\[({<]\s*(?:at|ät|arroba|chez|@)\s*[\])}>][\x20\t]*", re.I)
DOT = re.compile(r"(?<![\x20\t])[\x20\t]*+[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>][\x20\t]*", re.I)
BARE = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)([\x20\t]+(?:at|arroba)[\x20\t]+|[\x20\t]*@[\x20\t]*)([A-Za-z0-9-]+(?:(?:[\x20\t]+(?:dot|punkt|punto|point)[\x20\t]+|\.)[A-Za-z0-9-]+)+)", re.I)
NUMBER_DOT = re.compile(r"(?<=[0-9])[\x20\t]+(?:dot|punkt|punto|point)[\x20\t]+(?=[0-9])", re.I)
BARE_DOT = re.compile(r"(?<![\x20\t])[\x20\t]++(?:dot|punkt|punto|point)[\x20\t]+", re.I)

#: Character references and escapes of @ and '.'; words joined by hyphens or underscores; blanks around a sign between digits; groups of a card's
#: digits with other signs between them; letters that stand for digits inside a card's number; a spelled plus before digits.
REFERENCE = re.compile(r"&(?:#0*64|#x0*40|commat);|%40|&(?:#0*46|#x0*2e|period);", re.I)
JOINED = re.compile(r"(?<![A-Za-z0-9%+])(?<![A-Za-z0-9%+][-_.])[A-Za-z0-9%+]++(?:[-_.](?!at[-_])[A-Za-z0-9%+]++)*+([-_]at[-_])[A-Za-z0-9]++(?:[-_]dot[-_][A-Za-z0-9]++)+", re.I)
JOINED_DOT = re.compile(r"[-_]dot[-_]", re.I)
APART = re.compile(r"(?<=[0-9])[\x20\t]+([.-])[\x20\t]+(?=[0-9])")
GROUPS = re.compile(r"(?<![0-9.])[0-9]{4}([._/·•])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9.])")
MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[\x20-]?[0-9OoIl]){12,22}(?![A-Za-z0-9])")
PLUS = re.compile(r"(?<![^\W\d_])plus[\x20]+(?=[0-9][\x20().0-9-]{7,}[0-9])", re.I)
OPEN_PLUS = re.compile(r"\+[\x20]+(?=[0-9][\x20().0-9-]{7,}[0-9])")
#: "jane @ example . com"
WIDE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++([\x20\t]+@[\x20\t]+)[A-Za-z0-9-]+(?:[\x20\t]+\.[\x20\t]+[a-z0-9-]+)+(?![A-Za-z0-9])")
WIDE_DOT = re.compile(r"(?<![\x20\t])[\x20\t]++\.[\x20\t]+")

#: A text that none of these finds is its own normal form.
BRACKETED = re.compile(r"[\[({<]\s*(?:at|ät|arroba|chez|@|dot|punkt|punto|point|\.)\s*[\])}>]", re.I)
SPACED_AT = re.compile(r"[\x20\t]@|@[\x20\t]")
PLAIN_AT = re.compile(r"[\x20\t](?:at|arroba)[\x20\t]+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2}", re.I)
NAME = re.compile(r"[A-Za-z0-9%-]+(?:[._+][A-Za-z0-9%-]+)+")
DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}")
SPOKEN_DOT = re.compile(r"[\x20\t](?:dot|punkt|punto|point)[\x20\t]", re.I)
UNUSUAL = re.compile(r"[^\x00-\x7FÀ-İĲ-ɏ]")
#: A numeral before a separator and a digit or numeral. It begins at the separator's right, where few places fit.
SPELLED_TRIGGER = re.compile(rf"[\x20.,()+-](?:(?:{_NUMERAL})+(?![^\W\d_])|[0-9])", re.I)
JOINED_AT = re.compile(r"[-_]at[-_]", re.I)
#: What APART, GROUPS and MIXED begin with.
DIGIT_SIGN = re.compile(r"[0-9](?:[\x20\t]+[.-][\x20\t]|[._/·•][0-9]{4}|[\x20-]?[OoIl])")
PLUS_DIGIT = re.compile(r"plus\x20+[0-9]", re.I)


def disguised(text: str) -> bool:
    return bool(
        UNUSUAL.search(text)
        or BRACKETED.search(text)
        or "@" in text and SPACED_AT.search(text)
        or SPOKEN_DOT.search(text)
        or PLAIN_AT.search(text)
        or ("&" in text or "%" in text) and REFERENCE.search(text)
        or JOINED_AT.search(text)
        or DIGIT_SIGN.search(text) and (APART.search(text) or GROUPS.search(text) or MIXED.search(text))
        or PLUS_DIGIT.search(text)
        or SPELLED_TRIGGER.search(text) and SPELLED.search(text)
    )


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    """What EMAIL.finditer finds, without trying it inside every word."""
    at, start = text.find("@"), 0
    while at >= 0:
        i = at
        while i > start and text[i - 1] in LOCAL:
            i -= 1
        m = EMAIL.match(text, i) if i < at else None
        if m:
            yield m.span()
            start = m.end()
        at = text.find("@", max(at + 1, start))


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, leftmost and without overlap."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))] if DOTTED.search(text) else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


DOTTED = re.compile(r"[0-9]\.[0-9]")


class Tape:
    """A text and, for each of its characters, the source span it came from."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.changed: list[tuple[int, int]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (from, to, output), in order and without overlap; the output stands for the whole of from..to."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for i, j, put in edits:
            text.append(self.text[at:i]), start.extend(self.start[at:i]), end.extend(self.end[at:i])
            a, b = self.start[i], self.end[j - 1]
            text.append(put), start.extend([a] * len(put)), end.extend([b] * len(put))
            self.changed.append((a, b))
            at = j
        text.append(self.text[at:]), start.extend(self.start[at:]), end.extend(self.end[at:])
        self.text, self.start, self.end = "".join(text), start, end


def _look(c: str) -> str | None:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if " " <= c <= " " or c in "  　":
        return " "
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain != c and plain.isascii():
        return plain
    if c.isdecimal() and not c.isascii():
        return str(unicodedata.decimal(c))
    return None



def normalise(text: str) -> Tape:
    """The cascade: characters, references, spelled digits, signs between digits, then at and dot."""
    tape = Tape(text)
    tape.rewrite([(m.start(), m.end(), put) for m in UNUSUAL.finditer(tape.text) if (put := _look(m[0])) is not None])
    tape.rewrite([(m.start(), m.end(), "@" if re.search("64|40|commat", m[0]) else ".") for m in REFERENCE.finditer(tape.text)])
    edits = []
    for m in SPELLED.finditer(tape.text):
        tokens = list(TOKEN.finditer(tape.text, m.start(), m.end()))
        if not any(t[0].isalpha() for t in tokens):
            continue
        for t, following in zip(tokens, [*tokens[1:], None]):
            # Blanks and commas beside a spelled digit vanish with it: "four, 1 one" reads 411.
            gap = following and (t[0].isalpha() or following[0].isalpha()) and not tape.text[t.end() : following.start()].strip(" ,")
            if t[0].isalpha() or gap and following.start() > t.end():
                edits.append((t.start(), following.start() if gap else t.end(), DIGIT_WORDS.get(t[0].lower(), t[0])))
    spelled = bool(edits)
    tape.rewrite(edits)
    tape.rewrite([(m.start(), m.end(), "+") for m in PLUS.finditer(tape.text)])
    if spelled:
        tape.rewrite([(m.start(), m.end(), "+") for m in OPEN_PLUS.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), m[1]) for m in APART.finditer(tape.text)])
    tape.rewrite([(m.start() + k, m.start() + k + 1, "-") for m in GROUPS.finditer(tape.text) for k in (4, 9, 14)])
    tape.rewrite([(m.start() + k, m.start() + k + 1, "0" if c in "Oo" else "1") for m in MIXED.finditer(tape.text) if sum(c.isdigit() for c in m[0]) >= 9 for k, c in enumerate(m[0]) if c in "OoIl"])
    tape.rewrite([(m.start(), m.end(), "@") for m in AT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in DOT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(tape.text)])
    for whole, dot in ((JOINED, JOINED_DOT), (WIDE, WIDE_DOT)):
        edits = []
        for m in whole.finditer(tape.text):
            edits += [(d.start(), d.end(), ".") for d in dot.finditer(tape.text, m.start(), m.start(1))]
            edits.append((*m.span(1), "@"))
            edits += [(d.start(), d.end(), ".") for d in dot.finditer(tape.text, m.end(1), m.end())]
        tape.rewrite(edits)
    edits = []
    for m in BARE.finditer(tape.text):
        spelled = not m[2].strip().startswith("@")
        dots = [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in BARE_DOT.finditer(m[3])]
        plain = DOMAIN.fullmatch(m[3]) and (m[2].strip().lower() == "arroba" or NAME.fullmatch(m[1]))
        if dots or not spelled and m[2] != "@" or spelled and plain:  # "at" alone is a word; a spelled dot or such a name shows the disguise
            edits.append((m.start(2), m.end(2), "@"))
            edits += dots
    tape.rewrite(edits)
    return tape


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base spans, and all spans: base ones and those that only the normal form shows."""
    base = detect(text)
    if not disguised(text):
        return base, base
    tape = normalise(text)
    if not tape.changed:
        return base, base
    changed = sorted(tape.changed)
    firsts = [a for a, _ in changed]
    every = {}
    for kind, found in detect(tape.text).items():
        have = sorted(base[kind])
        for i, j in found:
            a, b = min(tape.start[i:j]), max(tape.end[i:j])
            k = bisect_left(firsts, a)
            touched = k < len(changed) and changed[k][0] < b or k > 0 and changed[k - 1][1] > a
            n = bisect_left(have, (a, b))
            met = [s for s in have[max(0, n - 1) : bisect_left(have, (b, b))] if s[0] < b and s[1] > a]
            # A base span grows only where the text goes on without a blank: "555-1373 Un" is a number and a word.
            grows = lambda x, y: a <= x and y <= b and (x, y) != (a, b) and (x == a or not text[x - 1].isspace()) and (y == b or not text[y].isspace())
            if touched and all(grows(x, y) for x, y in met):
                have.insert(n, (a, b))
        every[kind] = have
    return base, every


def line(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


SPANS = pa.schema([("doc_id", pa.int64()), *((f"{w}_{k}", pa.list_(pa.int64())) for w in ("base", "all") for k in KINDS)])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, base_<kind> and all_<kind>: starts and ends in turn."""

    def run(batches):
        for b in slices(batches):
            columns = {n: [] for n in SPANS.names}
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, every = spans(text or "")
                columns["doc_id"].append(i)
                for k in KINDS:
                    columns[f"base_{k}"].append([x for s in base[k] for x in s])
                    columns[f"all_{k}"].append([x for s in every[k] for x in s])
            yield batch(SPANS, **columns)

    schema = "doc_id long, " + ", ".join(f"{w}_{k} array<long>" for w in ("base", "all") for k in KINDS)
    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, schema)


def redact_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first kind listed."""
    _, every = spans(text)
    merged: list[list] = []
    for a, n, b in sorted((a, n, b) for n, k in enumerate(KINDS) for a, b in every[k]):
        if merged and a < merged[-1][1]:
            merged[-1][1], merged[-1][2] = max(merged[-1][1], b), min(merged[-1][2], n)
        else:
            merged.append([a, b, n])
    if not merged:
        return text
    out, at = [], 0
    for a, b, n in merged:
        out += [text[at:a], f"[{KINDS[n].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in `text` replaced; all columns and rows stay, null texts stay null."""
    schema = docs.schema

    def run(batches):
        for b in slices(batches, text=text):
            at = b.schema.get_field_index(text)
            new = [t and redact_text(t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return mapped(docs, run, schema)
