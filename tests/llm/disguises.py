"""Generated personal data in disguise: FORMS has, for each kind, functions from a random generator to a disguised value."""

from cairnframe.llm.pii import luhn

ALIKE = {"a": "аα", "e": "е", "o": "оο", "c": "с", "p": "р", "i": "і", "x": "х", "s": "ѕ", "y": "у", "j": "ј"}
NUMERALS = {
    "en": "zero one two three four five six seven eight nine".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "fr": "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
}


def email(r):
    name = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    return f"{name(5)}.{name(4)}@{name(6)}.{r.choice(['com', 'org', 'de', 'co.uk'])}"


def card(r):
    while True:
        digits = "".join(str(r.randrange(10)) for _ in range(16))
        if luhn(digits):
            return " ".join(digits[i : i + 4] for i in range(0, 16, 4))


def phone(r):
    return f"+{r.randrange(1, 99)} " + " ".join(str(r.randrange(100, 1000)) for _ in range(3))


def ip(r):
    return ".".join(str(r.randrange(1, 256)) for _ in range(4))


def digits(t, zero):
    """With the digits of another script or style."""
    return "".join(zero[int(c)] if c.isdigit() else c for c in t)


STYLES = ["٠١٢٣٤٥٦٧٨٩", "𝟎𝟏𝟐𝟑𝟒𝟓𝟔𝟕𝟖𝟗", "⓪①②③④⑤⑥⑦⑧⑨", "⁰¹²³⁴⁵⁶⁷⁸⁹", "०१२३४५६७८९"]


def wide(t):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)


def bold(t):
    return "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in t)


def invisible(r, t):
    return "".join(c + (r.choice("​‍⁠﻿­") if r.random() < 0.3 else "") for c in t)


def alike(r, t):
    return "".join(r.choice(ALIKE[c]) if c in ALIKE and r.random() < 0.6 else c for c in t)


def spelled(r, t, share=1.0, language=None):
    words = NUMERALS[language or r.choice(sorted(NUMERALS))]
    return " ".join("".join(f" {words[int(c)]} " if c.isdigit() and r.random() < share else c for c in t).split())


def one_spelled(r, t):
    at = r.choice([i for i, c in enumerate(t) if c.isdigit()][1:])
    return t[:at] + NUMERALS[r.choice(sorted(NUMERALS))][int(t[at])] + t[at + 1 :]


def signs(at, dot):
    def form(r):
        name, host = email(r).split("@")
        return name + at + host.replace(".", dot)

    return form


_SIGNS = [(" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" at ", "."), (" @ ", " . "), ("＠", "．"), ("{at}", "{dot}"), (" <at> ", " <dot> "), (" arroba ", " punto "), ("[ät]", " punkt "), ("&#64;", "."), ("&commat;", "&period;"), ("%40", "."), (" @", "."), ("-at-", "-dot-"), ("_at_", "_dot_")]
_DOTS = [" dot ", "[.]", "(dot)", "。", " point ", "․", " . "]
FORMS = {
    "email": [*(signs(*s) for s in _SIGNS), lambda r: wide(email(r)), lambda r: bold(email(r)), lambda r: alike(r, email(r)), lambda r: invisible(r, email(r))],
    "ip": [*((lambda d: lambda r: ip(r).replace(".", d))(d) for d in _DOTS), *((lambda z: lambda r: digits(ip(r), z))(z) for z in STYLES), lambda r: wide(ip(r)), lambda r: invisible(r, ip(r)), lambda r: one_spelled(r, ip(r)), lambda r: spelled(r, ip(r).replace(".", " dot "))],
    "card": [*((lambda z: lambda r: digits(card(r), z))(z) for z in STYLES), lambda r: wide(card(r)), lambda r: invisible(r, card(r)), lambda r: one_spelled(r, card(r)), lambda r: spelled(r, card(r)), lambda r: spelled(r, card(r), 0.4), lambda r: card(r).replace(" ", "–"), lambda r: card(r).replace(" ", "."), lambda r: card(r).replace(" ", " - "), lambda r: card(r).replace(" ", " ")],
    "phone": [*((lambda z: lambda r: digits(phone(r), z))(z) for z in STYLES), lambda r: wide(phone(r)), lambda r: invisible(r, phone(r)), lambda r: one_spelled(r, phone(r)), lambda r: spelled(r, phone(r)), lambda r: spelled(r, phone(r), 0.4), lambda r: phone(r).replace("+", "plus "), lambda r: spelled(r, phone(r).replace("+", "plus ")), lambda r: phone(r).replace(" ", "–")],
}
