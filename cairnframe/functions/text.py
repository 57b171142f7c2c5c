"""How values read as text."""

from __future__ import annotations

import math

#: The powers of ten below and from which floats take exponent form.
LEAST_EXPONENT, FIRST_EXPONENT = -4, 6


def float_text(v: float) -> str:
    """Shortest digits that read back as v; exponents are signed and have two digits at least."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    sign = "-" if math.copysign(1, v) < 0 else ""
    mantissa, _, exponent = f"{abs(v)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = whole + (part if part != "0" else "")
    point = len(whole) + int(exponent or 0)
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    if not digits:
        return sign + "0"
    power = point - 1
    if power < LEAST_EXPONENT or power >= FIRST_EXPONENT:
        tail = f".{digits[1:]}" if len(digits) > 1 else ""
        return f"{sign}{digits[0]}{tail}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[:point].ljust(point, '0')}" + (f".{digits[point:]}" if len(digits) > point else "")


def value_text(v) -> str:
    """A cell's text; None has none."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return float_text(v)
    return str(v)
