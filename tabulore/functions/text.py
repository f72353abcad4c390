"""How values are spelled."""

from __future__ import annotations

import math
import re


def digits_and_point(text: str) -> tuple[str, str, int]:
    """Sign, significant digits, and the place of the point among them, of a decimal or scientific number."""
    sign, whole, part, exponent = re.fullmatch(r"(-?)(\d+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?", text).groups()
    part = part or ""
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))
    kept = digits.rstrip("0")
    return sign, kept, point if kept else 0


def shortest(text: str) -> str:
    """A float as data formats spell it: 34.0, 0.00001, 1e-6, 1e16, 1.5e300."""
    if text in ("NaN", "Infinity", "-Infinity", "inf", "-inf", "nan"):
        return {"Infinity": "inf", "-Infinity": "-inf", "nan": "NaN"}.get(text, text)
    sign, digits, point = digits_and_point(text)
    if not digits:
        return f"{sign}0.0"
    if 0 < point <= 16:
        return sign + (digits.ljust(point, "0") + ".0" if len(digits) <= point else f"{digits[:point]}.{digits[point:]}")
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{point - 1}"


def float_text(x: float) -> str:
    return shortest(repr(float(x)))


def plain(x: float) -> str:
    """A float without exponent and without a fraction of zero: 34, 0.000001, NaN, inf."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    sign, digits, point = digits_and_point(str(x))
    if not digits:
        return f"{sign}0"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return sign + digits.ljust(point, "0")[:point] + (f".{digits[point:]}" if digits[point:] else "")


def round1(x: float) -> float:
    """To one decimal, halves away from zero."""
    return math.floor(x * 10 + 0.5) / 10
