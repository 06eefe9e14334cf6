"""Quantities in free text: value, unit family and pieces in the pack, in one common base unit.

Pure Python on single strings; operators run it over distinct texts in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# Base units are g, ml, mm and uni; ounces, fluid ounces and pounds are the US ones.
FACTORS: dict[str, tuple[str, float]] = {
    "mg": ("g", 0.001), "miligramo": ("g", 0.001), "miligramos": ("g", 0.001),
    "g": ("g", 1), "gr": ("g", 1), "grs": ("g", 1), "gramo": ("g", 1), "gramos": ("g", 1),
    "kg": ("g", 1000), "kgs": ("g", 1000), "kilo": ("g", 1000), "kilos": ("g", 1000), "kilogramo": ("g", 1000), "kilogramos": ("g", 1000),
    "oz": ("g", 28.349523125), "onza": ("g", 28.349523125), "onzas": ("g", 28.349523125),
    "lb": ("g", 453.59237), "lbs": ("g", 453.59237), "libra": ("g", 453.59237), "libras": ("g", 453.59237),
    "ml": ("ml", 1), "mls": ("ml", 1), "mililitro": ("ml", 1), "mililitros": ("ml", 1), "cc": ("ml", 1), "cm3": ("ml", 1),
    "cl": ("ml", 10), "centilitro": ("ml", 10), "centilitros": ("ml", 10),
    "l": ("ml", 1000), "lt": ("ml", 1000), "lts": ("ml", 1000), "litro": ("ml", 1000), "litros": ("ml", 1000),
    "floz": ("ml", 29.5735295625),
    "mm": ("mm", 1), "milimetro": ("mm", 1), "milimetros": ("mm", 1),
    "cm": ("mm", 10), "cms": ("mm", 10), "centimetro": ("mm", 10), "centimetros": ("mm", 10),
    "m": ("mm", 1000), "mt": ("mm", 1000), "mts": ("mm", 1000), "metro": ("mm", 1000), "metros": ("mm", 1000),
    "u": ("uni", 1), "un": ("uni", 1), "uni": ("uni", 1), "unid": ("uni", 1), "unids": ("uni", 1), "unidad": ("uni", 1), "unidades": ("uni", 1),
    "x": ("uni", 1), "ud": ("uni", 1), "uds": ("uni", 1), "pieza": ("uni", 1), "piezas": ("uni", 1), "pza": ("uni", 1), "pzas": ("uni", 1),
    "doc": ("uni", 12), "docena": ("uni", 12), "docenas": ("uni", 12), "par": ("uni", 2), "pares": ("uni", 2),
}
#: Units of which three digits after a dot are thousands ("2.000 cc"), not decimals ("0.800 kg").
SMALL = {"mg", "g", "gr", "grs", "gramo", "gramos", "ml", "mls", "cc", "cm3", "cl", "mm", "cm", "cms"}

_NUMBER = r"(?:\d+\s+\d/\d+|\d+/\d+|\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?)"
_MEASURE = r"(?:fl\.?\s*oz|miligramos?|kilogramos?|mililitros?|centilitros?|milimetros?|centimetros?|gramos?|litros?|metros?|onzas?|libras?|kilos?|kgs?|mg|grs?|g|oz|lbs?|mls?|c\.?c\.?|cm3|cl|lts?|l|mm|cms?|mts?|m)"
_COUNT = r"(?:unidades|unidad|unids?|uni|un|uds?|u|piezas?|pzas?|docenas?|doc|pares|par)"
_END = r"(?![a-z0-9])"
_START = r"(?<![\w.,/])"
_NOISE = re.compile(
    r"\([^)]*(?:caja|bulto|art|cod|ref)[^)]*\)|\bu\s*x\s*b\s*:?\s*\d+|\bbultos?\s*(?:x|de)?\s*\d+|\bcajas?\s*(?:x|de)\s*\d+"
    r"|\b(?:cod|ref|art|articulo|codigo)\b[.:\s]*(?:n[º°o]?\.?\s*)?[a-z]?-?\d+|\bn\s*[º°]\s*\.?\s*\d+|\bnro\.?\s*\d+"
    r"|\b\d+\s*cuotas?\b|-?\s*\d+\s*%(?:\s*off\b)?|\bllev\w*\s+\d+\s*x\s*\d+|\bedicion\s+\d{4}\b|\b\d+\s*x\s*1\b(?!\s*[\w/.,])"
)
_HERE = r"(?:(?<=\dx)|\b)"
_WORDS = (
    (re.compile(_HERE + r"(kilo|litro|metro|docena|libra)\s+y\s+medi[oa]\b"), r"1.5 \1"),
    (re.compile(_HERE + r"(?:tres cuartos|3/4)\s+(?:de\s+)?(kilo|litro|metro|libra)"), r"3/4 \1"),
    (re.compile(_HERE + r"medi[oa]\s+(kilo|litro|metro|docena|libra|kg|lt|l|doc)\b"), r"1/2 \1"),
    (re.compile(_HERE + r"cuarto\s+(?:de\s+)?(kilo|litro|metro|libra|kg|lt|l)\b"), r"1/4 \1"),
)
_VALUE = rf"({_NUMBER})\s*({_MEASURE}){_END}\.?"
_PACKED = re.compile(rf"{_START}(\d+)\s*(?:(?:{_COUNT}|rollos?|botellas?|latas?|paq\w*)\.?\s*)?x\s*{_VALUE}")
_MULTI = re.compile(rf"\bmultipack\s+(?:de\s+)?(\d+)\s+(?:de|x)\s+{_VALUE}")
_BACK = re.compile(rf"{_START}{_VALUE}\s*x\s*(\d+)(?:\s*(?:{_COUNT}|rollos?)(?![a-z0-9]))?")
_PLAIN = re.compile(rf"{_START}{_VALUE}")
_BARE = re.compile(rf"(?<![\w])(kilo|litro|metro){_END}")
_COUNTED = re.compile(rf"{_START}(?:x\s*)?({_NUMBER})\s*({_COUNT}){_END}")
_TIMES = re.compile(r"(?<![\w.,/])x\s*(\d+)(?![\w.,/%])")
_DOZEN = re.compile(rf"(?<![\w])(docena|par){_END}")
_FOLDED = str.maketrans({"½": " 1/2", "¼": " 1/4", "¾": " 3/4", "³": "3", "×": "x", " ": " "})


class Quantity(NamedTuple):
    value: float  # of one piece, in the base unit
    unit: str  # g, ml, mm or uni
    pieces: int  # pieces of a weight, volume or length in the pack; 1 for counts


def fold(text: str) -> str:
    """Lower case without accents, fractions and multiplication signs spelt out."""
    text = unicodedata.normalize("NFD", text.translate(_FOLDED).lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def number(text: str, unit: str = "") -> float | None:
    """``1 1/2``, ``1/2``, ``2,25``, ``2.000`` (thousands before small units) as a float; None for a zero divisor."""
    if "/" in text:
        whole, _, part = text.rpartition(" ")
        up, down = part.split("/")
        if not int(down):
            return None
        return (float(whole) if whole.strip() else 0.0) + int(up) / int(down)
    dots = text.count(".")
    if dots and "," in text:
        text = text.replace(".", "").replace(",", ".")
    elif dots > 1 or (unit in SMALL and re.fullmatch(r"[1-9]\d{0,2}[.,]\d{3}", text)):
        text = text.replace(".", "").replace(",", "")
    return float(text.replace(",", "."))


def _unit(text: str) -> str:
    return re.sub(r"[.\s]", "", text)


class Reading(NamedTuple):
    number: float  # as written
    notation: str  # the unit as written, without dots and spaces; x for a bare "x 24"
    pieces: int  # pieces of a weight, volume or length in the pack; 1 for counts


def _reading(value: str, unit: str, pieces: str = "1") -> Reading | None:
    unit = _unit(unit)
    n = number(value, unit)
    return None if n is None or n <= 0 or int(pieces) <= 0 else Reading(n, unit, int(pieces))


def readings(text: str) -> tuple[Reading | None, list[tuple[int, int]], str]:
    """Number, notation and pieces a text states, the spans of the cleaned text that state them, and the cleaned text."""
    text = fold(text)
    for pattern, to in _WORDS:
        text = pattern.sub(to, text)
    text = _NOISE.sub(lambda m: " " * len(m[0]), text)
    for pattern, order in ((_MULTI, (2, 3, 1)), (_PACKED, (2, 3, 1)), (_BACK, (1, 2, 3)), (_PLAIN, (1, 2)), (_COUNTED, (1, 2))):
        if (m := pattern.search(text)) and (r := _reading(*(m[i] for i in order))):
            return r, [m.span()], text
    if (m := _TIMES.search(text)) and int(m[1]) > 0:
        return Reading(float(m[1]), "x", 1), [m.span()], text
    for pattern in (_DOZEN, _BARE):
        if m := pattern.search(text):
            return Reading(1.0, m[1], 1), [m.span()], text
    return None, [], text


def read(text: str | None) -> Reading | None:
    """What a name or size states, as written; None for null, empty and texts without a quantity."""
    return readings(text)[0] if text else None


def notation(unit: str | None) -> str:
    """A unit column's text as a notation; empty for null."""
    return _unit(fold(unit)) if unit else ""


def spans(text: str) -> tuple[Quantity | None, list[tuple[int, int]], str]:
    """The quantity a text states by the unit table, the spans of the cleaned text that state it, and the cleaned text."""
    r, at, text = readings(text)
    if r is None:
        return None, [], text
    base, factor = FACTORS[r.notation]
    return Quantity(r.number * factor, base, r.pieces), at, text


def parse(text: str | None) -> Quantity | None:
    """The quantity a name or size states; None for null, empty and texts without one."""
    return spans(text)[0] if text else None


def in_base(value: float | None, unit: str | None) -> tuple[float, str] | None:
    """A typed value with a unit column in the base unit; None without value or known unit."""
    if value is None or not unit or not value > 0:
        return None
    known = FACTORS.get(_unit(fold(unit)))
    return (value * known[1], known[0]) if known else None
