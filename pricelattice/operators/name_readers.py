"""Five readers of listing names, one for each custom of writing them, and the choice of each source's reader.

A reader is declared, not coded: texts to replace before reading, measures to cut out in their order, and a
layout that finds type and brand in what is left. The layouts are type first, either order, brand in
capitals, size at the end, and brand first. Dictionaries of brands, types, their aliases and abbreviations are
parameters. Corrections for single brands are business rules and no part of this.

Reading is one Arrow pass; the readers of a worker are built once a set of dictionaries.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelattice.functions.quantity import FACTORS, fold

GENERIC = "Generico"
MAX_ENTRIES = 200_000  # dictionary entries that the workers hold; more raise an error
# Words that begin a brand of two words; prepositions that begin none; words that are none.
ARTICLES = frozenset("la el los las lo le don san santa".split())
WIDE_ARTICLES = frozenset("la el los las san santa don dog old new close oral".split())
PREPOSITIONS = frozenset("de del en con al a y".split())
NO_BRAND = frozenset("de del al con sin para y e s/ c/ p/ x extra super ultra light diet natural 0% s/azucar d/p f/p d/t".split())
# Codes in capitals that follow a brand without being part of it; and words that name packings.
BRAND_SUFFIXES = frozenset("aa aaa aob be ddl ii mmm plax sg pronto tnt ultra".split())
CONTAINERS = re.compile(r"\b(?:botella|pote|bolsa|caja|lata|frasco|sachet|saquito|doy\s*pack|pet|pvc|petaca|sobre|barra|tira)\b", re.I)
# Types whose bare numbers are millilitres or grams.
ML_TYPES = frozenset(
    "desodorante|antitranspirante|shampoo|acondicionador|jabon liquido|suavizante|gel fijador|gel antibacterial|crema para peinar|crema hidratante|crema corporal|crema facial|"
    "crema depilatoria|crema de enjuague|crema de tratamiento|protector solar|prot.solar|gel micelar|agua micelar|vino|espumante|champagne|licor|whisky|vodka|fernet".split("|")
)
G_TYPES = frozenset("protector labial|jabon glicerina|jabon pastilla|jabon tocador".split("|"))
CANDY = frozenset("gomitas caramelos chupetines chupetin chicles turron golosinas confites pastillitas".split())

_TEXT, _WHOLE, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()
RESULT = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("brand", _TEXT), ("brand_source", _TEXT), ("product_type", _TEXT), ("variant", _TEXT), ("size_value", _REAL), ("size_unit", _TEXT),
            ("pieces", _WHOLE), ("units", _WHOLE), ("units_label", _TEXT), ("length", _TEXT), ("dimensions", _TEXT), ("shown", _TEXT),
        )
    ]
)


@dataclass
class Sizes:
    """What the measures of a name say; each slot is filled once."""

    value: float | None = None  # in g, ml, m, W or pieces, by ``unit``
    unit: str | None = None
    pieces: int | None = None  # pieces of that value in the pack
    units: int | None = None
    units_label: str | None = None
    length: str | None = None
    dimensions: str | None = None
    shown: str | None = None
    bare: str | None = None  # a number without unit, as written


def plain(x: float) -> str:
    return str(int(x)) if x == int(x) else f"{x:.3f}".rstrip("0")


def numeral(text: str) -> float:
    return float(text.replace(",", ".").rstrip("."))


def based(value: float, unit: str) -> tuple[float, str]:
    """A value in grams, millilitres, pieces, metres or watts, by the unit table."""
    unit = re.sub(r"[.\s]", "", fold(unit))
    if unit in ("w", "wa"):
        return value, "W"
    if unit == "ltr":
        unit = "lt"
    family, factor = FACTORS[unit]
    return (value * factor / 1000, "m") if family == "mm" and unit in ("m", "mt", "mts", "metro", "metros") else (value * factor, {"mm": "mm", "uni": "uni"}.get(family, family))


class Measure(NamedTuple):
    """A pattern, when it may be looked for, and what its match says."""

    pattern: re.Pattern
    fill: Callable[[re.Match, Sizes, str], None]
    when: Callable[[Sizes], bool] = lambda s: True


def _amount(m: re.Match, s: Sizes, text: str) -> None:
    """Groups v and u, and n for a pack of pieces."""
    s.value, s.unit = based(numeral(m["v"]), m["u"])
    if m.groupdict().get("n"):
        s.pieces = int(m["n"])


def _total(m: re.Match, s: Sizes, text: str) -> None:
    """As ``_amount``, but a pack counts as the sum of its pieces."""
    s.value, s.unit = based(numeral(m["v"]) * int(m.groupdict().get("n") or 1), m["u"])


def _count(label: str) -> Callable:
    def fill(m: re.Match, s: Sizes, text: str) -> None:
        s.units, s.units_label = int(next(x for x in m.groups() if x)), label

    return fill


def _length(unit: str) -> Callable:
    def fill(m: re.Match, s: Sizes, text: str) -> None:
        s.length = f"{plain(numeral(m[1]))} {unit}"

    return fill


def _dimensions(m: re.Match, s: Sizes, text: str) -> None:
    s.dimensions = f"{m[1]}x{m[2]} cm"


_W, _V = r"(?P<u>kgs?|kilos?|grs?|gramos|g)", r"(?P<u>lt[rs]?|litros?|ml|cc|cm3|l)"
_N = r"(?P<v>\d+(?:[.,]\d+)?)"
_ANY = r"(?P<u>kg|kilos?|grs?|gramos|g|lts?|litros?|ml|cc|cm3)"
_no_amount = lambda s: s.value is None
_no_units = lambda s: s.units is None
PACK = Measure(re.compile(rf"\b(?P<n>\d+)\s*x\s*{_N}\s*{_ANY}\b", re.I), _amount)
WEIGHT = Measure(re.compile(rf"\b{_N}\s*{_W}\b", re.I), _amount, _no_amount)
VOLUME = Measure(re.compile(rf"\b{_N}\s*{_V}\b", re.I), _amount, _no_amount)
LONG_VOLUME = Measure(re.compile(rf"\b{_N}\s*(?P<u>lt[rs]?|litros?|ml|cc|cm3)\b", re.I), _amount, _no_amount)
UNITS = Measure(re.compile(r"\b(?:x\s*(\d+)|(\d+)\s*un(?:d|idades?)?)\b", re.I), _count("un"), _no_units)


def _bundle(m: re.Match, s: Sizes, text: str) -> None:
    s.dimensions = f"{m[1]}x{m[2] or ''}" + (" un" if m[3] else "")


TYPE_FIRST_MEASURES = (
    PACK, WEIGHT, VOLUME,
    Measure(re.compile(r"\b(\d+)\s*x\s*(\d+)\s*cm\b", re.I), _dimensions, _no_amount),
    Measure(re.compile(r"\b(\d+)\s*x(?:\s*(\d+))?\s*(un(?:d|idades?)?)?\b", re.I), _bundle, lambda s: s.dimensions is None and s.pieces is None),
    UNITS,
    Measure(re.compile(r"\b(\d+)\s*(?:sobres?|so)\b", re.I), _count("sobres"), _no_units),
    Measure(re.compile(r"\b(\d+(?:[.,]\d+)?)\s*(?:mts?|metros?)\b", re.I), _length("mt"), lambda s: s.dimensions is None),
    Measure(re.compile(r"\b(\d+(?:[.,]\d+)?)\s*cm\b", re.I), _length("cm"), lambda s: s.length is s.dimensions is s.value is None),
)
EITHER_MEASURES = (PACK, WEIGHT, LONG_VOLUME, UNITS)


# One letter stands for a unit at the end of names of the layout in capitals.
_LETTER = {"g": ("g", 1), "k": ("g", 1000), "m": ("ml", 1), "c": ("ml", 1), "l": ("ml", 1000)}
_ROLL = re.compile(r"\b(?:papel|rollo|toalla|serv)\b", re.I)


def _lettered(m: re.Match, s: Sizes, text: str) -> None:
    value, letter = numeral(m["v"]), m["u"].lower()
    n = m.groupdict().get("n")
    if letter in "us":
        s.units, s.units_label = int(value), "saquitos" if letter == "s" else "un"
    elif letter == "m" and n and _ROLL.search(text):  # metres on each of n rolls
        s.units, s.units_label, s.length = int(n), "un", f"{plain(value)} mt"
    else:
        unit, factor = _LETTER[letter]
        s.value, s.unit, s.pieces = value * factor, unit, int(n) if n else s.pieces


def _display(m: re.Match, s: Sizes, text: str) -> None:
    s.pieces, s.units, s.units_label = int(m[1]), int(m[2]), "un"


_nothing = lambda s: s.value is s.units is s.pieces is None
_no_size = lambda s: s.value is s.units is s.pieces is s.dimensions is s.length is None
_counted = lambda s: s.units is not None and s.length is None


def _bag_count(m: re.Match, s: Sizes, text: str) -> None:
    s.units, s.units_label = int(m[1]), "un"


CAPITALS_MEASURES = (
    Measure(re.compile(rf"\b(?P<n>\d+)\s*ux{_N}\s*(?P<u>[gkmcl])\s*\*?\s*$", re.I), _lettered),
    Measure(re.compile(r"\b(\d+)x(\d+)\s*u\s*\*?\s*$", re.I), _display, _nothing),
    Measure(re.compile(rf"\b(?P<n>\d+)x{_N}\s*(?P<u>[gk])\s*\*?\s*$", re.I), _lettered, _nothing),
    Measure(re.compile(r"\b(\d+)\s*saq\.\s*$", re.I), _count("saquitos"), _nothing),
    Measure(re.compile(rf"(?<!\dx)\b{_N}\s*(?P<u>[gkmclus])\s*\*?\s*$", re.I), _lettered, _nothing),
    Measure(re.compile(r"\b(\d+)x(\d+)\s*(?:e\s*$|cm\b)", re.I), _dimensions),
    Measure(re.compile(r"\b(\d+)\s*u\b", re.I), _bag_count, lambda s: s.dimensions is not None and s.units is None),
    Measure(re.compile(r"\b(\d+(?:[.,]\d+)?)\s*e\s*$", re.I), _length("mt"), lambda s: s.dimensions is s.length is None),
    Measure(re.compile(r"\bpaq\.?\s*(\d+)\s*u\b", re.I), _count("un"), _no_size),
    Measure(re.compile(r"\b(\d+(?:/\d+)?)\s*(?:=\d+\s*)?W\s*\*?\s*$"), lambda m, s, t: setattr(s, "length", f"{m[1]} W"), _no_size),
    Measure(re.compile(r"\b(\d+)p\.?(?=\s|$)", re.I), lambda m, s, t: setattr(s, "length", f"{int(m[1])} paños"), _counted),
    Measure(re.compile(r"\b(\d+(?:[.,]\d+)?)\s*grs?\.\s*", re.I), _length("gr"), _counted),
)
BISCUIT_GRAMS = re.compile(r"^gallet\b.*?\b(\d+(?:[.,]\d+)?)\s*$", re.I)

_TAIL = r"(?P<u>kgs?|grs?|g|ml|lts?|cc|un|mts?|cms?|w|wa)\.?"
_SIZED = re.compile(rf"\s+(?:(?P<n>\d+)x)?{_N}\s*{_TAIL}\s*$", re.I)
_TONE = re.compile(r"\s+(?:fria|calida|neutra|blanca|amarilla)\s*$", re.I)
_SINGLE = re.compile(r"\s+un\.?\s*$", re.I)
_BARE = re.compile(r"\s+(?P<raw>(?:(?P<n>\d+)x)?(?P<v>\d+(?:[.,]\d+)?)\.?)\s*$", re.I)
_BRAND_FIRST_SIZE = re.compile(rf"\s+(?P<v>\d+[.,]?\d*)\s*(?P<u>kgs?|grs?|g|ml|lts?|l|uni|cm3|cc)\b.*$", re.I)


def cut(text: str, measures: Iterable[Measure]) -> tuple[Sizes, str]:
    """The measures of a text, each cut out before the next is looked for, and the rest."""
    sizes = Sizes()
    for m in measures:
        if m.when(sizes) and (hit := m.pattern.search(text)):
            m.fill(hit, sizes, text)
            text = re.sub(r"\s+", " ", text[: hit.start()] + " " + text[hit.end() :]).strip(" *")
    return sizes, text


def cut_tail(text: str) -> tuple[Sizes, str]:
    """The size at the end of a name: a pack as its total, tones of light and a closing ``Un.`` set aside, a bonus not counted."""
    s = Sizes()
    toneless = _TONE.sub("", text)
    unitless = _SINGLE.sub("", text)
    if m := _SIZED.search(text):
        _total(m, s, text)
        return s, text[: m.start()]
    if toneless != text and (m := _SIZED.search(toneless) or re.search(r"(?<!\d)(?P<v>\d+(?:[.,]\d+)?)\s*(?P<u>wa?)\.?\s*$", toneless, re.I)):
        _total(m, s, toneless)
        return s, toneless[: m.start()]
    if m := re.search(rf"\s+(?P<v>\d+)\+\d+\s*(?P<u>kgs?|grs?|ml|lts?)\.?\s*$", text, re.I):
        _total(m, s, text)
        return s, text[: m.start()]
    if unitless != text:
        m = _SIZED.search(unitless)
        if m:
            _total(m, s, unitless)
        else:
            s.value, s.unit = 1.0, "uni"
        return s, unitless[: m.start()] if m else unitless
    if m := _BARE.search(text):
        s.value, s.bare = numeral(m["v"]) * int(m["n"] or 1), m["raw"].rstrip(".")
        return s, text[: m.start()]
    return s, text


class Prefixes:
    """Entries by their folded spelling; the longest that a list of words begins with, by whole words or by letters."""

    def __init__(self, values: dict[str, str]):
        self.entries = {" ".join(fold(k).split()): v for k, v in sorted(values.items()) if k.strip()}
        self.words = max((len(k.split()) for k in self.entries), default=0)
        self.by_start: dict[str, list[str]] = {}
        for k in sorted(self.entries, key=lambda k: (-len(k), k)):
            self.by_start.setdefault(k[:1], []).append(k)

    def whole(self, words: list[str]) -> tuple[str, int] | None:
        """(entry, words) of the longest entry of which the first words are the words."""
        for n in range(min(self.words, len(words)), 0, -1):
            if hit := self.entries.get(" ".join(map(fold, words[:n]))):
                return hit, n
        return None

    def letters(self, words: list[str]) -> tuple[str, int] | None:
        """As ``whole``, but the last word may go on: ``FIDEO`` begins ``FIDEOS``."""
        text = fold(" ".join(words))
        for k in self.by_start.get(text[:1], ()):
            if text.startswith(k):
                return self.entries[k], len(k.split())
        return None


@dataclass
class Dictionaries:
    """What the readers look up: brands and types by spelling, aliases of types (an entry may carry the beginning of the variant), abbreviations, variant spellings."""

    brands: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    variants: list[tuple[str, str]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.brands) + len(self.types) + len(self.aliases) + len(self.abbreviations) + len(self.variants)


def titled(text: str | None) -> str | None:
    return " ".join(w.capitalize() for w in text.split()) or None if text else None


def split_boundaries(text: str) -> str:
    """Blanks between a type's abbreviation and a brand that were written as one: ``D/Amb.POETT`` gives ``D/Amb. POETT``."""
    for pattern, to in (
        (r"\.([A-Z]{2,})", r". \1"), (r"([A-Z]{2,})\.([A-Z][a-z])", r"\1. \2"), (r"([a-z])\.([A-Z\d])", r"\1. \2"),
        (r"([*)])([A-Z]{2,})", r"\1 \2"), (r"([A-Z]{2,})(\([A-Za-z]\))", r"\1 \2"), (r"([A-Z])\.([A-Z][a-z])", r"\1. \2"),
    ):
        text = re.sub(pattern, to, text)
    return text


class NameReader:
    """The five layouts over one set of dictionaries. All give (brand, source, type, words of the variant)."""

    def __init__(self, known: Dictionaries):
        self.known, self.brands, self.types = known, Prefixes(known.brands), Prefixes(known.types)
        self.aliases = Prefixes({k: k for k in known.aliases})
        self.alias_of = {" ".join(fold(k).split()): v for k, v in known.aliases.items()}

    def aliased(self, kind: str | None) -> tuple[str | None, str | None]:
        return self.alias_of.get(" ".join(fold(kind).split()), (kind, None)) if kind else (None, None)

    # -- parts ------------------------------------------------------------------------------------------

    def guessed_brand(self, words: list[str]) -> tuple[str | None, int]:
        """A brand no list knows: past a preposition, two words after an article, with a short word that goes with it."""
        skip = int(len(words) > 1 and fold(words[0]) in PREPOSITIONS)
        rest = words[skip:]
        if not rest:
            return None, 0
        if fold(rest[0]) in ARTICLES and len(rest) > 1:
            return titled(" ".join(rest[:2])), skip + 2
        if len(rest) > 1 and len(rest[1]) <= 2 and rest[1].isalpha():
            return f"{rest[0].capitalize()} {rest[1].upper()}", skip + 2
        return rest[0].capitalize(), skip + 1

    def in_order(self, words: list[str], brand_first: bool) -> tuple | None:
        """(brand, source, type, rest, whether the type is known, words looked up) in one of both orders; None if no brand leads."""
        brand = self.brands.letters(words) if brand_first else None
        if brand_first and brand is None:
            return None
        at = brand[1] if brand else 0
        kind = self.types.letters(words[at:])
        name, n = kind or ((words[at].capitalize(), 1) if at < len(words) else (None, 0))
        name = self.aliased(name)[0]
        rest, looked_up = words[at + n :], at + n
        if brand_first:
            return brand[0], "lookup", name, rest, bool(kind), looked_up
        if brand := self.brands.letters(rest):
            return brand[0], "lookup", name, rest[brand[1] :], bool(kind), looked_up + brand[1]
        guess, used = self.guessed_brand(rest)
        return guess or GENERIC, "heuristic" if guess else "generico", name, rest[used:], bool(kind), looked_up

    # -- layouts ----------------------------------------------------------------------------------------

    def type_first(self, name: str, category: str | None) -> tuple[Sizes, tuple]:
        text = re.sub(r"\bAGRUPADOS\b", "6 UN", name.upper())
        text = re.sub(r"\bEXTENS\s+(\d+[,.]\d+)\b", r"EXTENS \1 MT", text)
        text = re.sub(r"\b(\d+)\s+C\b", r"\1 CC", text)
        text = re.sub(r"([A-Z])(\d+(?:[.,]\d+)?\s*(?:KG|KILOS?|GRS?|GRAMOS|G|LT[RS]?|LITROS?|ML|CC|CM3|MTS?|METROS?|CM|L))\b", r"\1 \2", text)
        sizes, text = cut(text, TYPE_FIRST_MEASURES)
        brand, source, kind, rest, *_ = self.in_order(self.without_containers(text), False)
        return sizes, (brand, source, kind, rest)

    def either(self, name: str, category: str | None) -> tuple[Sizes, tuple]:
        sizes, text = cut(name.upper(), EITHER_MEASURES)
        words = self.without_containers(text)
        one, other = self.in_order(words, False), self.in_order(words, True)
        better = other is not None and (one[1] != "lookup" or (other[5] > one[5] and (other[4] or not one[4])))
        return sizes, (other if better else one)[:4]

    def capitals(self, name: str, category: str | None) -> tuple[Sizes, tuple]:
        sizes, text = cut(name, CAPITALS_MEASURES)
        if _no_size(sizes) and (m := BISCUIT_GRAMS.search(text)):
            sizes.value, sizes.unit, text = numeral(m[1]), "g", text[: m.start(1)].strip()
        for short, full in self.known.abbreviations.items():
            text = re.sub(rf"(?<!\w){re.escape(short)}", full + " ", text)
        words = split_boundaries(text).split()
        start, end = self.capital_run(words)
        kind = titled(" ".join(words[:start]))
        kind, prefix = self.aliased(kind)
        rest = ([prefix] if prefix else []) + words[end:]
        brand = titled(" ".join(words[start:end]))
        return sizes, (brand, "capitals" if brand else "generico", kind, rest)

    @staticmethod
    def capital_run(words: list[str]) -> tuple[int, int]:
        """(first, end) of the run of words in capitals that is the brand; both at the end without one."""
        core = lambda w: re.sub(r"[.\-/!*&'\"()]", "", w)
        code = re.compile(r"[A-Z](/[A-Z])+\.?|\([A-Za-z]+\)|\(\d+\)")  # T/R, (M), (2003)
        capital = lambda w: len(core(w)) >= 2 and core(w).isupper()
        number = lambda w: core(w).isdigit() and len(core(w)) >= 3 and not re.fullmatch(r"\d+\.\d+", w)
        start = next((i for i, w in enumerate(words) if not code.fullmatch(w) and (capital(w) or number(w))), None)
        if start is None:
            return len(words), len(words)
        end = start + 1
        while end < len(words):
            w, c = words[end], core(words[end])
            year = re.fullmatch(r"1[89]\d\d|20\d\d", c)
            lower, bare, mixed = any(x.islower() for x in c), not any(x.isalpha() for x in c) and not year, any(x.isdigit() for x in c) and any(x.isalpha() for x in c)
            short = (len(c) == 1 and end == start + 1) or (w.endswith(".") and len(c) <= 3)
            if lower or bare or mixed or short or code.fullmatch(w) or ("." in w and "/" in w) or c.lower() in BRAND_SUFFIXES:
                break
            end += 1
        if start and not words[start - 1].endswith(("*", ".")) and re.fullmatch(r"\d+|[A-Z]", core(words[start - 1])):
            start -= 1  # "9 DE ORO", "D ALOMO"
        return start, end

    def size_last(self, name: str, category: str | None) -> tuple[Sizes, tuple]:
        sizes, text = cut_tail(name)
        words = text.split()
        # Brands of several words that aren't all letters may lead, without a type.
        led = self.brands.whole(words)
        if led and led[1] > 1 and not all(w.isalpha() for w in fold(led[0]).split()):
            brand, source, kind, rest = led[0], "lookup", None, words[led[1] :]
        else:
            alias = self.aliases.whole(words)
            kind, used = (self.aliased(alias[0])[0], alias[1]) if alias else ((words[0].capitalize(), 1) if words else ("Desconocido", 0))
            rest = words[used:]
            skip = next((i for i, w in enumerate(rest) if fold(w) not in NO_BRAND), len(rest))
            tail = rest[skip:]
            if not tail:
                brand, source, n = GENERIC, "generico", 0
            elif hit := self.brands.whole(tail):
                brand, source, n = hit[0], "lookup", skip + hit[1]
            else:
                n = 2 if fold(tail[0]) in WIDE_ARTICLES and len(tail) > 1 else 1
                brand, source, n = " ".join(tail[:n]), "heuristic", skip + n
            rest = rest[n:]
        if sizes.bare is not None:
            folded = fold(kind or "")
            sizes.unit = "ml" if folded in ML_TYPES else "g" if folded in G_TYPES else None
            if sizes.unit:
                sizes.shown = f"{sizes.bare} {sizes.unit}"
            else:
                sizes.value = None
                rest = [*rest, sizes.bare]
        return sizes, (brand, source, kind, rest)

    def brand_first(self, name: str, category: str | None) -> tuple[Sizes, tuple]:
        sizes = Sizes()
        text = " ".join(name.split())
        if m := _BRAND_FIRST_SIZE.search(text):
            sizes.value, sizes.unit = based(numeral(m["v"]), m["u"])
            text = text[: m.start()]
        words = text.split()
        led = 0
        while led < len(words) and len(words[led]) >= 2 and any(c.isupper() for c in words[led]) and words[led].upper() == words[led]:
            led += 1
        listed = self.brands.letters(words)
        if listed and len(" ".join(words[: listed[1]])) > len(" ".join(words[:led])):
            brand, led = listed[0], listed[1]
        else:
            brand = self.known.brands.get(" ".join(words[:led]), " ".join(words[:led])) if led else None
        rest = words[led:]
        source = "lookup" if listed else "capitals" if brand else "generico"
        if rest:
            kind, rest = self.aliased(rest[0])[0], rest[1:]
        else:
            leaf = re.sub(r"\s*\([^)]*\)\s*$", "", (category or "").rpartition(">")[2]).split()
            kind = (" ".join(leaf) if len(leaf) <= 3 else leaf[0]) if leaf else None
        return sizes, (brand, source, kind, rest)

    @staticmethod
    def without_containers(text: str) -> list[str]:
        """Words without those that name packings; the first stays, it may be the type."""
        words = text.split()
        return [*words[:1], *CONTAINERS.sub("", " ".join(words[1:])).split()]

    # -- all --------------------------------------------------------------------------------------------

    def read(self, name: str | None, layout: str, category: str | None = None) -> tuple:
        """The columns of RESULT; all null for null and blank names."""
        if not name or not name.strip():
            return (None,) * len(RESULT.names)
        sizes, (brand, source, kind, rest) = getattr(self, layout)(" ".join(name.split()), category)
        variant = " ".join(rest).strip(" -") or None
        if layout in ("type_first", "either"):
            variant = titled(variant)
        for pattern, to in self.known.variants if variant else ():
            variant = re.sub(pattern, to, variant, flags=re.I).strip() or None
            if not variant:
                break
        if variant and layout == "brand_first" and fold(kind or "") in CANDY:
            variant = re.sub(r"\bFrutal\b", "Frutales", variant, flags=re.I)
        return brand, source, kind, variant, sizes.value, sizes.unit, sizes.pieces, sizes.units, sizes.units_label, sizes.length, sizes.dimensions, sizes.shown


LAYOUTS = ("type_first", "either", "capitals", "size_last", "brand_first")
_READERS: dict[int, NameReader] = {}  # of the worker process, by what they look up


def _reader_on(known: Dictionaries, spark):
    if len(known) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} dictionary entries; read names by supplier with smaller dictionaries")
    key, shared = hash(pickle.dumps(known)), spark.sparkContext.broadcast(known)

    def get() -> NameReader:
        if key not in _READERS:
            _READERS[key] = NameReader(shared.value)
        return _READERS[key]

    return get


def read_names(products: DataFrame, known: Dictionaries, layouts: DataFrame | None = None, default: str = "type_first") -> DataFrame:
    """(supplier, sku, name, layout, columns of RESULT) of each row of (supplier, sku, name, category).

    ``layouts`` is (supplier, layout), one row a supplier; suppliers without one are read by ``default``. Null and blank names
    give null features. Further columns are ignored; an empty table gives no rows.
    """
    get = _reader_on(known, products.sparkSession)

    @F.pandas_udf(RESULT)
    def features(name: pd.Series, layout: pd.Series, category: pd.Series) -> pd.DataFrame:
        reader = get()
        out = pd.DataFrame([reader.read(*row) for row in zip(name, layout, category)], columns=RESULT.names)
        return out.astype({"size_value": "float64", "pieces": "Int32", "units": "Int32"})

    rows = products.select("supplier", "sku", "name", "category")
    rows = rows.withColumn("layout", F.lit(default)) if layouts is None else rows.join(layouts.select("supplier", "layout"), "supplier", "left").fillna(default, ["layout"])
    return rows.select("supplier", "sku", "name", "layout", features("name", "layout", "category").alias("f")).select("supplier", "sku", "name", "layout", "f.*")


def learned_layouts(products: DataFrame, known: Dictionaries) -> DataFrame:
    """(supplier, layout): the layout by which most of the supplier's names give a known brand and a known type (ties: the first of LAYOUTS)."""
    get = _reader_on(known, products.sparkSession)
    brands, types = set(known.brands.values()), set(known.types.values())

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def hits(name: pd.Series, category: pd.Series) -> pd.Series:
        reader = get()
        score = lambda r: (r[0] in brands) + (r[2] in types)
        return pd.Series([[score(reader.read(n, layout, c)) for layout in LAYOUTS] for n, c in zip(name, category)])

    scored = products.filter("supplier is not null and name is not null").select("supplier", hits("name", "category").alias("h"))
    sums = scored.groupBy("supplier").agg(*[F.sum(F.col("h")[i]).alias(layout) for i, layout in enumerate(LAYOUTS)])
    best = F.array_max(F.array(*[F.struct(F.col(layout).alias("n"), F.lit(-i).alias("at"), F.lit(layout).alias("layout")) for i, layout in enumerate(LAYOUTS)]))
    return sums.select("supplier", best["layout"].alias("layout"))


def dictionaries_of(refs: DataFrame) -> Dictionaries:
    """Brands and types of a reference list (field, value)."""
    rows = refs.filter("field in ('brand', 'product_type') and value is not null").select("field", "value").limit(MAX_ENTRIES + 1).collect()
    return Dictionaries(*[{r.value: r.value for r in rows if r.field == f} for f in ("brand", "product_type")])


def classified(products: DataFrame, known: Dictionaries, layouts: DataFrame | None = None) -> DataFrame:
    """The unclassified rows with their features, status ``pending`` and confidence: high if brand and size were found, else low."""
    todo = products.filter("classification_status is null")
    confident = F.coalesce((F.col("brand") != GENERIC) & (F.col("size_value").isNotNull() | F.col("units").isNotNull()), F.lit(False))
    return read_names(todo, known, layouts).withColumn("classification_status", F.lit("pending")).withColumn("classification_confidence", F.when(confident, "high").otherwise("low"))
