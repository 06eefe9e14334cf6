"""Numbers in text and rounding, as Column expressions. Unreadable values give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comma_price(raw: Column, most: float | None = None) -> Column:
    """``$1.234,56`` → 1234.56: dots are thousands, the comma is decimal; above ``most`` null."""
    text = F.replace(F.translate(F.trim(raw), "$.  ", ""), F.lit(","), F.lit("."))
    value = text.try_cast("double")
    return value if most is None else F.when(value <= most, value)


def dot_price(raw: Column) -> Column:
    """``$4446.270`` → 4446.27."""
    return F.regexp_replace(F.trim(raw), r"[$\s ]", "").try_cast("double")


def decode_price(encoded: Column) -> Column:
    """Three-digit groups, each the code of a character plus ten; null unless the length is a multiple of three."""
    groups = F.regexp_extract_all(encoded, F.lit(r"\d{3}"), F.lit(0))
    text = F.array_join(F.transform(groups, lambda g: F.char(g.cast("int") - 10)), "")
    return F.when((F.length(encoded) % 3 == 0) & (F.length(encoded) > 0) & (F.size(groups) * 3 == F.length(encoded)), text.try_cast("double"))


def half_up(value: Column, digits: int = 2) -> Column:
    """Rounding by floor(x + 1/2), the same in every engine."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + F.lit(0.5)) / F.lit(scale)


def percent_over(high: Column, low: Column) -> Column:
    """(high - low) / low in percent; null unless low is positive."""
    return F.when(low > 0, half_up((high.cast("double") - low.cast("double")) / low.cast("double") * 100.0))


def to_base(value: Column, unit: Column) -> Column:
    """A value with one of the common unit names in g, ml or mm; null for others."""
    u = F.lower(F.trim(unit))
    scale = F.when(u.isin("g", "gr", "grs", "ml", "cc", "cm3", "mm"), 1.0).when(u.isin("kg", "kilo", "l", "lt", "lts", "litro", "litros", "m", "mts"), 1000.0).when(u.isin("cl", "cm"), 10.0).when(u == "mg", 0.001)
    return value.cast("double") * scale


def boxed_units(stock: Column) -> Column:
    """``uxb:24`` → 24, else null."""
    return F.regexp_extract(F.lower(F.trim(stock)), r"^uxb:\s*(\d+)$", 1).try_cast("int")


def plain_float(raw: Column) -> Column:
    """A number with a decimal dot, else null."""
    return F.when(raw.rlike(r"^\s*[+-]?\d+(\.\d*)?\s*$"), raw.try_cast("double"))


def comma_number(raw: Column) -> Column:
    """``1,5`` → 1.5; no thousands."""
    return F.replace(F.trim(raw), F.lit(","), F.lit(".")).try_cast("double")
