"""Values as text for reports and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency(value: Column, empty: str = "-") -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, 2)), F.lit(empty))


def count_text(value: Column) -> Column:
    return F.format_number(value, 0)


def percent_text(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", value), F.lit("%"))


def signed_percent(part: Column, base: Column) -> Column:
    """``+12.5%``: base against part; null for a zero base."""
    return F.format_string("%+.1f%%", F.try_divide(part - base, base) * 100)


def timestamp_text(value: Column) -> Column:
    return F.date_format(value, "dd MMM yyyy, HH:mm")


def plain_number(value: Column) -> Column:
    """Without trailing zeros: 1500 for 1500.0, 1.5 for 1.50."""
    d = value.cast("decimal(18,4)")
    return F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def readable_size(value: Column, unit: Column) -> Column:
    """g and ml from a thousand on as kg and l, else as they are; null without value."""
    big = value >= 1000
    scaled = F.when(big & unit.isin("g", "ml"), value / 1000).otherwise(value)
    name = F.when(big & (unit == "g"), "kg").when(big & (unit == "ml"), "l").otherwise(unit)
    return F.concat_ws(" ", plain_number(scaled), name)


def fixed_width(columns: dict[str, int], border: str = "|") -> Column:
    """One line a row: each column padded or cut to its width, between borders."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in columns.items()]
    return F.concat(F.lit(border), F.concat_ws(border, *cells), F.lit(border))


def key_measure_text(key: Column) -> Column:
    """The measure of a canonical key in words: ``500g``, ``1.5kg``, ``330ml``, ``1.50L``, ``12 uni``, else ``?``."""
    part = F.get(F.split(key, "[|]"), F.lit(3))
    letter, n = F.substring(part, 1, 1), F.substring(part, 2, 30).try_cast("bigint")
    weight = F.when(n < 1000, F.concat(n.cast("string"), F.lit("g"))).otherwise(F.format_string("%.1fkg", n / 1000.0))
    volume = F.when(n < 1000, F.concat(n.cast("string"), F.lit("ml"))).otherwise(F.format_string("%.2fL", n / 1000.0))
    return F.coalesce(F.when(letter == "W", weight).when(letter == "V", volume).when(letter == "U", F.concat(n.cast("string"), F.lit(" uni"))), F.lit("?"))


def cell_text(price: Column, listed: Column) -> Column:
    """A comparison cell: the price, ``N/A`` where the supplier lists it without one, else nothing."""
    return F.when(price.isNotNull(), currency(price)).when(listed, "N/A").otherwise("")


def step_of_spread(low: Column, high: Column) -> Column:
    """A convenient step for choosing in a range of this width."""
    width = (high - low).cast("double")
    return F.when(width <= 5, 0.1).when(width <= 25, 0.25).when(width <= 100, 1.0).when(width <= 1000, 5.0).when(width.isNotNull(), 25.0)


def composite_size(pieces: Column, value: Column, unit: Column) -> Column:
    """``6x500 ml`` for a pack, ``500 ml`` for one piece, the pieces alone without a value; null without both."""
    measure = F.concat_ws(" ", plain_number(value), unit)
    return F.when(value.isNotNull() & (pieces > 1), F.concat(pieces.cast("string"), F.lit("x"), measure)).when(value.isNotNull(), measure).when(pieces.isNotNull(), F.concat(pieces.cast("string"), F.lit(" uni")))
