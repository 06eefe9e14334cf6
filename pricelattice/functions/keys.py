"""Keys and names built from a listing's parts, and readers of their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelattice.functions.text import fold, stripped, title_words, unaccent

UNKNOWN = "?"


def brand_core(brand: Column) -> Column:
    """Upper case without accents and punctuation, blanks collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.upper(unaccent(brand)), "[^A-Z0-9 ]", " "), " +", " ")), F.lit(""))


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")), " ")


def measure_token(weight: Column, volume: Column, count: Column) -> Column:
    """``W500``, ``V330`` or ``U12`` by the first that is known, rounded half to even, else ``?``."""
    whole = lambda letter, c: F.concat(F.lit(letter), F.bround(c.cast("double")).cast("bigint").cast("string"))
    return F.coalesce(whole("W", weight), whole("V", volume), whole("U", count), F.lit(UNKNOWN))


def canonical_key(brand: Column, kind: Column, variant: Column, measure: Column) -> Column:
    """BRAND|TYPE|SORTED VARIANT WORDS|MEASURE with ``?`` for an unknown part, except the variant, which may be empty."""
    part = lambda c: F.coalesce(brand_core(c), F.lit(UNKNOWN))
    return F.concat_ws("|", part(brand), part(kind), F.coalesce(sorted_words(F.coalesce(brand_core(variant), F.lit(""))), F.lit("")), measure)


def canonical_name(kind: Column, brand: Column, variant: Column, size: Column) -> Column:
    """Type, BRAND, variant and size in one text, unknown parts left out; null if all are."""
    blank = lambda c: F.nullif(stripped(c), F.lit(""))
    return F.nullif(F.concat_ws(" ", title_words(blank(kind)), F.upper(blank(brand)), F.lower(blank(variant)), blank(size)), F.lit(""))


def low_confidence(key: Column) -> Column:
    """True if the measure of a key is unknown; null for a null key."""
    return F.substring_index(key, "|", -1) == UNKNOWN


def path_part(path: Column, at: int, separator: str = ">") -> Column:
    """Element of a path, trimmed; null beyond its end."""
    return F.nullif(stripped(F.get(F.split(path, separator), F.lit(at))), F.lit(""))


def last_part(path: Column, separator: str = ">") -> Column:
    return F.trim(F.element_at(F.split(F.regexp_replace(path, rf"[{separator}\s]+$", ""), separator), -1))


def title_from_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def clean_category(raw: Column) -> Column:
    """Blanks collapsed, a trailing number or bracket dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+", " "), r"\s*\([^)]*\)\s*$", ""), r"\s+\d+$", ""))


def folded(text: Column) -> Column:
    """Null as '', trimmed, lower case, without accents."""
    return F.coalesce(fold(F.trim(text)), F.lit(""))


def label(*parts: Column, separator: str = " | ") -> Column:
    return F.concat_ws(separator, *parts)


def strip_session(url: Column) -> Column:
    """Without session id, page and sort parameters."""
    return F.regexp_replace(F.regexp_replace(url, r"(?i)([?&])(?:osCsid|sid|page|sort|p)=[^&#]*", "$1"), r"[?&]+(?=$|#)|(?<=[?&])&+", "")


def product_id(short_code: Column, sku: Column) -> Column:
    """``code_sku``; null if one of them is."""
    return F.concat(short_code, F.lit("_"), sku)


def rejoined_path(*parts: Column) -> Column:
    """The parts that are known, joined by `` > ``; null without any."""
    return F.nullif(F.concat_ws(" > ", *parts), F.lit(""))


def normalized_brand(brand: Column, alias: Column) -> Column:
    """``brand_core``, or the canonical brand that a lookup gave for it; empty text stays, punctuation alone is null."""
    return F.when(brand == "", brand).otherwise(F.coalesce(alias, brand_core(brand)))


def unpriced_label(text: Column, price: Column) -> Column:
    """The label, marked where there is no price."""
    return F.concat(text, F.when(price.isNull(), " (sin precio)").otherwise(""))


def translated(key: Column, language: Column, texts: dict[tuple[str, str], str]) -> Column:
    """The text of (language, key), else the English one, else the key."""
    table = F.create_map(*[F.lit(x) for (lang, k), t in sorted(texts.items()) for x in (f"{lang}|{k}", t)])
    return F.coalesce(table[F.concat_ws("|", language, key)], table[F.concat(F.lit("en|"), key)], key)
