"""Text normalisation as Column expressions; they stay inside whole-stage codegen."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _composed() -> tuple[str, str]:
    """All characters that canonical decomposition turns into one character and combining marks, and those characters."""
    accented, plain = [], []
    for code in range(0x80, 0x30000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            accented.append(c)
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _composed()


def unaccent(c: Column) -> Column:
    """Without accents, typed as one character or as combining marks; other characters, Hangul among them, are kept."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")


def ascii_fold(c: Column) -> Column:
    """Without accents and without what is then still not ASCII."""
    return F.regexp_replace(unaccent(c), r"[^\x00-\x7F]", "")


def fold(c: Column) -> Column:
    return F.lower(ascii_fold(c))


def word_key(c: Column) -> Column:
    """The words of letters and digits, folded, sorted and joined: equal for any order and punctuation.

    Null stays null; a text without letters and digits gives the empty string.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(unaccent(c)), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


# Words that stay lower case inside a title.
SMALL_WORDS = ("y", "e", "o", "u", "de", "del", "la", "las", "el", "los", "en", "con", "sin", "para", "por", "al", "a")


def clean_title(c: Column) -> Column:
    """Blanks collapsed; each word capitalised, except small words after the first. Composed characters are expected."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), " ")
    shown = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))))
    return F.array_join(shown, " ")


def stripped(c: Column) -> Column:
    """Without outer blanks of any kind, no-break ones among them."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Blanks of any kind collapsed to one and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t != t else unicodedata.normalize("NFKC", t))


def compatible(c: Column) -> Column:
    """Compatibility forms (ligatures, widths, raised digits) as plain characters; only texts beyond ASCII reach Python's table."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def clean_name(c: Column) -> Column:
    """Compatibility forms replaced, blanks collapsed, words capitalised but for small ones after the first."""
    return clean_title(compatible(c))


def mended_fold(c: Column) -> Column:
    """``ascii_fold`` in which a broken character (U+FFFD) reads as the N that it mostly stood for."""
    return ascii_fold(F.replace(c, F.lit("\ufffd"), F.lit("N")))


def title_words(c: Column) -> Column:
    """Each run of letters capitalised, whatever stands before it: ``d/amb.`` gives ``D/Amb.``."""
    letters = F.split(F.lower(c), "")
    return F.array_join(F.transform(letters, lambda x, i: F.when(F.get(letters, i - 1).rlike(r"\p{L}") & (i > 0), x).otherwise(F.upper(x))), "")


# A damaged word of a catalogue's categories and what it was.
DAMAGED = {"Pa Ales": "Pañales"}


def mended_words(c: Column) -> Column:
    for damaged, whole in DAMAGED.items():
        c = F.replace(c, F.lit(damaged), F.lit(whole))
    return c
