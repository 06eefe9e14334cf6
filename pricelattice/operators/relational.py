"""Filters, joins, orders and set operations that the catalogue queries share. Nulls never match a filter."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.functions.keys import folded


def search(frame: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which a column contains the regular expression, whatever the letter case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike("(?iu)" + pattern), F.lit(False))
    return frame.filter(hit)


def choose(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows with one of the values, both sides folded; no values, no filter."""
    return frame.filter(folded(F.col(column)).isin(*[folded(F.lit(v)) for v in sorted(set(values))])) if values else frame


def cascade(frame: DataFrame, choices: dict[str, Sequence[str]]) -> DataFrame:
    """One filter after another; a column without values is not filtered."""
    for column, values in choices.items():
        frame = choose(frame, column, values)
    return frame


def within(frame: DataFrame, column: str, low, high) -> DataFrame:
    """Inclusive range; null values are dropped."""
    return frame.filter(F.col(column).between(low, high))


def rule(frame: DataFrame, expression: str, columns: Sequence[str]) -> tuple[DataFrame, str | None]:
    """Rows for which a user's expression over the allowed columns holds; (all rows, reason) if it can't be used."""
    names = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", expression))) - {"and", "or", "not", "is", "null", "in", "between", "like", "true", "false"}
    if strange := {n for n in names if n not in columns}:
        return frame, f"unknown names: {', '.join(sorted(strange))}"
    try:
        return frame.filter(F.expr(expression)), None
    except Exception as error:  # noqa: BLE001 - whatever the parser or analyser says goes to the user
        return frame, next((x for x in str(error).splitlines() if x.strip()), type(error).__name__)


def distinct_folded(frame: DataFrame, column: str) -> DataFrame:
    """One spelling, the least, of values that differ in accents, case or outer blanks only."""
    return frame.filter(F.col(column).isNotNull()).groupBy(folded(F.col(column)).alias("folded")).agg(F.min(column).alias("value"))


def top(frame: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in a total order."""
    return frame.orderBy(*order).limit(n)


def first_by(frame: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_by(frame: DataFrame, keys: Sequence[str], values: Sequence[str], *by: str) -> DataFrame:
    """Values of each key's greatest ``by``, combined map-side."""
    picked = frame.groupBy(*keys).agg(F.max(F.struct(*by, *values)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (*by, *values)])


def with_default(frame: DataFrame, lookup: DataFrame, on: Sequence[str], column: str, default: str) -> DataFrame:
    """Left join to a lookup table; Catalyst broadcasts it while it is small."""
    return frame.join(lookup, list(on), "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def longest_prefix(frame: DataFrame, text: str, prefixes: DataFrame, prefix: str, words: int = 4) -> DataFrame:
    """Each row with its longest prefix among ``prefixes`` (folded, whole words), null without any.

    An equi-join on the first 1..``words`` words instead of a theta join; longer prefixes are matched by their first
    ``words`` words and then compared in full.
    """
    split = lambda c: F.split(F.trim(F.regexp_replace(folded(c), r"\s+", " ")), " ")
    known = prefixes.select(F.col(prefix).alias("_p"), F.array_join(split(F.col(prefix)), " ").alias("_full"))
    known = known.withColumn("_head", F.array_join(F.slice(F.split("_full", " "), 1, words), " ")).filter("_head != ''").groupBy("_full", "_head").agg(F.min("_p").alias("_p"))
    rows = frame.withColumn("_t", F.array_join(split(F.col(text)), " "))
    # Texts are looked up once each; the join back is on the text itself.
    texts = rows.select("_t").distinct().withColumn("_w", F.split("_t", " "))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.lit(words), F.size("_w"))), lambda n: F.array_join(F.slice("_w", F.lit(1), n), " "))
    hit = texts.select("_t", F.explode(starts).alias("_head")).join(known, "_head").filter(F.concat("_t", F.lit(" ")).startswith(F.concat("_full", F.lit(" "))))
    best = hit.groupBy("_t").agg(F.max_by("_p", F.struct(F.length("_full"), "_full")).alias(prefix))
    return rows.join(best, "_t", "left").drop("_t")


def same_counts(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts by key on both sides of a copy, and whether they agree."""
    a, b = (f.groupBy(*keys).agg(F.count("*").alias(n)) for f, n in ((source, "source_rows"), (target, "target_rows")))
    both = a.join(b, list(keys), "full_outer").fillna(0, ["source_rows", "target_rows"])
    return both.withColumn("equal", F.col("source_rows") == F.col("target_rows"))


def among(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows with exactly one of the values; no values, no filter."""
    return frame.filter(F.col(column).isin(*values)) if values else frame


def visible(frame: DataFrame, wanted: Sequence[str], default: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in their order; the default ones if none does."""
    there = [c for c in wanted if c in frame.columns]
    return frame.select(*(there or default))


def available(frame: DataFrame, column: str = "stock") -> DataFrame:
    """Rows whose stock text isn't one of those that mean none."""
    return frame.filter(~folded(F.col(column)).isin("sin stock", "disponibilidad critica"))


def panel(frame: DataFrame, text: str = "", columns: Sequence[str] = (), chosen: dict[str, Sequence[str]] | None = None, ranges: dict[str, tuple] | None = None, hide_unavailable: bool = False) -> DataFrame:
    """A filter panel: text search, then choices, then availability, then inclusive ranges; what isn't set doesn't filter."""
    out = search(frame, text, columns) if text else frame
    for column, values in (chosen or {}).items():
        out = among(out, column, values)
    out = available(out) if hide_unavailable else out
    for column, (low, high) in (ranges or {}).items():
        out = within(out, column, low, high)
    return out


def ranked(frame: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in a total order with their place, from 1; the window sees those rows only."""
    return top(frame, n, *order).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def query(spark, sql: str, frames: dict[str, DataFrame] | None = None, **values) -> DataFrame:
    """Parameterised SQL: ``:name`` stands for a value, ``{name}`` for a frame."""
    return spark.sql(sql, args=values, **(frames or {}))
