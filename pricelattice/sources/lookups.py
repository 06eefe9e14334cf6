"""Lookup text files as small DataFrames: line lists, aliases, taxonomies, code maps.

Blank lines and lines with ``#`` are comments. Where a key repeats, the last line of its file wins; the line
number comes from reading the (small) file whole, so the order does not depend on how a reader splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.functions.keys import brand_core
from pricelattice.functions.text import fold


def lines(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(line, value): trimmed, without comments."""
    whole = spark.read.text(path, wholetext=True)
    return useful_lines(whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")), upper)


def useful_lines(rows: DataFrame, upper: bool = False) -> DataFrame:
    """Of (line, value): trimmed, without comments."""
    rows = rows.withColumn("value", F.trim("value")).filter("value != '' and not startswith(value, '#')")
    return rows.withColumn("value", F.upper("value")) if upper else rows


def _last(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(F.struct("line", *columns)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def read_aliases(rows: DataFrame, brands: bool = False) -> DataFrame:
    """(variant, canonical) of ``VARIANT=CANONICAL`` lines; variants folded, as brand keys if ``brands``."""
    rows = rows.filter("value like '%=%'")
    text = F.trim(F.substring_index("value", "=", 1))
    key = brand_core(text) if brands else F.upper(fold(text))
    return _last(rows.select("line", key.alias("variant"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("canonical")), "variant", "canonical")


def read_taxonomy(rows: DataFrame) -> DataFrame:
    """(kind, dept, sub) of ``DEPT|SUB|TYPE`` lines; lines of another number of parts are skipped."""
    parts = rows.withColumn("p", F.split("value", "[|]")).filter(F.size("p") == 3)
    part = lambda n: F.trim(F.get("p", F.lit(n)))
    return _last(parts.select("line", F.upper(fold(part(2))).alias("kind"), part(0).alias("dept"), part(1).alias("sub")), "kind", "dept", "sub")


def read_codes(rows: DataFrame) -> DataFrame:
    """(cpath, name) of ``1_101=NAME`` lines."""
    rows = rows.filter("value like '%=%'")
    return _last(rows.select("line", F.trim(F.substring_index("value", "=", 1)).alias("cpath"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("name")), "cpath", "name")


def read_table_brands(rows: DataFrame, column: int = 1) -> DataFrame:
    """(brand) of the lines of a fixed-width table with ``|`` borders, without its header and ``Generico``."""
    cells = rows.filter("startswith(value, '|')").select("line", F.trim(F.get(F.split("value", "[|]"), F.lit(column))).alias("brand"))
    head = cells.agg(F.min("line")).first()[0]
    return cells.filter((F.col("line") > F.lit(head)) & (F.col("brand") != "") & (F.lower("brand") != "generico")).select("brand").distinct()


def aliases(spark: SparkSession, path: str, brands: bool = False) -> DataFrame:
    return read_aliases(lines(spark, path), brands)


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return read_taxonomy(lines(spark, path))


def codes(spark: SparkSession, path: str) -> DataFrame:
    return read_codes(lines(spark, path))


def table_brands(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    return read_table_brands(lines(spark, path), column)


def longest_first(frame: DataFrame, column: str = "value", by_words: bool = False) -> DataFrame:
    """By number of words if asked, then by length, then by value."""
    return frame.orderBy(*longest_order(column, by_words))


def longest_order(column: str = "value", by_words: bool = False) -> list:
    return [*([F.desc(F.size(F.split(column, r"\s+")))] if by_words else []), F.desc(F.length(column)), F.asc(column)]
