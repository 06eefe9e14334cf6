"""Price comparison across suppliers, group by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelattice.functions.num import percent_over


def representative(offers: DataFrame, key: str, order: Column | None = None, pick: str = "min") -> DataFrame:
    """(key, supplier, price): one price a supplier and group: its least, or that of its first or last row in ``order``.

    ``order`` must be total. Null prices don't count for ``min``; first and last take the row's price as it is.
    """
    price = {"min": lambda: F.min("price"), "first": lambda: F.min_by("price", order), "last": lambda: F.max_by("price", order)}[pick]()
    return offers.groupBy(key, "supplier").agg(price.alias("price"))


def spread(prices: DataFrame, key: str, least_suppliers: int = 2) -> DataFrame:
    """(key, n_suppliers, min_price, max_price, cheapest, diff_pct) of groups with enough priced suppliers.

    Ties for the cheapest go to the least supplier; diff_pct is null unless the minimum is positive.
    """
    return (
        prices.filter("price is not null")
        .groupBy(key)
        .agg(F.count("*").alias("n_suppliers"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.min(F.struct("price", "supplier")).getField("supplier").alias("cheapest"))
        .filter(F.col("n_suppliers") >= least_suppliers)
        .withColumn("diff_pct", percent_over(F.col("max_price"), F.col("min_price")))
    )


def supplier_matrix(prices: DataFrame, key: str, suppliers: Sequence[str]) -> DataFrame:
    """A price column for each named supplier, also for those without any price."""
    return prices.groupBy(key).pivot("supplier", list(suppliers)).agg(F.min("price")) if suppliers else prices.select(key).distinct()


def row_extrema(matrix: DataFrame, suppliers: Sequence[str]) -> DataFrame:
    """Least and greatest price over the supplier columns, the cheapest supplier and the spread; rows without price stay null."""
    none = F.array().cast("array<struct<p:decimal(38,18),s:string>>")
    offers = F.filter(F.array(*[F.struct(F.col(s).alias("p"), F.lit(s).alias("s")) for s in suppliers]), lambda o: o["p"].isNotNull()) if suppliers else none
    out = matrix.withColumn("min_price", F.array_min(offers).getField("p")).withColumn("max_price", F.array_max(F.transform(offers, lambda o: o["p"]))).withColumn("cheapest", F.array_min(offers).getField("s"))
    return out.withColumn("diff_pct", percent_over(F.col("max_price"), F.col("min_price")))


def presence(offers: DataFrame, key: str, suppliers: Sequence[str]) -> DataFrame:
    """For each key, whether each supplier lists it."""
    if not suppliers:
        return offers.select(key).distinct()
    counts = offers.groupBy(key).pivot("supplier", list(suppliers)).agg(F.count(F.lit(1)))
    return counts.select(key, *[(F.coalesce(F.col(s), F.lit(0)) > 0).alias(s) for s in suppliers])


def pair_ratio(prices: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """(key, price_a, price_b, ratio): two suppliers' prices side by side, conditional aggregation instead of a self-join."""
    of = lambda s: F.max(F.when(F.col("supplier") == s, F.col("price")))
    both = prices.groupBy(key).agg(of(one).alias("price_a"), of(other).alias("price_b")).filter("price_a is not null and price_b > 0")
    return both.withColumn("ratio", F.floor(F.col("price_a").cast("double") / F.col("price_b").cast("double") * 10 + 0.5) / 10.0)


MAX_SUPPLIERS = 5_000  # columns of a matrix; more raise an error


def suppliers_of(offers: DataFrame) -> list[str]:
    """All suppliers in order, for the columns of a matrix."""
    rows = offers.select("supplier").filter("supplier is not null").distinct().limit(MAX_SUPPLIERS + 1).collect()
    if len(rows) > MAX_SUPPLIERS:
        raise ValueError(f"more than {MAX_SUPPLIERS} suppliers for the columns of a matrix")
    return sorted(r.supplier for r in rows)


def display_attributes(offers: DataFrame, key: str, columns: Sequence[str], *order: str) -> DataFrame:
    """(key, columns): each attribute's first value that isn't null, in the order of ``order``."""
    by = F.struct(*order)
    return offers.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in columns])


def hide_unpriced(matrix: DataFrame, suppliers: Sequence[str]) -> DataFrame:
    """Rows with a price in some supplier's column."""
    return matrix.filter(F.coalesce(F.lit(None), *[F.col(s) for s in suppliers]).isNotNull())


def match_groups(products: DataFrame, least_suppliers: int = 2) -> DataFrame:
    """(canonical_key, listings, suppliers) of the keys at enough suppliers; listings without a key are of the unknown one."""
    key = F.coalesce("canonical_key", F.lit("?|?|?|?")).alias("canonical_key")
    return products.groupBy(key).agg(F.count("*").alias("listings"), F.countDistinct("supplier").alias("suppliers")).filter(F.col("suppliers") >= least_suppliers)
