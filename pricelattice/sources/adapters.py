"""Adapters of supplier sites over landed pages: where categories stand, which pages belong to a listing, how records are read.

Network access and logins are no part of an engine that reads landed files; ``Adapter.options`` is handed to whoever lands them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelattice.functions.keys import strip_session, title_from_slug
from pricelattice.functions.num import comma_price
from pricelattice.sources import payloads

COLLECTION_JSON = "products: array<struct<id: bigint, title: string, vendor: string, variants: array<struct<id: bigint, sku: string, price: string>>>>"


@dataclass(frozen=True)
class Adapter:
    """What an engine needs to know of a supplier: ``discover`` (landed pages → category links) and ``parse`` (landed pages → records)."""

    supplier: str
    short_code: str
    discover: Callable[[DataFrame], DataFrame]
    parse: Callable[[DataFrame], DataFrame]
    options: dict[str, str] = field(default_factory=dict)


class Registry:
    """Adapters by supplier."""

    def __init__(self, *adapters: Adapter):
        self.adapters = {a.supplier: a for a in adapters}

    def get(self, supplier: str) -> Adapter:
        if supplier not in self.adapters:
            raise ValueError(f"unknown supplier {supplier}; known: {', '.join(sorted(self.adapters))}")
        return self.adapters[supplier]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(supplier, short_code), for joins."""
        return spark.createDataFrame([(a.supplier, a.short_code) for a in self.adapters.values()], "supplier string, short_code string")


def listing_pages(pages: DataFrame, card: str, per_page: int | None = None, next_link: str | None = None, column: str = "html") -> DataFrame:
    """The landed pages (listing, page, url, html) of each listing up to its last one.

    A listing ends with its first page without a card, with fewer than ``per_page`` cards, or without a link that matches
    ``next_link``; what was landed beyond is left out. Null pages have no card.
    """
    cards = F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(rf'class="(?:[^"]*\s)?{card}(?:\s[^"]*)?"'))
    ends = cards == 0
    if per_page:
        ends = ends | (cards < per_page)
    if next_link:
        ends = ends | ~F.coalesce(F.col(column).rlike(next_link), F.lit(False))
    before = Window.partitionBy("listing").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    marked = pages.withColumn("_cards", cards).withColumn("_over", F.coalesce(F.max(ends.cast("int")).over(before), F.lit(0)))
    return marked.filter("_over = 0 and _cards > 0").drop("_over", "_cards")


def json_pages(pages: DataFrame, size: int, schema: str, column: str = "payload") -> DataFrame:
    """The elements of landed JSON arrays (listing, offset, payload) of each listing, up to its first page shorter than ``size``."""
    read = pages.withColumn("_rows", F.from_json(column, schema))
    before = Window.partitionBy("listing").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    short = F.coalesce(F.size("_rows"), F.lit(0)) < size
    kept = read.withColumn("_over", F.coalesce(F.max(short.cast("int")).over(before), F.lit(0))).filter("_over = 0")
    return kept.select("listing", "offset", F.explode("_rows").alias("item"))


def two_level_categories(pages: DataFrame, pattern: str, skip: DataFrame | None = None, column: str = "html") -> DataFrame:
    """(href, parent) of category links on landed pages (url, html), sessions stripped, names on the skip list (cpath) left out; parents are the links' first code."""
    links = pages.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r'href="([^"]+)"'), F.lit(1))).alias("href")).filter(F.col("href").rlike(pattern))
    clean = links.select(strip_session(F.replace("href", F.lit("&amp;"), F.lit("&"))).alias("href")).withColumn("cpath", F.regexp_extract("href", r"cPath=([\d_]+)", 1)).distinct()
    kept = clean if skip is None else clean.join(skip.select("cpath"), "cpath", "left_anti")
    return kept.select("href", "cpath", F.substring_index("cpath", "_", 1).alias("parent")).orderBy("cpath", "href")


def sitemap_categories(sitemaps: DataFrame, pages: DataFrame, exclude: DataFrame, column: str = "xml") -> DataFrame:
    """(slug, name) of the collections in landed sitemaps, the excluded slugs left out; of the pages' navigation where no sitemap names one."""
    slugs = lambda frame, c, pattern: frame.select(F.explode(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(1))).alias("slug")).distinct()
    mapped = slugs(sitemaps, column, r"<loc>[^<]*/collections/([\w-]+)</loc>")
    found = slugs(pages, "html", r'href="[^"]*/collections/([\w-]+)') if mapped.isEmpty() else mapped
    return found.join(exclude.select("slug"), "slug", "left_anti").select("slug", title_from_slug(F.col("slug")).alias("name")).orderBy("slug")


def sector_url(prefix: str, department: Column, sector: Column, description: Column) -> Column:
    """A pseudo-URL of a department's sector: ``prefix:d:s:description``."""
    return F.concat_ws(":", F.lit(prefix), department, sector, description)


def sector_of(url: Column) -> Column:
    """(department, sector, description) of a pseudo-URL; the description may hold colons."""
    parts = F.split(url, ":", 4)
    return F.struct(F.get(parts, F.lit(1)).alias("department"), F.get(parts, F.lit(2)).alias("sector"), F.get(parts, F.lit(3)).alias("description"))


def single_pass(spark: SparkSession, name: str = "all") -> DataFrame:
    """The one category of a source that lists everything at once."""
    return spark.createDataFrame([(name,)], "href string")


def unit_cards(pages: DataFrame, card: str = "product-card") -> DataFrame:
    """Shop cards with variant links: variant id as SKU, the price before ``x UN``, units a bulk, bulk price to cents, sold-out flag."""
    cards = payloads.html_cards(pages, card)
    text = F.array_join("texts", "\n")
    unit = F.coalesce(comma_price(F.nullif(F.regexp_extract(text, r"(?is)\$\s*([\d.]+(?:,\d+)?)\s*x\s*un\b", 1), F.lit(""))), comma_price(F.nullif(F.regexp_extract(text, r"\$\s*([\d.]+(?:,\d+)?)", 1), F.lit(""))))
    bulk = F.nullif(F.regexp_extract(text, r"(?i)(?:bulto|caja|pack)\s*(?:de|x)?\s*(\d+)", 1), F.lit("")).try_cast("int")
    return cards.select(
        F.nullif(F.regexp_extract("href", r"variant=(\d+)", 1), F.lit("")).alias("sku"),
        F.get("texts", F.lit(0)).alias("name"),
        title_from_slug(F.regexp_extract("url", r"/collections/([\w-]+)", 1)).alias("category"),
        unit.alias("price_unit"),
        (F.floor(unit * bulk * 100 + 0.5) / 100).alias("price_bulk"),
        F.when(F.lower(text).contains("agotado"), "sin stock").otherwise("disponible").alias("stock"),
        bulk.alias("units_per_package"),
    ).filter("sku is not null")


def collection_sample(pages: DataFrame, column: str = "payload") -> DataFrame:
    """(id, title, vendor, sku, price) of each product of landed collection JSON, by its first variant; unreadable payloads give none."""
    item = pages.select(F.explode(F.from_json(column, f"struct<{COLLECTION_JSON}>").getField("products")).alias("p"))
    first = F.get(F.col("p.variants"), F.lit(0))
    return item.select("p.id", "p.title", "p.vendor", first["sku"].alias("sku"), first["price"].try_cast("double").alias("price"))
