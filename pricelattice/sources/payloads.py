"""Landed payloads of supplier sites (JSON, JSONP, HTML) to listing records.

Network access is no part of the engine: payloads are read as text, one a row, and parsed here. A payload that
can't be read gives no record. Records: sku, name, category, price_unit, price_bulk, stock.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelattice.functions.num import comma_price, decode_price, dot_price

RECORD = "sku string, name string, category string, price_unit double, price_bulk double, stock string"
STORE_JSON = (
    "productName string, link string, categories array<string>, items array<struct<ean string, itemId string, "
    "sellers array<struct<commertialOffer struct<Price double, AvailableQuantity int, Installments array<struct<Value double>>>>>>>"
)
CATALOG_JSON = "id string, trademark string, largeDescription string, smallDescription string, price double, priceWithTax string, stock string, unidsPerPackage string, packsPerPallet string"


def unwrap_jsonp(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\((.+)\)", 1)


def _whole(c: Column) -> Column:
    return c.try_cast("int")


def store_products(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Store JSON arrays: first item and seller; bulk price is the first instalment, else the unit price."""
    p = payloads.select(F.explode(F.from_json(column, f"array<struct<{_typed(STORE_JSON)}>>")).alias("p")).filter("p is not null")
    item = F.get(F.col("p.items"), F.lit(0))
    offer = F.get(item["sellers"], F.lit(0))["commertialOffer"]
    path = F.get(F.col("p.categories"), F.lit(0))
    return p.select(
        F.coalesce(F.nullif(item["ean"], F.lit("")), item["itemId"]).alias("sku"),
        F.col("p.productName").alias("name"),
        F.element_at(F.split(F.trim(path, F.lit("/")), "/"), -1).alias("category"),
        offer["Price"].alias("price_unit"),
        F.coalesce(F.get(offer["Installments"], F.lit(0))["Value"], offer["Price"]).alias("price_bulk"),
        F.when(offer["AvailableQuantity"] > 0, "disponible").otherwise("sin stock").alias("stock"),
    )


def _typed(ddl: str) -> str:
    """A column list as the inside of struct<>: ``a int`` becomes ``a: int`` at every level."""
    return re.sub(r"(?<=[\s<,])(\w+) (?=(?:string|double|int|array|struct))", r"\1: ", " " + ddl).strip()


def described_name(brand: Column, large: Column, small: Column) -> Column:
    """The longer description (ties: large) with the brand before it unless it starts with it."""
    blanks = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))
    brand, large, small = blanks(brand), blanks(large), blanks(small)
    text = F.when(F.length(large) >= F.length(small), large).otherwise(small)
    return F.when((brand == "") | F.startswith(F.upper(text), F.upper(brand)), text).otherwise(F.concat_ws(" ", brand, text))


def catalog_products(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Catalogue JSON arrays with coded prices; bulk price is unit price times units, to cents."""
    p = payloads.select(F.explode(F.from_json(column, f"array<struct<{_typed(CATALOG_JSON)}>>")).alias("p")).select("p.*")
    unit = F.coalesce(decode_price(F.col("priceWithTax")), F.col("price"))
    return p.select(
        F.col("id").alias("sku"),
        described_name(F.col("trademark"), F.col("largeDescription"), F.col("smallDescription")).alias("name"),
        F.lit(None).cast("string").alias("category"),
        unit.alias("price_unit"),
        F.round(unit * _whole(F.col("unidsPerPackage")), 2).alias("price_bulk"),
        "stock",
        _whole(F.col("unidsPerPackage")).alias("units_per_package"),
        _whole(F.col("packsPerPallet")).alias("packs_per_pallet"),
    )


class _Cards(HTMLParser):
    """Texts and links of each element of a class, nested elements included."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, card: str):
        super().__init__()
        self.card, self.deep, self.cards = card, 0, []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.deep:
            self.deep += tag not in self.VOID
        elif self.card in (attrs.get("class") or "").split() or tag == self.card:
            self.deep = 1
            self.cards.append({"texts": [], "href": None})
        if self.deep:
            if tag == "a" and attrs.get("href") and not self.cards[-1]["href"]:
                self.cards[-1]["href"] = attrs["href"]

    def handle_endtag(self, tag):
        if self.deep and tag not in self.VOID:
            self.deep -= 1

    def handle_data(self, data):
        if self.deep and data.strip():
            self.cards[-1]["texts"].append(" ".join(data.split()))


def html_cards(pages: DataFrame, card: str, column: str = "html") -> DataFrame:
    """(url, href, texts) of each element of the class (or tag) ``card`` in each page; broken markup is read as far as it goes."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url, html in zip(frame["url"], frame[column]):
                parser = _Cards(card)
                parser.feed(html or "")
                out.extend((url, c["href"], c["texts"]) for c in parser.cards)
            yield pd.DataFrame(out, columns=["url", "href", "texts"])

    return pages.select("url", column).mapInPandas(parse, "url string, href string, texts array<string>")


def shop_cards(pages: DataFrame, card: str = "product-item") -> DataFrame:
    """Shop pages: the first price of a card is the bulk price, the second the unit price; the SKU follows its label."""
    cards = html_cards(pages, card)
    text = F.array_join("texts", "\n")
    prices = F.regexp_extract_all(text, F.lit(r"\$\s*([\d.]+(?:,\d+)?)"), F.lit(1))
    return cards.select(
        F.nullif(F.regexp_extract(text, r"(?i)sku:?\s*(\w+)", 1), F.lit("")).alias("sku"),
        F.get("texts", F.lit(0)).alias("name"),
        category_from_path(F.col("url")).alias("category"),
        comma_price(F.get(prices, F.lit(1))).alias("price_unit"),
        comma_price(F.get(prices, F.lit(0))).alias("price_bulk"),
        F.when(F.lower(text).contains("agotado"), "sin stock").otherwise("unknown").alias("stock"),
    ).filter("sku is not null")


def table_rows(pages: DataFrame) -> DataFrame:
    """Table rows with a product link: prices with a decimal dot (net, gross), id from the link, units a box as stock."""
    rows = html_cards(pages, "tr")
    text = F.array_join("texts", "\n")
    prices = F.regexp_extract_all(text, F.lit(r"\$([\d.]+)"), F.lit(1))
    return rows.select(
        F.nullif(F.regexp_extract("href", r"products_id=(\d+)", 1), F.lit("")).alias("sku"),
        F.get("texts", F.lit(0)).alias("name"),
        F.regexp_extract("url", r"[?&]cPath=([\d_]+)", 1).alias("category"),
        dot_price(F.get(prices, F.lit(0))).alias("price_unit"),
        dot_price(F.get(prices, F.lit(1))).alias("price_bulk"),
        F.concat(F.lit("uxb:"), F.regexp_extract(text, r"(?i)u\s*x\s*b:?\s*(\d+)", 1)).alias("stock"),
    ).filter("sku is not null")


def category_from_path(url: Column) -> Column:
    """``/a-b/c.html`` → ``A B > C``."""
    parts = F.filter(F.split(F.regexp_replace(F.parse_url(url, F.lit("PATH")), r"\.html$", ""), "/"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.initcap(F.replace(p, F.lit("-"), F.lit(" ")))), " > ")


def category_links(pages: DataFrame, pattern: str, column: str = "html") -> DataFrame:
    """Distinct links of the pages that match the pattern, in order."""
    links = pages.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r'href="([^"]+)"'), F.lit(1))).alias("href"))
    return links.filter(F.col("href").rlike(pattern)).distinct().orderBy("href")


def category_codes(links: DataFrame) -> DataFrame:
    """(cpath, name): the first name of each code, upper case, in the numeric order of the code's parts. Needs place, cpath, name."""
    first = links.filter("cpath is not null").groupBy("cpath").agg(F.min_by("name", "place").alias("name"))
    return first.select("cpath", F.upper("name").alias("name")).orderBy(F.transform(F.split("cpath", "_"), lambda x: x.cast("int")))
