"""Adapters over landed pages, SQL functions and commands."""

import json

import pytest
from pyspark.sql import functions as F

from pricelattice.__main__ import main
from pricelattice.functions.registry import register_functions
from pricelattice.sources import adapters, payloads


def test_registry(spark):
    known = adapters.Registry(adapters.Adapter("a", "AA", lambda p: payloads.category_links(p, "html$"), payloads.shop_cards, {"language": "es"}), adapters.Adapter("b", "BB", lambda p: p, payloads.table_rows))
    assert known.get("a").short_code == "AA" and {tuple(r) for r in known.frame(spark).collect()} == {("a", "AA"), ("b", "BB")}
    with pytest.raises(ValueError, match="unknown supplier"):
        known.get("c")
    assert adapters.single_pass(spark).first().href == "all"


def test_pages_of_a_listing(spark):
    card, more = '<div class="x card">a</div>', '<a class="next" href="?p=2">'
    rows = [("l", 1, card * 2 + more), ("l", 2, card * 2 + more), ("l", 3, card), ("l", 4, card * 2 + more), ("m", 1, "none"), ("m", 2, card), ("n", 1, None)]
    pages = spark.createDataFrame(rows, "listing string, page int, html string")
    assert [(r.listing, r.page) for r in adapters.listing_pages(pages, "card").orderBy("listing", "page").collect()] == [("l", 1), ("l", 2), ("l", 3), ("l", 4)]
    assert [r.page for r in adapters.listing_pages(pages, "card", per_page=2).orderBy("page").collect()] == [1, 2, 3]
    assert [r.page for r in adapters.listing_pages(pages, "card", next_link='class="next"').orderBy("page").collect()] == [1, 2, 3]
    items = spark.createDataFrame([("l", 0, "[1, 2]"), ("l", 2, "[3]"), ("l", 4, "[4, 5]"), ("m", 0, "broken")], "listing string, offset int, payload string")
    assert sorted(r.item for r in adapters.json_pages(items, 2, "array<int>").collect()) == [1, 2, 3]


def test_discovery(spark):
    html = '<a href="/i?cPath=1&amp;osCsid=9a">A</a><a href="/i?cPath=1_12">B</a><a href="/i?cPath=7">skip</a><a href="/other">x</a>'
    pages = spark.createDataFrame([("u", html), ("v", None)], "url string, html string")
    found = adapters.two_level_categories(pages, "cPath=", spark.createDataFrame([("7",)], "cpath string"))
    assert [(r.cpath, r.parent) for r in found.collect()] == [("1", "1"), ("1_12", "1")] and "osCsid" not in found.first().href
    maps = spark.createDataFrame([("<loc>https://a.test/collections/dulces-y-miel</loc><loc>https://a.test/collections/all</loc>",)], "xml string")
    nav, out = spark.createDataFrame([('<a href="/collections/te">',)], "html string"), spark.createDataFrame([("all",)], "slug string")
    assert [tuple(r) for r in adapters.sitemap_categories(maps, nav, out).collect()] == [("dulces-y-miel", "Dulces Y Miel")]
    assert [r.slug for r in adapters.sitemap_categories(maps.limit(0), nav, out).collect()] == ["te"]
    one = spark.createDataFrame([("3", "9", "Té: verde")], "d string, s string, n string").select(adapters.sector_url("x", F.col("d"), F.col("s"), F.col("n")).alias("u"))
    assert one.first().u == "x:3:9:Té: verde" and tuple(one.select(adapters.sector_of(F.col("u")).alias("p")).first().p) == ("3", "9", "Té: verde")


def test_cards(spark):
    html = '<div class="product-card"><a href="/p?variant=77">Miel</a><p>$1.234,50 x UN</p><p>Bulto x 12</p></div><div class="product-card"><a href="/p?variant=78">Sal</a><p>$10,00</p><b>Agotado</b></div><div class="product-card">no link</div>'
    got = adapters.unit_cards(spark.createDataFrame([("https://a.test/collections/dulces", html), ("u", None)], "url string, html string")).collect()
    assert [(r.sku, r.name, r.category, r.price_unit, r.price_bulk, r.stock, r.units_per_package) for r in got] == [("77", "Miel", "Dulces", 1234.5, 14814.0, "disponible", 12), ("78", "Sal", "Dulces", 10.0, None, "sin stock", None)]
    page = json.dumps({"products": [{"id": 1, "title": "Miel", "vendor": "Ab", "variants": [{"id": 2, "sku": "s", "price": "1.5"}]}, {"id": 3, "title": "Sal", "variants": []}]})
    sample = adapters.collection_sample(spark.createDataFrame([(page,), ("broken",), (None,)], "payload string")).collect()
    assert [tuple(r) for r in sample] == [(1, "Miel", "Ab", "s", 1.5), (3, "Sal", None, None, None)]
    assert payloads.store_products(spark.createDataFrame([("broken",), (None,)], "payload string")).count() == 0


def test_sql_functions(spark):
    names = register_functions(spark)
    assert names == ["ascii_fold", "normalize_brand", "canonical_key", "parse_ar_price", "token_sort_ratio"]
    row = spark.sql("select ascii_fold('Piñón °') a, normalize_brand('Ñandú S.A.') b, canonical_key('Ñu', null, 'b a', 'W5') c, parse_ar_price('$1.234,56') d, token_sort_ratio('a b', 'b a') e, normalize_brand('!!') f").first()
    assert tuple(row) == ("Pinon ", "NANDU S A", "NU|?|A B|W5", 1234.56, 100.0, None)


def test_commands(spark, tmp_path, capsys):
    import datetime as dt

    from tests.frames import frame
    from tests.test_entry import TABLES

    for name, (ddl, rows) in TABLES.items():
        frame(spark, rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda *a: (main(["--folder", str(tmp_path), *a]), capsys.readouterr().out)[1]
    assert "p6_found" in run("list") and "sim05_brand_report" in run("list")
    assert "Miel" in run("pipeline", "--dry-run", "--sample", "5") and "product_type" in run("pipeline", "--list-unmapped")
    run("pipeline", "--supplier", "norvalle", "--force", "--out", str(tmp_path / "done"))
    done = spark.read.parquet(str(tmp_path / "done")).collect()
    assert {r.supplier for r in done if r.classification_status == "pending"} >= {"norvalle", "pasoviejo"}
    assert run("unify", "--suppliers", "pasoviejo,norvalle", "--top", "5") and run("unify", "--min-spread", "1000") is not None
    pages = spark.createDataFrame([("u", '<a href="/a/b.html">x</a>')], "url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    assert "/a/b.html" in run("discover", str(tmp_path / "pages"), "--pattern", r"\.html$")
    spark.createDataFrame([("1", "pasoviejo", 12.0, None, "x", dt.datetime(2025, 1, 1))], "sku string, supplier string, price_unit double, price_bulk double, stock string, last_scraped_at timestamp").write.parquet(str(tmp_path / "landed"))
    run("schedule", str(tmp_path / "landed"), str(tmp_path / "table"), str(tmp_path / "marks"))
    assert spark.read.parquet(str(tmp_path / "table" / "v1")).count() == 1
