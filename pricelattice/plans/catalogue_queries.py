"""Further registered queries of the catalogue: orders with places, panels, lookups, labels, stored periods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelattice.functions import fmt, keys, num, text
from pricelattice.operators import brands, compare, merge, periods, relational
from pricelattice.plans.reference_queries import _DIFF, _OFFERS, SUPPLIERS, _core, _daily, _DAILY, _fold, _half, _offers, _products
from pricelattice.session import read_table
from pricelattice.sources import lookups, payloads, writers
from pricelattice.streaming.periods import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = "2025-07-10"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


# --- Named queries, filters, orders -----------------------------------------------------------------------


@query("SELECT supplier, sku, name, brand, price_unit, row_number() OVER (ORDER BY name, supplier, sku, updated_at) AS place FROM (SELECT * FROM products WHERE price_unit IS NOT NULL ORDER BY name, supplier, sku, updated_at LIMIT 500)")
def qry02_comparison_input(s, d):
    return relational.ranked(_products(s, d).filter("price_unit is not null"), 500, *map(F.asc, ("name", "supplier", "sku", "updated_at"))).select("supplier", "sku", "name", "brand", "price_unit", "place")


@query("SELECT doc_id, array_to_string(tags, ', ') AS tag_text, created_at FROM documents ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 200")
def qry08_newest200(s, d):
    rows = read_table(s, d, "documents").select("doc_id", F.array_join("tags", ", ").alias("tag_text"), "created_at")
    return relational.top(rows, 200, F.desc_nulls_last("created_at"), F.asc("doc_id"))


@query("SELECT * FROM products WHERE supplier = 'norvalle'")
def qry15_of_supplier(s, d):
    return _products(s, d).filter("supplier = 'norvalle'")


@query("SELECT p.supplier, p.sku, p.name, h.price_unit, h.first_seen, h.last_seen, h.stock_flags FROM price_history h JOIN (SELECT supplier, sku, min(name) AS name FROM products WHERE supplier = 'norvalle' AND sku = (SELECT max(sku) FROM products WHERE supplier = 'norvalle') GROUP BY ALL) p ON h.supplier = p.supplier AND h.sku = p.sku")
def qry18_history_of_one(s, d):
    mine = _products(s, d, "supplier", "sku", "name").filter("supplier = 'norvalle'")
    one = mine.groupBy("supplier", "sku").agg(F.min("name").alias("name")).orderBy(F.desc("sku")).limit(1)
    return read_table(s, d, "price_history", "supplier", "sku", "price_unit", "first_seen", "last_seen", "stock_flags").join(one, ["supplier", "sku"]).orderBy("first_seen")


@query("SELECT classification_status AS status, classification_confidence AS confidence, count(*) AS n FROM products GROUP BY ALL")
def qry24_approval_counts(s, d):
    return _products(s, d).groupBy(F.col("classification_status").alias("status"), F.col("classification_confidence").alias("confidence")).agg(F.count("*").alias("n"))


@query("SELECT supplier, sku, size_unit FROM products WHERE size_unit IN ('kg', 'lt', 'ml')")
def flt02_among(s, d):
    return relational.among(_products(s, d, "supplier", "sku", "size_unit"), "size_unit", ["kg", "lt", "ml"])


@query("SELECT supplier, sku, name FROM products")
def flt06_visible(s, d):
    return relational.visible(_products(s, d), ["no_such_column"], ["supplier", "sku", "name"])


@query("SELECT supplier, sku, stock FROM products WHERE stock IN ('disponible', 'sin stock')")
def flt07_stock_status(s, d):
    return relational.among(_products(s, d, "supplier", "sku", "stock"), "stock", ["disponible", "sin stock"])


@query(f"SELECT supplier, sku, name, stock, price_unit FROM products WHERE regexp_matches(name, 'x', 'i') AND supplier IN ('norvalle', 'almadis') AND coalesce({_fold('trim(stock)')}, '') NOT IN ('sin stock', 'disponibilidad critica') AND price_unit BETWEEN 100 AND 5000")
def flt08_panel(s, d):
    return relational.panel(_products(s, d), "x", ["name"], {"supplier": ["norvalle", "almadis"], "size": []}, {"price_unit": (100, 5000)}, True).select("supplier", "sku", "name", "stock", "price_unit")


@query(f"WITH o AS ({_OFFERS}), m AS (SELECT k, {', '.join(f'''min(CASE WHEN supplier = '{x}' THEN price END) AS {x}''' for x in SUPPLIERS)} FROM o GROUP BY k) SELECT * FROM m WHERE coalesce({', '.join(SUPPLIERS)}) IS NOT NULL")
def flt10_hide_unpriced(s, d):
    suppliers = compare.suppliers_of(_products(s, d))
    return compare.hide_unpriced(compare.supplier_matrix(_offers(s, d), "k", suppliers), suppliers)


@query("SELECT supplier, sku, name FROM products WHERE classification_confidence = 'high' AND contains(lower(name), 'miel')")
def flt18_confident(s, d):
    return _products(s, d).filter("classification_confidence = 'high' and contains(lower(name), 'miel')").select("supplier", "sku", "name")


_SPREAD = f"""WITH o AS ({_OFFERS}), m AS (SELECT k, supplier, min(price) AS price FROM o WHERE price IS NOT NULL GROUP BY ALL),
g AS (SELECT k, count(*) AS n_suppliers, min(price) AS min_price, max(price) AS max_price FROM m GROUP BY k HAVING count(*) >= 2), x AS (SELECT *, CASE WHEN min_price > 0 THEN {_DIFF} END AS diff_pct FROM g)"""


def _spread(s, d):
    return compare.spread(compare.representative(_offers(s, d), "k"), "k")


@query(_SPREAD + " SELECT k, diff_pct, row_number() OVER (ORDER BY diff_pct DESC NULLS LAST, k) AS place FROM x QUALIFY place <= 300")
def srt02_by_difference(s, d):
    return relational.ranked(_spread(s, d).select("k", "diff_pct"), 300, F.desc_nulls_last("diff_pct"), F.asc("k"))


@query(
    """SELECT canonical_key, supplier, sku, row_number() OVER (ORDER BY split_part(canonical_key, '|', 1), split_part(canonical_key, '|', 2), canonical_key, supplier, sku) AS place
FROM (SELECT DISTINCT canonical_key, supplier, sku FROM products WHERE canonical_key IS NOT NULL) QUALIFY place <= 300"""
)
def srt03_by_key_parts(s, d):
    part = lambda n: F.get(F.split("canonical_key", "[|]"), F.lit(n))
    rows = _products(s, d).filter("canonical_key is not null").select("canonical_key", "supplier", "sku").distinct()
    return relational.ranked(rows, 300, part(0).asc(), part(1).asc(), F.asc("canonical_key"), F.asc("supplier"), F.asc("sku"))


@query("SELECT id, supplier, sku, first_seen, row_number() OVER (PARTITION BY supplier, sku ORDER BY first_seen, id) AS place FROM price_history")
def srt05_within_label(s, d):
    by = Window.partitionBy("supplier", "sku").orderBy("first_seen", "id")
    return read_table(s, d, "price_history", "id", "supplier", "sku", "first_seen").withColumn("place", F.row_number().over(by))


@query("SELECT supplier, sku, price_unit, row_number() OVER (ORDER BY price_unit ASC NULLS LAST, supplier, name, sku, updated_at) AS place FROM products WHERE supplier <> 'pasoviejo' QUALIFY place <= 400")
def srt01_nulls_last(s, d):
    rows = _products(s, d).filter("supplier <> 'pasoviejo'")
    return relational.ranked(rows, 400, F.asc_nulls_last("price_unit"), *map(F.asc, ("supplier", "name", "sku", "updated_at"))).select("supplier", "sku", "price_unit", "place")


@query("SELECT brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, brand) AS place FROM products WHERE brand IS NOT NULL GROUP BY brand QUALIFY place <= 200")
def srt04_by_total(s, d):
    return relational.ranked(_products(s, d).filter("brand is not null").groupBy("brand").agg(F.count("*").alias("n")), 200, F.desc("n"), F.asc("brand"))


@query("SELECT supplier, sku, name FROM (SELECT DISTINCT supplier, sku, name FROM products WHERE supplier = 'almadis') ORDER BY sku, name LIMIT 40")
def top02_first_products(s, d):
    return relational.top(_products(s, d, "supplier", "sku", "name").filter("supplier = 'almadis'").distinct(), 40, F.asc("sku"), F.asc("name"))


@query("SELECT supplier, sku FROM products WHERE supplier = 'norvalle' AND price_unit > 1000 AND brand IS NOT NULL")
def src24_parameters(s, d):
    return relational.query(s, "select supplier, sku from {p} where supplier = :supplier and price_unit > :least and brand is not null", {"p": _products(s, d)}, supplier="norvalle", least=1000)


@query("SELECT supplier, sku, classification_confidence AS confidence FROM products WHERE classification_status = 'pending' AND supplier = 'norvalle' AND classification_confidence = 'high'")
def src25_composed_filters(s, d):
    return relational.panel(_products(s, d), chosen={"classification_status": ["pending"], "supplier": ["norvalle"], "classification_confidence": ["high"], "brand": []}).select("supplier", "sku", F.col("classification_confidence").alias("confidence"))


@query("SELECT supplier, sku, name, category FROM products WHERE sku = (SELECT max(sku) FROM products) ORDER BY category NULLS LAST, supplier, name LIMIT 1")
def src27_point_lookup(s, d):
    last = _products(s, d).agg(F.max("sku").alias("sku"))
    rows = _products(s, d, "supplier", "sku", "name", "category").join(last, "sku", "left_semi")
    return relational.top(rows, 1, F.asc_nulls_last("category"), F.asc("supplier"), F.asc("name")).select("supplier", "sku", "name", "category")


# --- Joins and aggregations -------------------------------------------------------------------------------


@query(
    f"""WITH o AS ({_OFFERS}), m AS (SELECT k, min(price) AS least FROM o GROUP BY k), a AS (SELECT k, arg_min(name, {{'a': supplier, 'b': sku, 'c': updated_at, 'd': name}}) FILTER (name IS NOT NULL) AS name, min(supplier) AS supplier FROM o GROUP BY k)
SELECT m.k, m.least, a.name, a.supplier FROM m LEFT JOIN a ON m.k = a.k"""
)
def jon06_display_attributes(s, d):
    offers = _offers(s, d)
    return offers.groupBy("k").agg(F.min("price").alias("least")).join(compare.display_attributes(offers, "k", ["name", "supplier"], "supplier", "sku", "updated_at", "name"), "k", "left")


@query(f"WITH o AS ({_OFFERS}) SELECT k, arg_min(name, {{'a': supplier, 'b': sku, 'c': updated_at, 'd': name}}) FILTER (name IS NOT NULL) AS name, arg_min(price, {{'a': supplier, 'b': sku, 'c': updated_at, 'd': name}}) FILTER (price IS NOT NULL) AS price FROM o GROUP BY k")
def agg11_first_attributes(s, d):
    return compare.display_attributes(_offers(s, d), "k", ["name", "price"], "supplier", "sku", "updated_at", "name")


@query("SELECT coalesce(canonical_key, '?|?|?|?') AS canonical_key, count(*) AS listings, count(DISTINCT supplier) AS suppliers FROM products GROUP BY 1")
def agg06_key_groups(s, d):
    return compare.match_groups(_products(s, d, "canonical_key", "supplier"), 1)


@query("SELECT coalesce(canonical_key, '?|?|?|?') AS canonical_key, count(*) AS listings, count(DISTINCT supplier) AS suppliers FROM products GROUP BY 1 HAVING count(DISTINCT supplier) >= 2")
def jon11_match_groups(s, d):
    return compare.match_groups(_products(s, d, "canonical_key", "supplier"))


@query(_SPREAD + " SELECT k, n_suppliers, diff_pct, coalesce(diff_pct > 20, FALSE) AS wide FROM x")
def agg08_wide_spread(s, d):
    return _spread(s, d).select("k", "n_suppliers", "diff_pct", F.coalesce(F.col("diff_pct") > 20, F.lit(False)).alias("wide"))


_RATIO = f"""WITH o AS ({_OFFERS}), m AS (SELECT k, supplier, min(price) AS price FROM o GROUP BY ALL),
r AS (SELECT k, max(CASE WHEN supplier = 'pasoviejo' THEN price END) AS price_a, max(CASE WHEN supplier = 'norvalle' THEN price END) AS price_b FROM m GROUP BY k HAVING max(CASE WHEN supplier = 'pasoviejo' THEN price END) IS NOT NULL AND max(CASE WHEN supplier = 'norvalle' THEN price END) > 0),
x AS (SELECT *, floor(CAST(price_a AS DOUBLE) / CAST(price_b AS DOUBLE) * 10e0 + 0.5e0) / 10e0 AS ratio FROM r)"""


@query(_RATIO + " SELECT * FROM x WHERE ratio > 3 ORDER BY ratio DESC, k LIMIT 25")
def agg26_high_ratios(s, d):
    rows = compare.pair_ratio(compare.representative(_offers(s, d), "k"), "k", "pasoviejo", "norvalle").filter("ratio > 3")
    return relational.top(rows, 25, F.desc("ratio"), F.asc("k"))


@query(
    """SELECT r.id, r.supplier, r.status, count(s.id) AS written, count(DISTINCT s.sku) AS products FROM run_log r LEFT JOIN price_snapshots s ON s.supplier = r.supplier AND s.scraped_at = CAST(r.started_at AS DATE) GROUP BY ALL"""
)
def agg27_run_counters(s, d):
    runs = read_table(s, d, "run_log", "id", "supplier", "status", "started_at").withColumn("day", F.to_date("started_at"))
    made = read_table(s, d, "price_snapshots", "supplier", "sku", "scraped_at").groupBy("supplier", F.col("scraped_at").alias("day")).agg(F.count("*").alias("written"), F.countDistinct("sku").alias("products"))
    return runs.join(made, ["supplier", "day"], "left").fillna(0, ["written", "products"]).select("id", "supplier", "status", "written", "products")


@query("SELECT canonical_key, supplier, sku, coalesce(canonical_name, name) AS shown FROM products WHERE split_part(canonical_key, '|', -1) = '?'")
def snk15_uncertain_matches(s, d):
    return _products(s, d).filter(keys.low_confidence(F.col("canonical_key"))).select("canonical_key", "supplier", "sku", F.coalesce("canonical_name", "name").alias("shown"))


@query("SELECT canonical_key, supplier, sku, price_unit FROM products WHERE canonical_key IN (SELECT canonical_key FROM products GROUP BY 1 HAVING count(DISTINCT supplier) >= 2) AND canonical_key <> '?|?|?|?'")
def snk17_matched_products(s, d):
    rows = _products(s, d, "canonical_key", "supplier", "sku", "price_unit").filter("canonical_key <> '?|?|?|?'")
    return rows.join(compare.match_groups(rows).select("canonical_key"), "canonical_key", "left_semi").orderBy("canonical_key")


# The newest stored period of each listing after one more day, against its SQL.
@query(
    f"""WITH o AS (SELECT supplier, sku, max({{'p': price, 'f': flag}}) AS o FROM ({_DAILY}) WHERE day = (SELECT max(scraped_at) FROM price_snapshots) AND supplier IS NOT NULL AND sku IS NOT NULL GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY supplier, sku ORDER BY first_seen DESC, id DESC) AS n FROM price_history),
j AS (SELECT h.*, o.o, o.o IS NOT NULL AND n = 1 AND last_seen < DATE '2026-01-31' AS live, price_unit IS NOT DISTINCT FROM o.o.p AS same FROM h LEFT JOIN o ON h.supplier = o.supplier AND h.sku = o.sku),
f AS (SELECT *, stock_flags || repeat(coalesce(nullif(right(stock_flags, 1), ''), '1'), greatest(0, DATE '2026-01-31' - last_seen - 1)) AS filled FROM j)
SELECT id, supplier, sku, price_unit AS price, first_seen, CASE WHEN live AND same THEN DATE '2026-01-31' WHEN live THEN DATE '2026-01-30' ELSE last_seen END AS last_seen, CASE WHEN live AND same THEN filled || o.f WHEN live THEN filled ELSE stock_flags END AS stock_flags FROM f
UNION ALL SELECT NULL, supplier, sku, o.p, DATE '2026-01-31', DATE '2026-01-31', o.f FROM j WHERE live AND NOT same
UNION ALL SELECT NULL, o.supplier, o.sku, o.o.p, DATE '2026-01-31', DATE '2026-01-31', o.o.f FROM o WHERE NOT EXISTS (SELECT 1 FROM price_history h WHERE h.supplier = o.supplier AND h.sku = o.sku)"""
)
def snk02_upsert_day(s, d):
    last = read_table(s, d, "price_snapshots", "scraped_at").agg(F.max("scraped_at").alias("day"))
    seen = _daily(s, d).join(last, "day", "left_semi").filter("supplier is not null and sku is not null").select("supplier", "sku", "price", "flag")
    return periods.upsert_day(read_table(s, d, "price_history").withColumnRenamed("price_unit", "price"), seen, "2026-01-31")


@query("SELECT supplier, sku, price, first_seen, last_seen, stock_flags FROM (SELECT 'x' AS supplier, 'x' AS sku, CAST(1 AS DECIMAL(12,2)) AS price, DATE '2025-01-01' AS first_seen, DATE '2025-01-01' AS last_seen, '1' AS stock_flags) WHERE (SELECT count(*) FROM price_history) = 0")
def snk25_first_history(s, d):
    """No row where a history exists already."""
    return periods.first_history(read_table(s, d, "price_history"), _daily(s, d))


# --- Scalars ----------------------------------------------------------------------------------------------


@query("SELECT DISTINCT name, regexp_replace(strip_accents(replace(name, chr(65533), 'N')), '[^\\x00-\\x7F]', '', 'g') AS folded FROM products")
def str_f03_mended_fold(s, d):
    return _products(s, d, "name").select("name", text.mended_fold(F.col("name")).alias("folded")).distinct()


@query("SELECT DISTINCT category, nullif(trim(lower(strip_accents(category))), '') AS plain FROM products")
def str_f02_unaccent(s, d):
    return _products(s, d, "category").select("category", F.nullif(text.stripped(F.lower(text.unaccent(F.col("category")))), F.lit("")).alias("plain")).distinct()


_CANON = f"SELECT {_core('value')} AS k, min(value) AS canonical FROM ref_values WHERE field = 'brand' GROUP BY 1"


@query(f"SELECT DISTINCT brand, CASE WHEN brand = '' THEN brand ELSE coalesce(canonical, {_core('brand')}) END AS brand_norm FROM products LEFT JOIN ({_CANON}) ON {_core('brand')} = k")
def str_f07_normalize_brand(s, d):
    known = read_table(s, d, "ref_values").filter("field = 'brand'").groupBy(keys.brand_core(F.col("value")).alias("k")).agg(F.min("value").alias("canonical"))
    rows = _products(s, d, "brand").distinct().withColumn("k", keys.brand_core(F.col("brand")))
    return rows.join(known, "k", "left").select("brand", keys.normalized_brand(F.col("brand"), F.col("canonical")).alias("brand_norm"))


@query("SELECT DISTINCT name, trim(regexp_replace(replace(name, chr(160), ' '), '\\s+', ' ', 'g')) AS clean FROM products")
def str_f09_collapsed(s, d):
    return _products(s, d, "name").select("name", text.collapsed(F.col("name")).alias("clean")).distinct()


_TITLED = "array_to_string(list_transform(string_split(lower(trim(product_type)), ''), lambda c, i: CASE WHEN i > 1 AND regexp_matches(string_split(lower(trim(product_type)), '')[i - 1], '\\p{L}') THEN c ELSE upper(c) END), '')"


@query(f"SELECT DISTINCT product_type, brand, variant, size, nullif(concat_ws(' ', nullif({_TITLED}, ''), upper(nullif(trim(brand), '')), lower(nullif(trim(variant), '')), nullif(trim(size), '')), '') AS shown FROM products")
def str_f10_canonical_name(s, d):
    columns = ["product_type", "brand", "variant", "size"]
    return _products(s, d, *columns).select(*columns, keys.canonical_name(*[F.col(c) for c in columns]).alias("shown")).distinct()


@query("SELECT DISTINCT supplier, sku, upper(left(supplier, 3)) || '_' || sku AS id FROM products")
def str_f13_product_id(s, d):
    return _products(s, d, "supplier", "sku").select("supplier", "sku", keys.product_id(F.upper(F.left("supplier", F.lit(3))), F.col("sku")).alias("id")).distinct()


_PLAIN = lambda v: f"regexp_replace(regexp_replace(CAST(CAST({v} AS DECIMAL(18,4)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


@query(f"SELECT DISTINCT size_value, size_unit, CASE WHEN size_value IS NULL THEN NULL ELSE concat_ws(' ', {_PLAIN('size_value')}, size_unit) END AS shown FROM products")
def str_f14_size_text(s, d):
    shown = F.when(F.col("size_value").isNotNull(), F.concat_ws(" ", fmt.plain_number(F.col("size_value")), "size_unit"))
    return _products(s, d, "size_value", "size_unit").select("size_value", "size_unit", shown.alias("shown")).distinct()


@query(
    f"SELECT DISTINCT size_value, size_unit, concat_ws(' ', CASE WHEN size_value >= 1000 AND size_unit IN ('g', 'ml') THEN {_PLAIN('size_value / 1000e0')} ELSE {_PLAIN('size_value')} END, CASE WHEN size_value >= 1000 AND size_unit = 'g' THEN 'kg' WHEN size_value >= 1000 AND size_unit = 'ml' THEN 'l' ELSE size_unit END) AS shown FROM products WHERE size_value IS NOT NULL"
)
def str_f15_readable_size(s, d):
    return _products(s, d, "size_value", "size_unit").filter("size_value is not null").select("size_value", "size_unit", fmt.readable_size(F.col("size_value"), F.col("size_unit")).alias("shown")).distinct()


@query(
    f"SELECT DISTINCT units_per_package, size_value, size_unit, CASE WHEN size_value IS NOT NULL AND units_per_package > 1 THEN units_per_package || 'x' || concat_ws(' ', {_PLAIN('size_value')}, size_unit) WHEN size_value IS NOT NULL THEN concat_ws(' ', {_PLAIN('size_value')}, size_unit) WHEN units_per_package IS NOT NULL THEN units_per_package || ' uni' END AS shown FROM products"
)
def str_f16_composite_size(s, d):
    columns = ["units_per_package", "size_value", "size_unit"]
    return _products(s, d, *columns).select(*columns, fmt.composite_size(*[F.col(c) for c in columns]).alias("shown")).distinct()


@query("SELECT DISTINCT category, nullif(array_to_string(list_filter(list_transform(string_split(category, '>'), lambda p: trim(p)), lambda p: p <> ''), ' > '), '') AS joined FROM products WHERE category IS NOT NULL AND len(string_split(category, '>')) <= 3")
def str_f20_rejoined(s, d):
    c = F.col("category")
    return _products(s, d, "category").filter(c.isNotNull() & (F.size(F.split(c, ">")) <= 3)).select("category", keys.rejoined_path(*[keys.path_part(c, n) for n in range(3)]).alias("joined")).distinct()


@query("SELECT DISTINCT p.category, coalesce(c.name, regexp_replace(p.category, '\\s+\\d+$', '')) AS clean FROM products p LEFT JOIN category_codes c ON p.category = c.cpath")
def str_f22_mapped_category(s, d):
    codes = read_table(s, d, "category_codes").select(F.col("cpath").alias("category"), "name")
    return _products(s, d, "category").distinct().join(codes, "category", "left").select("category", F.coalesce("name", F.regexp_replace("category", r"\s+\d+$", "")).alias("clean"))


@query("SELECT DISTINCT name, replace(name, 'Pa Ales', 'Pañales') AS mended FROM products")
def str_f24_mended_words(s, d):
    return _products(s, d, "name").select("name", text.mended_words(F.col("name")).alias("mended")).distinct()


@query("SELECT supplier, sku, name || CASE WHEN price_unit IS NULL THEN ' (sin precio)' ELSE '' END AS label FROM products")
def str_f28_unpriced(s, d):
    return _products(s, d).select("supplier", "sku", keys.unpriced_label(F.col("name"), F.col("price_unit")).alias("label"))


# Labels of a few words in some languages.
LABELS = {("en", "price"): "Price", ("es", "price"): "Precio", ("pt", "price"): "Preço", ("en", "stock"): "Stock"}


@query("SELECT doc_id, CASE lang WHEN 'es' THEN 'Precio' WHEN 'pt' THEN 'Preço' ELSE 'Price' END AS price, 'Stock' AS stock, 'missing' AS missing FROM documents")
def str_f29_labels(s, d):
    label = lambda k: keys.translated(F.lit(k), F.coalesce("lang", F.lit("")), LABELS).alias(k)
    return read_table(s, d, "documents", "doc_id", "lang").select("doc_id", label("price"), label("stock"), label("missing"))


@query("SELECT id, CASE WHEN price_unit * 100000 <= 9999999999.99 THEN CAST(price_unit * 100000 AS DOUBLE) END AS price FROM (SELECT id, CAST(price_unit AS DECIMAL(30,2)) AS price_unit FROM price_snapshots)")
def num_f02_bounded_price(s, d):
    """Prices a hundred thousand times too high, written the Argentine way; the impossible ones are no price."""
    rows = read_table(s, d, "price_snapshots", "id", "price_unit").withColumn("p", F.col("price_unit").cast("decimal(30,2)") * 100_000)
    return rows.select("id", num.comma_price(F.concat(F.lit("$"), F.translate(F.format_number("p", 2), ",.", ".,")), 9_999_999_999.99).alias("price"))


@query("SELECT id, CAST(price_unit AS DOUBLE) AS price FROM price_snapshots")
def num_f03_dot_price(s, d):
    return read_table(s, d, "price_snapshots", "id", "price_unit").select("id", num.dot_price(F.concat(F.lit("$ "), F.col("price_unit").cast("string"))).alias("price"))


@query("SELECT DISTINCT sku, CASE WHEN regexp_matches(sku, '^\\s*[+-]?\\d+(\\.\\d*)?\\s*$') THEN TRY_CAST(sku AS DOUBLE) END AS number FROM products")
def num_f04_float(s, d):
    return _products(s, d, "sku").select("sku", num.plain_float(F.col("sku")).alias("number")).distinct()


@query("SELECT DISTINCT size, TRY_CAST(replace(nullif(regexp_extract(size, '\\d+,\\d+'), ''), ',', '.') AS DOUBLE) AS number FROM products")
def num_f05_comma_number(s, d):
    return _products(s, d, "size").select("size", num.comma_number(F.nullif(F.regexp_extract("size", r"\d+,\d+", 0), F.lit(""))).alias("number")).distinct()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn02_jsonp(s, d):
    wrapped = F.concat(F.lit("done("), "props", F.lit(");"))
    return read_table(s, d, "events", "event_id", "props").select("event_id", F.from_json(payloads.unwrap_jsonp(wrapped), "k bigint").getField("k").alias("k"))


@query("SELECT DISTINCT url, url AS plain FROM products WHERE url IS NOT NULL AND NOT contains(url, '?')")
def url01_stripped(s, d):
    rows = _products(s, d, "url").filter("url is not null and not contains(url, '?')")
    return rows.select("url", keys.strip_session(F.concat("url", F.lit("?osCsid=0a1b&page=3&sort=2a"))).alias("plain")).distinct()


# --- Pages, updates, windows ------------------------------------------------------------------------------


@query("SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(text, 'href=\"([^\"]+)\"', 1)) AS href FROM documents) WHERE regexp_matches(href, '[.]html$')")
def src12_category_links(s, d):
    return payloads.category_links(read_table(s, d, "documents", "text"), r"[.]html$", "text")


@query(
    """SELECT DISTINCT url, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '[.]html$', ''), '/'), lambda p: p <> ''),
  lambda p: array_to_string(list_transform(string_split(replace(lower(p), '-', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')), ' > ') AS category FROM products WHERE regexp_matches(url, '^https?://[^/]+/')"""
)
def src19_category_from_path(s, d):
    return _products(s, d, "url").filter(F.col("url").rlike("^https?://[^/]+/")).select("url", payloads.category_from_path(F.col("url")).alias("category")).distinct()


@query("SELECT cpath, cpath AS found FROM category_codes WHERE cpath IS NOT NULL")
def src20_category_from_query(s, d):
    url = F.concat(F.lit("https://a.test/index.php?page=2&cPath="), "cpath", F.lit("#top"))
    return read_table(s, d, "category_codes", "cpath").filter("cpath is not null").select("cpath", F.parse_url(url, F.lit("QUERY"), F.lit("cPath")).alias("found"))


@query("SELECT DISTINCT value, array_to_string(list_transform(string_split(lower(value), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM ref_values WHERE field = 'product_type'")
def src21_title_from_slug(s, d):
    slug = F.replace(F.lower("value"), F.lit(" "), F.lit("-"))
    return read_table(s, d, "ref_values").filter("field = 'product_type'").select("value", keys.title_from_slug(slug).alias("title")).distinct()


@query("SELECT cpath, upper(min(name)) AS name FROM category_codes WHERE cpath IS NOT NULL GROUP BY cpath")
def src26_code_map(s, d):
    codes = read_table(s, d, "category_codes")
    links = codes.withColumn("place", F.lit(1)).unionByName(codes.withColumn("place", F.lit(2)).withColumn("name", F.lit("later")))
    return payloads.category_codes(links)


@query("SELECT p.supplier, p.sku, p.updated_at, coalesce(n.brand, p.brand) AS brand FROM products p LEFT JOIN (SELECT supplier, sku, max(lower(brand)) AS brand FROM products GROUP BY ALL) n ON p.supplier = n.supplier AND p.sku = n.sku")
def snk05_full_update(s, d):
    rows = _products(s, d, "supplier", "sku", "updated_at", "brand")
    return merge.overwrite_where(rows, rows.groupBy("supplier", "sku").agg(F.max(F.lower("brand")).alias("brand")), ["supplier", "sku"], ["brand"], "true")


@query("SELECT '|' || rpad(coalesce(name, ''), 20, ' ') || '|' || rpad(coalesce(brand, ''), 12, ' ') || '|' AS line FROM products")
def snk20_dry_run_lines(s, d):
    return writers.fixed_width_lines(_products(s, d, "name", "brand"), {"name": 20, "brand": 12})


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def str07_daily_windows(s, d):
    """Tumbling windows; the same function takes a stream. An extension beyond the inventory."""
    zoneless = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return windowed_counts(read_table(s, d, "events"), "tumbling", "1 day").select(zoneless("start"), zoneless("end"), "event_type", "n")


# --- Lookup lists, from lines as files have them ----------------------------------------------------------


def _lines(s, d, field: str, value) -> DataFrame:
    return read_table(s, d, "ref_values").filter(F.col("field") == field).select(F.col("ref_id").alias("line"), value.alias("value"))


@query("SELECT upper(trim(value)) AS value FROM ref_values WHERE field = 'brand'")
def dim01_upper_lines(s, d):
    return lookups.useful_lines(_lines(s, d, "brand", F.concat(F.lit("  "), "value")), upper=True).select("value")


@query("SELECT value FROM ref_values WHERE field = 'product_type' AND ref_id % 2 = 0")
def dim02_lines(s, d):
    commented = F.when(F.col("ref_id") % 2 == 0, F.concat("value", F.lit("  "))).otherwise(F.concat(F.lit("# "), "value"))
    return lookups.useful_lines(_lines(s, d, "product_type", commented)).select("value")


@query(f"SELECT upper({_fold('value')}) AS variant, arg_max(value, ref_id) AS canonical FROM ref_values WHERE field = 'product_type' GROUP BY 1")
def dim03_aliases(s, d):
    return lookups.read_aliases(_lines(s, d, "product_type", F.concat("value", F.lit("="), "value")))


@query(f"SELECT {_core('value')} AS variant, arg_max(value, ref_id) AS canonical FROM ref_values WHERE field = 'brand' GROUP BY 1")
def dim04_brand_aliases(s, d):
    return lookups.read_aliases(_lines(s, d, "brand", F.concat("value", F.lit("="), "value")), brands=True)


@query(f"SELECT upper({_fold('trim(split_part(value, chr(62), 2))')}) AS kind, arg_max(trim(split_part(value, '>', 1)), ref_id) AS dept, arg_max(trim(split_part(value, '>', 2)), ref_id) AS sub FROM ref_values WHERE field = 'category' GROUP BY 1")
def dim05_taxonomy(s, d):
    dept, sub = keys.path_part(F.col("value"), 0), keys.path_part(F.col("value"), 1)
    return lookups.read_taxonomy(_lines(s, d, "category", F.concat_ws("|", dept, sub, sub)))


@query("SELECT cpath, name FROM category_codes")
def dim06_codes(s, d):
    return lookups.read_codes(read_table(s, d, "category_codes").select(F.lit(1).alias("line"), F.concat_ws("=", "cpath", "name").alias("value")))


@query("SELECT value, row_number() OVER (ORDER BY length(value) DESC, value) AS place FROM (SELECT DISTINCT value FROM ref_values WHERE field = 'brand') QUALIFY place <= 100")
def dim07_longest_first(s, d):
    return relational.ranked(read_table(s, d, "ref_values").filter("field = 'brand'").select("value").distinct(), 100, *lookups.longest_order())


@query("SELECT value, row_number() OVER (ORDER BY len(string_split(value, ' ')) DESC, length(value) DESC, value) AS place FROM (SELECT DISTINCT value FROM ref_values WHERE field = 'product_type') QUALIFY place <= 100")
def dim08_most_words_first(s, d):
    return relational.ranked(read_table(s, d, "ref_values").filter("field = 'product_type'").select("value").distinct(), 100, *lookups.longest_order(by_words=True))


@query("SELECT DISTINCT trim(value) AS brand FROM ref_values WHERE field = 'brand' AND lower(value) <> 'generico' AND ref_id > (SELECT min(ref_id) FROM ref_values WHERE field = 'brand')")
def dim09_table_brands(s, d):
    return lookups.read_table_brands(_lines(s, d, "brand", F.concat(F.lit("| "), F.rpad("value", 40, " "), F.lit("|"))))


@query()
def str_f08_clean_name(s, d):
    return _products(s, d, "name").distinct().select("name", text.clean_name(F.col("name")).alias("clean"), text.collapsed(text.compatible(F.col("name"))).alias("plain"))


# --- Reports that SQL can't say; the tests check them -----------------------------------------------------


@query()
def sim05_brand_report(s, d):
    return brands.brand_report(_products(s, d, "brand", "supplier"))


@query()
def sim06_review_list(s, d):
    return brands.review_list(_products(s, d, "brand", "supplier"), least=70.0)
