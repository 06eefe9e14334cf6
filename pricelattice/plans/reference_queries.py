"""Registered queries of the catalogue operators, each beside SQL that says the same.

Every query runs over its whole tables; a limit stands only where the top rows are the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.functions import fmt, keys, num, text
from pricelattice.operators import brands, compare, merge, name_readers, periods, relational
from pricelattice.session import read_table
from pricelattice.sources import payloads, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# All sellers of the test tables, for the columns that SQL must name; the queries read them from the data.
SUPPLIERS = (
    "almadis bahiacenter cumbredis don_ombu faroltrade granpuerto islamayor jacarandis kioskred litoralmax lomadulce mesopampa molinoeste nandubay norvalle "
    "ortizales pasoviejo piedrasur quebrachal rionegro2 sauceverde tilcardis tresarroyo vegabaja"
).split()
AS_OF = "2025-07-10"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


# The SQL spellings of shared expressions.
def _fold(c: str) -> str:
    return f"lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g'))"


def _core(c: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(upper(strip_accents({c})), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '')"


def _half(c: str, digits: int = 2) -> str:
    return f"floor(CAST({c} AS DOUBLE) * {10**digits}e0 + 0.5e0) / {10**digits}e0"


_DIFF = _half("(CAST(max_price AS DOUBLE) - CAST(min_price AS DOUBLE)) / CAST(min_price AS DOUBLE) * 100e0")
_OFFERS = f"""SELECT {_core("brand")} || '|' || {_core("product_type")} AS k, supplier, sku, updated_at, price_unit AS price, name
  FROM products WHERE {_core("brand")} IS NOT NULL AND {_core("product_type")} IS NOT NULL"""
_DAILY = """SELECT supplier, sku, scraped_at AS day, price_unit AS price, CASE WHEN lower(trim(stock)) = 'sin stock' THEN '0' ELSE '1' END AS flag
  FROM (SELECT *, row_number() OVER (PARTITION BY supplier, sku, scraped_at ORDER BY id DESC) AS n FROM price_snapshots) WHERE n = 1"""


def _products(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(s, d, "products", *columns)


def _offers(s: SparkSession, d: str) -> DataFrame:
    key = F.concat(keys.brand_core(F.col("brand")), F.lit("|"), keys.brand_core(F.col("product_type")))
    return _products(s, d).select(key.alias("k"), "supplier", "sku", "updated_at", F.col("price_unit").alias("price"), "name").filter("k is not null")


def _daily(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "price_snapshots", "supplier", "sku", "scraped_at", "id", "price_unit", "stock")
    latest = relational.latest_by(rows, ["supplier", "sku", "scraped_at"], ["price_unit", "stock"], "id")
    flag = F.when(F.lower(F.trim("stock")) == "sin stock", "0").otherwise("1")
    return latest.select("supplier", "sku", F.col("scraped_at").alias("day"), F.col("price_unit").alias("price"), flag.alias("flag"))


# --- Scans, filters, orders -------------------------------------------------------------------------------


@query("SELECT supplier, sku, name, price_unit, price_bulk FROM products WHERE price_unit IS NOT NULL")
def qry01_latest(s, d):
    return _products(s, d).filter("price_unit is not null").select("supplier", "sku", "name", "price_unit", "price_bulk").orderBy("supplier", "name")


@query("SELECT supplier, sku, name, price_unit FROM products WHERE supplier IN ('pasoviejo', 'norvalle')")
def qry03_suppliers(s, d):
    return _products(s, d).filter(F.col("supplier").isin("pasoviejo", "norvalle")).select("supplier", "sku", "name", "price_unit")


@query("SELECT supplier, sku, name, price_unit FROM products WHERE supplier <> 'pasoviejo'")
def qry04_browse(s, d):
    return _products(s, d).filter("supplier <> 'pasoviejo'").select("supplier", "sku", "name", "price_unit").orderBy(F.asc_nulls_last("price_unit"), "supplier", "name")


@query("SELECT supplier, sku, canonical_key FROM products WHERE canonical_key IS NOT NULL AND canonical_key <> '?|?|?|?'")
def qry05_comparable(s, d):
    return _products(s, d).filter("canonical_key is not null and canonical_key <> '?|?|?|?'").select("supplier", "sku", "canonical_key")


@query("SELECT supplier, sku, name FROM products p WHERE EXISTS (SELECT 1 FROM price_history h WHERE h.supplier = p.supplier AND h.sku = p.sku)")
def qry06_has_history(s, d):
    return _products(s, d, "supplier", "sku", "name").join(read_table(s, d, "price_history", "supplier", "sku"), ["supplier", "sku"], "left_semi")


@query("SELECT count(*) AS listings, count(DISTINCT supplier) AS suppliers, max(updated_at) AS latest FROM products")
def qry07_snapshot(s, d):
    return _products(s, d).agg(F.count("*").alias("listings"), F.countDistinct("supplier").alias("suppliers"), F.max("updated_at").alias("latest"))


@query("SELECT p.supplier, p.sku, p.name, h.price_unit, h.first_seen, h.last_seen FROM (SELECT supplier, sku, min(name) AS name FROM products WHERE category LIKE '%nfusiones' GROUP BY ALL) p JOIN price_history h ON p.supplier = h.supplier AND p.sku = h.sku")
def qry09_history_of(s, d):
    chosen = _products(s, d).filter("category like '%nfusiones'").groupBy("supplier", "sku").agg(F.min("name").alias("name"))
    return chosen.join(read_table(s, d, "price_history", "supplier", "sku", "price_unit", "first_seen", "last_seen"), ["supplier", "sku"])


@query("SELECT id, supplier, started_at, status FROM run_log ORDER BY started_at DESC, id DESC LIMIT 20")
def qry10_runs_top20(s, d):
    return relational.top(read_table(s, d, "run_log", "id", "supplier", "started_at", "status"), 20, F.desc("started_at"), F.desc("id"))


@query("SELECT supplier, classification_confidence AS confidence, count(*) AS n FROM products WHERE classification_status = 'pending' GROUP BY ALL")
def qry11_status_counts(s, d):
    return _products(s, d).filter("classification_status = 'pending'").groupBy("supplier", F.col("classification_confidence").alias("confidence")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT supplier, sku, classification_confidence AS confidence, updated_at FROM products ORDER BY confidence DESC NULLS FIRST, updated_at ASC NULLS LAST, supplier, sku LIMIT 100")
def qry12_queue_topk(s, d):
    rows = _products(s, d).select("supplier", "sku", F.col("classification_confidence").alias("confidence"), "updated_at").distinct()
    return relational.top(rows, 100, F.desc_nulls_first("confidence"), F.asc_nulls_last("updated_at"), F.asc("supplier"), F.asc("sku"))


@query("SELECT DISTINCT supplier FROM products")
def qry13_supplier_list(s, d):
    return _products(s, d).select("supplier").distinct().orderBy("supplier")


@query("SELECT supplier, sku, name, category FROM products WHERE canonical_key IS NULL")
def qry14_unread(s, d):
    return _products(s, d).filter("canonical_key is null").select("supplier", "sku", "name", "category")


@query("SELECT product_type, count(*) AS n FROM products WHERE product_type IS NOT NULL GROUP BY 1")
def qry17_type_counts(s, d):
    return _products(s, d).filter("product_type is not null").groupBy("product_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT brand, supplier, count(*) AS n FROM products WHERE brand IS NOT NULL AND lower(brand) <> 'generico' GROUP BY ALL")
def qry19_brand_counts(s, d):
    return _products(s, d).filter("brand is not null and lower(brand) <> 'generico'").groupBy("brand", "supplier").agg(F.count("*").alias("n"))


@query(
    """SELECT supplier, sku, scraped_at, price_unit FROM (SELECT *, row_number() OVER (PARTITION BY supplier, sku ORDER BY scraped_at DESC, id DESC) AS n
  FROM price_snapshots) WHERE n = 1"""
)
def qry20_latest_snapshot(s, d):
    rows = read_table(s, d, "price_snapshots", "supplier", "sku", "scraped_at", "id", "price_unit")
    return relational.latest_by(rows, ["supplier", "sku"], ["price_unit"], "scraped_at", "id").drop("id")


@query("SELECT supplier, sku, name FROM products WHERE length(trim(name)) < 30")
def qry21_short_names(s, d):
    return _products(s, d).filter(F.length(F.trim("name")) < 30).select("supplier", "sku", "name")


@query("SELECT id, supplier, status FROM run_log ORDER BY id DESC LIMIT 1")
def qry22_last_run(s, d):
    return relational.top(read_table(s, d, "run_log", "id", "supplier", "status"), 1, F.desc("id"))


@query("SELECT supplier, sku, name FROM products p WHERE sku IN (SELECT sku FROM price_history WHERE stock_flags = '')")
def qry23_lookup(s, d):
    wanted = read_table(s, d, "price_history", "sku", "stock_flags").filter("stock_flags = ''").select("sku")
    return _products(s, d, "supplier", "sku", "name").join(wanted, "sku", "left_semi").select("supplier", "sku", "name")


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM products)")
def qry25_columns(s, d):
    return s.createDataFrame([(n,) for n in _products(s, d).columns], "name string")  # the catalogue's columns, as the reader knows them


@query("SELECT supplier, sku, name, brand FROM products WHERE regexp_matches(name, 'vainilla|canela', 'i') OR regexp_matches(brand, 'vainilla|canela', 'i') OR regexp_matches(variant, 'vainilla|canela', 'i')")
def flt01_search(s, d):
    return relational.search(_products(s, d), "vainilla|canela", ["name", "brand", "variant"]).select("supplier", "sku", "name", "brand")


@query(f"SELECT supplier, sku, stock FROM products WHERE coalesce({_fold('trim(stock)')}, '') NOT IN ('sin stock', 'disponibilidad critica')")
def flt03_in_stock(s, d):
    return _products(s, d).filter(~keys.folded(F.col("stock")).isin("sin stock", "disponibilidad critica")).select("supplier", "sku", "stock")


@query("SELECT supplier, sku, price_unit FROM products WHERE price_unit BETWEEN 500 AND 1500")
def flt04_range(s, d):
    return relational.within(_products(s, d), "price_unit", 500, 1500).select("supplier", "sku", "price_unit")


@query("SELECT supplier, sku, price_unit, price_bulk FROM products WHERE price_bulk < price_unit * 0.9 AND supplier <> 'x'")
def flt05_rule(s, d):
    rows, error = relational.rule(_products(s, d), "price_bulk < price_unit * 0.9 and supplier <> 'x'", ["price_unit", "price_bulk", "supplier"])
    assert error is None
    return rows.select("supplier", "sku", "price_unit", "price_bulk")


@query(f"SELECT supplier, sku, brand, product_type FROM products WHERE coalesce({_fold('trim(product_type)')}, '') IN ('miel', 'atun') AND coalesce({_fold('trim(supplier)')}, '') IN ('norvalle', 'almadis')")
def flt09_cascade(s, d):
    return relational.cascade(_products(s, d), {"product_type": ["miel", "atun"], "supplier": ["norvalle", "almadis"], "size": []}).select("supplier", "sku", "brand", "product_type")


@query("SELECT supplier, sku, CASE WHEN lower(trim(stock)) = 'sin stock' THEN NULL ELSE price_unit END AS price FROM products")
def flt11_no_price_without_stock(s, d):
    return _products(s, d).select("supplier", "sku", F.when(F.coalesce(F.lower(F.trim("stock")) == "sin stock", F.lit(False)), F.lit(None)).otherwise(F.col("price_unit")).alias("price"))


@query(f"SELECT coalesce({_fold('trim(category)')}, '') AS folded, min(category) AS value FROM products WHERE category IS NOT NULL GROUP BY 1")
def flt16_fold_dedup(s, d):
    return relational.distinct_folded(_products(s, d, "category"), "category")


@query("SELECT DISTINCT brand FROM products WHERE price_unit IS NOT NULL AND brand IS NOT NULL")
def flt17_priced_options(s, d):
    return _products(s, d).filter("price_unit is not null and brand is not null").select("brand").distinct()


# --- Joins ------------------------------------------------------------------------------------------------


@query("SELECT h.supplier, h.sku, p.name, h.price_unit, h.first_seen FROM price_history h JOIN (SELECT supplier, sku, min(name) AS name FROM products GROUP BY ALL) p ON h.supplier = p.supplier AND h.sku = p.sku")
def jon01_history_join(s, d):
    one = _products(s, d, "supplier", "sku", "name").groupBy("supplier", "sku").agg(F.min("name").alias("name"))
    return read_table(s, d, "price_history", "supplier", "sku", "price_unit", "first_seen").join(one, ["supplier", "sku"])


@query(
    """SELECT DISTINCT p.supplier, p.sku FROM products p WHERE NOT EXISTS (SELECT 1 FROM price_snapshots s JOIN
  (SELECT supplier, max(CAST(started_at AS DATE)) AS day FROM run_log WHERE status = 'success' GROUP BY 1) r ON s.supplier = r.supplier AND s.scraped_at = r.day
  WHERE s.supplier = p.supplier AND s.sku = p.sku)"""
)
def jon03_missing_anti(s, d):
    last = read_table(s, d, "run_log").filter("status = 'success'").groupBy("supplier").agg(F.max(F.to_date("started_at")).alias("scraped_at"))
    seen = read_table(s, d, "price_snapshots", "supplier", "sku", "scraped_at").join(last, ["supplier", "scraped_at"])
    return _products(s, d, "supplier", "sku").join(seen, ["supplier", "sku"], "left_anti").distinct()


@query("SELECT p.supplier, p.sku, p.category, coalesce(c.name, 'Otros') AS category_name FROM products p LEFT JOIN category_codes c ON p.category = c.cpath")
def jon07_taxonomy_default(s, d):
    codes = read_table(s, d, "category_codes").select(F.col("cpath").alias("category"), F.col("name").alias("category_name"))
    return relational.with_default(_products(s, d, "supplier", "sku", "category"), codes, ["category"], "category_name", "Otros")


_SQUEEZE = lambda c: f"trim(regexp_replace({_fold(c)}, '\\s+', ' ', 'g'))"


@query(
    f"""WITH k AS (SELECT min(value) AS v, {_SQUEEZE("trim(value)")} AS f FROM ref_values WHERE field = 'product_type' GROUP BY 2),
n AS (SELECT DISTINCT supplier, sku, name, {_SQUEEZE("trim(name)")} AS t FROM products)
SELECT supplier, sku, name, (SELECT arg_max(k.v, length(k.f)) FROM k WHERE n.t || ' ' LIKE k.f || ' %') AS value FROM n"""
)
def jon08_longest_prefix(s, d):
    kinds = read_table(s, d, "ref_values").filter("field = 'product_type'").select("value")
    return relational.longest_prefix(_products(s, d, "supplier", "sku", "name").distinct(), "name", kinds, "value")


@query()
def jon10_similar_brands(s, d):
    return brands.similar_brands(_products(s, d, "brand"), least=70.0)


@query(
    f"""WITH o AS ({_OFFERS}), m AS (SELECT k, supplier, min(price) AS price FROM o GROUP BY ALL)
SELECT k, max(CASE WHEN supplier = 'pasoviejo' THEN price END) AS price_a, max(CASE WHEN supplier = 'norvalle' THEN price END) AS price_b,
  floor(CAST(max(CASE WHEN supplier = 'pasoviejo' THEN price END) AS DOUBLE) / CAST(max(CASE WHEN supplier = 'norvalle' THEN price END) AS DOUBLE) * 10e0 + 0.5e0) / 10e0 AS ratio
FROM m GROUP BY k HAVING price_a IS NOT NULL AND price_b > 0"""
)
def jon13_ratio(s, d):
    return compare.pair_ratio(compare.representative(_offers(s, d), "k"), "k", "pasoviejo", "norvalle")


@query(
    """SELECT a.supplier, a.sku, a.scraped_at, a.price_unit AS was, b.price_unit AS now FROM price_snapshots a JOIN price_snapshots b
  ON a.supplier = b.supplier AND a.sku = b.sku AND a.scraped_at = b.scraped_at AND a.id < b.id WHERE a.price_unit IS DISTINCT FROM b.price_unit"""
)
def jon14_corrected_rows(s, d):
    rows = read_table(s, d, "price_snapshots", "supplier", "sku", "scraped_at", "id", "price_unit")
    # Only keys that repeat are paired.
    twice = rows.groupBy("supplier", "sku", "scraped_at").count().filter("count > 1").drop("count")
    again = rows.join(twice, ["supplier", "sku", "scraped_at"])
    a, b = again.withColumnRenamed("price_unit", "was").withColumnRenamed("id", "i"), again.withColumnRenamed("price_unit", "now").withColumnRenamed("id", "j")
    return a.join(b, ["supplier", "sku", "scraped_at"]).filter("i < j").filter(~F.col("was").eqNullSafe(F.col("now"))).drop("i", "j")


# --- Aggregations -----------------------------------------------------------------------------------------


@query("SELECT lower(trim(name)) AS name_key, count(*) AS listings, count(DISTINCT supplier) AS suppliers FROM products WHERE name IS NOT NULL GROUP BY 1")
def agg03_name_groups(s, d):
    return _products(s, d).filter("name is not null").groupBy(F.lower(F.trim("name")).alias("name_key")).agg(F.count("*").alias("listings"), F.countDistinct("supplier").alias("suppliers"))


@query(
    f"""WITH o AS ({_OFFERS}), f AS (SELECT k, supplier, price FROM (SELECT *, row_number() OVER (PARTITION BY k, supplier ORDER BY sku, updated_at, price) AS n FROM o WHERE price IS NOT NULL) WHERE n = 1)
SELECT k, {", ".join(f"max(CASE WHEN supplier = '{x}' THEN price END) AS {x}" for x in SUPPLIERS)} FROM f GROUP BY k"""
)
def agg04_pivot_first(s, d):
    first = compare.representative(_offers(s, d).filter("price is not null"), "k", F.struct("sku", "updated_at", "price"), "first")
    return compare.supplier_matrix(first, "k", compare.suppliers_of(_products(s, d)))


@query(
    f"""WITH o AS ({_OFFERS}), m AS (SELECT k, supplier, min(price) AS price FROM o WHERE price IS NOT NULL GROUP BY ALL),
g AS (SELECT k, count(*) AS n_suppliers, min(price) AS min_price, max(price) AS max_price, (min({{'p': price, 's': supplier}})).s AS cheapest FROM m GROUP BY k HAVING count(*) >= 2)
SELECT *, CASE WHEN min_price > 0 THEN {_DIFF} END AS diff_pct FROM g"""
)
def agg05_cheapest(s, d):
    return compare.spread(compare.representative(_offers(s, d), "k"), "k")


@query(f"WITH o AS ({_OFFERS}) SELECT k, count(DISTINCT supplier) AS suppliers, count(*) AS listings FROM o GROUP BY k HAVING count(DISTINCT supplier) >= 2")
def agg07_multi_supplier(s, d):
    return _offers(s, d).groupBy("k").agg(F.countDistinct("supplier").alias("suppliers"), F.count("*").alias("listings")).filter("suppliers >= 2")


@query(
    f"""WITH o AS ({_OFFERS}), m AS (SELECT k, supplier, price FROM (SELECT *, row_number() OVER (PARTITION BY k, supplier ORDER BY sku DESC, updated_at DESC, price DESC) AS n FROM o WHERE price IS NOT NULL) WHERE n = 1),
g AS (SELECT k, count(*) AS n_suppliers, min(price) AS min_price, max(price) AS max_price, (min({{'p': price, 's': supplier}})).s AS cheapest FROM m GROUP BY k HAVING count(*) >= 2)
SELECT * FROM (SELECT *, CASE WHEN min_price > 0 THEN {_DIFF} END AS diff_pct FROM g) WHERE diff_pct >= 20"""
)
def agg09_min_spread_last(s, d):
    last = compare.representative(_offers(s, d).filter("price is not null"), "k", F.struct("sku", "updated_at", "price"), "last")
    return compare.spread(last, "k").filter("diff_pct >= 20")


@query(f"WITH o AS ({_OFFERS}) SELECT k, {', '.join(f'''min(CASE WHEN supplier = '{x}' THEN price END) AS {x}''' for x in SUPPLIERS)} FROM o GROUP BY k")
def agg10_pivot_min(s, d):
    return compare.supplier_matrix(_offers(s, d), "k", compare.suppliers_of(_products(s, d)))


@query(
    f"""WITH o AS ({_OFFERS}), w AS (SELECT k, {", ".join(f"min(CASE WHEN supplier = '{x}' THEN price END) AS {x}" for x in SUPPLIERS)} FROM o GROUP BY k),
e AS (SELECT k, least({", ".join(SUPPLIERS)}) AS min_price, greatest({", ".join(SUPPLIERS)}) AS max_price FROM w)
SELECT e.k, e.min_price, e.max_price, (SELECT min(supplier) FROM o WHERE o.k = e.k AND o.price = e.min_price AND supplier IN ({", ".join(f"'{x}'" for x in SUPPLIERS)})) AS cheapest,
  CASE WHEN min_price > 0 THEN {_DIFF} END AS diff_pct FROM e"""
)
def agg12_row_extrema(s, d):
    suppliers = compare.suppliers_of(_products(s, d))
    return compare.row_extrema(compare.supplier_matrix(_offers(s, d), "k", suppliers), suppliers).select("k", "min_price", "max_price", "cheapest", "diff_pct")


@query(
    f"""WITH o AS ({_OFFERS}), m AS (SELECT k, supplier, min(price) AS price FROM o WHERE price IS NOT NULL GROUP BY ALL),
g AS (SELECT k, min(price) AS min_price, max(price) AS max_price FROM m GROUP BY k HAVING count(*) >= 2)
SELECT count(*) AS n_groups, {_half(f"median({_DIFF})")} AS median_diff, max({_DIFF}) AS max_diff FROM g WHERE min_price > 0"""
)
def agg13_median_diff(s, d):
    groups = compare.spread(compare.representative(_offers(s, d), "k"), "k").filter("min_price > 0")
    return groups.agg(F.count("*").alias("n_groups"), num.half_up(F.median("diff_pct")).alias("median_diff"), F.max("diff_pct").alias("max_diff"))


@query(f"WITH o AS ({_OFFERS}) SELECT k, {', '.join(f'''bool_or(supplier = '{x}') AS {x}''' for x in SUPPLIERS)} FROM o GROUP BY k")
def agg14_presence(s, d):
    return compare.presence(_offers(s, d), "k", compare.suppliers_of(_products(s, d)))


@query(f"WITH o AS ({_OFFERS}) SELECT k, bool_or(price IS NOT NULL) AS priced FROM o GROUP BY k")
def agg16_any_priced(s, d):
    return _offers(s, d).groupBy("k").agg(F.bool_or(F.col("price").isNotNull()).alias("priced"))


@query("SELECT count(DISTINCT supplier) AS suppliers, count(DISTINCT brand) AS brands, count(DISTINCT product_type) AS kinds, count(DISTINCT canonical_key) AS keys FROM products")
def agg17_distinct_counts(s, d):
    return _products(s, d).agg(*[F.countDistinct(c).alias(a) for c, a in (("supplier", "suppliers"), ("brand", "brands"), ("product_type", "kinds"), ("canonical_key", "keys"))])


@query(
    f"""SELECT supplier, count(*) AS runs, {_half("avg(CASE WHEN status = 'success' THEN 100e0 ELSE 0e0 END)")} AS success_pct,
  count(CASE WHEN status = 'success' AND snapshots_written = 0 THEN 1 END) AS empty_successes, max(coalesce(finished_at, started_at)) AS latest, max(CASE WHEN status = 'failed' THEN started_at END) AS last_failed
FROM run_log GROUP BY supplier"""
)
def agg18_run_health(s, d):
    ok = F.col("status") == "success"
    return (
        read_table(s, d, "run_log")
        .groupBy("supplier")
        .agg(
            F.count("*").alias("runs"),
            num.half_up(F.avg(F.when(ok, 100.0).otherwise(0.0))).alias("success_pct"),
            F.count_if(ok & (F.col("snapshots_written") == 0)).alias("empty_successes"),
            F.max(F.coalesce("finished_at", "started_at")).alias("latest"),
            F.max(F.when(F.col("status") == "failed", F.col("started_at"))).alias("last_failed"),
        )
    )


@query("SELECT product_type, count(*) AS n FROM products p WHERE product_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ref_values r WHERE r.field = 'product_type' AND r.value = p.product_type) GROUP BY 1")
def agg20_unmapped(s, d):
    known = read_table(s, d, "ref_values").filter("field = 'product_type'").select(F.col("value").alias("product_type"))
    return _products(s, d, "product_type").filter("product_type is not null").groupBy("product_type").agg(F.count("*").alias("n")).join(known, "product_type", "left_anti")


@query(f"SELECT supplier, count(*) AS n, count(brand) AS with_brand, count(product_type) AS with_type, count(size) AS with_size, {_half('count(brand) * 100e0 / count(*)')} AS brand_pct FROM products GROUP BY supplier")
def agg21_coverage(s, d):
    counts = [F.count(c).alias(a) for c, a in (("brand", "with_brand"), ("product_type", "with_type"), ("size", "with_size"))]
    return _products(s, d).groupBy("supplier").agg(F.count("*").alias("n"), *counts).withColumn("brand_pct", num.half_up(F.col("with_brand") * 100.0 / F.col("n")))


@query("SELECT lower(split_part(trim(name), ' ', 1)) AS abbreviation, count(*) AS n FROM products WHERE regexp_matches(split_part(trim(name), ' ', 1), '[./]') GROUP BY 1")
def agg22_abbreviations(s, d):
    first = F.substring_index(F.trim("name"), " ", 1)
    return _products(s, d).filter(first.rlike("[./]")).groupBy(F.lower(first).alias("abbreviation")).agg(F.count("*").alias("n"))


@query(
    f"""WITH c AS (SELECT {_core("brand")} AS brand_norm, brand, supplier, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY ALL),
t AS (SELECT brand_norm, brand, sum(n) AS n FROM c GROUP BY ALL), v AS (SELECT brand_norm, brand AS shown FROM (SELECT *, row_number() OVER (PARTITION BY brand_norm ORDER BY n DESC, brand) AS r FROM t) WHERE r = 1)
SELECT c.brand_norm, count(DISTINCT supplier) AS suppliers, CAST(sum(n) AS BIGINT) AS listings, any_value(shown) AS shown FROM c JOIN v ON c.brand_norm = v.brand_norm WHERE c.brand_norm IS NOT NULL GROUP BY 1 HAVING count(DISTINCT supplier) >= 2"""
)
def agg23_brand_groups(s, d):
    return brands.brand_groups(_products(s, d, "brand", "supplier"))


@query(f"SELECT {_core('brand')} AS brand_norm, min(supplier) AS supplier FROM products WHERE {_core('brand')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT supplier) = 1")
def agg25_solo_brands(s, d):
    named = _products(s, d, "brand", "supplier").select(keys.brand_core(F.col("brand")).alias("brand_norm"), "supplier").filter("brand_norm is not null")
    return named.groupBy("brand_norm").agg(F.min("supplier").alias("supplier"), F.countDistinct("supplier").alias("n")).filter("n = 1").drop("n")


@query(
    f"""WITH o AS ({_OFFERS}), m AS (SELECT k, supplier, min(price) AS price FROM o GROUP BY ALL),
r AS (SELECT floor(CAST(max(CASE WHEN supplier = 'pasoviejo' THEN price END) AS DOUBLE) / CAST(max(CASE WHEN supplier = 'norvalle' THEN price END) AS DOUBLE) * 10e0 + 0.5e0) / 10e0 AS ratio
  FROM m GROUP BY k HAVING max(CASE WHEN supplier = 'pasoviejo' THEN price END) IS NOT NULL AND max(CASE WHEN supplier = 'norvalle' THEN price END) > 0)
SELECT ratio, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, ratio LIMIT 10"""
)
def agg26_ratio_mode(s, d):
    return relational.top(jon13_ratio(s, d).groupBy("ratio").agg(F.count("*").alias("n")), 10, F.desc("n"), F.asc("ratio"))


@query("SELECT coalesce(a.supplier, b.supplier) AS supplier, coalesce(x, 0) AS source_rows, coalesce(y, 0) AS target_rows, coalesce(x, 0) = coalesce(y, 0) AS equal FROM (SELECT supplier, count(*) AS x FROM products GROUP BY 1) a FULL JOIN (SELECT supplier, count(*) AS y FROM (SELECT DISTINCT supplier, sku FROM products) GROUP BY 1) b ON a.supplier = b.supplier")
def agg28_row_counts(s, d):
    rows = _products(s, d, "supplier", "sku")
    return relational.same_counts(rows, rows.distinct(), ["supplier"])


# --- Windows, periods, sets -------------------------------------------------------------------------------


@query(
    f"""WITH o AS (SELECT * FROM ({_DAILY}) WHERE price IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY supplier, sku ORDER BY day) - row_number() OVER (PARTITION BY supplier, sku, price ORDER BY day) AS g FROM o)
SELECT supplier, sku, price, min(day) AS first_seen, max(day) AS last_seen FROM r GROUP BY supplier, sku, price, g"""
)
def win01_islands(s, d):
    return periods.islands(_daily(s, d))


@query(
    f"""WITH o AS (SELECT * FROM ({_DAILY}) WHERE price IS NOT NULL),
n AS (SELECT *, coalesce(lead(day) OVER w - day, 1) AS k, CASE WHEN lag(price) OVER w IS NOT DISTINCT FROM price THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY supplier, sku ORDER BY day)),
g AS (SELECT *, sum(new) OVER (PARTITION BY supplier, sku ORDER BY day) AS run FROM n)
SELECT supplier, sku, price, min(day) AS first_seen, CAST(min(day) + CAST(sum(k) AS INTEGER) - 1 AS DATE) AS last_seen, string_agg(repeat(flag, k), '' ORDER BY day) AS stock_flags FROM g GROUP BY supplier, sku, price, run"""
)
def win02_period_fold(s, d):
    return periods.fold_periods(_daily(s, d))


@query("SELECT supplier, sku, first_seen, price_unit FROM (SELECT *, row_number() OVER (PARTITION BY supplier, sku ORDER BY first_seen DESC, id DESC) AS n FROM price_history) WHERE n = 1")
def win03_latest(s, d):
    return relational.latest_by(read_table(s, d, "price_history", "supplier", "sku", "first_seen", "id", "price_unit"), ["supplier", "sku"], ["price_unit"], "first_seen", "id").drop("id")


@query(f"SELECT k, supplier, sku, price FROM (SELECT *, row_number() OVER (PARTITION BY k, supplier ORDER BY sku, updated_at, price NULLS LAST) AS n FROM ({_OFFERS})) WHERE n = 1")
def win04_first(s, d):
    return relational.first_by(_offers(s, d), ["k", "supplier"], F.asc("sku"), F.asc("updated_at"), F.asc_nulls_last("price")).select("k", "supplier", "sku", "price")


@query(f"SELECT k, supplier, sku, price FROM (SELECT *, row_number() OVER (PARTITION BY k, supplier ORDER BY sku DESC, updated_at DESC, price DESC NULLS LAST) AS n FROM ({_OFFERS})) WHERE n = 1")
def win05_last(s, d):
    return relational.first_by(_offers(s, d), ["k", "supplier"], F.desc("sku"), F.desc("updated_at"), F.desc_nulls_last("price")).select("k", "supplier", "sku", "price")


@query("SELECT supplier, sku, first_seen AS day, price_unit FROM price_history UNION ALL SELECT supplier, sku, last_seen AS day, price_unit FROM price_history")
def set01_endpoints(s, d):
    return periods.end_points(read_table(s, d, "price_history"))


@query("SELECT DISTINCT category FROM products WHERE category IS NOT NULL EXCEPT SELECT value FROM ref_values WHERE field = 'category'")
def set02_difference(s, d):
    return _products(s, d).filter("category is not null").select("category").subtract(read_table(s, d, "ref_values").filter("field = 'category'").select(F.col("value").alias("category")))


@query("SELECT brand, list_sort(list_distinct(list(supplier))) AS suppliers FROM products WHERE brand IS NOT NULL GROUP BY brand")
def set04_supplier_sets(s, d):
    return _products(s, d).filter("brand is not null").groupBy("brand").agg(F.array_sort(F.collect_set("supplier")).alias("suppliers"))


@query("SELECT supplier, sku, CAST(first_seen + CAST(i AS INTEGER) - 1 AS DATE) AS day, substr(stock_flags, i, 1) <> '0' AS in_stock FROM (SELECT supplier, sku, first_seen, stock_flags, unnest(range(1, length(stock_flags) + 1)) AS i FROM price_history WHERE stock_flags IS NOT NULL AND first_seen IS NOT NULL)")
def exp01_daily_flags(s, d):
    return periods.daily_flags(read_table(s, d, "price_history").filter("first_seen is not null"))


# --- Merges -----------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT supplier, sku, min(name) AS name, min(stock) AS stock FROM products WHERE supplier <> 'kioskred' GROUP BY ALL),
n AS (SELECT supplier, sku, max(stock) AS stock, max(lower(stock)) AS name FROM price_snapshots GROUP BY ALL)
SELECT coalesce(o.supplier, n.supplier) AS supplier, coalesce(o.sku, n.sku) AS sku, CASE WHEN o.sku IS NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.sku IS NULL THEN o.stock ELSE n.stock END AS stock
FROM o FULL JOIN n ON o.supplier = n.supplier AND o.sku = n.sku"""
)
def snk01_merge(s, d):
    old = _products(s, d).filter("supplier <> 'kioskred'").groupBy("supplier", "sku").agg(F.min("name").alias("name"), F.min("stock").alias("stock"))
    new = read_table(s, d, "price_snapshots", "supplier", "sku", "stock").groupBy("supplier", "sku").agg(F.max("stock").alias("stock"), F.max(F.lower("stock")).alias("name"))
    return merge.upsert(old, new, ["supplier", "sku"], ["stock"])


@query(
    f"""WITH seen AS (SELECT DISTINCT supplier, sku FROM price_snapshots WHERE scraped_at >= DATE '2025-07-01'),
h AS (SELECT h.*, s.sku IS NOT NULL AS seen, row_number() OVER (PARTITION BY h.supplier, h.sku ORDER BY first_seen DESC, id DESC) AS n FROM price_history h LEFT JOIN seen s ON h.supplier = s.supplier AND h.sku = s.sku),
l AS (SELECT *, n = 1 AND NOT seen AND last_seen < DATE '{AS_OF}' AND (SELECT count(*) FROM seen) > 0 AS late FROM h)
SELECT id, supplier, sku, CASE WHEN late THEN DATE '{AS_OF}' ELSE last_seen END AS last_seen,
  CASE WHEN late THEN stock_flags || repeat(coalesce(nullif(right(stock_flags, 1), ''), '1'), greatest(0, DATE '{AS_OF}' - last_seen - 1)) || '0' ELSE stock_flags END AS stock_flags FROM l"""
)
def snk04_reconcile(s, d):
    seen = read_table(s, d, "price_snapshots", "supplier", "sku", "scraped_at").filter("scraped_at >= date '2025-07-01'")
    return periods.mark_missing(read_table(s, d, "price_history"), seen, AS_OF).select("id", "supplier", "sku", "last_seen", "stock_flags")


@query(
    """WITH n AS (SELECT supplier, sku, max(lower(brand)) AS brand FROM products GROUP BY ALL)
SELECT p.supplier, p.sku, p.updated_at, CASE WHEN p.canonical_key IS NULL THEN n.brand ELSE p.brand END AS brand, p.canonical_key FROM products p JOIN n ON p.supplier = n.supplier AND p.sku = n.sku"""
)
def snk06_guarded(s, d):
    rows = _products(s, d, "supplier", "sku", "updated_at", "brand", "canonical_key")
    return merge.overwrite_where(rows, rows.groupBy("supplier", "sku").agg(F.max(F.lower("brand")).alias("brand")), ["supplier", "sku"], ["brand"], "canonical_key is null")


@query("SELECT '|' || rpad(supplier, 12, ' ') || '|' || rpad(sku, 15, ' ') || '|' || rpad(coalesce(CAST(price_unit AS VARCHAR), ''), 12, ' ') || '|' AS line FROM products")
def snk19_fixed_width(s, d):
    return writers.fixed_width_lines(_products(s, d, "supplier", "sku", "price_unit"), {"supplier": 12, "sku": 15, "price_unit": 12})


# --- Scalars ----------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT name, regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g') AS plain, {_fold('name')} AS folded FROM products")
def str_f01_ascii_fold(s, d):
    return _products(s, d, "name").select("name", text.ascii_fold(F.col("name")).alias("plain"), text.fold(F.col("name")).alias("folded")).distinct()


@query(f"SELECT DISTINCT brand, {_core('brand')} AS brand_norm FROM products")
def str_f06_brand_norm(s, d):
    return _products(s, d, "brand").select("brand", keys.brand_core(F.col("brand")).alias("brand_norm")).distinct()


_KG = "CASE WHEN lower(trim(size_unit)) IN ('g','gr','grs','ml','cc','cm3','mm') THEN 1e0 WHEN lower(trim(size_unit)) IN ('kg','kilo','l','lt','lts','litro','litros','m','mts') THEN 1000e0 WHEN lower(trim(size_unit)) IN ('cl','cm') THEN 10e0 WHEN lower(trim(size_unit)) = 'mg' THEN 0.001e0 END"
_BASE = f"CAST(size_value AS DOUBLE) * {_KG}"
_WEIGHT = "lower(trim(size_unit)) IN ('g','gr','grs','kg','kilo','mg')"


@query(
    f"""SELECT DISTINCT brand, product_type, variant, size_value, size_unit, coalesce({_core("brand")}, '?') || '|' || coalesce({_core("product_type")}, '?') || '|' ||
  array_to_string(list_sort(string_split(coalesce({_core("variant")}, ''), ' ')), ' ') || '|' || CASE WHEN {_BASE} IS NULL THEN '?' WHEN {_WEIGHT} THEN 'W' || CAST(CAST(round_even({_BASE}, 0) AS BIGINT) AS VARCHAR) ELSE 'V' || CAST(CAST(round_even({_BASE}, 0) AS BIGINT) AS VARCHAR) END AS key FROM products"""
)
def str_f11_key(s, d):
    base = num.to_base(F.col("size_value"), F.col("size_unit"))
    weight = F.lower(F.trim("size_unit")).isin("g", "gr", "grs", "kg", "kilo", "mg")
    measure = keys.measure_token(F.when(weight, base), F.when(~weight, base), F.lit(None).cast("double"))
    columns = ["brand", "product_type", "variant", "size_value", "size_unit"]
    return _products(s, d, *columns).select(*columns, keys.canonical_key(F.col("brand"), F.col("product_type"), F.col("variant"), measure).alias("key")).distinct()


@query("SELECT DISTINCT canonical_key, split_part(canonical_key, '|', -1) = '?' AS low FROM products")
def str_f18_low_confidence(s, d):
    return _products(s, d, "canonical_key").select("canonical_key", keys.low_confidence(F.col("canonical_key")).alias("low")).distinct()


@query("SELECT DISTINCT category, nullif(trim(string_split(category, '>')[1]), '') AS section, nullif(trim(string_split(category, '>')[2]), '') AS subsection, trim(string_split(category, '>')[-1]) AS leaf FROM products WHERE category LIKE '%>%'")
def str_f19_path(s, d):
    c = F.col("category")
    return _products(s, d, "category").filter("category like '%>%'").select("category", keys.path_part(c, 0).alias("section"), keys.path_part(c, 1).alias("subsection"), keys.last_part(c).alias("leaf")).distinct()


@query("SELECT c.cpath, p.name || ' / ' || c.name AS path FROM category_codes c JOIN category_codes p ON split_part(c.cpath, '_', 1) = p.cpath WHERE c.cpath LIKE '%\\_%' ESCAPE '\\'")
def str_f21_code_path(s, d):
    codes = read_table(s, d, "category_codes")
    parents = codes.select(F.col("cpath").alias("parent"), F.col("name").alias("parent_name"))
    return codes.filter(F.col("cpath").contains("_")).withColumn("parent", F.substring_index("cpath", "_", 1)).join(parents, "parent").select("cpath", F.concat_ws(" / ", "parent_name", "name").alias("path"))


@query("SELECT DISTINCT stock, TRY_CAST(regexp_extract(lower(trim(stock)), '^uxb:\\s*(\\d+)$', 1) AS INTEGER) AS units FROM price_snapshots")
def str_f25_uxb(s, d):
    return read_table(s, d, "price_snapshots", "stock").select("stock", num.boxed_units(F.col("stock")).alias("units")).distinct()


@query("SELECT DISTINCT supplier, sku, concat_ws(' | ', supplier, coalesce(canonical_name, name)) AS label FROM products")
def str_f26_label(s, d):
    return _products(s, d).select("supplier", "sku", keys.label(F.col("supplier"), F.coalesce("canonical_name", "name")).alias("label")).distinct()


@query("SELECT DISTINCT doc_id, array_to_string(tags, ', ') AS tag_text FROM documents")
def str_f27_array_text(s, d):
    return read_table(s, d, "documents", "doc_id", "tags").select("doc_id", F.array_join("tags", ", ").alias("tag_text")).distinct()


@query("SELECT id, CAST(price_unit AS DOUBLE) AS price FROM price_snapshots")
def num_f01_price(s, d):
    """Prices written the Argentine way and read again."""
    rows = read_table(s, d, "price_snapshots", "id", "price_unit")
    written = F.concat(F.lit("$"), F.translate(F.format_number("price_unit", 2), ",.", ".,"))
    return rows.select("id", num.comma_price(written).alias("price"))


@query(f"SELECT DISTINCT size_value, size_unit, {_BASE} AS base FROM products")
def num_f07_units(s, d):
    return _products(s, d, "size_value", "size_unit").select("size_value", "size_unit", num.to_base(F.col("size_value"), F.col("size_unit")).alias("base")).distinct()


@query("SELECT id, CASE WHEN price_unit IS NULL OR price_bulk IS NULL OR price_unit = 0 THEN NULL ELSE printf('%+.1f%%', CAST(price_bulk - price_unit AS DOUBLE) / CAST(price_unit AS DOUBLE) * 100e0) END AS diff FROM price_snapshots")
def num_f08_diff_text(s, d):
    part, base = F.col("price_bulk").cast("double"), F.col("price_unit").cast("double")
    shown = F.when(F.try_divide(part - base, base).isNotNull(), fmt.signed_percent(part, base))
    return read_table(s, d, "price_snapshots", "id", "price_unit", "price_bulk").select("id", shown.alias("diff"))


@query("SELECT DISTINCT price_unit, coalesce('$' || format('{:,.2f}', price_unit), '-') AS shown FROM products")
def fmt01_currency(s, d):
    return _products(s, d, "price_unit").select("price_unit", fmt.currency(F.col("price_unit")).alias("shown")).distinct()


@query("SELECT id, strftime(started_at, '%d %b %Y, %H:%M') AS started, format('{:,}', snapshots_written) AS written FROM run_log")
def fmt02_texts(s, d):
    return read_table(s, d, "run_log").select("id", fmt.timestamp_text(F.col("started_at")).alias("started"), fmt.count_text(F.col("snapshots_written")).alias("written"))


@query("SELECT id, CAST(price_unit AS DOUBLE) AS decoded FROM price_snapshots WHERE price_unit > 0")
def src10_decode(s, d):
    """Prices in three-digit code, read again."""
    rows = read_table(s, d, "price_snapshots", "id", "price_unit").filter("price_unit > 0")
    code = F.array_join(F.transform(F.split(F.col("price_unit").cast("string"), ""), lambda c: F.when(c != "", F.lpad((F.ascii(c) + 10).cast("string"), 3, "0"))), "")
    return rows.select("id", num.decode_price(code).alias("decoded"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn01_path(s, d):
    return read_table(s, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT DISTINCT url, split_part(url, '/', 3) AS host, string_split(url, '/')[-1] AS page FROM products")
def url01_parts(s, d):
    return _products(s, d, "url").select("url", F.parse_url("url", F.lit("HOST")).alias("host"), keys.last_part(F.col("url"), "/").alias("page")).distinct()


# --- Extraction, clusters, payloads (checked by tests; SQL can't say them) --------------------------------


def _named(s, d):
    return _products(s, d, "supplier", "sku", "name", "category"), name_readers.dictionaries_of(read_table(s, d, "ref_values"))


@query()
def ext01_features(s, d):
    """Every name by the layout that its seller's names follow."""
    names, known = _named(s, d)
    return name_readers.read_names(names, known, name_readers.learned_layouts(names, known))


@query()
def ext02_classified(s, d):
    """The unclassified listings with features, status and confidence."""
    names, known = _named(s, d)
    rows = _products(s, d, "supplier", "sku", "name", "category", "classification_status")
    return name_readers.classified(rows, known, name_readers.learned_layouts(names, known))


@query()
def ext10_type_first(s, d):
    return name_readers.read_names(*_named(s, d), default="type_first")


@query()
def ext20_either_order(s, d):
    return name_readers.read_names(*_named(s, d), default="either")


@query()
def ext30_capitals(s, d):
    return name_readers.read_names(*_named(s, d), default="capitals")


@query()
def ext40_size_last(s, d):
    return name_readers.read_names(*_named(s, d), default="size_last")


@query()
def ext50_brand_first(s, d):
    return name_readers.read_names(*_named(s, d), default="brand_first")


@query()
def sim03_brand_clusters(s, d):
    return brands.linked_clusters(jon10_similar_brands(s, d))


@query("SELECT supplier, sku, CAST(price_unit AS DOUBLE) AS price_unit FROM products WHERE price_unit IS NOT NULL")
def src09_catalog_json(s, d):
    """Listings written as the catalogue's JSON payloads and parsed again."""
    rows = _products(s, d, "supplier", "sku", "price_unit").filter("price_unit is not null")
    payload = F.to_json(F.array(F.struct(F.concat_ws(" ", "supplier", "sku").alias("id"), F.col("price_unit").cast("double").alias("price"))))
    parsed = payloads.catalog_products(rows.select(payload.alias("payload")))
    return parsed.select(F.substring_index("sku", " ", 1).alias("supplier"), F.substring_index("sku", " ", -1).alias("sku"), "price_unit")


# --- Further items of the inventory -----------------------------------------------------------------------


@query()
def qry16_sample(s, d):
    """A random sample of 50 listings, the same for a seed and data."""
    return _products(s, d).select("supplier", "sku", "name", "updated_at").orderBy(F.xxhash64("supplier", "sku", "updated_at", F.lit(7))).limit(50)


@query(f"SELECT k, count(*) AS n, min(price) AS low, max(price) AS high, CASE WHEN max(price) - min(price) <= 5 THEN 0.1e0 WHEN max(price) - min(price) <= 25 THEN 0.25e0 WHEN max(price) - min(price) <= 100 THEN 1e0 WHEN max(price) - min(price) <= 1000 THEN 5e0 WHEN max(price) IS NOT NULL THEN 25e0 END AS step FROM ({_OFFERS}) GROUP BY k")
def flt19_step(s, d):
    groups = _offers(s, d).groupBy("k").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    return groups.withColumn("step", fmt.step_of_spread(F.col("low"), F.col("high")))


@query("SELECT p.supplier, p.sku, s.price_unit FROM (SELECT DISTINCT supplier, sku FROM products) p JOIN (SELECT supplier, sku, price_unit FROM (SELECT *, row_number() OVER (PARTITION BY supplier, sku ORDER BY scraped_at DESC, id DESC) AS n FROM price_snapshots) WHERE n = 1) s ON p.supplier = s.supplier AND p.sku = s.sku")
def jon04_latest_price(s, d):
    return _products(s, d, "supplier", "sku").distinct().join(qry20_latest_snapshot(s, d).drop("scraped_at"), ["supplier", "sku"])


@query(f"WITH o AS ({_OFFERS}) SELECT k, list_sort(list(concat_ws(' ', supplier, sku, price))) AS details FROM o GROUP BY k HAVING count(DISTINCT supplier) > 2")
def agg15_details(s, d):
    line = F.concat_ws(" ", "supplier", "sku", F.col("price").cast("string"))
    group = _offers(s, d).groupBy("k").agg(F.countDistinct("supplier").alias("n"), F.array_sort(F.collect_list(line)).alias("details"))
    return group.filter("n > 2").select("k", "details")


@query("SELECT supplier, count(*) AS total, count(CASE WHEN classification_confidence = 'high' THEN 1 END) AS high, count(CASE WHEN classification_confidence = 'low' THEN 1 END) AS low FROM products GROUP BY 1")
def agg19_confidence_counts(s, d):
    level = lambda x: F.count_if(F.col("classification_confidence") == x).alias(x)
    return _products(s, d).groupBy("supplier").agg(F.count("*").alias("total"), level("high"), level("low"))


@query("SELECT max(length(supplier)) AS supplier, max(length(sku)) AS sku, max(length(name)) AS name, max(length(CAST(price_unit AS VARCHAR))) AS price_unit FROM products")
def agg29_column_widths(s, d):
    return _products(s, d).agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in ("supplier", "sku", "name", "price_unit")])


@query("SELECT supplier, CAST(started_at AS DATE) AS day, status, date_diff('day', lag(CAST(started_at AS DATE)) OVER (PARTITION BY supplier ORDER BY started_at, id), CAST(started_at AS DATE)) AS days_since FROM run_log")
def dat01_days_between_runs(s, d):
    from pyspark.sql import Window

    day = F.to_date("started_at")
    before = F.lag(day).over(Window.partitionBy("supplier").orderBy("started_at", "id"))
    return read_table(s, d, "run_log").select("supplier", day.alias("day"), "status", F.datediff(day, before).alias("days_since"))


@query("SELECT id, coalesce(nullif(right(stock_flags, 1), ''), '1') AS last_flag, repeat(coalesce(nullif(right(stock_flags, 1), ''), '1'), greatest(0, DATE '2025-07-10' - last_seen - 1)) AS filled FROM price_history")
def snk03_gap_fill(s, d):
    flag = periods.last_flag(F.col("stock_flags"))
    return read_table(s, d, "price_history").select("id", flag.alias("last_flag"), periods.gap_fill(flag, F.col("last_seen"), F.lit(AS_OF).cast("date")).alias("filled"))


_SMALL = ", ".join(f"'{w}'" for w in text.SMALL_WORDS)


@query(
    f"""SELECT DISTINCT name, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ({_SMALL}) THEN x ELSE upper(substr(x, 1, 1)) || substr(x, 2) END), ' ') AS title
FROM (SELECT name, string_split(trim(regexp_replace(lower(replace(name, chr(160), ' ')), '\\s+', ' ', 'g')), ' ') AS w FROM products WHERE name IS NOT NULL)"""
)
def str_f08_title(s, d):
    return _products(s, d, "name").filter("name is not null").select("name", text.clean_title(F.col("name")).alias("title")).distinct()


@query(
    """WITH m AS (SELECT DISTINCT canonical_key, string_split(canonical_key, '|')[4] AS p FROM products WHERE canonical_key IS NOT NULL), n AS (SELECT *, substr(p, 1, 1) AS l, TRY_CAST(substr(p, 2) AS BIGINT) AS n FROM m)
SELECT canonical_key, coalesce(CASE WHEN l = 'W' THEN CASE WHEN n < 1000 THEN n || 'g' ELSE printf('%.1fkg', n / 1000e0) END WHEN l = 'V' THEN CASE WHEN n < 1000 THEN n || 'ml' ELSE printf('%.2fL', n / 1000e0) END WHEN l = 'U' THEN n || ' uni' END, '?') AS measure FROM n"""
)
def str_f17_measure(s, d):
    return _products(s, d, "canonical_key").filter("canonical_key is not null").select("canonical_key", fmt.key_measure_text(F.col("canonical_key")).alias("measure")).distinct()


@query("SELECT DISTINCT category, trim(regexp_replace(regexp_replace(regexp_replace(replace(category, chr(160), ' '), '\\s+', ' ', 'g'), '\\s*\\([^)]*\\)\\s*$', ''), '\\s+\\d+$', '')) AS clean FROM products")
def str_f23_clean_category(s, d):
    return _products(s, d, "category").select("category", keys.clean_category(F.col("category")).alias("clean")).distinct()


@query("SELECT supplier, sku, price_unit, units_per_package, floor(CAST(price_unit AS DOUBLE) * units_per_package * 100e0 + 0.5e0) / 100e0 AS bulk FROM products")
def num_f09_bulk(s, d):
    rows = _products(s, d, "supplier", "sku", "price_unit", "units_per_package")
    return rows.withColumn("bulk", num.half_up(F.col("price_unit").cast("double") * F.col("units_per_package")))


@query("SELECT supplier, sku, CASE WHEN price_unit IS NOT NULL THEN '$' || format('{:,.2f}', price_unit) WHEN stock IS NOT NULL THEN 'N/A' ELSE '' END AS cell FROM products")
def fmt03_cell(s, d):
    return _products(s, d).select("supplier", "sku", fmt.cell_text(F.col("price_unit"), F.col("stock").isNotNull()).alias("cell"))


_BLANKS = lambda c: f"coalesce(trim(regexp_replace(replace({c}, chr(160), ' '), '\\s+', ' ', 'g')), '')"


@query(
    f"""SELECT supplier, sku, CASE WHEN b = '' THEN t WHEN starts_with(upper(t), upper(b)) THEN t ELSE b || ' ' || t END AS described
FROM (SELECT *, CASE WHEN length(n) >= length(c) THEN n ELSE c END AS t FROM (SELECT supplier, sku, {_BLANKS("brand")} AS b, {_BLANKS("name")} AS n, {_BLANKS("canonical_name")} AS c FROM products))"""
)
def src11_name(s, d):
    return _products(s, d).select("supplier", "sku", payloads.described_name(F.col("brand"), F.col("name"), F.col("canonical_name")).alias("described"))


@query()
def sim01_led_brand_groups(s, d):
    return brands.led_groups(_products(s, d, "brand", "supplier"))
