"""The registered queries of the data problems in the core, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.operators.period_history import price_versions
from pricelattice.operators.price_spikes import implausible_prices
from pricelattice.operators.snapshot_diff import snapshot_changes
from pricelattice.operators.units import listing_quantities
from pricelattice.session import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    products = read_table(spark, folder, "products", "supplier", "sku", "updated_at", "name", "size", "size_value", "size_unit", "brand", "variant")
    return listing_quantities(products).select("supplier", "sku", "qty", "unit")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    day = lambda c: F.col(c).cast("string")
    return price_versions(read_table(spark, folder, "price_history")).select(
        "supplier", "sku", day("first_day").alias("first_seen"), day("last_day").alias("last_seen"), "price_cents", "stock_flags"
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return implausible_prices(read_table(spark, folder, "price_snapshots", "id", "sku", "supplier", "scraped_at", "price_unit", "price_bulk"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    changes = snapshot_changes(read_table(spark, folder, "price_snapshots"), read_table(spark, folder, "run_log", "supplier", "started_at", "status"))
    return changes.withColumn("scraped_at", F.col("scraped_at").cast("string"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found}

SQL = {
    "p3_found": """
WITH v AS (SELECT id, supplier, sku, CAST(price_unit * 100 AS BIGINT) AS cents, first_seen, last_seen, coalesce(stock_flags, '') AS f
  FROM price_history WHERE price_unit IS NOT NULL AND first_seen <= last_seen AND supplier IS NOT NULL AND sku IS NOT NULL),
d AS (SELECT *, CAST(unnest(generate_series(first_seen, last_seen, INTERVAL 1 DAY)) AS DATE) AS day FROM v),
c AS (SELECT supplier, sku, day, arg_max(cents, id) AS cents,
    arg_max(CASE WHEN f = '' THEN '1' ELSE substr(f, least(day - first_seen + 1, length(f)), 1) END, id) AS flag FROM d GROUP BY ALL),
n AS (SELECT *, lead(day) OVER w AS nxt, lag(cents) OVER w AS was FROM c WINDOW w AS (PARTITION BY supplier, sku ORDER BY day)),
g AS (SELECT *, sum(CASE WHEN was = cents THEN 0 ELSE 1 END) OVER (PARTITION BY supplier, sku ORDER BY day) AS run, coalesce(nxt - day, 1) AS k FROM n)
SELECT supplier, sku, CAST(min(day) AS VARCHAR) AS first_seen, CAST(CAST(min(day) + CAST(sum(k) AS INTEGER) - 1 AS DATE) AS VARCHAR) AS last_seen,
  min(cents) AS price_cents, string_agg(repeat(flag, k), '' ORDER BY day) AS stock_flags
FROM g GROUP BY supplier, sku, run
""",
    "p6_found": """
WITH d AS (SELECT supplier, day, row_number() OVER (PARTITION BY supplier ORDER BY day) AS n FROM
  (SELECT DISTINCT supplier, CAST(started_at AS DATE) AS day FROM run_log WHERE status = 'success')),
s AS (SELECT * FROM (SELECT s.supplier, s.sku, d.n, price_unit AS u, price_bulk AS b, lower(trim(stock)) AS k,
    row_number() OVER (PARTITION BY s.supplier, s.sku, s.scraped_at ORDER BY s.id DESC) AS r
  FROM price_snapshots s JOIN d ON s.supplier = d.supplier AND s.scraped_at = d.day WHERE s.sku IS NOT NULL) WHERE r = 1),
j AS (SELECT coalesce(a.supplier, b.supplier) AS supplier, coalesce(a.sku, b.sku) AS sku, coalesce(a.n, b.n + 1) AS n,
    CASE WHEN b.sku IS NULL THEN 'added' WHEN a.sku IS NULL THEN 'removed'
      WHEN a.u IS DISTINCT FROM b.u OR a.b IS DISTINCT FROM b.b OR a.k IS DISTINCT FROM b.k THEN 'changed' END AS change
  FROM s a FULL JOIN s b ON a.supplier = b.supplier AND a.sku = b.sku AND a.n = b.n + 1)
SELECT j.supplier, j.sku, CAST(d.day AS VARCHAR) AS scraped_at, change FROM j JOIN d ON j.supplier = d.supplier AND j.n = d.n
WHERE change IS NOT NULL AND j.n > 1
""",
}
