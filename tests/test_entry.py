"""Registered queries on small tables written here: each runs, on filled and on empty tables, with extra columns."""

import datetime as dt
import importlib.util

import pytest

import __spark_entry__ as entry
from tests.frames import frame

T, D = dt.datetime(2025, 3, 3, 6), dt.date(2025, 3, 3)
PRODUCTS = (
    "sku string, supplier string, name string, url string, category string, updated_at timestamp_ntz, product_id string, brand string, product_type string, variant string, size string, "
    "size_value decimal(12,4), size_unit string, canonical_key string, canonical_name string, classification_status string, classification_confidence string, price_unit decimal(12,2), price_bulk decimal(12,2), stock string, units_per_package int, _run int"
)
TABLES = {
    "products": (PRODUCTS, [("1", s, "Miel Pura 500 g", "https://a.test/p/1", "Almacén > Infusiones", T, s + "_1", "Ab", "Miel", "Pura", None, 500, "g", None, None, "pending", None, 10, 9, "disponible", 6, 1) for s in ("pasoviejo", "norvalle")] + [(None,) * 22]),
    "price_snapshots": ("id long, sku string, supplier string, scraped_at date, price_unit decimal(12,2), price_bulk decimal(12,2), stock string, k int", [(n, "1", "pasoviejo", D, 10, 9, "uxb:2", 1) for n in range(3)] + [(9,) + (None,) * 7]),
    "price_history": ("id long, sku string, supplier string, price_unit decimal(12,2), first_seen date, last_seen date, stock_flags string, block int", [(1, "1", "pasoviejo", 10, D, D, "1", 1), (None,) * 8]),
    "run_log": ("id long, supplier string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, categories_total int, categories_done int, products_scraped int, snapshots_written int, error_message string", [(1, "pasoviejo", T, None, "success", 1, 1, 1, 0, None), (None,) * 10]),
    "category_codes": ("cpath string, name string", [("1", "ALMACEN"), ("1_101", "INFUSIONES"), (None, None)]),
    "ref_values": ("ref_id long, field string, value string", [(1, "brand", "Ab"), (2, "product_type", "Miel"), (3, "category", "Almacén > Infusiones"), (None, None, None)]),
    "eval_items": ("item_id long, suite string, lang string, text string, answer string", [(1, "a", "es", "uno\ndos\ntres", "A"), (None,) * 5]),
    "documents": ("doc_id long, text string, lang string, tags array<string>, created_at timestamp_ntz", [(1, "hola mundo", "es", ["a", None], T), (2, None, None, None, None), (None, "", "x", [], T)]),
    "events": ("event_id long, ts timestamp_ntz, event_type string, value double, props string", [(1, T, "a", 1.0, '{"k": 2}'), (2, T, None, None, "broken")]),
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("filled", "empty"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, (ddl, rows) in TABLES.items():
            frame(spark, rows if kind == "filled" else [], ddl).coalesce(1).write.parquet(f"{out[kind]}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_runs(spark, folders, name):
    for folder in folders.values():
        found = entry.queries()[name](spark, folder)
        assert found.columns and found.collect() is not None


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    wanted = {"p1_found", "p3_found", "p4_found", "p6_found"}
    if importlib.util.find_spec("pricelattice.llm"):
        wanted |= {"p2_found", "p5_found", "p7_ids", "p8_found", "p9_found"}
    assert wanted <= set(queries)


def test_plans(spark, folders):
    """Filters and columns reach the scan; relational queries need no Python."""
    plan = entry.queries()["flt04_range"](spark, folders["filled"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(price_unit), GreaterThanOrEqual(price_unit" in plan and "ReadSchema: struct<sku:string,supplier:string,price_unit" in plan
    for name in ("qry06_has_history", "agg05_cheapest", "win02_period_fold", "p6_found"):
        text = entry.queries()[name](spark, folders["filled"])._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text, name
