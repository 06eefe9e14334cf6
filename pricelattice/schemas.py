"""Schemas of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampType()
_PRICE = T.DecimalType(12, 2)

PRODUCTS = _schema(
    sku=_S, supplier=_S, name=_S, url=_S, category=_S, units_per_package=_I, packs_per_pallet=_I, updated_at=_TS, product_id=_S, brand=_S,
    product_type=_S, variant=_S, size=_S, size_value=T.DecimalType(12, 4), size_unit=_S, category_dept=_S, category_sub=_S, canonical_key=_S,
    canonical_name=_S, features_version=_I, last_scraped_at=_TS, classification_status=_S, classification_confidence=_S, price_unit=_PRICE,
    price_bulk=_PRICE, stock=_S,
)
PRICE_SNAPSHOTS = _schema(id=_L, sku=_S, supplier=_S, scraped_at=_D, price_unit=_PRICE, price_bulk=_PRICE, stock=_S)
PRICE_HISTORY = _schema(id=_L, sku=_S, supplier=_S, price_unit=_PRICE, first_seen=_D, last_seen=_D, stock_flags=_S)
RUN_LOG = _schema(id=_L, supplier=_S, started_at=_TS, finished_at=_TS, status=_S, categories_total=_I, categories_done=_I, products_scraped=_I, snapshots_written=_I, error_message=_S)
COMPARISON_FEEDBACK = _schema(id=_L, created_at=_TS, canonical_names=T.ArrayType(_S), comment=_S)
USERS = _schema(id=_S, email=_S, password_hash=_S, role=_S, is_active=T.BooleanType(), created_at=_TS)

ALL = {"products": PRODUCTS, "price_snapshots": PRICE_SNAPSHOTS, "price_history": PRICE_HISTORY, "run_log": RUN_LOG, "comparison_feedback": COMPARISON_FEEDBACK, "users": USERS}
