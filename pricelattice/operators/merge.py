"""Emulated MERGE: parquet has no update, so a merge is a full outer join with a rule for each column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, arriving: DataFrame, keys: Sequence[str], updated: Sequence[str]) -> DataFrame:
    """All of ``existing``, with ``updated`` columns taken from ``arriving`` where it has the key, and its new keys.

    Other columns keep their first value. Of arriving rows with the same key one, the greatest, counts. Columns that
    ``arriving`` lacks are null for new keys.
    """
    rest = [c for c in existing.columns if c not in keys]
    mine = [c for c in rest if c in arriving.columns]
    new = arriving.groupBy(*keys).agg(F.max(F.struct(*mine)).alias("_new"))
    old = existing.select(*keys, F.struct(*rest).alias("_old"))
    both = old.join(new, list(keys), "full_outer")

    def column(c: str):
        if c not in mine:
            return F.col(f"_old.{c}").alias(c)
        if c in updated:
            return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
        return F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c)

    return both.select(*keys, *[column(c) for c in rest])


def overwrite_where(existing: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], condition: str) -> DataFrame:
    """``columns`` replaced by those of ``changes`` (unique by key) where ``condition`` holds for the existing row."""
    new = changes.select(*keys, F.struct(*columns).alias("_new"))
    rows = existing.join(new, list(keys), "left").withColumn("_ok", F.col("_new").isNotNull() & F.coalesce(F.expr(condition), F.lit(False)))
    return rows.select(*[F.when(F.col("_ok"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])
