"""What changed between consecutive full snapshots.

Method: full outer join on the primary key comparing canonical row hashes. A delivery is numbered within its
supplier; each row meets the row of the same key in the preceding delivery. A missing side is an addition or
a removal, unequal hashes are a change.

Scale: partial aggregation before the first shuffle removes repeated and corrected rows (so a hot key costs
one row a task), and only key, delivery number and a 64-bit hash travel through the join. The list of
deliveries is the run log's distinct (supplier, day), joined by Catalyst's own choice of strategy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: Sequence[Column]) -> Column:
    """64-bit hash of a canonical row in which null differs from every value and from its neighbours."""
    return F.xxhash64(*[part for c in columns for part in (c.isNull(), c)])


def deliveries(runs: DataFrame) -> DataFrame:
    """``(supplier, day, n)``: the days on which a successful run started, numbered from 1 within the supplier."""
    days = runs.filter("status = 'success' and supplier is not null and started_at is not null").select("supplier", F.to_date("started_at").alias("day")).distinct()
    return days.withColumn("n", F.row_number().over(Window.partitionBy("supplier").orderBy("day")))


def snapshot_changes(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """``(supplier, sku, scraped_at, change)`` for each complete delivery against the preceding one.

    ``scraped_at`` is a date; ``change`` is added, removed or changed. Prices compare as decimals (null equals
    null), ``stock`` without letter case and outer blanks. Of repeated rows the greatest id counts; a null id is
    the least, equal ids are resolved by the greater hash. Rows without supplier, sku or date, and rows of days
    without a successful run, are left out. A complete day without rows removes everything listed before. Other
    columns are ignored; empty tables give no rows.
    """
    days = deliveries(runs)
    payload = row_hash([F.col("price_unit").cast("decimal(18,4)"), F.col("price_bulk").cast("decimal(18,4)"), F.lower(F.trim("stock"))])
    listed = (
        snapshots.filter("sku is not null")
        .select("supplier", "sku", F.col("scraped_at").cast("date").alias("day"), F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))).alias("id"), payload.alias("h"))
        .join(days, ["supplier", "day"])
        .groupBy("supplier", "sku", "n")
        .agg(F.max(F.struct("id", "h")).getField("h").alias("h"))
    )
    now = listed.withColumnRenamed("h", "h_now")
    then = listed.select("supplier", "sku", (F.col("n") + 1).alias("n"), F.col("h").alias("h_then"))
    change = F.when(F.col("h_then").isNull(), "added").when(F.col("h_now").isNull(), "removed").when(F.col("h_now") != F.col("h_then"), "changed")
    # The join to the days drops what is "removed" after a supplier's last delivery, and gives the dates back.
    return (
        now.join(then, ["supplier", "sku", "n"], "full_outer")
        .select("supplier", "sku", "n", change.alias("change"))
        .filter("change is not null and n > 1")
        .join(days, ["supplier", "n"])
        .select("supplier", "sku", F.col("day").alias("scraped_at"), "change")
    )
