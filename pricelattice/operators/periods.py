"""Price periods out of dated observations, and what can be read from them. Purely relational.

``period_history`` merges overlapping period updates; here every observation is one (listing, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["supplier", "sku"]


def islands(observed: DataFrame) -> DataFrame:
    """(supplier, sku, price, first_seen, last_seen): runs of equal price over successive observations.

    Needs supplier, sku, day, price with one row a listing and day. Null prices are left out before numbering, so a
    null does not end a run.
    """
    rows = observed.filter("price is not null")
    by = Window.partitionBy(*KEY).orderBy("day")
    run = F.row_number().over(by) - F.row_number().over(Window.partitionBy(*KEY, "price").orderBy("day"))
    return rows.withColumn("_run", run).groupBy(*KEY, "price", "_run").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen")).drop("_run")


def fold_periods(observed: DataFrame) -> DataFrame:
    """(supplier, sku, price, first_seen, last_seen, stock_flags): periods that close the day before the next opens.

    Needs supplier, sku, day, price, flag ('1' or '0'). Days without observation repeat the last flag; flags have one
    character a day of the period.
    """
    by = Window.partitionBy(*KEY).orderBy("day")
    rows = (
        observed.filter("price is not null")
        .withColumn("_new", (~F.lag("price").over(by).eqNullSafe(F.col("price"))).cast("int"))
        .withColumn("_k", F.coalesce(F.datediff(F.lead("day").over(by), F.col("day")), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(by))
    )
    parts = F.array_sort(F.collect_list(F.struct("day", F.repeat(F.col("flag"), F.col("_k")).alias("f"))))
    return (
        rows.groupBy(*KEY, "price", "_run")
        .agg(F.min("day").alias("first_seen"), F.sum("_k").alias("_days"), F.array_join(F.transform(parts, lambda p: p["f"]), "").alias("stock_flags"))
        .withColumn("last_seen", F.date_add("first_seen", F.col("_days").cast("int") - 1))
        .select(*KEY, "price", "first_seen", "last_seen", "stock_flags")
    )


def gap_fill(flag: Column, last_seen: Column, day: Column) -> Column:
    """The last flag once for each day strictly between."""
    return F.repeat(flag, F.greatest(F.lit(0), F.datediff(day, last_seen) - 1))


def last_flag(flags: Column) -> Column:
    return F.coalesce(F.nullif(F.right(flags, F.lit(1)), F.lit("")), F.lit("1"))


def mark_missing(periods: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    """Periods with the newest one of each unseen listing extended to ``as_of`` and out of stock on that day.

    Periods already reaching ``as_of`` and listings among ``seen`` stay; nothing seen at all changes nothing.
    """
    if seen.isEmpty():
        return periods
    today = F.lit(as_of).cast("date")
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("first_seen"), F.desc("id")))
    here = seen.select(*KEY).distinct().withColumn("_seen", F.lit(True))
    rows = periods.withColumn("_n", newest).join(here, KEY, "left")
    late = (F.col("_n") == 1) & F.col("_seen").isNull() & (F.col("last_seen") < today)
    flags = F.concat("stock_flags", gap_fill(last_flag(F.col("stock_flags")), F.col("last_seen"), today), F.lit("0"))
    return rows.withColumn("stock_flags", F.when(late, flags).otherwise(F.col("stock_flags"))).withColumn("last_seen", F.when(late, today).otherwise(F.col("last_seen"))).drop("_n", "_seen")


def daily_flags(periods: DataFrame) -> DataFrame:
    """One row a day of a period: its date and whether it was in stock."""
    days = periods.select(*KEY, "first_seen", F.posexplode(F.split("stock_flags", "")).alias("i", "flag")).filter("flag != ''")
    return days.select(*KEY, F.date_add("first_seen", F.col("i")).alias("day"), (F.col("flag") != "0").alias("in_stock"))


def end_points(periods: DataFrame) -> DataFrame:
    """Both ends of each period, for step lines."""
    return periods.select(*KEY, F.explode(F.array("first_seen", "last_seen")).alias("day"), "price_unit")


def upsert_day(periods: DataFrame, observed: DataFrame, day) -> DataFrame:
    """Stored periods (id, supplier, sku, price, first_seen, last_seen, stock_flags) after a day's observations (supplier, sku, price, flag).

    A listing's newest period (greatest first_seen, then id) is extended if its price is that of the day, null equal
    to null; else it is closed on the day before and a new one opens, with null id. Days without observation repeat the last flag. A
    listing whose newest period reaches the day already stays as it is, so that a repeated run changes nothing.
    """
    today = F.lit(day).cast("date")
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("first_seen"), F.desc("id")))
    news = observed.groupBy(*KEY).agg(F.max(F.struct("price", "flag")).alias("_o")).select(*KEY, F.col("_o.price").alias("_price"), F.col("_o.flag").alias("_flag"))
    rows = periods.withColumn("_n", newest).join(news, KEY, "left")
    open_ = (F.col("_n") == 1) & F.col("_flag").isNotNull() & (F.col("last_seen") < today)
    same = F.col("price").eqNullSafe(F.col("_price"))
    filled = F.concat("stock_flags", gap_fill(last_flag(F.col("stock_flags")), F.col("last_seen"), today))
    kept = rows.select(
        "id",
        *KEY,
        "price",
        "first_seen",
        F.when(open_ & same, today).when(open_, F.date_sub(today, 1)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(open_ & same, F.concat(filled, "_flag")).when(open_, filled).otherwise(F.col("stock_flags")).alias("stock_flags"),
    )
    # New periods: of listings whose price changed, and of those never seen.
    changed = rows.filter(open_ & ~same).select(*KEY, "_price", "_flag")
    unseen = news.join(periods.select(*KEY), KEY, "left_anti")
    fresh = changed.unionByName(unseen).select(F.lit(None).cast("long").alias("id"), *KEY, F.col("_price").alias("price"), today.alias("first_seen"), today.alias("last_seen"), F.col("_flag").alias("stock_flags"))
    return kept.unionByName(fresh)


def first_history(history: DataFrame, observed: DataFrame) -> DataFrame:
    """Periods of all observations if there is no history yet, else none: a migration that runs once."""
    periods = fold_periods(observed)
    return periods if history.isEmpty() else periods.limit(0)
