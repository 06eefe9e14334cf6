"""Structured Streaming: period state a listing, merging ingest, de-duplication and windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricelattice.operators.merge import upsert
from pricelattice.session import exists, file_system, names_in

PERIOD = "supplier string, sku string, price_cents long, first_seen date, last_seen date, stock_flags string, closed boolean"


class PeriodProcessor(StatefulProcessor):
    """Folds a listing's observations into periods, as ``operators.periods.fold_periods`` does in batch.

    State is the open period: price, first and last day, flags. A day that is not after the last one is late or
    repeated and is left out (a batch rebuild of the listing takes it in). Every input batch emits the periods it
    closed and the open one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "price_cents long, first_seen date, last_seen date, stock_flags string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).dropna(subset=["price_cents", "day"]).sort_values(["day", "id"]).drop_duplicates("day", keep="last")
        state = self.open.get() if self.open.exists() else None
        out = []
        for price, day, flag in zip(frame["price_cents"], frame["day"], frame["flag"]):
            if state is None:
                state = (int(price), day, day, flag)
                continue
            was, first, last, flags = state
            gap = (day - last).days
            if gap <= 0:
                continue
            filled = flags + (flags[-1] if flags else "1") * (gap - 1)
            if price == was:
                state = (was, first, day, filled + flag)
            else:
                out.append((*key, was, first, day - pd.Timedelta(days=1), filled, True))
                state = (int(price), day, day, flag)
        if state is not None:
            self.open.update(state)
            out.append((*key, *state, False))
        yield pd.DataFrame(out, columns=["supplier", "sku", "price_cents", "first_seen", "last_seen", "stock_flags", "closed"])

    def close(self) -> None:
        pass


def stream_periods(observations: DataFrame) -> DataFrame:
    """Periods out of a stream of (supplier, sku, day, id, price_cents, flag); output mode update, RocksDB state."""
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return observations.groupBy("supplier", "sku").transformWithStateInPandas(PeriodProcessor(), PERIOD, "Update", "None")


class VersionedTable:
    """A table of numbered parquet folders; readers take the greatest complete one, so a retried batch is harmless."""

    KEEP = 3

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        found = [n for n in names_in(self.spark, self.path) if n[:1] == "v" and n[1:].isdigit()]
        return sorted(int(n[1:]) for n in found if exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self, before: int | None = None) -> DataFrame | None:
        past = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{past[-1]}") if past else None

    def write(self, frame: DataFrame, version: int) -> None:
        """Writes a version, then drops those before the KEEP last: a reader of an older one has finished by then."""
        frame.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        for old in [v for v in self.versions() if v <= version][: -self.KEEP]:
            files, at = file_system(self.spark, f"{self.path}/v{old}")
            files.delete(at, True)


def merge_stream(arriving: DataFrame, table: VersionedTable, keys: Sequence[str], updated: Sequence[str], checkpoint: str):
    """Upserts each micro-batch into a versioned table; processes what is there and stops (availableNow)."""

    def merge(batch: DataFrame, number: int) -> None:
        known = table.read(before=number + 1)
        new = upsert(known if known is not None else batch.limit(0), batch, keys, updated)
        table.write(new, number + 1)

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_a_day(observations: DataFrame, time: str = "scraped_at", delay: str = "2 days") -> DataFrame:
    """One row a listing and event time within the watermark; zone-less times are taken as UTC."""
    return observations.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["supplier", "sku", time])


def windowed_counts(events: DataFrame, kind: str, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Event counts and sums a tumbling, sliding or session window and event type. An extension beyond the inventory."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", delay)
    window = F.session_window("ts", size) if kind == "session" else F.window("ts", size, slide or size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
