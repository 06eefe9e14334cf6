"""History of changing attributes: versions of price and daily stock out of overlapping period updates.

Method: tree-reduction coalescing. Every update is a list of runs of unit intervals (days) of one payload, price and
flag. In each of logarithmically many rounds, the run lists of neighbouring updates of an entity are merged pairwise:
the later one's runs stand, the earlier one's are cut to what the later leaves free, and adjacent runs of equal
payload become one. The list at the root is the entity's history; gaps take the payload of the day before, and
runs of equal price are its versions.

Scale: one shuffle on (supplier, sku). An entity with more than ``block_rows`` updates is cut by ranges of id into
blocks that are reduced apart and then merged pairwise in further rounds, so no task gets an unbounded group: a reduced
block has at most one run a day. Kernels are numpy over thousands of entities a call; their cost follows runs, not days.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelattice.operators.arrow_groups import group_starts, whole_groups
from pricelattice.session import checkpointed

BLOCK_ROWS = 20_000  # updates of one entity in one block
CELLS = 4_000_000  # days of flags written at once
MAX_HOT = 100_000  # hot entities whose cuts are broadcast; more are joined
KEYS = ["supplier", "sku"]
RUNS = "supplier string, sku string, block long, id long, price_cents long, first_day date, last_day date, stock_flags string"
VERSIONS = "supplier string, sku string, first_day date, last_day date, price_cents long, stock_flags string"


class Runs(NamedTuple):
    """Disjoint runs of days, sorted by list and day; lists are numbered within their group."""

    group: np.ndarray
    list: np.ndarray
    first: np.ndarray
    last: np.ndarray
    price: np.ndarray
    flag: np.ndarray

    def take(self, rows: np.ndarray) -> Runs:
        return Runs(*(c[rows] for c in self))


def coalesced(runs: Runs) -> Runs:
    """Adjacent runs of one list with equal payload as one."""
    if not len(runs.first):
        return runs
    joins = np.zeros(len(runs.first), bool)
    joins[1:] = (runs.last[:-1] + 1 == runs.first[1:]) & np.logical_and.reduce([c[1:] == c[:-1] for c in (runs.group, runs.list, runs.price, runs.flag)])
    begin = np.flatnonzero(~joins)
    end = np.append(begin[1:], len(joins)) - 1
    return runs.take(begin)._replace(last=runs.last[end])


def merge_round(runs: Runs) -> Runs:
    """Lists 2k and 2k + 1 of each group as one list k; the days of the odd one win."""
    low, room = int(runs.first.min()), int(runs.last.max() - runs.first.min()) + 3
    # Groups and lists as one number, then days within it: sorted by pair and day.
    pair = runs.list // 2
    change = np.ones(len(pair), bool)
    change[1:] = (runs.group[1:] != runs.group[:-1]) | (pair[1:] != pair[:-1])
    base = (np.cumsum(change) - 1) * room - low + 1
    later = runs.list % 2 == 1
    under, over = np.flatnonzero(~later), np.flatnonzero(later)
    start, stop = base[over] + runs.first[over], base[over] + runs.last[over]  # sorted and disjoint
    # What an earlier run keeps lies between two later ones: pieces before, between and after those that it meets.
    a, z = base[under] + runs.first[under], base[under] + runs.last[under]
    met, beyond = np.searchsorted(stop, a), np.searchsorted(start, z, side="right")
    pieces = beyond - met + 1
    of = np.repeat(np.arange(len(under)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + met[of]
    ends = np.append(stop, 0) if len(stop) else np.zeros(1, np.int64)
    starts = np.append(start, 0) if len(start) else np.zeros(1, np.int64)
    first = np.where(nth > met[of], ends[nth - 1] + 1, a[of])
    last = np.where(nth < beyond[of], starts[np.minimum(nth, len(starts) - 1)] - 1, z[of])
    kept = first <= last
    of, first, last = under[of[kept]], first[kept], last[kept]
    left = runs.take(of)._replace(first=first - base[of], last=last - base[of])
    every = Runs(*(np.concatenate(c) for c in zip(left, runs.take(over))))
    order = np.argsort(np.concatenate((first, start)), kind="stable")
    every = every.take(order)
    return coalesced(every._replace(list=every.list // 2))


def reduced(runs: Runs) -> Runs:
    """The one list of each group that remains after rounds of pairwise merges."""
    while len(runs.list) and runs.list.max() > 0:
        runs = merge_round(runs)
    return runs


def _days(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)


def _flag_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all flag strings, and each row's start and length in them; null counts as empty."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _text(data: np.ndarray, starts: np.ndarray, total: int) -> pa.Array:
    """Consecutive slices of ``data``, cut at ``starts``, as a string array."""
    offsets = np.append(starts, total).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def update_runs(table: pa.Table, starts: np.ndarray) -> Runs:
    """The runs of each row of a sorted table; a row is a list, numbered within its group (``starts``: first rows of the groups)."""
    n = table.num_rows
    first, last = _days(table["first_day"]), _days(table["last_day"])
    data, at, size = _flag_bytes(table["stock_flags"])
    stated = np.maximum(np.minimum(size, last - first + 1), 1)  # the last flag holds on
    row = np.repeat(np.arange(n), stated)
    place = np.arange(len(row)) - np.repeat(np.cumsum(stated) - stated, stated)
    flag = np.where(size[row] > 0, data[np.minimum(at[row] + place, len(data) - 1)], ord("1")).astype(np.uint8)
    change = place == 0
    change[1:] |= flag[1:] != flag[:-1]
    begin = np.flatnonzero(change)
    of = row[begin]
    ends = np.append(place[begin[1:]] - 1, 0)
    closing = np.append(of[1:] != of[:-1], True)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    price = table["price_cents"].combine_chunks().to_numpy()
    return Runs(group[of], of - starts[group[of]], first[of] + place[begin], np.where(closing, last[of], first[of] + ends), price[of], flag[begin])


def _price_runs(table: pa.Table, keys: list[str], filled: bool) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(first row of each one's group, its columns) of the runs of equal price of whole groups; ``filled``: gaps have the day before's payload."""
    starts = group_starts(table, keys)
    runs = reduced(update_runs(table, starts))
    if filled:
        same = runs.group[1:] == runs.group[:-1]
        runs = coalesced(runs._replace(last=np.append(np.where(same, runs.first[1:] - 1, runs.last[:-1]), runs.last[-1:])))
    opens = np.ones(len(runs.first), bool)
    opens[1:] = (runs.group[1:] != runs.group[:-1]) | (runs.price[1:] != runs.price[:-1]) | (runs.last[:-1] + 1 != runs.first[1:])
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(opens))
    days = runs.last - runs.first + 1
    of = np.append(0, np.cumsum(days))
    one = 0
    while one < len(begin):
        upto = one + max(1, int(np.searchsorted(of[end[one : one + 262_144]] - of[begin[one]], CELLS, side="right")))
        rows = slice(begin[one], end[upto - 1])
        flags = np.repeat(runs.flag[rows], days[rows])
        b, e = begin[one:upto], end[one:upto]
        yield (
            starts[runs.group[b]],
            pa.record_batch(
                {
                    "first_day": pa.array(runs.first[b].astype(np.int32)).cast(pa.date32()),
                    "last_day": pa.array(runs.last[e - 1].astype(np.int32)).cast(pa.date32()),
                    "price_cents": pa.array(runs.price[b]),
                    "stock_flags": _text(flags, of[b] - of[b[0]], len(flags)),
                }
            ),
        )
        one = upto


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block, or pair of reduced blocks, of an entity as disjoint runs of equal price, in the block of the next round."""
    for table in whole_groups(batches, [*KEYS, "block"]):
        for rows, found in _price_runs(table, [*KEYS, "block"], filled=False):
            some = table.select([*KEYS, "block"]).take(pa.array(rows)).combine_chunks()
            block = some["block"].combine_chunks().to_numpy()
            yield pa.record_batch(
                {
                    "supplier": some["supplier"].combine_chunks(),
                    "sku": some["sku"].combine_chunks(),
                    "block": pa.array(block // 2),
                    "id": pa.array(block),  # later blocks win
                    **{c: found.column(c) for c in ("price_cents", "first_day", "last_day", "stock_flags")},
                }
            )


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The final versions of whole entities."""
    for table in whole_groups(batches, KEYS):
        for rows, found in _price_runs(table, KEYS, filled=True):
            some = table.select(KEYS).take(pa.array(rows)).combine_chunks()
            yield pa.record_batch({"supplier": some["supplier"].combine_chunks(), "sku": some["sku"].combine_chunks(), **{c: found.column(c) for c in found.schema.names}})


def price_versions(history: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All price versions ``(supplier, sku, first_day, last_day, price_cents, stock_flags)`` of each listing.

    ``history`` needs id, supplier, sku, price_unit, first_seen, last_seen, stock_flags; further columns are
    ignored. Rows without price, supplier, sku or a date, or running backwards, are void. Of rows that cover a
    day the greatest id wins (null id is the least; equal ids: the greater price, then dates, then flags).
    Null and empty flags count as in stock; a flag outside ASCII counts as in stock. Days between a listing's
    first and last covered days that nothing covers repeat the day before. An empty table gives no rows.
    """
    flags = F.col("stock_flags")
    rows = history.filter("price_unit is not null and first_seen <= last_seen and supplier is not null and sku is not null").select(
        "supplier",
        "sku",
        F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))).alias("id"),
        (F.col("price_unit").cast("decimal(18,2)") * 100).cast("long").alias("price_cents"),
        F.col("first_seen").cast("date").alias("first_day"),
        F.col("last_seen").cast("date").alias("last_day"),
        F.when(F.octet_length(flags) == F.char_length(flags), flags).otherwise(F.regexp_replace(flags, r"[^\x00-\x7F]", "1")).alias("stock_flags"),
    )
    order = ["id", "price_cents", "first_day", "last_day", "stock_flags"]
    key = F.xxhash64(*KEYS)
    # At most rows / block_rows entities are hot.
    hot = rows.groupBy(key.alias("h")).count().filter(F.col("count") > block_rows)
    widest = hot.agg(F.max("count")).first()[0]
    cold = rows
    merged = None
    if widest:
        blocks = 1 << max(1, int(np.ceil(np.log2(widest / block_rows))))
        hot = checkpointed(hot.select("h"))
        few = hot.count() <= MAX_HOT
        met = rows.join(F.broadcast(hot) if few else hot, key == F.col("h"))
        # Repeated rows change nothing. Blocks are ranges of id, so that a later block wins as a whole.
        met = met.dropDuplicates(["h", *rows.columns])
        cuts = F.array(*[F.lit(k / blocks) for k in range(1, blocks)])
        cut = checkpointed(met.groupBy("h").agg(F.percentile_approx("id", cuts, F.lit(10_000)).alias("cuts")))
        block = F.size(F.filter("cuts", lambda c: c < F.col("id"))).cast("long").alias("block")
        merged = met.join(F.broadcast(cut) if few else cut, "h").select(*rows.columns, block)
        cold = rows.join(F.broadcast(hot) if few else hot, key == F.col("h"), "left_anti")
        while blocks >= 1:
            merged = merged.repartition(*KEYS, "block").sortWithinPartitions(*KEYS, "block", *order).mapInArrow(_reduce, RUNS)
            blocks //= 2
        merged = merged.select(rows.columns)
    every = cold if merged is None else cold.unionByName(merged)
    return every.repartition(*KEYS).sortWithinPartitions(*KEYS, *order).mapInArrow(_versions, VERSIONS)
