"""Implausible values in price series: spikes, stuck values and impossible readings, judged per seller.

Method: a hidden Markov model per seller and price field with the states normal, spike, stuck and
out-of-range. A value is seen through its log distance to what the same listing cost around it and through
whether it repeats the preceding value. The seller's normal movement (two centred Gaussians beside a flat
spike component, and the rate of unchanged prices) is fitted by EM on the histogram of all its distances.
Forward-backward probabilities assign spike and stuck; a hard bound assigns out-of-range (zero or less).

Scale: rows meet on (supplier, sku) once; the shuffled rows serve both the fit and the judgement. A listing
with more than ``hot_rows`` rows is first collapsed to one row a date (partial aggregation), and its rows are
joined back to the judgement of their date. What reaches the fit is one histogram a seller and field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelattice.operators.arrow_groups import group_starts, whole_groups
from pricelattice.session import checkpointed

FIELDS = ("price_unit", "price_bulk")
AROUND = 4  # dates before and after
BIN, BINS = 0.005, 2000  # the histogram of log distances; the last bin is open
SPIKE_DENSITY = 1 / 16  # flat over log distances of -8..8
SPIKE_RATE, SPIKE_STAYS = 0.004, 0.02
STUCK_RATE, STUCK_STAYS = 0.003, 0.9
STUCK_DATES = 5
STEADY = 0.08  # a seller with a greater rate of unchanged values has no stuck state
HOT_ROWS = 200_000
MAX_HOT = 100_000  # hot listings whose hashes are broadcast; more are joined
MAX_SELLERS = 100_000  # parameters broadcast up to here (about 150 bytes each), joined beyond


class Series:
    """One price field of whole listings, collapsed to one value a (listing, date): that of the greatest id.

    Rows must come sorted by listing, date and id. Null and non-positive values are no part of a series.
    """

    def __init__(self, listing: np.ndarray, day: np.ndarray, value: np.ndarray):
        usable = np.flatnonzero(value > 0)
        last = np.ones(len(usable), bool)
        if len(usable):
            last[:-1] = (listing[usable][1:] != listing[usable][:-1]) | (day[usable][1:] != day[usable][:-1])
        #: Row of each point, and the point that stands for the date of each usable row.
        self.row = usable[last]
        self.usable = usable
        self.point = np.concatenate(([0], np.cumsum(last)[:-1])).astype(np.int64) if len(usable) else usable
        self.listing, self.log = listing[self.row], np.log(value[self.row])
        n = len(self.row)
        self.n = n
        begin = np.ones(n, bool)
        begin[1:] = self.listing[1:] != self.listing[:-1]
        self.start = np.flatnonzero(begin)
        self.length = np.diff(np.append(self.start, n))
        self.step = np.arange(n) - np.repeat(self.start, self.length)
        self.same = np.zeros(n, bool)
        if n:
            cents = np.rint(value[self.row] * 100)
            self.same[1:] = (cents[1:] == cents[:-1]) & ~begin[1:]
        self.refs = self._references()

    def _shifted(self, k: int) -> np.ndarray:
        """Log value k dates later (earlier for k < 0), NaN outside the listing."""
        out = np.full(self.n, np.nan)
        to = self.step + k
        inside = (to >= 0) & (to < np.repeat(self.length, self.length))
        out[inside] = self.log[np.flatnonzero(inside) + k]
        return out

    @staticmethod
    def _middles(columns: list[np.ndarray], least: int) -> list[np.ndarray]:
        """Lower and upper median over the columns' present values; NaN below ``least`` values."""
        table = np.sort(np.column_stack(columns), axis=1)
        count = (~np.isnan(table)).sum(axis=1)
        rows = np.arange(len(table))
        out = []
        for at in (np.maximum(count - 1, 0) // 2, np.minimum(count // 2, table.shape[1] - 1)):
            middle = table[rows, at]
            middle[count < least] = np.nan
            out.append(middle)
        return out

    def _references(self) -> np.ndarray:
        before = [self._shifted(-k) for k in range(1, AROUND + 1)]
        after = [self._shifted(k) for k in range(1, AROUND + 1)]
        return np.column_stack([*self._middles(before, 2), *self._middles(after, 2), *self._middles([*before, *after], 1)])

    def distance(self, log: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Smallest log distance of values standing at ``point`` to the level before, after or around; 0 without any.

        Before and after speak for a value only with both middles, so one wrong neighbour can't excuse another.
        """
        gap = np.abs(log[:, None] - self.refs[point])
        gap[np.isnan(gap)] = np.inf
        least = np.minimum(np.minimum(gap[:, 0:2].max(axis=1), gap[:, 2:4].max(axis=1)), gap[:, 4:6].min(axis=1))
        return np.where(np.isfinite(least), least, 0.0)

    def distances(self, centre: np.ndarray) -> np.ndarray:
        """Distance of each point. Of a listing with two dates, only the value farther from ``centre`` is off."""
        x = self.distance(self.log, np.arange(self.n))
        pair = np.flatnonzero(self.length == 2)
        a = self.start[pair]
        b = a + 1
        off = np.abs(self.log - centre)
        x[np.where(off[a] > off[b], b, a)] = 0.0
        return x


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    starts = group_starts(table, ["supplier", "sku"])
    listing = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    day = table["day"].combine_chunks().cast(pa.int32()).to_numpy(zero_copy_only=False)
    return listing, day, {f: table[f].combine_chunks().to_numpy(zero_copy_only=False).astype(float) for f in FIELDS}


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(supplier, field, bin, points, same, steps, log_sum): one batch of partial histograms per input slice."""
    for table in whole_groups(batches, ["supplier", "sku"]):
        listing, day, values = _columns(table)
        codes = table["supplier"].combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = pa.concat_arrays(codes.chunks)
        seller = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out: dict[str, list] = {"supplier": [], "field": [], "bin": [], "points": [], "same": [], "steps": [], "log_sum": []}
        for number, field in enumerate(FIELDS):
            series = Series(listing, day, values[field])
            if not series.n:
                continue
            x = series.distances(np.zeros(series.n))
            known = series.length[np.cumsum(series.step == 0) - 1] > 1
            cell = seller[series.row] * (BINS + 1) + np.where(known, np.minimum((x / BIN).astype(np.int64), BINS - 1), BINS)
            used, back = np.unique(cell, return_inverse=True)
            out["supplier"].append(codes.dictionary.take(pa.array(used // (BINS + 1))))
            out["field"].append(np.full(len(used), number, np.int32))
            out["bin"].append((used % (BINS + 1)).astype(np.int32))
            out["points"].append(np.bincount(back).astype(np.int64))
            out["same"].append(np.bincount(back, series.same).astype(np.int64))
            out["steps"].append(np.bincount(back, series.step > 0).astype(np.int64))
            out["log_sum"].append(np.bincount(back, series.log))
        if out["supplier"]:
            yield pa.record_batch({k: pa.concat_arrays(v) if k == "supplier" else pa.array(np.concatenate(v)) for k, v in out.items()})


def fit_seller(bins: np.ndarray, points: np.ndarray, rounds: int = 60) -> tuple[float, float, float, float]:
    """(narrow sigma, wide sigma, narrow weight, wide weight) of the normal movement, by EM on a histogram.

    A flat third component takes the spikes, so they don't widen the others. Fewer than ten points give a
    moderate default.
    """
    total = points.sum()
    if total < 10:
        return 0.02, 0.15, 0.7, 0.3
    x = (bins + 0.5) * BIN
    order = np.argsort(x)
    share = np.cumsum(points[order]) / total
    at = lambda q: max(x[order][min(np.searchsorted(share, q), len(x) - 1)], BIN)
    narrow, wide, w = max(at(0.5), 2 * BIN), max(min(1.3 * at(0.9), 1.5), 4 * BIN), np.array([0.6, 0.38, 0.02])
    for _ in range(rounds):
        dens = np.column_stack([2 / (s * np.sqrt(2 * np.pi)) * np.exp(-0.5 * (x / s) ** 2) for s in (narrow, wide)] + [np.full(len(x), 2 * SPIKE_DENSITY)]) * w
        resp = dens / dens.sum(axis=1, keepdims=True) * points[:, None]
        mass = resp.sum(axis=0) + 1e-9
        narrow = max(np.sqrt((resp[:, 0] * x**2).sum() / mass[0]), BIN)
        wide = max(np.sqrt((resp[:, 1] * x**2).sum() / mass[1]), 1.5 * narrow)
        w = mass / mass.sum()
    keep = w[:2] / w[:2].sum()
    return float(narrow), float(wide), float(keep[0]), float(keep[1])


def _fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    inside = pdf[pdf["bin"] < BINS]
    narrow, wide, a, b = fit_seller(inside["bin"].to_numpy(float), inside["points"].to_numpy(float))
    return pd.DataFrame(
        [[key[0], key[1], narrow, wide, a, b, pdf["same"].sum() / max(1, pdf["steps"].sum()), pdf["log_sum"].sum() / max(1, pdf["points"].sum())]],
        columns=["supplier", "field", "narrow", "wide", "w_narrow", "w_wide", "same_rate", "centre"],
    )


PARAMETERS = ("narrow", "wide", "w_narrow", "w_wide", "same_rate", "centre")
PARAMETER_SCHEMA = "supplier string, field int, " + ", ".join(f"{p} double" for p in PARAMETERS)


def normal_density(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    root = np.sqrt(2 * np.pi)
    return sum(p[w] / (p[s] * root) * np.exp(-0.5 * (x / p[s]) ** 2) for s, w in (("narrow", "w_narrow"), ("wide", "w_wide")))


def posteriors(series: Series, x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Forward-backward probabilities (points, [normal, spike, stuck]); ``p`` has the parameters a point.

    All listings advance together, a date a step, the longest first. Non-positive values never enter: their
    out-of-range state has all its probability by the hard bound.
    """
    n = series.n
    first = series.step == 0
    normal, same = normal_density(x, p), series.same
    rate = np.clip(p["same_rate"], 0.001, 0.999)
    equal = np.where(first, 1.0, np.where(same, rate, 1 - rate))
    emit = np.empty((n, 3))
    emit[:, 0] = normal * equal + 1e-12
    emit[:, 1] = SPIKE_DENSITY * np.where(same, 0.3, equal)
    emit[:, 2] = np.where(first | ~same, 1e-9, normal + 1e-9)
    stuck_rate = np.where(p["same_rate"] <= STEADY, STUCK_RATE, 0.0)
    order = np.argsort(-series.length, kind="stable")
    start, length = series.start[order], series.length[order]
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) if len(length) else 0)]
    k = stuck_rate[start]
    # A stuck run shows from its second date on; the run's first date counts as normal here.
    move = np.zeros((len(start), 3, 3))
    move[:, 0, 1], move[:, 0, 2] = SPIKE_RATE, k
    move[:, 0, 0] = 1 - SPIKE_RATE - k
    move[:, 1, 1], move[:, 1, 0] = SPIKE_STAYS, 1 - SPIKE_STAYS
    move[:, 2, 2], move[:, 2, 0] = STUCK_STAYS, 1 - STUCK_STAYS
    ahead, back = np.zeros((n, 3)), np.ones((n, 3))
    for t, m in enumerate(alive):
        at = start[:m] + t
        now = emit[at] * (np.array([1 - SPIKE_RATE, SPIKE_RATE, 0.0]) if t == 0 else np.einsum("ni,nij->nj", ahead[at - 1], move[:m]))
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        m = alive[t + 1]
        at = start[:m] + t
        was = np.einsum("nij,nj->ni", move[:m], emit[at + 1] * back[at + 1])
        back[at] = was / was.sum(axis=1, keepdims=True)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True)


def judge(listing: np.ndarray, day: np.ndarray, value: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """True for each row whose value is a spike, stuck or out of range; rows sorted by listing, date and id."""
    flagged = value <= 0
    series = Series(listing, day, value)
    if not series.n:
        return flagged
    mine = {k: v[series.row] for k, v in p.items()}
    x = series.distances(mine["centre"])
    odds = posteriors(series, x, mine)
    spike = odds[:, 1] > 0.5
    # Stuck: the dates after the first of a run of STUCK_DATES or more equal values, where stuck is the likelier state.
    run = np.cumsum(~series.same) - 1
    long = np.bincount(run, minlength=run[-1] + 1)[run] >= STUCK_DATES
    stuck = long & series.same & (odds[:, 2] > 0.5)
    cents = np.rint(value * 100)
    rows, point = series.usable, series.point
    own = cents[rows] == cents[series.row[point]]
    # Another value of the same date is judged by itself, as the model sees it without neighbours.
    other = series.distance(np.log(value[rows]), point)
    there = {k: v[rows] for k, v in p.items()}
    alone = SPIKE_RATE * SPIKE_DENSITY > (1 - SPIKE_RATE) * normal_density(other, there)
    flagged[rows] |= np.where(own, spike[point] | stuck[point], alone)
    return flagged


def _with_parameters(table: pa.Table, number: int) -> dict[str, np.ndarray]:
    return {p: table[f"{p}_{number}"].combine_chunks().to_numpy(zero_copy_only=False) for p in PARAMETERS}


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["supplier", "sku"]):
        listing, day, values = _columns(table)
        for number, field in enumerate(FIELDS):
            rows = np.flatnonzero(judge(listing, day, values[field], _with_parameters(table, number)))
            if len(rows):
                yield pa.record_batch({"id": table["id"].combine_chunks().take(pa.array(rows)), "field": pa.array([field] * len(rows), pa.string())})


def _judged_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For collapsed listings: which (supplier, sku, day, field, value) is wrong."""
    for table in whole_groups(batches, ["supplier", "sku"]):
        listing, day, values = _columns(table)
        for number, field in enumerate(FIELDS):
            rows = np.flatnonzero(judge(listing, day, values[field], _with_parameters(table, number)))
            if len(rows):
                some = table.take(pa.array(rows))
                yield pa.record_batch(
                    {"supplier": some["supplier"].combine_chunks(), "sku": some["sku"].combine_chunks(), "day": some["day"].combine_chunks(), "field": pa.array([field] * len(rows), pa.string()), "value": pa.array(values[field][rows])}
                )


def implausible_prices(snapshots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, field)`` of every implausible value; field is price_unit or price_bulk.

    Rows without supplier, sku or date can't be compared: only values of zero or less are reported of them.
    Null values are no cases. On a date with several rows the greatest id's value stands for the date, and the
    others are judged against the same surroundings. A listing with one priced date has no surroundings; of one
    with two dates only the value farther from the seller's usual price can be off. Further columns are
    ignored; an empty table gives no rows.
    """
    prices = [F.col(f).cast("double").alias(f) for f in FIELDS]
    every = snapshots.select("supplier", "sku", F.col("scraped_at").cast("date").alias("day"), F.col("id").cast("long").alias("id"), *prices)
    keyed = "supplier is not null and sku is not null and day is not null"
    rows = every.filter(keyed)
    # Bare values can only be out of range.
    bare = every.filter(f"not ({keyed})").select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("v"))
    bare = bare.filter("v.value <= 0").select("id", "v.field")

    key = F.xxhash64("supplier", "sku")
    counts = rows.groupBy("supplier", key.alias("h")).count()
    sellers, widest = counts.groupBy("supplier").agg(F.max("count").alias("n")).agg(F.count("*"), F.max("n")).first()
    hot, cold = None, rows
    if (widest or 0) > hot_rows:
        hot = checkpointed(counts.filter(F.col("count") > hot_rows).select("h"))
        hot = F.broadcast(hot) if hot.count() <= MAX_HOT else hot
        cold = rows.join(hot, key == F.col("h"), "left_anti")
    order = ["supplier", "sku", "day", "id"]
    met = cold.repartition("supplier", "sku")
    collapsed = None
    if hot is not None:
        # One row a (listing, date, pair of values), however often it repeats.
        collapsed = rows.join(hot, key == F.col("h"), "left_semi").groupBy("supplier", "sku", "day", *FIELDS).agg(F.max("id").alias("id")).repartition("supplier", "sku")
    counted = [part.sortWithinPartitions(*order).mapInArrow(_histogram, "supplier string, field int, bin int, points long, same long, steps long, log_sum double") for part in (met, collapsed) if part is not None]
    histogram = counted[0] if len(counted) == 1 else counted[0].unionByName(counted[1])
    fitted = (
        histogram.groupBy("supplier", "field", "bin")
        .agg(*[F.sum(c).alias(c) for c in ("points", "same", "steps", "log_sum")])
        .groupBy("supplier", "field")
        .applyInPandas(_fit, PARAMETER_SCHEMA)
    )
    wide = fitted.groupBy("supplier").agg(*[F.max(F.when(F.col("field") == n, F.col(p))).alias(f"{p}_{n}") for n in range(len(FIELDS)) for p in PARAMETERS])
    default = {"narrow": 0.02, "wide": 0.15, "w_narrow": 0.7, "w_wide": 0.3, "same_rate": 1.0, "centre": 0.0}
    wide = wide.fillna({f"{p}_{n}": v for p, v in default.items() for n in range(len(FIELDS))})
    # A join that isn't broadcast may cut a listing in two, so its rows meet again.
    known = lambda part: part.join(F.broadcast(wide), "supplier") if sellers <= MAX_SELLERS else part.join(wide, "supplier").repartition("supplier", "sku")
    judged = known(met).sortWithinPartitions(*order).mapInArrow(_judged, "id long, field string")
    out = judged.unionByName(bare)
    if collapsed is not None:
        wrong = known(collapsed).sortWithinPartitions(*order).mapInArrow(_judged_values, "supplier string, sku string, day date, field string, value double")
        for field in FIELDS:
            # A value stands in several collapsed rows if the other price of its date varies; each row of the date is one case.
            mine = wrong.filter(F.col("field") == field).select("supplier", "sku", "day", F.col("value").alias(field))
            out = out.unionByName(rows.join(hot, key == F.col("h"), "left_semi").join(mine, ["supplier", "sku", "day", field], "left_semi").select("id", F.lit(field).alias("field")))
    return out
