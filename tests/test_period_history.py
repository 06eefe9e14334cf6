import datetime as dt
import random

import numpy as np
import pytest

from pricelattice.operators.period_history import Runs, merge_round, price_versions, reduced
from pricelattice.operators.periods import fold_periods, islands, mark_missing
from tests.frames import frame

COLS = "id long, supplier string, sku string, price_unit decimal(12,2), first_seen date, last_seen date, stock_flags string, block int, note string"
D0 = dt.date(2025, 1, 1)


def brute(rows):
    """Day by day, as the definition says."""
    days = {}
    for id_, sup, sku, price, first, last, flags, *_ in rows:
        if price is None or first is None or last is None or last < first or sup is None or sku is None:
            continue
        for i in range((last - first).days + 1):
            f = flags or ""
            flag = f[min(i, len(f) - 1)] if f else "1"
            key = (sup, sku, first + dt.timedelta(days=i))
            days[key] = max(days.get(key, (-(2**63) - 1,)), (id_ if id_ is not None else -(2**63), int(price * 100), first, last, f, flag))
    out = []
    for sup, sku in sorted({k[:2] for k in days}):
        mine = sorted((k[2], v[1], v[5]) for k, v in days.items() if k[:2] == (sup, sku))
        day, filled = mine[0][0], []
        by = {d: (p, f) for d, p, f in mine}
        while day <= mine[-1][0]:
            filled.append((day, *by.get(day, filled[-1][1:] if filled else None)))
            day += dt.timedelta(days=1)
        start = 0
        for i in range(1, len(filled) + 1):
            if i == len(filled) or filled[i][1] != filled[start][1]:
                out.append((sup, sku, filled[start][0], filled[i - 1][0], filled[start][1], "".join(f for _, _, f in filled[start:i])))
                start = i
    return sorted(out)


def make(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        first = D0 + dt.timedelta(days=r.randint(0, 40))
        rows.append((r.choice([i, i, None]), r.choice(["a", "b", None]), r.choice(["1", "2", "hot", "hot", "hot"]), r.choice([None, 1, 2, 3]), first, first + dt.timedelta(days=r.randint(-2, 12)), r.choice([None, "", "1", "0", "1010", "0" * 30]), 1, "x"))
    return rows + rows[:5]


@pytest.mark.parametrize("block_rows", [20_000, 7, 1])
def test_against_brute_force(spark, block_rows):
    rows = make(3, 160)
    got = sorted(tuple(r) for r in price_versions(frame(spark, rows, COLS), block_rows).collect())
    assert got == brute(rows)


def test_empty_and_void(spark):
    assert price_versions(frame(spark, [], COLS)).count() == 0
    assert price_versions(frame(spark, [(1, "a", "1", None, D0, D0, "1", 0, "")], COLS)).count() == 0


def random_runs(seed, lists, groups):
    """Runs of several lists a group, and each group's days as the latest list paints them."""
    r, rows, days = random.Random(seed), [], {}
    for g in range(groups):
        for k in range(r.randint(1, lists)):
            at = r.randint(0, 20)
            for _ in range(r.randint(0, 4) if k else 1):
                at += r.randint(0, 3)
                last, payload = at + r.randint(0, 6), (r.randint(1, 2), r.choice(b"01"))
                rows.append((g, k, at, last, *payload))
                days.update({(g, d): (k, payload) for d in range(at, last + 1) if days.get((g, d), (-1,))[0] <= k})
                at = last + 1
    return Runs(*(np.array(c, np.int64) for c in zip(*rows))), {k: v[1] for k, v in days.items()}


@pytest.mark.parametrize("seed", range(25))
def test_rounds_merge_like_painting(seed):
    runs, days = random_runs(seed, 1 + 3 * (seed % 6), 5)
    rounds = 0
    while runs.list.max() > 0:
        before = runs.list.max()
        runs, rounds = merge_round(runs), rounds + 1
        assert runs.list.max() == before // 2
    got = {(g, d): (p, f) for g, _, a, z, p, f in zip(*runs) for d in range(a, z + 1)}
    assert got == days and sum(runs.last - runs.first + 1) == len(days)
    # Coalesced: no two adjacent runs of a group agree.
    assert not ((runs.group[1:] == runs.group[:-1]) & (runs.last[:-1] + 1 == runs.first[1:]) & (runs.price[1:] == runs.price[:-1]) & (runs.flag[1:] == runs.flag[:-1])).any()


def test_rounds_are_logarithmic(monkeypatch):
    from pricelattice.operators import period_history

    calls = []
    monkeypatch.setattr(period_history, "merge_round", lambda runs: calls.append(1) or merge_round(runs))
    n = 1000
    runs = reduced(Runs(np.zeros(n, np.int64), np.arange(n), np.arange(n), np.arange(n) + 1, np.ones(n, np.int64), np.full(n, 49)))
    assert len(calls) == 10 and list(zip(*runs)) == [(0, 0, 0, n, 1, 49)]


def test_folds(spark):
    day = lambda n: D0 + dt.timedelta(days=n)
    rows = [("a", "1", day(0), 1, "1"), ("a", "1", day(3), 1, "0"), ("a", "1", day(5), 2, "1"), ("a", "1", day(6), None, "1"), ("a", "1", day(8), 1, "1")]
    frame = spark.createDataFrame(rows, "supplier string, sku string, day date, price int, flag string")
    got = sorted((r.first_seen, r.last_seen, r.price, r.stock_flags) for r in fold_periods(frame).collect())
    assert got == [(day(0), day(4), 1, "11100"), (day(5), day(7), 2, "111"), (day(8), day(8), 1, "1")]
    assert sorted((r.first_seen, r.last_seen) for r in islands(frame).collect()) == [(day(0), day(3)), (day(5), day(5)), (day(8), day(8))]


def test_mark_missing(spark):
    periods = spark.createDataFrame([(1, "a", "1", D0, D0, "1"), (2, "a", "2", D0, D0, "")], "id long, supplier string, sku string, first_seen date, last_seen date, stock_flags string")
    seen = spark.createDataFrame([("a", "1")], "supplier string, sku string")
    got = {r.sku: (r.last_seen, r.stock_flags) for r in mark_missing(periods, seen, "2025-01-04").collect()}
    assert got == {"1": (D0, "1"), "2": (dt.date(2025, 1, 4), "110")}
    assert {r.last_seen for r in mark_missing(periods, seen.limit(0), "2025-01-04").collect()} == {D0}
