import datetime as dt
import random

import numpy as np
import pytest

from pricelattice.operators.price_spikes import Series, fit_seller, implausible_prices, posteriors
from tests.frames import frame

COLS = "id long, sku string, supplier string, scraped_at date, price_unit decimal(12,2), price_bulk decimal(12,2), stock string, day string"


def sample(seed=1, listings=120, dates=24):
    """Prices of a steady seller (steps) and a restless one (small moves); returns rows and the planted cases."""
    r = random.Random(seed)
    rows, wrong, number = [], set(), 0
    for seller in ("step", "restless"):
        for k in range(listings):
            price = r.uniform(100, 5000)
            stuck = r.randint(2, 10) if seller == "restless" and k % 12 == 0 else None
            held = None
            for t in range(dates):
                if seller == "step":
                    price *= r.choice([1] * 8 + [1.08, 0.95])
                else:
                    price *= r.uniform(0.98, 1.02)
                value, number = round(price, 2), number + 1
                if stuck is not None and stuck <= t < stuck + 7:
                    held = held or value
                    value = held
                    if t > stuck:
                        wrong.add((number, "price_unit"))
                elif r.random() < 0.01:
                    value = round(price * r.choice([10, 100, 0.01, 4]), 2)
                    wrong.add((number, "price_unit"))
                if r.random() < 0.002:
                    value = 0
                    wrong.add((number, "price_unit"))
                rows.append((number, f"s{k}", seller, dt.date(2025, 1, 1) + dt.timedelta(days=5 * t), value, None, "x", "y"))
    return rows, wrong


@pytest.fixture(scope="module")
def planted():
    return sample()


@pytest.mark.parametrize("hot_rows", [200_000, 10])
def test_planted(spark, planted, hot_rows):
    rows, wrong = planted
    got = {(r.id, r.field) for r in implausible_prices(frame(spark, rows, COLS), hot_rows).collect()}
    assert len(got & wrong) / len(wrong) > 0.93 and len(got & wrong) / len(got) > 0.93


def test_edges(spark):
    d = dt.date(2025, 1, 1)
    rows = [(1, "a", "s", d, -1, 0, None, None), (2, None, "s", d, 0, 5, None, None), (3, "a", "s", None, None, None, None, None), (4, "b", "s", d, 10, None, None, None), (4, "b", "s", d, 10, None, None, None)]
    assert {(r.id, r.field) for r in implausible_prices(frame(spark, rows, COLS)).collect()} == {(1, "price_unit"), (1, "price_bulk"), (2, "price_unit")}
    assert implausible_prices(frame(spark, [], COLS)).count() == 0


def test_repeated_rows_are_cases_of_their_own(spark):
    d = [dt.date(2025, 1, n) for n in range(1, 12)]
    rows = [(n, "a", "s", x, 10 + n / 100, None, None, None) for n, x in enumerate(d)]
    rows += [(20, "a", "s", d[5], 1000, None, None, None), (21, "a", "s", d[5], 1000, None, None, None), (22, "a", "s", d[5], 10.05, None, None, None)]
    assert sorted(r.id for r in implausible_prices(frame(spark, rows, COLS)).collect()) == [20, 21]


@pytest.mark.parametrize("bounds", [(100_000, 100_000), (0, 0)])
@pytest.mark.parametrize("hot_rows", [200_000, 10])
def test_hot_listings_give_each_row_once(spark, hot_rows, bounds, monkeypatch):
    from pricelattice.operators import price_spikes

    monkeypatch.setattr(price_spikes, "MAX_HOT", bounds[0])
    monkeypatch.setattr(price_spikes, "MAX_SELLERS", bounds[1])
    d = [dt.date(2025, 1, n) for n in range(1, 12)]
    rows = [(n, "a", "s", x, 10 + n / 100, 8 + n / 100, None, None) for n, x in enumerate(d)]
    rows += [(20 + n, "a", "s", d[5], 1000, bulk, None, None) for n, bulk in enumerate([8.01, 8.02, 8.03, None, 8.03])] + [(30, "a", "s", d[5], 10.05, 8.05, None, None)]
    got = sorted((r.id, r.field) for r in implausible_prices(frame(spark, rows, COLS), hot_rows).collect())
    assert got == [(n, "price_unit") for n in range(20, 25)]


def test_forward_backward_is_exact():
    """Posteriors of a short series equal the sum over all state paths."""
    import itertools

    x = np.array([0.0, 0.01, 3.0, 0.02])
    values = np.exp(np.array([5, 5.01, 8, 5.02]))
    series = Series(np.zeros(4, int), np.arange(4), values)
    p = {k: np.full(4, v) for k, v in {"narrow": 0.01, "wide": 0.1, "w_narrow": 0.7, "w_wide": 0.3, "same_rate": 0.05, "centre": 0.0}.items()}
    got = posteriors(series, x, p)
    from pricelattice.operators import price_spikes as m

    k = m.STUCK_RATE
    move = np.array([[1 - m.SPIKE_RATE - k, m.SPIKE_RATE, k], [1 - m.SPIKE_STAYS, m.SPIKE_STAYS, 0], [1 - m.STUCK_STAYS, 0, m.STUCK_STAYS]])
    equal = np.where(np.arange(4) == 0, 1, 1 - 0.05)
    emit = np.column_stack([m.normal_density(x, p) * equal + 1e-12, m.SPIKE_DENSITY * equal, np.full(4, 1e-9)])
    start, total = np.array([1 - m.SPIKE_RATE, m.SPIKE_RATE, 0]), np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = start[path[0]] * emit[0, path[0]]
        for t in range(1, 4):
            w *= move[path[t - 1], path[t]] * emit[t, path[t]]
        for t in range(4):
            total[t, path[t]] += w
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_fit_ignores_spikes():
    bins = np.array([0, 1, 2, 5, 900.0])
    narrow, wide, *_ = fit_seller(bins, np.array([500, 300, 100, 20, 40.0]))
    assert narrow < wide < 0.2
