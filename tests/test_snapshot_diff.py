import datetime as dt

from pricelattice.operators.snapshot_diff import snapshot_changes
from tests.frames import frame

SNAP = "id long, sku string, supplier string, scraped_at date, price_unit decimal(12,2), price_bulk decimal(12,2), stock string, n int, h string"
RUNS = "supplier string, started_at timestamp_ntz, status string"


def day(n):
    return dt.date(2025, 1, n)


def test_changes(spark):
    runs = [("a", dt.datetime(2025, 1, n, 23, 59), s) for n, s in ((1, "success"), (2, "failed"), (3, "success"), (3, "success"), (4, "success"), (5, "running"), (6, "success"))]
    snaps = [
        (1, "keep", "a", day(1), 5, None, " Disponible", 0, "x"), (2, "keep", "a", day(3), 5, None, "disponible ", 0, "x"),
        (3, "gone", "a", day(1), 5, 5, None, 0, "x"), (4, "lost", "a", day(2), 5, 5, None, 0, "x"),  # a failed run's day doesn't count
        (9, "twice", "a", day(1), 7, 5, None, 0, "x"), (5, "twice", "a", day(1), 6, 5, None, 0, "x"), (6, "twice", "a", day(3), 6, 5, None, 0, "x"),
        (7, "null", "a", day(1), None, 5, "u", 0, "x"), (8, "null", "a", day(3), 5, None, "u", 0, "x"),  # nulls change places
        (10, "new", "a", day(3), 5, 5, None, 0, "x"), (10, "new", "a", day(3), 5, 5, None, 0, "x"), (11, None, "a", day(3), 5, 5, None, 0, "x"), (12, "other", "b", day(3), 5, 5, None, 0, "x"),
    ]
    got = sorted((str(r.scraped_at), r.sku, r.change) for r in snapshot_changes(frame(spark, snaps, SNAP), spark.createDataFrame(runs, RUNS)).collect())
    third = [("2025-01-03", "gone", "removed"), ("2025-01-03", "new", "added"), ("2025-01-03", "null", "changed"), ("2025-01-03", "twice", "changed")]
    # Day 4 is complete and empty: all is gone; day 6 has nothing to compare with but emptiness.
    assert got == third + [("2025-01-04", k, "removed") for k in ("keep", "new", "null", "twice")]


def test_empty(spark):
    assert snapshot_changes(frame(spark, [], SNAP), spark.createDataFrame([], RUNS)).count() == 0
