"""Stored periods, groups, panels and reports on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelattice.operators import brands, compare, periods, relational

D = lambda n: dt.date(2025, 1, n)
PERIODS = "id long, supplier string, sku string, price int, first_seen date, last_seen date, stock_flags string"
SEEN = "supplier string, sku string, price int, flag string"


def test_a_day_extends_closes_and_opens(spark):
    stored = spark.createDataFrame([(1, "a", "same", 5, D(1), D(2), "10"), (2, "a", "changed", 5, D(1), D(2), "11"), (3, "a", "unseen", 5, D(1), D(2), "11"), (4, "a", "old", 4, D(1), D(1), "1"), (5, "a", "old", 5, D(2), D(3), "10"), (6, "a", "null", None, D(1), D(1), "")], PERIODS)
    day = spark.createDataFrame([("a", "same", 5, "1"), ("a", "changed", 6, "0"), ("a", "new", 7, "1"), ("a", "old", 5, "1"), ("a", "null", None, "1"), ("a", "new", 7, "1")], SEEN)
    after = periods.upsert_day(stored, day, D(5))
    got = sorted((r.sku, r.id or 0, r.price, r.first_seen.day, r.last_seen.day, r.stock_flags) for r in after.collect())
    assert got == sorted([("same", 1, 5, 1, 5, "10001"), ("changed", 2, 5, 1, 4, "1111"), ("changed", 0, 6, 5, 5, "0"), ("unseen", 3, 5, 1, 2, "11"), ("old", 4, 4, 1, 1, "1"), ("old", 5, 5, 2, 5, "1001"), ("null", 6, None, 1, 5, "1111"), ("new", 0, 7, 5, 5, "1")], key=lambda r: (r[0], r[1]))
    again = periods.upsert_day(after, day, D(5))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, again.collect()), key=key) == sorted(map(tuple, after.collect()), key=key)
    assert periods.upsert_day(stored.limit(0), day, D(5)).count() == 5 and periods.upsert_day(stored, day.limit(0), D(5)).count() == 6


def test_days_make_what_the_fold_makes(spark):
    """One upsert a day gives the periods of the whole at once."""
    rows = [("a", "1", D(n), p, f) for n, p, f in ((1, 5, "1"), (2, 5, "0"), (5, 6, "1"), (6, 6, "1"), (9, 5, "1"))] + [("b", "1", D(3), 5, "1")]
    seen = spark.createDataFrame(rows, "supplier string, sku string, day date, price int, flag string")
    stored = spark.createDataFrame([], PERIODS)
    for day in sorted({r[2] for r in rows}):
        stored = periods.upsert_day(stored, seen.filter(F.col("day") == F.lit(day)), day)
        stored = spark.createDataFrame(stored.collect(), PERIODS)
    columns = ["supplier", "sku", "price", "first_seen", "last_seen", "stock_flags"]
    assert sorted(map(tuple, stored.select(columns).collect())) == sorted(map(tuple, periods.fold_periods(seen).select(columns).collect()))
    assert periods.first_history(stored, seen).count() == 0 and periods.first_history(stored.limit(0), seen).count() == 4


def test_groups_and_panels(spark):
    offers = spark.createDataFrame([("k", "a", "2", None, 5), ("k", "a", "1", None, None), ("k", "b", "1", "n", None), ("j", "b", "1", None, None)], "k string, supplier string, sku string, name string, price int")
    assert {r.k: (r.name, r.price) for r in compare.display_attributes(offers, "k", ["name", "price"], "supplier", "sku").collect()} == {"k": ("n", 5), "j": (None, None)}
    suppliers = compare.suppliers_of(offers)
    assert suppliers == ["a", "b"] and [r.k for r in compare.hide_unpriced(compare.supplier_matrix(offers, "k", suppliers), suppliers).collect()] == ["k"]
    assert [(r.sku, r.place) for r in relational.ranked(offers, 2, F.desc_nulls_last("price"), F.asc("k"), F.asc("sku")).collect()] == [("2", 1), ("1", 2)]
    assert relational.visible(offers, ["x", "sku"], ["k"]).columns == ["sku"] and relational.visible(offers, [], ["k"]).columns == ["k"]
    assert relational.panel(offers, chosen={"supplier": ["b"], "k": []}, ranges={}).count() == 2 and relational.query(spark, "select * from {o} where k = :k", {"o": offers}, k="j").count() == 1
    with pytest.raises(ValueError, match="suppliers"):
        compare.MAX_SUPPLIERS, keep = 1, compare.MAX_SUPPLIERS
        try:
            compare.suppliers_of(offers)
        finally:
            compare.MAX_SUPPLIERS = keep


def test_brand_report(spark):
    rows = [("Kudrodiax", "a"), ("KUDRODIAX", "b"), ("Kudrodiaz", "c"), ("Solo", "a"), ("!!", "a"), (None, "a")]
    products = spark.createDataFrame(rows, "brand string, supplier string")
    got = {(r.section, r.name): (r.members, r.suppliers, r.listings) for r in brands.brand_report(products).collect()}
    assert got == {
        ("same", "KUDRODIAX"): (["KUDRODIAX"], ["a", "b"], 2),
        ("similar", "KUDRODIAX"): (["KUDRODIAX", "KUDRODIAZ"], ["a", "b", "c"], 3),
        ("single", "SOLO"): (["SOLO"], ["a"], 1),
    }
    assert [(r.a, r.b, r.listings_a, r.listings_b) for r in brands.review_list(products).collect()] == [("KUDRODIAX", "KUDRODIAZ", 2, 1)]
    edges = spark.createDataFrame([("a", "b", 90.0), ("b", "c", 85.0), ("x", "y", 99.0)], "a string, b string, score double")
    assert {r.cluster: (r.members, r.size, r.best) for r in brands.cluster_members(edges).collect()} == {"a": (["a", "b", "c"], 3, 90.0), "x": (["x", "y"], 2, 99.0)}


def test_clean_names(spark):
    import unicodedata

    from pricelattice.functions.text import clean_name, compatible

    texts = ["ﬁdeos al huevo ½ kg", "MIEL de la SIERRA", "ＳＡＬ fina", "caña ② x³", "", None, "plain ascii"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", compatible(F.col("t")).alias("k"), clean_name(F.col("t")).alias("c")).collect():
        assert r.k == (None if r.t is None else unicodedata.normalize("NFKC", r.t))
    assert frame.filter("t like 'MIEL%'").select(clean_name(F.col("t")).alias("c")).first().c == "Miel de la Sierra"


def test_reports_as_files(spark, tmp_path):
    from pricelattice.sources import writers
    from pricelattice.streaming.periods import VersionedTable

    rows = [("same", "AB", ["AB"], ["x", "y"], 3), ("similar", "CD", ["CD", "CE"], ["x", "z"], 2)]
    writers.write_brand_report(spark.createDataFrame(rows, "section string, name string, members array<string>, suppliers array<string>, listings int"), str(tmp_path / "r"))
    assert {(r.section, r.value) for r in spark.read.text(str(tmp_path / "r")).collect()} == {("same", "AB (x, y, 3)"), ("similar", "CD (x, z, 2): CD, CE")}
    table = VersionedTable(spark, str(tmp_path / "t"))
    for n in range(1, 6):
        table.write(spark.range(n), n)
    assert table.versions() == [3, 4, 5] and table.read().count() == 5 and table.read(before=5).count() == 4
    writers.write_text(spark.createDataFrame([("a",)], "line string"), str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first().value == "a"
