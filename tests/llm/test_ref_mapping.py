import datetime as dt
import random

import pytest

from pricelattice.llm.ref_mapping import Trie, aliases, build_mapper, entries_in_reach, map_values, osa, reach, squeeze

REFS = [
    (1, "brand", "Kudrodiax"), (2, "brand", "La Lumcom"), (3, "brand", "Tívonplex Nórperye"), (4, "product_type", "Fideos Mostachol"), (5, "product_type", "Fideos Tallarín"),
    (6, "product_type", "Sal Fina"), (7, "category", "Almacén > Infusiones"), (8, "category", "Frescos > Lácteos"),
]
CODES = [("1", "ALMACEN"), ("1_101", "INFUSIONES"), ("5", "FRESCOS"), ("5_104", "LACTEOS")]
MEANT = [
    ("brand", "KUDRODIAX", 1), ("brand", "kudrodíax  ", 1), ("brand", "*Kudrodiax*", 1), ("brand", "Kudrodiax S.A.", 1), ("brand", "Kudrodiax - Línea Hogar", 1), ("brand", "Kudr0d1ax", 1),
    ("brand", "Kudordiax", 1), ("brand", "Kudrodia", 1), ("brand", "Lumcom, La", 2), ("brand", "Nórperye Tívonplex", 3), ("brand", "Tívonplex Nórpe", 3), ("brand", "varios", 0),
    ("brand", "", 0), ("brand", "   ", 0), ("brand", "x" * 20_000, 0), ("brand", "7790", 0), ("brand", "S/D", 0), ("product_type", "Mostachol, Fideos", 4), ("product_type", "Fideo Mostachol", 4),
    ("product_type", "Sales Fina", 6), ("product_type", "Fideos", 0), ("product_type", "Colchones", 0), ("category", "1_101", 7), ("category", "1-101", 7), ("category", "1_999", 0),
    ("category", "1", 0), ("category", "/almacen/infusiones/", 7), ("category", "infusiones-4", 7), ("category", "ALMACÉN / INFUSIONES", 7), ("category", "lacteos", 8), ("category", "home", 0),
]


@pytest.mark.parametrize("field,value,ref", MEANT)
def test_meant(field, value, ref):
    assert build_mapper(REFS, CODES).map(field, value)[0] == ref


def test_equal_values_are_no_case():
    assert build_mapper(REFS, CODES).map("brand", "La Lumcom") is None


def test_automaton_against_brute_force():
    r = random.Random(4)
    words = {"".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(200)}
    trie = Trie({w: {w} for w in words})
    for _ in range(300):
        query, edits = "".join(r.choice("abcde") for _ in range(r.randint(0, 7))), r.randint(0, 3)
        assert trie.within(query, edits) == {w: osa(query, w) for w in words if osa(query, w) <= edits}


@pytest.mark.parametrize("shard", [50_000, 3])
def test_frame(spark, shard):
    t = dt.datetime(2025, 1, 1)
    cols = "supplier string, sku string, updated_at timestamp_ntz, brand string, product_type string, category string, ref_id long, field string"
    rows = [("a", "1", t, "KUDRODIAX", "Fideos Mostachol", "5_104", 9, "z")] * 2 + [("a", "1", dt.datetime(2024, 1, 1), "KUDRODIAX", "Fideos Mostachol", "5_104", 9, "z"), ("a", "2", t, "", None, None, 9, "z"), ("b", "1", t, "Lumcom La", "nada", "home", 9, "z"), (None, "1", t, "x", None, None, 9, "z")]
    products = spark.createDataFrame(rows, cols)
    refs = spark.createDataFrame([*REFS, (None, "brand", "x"), (9, None, "x")], "ref_id long, field string, value string")
    codes = spark.createDataFrame([*CODES, (None, "X")], "cpath string, name string")
    got = sorted(tuple(r) for r in map_values(products, refs, codes, shard).collect())
    assert got == [("a", "1", "brand", 1), ("a", "1", "category", 8), ("a", "2", "brand", 0), ("b", "1", "brand", 2), ("b", "1", "category", 0), ("b", "1", "product_type", 0)]
    assert map_values(products.limit(0), refs, codes).count() == 0
    assert {r.ref_id for r in map_values(products, refs.limit(0), codes.limit(0)).collect()} == {0}


@pytest.mark.parametrize("shard", [4, 1])
def test_shards_decide_alike(spark, shard):
    """Full spellings before aliases, single continuations and codes, whichever shard knows of them."""
    refs = [*REFS, (11, "brand", "Miel Pura"), (12, "brand", "Pura Miel"), (13, "brand", "Continuando Uno"), (14, "brand", "Continuando Dos"), (15, "brand", "Soledad Larga"), (16, "category", "Otra > Infusiones")]
    values = [("brand", v) for v in ("PURA MIEL", "MIEL PURA", "Continuando", "Soledad L", "PURA MIAL", "Kudordiax", "La Lumcom", "zzz", "")] + [("category", v) for v in ("1_101", "1_999", "5-104", "infusiones")]
    t = dt.datetime(2025, 1, 1)
    cols = "supplier string, sku string, updated_at timestamp_ntz, brand string, product_type string, category string"
    rows = [("a", str(n), t, v if f == "brand" else None, None, v if f == "category" else None) for n, (f, v) in enumerate(values)]
    products = spark.createDataFrame(rows, cols)
    frame, codes = spark.createDataFrame(refs, "ref_id long, field string, value string"), spark.createDataFrame(CODES, "cpath string, name string")
    mapper = build_mapper(refs, CODES)
    want = {(str(n), f): hit[0] for n, (f, v) in enumerate(values) if (hit := mapper.map(f, v))}
    assert {(r.sku, r.field): r.ref_id for r in map_values(products, frame, codes, shard).collect()} == want
    assert want["0", "brand"] == 12 and want["2", "brand"] == 0 and want["3", "brand"] == 15 and ("6", "brand") not in want
    near = entries_in_reach(products, frame, codes, shard).collect()
    assert sorted(map(tuple, near)) == sorted(map(tuple, entries_in_reach(products, frame, codes).collect()))
    # All entries within the distance, by brute force over the aliases.
    for value in ("PURA MIAL", "Kudordiax"):
        form = squeeze(value)
        brute = {r: min(osa(form, a) for a in aliases(v, False)) for r, f, v in refs if f == "brand"}
        # The full spelling of one entry is not an alias of another.
        got = {r.ref_id: r.distance for r in near if r.value == value}
        assert got and set(got) <= {r for r, d in brute.items() if d <= reach(len(form))} and min(got.values()) == min(brute.values())
