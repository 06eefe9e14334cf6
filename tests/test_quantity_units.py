import datetime as dt

import pytest

from pricelattice.functions.quantity import in_base, parse, read
from pricelattice.operators import units
from pricelattice.operators.units import listing_quantities, propagate, snap
from tests.frames import frame

STATED = [
    ("Harina 3x125 g (art 20) UxB 12", (125, "g", 3)), ("Cerveza pack 4 u x 1,5lt", (1500, "ml", 4)), ("Multipack 12 de 90 GR", (90, "g", 12)),
    ("125 GR x 3 un", (125, "g", 3)), ("4 rollos x 80 Mts.", (80000, "mm", 4)), ("6x½ L", (500, "ml", 6)), ("pack 4 u x 1/2 KG bulto x36", (500, "g", 4)),
    ("2.000 c.c.", (2000, "ml", 1)), ("0.800 kg", (800, "g", 1)), ("5.000 KG", (5000, "g", 1)), ("medio kilo", (500, "g", 1)), ("kilo y medio", (1500, "g", 1)),
    ("4xmedio kilo", (500, "g", 4)), ("cuarto kilo", (250, "g", 1)), ("1 1/2 kg", (1500, "g", 1)), ("12 fl. oz.", (354.882, "ml", 1)), ("8 oz", (226.796, "g", 1)),
    ("1/2 lb", (226.796, "g", 1)), ("½ docena", (6, "uni", 1)), ("10 DOC.", (120, "uni", 1)), ("6 pares", (12, "uni", 1)), ("X48", (48, "uni", 1)),
    ("x 24 unidades bulto x36", (24, "uni", 1)), ("20 cl", (200, "ml", 1)), ("25000 mg", (25, "g", 1)),
]


@pytest.mark.parametrize("text,want", STATED)
def test_stated(text, want):
    got = parse(text)
    assert (round(got.value, 3), got.unit, got.pieces) == want


@pytest.mark.parametrize("text", [None, "", " ", "Llevate 2x1", "12 cuotas -20% OFF", "Cod.6266 Ref 12 Nº 4", "(caja 12 bultos)", "Edición 2025", "1/0 kg"])
def test_no_quantity(text):
    assert parse(text) is None


def test_typed_and_conversions():
    assert in_base(2.0, "KG") == (2000.0, "g") and in_base(None, "g") is None and in_base(1.0, None) is None and in_base(0.0, "g") is None and in_base(1.0, "zz") is None
    assert snap(1003.0) == 1000.0 and snap(28.3) == pytest.approx(28.349523125) and snap(1.5) is None
    # kg's numbers are a thousandth of g's, sack's a tenth of kg's: scales multiply along the path; an island isn't reached.
    got = propagate([("kg", "g", 0.001, 50), ("sack", "kg", 0.1, 20), ("x", "y", 1.0, 90)])
    assert {k: f for k, (f, _) in got.items()} == {"g": "g", "ml": "ml", "mm": "mm", "u": "uni", "kg": "g", "sack": "g"}
    assert got["kg"][1] == pytest.approx(1000.0) and got["sack"][1] == pytest.approx(10_000.0)


def test_read_as_written():
    assert read("Miel 3x1,5 Kg") == (1.5, "kg", 3) and read("Pilas x48") == (48.0, "x", 1) and read("Huevos docena") == (1.0, "docena", 1) and read("") is None


def test_listings(spark):
    t = dt.datetime(2025, 1, 1)
    cols = "supplier string, sku string, updated_at timestamp_ntz, name string, size string, size_value decimal(12,4), size_unit string, brand string, variant string, source string, qty int"
    rows = [
        ("a", "1", t, "Miel 500 g", "1 kg", None, None, "X", "v", "s", 1), ("a", "1", t, "Miel 500 g", "1 kg", None, None, "X", "v", "s", 1),  # repeated row
        ("a", "2", t, "Miel", "x 3 un", 7, "kg", "X", "v", "s", 1), ("a", "3", t, "Miel", None, 2, "kilo", None, None, "s", 1),
        ("a", "4", t, None, None, None, None, None, None, "s", 1), ("a", "5", t, "Miel", None, 500000, "g", "X", "v", "s", 1),  # thousand times the entity's 500 g
        (None, "6", t, "1 kg", None, None, None, None, None, "s", 1), ("b", "1", t, "Miel " + "z" * 50_000, None, 1, "pinta", None, None, "s", 1),
    ]
    got = {(r.supplier, r.sku): (r.qty, r.unit, r.pieces) for r in listing_quantities(frame(spark, rows, cols)).collect()}
    assert got == {("a", "1"): (500, "g", 1), ("a", "2"): (3, "uni", 1), ("a", "3"): (2000, "g", 1), ("a", "5"): (500, "g", 1)}
    assert listing_quantities(frame(spark, [], cols)).count() == 0


def planted(spark):
    """60 articles: two honest sellers by name, and sellers who type numbers in their own ways."""
    t, rows = dt.datetime(2025, 1, 1), []
    cols = "supplier string, sku string, updated_at timestamp_ntz, name string, size string, size_value decimal(12,4), size_unit string, brand string, variant string"
    for k in range(60):
        grams, key = 100 + 25 * k, ("B", f"v{k}")
        rows += [("a", f"{k}", t, f"Miel {grams} g", None, None, None, *key), ("b", f"{k}", t, f"Miel {grams / 1000} kg", None, None, None, *key)]
        rows.append(("thousandth", f"{k}", t, "Miel", None, grams / 1000, "g", *key))  # types kilos and calls them g
        rows.append(("tare", f"{k}", t, "Miel", None, grams + 80, "g", *key))  # weighs the jar too
        rows.append(("bare", f"{k}", t, "Miel", None, grams / 10, None, *key))  # numbers without a unit
        rows.append(("own_unit", f"{k}", t, "Miel", None, grams / 1000, "kgr", *key))  # a unit the table doesn't know
        rows.append(("honest", f"{k}", t, "Miel", None, grams / 1000, "kg", *key))
    rows.append(("bare", "other", t, "Miel", None, 7, None, "B", "unheard of"))
    return frame(spark, rows, cols)


def test_graph_mends_sources(spark):
    got = {(r.supplier, r.sku): (r.qty, r.unit) for r in listing_quantities(planted(spark)).collect()}
    want = {(s, f"{k}"): (100 + 25 * k, "g") for s in ("a", "b", "thousandth", "tare", "bare", "own_unit", "honest") for k in range(60)}
    assert got == want


def test_without_the_graph_sources_stay_wrong(spark):
    off = 10**9
    got = {(r.supplier, r.sku): (r.qty, r.unit) for r in listing_quantities(planted(spark), least=off, source_least=off).filter("sku = '4'").collect()}
    assert got["a", "4"] == got["b", "4"] == got["honest", "4"] == (200, "g")
    assert got["tare", "4"] == (280, "g") and not {("bare", "4"), ("own_unit", "4")} & set(got)


def test_notations_are_learned(spark, monkeypatch):
    # The table is needed for the bases alone where the links are many.
    monkeypatch.setattr(units, "FACTORS", {})
    rows = [(e, s, n, q * f) for e in range(30) for q in [100.0 + e] for s, n, f in (("a", "g", 1), ("b", "kg", 0.001), ("c", "oz", 1 / 28.349523125))]
    rows += [(e, "d", "g", 999.0) for e in range(3)]  # entities that contradict themselves give no link of it
    readings = spark.createDataFrame(rows, "entity long, supplier string, notation string, x double")
    got = units.notation_scales(readings)
    assert got["kg"] == ("g", pytest.approx(1000)) and got["oz"] == ("g", pytest.approx(28.349523125)) and units.notation_scales(readings, 10**9).get("kg") is None


def test_too_many_pairs_of_notations_raise(spark, monkeypatch):
    readings = spark.createDataFrame([(e, s, n, 1.0 + e) for e in range(60) for s, n in (("a", "g"), ("b", "gr"), ("c", "grs"))], "entity long, supplier string, notation string, x double")
    monkeypatch.setattr(units, "MAX_EDGES", 2)
    assert units.notation_scales(readings)["grs"] == ("g", pytest.approx(1.0))
    monkeypatch.setattr(units, "MAX_EDGES", 1)
    with pytest.raises(ValueError, match="pairs of notations"):
        units.notation_scales(readings)
