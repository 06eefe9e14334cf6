"""What the readers make of names; the first cases are the oracles that the inventory states."""

import pytest

from pricelattice.operators.name_readers import Dictionaries, NameReader, based, classified, cut_tail, learned_layouts, read_names, split_boundaries

KNOWN = Dictionaries(
    brands={"Poett": "Poett", "La Lumcom": "La Lumcom", "Kudrodiax": "Kudrodiax", "9 De Oro": "9 De Oro", "Rojo + Negro": "Rojo + Negro"},
    types={"Fideos": "Fideos", "Fideos Tallarin": "Fideos Tallarín", "Miel": "Miel"},
    aliases={"FID.": ("Fideos", None), "D/amb.": ("Desodorante de Ambiente", "Aerosol"), "Gallet.": ("Galletitas", None)},
    abbreviations={"KUD.": "KUDRODIAX"},
    variants=[(r"\bSurt\.", "Surtidos ")],
)
READER = NameReader(KNOWN)


def got(layout, name, *columns, category=None):
    from pricelattice.operators.name_readers import RESULT

    row = dict(zip(RESULT.names, READER.read(name, layout, category)))
    return tuple(row[c] for c in columns)


@pytest.mark.parametrize("text,value,unit", [("Miel 3x125 Grs", 375, "g"), ("Bollito Un.", 1, "uni"), ("Film 15 Mts Un.", 15, "m"), ("Lampara 18W FRIA", 18, "W"), ("Lampara CUAD.18W CALIDA", 18, "W"), ("Arroz 15+2 Kgs", 15000, "g"), ("Aceite 1.5 Lt.", 1500, "ml"), ("Lampara 860 wa", 860, "W"), ("Tubo 20 Cms", 200, "mm")])
def test_size_at_the_end(text, value, unit):
    sizes, rest = cut_tail(text)
    assert (sizes.value, sizes.unit) == (value, unit) and not any(c.isdigit() for c in rest)


@pytest.mark.parametrize("value,unit,want", [(500, "Ml", (500, "ml")), (1.8, "Kg", (1800, "g")), (20, "Uni", (20, "uni")), (2, "c.c.", (2, "ml"))])
def test_units(value, unit, want):
    assert based(value, unit) == want


@pytest.mark.parametrize("text,want", [("D/Amb.POETT", "D/Amb. POETT"), ("96*PUROCOL", "96* PUROCOL"), ("NESC.Black", "NESC. Black"), ("Gallet.9 DE ORO", "Gallet. 9 DE ORO"), ("(LC)BULL", "(LC) BULL"), ("DANVERS(F)", "DANVERS (F)"), ("F.S.Roscado", "F.S. Roscado"), ("LE.Q", "LE.Q")])
def test_boundaries(text, want):
    assert split_boundaries(text) == want


def test_type_first():
    c = ("product_type", "brand", "variant", "size_value", "size_unit", "pieces")
    assert got("type_first", "Fideos Tallarin La Lumcom caja al huevo 12x500 GR", *c) == ("Fideos Tallarín", "La Lumcom", "Al Huevo", 500, "g", 12)
    assert got("type_first", "Arroz de San Felipe Largo 1KG", *c) == ("Arroz", "San Felipe", "Largo", 1000, "g", None)
    assert got("type_first", "Cepillo Oral B Medio", "brand", "brand_source", "variant") == ("Oral B", "heuristic", "Medio")
    assert got("type_first", "Lata Kudrodiax AGRUPADOS", "product_type", "units") == ("Lata", 6) and got("type_first", "Cable EXTENS 1,5", "length") == ("1.5 mt",)
    assert got("type_first", "Bolsa 60X100 CM", "dimensions") == ("60x100 cm",) and got("type_first", "Te 50 SOBRES", "units", "units_label") == (50, "sobres")
    assert got("type_first", "Vino Kudrodiax 750 C", "size_value", "size_unit") == (750, "ml") and got("type_first", "Jabon KUDRODIAX180 GR", "brand", "size_value") == ("Kudrodiax", 180)
    assert got("type_first", "Miel", "brand", "brand_source") == ("Generico", "generico") and got("type_first", "Sarten 22 CM", "length") == ("22 cm",) and got("type_first", "Combo Kudrodiax 3X2", "dimensions") == ("3x2",)


def test_either_order():
    assert got("either", "Kudrodiax Miel Pura 500 GR", "product_type", "brand", "variant", "brand_source") == ("Miel", "Kudrodiax", "Pura", "lookup")
    assert got("either", "Miel Kudrodiax Pura x24", "product_type", "brand", "variant", "units") == ("Miel", "Kudrodiax", "Pura", 24)
    assert got("either", "Miel Otra Pura 2 L", "brand", "brand_source", "size_value") == ("Otra", "heuristic", None)  # a bare L is no unit here


def test_capitals():
    c = ("product_type", "brand", "variant", "size_value", "size_unit")
    assert got("capitals", "D/Amb.POETT Lavanda 360 M", *c) == ("Desodorante de Ambiente", "Poett", "Aerosol Lavanda", 360, "ml")
    assert got("capitals", "Gallet.9 DE ORO Clasico 200 G", *c) == ("Galletitas", "9 De Oro", "Clasico", 200, "g")
    assert got("capitals", "Papel Hig. CAUTIVA 4ux30 M", "brand", "units", "length", "size_value") == ("Cautiva", 4, "30 mt", None)
    assert got("capitals", "Te VIRGEN 20saq.", "units", "units_label") == (20, "saquitos") and got("capitals", "Alfajor TATIN 12x14 U", "pieces", "units") == (12, 14)
    assert got("capitals", "Bolsa ROLLIX 10u 60x90 e", "dimensions", "units") == ("60x90 cm", 10) and got("capitals", "Cabo BROMY Barnizado 1.20 e", "length") == ("1.2 mt",)
    assert got("capitals", "Lampara PHILCO 12=100 W", "length") == ("12 W",) and got("capitals", "Rollo CARTABELLA Daily 40p 3 U", "units", "length") == (3, "40 paños")
    assert got("capitals", "Sal CELUSAL Sobre 0.5Grs. 1000 U", "units", "length") == (1000, "0.5 gr") and got("capitals", "Pañuelos ELITE Paq.10u Compacto", "units") == (10,)
    assert got("capitals", "Gallet.FRUTIGRAN Avena 250", *c) == ("Galletitas", "Frutigran", "Avena", 250, "g") and got("capitals", "Miel KUD.Pura", "brand") == ("Kudrodiax",)
    assert got("capitals", "Ron BULL DOG 1882 C2780 Gin", "brand", "variant") == ("Bull Dog 1882", "C2780 Gin") and got("capitals", "Pilas PHILCO AA Larga", "brand", "variant") == ("Philco", "AA Larga")
    assert got("capitals", "sin marca", "brand", "product_type") == (None, "Sin Marca")


def test_size_last():
    assert got("size_last", "FID. Kudrodiax Al Huevo 500 Grs", "product_type", "brand", "variant", "size_value") == ("Fideos", "Kudrodiax", "Al Huevo", 500)
    assert got("size_last", "Rojo + Negro Lata 473 Ml", "product_type", "brand", "variant") == (None, "Rojo + Negro", "Lata")
    assert got("size_last", "Vino Light San Felipe 750", "brand", "size_value", "size_unit", "shown") == ("San Felipe", 750, "ml", "750 ml")
    assert got("size_last", "Galletas Otra 750", "size_value", "variant") == (None, "750") and got("size_last", "Miel Light", "brand") == ("Generico",)


def test_brand_first():
    c = ("brand", "product_type", "variant", "size_value", "size_unit")
    assert got("brand_first", "KUDRODIAX  Miel Surt.Pura  1,80 Kg (old)", *c) == ("KUDRODIAX", "Miel", "Surtidos Pura", 1800, "g")
    assert got("brand_first", "9 De Oro Caramelos Frutal", *c[:3]) == ("9 De Oro", "Caramelos", "Frutales")
    assert got("brand_first", "MANON 182 G", *c[:3], category="Almacén > Galletas Dulces (oferta)") == ("MANON", "Galletas Dulces", None)
    assert got("brand_first", "MANON", "product_type", category="a b c d") == ("a",) and got("brand_first", "MANON", "product_type") == (None,)


@pytest.mark.parametrize("layout", ["type_first", "either", "capitals", "size_last", "brand_first"])
def test_any_text(layout):
    for text in (None, "", "   ", "1", "500 g", "x" * 5000, "ñ°½ (", "A/B", "12x", "* * *", "\t\n"):
        assert len(READER.read(text, layout)) == 12


def test_frames(spark):
    rows = [("a", str(n), t, None, None) for n, t in enumerate(["Miel Kudrodiax Pura 500 GR", "Fideos La Lumcom 1 KG", None])]
    rows += [("b", str(n), t, "x", "done") for n, t in enumerate(["Kudrodiax Miel 500 g", "La Lumcom Fideos 1 Kg", "9 De Oro Miel 20 g"])]
    products = spark.createDataFrame(rows, "supplier string, sku string, name string, category string, classification_status string")
    layouts = learned_layouts(products, KNOWN)
    chosen = {r.supplier: r.layout for r in layouts.collect()}
    assert chosen["a"] == "type_first" and chosen["b"] in ("either", "brand_first")
    read = {(r.supplier, r.sku): (r.brand, r.product_type, r.size_value) for r in read_names(products, KNOWN, layouts).collect()}
    assert read["a", "0"] == read["b", "0"] == ("Kudrodiax", "Miel", 500.0) and read["a", "2"] == (None, None, None) and len(read) == 6
    done = {r.sku: (r.classification_status, r.classification_confidence) for r in classified(products, KNOWN, layouts).collect()}
    assert done == {"0": ("pending", "high"), "1": ("pending", "high"), "2": ("pending", "low")}
    assert read_names(products.limit(0), KNOWN).count() == 0
