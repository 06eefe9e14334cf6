import datetime as dt
import itertools

import pytest

from pricelattice.llm.product_match import alignment, correlation_clusters, matched_pairs, neighbourhood, shared_words, variant_words
from tests.frames import frame

COLS = "supplier string, sku string, product_id string, updated_at timestamp_ntz, name string, brand string, product_type string, variant string, size string, size_value decimal(12,4), size_unit string, node int"
REFS = [(1, "brand", "Kudrodiax"), (2, "brand", "La Lumcom"), (3, "product_type", "Fideos Mostachol"), (4, "product_type", "Miel")]
T = dt.datetime(2025, 1, 1)


def listing(n, name, brand="Kudrodiax", kind="Miel", variant=None, size=None):
    return ("s" + str(n % 3), str(n), f"p{n:02}", T, name, brand, kind, variant, size, None, None, 0)


GROUPS = [
    [listing(1, "Miel Canela Suave Kudrodiax 500 g", variant="Canela Suave"), listing(2, "KUDRODIAX MIEL SUAVE CANELA 0,5 KG Imperdible", "KUDR0DIAX", variant="Suave Canela"), listing(3, "miel kudrodiax canela suav. (art 22)", None, variant="Canela Suav.", size="500grs."), listing(4, "Miel Cannela Suave Kudrodiax 1/2 kg", "varios", None)],
    [listing(5, "Miel Canela Suave Kudrodiax 3x500 g", variant="Canela Suave"), listing(6, "Miel Canela Suave Kudrodiax Multipack 3 de 500 g", variant="Canela Suave")],
    [listing(7, "Miel Limón Suave Kudrodiax 500 g", variant="Limón Suave"), listing(8, "Miel Suave Limón Kudrodiax 500g", variant="Suave Limón")],
    [listing(9, "Miel Canela Suave La Lumcom 500 g", "La Lumcom", variant="Canela Suave")],
    [listing(10, "Fideos Mostachol Canela Suave Kudrodiax 500 g", kind="Fideos Mostachol", variant="Canela Suave")],
    [listing(11, "Miel Canela Suave Kudrodiax", variant="Canela Suave")], [listing(12, None, None, None)],
]


def test_pairs(spark):
    rows = [r for g in GROUPS for r in g] + [GROUPS[0][0]] + [(None, "x", "y", T, "Miel 1 g", None, None, None, None, None, None, 0)]
    # The vocabulary comes from the corpus: each word needs to be seen some times.
    rows += [listing(20 + n, "Miel Romero Familiar La Lumcom 2 kg", "La Lumcom", variant=v) for n, v in enumerate(["Canela", "Suave", "Limón", "Romero", "Familiar"] * 3)]
    refs = spark.createDataFrame(REFS, "ref_id long, field string, value string")
    got = {tuple(r) for r in matched_pairs(frame(spark, rows, COLS), refs).collect()}
    small = {(a, b) for a, b in got if b < "p20"}
    assert small == {(a[2], b[2]) for g in GROUPS for a, b in itertools.combinations(g, 2)}
    assert matched_pairs(frame(spark, [], COLS), refs).count() == 0


def test_rare_words_tell_articles_apart(spark):
    rows = [listing(n, f"Miel {v} Kudrodiax 500 g", variant=v) for n, v in enumerate(["Canela Salmón", "Salmón Canela", "Canela Búfalo", "Vacuno", "Vacuno", "Canela", "Canela"])]
    rows += [listing(20 + n, "Miel Canela La Lumcom 2 kg", "La Lumcom", variant="Canela") for n in range(40)]
    got = {tuple(r) for r in matched_pairs(frame(spark, rows, COLS), spark.createDataFrame(REFS, "ref_id long, field string, value string")).collect()}
    assert {(0, 1), (3, 4), (5, 6)} <= {(int(a[1:]), int(b[1:])) for a, b in got} and not {("p00", "p02"), ("p01", "p02"), ("p03", "p05")} & got


def test_variant_words():
    counts = [("marina", 1400, 0), ("sardina", 200, 3), ("sarrdina", 2, 0), ("vacuno", 1, 0), ("intenso", 50, 0), ("inte", 9, 9), ("intens", 3, 0), ("cordero", 4, 0), ("pavo", 3, 0), ("pato", 4, 0)]
    assert variant_words(counts) == sorted(["marina", "sardina", "vacuno", "intenso", "cordero", "pavo", "pato"])


def test_alignment():
    assert alignment(["canela", "suave"], ["suave", "canela"]) == 1.0
    assert 0.8 < alignment(["canela", "int*"], ["intenso", "canela"]) < 1
    assert alignment(["canela", "suave"], ["canela", "light"]) == 0 and alignment([], []) == 0
    assert 0 < alignment(["canela"], ["canela", "suave"]) < 0.7 and alignment(["canela"], ["canela", "suave", "light"]) == 0


@pytest.mark.parametrize("window", [3, 1000])
def test_neighbourhood_against_brute_force(spark, window):
    from pyspark.sql import functions as F

    rows = [(n, 500, "g", 1, "1", "4", v, 1) for n, v in enumerate(["canela suave", "canela suav*", "canella suave", "limon suave", "limon", "romero", "suave limon"] * 4)]
    nodes = spark.createDataFrame(rows, "node long, qty long, unit string, pieces int, brand string, kind string, variant string, members long").repartition(7)
    got = {(r.a, r.b) for r in neighbourhood(nodes, F.col("variant"), window).collect()}
    order = sorted(rows, key=lambda r: (r[6], r[0]))
    want = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(order) for b in order[i + 1 : i + 1 + window] if alignment(a[6].split(), b[6].split())}
    assert want <= got


def test_large_block_against_all_pairs(spark):
    """In a hot brand and quantity, similar nodes meet however many others lie between them."""
    tastes = ["canela", "limon", "romero", "tilo", "menta", "anana", "cedro", "lavanda", "vacuno", "salmon", "bufalo", "higado"]
    texts = [f"{a} {b} suave" for a, b in itertools.combinations(sorted(tastes), 2)] + [f"{t} suave" for t in tastes] + tastes
    texts += ["acnela suave", "canela limn suave", "int* canela", "canela intenso", "anana canela suav* zinc", "blimon suave", "canela light", "tilo lavadna suave", "avlanda suave tilo"]
    rows = [(n, 500, "g", 1, "1", str(n % 3 or ""), " ".join(sorted(v.split())), 1) for n, v in enumerate(texts * 3)]
    nodes = spark.createDataFrame(rows, "node long, qty long, unit string, pieces int, brand string, kind string, variant string, members long")
    nodes = nodes.unionByName(nodes.selectExpr("node + 10000 as node", "qty", "unit", "pieces", "'2' as brand", "kind", "variant", "members"))
    want = {(a[0], b[0]): alignment(a[6].split(), b[6].split()) * (1.0 if a[5] == b[5] else 0.9) for a, b in itertools.combinations(rows, 2) if a[5] == b[5] or not a[5] or not b[5]}
    want = {k: v for k, v in want.items() if v > 0}
    got = [((r.a, r.b), r.score) for r in shared_words(nodes).collect()]
    assert len(got) == len(dict(got)) and {k: v for k, v in got if k[0] < 10000} == pytest.approx(want)
    assert len(got) == 2 * len(want)


def test_clusters(spark):
    nodes = spark.createDataFrame([(n, m) for n, m in enumerate([5, 1, 1, 9, 1, 1])], "node long, members long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.5), (3, 4, 1.0)], "a long, b long, score double")
    got = {r.node: r.cluster for r in correlation_clusters(nodes, edges).collect()}
    # 0 and 3 outrank their neighbours; 2 joins 3; 5 stays alone.
    assert got == {0: 0, 1: 0, 2: 3, 3: 3, 4: 3, 5: 5}
    assert {r.node for r in correlation_clusters(nodes, edges.limit(0)).collect()} == set(range(6))
