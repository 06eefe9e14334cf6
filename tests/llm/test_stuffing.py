import math
import random

import pytest

from pricelattice.llm import stuffing
from pricelattice.llm.stuffing import Words, distances, flagged, grouped, learned_words, norm_lines, page_curves, references, stuffed_pages, stuffed_share

PROSE = "No encuentro la manera de cruzar dos planillas porque el proceso queda colgado. Cuando intento leer el archivo, los acentos salen rotos y la memoria se llena. "
STUFFED = [
    "gaseosa oferta, gaseosa precio, ketchup online, gaseosa 2025, comprar ketchup, ketchup barato",
    "#oferta #online #miel #barato #precio #mejor #comprar #outlet #miel #descuento",
    "cheap bizcochos bizcochos near me chupetines price wholesale chupetines chupetines cheap buy chupetines bizcochos best price chupetines",
    "\n".join(f"[precio Miel](http://a{n}.test/x-{n})" for n in range(9)),
    " ".join(f'<a href="https://b{n}.test/y?p={n}">Arroz Largo</a><br>' for n in range(9)),
    "Almacén > Infusiones > Almacén » Arroces > Frescos > Quesos > Bebidas > Aguas > Bazar > Velas",
    PROSE[:80] + "\n\n" + "Miel oferta • Miel precio • Miel online • " * 5,
]
FINE = [
    PROSE, "", "  ", "Gracias!", PROSE + "Fuente: http://a.test/x", PROSE + "Los productos: sal fina, arvejas, miel.",
    "```\nrow = ['merge', 'merge', 17, 'merge', 'merge', 93, 'merge', 'merge', 11, 'merge']\n```", "<pre><code>" + "foo bar baz; " * 40 + "</code></pre>",
    "\n".join(f"2025-01-01 10:00:0{n} WARN a.b: c={n}" for n in range(9)), "| a | b |\n|---|---|\n" + "| Miel | 3 |\n" * 12, "D4BAD876d51C28798e4cCeF53fbc4e" * 20,
    "\n".join(f"- Para ordenar por fecha sirve http://a{n}.test/x, donde muestran la lista de precios paso a paso." for n in range(9)),
    PROSE * 3 + "miel oferta, miel precio, miel online, miel barato, miel 2025",
]


# What test_words_are_learned shows to be learned from pages such as these.
KNOWN = Words(frozenset("no encuentro manera cruzar dos planillas porque el proceso queda colgado cuando intento leer archivo los acentos salen rotos memoria se llena donde sirve".split()), frozenset("de la y en para por a".split()))


@pytest.mark.parametrize("n", range(len(STUFFED)))
def test_stuffed(n):
    assert stuffed_share(STUFFED[n], KNOWN)[0] > 0.5


@pytest.mark.parametrize("n", range(len(FINE)))
def test_fine(n):
    assert stuffed_share(FINE[n], KNOWN)[0] <= 0.5


def test_curve_is_least_squares(spark):
    row = page_curves(spark.createDataFrame([(1, "a a a a b b c", 0)], "doc_id long, text string, part int"), ["es"], {"es": {"a": 0.25, "z": 0.5}}).first()
    xs, ys = [math.log(k) for k in (1, 2, 3)], [math.log(k) for k in (4, 2, 1)]
    mx, my = sum(xs) / 3, sum(ys) / 3
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    assert (row.tokens, row.types) == (7, 3) and row.slope == pytest.approx(slope)
    assert row.residual == pytest.approx(math.sqrt(sum((y - my - slope * (x - mx)) ** 2 for x, y in zip(xs, ys)) / 3))


def test_divergence_is_jensen_shannon(spark):
    rows = [(1, "aa b b cccc"), (2, "b b"), (3, "x"), (4, "```aa``` b"), (5, "... !"), (6, "b c c zz")]
    shares = {"en": {"b": 0.6, "c": 0.4}, "es": {"aa": 0.5, "b": 0.25, "zz": 0.25}}
    got = {r.doc_id: (r.divergence, r.language) for r in page_curves(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int"), ["en", "es"], shares).collect()}

    def jsd(p, q):
        mid = {w: (p.get(w, 0) + q.get(w, 0)) / 2 for w in p | q}
        return sum(x.get(w, 0) * math.log2(x[w] / m) for x in (p, q) for w, m in mid.items() if x.get(w)) / 2

    pages = {1: "aa b b cccc", 2: "b b", 3: "x", 4: "b", 6: "b c c zz"}
    assert set(got) == set(pages)
    for k, text in pages.items():
        words = text.split()
        page = {w: words.count(w) * len(w) / sum(map(len, words)) for w in words}
        want = min((jsd(page, shares[n]), n) for n in ("en", "es"))
        assert got[k][0] == pytest.approx(want[0]) and got[k][1] == want[1]


def corpus(spark, spam=30, copies=1, prose=240):
    """Prose of 12 to 90 words, and stuffed pages of 60 to 200 words, some led by a sentence."""
    said, things = "el la los de que se con en un por para pero no es como cuando porque ya lo".split(), [f"{a}{b}" for a in ("arch", "mem", "col", "fil", "cal", "proc", "tem", "gru", "lin", "dat") for b in ("ivo", "oria", "umna", "eso", "a", "ado", "ero", "ita")]

    def say(n):
        draw = random.Random(n)
        words = [draw.choice(said) if draw.random() < 0.5 else draw.choice(things) for _ in range(12 + n % 78)]
        return " ".join(w + ("." if i % 12 == 11 else "") for i, w in enumerate(words))

    rows = [(n, say(n) + f" caso{n} tema{n % 17}", "es", f"s{n % 9}") for n in range(prose)]
    goods, talk = ["miel", "sal fina", "arroz", "ketchup", "velas"], ["oferta", "precio", "online", "barato", "mejor", "2025"]
    heap = lambda n: ", ".join(f"{goods[(n + i) % 5]} {talk[(n * 3 + i * i) % 6]}" for i in range(30 + n % 70))
    rows += [(10_000 + n * 1000 + c, ("el proceso no anda porque se llena. " if n % 3 == 0 else "") + heap(n), "es", "spam") for n in range(spam) for c in range(copies)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("spam,copies", [(0, 1), (8, 1), (30, 1), (120, 1), (2, 100)])
def test_planted(spark, spam, copies):
    """Found whole and nothing else, with no stuffed page, few, a third of all rows, and copies in number."""
    frame = corpus(spark, spam, copies)
    assert sorted(r.doc_id for r in stuffed_pages(frame).collect()) == sorted(10_000 + n * 1000 + c for n in range(spam) for c in range(copies))


def test_few_pages_are_flagged_and_words_are_learned(spark):
    pages = corpus(spark, 12)
    languages, shares = references(grouped(pages))
    assert languages == ["es"] and sum(shares["es"].values()) <= 1 and len(shares["es"]) <= 1 / stuffing.LEAST_SHARE
    extreme = flagged(distances(page_curves(grouped(pages), languages, shares)))
    ids = {r.doc_id for r in extreme.collect()}
    assert {10_000 + n * 1000 for n in range(12)} <= ids and len(ids) < 0.1 * pages.count()
    known = learned_words(pages.join(extreme, "doc_id"), languages, shares)
    assert {"pero", "cuando", "que"} <= known.spoken and not {"oferta", "miel", "precio", "online"} & (known.spoken | known.joining)


def test_lines_resist_odd_lengths():
    """Longest pages that are all stuffed don't bend the line of the language."""
    rows = [{"language": "es", "part": 0, "bucket": b, "n": n, **{f"{m}_mid": v for m in stuffing.MEASURES}, **{f"{m}_low": v - 0.05 for m in stuffing.MEASURES}} for b, n, v in ((4, 300, 0.8), (5, 900, 0.75), (6, 900, 0.7), (7, 300, 0.65), (8, 60, 0.9), (9, 40, 0.92))]
    at, slope, far = norm_lines(rows)["es"]["divergence"]
    assert slope == pytest.approx(-0.05) and at == pytest.approx(1.0) and far == pytest.approx(0.05)
    assert norm_lines([]) == {}


def test_frame(spark):
    texts = [*STUFFED, *FINE, None, "x" * 200_000]
    rows = [(n, t, "q") for n, t in enumerate(texts)] + [(100 + n, PROSE + str(n), "q") for n in range(60)] + [(0, texts[0], "q"), (None, texts[0], "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    assert sorted(r.doc_id for r in stuffed_pages(frame).collect()) == list(range(len(STUFFED)))
    assert stuffed_pages(frame.limit(0)).count() == 0
