import random
from collections import Counter

import pytest

from pricelattice.llm.leakage import BlockMaxIndex, LeakFinder, aligned_words, common_words, fold_words, leaked_items, split_item, word_masks

PASSAGE = "La sastra subió 414 tambores grises junto al aserradero aunque frente al teatro la escultora midió velas ilegibles después del eclipse con mucha paciencia"
ITEM = f"Lea con atención el pasaje.\n{PASSAGE}\n¿Cuántos botones lavó el guardabosque?\nA) 451 B) 566"
WORDS = PASSAGE.split()


def slow_alignment(p, w):
    """All chains by plain recursion over (place, text place, interrupted)."""
    from functools import lru_cache

    @lru_cache(None)
    def ends(i, j, broken):
        if p[i] != w[j]:
            return -99
        best = 1 if not broken else -99
        for a in range(1, 3):
            for b in range(1, 3):
                if i >= a and j >= b:
                    best = max(best, 1 + ends(i - a, j - b, broken))
            if broken and i >= a:
                best = max([best, *(1 + ends(i - a, k, False) for k in range(j))])
        return best

    return max([0, *(ends(i, j, b) for i in range(len(p)) for j in range(len(w)) for b in (False, True))])


def test_alignment_against_brute_force():
    r = random.Random(2)
    for _ in range(150):
        p, w = [[r.choice("abcdef") for _ in range(r.randint(1, 8))] for _ in range(2)]
        assert aligned_words(p, w) == slow_alignment(tuple(p), tuple(w)), (p, w)
        row = [0] * (len(w) + 1)
        for x in p:
            left = 0
            for j, y in enumerate(w, 1):
                left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
        assert common_words(word_masks(p), len(p), w) == row[-1] >= aligned_words(p, w)


def test_wand_against_exhaustive():
    r = random.Random(3)
    vocabulary = [f"w{n}" for n in range(60)]
    index = BlockMaxIndex([[r.choice(vocabulary) for _ in range(r.randint(15, 30))] for _ in range(150)])
    for _ in range(200):
        query = set(r.sample(vocabulary, r.randint(1, 20)))
        score = Counter()
        for w in query:
            for k, x in index.postings.get(w, ()):
                score[k] += x
        assert index.retrieve(query) == sorted(k for k, x in score.items() if x >= 1)


LEAKS = [
    (PASSAGE, True), (PASSAGE.upper().replace("Ó", "O"), True), ("> " + PASSAGE.replace(" ", "\n> ", 5), True), (f"<p>{PASSAGE.replace(' ', '&nbsp;')}</p>", True),
    (" ".join(WORDS[:16]), True), (" ".join(WORDS[:12]), False), (" ".join(WORDS[:9]) + " otra cosa distinta en el medio del todo " + " ".join(WORDS[9:18]), True),
    (" ".join("cosa" if n % 6 == 5 else w for n, w in enumerate(WORDS)), True), (" ".join(w for n, w in enumerate(WORDS) if n % 7), True), (" ".join(reversed(WORDS)), False),
    ("Lea con atención el pasaje. " * 5, False), ("palabra " * 500 + PASSAGE + " palabra" * 500, True), ("", False),
]


@pytest.mark.parametrize("n", range(len(LEAKS)))
def test_leak(n):
    text, leaks = LEAKS[n]
    assert bool(LeakFinder([(7, ITEM, "A")]).find(text)) == leaks


def test_parts():
    assert split_item(ITEM)[0] == PASSAGE and split_item("nur eine") == ("nur eine", "", "")
    assert fold_words("Él—<b>ÑO</b> 3_4") == ["el", "no", "3", "4"]
    assert LeakFinder([(7, ITEM, "A")]).find(PASSAGE + " lavó el guardabosque 451")[0][2:] == (3 / 5, True)


@pytest.mark.parametrize("shard", [20_000, 1])
def test_frame(spark, shard):
    docs = [(1, PASSAGE, 5), (1, PASSAGE, 5), (2, PASSAGE, 5), (3, None, 5), (4, "", 5), (None, PASSAGE, 5), (5, "x" * 100_000, 5)]
    items = [(7, ITEM, "A"), (8, ITEM.replace("sastra", "herrera"), None), (9, None, "A"), (None, ITEM, "A"), (10, "", "A"), (11, "corto\npasaje\nx", "A")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string, answer string")
    got = sorted((r.doc_id, r.item_id) for r in leaked_items(d, i, shard).collect())
    assert got == [(1, 7), (1, 8), (2, 7), (2, 8)]
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


def test_only_markup_is_dropped():
    from pricelattice.llm.leakage import fold_words

    assert fold_words("uno < dos y tres > cuatro") == ["uno", "dos", "y", "tres", "cuatro"]
    assert fold_words('uno <a href="' + "x" * 2000 + '">dos</a> tres') == ["uno", "dos", "tres"]


def test_shards_weigh_words_alike(spark):
    """An item's threshold and postings are the same in a shard as among all items."""
    import pyspark.sql.functions as F

    from pricelattice.llm.leakage import BlockMaxIndex, Corpus, fold_words, leaked_items, passage_words, split_item

    r = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    texts = [(n, "\n".join([" ".join(r.choices(words, k=30)), "pregunta uno", "A) x B) y"]), "A") for n in range(40)]
    items = spark.createDataFrame(texts, "item_id long, text string, answer string")
    passages = [fold_words(split_item(t)[0]) for _, t, _ in texts]
    whole = BlockMaxIndex(passages)
    part = BlockMaxIndex(passages[:10], Corpus.of(passages))
    for word, postings in part.postings.items():
        assert postings == [p for p in whole.postings[word] if p[0] < 10]
    got = {x.word: x.f for x in passage_words(items).groupBy("word").agg(F.countDistinct("item_id").alias("f")).collect()}
    assert got == dict(Corpus.of(passages).frequency)
    documents = spark.createDataFrame([(n, "antes " + " ".join(p[3:25]) + " luego") for n, p in enumerate(passages)] + [(99, "nada")], "doc_id long, text string")
    key = lambda frame: sorted(map(tuple, frame.collect()))
    assert key(leaked_items(documents, items, 7)) == key(leaked_items(documents, items)) and {(n, n) for n in range(40)} <= {(x.doc_id, x.item_id) for x in leaked_items(documents, items, 7).collect()}
