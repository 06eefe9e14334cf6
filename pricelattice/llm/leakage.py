"""Evaluation texts leaking into training text.

Method: a BM25 inverted index of the test items' passages with block-max WAND. Every training passage (an
overlapping window of words of each document) is a query; all items above their threshold are retrieved, and
the whole document is verified against them: an in-order alignment of the item's passage, with question and
answer overlap beside it.

Scale: documents are read once and never shuffled; the index goes to the workers in shards of at most ``SHARD``
items, weighed alike in all, and every document meets every shard. WAND drops a window without touching postings when its words
cannot reach any item's threshold, which is the case of nearly all text.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelattice.session import checkpointed, spread

SHARD = 20_000
LEAST_WORDS = 15
WINDOW, STEP = 64, 32  # words of a training passage, and words from one to the next
PART = 0.3  # of the least BM25 mass of LEAST_WORDS consecutive item words: an interrupted half with edits keeps it
K1, B = 1.2, 0.5
BLOCK = 16  # items of a postings block
REACH = 2  # one single word replaced, dropped or put in between two matched ones
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def fold_words(text: str) -> list[str]:
    """Words without case, accents, punctuation and markup."""
    text = unicodedata.normalize("NFD", html.unescape(_TAG.sub(" ", text)).lower())
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c)))


def split_item(text: str) -> tuple[str, str, str]:
    """(passage, question, options) of an item: its last three lines, or its longest line alone."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) >= 3:
        return lines[-3], lines[-2], lines[-1]
    return max(lines, key=len, default=""), "", ""


class Corpus(NamedTuple):
    """Number and mean length of all passages, and the passages that have each word."""

    size: int
    mean: float
    frequency: dict[str, int]

    @classmethod
    def of(cls, passages: list[list[str]]) -> Corpus:
        return cls(len(passages), sum(map(len, passages)) / max(1, len(passages)) or 1.0, Counter(w for p in passages for w in set(p)))


class BlockMaxIndex:
    """BM25 postings of passages; weights are divided by each passage's threshold, so that 1 is to be reached."""

    def __init__(self, passages: list[list[str]], corpus: Corpus | None = None):
        """``corpus`` says what all passages have, where these are a part of them."""
        self.size = len(passages)
        every, mean, frequency = corpus or Corpus.of(passages)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, words in enumerate(passages):
            if len(words) < LEAST_WORDS:
                continue  # nothing of it can be a case
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {w: math.log(1 + (every - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in Counter(words).items()}
            spans = [sum(weight[w] for w in set(words[i : i + LEAST_WORDS])) for i in range(len(words) - LEAST_WORDS + 1)]
            threshold = PART * min(spans) or 1e-9
            for w, x in weight.items():
                postings[w].append((k, x / threshold))
        self.postings = dict(postings)
        self.top = {w: max(x for _, x in p) for w, p in postings.items()}
        self.blocks = {w: [(p[i : i + BLOCK][-1][0], max(x for _, x in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)] for w, p in postings.items()}

    def retrieve(self, words: set[str]) -> list[int]:
        """All passages whose score for the query reaches their threshold (block-max WAND, document at a time)."""
        top = self.top
        terms = [w for w in words if w in top]
        if sum(top[w] for w in terms) < 1:
            return []
        found = []
        at = dict.fromkeys(terms, 0)
        # Cursors ordered by the passage they stand at.
        queue = [(self.postings[w][0][0], w) for w in terms]
        heapq.heapify(queue)
        while queue:
            order = sorted(queue)
            bound, pivot = 0.0, -1
            for n, (_, w) in enumerate(order):
                bound += top[w]
                if bound >= 1:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = order[pivot][0]
            while pivot + 1 < len(order) and order[pivot + 1][0] == item:
                pivot += 1
            # The blocks that hold the pivot bound it more tightly; below 1 they are jumped as a whole.
            limit, tight = self.size, 0.0
            for _, w in order[: pivot + 1]:
                blocks = self.blocks[w]
                b = at[w] // BLOCK
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    tight += blocks[b][1]
                    limit = min(limit, blocks[b][0])
            target = item
            if tight < 1:
                target = limit + 1
                if pivot + 1 < len(order):
                    target = min(target, order[pivot + 1][0])
                target = max(target, item + 1)
            elif order[0][0] == item:
                score = 0.0
                for _, w in order[: pivot + 1]:
                    score += self.postings[w][at[w]][1]
                if score >= 1:
                    found.append(item)
                target = item + 1
            rest = order[pivot + 1 :]
            for here, w in order[: pivot + 1]:
                if here < target:
                    list_, k = self.postings[w], at[w]
                    while k < len(list_) and list_[k][0] < target:
                        k += 1
                    at[w] = k
                    if k == len(list_):
                        continue
                    here = list_[k][0]
                rest.append((here, w))
            queue = rest
        return found


def word_masks(passage: list[str]) -> dict[str, int]:
    """For each word of a passage the bits of its places."""
    masks: dict[str, int] = defaultdict(int)
    for i, w in enumerate(passage):
        masks[w] |= 1 << i
    return dict(masks)


def common_words(masks: dict[str, int], places: int, words: list[str]) -> int:
    """Length of the longest common subsequence of a passage and a text, all places at once in the bits of a number."""
    full = (1 << places) - 1
    row = full
    for w in words:
        if hit := row & masks.get(w, 0):
            row = ((row + hit) | (row - hit)) & full
    return places - row.bit_count()


def aligned_words(passage: list[str], words: list[str]) -> int:
    """Most words of the passage that the text repeats in order.

    Between two matched words at most one word may be replaced, dropped or put in; once the text may be
    interrupted by any number of words.
    """
    places: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(passage):
        places[w].append(i)
    n = len(passage)
    best = 0
    before: list[dict[int, tuple[int, int]]] = [{} for _ in range(REACH)]  # (straight, interrupted) ends by place, latest first
    ever = [0] * n  # straight chains that ended anywhere before
    for w in words:
        row: dict[int, tuple[int, int]] = {}
        for i in places.get(w, ()):
            straight, broken = 1, 0
            for past in before:
                for back in range(1, REACH + 1):
                    if end := past.get(i - back):
                        straight = max(straight, end[0] + 1)
                        if end[1]:
                            broken = max(broken, end[1] + 1)
            for back in range(1, REACH + 1):
                if i >= back and ever[i - back]:
                    broken = max(broken, ever[i - back] + 1)
            row[i] = (straight, broken)
            best = max(best, straight, broken)
        for i, (straight, _) in row.items():
            ever[i] = max(ever[i], straight)
        before = [row, *before[:-1]]
    return best


class LeakFinder:
    """Index and verification of one shard of items: (item_id, text, answer)."""

    def __init__(self, items: list[tuple[int, str, str | None]], corpus: Corpus | None = None):
        self.items = []
        for item_id, text, answer in items:
            passage, question, options = split_item(text)
            chosen = re.search(rf"\b{re.escape(answer)}\)\s*([^\s)]+(?:\s+(?!\w\))[^\s)]+)*)", options) if answer else None
            folded = fold_words(passage)
            self.items.append((item_id, folded, word_masks(folded), set(fold_words(question)), fold_words(chosen[1]) if chosen else []))
        self.index = BlockMaxIndex([item[1] for item in self.items], corpus)
        self.vocabulary = frozenset(self.index.top)

    def find(self, text: str) -> list[tuple[int, int, float, bool]]:
        """(item_id, matched words, share of the question's words, answer present) of each item the text exposes."""
        words = fold_words(text)
        if len(words) < LEAST_WORDS:
            return []
        candidates: set[int] = set()
        for k in range(0, max(1, len(words) - WINDOW + STEP), STEP):
            candidates.update(self.index.retrieve(self.vocabulary.intersection(words[k : k + WINDOW])))
        out, there = [], set(words)
        for k in sorted(candidates):
            item_id, passage, masks, question, answer = self.items[k]
            # An alignment is a common subsequence: where the longest is too short, there is none.
            if common_words(masks, len(passage), words) < LEAST_WORDS:
                continue
            matched = aligned_words(passage, words)
            if matched >= LEAST_WORDS:
                out.append((item_id, matched, len(question & there) / max(1, len(question)), bool(answer) and set(answer) <= there))
        return out


_FINDERS: dict[int, LeakFinder] = {}  # of the worker process, by shard
FOUND = "doc_id long, item_id long, matched int, question_share double, answer_present boolean"


def passage_words(items: DataFrame) -> DataFrame:
    """(item_id, n, word): each different word of each item's passage, and the passage's length."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"item_id": [], "n": [], "word": []}
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                folded = fold_words(split_item(text)[0])
                for word in set(folded) or {""}:
                    for column, value in zip(out.values(), (item_id, len(folded), word)):
                        column.append(value)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.string()))], names=list(out))

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(split, "item_id long, n int, word string")


def leaked_items(documents: DataFrame, items: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(doc_id, item_id, matched, question_share, answer_present)`` for each document and item it exposes.

    A document exposes an item if it repeats, in order, LEAST_WORDS or more words of the item's passage line
    (see ``aligned_words``). Null, empty and short texts expose none; items with null id or text, and passages
    shorter than that, can't leak; documents without doc_id are ignored; copies are cases of their own; rows
    repeated with the same doc_id give one row. Extra columns are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    valid = items.filter("item_id is not null and text is not null").select("item_id", "text", "answer").distinct()
    shards = max(1, -(-valid.count() // shard))
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    texts = spread(texts)

    # Words are weighed by all items, in whatever shard they are.
    size, mean, spoken, counts = 0, 1.0, None, None
    if shards > 1:
        spoken = checkpointed(passage_words(valid))
        size, total = spoken.groupBy("item_id").agg(F.max("n").alias("n")).agg(F.count("*"), F.sum("n")).first()
        mean = total / size or 1.0
        counts = checkpointed(spoken.groupBy("word").agg(F.countDistinct("item_id").alias("f")))

    def within(part: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.col("item_id").cast("long")), F.lit(shards)) == part
        rows = sorted((r.item_id, r.text, r.answer or "") for r in valid.filter(mine).collect())
        corpus = Corpus(size, mean, {r.word: r.f for r in counts.join(spoken.filter(mine).select("word").distinct(), "word").collect()}) if shards > 1 else None
        shared = spark.sparkContext.broadcast((rows, corpus))
        key = hash((tuple(rows), size))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _FINDERS.get(key)
            if finder is None:
                finder = _FINDERS[key] = LeakFinder(*shared.value)
            for batch in batches:
                out: dict[str, list] = {"doc_id": [], "item_id": [], "matched": [], "question_share": [], "answer_present": []}
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    for hit in finder.find(text):
                        for column, value in zip(out.values(), (doc_id, *hit)):
                            column.append(value)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()))], names=list(out))

        return texts.mapInArrow(search, FOUND)

    found = within(0)
    for part in range(1, shards):
        found = found.unionByName(within(part))
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("matched", "question_share", "answer_present")])
