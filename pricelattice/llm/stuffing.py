"""Keyword-stuffed and link-list pages.

Method: each page's rank-frequency curve is fitted with SQL windows (slope and residual of log frequency over
log rank). The prose of each language is its reference: the share of the letters that each token takes, over all pages
of the language. A page's divergence is the Jensen-Shannon divergence of its own token shares from the nearest reference.
For slope, residual and divergence, robust lines over the log of the length give what is usual in a language at
that length, and how far it spreads; pages beyond EXTREME spreads are flagged.
What stands out is then measured on the flagged pages' whole texts: which stretches are strings of keywords, tags
and links, by words whose weight is learned: a word is one of sentences if prose has it clearly more than strongly
divergent pages have. No word list is given.

Scale: texts are shuffled once, on doc_id; token counts, windows, fits and divergences reuse that partitioning. A
reference has at most 1 / LEAST_SHARE tokens a language (shares add up to 1), norms have one row a language and power
of two of the length. Only flagged pages reach Python. Copies of a text count once, and each of GROUPS groups of sources has one vote on what is usual.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.session import checkpointed

TOKEN = r"https?://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|#?[\p{L}\p{N}][\p{L}\p{N}\p{M}'_-]*"
#: Code blocks, and lines of tables, shells and logs: no part of prose or of lists.
CODE = r"(?s)```.*?```|<(pre|code)\b.*?</\1>|(?m:^[ \t]*(?:\||[$>][ \t]+\w|\d{4}-\d\d-\d\d[t ]\d\d:\d\d)[^\n]*$)"
LEAST_SHARE = 5e-4  # of the letters of a language's pages, for a token of its reference
LEAST_PAGES, LEAST_PART = 20, 0.001  # pages that a language needs for a reference of its own, and their part of all
HEAVY = 0.001  # part of all pages from which a copied text's weight is reduced
GROUPS = 8  # of sources; each has one vote on what is usual
#: Spreads beyond which a page is extreme. A spread is the usual distance of a tenth from the median.
EXTREME = {"divergence": 3.0, "slope": 10.0, "residual": 12.0}
LEAST_SPREAD = {"divergence": 0.03, "slope": 0.05, "residual": 0.02}  # where few pages seem to agree
STRONG = 5.0  # spreads of divergence of the pages that prose is contrasted with
CONTRAST = 8.0  # times as much of prose as of those pages makes a word one of sentences
PRIOR = 10  # pages without the word that are added to those: few pages say little
SHORT, JOINING = 4, 0.002  # most letters, and least share, of the words that can join both sentences and names
LEAST_ITEMS = 8
BREAK = 5  # a sentence word outweighs so many items
SHARE = 0.5  # of the characters
MEASURES = tuple(EXTREME)
MAX_BROADCAST = 500_000  # flagged pages of 24 bytes each

_CODE_BLOCK = re.compile(r"```.*?(?:```|\Z)|<(pre|code)\b.*?(?:</\1>|\Z)", re.S | re.I)
_CODE_LINE = re.compile(
    r"^\s*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\||[$>]\s+\w+|(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|INSERT|UPDATE)\b|(?:def|class|for|while|if|return|import|const|let|var|function)\b.*[:;{}()=]|[\w.\[\]]+\s*=\s*[\[{('\"\w]|[})\]]+;?\s*$)"
    r"|=>|\w\([^)]*\);?\s*$|\w\(\w+\.\w+\)|\{\s*\w+[:,]|\s\|\s*(?:sort|uniq|grep|cut|awk|head)\b",
)
_PART = re.compile(
    r"(?P<link><a\b[^>]*href\s*=\s*[\"']?[^\"'>\s]+[^>]*>|(?:https?://|www\.)[^\s<>\"')\]]+)|(?P<mark></?[A-Za-z!][^<>]*>)|(?P<blob>[A-Za-z0-9+/=_-]{41,})"
    r"|(?P<tag>#[^\W_][\w'-]*)|(?P<word>[^\W_][\w'’-]*)|(?P<stop>\x00+|[,;:.!?¡¿•·|/»>\n\r()\[\]\"–—]|\s-\s)",
    re.I,
)
_LINK = re.compile(r"<a\b|https?://|www\.", re.I)
_OTHER_SCRIPT = re.compile(r"[^\W\d_a-zA-ZÀ-ɏ]")
PHRASE = 6  # content words from which an unbroken phrase is a sentence, unless it keeps repeating itself


class Words(NamedTuple):
    """What the corpus says of words: those of sentences, and short ones that join sentences and names alike."""

    spoken: frozenset[str]
    joining: frozenset[str]


def _phrase_score(words: list[str], known: Words) -> int:
    """Keywords in a phrase, negative for a piece of a sentence."""
    content = [w for w in words if w not in known.joining]
    spoken = sum(w in known.spoken for w in content)
    if any(_OTHER_SCRIPT.search(w) for w in words):
        return -len(words)
    if len(content) >= PHRASE and not (len(set(content)) < 0.6 * len(content) and spoken < 0.1 * len(content)):
        return -len(words)
    return len(content) - (BREAK + 1) * spoken


def _parts(text: str, known: Words) -> list[tuple[int, int, int]]:
    """(start, end, score) of the links, tags and phrases of a text, and of the barriers between them."""
    out: list[tuple[int, int, int]] = []
    words: list[str] = []
    begin = end = 0

    def close() -> None:
        if words:
            out.append((begin, end, _phrase_score(words, known)))
            words.clear()

    for m in _PART.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            if not words:
                begin = m.start()
            words.append(m[0].lower())
            end = m.end()
            continue
        if kind == "mark":
            continue
        close()
        if kind in ("link", "tag"):
            out.append((m.start(), m.end(), 1))
        elif kind == "blob" or m[0].startswith("\0"):
            out.append((m.start(), m.end(), -1_000))
    close()
    return out


def stuffed_share(text: str, known: Words) -> tuple[float, float]:
    """(share of the text's characters in strings of keywords, tags and links; greatest score of a string).

    Code blocks, logs, tables and blobs are barriers. A tag, a link and each word of a short phrase score one; a
    sentence word takes BREAK; an unbroken phrase of PHRASE or more content words is a sentence and scores
    negative, unless it says few words over and over. The strings are the maximal scoring stretches (Ruzzo and
    Tompa) of LEAST_ITEMS or more.
    """
    text = html.unescape(text).strip()
    if not text:
        return 0.0, 0
    blank = lambda m: "\0" * len(m[0])
    rest = _CODE_BLOCK.sub(blank, text)
    rest = "\n".join("\0" * len(line) if line.strip("\0 ") and not _LINK.search(line) and _CODE_LINE.search(line) else line for line in rest.split("\n"))
    stretches: list[list[int]] = []  # [first part, last part, sum before, sum with]
    total = 0
    parts = _parts(rest, known)
    for k, (_, _, score) in enumerate(parts):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [k, k, before, total]
        while True:
            j = next((j for j in range(len(stretches) - 1, -1, -1) if stretches[j][2] < new[2]), -1)
            if j < 0 or stretches[j][3] >= new[3]:
                stretches.append(new)
                break
            new = [stretches[j][0], new[1], stretches[j][2], new[3]]
            del stretches[j:]
    strings = [s for s in stretches if s[3] - s[2] >= LEAST_ITEMS]
    chars = sum(parts[b][1] - parts[a][0] for a, b, _, _ in strings)
    return chars / len(text), max((s[3] - s[2] for s in strings), default=0)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), CODE, " "), F.lit(TOKEN), F.lit(0))


def _letters(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t))


def grouped(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, text, lang, source) with a group of sources, one of GROUPS, and a weight: all copies of one text count as one page.

    Weights are lowered for texts that HEAVY of all pages or more share, of which at most 1 / HEAVY exist.
    """
    keyed = pages.withColumn("copy", F.xxhash64("text", F.length("text")))
    repeated = keyed.groupBy("copy").count().filter(F.col("count") >= max(2.0, HEAVY * pages.select("doc_id").count()))
    heavy = [F.lit(x) for r in repeated.collect() for x in (r["copy"], 1.0 / r["count"])]
    weight = F.coalesce(F.create_map(*heavy)[F.col("copy")], F.lit(1.0)) if heavy else F.lit(1.0)
    return keyed.withColumn("weight", weight).withColumn("part", source_group()).drop("copy")


def source_group() -> Column:
    """All pages of a source are in one group; those without a source are spread."""
    return F.pmod(F.coalesce(F.xxhash64("source"), F.xxhash64("doc_id")), F.lit(GROUPS))


def references(pages: DataFrame) -> tuple[list[str], dict[str, dict[str, float]]]:
    """The languages, and each language's share of the letters a token; of ``grouped`` pages.

    A share is the median over the groups of sources, so that no single source decides, however many pages it has. A
    language is the first two letters of ``lang``; small ones have no reference of their own, and if all are small
    there is one reference of all pages, named by the empty string.
    """
    language = F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("?"))
    named = pages.withColumn("language", language)
    sizes: dict[str, dict[int, float]] = {}
    pages_of: dict[str, int] = {}
    for r in named.groupBy("language", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect():
        sizes.setdefault(r.language, {})[r.part] = r.w
        pages_of[r.language] = pages_of.get(r.language, 0) + r.n
    chosen = sorted(k for k, n in pages_of.items() if k != "?" and n >= max(LEAST_PAGES, LEAST_PART * sum(pages_of.values())))
    if chosen:
        named = named.filter(F.col("language").isin(chosen))
    else:
        chosen, named = [""], named.withColumn("language", F.lit(""))
        sizes = {"": {p: sum(g.get(p, 0.0) for g in sizes.values()) for p in range(GROUPS) if any(p in g for g in sizes.values())}}
    total = F.create_map(*[F.lit(x) for k in chosen for p, w in sizes.get(k, {}).items() for x in (f"{k}|{p}", w)]) if any(sizes.get(k) for k in chosen) else F.create_map(F.lit(""), F.lit(1.0))
    parts = named.select("language", "part", "weight", _tokens(F.col("text")).alias("t")).withColumn("letters", _letters(F.col("t"))).filter("letters > 0")
    shares = parts.select("language", "part", (F.col("weight") / F.col("letters")).alias("w"), F.explode("t").alias("token")).groupBy("language", "part", "token").agg((F.sum("w") * F.length("token")).alias("share"))
    shares = shares.withColumn("share", F.col("share") / F.element_at(total, F.concat_ws("|", "language", "part")))
    # A group has at most 1 / LEAST_SHARE tokens beyond the least share, and half of the groups must have a token.
    mine = F.sort_array(F.collect_list("share"), asc=False)
    half = F.element_at(F.create_map(*[F.lit(x) for k in chosen for x in (k, len(sizes.get(k, {})) // 2 + 1)]), F.col("language"))
    found = shares.filter(F.col("share") >= LEAST_SHARE).groupBy("language", "token").agg(mine.alias("each")).filter(F.size("each") >= half).select("language", "token", F.element_at("each", half).alias("share"))
    out: dict[str, dict[str, float]] = {k: {} for k in chosen}
    for r in found.collect():
        out[r.language][r.token] = r.share
    # Medians may add up to a little more than 1.
    return chosen, {k: {t: q / max(1.0, sum(shares.values())) for t, q in shares.items()} for k, shares in out.items()}


def page_curves(pages: DataFrame, languages: list[str], reference: dict[str, dict[str, float]]) -> DataFrame:
    """(doc_id, part, letters, tokens, types, slope, residual, divergence, language) of each page with a token.

    slope and residual: least squares of ln frequency over ln rank (0 for a single type); divergence: Jensen-Shannon, in
    bits, of the page's token shares (by letters) from the nearest language's reference (ties: the first language).
    """
    spark = pages.sparkSession
    tokens = sorted({t for q in reference.values() for t in q})
    names = [f"q{k}" for k in range(len(languages))]
    table = spark.createDataFrame([(t, *[float(reference[k].get(t, 0.0)) for k in languages]) for t in tokens] or [("", *[0.0] * len(names))], ", ".join(["token string", *[f"{n} double" for n in names]]))
    parts = pages.select("doc_id", "part", _tokens(F.col("text")).alias("t")).withColumn("letters", _letters(F.col("t"))).filter("letters > 0")
    counts = parts.select("doc_id", "part", "letters", F.explode("t").alias("token")).groupBy("doc_id", "part", "letters", "token").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("y", F.ln("c")).withColumn("x", F.ln(F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), "token"))))
    met = ranked.join(F.broadcast(table), "token", "left").withColumn("p", F.col("c") * F.length("token") / F.col("letters"))

    def nearness(name: str) -> Column:
        """The token's part of 2 x (1 - divergence), negative."""
        p, q = F.col("p"), F.col(name)
        return F.sum(F.when(q > 0, p * F.log2(2 * p / (p + q)) - p + q * F.log2(2 * q / (p + q)) - q).otherwise(0.0)).alias(name)

    page = met.groupBy("doc_id").agg(
        F.max("part").alias("part"), F.max("letters").alias("letters"), F.sum("c").alias("tokens"), F.count("*").alias("types"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x"), F.lit(0.0)).alias("sse"), *map(nearness, names)
    )
    best = F.array_min(F.array(*[F.struct(F.col(n).alias("d"), F.lit(k).alias("language")) for n, k in zip(names, languages)]))
    return page.withColumn("best", best).select("doc_id", "part", "letters", "tokens", "types", "slope", F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.col("types")).alias("residual"), (1 + F.col("best.d") / 2).alias("divergence"), "best.language")


def _middle(values: np.ndarray, weights: np.ndarray) -> float:
    """Weighted median."""
    order = np.argsort(values)
    sums = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(sums, sums[-1] / 2)])


def norm_lines(rows: list) -> dict[str, dict[str, tuple[float, float, float]]]:
    """For each language and measure: intercept and slope over log2 letters of the usual value, and its spread.

    ``rows``: language, part, bucket, n and, for each measure m, m_mid and m_low (quantiles 0.5 and 0.1). All three are weighted medians:
    slopes between the buckets of a group, and what cells add to the line; each group of sources has the same
    weight. Neither a source nor lengths that only extreme pages have bend the line.
    """
    out: dict[str, dict[str, tuple[float, float, float]]] = {}
    for language, cells in itertools.groupby(sorted(rows, key=lambda r: (r["language"], r["part"], r["bucket"])), key=lambda r: r["language"]):
        cells = list(cells)
        part, at, n = (np.array([r[c] for r in cells], float) for c in ("part", "bucket", "n"))
        weight = n / np.array([n[part == p].sum() for p in part])
        pairs = [(i, j) for i in range(len(at)) for j in range(i + 1, len(at)) if part[i] == part[j]]
        out[language] = {}
        for m in MEASURES:
            mid, low = np.array([r[f"{m}_mid"] for r in cells]), np.array([r[f"{m}_low"] for r in cells])
            slope = _middle(np.array([(mid[j] - mid[i]) / (at[j] - at[i]) for i, j in pairs]), np.array([min(weight[i], weight[j]) * (at[j] - at[i]) for i, j in pairs])) if pairs else 0.0
            several = n > 1
            far = _middle((mid - low)[several], (weight * (n - 1) / n)[several]) if several.any() else 0.0
            out[language][m] = (_middle(mid - slope * at, weight), slope, max(far, LEAST_SPREAD[m]))
    return out


def distances(curves: DataFrame) -> DataFrame:
    """``curves`` with far_divergence, far_slope and far_residual: spreads from what is usual in the language at the length."""
    sized = curves.withColumn("bucket", F.floor(F.log2("letters")))
    at = lambda c, q: F.expr(f"percentile_approx({c}, {q}, 1000)")
    # Copies have equal curves; they count once.
    single = sized.dropDuplicates(["language", "part", "letters", "types", *MEASURES])
    lines = norm_lines(single.groupBy("language", "part", "bucket").agg(F.count("*").alias("n"), *[x for m in MEASURES for x in (at(m, 0.5).alias(f"{m}_mid"), at(m, 0.1).alias(f"{m}_low"))]).collect())

    def far(m: str) -> Column:
        of = [F.when(F.col("language") == k, (F.col(m) - (F.lit(v[m][0]) + F.lit(v[m][1]) * F.col("bucket"))) / F.lit(v[m][2])) for k, v in sorted(lines.items())]
        return F.coalesce(*of, F.lit(0.0))

    return sized.select("doc_id", "language", "tokens", *[far(m).alias(f"far_{m}") for m in MEASURES])


def flagged(far: DataFrame) -> DataFrame:
    """The rows of ``distances`` that are extreme: more divergent, or steeper, or off the line; pages of fewer than LEAST_ITEMS tokens can't be."""
    f = lambda m: F.col(f"far_{m}")
    return far.filter(F.col("tokens") >= LEAST_ITEMS).filter((f("divergence") > EXTREME["divergence"]) | (F.abs(f("slope")) > EXTREME["slope"]) | (F.abs(f("residual")) > EXTREME["residual"]))


def learned_words(strong: DataFrame, languages: list[str], reference: dict[str, dict[str, float]]) -> Words:
    """The words of each reference that prose has CONTRAST times as much as the ``strong`` pages (text, language), of its language or of all."""
    parts = strong.select("language", _tokens(F.col("text")).alias("t")).withColumn("letters", _letters(F.col("t"))).filter("letters > 0")
    sizes = {r.language: r.n for r in parts.groupBy("language").agg(F.count("*").alias("n")).collect()}
    spark = strong.sparkSession
    known = spark.createDataFrame([(t,) for t in sorted({t for k in languages for t in reference[k]})] or [("",)], "token string")
    shares = parts.select("language", (1 / F.col("letters")).alias("w"), F.explode("t").alias("token")).join(F.broadcast(known), "token", "left_semi").groupBy("language", "token").agg((F.sum("w") * F.length("token")).alias("share"))
    there = {(r.language, r.token): r.share for r in shares.collect()}  # no more than the references have
    every = sum(sizes.values())
    anywhere: dict[str, float] = {}
    for (_, token), share in there.items():
        anywhere[token] = anywhere.get(token, 0.0) + share
    spoken, joining = set(), set()
    for k in languages:
        for token, q in reference[k].items():
            # Names of goods cross languages: the strong pages of all of them say as much as the language's own.
            p = max(there.get((k, token), 0.0) / (sizes.get(k, 0) + PRIOR), anywhere.get(token, 0.0) / (every + PRIOR))
            if q >= CONTRAST * p:
                spoken.add(token)
            elif len(token) <= SHORT and q >= JOINING and q * CONTRAST >= p:
                joining.add(token)
    return Words(frozenset(spoken), frozenset(joining - spoken))


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of pages more than half of whose characters are strings of keywords, tags or links.

    ``documents`` needs doc_id and text; lang and source are used where they exist. Null, empty and blank texts are
    none; pages without doc_id are ignored; copies are judged alike; further columns are ignored; an empty table
    gives no rows.
    """
    there = [c if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    pages = documents.filter("doc_id is not null and text is not null").select("doc_id", "text", *there)
    languages, reference = references(grouped(pages))
    texts = pages.select("doc_id", "text", source_group().alias("part")).repartition("doc_id")
    # One narrow row a page; the norms and the flags both read it.
    far = checkpointed(page_curves(texts, languages, reference))
    extreme = flagged(distances(far)).select("doc_id", "language", "far_divergence")
    # Few flagged pages go to the texts, many meet them by a shuffle.
    extreme = F.broadcast(extreme) if extreme.count() <= MAX_BROADCAST else extreme
    candidates = checkpointed(pages.select("doc_id", "text").join(extreme, "doc_id"))
    words = documents.sparkSession.sparkContext.broadcast(learned_words(candidates.filter(F.col("far_divergence") > STRONG), languages, reference))

    def stuffed_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [i for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if stuffed_share(text, words.value)[0] > SHARE]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64())})

    return candidates.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stuffed_only, "doc_id long").distinct()
