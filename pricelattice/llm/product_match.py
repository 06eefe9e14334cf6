"""Listings of the same product: multi-pass sorted neighbourhood and equi-joins, soft token alignment, correlation clustering.

Each listing is read into a signature: quantity of a piece, unit, pieces, brand, type and the words of the
variant, each word brought to the corpus' own vocabulary where it is a slip or an unambiguous abbreviation of a clearly
commoner word.
Listings of equal signature are one node. Nodes are sorted by several token orders of the signature, neighbours
in a sliding window are compared by soft token alignment; equi-joins on the signature with a word left out find the
similar nodes that many others separate in every order. The graph of similar nodes is then clustered by the
pivot rule of correlation clustering: in rounds, the nodes that outrank all their open neighbours become
pivots, and their neighbours join them.

Scale: sorting is by range over the whole key, so a hot brand or quantity spreads over tasks; the rows at the
partitions' borders are compared in a second, small pass. Only distinct signatures are compared. Clustering
rounds run on the edges and cut their lineage by checkpoints. Pairs come out of one join on the cluster.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelattice.functions.quantity import spans
from pricelattice.functions.text import unaccent
from pricelattice.llm.ref_mapping import Mapper, Trie, build_mapper, osa, squeeze, words
from pricelattice.operators.units import listing_quantities
from pricelattice.session import checkpointed, spread

WINDOW = 12
MAX_REFS = 50_000  # entries whose trie each worker holds; more raise an error
COMMONER = 4  # so many times as frequent a word makes one an edit away its slip; for two edits, its square
# Words that introduce a variant without being part of it.
INTRODUCING = frozenset("sabor c con sin aroma fragancia x".split())
SIGNATURE = ["qty", "unit", "pieces", "brand", "kind", "variant"]
_NODE = "node long, qty long, unit string, pieces int, brand string, kind string, variant string, members long, k string"


def edit_reach(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def variant_words(counts: list[tuple[str, int, int]]) -> list[str]:
    """The genuine ones of (word, times, times with a full stop): not slips or abbreviations of a clearly commoner word.

    A word that mostly has a full stop is an abbreviation already of a longer word as frequent as itself. However
    rare a word is, it is genuine if no such word is near.
    """
    times = {w: n for w, n, _ in counts}
    cut = {w for w, n, stops in counts if 2 * stops > n}
    continued: dict[str, int] = {}  # the greatest frequency of a longer word by its beginning
    for w in times.keys() - cut:
        for end in range(3, len(w)):
            continued[w[:end]] = max(continued.get(w[:end], 0), times[w])
    genuine, known = [], Trie({})
    for w, n in sorted(times.items(), key=lambda x: (-x[1], x[0])):
        if continued.get(w, 0) >= n * (1 if w in cut else COMMONER):
            continue
        if (reach := edit_reach(w)) and any(times[v] >= COMMONER**edits * n for v, edits in known.within(w, reach).items()):
            continue
        known.add(w, {w})
        genuine.append(w)
    return sorted(genuine)


class Reader:
    """Turns a listing's texts into (brand, kind, variant)."""

    def __init__(self, mapper: Mapper | None, kinds: list[tuple[int, str]], vocabulary: list[str]):
        self.mapper = mapper
        # A word that spells, cuts off or misspells a kind's first word shares its first letter.
        self.kinds: dict[str, list[tuple[int, str, list[str]]]] = {}
        for n, (r, v) in enumerate(kinds):
            if parts := words(v):
                self.kinds.setdefault(parts[0][0], []).append((n, str(r), parts))
        self.brands = {} if mapper is None else {a: min(r) for a, r in mapper.tries["brand"].alias.items() if len(a) > 3}
        self.entry = {} if mapper is None else {v: str(min(r)) for f in ("brand", "product_type") for v in mapper.tries[f].exact if (r := mapper.tries[f].alias.get(squeeze(v)))}
        self.vocabulary = set(vocabulary)
        self.by_letter: dict[str, list[str]] = {}
        for w in sorted(vocabulary):
            self.by_letter.setdefault(w[0], []).append(w)
        self.near_words = Trie({w: {w} for w in vocabulary})
        self.known: dict[tuple[str, bool], str | None] = {}

    def _ref(self, field: str, value: str | None) -> str | None:
        if not value:
            return None
        if self.mapper is None:
            return squeeze(value) or None
        hit = self.mapper.map(field, value)
        if hit is None:
            return self.entry.get(value)
        return str(hit[0]) if hit[0] else None

    def word(self, word: str, cut: bool) -> str | None:
        """The vocabulary's word for a word; ``abc*`` for an abbreviation of several; None if it has none."""
        key = (word, cut)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._word(word, cut)
        return self.known[key]

    def _word(self, word: str, cut: bool) -> str | None:
        if word in self.vocabulary and not cut:
            return word
        if cut and len(word) >= 3:
            longer = [w for w in self.by_letter.get(word[0], ()) if w.startswith(word)]
            # An abbreviation is no word of its own, however often it is typed.
            longer = [w for w in longer if not any(v != w and v.startswith(w) for v in longer)] or longer
            if longer:
                return longer[0] if len(longer) == 1 else word + "*"
        if word in self.vocabulary:
            return word
        reach = edit_reach(word)
        if not reach:
            return None
        _, near = self.near_words.nearest(word, reach)
        return near[0] if len(near) == 1 else None

    def _variant(self, text: str, skip: set[int] = frozenset()) -> list[str]:
        out = []
        for n, m in enumerate(re.finditer(r"([^\W_]+)(\.?)", text)):
            if n in skip or m[1] in INTRODUCING or m[1].isdigit():
                continue
            if w := self.word(m[1], bool(m[2])):
                out.append(w)
        return out

    def _kind_at(self, name: list[str]) -> tuple[str, int, int] | None:
        """(kind, first word, words) that the words of a name spell, abbreviate or misspell; the closest fit."""
        best = None
        for i, first in enumerate(name):
            for n, kind, parts in self.kinds.get(first[0], ()):
                if i + len(parts) > len(name):
                    continue
                fit = 0.0
                for part, w in zip(parts, name[i:]):
                    if w == part:
                        fit += 1
                    elif len(w) >= 3 and part.startswith(w):
                        fit += 0.8 if len(w) < len(part) - 1 else 0.95
                    elif len(part) >= 4 and w[0] == part[0] and abs(len(w) - len(part)) <= 2 and osa(w, part) <= (1 if len(part) < 7 else 2):
                        fit += 0.7
                    else:
                        fit = 0.0
                        break
                # Of equal fits the kind that comes first, then the place.
                if fit and (best is None or (fit / len(parts), len(parts), -n, -i) > best[0]):
                    best = ((fit / len(parts), len(parts), -n, -i), kind, i, len(parts))
        return best[1:] if best else None

    def _brand_at(self, name: list[str], used: set[int], nearly: bool) -> tuple[str, int, int] | None:
        """(brand, first word, words) that a run of a name's words spells, or, failing that, ``nearly`` spells."""
        for size in (3, 2, 1):
            for i in range(len(name) - size + 1):
                if ref := self.brands.get("".join(name[i : i + size])):
                    return str(ref), i, size
        if self.mapper is None or not nearly:
            return None
        best = None
        for size in (2, 1, 3):
            for i in range(len(name) - size + 1):
                run = range(i, i + size)
                if used.intersection(run) or all(name[n] in self.vocabulary for n in run):
                    continue
                text = "".join(name[i : i + size])
                if len(text) < 5:
                    continue
                d, near = self.mapper.tries["brand"].trie.nearest(text, 1 if len(text) < 8 else 2)
                if near and (best is None or (d / len(text)) < best[0]):
                    best = (d / len(text), str(near[0]), i, size)
        return best[1:] if best else None

    def read(self, name: str | None, brand: str | None, kind: str | None, variant: str | None) -> tuple[str | None, str | None, str]:
        text = ""
        if name:
            _, stated, text = spans(name)
            for a, b in stated:
                text = text[:a] + " " * (b - a) + text[b:]
        name_words = [m[1] for m in re.finditer(r"([^\W_]+)(\.?)", text)]
        b, k = self._ref("brand", brand), self._ref("product_type", kind)
        used: set[int] = set()
        if k is None and (at_kind := self._kind_at(name_words)):
            k = at_kind[0]
            used.update(range(at_kind[1], at_kind[1] + at_kind[2]))
        tokens = self._variant(spans_free(variant)) if variant else []
        if b is None or not tokens:
            spelt = self._brand_at(name_words, used, nearly=b is None)
            if spelt:
                used.update(range(spelt[1], spelt[1] + spelt[2]))
                b = b or spelt[0]
        if not tokens:
            tokens = self._variant(text, used)
        return b, k, " ".join(sorted(set(tokens)))


def spans_free(text: str) -> str:
    """Folded text of a variant field."""
    return " ".join(re.findall(r"[^\W_]+\.?", spans(text)[2]))


def same_word(a: str, b: str) -> float:
    """1 for equal words, less for an abbreviation or a slip, 0 for different words."""
    if a == b:
        return 1.0
    if a.endswith("*") or b.endswith("*"):
        x, y = a.rstrip("*"), b.rstrip("*")
        return 0.9 if x.startswith(y) or y.startswith(x) else 0.0
    if min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 1 and osa(a, b) <= 1:
        return 0.8
    return 0.0


def alignment(a: list[str], b: list[str]) -> float:
    """Mean similarity of the best greedy alignment of the words of the shorter list; 0 if one has no partner.

    One word more on one side (it was illegible on the other) lowers the result; two are another variant.
    """
    a, b = sorted((a, b), key=len)
    if not a or len(b) > len(a) + 1:
        return 0.0
    rest, total = list(b), 0.0
    for w in sorted(a, key=lambda w: w.endswith("*")):
        score, at = max((same_word(w, v), -n) for n, v in enumerate(rest))
        if not score:
            return 0.0
        total += score
        rest.pop(-at)
    return total / len(a) * (0.6 if rest else 1.0)


def similarity(a: dict, b: dict) -> float:
    """Of two nodes; 0 unless quantity, unit, pieces and brand agree and the kinds don't differ."""
    if a["brand"] != b["brand"] or a["qty"] != b["qty"] or a["unit"] != b["unit"] or a["pieces"] != b["pieces"]:
        return 0.0
    if a["kind"] != b["kind"] and a["kind"] and b["kind"]:
        return 0.0
    return alignment(a["variant"].split(), b["variant"].split()) * (1.0 if a["kind"] == b["kind"] else 0.9)


def _slide(rows: Iterator[dict], window: int) -> Iterator[tuple[int, int, float]]:
    near: deque[dict] = deque(maxlen=window)
    for row in rows:
        for other in near:
            if other["node"] != row["node"] and (s := similarity(other, row)) > 0:
                yield min(other["node"], row["node"]), max(other["node"], row["node"]), s
        near.append(row)


def neighbourhood(nodes: DataFrame, key, window: int) -> DataFrame:
    """(a, b, score) of similar nodes at most ``window`` places apart in the order of ``key``."""
    out = _NODE + ", a long, b long, score double"
    names = [c.split()[0] for c in out.split(", ")]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[dict] = []
        last: deque[dict] = deque(maxlen=window)

        def watched() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    if len(first) < window:
                        first.append(row)
                    last.append(row)
                    yield row

        found: list[dict] = []
        for a, b, s in _slide(watched(), window):
            found.append({"a": a, "b": b, "score": s})
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
        # The border rows go out whole, for the pass over all borders.
        border = {r["node"]: r for r in [*first, *last]}
        yield pa.RecordBatch.from_pylist(found + list(border.values()), schema)

    schema = pa.schema([(n, pa.string() if n in ("unit", "brand", "kind", "variant", "k") else pa.float64() if n == "score" else pa.int32() if n == "pieces" else pa.int64()) for n in names])
    keyed = nodes.withColumn("k", key)
    ranged = keyed.repartitionByRange("k", "node").sortWithinPartitions("k", "node")
    seen = checkpointed(ranged.mapInArrow(slide, out))
    # At most 2 * window rows a partition of the sort.
    border = seen.filter("node is not null").select(*names[:-3]).coalesce(1).sortWithinPartitions("k", "node").mapInArrow(slide, out)
    return seen.unionByName(border).filter("a is not null").select("a", "b", "score")


def shared_words(nodes: DataFrame) -> DataFrame:
    """(a, b, score) of similar nodes by equi-joins, however many other nodes stand between them.

    Words are compared by their first three letters, which a word shares with its abbreviations and with slips
    further back. Nodes meet if these agree in all words, but for one word more of one node, and but for one word of
    each that share a spelling with a letter of the first four left out (a slip in front). Only pairs with two slips
    in front are left to the sorted passes.
    """
    words = F.split("variant", " ")
    base = F.xxhash64("qty", "unit", "pieces", "brand")
    short = lambda ws: F.array_join(F.array_sort(F.transform(ws, lambda w: F.substring(w, 1, 3))), " ")
    rest = lambda i: short(F.filter(words, lambda _, j: j != i))
    left_out = lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.concat(F.substring(w, 1, k - 1), F.substring(w, k + 1, 1_000_000))))
    slip = lambda w, left: F.when((F.length(w) >= 5) & ~F.endswith(w, F.lit("*")), F.transform(left_out(w), lambda v: F.concat_ws("|", F.lit("~"), v, left))).otherwise(F.array().cast("array<string>"))
    slips = F.flatten(F.transform(words, lambda w, i: slip(w, rest(i))))
    # The same with a further word left out.
    slips_less = F.flatten(F.flatten(F.transform(words, lambda w, i: F.transform(words, lambda _, n: F.when(i != n, slip(w, short(F.filter(words, lambda _, j: (j != i) & (j != n))))).otherwise(F.array().cast("array<string>"))))))
    keyed = nodes.withColumn("base", base)
    columns = ["node", *SIGNATURE]
    keys = lambda each: keyed.select(*columns, F.explode(F.array_distinct(each)).alias("key"), "base").withColumn("key", F.xxhash64("base", "key")).drop("base")
    whole = keys(F.concat(F.array(F.concat_ws("|", F.lit("="), short(words))), slips))
    less = keys(F.concat(F.transform(words, lambda _, i: F.concat_ws("|", F.lit("="), rest(i))), slips_less))
    left, right = [whole.select("key", *[F.col(c).alias(f"{c}_a") for c in columns])], [x.select("key", *[F.col(c).alias(f"{c}_b") for c in columns]) for x in (whole, less)]
    agree = " and ".join(f"{c}_a = {c}_b" for c in SIGNATURE[:4]) + " and (kind_a = kind_b or kind_a = '' or kind_b = '')"
    met = left[0].join(right[0], "key").filter("node_a < node_b").filter(agree).unionByName(left[0].join(right[1], "key").filter("node_a != node_b").filter(agree))
    pairs = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), "variant_a", "variant_b", (F.col("kind_a") == F.col("kind_b")).alias("same_kind")).dropDuplicates(["a", "b"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [alignment(x.split(), y.split()) * (1.0 if same else 0.9) for x, y, same in zip(*(batch.column(c).to_pylist() for c in ("variant_a", "variant_b", "same_kind")))]
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())], names=["a", "b", "score"])

    return pairs.mapInArrow(score, "a long, b long, score double").filter("score > 0")


def correlation_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cluster) by the pivot rule; a node without edges is its own cluster.

    In each round an open node that outranks all its open neighbours (more members, then the lesser id) is a
    pivot; an open neighbour of pivots joins the one it is most similar to. Some node is settled in every round.
    """
    rank = F.struct("members", -F.col("node"))
    ranks = nodes.select("node", rank.alias("rank"))
    both = edges.select("a", "b", "score").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    both = both.groupBy("a", "b").agg(F.max("score").alias("score"))
    both = both.join(ranks.toDF("a", "rank_a"), "a").join(ranks.toDF("b", "rank_b"), "b")
    open_edges = checkpointed(both)
    settled = None
    while True:
        pivots = open_edges.groupBy("a").agg(F.max("rank_b").alias("top"), F.first("rank_a").alias("own")).filter("own > top").select(F.col("a").alias("p"))
        joined = open_edges.join(pivots, open_edges.b == F.col("p"), "left_semi").groupBy("a").agg(F.max_by("b", F.struct("score", "rank_b")).alias("cluster")).select(F.col("a").alias("node"), "cluster")
        new = checkpointed(pivots.select(F.col("p").alias("node"), F.col("p").alias("cluster")).unionByName(joined))
        settled = new if settled is None else settled.unionByName(new)
        gone = new.select(F.col("node").alias("g"))
        open_edges = checkpointed(open_edges.join(gone, F.col("a") == F.col("g"), "left_anti").join(gone, F.col("b") == F.col("g"), "left_anti"))
        if open_edges.isEmpty():
            break
    return nodes.select("node").join(settled, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


_READERS: dict[int, Reader] = {}  # of the worker process, by broadcast


def signatures(products: DataFrame, refs: DataFrame) -> DataFrame:
    """(supplier, sku, product_id, brand, kind, variant): what each listing says it is, one row a listing."""
    spark = products.sparkSession
    texts = ["product_id", "name", "brand", "product_type", "variant"]
    one = products.filter("supplier is not null and sku is not null and product_id is not null").groupBy("supplier", "sku").agg(F.max(F.struct("updated_at", *texts)).alias("r")).select("supplier", "sku", *[F.col(f"r.{c}").alias(c) for c in texts])
    valid = refs.filter("ref_id is not null and field is not null and value is not null").select("ref_id", "field", "value")
    entries = sorted((r.ref_id, r.field, r.value) for r in valid.limit(MAX_REFS + 1).collect())
    if len(entries) > MAX_REFS:
        raise ValueError(f"more than {MAX_REFS} reference entries; match the listings of a part of the brands at a time")
    said = one.filter("variant is not null").select(F.explode(F.regexp_extract_all(F.lower(unaccent(F.col("variant"))), F.lit(r"[\p{L}\p{N}]+\.?"), F.lit(0))).alias("t"))
    said = said.select(F.rtrim(F.col("t"), F.lit(".")).alias("w"), F.endswith("t", F.lit(".")).cast("int").alias("stop")).filter(F.length("w") > 2)
    # One row a distinct word.
    counts = [(r.w, r.n, r.stops) for r in said.groupBy("w").agg(F.count("*").alias("n"), F.sum("stop").alias("stops")).collect()]
    vocabulary = variant_words([x for x in counts if not x[0].isdigit() and x[0] not in INTRODUCING])
    shared = spark.sparkContext.broadcast((entries, vocabulary))
    key = hash((tuple(entries), tuple(vocabulary)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _READERS.get(key)
        if reader is None:
            known, spoken = shared.value
            reader = _READERS[key] = Reader(build_mapper(known, []), [(r, v) for r, f, v in known if f == "product_type"], spoken)
        for batch in batches:
            out = [reader.read(*row) for row in zip(*(batch.column(c).to_pylist() for c in texts[1:]))]
            yield pa.record_batch(
                [batch.column("supplier"), batch.column("sku"), batch.column("product_id"), *(pa.array([r[n] for r in out], pa.string()) for n in range(3))],
                names=["supplier", "sku", "product_id", "brand", "kind", "variant"],
            )

    return spread(one).mapInArrow(read, "supplier string, sku string, product_id string, brand string, kind string, variant string")


def matched_listings(products: DataFrame, refs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(product_id, cluster)`` of every listing with a stated quantity, a brand and variant words.

    Further listings are in no group. Of several rows of a listing the latest counts. Listings without supplier,
    sku or product_id are ignored; extra columns are ignored; empty tables give no rows.
    """
    read = signatures(products, refs)
    sized = listing_quantities(products)
    full = checkpointed(read.join(sized, ["supplier", "sku"]).filter("brand is not null and variant != ''").select("product_id", *SIGNATURE[:3], "brand", F.coalesce("kind", F.lit("")).alias("kind"), "variant"))
    nodes = checkpointed(full.groupBy(*SIGNATURE).agg(F.count("*").alias("members"), F.min(F.xxhash64("product_id")).alias("node")))
    base = [F.col(c).cast("string") for c in ("qty", "unit", "pieces", "brand")]
    short = F.transform(F.split("variant", " "), lambda w: F.substring(w, 1, 3))
    orders = [
        F.concat_ws("|", *base, "kind", F.array_join(F.array_sort(short), " ")),
        F.concat_ws("|", *base, F.array_join(F.array_sort(short), " "), "kind"),
        F.concat_ws("|", *base, F.array_join(F.reverse(F.array_sort(short)), " "), "kind"),
    ]
    edges = shared_words(nodes)
    for key in orders:
        edges = edges.unionByName(neighbourhood(nodes.select("node", *SIGNATURE, "members"), key, window))
    clusters = correlation_clusters(nodes, edges)
    return full.join(nodes.select("node", *SIGNATURE), SIGNATURE).join(clusters, "node").select("product_id", "cluster")


def matched_pairs(products: DataFrame, refs: DataFrame) -> DataFrame:
    """``(product_id_a, product_id_b)``, a < b, of listings of one product; see ``matched_listings``."""
    group = checkpointed(matched_listings(products, refs))
    a, b = group.toDF("product_id_a", "cluster"), group.toDF("product_id_b", "cluster")
    return a.join(b, "cluster").filter("product_id_a < product_id_b").select("product_id_a", "product_id_b").distinct()
