"""Brand reports: groups of equal spelling, similar spellings, single-linkage clusters."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelattice.functions.keys import brand_core, sorted_words
from pricelattice.session import checkpointed


def token_sort_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b) of the texts with their words sorted; two empty texts are equal."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for n, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << n
    # Hyyrö's bit-parallel longest common subsequence: its length is the number of cleared bits.
    full = open_ = (1 << len(b)) - 1
    for x in a:
        u = open_ & at.get(x, 0)
        open_ = ((open_ + u) | (open_ - u)) & full
    return 200.0 * (len(b) - open_.bit_count()) / (len(a) + len(b))


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _pairwise(measure):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(measure(x, y)) for x, y in zip(a, b)], dtype="float64")

    return score


def similar_brands(brands: DataFrame, column: str = "brand", least: float = 82.0) -> DataFrame:
    """(a, b, score) of all pairs of distinct normalised brands that reach the ratio (above 0), a < b.

    No pair is lost: texts of m and n letters at the ratio share ``least * (m + n) / 200`` letters, counting repeats,
    so of each text's letters, rarest first, all but that many plus one must hold a common one. The equi-join is on
    that letter and both lengths; a pair comes out at its first common letter, and is scored if enough letters agree.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    names = brands.select(brand_core(F.col(column)).alias("n")).filter("n is not null").distinct()
    letters = F.split(sorted_words(F.col("n")), "")
    # The k-th of equal letters is a token of its own, which makes the bag of letters a set.
    tokens = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")))
    spelt = checkpointed(names.select("n", F.length("n").alias("own"), tokens.alias("tokens")))
    each = spelt.select("n", "own", F.explode("tokens").alias("token"))
    ordered = each.join(each.groupBy("token").agg(F.count("*").alias("f")), "token").groupBy("n", "own").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).getField("token").alias("tokens"))
    # One row a length that occurs; only lengths that can reach the ratio meet.
    shared = F.ceil(least * (F.col("own") + F.col("other")) / 200 - 1e-9).cast("int")
    met = ordered.join(F.broadcast(spelt.select(F.col("own").alias("other")).distinct()), shared <= F.least("own", "other")).withColumn("shared", shared)
    first = met.withColumn("first", F.slice("tokens", F.lit(1), F.greatest(F.col("own") - F.col("shared") + 1, F.lit(0)))).withColumn("token", F.explode("first"))
    a = first.select("token", F.col("own").alias("m"), F.col("other").alias("k"), F.col("n").alias("a"), F.col("first").alias("first_a"), F.col("tokens").alias("tokens_a"), "shared")
    b = first.select("token", F.col("other").alias("m"), F.col("own").alias("k"), F.col("n").alias("b"), F.col("first").alias("first_b"), F.col("tokens").alias("tokens_b"))
    pairs = a.join(b, ["token", "m", "k"]).filter("a < b").filter(F.array_intersect("first_a", "first_b")[0] == F.col("token")).filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("shared"))
    return pairs.withColumn("score", _pairwise(token_sort_ratio)("a", "b")).filter(F.col("score") >= least).select("a", "b", "score")


def linked_clusters(edges: DataFrame) -> DataFrame:
    """(node, cluster) by single linkage: the least name reachable, by label propagation with path jumping.

    Each round takes the least label of a node and its neighbours, then that label's own label; the rounds grow with
    the logarithm of the longest chain, and each cuts its lineage.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).toDF("node", "label"))
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near")).toDF("node", "near")
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jumped = stepped.join(labels.toDF("new", "far"), "new").select("node", "label", F.least("new", "far").alias("new"))
        done = checkpointed(jumped)
        labels = done.select("node", F.col("new").alias("label"))
        if done.filter("label != new").isEmpty():
            return labels.toDF("node", "cluster")


def brand_groups(products: DataFrame, least_suppliers: int = 2) -> DataFrame:
    """(brand_norm, suppliers, listings, shown) of normalised brands at enough suppliers; shown is the commonest spelling (ties: the least)."""
    counted = products.filter("brand is not null").groupBy(brand_core(F.col("brand")).alias("brand_norm"), "brand", "supplier").agg(F.count("*").alias("n")).filter("brand_norm is not null")
    spelt = counted.groupBy("brand_norm", "brand").agg(F.sum("n").alias("n"))
    shown = spelt.groupBy("brand_norm").agg(F.min(F.struct(-F.col("n"), "brand")).getField("brand").alias("shown"))
    groups = counted.groupBy("brand_norm").agg(F.countDistinct("supplier").alias("suppliers"), F.sum("n").alias("listings")).filter(F.col("suppliers") >= least_suppliers)
    return groups.join(shown, "brand_norm")


def led_groups(products: DataFrame, least: float = 0.82, block: int = 3) -> DataFrame:
    """(leader, members, suppliers) of similar normalised brands, greedily in alphabetical order within a block.

    The first free name of a block leads; later free names of at least that sequence ratio join it, unless both are
    known from one and the same supplier only. A group stands if two suppliers are in it; its members are then taken.
    A block holds the distinct brands that share their first letters.
    """
    known = products.select(brand_core(F.col("brand")).alias("name"), "supplier").filter("name is not null").groupBy("name").agg(F.array_sort(F.collect_set("supplier")).alias("suppliers"))

    def lead(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(zip(frame["name"], map(frozenset, frame["suppliers"])))
        free, out = dict(names), []
        for name, suppliers in names:
            if name not in free:
                continue
            members = [name] + [n for n, s in names if n > name and n in free and not (s == suppliers and len(s) == 1) and sequence_ratio(name, n) >= least]
            everyone = sorted(set().union(*(free[m] for m in members)))
            if len(members) > 1 and len(everyone) > 1:
                out.append((name, members, everyone))
                for m in members:
                    del free[m]
        return pd.DataFrame(out, columns=["leader", "members", "suppliers"])

    return known.groupBy(F.substring("name", 1, block).alias("block")).applyInPandas(lead, "leader string, members array<string>, suppliers array<string>")


def cluster_members(edges: DataFrame) -> DataFrame:
    """(cluster, members, size, best): single-linkage clusters with their sorted members and the greatest score of their pairs."""
    of = checkpointed(linked_clusters(edges))
    members = of.groupBy("cluster").agg(F.array_sort(F.collect_set("node")).alias("members"))
    best = edges.join(of, edges.a == F.col("node")).groupBy("cluster").agg(F.max("score").alias("best"))
    return members.join(best, "cluster").select("cluster", "members", F.size("members").alias("size"), "best")


def brand_report(products: DataFrame, least: float = 0.82) -> DataFrame:
    """(section, name, members, suppliers, listings): brands of one spelling at several suppliers (``same``), groups of similar ones (``similar``), the rest (``single``)."""
    counted = products.filter("brand is not null").groupBy(brand_core(F.col("brand")).alias("name")).agg(F.array_sort(F.collect_set("supplier")).alias("suppliers"), F.count("*").alias("listings")).filter("name is not null")
    one = F.array("name").alias("members")
    same = counted.filter(F.size("suppliers") >= 2).select(F.lit("same").alias("section"), "name", one, "suppliers", "listings")
    led = checkpointed(led_groups(products, least))
    inside = led.select("leader", F.explode("members").alias("name"))
    sums = inside.join(counted.select("name", "listings"), "name").groupBy("leader").agg(F.sum("listings").alias("listings"))
    similar = led.join(sums, "leader").select(F.lit("similar").alias("section"), F.col("leader").alias("name"), "members", "suppliers", "listings")
    single = counted.filter(F.size("suppliers") < 2).join(inside, "name", "left_anti").select(F.lit("single").alias("section"), "name", one, "suppliers", "listings")
    return same.unionByName(similar).unionByName(single)


def review_list(products: DataFrame, least: float = 82.0) -> DataFrame:
    """(a, b, score, listings_a, listings_b) of similar brands for review, the most similar and commonest first."""
    counted = products.filter("brand is not null").groupBy(brand_core(F.col("brand")).alias("name")).agg(F.count("*").alias("n"))
    pairs = similar_brands(products, least=least).filter("score < 100")
    met = pairs.join(counted.toDF("a", "listings_a"), "a").join(counted.toDF("b", "listings_b"), "b")
    return met.select("a", "b", "score", "listings_a", "listings_b").orderBy(F.desc("score"), F.desc(F.col("listings_a") + F.col("listings_b")), "a", "b")
