"""Quantities recorded in different units, notations and scales, brought to one base unit.

Method: texts and typed fields are only read as written, a number beside a notation. What a notation is worth is
learned: entities (one brand and variant) link the notations that state them; each link of a notation to its
entity's hub, the entity's commonest notation, gives a ratio; the mode of the log ratios of a pair of notations is its
robust scale, which is snapped to the known conversions and propagated from the base notations (g, ml, mm, u)
through the graph. Then every source, a seller's name, size or typed notation, is set against what several sellers
agree an entity is: a source whose modal ratio is another known conversion is rescaled, and one that fits no ratio gets
a scale and an offset by Theil-Sen slopes (medians over pairs of entities). The unit table only stands in for
notations with too few links; notations that it doesn't know, and bare numbers, get their meaning from the graph alone.

Scale: one shuffle for one row a listing, parsed in Arrow batches; everything after reads narrow rows and is
aggregated before it is shuffled. An entity gives a link a notation and a source, never pairs. Slopes come from
blocks of about eight entities, two of each.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelattice.functions.quantity import FACTORS, notation, read
from pricelattice.functions.text import word_key
from pricelattice.session import checkpointed, spread

#: The notation of each family that all others are scaled to.
BASES = {"g": "g", "ml": "ml", "mm": "mm", "u": "uni"}
#: Ratios between two units of one family; what an estimate can be snapped to.
CONVERSIONS = sorted({a / b for f, a in FACTORS.values() for g, b in FACTORS.values() if f == g})
SNAP = 0.02  # relative distance within which an estimate is taken for a known conversion
BIN = 0.02  # width of the bins of log ratios
LEAST_LINKS = 5  # entities that must agree on the scale of a pair of notations
LEAST_SHARE = 0.3  # of a pair's links; an entity may come in several sizes, so that many links don't agree
SOURCE_LINKS = 10  # entities that must agree before a source is rescaled
SOURCE_SHARE = 0.6
BLOCK = 8  # entities of a block that gives one slope
#: What a single typed value may be off by: kilo for gram and the reverse.
SLIPS = (1000.0, 0.001)
MAX_EDGES = 100_000  # pairs of notations collected; more raise an error
PLACES = ("name", "size", "typed")  # in the order of precedence
RAW = ["name", "size", "size_value", "size_unit", "brand", "variant"]
PARSED = T.StructType([T.StructField(f"{p}_{c}", t) for p in PLACES for c, t in (("x", T.DoubleType()), ("notation", T.StringType()), ("pieces", T.IntegerType()))])


@F.pandas_udf(PARSED)
def read_as_written(name: pd.Series, size: pd.Series, value: pd.Series, unit: pd.Series) -> pd.DataFrame:
    """What a row's name, size and typed value state, each as number, notation and pieces."""
    out = []
    for n, s, v, u in zip(name, size, value, unit):
        typed = (float(v), notation(u), 1) if v is not None and v == v and v > 0 else (None, None, None)
        out.append((*(read(n) or (None, None, None)), *(read(s) or (None, None, None)), *typed))
    frame = pd.DataFrame(out, columns=PARSED.names)
    return frame.astype({f"{p}_{c}": t for p in PLACES for c, t in (("x", "float64"), ("pieces", "Int32"))})


def snap(ratio: float) -> float | None:
    """The known conversion within SNAP of ``ratio``, or None."""
    best = min(CONVERSIONS, key=lambda c: abs(ratio / c - 1))
    return best if abs(ratio / best - 1) <= SNAP else None


def _snapped(ratio: Column) -> Column:
    near = F.array_min(F.transform(F.array(*map(F.lit, CONVERSIONS)), lambda c: F.struct(F.abs(ratio / c - 1).alias("off"), c.alias("c"))))
    return F.when(near["off"] <= SNAP, near["c"])


def propagate(edges: list[tuple[str, str, float, int]], bases: dict[str, str] = BASES) -> dict[str, tuple[str, float]]:
    """(family, scale to its base) of each notation that the bases reach, from (notation, other, scale of the other over the notation's, links).

    The graph grows from the bases along the best-supported edges (a maximum spanning forest), multiplying scales.
    """
    near: dict[str, list[tuple[int, str, str, float]]] = defaultdict(list)
    for a, b, ratio, n in edges:
        near[a].append((n, b, a, ratio))
        near[b].append((n, a, b, 1 / ratio))
    known = {base: (family, 1.0) for base, family in bases.items()}
    open_edges = [e for base in known for e in near[base]]
    while open_edges:
        best = max(open_edges, key=lambda e: (e[0], e[1], e[2]))
        open_edges.remove(best)
        _, there, here, factor = best
        if there not in known:
            known[there] = (known[here][0], known[here][1] * factor)
            open_edges += near[there]
    return known


def _modal(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, agree, links): the modal ratio of each group, the links within its bin, and all its links."""
    bins = links.groupBy(*keys, F.round(F.ln("ratio") / BIN).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.ln("ratio")).alias("mean"))
    top = F.max(F.struct("n", -F.abs("bin"), "mean"))
    return bins.groupBy(*keys).agg(top.alias("top"), F.sum("n").alias("links")).select(*keys, F.exp("top.mean").alias("ratio"), F.col("top.n").alias("agree"), "links")


def _small(frame: DataFrame) -> DataFrame:
    """A written frame for a join whose other side has few keys: broadcast up to MAX_EDGES rows."""
    return F.broadcast(frame) if frame.count() <= MAX_EDGES else frame


def notation_edges(readings: DataFrame) -> DataFrame:
    """(notation, hub, ratio, agree, links): what one of the hub is in the notation's numbers, over the entities that state both.

    An entity's hub is the commonest of its notations over all readings (ties: the greater text). An entity gives one
    link a notation, of the least and only if it doesn't contradict itself.
    """
    each = readings.filter("notation != ''").groupBy("entity", "notation").agg(F.min("x").alias("x"), F.max("x").alias("most"), F.count("*").alias("n"))
    common = checkpointed(each.groupBy("notation").agg(F.sum("n").alias("times")))
    each = each.join(_small(common), "notation").filter("most <= x * 1.02")
    hub = each.groupBy("entity").agg(F.max(F.struct("times", F.col("notation").alias("hub"), F.col("x").alias("hub_x"))).alias("h")).select("entity", "h.hub", "h.hub_x")
    return _modal(each.join(hub, "entity").filter("notation != hub").select("notation", "hub", (F.col("x") / F.col("hub_x")).alias("ratio")), ["notation", "hub"])


def notation_scales(readings: DataFrame, least: int = LEAST_LINKS) -> dict[str, tuple[str, float]]:
    """(family, scale) of every notation: of the graph where ``least`` entities agree, else of the unit table."""
    rows = notation_edges(readings).filter(f"agree >= {least} and agree >= {LEAST_SHARE} * links").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} pairs of notations to propagate scales over")
    learned = propagate([(r.notation, r.hub, s, r.agree) for r in rows if (s := snap(r.ratio))])
    return FACTORS | learned


def agreed_quantities(based: DataFrame) -> DataFrame:
    """(entity, family, agreed): the quantity that at least two sellers and half of all that name the entity agree on."""
    votes = based.filter("family is not null").select("entity", "family", F.round(F.ln("v") / BIN).alias("bin"), "supplier", "v").groupBy("entity", "family", "bin", "supplier").agg(F.avg("v").alias("v"))
    bins = votes.groupBy("entity", "family", "bin").agg(F.count("*").alias("votes"), F.expr("percentile_approx(v, 0.5, 1000)").alias("v"))
    top = bins.groupBy("entity").agg(F.max(F.struct("votes", "family", -F.col("bin"), "v")).alias("top"), F.sum("votes").alias("all"))
    return top.filter("top.votes >= 2 and 2 * top.votes >= all").select("entity", "top.family", F.col("top.v").alias("agreed"))


def source_corrections(based: DataFrame, agreed: DataFrame, least: int = SOURCE_LINKS) -> DataFrame:
    """(source, family, scale, shift) of the sources that stand off: a quantity is scale x number + shift.

    Numbers of known notations are in the base unit already, where scale 1 without shift is no correction; for
    numbers without a known notation it is one.
    """
    # One row a source and entity before they meet, however many listings an entity has.
    each = based.groupBy("source", "entity", "family").agg(F.min("v").alias("v"))
    links = each.join(agreed.withColumnRenamed("family", "of"), "entity").filter("family is null or family = of").select("source", "of", "entity", F.col("family").isNotNull().alias("known"), "agreed", "v")
    fit = checkpointed(_modal(links.withColumn("ratio", F.col("agreed") / F.col("v")), ["source", "of", "known"]).withColumn("scale", _snapped(F.col("ratio"))))  # one row a source
    fits = F.coalesce(F.col("scale").isNotNull() & (F.col("agree") >= SOURCE_SHARE * F.col("links")), F.lit(False))
    scaled = fit.filter(fits & (F.col("agree") >= least)).filter("not known or scale != 1").select("source", F.col("of").alias("family"), "scale", F.lit(0.0).alias("shift"))
    stray = fit.filter(~fits & (F.col("links") >= 2 * least)).select("source", "of", F.col("links").alias("n"))
    return scaled if stray.isEmpty() else scaled.unionByName(_shifted(links.join(stray, ["source", "of"]), least))


def _shifted(rest: DataFrame, least: int) -> DataFrame:
    """Scale and shift of the sources that no ratio fits, by slopes between the extremes of small blocks of entities; ``rest`` are their links."""
    block = F.pmod(F.xxhash64("entity"), F.greatest(F.lit(1), F.floor(F.col("n") / BLOCK)).cast("long"))
    ends = rest.groupBy("source", "of", block.alias("block")).agg(F.min(F.struct("v", "agreed")).alias("a"), F.max(F.struct("v", "agreed")).alias("b")).filter("b.v > 1.1 * a.v")
    slope = ends.groupBy("source", "of").agg(F.expr("percentile_approx((b.agreed - a.agreed) / (b.v - a.v), 0.5, 1000)").alias("slope"))
    slope = slope.filter("slope > 0").withColumn("scale", _snapped(F.col("slope"))).filter("scale is not null").select("source", "of", "scale")
    moved = rest.join(slope, ["source", "of"])
    shift = moved.groupBy("source", "of", "scale").agg(F.expr("percentile_approx(agreed - scale * v, 0.5, 1000)").alias("shift"))
    held = moved.join(shift, ["source", "of", "scale"]).groupBy("source", "of", "scale", "shift").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("scale") * F.col("v") + F.col("shift") - F.col("agreed")) <= SNAP * F.col("agreed")).alias("agree"))
    return held.filter(f"agree >= {least} and agree >= {SOURCE_SHARE} * n").select("source", F.col("of").alias("family"), "scale", "shift")


def slips_mended(typed: DataFrame, facts: DataFrame) -> DataFrame:
    """``typed`` (supplier, sku, entity, family, v, ...) with the v and pieces of the stated fact that a slip stands for.

    ``facts`` is (entity, family, v, pieces, votes). A value that equals a fact stays; one that is the fact times its pieces,
    or off by one of SLIPS, becomes the fact with the most votes.
    """
    asked = typed.filter("entity is not null").select("entity", "family", F.col("v").alias("own")).distinct()
    fits = lambda c: F.abs(F.col("own") / (F.col("v") * c) - 1) <= SNAP
    rank = F.when(fits(F.lit(1.0)), 0).when((F.col("pieces") > 1) & fits(F.col("pieces")), 1)
    for step, c in enumerate(SLIPS, 2):
        rank = rank.when(fits(F.lit(c)), step)
    best = F.min(F.struct("rank", -F.col("votes"), F.col("v").alias("fact"), F.col("pieces").alias("fact_pieces"))).alias("best")
    answer = asked.join(facts, ["entity", "family"]).withColumn("rank", rank).filter("rank is not null and v > 0").groupBy("entity", "family", "own").agg(best)
    mended = F.when(F.col("best.rank") > 0, F.col("best.fact")).otherwise(F.col("v"))
    met = typed.join(answer.withColumnRenamed("own", "v"), ["entity", "family", "v"], "left")
    return met.select(*[c for c in typed.columns if c not in ("v", "pieces")], mended.alias("v"), F.coalesce("best.fact_pieces", "pieces").alias("pieces"))


def listing_quantities(products: DataFrame, least: int = LEAST_LINKS, source_least: int = SOURCE_LINKS) -> DataFrame:
    """``(supplier, sku, qty, unit, pieces)``: whole base units of one piece, for each listing that states a quantity.

    unit is g, ml, mm or uni. Of several rows of a listing the latest updated_at counts (ties: the greater
    texts). Name goes before size, size before the typed value. Pieces is 1 unless a text states a pack of
    several weights, volumes or lengths. Rows without supplier or sku, and listings without any readable
    quantity or with zero, give no row; neither do numbers without a unit whose source no other source explains.
    Extra columns are ignored; empty tables give no rows. ``least`` and ``source_least`` are the entities that must
    agree on a notation's and a source's scale.
    """
    spark = products.sparkSession
    one = (
        products.filter("supplier is not null and sku is not null")
        .groupBy("supplier", "sku")
        .agg(F.max(F.struct("updated_at", *RAW)).alias("r"))
        .select("supplier", "sku", *[F.col(f"r.{c}").alias(c) for c in RAW])
    )
    entity = F.when(F.col("brand").isNotNull() & F.col("variant").isNotNull(), F.xxhash64(F.concat_ws("|", word_key(F.col("brand")), word_key(F.col("variant")))))
    # Texts are parsed once; links, scales and answers read the narrow result.
    parsed = checkpointed(
        spread(one).withColumn("p", read_as_written("name", "size", F.col("size_value").cast("double"), "size_unit")).select("supplier", "sku", entity.alias("entity"), "p.*")
    ).filter(" or ".join(f"{p}_x is not null" for p in PLACES))
    every = F.array(*[F.struct(F.lit(p).alias("place"), *[F.col(f"{p}_{c}").alias(c) for c in ("x", "notation", "pieces")]) for p in PLACES])
    single = parsed.filter("entity is not null and coalesce(name_pieces, 1) = 1 and coalesce(size_pieces, 1) = 1")
    readings = single.select("supplier", "entity", F.explode(F.filter(every, lambda r: r["x"].isNotNull())).alias("r")).select("supplier", "entity", "r.*")

    known = spark.createDataFrame([(k, f, float(s)) for k, (f, s) in sorted(notation_scales(readings, least).items())], "notation string, family string, unit_scale double")
    known = F.broadcast(known)  # at most MAX_EDGES notations
    source = F.concat_ws("|", "supplier", "place", "notation").alias("source")
    value = (F.col("x") * F.coalesce("unit_scale", F.lit(1.0))).alias("v")
    based = readings.join(known, "notation", "left").select("supplier", "entity", source, "family", value)
    agreed = checkpointed(agreed_quantities(based))  # one narrow row an entity
    corrections = checkpointed(source_corrections(based, agreed, source_least))  # one a source that stands off

    first = F.coalesce(*[F.when(F.col(f"{p}_x").isNotNull(), F.struct(F.lit(p).alias("place"), *[F.col(f"{p}_{c}").alias(c) for c in ("x", "notation", "pieces")])) for p in PLACES])
    stated = parsed.select("supplier", "sku", "entity", first.alias("r")).select("supplier", "sku", "entity", "r.*").join(known, "notation", "left")
    stated = stated.select("supplier", "sku", "entity", "place", source, "family", value, "pieces")
    # Numbers without a known notation are of the family of their entity.
    named = stated.filter("family is not null").withColumn("known", F.lit(True))
    odd = stated.filter("family is null").drop("family").join(agreed.select("entity", "family"), "entity").withColumn("known", F.lit(False))
    settled = named.unionByName(odd).join(_small(corrections), ["source", "family"], "left").filter("known or scale is not null")
    settled = settled.withColumn("v", F.coalesce("scale", F.lit(1.0)) * F.col("v") + F.coalesce("shift", F.lit(0.0))).select("supplier", "sku", "entity", "place", "family", "v", "pieces")
    texts = settled.filter("place != 'typed'")
    facts = texts.filter("entity is not null").groupBy("entity", "family", F.round("v").alias("v"), "pieces").agg(F.count("*").alias("votes"))
    typed = slips_mended(settled.filter("place = 'typed'"), facts)
    return texts.unionByName(typed).select("supplier", "sku", F.floor(F.col("v") + 0.5 + 1e-9).cast("long").alias("qty"), F.col("family").alias("unit"), "pieces").filter("qty > 0")
