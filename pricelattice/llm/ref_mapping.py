"""Mapping freely entered values to the entries of a reference list.

Method: a trie of the reference entries and their alias paths (other word orders, plural and singular forms,
the last element of a path, codes of a code list), searched with a Levenshtein automaton. The search returns
all entries within a distance that depends on the value's length; the nearest is the mapping, and a value
without any is unmatched. A cut-off value follows its exact path and is completed if one entry alone lies below.

Scale: values are mapped where they are read, in Arrow batches with a cache a worker, so a hot value costs one
search a worker and no join; the only shuffle makes one row a listing. Beyond ``SHARD`` entries the aliases are cut into
shards by hash; each distinct value is searched in every shard, and the evidence of all shards is decided together.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from itertools import permutations
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelattice.session import checkpointed, spread

FIELDS = ("brand", "product_type", "category")
SHARD = 50_000
MAX_CODES = 50_000
CACHE = 200_000
_SUFFIX = re.compile(r"(?:[\s,\-–]+(?:s\.?\s?a\.?(?:\s?i\.?\s?c\.?)?|s\.?\s?r\.?\s?l\.?|ltda\.?|argentina|linea hogar)|\s*\((?:r|tm)\)|\s*[®™])+\s*$")
# What sellers type where they have nothing to say.
PLACEHOLDERS = frozenset("varios otros generico sinmarca sinclasificar nada ninguno ninguna noinforma nodefinido adefinir pendiente pendientedecarga sd na xx xxx null none desconocido".split())
_CODE = re.compile(r"\s*(\d+)(?:[_\-](\d+))?\s*")
_LOOKALIKE = str.maketrans("01345", "oieas")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def squeeze(text: str) -> str:
    return "".join(words(text))


def reach(length: int) -> int:
    """Edits (a swap of neighbours is one) that a value of this many letters may be off by."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 12 else 3


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance: insertions, deletions, replacements, swaps of neighbours."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
    return row[-1]


def _numbers(word: str) -> set[str]:
    """Singular and plural forms of a word."""
    forms = {word, word + "s", word + "es"}
    if word.endswith("s"):
        forms |= {word[:-1]}
    if word.endswith("es"):
        forms |= {word[:-2]}
    if word.endswith("z"):
        forms |= {word[:-1] + "ces"}
    return forms


def aliases(value: str, path: bool) -> set[str]:
    """Squeezed spellings that mean ``value``; ``path``: its last element does too."""
    out = set()
    for text in [value, value.rpartition(">")[2]] if path else [value]:
        parts = words(text)
        if not parts:
            continue
        out.add("".join(parts))
        for form in _numbers(parts[0]):
            out.add("".join([form, *parts[1:]]))
        if len(parts) > 1:
            out.add("".join(parts[:-1] + [parts[-1] + "s"]))
            if not path:
                orders = permutations(parts) if len(parts) <= 3 else (parts[k:] + parts[:k] for k in range(len(parts)))
                out.update("".join(p) for p in orders)
    return out


class Automaton:
    """Levenshtein automaton of one word, a swap of neighbours counting one.

    States are sparse rows of (position, edits, whether a swap is half done), numbered as they are met; 0 is dead.
    ``moves[state][letter]`` is filled on demand; all letters that the word lacks share one move.
    """

    def __init__(self, word: str, edits: int):
        self.word, self.edits, self.letters = word, edits, frozenset(word)
        start = tuple((i, i, 0) for i in range(min(edits, len(word)) + 1))
        self.rows: list[tuple] = [(), start]
        self.number = {(): 0, start: 1}
        self.moves: list[dict[str, int]] = [{}, {}]
        self.ends: list[int] = [-1, self._end(start)]

    def _end(self, row: tuple) -> int:
        """Edits with which the row accepts, or -1."""
        return min((e for i, e, half in row if i == len(self.word) and not half), default=-1)

    def step(self, state: int, letter: str) -> int:
        moves = self.moves[state]
        kind = letter if letter in self.letters else ""
        if kind in moves:
            moves[letter] = moves[kind]
            return moves[kind]
        word, edits, row = self.word, self.edits, {}
        for i, e, half in self.rows[state]:
            if half:
                if word[i] == letter and row.get((i + 2, 0), edits + 1) > e:
                    row[i + 2, 0] = e
                continue
            if e < edits:
                if row.get((i, 0), edits + 1) > e + 1:
                    row[i, 0] = e + 1
                if i + 1 < len(word) and word[i + 1] == letter and row.get((i, 1), edits + 1) > e + 1:
                    row[i, 1] = e + 1
            if i < len(word):
                cost = e + (word[i] != letter)
                if cost <= edits and row.get((i + 1, 0), edits + 1) > cost:
                    row[i + 1, 0] = cost
        for i, half in sorted(row):
            if not half:
                cost = row[i, 0] + 1
                while i < len(word) and cost <= edits and row.get((i + 1, 0), edits + 1) > cost:
                    i += 1
                    row[i, 0] = cost
                    cost += 1
        found = tuple(sorted((i, e, half) for (i, half), e in row.items()))
        number = self.number.get(found)
        if number is None:
            number = self.number[found] = len(self.rows)
            self.rows.append(found)
            self.moves.append({})
            self.ends.append(self._end(found))
        moves[kind] = moves[letter] = number
        return number


class Trie:
    """Words with a set of values each; searched exactly, by prefix, and with a Levenshtein automaton."""

    def __init__(self, words: dict[str, set]):
        self.root: dict = {}
        for word, values in words.items():
            self.add(word, values)

    def add(self, word: str, values: set) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = values

    def within(self, word: str, edits: int) -> dict:
        """Every value with a word within ``edits``, and the distance of its nearest one."""
        automaton = Automaton(word, edits)
        moves, ends, step = automaton.moves, automaton.ends, automaton.step
        found: dict = {}
        stack = [(self.root, 1)]
        while stack:
            node, state = stack.pop()
            known = moves[state]
            for letter, child in node.items():
                if letter == "":
                    if (d := ends[state]) >= 0:
                        for value in child:
                            if found.get(value, edits + 1) > d:
                                found[value] = d
                    continue
                nxt = known.get(letter)
                if nxt is None:
                    nxt = step(state, letter)
                if nxt:
                    stack.append((child, nxt))
        return found

    def nearest(self, word: str, edits: int) -> tuple[int, list]:
        """(distance, values) of the nearest words within ``edits``, the cheap searches first; (99, []) without any."""
        for e in range(1, edits + 1):
            if found := self.within(word, e):
                least = min(found.values())
                return least, sorted(v for v, d in found.items() if d == least)
        return 99, []


class Evidence(NamedTuple):
    """What a trie says of one form of a value."""

    form: int
    letters: int
    exact: int | None  # the least entry that the form spells
    d: int  # distance of the nearest entries
    near: int | None  # the least of them
    low: int | None  # the least and the greatest entry that continue the form
    high: int | None


def decide(forms: Iterable[Evidence]) -> tuple[int, int]:
    """(ref_id, distance) of the entry meant by the evidence on a value's forms in their order; (0, 99) if none is."""
    best = (0, 99)
    for e in forms:
        if e.exact is not None:
            return e.exact, 0
        if e.near is not None and e.d < best[1]:
            best = (e.near, e.d)
        if best[1] > 1 and e.letters >= 4 and e.low is not None and e.low == e.high:
            best = (e.low, 1)
    return best


def spellings(entries: Iterable[tuple[int, str]], path: bool) -> dict[str, set[int]]:
    """The entries of each alias; the full spelling of one entry is not an alias of another."""
    out: dict[str, set[int]] = {}
    full: dict[str, set[int]] = {}
    for ref, value in entries:
        for a in aliases(value, path):
            out.setdefault(a, set()).add(ref)
        if s := squeeze(value):
            full.setdefault(s, set()).add(ref)
    return out | full


class ReferenceTrie:
    """The aliases of one field (or of a shard of it), its entries' texts, and the entries that codes mean."""

    def __init__(self, alias: dict[str, set[int]], exact: Iterable[str], path: bool = False, codes: dict[str, int] | None = None):
        self.alias, self.exact, self.codes, self.is_path = alias, set(exact), codes or {}, path
        self.trie = Trie(alias)

    def within(self, word: str, edits: int) -> dict[int, int]:
        """All entries within ``edits`` (swaps count one) of ``word``, with the distance of their nearest alias."""
        return self.trie.within(word, edits)

    def below(self, word: str) -> set[int]:
        """Entries whose spelling goes on after ``word`` by no more than a third of it plus three letters; at most two are looked for."""
        node = self.trie.root
        for c in word:
            node = node.get(c)
            if node is None:
                return set()
        refs: set[int] = set()
        stack = [(node, 0)]
        while stack and len(refs) < 2:
            node, deep = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    refs |= child
                elif deep < 3 + len(word) // 3:
                    stack.append((child, deep + 1))
        return refs

    def forms(self, value: str) -> list[str]:
        """Spellings of a value to look up: without suffixes, with look-alike digits as letters, and whole."""
        text = _SUFFIX.sub("", fold(value))
        if self.is_path:
            text = re.sub(r"[\-_ ]\d+\s*$", "", text)
        forms = dict.fromkeys((squeeze(text), squeeze(text.translate(_LOOKALIKE)), squeeze(value)))
        return [f for f in forms if f and not f.isdigit() and f not in PLACEHOLDERS]

    def evidence(self, value: str) -> list[Evidence]:
        """Of each form of a value, up to one that an alias spells."""
        if self.codes and (m := _CODE.fullmatch(value)):
            ref = self.codes.get("_".join(x for x in m.groups() if x))
            return [Evidence(0, 0, ref, 99, None, None, None)] if ref else []
        out = []
        for n, form in enumerate(self.forms(value)):
            if refs := self.alias.get(form):
                out.append(Evidence(n, len(form), min(refs), 99, None, None, None))
                break
            d, near = self.trie.nearest(form, reach(len(form)))
            below = self.below(form) if d > 1 and len(form) >= 4 else ()
            out.append(Evidence(n, len(form), None, d, near[0] if near else None, min(below, default=None), max(below, default=None)))
        return out

    def find(self, value: str) -> tuple[int, int]:
        """(ref_id, distance) of the entry meant, (0, 99) if none; ties go to the least ref_id."""
        return decide(self.evidence(value))

    def reached(self, value: str) -> dict[int, int]:
        """All entries within reach of a form of the value, with their least distance."""
        out: dict[int, int] = {}
        for form in self.forms(value):
            for ref, d in self.within(form, reach(len(form))).items():
                out[ref] = min(d, out.get(ref, d))
        return out


class Mapper:
    """All fields' tries, with a bounded cache."""

    def __init__(self, tries: dict[str, ReferenceTrie]):
        self.tries, self.cache = tries, OrderedDict()

    def evidence(self, field: str, value: str) -> list[Evidence] | None:
        """None for a value that equals an entry letter by letter."""
        trie = self.tries[field]
        if value in trie.exact:
            return None
        key = (field, value)
        if key not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.popitem(last=False)
            self.cache[key] = trie.evidence(value)
        return self.cache[key]

    def map(self, field: str, value: str) -> tuple[int, int] | None:
        """None for a value that equals an entry letter by letter, else (ref_id, distance)."""
        found = self.evidence(field, value)
        return None if found is None else decide(found)


_MAPPERS: dict[int, Mapper] = {}  # of the worker process, by the hash of what they are built from


def code_paths(codes: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The squeezed path that each code means: a code below another is ``name of the parent > name``."""
    names = dict(codes)
    return {c: squeeze(f"{names[p]} > {n}") for c, n in names.items() if (p := c.rpartition("_")[0]) in names}


def build_mapper(refs: list[tuple[int, str, str]], codes: list[tuple[str, str]]) -> Mapper:
    """From all (ref_id, field, value) and (cpath, name)."""
    tries = {}
    for f in FIELDS:
        mine = [(r, v) for r, g, v in refs if g == f]
        alias = spellings(mine, f == "category")
        meant = {c: min(alias[p]) for c, p in code_paths(codes).items() if p in alias} if f == "category" else {}
        # Codes that mean no entry are codes all the same.
        tries[f] = ReferenceTrie(alias, (v for _, v in mine), f == "category", meant or ({"": 0} if f == "category" and codes else {}))
    return Mapper(tries)


ALIASES = "field string, alias string, ref_id long, whole boolean"


def alias_table(refs: DataFrame) -> DataFrame:
    """(field, alias, refs) of all entries; where the alias is the full spelling of some, of these only."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (field, a, ref, a == squeeze(value))
                for ref, field, value in zip(*(batch.column(c).to_pylist() for c in ("ref_id", "field", "value")))
                if field in FIELDS
                for a in aliases(value, field == "category")
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(("field", "alias", "ref_id", "whole"), r)) for r in rows], pa.schema([("field", pa.string()), ("alias", pa.string()), ("ref_id", pa.int64()), ("whole", pa.bool_())]))

    every = refs.select("ref_id", "field", "value").mapInArrow(each, ALIASES)
    of = every.groupBy("field", "alias").agg(F.collect_set(F.when(F.col("whole"), F.col("ref_id"))).alias("whole"), F.collect_set("ref_id").alias("any"))
    return of.select("field", "alias", F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.col("any")).alias("refs"))


class References:
    """A reference list and a code list, ready for the workers: one mapper, or one a shard of the aliases.

    A shard holds all that is known of its aliases, and evidence from all shards is decided together, so that the
    result doesn't depend on their number.
    """

    def __init__(self, refs: DataFrame, codes: DataFrame, shard: int = SHARD):
        self.spark = refs.sparkSession
        valid = refs.filter("ref_id is not null and field is not null and value is not null").select("ref_id", "field", "value")
        code_rows = [(r.cpath, r.name) for r in codes.filter("cpath is not null and name is not null").select("cpath", "name").limit(MAX_CODES + 1).collect()]
        if len(code_rows) > MAX_CODES:
            raise ValueError(f"more than {MAX_CODES} category codes")
        self.shards = max(1, -(-valid.count() // shard))
        if self.shards == 1:
            self.parts = [([tuple(r) for r in valid.collect()], code_rows)]
            return
        table = checkpointed(alias_table(valid))
        paths = code_paths(code_rows)
        wanted = self.spark.createDataFrame([(p,) for p in sorted(set(paths.values()))] or [("",)], "alias string")
        known = {r.alias: min(r.refs) for r in table.filter("field = 'category'").join(wanted, "alias", "left_semi").collect()}
        meant = {c: known[p] for c, p in paths.items() if p in known}
        at = lambda *c: F.pmod(F.xxhash64(*c), F.lit(self.shards))
        self.parts = []
        for n in range(self.shards):
            alias = [(r.field, r.alias, tuple(r.refs)) for r in table.filter(at("field", "alias") == n).collect()]
            exact = [(r.field, r.value) for r in valid.filter(at("field", "value") == n).select("field", "value").collect()]
            self.parts.append((alias, exact, meant, bool(code_rows)))

    def mapper(self, part: int):
        """A function that gives the mapper of a shard on a worker."""
        shared = self.spark.sparkContext.broadcast(self.parts[part])
        key = hash(pickle.dumps(self.parts[part]))

        def get() -> Mapper:
            found = _MAPPERS.get(key)
            if found is None:
                rows = shared.value
                if len(rows) == 2:
                    found = build_mapper(*rows)
                else:
                    alias, exact, meant, coded = rows
                    found = Mapper({f: ReferenceTrie({a: set(r) for g, a, r in alias if g == f}, (v for g, v in exact if g == f), f == "category", (meant or ({"": 0} if coded else {})) if f == "category" else {}) for f in FIELDS})
                _MAPPERS[key] = found
            return found

        return get


EVIDENCE = T.StructType([T.StructField(n, t) for n, t in (("form", T.IntegerType()), ("letters", T.IntegerType()), ("exact", T.LongType()), ("d", T.IntegerType()), ("near", T.LongType()), ("low", T.LongType()), ("high", T.LongType()))])


@F.pandas_udf(T.LongType())
def _decided(forms: pd.Series) -> pd.Series:
    return pd.Series([decide(Evidence(*(e[f] for f in Evidence._fields)) for e in row)[0] for row in forms], dtype="int64")


def map_values(products: DataFrame, refs: DataFrame, codes: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(supplier, sku, field, ref_id)`` for each value of a listing that equals no entry; ref_id 0 if it means none.

    Of several rows of a listing the latest updated_at counts. Null values give no row; blank, empty and very
    long values are unmatched unless an entry is in reach. Reference rows with null parts and rows without
    supplier or sku are ignored; so are extra columns. An empty reference list leaves every value unmatched. More than
    MAX_CODES codes raise; reference lists have no bound, beyond ``shard`` entries they are searched in parts.
    """
    listing = (
        products.filter("supplier is not null and sku is not null")
        .groupBy("supplier", "sku")
        .agg(F.max(F.struct("updated_at", *FIELDS)).alias("r"))
        .select("supplier", "sku", *[F.col(f"r.{f}").alias(f) for f in FIELDS])
    )
    listing = spread(listing)
    known = References(refs, codes, shard)
    if known.shards == 1:
        get = known.mapper(0)

        @F.pandas_udf(T.ArrayType(T.StructType().add("field", T.StringType()).add("ref_id", T.LongType())))
        def look_up(brand: pd.Series, product_type: pd.Series, category: pd.Series) -> pd.Series:
            mapper = get()
            hits = lambda row: [(f, mapper.map(f, v)) for f, v in zip(FIELDS, row) if v is not None and v == v]
            return pd.Series([[{"field": f, "ref_id": hit[0]} for f, hit in hits(row) if hit is not None] for row in zip(brand, product_type, category)])

        return listing.select("supplier", "sku", F.explode(look_up(*FIELDS)).alias("v")).select("supplier", "sku", "v.*")

    values = listing.select("supplier", "sku", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("v")).select("supplier", "sku", "v.*").filter("value is not null")
    texts = values.select("field", "value").distinct()
    found = None
    for part in range(known.shards):
        seen = texts.select("field", "value", _evidence_of(known.mapper(part))("field", "value").alias("e"))
        found = seen if found is None else found.unionByName(seen)
    # A value equals an entry if a shard has it; else the evidence on each form is put together.
    met = found.groupBy("field", "value").agg(F.bool_or("e.equal").alias("equal"), F.flatten(F.collect_list("e.forms")).alias("forms"))
    form = F.explode_outer("forms").alias("e")
    forms = met.filter("not equal").select("field", "value", form).select("field", "value", "e.*")
    forms = forms.groupBy("field", "value", "form").agg(F.max("letters").alias("letters"), F.min("exact").alias("exact"), F.min(F.when(F.col("near").isNotNull(), F.struct("d", "near"))).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    forms = forms.select("field", "value", F.struct(F.col("form"), F.col("letters"), F.col("exact"), F.coalesce("n.d", F.lit(99)).alias("d"), F.col("n.near").alias("near"), "low", "high").alias("e"))
    meant = forms.groupBy("field", "value").agg(F.array_sort(F.filter(F.collect_list("e"), lambda e: e["form"].isNotNull())).alias("forms")).select("field", "value", _decided("forms").alias("ref_id"))
    return values.join(meant, ["field", "value"]).select("supplier", "sku", "field", "ref_id")


def _evidence_of(get):
    @F.pandas_udf(T.StructType().add("equal", T.BooleanType()).add("forms", T.ArrayType(EVIDENCE)))
    def look_up(field: pd.Series, value: pd.Series) -> pd.DataFrame:
        mapper = get()
        found = [mapper.evidence(f, v) for f, v in zip(field, value)]
        return pd.DataFrame({"equal": [e is None for e in found], "forms": [[x._asdict() for x in e or ()] for e in found]})

    return look_up


def entries_in_reach(products: DataFrame, refs: DataFrame, codes: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(field, value, ref_id, distance)``: every entry within the length-dependent distance of each distinct value of the listings.

    Values and references are taken as in ``map_values``; values that equal an entry are among them, at distance 0.
    """
    values = products.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("v")).select("v.*").filter("value is not null").distinct()
    values = spread(values)
    known = References(refs, codes, shard)
    found = None
    for part in range(known.shards):
        seen = values.select("field", "value", F.explode(_reached_by(known.mapper(part))("field", "value")).alias("e")).select("field", "value", "e.*")
        found = seen if found is None else found.unionByName(seen)
    return found.groupBy("field", "value", "ref_id").agg(F.min("distance").alias("distance"))


def _reached_by(get):
    @F.pandas_udf(T.ArrayType(T.StructType().add("ref_id", T.LongType()).add("distance", T.IntegerType())))
    def look_up(field: pd.Series, value: pd.Series) -> pd.Series:
        tries = get().tries
        return pd.Series([[{"ref_id": r, "distance": d} for r, d in sorted(tries[f].reached(v).items())] for f, v in zip(field, value)])

    return look_up
