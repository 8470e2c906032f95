"""Mapping of freely typed values to the closest entry of a reference list.

The entries of each kind (terms, and the other spellings of them that rules or lists give) are held in BK-trees under Levenshtein distance, a true metric: one tree for each kind, digits and
length, since digits must agree and an entry within two slips differs by at most two in its distance to the empty text. A value is folded and looked up; the triangle inequality prunes the trees, and every
entry within the radius comes back. A transposition is one slip of the typist but two edits, so the radius is twice the slips allowed; the exact check after it counts slips, word by word. The entries are
broadcast while they are few; else they are sharded by the trees they belong to, a value goes only to shards that can hold an entry near it, and the shards' winners are merged.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import looked_up, small, written

# Fixed values -------------------------------------------------------------------------------------------------------------------------------
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіАВЕКМНОРСТУХІ", "aeopcyxiABEKMHOPCTYXI")
MONTHS = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()
#: Other names of terms that neither a slip nor a rule explains, by kind and term.
OTHER_NAMES = {
    ("TYPE", "STATE"): ["INDIAN STATE"],
    ("TYPE", "PERIOD"): ["MONTH", "TIME PERIOD"],
    ("TYPE", "DISTRIBUTOR"): ["WD", "DISTRIB"],
    ("TYPE", "CATEGORY"): ["CAT", "CATEGORIE", "PRODUCT CATEGORY"],
    ("TYPE", "FRANCHISE"): ["BRAND"],
    ("TYPE", "METRIC"): ["KPI", "METRIC NAME"],
    ("TYPE", "DOCUMENT"): ["FILE", "SOURCE DOCUMENT"],
    ("METRIC", "PRODUCTIVITY"): ["PROD"],
    ("METRIC", "SERVICE LEVEL"): ["SVC LEVEL", "SERV LEVEL", "SERVICE LVL"],
    ("METRIC", "SKUS PER TRANSACTION"): ["SKU PER TRANS", "SKUS PER TXN", "SKUS TRANSACTION"],
    ("METRIC", "INVENTORY TURNS"): ["INV TURNS", "INVTRY TURNS", "INVENTORY TURN"],
    ("METRIC", "INVENTORY DAYS"): ["INV DAYS", "DAYS OF INVENTORY", "INVENTORY DAY"],
    ("METRIC", "NUMERIC DISTRIBUTION"): ["NUMERIC DIST", "NUMERIC DISTR", "NUM DISTRIBUTION"],
    ("METRIC", "RANGE BILLING"): ["BILLING RANGE", "RANGE BILL"],
    ("METRIC", "OUT OF STOCK RATE"): ["OOS RATE", "OUT OF STOCK"],
}
#: What may be written around a term, by kind; the group is the term.
AROUND = {
    "STATE": [r"STATE OF (.+)", r"(.+) STATE", r"(.+), IN", r"(.+) \(ST\)"],
    "PERIOD": [r"MONTH OF (.+)"],
    "DISTRIBUTOR": [r"M/S\.? (.+)", r"(.+) - WD", r"(.+) PVT\.? LTD\.?", r"(.+) \([^()]*\)", r"(.+), ZONE \d+"],
    "CATEGORY": [r"CATEGORY: ?(.+)", r"(.+) CATEGORY", r"(.+) \(ALL PACKS\)"],
    "FRANCHISE": [r"BRAND (.+)", r"(.+) \(RANGE\)", r"(.+) PACK \d+"],
    "METRIC": [r"(.+) \(WEIGHTED\)", r"(.+) \(UNITS\)", r"(.+) ?%"],
}
#: Endings that say what a distributor's name already is.
FIRM_ENDINGS = ["DISTRIBUTORS", "DISTRIBUTOR", "DISTRIBUTION", "DSTRBTRS", "DISTR", "DIST"]
# --------------------------------------------------------------------------------------------------------------------------------------------



@dataclass(frozen=True)
class Rules:
    """What is known of a list's terms beyond their spelling: other names by kind and term, and patterns of what may be written around a term, by kind. The defaults serve sales vocabularies; give others for other lists."""

    other_names: Mapping[tuple[str, str], Sequence[str]] = field(default_factory=lambda: OTHER_NAMES)
    around: Mapping[str, Sequence[str]] = field(default_factory=lambda: AROUND)

    def terms_in(self, kind: str, folded: str) -> list[str]:
        """A folded value, and the term in it where something is written around it."""
        found = [re.fullmatch(p, folded) for p in self.around.get(kind, [])]
        return [folded, *(m.group(1).strip() for m in found if m)]


RULES = Rules()
_TITLE_KINDS = ("STATE", "PERIOD", "DISTRIBUTOR", "CATEGORY", "FRANCHISE", "METRIC")
#: Most terms that are broadcast, entries of a shard beyond that, and values that one task looks up.
BROADCAST_TERMS, SHARD_TERMS, TASK_VALUES = 20_000, 5_000, 1_000
#: Most slips in any entry, which is how far lengths may differ.
MOST_SLIPS = 2


def fold(value: str) -> str:
    """Upper case, without accents and look-alikes, white space and underscores as one blank."""
    plain = unicodedata.normalize("NFKD", value.translate(LOOKALIKES))
    return re.sub(r"[\s_]+", " ", "".join(c for c in plain if not unicodedata.combining(c))).strip().upper()


def words_of(folded: str) -> list[str]:
    return [w for w in re.sub(r"[^0-9A-Z]+", " ", re.sub(r"(?<=\w)\.(?=\w\b)", "", folded.replace("&", " "))).split() if w != "AND"]


def levenshtein(pattern: str) -> "callable":
    """The distance of any string to ``pattern``, by Myers' bit vectors."""
    m = len(pattern)
    if not m:
        return len
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1

    def distance(other: str) -> int:
        up, down, score = full, 0, m
        for c in other:
            eq = at.get(c, 0)
            diag = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | ~(diag | up) & full, up & diag
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = plus << 1 | 1
            down, up = plus & diag & full, (minus << 1 | ~(diag | plus)) & full
        return score

    return distance


def slips(a: str, b: str) -> int:
    """Insertions, deletions, changes and transpositions (Damerau-Levenshtein) between a and b."""
    if a == b:
        return 0
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k = last.get(y, 0)
            swap = rows[k][match] + (i - k - 1) + 1 + (j - match - 1)
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap))
            if x == y:
                match = j
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


class BKTree:
    """Keys under Levenshtein distance; equal keys share a node."""

    def __init__(self, keys: Iterable[str]) -> None:
        self.root: list | None = None
        for key in keys:
            if self.root is None:
                self.root = [key, {}]
                continue
            node, distance = self.root, levenshtein(key)
            while d := distance(node[0]):
                if d not in node[1]:
                    node[1][d] = [key, {}]
                    break
                node = node[1][d]

    def within(self, query: str, radius: int) -> list[tuple[int, str]]:
        """Every key within the radius, with its distance. A child at edge e can only hold such keys if |d - e| <= radius."""
        found, stack, distance = [], [self.root] if self.root else [], levenshtein(query)
        while stack:
            key, children = stack.pop()
            d = distance(key)
            if d <= radius:
                found.append((d, key))
            for edge, child in children.items():
                if -radius <= d - edge <= radius:
                    stack.append(child)
        return found


def _allowed(key: str, kind: str) -> int:
    """Slips allowed in an entry: none up to 4 characters, one up to 8, two beyond; a month's digits don't make it longer."""
    n = len(re.sub(r"\d", "", key)) if kind == "PERIOD" else len(key)
    return 0 if n <= 4 and kind != "PERIOD" else 1 if n <= (5 if kind == "PERIOD" else 8) else 2


_ENDINGS = [(e, levenshtein(e), range(max(3, len(e) - 2), len(e) + 3) if len(e) > 6 else (len(e),), 2 if len(e) > 8 else 0) for e in FIRM_ENDINGS]


@lru_cache(100_000)
def _ending_slips(tail: str, ending: int) -> int:
    """Slips between a tail and an ending, or 3 if there are more than 2; most tails are ruled out by their Levenshtein distance, at most twice the slips."""
    return 3 if _ENDINGS[ending][1](tail) > 4 else min(3, slips(tail, _ENDINGS[ending][0]))


def _firm(words: list[str]) -> tuple[str, int] | None:
    """A distributor's name without its ending, squeezed, and the slips in the ending; None if nothing is left of it."""
    whole = "".join(words)
    best = (3, 0, len(whole))
    for i, (_, _, lengths, most) in enumerate(_ENDINGS):
        for n in lengths:
            if n < len(whole) and (d := _ending_slips(whole[-n:], i)) <= most:
                best = min(best, (d, -n, len(whole) - n))
    if best[0] == 3:
        return (whole, 0) if whole and not any(_ending_slips(whole, i) <= 2 for i in range(len(_ENDINGS))) else None
    return whole[: best[2]], best[0]


class Entries:
    """Trees of entries. An entry is a squeezed spelling of a term (kind, key, term_id, slips allowed in it, its words)."""

    def __init__(self, rows: Iterable[tuple[str, str, int, int, Sequence[str]]]) -> None:
        self.cells: dict[tuple[str, str, int], dict[str, list[tuple[int, int, tuple[str, ...]]]]] = {}
        for kind, key, term_id, allowed, words in rows:
            self.cells.setdefault((kind, digits_of(key), len(key)), {}).setdefault(key, []).append((term_id, allowed, tuple(words)))
        self.trees: dict[tuple[str, str, int], BKTree] = {}
        self.closest = lru_cache(200_000)(self._closest)

    def _near(self, cell: tuple[str, str, int], query: str, radius: int) -> list[str]:
        if cell not in self.cells:
            return []
        if cell not in self.trees:
            self.trees[cell] = BKTree(self.cells[cell])
        return [key for _, key in self.trees[cell].within(query, radius)]

    def _closest(self, kind: str, words: tuple[str, ...], spent: int) -> tuple[int, int] | None:
        """Slips and term of the closest entry of the kind; None if there is none within what it allows."""
        query = "".join(words)
        digits, n, best = digits_of(query), len(query), None
        for length in sorted(range(n - MOST_SLIPS, n + MOST_SLIPS + 1), key=lambda x: x != n) if query else ():
            cell = (kind, digits, length)
            exact = length == n and query in self.cells.get(cell, ())
            for key in ([query] if exact else []) + self._near(cell, query, 2 * (2 if n > 6 else 1)) if best is None or best[0] > spent else ():
                d = slips(query, key)
                for term_id, allowed, spelt in self.cells[cell][key]:
                    near = len(spelt) != len(words) or all(slips(a, b) <= (1 if len(b) <= 5 else 2) for a, b in zip(words, spelt))
                    if d + spent <= max(allowed, 2 * bool(spent and allowed)) and near and (best is None or (d + spent, term_id) < best):
                        best = (d + spent, term_id)
                if exact and best is not None and best[0] == spent:
                    break  # nothing is closer than an entry as it stands
        return best


def digits_of(key: str) -> str:
    return re.sub(r"\D", "", key)


def entries_of(term_id: int, kind: str, term: str, single: bool, rules: Rules = RULES) -> list[tuple[str, str, int, int, tuple[str, ...]]]:
    """The entries of a term: (kind, key, term_id, slips allowed, words). ``single`` says that no other distributor has its first word."""
    out = []
    for words, allowed in _spellings(kind, words_of(fold(term)), single, rules):
        if key := "".join(words):
            out.append((kind, key, term_id, _allowed(key, kind) if allowed is None else allowed, tuple(words)))
    return out


def _spellings(kind: str, words: list[str], single: bool, rules: Rules) -> Iterator[tuple[list[str], int | None]]:
    if kind == "DISTRIBUTOR":
        name = words[:-1] if len(words) > 1 and words[-1] in FIRM_ENDINGS else words
        yield name, None
        if len(name) == 2:
            yield name[::-1], None
            if single:
                yield name[:1], 0
        return
    yield words, None
    for other in rules.other_names.get((kind, " ".join(words)), []):
        yield other.split(), 0
    if kind == "PERIOD" and len(words) == 2 and words[0] in MONTHS:
        month, year = words
        no = f"{MONTHS.index(month) + 1:02d}"
        yield [year, month], None
        yield [month, "OF", year], None
        for short in ([month[:3], year], [month[:3], year[2:]], [year, no], [no, year]):
            yield short, 0


def asked_forms(kind: str, value: str, states: Iterable[str] = (), rests: Iterable[str] = (), rules: Rules = RULES) -> list[tuple[tuple[str, ...], int]]:
    """The words a value may be looked up by, and the slips already spent on what was taken off: its own, without what is written around a term, without a firm's ending, and for categories without a state's
    name before them, which is one of ``states`` or has been taken off already in ``rests``."""
    asked: list[tuple[tuple[str, ...], int]] = [((r,), 0) for r in rests]
    for words in forms_of(kind, value, rules):
        if kind == "DISTRIBUTOR":
            if (firm := _firm(words)) is not None:
                name = words[:-1] if "".join(words[:-1]) == firm[0] else words if "".join(words) == firm[0] else [firm[0]]
                asked.append((tuple(name), firm[1]))
        else:
            asked.append((tuple(words), 0))
            if kind == "CATEGORY":
                whole = "".join(words)
                asked += [((whole[len(s) :],), 0) for s in states if whole.startswith(s) and len(whole) > len(s)]
    return [(words, spent) for words, spent in dict.fromkeys(asked) if "".join(words)]


class TermIndex:
    """All terms of a list, ready for look-ups."""

    def __init__(self, terms: Iterable[tuple[int, str, str]], rules: Rules = RULES) -> None:
        self.rules = rules
        terms = sorted({(i, k, t) for i, k, t in terms if k and t})
        self.states = sorted(("".join(words_of(fold(t))) for _, k, t in terms if k == "STATE"), key=len, reverse=True)
        firsts = single_firsts(terms)
        self.entries = Entries(e for i, k, t in terms for e in entries_of(i, k, t, (words_of(fold(t)) or [""])[0] in firsts, rules))

    def lookup(self, kind: str, value: str) -> tuple[int, int] | None:
        """Slips and id of the term of the kind that the value means, or None."""
        found = [x for words, spent in asked_forms(kind, value, self.states, rules=self.rules) if (x := self.entries.closest(kind, words, spent)) is not None]
        return min(found) if found else None


def forms_of(kind: str, value: str, rules: Rules = RULES) -> list[list[str]]:
    """The words of a value, and of the term in it where something is written around it."""
    folded = fold(value).replace("®", "").strip().strip("\"'“”«»").strip()
    return [words_of(form) for form in rules.terms_in(kind, folded)]


def single_firsts(terms: Iterable[tuple[int, str, str]]) -> frozenset[str]:
    """First words that only one distributor has."""
    first: dict[str, int] = {}
    for _, kind, term in terms:
        if kind == "DISTRIBUTOR" and (w := words_of(fold(term))):
            first[w[0]] = first.get(w[0], 0) + 1
    return frozenset(w for w, n in first.items() if n == 1)


def _with_single(known: DataFrame) -> DataFrame:
    """Terms with ``single``: the first word of a distributor, if no other of the whole list has it; else null."""

    def first_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["first"] = [(words_of(fold(t)) or [None])[0] if k == "DISTRIBUTOR" else None for k, t in zip(b["kind"], b["term"])]
            yield b

    firsts = written(known.where("kind <> '' AND term <> ''").mapInPandas(first_words, "term_id long, kind string, term string, first string"), "firsts")
    single = firsts.where("first IS NOT NULL").groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("first", F.col("first").alias("single"))
    return firsts.join(single, "first", "left").select("term_id", "kind", "term", "single")


def _with_rests(asked: DataFrame, known: DataFrame, rules: Rules) -> DataFrame:
    """Values with ``rests``: what follows the name of any state of the whole list in a category's value; the value's beginnings are looked up among the states by equality."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"state": ["".join(words_of(fold(t))) for t in b["term"]]})

    states = written(known.where("kind = 'STATE'").select("term").mapInPandas(names, "state string").where("state <> ''").distinct(), "states")
    lengths = [r["n"] for r in states.select(F.length("state").alias("n")).distinct().collect()]  # as many as names have lengths

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            wholes = [(v, w) for v in b["value"] for w in {"".join(f) for f in forms_of("CATEGORY", v, rules)}]
            yield pd.DataFrame([(v, w[:n], w[n:]) for v, w in wholes for n in lengths if n < len(w)], columns=["value", "state", "rest"])

    cut = asked.where("kind = 'CATEGORY'").select("value").mapInPandas(halves, "value string, state string, rest string")
    rests = cut.join(small(states), "state").groupBy("value").agg(F.collect_set("rest").alias("rests")).withColumn("kind", F.lit("CATEGORY"))
    return asked.join(rests, ["kind", "value"], "left").withColumn("rests", F.coalesce("rests", F.array().cast("array<string>")))


_indexes: dict[str, TermIndex] = {}


def _index_of(token: str, held, rules: Rules) -> TermIndex:
    """The index of a broadcast list, built once in each worker process; the one before it is let go."""
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = TermIndex(held.value, rules)
    return _indexes[token]


def map_values(values: DataFrame, terms: DataFrame, broadcast_terms: int = BROADCAST_TERMS, shard_terms: int = SHARD_TERMS, rules: Rules = RULES) -> DataFrame:
    """For each distinct (kind, value): term_id of the entry of that kind it means, or 0, and ``slips``, the slips found (null for 0).

    ``values`` has kind and value, ``terms`` has term_id, kind, term. Null or blank values and null kinds are left out; kinds without terms match nothing; among equally close
    entries the lowest term_id counts. Distinct values are looked up once, however often they occur. Up to ``broadcast_terms`` terms are broadcast as one index; more are sharded, see ``_map_sharded``.
    """
    spark = values.sparkSession
    asked = written(values.select("kind", "value").where(F.col("kind").isNotNull() & (F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) != "")).distinct(), "values")
    known = terms.select("term_id", "kind", "term").where(F.col("term").isNotNull() & F.col("kind").isNotNull()).distinct()
    n_values, n_terms = asked.count(), known.count()
    if n_terms > broadcast_terms:
        return _map_sharded(asked, known, shard_terms, rules)
    held, token = spark.sparkContext.broadcast([tuple(r) for r in known.collect()]), uuid.uuid4().hex

    def by_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index_of(token, held, rules)
        for b in batches:
            got = [index.lookup(k, v) for k, v in zip(b["kind"], b["value"])]
            yield pd.DataFrame({"kind": b["kind"], "value": b["value"], "slips": pd.array([g[0] if g else None for g in got], "Int32"), "term_id": pd.array([g[1] if g else 0 for g in got], "int64")})

    return asked.repartition(max(1, -(-n_values // TASK_VALUES))).mapInPandas(by_batch, "kind string, value string, slips int, term_id long")


def _map_sharded(asked: DataFrame, known: DataFrame, shard_terms: int, rules: Rules) -> DataFrame:
    """map_values() for more terms than can be broadcast.

    Entries and the forms of values are laid out as rows. Entries are sharded by kind, digits and length, and dealt further by a hash where such a cell has over ``shard_terms``; a form goes
    to the cells at most MOST_SLIPS longer or shorter, and there to each shard, in as many parts as the forms there need, so that no task has more than about TASK_VALUES forms and ``shard_terms`` entries. What depends on the whole list (first
    words that only one distributor has, states before a category) is found before. The closest answer of a value counts.
    """
    cell = ["kind", "digits", "length"]

    def lay_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, digits_of(key), len(key), key, i, n, list(w)) for t, kind, term, single in b.itertuples(index=False) for k, key, i, n, w in entries_of(t, kind, term, single is not None, rules)]
            yield pd.DataFrame(rows, columns=[*cell, "key", "term_id", "allowed", "words"])

    def lay_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, v, list(w), spent, digits_of("".join(w)), len("".join(w))) for k, v, rests in zip(b["kind"], b["value"], b["rests"]) for w, spent in asked_forms(k, v, rests=rests, rules=rules)]
            yield pd.DataFrame(rows, columns=["kind", "value", "words", "spent", "digits", "own"])

    entries = written(_with_single(known).mapInPandas(lay_entries, "kind string, digits string, length int, key string, term_id long, allowed int, words array<string>"), "entries")
    laid = written(_with_rests(asked, known, rules).mapInPandas(lay_forms, "kind string, value string, words array<string>, spent int, digits string, own int"), "forms")
    forms = laid.withColumn("length", F.explode(F.sequence(F.col("own") - MOST_SLIPS, F.col("own") + MOST_SLIPS)))
    sizes = entries.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / shard_terms).cast("int").alias("shards"))
    needs = forms.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / TASK_VALUES).cast("int").alias("parts"))
    cells = small(written(sizes.join(needs, cell), "cells"))  # a row for each length and digits that both have
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    dealt = entries.join(cells, cell).withColumn("shard", one("key", "shards")).withColumn("part", every("parts")).drop("shards", "parts")
    spread = forms.join(cells, cell).withColumn("part", one("value", "parts")).withColumn("shard", every("shards")).drop("shards", "parts")

    def by_shard(f: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        index = Entries(e[["kind", "key", "term_id", "allowed", "words"]].itertuples(index=False, name=None)) if len(f) and len(e) else None
        got = [index.closest(k, tuple(w), s) if index else None for k, w, s in zip(f["kind"], f["words"], f["spent"])]
        return pd.DataFrame([(k, v, *g) for k, v, g in zip(f["kind"], f["value"], got) if g], columns=["kind", "value", "slips", "term_id"]).astype({"slips": "int32", "term_id": "int64"})

    keys = [*cell, "shard", "part"]
    found = spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(by_shard, "kind string, value string, slips int, term_id long")
    winner = found.groupBy("kind", "value").agg(F.min(F.struct("slips", "term_id")).alias("w"))
    return asked.join(winner, ["kind", "value"], "left").select("kind", "value", F.col("w.slips").alias("slips"), F.coalesce("w.term_id", F.lit(0).cast("long")).alias("term_id"))


def map_entities(entities: DataFrame, terms: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Every typed value of entities with the term it means: entity_id, field_name (type or title), kind, value, term_id (0: none), exact.

    A type is looked up among the terms of kind TYPE; a title among those of the kind its type means, if that kind has terms of its own (STATE, PERIOD, DISTRIBUTOR, CATEGORY,
    FRANCHISE, METRIC). ``exact`` says that the value is a term as it stands. Null and blank values give no row; repeated rows of an id give one.
    """
    rows = entities.select(F.col("id").alias("entity_id"), "type", "title")
    types = map_values(rows.select(F.lit("TYPE").alias("kind"), F.col("type").alias("value")), terms, rules=rules)
    names = written(terms.where("kind = 'TYPE'").select(F.col("term_id").alias("type_id"), F.upper("term").alias("title_kind")).distinct(), "names")
    kinds = written(types.withColumnRenamed("term_id", "type_id").join(small(names), "type_id", "left").select(F.col("value").alias("type"), "type_id", "title_kind"), "kinds")
    typed = looked_up(rows, kinds, ["type"])
    titled = typed.where(F.col("title_kind").isin(*_TITLE_KINDS)).select("entity_id", F.col("title_kind").alias("kind"), F.col("title").alias("value"))
    meant = written(map_values(titled, terms, rules=rules), "meant")
    titles = looked_up(titled, meant, ["kind", "value"]).select("entity_id", F.lit("title").alias("field_name"), "kind", "value", "term_id")
    both = typed.select("entity_id", F.lit("type").alias("field_name"), F.lit("TYPE").alias("kind"), F.col("type").alias("value"), F.col("type_id").alias("term_id")).unionByName(titles)
    exact = written(terms.select("kind", F.col("term").alias("value"), F.lit(True).alias("exact")).distinct(), "exact")
    return looked_up(both, exact, ["kind", "value"], "left").withColumn("exact", F.coalesce("exact", F.lit(False))).distinct()
