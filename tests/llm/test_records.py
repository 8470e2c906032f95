import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.keys import fold_title
from tallyloom.llm.survivors import surviving_observations
from tallyloom.llm.termmap import BKTree, TermIndex, levenshtein, map_entities, map_values, slips
from tallyloom.llm.topn import top_n

TERMS = [(1, "TYPE", "STATE"), (2, "TYPE", "PERIOD"), (3, "TYPE", "DISTRIBUTOR"), (4, "TYPE", "FRANCHISE"), (5, "TYPE", "OBSERVATION"), (6, "TYPE", "CATEGORY"), (10, "STATE", "Dakshin Shila"), (11, "STATE", "Meghvan"), (20, "PERIOD", "March 2025"), (21, "PERIOD", "May 2025"), (30, "DISTRIBUTOR", "Suldor & Banuk Distributors"), (31, "DISTRIBUTOR", "Suldor Vembovan Distributors"), (32, "DISTRIBUTOR", "Pantes-Torvint Distributors"), (40, "FRANCHISE", "Crisp_Series_1"), (41, "FRANCHISE", "Crisp_Series_2"), (50, "CATEGORY", "Mintline")]


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_against_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["x" * 80, "x" * 79 + "y"]
    for a in words:
        d = levenshtein(a)
        for b in words:
            assert d(b) == plain_levenshtein(a, b)
            assert slips(a, b) <= d(b) <= 2 * slips(a, b)
    assert slips("abcd", "abdc") == 1 and slips("ca", "abc") == 2


def test_tree_returns_every_key_within_the_radius():
    rng = random.Random(6)
    keys = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(300)}
    tree = BKTree(keys)
    for q in list(keys)[:40] + ["", "zzzz", "abcdabcd"]:
        for r in (0, 1, 3):
            assert sorted(tree.within(q, r)) == sorted((plain_levenshtein(q, k), k) for k in keys if plain_levenshtein(q, k) <= r)
    assert BKTree([]).within("a", 3) == []


@pytest.mark.parametrize(
    "kind, value, term",
    [
        ("STATE", "dakshin_shila\t", 10), ("STATE", "DAKSHN SHHILA", 10), ("STATE", "State of Meghvan", 11), ("STATE", "Megvhan", 11), ("STATE", "Paschim Desh", None), ("STATE", "Méghvаn", 11),
        ("PERIOD", "Mar-25", 20), ("PERIOD", "03/2025", 20), ("PERIOD", "2025 March", 20), ("PERIOD", "month of May 2025", 21), ("PERIOD", "May 2026", None), ("PERIOD", "Q3 2025", None), ("PERIOD", "last month", None),
        ("DISTRIBUTOR", "SULDOR AND BANUK DISTRBUTORS", 30), ("DISTRIBUTOR", "Suldor&BanukDistributors", 30), ("DISTRIBUTOR", "M/s Suldor & Banuk Distributors", 30), ("DISTRIBUTOR", "Suldor & Banuk", 30),
        ("DISTRIBUTOR", "Torvint - Pantes Distributors", 32), ("DISTRIBUTOR", "Pantes Distributors", 32), ("DISTRIBUTOR", "Suldor Distributors", None), ("DISTRIBUTOR", "Suldor & Sons Distributors", None), ("DISTRIBUTOR", "Distributors", None), ("DISTRIBUTOR", "Vembovan-Torvint Distributors", None),
        ("FRANCHISE", "crisp-series-2", 41), ("FRANCHISE", "Crisp_Series_3", None), ("FRANCHISE", "Crisp_Series_12", None), ("FRANCHISE", '"Crisp_Sreies_1"', 40), ("FRANCHISE", "Crisp Series 1 (range)", 40),
        ("CATEGORY", "Meghvan Mintline", 50), ("CATEGORY", "Mintlnie", 50), ("CATEGORY", "Others", None), ("TYPE", "Distributer", 3), ("TYPE", "PERSON", None), ("NOTHING", "x", None),
    ],
)
def test_lookup(kind, value, term):
    found = TermIndex(TERMS).lookup(kind, value)
    assert (found and found[1]) == term


def test_shards_give_the_same_as_the_broadcast_index(spark):
    terms = spark.createDataFrame(TERMS, "term_id long, kind string, term string")
    values = spark.createDataFrame([(k, v) for _, k, t in TERMS for v in (t, t.lower(), t[:-1], t + "x", "zzz")] + [("STATE", None), ("STATE", " \t"), (None, "x"), ("STATE", "Meghvan" * 400)], "kind string, value string")
    values = values.unionByName(spark.createDataFrame([("CATEGORY", f"{s} {c}") for s in ("Meghvan", "dakshin_shila", "Nowhere") for c in ("Mintline", "mintlnie", "Others")], values.schema))
    a = sorted(map(tuple, map_values(values, terms).collect()), key=str)
    assert len(a) > 60 and sum(r[0] == "DISTRIBUTOR" and r[3] > 0 for r in a) > 8
    for shard_terms in (1, 4, 50):
        assert sorted(map(tuple, map_values(values, terms, broadcast_terms=0, shard_terms=shard_terms).collect()), key=str) == a
    assert map_values(values.limit(0), terms).count() == 0
    assert {r.term_id for r in map_values(values, terms.limit(0)).collect()} == {0}


def test_shards_know_first_words_and_states_of_the_whole_list(spark):
    more = [(33, "DISTRIBUTOR", "Suldolda Marn Distributors"), (34, "DISTRIBUTOR", "Suldolda Tiv Distributors"), (51, "CATEGORY", "Softdrop"), (52, "CATEGORY", "Oral Care"), (12, "STATE", "Dakshin")]
    terms = spark.createDataFrame(TERMS + more, "term_id long, kind string, term string")
    asked = [("DISTRIBUTOR", v) for v in ("Suldolda", "SULDOLDA distributors", "Suldor", "Pantes", "M/s Pantes", "Suldor & Banuk")] + [("CATEGORY", v) for v in ("Meghvan Mintline", "DAKSHIN_SHILA softdrop", "Dakshin Oral Caer", "Category: Meghvan Softdrop", "Meghvan", "Paschim Mintline")]
    values = spark.createDataFrame(asked, "kind string, value string")
    whole = {(r.kind, r.value): (r.slips, r.term_id) for r in map_values(values, terms).collect()}
    assert whole["DISTRIBUTOR", "Suldolda"] == (None, 0) and whole["DISTRIBUTOR", "Pantes"] == (0, 32) and whole["CATEGORY", "Meghvan Mintline"] == (0, 50) and whole["CATEGORY", "DAKSHIN_SHILA softdrop"] == (0, 51)
    for shard_terms in (1, 4):
        assert {(r.kind, r.value): (r.slips, r.term_id) for r in map_values(values, terms, broadcast_terms=0, shard_terms=shard_terms).collect()} == whole


def test_entities_with_blank_repeated_and_clashing_rows(spark):
    rows = [("a", "state", "megvhan"), ("a", "state", "megvhan"), ("b", "STATE", "Meghvan"), ("c", None, "Meghvan"), ("d", " ", "Meghvan"), ("e", "STATES", None), ("f", "OBSERVATION", "Meghvan"), ("g", "???", "Meghvan")]
    entities = spark.createDataFrame([(*r, 7, "x") for r in rows], "id string, type string, title string, kind int, value string")
    out = map_entities(entities, spark.createDataFrame(TERMS, "term_id long, kind string, term string"))
    got = sorted((r.entity_id, r.field_name, r.term_id, r.exact) for r in out.collect())
    assert got == [("a", "title", 11, False), ("a", "type", 1, False), ("b", "title", 11, True), ("b", "type", 1, True), ("e", "type", 1, False), ("f", "type", 5, True), ("g", "type", 0, False)]


def test_survivors_by_field(spark):
    t = lambda d: datetime(2026, 8, d)
    rows = [
        ("a", 5, "Obs_1", " observation", "long one here", "extract", t(1)),
        ("b", 3, "OBS 1", "OBSERVATION", None, "review", t(2)),
        ("c", None, "obs  1 ", "Observation\t", "  long one here ", None, t(3)),
        ("b", 3, "OBS 1", "OBSERVATION", None, "review", t(2)),
        ("d", 1, "alone", "OBSERVATION", "x", "review", t(1)),
        ("d", 1, "alone", "OBSERVATION", "x", "review", t(1)),
        ("e", None, None, "OBSERVATION", "x", None, None),
        ("f", None, "T", "OBSERVATION", "", "other", None),
        ("g", None, "t", "OBSERVATION", None, None, None),
        ("h", 9, "Obs 1", "STATE", "longest of them all, but a state", "review", t(9)),
    ]
    e = spark.createDataFrame([(*r, "clash") for r in rows], "id string, human_readable_id long, title string, type string, description string, origin string, loaded_at timestamp_ntz, `group` string")
    out = surviving_observations(e, fold_title("title"))
    assert sorted(map(tuple, out.select("keep_id", "title_id", "title", "description_id", "description").collect())) == [("b", "b", "OBS 1", "c", "long one here"), ("f", "f", "T", "f", "")]
    assert surviving_observations(e.limit(0), fold_title("title")).count() == 0


def test_top_n_of_hot_groups_with_ties_and_nulls(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([1, 2, 3, None]), f"i{rng.randint(0, 30):02d}", "mine") for _ in range(500)] + [("one", 4, None, "x")]
    df = spark.createDataFrame(data, "g string, s int, i string, place string").repartition(5)
    out = top_n(df, ["g"], "s", "i", 4)
    assert out.columns == ["g", "s", "i", "place"]
    for g in {d[0] for d in data}:
        want = sorted((d for d in data if d[0] == g), key=lambda d: (d[1] is None, -(d[1] or 0), d[2] is None, d[2] or ""))[:4]
        assert [(r.s, r.i) for r in sorted(out.where(F.col("g").eqNullSafe(F.lit(g))).collect(), key=lambda r: r.place)] == [(w[1], w[2]) for w in want]
    assert top_n(df, ["g"], "s", "i", 0).count() == 0 and top_n(df.limit(0), ["g"], "s", "i", 3).count() == 0


def test_every_entry_within_the_slips_is_found():
    from tallyloom.llm.termmap import Entries, _allowed, digits_of, slips

    rng = random.Random(8)
    names = ["".join(rng.choice("abcd12"[: rng.choice([4, 6])]) for _ in range(rng.randint(5, 12))).upper() for _ in range(300)]
    held = Entries([("K", n, i, _allowed(n, "K"), (n,)) for i, n in enumerate(names)])
    for n in names[:200]:
        q = list(n)
        i = rng.randrange(len(q) - 1)
        q[i], q[i + 1] = q[i + 1], q[i]
        if rng.random() < 0.5:
            del q[rng.randrange(len(q))]
        q = "".join(q)
        near = [(slips(q, m), i) for i, m in enumerate(names) if slips(q, m) <= min(_allowed(m, "K"), 1 if len(m) <= 5 else 2) and digits_of(m) == digits_of(q)]
        assert held.closest("K", (q,), 0) == (min(near) if near else None)
