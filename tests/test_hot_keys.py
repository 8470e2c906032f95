from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.features import feature_table
from tallyloom.operators.orphans import bloom_filter, find_orphans, probed
from tallyloom.operators.positions import key_totals, number_rows, running_totals
from tallyloom.operators.rolling import rolling_totals, trailing_sums


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_totals_of_hot_null_and_empty_keys(spark):
    data = [("a", i) for i in range(1000)] + [("b", None), (None, 5), (None, 6), ("b", None), ("", 1)]
    df = spark.createDataFrame(data, "k string, v long").repartition(7)
    assert rows(key_totals(df, ["k"], "v", 37)) == rows(spark.createDataFrame([("a", 1000, 499500), ("b", 2, 0), (None, 2, 11), ("", 1, 1)], "k string, n long, t long"))


def test_totals_of_an_empty_table(spark):
    assert key_totals(spark.createDataFrame([], "k string, v long"), ["k"], "v").count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_running_totals_against_brute_force(spark, chunk):
    rng = np.random.default_rng(1)
    data = [(["hot", "x", "y", None][min(3, int(rng.integers(0, 9)))] if i % 3 else "hot", int(rng.integers(0, 40)), i, int(rng.integers(-5, 9))) for i in range(400)]
    out = running_totals(spark.createDataFrame(data, "k string, d int, i int, v int"), ["k"], [F.col("d"), F.col("i")], "v", chunk).collect()
    for k in {r[0] for r in data}:
        total, want = 0, []
        for no, (_, _d, i, v) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: r[1:3])):
            total += v
            want.append((i, no, total))
        assert sorted((r.i, r.row_no, r.running_total) for r in out if r.k == k) == sorted(want)


def test_number_rows_replaces_a_clashing_column_and_keeps_the_others(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 2, "y")], "k string, row_no int, extra string")
    out = number_rows(df, ["k"], [F.col("extra")])
    assert out.columns == ["k", "extra", "row_no"] and rows(out) == [("a", "y", 0), ("a", "z", 1)]


@pytest.mark.parametrize("width", [1, 2, 7, 30, 50])
def test_trailing_sums_against_brute_force(width):
    days = np.random.default_rng(width).integers(-4, 9, (5, 41))
    want = np.stack([days[:, max(0, i - width + 1) : i + 1].sum(axis=1) for i in range(41)], axis=1)
    assert (trailing_sums(days, width) == want).all()


def test_rolling_totals_of_silent_unknown_and_null_entities(spark):
    e = [("a", date(2024, 12, 31), 5), ("a", date(2025, 1, 2), 1), ("a", date(2025, 1, 2), 2), ("a", None, 9), (None, date(2025, 1, 1), 9), ("z", date(2025, 1, 1), 9), ("a", date(2025, 1, 3), None)]
    events = spark.createDataFrame(e, "o string, day date, q long")
    known = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "o string, extra int")
    out = rolling_totals(events, known, "o", "day", "q", date(2025, 1, 1), date(2025, 1, 3), (1, 2))
    assert out.columns == ["o", "day", "total_1", "avg_1", "total_2", "avg_2"]
    want = [("a", date(2025, 1, 1), 0, 0.0, 5, 2.5), ("a", date(2025, 1, 2), 3, 3.0, 3, 1.5), ("a", date(2025, 1, 3), 0, 0.0, 3, 1.5)]
    assert rows(out) == want + [("b", date(2025, 1, d), 0, 0.0, 0, 0.0) for d in (1, 2, 3)]
    assert rows(rolling_totals(events, known, "o", "day", "q", date(2025, 1, 1), date(2025, 1, 3), (2,), [date(2025, 1, 2), date(2031, 1, 1)])) == [("a", date(2025, 1, 2), 3, 1.5), ("b", date(2025, 1, 2), 0, 0.0)]
    assert rolling_totals(events, known, "o", "day", "q", date(2025, 1, 1), date(2025, 1, 3), (2,), []).count() == 0
    far = rolling_totals(events, known, "o", "day", "q", date(2024, 1, 1), date(2025, 12, 31), (2,), [date(2024, 1, 1) + timedelta(days=2 * i) for i in range(365)])
    assert far.count() == 730 and rows(far.where("total_2 > 0").select("day", "total_2")) == [(date(2025, 1, 1), 5), (date(2025, 1, 3), 3)]
    assert rolling_totals(events, known.limit(0), "o", "day", "q", date(2025, 1, 1), date(2025, 1, 3)).count() == 0


def test_feature_table_with_a_heavy_entity(spark):
    data = [("hot", "x", date(2025, 1, 1 + i % 20), i, f"l{i}") for i in range(500)] + [("b", "y", None, None, None), ("b", "unlisted", date(2025, 1, 5), 7, "m"), (None, "x", None, 1, "n"), ("b", None, None, 2, "o")]
    events = spark.createDataFrame(data, "e string, k string, d date, v long, id string")
    out = feature_table(events, spark.createDataFrame([("silent",), ("b",), (None,)], "e string"), ["x", "y", "other"], "e", "k", "d", "v", "id", date(2025, 1, 31), salts=4)
    got = {r.e: r.asDict() for r in out.collect()}
    assert set(got) == {"hot", "b", "silent"}
    assert (got["hot"]["n"], got["hot"]["days"], got["hot"]["total"], got["hot"]["n_x"], got["hot"]["days_x"], got["hot"]["total_x"]) == (500, 11, sum(range(500)), 500, 11, sum(range(500)))
    assert (got["b"]["n"], got["b"]["days"], got["b"]["total"], got["b"]["n_y"], got["b"]["days_y"], got["b"]["total_y"]) == (3, 26, 9, 1, None, 0)
    assert (got["silent"]["n"], got["silent"]["days"], got["silent"]["n_x"], got["silent"]["n_other"]) == (0, None, 0, 0)


def test_feature_table_of_empty_tables(spark):
    events = spark.createDataFrame([], "e string, k string, d date, v long, id string")
    assert feature_table(events, spark.createDataFrame([], "e string"), ["x"], "e", "k", "d", "v", "id", date(2025, 1, 31)).count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(30_000).selectExpr("if(id % 3 = 0, 'a', 'b') target", "cast(id as string) key").unionByName(spark.createDataFrame([("few", "x")], "target string, key string"))
    filt = bloom_filter(keys).cache()
    assert {r.target: r.segments for r in filt.select("target", "segments").distinct().collect()} == {"a": 1, "b": 2, "few": 1}
    assert filt.where("size(words) <> 2048").count() == 0 and filt.count() == 4
    assert probed(keys, filt).where("NOT __maybe").count() == 0
    others = spark.range(30_000).selectExpr("if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'none')) target", "concat('x', id) key", "id")
    out = probed(others, filt)
    assert out.columns == ["target", "key", "id", "__maybe"] and out.where("__maybe").count() < 300 and out.where("target = 'none' AND __maybe").count() == 0 and out.count() == 30_000


def test_orphans_are_missing_early_or_deleted(spark):
    parents = [("t", "A", 10, 100), ("t", "A", 5, 200), ("t", "B", 1, None), ("u", "A", 1, None), ("t", None, 1, None), ("t", "C", None, None)]
    refs = [("t", "A", 4, "early"), ("t", "A", 5, None), ("t", "A", 100, "deleted"), ("t", "B", 0, "early"), ("t", "X", 7, "missing"), ("u", "B", 7, "missing"), ("t", None, 7, None), ("t", "", 7, "missing"), ("t", "A", None, None), ("t", "C", 3, None), ("t", "A", 4, "early")]
    asked = spark.createDataFrame([(*r[:3], i, "mine") for i, r in enumerate(refs)], "target string, key string, made_at long, i int, reason string")
    known = spark.createDataFrame(parents, "target string, key string, known_from long, known_until long")
    want = sorted((i, r[3]) for i, r in enumerate(refs) if r[3])
    out = find_orphans(asked, known)
    assert out.columns == ["target", "key", "made_at", "i", "reason"] and sorted((r.i, r.reason) for r in out.collect()) == want
    assert find_orphans(asked.limit(0), known).count() == 0
    assert {r.reason for r in find_orphans(asked, known.limit(0)).collect()} == {"missing"}


def test_orphans_by_shuffled_join_are_the_same(spark, monkeypatch):
    from tallyloom import session
    from tallyloom.operators import orphans

    known = spark.range(50).selectExpr("'t' target", "concat('k', id) key", "id known_from", "id + 100 known_until")
    asked = spark.range(4000).selectExpr("'t' target", "concat('k', if(id % 3 = 0, 7, id % 60)) key", "id % 200 made_at", "id")
    a = rows(find_orphans(asked, known))
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", 0)
    assert rows(find_orphans(asked, known)) == a and len(a) > 1000
    monkeypatch.setattr(session, "small", lambda df, *_: df)
    assert rows(find_orphans(asked, known)) == a
    monkeypatch.setattr(session, "KEY_ROWS", 30)  # hot keys are met in many places
    assert rows(find_orphans(asked, known)) == a
    assert find_orphans(asked.limit(0), known).count() == 0 and find_orphans(asked, known.limit(0)).count() == 4000


def test_hot_keys_are_met_in_many_places(spark, monkeypatch):
    from tallyloom import session

    events = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 40)) k", "id").unionByName(spark.createDataFrame([(None, -1), ("absent", -2)], "k string, id long"))
    table = session.written(spark.range(40).selectExpr("concat('k', id) k", "id v").unionByName(spark.createDataFrame([("hot", 99), ("idle", 5)], "k string, v long")), "table")
    want = {how: rows(events.join(table, ["k"], how)) for how in ("inner", "left")}
    monkeypatch.setattr(session, "small", lambda df, *_: df)
    for how in want:
        assert rows(session.looked_up(events, table, ["k"], how, 100)) == want[how] and rows(session.looked_up(events, table, ["k"], how)) == want[how]


def test_a_kept_table_is_made_again_when_it_is_gone(spark):
    from tallyloom import session

    made = []
    make = lambda: made.append(1) or spark.range(5)
    assert session.written_once(spark, "kept", "folder", make).count() == session.written_once(spark, "kept", "folder", make).count() == 5 and len(made) == 1
    (path, files), there = session._hadoop_path(spark, session._kept[spark.sparkContext.applicationId, "kept", "folder"][0])
    assert there and files.delete(path, True)
    assert session.written_once(spark, "kept", "folder", make).count() == 5 and len(made) == 2


def test_measured_bytes_and_broadcasts(spark):
    from tallyloom import session

    df = spark.createDataFrame([("abc", 1, ["x", "yy"]), (None, 2, None)], "s string, i int, a array<string>")
    assert 60 < session.measured(df) < 200 and session.measured(df.limit(0)) == 0
    assert session.small(df) is not df and session.small(df, 10) is df
