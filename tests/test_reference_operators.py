import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.keys import clean_key, fold_title, month_words, words_month
from tallyloom.operators import documents, graph, grounding, questions, rollup, vectors
from tallyloom.sources import files
from tallyloom.sources.tables import lines_once
from tallyloom.streaming.incremental import running_outlet_totals


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(c.alias("x")).first().x


def test_keys_and_months(spark):
    df = spark.createDataFrame([(" \tab ",), ("  ",), (None,)], "k string")
    assert [r.x for r in df.select(clean_key("k").alias("x")).collect()] == ["AB", None, None]
    assert one(spark, fold_title("t"), t=" a__b \n c_") == "A B C" and one(spark, fold_title("t"), t="_ ") is None
    assert one(spark, month_words("m"), m="2024-08") == "August 2024" and one(spark, words_month("m"), m="August 2024") == "2024-08"
    assert one(spark, words_month("m"), m="Q3 2025") is None and one(spark, month_words("m"), m="x") is None


def test_lines_sent_again_count_once(spark):
    df = spark.createDataFrame([("l1", 1, "a", 5), ("l1", 2, "A ", 5), (None, 1, "b", 7), (None, 1, "b", 7), ("l2", None, None, None)], "line_id string, loaded_at int, sku string, q int")
    assert rows(lines_once(df, sku=clean_key("sku"), q=F.col("q"))) == [("l1", "A", 5), ("l2", None, None), (None, "B", 7), (None, "B", 7)]


def test_tier_ranks_with_ties(spark):
    df = spark.createDataFrame([("g", 5.0, i) for i in range(10)] + [("h", None, 1)], "g string, s double, i int")
    out = rollup.rank_fraction(df, "g", "s", "i").withColumn("t", rollup.tier_by_rank(F.col("rank_pct")))
    assert [r.t for r in out.where("g = 'g'").orderBy("i").collect()] == ["Gold"] * 2 + ["Silver"] * 3 + ["Bronze"] * 5
    assert out.where("g = 'h'").first().rank_pct == 1.0


def test_previous_month_needs_the_calendar_neighbour(spark):
    df = spark.createDataFrame([("s", "2024-12", 1.0), ("s", "2025-01", 2.0), ("s", "2025-03", 1.0), ("t", "2025-01", 5.0)], "s string, month string, v double")
    out = {(r.s, r.month): (r.previous, r.direction) for r in rollup.against_previous_month(df, ["s"], ["v"]).collect()}
    assert out == {("s", "2024-12"): (None, None), ("s", "2025-01"): (1.0, "up"), ("s", "2025-03"): (None, None), ("t", "2025-01"): (None, None)}


def test_a_gap_of_exactly_the_limit_is_no_deviation(spark):
    m = spark.createDataFrame([(1, "s", 0.25, 90.0), (2, "s", 0.24, 80.0), (3, "s", None, None), (4, "s", 0.9, 111.0)], "w int, s string, p double, d double")
    peers = spark.createDataFrame([("s", 0.35, 100.0)], "s string, p double, d double")
    out = rollup.deviations(m, peers, ["s"], {"p": "lower", "d": "both"})
    assert sorted((r.w, r.metric, r.gap) for r in out.collect()) == [(2, "d", 20.0), (2, "p", 11.0), (4, "d", 11.0)]


def test_super_groups_and_pivot(spark):
    df = spark.createDataFrame([("a", "k", 1.0), ("b", "k", 2.0), ("c", "l", 4.0)], "c string, k string, v double")
    assert rows(rollup.with_super_group(df, "c", {"AB": ["a", "b"]}).groupBy("c").agg(F.sum("v"))) == [("AB", 3.0), ("a", 1.0), ("b", 2.0), ("c", 4.0)]
    assert rows(rollup.pivot_sum(df, ["k"], "c", ["a", "c"], "v", missing=0.0)) == [("k", 1.0, 0.0), ("l", 0.0, 4.0)]


def test_documents_come_back_as_facts(spark):
    s = spark.createDataFrame([("NEW X", "2025-03", 0.4625, 0.5, 2.345, 1234.5, 1.0, None)], "state_name string, month string, productivity double, service_level double, skus_per_transaction double, dropsize double, inventory_turns double, inventory_days double")
    c = spark.createDataFrame([("NEW X", "2025-03", "TEA", 0.1, 0.2, None, 0.05)], "state_name string, month string, category_name string, numeric_distribution double, acv double, range_billing double, oos_pct double")
    d = spark.createDataFrame([("NEW X", "2025-03", 7, "DIS & CO", "productivity", 0.3, 0.4625, 16.25)], "state_name string, month string, wd_id int, wd_name string, metric string, value double, peer_value double, gap double")
    docs = documents.render(s, c, d)
    assert docs.first().doc_id == "NEW_X_2025-03.txt" and "nan" not in docs.first().text.lower()
    assert {r.metric: r.value for r in documents.state_facts(docs).collect()} == {"productivity": 46.3, "service_level": 50.0, "skus_per_transaction": 2.35, "dropsize": 1234.5, "inventory_turns": 1.0}
    assert {(r.category_name, r.metric): r.value for r in documents.category_facts(docs).collect()} == {("TEA", "numeric_distribution"): 10.0, ("TEA", "acv"): 20.0, ("TEA", "oos_pct"): 5.0}
    assert rows(documents.deviation_facts(docs).drop("doc_id")) == [("DIS & CO", "Productivity", 30.0, 46.3, 16.3)]
    headless = docs.withColumn("text", F.regexp_replace("text", r"(?s)^.*?(?=Category)", ""))
    assert documents.category_facts(headless).count() == 3 and documents.state_facts(headless).count() == 0


@pytest.mark.parametrize(
    "question, want",
    [
        ("Why did Productivity decline in Middle East in March 2025?", ("Middle East", "March 2025", None, "Productivity", "down", None, None, "local")),
        ("Top 3 SKUs by revenue in Asia during 2024, or 2025?", ("Asia", "", 2025, "Revenue", "neutral", 3, "highest", "local")),
        ("Compare January and March 2026 in Asia and East", ("Asia", "January 2026, March 2026", None, None, "neutral", None, None, "global")),
        ("Did it rise or fall? best and worst", (None, "", None, None, "neutral", None, None, "basic")),
        ("lowest dropsize across all states", (None, "", None, "Dropsize", "neutral", None, "lowest", "global")),
    ],
)
def test_questions(spark, question, want):
    r = questions.requirements(spark.createDataFrame([(question,)], "question string"), ["Asia", "East", "Middle East"]).first()
    assert (r.state_name, r.periods, r.target_year, r.metric, r.direction, r.rank_n, r.rank_direction, r.intent) == want


def test_claims_against_evidence(spark):
    ev = spark.createDataFrame([("d1", "Service Level was 50.0%. Dropsize was 1,234.5 vs. 9."), ("d2", None)], "id string, text string")
    claims = [("a", "d1", "Service Level", 50.04), ("b", "d1", "Service Level", 1234.5), ("c", "d1", "Dropsize", 77.0), ("d", "nowhere", "Dropsize", 9.0), ("e", None, "Dropsize", 9.0), ("f", "d2", "Dropsize", 9.0), ("g", "d1", "Dropsize", None)]
    c = spark.createDataFrame([(*x, x[0] in "ab") for x in claims], "claim_id string, citation string, metric_label string, value double, answer boolean")
    checked = grounding.supported_claims(c, ev)
    assert dict(rows(grounding.issues(checked).select("claim_id", "issue_type"))) == {"b": "not_in_one_sentence", "c": "value_not_in_evidence", "d": "unresolved_citation", "e": "unresolved_citation", "f": "unresolved_citation", "g": "value_not_in_evidence"}
    assert rows(grounding.verdicts(c, grounding.issues(checked), "answer").select("answer", "n_errors", "status")) == [(False, 5, "fail"), (True, 1, "fail")]


def test_text_helpers(spark):
    assert one(spark, grounding.numbers_in(F.col("t")), t="-3 and 1,234.5%, v2") == [-3.0, 1234.5, 2.0]
    assert one(spark, grounding.sentences_of(F.col("t")), t="A vs. B. C!  D\n\nE") == ["A vs. B.", "C!", "D", "E"]
    assert one(spark, grounding.direction_word(F.col("t")), t="It fell") == "down" and one(spark, grounding.direction_word(F.col("t")), t="It fell and rose") is None


def test_extremes_and_coverage(spark):
    f = spark.createDataFrame([("g", "a", 5.0), ("g", "b", 4.97), ("g", "c", 1.0)], "g string, i string, v double")
    assert rows(grounding.extreme_claims(f.select("g", "i"), f, ["g"], "i", "v").select("i", "holds")) == [("a", True), ("b", True), ("c", False)]
    assert rows(grounding.coverage(f.where("i = 'b'").select("g", "i"), f, ["g"], "i")) == [("g", 1, 3, "a, c")]


GRAPH_ENTITIES = "id string, human_readable_id long, title string, type string, description string, text_unit_ids array<string>, frequency long, degree long"


def test_graph_checks_and_merge(spark):
    e = spark.createDataFrame(
        [("e1", 2, "Gold_1", "FRANCHISE", "x", ["u1", "u2"], 1, 1), ("e2", 1, "GOLD 1", "FRANCHISE", "y", ["u2", "u9"], 1, 1), ("e2", 1, "GOLD 1", "FRANCHISE", "y", ["u2", "u9"], 1, 1), ("e3", None, "Zed", "zone ", None, None, 1, 1), ("e4", 3, None, "STATE", "", [], 1, 1)],
        GRAPH_ENTITIES,
    )
    r = spark.createDataFrame([("r1", 5, "gold 1", "zed", 1.0), ("r2", 4, "Gold_1", "ZED", 2.0), ("r2", 4, "Gold_1", "ZED", 2.0), ("r3", 6, None, "zed", 1.0), ("r4", 7, "nobody", "Gold 1", None)], "id string, human_readable_id long, source string, target string, weight double")
    units = spark.createDataFrame([("u1",), ("u2",)], "id string")
    assert rows(graph.list_orphans(e, "entities", "text_unit_ids", units).select("subject", "detail")) == [("e2", "entities.text_unit_ids: u9")]
    assert rows(graph.dangling_edges(r, e).select("subject", "detail")) == [("r3", "source"), ("r4", "source")]
    assert rows(graph.forbidden_types(e).select("subject")) == [("e3",)]
    assert rows(graph.vocabulary(e, spark.createDataFrame([("FRANCHISE", "Gold 2")], "kind string, term string"), "FRANCHISE").select("check", "subject")) == [("franchise_duplicate", "GOLD 1"), ("franchise_unknown", "e1"), ("franchise_unknown", "e2")]
    m = graph.merge_entities(e)
    assert rows(m.select("id", "title", "description", "text_unit_ids", "frequency")) == [("e2", "GOLD 1", "y | x", ["u2", "u9", "u1"], 3), ("e3", "ZED", "", [], 0)]
    assert rows(graph.merge_entities(m.withColumn("type", F.lit("x"))).select(m.columns)) == rows(m)  # a second pass changes nothing
    assert rows(graph.remap_relationships(r)) == [("GOLD 1", "ZED", "r2", 4, 1.5, 2), ("NOBODY", "GOLD 1", "r4", 7, None, 2)]
    assert rows(graph.schema_violations({"entities": e.drop("degree")}).where("subject = 'entities'").select("detail")) == [("lacks degree",)]


def test_collapsed_edges_keep_texts_and_units_and_lists_are_remapped(spark):
    r = spark.createDataFrame(
        [("r1", 5, "gold 1", "zed", "x", ["u1", "u2"]), ("r2", 4, "Gold_1", "ZED", " y ", ["u2", "u9"]), ("r2", 4, "Gold_1", "ZED", "y", None), ("r3", None, "gold 1", "zed", None, [None, "u0"]), ("r4", 1, None, "zed", "lost", ["u5"])],
        "id string, human_readable_id long, source string, target string, description string, text_unit_ids array<string>",
    )
    edges = graph.folded_edges(r)
    texts, units = graph.merged_texts(edges, ["source", "target"]), graph.merged_units(edges, ["source", "target"])
    assert [tuple(x) for x in texts.orderBy("first").select("source", "target", "description").collect()] == [("GOLD 1", "ZED", "y"), ("GOLD 1", "ZED", "x")]
    assert [x.unit for x in units.orderBy("first").collect()] == ["u2", "u9", "u1", "u0"]
    lists = spark.createDataFrame([("t1", ["b", "a", "c", "b"]), ("t2", []), ("t3", ["c", "a"])], "id string, entity_ids array<string>")
    mapping = spark.createDataFrame([("a", "b"), ("b", "b")], "id string, survivor string")
    assert [tuple(x) for x in graph.remap_list(lists, "id", "entity_ids", mapping).orderBy("key", "at").select("key", "ref").collect()] == [("t1", "b"), ("t1", "c"), ("t3", "c"), ("t3", "b")]


def test_merging_gathers_no_copies_of_a_title(spark):
    from tallyloom.plans import graph_queries

    class Tables:
        entities = spark.range(3000).select(F.concat(F.lit("e"), "id").alias("id"), (F.col("id") + 1).alias("human_readable_id"), F.lit("Gold_1").alias("title"), F.lit("x").alias("description"), F.array(F.concat(F.lit("u"), F.col("id") % 700)).alias("text_unit_ids"))

    for q in (graph_queries.gc_01_merge, graph_queries.gc_03_list_remap):
        df = getattr(q, "__wrapped__", q)(Tables)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "collect_list" not in plan
        if q is graph_queries.gc_01_merge:
            assert rows(df) == [("e0", 1, "GOLD 1", 700)]
    long = graph.merged_units(Tables.entities, ["title"])
    assert long.count() == 700 and [r.unit for r in long.orderBy("first").limit(3).collect()] == ["u0", "u1", "u2"]
    assert [tuple(r)[:2] for r in graph.merged_texts(Tables.entities, ["title"]).collect()] == [("Gold_1", "x")]


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for _ in range(90)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(200)] + [("hub", f"x{i}") for i in range(100)] + [(None, "x1"), ("solo", "solo")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    out = graph.components(spark.createDataFrame(edges, "source string, target string"))
    assert dict(rows(out)) == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "source string, target string")).count() == 0


@pytest.mark.parametrize("block", [2000, 3])
def test_nearest_against_brute_force(spark, block):
    m = np.random.default_rng(3).normal(size=(60, 5))
    m[7] = m[8] = m[9]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(98, None), (99, [0.0] * 5)], "vec_id long, embedding array<double>").repartition(4)
    out = vectors.nearest(df, df.where("vec_id % 10 = 0 OR vec_id = 9"), 5, block)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in [*range(0, 60, 10), 9]:
        s = np.round(u @ u[q], 6)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [r.vec_id for r in out.where(F.col("query_id") == q).orderBy("place").collect()] == want


def test_chunks(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, " \n"), (3, None), (4, "a  b")], "doc_id long, text string")
    out = {(r.doc_id, r.chunk_no): r.text.split() for r in vectors.word_chunks(df, 10, 2).collect()}
    assert [out[1, i][0] for i in range(3)] == ["0", "8", "16"] and out[1, 2][-1] == "24" and out[4, 0] == ["a", "b"] and len(out) == 4


def test_files_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("s1", 'a "b", c', None, "x", "y", 1.5, date(2024, 1, 2), True)], files.CSV_SCHEMAS["products"])
    files.write_csv(p, f"{tmp_path}/products.csv")
    back = files.read_csv_tables(spark, str(tmp_path), ["products"])["products"]
    assert rows(back) == rows(p) and back.schema == p.schema
    files.write_tables({"a": p}, str(tmp_path), "json")
    assert spark.read.json(f"{tmp_path}/a").count() == 1
    there = files.read_table_if_there(spark, str(tmp_path), "nothing", "x int")
    assert there[1] is False and there[0].count() == 0
    docs = spark.createDataFrame([("A_2025-01.txt", "A", "2025-01", "State: A\nPeriod: January 2025\n\nx")], "doc_id string, state_name string, month string, text string")
    files.write_documents(docs, f"{tmp_path}/docs")
    assert spark.read.parquet(f"{tmp_path}/docs/documents").where("month = '2025-01'").first().doc_id == "A_2025-01.txt"
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "A_2025-01.txt").write_text("State: A\nPeriod: January 2025\n\nx")
    assert rows(files.read_text_documents(spark, f"{tmp_path}/texts").drop("text")) == [("A_2025-01.txt", "A", "January 2025")]
    store = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert rows(files.upsert(store, spark.createDataFrame([(2, "B"), (4, "D")], "id int, v string"), "id", spark.createDataFrame([(3,)], "id int"))) == [(1, "a"), (2, "B"), (4, "D")]


def test_stream_over_many_files_equals_the_batch(spark, tmp_path):
    df = spark.range(1000).selectExpr("concat(if(id % 3 = 0, ' o', 'O'), id % 7, ' ') outlet_id", "id % 5 qty_delivered").unionByName(spark.createDataFrame([(None, 5), ("  ", 5)], "outlet_id string, qty_delivered long"))
    df.repartition(40).write.parquet(f"{tmp_path}/order_lines.parquet")
    want = df.select(clean_key("outlet_id").alias("o"), "qty_delivered").where("o IS NOT NULL").groupBy("o").agg(F.sum("qty_delivered"), F.count(F.lit(1)))
    assert rows(running_outlet_totals(spark, str(tmp_path))) == rows(want)


def test_communities_are_bounded_whole_and_nested(spark):
    edges = [("hub", f"n{i}", 1.0 + i % 3) for i in range(30)] + [("a", "b", 5.0), ("b", "c", None), ("c", "c", 1.0), ("loop", "loop", 1.0), (None, "x", 1.0), ("a", "b", 1.0), ("c", "n1", 0.5)]
    e = spark.createDataFrame(edges, "source string, target string, weight double")
    found = graph.communities(e, 4, 3).cache()
    assert [tuple(r)[2:] for r in graph.community_faults(found, e, 4).collect()] == [(0, 0, 0)] * found.select("level").distinct().count()
    first = {r.node: r.community for r in found.where("level = 0").collect()}
    assert set(first) == {x for s, t, _ in edges if s and t for x in (s, t)} and first["loop"] == "loop" and len(set(first.values())) < len(first)
    assert graph.communities(e.limit(0)).count() == 0
