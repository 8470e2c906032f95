import pytest
from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.operators import evidence, questions
from tallyloom.sources import files


def test_skus_named_takes_the_longest_names(spark):
    skus = spark.createDataFrame([(1, "Mint Line"), (2, "Mint Line 200ml"), (3, "line 200ML"), (4, "Mint"), (5, None), (6, " ")], "sku_id int, sku_name string")
    q = spark.createDataFrame([("a", "Why did MINT-LINE 200ml fall?"), ("b", "mint, line"), ("c", "minty lines"), ("d", None), ("e", "")], "question_id string, question string")
    got = sorted(map(tuple, questions.skus_named(q, skus).collect()))
    assert got == [("a", 2), ("b", 1)]
    assert questions.skus_named(q, skus.limit(0)).count() == 0 and questions.skus_named(q.limit(0), skus).count() == 0


def test_many_sku_names_meet_without_a_broadcast(spark, monkeypatch):
    skus = spark.range(300).select(F.col("id").alias("sku_id"), F.concat(F.lit("Mint Line #"), F.col("id")).alias("sku_name"))
    q = skus.select(F.col("sku_id").alias("question_id"), F.concat(F.lit("Why did "), "sku_name", F.lit(" fall, and what comes next?")).alias("question"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    got = questions.skus_named(q, skus)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(300)]
    assert "Broadcast" not in plan(got) and "SortMergeJoin" in plan(got)
    monkeypatch.undo()
    few = questions.skus_named(q, skus)  # few names are broadcast, the questions' runs of words never
    assert sorted(map(tuple, few.collect())) == [(i, i) for i in range(300)] and "BuildRight" in plan(few)


def test_context_keeps_the_first_of_equal_records(spark):
    a = spark.createDataFrame([("q", "1", "one"), ("q", "2", None)], "question_id string, id string, text string")
    b = spark.createDataFrame([("q", "1", "again"), ("q", "2", "two"), ("p", "1", "x")], "question_id string, id string, text string")
    got = sorted(map(tuple, evidence.context("question_id", {"sources": a, "glossary": b}).collect()))
    assert got == [("p", "glossary", "1", "x"), ("q", "glossary", "2", "two"), ("q", "sources", "1", "one")]


def test_labels(spark):
    one = spark.range(1)
    row = one.select(
        evidence.year_label(F.lit("2025"), F.lit(12)).alias("a"), evidence.year_label(F.lit("2025"), F.lit(1)).alias("b"), evidence.range_label(F.lit("2025-03"), F.lit("2026-05")).alias("c"),
        evidence.range_label(F.lit("2025-03"), F.lit("2025-03")).alias("d"), evidence.source_id(F.lit("Tamil Nadu"), F.lit("May 2025")).alias("e"),
    ).first()
    assert tuple(row) == ("2025", "2025 (1 month)", "March 2025 to May 2026", "March 2025", "sku-Tamil_Nadu-May_2025")


def test_subsets_previews_indexes_and_status(spark, tmp_path):
    docs = spark.createDataFrame([("a.txt", "S", "2025-01", "one\ntwo"), ("b.txt", "T", "2025-01", "three")], "doc_id string, state_name string, month string, text string")
    files.write_document_subset(docs, f"{tmp_path}/sub", docs.where("state_name = 'T'"))
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/sub/documents").collect()] == ["b.txt"]
    files.write_text_files(docs, f"{tmp_path}/all")
    assert {r.doc_id: r.value for r in spark.read.text(f"{tmp_path}/all/texts", wholetext=True).collect()} == {"a.txt": "one\ntwo\n", "b.txt": "three\n"}
    files.write_preview(spark.range(200), f"{tmp_path}/preview")
    assert spark.read.option("header", True).csv(f"{tmp_path}/preview").count() == 50
    files.write_tables({n: spark.range(3) for n in files.INDEX_TABLES}, f"{tmp_path}/index")
    assert list(files.read_index(spark, f"{tmp_path}/index")) == files.INDEX_TABLES and files.read_preview(spark, f"{tmp_path}/index", "entities", 2).count() == 2
    assert files.read_preview(spark, f"{tmp_path}/index", "nothing") is None
    with pytest.raises(FileNotFoundError):
        files.read_index(spark, f"{tmp_path}/nowhere")
    bad = spark.createDataFrame([("c", "low"), ("d", "high")], "`check` string, severity string")
    assert files.write_violations(bad, f"{tmp_path}/v") == 1 and files.write_violations(bad.where("severity = 'low'"), f"{tmp_path}/v") == 0
    lost = files.missing_tables(spark, f"{tmp_path}/index", ["entities", "claims"]).collect()
    assert [(r.subject, r.severity) for r in lost] == [("claims", "critical")]


def test_kpi_tables_survive_csv(spark, tmp_path):
    from tallyloom.operators import kpi
    from tallyloom.sources.warehouse import Warehouse

    tables = kpi.all_tables(Warehouse(spark, "/root/testdata/sf0.001"))
    assert list(tables) == list(files.KPI_SCHEMAS)
    files.write_tables(tables, str(tmp_path), "csv")
    back = files.read_kpi_tables(spark, str(tmp_path))
    for n, df in tables.items():
        assert set(df.columns) == set(back[n].columns)
        cols = [c for c in df.columns if c != "sku_name"]
        want = sorted((tuple(str(r[c]) for c in cols) for r in df.select(back[n].columns).collect()))
        assert sorted((tuple(str(float(r[c]) if isinstance(r[c], float) else r[c]) for c in cols) for r in back[n].collect())) == want or n == "", n


def test_token_chunks_against_a_round_trip(spark):
    from tallyloom.functions.tokens import TOKENIZER, encoding, token_chunks

    e, texts = encoding(TOKENIZER), {1: "Depot 4 is shut. " * 40, 2: "x", 3: None, 4: " \n", 5: "नमस्ते दुनिया " * 9}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size, overlap in ((50, 10), (7, 0), (5000, 100)):
        got = {}
        for r in sorted(token_chunks(docs, size, overlap).collect()):
            got.setdefault(r.doc_id, []).append(r)
        assert set(got) == {1, 2, 5}
        for i, rs in got.items():
            ids = e.encode_ordinary(texts[i])
            assert [r.n_tokens for r in rs[:-1]] == [size] * (len(rs) - 1) and sum(r.n_tokens for r in rs) - overlap * (len(rs) - 1) == len(ids)
            assert [r.text for r in rs] == [e.decode(ids[k * (size - overlap) : k * (size - overlap) + size]) for k in range(len(rs))]
