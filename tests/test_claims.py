from pyspark.sql import functions as F

from tallyloom.operators import claims
from tallyloom.operators.grounding import figures_in, sentences_of


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_text_functions(spark):
    assert values(spark, ["It fell", "Done. ", 'He said "yes."', "", "Who?)", None], claims.with_terminal) == ["It fell.", "Done.", 'He said "yes."', "", "Who?)", None]
    assert values(spark, ["  Mint-Line  200ML*4 ", None], claims.sku_text) == ["mint line 200ml 4", None]
    assert values(spark, ["Sources", "SKU Facts (4)"], claims.dataset_name) == ["sources", "skufacts"]
    assert values(spark, ["A cat, a CAT; cats", "a.b axb a.b"], lambda t: claims.word_count(t, F.lit("cat"))) == [2, 0]
    assert values(spark, ["a.b axb a.b"], lambda t: claims.word_count(t, F.lit("a.b"))) == [2]
    assert values(spark, ["It rose [Data: Sources (1, 2); Reports (3)] and fell [Data: 9].", "none"], claims.citation_tags) == [["Sources (1, 2); Reports (3)", "9"], []]
    assert values(spark, ["It rose [Data: Sources (1)] fast."], claims.without_tags) == ["It rose fast."]
    got = values(spark, ["Sources (1, 2, +more); SKU Facts (a-3)", "7, 8", ""], claims.cited_records)
    assert [[tuple(x) for x in g] for g in got] == [[("sources", "1"), ("sources", "2"), ("skufacts", "a-3")], [("sources", "7"), ("sources", "8")], []]
    assert values(spark, ["various distributors", "Several zones ", "Bihar", "many"], claims.group_noun) == ["distributors", "zones", None, None]
    assert values(spark, ["categories", "zones"], claims.singular) == ["category", "zone"]
    assert values(spark, ["It fell because of rain.", "There is no evidence it was caused by rain.", "It fell."], claims.is_cause) == [True, False, False]
    assert values(spark, ["A dramatically WEAKER, weak month; strongly up", ""], claims.qualitative_terms) == [["strongly", "weak"], []]
    assert values(spark, ["NATION_20 sold 20.5, 1,234 and -3 of v2.5; 2024-11", "no.5"], figures_in) == [[20.5, 1234.0, -3.0, 2024.0, 11.0], [5.0]]
    assert values(spark, ["A vs. B. C?\n\nD! e"], sentences_of) == [["A vs. B.", "C?", "D!", "e"]]


def test_a_name_within_a_longer_one_is_not_named(spark):
    assert values(spark, ["NATION_22 fell", "nation_2 fell", "a (NATION_2)", "NATION_2_b"], lambda t: claims.names(t, F.lit("NATION_2"))) == [False, True, True, True]
    known = F.array(*map(F.lit, ["Alpha Trading", "Beta Sons", "Alpha", "xy"]))
    assert values(spark, ["Alpha Trading, Beta Sons Co", "Alpha Trading", "Beta Sons xy"], lambda t: claims.fused_names(t, known)) == ["Alpha Trading, Beta Sons", None, None]


def one_claim(spark, **fields):
    kinds = {"value": "double", "comparison_value": "double", "delta": "double", "citations": "array<string>"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in claims.FIELDS.split(", "))
    return spark.createDataFrame([tuple({"claim_id": "c", "citations": ["Sources (d)"], **fields}.get(n) for n in claims.FIELDS.split(", "))], schema)


def test_rules_of_claims(spark):
    text = "Distributor Alpha was off on Productivity in ASIA, May 2025: 40.1% against a state value of 52.0%, a gap of 11.9. Category Mint in ASIA, May 2025: ACV was 12.5%. Sales were strong because of rain."
    evidence = claims.evidence_index({"sources": spark.createDataFrame([("d", text), ("e", None)], "id string, text string")})

    def issues(**fields):
        return sorted(r.issue_type for r in claims.validate_claims(one_claim(spark, **fields), evidence, ["ASIA"], ["Mint"]).collect())

    assert issues(entity="Alpha", metric="Productivity", value=40.1, comparison_value=52.0, period="May 2025", delta=11.9) == []
    assert issues(entity="ASIA Mint", metric="ACV", value=12.5) == [] and issues(entity="ASIA Mint Category", metric="Productivity", value=12.5) == ["not_one_fact"]
    assert issues(entity="Beta", value=40.1) == ["not_one_fact", "unsupported_entity"] and issues(value=41.0) == ["unsupported_numeric"]
    assert issues(entity="several distributors") == ["unsupported_entity"]
    assert issues(value=40.1, comparison_value=52.0, period="May 2025", comparison_period="May 2025", direction="rose") == ["direction_mismatch"]
    assert issues(claim_text="It rose.", value=40.1, comparison_value=52.0) == ["direction_in_text"] and issues(claim_text="It should rise.", value=40.1, comparison_value=52.0) == []
    assert issues(claim_text="A weak, strong month because of snow") == ["unsupported_qualifier"]
    assert issues(comparison_entity="Gamma", period="June 2025") == ["unsupported_comparison_entity", "unsupported_period"]
    assert issues(citations=["Sources (zz)"], value=1.0) == ["unresolved_citation"] and issues(citations=[]) == ["unresolved_citation"]


def test_scans_of_answers_with_no_rows(spark):
    answers = spark.createDataFrame([], "answer_id string, text string")
    s = claims.answer_sentences(answers)
    evidence = claims.evidence_index({"sources": spark.createDataFrame([], "id string, text string")})
    facts = spark.createDataFrame([], "answer_id string, entity string, values array<double>")
    assert claims.scan_numbers(s, facts).count() == 0 and claims.scan_language(s, evidence).count() == 0


def test_numbers_go_to_the_nearest_name_before_them(spark):
    answers = spark.createDataFrame([("a", "In May 2025 Alpha had 5 and Alpha Two 6.5. It then fell to 7. [Data: Sources (1)] Nobody saw 9.")], "answer_id string, text string")
    names = spark.createDataFrame([("a", "Alpha"), ("a", "Alpha Two"), ("a", "Gone")], "answer_id string, entity string")
    s = claims.answer_sentences(answers)
    got = sorted((r.pos, r.number, r.entity) for r in claims.entity_numbers(s, names).collect())
    assert [(n, e) for _, n, e in got] == [(5.0, "Alpha"), (6.5, "Alpha Two"), (7.0, "Alpha Two"), (9.0, "Alpha Two")]
