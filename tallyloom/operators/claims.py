"""Claims of answers validated rule by rule against the evidence they cite, and answers scanned sentence by sentence for what no claim covers.

Every rule is a column; a claim's cited texts are flagged where they stand and only the flags are summed up per claim, so evidence is never gathered. Issues come out in long form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.grounding import NUMBER, TOLERANCE, direction_word, figures_in, mentions, sentences_of, stem, tokens, words_present

# Word lists ---------------------------------------------------------------------------------------------------------------------------------
#: Words that judge instead of stating a figure.
QUALITATIVE = (
    "strong weak robust poor excellent alarming impressive severe critical healthy sluggish remarkable worrying steady volatile dramatic sharp stable fragile outstanding disappointing solid mediocre exceptional significant".split()
)
#: What says that one thing brought about another, and what denies or leaves open that it did.
CAUSE = r"(?i)\b(because|due to|owing to|thanks to|caus(?:e|es|ed|ing)|driven by|leads? to|led to|result(?:s|ed|ing)? (?:in|from)|as a result of|attribut\w+ to|stem(?:s|med)? from|responsible for)\b"
NO_CAUSE = r"(?i)\b(no evidence|not? (?:\w+ )?cause|not (?:necessarily )?(?:caused|due|attributed)|coincidence|cannot be (?:attributed|established)|without (?:a |an )?(?:\w+ )?cause)\b"
#: What speaks of the future, or of what should be done.
AHEAD = r"(?i)\b(should|must|ought to|need(?:s)? to|will|would|could|recommend\w*|suggest\w*|going forward|in future|next (?:month|quarter|year)|from now on|consider|monitor|prioriti[sz]e)\b"
#: What explains a term.
DEFINES = r"(?i)\b(?:is|are) (?:defined as|calculated as|measured as|a measure of|the (?:share|ratio|number|percentage) of)\b|\bstands for\b|\brefers to\b"
#: Words that mark a stated deviation.
OFF = r"(?i)\b(deviat\w+|off on|a gap of)\b"
#: Abbreviations and what they don't stand for.
WRONG_EXPANSIONS = [("ACV", "average customer value"), ("ACV", "annual contract value"), ("OOS", "out of service"), ("SKU", "sales key unit"), ("WD", "warehouse depot")]
# --------------------------------------------------------------------------------------------------------------------------------------------
_GROUP = r"(?i)^(?:various|multiple|several|some|many|numerous|these|those|a number of)\s+([a-z]+s)$"
_TAG = r"\[Data:\s*([^\]]*)\]"
_OFF_NAMES = r"Distributor (.+?) was off on"


# Texts

def dataset_name(name: Column) -> Column:
    """The name of a cited data set in letters alone, lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def sku_text(text: Column) -> Column:
    """A SKU's name or a text that may name one, in one spelling: lower case, anything but letters and digits as one blank."""
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", " "))


def with_terminal(text: Column) -> Column:
    """The text, with a full stop where it ends without a terminator; closing quotes and brackets after one count. Blank texts stay empty."""
    t = F.regexp_replace(text, r"(?U)\s+$", "")
    return F.when((t == "") | t.rlike(r"""[.!?…][)\]"'”’»]*$"""), t).otherwise(F.concat(t, F.lit(".")))


def word_count(text: Column, word: Column) -> Column:
    """How often a word stands in a text as a word of its own, in any case."""
    return F.regexp_count(text, F.concat(F.lit(r"(?i)\b\Q"), word, F.lit(r"\E\b")))


def citation_tags(sentence: Column) -> Column:
    """What stands in the [Data: ...] tags of a sentence, in order."""
    return F.regexp_extract_all(sentence, F.lit(_TAG), F.lit(1))


def without_tags(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s*\[Data:[^\]]*\]", ""))


def cited_records(tag: Column) -> Column:
    """The records that a citation names, as an array of (dataset, id): 'Sources (3, 7); Reports (2)'. A bare id is one of sources; '+more' and blanks are none."""
    named = F.arrays_zip(F.regexp_extract_all(tag, F.lit(r"([A-Za-z][A-Za-z ]*?)\s*\(([^)]*)\)"), F.lit(1)).alias("d"), F.regexp_extract_all(tag, F.lit(r"([A-Za-z][A-Za-z ]*?)\s*\(([^)]*)\)"), F.lit(2)).alias("i"))
    ids = lambda s: F.filter(F.transform(F.split(s, ","), lambda x: F.btrim(x)), lambda x: (x != "") & ~x.startswith("+"))
    each = F.flatten(F.transform(named, lambda n: F.transform(ids(n["i"]), lambda x: F.struct(dataset_name(n["d"]).alias("dataset"), x.alias("id")))))
    bare = F.transform(ids(tag), lambda x: F.struct(F.lit("sources").alias("dataset"), x.alias("id")))
    return F.when(F.size(named) > 0, each).otherwise(bare)


def group_noun(entity: Column) -> Column:
    """The noun of a group that nobody is named of ('various distributors'), lower case; null for any other entity."""
    return F.lower(F.nullif(F.regexp_extract(F.btrim(entity), _GROUP, 1), F.lit("")))


def singular(noun: Column) -> Column:
    return F.when(noun.endswith("ies"), F.concat(F.substring(noun, F.lit(1), F.length(noun) - 3), F.lit("y"))).otherwise(F.substring(noun, F.lit(1), F.length(noun) - 1))


def qualitative_terms(text: Column) -> Column:
    """The judging words of a text, whatever their ending, distinct and in order."""
    stems = F.transform(F.array(*map(F.lit, QUALITATIVE)), stem)
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda w: F.array_contains(stems, stem(w)))))


def unsupported_terms(text: Column, evidence_stems: Column) -> Column:
    """Judging words of a text whose stems the evidence hasn't."""
    return F.filter(qualitative_terms(text), lambda w: ~F.array_contains(evidence_stems, stem(w)))


def is_cause(text: Column) -> Column:
    """Whether a text claims a cause and doesn't deny one."""
    return text.rlike(CAUSE) & ~text.rlike(NO_CAUSE)


def names(text: Column, term: Column) -> Column:
    """Whether a text names the term, in any case, not merely as part of a longer word or name."""
    return mentions(text, term) & F.rlike(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), term, F.lit(r"\E(?![A-Za-z0-9])")))


def off_names(text: Column) -> Column:
    """The distributors that a text says are off, as an array."""
    return F.regexp_extract_all(text, F.lit(_OFF_NAMES), F.lit(1))


def fused_names(entity: Column, known: Column) -> Column:
    """Distributors of an array that the entity holds, if it fuses two or more of them; a name within a longer one doesn't count. Else null."""
    held = F.filter(known, lambda k: (F.length(k) >= 4) & F.contains(entity, k))
    alone = F.filter(held, lambda k: ~F.exists(held, lambda x: (x != k) & F.contains(x, k)))
    return F.when(F.size(alone) >= 2, F.array_join(F.array_sort(alone), ", "))


def claim_type() -> Column:
    """The type of a claim: as given, or by its text and fields."""
    text = F.coalesce("claim_text", F.lit(""))
    return (
        F.when(F.col("claim_type").isNotNull(), F.col("claim_type")).when(text.rlike(CAUSE), "causal").when(F.col("comparison_entity").isNotNull(), "comparison")
        .when(F.col("entity").isNotNull() & text.rlike(OFF), "deviation").when(F.col("value").isNotNull() & F.col("comparison_value").isNotNull(), "trend")
        .when(F.size(qualitative_terms(text)) > 0, "qualitative").otherwise("factual_numeric")
    )


# Evidence

def evidence_index(sources: Mapping[str, DataFrame]) -> DataFrame:
    """dataset, id and text of all evidence: data frames (id, text) by the name of their data set."""
    frames = [d.select(F.lit(n).alias("dataset"), F.col("id").cast("string").alias("id"), "text") for n, d in sources.items()]
    return reduce(DataFrame.unionByName, frames)


def evidence_sentences(evidence: DataFrame) -> DataFrame:
    """dataset, id and each sentence of the evidence with what rules ask of it: its numbers, whether it states a deviation, a cause or a definition, the distributors it says are off, the stems of its judging words."""
    s = F.col("s")
    cut = evidence.select("dataset", "id", F.explode(sentences_of(F.col("text"))).alias("s"))
    return cut.select("dataset", "id", "s", figures_in(s).alias("numbers"), s.rlike(OFF).alias("off"), s.rlike(CAUSE).alias("cause"), s.rlike(DEFINES).alias("defines"), off_names(s).alias("off_names"), F.transform(qualitative_terms(s), stem).alias("stems"))


def citations_of(rows: DataFrame, key: str, citations: str) -> DataFrame:
    """key, dataset and id of each record that the citations of a row name."""
    return rows.select(key, F.explode(citations).alias("c")).select(key, F.explode(cited_records(F.col("c"))).alias("r")).select(key, "r.dataset", "r.id").distinct()


def near(numbers: Column, value: Column) -> Column:
    return F.exists(numbers, lambda x: F.abs(x - value) <= TOLERANCE + 1e-9)


# Claims

FIELDS = "claim_id, claim_text, claim_type, entity, metric, value, period, comparison_entity, comparison_value, comparison_period, direction, delta, citations"


def validate_claims(claims: DataFrame, evidence: DataFrame, states: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Issues of claims against the records they cite: claim_id, issue_type, term, severity; a claim without issues has no row.

    ``claims`` has the columns of FIELDS, claim_id being unique, citations a list such as 'Sources (3)'; ``evidence`` is an evidence_index. States and categories are bounded lists. A claim none of whose citations resolves
    gets just unresolved_citation: it fails closed. Else each rule looks at the records together: value and comparison value are stated; the entity is mentioned, or as '<State> <Category>' in both its parts, or as a
    group of which there are several (a warning), or it fuses several names; value, entity, metric and period stand in one sentence, and so does the comparison; periods are mentioned; direction and delta follow from
    the values; deviations are stated as such; causes and judging words are the evidence's own. Null fields ask for nothing.
    """
    named = lambda xs: "|".join(rf"\Q{x}\E" for x in sorted(xs, key=lambda x: (-len(x), x)))
    pattern = rf"(?i)^({named(states)}) ({named(categories)})(?: Category)?$"
    c = claims.withColumn("claim_type", claim_type()).withColumn("noun", group_noun(F.col("entity")))
    part = lambda i: F.nullif(F.regexp_extract("entity", pattern, i), F.lit(""))
    c = c.withColumn("p1", part(1)).withColumn("p2", part(2))
    met = c.join(citations_of(claims, "claim_id", "citations"), "claim_id").join(evidence_sentences(evidence), ["dataset", "id"])
    text, col = F.col("s"), F.col
    yes = lambda c: F.coalesce(c, F.lit(False))
    if_given = lambda c, test: F.when(c.isNotNull(), test).otherwise(F.lit(True))
    parts = yes(names(text, col("p1")) & names(text, col("p2")))
    other = F.coalesce("comparison_entity", "entity")
    has_metric = if_given(col("metric"), words_present(text, col("metric")))
    fact = near(col("numbers"), col("value")) & (if_given(col("entity"), names(text, col("entity"))) | parts) & has_metric & if_given(col("period"), mentions(text, col("period")))
    other_period = F.coalesce("comparison_period", "period")
    other_fact = near(col("numbers"), col("comparison_value")) & (if_given(other, names(text, other)) | (parts & col("comparison_entity").isNull())) & has_metric & if_given(other_period, mentions(text, other_period))
    flags = met.groupBy("claim_id").agg(
        F.bool_or(near(col("numbers"), col("value"))).alias("has_value"),
        F.bool_or(near(col("numbers"), col("comparison_value"))).alias("has_other_value"),
        F.bool_or(names(text, col("entity"))).alias("has_entity"),
        F.bool_or(names(text, col("p1"))).alias("has_p1"),
        F.bool_or(names(text, col("p2"))).alias("has_p2"),
        F.sum(word_count(text, col("noun")) + word_count(text, singular(col("noun")))).alias("n_noun"),
        F.array_distinct(F.flatten(F.collect_list(F.filter("off_names", lambda n: F.contains(col("entity"), n))))).alias("held"),  # names within the claim's own entity
        F.bool_or(fact).alias("has_fact"),
        F.bool_or(other_fact).alias("has_other_fact"),
        F.bool_or(names(text, col("comparison_entity"))).alias("has_other_entity"),
        F.bool_or(mentions(text, col("period"))).alias("has_period"),
        F.bool_or(mentions(text, col("comparison_period"))).alias("has_other_period"),
        F.bool_or("off").alias("has_off"),
        F.bool_or("cause").alias("has_cause"),
        F.array_distinct(F.flatten(F.collect_set("stems"))).alias("stems"),  # of a bounded word list
    )
    j = c.join(flags, "claim_id", "left").withColumn("fused", fused_names(F.col("entity"), F.col("held")))
    later = F.try_to_date("comparison_period", "MMMM yyyy") > F.try_to_date("period", "MMMM yyyy")
    change = F.when(later, col("comparison_value") - col("value")).otherwise(col("value") - col("comparison_value"))
    actual = F.when(change > 1e-9, "up").when(change < -1e-9, "down").when(change.isNotNull(), "flat")
    trend = col("claim_type").isin("trend", "comparison")
    gap = F.when(col("metric").contains("Dropsize") & (col("claim_type") == "deviation"), F.try_divide(F.abs(change), F.abs("comparison_value")) * 100).otherwise(F.abs(change))
    no = lambda c: ~yes(c)
    named_one = col("entity").isNotNull() & col("noun").isNull()
    composite = named_one & no(col("has_entity")) & col("p1").isNotNull()
    rules = [
        ("unsupported_numeric", no(col("has_value")) & col("value").isNotNull(), col("value").cast("string"), "error"),
        ("unsupported_comparison", no(col("has_other_value")) & col("comparison_value").isNotNull(), col("comparison_value").cast("string"), "error"),
        ("unsupported_entity", col("noun").isNotNull() & (col("n_noun") < 2), col("entity"), "error"),
        ("generic_aggregation", col("noun").isNotNull() & (col("n_noun") >= 2), col("entity"), "warning"),
        ("unsupported_entity", composite & (no(col("has_p1")) | no(col("has_p2"))), col("entity"), "error"),
        ("fused_entity", named_one & no(col("has_entity")) & col("p1").isNull() & col("fused").isNotNull(), col("fused"), "error"),
        ("unsupported_entity", named_one & no(col("has_entity")) & col("p1").isNull() & col("fused").isNull(), col("entity"), "error"),
        ("not_one_fact", named_one & col("value").isNotNull() & no(col("has_fact")), col("value").cast("string"), "error"),
        ("comparison_not_one_fact", named_one & col("comparison_value").isNotNull() & no(col("has_other_fact")), col("comparison_value").cast("string"), "error"),
        ("unsupported_comparison_entity", col("comparison_entity").isNotNull() & no(col("has_other_entity")), col("comparison_entity"), "error"),
        ("unsupported_period", col("period").isNotNull() & no(col("has_period")), col("period"), "error"),
        ("unsupported_period", col("comparison_period").isNotNull() & no(col("has_other_period")), col("comparison_period"), "error"),
        ("direction_mismatch", col("direction").isNotNull() & (direction_word(col("direction")) != actual), col("direction"), "error"),
        ("direction_in_text", trend & col("direction").isNull() & (direction_word(col("claim_text")) != actual) & ~col("claim_text").rlike(AHEAD), direction_word(col("claim_text")), "error"),
        ("delta_mismatch", F.abs(gap - F.abs(col("delta"))) > 0.15, col("delta").cast("string"), "error"),
        ("unsupported_deviation", (col("claim_type") == "deviation") & no(col("has_off")), F.lit("deviation"), "error"),
        ("unsupported_cause", is_cause(F.coalesce("claim_text", F.lit(""))) & no(col("has_cause")), F.lit("cause"), "error"),
    ]
    one = lambda t, cond, term, sev: F.when(cond, F.struct(F.lit(t).alias("issue_type"), term.alias("term"), F.lit(sev).alias("severity")))
    judged = F.transform(unsupported_terms(F.coalesce("claim_text", F.lit("")), F.coalesce("stems", F.array().cast("array<string>"))), lambda w: F.struct(F.lit("unsupported_qualifier").alias("issue_type"), w.alias("term"), F.lit("error").alias("severity")))
    every = F.concat(F.array_compact(F.array(*[one(*r) for r in rules])), judged)
    unresolved = F.array(F.struct(F.lit("unresolved_citation").alias("issue_type"), F.array_join("citations", ", ").alias("term"), F.lit("error").alias("severity")))
    return j.select("claim_id", F.explode(F.when(col("has_cause").isNull(), unresolved).otherwise(every)).alias("i")).select("claim_id", "i.*")


# Answers

def answer_sentences(answers: DataFrame) -> DataFrame:
    """answer_id, pos, sentence (without its tags) and tags of each sentence; a sentence without citations borrows those of the next one that has some. A tag at the end of a sentence belongs to it."""
    s = answers.select("answer_id", F.posexplode(sentences_of(F.regexp_replace("text", r"([.!?])\s*((?:\[Data:[^\]]*\]\s*)+)", " $2$1 "))).alias("pos", "s"))
    own = F.when(F.size(citation_tags(F.col("s"))) > 0, citation_tags(F.col("s")))
    ahead = Window.partitionBy("answer_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    return s.select("answer_id", "pos", without_tags(F.col("s")).alias("sentence"), F.coalesce(F.first(own, True).over(ahead), F.array().cast("array<string>")).alias("tags"))


def entity_numbers(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """answer_id, pos, number, entity: each number of a sentence with the name that stands nearest before it, in the sentence or else the last one of the sentences before.

    ``names`` has answer_id and entity: what each answer may name, such as the entities of its evidence. Numbers before any name have a null entity. Years of periods aren't numbers here.
    """
    months = r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b"
    s = sentences.select("answer_id", "pos", F.regexp_replace("sentence", months, "$1").alias("sentence"))
    held = s.join(names.distinct(), "answer_id").where(F.contains("sentence", F.col("entity")))
    spans = held.groupBy("answer_id", "pos").agg(F.collect_set("entity").alias("es"))
    named = s.join(spans, ["answer_id", "pos"], "left")
    ends = lambda text, e: F.length(text) - F.length(F.call_function("substring_index", text, e, F.lit(-1)))  # where a name last ends
    at = lambda text, e: F.struct(ends(text, e).alias("at"), F.length(e).alias("n"), e.alias("e"))  # of names that end at one place, the longest is the one
    last = F.try_element_at(F.array_sort(F.transform("es", lambda e: at(F.col("sentence"), e))), F.lit(-1))["e"]
    before = Window.partitionBy("answer_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    carried = named.withColumn("prior", F.last(F.when(F.size("es") > 0, last), True).over(before))
    part = lambda i: F.regexp_extract_all("sentence", F.lit(rf"(?s)(.*?)({NUMBER})"), F.lit(i))  # what stands before a number, and the number; digits of a name are none
    numbers = carried.select("answer_id", "pos", "es", "prior", part(1).alias("p"), F.posexplode(part(2)).alias("i", "n"))
    each = numbers.withColumn("number", F.replace(F.col("n"), F.lit(","), F.lit("")).cast("double"))
    lead = F.array_join(F.slice("p", F.lit(1), F.col("i") + 1), "\u0001")  # all that stands before the number
    near = F.filter(F.transform(F.coalesce("es", F.array().cast("array<string>")), lambda e: at(lead, e)), lambda x: F.contains(lead, x["e"]))
    return each.select("answer_id", "pos", "number", F.coalesce(F.try_element_at(F.array_sort(near), F.lit(-1))["e"], F.col("prior")).alias("entity"))


def scan_numbers(sentences: DataFrame, facts: DataFrame) -> DataFrame:
    """Issues of numbers in prose: answer_id, pos, issue_type, term. ``facts`` has answer_id, entity and values (all figures the evidence gives for the entity).

    A number is held against the figures of the nearest entity before it: misattributed if only another entity of the evidence has it, unsupported if none has. Sentences about what is to come aren't held to account.
    """
    now = sentences.where(~F.col("sentence").rlike(AHEAD))
    said = entity_numbers(now, facts.select("answer_id", "entity")).where("entity IS NOT NULL")
    own = said.join(facts, ["answer_id", "entity"], "left")
    close = lambda vs, x: F.coalesce(F.exists(vs, lambda v: F.abs(v - x) <= TOLERANCE + 1e-9), F.lit(False))
    off = own.where(~close(F.col("values"), F.col("number"))).select("answer_id", "pos", "entity", "number").distinct()
    others = facts.select("answer_id", F.col("entity").alias("other"), F.explode("values").alias("v"))
    hit = off.join(others, "answer_id").where((F.col("other") != F.col("entity")) & (F.abs(F.col("v") - F.col("number")) <= TOLERANCE + 1e-9)).select("answer_id", "pos", "entity", "number", F.lit(True).alias("_hit")).distinct()
    j = off.join(hit, ["answer_id", "pos", "entity", "number"], "left")
    return j.select("answer_id", "pos", F.when(F.col("_hit"), "misattributed_number").otherwise("unsupported_number").alias("issue_type"), F.concat_ws(" ", "entity", F.col("number").cast("string")).alias("term"))


def scan_language(sentences: DataFrame, evidence: DataFrame) -> DataFrame:
    """Issues of wording: answer_id, pos, issue_type, term. ``sentences`` as of answer_sentences, ``evidence`` an evidence_index.

    Judging words must share their stem with the evidence that the sentence cites; causes and definitions must be the evidence's too; numbers in a recommendation must be stated there; and no abbreviation
    may be expanded wrongly. A sentence that cites nothing that exists has no evidence, and fails where it needs some.
    """
    kept = sentences.withColumn("key", F.struct("answer_id", "pos")).withColumn("own", figures_in(F.col("sentence")))
    asked = citations_of(kept, "key", "tags").join(evidence_sentences(evidence), ["dataset", "id"])
    needed = asked.join(kept.select("key", "own"), "key")
    s = F.col("sentence")
    of = needed.groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_set("stems"))).alias("stems"),  # of a bounded word list
        F.bool_or("cause").alias("has_cause"),
        F.bool_or("defines").alias("has_definition"),
        F.array_distinct(F.flatten(F.collect_list(F.filter("own", lambda n: near(F.col("numbers"), n))))).alias("stated"),  # of the sentence's own numbers
    )
    j = kept.join(of, "key", "left")
    none = lambda t: F.array().cast(f"array<{t}>")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    issue = lambda t, term: F.struct(F.lit(t).alias("issue_type"), term.alias("term"))
    wrong = [F.when(s.rlike(rf"\b{a}\b") & F.contains(F.lower(s), F.lit(w)), issue("wrong_expansion", F.lit(f"{a}: {w}"))) for a, w in WRONG_EXPANSIONS]
    single = F.array_compact(F.array(F.when(is_cause(s) & no(F.col("has_cause")), issue("unsupported_cause", F.lit("cause"))), F.when(s.rlike(DEFINES) & no(F.col("has_definition")), issue("unsupported_definition", F.lit("definition"))), *wrong))
    judged = F.transform(unsupported_terms(s, F.coalesce("stems", none("string"))), lambda w: issue("unsupported_qualifier", w))
    advice = F.when(s.rlike(AHEAD), F.transform(F.array_except(F.array_distinct("own"), F.coalesce("stated", none("double"))), lambda n: issue("unsupported_advice_number", n.cast("string")))).otherwise(F.array().cast("array<struct<issue_type: string, term: string>>"))
    return j.select("answer_id", "pos", F.explode(F.concat(single, judged, advice)).alias("i")).select("answer_id", "pos", "i.*")
