"""Evidence around facts: SKU sentences, documents for named periods, term mentions, and the graph that the facts span."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.keys import month_words, words_month
from tallyloom.operators.documents import number, printed


def sku_sentences(sales: DataFrame) -> DataFrame:
    """One sentence for each SKU of a state and month: state_name, month, sku_id, text. ``sales`` has those keys, qty_delivered, revenue and service_level."""
    text = F.concat(
        F.lit("SKU "), F.col("sku_id").cast("string"), F.lit(" in "), F.col("state_name"), F.lit(", "), month_words("month"), F.lit(": "),
        F.format_string("%d", F.col("qty_delivered").cast("bigint")), F.lit(" units, Rs "), F.format_string("%.2f", F.round("revenue", 2)), F.lit(", Service Level "), F.coalesce(printed(F.col("service_level"), True), F.lit("unknown")), F.lit("."),
    )
    return sales.select("state_name", "month", "sku_id", text.alias("text"))


def sku_facts(texts: DataFrame) -> DataFrame:
    """The figures of SKU sentences, read from texts of any number of them: state_name, month, sku_id, units, revenue, service_level."""
    pattern = r"SKU (\d+) in (.+?), (\w+ \d{4}): ([\d,]+) units, Rs ([\d.,]+\d), Service Level ([\d.]+)%"
    found = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("sku", "state", "words", "units", "revenue", "level"), 1)])
    r = texts.select(F.explode(found).alias("f")).select("f.*")
    return r.select(F.col("state").alias("state_name"), words_month(F.col("words")).alias("month"), F.col("sku").cast("bigint").alias("sku_id"), number(F.col("units")).alias("units"), number(F.col("revenue")).alias("revenue"), number(F.col("level")).alias("service_level"))


def named_documents(asked: DataFrame, docs: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Documents of the states and periods that questions name and that haven't been retrieved for them: question_id, doc_id.

    ``asked`` has question_id, state_name and periods ('March 2025, May 2025'); ``docs`` has doc_id, state_name, month; ``retrieved`` question_id and doc_id.
    """
    wanted = asked.select("question_id", F.upper("state_name").alias("state_name"), F.explode(F.split("periods", ", ")).alias("p")).withColumn("month", words_month(F.col("p"))).where("month IS NOT NULL")
    found = wanted.join(docs.select("doc_id", F.upper("state_name").alias("state_name"), "month"), ["state_name", "month"]).select("question_id", "doc_id").distinct()
    return found.join(retrieved.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")


def scoped(sources: DataFrame, group: str, keep: Column) -> DataFrame:
    """The sources of each group that are to be kept, or all of the group where none would be left."""
    any_kept = sources.groupBy(group).agg(F.bool_or(F.coalesce(keep, F.lit(False))).alias("_any"))
    return sources.join(any_kept, group).where(F.coalesce(keep, F.lit(False)) | ~F.col("_any")).drop("_any")


def term_mentions(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """doc_id and term for each term of a bounded list that the text has as whole words, in any case; every text is read once."""
    if not terms:
        return docs.select("doc_id", F.lit(None).cast("string").alias("term")).limit(0)
    hit = lambda t: F.when(F.col("text").rlike(r"(?i)(?<![A-Za-z0-9])" + _quoted(t) + r"(?![A-Za-z0-9])"), t)
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(F.array_compact(F.array(*map(hit, terms)))).alias("term")).distinct()


def _quoted(term: str) -> str:
    return r"\Q" + term + r"\E"


def gap_consistent(facts: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Deviation facts with ``consistent``: the stated gap is that of the stated values, in points or, for a relative metric, in percent."""
    v, p = F.col("value"), F.col("peer_value")
    gap = F.when(F.col("metric_label") == "Dropsize", F.abs(F.try_divide(v - p, p) * 100)).otherwise(F.abs(v - p))
    return facts.withColumn("consistent", F.abs(gap - F.col("gap")) <= tolerance)


def fact_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (title, type) and relationships (source, target, label) that state facts (doc_id, state_name, month, metric) span; months are linked to their successors."""
    place, period = F.col("state_name"), month_words("month")
    seen = F.concat_ws(" ", place, F.col("metric"), period)
    node = lambda t, k: F.struct(t.alias("title"), F.lit(k).alias("type"))
    edge = lambda s, t, k: F.struct(s.alias("source"), t.alias("target"), F.lit(k).alias("label"))
    nodes = F.array(node(place, "STATE"), node(period, "PERIOD"), node(F.col("metric"), "METRIC"), node(F.col("doc_id"), "DOCUMENT"), node(seen, "OBSERVATION"))
    following = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "MMMM yyyy")
    edges = F.array(
        edge(place, seen, "HAS_OBSERVATION"), edge(seen, F.col("metric"), "OF_METRIC"), edge(seen, period, "OBSERVED_IN"), edge(seen, F.col("doc_id"), "EVIDENCED_BY"), edge(period, following, "PRECEDES")
    )
    entities = facts.select(F.explode(nodes).alias("n")).select("n.*").distinct()
    links = facts.select(F.explode(edges).alias("e")).select("e.*").distinct()
    known = entities.where("type = 'PERIOD'").select(F.col("title").alias("target"))
    return entities, links.where("label <> 'PRECEDES'").unionByName(links.where("label = 'PRECEDES'").join(known, "target", "left_semi").select(links.columns))


def glossary_rows(mentions: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, id (glossary-...) and text of the terms that each text mentions. ``mentions`` has key and term; ``terms`` kind and term, a bounded list."""
    known = terms.select("term", F.concat(F.lit("glossary-"), F.lower(F.replace("term", F.lit(" "), F.lit("-")))).alias("id"), F.concat("term", F.lit(": a "), F.lower("kind"), F.lit(" of the reference list.")).alias("text")).distinct()
    return mentions.join(known, "term").select(key, "id", "text")


def with_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """The rows of evidence whose id begins with a prefix, such as glossary- or sku-ranking-."""
    return rows.where(F.startswith("id", F.lit(prefix)))


def context(key: str, parts: Mapping[str, DataFrame]) -> DataFrame:
    """key, dataset, id and text of all evidence for each question: parts (key, id, text) by data set, in order of rank. A record that several parts bring stays in the first; records without text are left out."""
    frames = [d.select(key, F.lit(i).alias("rank"), F.lit(n).alias("dataset"), F.col("id").cast("string").alias("id"), "text") for i, (n, d) in enumerate(parts.items())]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    best = every.where("text IS NOT NULL").groupBy(key, "id").agg(F.min(F.struct("rank", "dataset", "text")).alias("b"))
    return best.select(key, "b.dataset", "id", "b.text")


def source_id(state: Column, period: Column) -> Column:
    """The id of evidence made for a state and a period: sku-STATE-period, blanks as underscores."""
    return F.concat(F.lit("sku-"), F.translate(F.concat_ws("-", state, period), " ", "_"))


def year_label(year: Column, n_months: Column) -> Column:
    """A year as a period: '2025', or '2025 (5 months)' where not all are there."""
    y = year.cast("string")
    return F.when(n_months >= 12, y).otherwise(F.concat(y, F.lit(" ("), n_months.cast("string"), F.when(n_months == 1, " month)").otherwise(" months)")))


def range_label(first: Column, last: Column) -> Column:
    """'March 2025 to May 2026' of two months; one month stands alone; null without months."""
    return F.when(first == last, month_words(first)).otherwise(F.concat(month_words(first), F.lit(" to "), month_words(last)))


def first_document(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The first document, by doc_id, of each asked state and month (state_name in any case); none where there is none."""
    found = docs.select(F.upper("state_name").alias("state_name"), "month", "doc_id").groupBy("state_name", "month").agg(F.min("doc_id").alias("doc_id"))
    return asked.select(F.upper("state_name").alias("state_name"), "month").distinct().join(found, ["state_name", "month"])


def all_facts(kinds: Mapping[str, tuple[DataFrame, Column, Column]], doc_id: str = "doc_id") -> DataFrame:
    """kind, doc_id, entity, metric and figures of facts of several kinds: each a data frame with doc_id and metric, its entity and its array of figures; null figures are left out."""
    frames = [d.select(F.lit(k).alias("kind"), F.col(doc_id).alias("doc_id"), entity.cast("string").alias("entity"), "metric", F.array_compact(figures).alias("figures")) for k, (d, entity, figures) in kinds.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def numbered_lists(facts: DataFrame) -> DataFrame:
    """all_facts with fact_no, the number of a fact in its document's list of its kind, by entity and metric."""
    return facts.withColumn("fact_no", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("entity", "metric", "figures")))
