"""The property graph of entities and relationships: checks, entity merging, edge remapping, components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.keys import fold_title
from tallyloom.operators.positions import number_rows
from tallyloom.session import small, written

#: Columns a graph table must have; types no entity may have.
REQUIRED = {
    "entities": ["id", "human_readable_id", "title", "type", "description", "text_unit_ids", "frequency", "degree"],
    "relationships": ["id", "human_readable_id", "source", "target", "description", "text_unit_ids", "weight", "combined_degree"],
    "documents": ["doc_id", "title", "text"],
}
FORBIDDEN = ["ZONE", "CHANNEL"]
EDGE_LABEL = r"^\s*([A-Z_]{3,40}):"


def violation(check: str, severity: str, subject: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.alias("detail")]


def schema_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row for each required column that a table lacks; a missing table lacks all. Looks at schemas only."""
    some = next(iter(tables.values()))
    missing = [(t, c) for t, cols in REQUIRED.items() for c in cols if t not in tables or c not in tables[t].columns]
    rows = some.sparkSession.createDataFrame(missing, "t string, c string")
    return rows.select(*violation("schema", "critical", F.col("t"), F.concat(F.lit("lacks "), F.col("c"))))


def list_orphans(table: DataFrame, name: str, column: str, known: DataFrame) -> DataFrame:
    """Ids in a list column that no row of ``known`` (one column, id) has, with the record that holds them."""
    held = table.select(F.col("id").alias("subject"), F.explode(column).alias("ref")).distinct()
    lost = held.join(known.select(F.col(known.columns[0]).alias("ref")).distinct(), "ref", "left_anti")
    return lost.select(*violation("orphaned_reference", "high", F.col("subject"), F.concat(F.lit(f"{name}.{column}: "), F.col("ref"))))


def dangling_edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose source or target is no entity's title (folded); the detail names the ends."""
    titles = entities.select(fold_title("title").alias("k")).where("k IS NOT NULL").distinct()
    r = relationships.select("id", fold_title("source").alias("s"), fold_title("target").alias("t")).distinct()
    end = lambda side: titles.select(F.col("k").alias(side), F.lit(True).alias(f"has_{side}"))
    j = r.join(end("s"), "s", "left").join(end("t"), "t", "left").where("has_s IS NULL OR has_t IS NULL")
    ends = F.concat_ws("+", F.when(F.col("has_s").isNull(), "source"), F.when(F.col("has_t").isNull(), "target"))
    return j.select(*violation("dangling_edge", "high", F.col("id"), ends)).distinct()


def forbidden_types(entities: DataFrame) -> DataFrame:
    return entities.where(F.upper(F.trim("type")).isin(FORBIDDEN)).select(*violation("forbidden_type", "medium", F.col("id"), F.upper(F.trim("type")))).distinct()


def vocabulary(entities: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """Entities of a kind whose folded title isn't in its vocabulary, and titles that several entities share."""
    e = entities.where(F.upper(F.trim("type")) == kind).select("id", fold_title("title").alias("k")).where("k IS NOT NULL").distinct()
    words = terms.where(F.col("kind") == kind).select(fold_title("term").alias("k")).distinct()
    unknown = e.join(words, "k", "left_anti").select(*violation(f"{kind.lower()}_unknown", "medium", F.col("id"), F.col("k")))
    twice = e.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return unknown.unionByName(twice.select(*violation(f"{kind.lower()}_duplicate", "low", F.col("k"), F.col("n").cast("string"))))


def first_per_check(violations: DataFrame, n: int = 10) -> DataFrame:
    """The report: each check's first n violations in order, and how many there are."""
    w = Window.partitionBy("check").orderBy("subject", "detail")
    counts = violations.groupBy("check").agg(F.count(F.lit(1)).alias("n_all"))
    return violations.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).join(counts, "check")


def vocabulary_map(terms: DataFrame, kind: str) -> DataFrame:
    """k and term of each term of a kind, by its folded title."""
    return terms.where(F.col("kind") == kind).select(fold_title("term").alias("k"), "term").where("k IS NOT NULL").groupBy("k").agg(F.min("term").alias("term"))


def aliases(words: DataFrame) -> DataFrame:
    """alias and term of other ways to write the folded titles of a vocabulary map: without or with the plural's S, with its words run together or joined by hyphens. An alias that two terms have means neither, and a
    term's own title is no alias."""
    k = F.col("k")
    plural = F.when(k.endswith("S"), F.substring(k, F.lit(1), F.length(k) - 1)).otherwise(F.concat(k, F.lit("S")))
    ways = words.select("term", F.explode(F.array_distinct(F.array(plural, F.replace(k, F.lit(" "), F.lit("")), F.replace(k, F.lit(" "), F.lit("-"))))).alias("alias"))
    single = ways.groupBy("alias").agg(F.min("term").alias("term"), F.countDistinct("term").alias("n")).where("n = 1").drop("n")
    return single.join(words.select(k.alias("alias")), "alias", "left_anti")


def _titles(titles: DataFrame) -> DataFrame:
    return titles.select("title").where("title IS NOT NULL").distinct().withColumn("k", fold_title("title"))


def resolve_franchise(titles: DataFrame, terms: DataFrame) -> DataFrame:
    """title, franchise and reason: normalised (its folded title is a term's), alias, or unresolved."""
    words = written(vocabulary_map(terms, "FRANCHISE"), "words")
    other = written(aliases(words), "aliases")
    out = _titles(titles).join(small(words), "k", "left").join(small(other.select(F.col("alias").alias("k"), F.col("term").alias("other"))), "k", "left")
    reason = F.when(F.col("term").isNotNull(), "normalised").when(F.col("other").isNotNull(), "alias").otherwise("unresolved")
    return out.select("title", F.coalesce("term", "other").alias("franchise"), reason.alias("reason"))


def resolve_category(titles: DataFrame, terms: DataFrame, with_aliases: bool = False) -> DataFrame:
    """title, category and reason: exact, alias (only ``with_aliases``), state_prefix ('<STATE> <CATEGORY>'), or unresolved; small vocabularies, looked up by join."""
    t = _titles(titles)
    words = terms.where("kind = 'CATEGORY'").select(fold_title("term").alias("k"), F.col("term").alias("category"))
    states = terms.where("kind = 'STATE'").select(fold_title("term").alias("state")).distinct()
    # Every way to cut the title in two at a blank, looked up by equality on both sides.
    w = F.split("k", " ")
    cuts = t.select("title", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("i"), w.alias("w")).where("i >= 1 AND i < size(w)")
    halves = cuts.select("title", F.array_join(F.slice("w", F.lit(1), F.col("i")), " ").alias("state"), F.array_join(F.slice("w", F.col("i") + 1, F.size("w")), " ").alias("k"))
    prefixed = halves.join(states, "state", "left_semi").join(words, "k").groupBy("title").agg(F.min("category").alias("prefixed"))
    out = t.join(words, "k", "left").join(prefixed, "title", "left")
    if with_aliases:
        other = written(aliases(vocabulary_map(terms, "CATEGORY")), "aliases").select(F.col("alias").alias("k"), F.col("term").alias("other"))
        out = out.join(small(other), "k", "left")
    else:
        out = out.withColumn("other", F.lit(None).cast("string"))
    reason = F.when(F.col("category").isNotNull(), "exact").when(F.col("other").isNotNull(), "alias").when(F.col("prefixed").isNotNull(), "state_prefix").otherwise("unresolved")
    return out.select("title", F.coalesce("category", "other", "prefixed").alias("category"), reason.alias("reason"))


def one_to_one(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Violations of 'each row of one table has exactly one of the other': keys that a side lacks, or has more than once."""
    n = lambda d, c: d.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(c))
    both = n(left, "a").join(n(right, "b"), key, "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    detail = F.concat(F.lit(f"{names[0]}: "), a.cast("string"), F.lit(f", {names[1]}: "), b.cast("string"))
    return both.where((a != 1) | (b != 1)).select(*violation("cardinality", "medium", F.col(key), detail))


def survivors(entities: DataFrame, exact_first: bool = False) -> DataFrame:
    """title (folded), id and human_readable_id of the entity that survives among those of the title: lowest human_readable_id, nulls last, then id; with ``exact_first`` entities whose title is written in the
    folded way come before all others. One minimum a title, merged from partial ones."""
    other = (F.col("_raw") != F.col("title")) if exact_first else F.lit(False)
    e = entities.select(F.col("title").alias("_raw"), fold_title("title").alias("title"), "id", "human_readable_id").where("title IS NOT NULL")
    row = F.struct(other.alias("o"), F.col("human_readable_id").isNull().alias("n"), "human_readable_id", "id")
    g = e.groupBy("title").agg(F.min(row).alias("r"))
    return g.select("title", F.col("r.id").alias("id"), F.col("r.human_readable_id").alias("human_readable_id"))


def merged_texts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form of the joined descriptions: a row for each key and distinct description (trimmed, not blank), with ``first``, by which a key's descriptions are ordered."""
    first = F.struct(F.col("human_readable_id").isNull().alias("n"), "human_readable_id", "id", F.col("description").alias("d"))
    return rows.select(*keys, F.nullif(F.trim("description"), F.lit("")).alias("description"), first.alias("f")).where("description IS NOT NULL").groupBy(*keys, "description").agg(F.min("f").alias("first"))


def merged_units(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form of the merged text units: a row for each key and distinct unit, with ``first``, by which a key's units are ordered."""
    each = rows.select(*keys, "human_readable_id", "id", F.posexplode("text_unit_ids").alias("at", "unit")).where("unit IS NOT NULL")
    first = F.struct(F.col("human_readable_id").isNull().alias("n"), "human_readable_id", "id", "at", F.col("unit").alias("u"))
    return each.groupBy(*keys, "unit").agg(F.min(first).alias("first"))


def unit_counts(entities: DataFrame) -> DataFrame:
    """title (folded) and frequency, its number of distinct text units: spread by title and unit, then counted."""
    units = entities.select(fold_title("title").alias("title"), F.explode("text_unit_ids").alias("unit")).where("title IS NOT NULL AND unit IS NOT NULL").distinct()
    return units.groupBy("title").agg(F.count(F.lit(1)).cast("int").alias("frequency"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """Entities merged by folded title: the survivor's id and human_readable_id (lowest, nulls last, then id), distinct descriptions joined in that order, distinct text units, and frequency.

    A row holds its title's distinct descriptions and units, made distinct before they are gathered. Where a title may have too many for a row, take survivors() and unit_counts(), and
    the values from merged_texts() and merged_units(), which gather nothing.
    """
    e = entities.withColumn("title", fold_title("title")).where("title IS NOT NULL")
    texts = merged_texts(e, ["title"]).groupBy("title").agg(F.array_sort(F.collect_list(F.struct("first", "description"))).alias("t"))
    units = merged_units(e, ["title"]).groupBy("title").agg(F.array_sort(F.collect_list(F.struct("first", "unit"))).alias("u"))
    found = survivors(entities).join(texts, "title", "left").join(units, "title", "left")
    listed = F.coalesce(F.col("u.unit"), F.array().cast("array<string>"))
    return found.select("id", "human_readable_id", "title", F.coalesce(F.array_join("t.description", " | "), F.lit("")).alias("description"), listed.alias("text_unit_ids"), F.size(listed).alias("frequency"))


def remap_relationships(relationships: DataFrame) -> DataFrame:
    """Edges between folded titles, one per source and target: lowest human_readable_id survives, mean weight of the distinct rows, and combined_degree: the source's edges out plus the target's edges in."""
    r = relationships.select(fold_title("source").alias("source"), fold_title("target").alias("target"), "id", "human_readable_id", "weight").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    best = F.min(F.struct(F.col("human_readable_id").isNull().alias("n"), "human_readable_id", "id"))
    edges = r.groupBy("source", "target").agg(best.alias("b"), F.round(F.avg("weight"), 6).alias("weight")).select("source", "target", F.col("b.id").alias("id"), F.col("b.human_readable_id").alias("human_readable_id"), "weight")
    out, into = edges.groupBy("source").agg(F.count(F.lit(1)).alias("o")), edges.groupBy("target").agg(F.count(F.lit(1)).alias("i"))
    return edges.join(out, "source").join(into, "target").select("source", "target", "id", "human_readable_id", "weight", (F.col("o") + F.col("i")).alias("combined_degree"))


def folded_edges(relationships: DataFrame) -> DataFrame:
    """Relationships with both ends folded, and without those that lack one: the rows that remap_relationships collapses; merged_texts and merged_units keep what they say."""
    return relationships.withColumns({c: fold_title(c) for c in ("source", "target")}).where("source IS NOT NULL AND target IS NOT NULL")


def remap_list(table: DataFrame, key: str, column: str, mapping: DataFrame) -> DataFrame:
    """Long form of a list column with its ids remapped: a row for each key and distinct new id, with ``at``, the first place it has in the list. Ids that ``mapping`` (id, survivor) lacks stay as they are."""
    held = table.select(F.col(key).alias("key"), F.posexplode(column).alias("at", "id")).join(mapping, "id", "left")
    return held.groupBy("key", F.coalesce("survivor", "id").alias("ref")).agg(F.min("at").alias("at"))


def edge_labels(relationships: DataFrame) -> DataFrame:
    """Edges by the label their description begins with."""
    label = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("description", F.lit("")), EDGE_LABEL, 1), F.lit("")), F.lit("(unlabeled)"))
    return relationships.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n_edges"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of the undirected graph of edges (source, target).

    Each round every node takes the smallest label around it, then the label of that label; the labels are written to the shared folder, which cuts the lineage. Labels halve their
    distance to the smallest node in a round, so few rounds are needed. Only the number of changes reaches the driver.
    """
    both = edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("a"), F.col("target").alias("b"))
    pairs = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = written(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = pairs.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        low = labels.join(near, "a").select("a", F.least("label", "theirs").alias("low"), "label")
        jump = labels.select(F.col("a").alias("low"), F.col("label").alias("beyond"))
        step = written(low.join(jump, "low", "left").select("a", F.least("low", F.coalesce("beyond", "low")).alias("label"), (F.least("low", F.coalesce("beyond", "low")) != F.col("label")).alias("moved")), "labels")
        moved, labels = step.where("moved").count(), step.select("a", "label")
        if not moved:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def missing_entities(names: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """Names (one column) that no entity of the kind has as its folded title."""
    have = entities.where(F.upper(F.trim("type")) == kind).select(fold_title("title").alias("k")).distinct()
    n = names.select(F.col(names.columns[0]).alias("name")).where("name IS NOT NULL").distinct().withColumn("k", fold_title("name"))
    return n.join(have, "k", "left_anti").select(*violation(f"missing_{kind.lower()}", "high", F.col("name"), F.lit("no entity")))


def affected(components_of: DataFrame, losers: DataFrame) -> DataFrame:
    """Components that hold an entity lost in a merge, with how many."""
    return components_of.join(losers.select(F.col(losers.columns[0]).alias("node")).distinct(), "node").groupBy("component").agg(F.count(F.lit(1)).alias("n_lost"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def source_consistency(docs: DataFrame) -> DataFrame:
    """doc_id, the state of the file name, and status: ok, unparsable (no STATE_yyyy-MM_ID.txt), no_head, name_mismatch (with state_name), head_mismatch (with the text's State line)."""
    parts = r"^(.+)_(\d{4}-\d{2})_(\d+)\.txt$"
    named = F.replace(F.regexp_extract(F.coalesce("title", F.lit("")), parts, 1), F.lit("_"), F.lit(" "))
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?m)^State:\s*(.+?)\s*$", 1)
    status = (
        F.when(named == "", "unparsable").when(~named.eqNullSafe(F.col("state_name")), "name_mismatch").when(head == "", "no_head").when(head != named, "head_mismatch").otherwise("ok")
    )
    return docs.select("doc_id", F.nullif(named, F.lit("")).alias("file_state"), status.alias("status"))


def removable(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities of forbidden types with the edges at their folded title, and whether they can go: only those without any."""
    e = entities.where(F.upper(F.trim("type")).isin(FORBIDDEN)).select("id", fold_title("title").alias("k")).distinct()
    ends = relationships.select(F.explode(F.array_distinct(F.array(fold_title("source"), fold_title("target")))).alias("k"), "id").where("k IS NOT NULL").distinct()
    n = ends.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, "k", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_edges"), F.col("n").isNull().alias("removed"))


def without_removed(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities without those of forbidden types that no edge has at its ends."""
    gone = removable(entities, relationships).where("removed").select("id")
    return entities.join(gone, "id", "left_anti")


def backfill(entities: DataFrame, missing: DataFrame, kind: str) -> DataFrame:
    """New entities for missing names (subject): id from the name, human_readable_ids on from the highest, in the names' order."""
    highest = entities.agg(F.coalesce(F.max("human_readable_id"), F.lit(0))).first()[0]
    placed = number_rows(missing, [], [F.col("subject")])
    return placed.select(F.concat(F.lit("new-"), F.lower(F.replace(F.col("subject"), F.lit(" "), F.lit("-")))).alias("id"), (F.lit(highest) + F.col("row_no") + 1).alias("human_readable_id"), F.upper("subject").alias("title"), F.lit(kind).alias("type"))


#: What links a backfilled state to entities of its documents, by their type: the label, and whether the state is the source.
STATE_EDGES = {"DISTRIBUTOR": ("SERVES", False), "OBSERVATION": ("HAS_OBSERVATION", True)}


def backfill_edges(entities: DataFrame, units: DataFrame, missing: DataFrame) -> DataFrame:
    """Edges (source, target, label, n_units) of missing states (subject): from distributors, and to observations, that occur in a text unit of a document of the state.

    ``units`` has id and state_name, one row per text unit; n_units counts the units that an edge rests on. Only the units of missing states travel, broadcast if they are few.
    """
    of_state = written(units.join(F.broadcast(missing.select(F.col("subject").alias("state_name")).distinct()), "state_name").select(F.col("id").alias("unit"), fold_title("state_name").alias("state")).distinct(), "units")
    kind = F.upper(F.trim("type"))
    held = entities.where(kind.isin(list(STATE_EDGES))).select(fold_title("title").alias("title"), kind.alias("type"), F.explode("text_unit_ids").alias("unit")).where("title IS NOT NULL").distinct()
    met = held.join(small(of_state), "unit").groupBy("state", "title", "type").agg(F.countDistinct("unit").alias("n_units"))
    label, first = None, None
    for t, (name, state_first) in STATE_EDGES.items():
        is_it = F.col("type") == t
        label = F.when(is_it, name) if label is None else label.when(is_it, name)
        first = F.when(is_it, F.lit(state_first)) if first is None else first.when(is_it, F.lit(state_first))
    return met.select(F.when(first, F.col("state")).otherwise(F.col("title")).alias("source"), F.when(first, F.col("title")).otherwise(F.col("state")).alias("target"), label.alias("label"), "n_units")


def unit_lists(units: DataFrame, missing: DataFrame, kind: str = "new-") -> DataFrame:
    """Long form of what a backfilled state is added to: unit and the new entity's id, a row for each text unit of a document of a missing state."""
    return units.join(F.broadcast(missing.select(F.col("subject").alias("state_name")).distinct()), "state_name").select(F.col("id").alias("unit"), F.concat(F.lit(kind), F.lower(F.replace(F.col("state_name"), F.lit(" "), F.lit("-")))).alias("entity_id")).distinct()


#: Checks that merging, remapping, backfilling and removing can't settle, as they need someone's decision.
KNOWN_REMAINING = ("dangling_edge", "category_unknown", "franchise_unknown", "forbidden_type", "orphaned_reference")


def canonicalised(entities: DataFrame, relationships: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, human_readable_id, title, type) and relationships (id, source, target) after the whole run: forbidden entities without edges removed, titles merged, missing states backfilled with
    their edges, and edges remapped and collapsed. Running it on its own result changes nothing."""
    kept = without_removed(entities, relationships)
    first = survivors(kept)
    typed = kept.select("id", "human_readable_id", "type", fold_title("title").alias("title")).groupBy("title", "id").agg(F.min("type").alias("type"))
    merged = written(first.join(typed, ["title", "id"]).select("id", "human_readable_id", "title", F.upper(F.trim("type")).alias("type")), "merged")
    missing = written(missing_entities(documents.select("state_name"), merged, "STATE"), "missing")
    new = backfill(entities, missing, "STATE").select("id", "human_readable_id", fold_title("title").alias("title"), "type")
    edges = remap_relationships(relationships).select("id", "source", "target")
    units = documents.where("state_name IS NOT NULL").select(F.concat(F.lit("tu-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), "state_name")
    added = backfill_edges(kept, units, missing).select(F.concat_ws("|", F.lit("new"), "source", "target").alias("id"), "source", "target")
    return merged.unionByName(new), edges.unionByName(added.join(edges.select("source", "target"), ["source", "target"], "left_anti"))


def run_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per check: n_before and n_after violations, and status: clean, known_remaining (none of the checks left is one the run should have settled), or failed (more than before, or left though settled by the run)."""
    n = lambda d, c: d.groupBy("check").agg(F.count(F.lit(1)).alias(c))
    both = n(before, "n_before").join(n(after, "n_after"), "check", "full").select("check", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    known = F.col("check").isin(list(KNOWN_REMAINING)) & (F.col("n_after") <= F.col("n_before"))
    return both.withColumn("status", F.when(F.col("n_after") == 0, "clean").when(known, "known_remaining").otherwise("failed"))


def related_edges(found: DataFrame, entities: DataFrame, relationships: DataFrame, n: int) -> DataFrame:
    """query_id, edge_id and place of the n heaviest edges at the entities that a search found (query_id, vec_id): of equal weights the lower id first, null weights last.

    Edges are laid out by their ends and met by title; an edge that both of its ends bring counts once. What is ranked is cut to n of each query and end's title before, so a title at the end of very many edges brings n.
    """
    named = entities.select(F.col("human_readable_id").alias("vec_id"), fold_title("title").alias("title")).where("vec_id IS NOT NULL AND title IS NOT NULL").distinct()
    ends = relationships.select("id", "weight", F.explode(F.array_distinct(F.array(fold_title("source"), fold_title("target")))).alias("title")).where("title IS NOT NULL").groupBy("id", "title").agg(F.max("weight").alias("weight"))
    best = number_rows(ends, ["title"], [F.col("weight").desc_nulls_last(), F.col("id")], first=n).drop("row_no")
    met = found.select("query_id", "vec_id").join(named, "vec_id").join(best, "title").groupBy("query_id", F.col("id").alias("edge_id")).agg(F.max("weight").alias("weight"))
    w = Window.partitionBy("query_id").orderBy(F.col("weight").desc_nulls_last(), "edge_id")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "edge_id", "place")


def communities(edges: DataFrame, max_size: int = 10, levels: int = 3, rounds: int = 3) -> DataFrame:
    """level, node and community (named after one of its nodes) of the undirected graph of edges (source, target, weight): at level 0 of nodes, at each further level of the communities of the one before; none
    has more than ``max_size`` members, and levels end where none can be joined any more. A null weight is 1; loops join nothing; nodes stay alone where all around them is full.

    In each round a coin (a hash) makes half of those that are alone wait; the others each ask the community they have the most weight to, of equal ones the lowest, and a community takes the
    heaviest asking, as many as it has room for. Asking is sorted and numbered over the cluster, so a hub may be asked by any number. Every round's members are written, which cuts the lineage.
    """
    ends = edges.where("source IS NOT NULL AND target IS NOT NULL")
    place = written(ends.select(F.explode(F.array("source", "target")).alias("node")).distinct().select("node", F.col("node").alias("unit")), "place")
    one_way = ends.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    both = lambda d: d.unionByName(d.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    links = written(both(one_way.groupBy("u", "v").agg(F.round(F.sum("w"), 6).alias("w"))), "links")
    out = []
    for level in range(levels):
        member = written(place.select("unit").distinct().withColumn("c", F.col("unit")), "member")
        for r in range(rounds):
            sized = written(member.join(member.groupBy("c").agg(F.count(F.lit(1)).alias("size")), "c").withColumn("waits", F.pmod(F.xxhash64("c", F.lit(level * rounds + r)), F.lit(2)) == 1), "sized")
            free = sized.where("size = 1 AND NOT waits").select(F.col("unit").alias("u"))
            open_ = sized.where((F.col("size") < max_size) & ((F.col("size") > 1) | F.col("waits"))).select(F.col("unit").alias("v"), F.col("c").alias("to"), "size")
            offers = links.join(free, "u").join(open_, "v").groupBy("u", "to", "size").agg(F.round(F.sum("w"), 6).alias("w"))
            best = offers.groupBy("u").agg(F.min(F.struct((-F.col("w")).alias("w"), "to", "size")).alias("b")).select("u", "b.w", "b.to", "b.size")
            taken = number_rows(best, ["to"], [F.col("w"), F.col("u")], first=max_size - 1).where(F.col("row_no") < max_size - F.col("size"))
            member = written(member.join(taken.select(F.col("u").alias("unit"), "to"), "unit", "left").select("unit", F.coalesce("to", "c").alias("c")), "member")
        place = written(place.join(member, "unit").select("node", F.col("c").alias("unit")), "place")
        out.append(place.select(F.lit(level).alias("level"), "node", F.col("unit").alias("community")))
        of = lambda end: member.select(F.col("unit").alias(end), F.col("c").alias(f"c{end}"))
        joined = links.join(of("u"), "u").join(of("v"), "v").where("cu <> cv")
        before, links = links, written(joined.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.round(F.sum("w"), 6).alias("w")), "links")
        if links.limit(1).count() == 0 or (level and links.count() == before.count()):
            break
    return union_all(out)


def community_faults(found: DataFrame, edges: DataFrame, max_size: int = 10) -> DataFrame:
    """Per level: n_nodes, and what must be 0: n_over communities with more than max_size members, n_torn nodes whose community of the level before is split, n_apart nodes of a larger community without an edge into it (level 0)."""
    below = found.select((F.col("level") + 1).alias("level"), "node", F.col("community").alias("unit"))
    nodes = found.where("level = 0").select("level", "node", F.col("node").alias("unit")).unionByName(below)
    held = found.join(nodes, ["level", "node"])
    over = held.groupBy("level", "community").agg(F.countDistinct("unit").alias("n")).groupBy("level").agg(F.count_if(F.col("n") > max_size).alias("n_over"))
    torn = held.groupBy("level", "unit").agg(F.countDistinct("community").alias("n")).groupBy("level").agg(F.count_if(F.col("n") > 1).alias("n_torn"))
    first = found.where("level = 0").select("node", "community")
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    near = both.join(first.select(F.col("node").alias("source"), "community"), "source").join(first.select(F.col("node").alias("target"), F.col("community").alias("other")), "target")
    inside = near.where("community = other").select(F.col("source").alias("node")).distinct()
    many = first.join(first.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "community", "left_semi")
    apart = many.join(inside, "node", "left_anti").agg(F.count(F.lit(1)).alias("n_apart")).withColumn("level", F.lit(0))
    sizes = found.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.join(over, "level").join(torn, "level").join(apart, "level", "left").select("level", "n_nodes", "n_over", "n_torn", F.coalesce("n_apart", F.lit(0)).alias("n_apart"))
