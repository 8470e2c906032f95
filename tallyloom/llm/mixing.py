"""Mixing sources to target shares of the tokens, by Pfair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import written

#: Most tokens of a block, slots of a period of the schedule (at most a slot more for each source), documents of a bucket, and most sources of a mix.
BLOCK_TOKENS, MOST_SLOTS, BUCKET_DOCS, MOST_SOURCES = 8192, 50_000, 50_000, 1000


def source_name(c):
    """Source in lower case without white space around it, blanks and hyphens as underscores; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.btrim(F.lower(c)), r"[\s-]+", "_"), F.lit(""))


def budgets(shares: Mapping[str, float], supply: Mapping[str, int], repeats: Mapping[str, int], total: int) -> dict[str, float]:
    """Tokens to draw from each source: its share of ``total``, but at most its supply times its repeats; what a source can't give, the others take over by their shares, as far as they can."""
    most = {s: supply.get(s, 0) * max(0, repeats[s]) for s in shares}
    drawn = {s: 0.0 for s in shares}
    open_, left = {s for s in shares if most[s] > 0 and shares[s] > 0}, float(total)
    while open_ and left > 1e-9:
        weight = sum(shares[s] for s in open_)
        short = {s for s in open_ if most[s] <= left * shares[s] / weight}
        for s in short or open_:
            drawn[s] = float(most[s]) if short else left * shares[s] / weight
        if not short:
            break
        left -= sum(drawn[s] for s in short)
        open_ -= short
    return drawn


def earliest_deadline_first(blocks: list[int]) -> list[tuple[int, int, int]]:
    """(slot, source, block) of a mix of ``blocks`` blocks of each source.

    Block k of a source with b of the n blocks is released at slot floor(k n / b) and due by ceil((k + 1) n / b); each slot takes, of the released blocks, the one due first. A source is
    then never as much as a block away from its share.
    """
    n, out = sum(blocks), []
    due = lambda i, k: -(-(k + 1) * n // blocks[i])
    waiting, ready = [(0, i, 0) for i, b in enumerate(blocks) if b], []
    heapq.heapify(waiting)
    for t in range(n):
        while waiting and (waiting[0][0] <= t or not ready):
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(i, k), i, k))
        _, i, k = heapq.heappop(ready)
        out.append((t, i, k))
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, ((k + 1) * n // blocks[i], i, k + 1))
    return out


def periods(blocks: list[int], slots: int) -> tuple[int, list[int]]:
    """How many equal periods a mix of at least ``blocks`` blocks of each source has, and the blocks of each source in one, about ``slots`` in all.

    Every source gets a multiple of the number of periods, in blocks that are the smaller for it; so its share falls on a whole block at each period's end, no release or deadline reaches over it, and the
    schedule of one period, repeated, is the schedule of the whole mix.
    """
    n = sum(blocks)
    if n <= slots:
        return 1, blocks
    each = [-(-b * slots // n) for b in blocks]
    return max(-(-b // q) for b, q in zip(blocks, each) if q), each


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The drawn documents in mixing order: slot, source, doc_id, copy_no (from 1), n_tokens, source_start (tokens of the source before it).

    ``docs`` has doc_id, source, n_tokens; ``targets`` source, target_share, max_repeats (a bounded list of at most MOST_SOURCES). Sources are matched without regard to case and blanks; documents
    of sources that aren't targets, or without tokens, aren't drawn, and neither are null shares. In all, ``total_tokens`` are drawn (by default the tokens that the target sources have), of each source its share,
    every document at most max_repeats times; the whole source once before any second copy. What a source lacks, the others take over by their shares as far as they can. A source's last document may
    exceed its share by less than its own length. Repeated rows are documents of their own.

    The source's tokens are prefix-summed in hash buckets of bounded size and cut to equal blocks of at most ``block_tokens``; each block has a release and a deadline from its source's share, and slots are given earliest
    deadline first, so that at any slot a source is less than one of its blocks from its share, however long the mix is. A long mix consists of equal periods (see ``periods``): one period of about MOST_SLOTS slots is
    scheduled, and a block finds its slot by its place in its period, in a join with that bounded list.
    """
    spark = docs.sparkSession
    wanted = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    known = docs.select(source_name("source").alias("source"), "doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0").join(F.broadcast(wanted.select("source")), "source")
    buckets = max(1, -(-known.count() // BUCKET_DOCS))
    hashed = written(known.withColumn("h", F.xxhash64("doc_id", F.monotonically_increasing_id())).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")), "mixed")
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    supply = {r["source"]: int(r["t"]) for r in sums.groupBy("source").agg(F.sum("t").alias("t")).collect()}  # a row for each target source
    names = sorted(r["source"] for r in rows)
    shares = {r["source"]: float(r["target_share"]) for r in rows}
    repeats = {r["source"]: int(r["max_repeats"] if r["max_repeats"] is not None else 1) for r in rows}
    drawn = budgets(shares, supply, repeats, sum(supply.values()) if total_tokens is None else total_tokens)
    n_periods, each = periods([-(-int(drawn[s]) // block_tokens) for s in names], MOST_SLOTS)
    plan = spark.createDataFrame(
        [(s, i, supply[s], -(-int(drawn[s]) // supply[s]), int(drawn[s]), each[i], n_periods * each[i]) for i, s in enumerate(names) if drawn.get(s, 0) >= 1],
        "source string, source_no int, supply long, copies int, draw long, each long, blocks long",
    )
    period = spark.createDataFrame(earliest_deadline_first(each) if sum(each) else [], "place long, source_no int, in_period long")

    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    starts = hashed.withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(F.broadcast(before) if buckets <= 1000 else before, ["source", "bucket"])
    copies = (
        starts.join(F.broadcast(plan), "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("source_start", F.col("base") + F.col("start") + F.col("copy") * F.col("supply"))
        .where("source_start < draw")
        .withColumn("block", F.least(F.floor(F.col("source_start") / (F.col("draw") / F.col("blocks"))), F.col("blocks") - 1))
        .withColumn("in_period", F.col("block") % F.col("each"))
    )
    timed = copies.join(F.broadcast(period), ["source_no", "in_period"]).withColumn("slot", F.floor(F.col("block") / F.col("each")) * sum(each) + F.col("place"))
    return timed.select("slot", "source", "doc_id", (F.col("copy") + 1).alias("copy_no"), "n_tokens", "source_start")


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, n_docs and n_tokens drawn, most copies of one document, the share reached, and whether it is within one part in a hundred of the target."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("copy_no").alias("most_copies"))
    all_tokens = got.agg(F.sum("n_tokens")).scalar()
    wanted = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    out = wanted.join(got, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("n_tokens") / all_tokens, F.lit(0.0)).alias("share_reached"),
    )
    return out.withColumn("met", F.abs(F.col("share_reached") - F.col("target_share")) <= 0.01)


def mixing_faults(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: what must be 0: n_over documents used more often than allowed, n_uneven ones used twice before another of the source was used once (by the number of copies), and ``n_foreign``, tokens drawn of other sources.

    ``docs`` (doc_id, source, n_tokens) must have each doc_id once.
    """
    wanted = targets.select(source_name("source").alias("source"), "max_repeats").where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    used = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    own = docs.where("n_tokens > 0").select(source_name("source").alias("source"), "doc_id").join(F.broadcast(wanted), "source")
    counts = own.join(used, ["source", "doc_id"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    most = counts.groupBy("source").agg(F.max("c").alias("hi"), F.min("c").alias("lo"), F.count_if(F.col("c") > F.coalesce("max_repeats", F.lit(1))).alias("n_over"))
    foreign = used.join(own.select("source", "doc_id"), ["source", "doc_id"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("f"))
    out = wanted.join(most, "source", "left").join(foreign, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("source", zero(F.col("n_over")).alias("n_over"), zero(F.greatest(F.col("hi") - F.col("lo") - 1, F.lit(0))).alias("n_uneven"), zero(F.col("f")).alias("n_foreign"))
