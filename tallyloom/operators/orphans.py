"""References to records that don't exist, or don't exist yet or any longer, when they are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import BROADCAST_BYTES, looked_up, measured, written

#: Bits of the filter for each parent key, and of a segment (a power of two); how many positions of a segment a key sets, and how many of them one 64-bit hash gives.
BITS_PER_KEY, SEGMENT_BITS, HASHES, PER_HASH = 12, 1 << 17, 6, 3


def _positions(key: Column) -> list[Column]:
    """The bits a key sets in its segment: disjoint slices of two 64-bit hashes."""
    width = SEGMENT_BITS.bit_length() - 1
    hashes = [F.xxhash64(key), F.xxhash64(F.lit("second"), key)]
    return [F.shiftrightunsigned(hashes[i // PER_HASH], width * (i % PER_HASH)).bitwiseAND(F.lit(SEGMENT_BITS - 1)).cast("int") for i in range(HASHES)]


def _segment(key: Column, segments: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), segments.cast("long")).cast("int")


def bloom_filter(parents: DataFrame) -> DataFrame:
    """The Bloom filter of (target, key) rows, each once: target, segments (how many the target has), segment, words (SEGMENT_BITS bits in 64-bit words).

    A key belongs to one segment of its target by a hash, and there are as many segments as its target's keys need at BITS_PER_KEY, so the filter proves as much for a thousand million
    keys as for a thousand. Executors set the bits; words are merged per word, then laid out as one array a segment, with all its words.
    """
    sizes = parents.groupBy("target").agg(F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / SEGMENT_BITS).cast("int").alias("segments"))
    at = F.explode(F.array(*_positions(F.col("key")))).alias("at")
    bits = parents.join(F.broadcast(sizes), "target").select("target", "segments", _segment(F.col("key"), F.col("segments")).alias("segment"), at)
    words = bits.select("target", "segments", "segment", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, at & 63)").alias("mask"))
    none = sizes.select("target", "segments", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment")).withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS // 64 - 1))))
    merged = words.unionByName(none.withColumn("mask", F.lit(0).cast("long"))).groupBy("target", "segments", "segment", "word").agg(F.bit_or("mask").alias("mask"))
    laid = merged.groupBy("target", "segments", "segment").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("w"))
    return laid.select("target", "segments", "segment", F.col("w.mask").alias("words"))


def probed(asked: DataFrame, bloom: DataFrame) -> DataFrame:
    """``asked`` (target, key, ...) with ``__maybe``, false where the filter proves that no parent has the key. The filter's segments meet the keys by a join, broadcast if they are few enough."""
    sizes = F.broadcast(bloom.select(F.col("target").alias("__t"), "segments").distinct())
    placed = asked.join(sizes, F.col("target") == F.col("__t"), "left").withColumn("__s", _segment(F.col("key"), F.col("segments"))).drop("__t", "segments")
    held = bloom.select(F.col("target").alias("__t"), F.col("segment").alias("__n"), "words")
    fits = bloom.count() * SEGMENT_BITS // 8 <= BROADCAST_BYTES
    met = placed.join(F.broadcast(held) if fits else held, (F.col("target") == F.col("__t")) & (F.col("__s") == F.col("__n")), "left")
    there = F.col("words").isNotNull()
    for i, at in enumerate(_positions(F.col("key"))):
        met = met.withColumn(f"__at{i}", at)
        there &= F.expr(f"shiftright(get(words, shiftright(__at{i}, 6)), __at{i} & 63) & 1") == 1
    return met.withColumn("__maybe", there).select(*asked.columns, "__maybe")


def find_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references (target, key, made_at, ...) that name no record of their target in force, with ``reason``.

    ``parents`` has target, key, known_from, known_until, one row per row of the parent tables; targets are a bounded list. A reference is missing if no row has its target and key, early if the earliest
    known_from is later than made_at, deleted if the earliest known_until isn't later than made_at. References without a key, and parents without one, count for nothing; a null
    made_at can't be early or deleted. All further columns of the references are kept (but a column reason is replaced), one row for each reference row that is a case.

    A Bloom filter of the parents proves most missing references; only those it can't rule out are verified by an exact join. If the parents are few enough, both are broadcast to the references. Else
    the references are first summed up to their distinct keys with the first and last time each was made; the keys the filter rules out are cases without any join, the others are verified, and only the keys
    that can be a case come back to the references, broadcast if few. If not, a key with very many references is met in as many places as they need (see ``looked_up``).
    """
    kept = [c for c in references.columns if c != "reason"]
    terms = written(
        parents.where(F.col("key").isNotNull() & F.col("target").isNotNull()).groupBy("target", "key").agg(F.min("known_from").alias("__from"), F.min("known_until").alias("__until")),
        "parents",
    )
    bloom = written(bloom_filter(terms.select("target", "key")), "filter")
    exact = terms.select(F.col("target").alias("__target"), F.col("key").alias("__key"), "__from", "__until", F.lit(True).alias("__there"))
    same = F.col("target") == F.col("__target")
    asked = references.where(F.col("key").isNotNull())
    if measured(terms) <= BROADCAST_BYTES:
        # What the filter rules out gets a null join key and is looked up nowhere.
        joined = probed(asked, bloom).join(F.broadcast(exact), same & (F.when(F.col("__maybe"), F.col("key")) == F.col("__key")), "left")
    else:
        keys = written(probed(asked.groupBy("target", "key").agg(F.min("made_at").alias("lo"), F.max("made_at").alias("hi")), bloom), "keys")
        found = keys.where("__maybe").join(exact, same & (F.col("key") == F.col("__key")), "left")
        doubtful = F.col("__there").isNull() | (F.col("lo") < F.col("__from")) | (F.col("hi") >= F.col("__until"))
        of_case = ["target", "key", "__from", "__until", "__there"]
        none = keys.where("NOT __maybe").withColumns({c: F.lit(None).cast(exact.schema[c].dataType) for c in ("__from", "__until", "__there")})
        troubled = written(found.where(doubtful).select(*of_case).unionByName(none.select(*of_case)), "troubled")
        joined = looked_up(asked, troubled, ["target", "key"])
    reason = (
        F.when(F.col("__there").isNull(), F.lit("missing")).when(F.col("__from") > F.col("made_at"), F.lit("early")).when(F.col("__until") <= F.col("made_at"), F.lit("deleted"))
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*kept, "reason")

