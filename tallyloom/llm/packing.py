"""Filling containers of a fixed capacity with documents, by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written

#: Items that one task packs in a row, and most capacities that are tried.
SHARD_ITEMS, MOST_SPECS = 20_000, 100


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item, in order of arrival, and each container's fill. Sizes are from 1 to the capacity.

    ``open_at[h]`` counts the containers filled to h. An item goes where the sum of the squared counts of partly filled containers grows least: into one at level h, or a new one (level
    0); of equal choices, the fullest.
    """
    open_at = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, fill = np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        # From level h to h + s: 2 * (count at h + s, unless that is full) - 2 * (count at h) + 2; a new one only adds.
        gain = open_at[s : capacity + 1] - open_at[: capacity - s + 1] + 1
        gain[-1] -= open_at[capacity] + (1 if s < capacity else 0)
        usable = open_at[: capacity - s + 1] > 0
        usable[0] = True
        twice = 2 * gain
        twice[0] = 2 * open_at[s] + 1 if s < capacity else 0
        if s < capacity:
            twice[-1] = 1 - 2 * open_at[capacity - s]
        twice[~usable] = np.iinfo(np.int64).max
        h = len(twice) - 1 - int(np.argmin(twice[::-1]))
        if h:
            box = stacks[h].pop()
            open_at[h] -= 1
        else:
            box = len(fill)
            fill.append(0)
        where[i] = box
        fill[box] = h + s
        if h + s < capacity:
            open_at[h + s] += 1
            stacks[h + s].append(box)
    return where, np.array(fill, np.int64)


def pack(items: DataFrame, specs: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The place of each piece of each item in a container, for each capacity: spec_id, container_id, doc_id, piece_no, tok_start, tok_end.

    ``items`` has doc_id and n_tokens, ``specs`` spec_id and capacity_tokens (at most MOST_SPECS rows; null or non-positive capacities give nothing). An item is split only if it alone exceeds the
    capacity: into full pieces, each a container of its own, and a rest that is packed like an item. Empty items (0 tokens or null) take no room and come out with a null container. Repeated rows
    are items of their own: each input row is written with a number of its own first, by which its pieces' containers are named.

    Items are dealt to shards of about ``shard_items`` by a hash; each task packs its shard online by the sum of squares. Containers that stay partly filled are items of a second round, packed
    in the same way, in as many fewer shards; so the room left by the shards is closed over all of them.
    """
    sized = written(items.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("item")), "items")
    shards = max(1, -(-sized.count() // shard_items))
    caps = specs.where("capacity_tokens > 0").select("spec_id", F.col("capacity_tokens").cast("long").alias("cap")).distinct().limit(MOST_SPECS + 1).collect()
    if len(caps) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} capacities")
    kind, spec = items.schema["doc_id"].dataType.simpleString(), specs.schema["spec_id"].dataType.simpleString()
    each = F.array(*[F.struct(F.lit(r["spec_id"]).cast(spec).alias("spec_id"), F.lit(r["cap"]).cast("long").alias("cap")) for r in caps]) if caps else F.array().cast(f"array<struct<spec_id: {spec}, cap: bigint>>")
    tried = sized.select("doc_id", "n", "item", F.explode(each).alias("s")).select("doc_id", "n", "item", "s.*")  # a row of the item for each capacity tried
    cut = tried.withColumn("full", F.floor(F.col("n") / F.col("cap"))).withColumn("rest", F.col("n") - F.col("full") * F.col("cap"))
    whole = cut.where("full > 0").select("spec_id", "doc_id", "item", "cap", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no")).select(
        "spec_id",
        F.concat_ws("-", F.lit("f"), "spec_id", "item", "piece_no").alias("container_id"),
        "doc_id",
        F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("piece_no") * F.col("cap")).alias("tok_start"),
        ((F.col("piece_no") + 1) * F.col("cap")).alias("tok_end"),
    )
    empty = cut.where("n = 0").select("spec_id", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("tok_start"), F.lit(0).cast("long").alias("tok_end"))

    def first_round(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "item"], kind="stable")
        where, fill = sum_of_squares(part["rest"].to_numpy(), int(part["cap"].iloc[0]))
        return pd.DataFrame({"spec_id": part["spec_id"], "cap": part["cap"], "doc_id": part["doc_id"], "full": part["full"], "rest": part["rest"], "shard": part["shard"], "box": where, "fill": fill[where]})

    rests = cut.where("rest > 0").withColumn("h", F.xxhash64("doc_id", "item")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("long"))
    packed = written(
        rests.groupBy("spec_id", "shard").applyInPandas(first_round, f"spec_id {spec}, cap long, doc_id {kind}, full long, rest long, shard long, box long, fill long"), "packed"
    )
    partly = packed.where("fill < cap").select("spec_id", "cap", "shard", "box", "fill").distinct()
    again = max(1, -(-partly.count() // shard_items))

    def second_round(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "shard", "box"], kind="stable")
        where, _ = sum_of_squares(part["fill"].to_numpy(), int(part["cap"].iloc[0]))
        return pd.DataFrame({"spec_id": part["spec_id"], "shard": part["shard"], "box": part["box"], "group": part["g"], "joint": where})

    joint = (
        partly.withColumn("h", F.xxhash64("shard", "box"))
        .withColumn("g", F.pmod("h", F.lit(again)).cast("long"))
        .groupBy("spec_id", "g")
        .applyInPandas(second_round, f"spec_id {spec}, shard long, box long, group long, joint long")
    )
    placed = packed.join(joint, ["spec_id", "shard", "box"], "left").select(
        "spec_id",
        F.when(F.col("joint").isNull(), F.concat_ws("-", F.lit("a"), "spec_id", "shard", "box")).otherwise(F.concat_ws("-", F.lit("b"), "spec_id", "group", "joint")).alias("container_id"),
        "doc_id",
        F.col("full").cast("int").alias("piece_no"),
        (F.col("full") * F.col("cap")).alias("tok_start"),
        (F.col("full") * F.col("cap") + F.col("rest")).alias("tok_end"),
    )
    return placed.unionByName(whole).unionByName(empty)


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per capacity: n_containers, n_tokens, and the share of the room that is filled."""
    per = packed.where(F.col("container_id").isNotNull()).groupBy("spec_id", "container_id").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("t"))
    per = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return per.join(F.broadcast(specs.select("spec_id", "capacity_tokens")), "spec_id").withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def packing_faults(packed: DataFrame, items: DataFrame, specs: DataFrame) -> DataFrame:
    """Per capacity: n_docs placed, and what must be 0: n_overfull containers, n_untiled documents (their pieces don't cover their tokens once), n_needless ones (split though they would fit).

    ``items`` must have each doc_id once.
    """
    cap = F.broadcast(specs.where("capacity_tokens > 0").select("spec_id", F.col("capacity_tokens").cast("long").alias("cap")).distinct())
    fills = packed.where("container_id IS NOT NULL").groupBy("spec_id", "container_id").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("t")).join(cap, "spec_id")
    over = fills.groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("cap")).alias("n_overfull"))
    pieces = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("tok_start").alias("lo"), F.max("tok_end").alias("hi"), F.sum(F.col("tok_end") - F.col("tok_start")).alias("t"), F.countDistinct("piece_no").alias("p"))
    held = pieces.join(items.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n")), "doc_id").join(cap, "spec_id")
    tiled = (F.col("lo") == 0) & (F.col("hi") == F.col("n")) & (F.col("t") == F.col("n")) & (F.col("p") == F.col("k"))
    docs = held.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~tiled).alias("n_untiled"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("cap"))).alias("n_needless"))
    return docs.join(over, "spec_id", "left").select("spec_id", "n_docs", F.coalesce("n_overfull", F.lit(0)).alias("n_overfull"), "n_untiled", "n_needless")
