"""Sharding by longest-processing-time scheduling.

Groups that must stay together go, largest first, each to the shard that has
the least bytes so far, kept in a heap.  Only a bounded number of items is
scheduled: groups of more than ``1 / (grain * shards)`` of all bytes are items
of their own (there can be at most ``grain * shards`` of them), all other
groups are gathered by a hash of their key into ``grain * shards`` bundles.
The schedule therefore has at most ``2 * grain * shards`` items at any size of
the input, and a shard's bytes differ from the mean by about one item, unless
one group alone exceeds a shard.

Slots number the rows of a shard from 0 without gaps: rows of a shard are
dealt to ``lanes`` by a hash of all their columns, lanes are counted, and a row's
slot is its lane's offset plus its place in the lane.

Null keys form one group; a null size counts as 0.  Rows that are wholly alike
get different slots.  An empty table gives an empty table.  Input columns named
like an output are replaced, so ``key``, ``size`` and ``order`` may not be; any
other name is kept.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def schedule(items: list[tuple[int, object]], shards: int) -> dict:
    """Longest processing time first: ``{item: shard}`` of ``(size, item)``."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_groups(df: DataFrame, key: str, size: str, shards: int, order: str, grain: int = 256, lanes: int = 256) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; rows of equal ``key`` share a shard.

    ``key`` and ``size`` (bytes) are columns of ``df``; ``order`` is the column
    by which a lane's rows are numbered.
    """
    spark = df.sparkSession
    kept = [F.col(f"r.`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]
    # the input's row is one column, so that no name of it meets one of the names below
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    rows = df.select(row.alias("r"), F.col(key).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("b"), F.col(order).alias("o"))
    rows = rows.withColumns({"g": F.coalesce(F.col("k").cast("string"), F.lit("")), "none": F.col("k").isNull()})
    groups = rows.groupBy("g", "none").agg(F.sum("b").alias("bytes"))
    total = rows.agg(F.sum("b")).first()[0] or 0
    bound = total / (grain * shards)
    bundle = F.pmod(F.xxhash64("g", "none"), F.lit(grain * shards)).cast("int")
    item = F.when(F.col("bytes") > bound, F.concat_ws(":", F.col("g"), F.col("none").cast("string")))
    # the same rule on both sides: a large group is known by its name, the others by their bundle
    sized = groups.select(F.coalesce(item, bundle.cast("string")).alias("item"), item.isNotNull().alias("large"), "bytes")
    loads = sized.groupBy("item", "large").agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 * grain * shards rows
    placed = schedule([(x["bytes"], (x["item"], x["large"])) for x in loads], shards)
    table = spark.createDataFrame([(i, large, s) for (i, large), s in placed.items()], "item string, large boolean, shard int")
    big = table.where("large").select(F.col("item").alias("big_item"), F.col("shard").alias("big_shard"))
    small = table.where("not large").select(F.col("item").cast("int").alias("small_item"), F.col("shard").alias("small_shard"))
    dealt = (
        rows.withColumn("big_item", F.concat_ws(":", F.col("g"), F.col("none").cast("string")))
        .withColumn("small_item", bundle)
        .join(F.broadcast(big), "big_item", "left")
        .join(F.broadcast(small), "small_item", "left")
        .select("r", "o", F.coalesce("big_shard", "small_shard").alias("shard"), F.pmod(F.xxhash64("r"), F.lit(lanes)).cast("int").alias("lane"))
    )
    counts = dealt.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("o"))
    slots = dealt.withColumn("place", place).join(F.broadcast(offsets), ["shard", "lane"])
    return slots.select(*kept, "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
