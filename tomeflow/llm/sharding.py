"""Sharding by longest processing time: the largest groups first, each to the least loaded shard of a heap.

Rows of equal text form a group that stays together. LPT treats groups of equal size alike, so its plan
needs only how many groups of each size there are. Sizes are kept to eleven significant bits (sizes below
2048 are exact), which leaves at most 1024 x 54 size classes for any input; that bounds what the driver
holds and what is broadcast. A class's load is its exact mean size. Few groups of a class go through the
heap one by one; many are first poured to an equal level, which is what the heap would do, and the rest
goes through it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bucket_count, numbered, stored

SIGNIFICANT_BITS = 11


def size_class(size: Column) -> Column:
    """size without the bits after its SIGNIFICANT_BITS highest."""
    low = F.greatest(F.length(F.bin(size)) - SIGNIFICANT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def lpt_plan(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """For each (class, groups, bytes): where each shard's ranks end, shard after shard."""
    heap = [(0.0, s) for s in range(shards)]
    plan = {}
    for size, groups, total in sorted(classes, reverse=True):
        each, left, counts = total / groups, groups, [0] * shards
        if left > 4 * shards:
            loads = dict((s, load) for load, s in heap)
            low, high = 0, max(0, int((max(loads.values()) - min(loads.values())) / each)) + left + 1
            base = min(loads.values())
            fill = lambda level: {s: max(0, int((base + level * each - load) // each)) for s, load in loads.items()}
            while low < high:  # the highest level that the groups fill
                middle = (low + high + 1) // 2
                low, high = (middle, high) if sum(fill(middle).values()) <= left else (low, middle - 1)
            for s, n in fill(low).items():
                counts[s] += n
                left -= n
            heap = [(load + counts[s] * each, s) for load, s in heap]
            heapq.heapify(heap)
        for _ in range(left):
            load, s = heapq.heappop(heap)
            counts[s] += 1
            heapq.heappush(heap, (load + each, s))
        ends, end = [], 0
        for n in counts:
            end += n
            ends.append(end)
        plan[size] = ends
    return plan


def shard_by_size(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Puts every row of docs into a shard; rows of equal text share one.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot (gapless
    from 0 in each shard, by no stated order) and grown_shard (null under this law). A null text counts as
    empty and belongs to the group of empty texts. Repeated rows and null doc_ids are rows like others; an
    empty table gives no rows; other columns of docs are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("total")).withColumn("class", size_class(F.col("total")))
    groups = stored(groups, "shard-groups")
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.sum("total").alias("bytes"))
    plan = lpt_plan([(r["class"], r["groups"], r["bytes"]) for r in classes.collect()], shards)
    plan_rows = spark.createDataFrame(list(plan.items()), "class long, ends array<long>")
    ranked = numbered(groups, ["class"], F.col("group"), "rank", bucket_count(groups.count()), [F.col("group")])
    dealt = ranked.join(F.broadcast(plan_rows), "class").select("group", F.expr("size(filter(ends, e -> e <= rank))").alias("shard"))
    placed = stored(rows.join(dealt, "group").withColumn("row", F.monotonically_increasing_id()), "shard-placed")  # repeated rows are dealt apart by it
    slots = numbered(placed, ["shard"], F.col("row"), "slot", bucket_count(placed.count()), [F.col("row")])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
