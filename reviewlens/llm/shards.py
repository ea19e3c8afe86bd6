"""Shards of equal bytes out of indivisible groups, by Karmarkar-Karp differencing.

A partial partition is a list of as many sums as there are sets. Differencing starts with one partial
partition per group and always combines the two of the largest spread, the one's largest sum with the
other's smallest, until one is left (:func:`difference`). Rows of equal text are one group.

One heap over all groups would be one task. So groups are dealt to buckets of bounded size, and each
bucket's groups are differenced into bundles; bundles are the groups of the next level, until so few are
left that one heap holds them (``TOP``, whatever the input). Groups that hold more than one part in
``BIG`` of all bytes or rows, of which there are at most ``2 * BIG``, go straight to the last heap, where bundles
make up for them: a group above a shard's share gets a shard that nothing else is added to.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.llm.common import saved, text_of

TOP = 4096  # bundles in the last heap, at most
BIG = 2048
PER_TASK = 1 << 14  # groups that one task differences
LEAST_SETS = 8  # bundles of a bucket


def difference(sizes: np.ndarray, sets: int) -> np.ndarray:
    """The set, 0 to ``sets - 1``, of each item; set 0 has the largest sum. Items should come in a fixed
    order (equal spreads are taken in that of the items). No item: an empty array."""
    n = len(sizes)
    into = np.arange(n)  # the item whose set an item has joined
    # sums of a partial partition in falling order, zeros left out, and an item of each of its sets
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, at, sums, items = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        other, theirs = other[::-1], theirs[::-1]
        both = max(len(sums) + len(other) - sets, 0)  # sets in which both have something
        if both:
            into[theirs[:both]] = items[len(items) - both :]
            sums = sums.copy()
            sums[len(sums) - both :] += other[:both]
        sums, items = np.concatenate([sums, other[both:]]), np.concatenate([items, theirs[both:]])
        order = np.argsort(-sums, kind="stable")
        sums, items = sums[order], items[order]
        spread = sums[0] - (sums[-1] if len(sums) == sets else 0)
        heapq.heappush(heap, (-int(spread), at, sums, items))
    out = np.zeros(n, np.int64)
    if heap:
        while not np.array_equal(into, into[into]):
            into = into[into]
        out[heap[0][3]] = np.arange(len(heap[0][3]))
        out = out[into]
    return out


def labelled(items: pd.DataFrame, sets: int) -> np.ndarray:
    """``difference`` in an order that does not depend on that of the rows."""
    order = np.lexsort((items["item"].to_numpy(), -items["size"].to_numpy()))
    out = np.empty(len(items), np.int64)
    out[order] = difference(items["size"].to_numpy()[order], sets)
    return out


def bundled(items: DataFrame, count: int, per_task: int, top: int) -> DataFrame:
    """``items`` (item, size) with their bundle."""
    buckets = -(-count // per_task)
    sets = max(LEAST_SETS, top // buckets)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        bundle = part["bucket"].to_numpy(np.int64) * sets + labelled(part, sets)
        return pd.DataFrame({"item": part["item"], "size": part["size"], "bundle": bundle})

    dealt = items.select("item", "size", F.pmod(F.xxhash64("item", F.lit(7)), F.lit(buckets)).cast("long").alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(run, "item bigint, size bigint, bundle bigint")


def shards_of(groups: DataFrame, shards: int, per_task: int = PER_TASK, top: int = TOP, big: int = BIG) -> tuple[DataFrame, DataFrame]:
    """Of ``groups`` (item, size, n): those that are big and the others, each as (item, shard)."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    heavy = (F.col("size") > F.lit((total["size"] or 0) // big)) | (F.col("n") > F.lit((total["n"] or 0) // big))
    large = groups.filter(heavy).select("item", "size").toPandas()
    level, count, chain = groups.filter(~heavy).select("item", "size"), total["groups"] - len(large), []
    while count > top:
        chain.append(saved(bundled(level, count, per_task, top), "bundles"))
        level = chain[-1].groupBy(F.col("bundle").alias("item")).agg(F.sum("size").alias("size"))
        count = level.count()
    last = pd.concat([large.assign(large=True), level.toPandas().assign(large=False)], ignore_index=True)
    # an item number can be that of a large group and of a bundle
    last["shard"] = labelled(last, shards).astype("int32") if len(last) else pd.Series([], dtype="int32")
    schema = "item bigint, shard int"
    frames = [spark.createDataFrame(last.loc[last["large"] == x, ["item", "shard"]].values.tolist(), schema) for x in (True, False)]
    rest = frames[1]
    for step in reversed(chain):
        rest = step.join(rest.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
    return frames[0], rest


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus one. Rows of equal text share a shard; null text counts as the empty
    text, and is one group with it. The law is ``bytes``: sums of sizes are as near to each other as the groups let them be
    (a group above a shard's share has a shard for itself). Slots number a shard's rows from 0 without
    gaps. Repeated rows, null and repeated doc_ids are rows like others; rows alike in all columns are
    interchangeable. An empty table gives no rows. Other columns are not read.
    """
    hashed = F.xxhash64(text_of(text))  # two texts that share a hash would share a shard, no more
    few = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(text_of(text)) + F.lit(1)).cast("long").alias("size"), F.crc32(text_of(text)).alias("text_crc32"), hashed.alias("item"), F.spark_partition_id().alias("chunk"))
    rows = saved(few, "sizes")
    groups = saved(rows.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    large, rest = shards_of(groups, shards)
    # the join by key never sees a group of many rows: those are large, and their list is bounded
    mine = rows.join(F.broadcast(large.withColumnRenamed("shard", "own")), "item", "left")
    first = mine.filter("own is not null").withColumnRenamed("own", "shard")
    second = mine.filter("own is null").drop("own").join(rest, "item")
    return numbered(saved(first.unionByName(second), "placed"))


def numbered(placed: DataFrame) -> DataFrame:
    """Slots: numbers within (shard, chunk), behind those of the shard's earlier chunks. A chunk is what one task
    read, so no shard is brought into one task; only counts of chunks are summed by shard."""
    counts = placed.groupBy("chunk", "shard").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("chunk", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("chunk", "shard").orderBy("doc_id", "size", "text_crc32", "item"))
    slots = placed.withColumn("place", place).join(starts, ["chunk", "shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
