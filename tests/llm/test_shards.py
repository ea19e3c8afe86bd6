"""Shards by differencing: the heap against plain differencing, and the laws of the rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.llm import queries, shards


def plain_sums(sizes, sets):
    """Differencing with whole lists of sums."""
    parts = [(-s, i, [s] + [0] * (sets - 1)) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort()
        (_, i, a), (_, _, b), *parts = parts
        c = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        parts.append((c[-1] - c[0], i, c))
    return parts[0][2] if parts else [0] * sets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 9))
def test_difference_is_differencing(sizes, sets):
    found = shards.difference(np.array(sizes, np.int64), sets)
    assert np.bincount(found, sizes, sets).tolist() == plain_sums(sizes, sets) if sizes else len(found) == 0


def laws(rows, texts, n):
    """The laws that hold for any sharding; returns the shards' sums."""
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
    slots, of_text, sums = defaultdict(list), defaultdict(set), Counter()
    size_of = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert size_of == Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    for r in rows:
        slots[r.shard].append(r.slot)
        of_text[r.size, r.text_crc32].add(r.shard)
        sums[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in of_text.values())
    return [sums[i] for i in range(n)]


def test_sf_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    sums = laws(shards.shard(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 8)
    assert max(sums) - min(sums) <= 8


@pytest.mark.parametrize("third", [False, True])
def test_edges_and_hot_group(spark, third):
    texts = [(1, None), (2, ""), (None, None), (None, "no id"), (3, "é😀 \0"), (4, "x" * 200_000), (4, "x" * 200_000), (4, "other")] + [(10 + i, f"text {i * i}") for i in range(300)]
    texts += [(1000 + i, "hot" * 4000) for i in range(150)] if third else []
    df = spark.createDataFrame([(d, t, "x", 1, None, 9) for d, t in texts], "doc_id long, text string, item string, shard int, chunk int, size int").repartition(5)
    sums = laws(shards.shard(df, 4).collect(), texts, 4)
    heavy = sorted(sums)[::-1]
    assert heavy[0] == (150 * 12001 if third else 2 * 200_001)
    # the heavy group gets nothing more, and with two of them the rest is shared by the others
    assert heavy[-2] - heavy[-1] <= 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shards.shard(df).count() == 0
    assert shards.shard(df.select("doc_id", F.lit(None).cast("string").alias("text"))).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_many_levels(spark):
    """Small buckets: several levels of bundles keep each item once and the sums near."""
    groups = spark.range(3000).select(F.col("id").alias("item"), (F.col("id") % 97 + 1).alias("size"), F.lit(1).alias("n"))
    large, rest = shards.shards_of(groups, 4, per_task=50, top=100, big=1000)
    found = large.union(rest).join(groups, "item").groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == 3000 and large.count() == 0
    assert max(r.s for r in found) - min(r.s for r in found) <= 100
