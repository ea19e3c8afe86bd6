"""Exact search for the largest inner products by a Voronoi k-nearest-neighbour join.

With one more component, sqrt(M - |x|^2) for data (M: the largest squared norm) and 0 for queries, the
largest inner products are the nearest neighbours, so distances and their bounds apply:

1. Every vector goes to the nearest of a bounded number of pivots. Per cell of data: number, smallest
   distances to the pivot; per cell of queries: number, largest distance.
2. From these summaries each query cell gets a bound on the distance of its k-th neighbour, and from it, for
   every data cell, the interval of pivot distances outside which no neighbour can lie.
3. Queries are grouped by cell, large cells split by hash; a data row is sent only to the groups whose
   interval it lies in, in slices by hash, so that a task has a bounded number of either kind. A group has as many
   slices, and its queries as many copies, as the rows that are left for it ask for.
4. Every task finds the k best of its slice; a query's lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import saved

PIVOTS = 64
QUERIES_PER_GROUP = 2048
ROWS_PER_SLICE = 16384
AT_ONCE = 128  # queries multiplied with a slice at a time
SLACK = 1e-6  # for rounding of distances


def scaled(vector: Column, factor: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def assigned(vectors: DataFrame, pivots: np.ndarray, largest: int) -> DataFrame:
    """Rows (query, cell, dist, vec_id, v): every vector as data, and once more if it is a query."""
    height = np.sqrt(np.maximum(largest - (pivots.astype(float) ** 2).sum(1), 0))
    width = pivots.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((pivots.astype(float), height))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, p_height = shared.value
        for batch in batches:
            x = matrix(batch["v"], width).astype(float)
            norm = (x**2).sum(1)
            inner = x @ p.T
            asked = np.flatnonzero(batch["is_query"].to_numpy(zero_copy_only=False))
            as_data = 2.0 * largest - 2.0 * (inner + np.sqrt(np.maximum(largest - norm, 0))[:, None] * p_height)
            as_query = (norm + largest)[asked, None] - 2.0 * inner[asked]
            for query, squared, rows in ((False, as_data, np.arange(len(x))), (True, as_query, asked)):
                squared = np.maximum(squared, 0)
                cell = squared.argmin(1).astype(np.int32)
                dist = np.sqrt(squared[np.arange(len(rows)), cell])
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), query)), pa.array(cell), pa.array(dist), taken["vec_id"], taken["v"]], ["query", "cell", "dist", "vec_id", "v"])

    return vectors.mapInArrow(run, "query boolean, cell int, dist double, vec_id bigint, v array<bigint>")


def summaries(points: DataFrame, k: int) -> tuple[list, list]:
    """Per query cell (cell, n, farthest); per data cell (cell, nearest k + 1 distances). At most ``PIVOTS``
    rows of each. The nearest are cut in slices before a cell's rows meet."""
    queries = points.filter("query").groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()
    data = points.filter("NOT query").select("cell", "dist", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("slice"))
    for by in (("cell", "slice"), ("cell",)):
        data = data.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("dist"))).filter(F.col("r") <= k + 1).drop("r")
    return queries, data.groupBy("cell").agg(F.sort_array(F.collect_list("dist")).alias("near")).collect()


def routes(queries: list, data: list, pivots: np.ndarray, largest: int, k: int) -> tuple[list, list]:
    """Query cell -> (cell, group, salts), and (group, salts, cell, lowest, highest pivot distance) of the
    data that a group needs. Both have at most ``PIVOTS`` squared rows."""
    p = pivots.astype(float)
    height = np.sqrt(np.maximum(largest - (p**2).sum(1), 0))
    between = np.sqrt(np.maximum(2.0 * largest - 2.0 * (p @ p.T + np.outer(height, height)), 0))
    groups, held = [], 0
    for q in sorted(queries, key=lambda q: q["cell"]):
        if groups and held + q["n"] <= QUERIES_PER_GROUP:
            groups[-1].append(q)
            held += q["n"]
        else:
            groups.append([q])
            held = q["n"]
    to_group, needed = [], []
    for g, cells in enumerate(groups):
        salts = -(-sum(q["n"] for q in cells) // QUERIES_PER_GROUP)
        to_group += [(q["cell"], g, salts) for q in cells]
        span: dict[int, tuple[float, float]] = {}
        for q in cells:
            i, far = q["cell"], q["far"]
            reach = np.sort(np.concatenate([far + between[i, d["cell"]] + np.array(d["near"]) for d in data])) if data else np.zeros(0)
            bound = reach[k] if len(reach) > k else np.inf
            slack = SLACK * (1.0 + 2.0 * np.sqrt(largest))
            for d in data:
                low, high = between[i, d["cell"]] - far - bound - slack, between[i, d["cell"]] + far + bound + slack
                a, b = span.get(d["cell"], (np.inf, -np.inf))
                span[d["cell"]] = (min(a, low), max(b, high))
        needed += [(g, salts, cell, float(a), float(b)) for cell, (a, b) in span.items()]
    return to_group, needed


def remaining(points: DataFrame, intervals: DataFrame) -> dict[int, int]:
    """Group -> how many data rows lie in its intervals; only cells and distances are read."""
    left = points.filter("NOT query").select("cell", "dist").join(intervals.select("task_group", "cell", "low", "high"), "cell")
    return {r["task_group"]: r["n"] for r in left.filter(F.col("dist").between(F.col("low"), F.col("high"))).groupBy("task_group").agg(F.count("*").alias("n")).collect()}


def solve(queries: pa.Table, data: pa.Table, k: int) -> pa.Table:
    """The k best rows of ``data`` for every query: largest score, then smallest id, never the query's own id."""
    width = max([0, *(len(v) for t in (queries, data) for v in t["v"].combine_chunks())]) if queries.num_rows and data.num_rows else 0
    out: list[tuple] = []
    if width or (queries.num_rows and data.num_rows):
        data = data.sort_by("vec_id")
        ids, x = data["vec_id"].to_numpy(), matrix(data["v"], width)
        asked, q = queries["vec_id"].to_numpy(), matrix(queries["v"], width)
        exact = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < 1 << 20  # products are exact in floats
        x = x.T.astype(float) if exact else x.T
        m = len(ids)
        for a in range(0, len(asked), AT_ONCE):
            scores = (q[a : a + AT_ONCE].astype(x.dtype) @ x).astype(np.int64)
            key = scores * m + np.arange(m - 1, -1, -1)
            own = asked[a : a + AT_ONCE, None] == ids
            key[own] = -np.iinfo(np.int64).max
            top = np.argpartition(-key, min(k, m) - 1, axis=1)[:, : min(k, m)] if m > k else np.tile(np.arange(m), (len(key), 1))
            row = np.repeat(np.arange(len(key)), top.shape[1])
            keep = ~own[row, top.ravel()]
            out.append((asked[a : a + AT_ONCE][row][keep], ids[top.ravel()][keep], scores[row, top.ravel()][keep]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, factor: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every query with all other rows, on
    components floor(``factor`` * x).

    Vectors that are null or hold null or non-finite components take no part; vectors of fewer components
    count as filled with zeros. Rows with the query's own id are not its candidates. A query without
    candidates has no rows; a table without vectors gives none. Of equal scores the smaller ids come first. Rows that
    share an id are candidates each, so an id can stand in a list more than once; as queries they are one, whose list has the
    best scores of all of them. Squared norms and products beyond 2 ** 63 end the job with an arithmetic error.
    """
    spark = rows.sparkSession
    source = rows.filter(valid(F.col(vector)) & F.col(vec_id).isNotNull())
    vectors = source.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), factor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    squared = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    facts = vectors.agg(F.max(squared).alias("largest"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], empty)
    largest, width = facts["largest"], max(facts["width"], 1)
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").toArrow()
    pivots = np.unique(matrix(chosen["v"], width), axis=0)
    points = saved(assigned(vectors, pivots, largest), "voronoi-cells")
    to_group, needed = routes(*summaries(points, k), pivots, largest, k)
    intervals = spark.createDataFrame(needed, "task_group int, salts int, cell int, low double, high double")
    left = remaining(points, intervals)
    slices = spark.createDataFrame([(g, -(-n // ROWS_PER_SLICE)) for g, n in left.items()], "task_group int, slices long")  # a row per group
    query_side = (
        points.filter("query")
        .join(spark.createDataFrame(to_group, "cell int, task_group int, salts int"), "cell")
        .join(slices, "task_group")
        .withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    )
    data_side = (
        points.filter("NOT query")
        .join(intervals, "cell")
        .filter(F.col("dist").between(F.col("low"), F.col("high")))
        .join(slices, "task_group")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))
        .withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")))
    )
    keys = ("task_group", "salt", "slice")
    columns = (*keys, "vec_id", "v")
    query_side, data_side = query_side.select(*columns).toDF(*columns), data_side.select(*columns).toDF(*columns)  # names of their own
    found = query_side.groupBy(*keys).cogroup(data_side.groupBy(*keys)).applyInArrow(lambda q, d: solve(q, d, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
