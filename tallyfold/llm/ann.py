"""Approximate nearest neighbours by largest inner product: a forest of hash prefixes.

Vectors are made equally long by one more component (what their norm lacks to the largest one), so that
the largest inner product is the smallest angle. A tree hashes a vector to 64 signs of random projections, and
is the sorted array of those strings. A query descends in every tree to its longest prefix match and then
ascends in all trees together, one bit at a time and tree by tree, until the trees hold at least ``reach`` of the segment and ``least`` rows for each neighbour asked for, what several hold being counted for each; what they
hold is scored exactly, in double precision.

Equal vectors are one class with its ``k + 1`` smallest ids, which are all that an answer can need. Classes are dealt by
hash into segments of about ``segment_rows``, each with a forest of its own; queries, a stated part of the rows, come in
blocks of up to ``block_rows`` classes, 64 MB of 64 dimensions, each broadcast, searched in one job over all segments, and released. So memory is bounded by one segment and one block,
every row is indexed, no segment is hot, and the plan doesn't grow with the queries. Only ``k + 1`` rows for each query class and segment are passed on.

``reach`` is a share because a query's neighbours need not be close: unstructured vectors (the check tool's are spread evenly over the sphere) need many candidates for the recall asked for.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, that have another size than most
(the smaller of equally frequent ones), or rows with a null id take no part, nor do they as queries. Rows of equal id
and vector count once; an id with several vectors is several candidates, and several queries with a list each. With fewer candidates than ``k``, all are returned; an empty table gives an empty result.
Ties go to the smaller id. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.plans.recovery import reunited, written

FOUND = "q1 long, q2 long, id long, score double"


def planes(trees: int, dims: int, seed: int) -> np.ndarray:
    """Random projections of each tree, the same for all segments, so that a query is hashed once."""
    return np.random.default_rng(seed).standard_normal((trees, dims + 1, 64))


def strings(lifted: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """The hash strings of vectors in each tree."""
    return np.stack([np.packbits(lifted @ p > 0, axis=1).view(">u8")[:, 0].astype(np.uint64) for p in projections])


class Forest:
    def __init__(self, vectors: np.ndarray, longest: float, projections: np.ndarray) -> None:
        self.n = len(vectors)
        lack = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        own = strings(np.column_stack([vectors, lack]), projections)
        self.order = np.argsort(own, axis=1, kind="stable")
        self.sorted = np.take_along_axis(own, self.order, 1)

    def ranges(self, asked: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, where the strings that share ``depth`` bits with each query begin and end."""
        shift = (64 - np.maximum(depth, 1)).astype(np.uint64)
        low = np.where(depth == 0, np.uint64(0), (asked >> shift) << shift)
        high = np.where(depth == 0, np.uint64(2**64 - 1), low | ((np.uint64(1) << shift) - np.uint64(1)))
        return tuple(np.stack([np.searchsorted(s, x[t], side) for t, s in enumerate(self.sorted)]) for x, side in ((low, "left"), (high, "right")))

    def candidates(self, asked: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query, given by its strings, the rows that the trees hold at the longest common depth, one bit less in as many of the first trees as it takes to hold ``least``."""
        depth, top = np.zeros(asked.shape[1], np.int64), np.full(asked.shape[1], 64)
        while (depth < top).any():
            middle = (depth + top + 1) // 2
            begin, end = self.ranges(asked, middle)
            enough = (end - begin).sum(0) >= least
            depth, top = np.where(enough, middle, depth), np.where(enough, top, middle - 1)
        begin, end = self.ranges(asked, depth)
        deep_begin, deep_end = self.ranges(asked, np.minimum(depth + 1, 64))
        deep = (deep_end - deep_begin).sum(0) + np.cumsum((end - begin) - (deep_end - deep_begin), axis=0)  # with the first trees one bit less deep
        needed = np.minimum((deep < least).sum(0) + 1, len(self.sorted))
        shallow = (np.arange(len(self.sorted))[:, None] < needed) | (depth == 64)
        begin, end = np.where(shallow, begin, deep_begin), np.where(shallow, end, deep_end)
        for q in range(asked.shape[1]):
            held = np.zeros(self.n, bool)
            for t in range(len(self.sorted)):
                held[self.order[t, begin[t, q] : end[t, q]]] = True
            yield np.flatnonzero(held)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


#: Queries searched at once in a segment.
AT_ONCE = 2048


def _nearest(own: np.ndarray, ids: list[list[int]], forest: Forest, q1: np.ndarray, q2: np.ndarray, asked: np.ndarray, hashed: np.ndarray, k: int, entries: int) -> pa.RecordBatch:
    least_ids, out = np.array([i[0] for i in ids]), []
    for q, rows in enumerate(forest.candidates(hashed, entries)):
        score = own[rows] @ asked[q]
        if len(rows) > 4 * k:
            # Not fewer than k + 1, and all that equal the last of them.
            bar = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            rows, score = rows[score >= bar], score[score >= bar]
        for r in np.lexsort((least_ids[rows], -score)):
            out += [(score[r], i, q) for i in ids[rows[r]]]
        # Of equal scores, the smaller ids, whatever class they are in.
        first = len(out) - sum(len(ids[r]) for r in rows)
        out[first:] = sorted(out[first:], key=lambda x: (-x[0], x[1]))[: k + 1]
    score, found, number = (np.array(x) for x in zip(*out, strict=True)) if out else (np.empty(0), np.empty(0), np.empty(0))
    number = number.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(q1[number]), pa.array(q2[number]), pa.array(found.astype(np.int64)), pa.array(score.astype(np.float64))], ["q1", "q2", "id", "score"])


def searcher(queries: Broadcast, dims: int, k: int, trees: int, reach: float, least: int, longest: float, seed: int):
    """The search of segments (segment, v, ids), one after the other, for the queries (h1, h2, vectors) of one block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q1, q2, asked = queries.value
        projections, hashed = planes(trees, dims, seed), None

        def close(own: list, ids: list) -> Iterator[pa.RecordBatch]:
            nonlocal hashed
            if hashed is None:
                hashed = strings(np.column_stack([asked, np.zeros(len(asked))]), projections)
            own = np.array(own, np.float64)
            forest = Forest(own, longest, projections)
            for at in range(0, len(q1), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                yield _nearest(own, ids, forest, q1[part], q2[part], asked[part], hashed[:, part], k, max(least * k, int(reach * len(own))))

        segment, own, ids = None, [], []
        for batch in batches:  # sorted, so that the rows of a segment are neighbours, over batches too
            for s, v, i in zip(batch.column("segment").to_pylist(), batch.column("v").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s != segment and own:
                    yield from close(own, ids)
                    own, ids = [], []
                segment = s
                own.append(v)
                ids.append(i)
        if own:
            yield from close(own, ids)

    return search


def neighbours(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = 64, reach: float = 0.8, least: int = 100,
    segment_rows: int = 4096, block_rows: int = 131_072, seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query row (``is_query``, a condition on ``vectors``)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = sizes[0]["d"] if sizes else 1
    rows = rows.where(F.size("v") == dims).select("id", "v", "is_query", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(seed), "v").alias("h2"))
    rows = rows.groupBy("id", "h1", "h2").agg(F.any_value("v").alias("v"), F.bool_or("is_query").alias("is_query"))
    rows = written(rows, "vectors")
    # The smallest ids of a class, taken in two steps, so that a vector with many ids is no group of one task.
    shard = F.pmod(F.xxhash64("id"), F.lit(64))
    smallest = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("id")) <= k + 1
    some = rows.select("id", "h1", "h2", "v", shard.alias("shard")).withColumn("kept", smallest(["h1", "h2", "shard"])).where("kept")
    some = some.withColumn("kept", smallest(["h1", "h2"])).where("kept")
    classes = some.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.any_value("v").alias("v"))
    classes = written(classes, "vector-classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    segments, longest = max(1, -(-facts["n"] // segment_rows)), float(facts["norm"] or 0) ** 0.5
    dealt = classes.select(F.pmod(F.col("h2"), F.lit(segments)).cast("int").alias("segment"), "v", "ids").repartition(segments, "segment").sortWithinPartitions("segment")

    asked = written(rows.where("is_query").groupBy("h1", "h2").agg(F.any_value("v").alias("v")), "queries")
    blocks, lists = max(1, -(-asked.count() // block_rows)), []
    best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id"))
    for b in range(blocks):
        block = asked.where(F.pmod("h1", F.lit(blocks)) == b).toPandas()
        queries = spark.sparkContext.broadcast((block["h1"].to_numpy(np.int64), block["h2"].to_numpy(np.int64), np.array(block["v"].tolist(), np.float64).reshape(-1, dims)))
        found = dealt.mapInArrow(searcher(queries, dims, k, trees, reach, least, longest, seed), FOUND)
        top = found.withColumn("n", best).where(F.col("n") <= k + 1).groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
        lists.append(written(top, "nearest"))
        queries.unpersist()
    lists = reunited(lists)
    mine = rows.where("is_query").select("id", "h1", "h2")
    pairs = mine.join(lists, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))).select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    flat = pairs.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "x"))
    return flat.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(key), "x.score")
