"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Rows are dealt evenly over shards of bounded size.  A shard keeps its distinct vectors once (equal vectors hang on one
node with all their ids, so copies neither break the graph nor lose a row), draws a level for each node, and links each
level by the usual diversity rule into one flat neighbour array.  Graphs are rows of a table in the shared folder.
Queries travel in blocks; each block meets each shard's graph, descends greedily and widens its search on the ground
level, and the shards' nearest are merged by distance, then id.  Distances are Euclidean, in double precision, on the
original vectors.

Defined cases: null, empty, all-zero vectors and those with null or non-finite components take no part, nor do rows with
a null id, nor vectors of another length than most of the table (the longest of equally frequent lengths); a query is
never its own candidate, but other rows with equal vectors are; where an id repeats, the smallest of its vectors asks and
the nearest of them is found; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import Scratch, lean

NEAREST = 10
QUERY_EVERY = 100
#: Vectors of a shard at most, about; and shards at least, so that small tables also use several tasks.
SHARD_ROWS, LEAST_SHARDS = 8192, 8
LINKS, POOL, BREADTH = 16, 64, 200
QUERY_BLOCK_BITS = 8
#: Parts that a shard's blocks of queries are dealt over.
PARTS = 16
U = np.uint64


def _usable(column: str) -> F.Column:
    v = F.col(column)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def _distances(vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = vectors - at
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _diverse(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> list[int]:
    """Candidates, nearest first, that are closer to the node than to any neighbour already chosen; then the nearest rest."""
    among = _square(vectors[ids], vectors[ids])
    chosen: list[int] = []
    for k in range(len(ids)):
        if len(chosen) == most:
            break
        if not chosen or dist[k] < among[k, chosen].min():
            chosen.append(k)
    if len(chosen) < most:
        rest = [k for k in range(len(ids)) if k not in set(chosen)]
        chosen += rest[: most - len(chosen)]
    return ids[chosen].tolist()


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _level(vectors: np.ndarray, nodes: np.ndarray, links: int, pool: int) -> np.ndarray:
    """Flat neighbour rows (node, 2 * links), -1 where there is none: chosen links and links back, pruned alike."""
    v = vectors[nodes]
    n, near = len(nodes), []
    for lo in range(0, n, 1024):
        d = _square(v[lo : lo + 1024], v)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        k = min(pool, n - 1)
        best = np.argpartition(d, k - 1, 1)[:, :k] if k else np.zeros((len(d), 0), int)
        order = np.take_along_axis(d, best, 1).argsort(1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        near += [_diverse(v, best[r], np.take(d[r], best[r]), links) for r in range(len(d))]
    sides: list[dict[int, None]] = [dict.fromkeys(x) for x in near]
    for a, xs in enumerate(near):
        for b in xs:
            sides[b].setdefault(a)
    out = np.full((n, 2 * links), -1, np.int32)
    for a, xs in enumerate(sides):
        ids = np.fromiter(xs, np.int64, len(xs))
        if len(ids) > 2 * links:
            d = _square(v[a : a + 1], v[ids])[0]
            order = d.argsort(kind="stable")
            ids = np.array(_diverse(v, ids[order], d[order], 2 * links))
        out[a, : len(ids)] = nodes[ids]
    return out


class Graph:
    """One shard: distinct vectors, the ids on each, and for every level its nodes' rows of neighbours."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, pool: int = POOL):
        _, first, inverse = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        order = np.lexsort((ids, inverse))
        self.ids, self.pointers = ids[order], np.searchsorted(inverse[order], np.arange(len(first) + 1))
        n = len(first)
        draw = np.random.default_rng(n).random(n)
        height = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 6)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(int(height.max()) + 1 if n else 0):
            nodes = np.flatnonzero(height >= level)
            place = np.full(n, -1, np.int32)
            place[nodes] = np.arange(len(nodes))
            self.levels.append((place, _level(self.vectors, nodes, links, pool)))
        self.entry = int(np.flatnonzero(height == height.max())[0]) if n else -1

    def search(self, query: np.ndarray, own: int, wanted: int = NEAREST, breadth: int = BREADTH) -> list[tuple[float, int]]:
        """The ``wanted`` nearest found, as (distance, id), without the id ``own``."""
        if self.entry < 0 or self.vectors.shape[1] != len(query):
            return []
        at, d = self.entry, float(_distances(self.vectors[self.entry : self.entry + 1], query)[0])
        for place, rows in self.levels[:0:-1]:
            while True:
                near = rows[place[at]]
                near = near[near >= 0]
                dist = _distances(self.vectors[near], query)
                if not len(near) or dist.min() >= d:
                    break
                at, d = int(near[dist.argmin()]), float(dist.min())
        _, rows = self.levels[0]
        seen = np.zeros(len(self.vectors), bool)
        seen[at] = True
        todo, best = [(d, at)], [(-d, at)]
        while todo:
            d, at = heapq.heappop(todo)
            if len(best) >= breadth and d > -best[0][0]:
                break
            near = rows[at]
            near = near[near >= 0]
            near = near[~seen[near]]
            seen[near] = True
            for x, k in zip(_distances(self.vectors[near], query).tolist(), near.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-x, k))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, k))
                else:
                    continue
                heapq.heappush(todo, (x, k))
        out: list[tuple[float, int]] = []
        for x, k in sorted((-x, k) for x, k in best):
            if len(out) >= wanted and x > out[wanted - 1][0]:
                break
            ids = [int(i) for i in dict.fromkeys(self.ids[self.pointers[k] : self.pointers[k + 1]].tolist()) if i != own][:wanted]
            out += [(x, i) for i in ids]
            out.sort()
        return out[:wanted]


def _build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(frame["embedding"].tolist(), np.float64)
    return pd.DataFrame({"shard": [key[0]], "graph": [pickle.dumps(Graph(frame["vec_id"].to_numpy(np.int64), vectors), protocol=5)]})


def search(embeddings: DataFrame, every: int = QUERY_EVERY, wanted: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & _usable("embedding"))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "all")
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.agg(F.max_by("size", F.struct("n", "size")).alias("size"), F.max("n").alias("n")).first()  # one row
    n = usual["n"] or 0
    rows = rows.where(F.size("embedding") == (usual["size"] or 0))
    shards = max(min(LEAST_SHARDS, n), -(-n // SHARD_ROWS), 1)
    # a mixed row number: even shards whatever ids or vectors repeat
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    graphs = scratch.save(dealt.select("shard", "vec_id", "embedding").groupBy("shard").applyInPandas(_build, "shard int, graph binary"), "graphs")

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")) if n else rows.select("vec_id", "embedding")
    asked = scratch.save(asked.withColumn("block", F.shiftright(F.monotonically_increasing_id(), QUERY_BLOCK_BITS)), "asked")
    blocks = asked.groupBy("block").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("embedding").alias("vectors"))  # at most 2 ** QUERY_BLOCK_BITS rows
    # a shard's graph comes first, then the blocks that ask it: it is read once for each part of the blocks
    part = F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int").alias("part")
    asks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part, "block", "ids", "vectors", F.lit(None).cast("binary").alias("graph"))
    there = asked.select(part).distinct()  # at most PARTS rows
    lists = [F.lit(None).cast(kind).alias(name) for name, kind in (("block", "long"), ("ids", "array<bigint>"), ("vectors", "array<array<double>>"))]
    meets = graphs.crossJoin(F.broadcast(there)).select("shard", "part", *lists, "graph").union(asks.select("shard", "part", "block", "ids", "vectors", "graph"))
    meets = meets.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("block").asc_nulls_first()).select("ids", "vectors", "graph")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            for ids, vectors, blob in zip(*batch.columns, strict=True):
                if blob.is_valid:
                    graph = pickle.loads(blob.as_buffer())
                    continue
                out: tuple[list, list, list] = ([], [], [])
                for own, vector in zip(ids.as_py(), vectors.as_py(), strict=True):
                    for d, k in graph.search(np.array(vector, np.float64), own, wanted):
                        for column, value in zip(out, (own, k, d), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = meets.mapInArrow(lean(run), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))  # `wanted` rows a shard
    return ranked.where(F.col("rank") <= wanted).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
