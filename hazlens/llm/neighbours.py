"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Equal vectors are one class, named by its least vec_id and carrying at most
``k + 1`` ids, the least ones, since no query can use more of them. So one
vector with a third of all rows is searched once.

The largest inner product becomes the least distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm, which is 0 for queries. Trees split by
the hyperplane between two random points of a bounded sample; every class is
put in its leaf of every tree. A query pushes all roots into one priority queue
and takes the branch with the best margin next, whatever its tree, until the
leaves it has reached hold enough classes. Leaf and query lists meet in blocks
of bounded size, where inner products are exact, in double precision; each block
returns the best of each query.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null vec_id or with fewer or more
components than most of the sample (an inner product with them isn't defined); of
several vectors under one vec_id the one of the least hash takes part, and repeated
rows are one; a query's own vec_id is never among its
results; with fewer than ``k`` candidates all are returned; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazlens.llm import scratch

#: Bound on the vectors that the trees are fitted on.
SAMPLE = 20_000
TREES, SEED = 16, 9
#: Leaves a tree, and the least size of a leaf. A query visits a number of leaves that doesn't grow.
LEAVES, LEAST_LEAF = 64, 16
#: What a query's leaves must hold, counted over all trees: a share of the classes, and a number at least.
#: Vectors without any structure, as in the fixtures, need this share for a recall of 0.9; clustered ones far less.
SHARE, LEAST_SEARCH = 1.0, 2_000
#: Members and queries that meet in one block.
MEMBERS_A_BLOCK, QUERIES_A_BLOCK = 2048, 512


class Forest:
    """Split planes of all trees in one table; a child below 0 is the leaf ~child."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaves: int = LEAVES, seed: int = SEED) -> None:
        self.norm = float(np.sqrt((sample.astype(float) ** 2).sum(1).max())) if len(sample) else 1.0
        x = self.lifted(sample)
        rng = np.random.default_rng(seed)
        # a leaf of the sample stands for more of the whole
        least = max(8, max(LEAST_LEAF, total // leaves) * len(x) // max(total, 1))
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.roots = [self._grown(x, np.arange(len(x)), least, rng) for _ in range(trees)]
        self.planes_array = np.array(self.planes, np.float32).reshape(len(self.planes), x.shape[1])
        self.cut_array = np.array(self.cuts, np.float32)
        self.child_array = np.array(self.child, np.int64).reshape(-1, 2)
        self.planes, self.cuts, self.child = [], [], []

    def lifted(self, x: np.ndarray) -> np.ndarray:
        square = (x.astype(float) ** 2).sum(1)
        return np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - square, 0))]).astype(np.float32)

    def _grown(self, x: np.ndarray, rows: np.ndarray, least: int, rng: np.random.Generator) -> int:
        if len(rows) > least:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)].astype(float)
                plane = a - b
                size = np.linalg.norm(plane)
                if not size:
                    continue
                plane /= size
                side = x[rows] @ plane
                cut = float(plane @ (a + b) / 2)
                right = side > cut
                if not 0.1 < right.mean() < 0.9:
                    cut = float(np.median(side))
                    right = side > cut
                if right.any() and not right.all():
                    at = len(self.planes)
                    self.planes.append(plane.astype(np.float32))
                    self.cuts.append(cut)
                    self.child.append([0, 0])
                    self.child[at] = [self._grown(x, rows[~right], least, rng), self._grown(x, rows[right], least, rng)]
                    return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x = self.lifted(x)
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while len(on := np.flatnonzero(node >= 0)):
                at = node[on]
                right = (self.planes_array[at] * x[on]).sum(1) > self.cut_array[at]
                node[on] = self.child_array[at, right.astype(np.int64)]
            out[:, t] = ~node
        return out

    def search(self, queries: np.ndarray, sizes: np.ndarray, enough: int) -> list[list[int]]:
        """The leaves that each query visits, through one queue over all trees."""
        x = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
        out = []
        for at in range(0, len(x), 256):
            margins = x[at : at + 256] @ self.planes_array.T - self.cut_array if len(self.cut_array) else np.zeros((len(x[at : at + 256]), 0))
            for margin in margins:
                queue = [(-np.inf, root) for root in self.roots]
                heapq.heapify(queue)
                found, held = [], 0
                while queue and held < enough:
                    worst, node = heapq.heappop(queue)
                    while node >= 0:
                        m = float(margin[node])
                        low, high = self.child_array[node]
                        near, far = (high, low) if m > 0 else (low, high)
                        heapq.heappush(queue, (max(worst, abs(m)), int(far)))
                        node = int(near)
                    found.append(~node)
                    held += int(sizes[~node])
                out.append(found)
        return out


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as an array of floats, of the rows that take part."""
    e = F.col("embedding")
    whole = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).where(
        ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    )
    # minus zero is zero, so that equal vectors have equal hashes
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda v: v.cast("float") + F.lit(0.0).cast("float")).alias("v"))


def _packed(dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "v"), pa.array([r.tobytes() for r in values], pa.binary())], [*(c for c in batch.schema.names if c != "v"), "v"])

    return work


def _array(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(-1, dims)


def _placed(forest, dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.value.leaves_of(_array(batch.column("v").to_pylist(), dims))
            n, trees = leaves.shape
            rows = pa.array(np.repeat(np.arange(n), trees))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), batch.column("class").take(rows), batch.column("v").take(rows)], ["leaf", "class", "v"])

    return work


def _sought(forest, sizes: np.ndarray, enough: int, dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.value.search(_array(batch.column("v").to_pylist(), dims), sizes, enough)
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            leaves = pa.array(np.array([x for f in found for x in f], np.int64))
            yield pa.RecordBatch.from_arrays([leaves, batch.column("class").take(rows), batch.column("v").take(rows)], ["leaf", "query", "v"])

    return work


def _reranked(dims: int, keep: int):
    def work(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "class": np.zeros(0, np.int64), "score": np.zeros(0)})
        members = members.sort_values("class")
        m, q = _array(members["v"], dims).astype(float), _array(queries["v"], dims).astype(float)
        score, name = q @ m.T, members["class"].to_numpy()
        best = np.argsort(-score, axis=1, kind="stable")[:, :keep]
        rows = np.arange(len(q))[:, None]
        # the score that is returned doesn't depend on the block's shape
        exact = (q[:, None, :] * m[best]).sum(2) if best.size < 1 << 20 else score[rows, best]
        return pd.DataFrame({"query": np.repeat(queries["query"].to_numpy(), best.shape[1]), "class": name[best].ravel(), "score": exact.ravel()})

    return work


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, trees: int = TREES, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for each row that ``is_query`` (of vec_id) holds for."""
    spark = vectors.sparkSession
    valid = _valid(vectors)
    first = valid.select(F.size("v").alias("n"), "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(1000).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], schema)
    dims = first["n"]
    packed = valid.where(F.size("v") == dims).mapInArrow(_packed(dims), "vec_id long, v binary").withColumn("h", F.md5("v"))
    # ranks are limited before the exchange, so a class of any size sends a few rows a task
    own = Window.partitionBy("h").orderBy("vec_id")
    packed = scratch.written(packed, "vectors")
    several = scratch.written(packed.groupBy("vec_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most"), "several")
    if not several.isEmpty():
        packed = packed.join(several, "vec_id", "left").where("least is null or h = least").drop("least", "most")
    few = packed.distinct().withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1)
    few = scratch.written(few, "few")
    classes = few.where("n = 1").select(F.col("vec_id").alias("class"), "h", "v")
    classes = scratch.written(classes, "classes")
    total = classes.count()
    rows = classes.select("class", "v").orderBy(F.xxhash64("class"), "class").limit(sample).select("v").toArrow().column(0).to_pylist()
    forest = Forest(_array(rows, dims), total, trees)
    shared = spark.sparkContext.broadcast(forest)
    members = scratch.written(classes.mapInArrow(_placed(shared, dims), "leaf long, class long, v binary"), "leaves")
    sizes = np.zeros(forest.leaves, np.int64)
    for r in members.groupBy("leaf").count().toLocalIterator():  # as many rows as the forest has leaves, which the sample bounds
        sizes[r["leaf"]] = r["count"]
    asked = packed.where(is_query).select("vec_id", "h").distinct().join(classes.select("h", "class"), "h").select(F.col("vec_id").alias("query_id"), "class")
    asked = scratch.written(asked, "asked")
    asking = classes.join(asked.select("class").distinct(), "class", "left_semi").select("class", "v")
    probes = scratch.written(asking.mapInArrow(_sought(shared, sizes, max(LEAST_SEARCH, int(share * total)), dims), "leaf long, query long, v binary"), "probes")

    counts = members.groupBy("leaf").agg(F.count("*").alias("m")).join(probes.groupBy("leaf").agg(F.count("*").alias("q")), "leaf")
    counts = scratch.written(counts.select("leaf", F.ceil(F.col("m") / MEMBERS_A_BLOCK).alias("ms"), F.ceil(F.col("q") / QUERIES_A_BLOCK).alias("qs")), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = members.join(F.broadcast(counts), "leaf").withColumn("mb", F.pmod(F.xxhash64("class"), F.col("ms"))).select("leaf", "mb", every("qs").alias("qb"), "class", "v")
    right = probes.join(F.broadcast(counts), "leaf").withColumn("qb", F.pmod(F.xxhash64("query"), F.col("qs"))).select("leaf", every("ms").alias("mb"), "qb", "query", "v")
    keys = ["leaf", "mb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_reranked(dims, k + 1), "query long, class long, score double")
    # a query's own class is always looked at
    itself = asking.mapInArrow(_own_score(dims), "query long, class long, score double")
    found = found.unionByName(itself).groupBy("query", "class").agg(F.max("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("n") <= k + 1)
    ids = few.join(classes.select("h", "class"), "h").select("class", "vec_id")
    listed = best.select("query", "class", "score").join(ids, "class").withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    listed = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list"))
    listed = scratch.written(listed, "listed")
    out = asked.join(listed.withColumnRenamed("query", "class"), "class")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _own_score(dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _array(batch.column("v").to_pylist(), dims).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("class"), pa.array((v * v).sum(1))], ["query", "class", "score"])

    return work
