"""Exact top-k by integer inner product: a Voronoi join of queries and data.

Components are scaled and floored to integers, so that scores are exact. The largest
inner product becomes the least distance by one more component, sqrt(M^2 - |x|^2) with
M the largest norm, which is 0 for queries. Data and queries go to the cell of their
nearest pivot. A few figures a cell (the number of rows, the least distances from
the pivot, the largest one of a query) bound how far the k-th neighbour of any query of a
cell can be, and so which data it may need: of each cell of data those in a range of
distances from their pivot. Cells of queries that need much the same data are joined into
groups while that costs less than sending the data twice. Data are replicated to
the groups that need them alone, met in blocks of bounded size with blocks of queries,
and the best of each block are merged.

Equal vectors are one class, named by its least vec_id and carrying at most ``k + 1``
ids, the least ones, since no query can use more of them.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do rows with a null vec_id; a zero vector takes part, and an empty one; of several
vectors under one vec_id the least takes part, and repeated rows are one; only vectors
of equal length have an inner product, so others aren't candidates of a query; a scaled
component past the range of a long is its end, as is a score; with fewer than ``k``
candidates all are returned; an empty table gives an empty table; other columns are
ignored. Nothing depends on the choice of the pivots but the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazlens.llm import scratch

#: Bound on the pivots, and so on all that the driver holds.
PIVOTS = 128
#: Data and queries that meet in one block.
DATA_A_BLOCK, QUERIES_A_BLOCK = 8_192, 2_048
#: Inner products that cost as much as sending a vector.
SENDING = 1_000
#: Slack for rounding of distances, as a share of the largest norm.
SLACK = 1e-6
RESULT = "query_id long, rank int, vec_id long, score long"
LONGEST = (1 << 63) - 1


def scaled(vectors: DataFrame, factor: int) -> DataFrame:
    """vec_id and the vector in whole numbers, one row a vec_id, of the rows that take part."""
    e = F.col("embedding")
    whole = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))
    ints = F.transform(e, lambda v: F.floor(F.lit(float(factor)) * v.cast("double")))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, of the narrowest whole numbers that hold the batch's largest."""
    for batch in batches:
        lists = batch.column("v")
        values, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8"), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        most = int(max(values.max(initial=0), -(values.min(initial=0) + 1)))
        width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        raw, norm = values.astype(f"<i{width}").tobytes(), values.astype(float) ** 2
        norms = np.add.reduceat(np.append(norm, 0.0), at[:-1]) * (at[1:] > at[:-1]) if len(at) > 1 else np.zeros(0)
        bytes_ = pa.array([raw[a * width : b * width] for a, b in zip(at, at[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("ids"), bytes_, pa.array(at[1:] - at[:-1], pa.int32()), pa.array(np.sqrt(norms))], ["class", "ids", "v", "dims", "norm"])


def _vectors(column: list[bytes], dims: int) -> np.ndarray:
    """Rows of whole numbers; each row's width follows from its bytes."""
    out = np.zeros((len(column), dims), np.int64)
    if dims:
        width = np.fromiter(map(len, column), np.int64, len(column)) // dims
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            out[rows] = np.frombuffer(b"".join(column[r] for r in rows), f"<i{w}").reshape(-1, dims)
    return out


class Cells:
    """Pivots, among vectors of one length; vectors of other lengths are in a cell of their own without bounds."""

    def __init__(self, pivots: np.ndarray, norm: float) -> None:
        self.norm = norm
        self.pivots = self.lifted(pivots)
        self.dims = pivots.shape[1]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(float)
        return np.column_stack([x, np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))])

    def nearest(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        x = self.lifted(x, query)
        square = np.maximum((x**2).sum(1)[:, None] - 2 * (x @ self.pivots.T) + (self.pivots**2).sum(1), 0)
        at = square.argmin(1)
        # taken anew, since the sum above loses digits for near points
        return at, np.sqrt(((x - self.pivots[at]) ** 2).sum(1))

    def place(self, batch: pa.RecordBatch, query: bool) -> tuple[np.ndarray, np.ndarray]:
        dims = batch.column("dims").to_numpy()
        cell, far = np.where(dims == self.dims, 0, -1 - dims.astype(np.int64)), np.zeros(len(dims))
        rows = np.flatnonzero(dims == self.dims)
        raw = batch.column("v").to_pylist()
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            cell[some], far[some] = self.nearest(_vectors([raw[r] for r in some], self.dims), query)
        return cell, far

    def gaps(self) -> np.ndarray:
        return np.sqrt(np.maximum(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(2), 0))


def _placed(cells, query: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = cells.value.place(batch, query)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), *(batch.column(c) for c in ("class", "v", "dims"))], ["cell", "far", "class", "v", "dims"])

    return work


PLACED = "cell long, far double, class long, v binary, dims int"


def necessary(gaps: np.ndarray, sizes: np.ndarray, near: list[np.ndarray], asked: np.ndarray, reach: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell of queries and cell of data the range of distances from the data's pivot that may matter: (low, high), low over high for none; and the bound on a query's k-th neighbour.

    gaps: between pivots; sizes: rows of data a cell; near: the least k distances of each cell's data from its pivot;
    asked: queries a cell; reach: the largest distance of a cell's queries from their pivot.
    """
    n = len(gaps)
    low, high, bounds = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.full(n, np.inf)
    for i in np.flatnonzero(asked):
        through = np.sort(np.concatenate([gaps[i, j] + near[j] for j in range(n)] + [np.zeros(0)]))
        if len(through) >= k:
            bounds[i] = reach[i] + through[k - 1] + slack
        # |q - x| is at least each of: gap - reach - far, far - gap - reach
        low[i] = gaps[i] - reach[i] - bounds[i] - slack
        high[i] = gaps[i] + reach[i] + bounds[i] + slack
        low[i][sizes == 0], high[i][sizes == 0] = np.inf, -np.inf
    return low, high, bounds


def grouped(need: np.ndarray, asked: np.ndarray) -> list[list[int]]:
    """Cells of queries in groups: two are joined while that costs less than sending what both need twice.

    need: rows of data by cell of queries and cell of data.
    """
    cost = lambda rows, n: rows.sum() * (SENDING * np.ceil(n / QUERIES_A_BLOCK) + n)
    groups: list[tuple[list[int], np.ndarray, int]] = []
    for i in sorted(np.flatnonzero(asked), key=lambda i: -need[i].sum()):
        alone, best = cost(need[i], asked[i]), None
        for g, (_, rows, n) in enumerate(groups):
            more = cost(np.maximum(rows, need[i]), n + asked[i]) - cost(rows, n)
            if more <= alone and (best is None or more < best[0]):
                best = more, g
        if best is None:
            groups.append(([int(i)], need[i].copy(), int(asked[i])))
        else:
            cells, rows, n = groups[best[1]]
            groups[best[1]] = [*cells, int(i)], np.maximum(rows, need[i]), n + int(asked[i])
    return [g[0] for g in groups]


def best_of(queries: np.ndarray, data: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` largest inner products of each query, exactly, and the rows of data they belong to; ties to the earlier row."""
    keep = min(keep, len(data))
    top = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    most = top(queries) * top(data) * max(queries.shape[1], 1)
    if most < 1 << 53:
        q, x = queries.astype(float), data.astype(float)
    elif most < 1 << 62:
        q, x = queries, data
    else:
        q, x = queries.astype(object), data.astype(object)
    score, row = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
    for at in range(0, len(x), 1024):
        new = q @ x[at : at + 1024].T
        if new.dtype == object:
            new = np.clip(new, -LONGEST - 1, LONGEST)
        new = new.astype(np.int64)
        if score.shape[1] == keep:
            # an equal score comes too late
            hits = np.flatnonzero((new > score[:, -1:]).any(1))
        else:
            hits = np.arange(len(q))
        if not len(hits):
            continue
        new = new[hits]
        if new.shape[1] > 4 * keep:
            edge = np.partition(new, new.shape[1] - keep, axis=1)[:, new.shape[1] - keep]
            few = [np.flatnonzero(r >= e) for r, e in zip(new, edge, strict=True)]
            few = [f if len(f) == keep else f[np.argsort(-new[k][f], kind="stable")[:keep]] for k, f in enumerate(few)]
            cols = np.sort(np.array(few), axis=1)
        else:
            cols = np.broadcast_to(np.arange(new.shape[1]), new.shape)
        both = np.concatenate([score[hits], np.take_along_axis(new, cols, 1)], 1)
        rows = np.concatenate([row[hits], cols + at], 1)
        order = np.argsort(-both.astype(object) if both.size and both.min() == -LONGEST - 1 else -both, axis=1, kind="stable")[:, :keep]
        if score.shape[1] == keep:
            score[hits], row[hits] = np.take_along_axis(both, order, 1), np.take_along_axis(rows, order, 1)
        else:
            score, row = np.take_along_axis(both, order, 1), np.take_along_axis(rows, order, 1)
    return score, row


def _solved(keep: int):
    def work(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "class": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        data, dims = data.sort_values("class"), int(queries["dims"].iloc[0])
        score, row = best_of(_vectors(queries["v"].tolist(), dims), _vectors(data["v"].tolist(), dims), keep)
        names = data["class"].to_numpy()
        return pd.DataFrame({"query": np.repeat(queries["class"].to_numpy(), row.shape[1]), "class": names[row].ravel(), "score": score.ravel()})

    return work


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256, pivots: int = PIVOTS, block: tuple[int, int] = (DATA_A_BLOCK, QUERIES_A_BLOCK)) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows for each that ``is_query`` (of vec_id) holds for."""
    spark, per_block, asked_a_block = vectors.sparkSession, *block
    ints = scratch.written(scaled(vectors, factor), "ints")
    # ranks are limited before the exchange, so a class of any size sends a few rows a task
    few = ints.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.min("vec_id").alias("class"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select("class", "ids", "v")
    classes = scratch.written(classes.mapInArrow(_packed, "class long, ids array<long>, v binary, dims int, norm double"), "classes")
    common = classes.groupBy("dims").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    dims = common["dims"]
    chosen = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("class"), "class").limit(pivots).select("v").toArrow().column(0).to_pylist()
    cells = Cells(_vectors(chosen, dims), common["norm"])
    shared = spark.sparkContext.broadcast(cells)
    data = scratch.written(classes.select("class", "v", "dims").mapInArrow(_placed(shared, False), PLACED), "data")
    # a query is a class that holds a query's id; the ids are joined to their classes by the vector
    asking = scratch.written(ints.where(is_query).select("vec_id", "v").join(few.where("n = 1").select("v", F.col("vec_id").alias("class")), "v").select("vec_id", "class"), "asking")
    queries = classes.join(asking.select("class").distinct(), "class", "left_semi").select("class", "v", "dims")
    queries = scratch.written(queries.mapInArrow(_placed(shared, True), PLACED), "queries")

    # ---- what the driver sees: a few figures a cell, of a bounded number of cells
    n = len(cells.pivots)
    inside = F.col("cell") >= 0
    sizes, asked, reach = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for r in data.where(inside).groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    for r in queries.where(inside).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        asked[r["cell"]], reach[r["cell"]] = r["n"], r["far"]
    near = [np.zeros(0)] * n
    first = data.where(inside).select("cell", "far").withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("n") <= k + 1)
    for r in first.groupBy("cell").agg(F.collect_list("far").alias("far")).collect():
        near[r["cell"]] = np.array(r["far"])
    low, high, _ = necessary(cells.gaps(), sizes, near, asked, reach, k + 1, SLACK * max(cells.norm, 1.0))
    groups = grouped(np.where(low <= high, sizes, 0), asked)

    # ---- who goes where: bounded tables as well; cells of vectors of other lengths meet themselves
    members = [(int(i), g) for g, own in enumerate(groups) for i in own]
    ranges = [(g, j, float(low[own, j].min()), float(high[own, j].max())) for g, own in enumerate(groups) for j in range(n) if (low[own, j] <= high[own, j]).any()]
    group_of = spark.createDataFrame(members, "cell long, grp long")
    range_of = spark.createDataFrame(ranges, "grp long, cell long, low double, high double")
    to = data.where(inside).join(F.broadcast(range_of), "cell").where("far between low and high").select("grp", "class", "v", "dims")
    of = queries.where(inside).join(F.broadcast(group_of), "cell").select("grp", "class", "v", "dims")
    beside = lambda df: df.where(~inside).select(F.col("cell").alias("grp"), "class", "v", "dims")
    to, of = to.unionByName(beside(data)), of.unionByName(beside(queries))
    counts = to.groupBy("grp").agg(F.count("*").alias("d")).join(of.groupBy("grp").agg(F.count("*").alias("q")), "grp")
    counts = scratch.written(counts.select("grp", F.ceil(F.col("d") / per_block).alias("ds"), F.ceil(F.col("q") / asked_a_block).alias("qs")), "blocks")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = to.join(counts, "grp").withColumn("db", F.pmod(F.xxhash64("class"), F.col("ds"))).select("grp", "db", every("qs").alias("qb"), "class", "v")
    right = of.join(counts, "grp").withColumn("qb", F.pmod(F.xxhash64("class"), F.col("qs"))).select("grp", every("ds").alias("db"), "qb", "class", "v", "dims")
    keys = ["grp", "db", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_solved(k + 1), "query long, class long, score long")

    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("n") <= k + 1)
    # k + 1 classes of k + 1 ids at most a query
    listed = best.join(classes.select("class", "ids"), "class").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("c"))
    order = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
    flat = F.array_sort(F.flatten(F.transform("c", lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i.alias("vec_id"))))), order)
    listed = scratch.written(listed.select(F.col("query").alias("class"), flat.alias("list")), "listed")
    # one list a class, whatever the number of queries that share it
    out = asking.join(listed, "class").select(F.col("vec_id").alias("query_id"), "list")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
    ), r AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
