"""Exact top-k search over vector-approximation files.

Three tables are written: the vectors, the distinct vectors (equal ones are one node with its least ids), and the
approximation file, which holds for each block of nodes one byte a dimension, the cell among CELLS between the block's
extremes.

1. Cells only are scanned: every block of cells meets every chunk of queries, and gives each query a lower and an upper
   bound of each inner product. A worker holds a chunk of queries and lets a group of blocks pass; nodes whose upper
   bound is below the k-th greatest lower bound so far are dropped there, and once more over all groups.
2. The nodes that are left are read exactly in descending order of their upper bounds: first FIRST * k a query, then
   those whose bound still reaches the k-th exact score. After that the k-th result is certain.

Blocks and chunks have bounded bytes, groups a bounded number of blocks; more vectors make more groups, not larger ones.

Defined cases: null ids and vectors, and vectors with null or non-finite components, take no part; empty vectors neither;
only vectors of the same length are compared; a query is never its own candidate, and rows of one id count as
one another's own; ties go to the smaller id; repeated rows are ranked each, and answered each where they are queries;
however many vectors are equal, only those that can be ranked (k + 1 ids, k rows an id) go further; an empty table or no
query gives no rows; extra columns of the input are ignored. Components up to 2 ** 24 in absolute value after scaling
keep all sums exact at up to 2 ** 15 dimensions; the bounds allow for rounding by the sum of all magnitudes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
CELLS = 64
BLOCK = 4096
QUERY_BLOCK = 4096
#: Bytes of a block of cells and, times eight, of a chunk of queries; long vectors make smaller blocks.
BLOCK_BYTES = 1 << 20
GROUP_BLOCKS = 64
#: Queries whose bounds are in hand at a time, and the exact vectors read first, times k.
SLICE = 256
FIRST = 2
PARTITIONS = 1 << 17
RESULT = "query_id long, rank int, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of vectors whose components are all present and finite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(whole).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """node, v, ids (vec_id, copies): the distinct vectors with the rows that may be among k results."""
    counted = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = counted.withColumn("place", place).where(F.col("place") <= k + 1)
    return held.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "copies"))).alias("ids")).select(F.monotonically_increasing_id().alias("node"), "v", "ids")


class Cells:
    """The approximation of a block: for each dimension CELLS equal cells between its extremes."""

    def __init__(self, code: np.ndarray, low: np.ndarray, width: np.ndarray, far: np.ndarray) -> None:
        self.code, self.low, self.width, self.far = code, low, width, far

    @classmethod
    def of(cls, x: np.ndarray) -> Cells:
        low, high = x.min(0).astype(np.float64), x.max(0).astype(np.float64)
        width = np.maximum(1.0, (high - low + 1) / CELLS)
        return cls(np.minimum((x - low) // width, CELLS - 1).astype(np.uint8), low, width, np.maximum(np.abs(low), np.abs(high)) + width)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries by vectors: no inner product is less than the first or greater than the second."""
        middle = (q * self.width) @ self.code.T.astype(np.float64) + (q @ (self.low + self.width / 2))[:, None]
        half = np.abs(q) @ (self.width / 2) + 1e-9 * (np.abs(q) @ self.far) + 1
        return middle - half[:, None], middle + half[:, None]


def approximation(exact: DataFrame, size: int) -> DataFrame:
    """block, dim, nodes, sole, several, low, width, far, code: the cells of up to size nodes of one length in a row.

    sole is the node's only id, where it has no other.
    """
    names = ["block", "dim", "nodes", "sole", "several", "low", "width", "far", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            some = held.pop(dim)
            node, sole, several = (np.array(x) for x in zip(*(r[:3] for r in some)))
            c = Cells.of(np.stack([r[3] for r in some]))
            number += 1
            blobs = (node.astype("<i8"), sole.astype("<i8"), several.astype(np.uint8), c.low, c.width, c.far, c.code)
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names)

        for b in batches:
            flat, at = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            for node, sole, n, i, j in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                some = held.setdefault(j - i, [])
                some.append((node, sole, n > 1, flat[i:j]))
                if len(some) >= size:
                    yield out(j - i)
        for dim in list(held):
            yield out(dim)

    return exact.select("node", "v", F.col("ids")[0]["vec_id"].alias("sole"), F.size("ids").alias("n")).mapInArrow(run, "block long, dim int, nodes binary, sole binary, several binary, low binary, width binary, far binary, code binary")


def chunked(asked: DataFrame, chunks: int) -> DataFrame:
    """chunk, dim, rows, ids, data: the queries of each chunk, of one length in a row, as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            flat, at = b.column(2).values.to_numpy(zero_copy_only=False), b.column(2).offsets.to_numpy()
            for row, key, chunk, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                held.setdefault((chunk, j - i), []).append((row, key, flat[i:j]))
        for chunk, dim in list(held):
            some = held.pop((chunk, dim))
            blobs = (np.array([r[0] for r in some], "<i8"), np.array([r[1] for r in some], "<i8"), np.concatenate([r[2] for r in some]).astype("<i8"))
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["chunk", "dim", "rows", "ids", "data"])

    dealt = asked.select("row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"))
    return dealt.repartition(chunks, "chunk").mapInArrow(run, "chunk long, dim int, rows binary, ids binary, data binary")


class Asked:
    """A chunk of queries and, for each, the k greatest lower bounds and the nodes that may matter so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.rows, self.ids, self.q, self.k = rows, ids, q.astype(np.float64), k
        self.best = np.full((len(rows), k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def meet(self, node: np.ndarray, sole: np.ndarray, several: np.ndarray, cells: Cells) -> None:
        k, n = self.k, len(node)
        for at in range(0, len(self.rows), SLICE):
            some = slice(at, at + SLICE)
            lower, upper = cells.bounds(self.q[some])
            own = np.flatnonzero(~several & np.isin(sole, self.ids[some]))
            i, j = np.nonzero(self.ids[some][:, None] == sole[own])
            lower[i, own[j]] = upper[i, own[j]] = -np.inf
            top = lower if n <= k else np.partition(lower, n - k, 1)[:, n - k :]
            self.best[some] = np.partition(np.concatenate([self.best[some], top], 1), top.shape[1], 1)[:, top.shape[1] :]
            i, j = np.nonzero((upper >= self.best[some].min(1)[:, None]) & (upper > -np.inf))
            self.found.append((i + at, node[j], lower[i, j], upper[i, j]))
            self.n += len(i)
        if self.n > 1 << 20:
            self.found = [self.left()]
            self.n = len(self.found[0][0])

    def left(self) -> tuple[np.ndarray, ...]:
        i, node, lower, upper = (np.concatenate(x) for x in zip(*self.found))
        keep = upper >= self.best.min(1)[i]
        return i[keep], node[keep], lower[keep], upper[keep]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            i, node, lower, upper = self.left()
            for a in range(0, len(i), 1 << 16):
                some = slice(a, a + (1 << 16))
                yield pa.record_batch([pa.array(x) for x in (self.rows[i[some]], node[some], lower[some], upper[some])], ["row", "node", "lower", "upper"])


def survivors(cells: DataFrame, chunk_rows: DataFrame, groups: int, chunks: int, k: int) -> DataFrame:
    """row (of a query), node, upper, place: the nodes that the bounds leave, in descending order of the upper one."""
    blob = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = chunk_rows.select("chunk", every(groups).alias("g"), F.lit(0).alias("kind"), "dim", F.col("rows").alias("a"), F.col("ids").alias("b"), F.col("data").alias("c"), *blob("low", "width", "far", "code"))
    passing = cells.select(every(chunks).alias("chunk"), F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), F.lit(1).alias("kind"), "dim", F.col("nodes").alias("a"), F.col("sole").alias("b"), F.col("several").alias("c"), "low", "width", "far", "code")
    parts = max(1, min(groups * chunks, PARTITIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, g, kind, dim, a, b, c, low, width, far, code = (x[r].as_py() for x in batch.columns)
                if key != (chunk, g):
                    for asked in held.values():
                        yield from asked.rest()
                    key, held = (chunk, g), {}
                a, b = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                if kind == 0:
                    held[dim] = Asked(a, b, np.frombuffer(c, "<i8").reshape(-1, dim), k)
                elif dim in held:
                    held[dim].meet(a, b, np.frombuffer(c, np.uint8) > 0, Cells(np.frombuffer(code, np.uint8).reshape(-1, dim), *(np.frombuffer(x) for x in (low, width, far))))
        for asked in held.values():
            yield from asked.rest()

    met = queries.union(passing).repartition(parts, "g", "chunk").sortWithinPartitions("g", "chunk", "kind")
    found = met.mapInArrow(run, "row long, node long, lower double, upper double")
    whole = Window.partitionBy("row").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = found.withColumn("sure", F.nth_value("lower", k).over(whole)).where(F.col("sure").isNull() | (F.col("upper") >= F.col("sure")))
    return left.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("upper"), "node"))).select("row", "node", "upper", "place")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest inner products over all other vectors."""
    spark = vectors.sparkSession
    rows = materialize(scaled(vectors).withColumn("row", F.monotonically_increasing_id()), "vafile-rows")
    asked = rows.where(is_query)
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.when(is_query, 1)).alias("m")).first()
    if not shape["m"]:
        return spark.createDataFrame([], RESULT)
    exact = materialize(nodes(rows, k), "vafile-exact")
    cells = materialize(approximation(exact, max(1, min(BLOCK, BLOCK_BYTES // shape["dim"]))), "vafile-cells")
    blocks = cells.count()
    groups = -(-blocks // max(1, min(GROUP_BLOCKS, blocks // (2 * spark.sparkContext.defaultParallelism))))
    chunks = -(-shape["m"] // max(1, min(QUERY_BLOCK, BLOCK_BYTES // shape["dim"])))
    left = materialize(survivors(cells, chunked(asked, chunks), groups, chunks, k), "vafile-candidates")
    query = asked.select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def scored(some: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        near = some.select("row", "node").join(exact, "node").join(query, "row")
        return near.select("row", "query_id", product.alias("score"), F.filter("ids", lambda x: x["vec_id"] != F.col("query_id")).alias("ids"))

    first = materialize(scored(left.where(F.col("place") <= FIRST * k)), "vafile-first")
    kth = first.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))).where(F.col("n") == k).select("row", F.col("score").alias("kth"))
    open_ = left.where(F.col("place") > FIRST * k).join(kth, "row").where(F.col("upper") >= F.col("kth"))
    # the k results come from the k nodes whose first row ranks highest
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.col("ids")[0]["vec_id"])
    top = first.union(scored(open_)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    each = top.select("row", "query_id", "score", F.explode("ids").alias("x")).select("row", "query_id", "score", F.col("x.vec_id").alias("vec_id"), F.explode(F.array_repeat(F.lit(0), F.col("x.copies").cast("int"))))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
