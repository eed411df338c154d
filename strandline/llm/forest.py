"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into blocks of bounded size. In a block each tree gives a vector a string of hash
bits and holds the strings sorted, which is a prefix tree without pointers. A query goes down every
tree to its longest matching prefix; then the trees go up together, bit by bit, and what stands under
the query's prefix joins the candidates, until there are enough. Candidates are ranked by exact
distance, and the blocks' nearest are merged. The queries are a stated set that meets all rows, a
block at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Trees, bits of a string, and the share of a block's vectors at which the way up ends.
TREES, BITS, SHARE = 1024, 24, 0.15
#: Vectors of a block, queries of a task and of a step in it, and a floor for the candidates.
BLOCK, PART, QUERIES, FLOOR = 16_384, 16_384, 128, 700
#: Trees that go up a bit before candidates are counted again.
STEP = 32


class Forest:
    """Sorted strings of one block's vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        """``bits`` is a multiple of 8, 32 at most."""
        self.planes = [self._planes(np.random.default_rng([seed, t]), vectors.shape[1], bits) for t in range(trees)]
        self.trees, self.bits = trees, bits
        self.centre = vectors.mean(0)
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, 1)

    @staticmethod
    def _planes(rng: np.random.Generator, width: int, bits: int) -> np.ndarray:
        """A tree's planes, at right angles to each other as far as the vectors' length allows: bits that tell more."""
        sets = [np.linalg.qr(rng.standard_normal((width, min(width, bits - at))))[0] for at in range(0, bits, width)]
        return np.concatenate(sets, axis=1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(tree, vector): the signs of the projections of what differs from the centre, first bit highest."""
        around, out = vectors - self.centre, np.zeros((self.trees, len(vectors)), np.int64)
        for t, p in enumerate(self.planes):
            for byte in np.packbits(around @ p > 0, axis=1).T:
                out[t] = out[t] << 8 | byte
        return out

    def search(self, queries: np.ndarray, enough: int):
        """Yields (query, candidates): what stands under the query's prefixes, from the longest up, until there are ``enough``."""
        strings = self.strings(queries)
        n = self.sorted.shape[1]
        shape = (self.bits + 2, self.trees, len(queries))
        low, high = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        high[0] = n
        for t in range(self.trees):
            for depth in range(1, self.bits + 1):
                shift = self.bits - depth
                prefix = strings[t] >> shift
                low[depth, t] = np.searchsorted(self.sorted[t], prefix << shift, "left")
                high[depth, t] = np.searchsorted(self.sorted[t], (prefix + 1) << shift, "left")
        # With fewer rows under the prefixes than wanted, copies counted, a level can't be enough: the way starts below.
        under = (high - low).sum(1, dtype=np.int64)
        for q in range(len(queries)):
            depth = int(np.flatnonzero(under[:, q] >= enough)[-1]) + 1 if under[0, q] >= enough else 0
            marked, done = np.zeros(n, bool), False
            while depth >= 0 and not done:
                for at in range(0, self.trees, STEP):
                    for t in range(at, min(at + STEP, self.trees)):
                        marked[self.order[t, low[depth, t, q] : high[depth, t, q]]] = True
                    if done := np.count_nonzero(marked) >= enough:
                        break
                depth -= 1
            yield q, np.flatnonzero(marked)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its ``k`` nearest other rows found.

    score is the Euclidean distance in double precision; nearest first, ties to the smaller id; fewer
    rows than ``k`` give all. Vectors that are null, zero, or hold null or non-finite components, and
    rows with a null id, take no part; so do vectors of another length than most. Rows that repeat an
    id: a query isn't matched with rows of its own id, and the nearest of an id's rows counts. An
    empty table gives no rows. Equal vectors have equal strings, so no copy is missed for another.
    """
    value = F.col(vector_col).cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))) & F.exists(value, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    rows = rows.select(F.col(id_col).alias("vec_id"), value.alias("vector"), F.coalesce(queries, F.lit(False)).alias("query"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    length = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"), F.count_if("query").alias("asked")).orderBy(F.desc("rows"), "n").first()
    count, width, wanted = (length["rows"], length["n"], length["asked"]) if length else (0, 0, 0)
    rows = rows.where(F.size("vector") == width)
    blocks, parts = max(1, math.ceil(count / block)), max(1, math.ceil(wanted / PART))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # Every part of the queries meets every block: a task holds one of each, whatever their numbers.
    own = rows.select(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("block"), every(parts, "part"), "vec_id", "vector")
    asked = rows.where("query").select("vec_id", "vector").distinct()
    asked = asked.select(every(blocks, "block"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.col("vec_id").alias("query_id"), F.col("vector").alias("target"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.array(column.combine_chunks().flatten(), float).reshape(-1, width)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, points = np.array(left["vec_id"].to_pylist()), matrix(left["vector"])
            names, targets = np.array(right["query_id"].to_pylist()), matrix(right["target"])
            forest = Forest(points, trees, bits)
            enough = max(FLOOR, math.ceil(share * len(points)))
            for at in range(0, len(targets), QUERIES):
                for q, found in forest.search(targets[at : at + QUERIES], enough):
                    name, target = names[at + q], targets[at + q]
                    found = found[ids[found] != name]
                    gap = points[found] - target
                    score = np.sqrt((gap * gap).sum(1))
                    # All that tie with the k-th stay, until ids decide.
                    if len(found) > k:
                        keep = score <= np.partition(score, k - 1)[k - 1]
                        found, score = found[keep], score[keep]
                    order = np.lexsort((ids[found], score))
                    _, first = np.unique(ids[found][order], return_index=True)
                    order = order[np.sort(first)][:k]
                    for c, x in zip(out, ([name] * len(order), ids[found[order]].tolist(), score[order].tolist()), strict=True):
                        c.extend(x)
        id_type = left.schema.field("vec_id").type
        return pa.table({"query_id": pa.array(out[0], id_type), "vec_id": pa.array(out[1], id_type), "score": pa.array(out[2], pa.float64())})

    found = own.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
