"""Exact top-k search by block-at-a-time pruning.

Candidates are cut into blocks of neighbouring ids. A block keeps its forward index (its vectors as
a matrix) and, for each component, the largest and smallest value in it. For a query, the sum over
components of the larger of query x largest and query x smallest bounds every score in the block.
Blocks are taken in the order of their bounds and scored through their forward index until the
next bound is below the k-th best score so far.

Candidates are packed and dealt out in groups, and every group meets all queries (see vector_blocks), so nothing goes through
the driver and one job serves any number of queries. A task keeps each query's k best over the blocks of a group, so the
k-th score so far bounds the next ones. One group in SEED is searched first, and each query's k-th score
there is the least that the others need to give back.

Components are floor(scale * x). Vectors that are null or empty, or hold null or other than finite
components, take no part; neither do candidates of another length than the query. A query's own
row is every row with its id. An empty table gives no rows. Fewer than k candidates are all given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize
from cadenza.llm.vector_blocks import BLOCK_ROWS, GROUP_BLOCKS, SEED, Block, grouped, meet, packed

FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int, *more: str) -> DataFrame:
    """(vec_id, v): whole-number components of the vectors that take part; then further columns."""
    x = F.col(vector_col).cast("array<double>")
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *more)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by floating point where all sums are exact in it."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


#: Score of no candidate; its negative is still a 64-bit number.
NONE = np.iinfo(np.int64).min + 1


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k best by score, ties to the smaller id."""
    return np.lexsort((ids, -scores), axis=-1)[:, :k]


class Best:
    """The k best candidates so far of each query; NONE where there are fewer. Scores under a query's `least` need not be found."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.least = np.full(len(queries), NONE) if least is None else least
        self.ids, self.scores = np.full((len(queries), k), NONE), np.full((len(queries), k), NONE)

    def search(self, ids: np.ndarray, vectors: np.ndarray, block: int) -> None:
        """Take the vectors in, block by block in the order of each query's bounds."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        cuts = np.arange(0, len(ids), block)
        high, low = np.maximum.reduceat(vectors, cuts), np.minimum.reduceat(vectors, cuts)
        bounds = products(np.maximum(self.queries, 0), high) + products(np.minimum(self.queries, 0), low)
        ranked = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(len(self.queries))
        for step in range(len(cuts)):
            at = ranked[active, step]
            going = bounds[active, at] >= np.maximum(self.scores[active, self.k - 1], self.least[active])
            active, at = active[going], at[going]
            if not len(active):
                break
            for b in np.unique(at):  # queries at the same block share its forward index
                q = active[at == b]
                own = slice(cuts[b], min(cuts[b] + block, len(ids)))
                s = products(self.queries[q], vectors[own])
                s[self.query_ids[q][:, None] == ids[own][None, :]] = NONE
                top = _top(s, min(self.k, s.shape[1]))
                all_ids = np.concatenate([self.ids[q], ids[own][top]], 1)
                all_scores = np.concatenate([self.scores[q], np.take_along_axis(s, top, 1)], 1)
                keep = best(all_ids, all_scores, self.k)
                self.ids[q], self.scores[q] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_scores, keep, 1)

    def found(self) -> pa.RecordBatch:
        q, j = np.nonzero((self.scores != NONE) & (self.scores >= self.least[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(self.query_ids[q]), pa.array(self.ids[q, j]), pa.array(self.scores[q, j])], ["query_id", "vec_id", "score"])


def _top(s: np.ndarray, n: int) -> np.ndarray:
    """For each row the places of its n largest values, ties to the earlier place."""
    least = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
    row, place = np.nonzero(s >= least)
    order = np.lexsort((place, -s[row, place], row))
    row, place = row[order], place[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return place[rank < n].reshape(len(s), n)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, block: int = 256, block_rows: int = BLOCK_ROWS, group_blocks: int = GROUP_BLOCKS, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by inner product, ties to smaller ids."""
    none = F.array().cast("array<bigint>")
    whole = lambda rows, more: rows.select("vec_id", F.lit(0).cast("long").alias("label"), "v", more.alias("more"))
    candidates = quantized(vectors, id_col, vector_col, scale).filter(F.size("v") > 0)
    blocks, n_groups = grouped(materialize(packed(whole(candidates, none), block_rows), "vectors"), group_blocks)
    queries = quantized(vectors.filter(is_query), id_col, vector_col, scale).filter(F.size("v") > 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(queries, "queries")

    def find(held: list[Block], queries: Block) -> pa.RecordBatch:
        best = Best(queries.ids, queries.v, k, queries.more[:, 0])
        for b in held:
            best.search(b.ids, b.v, block)
        return best.found()

    def part(queries: DataFrame, least: Column, chosen) -> DataFrame:
        numbers = F.filter(F.sequence(F.lit(0), F.lit(n_groups - 1)), chosen)
        return meet(blocks.filter(chosen(F.col("g"))), packed(whole(queries, F.array(least)), query_rows), numbers, n_groups, find, FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    if n_groups < 2 * SEED:
        found = part(queries, F.lit(NONE), lambda g: F.lit(True))
    else:
        first = materialize(part(queries, F.lit(NONE), lambda g: g % SEED == 0), "seeds")
        floors = ranked(first).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        found = first.unionByName(part(queries.join(floors, "vec_id", "left"), F.coalesce("floor", F.lit(NONE)), lambda g: g % SEED != 0))
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5
"""
