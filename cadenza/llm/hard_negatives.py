"""Hard negatives by an orthogonal rotation to principal components.

Vectors are rotated to the principal axes of all vectors' second moments, which leaves every
inner product as it is. The product over the leading components, with the remainder bounded by the
product of the residual norms and slack for rounding, bounds a score from both sides: pairs whose
upper bound falls below what an anchor already has (or below the band that is asked for), or whose lower bound
lies above the band, are discarded; the others get more components, and what is still left is
verified by whole-number products, which alone decide.

Anchors meet candidates block by block (see vector_blocks). One group in SEED is searched first, and each
anchor's k-th score there is the least that the other groups need to give back.

Components are floor(scale * x). Vectors that are null or empty, or hold null or other than finite components, and
rows without a label or id take no part; neither do candidates of another length than the anchor. Rows that
repeat an id are candidates each; an anchor that repeats is the row of the least (label, vector), and every row with
its id is its own. Fewer than k rows are all given. An empty table gives no rows. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize
from cadenza.llm.topk_search import quantized
from cadenza.llm.vector_blocks import BLOCK_ROWS, GROUP_BLOCKS, SEED, Block, grouped, meet, packed

FOUND = "anchor_id long, cap long, vec_id long, score long"

#: No score, and a cap that holds for every score.
NONE, ANY = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max

#: Parts of the components after which bounds are looked at.
STAGES = (0.125, 0.5)

#: Rounding slack of a product of floating-point vectors, relative to the product of their norms; far above what 64-bit sums of up to a million terms can lose.
SLACK = 1e-9

#: Components of a vector that are rotated at most, and sizes of vectors (the most frequent) that are; the others stay as they are, which is a rotation too.
ROTATED, SIZES = 1024, 4


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent sizes, the principal axes of the vectors' leading components by falling moment; sums over all rows."""
    sizes = [r[0] for r in rows.groupBy(F.size("v").alias("s")).count().filter("s > 0").orderBy(F.desc("count"), "s").limit(SIZES).collect()]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros((min(n, ROTATED),) * 2) for n in sizes}
        for b in batches:
            lengths = b.column(0).value_lengths().to_numpy()
            for n, total in sums.items():
                if len(at := np.flatnonzero(lengths == n)):
                    x = b.column(0).take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)[:, : len(total)].astype(float)
                    total += x.T @ x
        for n, total in sums.items():
            i, j = np.triu_indices(len(total))
            for a in range(0, len(i), 65536):
                k = slice(a, a + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i[k]), n, np.int32)), pa.array(i[k].astype(np.int32)), pa.array(j[k].astype(np.int32)), pa.array(total[i[k], j[k]])], ["size", "i", "j", "x"])

    out = {n: np.zeros((min(n, ROTATED),) * 2) for n in sizes}
    for r in rows.select("v").mapInArrow(moments, "size int, i int, j int, x double").groupBy("size", "i", "j").agg(F.sum("x").alias("x")).toLocalIterator():
        out[r["size"]][r["i"], r["j"]] = out[r["size"]][r["j"], r["i"]] = r["x"]
    return {n: np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1]) for n, m in out.items()}


class Rotated:
    """A block's vectors on the principal axes, with what is left of their norms after each stage."""

    def __init__(self, block: Block, axes: np.ndarray | None):
        self.block = block
        y = block.v.astype(float)
        if axes is not None:
            y = np.concatenate([y[:, : len(axes)] @ axes, y[:, len(axes) :]], 1)
        size = y.shape[1]
        self.y, self.cuts = y, [min(size, max(1, round(size * s))) for s in STAGES]
        left = np.concatenate([np.cumsum((y * y)[:, ::-1], 1)[:, ::-1], np.zeros((len(y), 1))], 1) if size else np.zeros((len(y), 1))
        self.norm = np.sqrt(left[:, 0])
        self.left = [np.sqrt(left[:, c]) for c in self.cuts]


class Bands:
    """For each anchor and band (least to cap) the k best rows so far by score, ties to the smaller id."""

    def __init__(self, n: int, bands: int, k: int):
        self.k = k
        self.ids, self.scores = np.full((n, bands, k), NONE), np.full((n, bands, k), NONE)

    def add(self, j: int, anchor: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take rows into band j; anchor is the row's place among the anchors."""
        some = np.unique(anchor)
        held = self.scores[some, j] != NONE
        anchor = np.concatenate([np.repeat(some, self.k)[held.ravel()], anchor])
        ids = np.concatenate([self.ids[some, j][held], ids])
        scores = np.concatenate([self.scores[some, j][held], scores])
        order = np.lexsort((ids, -scores, anchor))
        anchor, ids, scores = anchor[order], ids[order], scores[order]
        rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        best = rank < self.k
        self.ids[anchor[best], j, rank[best]], self.scores[anchor[best], j, rank[best]] = ids[best], scores[best]


def search(anchors: Rotated, blocks: list[Rotated], least: np.ndarray, cap: np.ndarray, same: bool, k: int, counts: dict | None = None) -> Bands:
    """The k best rows of each band least[i, j] <= score <= cap[i, j] for anchor i, of its label (or of others).

    counts gets the pairs that were looked at (all) and verified by whole-number products (verified).
    """
    a, n = anchors.block, len(anchors.block.ids)
    out = Bands(n, cap.shape[1], k)
    limit, high = least.astype(float), cap.astype(float)
    for c in blocks:
        m = anchors.cuts[0]
        part = anchors.y[:, :m] @ c.y[:, :m].T
        slack = np.outer(anchors.norm, c.norm) * SLACK
        rest = np.outer(anchors.left[0], c.left[0]) + slack
        top, low = part + rest, part - rest
        fit = (a.labels[:, None] == c.block.labels) == same
        fit &= a.ids[:, None] != c.block.ids
        alive = np.zeros(fit.shape, bool)
        for j in range(cap.shape[1]):
            able = fit & (top >= limit[:, j, None]) & (low <= high[:, j, None])
            if k <= able.shape[1]:
                # Rows that are surely in the band bound its k-th score from below.
                sure = np.where(able & (top <= high[:, j, None]) & (low >= least[:, j, None]), low, -np.inf)
                limit[:, j] = np.maximum(limit[:, j], np.partition(sure, -k, axis=1)[:, -k])
                able &= top >= limit[:, j, None]
            alive |= able
        i, x = np.nonzero(alive)
        done = m
        for stage, m in enumerate(anchors.cuts[1:], 1):
            grown = part[i, x]
            for s in range(0, len(i), 65536):
                p = slice(s, s + 65536)
                grown[p] += np.einsum("ij,ij->i", anchors.y[i[p], done:m], c.y[x[p], done:m])
            done = m
            part[i, x] = grown
            rest = anchors.left[stage][i] * c.left[stage][x] + slack[i, x]
            keep = ((grown + rest)[:, None] >= limit[i]) & ((grown - rest)[:, None] <= high[i])
            keep = keep.any(1)
            i, x = i[keep], x[keep]
        scores = np.zeros(len(i), np.int64)
        for s in range(0, len(i), 65536):
            p = slice(s, s + 65536)
            scores[p] = np.einsum("ij,ij->i", a.v[i[p]], c.block.v[x[p]])
        if counts is not None:
            counts["all"], counts["verified"] = counts.get("all", 0) + fit.size, counts.get("verified", 0) + len(i)
        for j in range(cap.shape[1]):
            ok = (scores >= least[i, j]) & (scores <= cap[i, j])
            if ok.any():
                out.add(j, i[ok], c.block.ids[x[ok]], scores[ok])
                full = out.scores[:, j, k - 1]
                limit[:, j] = np.maximum(limit[:, j], np.where(full == NONE, -np.inf, full.astype(float)))
    return out


def best_in_bands(blocks: DataFrame, n_groups: int, anchors: DataFrame, axes, same: bool, k: int, anchor_rows: int = 512) -> DataFrame:
    """anchor_id, cap, vec_id, score: at most k rows a group for each anchor and band, among them the k best of all.

    anchors: (vec_id, label, v, bands), where bands lists (least, cap); those of fewer bands get empty ones.
    """
    most = anchors.agg(F.max(F.size("bands"))).first()[0] or 0
    if not most:
        return anchors.sparkSession.createDataFrame([], FOUND)
    empty = F.array_repeat(F.struct(F.lit(ANY).alias("least"), F.lit(NONE).alias("cap")), F.lit(most) - F.size("bands"))

    def find(held: list[Block], queries: Block) -> pa.RecordBatch:
        size = queries.v.shape[1]
        ours = [b if isinstance(b, Rotated) else Rotated(b, axes.value.get(size)) for b in held]
        held[:] = ours  # the group's next queries find them rotated
        bands = queries.more.reshape(len(queries.ids), -1, 2)
        least, cap = bands[:, :, 0], bands[:, :, 1]
        got = search(Rotated(queries, axes.value.get(size)), ours, least, cap, same, k)
        i, j, r = np.nonzero(got.scores != NONE)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (queries.ids[i], cap[i, j], got.ids[i, j, r], got.scores[i, j, r])], ["anchor_id", "cap", "vec_id", "score"])

    def part(anchors: DataFrame, seed: bool | None) -> DataFrame:
        numbers = F.sequence(F.lit(0), F.lit(n_groups - 1))
        chosen = (lambda g: F.lit(True)) if seed is None else (lambda g: (g % SEED == 0) == F.lit(seed))
        listed = F.concat("bands", empty)
        rows = anchors.select("vec_id", "label", "v", F.flatten(F.transform(listed, lambda b: F.array(b["least"], b["cap"]))).alias("more"))
        return meet(blocks.filter(chosen(F.col("g"))), packed(rows, anchor_rows), F.filter(numbers, chosen), n_groups, find, FOUND)

    if n_groups < 2 * SEED:
        return part(anchors, None)
    first = materialize(part(anchors, True), "seeds")
    floors = best_of(first, k).filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("cap", "score"))).alias("floors"))
    raised = F.transform("bands", lambda b: F.struct(F.greatest(b["least"], F.coalesce(F.element_at("floors", b["cap"]), b["least"])).alias("least"), b["cap"].alias("cap")))
    known = anchors.join(floors.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
    known = known.withColumn("bands", F.when(F.col("floors").isNull(), F.col("bands")).otherwise(raised)).drop("floors")
    return first.unionByName(part(known, False))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """found with its rank in (anchor_id, cap), the k best alone."""
    order = Window.partitionBy("anchor_id", "cap").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    positives: int = 5,
    scale: int = 256,
    percent: int = 80,
    block_rows: int = BLOCK_ROWS,
    group_blocks: int = GROUP_BLOCKS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of the same label; for each, the best k rows of other labels with
    percent * positive_score <= 100 * negative_score <= 100 * positive_score. percent is 1 to 99, so only positives of a score of 0 or more have any.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))).withColumn("__label", label.cast("long")).filter(F.col("__label").isNotNull()), id_col, vector_col, scale, "__label", "__anchor")
    rows = rows.withColumnsRenamed({"__label": "label", "__anchor": "anchor"}).filter(F.size("v") > 0)
    axes = spark.sparkContext.broadcast(rotations(rows))
    blocks, n_groups = grouped(materialize(packed(rows.withColumn("more", F.expr("cast(array() as array<bigint>)")), block_rows), "vectors"), group_blocks)
    anchors = rows.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    anchors = materialize(anchors, "anchors")
    whole = F.array(F.struct(F.lit(NONE).alias("least"), F.lit(ANY).alias("cap")))
    found = materialize(best_in_bands(blocks, n_groups, anchors.withColumn("bands", whole), axes, True, positives), "near")
    near = materialize(best_of(found, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.expr(f"cast(-floor(-cast({percent} as decimal(3, 0)) * positive_score / 100) as bigint)")
    bands = near.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.struct(least.alias("least"), F.col("positive_score").alias("cap"))).alias("bands"))
    found = materialize(best_in_bands(blocks, n_groups, anchors.join(bands, "vec_id"), axes, False, k), "far")
    far = best_of(found, k).select("anchor_id", F.col("cap").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row whose vec_id is divisible by 100 and its 5 positives, the 5 hardest negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
a AS (SELECT vec_id, label, v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, v) AS n FROM e WHERE vec_id % 100 = 0) WHERE n = 1),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM a JOIN e ON a.vec_id <> e.vec_id AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
c AS (SELECT DISTINCT anchor_id, positive_score FROM p),
n AS (
  SELECT c.anchor_id, c.positive_score, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY c.anchor_id, c.positive_score ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM c JOIN s ON s.anchor_id = c.anchor_id AND NOT s.same AND 80 * c.positive_score <= 100 * s.score AND 100 * s.score <= 100 * c.positive_score)
SELECT p.anchor_id, p.positive_id, n.rank, n.negative_id, p.positive_score, n.negative_score FROM p JOIN n ON n.anchor_id = p.anchor_id AND n.positive_score = p.positive_score WHERE n.rank <= 5
"""
