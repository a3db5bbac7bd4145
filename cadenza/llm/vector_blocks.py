"""Whole-number vectors packed into blocks, and the meeting of all query blocks with all candidate blocks.

Candidates are dealt out to groups of blocks, queries (few beside them) are given to every group, and a
task searches one group at a time: nothing goes through the driver, one job serves any number of queries,
and a task holds the blocks of one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import shuffle_partitions

#: A block: vectors of one size, ids and labels as 64-bit numbers, components in the fewest bytes they fit in, further numbers of each row.
BLOCK = "size int, ids binary, labels binary, v binary, more binary"

#: Rows of a block, and blocks of a group on the average.
BLOCK_ROWS, GROUP_BLOCKS = 2048, 16

#: One group in so many is searched before the others, so that they know what they need not give back.
SEED = 16


class Block:
    """ids (n), labels (n), v (n x size, whole numbers) and more (n x any, whole numbers)."""

    def __init__(self, size: int, ids: bytes, labels: bytes, v: bytes, more: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        n = len(self.ids)
        width = len(v) // max(1, n * size)
        self.v = np.frombuffer(v, f"<i{width}").reshape(n, size).astype(np.int64) if size else np.zeros((n, 0), np.int64)
        self.more = np.frombuffer(more, np.int64).reshape(n, -1)


def _narrow(v: np.ndarray) -> np.ndarray:
    low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
    return v.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def packed(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, label, v, more) as BLOCK rows of up to `most` vectors of one size; more is a list of whole numbers, as long in all rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, most) for b in batches for i in range(0, len(b), most)):
            sizes = b.column(2).value_lengths().to_numpy()
            out = []
            for n in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == n))
                ids, labels, v, more = (b.column(i).take(at) for i in range(4))
                out.append((int(n), ids.to_numpy().tobytes(), labels.to_numpy().tobytes(), _narrow(v.flatten().to_numpy()).tobytes(), more.flatten().to_numpy().tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["size", "ids", "labels", "v", "more"])

    return rows.select("vec_id", "label", "v", "more").mapInArrow(pack, BLOCK)


def grouped(blocks: DataFrame, group_blocks: int = GROUP_BLOCKS) -> tuple[DataFrame, int]:
    """Blocks (of a written table) with the number of their group, and how many groups there are."""
    n = blocks.count()
    groups = max(1, min(n, max(-(-n // group_blocks), shuffle_partitions(blocks.sparkSession))))
    return blocks.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")), groups


def meet(candidates: DataFrame, queries: DataFrame, groups: Column, n_groups: int, search: Callable[[list[Block], Block], pa.RecordBatch], schema: str) -> DataFrame:
    """search(blocks of a group, block of queries) for every group and every block of queries of the same size.

    candidates are BLOCK rows with `g`; queries are BLOCK rows; groups is the list of all group numbers to be searched.
    """
    both = candidates.withColumn("side", F.lit(0)).unionByName(queries.withColumn("side", F.lit(1)).withColumn("g", F.explode(groups.cast("array<int>"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for b in batches:
            for g, side, size, *rest in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if g != at:
                    at, held = g, {}
                if side == 0:
                    held.setdefault(size, []).append(Block(size, *rest))
                elif size in held:
                    yield search(held[size], Block(size, *rest))

    n = max(1, min(n_groups, max(shuffle_partitions(candidates.sparkSession), n_groups // 4)))
    dealt = both.select("g", "side", "size", "ids", "labels", "v", "more").repartition(n, "g").sortWithinPartitions("g", "side")
    return dealt.mapInArrow(run, schema)
