"""Best-fit packing: a configuration linear program over the length histogram.

Documents become pieces of at most `capacity` tokens. The histogram of piece lengths has at most
`capacity` entries whatever the corpus holds, so the program is solved on the driver:
multiplicative weights on the lengths' demands, each round priced by a knapsack over one
sequence, give a fractional cover by configurations (how many pieces of each length a sequence
holds). Whole copies of each well filled configuration are kept, and the pieces left over are placed
best fit first, all pieces of a length and sequences that hold the same at once. Spark ranks the pieces
of each length, and a piece's rank decides its sequence and place.

Null texts are empty. A document always has its end id, so it has a piece. Rows that repeat a
doc_id are packed on their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, materialize, texts_of
from cadenza.llm.tokens import encoder

#: Above 1, a long piece is worth more than short ones of the same total, so short ones stay to fill gaps.
LONG_FIRST = 1.5
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces; only the first is ever short."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces_of(docs: DataFrame, capacity: int, end_id: int, tokenizer_path: str | None) -> DataFrame:
    """Every document's pieces, with the crc32 of their ids."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = np.uint32(end_id).astype("<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for a in range(0, len(ids), 256):
                out: list[list] = [[] for _ in names]
                texts = [t or "" for t in b.column(1).slice(a, 256).to_pylist()]
                for doc_id, blob in zip(ids[a : a + 256], encoder(tokenizer_path).encode(texts), strict=True):
                    blob += end
                    start = 0
                    for k, n in enumerate(cut(len(blob) // 4, capacity)):
                        row = (doc_id, k, start, n, zlib.crc32(memoryview(blob)[4 * start : 4 * (start + n)]))
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return docs.mapInArrow(encode, PIECES)


def knapsack(price: np.ndarray, capacity: int) -> Counter:
    """The configuration of the highest price, by dynamic programming; price[n] is that of length n."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    turned = np.zeros(capacity + 1)  # best, from the last to the first
    for c in range(1, capacity + 1):
        total = turned[capacity - c + 1 :] + price[1 : c + 1]
        n = int(total.argmax()) + 1
        if total[n - 1] > best[c - 1]:
            best[c], choice[c] = total[n - 1], n
        else:
            best[c] = best[c - 1]
        turned[capacity - c] = best[c]
    found: Counter = Counter()
    c = capacity
    while c > 0:
        n = int(choice[c])
        if n:
            found[n] += 1
        c -= n or 1
    return found


def configurations(histogram: dict[int, int], capacity: int, rounds: int, step: float, enough: float) -> dict[tuple, float]:
    """A fractional cover of `enough` of the histogram's tokens by configurations ((length, count), ...).

    Multiplicative weights for the covering program: a length is priced at its share of a
    sequence, lowered by exp(-step) for each time that its demand has been met. Each round adds
    the configuration that the knapsack finds at these prices, as often as no demand in it is met
    more than once.
    """
    lengths = np.array(sorted(histogram))
    demand = np.zeros(capacity + 1)
    demand[lengths] = [histogram[int(n)] for n in lengths]
    share = (np.arange(capacity + 1) / capacity) ** LONG_FIRST
    price = np.where(demand > 0, share, 0)
    met = np.zeros(capacity + 1)
    tokens = demand * np.arange(capacity + 1)
    used: Counter = Counter()
    for _ in range(rounds):
        found = knapsack(price, capacity)
        n, c = np.fromiter(found, int), np.fromiter(found.values(), float)
        amount = float((demand[n] / c).min())
        used[tuple(sorted(found.items()))] += amount
        met[n] += c * amount / demand[n]
        price[n] = share[n] * np.exp(-step * met[n])
        if (np.minimum(met, 1) * tokens).sum() >= enough * tokens.sum():
            break
    return dict(used)


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Configurations of best fit, longest pieces first.

    All pieces of a length are placed at once: sequences that hold the same are one entry with a
    count, and those with the least room that fits take as many pieces as each has room for.
    """
    room: list[tuple[int, tuple]] = []  # (free, what the sequence holds), sorted
    count: dict[tuple[int, tuple], int] = {}

    def put(free: int, held: tuple, n: int) -> None:
        if (free, held) not in count:
            insort(room, (free, held))
            count[free, held] = 0
        count[free, held] += n

    for n, left in sorted(histogram.items(), reverse=True):
        while left:
            i = bisect_left(room, (n, ()))
            if i == len(room):
                put(capacity, (), -(-left // (capacity // n)))
                continue
            free, held = room.pop(i)
            there = count.pop((free, held))
            each = min(free // n, left)
            full = min(there, left // each)
            put(free - n * each, (*held, (n, each)), full)
            if there > full:
                put(free, held, there - full)
            left -= full * each
    out: Counter = Counter()
    for (_, held), n in count.items():
        if held:
            out[tuple(sorted(held))] += n
    return out


def rounded(left: dict[int, int], fraction: dict[tuple, float], capacity: int, most_free: float) -> Counter:
    """Whole copies of the well filled configurations; takes their pieces from `left`."""
    out: Counter = Counter()
    for config, x in sorted(fraction.items(), key=lambda p: (-sum(n * c for n, c in p[0]), -p[1], p[0])):
        copies = min([round(x), *(left[n] // c for n, c in config)])
        if copies > 0 and sum(n * c for n, c in config) >= (1 - most_free) * capacity:
            out[config] += copies
            for n, c in config:
                left[n] -= c * copies
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = 2000, step: float = 4.0) -> list[tuple[tuple, int]]:
    """(configuration, copies) that hold each piece of the histogram once.

    The program is solved and rounded down; what rounding leaves is a histogram again, until rounding
    takes under a tenth of it. After each round best fit places what is left, its work bounded
    by the lengths and configurations, not by the pieces, and the plan of the fewest sequences is kept.
    """
    left = {n: c for n, c in histogram.items() if n != capacity and c}
    out: Counter = Counter()
    plan: Counter = Counter()
    while left:
        before = sum(left.values())
        out += rounded(left, configurations(left, capacity, rounds, step, 0.97), capacity, 0.002)
        left = {n: c for n, c in left.items() if c}
        whole = out + best_fit(left, capacity)
        if not plan or whole.total() < plan.total():
            plan = whole
        if sum(left.values()) > 0.9 * before:
            break
    if histogram.get(capacity):
        plan[((capacity, 1),)] += histogram[capacity]
    return sorted(plan.items())


def slots(plan: list[tuple[tuple, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: (first rank, first sequence, pieces a sequence, offset of the first)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for config, copies in plan:
        offset = 0
        for n, c in config:
            runs.setdefault(n, []).append((ranks[n], sequence, c, offset))
            ranks[n] += c * copies
            offset += n * c
        sequence += copies
    return {n: tuple(np.array(r, np.int64).T) for n, r in runs.items()}


def ranked(pieces: DataFrame, group_rows: int) -> DataFrame:
    """Add `rank`, 0-based among the pieces of a length.

    A length may hold a large part of all rows, so ranks are counted in salted groups of about
    group_rows rows; the groups' sizes, summed up in order, give each group's first rank.
    """
    n = pieces.count()
    salts = max(1, n // group_rows)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    tokenizer_path: str | None = None,
    group_rows: int = 20_000,
) -> DataFrame:
    """A row for each piece: where it is in its document, and its sequence and offset there."""
    pieces = materialize(pieces_of(texts_of(docs, id_col, text_col), capacity, end_id, tokenizer_path), "pieces")
    # At most `capacity` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = slots(solve(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, base, count, at = places[int(n)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                own = rank[rows] - first[k]
                sequence[rows] = base[k] + own // count[k]
                offset[rows] = at[k] + own % count[k] * n
            kept = [b.column(x.split()[0]) for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [x.split()[0] for x in PACKED.split(", ")])

    return ranked(pieces, group_rows).mapInArrow(place, PACKED)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    bounded_batches(spark)
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
