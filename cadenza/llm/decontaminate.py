"""Benchmark decontamination with training suffix arrays.

The training texts are cut into shards of whole documents. Each task builds the word-level suffix
array of a shard and binary-searches every suffix of every test item in it, for all of them at
once: the range of suffixes that share the first k words narrows word by word. The range left at
the window's length gives the occurrences of a test window, and the last range that is not empty
gives the longest verbatim match and where it is. Shards need nothing from each other, so no
training text is shuffled.

A training word that no test item holds ends every match, so it stands as a break, and words
between two breaks that are fewer than the shortest window are left out of the array: no match of
a window's length lies there.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null
texts have no words; a document without words is kept. A test item without words matches nothing.
Rows that repeat an id are judged one by one. Without test items nothing is contaminated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ByteHashes, bounded_batches, joined, materialize, slices, small_batches, split_words, texts_of, word_table

FOLD, FLAGS = word_table(True, [*range(48, 58), *range(97, 123), *range(128, 256)])
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "item_id string, item_word long, n_words long, doc_id long, doc_word long"


@dataclass
class Tests:
    """Words of a block of test items: all items' words in a row, as ranks in the block's vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes
    words: np.ndarray  # rank + 1 of each word
    item: np.ndarray  # of each window
    start: np.ndarray  # first word of each window, in words
    end: np.ndarray  # of the window's item, in words
    width: np.ndarray  # words of each window
    names: list[str]
    firsts: np.ndarray  # first word of each item


def tests_of(items: list[tuple[str, str | None]], window: int) -> Tests:
    hashes, starts, _, bounds = words_of([(t or "").encode() for _, t in items])
    vocabulary = np.unique(hashes)
    n = np.diff(bounds)
    width = np.minimum(n, window)
    count = np.where(n > 0, n - width + 1, 0)
    item = np.repeat(np.arange(len(items)), count)
    own = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return Tests(vocabulary, np.searchsorted(vocabulary, hashes) + 1, item, bounds[item] + own, bounds[item + 1], width[item], [i for i, _ in items], bounds[:-1])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the texts, and the number of words before each text."""
    data, bounds = joined(texts)
    data = FOLD[data]
    start, end, before = split_words(data, bounds, FLAGS)
    return ByteHashes(data).between(start, end), start, end, before


def ranks_of(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Rank + 1 of each word in the vocabulary, 0 for other words."""
    if not len(vocabulary) or not len(hashes):
        return np.zeros(len(hashes), np.int64)
    there = np.zeros(1 << 18, bool)
    there[(vocabulary & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    out = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(there[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
    k = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    same = vocabulary[k] == hashes[maybe]
    out[maybe[same]] = k[same] + 1
    return out


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int, top: int) -> np.ndarray:
    """The starts in suffix order; text is 0 at breaks, which end a suffix, and 1..top elsewhere.

    Prefixes are packed into 64-bit keys, sorted, and only starts that still tie are sorted again
    by the ranks behind them, twice as deep each round, to `depth` words.
    """
    bits = max(1, int(top).bit_length())
    h = max(1, 63 // bits)
    padded = np.concatenate([text, np.zeros(h, text.dtype)])
    key = np.zeros(len(starts), np.int64)
    alive = np.ones(len(starts), bool)
    for k in range(h):
        got = padded[starts + k]
        alive &= got > 0
        key = (key << bits) | np.where(alive, got, 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    array, open_ = starts[order], alive[order]
    rank = np.zeros(len(text) + 1, np.int64)
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    rank[array] = group + 1
    while h < depth:
        size = np.bincount(group, minlength=len(group))[group]
        tied = np.flatnonzero((size > 1) & open_)
        if not len(tied):
            break
        behind = rank[np.minimum(array[tied] + h, len(text))]
        again = np.lexsort((behind, group[tied]))
        array[tied] = array[tied][again]
        behind = behind[again]
        g = group[tied]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (behind[1:] != behind[:-1])])
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[array[tied]] = group[tied] + 1
        open_[tied] = behind > 0
        h *= 2
    return array


def narrow(text: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range [lo, hi), the part whose suffixes have `word` as their k-th word, by binary search."""

    def bound(least: np.ndarray) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (active := np.flatnonzero(a < b)).size:
            mid = (a[active] + b[active]) >> 1
            below = text[array[mid] + k[active]] < least[active]
            a[active] = np.where(below, mid + 1, a[active])
            b[active] = np.where(below, b[active], mid)
        return a

    return bound(word), bound(word + 1)


class Shard:
    """A suffix array over whole documents."""

    def __init__(self, texts: list[bytes], tests: Tests):
        hashes, _, _, before = words_of(texts)
        n = np.diff(before)
        self.before, self.n_words = before, n
        # A break after each document; word i of all stands at i + its document's number.
        self.doc_of = np.repeat(np.arange(len(texts)), n)
        text = np.zeros(len(hashes) + len(texts) + 1, np.int64)
        self.place = np.arange(len(hashes)) + self.doc_of
        text[self.place] = ranks_of(hashes, tests.vocabulary)
        self.text, self.tests = text, tests
        least = int(tests.width.min()) if len(tests.width) else 1
        stop = np.flatnonzero(text == 0)
        run = np.diff(np.concatenate([[-1], stop]))[np.searchsorted(stop, self.place)] - 1
        starts = self.place[run >= least]
        depth = int((tests.end - tests.start).max()) if len(tests.start) else 1
        self.array = suffix_array(text, starts, depth, len(tests.vocabulary))
        self.word_at = np.zeros(len(text), np.int64)
        self.word_at[self.place] = np.arange(len(hashes))

    def search(self, longest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(test window, first and end of its range, words matched) of the windows that occur."""
        t = self.tests
        which = np.arange(len(t.start))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(self.array), np.int64)
        k = np.zeros(len(which), np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        while len(which):
            full = k >= ((t.end - t.start)[which] if longest else t.width[which])
            if full.any():
                done.append((which[full], lo[full], hi[full], k[full]))
                which, lo, hi, k = (x[~full] for x in (which, lo, hi, k))
            a, b = narrow(self.text, self.array, lo, hi, k, t.words[t.start[which] + k])
            some = a < b
            if longest:
                over = ~some & (k >= t.width[which])
                done.append((which[over], lo[over], hi[over], k[over]))
            which, lo, hi, k = which[some], a[some], b[some], k[some] + 1
        if not done:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of lo and hi, word number in the shard) of all suffixes in the ranges."""
        n = hi - lo
        row = np.repeat(np.arange(len(lo)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        return row, self.word_at[self.array[at]]


def marked(texts: list[bytes], blocks: list[Tests]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words of each text, for every word whether it is hit, and the occurring items of each text."""
    items: list[list[str]] = [[] for _ in texts]
    covered = n_words = shard = None
    for tests in blocks:
        shard = Shard(texts, tests)
        n_words = shard.n_words
        window, lo, hi, _ = shard.search(longest=False)
        row, word = shard.occurrences(lo, hi)
        window = window[row]
        if covered is None:
            covered = np.zeros(n_words.sum() + 1, np.int64)
        covered += np.bincount(word, minlength=len(covered)) - np.bincount(word + tests.width[window], minlength=len(covered))
        pairs = np.unique(shard.doc_of[word] * len(tests.names) + tests.item[window]) if len(word) else []
        for p in pairs:
            items[p // len(tests.names)].append(tests.names[p % len(tests.names)])
    if shard is None:
        _, _, _, before = words_of(texts)
        return np.diff(before), np.zeros(int(before[-1]), bool), items
    return n_words, np.cumsum(covered[:-1]) > 0, items


def hits(texts: list[bytes], blocks: list[Tests]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words, hit words and occurring items of each text."""
    n_words, hit, items = marked(texts, blocks)
    inside = np.concatenate([[0], np.cumsum(hit)])
    return n_words, np.diff(inside[np.concatenate([[0], np.cumsum(n_words)])]), items


def hit_runs(n_words: np.ndarray, hit: np.ndarray) -> list[list[int]]:
    """For each text the first word of each run of hit words and the word after it, one after the other."""
    out = []
    ends = np.cumsum(n_words)
    for end, n in zip(ends.tolist(), n_words.tolist(), strict=True):
        own = np.concatenate([[False], hit[end - n : end], [False]])
        out.append(np.flatnonzero(own[1:] != own[:-1]).tolist())
    return out


#: Characters of test items that one pass takes; every worker holds them as suffix arrays, some 40 bytes a word.
MOST_TEST_CHARS = 64 << 20


def test_passes(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_chars: int, most_chars: int) -> Iterator[list[Tests]]:
    """The test items in blocks of at most block_chars characters, each small enough to broadcast, and as many blocks as one pass takes.

    Items come in the order of their ids, so a block is the same however often it is made, and only those of
    one pass are on the driver.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t"))
    blocks: list[Tests] = []
    block: list[tuple[str, str | None]] = []
    size = held = 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        n = len(r.t or "")
        if block and (size + n > block_chars or held + n > most_chars):
            blocks.append(tests_of(block, window))
            block, size = [], 0
        if blocks and held + n > most_chars:
            yield blocks
            blocks, held = [], 0
        block.append((r.i, r.t))
        size += n
        held += n
    if block:
        yield [*blocks, tests_of(block, window)]


def _shards(batches: Iterator[pa.RecordBatch], column: int, shard_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of shards of whole texts, and the texts."""
    for b in small_batches(batches, 1024):
        texts = [(t or "").encode() for t in b.column(column).to_pylist()]
        for i, j in slices(map(len, texts), shard_bytes):
            yield b.slice(i, j - i), texts[i:j]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shard_bytes: int = 1 << 20,
    block_chars: int = 8 << 20,
    most_chars: int = MOST_TEST_CHARS,
) -> DataFrame:
    """Per document, how many of its words lie in an occurrence of a test window, and of which items.

    The test set is broadcast in blocks of bounded size. One of more than most_chars characters is searched for in
    passes over the documents, one after the other, which are told apart by a number of their own then; each pass writes the
    runs of words that it hit, and the runs of a document are united.
    """
    sc = docs.sparkSession.sparkContext
    texts = texts_of(docs, id_col, text_col)
    passes = test_passes(benchmark, item_id_col, item_text_col, window, block_chars, most_chars)
    first, second = next(passes, []), next(passes, None)
    shared = [sc.broadcast(t) for t in first]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for rows, own in _shards(batches, 1, shard_bytes):
            n_words, n_hit, items = hits(own, [x.value for x in shared])
            unique = [sorted(set(x)) for x in items]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in unique]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in unique], pa.int64()), pa.array(sha), pa.array(n_hit > 0)], names)

    if second is None:
        return texts.mapInArrow(judge, DIGEST)
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "texts")

    def one_pass(blocks: list[Tests], number: int) -> DataFrame:
        shared = [sc.broadcast(t) for t in blocks]

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, own in _shards(batches, 1, shard_bytes):
                n_words, hit, items = marked(own, [x.value for x in shared])
                runs = hit_runs(n_words, hit)
                out = pa.RecordBatch.from_arrays([rows.column(2), rows.column(0), pa.array(n_words), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))], ["row", "doc_id", "n_words", "runs", "items"])
                yield out if number == 0 else out.filter(pa.array([bool(x) for x in runs]))

        found = materialize(texts.mapInArrow(mark, "row long, doc_id long, n_words long, runs array<long>, items array<string>"), f"pass-{number}")
        for x in shared:
            x.unpersist()
        return found

    found = [one_pass(blocks, k) for k, blocks in enumerate(chain([first, second], passes))]
    return _united(reduce(DataFrame.unionByName, found))


def _united(found: DataFrame) -> DataFrame:
    """Digest of each row from what its passes hit: at most a row a pass."""
    whole = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    ranges = F.array_sort(F.transform(F.sequence(F.lit(0), F.floor(F.size("runs") / 2).cast("int") - 1), lambda i: F.struct(F.get("runs", 2 * i).alias("a"), F.get("runs", 2 * i + 1).alias("b"))))
    ranges = F.when(F.size("runs") > 0, ranges)
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(ranges, start, lambda s, r: F.struct(F.greatest(s["end"], r["b"]).alias("end"), (s["n"] + F.greatest(r["b"] - F.greatest(s["end"], r["a"]), F.lit(0))).alias("n")))["n"]
    n_hit = F.coalesce(total, F.lit(0)).cast("long")
    return whole.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shard_bytes: int = 1 << 20,
    block_chars: int = 8 << 20,
    most_chars: int = MOST_TEST_CHARS,
) -> DataFrame:
    """For every test suffix that occurs for at least a window, its longest matches over all shards.

    Rows: item, first word in the item, words matched, document, first word in the document; the
    longest over all shards, with every place where it is. Each pass over a part of the test set writes what it finds.
    """
    sc = docs.sparkSession.sparkContext
    source = texts_of(docs, id_col, text_col)

    def one_pass(blocks: list[Tests]) -> DataFrame:
        shared = [sc.broadcast(t) for t in blocks]

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in MATCHES.split(", ")]
            for rows, own in _shards(batches, 1, shard_bytes):
                for tests in (x.value for x in shared):
                    shard = Shard(own, tests)
                    w, lo, hi, n = shard.search(longest=True)
                    row, word = shard.occurrences(lo, hi)
                    w, n = w[row], n[row]
                    doc = shard.doc_of[word]
                    columns = [
                        pa.array([tests.names[k] for k in tests.item[w]], pa.string()),
                        pa.array(tests.start[w] - tests.firsts[tests.item[w]]),
                        pa.array(n),
                        rows.column(0).take(pa.array(doc)),
                        pa.array(word - shard.before[doc]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

        found = materialize(source.mapInArrow(find, MATCHES), "matches")
        for x in shared:
            x.unpersist()
        return found

    passes = [one_pass(blocks) for blocks in test_passes(benchmark, item_id_col, item_text_col, window, block_chars, most_chars)]
    found = reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], MATCHES)
    most = found.groupBy(F.col("item_id").alias("i"), F.col("item_word").alias("p")).agg(F.max("n_words").alias("most"))
    same = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_word") == F.col("p")) & (F.col("n_words") == F.col("most"))
    return found.join(most, same, "left_semi")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_bytes: int = 1 << 20, block_chars: int = 8 << 20, most_chars: int = MOST_TEST_CHARS
) -> DataFrame:
    """The documents none of whose words lie in an occurrence of a test window, all columns kept. Each pass but the last writes what it keeps."""
    sc = docs.sparkSession.sparkContext
    column = docs.columns.index(text_col)
    schema = docs.schema

    def kept(docs: DataFrame, blocks: list[Tests]) -> DataFrame:
        shared = [sc.broadcast(t) for t in blocks]

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, own in _shards(batches, column, shard_bytes):
                _, n_hit, _ = hits(own, [x.value for x in shared])
                yield rows.filter(pa.array(n_hit == 0))

        return docs.mapInArrow(keep, schema)

    out = docs
    for number, blocks in enumerate(test_passes(benchmark, item_id_col, item_text_col, window, block_chars, most_chars)):
        out = kept(materialize(out, "kept") if number else out, blocks)
    return out


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of benchmark items."""
    bounded_batches(spark)
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS p FROM iw),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM pat) WHERE len(w) >= k),
dp AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS p FROM dw),
hit AS (SELECT dp.doc_id, dp.s, dp.k, pat.item_id FROM dp JOIN pat ON dp.k = pat.k AND dp.p = pat.p),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
