"""Quality classifier: a linear model over n-gram indicators scaled by log-count ratios.

Features are indicators of word n-grams (runs of letters and digits, and runs of other visible
characters, as uni- and bigrams) and of trigrams of the words' shapes, hashed into a fixed number
of dimensions. Each indicator is scaled by the log ratio of its smoothed share in either class
(naive Bayes), rows are scaled to unit length, and a hinge loss is minimized by dual coordinate
descent. The margin becomes a score by a logistic fit on the learning rows, weighed so that the
classes count as in all labelled rows.

The model is fitted on at most `sample_rows` labelled rows of each class, taken in hash order, and
of these on as many as have `sample_bytes` of text together (one at least); both bounds are
parameters, and what reaches the driver is in proportion to them. Texts are taken whole. Everything is scored, whole texts at a time. Null and empty texts have
no features and are scored by the intercept alone. Labels that are null or other than 0 and 1 are
left out; of a document labelled twice the lower label counts. With labels of one class or none,
the score is 0.5 moved halfway to that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ByteHashes, joined, mix64, slices, small_batches, texts_of
from cadenza.llm.language_id import remainder

BITS = 18
#: Bytes of text whose features are taken at once.
SLICE = 1 << 18
SCORES = "doc_id long, score double, predicted int"


def _kinds() -> np.ndarray:
    kind = np.full(256, 2, np.uint8)  # other visible characters
    kind[:33] = 0
    kind[127] = 0
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        kind[a:b] = 1
    return kind


KINDS = _kinds()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every n-gram indicator that is set, in order, each once."""
    data, bounds = joined(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KINDS[data]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edges = np.unique(np.concatenate([[0], change, bounds[1:-1], [len(data)]]))
    edges = edges[edges <= len(data)]
    start, end = edges[:-1], edges[1:]
    seen = kind[start] > 0
    start, end = start[seen], end[seen]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(bounds, start, side="right") - 1
    h = ByteHashes(data).between(start, end)
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    n_capital, n_small = capitals[end] - capitals[start], small[end] - small[start]
    shape = np.where(n_capital == 0, 0, np.where(n_small == 0, np.where(n_capital > 1, 2, 1), 1)).astype(np.uint64)
    word = kind[start] == 1
    again = np.zeros(len(h), bool)  # the same word as one or two tokens before
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again[2:] |= (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
    shape = np.where(word, shape + np.uint64(4) * again, h | np.uint64(16))
    prime = np.uint64(0x9E3779B97F4A7C15)
    two = np.flatnonzero(doc[1:] == doc[:-1])
    three = np.flatnonzero(doc[2:] == doc[:-2])
    grams = [h, mix64(h[two] * prime + h[two + 1]), mix64((shape[three] * prime + shape[three + 1]) * prime + shape[three + 2])]
    docs = [doc, doc[two], doc[three]]
    mask = np.uint64((1 << BITS) - 1)
    key = np.concatenate([(d << BITS) | (g & mask).astype(np.int64) for d, g in zip(docs, grams, strict=True)])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray  # by feature: log-count ratio times the linear model's weight
    ratios: np.ndarray
    intercept: float
    slope: float
    offset: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, f = features(texts)
        n = len(texts)
        margin = np.bincount(doc, self.weights[f], n)
        norm = np.sqrt(np.bincount(doc, self.ratios[f] ** 2, n))
        z = self.slope * (margin / np.maximum(norm, 1e-9) + self.intercept) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dims: int, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent; the intercept is one more feature of value 1."""
    w, b = np.zeros(dims), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += d * values[i]
                b += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1) over the margin, by Newton steps on a lightly damped likelihood."""
    a, c = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-2 * np.array([a - 1, c])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        s = np.linalg.solve(h, g)
        a, c = a + s[0], c + s[1]
        if abs(s).max() < 1e-8:
            break
    return float(a), float(c)


def fit(doc: np.ndarray, feature: np.ndarray, labels: np.ndarray, share: float, smoothing: float = 1.0, cost: float = 4.0, epochs: int = 30) -> Model:
    """Fit on rows 0..len(labels)-1 with their features; share is class 1's part of all labelled rows."""
    dims = 1 << BITS
    one = np.bincount(feature[labels[doc] == 1], minlength=dims) + smoothing
    zero = np.bincount(feature[labels[doc] == 0], minlength=dims) + smoothing
    ratios = np.log(one / one.sum()) - np.log(zero / zero.sum())
    # A feature of no learning row has no count to speak of.
    ratios[(one == smoothing) & (zero == smoothing)] = 0
    cuts = np.searchsorted(doc, np.arange(len(labels) + 1))
    rows = [feature[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    values = [ratios[r] / max(np.sqrt(ratios[r] @ ratios[r]), 1e-9) for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    fold = np.arange(len(labels)) % 2
    held = np.zeros(len(labels))
    for k in (0, 1):  # margins of rows that the model has not seen, for the logistic fit
        use = np.flatnonzero(fold != k)
        if len(np.unique(y[use])) < 2:
            use = np.arange(len(labels))
        w, b = descend([rows[i] for i in use], [values[i] for i in use], y[use], np.full(len(use), cost), dims, epochs, 1)
        for i in np.flatnonzero(fold == k):
            held[i] = w[rows[i]] @ values[i] + b
    w, b = descend(rows, values, y, np.full(len(y), cost), dims, epochs, 1)
    n_one = max(1, int((labels == 1).sum()))
    weight = np.where(labels == 1, share / n_one, (1 - share) / max(1, len(labels) - n_one)) * len(labels)
    slope, offset = logistic(held, (labels == 1).astype(float), weight)
    return Model(ratios * w, ratios, b, slope, offset)


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 3000, sample_bytes: int = 32 << 20) -> Model:
    """Fit on up to sample_rows documents of each label, of sample_bytes together."""
    known = labels.select(F.col(label_id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter("i IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("i").agg(F.min("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        only = 0.75 * next(iter(counts), 0) + 0.25 * (1 - next(iter(counts), 0)) if counts else 0.5
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(only / (1 - only))))
    # Each task gives its first rows of a class only, 2 x sample_rows come here.
    first = {y: [r.i for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(sample_rows).select("i").collect()] for y in (0, 1)}
    picked = [(i, y, rank) for y, ids in first.items() for rank, i in enumerate(ids)]
    few = docs.sparkSession.createDataFrame(picked, "i long, y int, rank int")
    texts = texts_of(docs, id_col, text_col).join(F.broadcast(few), F.col("doc_id") == F.col("i"))
    sizes = texts.groupBy("y", "rank", "i").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).collect()
    total = {0: 0, 1: 0}
    sample: dict[int, int] = {}
    for r in sorted(sizes, key=lambda r: (r.y, r["rank"])):
        total[r.y] += r.n
        if total[r.y] <= sample_bytes or r.y not in sample.values():
            sample[r.i] = r.y
    few = docs.sparkSession.createDataFrame(list(sample.items()), "i long, y int")
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(few), F.col("doc_id") == F.col("i"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for i, j in slices(map(len, texts), SLICE):
                doc, f = features(texts[i:j])
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                blobs = [f[x:y].astype(np.int32).tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(blobs, pa.binary())], ["i", "y", "f"])

    found = rows.select("doc_id", "text", "y").mapInArrow(extract, "i long, y int, f binary").collect()
    found = sorted(found, key=lambda r: (r.i, bytes(r.f)))
    parts = [np.frombuffer(r.f, np.int32) for r in found]
    doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return fit(doc, flat, np.array([r.y for r in found], int), counts[1] / (counts[0] + counts[1]))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: score (probability of label 1) and predicted label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 weights, whatever the corpus

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for i, j in slices(map(len, texts), SLICE):
                s = shared.value.score(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts_of(docs, id_col, text_col).mapInArrow(judge, SCORES)


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents predicted to have label 1, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [(t or "").encode() for t in b.column(k).to_pylist()]
            for i, j in slices(map(len, texts), SLICE):
                yield b.slice(i, j - i).filter(pa.array(shared.value.score(texts[i:j]) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels whose remainder by 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 3) != 1)
    found = score_quality(docs, learn_quality(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
