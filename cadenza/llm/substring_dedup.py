"""Exact substring deduplication with longest-previous-factor arrays.

Every byte covered by a string of `length` bytes that also starts earlier (in a document of smaller
id, or earlier in the same one) is removed, judged on the input as it is.

A string of `length` bytes repeats where its longest previous factor is at least that long. To keep
the suffixes that a task must order few, windows of `length` bytes are gathered under anchors: the
piece of `gram` bytes with the least hash in the window. Equal windows have equal anchors, so

1. every document gives runs of windows with one anchor, each with a hash of the run's bytes;
   of equal runs in one task only the first is sent on, the others are copies for certain;
2. by anchor, of equal runs all but the first are copies, and where an anchor has but one kind of
   run, that is all there is to know;
3. for anchors with several kinds of runs, the bytes of the first run of each kind are fetched. Their
   windows are the suffixes of a small text; they are put in suffix order, and from previous and
   next smaller positions in that order come the longest previous factors, to `length` bytes.
   Anchors with over `wide` kinds of runs are dealt out window by window, each window with its
   bytes, so the suffixes of one anchor are ordered in many tasks; a task sends a window once;
4. each document gathers its repeated ranges and drops them.

An anchor found frequent in a sample of the documents is dealt out by context from the start, so no
task gets all its runs. `wide` and the sample decide who does the work, not what is found. Runs count as
equal by 64 bits of their context and 32 of their anchor, windows by their bytes.

Null texts are empty. Rows that repeat both doc_id and text count as one document, and each of them
gets that document's result; rows that repeat a doc_id with another text are documents of their own,
in the order of their texts' crc32. Null ids sort first. A document under `length` bytes is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ByteHashes, joined, materialize, mix64, shuffle_partitions, slices, small_batches, texts_of

NO_ID = -(1 << 63)
TEXTS = "doc_id long, doc long, tie long, z binary"
PARTS = "bucket int, kind int, blob binary"
FOUND = "kind int, doc long, tie long, lo int, hi int, off int, anchor long"
CONTEXTS = "kind int, key long, doc long, tie long, lo int, hi int, bytes binary"
RANGES = "doc long, tie long, lo int, hi int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: What an anchor's run is sent as.
RUN = np.dtype([("anchor", "<u4"), ("context", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("lo", "<i4"), ("hi", "<i4"), ("off", "<i4")])
COPY, FETCH, FINE = 0, 1, 2


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, anchor hash, context hash) of runs of windows with one anchor.

    A window of `length` bytes is anchored at the one of its `gram`-byte pieces whose hash is
    least, the leftmost if several are equal, so equal windows are anchored alike wherever they
    are. Windows that follow each other mostly share their anchor; the context is all their bytes.
    """
    data, bounds = joined(texts)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = ByteHashes(data)
    at = np.arange(len(data) - gram + 1)
    h = hashes.between(at, at + gram)
    bits = np.uint64(max(20, int(len(data)).bit_length()))
    key = ((h >> bits) << bits) | at.astype(np.uint64)
    least = (sliding_minimum(key, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Windows that would run into the next text.
    over = np.zeros(len(data) + 2, np.int32)
    np.add.at(over, np.maximum(bounds[1:] - length + 1, bounds[:-1]), 1)
    np.add.at(over, bounds[1:], -1)
    ok = np.flatnonzero(np.cumsum(over)[: len(least)] == 0)
    if not len(ok):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.concatenate([[True], (least[ok][1:] != least[ok][:-1]) | (np.diff(ok) != 1)])
    k = np.flatnonzero(new)
    first = ok[k]
    last = ok[np.concatenate([k[1:], [len(ok)]]) - 1]
    anchor = least[first]
    context = mix64(hashes.between(first, last + length) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    text = np.searchsorted(bounds, first, side="right") - 1
    base = bounds[text]
    return text, first - base, last - base, anchor - base, h[anchor], context


def previous_smaller(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the nearest place before it of a smaller position (or -1), and what they share.

    lcp[i] is what places i-1 and i share. Pointers that lead to larger positions are replaced by
    where those lead, all at once, until none does.
    """
    n = len(position)
    to = np.arange(n) - 1
    shared = lcp.copy()
    while True:
        again = np.flatnonzero((to >= 0) & (position[np.maximum(to, 0)] >= position))
        if not len(again):
            break
        via = to[again]
        shared[again] = np.minimum(shared[again], shared[via])
        to[again] = to[via]
    shared[to < 0] = 0
    return to, shared


def longest_previous_factors(suffixes: np.ndarray, position: np.ndarray) -> np.ndarray:
    """For each row of a matrix of suffixes, cut to equal length, what it shares with one of smaller position.

    Rows are put in suffix order by their bytes, eight at a time; the longest previous factor of a
    suffix is found at its previous or next smaller position in that order.
    """
    n, length = suffixes.shape
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = suffixes
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([position, *words.T[::-1]])
    rows = suffixes[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), length)
    rank = position[order]
    _, before = previous_smaller(rank, lcp)
    turned = np.concatenate([[0], lcp[1:][::-1]])
    _, after = previous_smaller(rank[::-1], turned)
    out = np.empty(n, np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def _packed(runs: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(runs[c]).tobytes() for c in RUN.names))


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // RUN.itemsize
    out, at = np.zeros(n, RUN), 0
    for c in RUN.names:
        out[c] = np.frombuffer(raw, RUN[c], n, at)
        at += n * RUN[c].itemsize
    return out


def _place(runs: np.ndarray) -> list[np.ndarray]:
    """Sort keys of a run's position, the last first."""
    return [runs["lo"], runs["tie"], runs["doc"]]


def _new(runs: np.ndarray, *names: str) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns."""
    out = np.ones(len(runs), bool)
    if len(runs):
        out[1:] = np.any([runs[n][1:] != runs[n][:-1] for n in names], axis=0)
    return out


def copies(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order of anchor, context and position; which of them repeat an earlier run."""
    runs = runs[np.lexsort([*_place(runs), runs["context"], runs["anchor"]])]
    first = _new(runs, "anchor", "context")
    at = np.maximum.accumulate(np.where(first, np.arange(len(runs)), 0))
    head = runs[at]
    same = (runs["doc"] == head["doc"]) & (runs["tie"] == head["tie"]) & (runs["lo"] == head["lo"])
    return runs, ~same


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [lo, hi) as ranges that neither overlap nor touch."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([new[1:], [True]])]


def merged_by_document(doc: np.ndarray, tie: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """merged() within each document."""
    order = np.lexsort([lo, tie, doc])
    doc, tie, lo, hi = doc[order], tie[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    change = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]) if len(doc) else np.zeros(0, bool)
    step = np.cumsum(change) << 33  # far apart, so ranges of two documents never touch
    a, b = merged(lo + step, hi + step)
    k = np.searchsorted(lo + step, a)
    return doc[k], tie[k], (a - step[k]).astype(np.int32), (b - step[k]).astype(np.int32)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, tie, text); tie tells apart texts that share an id."""
    rows = texts_of(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    repeats = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return rows.select("doc_id", "doc", (F.crc32("text") if repeats else F.lit(0).cast("long")).alias("tie"), "text")


def _compressed(rows: DataFrame) -> DataFrame:
    """(doc_id, doc, tie, z): texts compressed for an exchange."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in small_batches(batches):
            packed = [z.compress(t.encode()) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())], ["doc_id", "doc", "tie", "z"])

    return rows.mapInArrow(compress, TEXTS)


def _plain(z: list[bytes]) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in z]


def _found(kind, doc, tie, lo, hi, off, anchor) -> pa.RecordBatch:
    n = len(doc)
    columns = [np.full(n, kind, np.int32), doc.astype(np.int64), tie.astype(np.int64), lo.astype(np.int32), hi.astype(np.int32), np.broadcast_to(off, n).astype(np.int32), np.broadcast_to(anchor, n).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in FOUND.split(", ")])


def frequent_anchors(rows: DataFrame, length: int, gram: int, n_parts: int, sample_rows: int = 2000) -> np.ndarray:
    """Anchors with so many runs that one would be a large part of what a task should get, in order.

    They are counted in a sample of the documents, which decides how the work is dealt, not what is
    found. An anchor counts from an eighth of a task's share on, so there are at most 8 x n_parts.
    """
    n = rows.count()
    part = max(1, n // max(sample_rows, 16 * n_parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [t.encode() for t in b.column(0).to_pylist()]
            for i, j in slices(map(len, texts), 1 << 18):
                values, k = np.unique(anchors(texts[i:j], length, gram)[4] >> np.uint64(32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(k)], ["anchor", "n"])

    picked = rows.filter(F.pmod(F.xxhash64("doc", "tie"), F.lit(part)) == 0) if part > 1 else rows
    sizes = materialize(picked.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    least = max(32, total // (8 * n_parts))
    return np.array(sorted(r.anchor for r in sizes.filter(F.col("n") >= least).collect()), np.uint32)


def repeated_ranges(rows: DataFrame, length: int, gram: int, wide: int, flush: int = 1 << 18, shard_bytes: int = 1 << 18, sample_rows: int = 2000) -> DataFrame:
    """(doc, tie, lo, hi): byte ranges covered by windows that also start earlier."""
    spark = rows.sparkSession
    n_parts = shuffle_partitions(spark)
    n_buckets = 4 * n_parts
    frequent = frequent_anchors(rows, length, gram, n_parts, sample_rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            runs, copy = copies(np.concatenate(held))
            held, size = [], 0
            packed = []
            if copy.any():
                c = runs[copy]
                doc, tie, lo, hi = merged_by_document(c["doc"], c["tie"], c["lo"], c["hi"] + length)
                local = np.zeros(len(doc), RUN)
                local["doc"], local["tie"], local["lo"], local["hi"] = doc, tie, lo, hi
                bucket = (mix64(doc.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
                packed += [(int(k), COPY, _packed(local[bucket == k])) for k in np.unique(bucket)]
            runs = runs[~copy]
            runs = runs[_new(runs, "anchor", "context", "doc", "tie", "lo")]  # rows given twice
            runs = runs[np.lexsort(_place(runs))]
            # Equal runs meet by anchor, those of a frequent anchor by their context.
            spread = np.isin(runs["anchor"], frequent)
            bucket = np.where(spread, runs["context"] % np.uint64(n_buckets), runs["anchor"] % n_buckets).astype(np.int64)
            for kind, some in ((FETCH, np.flatnonzero(~spread)), (FINE, np.flatnonzero(spread))):
                if len(some):
                    order = some[np.argsort(bucket[some], kind="stable")]
                    values, begin = np.unique(bucket[order], return_index=True)
                    packed += [(int(k), kind, _packed(part)) for k, part in zip(values, np.split(runs[order], begin[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "blob"])

        for b in small_batches(batches, 128):
            texts = [t.encode() for t in b.column(2).to_pylist()]
            doc, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in slices(map(len, texts), shard_bytes):
                text, lo, hi, at, h, context = anchors(texts[i:j], length, gram)
                runs = np.zeros(len(text), RUN)
                runs["anchor"], runs["context"] = h >> np.uint64(32), context
                runs["doc"], runs["tie"], runs["lo"], runs["hi"], runs["off"] = doc[i:j][text], tie[i:j][text], lo, hi, at - lo
                held.append(runs)
                size += len(runs)
                if size >= flush:
                    yield from out()
        if size:
            yield from out()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {FETCH: [], FINE: []}
        size = 0
        now = None

        def first_runs(kind: int) -> Iterator[pa.RecordBatch]:
            """Leaves the first of equal runs; the others are copies."""
            runs, copy = copies(np.concatenate(held[kind]))
            c = runs[copy]
            yield _found(COPY, c["doc"], c["tie"], c["lo"], c["hi"] + length, 0, 0)
            runs = runs[~copy]
            held[kind] = [runs[_new(runs, "anchor", "context")]]

        def out() -> Iterator[pa.RecordBatch]:
            for kind in (FETCH, FINE):
                if not held[kind]:
                    continue
                yield from first_runs(kind)
                runs = held[kind].pop()
                group = np.cumsum(_new(runs, "anchor")) - 1
                kinds = np.bincount(group)[group] if len(runs) else np.zeros(0, int)
                by_window = (kinds > wide) | (kind == FINE)
                for to, some in ((FETCH, (kinds > 1) & ~by_window), (FINE, by_window)):
                    r = runs[some]
                    yield _found(to, r["doc"], r["tie"], r["lo"], r["hi"], r["off"], r["anchor"])

        for b in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now and now is not None:
                    yield from out()
                    size = 0
                now = bucket
                x = _unpacked(blob)
                if kind == COPY:
                    yield _found(COPY, x["doc"], x["tie"], x["lo"], x["hi"], 0, 0)
                    continue
                held[kind].append(x)
                size += len(x)
                if size > 4 * flush:
                    for k in (FETCH, FINE):
                        if held[k]:
                            yield from first_runs(k)
                    size = flush * (sum(len(x) for v in held.values() for x in v) // flush)
        yield from out()

    sent = rows.select("doc", "tie", "text").mapInArrow(send, PARTS).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    found = materialize(sent.mapInArrow(resolve, FOUND), "runs")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CONTEXTS.split(", ")]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        packed: list[tuple] = []
        seen: dict[bytes, tuple[int, int, int]] = {}  # windows that this task has sent, and where

        def windows(text: bytes, doc: int, tie: int, lo: int, hi: int) -> None:
            nonlocal seen
            if len(seen) > 1 << 17:
                seen = {}
            h = ByteHashes(np.frombuffer(text[lo : hi + length], np.uint8))
            at = np.arange(hi - lo + 1)
            for key, i in zip(h.between(at, at + length).view(np.int64).tolist(), range(lo, hi + 1), strict=True):
                w = text[i : i + length]
                if w in seen and seen[w] < (doc, tie, i):
                    last = packed[-1] if packed else None
                    if last and last[0] == COPY and last[2:4] == (doc, tie) and last[4] <= i <= last[5]:
                        packed[-1] = (*last[:5], i + length, b"")
                    else:
                        packed.append((COPY, 0, doc, tie, i, i + length, b""))
                elif seen.get(w) != (doc, tie, i):
                    seen[w] = (doc, tie, i)
                    packed.append((FINE, key, doc, tie, i, i + length, w))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed, strict=True), types, strict=True)], names)

        for b in small_batches(batches):
            for doc, tie, z, wanted in zip(b.column("doc").to_pylist(), b.column("tie").to_pylist(), b.column("z").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                text = _plain([z])[0]
                for w in sorted(wanted, key=lambda w: w["lo"]):
                    if w["kind"] == FINE:
                        windows(text, doc, tie, w["lo"], w["hi"])
                    else:
                        packed.append((FETCH, w["anchor"], doc, tie, w["lo"], w["hi"] + length, text[w["lo"] : w["hi"] + length]))
                if len(packed) > 20_000:
                    yield out()
                    packed = []
        if packed:
            yield out()

    # As many as a document has runs, so bounded by its length.
    wanted = found.filter(F.col("kind") != COPY).groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "lo", "hi", "anchor")).alias("wanted"))
    contexts = materialize(_compressed(rows).dropDuplicates(["doc", "tie"]).join(wanted, ["doc", "tie"]).select("doc", "tie", "z", "wanted").mapInArrow(fetch, CONTEXTS), "contexts")

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.Table) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x) for x in part.column("bytes").to_pylist()], np.int64)
            data = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8)
            doc, tie, lo = (part.column(c).to_numpy() for c in ("doc", "tie", "lo"))
            n = sizes - length + 1
            row = np.repeat(np.arange(len(n)), n)
            own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(sizes) - sizes)[row] + own
            start = lo[row] + own
            position = np.empty(len(row), np.int64)
            position[np.lexsort([start, tie[row], doc[row]])] = np.arange(len(row))
            suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[at]
            again = longest_previous_factors(suffixes, position) >= length
            d, t, a, b = merged_by_document(doc[row][again], tie[row][again], start[again], start[again] + length)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(a), pa.array(b)], ["doc", "tie", "lo", "hi"])

        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = held.column("key").to_numpy()
            while len(held) > 1500:  # whole keys, about so many runs at a time
                cut = int(np.searchsorted(key, key[1500]))
                cut = cut or int(np.searchsorted(key, key[0], side="right"))
                if cut >= len(held) or cut == 0:
                    break
                yield from out(held.slice(0, cut).combine_chunks())
                held, key = held.slice(cut), key[cut:]
        if held is not None and len(held):
            yield from out(held.combine_chunks())

    # Runs of an anchor, or windows of one hash: at most `wide` runs, or a few of each task's windows.
    gathered = contexts.filter(F.col("kind") != COPY).select("key", "doc", "tie", "lo", "bytes").repartition("key").sortWithinPartitions("key")
    copied = [x.filter(F.col("kind") == COPY).select("doc", "tie", "lo", "hi") for x in (found, contexts)]
    return copied[0].union(copied[1]).union(gathered.mapInArrow(factor, RANGES))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 40, wide: int = 1000, keep_text: bool = False) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, hash of the rest (and the rest itself, if asked)."""
    rows = _rows(docs, id_col, text_col)
    ranges = repeated_ranges(rows, length, gram, wide)
    gathered = ranges.groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    names = [x.split()[0] for x in RESULT.split(", ")] + ["kept"] * keep_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            done = []
            lists = b.column("ranges")
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
            flat = lists.flatten()
            lo, hi = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            ends = np.cumsum(counts)
            for doc_id, z, n, end in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), counts, ends, strict=True):
                text = _plain([z])[0]
                a, c = merged(lo[end - n : end], hi[end - n : end])
                kept = text
                if len(a):
                    kept = b"".join(text[x:y] for x, y in zip([0, *c.tolist()], [*a.tolist(), len(text)], strict=True))
                done.append((doc_id, len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
            columns = zip(*done, strict=True) if done else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    whole = _compressed(rows).join(gathered, ["doc", "tie"], "left").select("doc_id", "z", "ranges")
    return whole.mapInArrow(drop, RESULT + ", kept binary" * keep_text)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in 100-byte strings that start earlier in the corpus."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
