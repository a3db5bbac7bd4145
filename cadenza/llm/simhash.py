"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code over 46 bits of the fingerprint: two binary Golay codes of
length 23 side by side. Each covers its bits with radius 3, so every fingerprint is within 6 of an
anchor. A fingerprint is sent to all anchors within 6 + threshold of it; two fingerprints that
differ in at most `threshold` bits then meet at the anchor nearest to either of them. Fingerprints
that meet are compared in full, and linked ones form components.

Equal fingerprints are one before they are sent, so copies do not add to an anchor. An anchor that
still gets very many is dealt out in pairs of blocks, so no task gets all of it. Tasks give back
a star for what they link, not all pairs.

Words are runs of other characters than ASCII white space, A-Z lower-cased; a text with fewer words
than a shingle is one shingle, and a text without words (or null) has fingerprint zero, linked like
any other. Rows that repeat a doc_id count as they are; component_id is the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import discard, joined_to_groups, materialize, may_match, small_batches, texts_of

#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0xAE3
LENGTH, RADIUS = 23, 3


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(x, 42) for x in parts], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the fingerprint's bits as a signed long."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fps = np.array([fingerprint((t or "").encode(), shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(sketch, "doc_id long, text_hash long, fp long")


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    v = v.astype(np.int64)
    for k in range(LENGTH - 1, 10, -1):
        v = np.where((v >> k) & 1, v ^ (GOLAY << (k - 11)), v)
    return v


@lru_cache(maxsize=4)
def patterns(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit patterns of at most `most` ones in order of (syndrome, ones), and where each (syndrome, ones) begins."""
    found = [np.zeros(1, np.int64)]
    for _ in range(most):
        last = found[-1]
        top = np.where(last > 0, np.floor(np.log2(np.maximum(last, 1))).astype(np.int64) + 1, 0)
        found.append(np.concatenate([last[top <= k] | (1 << k) for k in range(LENGTH)]))
    p = np.concatenate(found)
    ones = np.repeat(np.arange(most + 1), [len(x) for x in found])
    key = syndrome(p) * (most + 1) + ones
    order = np.argsort(key, kind="stable")
    return p[order], np.searchsorted(key[order], np.arange(2048 * (most + 1) + 1))


def anchors_near(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, anchor) of all anchors within the covering radius plus threshold."""
    most = 2 * RADIUS + threshold
    p, begin = patterns(most)
    fps = fps.view(np.uint64)
    mask = np.uint64((1 << LENGTH) - 1)
    a, b = (fps & mask).astype(np.int64), ((fps >> np.uint64(LENGTH)) & mask).astype(np.int64)
    sa, sb = syndrome(a) * (most + 1), syndrome(b) * (most + 1)
    rows, anchors = [], []
    for d in range(most + 1):  # ones of the first half's pattern; the second's has most - d at most
        na, nb = begin[sa + d + 1] - begin[sa + d], begin[sb + most - d + 1] - begin[sb]
        n = na * nb
        row = np.repeat(np.arange(len(fps)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = a[row] ^ p[begin[sa[row] + d] + k // np.maximum(nb[row], 1)]
        second = b[row] ^ p[begin[sb[row]] + k % np.maximum(nb[row], 1)]
        rows.append(row)
        anchors.append(((first >> 11) << 12) | (second >> 11))  # the code is systematic in its upper 12 bits
    return np.concatenate(rows), np.concatenate(anchors)


def mixed(x: np.ndarray) -> np.ndarray:
    return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what (a, b) join, one for each value but the least of its component."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(values))
    return values[label[other]], values[other]


def close_pairs(key: np.ndarray, fp: np.ndarray, threshold: int, most_pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints with the same key (rows come sorted by it) that differ in `threshold` bits at most."""
    if len(key) < 2:
        return
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    size = np.diff(np.concatenate([[0], cut, [len(key)]]))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(key)) - 1  # rows of the same key that follow
    at = np.flatnonzero(left > 0)
    u = fp.view(np.uint64)
    k = 1
    while len(at):
        for i in range(0, len(at), most_pairs):
            x = at[i : i + most_pairs]
            near = np.bitwise_count(u[x] ^ u[x + k]) <= threshold
            if near.any():
                yield fp[x[near]], fp[x[near] + k]
        k += 1
        at = at[left[at] >= k]


def links(nodes: DataFrame, threshold: int = 2, many: int = 20_000, sample: int = 1 << 17) -> DataFrame:
    """(a, b): links that connect all fingerprints at most `threshold` bits apart; nodes has distinct fp.

    A sample of the fingerprints tells which anchors get over `many` of them; those anchors' rows
    go to every pair of their blocks. The sample decides how the work is dealt, not what is found.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    part = max(1, n // sample)
    seen = nodes.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(part)) == 0) if part > 1 else nodes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, anchor = anchors_near(b.column(0).to_numpy(), threshold)
            values, n = np.unique(anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["anchor", "n"])

    hot: dict[int, int] = {}
    if n > many:
        sizes = seen.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
        # At most sample x replicas / many anchors can pass.
        hot = {r.anchor: -(-r.n * part // many) for r in sizes.filter(F.col("n") * part > many).collect()}
    names = np.array(sorted(hot), np.int64)
    blocks = np.array([hot[k] for k in sorted(hot)], np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                fps = batch.column(0).slice(i, 2000).to_numpy()
                row, anchor = anchors_near(fps, threshold)
                key = anchor << 32
                if len(names):
                    k = np.minimum(np.searchsorted(names, anchor), len(names) - 1)
                    m = np.where(names[k] == anchor, blocks[k], 1)
                    own = mixed(fps)[row] % m
                    row, other = np.repeat(row, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    own = np.repeat(own, m)
                    key = np.repeat(key, m) | (np.minimum(own, other) << 16) | np.maximum(own, other)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b, held = [], [], 0

        def take(k, f):
            nonlocal a, b, held
            for x, y in close_pairs(k, f, threshold):
                a.append(x)
                b.append(y)
                held += len(x)
                if held > 1 << 21:
                    x, y = stars(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], len(x)

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            take(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
        take(key, fp)
        if a:
            x, y = stars(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    sent = nodes.mapInArrow(send, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return sent.mapInArrow(compare, "a long, b long").distinct()


def connected(edges: DataFrame, rounds: int = 60, hub_edges: int = 1_000_000) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's smallest value.

    Large-star and small-star steps in turn, each pair of them written to the shared folder, until
    nothing changes. With over `hub_edges` edges, nodes with very many meet them by a broadcast.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        n = edges.count()

        def with_least(rows: DataFrame, least: DataFrame, n: int = n) -> DataFrame:
            return joined_to_groups(rows, least, "a") if n > hub_edges else rows.join(least.drop("n"), "a")

        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        large = with_least(both.filter("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.distinct()
        # Small star: of a's smaller neighbours, the least takes the others and a.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
        new = materialize(small.distinct(), "edges")
        discard(edges)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int) -> DataFrame:
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = connected(links(nodes.select("fp"), threshold))
    # Only fingerprints with a link have another root than themselves.
    linked = materialize(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "n", "root"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    least = joined_to_groups(linked.select("fp", "root"), least, "root").select(F.col("fp").alias("linked_fp"), "least")
    named = nodes.join(least, F.col("fp") == F.col("linked_fp"), "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    return joined_to_groups(fps, materialize(named, "named"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """Per document: doc_id, fingerprint and component_id, the smallest doc_id reachable over links."""
    found = _components(docs, id_col, text_col, shingle, threshold)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Multipliers that order a text's shingles anew for each sample and each place of the signature.
_ORDERS = (np.random.default_rng(42).integers(0, 1 << 63, 512, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: bytes, shingle: int) -> list[bytes]:
    """The text's runs of `shingle` words; all its words where it has fewer."""
    words = text.lower().split()
    if not words:
        return []
    return [*map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))] if len(words) >= shingle else [b" ".join(words)]


def sampled(text: bytes, shingle: int, samples: int, size: int, places: int, least: float = 0.8, few: int = 20) -> tuple[list[int], bytes, int]:
    """Fingerprints of `samples` samples of the text's shingles, a signature of `places` minima, and the number of shingles.

    A sample is the `size` shingles that come first in an order of its own, so two texts draw the same
    one with about their Jaccard similarity to the power `size`. A text of at most `few` shingles also
    gets every choice of `size` among its first ones in one common order: two such texts that are
    `least` alike share so many shingles that the first `size` of these are among the first of both.
    """
    import xxhash

    hashes = np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles(text, shingle)], np.uint64))
    if not len(hashes):
        return [0] * samples, b"\xff" * (2 * places), 0
    out = []
    for order in _ORDERS[:samples]:
        turned = hashes * order
        first = hashes[np.argpartition(turned, size - 1)[:size]] if len(hashes) > size else hashes
        ones = np.unpackbits(first.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big", signed=True))
    if size <= len(hashes) <= few:
        first = hashes[: len(hashes) - math.ceil(least * len(hashes) - 1e-9) + size].astype(">u8")
        out += [int.from_bytes(xxhash.xxh64_digest(b"".join(c)), "big", signed=True) for c in combinations([x.tobytes() for x in first], size)]
    least_of = np.full(places, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 512):
        least_of = np.minimum(least_of, (hashes[i : i + 512, None] * _ORDERS[None, samples : samples + places]).min(0))
    return out, (least_of >> np.uint64(48)).astype("<u2").tobytes(), len(hashes)


def sample_keys(texts: DataFrame, samples: int = 12) -> DataFrame:
    """(text_hash, anchor, lead): a row for each sample of a text that others have too; lead is the least of those texts."""
    keys = texts.select("text_hash", F.posexplode("views").alias("view", "fp"))
    keys = keys.select("text_hash", F.xxhash64(F.least("view", F.lit(samples)), "fp").alias("anchor")).distinct()
    shared = keys.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("lead")).filter("n > 1")
    return keys.join(shared.select("anchor", "lead"), "anchor").select("text_hash", "anchor", "lead")


def hashed_shingles(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(text_hash, hashes) of the needed texts (text_hash) among docs (text_hash, text): the sorted 32-bit hashes of their shingles, each once."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in small_batches(batches):
            sets = (np.array([xxhash.xxh64_intdigest(x, 42) & 0xFFFFFFFF for x in shingles(t.encode(), shingle)], "<u4") for t in b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(x).tobytes() for x in sets], pa.binary())], ["text_hash", "hashes"])

    return texts_for(docs, needed).mapInArrow(hashed, "text_hash long, hashes binary")


def texts_for(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(text_hash, text) of the needed texts, each once; texts that cannot be among them are not sent anywhere."""
    return may_match(docs, F.col("text_hash"), needed).join(needed, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text_hash", "text")


def sample_links(texts: DataFrame, hashes, least: float = 0.8, deviations: float = 3.5, many: int = 1000, keys: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(a, b): all pairs of texts (text_hash, views, sig, size) that share a sample, are not joined by
    roots (node, root) yet, and are `least` alike by 32-bit hashes of their shingles, but for one part in 200.

    hashes(needed) gives (text_hash, hashes) of texts. A pair is compared by them at the least
    anchor that both texts have. Texts of sizes further apart cannot be alike. A signature of n
    places tells the similarity with a deviation of at most sqrt(least (1 - least) / n) for texts
    that are `least` alike; below that by `deviations` of them a pair is left out, which happens to
    one in 4,300 of such texts at 3.5.

    At every anchor, those not joined to its lead meet all its texts; the others do not meet among
    themselves. An anchor with over `many` texts of either kind is dealt out in pairs of blocks.
    """
    keys = sample_keys(texts) if keys is None else keys
    if roots is None:
        roots = texts.select(F.col("text_hash").alias("node"), F.col("text_hash").alias("root"))
    own = keys.join(roots.withColumnRenamed("node", "text_hash"), "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    of_lead = roots.select(F.col("node").alias("lead"), F.col("root").alias("lead_root"))
    own = own.join(of_lead, "lead", "left").withColumn("apart", F.col("root") != F.coalesce("lead_root", "lead"))
    sizes = own.groupBy("anchor").agg(F.count_if("apart").alias("n_apart"), F.count_if(~F.col("apart")).alias("n_joined")).filter("n_apart > 0")
    blocks = lambda c: F.ceil(F.col(c) / many).cast("int")
    met = own.join(sizes, "anchor").withColumn("m", blocks("n_apart")).withColumn("m_joined", blocks("n_joined"))
    met = met.withColumn("own", F.when(F.col("apart"), F.pmod("text_hash", F.col("m"))).otherwise(F.col("m") + F.pmod("text_hash", F.col("m_joined"))).cast("int"))
    # A joined text goes to the blocks of the others only; these go to every block.
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1 + F.when(F.col("apart"), F.col("m_joined")).otherwise(0))))
    dealt = dealt.select("text_hash", "root", "apart", "anchor", F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    dealt = materialize(dealt, "dealt")
    needed = materialize(dealt.select("text_hash").distinct(), "needed")
    all_anchors = keys.groupBy("text_hash").agg(F.collect_list("anchor").alias("anchors"))  # as many as a text has samples
    sigs = may_match(texts.select("text_hash", "sig", "size"), F.col("text_hash"), needed)
    of_text = needed.join(sigs, "text_hash").join(all_anchors, "text_hash").join(hashes(needed), "text_hash")
    rows = dealt.join(of_text, "text_hash").select("key", "text_hash", "root", "apart", "anchor", "anchors", "size", "sig", "hashes")

    def pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
        key, name, root, anchor, size = (part.column(c).to_numpy() for c in ("key", "text_hash", "root", "anchor", "size"))
        apart = part.column("apart").to_numpy().astype(bool)
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(len(key), -1)
        least_same = least - deviations * math.sqrt(least * (1 - least) / sig.shape[1])
        anchors: dict[int, frozenset] = {}
        binary = part.column("hashes")
        hashed = lambda i: np.frombuffer(binary[int(i)].as_py(), "<u4")
        of = lambda i: anchors.get(i) or anchors.setdefault(i, frozenset(part.column("anchors")[int(i)].as_py()))
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        found: list[tuple[int, int]] = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            for x in np.flatnonzero(apart[i:j]) + i:
                rest = i + np.flatnonzero((root[i:j] != root[x]) & (~apart[i:j] | (np.arange(i, j) > x)))
                rest = rest[np.minimum(size[rest], size[x]) >= least * np.maximum(size[rest], size[x]) - 1e-9]
                near = rest[(sig[rest] == sig[x]).mean(1) >= least_same] if len(rest) else rest
                first = hashed(x) if len(near) else None
                for y in near:
                    if min(of(x) & of(y)) == anchor[x]:
                        second = hashed(y)
                        shared = len(np.intersect1d(first, second, assume_unique=True))
                        if shared >= (least - 0.005) * (len(first) + len(second) - shared):
                            found.append((min(name[x], name[y]), max(name[x], name[y])))
        if found:
            both = np.unique(np.array(found, np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            key = held.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield from pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield from pairs(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def alike(candidates: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of text hashes whose texts' sets of shingles have a Jaccard similarity of `least` or more."""
    needed = candidates.select(F.col("a").alias("text_hash")).union(candidates.select("b")).distinct()
    texts = materialize(texts_for(docs, materialize(needed, "needed")), "texts")
    other = candidates.join(texts.select(F.col("text_hash").alias("b"), F.col("text").alias("text_b")), "b")
    both = other.join(texts.select(F.col("text_hash").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first = None, set()
        for batch in batches:
            kept = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != name:  # the join leaves rows of one `a` together
                    name, first = a, set(shingles(text_a.as_py().encode(), shingle))
                second = set(shingles(text_b.as_py().encode(), shingle))
                shared = len(first & second)
                union = len(first) + len(second) - shared
                kept.append(not union or shared / union >= least)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(judge, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 2, least: float = 0.8, samples: int = 12, size: int = 4, places: int = 256) -> DataFrame:
    """Per document: doc_id, text_hash and component_id, over links of texts whose shingles are `least` alike.

    Fingerprints of whole texts a tenth apart in Jaccard similarity differ in six or more bits, out of
    reach of a covering code. Fingerprints of small samples do not: texts 0.8 alike have an equal one
    among 12 samples of four shingles with probability 0.998, and always where both have at most 20
    shingles. Fingerprints only find pairs; every link is by the exact similarity. First each
    anchor's texts are held against its least text; then those still apart against the anchor's
    others, unless their sizes or signatures tell that they are less alike.
    """
    names = ["doc_id", "text_hash", "fp", "views", "sig", "size"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [(t or "").encode() for t in b.column(2).to_pylist()]
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            views, sigs, sizes = zip(*(sampled(t, shingle, samples, size, places, least) for t in texts), strict=True)
            columns = [b.column(0), b.column(1), pa.array(fps), pa.array(views, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names)

    source = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(source.mapInArrow(sketch, "doc_id long, text_hash long, fp long, views array<long>, sig binary, size int"), "sketches")
    source = source.select("text_hash", "text")
    texts = rows.select("text_hash", "fp", "views", "sig", "size").dropDuplicates(["text_hash"])
    nodes = materialize(texts.groupBy("fp").agg(F.min("text_hash").alias("first")), "nodes")
    joined = links(nodes.select("fp"), threshold)
    ends = [nodes.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab"]
    close = joined.join(ends[0], "a").join(ends[1], "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    equal = texts.select("text_hash", "fp").join(nodes, "fp").select(F.col("first").alias("a"), F.col("text_hash").alias("b"))
    keys = materialize(sample_keys(texts, samples), "keys")
    stars_of = keys.select(F.col("lead").alias("a"), F.col("text_hash").alias("b"))
    tried = close.union(equal).union(stars_of).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = materialize(tried, "tried")
    sure = materialize(alike(tried, source, shingle, least), "sure")
    roots = materialize(connected(sure), "roots")
    rest = materialize(sample_links(texts, lambda needed: hashed_shingles(source, needed, shingle), least, keys=keys, roots=roots).join(tried, ["a", "b"], "left_anti"), "rest")
    found = connected(sure.union(alike(rest, source, shingle, least)))
    of_row = rows.select("doc_id", "text_hash").join(found, F.col("text_hash") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))
    of_row = materialize(of_row, "groups")
    groups = of_row.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return joined_to_groups(of_row, groups, "root").select("doc_id", "text_hash", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 2, least: float = 0.8) -> DataFrame:
    """The documents with one of each group kept, that of the smallest id; all columns kept.

    Rows that repeat an id and a text count once. Rows that repeat an id with another text of the
    same group stay together. Rows without an id stay.
    """
    gone = similar_groups(docs, id_col, text_col, shingle, threshold, least).filter("doc_id <> component_id")
    gone = materialize(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash")).distinct(), "gone")
    own = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    ids = gone.select("__gone_id")
    others = may_match(docs, docs[id_col], ids, "left_anti")
    left = may_match(docs, docs[id_col], ids).join(gone, (docs[id_col] == gone["__gone_id"]) & (own == gone["__gone_hash"]), "left_anti").union(others)
    if docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        named = left.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
        left = named.union(left.filter(F.col(id_col).isNull()))
    return left


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
