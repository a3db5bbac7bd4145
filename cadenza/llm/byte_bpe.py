"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

A text is cut into pre-tokens by the vocabulary's pattern. Each batch's different pre-tokens are looked up all
at once in a minimal perfect hash of the vocabulary: a displacement for the key's bucket gives the only
slot that it can be in, and the slot's bytes are compared. In those that are no token themselves the pair of the least rank, leftmost first, is
joined over linked bytes until none is left: in all short ones of a batch at once, a pair each a round, in a long one
by a heap of (rank, place). Ids are ranks. Decoding puts the tokens' bytes one after the other.

The vocabulary is read on the driver and broadcast; its size is that of the file. A worker keeps the ids of at most
`keep` merged pre-tokens. A null text is empty and has no ids; null ids decode to no bytes. Rows that repeat an id are
encoded each. Special tokens are ordinary text. An empty table gives no rows. An id that is not in the vocabulary, or
a vocabulary without all single bytes, is an error.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import WORKER_CACHES, ByteHashes, bounded_batches, joined, mix64, slices, texts_of

#: Bytes of text, and number of ids, that are worked on at once.
TEXT_BYTES, IDS = 1 << 22, 1 << 20

#: Bytes of a pre-token that is merged together with others, and how many of these at once.
SHORT, LANES = 32, 8192

#: Keys of a bucket on the average, and displacements that are tried at once.
BUCKET, TRIES = 4, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys as one byte array, their bounds in it, and a 64-bit hash of each."""
    data, bounds = joined(keys)
    return data, bounds, ByteHashes(data).between(bounds[:-1], bounds[1:])


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (mix64(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """n different keys to n slots: `slot_of` a known key's hash is its own, any other's is anyone's.

    Buckets are placed from the largest down, each under the first displacement that puts its keys on free slots;
    a bucket of one key names its slot directly (as a negative number).
    """

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys have one hash")
        self.n, self.buckets = n, max(1, n // BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(cuts)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = hashes[order[cuts[b] : cuts[b + 1]]]
            first = 0
            while True:
                at = np.sort(_slots(own[None, :], np.arange(first, first + TRIES)[:, None], n), 1)
                good = np.flatnonzero(free[at].all(1) & (at[:, 1:] != at[:, :-1]).all(1))
                if len(good):
                    break
                first += TRIES
            self.shift[b] = first + good[0]
            free[at[good[0]]] = False
        alone = np.flatnonzero(sizes == 1)
        self.shift[alone] = -1 - np.flatnonzero(free)[: len(alone)]

    def slot_of(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, _slots(hashes, np.maximum(shift, 0), self.n))


def merged(piece: bytes, rank: Callable[[bytes], int | None], single: list[int], pairs: list[int]) -> list[int]:
    """Ids of a pre-token: the adjacent parts whose bytes together have the least rank are joined until none have one.

    single and pairs give the ranks of one byte and of two (b0 * 256 + b1; -1 for none). A heap entry is one number
    of rank, start and end; it counts if the part that starts there and the next one still end there.
    """
    n = len(piece)
    bits = n.bit_length()
    low = (1 << bits) - 1
    ids = [single[b] for b in piece]  # of the part that starts here
    end = list(range(1, n + 2))  # where that part ends; -1 where none starts, and nothing ends where the last entry says
    before = list(range(-1, n))  # where the part that ends here starts
    heap = [((r << bits | i) << bits) | i + 2 for i, (x, y) in enumerate(pairwise(piece)) if (r := pairs[x << 8 | y]) >= 0]
    heapify(heap)
    while heap:
        code = heappop(heap)
        e = code & low
        code >>= bits
        i = code & low
        m = end[i]
        if end[m] != e:
            continue
        ids[i], end[i], end[m], before[e] = code >> bits, e, -1, i
        if i and (r := rank(piece[(p := before[i]) : e])) is not None:
            heappush(heap, ((r << bits | p) << bits) | e)
        if e < n and (r := rank(piece[i : (f := end[e])])) is not None:
            heappush(heap, ((r << bits | i) << bits) | f)
    return [x for x, e in zip(ids, end, strict=False) if e > 0]


def merged_together(pieces: list[bytes], single: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], base: int) -> list[bytes]:
    """What `merged` gives for each of many pieces of 2 to SHORT bytes, as 32-bit numbers.

    A column is a piece and a row a place in it. A round takes every piece's least code of rank and place and joins the
    part there with the next; finished pieces leave when they are half of what is left.
    """
    out: list[bytes] = [b""] * len(pieces)
    size = np.array(list(map(len, pieces)), np.int64)
    order = np.argsort(size, kind="stable")
    for a in range(0, len(pieces), LANES):
        at = order[a : a + LANES]
        _merge_lanes([pieces[i] for i in at.tolist()], size[at], at, single, pairs, base, out)
    return out


def _merge_lanes(pieces: list[bytes], size: np.ndarray, at: np.ndarray, single: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], base: int, out: list[bytes]) -> None:
    keys, ranks = pairs
    none = np.int64(1) << 62
    rows = int(size[-1])
    bits = rows.bit_length()

    def codes(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of the pair of two parts; `none` where it has no rank or a part is missing (negative)."""
        key = left * base + right
        found = np.searchsorted(keys, key)
        return np.where((keys[found] == key) & (left >= 0) & (right >= 0), ranks[found] << bits | place, none)

    data = np.frombuffer(b"".join(p.ljust(rows, b"\0") for p in pieces), np.uint8).reshape(len(pieces), rows).T
    place = np.arange(rows + 1)[:, None]
    # A last row stands for what follows the end; links of the first place lead there too.
    ids = np.full((rows + 1, len(pieces)), -1, np.int64)
    ids[:rows] = np.where(place[:rows] < size, single[data], -1)
    code = np.full(ids.shape, none)
    code[:-1] = codes(ids[:-1].ravel(), ids[1:].ravel(), np.repeat(place[:-1].ravel(), len(pieces))).reshape(rows, -1)
    after = np.minimum(np.broadcast_to(place + 1, ids.shape), rows).copy()
    before = np.broadcast_to(np.where(place > 0, place - 1, rows), ids.shape).copy()
    while True:
        least = code.min(0)
        live = np.flatnonzero(least < none)
        if 2 * len(live) <= len(at):
            done = np.flatnonzero(least == none)
            kept = ids[:, done].T
            flat = kept[kept >= 0].astype(np.int32).tobytes()
            ends = (4 * np.cumsum((kept >= 0).sum(1))).tolist()
            for i, x, y in zip(at[done].tolist(), [0, *ends], ends, strict=False):
                out[i] = flat[x:y]
            if not len(live):
                return
            at, least = at[live], least[live]
            ids, code, after, before = ids[:, live], code[:, live], after[:, live], before[:, live]
            live = np.arange(len(live))
        else:
            least = least[live]
        here, rank = least & ((1 << bits) - 1), least >> bits
        gone = after[here, live]
        far, near = after[gone, live], before[here, live]
        ids[here, live] = rank
        ids[gone, live] = -1
        code[gone, live] = none
        after[here, live] = far
        before[far, live] = here
        code[here, live] = codes(rank, ids[far, live], here)
        code[near, live] = codes(ids[near, live], rank, near)


class Vocabulary:
    """Tokens and ids, with the perfect hash of the tokens. Slots hold the tokens in the order of the hash."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.pattern = pattern
        tokens = list(ranks)
        _, _, hashes = key_hashes(tokens)
        self.hash = PerfectHash(hashes)
        at = np.argsort(self.hash.slot_of(hashes))
        self.data, self.bounds = joined([tokens[i] for i in at])
        self.ids = np.array([ranks[tokens[i]] for i in at], np.int32)
        self.base = int(self.ids.max()) + 1

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        data = self.data.tobytes()
        return {data[a:b]: i for (a, b), i in zip(pairwise(self.bounds.tolist()), self.ids.tolist(), strict=True)}

    @cached_property
    def pieces(self) -> tuple[Callable[[bytes], int | None], list[int], list[int]]:
        """Ranks by bytes, of one byte, and of two (-1 for none)."""
        known = self.ranks
        return known.get, [known[bytes([b])] for b in range(256)], [known.get(bytes([x, y]), -1) for x in range(256) for y in range(256)]

    @cached_property
    def pair_ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Every two tokens that are one together: left id * base + right id in ascending order, and the rank of both; a key of none is last."""
        known = self.ranks
        get = known.get
        found = [(x, y, r) for t, r in known.items() for i in range(1, len(t)) if (x := get(t[:i])) is not None and (y := get(t[i:])) is not None]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        keys = left * self.base + right
        order = np.argsort(keys)
        return np.append(keys[order], np.iinfo(np.int64).max), np.append(rank[order], 0)

    @cached_property
    def slot_of_id(self) -> np.ndarray:
        out = np.full(int(self.ids.max()) + 1, -1, np.int64)
        out[self.ids] = np.arange(len(self.ids))
        return out

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The id of each key, -1 where it is no token."""
        data, bounds, hashes = key_hashes(keys)
        slot, size = self.hash.slot_of(hashes), np.diff(bounds)
        start = self.bounds[slot]
        like = np.flatnonzero((self.bounds[slot + 1] - start == size) & (size > 0))
        n = size[like]
        cuts = np.concatenate([[0], np.cumsum(n)])
        within = np.arange(cuts[-1]) - np.repeat(cuts[:-1], n)
        same = data[np.repeat(bounds[like], n) + within] == self.data[np.repeat(start[like], n) + within]
        out = np.full(len(keys), -1, np.int64)
        if len(like):
            hit = like[np.logical_and.reduceat(same, cuts[:-1])]
            out[hit] = self.ids[slot[hit]]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' bytes one after the other, and the number of bytes of each."""
        known = (ids >= 0) & (ids < len(self.slot_of_id))
        slot = self.slot_of_id[np.where(known, ids, 0)]
        if not known.all() or (slot < 0).any():
            raise ValueError("an id is not in the vocabulary")
        start, size = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        ends = np.cumsum(size)
        return self.data[np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))], size


def read_vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """A rank file (base64 of a token's bytes, and its rank, in each line) with the pattern that cuts text into pre-tokens."""
    with open(path or default_path(), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    return Vocabulary(ranks, pattern or default_pattern())


class Encoder:
    """Encodes texts in batches; up to `keep` merged pre-tokens (the last batch's aside) stay known between them, those of late longest."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 300_000):
        import regex

        self.vocabulary, self.keep = vocabulary, keep
        self.find = regex.compile(vocabulary.pattern).findall
        self.merge = vocabulary.pieces
        self.together = np.array(vocabulary.pieces[1], np.int64), vocabulary.pair_ranks, vocabulary.base
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit numbers."""
        words = [self.find(t) if t else [] for t in texts]
        different = list(set().union(*words))
        keys = [w.encode() for w in different]
        hits = self.vocabulary.lookup(keys)
        flat = hits.astype(np.int32).tobytes()
        ids = {different[k]: flat[4 * k : 4 * k + 4] for k in np.flatnonzero(hits >= 0).tolist()}
        known, older = self.known, self.older
        short: list[int] = []
        for k in np.flatnonzero(hits < 0).tolist():
            w = different[k]
            if (got := known.get(w)) is not None:
                ids[w] = got
            elif (got := older.get(w)) is not None:
                ids[w] = known[w] = got
            elif 2 <= len(keys[k]) <= SHORT:
                short.append(k)
            else:
                ids[w] = got = array("i", merged(keys[k], *self.merge)).tobytes()
                if len(w) < 100:
                    known[w] = got
        new = dict(zip([different[k] for k in short], merged_together([keys[k] for k in short], *self.together), strict=True))
        ids.update(new)
        known.update(new)
        if len(known) > self.keep // 2:
            self.known, self.older = {}, known
        return [b"".join(map(ids.__getitem__, w)) for w in words]


#: The encoder that this worker used last.
_LAST: list[Encoder] = []
WORKER_CACHES.append(_LAST.clear)


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for each Python worker: what it knows stays from task to task while the vocabulary is the same object, as a broadcast one is."""
    if not _LAST or _LAST[0].vocabulary is not vocabulary:
        _LAST[:] = [Encoder(vocabulary)]
    return _LAST[0]


def _lists(blobs: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text, by a vocabulary that has been read or that of the path."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary(path, pattern))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for b in batches:
            for i, j in slices(pc.binary_length(b.column(1)).fill_null(0).to_pylist(), TEXT_BYTES):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(own.encode(part.column(1).to_pylist()))], ["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The rows with `decoded`, the bytes that their ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary(path, pattern))
    rest = [c for c in encoded.columns if c != "decoded"]
    frame = encoded.select(*rest)
    at = rest.index(ids_col)
    schema = frame.withColumn("decoded", F.lit(b""))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for b in batches:
            sizes = b.column(at).value_lengths().fill_null(0).to_pylist()
            for i, j in slices(sizes, IDS):
                part = b.slice(i, j - i)
                ids = part.column(at).flatten().to_numpy()
                data, size = vocabulary.decode(ids)
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes[i:j])]).astype(int)]
                decoded = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*rest, "decoded"])

    return frame.mapInArrow(run, fields)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    bounded_batches(spark)
    vocabulary = read_vocabulary()
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary=vocabulary), vocabulary=vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
