"""Prefix trie, hard negatives and byte-level BPE against brute force, SQL and the tiktoken library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CONVERSATION = "conv_id long, turn long, role string, text string, depth int, node string, n long"


def rows_of_sql(sql, sf_dir):
    """(columns, rows) of SQL in DuckDB over the tables."""
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return [c[0] for c in got.description], sorted(got.fetchall(), key=str)


def trie_by_hand(rows, rebuild=True):
    """rows: (conv_id, turn, role, text); every node of the trie, by comparing whole prefixes."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((t is not None, t or 0, tie, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    if rebuild:
        built = {}
        for c, own in turns.items():
            h = zlib.crc32(str(c).encode()) % 4
            base = c - (c % 20 if c >= 0 else -(-c % 20))
            built[c] = turns.get(base, [])[:h] + own[h:]
        turns = built
    members = defaultdict(list)
    for c, path in turns.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len([w for w in __import__("re").split("[\x20\x09-\x0d]+", path[-1][1]) if w]) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(turns[c]) == len(path)))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n):
    """Copies, prefixes, turnless, long and odd conversations."""
    rows = []
    for c in range(n):
        kind = rng.random()
        length = rng.randint(1, 7) if kind < 0.9 else 60
        speak = lambda k: "hi there" if kind < 0.6 and k < 3 else rng.choice(["a b", "c  d\te", "", "x"])
        rows += [(c * 3 - 30, k, "user" if k % 2 == 0 else "assistant", speak(k)) for k in range(length)]
    rows += [(9000 + i, k, "user", f"long {k}") for i in range(5) for k in range(80 + (i > 2))]  # copies, and two that go one turn further
    rows += [(8001, 1, "u", "b"), (8001, None, "u", "a"), (8001, 1, "u", "b"), (8001, None, None, None), (None, 1, "u", "x"), (8003, 1, "", "u:a"), (8004, 1, "u", ":a"), (8005, 2, "ü字", "É   x\x0b😀")]
    return rows


@pytest.mark.parametrize("few", [4096, 2])
def test_trie_by_hand(spark, few):
    from cadenza.llm.prefix_trie import conversations_of, ordered_turns, prefix_trie, rebuilt

    rows = conversations(random.Random(3), 120)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONVERSATION).repartition(7)
    turns = ordered_turns(df)
    got = prefix_trie(*rebuilt(turns), few_ends=few)
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_hand(rows)
    plain = prefix_trie(turns, conversations_of(turns), few_ends=few, skip_from=few % 5)
    assert sorted(map(tuple, plain.collect()), key=str) == trie_by_hand(rows, rebuild=False)
    assert prefix_trie(*rebuilt(ordered_turns(df.limit(0)))).count() == 0


def test_trie_one_conversation_over_many_ranges(spark):
    """A third of the rows are one conversation, many are copies of one another, all else is null."""
    from cadenza.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt

    rows = [(7, k, "u", f"t{k} w") for k in range(900)] + [(100 + c, k, "u", "same") for c in range(300) for k in range(3)] + [(5000, None, None, None)] * 20
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONVERSATION).repartition(5)
    turns = ordered_turns(df)
    assert turns.filter("conv_id = 7").agg(F.max("depth"), F.max("upto")).first()[:] == (900, 1800)
    got = prefix_trie(*rebuilt(turns))
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_hand(rows)


def test_trie_sql(spark):
    from cadenza.llm.prefix_trie import OP11_SQL, op11_prefix_trie

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        columns, want = rows_of_sql(OP11_SQL, sf)
        assert sorted(map(tuple, op11_prefix_trie(spark, sf).select(columns).collect()), key=str) == want


def negatives_by_hand(rows, k=5, positives=5, percent=80):
    """rows: (vec_id, vector, label) after the label's change; anchors are ids divisible by 100."""
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int), int(y)) for i, v, y in rows if i is not None and v and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in ok if i % 100 == 0}):
        y, v = min((y, tuple(v)) for i, v, y in ok if i == a)
        scored = [(-int(np.dot(v, w)), i, z) for i, w, z in ok if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            band = sorted(x for x in scored if x[2] != y and percent * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a, p, r, i, -s, -n) for r, (n, i, _) in enumerate(band, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(rng, n, size=24, labels=4):
    """Clusters, copies (also of ids), ties, odd and missing vectors."""
    centres = rng.normal(size=(labels, size))
    rows = []
    for i in range(n):
        y = int(rng.integers(labels))
        rows.append((i, (0.3 * centres[(y + (i % 3 == 0)) % labels] + 0.1 * rng.normal(size=size) * 2.0 ** -np.arange(size)).tolist(), y))
    rows += [(n + i, [0.25] * size, i % 2) for i in range(n // 3)]  # one vector, a quarter of the rows
    rows += [(100, [0.5] * size, 0), (7, [0.25] * size, 1), (None, [0.1] * size, 1), (3001, None, 1), (3002, [None] * size, 1), (3003, [float("nan")] * size, 1), (3004, [float("inf")] * size, 0), (3005, [], 0), (3006, [0.5] * size, None)]
    return rows + [(3100 + i, [0.5, 1.0 * i], i % 2) for i in range(0, 300, 10)] + [(3500, [3.0e4] * size, 1)]


@pytest.mark.parametrize("block_rows,group_blocks", [(16, 1), (2048, 16)])
def test_negatives_by_hand(spark, block_rows, group_blocks):
    from cadenza.llm.hard_negatives import hard_negatives

    rows = vectors(np.random.default_rng(5), 900)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, rank string, size int").repartition(6)
    got = hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), block_rows=block_rows, group_blocks=group_blocks)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == negatives_by_hand(rows)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_negatives_discard_early():
    """Bounds of leading components leave few pairs to be verified, and lose none."""
    from cadenza.llm.hard_negatives import ANY, NONE, Rotated, search
    from cadenza.llm.vector_blocks import Block

    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(3000, 64)) * 1.3 ** -np.arange(64)).astype(np.int64)
    block = lambda at: Block(64, at.tobytes(), (at % 5).tobytes(), v[at].tobytes(), b"")
    anchors, blocks = Rotated(block(np.arange(40)), None), [Rotated(block(np.arange(a, a + 500)), None) for a in range(0, 3000, 500)]
    counts = {}
    got = search(anchors, blocks, np.full((40, 1), NONE), np.full((40, 1), ANY), False, 5, counts)
    for i in range(40):
        want = sorted((-int(v[i] @ v[x]), x) for x in range(3000) if x % 5 != i % 5)[:5]
        assert list(zip(-got.scores[i, 0], got.ids[i, 0], strict=True)) == want
    assert counts["verified"] < 0.05 * counts["all"]


def test_negatives_sql(spark):
    from cadenza.llm.hard_negatives import OP12_SQL, op12_hard_negatives

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        columns, want = rows_of_sql(OP12_SQL, sf)
        assert sorted(map(tuple, op12_hard_negatives(spark, sf).select(columns).collect()), key=str) == want
        assert want


def tiktoken_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    from cadenza.llm.byte_bpe import read_vocabulary

    return read_vocabulary()


def test_perfect_hash(vocabulary):
    """Every token has a slot of its own; strings that are no tokens are found to be none."""
    ranks, _ = tiktoken_encoding()
    tokens = list(ranks)
    assert vocabulary.lookup(tokens).tolist() == list(ranks.values())
    others = [t + b"\x00q" for t in tokens[::7]] + [b"", b"\xff\xfe\xfd", b"no such token at all"]
    assert (vocabulary.lookup([o for o in others if o not in ranks]) == -1).all()
    assert len(vocabulary.ids) == vocabulary.hash.n == len(ranks) and sorted(vocabulary.hash.slot_of(__import__("cadenza.llm.byte_bpe", fromlist=["x"]).key_hashes(tokens)[2])) == list(range(len(ranks)))


ODD_TEXTS = [None, "", " ", "a", "\x00\x00", "don't  stop\n\n\t now's", "a" * 20_000, "ab" * 5_000, " " * 3_000 + "x", "<|endoftext|>", "é字😀‍👩‍👩‍👧 　\xa0x", "१२३ 123,456.78", "\r\n\r\n ", "ﷺ" * 50, "xyz" * 40 + "\n" * 70]


def test_bpe_as_tiktoken(spark, vocabulary):
    from cadenza.llm.byte_bpe import decode, encode, merged

    ranks, enc = tiktoken_encoding()
    rng = random.Random(4)
    texts = ODD_TEXTS + ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(1, 0x2FFF), rng.randint(0x1F300, 0x1F9FF)])) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    rows = [(i, t, "x", b"y") for i, t in enumerate(texts)] + [(1, "again", None, None), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary").repartition(3)
    got = decode(encode(df)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), enc.encode_ordinary(t or "")) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, _, _ in rows)
    assert encode(df.limit(0)).count() == 0
    for _ in range(200):
        piece = bytes(rng.choice(b"aabbcd \xc3\xa9") for _ in range(rng.randint(1, 40)))
        assert merged(piece, *vocabulary.pieces) == enc._core_bpe.encode_single_piece(piece)


def test_bpe_together(vocabulary, monkeypatch):
    """Short pieces of a batch are merged together, none by a heap of its own, to the ids of the heap and of tiktoken; a worker keeps what it knows."""
    from array import array

    from cadenza.llm import byte_bpe

    _, enc = tiktoken_encoding()
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"aabbcdentheris \xc3\xa9\x00\xff") for _ in range(rng.randint(2, byte_bpe.SHORT))) for _ in range(9000)]
    pieces += [bytes([b]) * n for b in b"a \n\x00" for n in range(2, byte_bpe.SHORT + 1)]
    single = np.array(vocabulary.pieces[1], np.int64)
    got = byte_bpe.merged_together(pieces, single, vocabulary.pair_ranks, vocabulary.base)
    assert got == [array("i", byte_bpe.merged(p, *vocabulary.pieces)).tobytes() for p in pieces]
    assert got[:500] == [array("i", enc._core_bpe.encode_single_piece(p)).tobytes() for p in pieces[:500]]
    assert byte_bpe.merged_together([], single, vocabulary.pair_ranks, vocabulary.base) == []

    plain = byte_bpe.Vocabulary({bytes([b]): 255 - b for b in range(256)}, ".+")
    assert byte_bpe.Encoder(plain).encode(["abc", None, "é"]) == [array("i", [255 - b for b in t.encode()]).tobytes() for t in ("abc", "", "é")]

    monkeypatch.setattr(byte_bpe, "merged", lambda *a: pytest.fail("a heap for a short piece"))
    words = " zqxjkv wqzzxk éèqzxñ qqqqzzzz"
    own = byte_bpe.encoder(vocabulary)
    assert [np.frombuffer(x, np.int32).tolist() for x in own.encode([words])] == [enc.encode_ordinary(words)]
    assert byte_bpe.encoder(vocabulary) is own and " zqxjkv" in own.known


def test_bpe_query(spark):
    from cadenza.llm.byte_bpe import op13_byte_bpe

    _, enc = tiktoken_encoding()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, op13_byte_bpe(spark, SF).collect())) == sorted(want)


def test_bpe_refuses(spark, vocabulary):
    from cadenza.llm.byte_bpe import Vocabulary

    with pytest.raises(ValueError):
        vocabulary.decode(np.array([10**6]))
    with pytest.raises(ValueError):
        Vocabulary({b"a": 0}, ".")
