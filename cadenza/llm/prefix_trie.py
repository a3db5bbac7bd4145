"""Prefix trie of conversations, built level by level and rolled up again.

A turn is told by a 128-bit hash of its role and text, so texts are read once and never shuffled.
For each depth the live conversations are grouped by (parent node, next turn); a node's name is the
smallest conv_id among its members, unique at its depth. Conversations of a group that go on
alike to their ends (a group of one, or of copies: their turns have one signature) are no longer live:
what remains of them is a chain whose nodes all have these members, read off the turns of the
smallest one. Beyond the first levels, depths at which no live group branches or ends are taken at
once in the same way, so there are as many rounds as depths of branchings, not as turns of the
longest conversation. Then, from the deepest level up, children are summed and joined to parents.

Every step deals rows out by conversation or node with sums before the exchange; groups of many
conversations are broadcast by name, a conversation of very many turns is numbered across the
ranges of a sorted exchange, and the ids of a node where many conversations end are packed
range by range and hashed as a stream.

Null roles and texts are empty. Rows without a conv_id take no part. Turns are ordered by `turn`, null
first; rows of one turn by the hash of their content, repeated rows are turns of their own. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import discard, joined_to_groups, materialize, shuffle_partitions

TURNS = "part int, conv_id long, depth long, key binary, words long, upto long"
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

#: A word of a turn (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"

#: Up to this many ids of a node are joined in one row; more are hashed as a stream.
FEW_ENDS = 4096

#: Bytes of ids in a row of the stream.
PIECE = 1 << 20


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns and sum up the words of each conversation, as far as it is in this sorted partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, depth, upto = None, 0, 0
    for b in batches:
        if not len(b):
            continue
        ids, words = b.column(0).to_numpy(), b.column(2).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        if ids[0] != last:
            depth = upto = 0
        sums = np.cumsum(words)
        depths = np.arange(1, len(ids) + 1) - first[run] + np.where(run == 0, depth, 0)
        uptos = sums - (sums - words)[first][run] + np.where(run == 0, upto, 0)
        last, depth, upto = ids[-1], int(depths[-1]), int(uptos[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), b.column(0), pa.array(depths), b.column(1), b.column(2), pa.array(uptos)], ["part", "conv_id", "depth", "key", "words", "upto"])


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth from 1, key, words, upto): each conversation's turns in order; upto is its words so far.

    Turns are numbered within the ranges of a sorted exchange. A conversation that goes on in the next
    range is continued there: one offset for each range at most.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    hashed = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn_key(role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.col(turn_col).alias("turn"))
    hashed = materialize(hashed, "turn-keys")
    order = ["conv_id", "turn", "key", "row"]
    turns = materialize(hashed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", "key", "words").mapInArrow(_numbered, TURNS), "turns")
    discard(hashed)
    ranges = turns.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "upto")).alias("end"))
    offsets: list[tuple[int, int, int, int]] = []
    before = (None, 0, 0)
    for r in sorted(ranges.collect()):  # a row for each range
        goes_on = r["first"] == before[0]
        if goes_on:
            offsets.append((r["part"], *before))
        of, depth, upto = r["end"]
        if goes_on and of == r["first"]:
            depth, upto = depth + before[1], upto + before[2]
        before = (of, depth, upto)
    if offsets:
        more = F.broadcast(spark.createDataFrame(offsets, "part int, conv_id long, d long, u long"))
        turns = turns.join(more, ["part", "conv_id"], "left").withColumns({"depth": F.col("depth") + F.coalesce("d", F.lit(0)), "upto": F.col("upto") + F.coalesce("u", F.lit(0))})
    return turns.select("conv_id", "depth", "key", "words", "upto")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_words)."""
    return turns.groupBy("conv_id").agg(F.max("depth").alias("n_turns"), F.max("upto").alias("n_words"))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after each conv_id c begins with the first h turns of c - c % family and goes on with its own after the first h.

    h is crc32 of the decimal c modulo `most`. Only the first most - 1 turns of a conversation are gathered in a row.
    """
    near = F.sort_array(F.collect_list(F.when(F.col("depth") < most, F.struct("depth", "key", "words"))))
    convs = materialize(turns.groupBy("conv_id").agg(F.max("depth").alias("n"), F.max("upto").alias("own"), near.alias("near")), "conversations")
    h = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(most)).cast("int")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, t: s + t["words"])
    heads = convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("near").alias("head"))
    convs = convs.withColumn("h", h(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    given = F.when(F.col("head").isNull(), F.slice("near", 1, 0)).otherwise(F.expr("slice(head, 1, h)"))
    convs = convs.withColumn("head", given).withColumn("own_head", F.expr("slice(near, 1, h)"))
    convs = materialize(
        convs.select(
            "conv_id",
            "head",
            (F.size("head") - F.col("h")).cast("long").alias("shift"),
            (total(F.col("head")) - total(F.col("own_head"))).alias("more"),
            (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n_turns"),
            (F.col("own") + total(F.col("head")) - total(F.col("own_head"))).alias("n_words"),
        ),
        "rebuilt",
    )
    own = turns.filter(F.col("depth") > h(F.col("conv_id"))).join(convs.select("conv_id", "shift", "more"), "conv_id")
    own = own.select("conv_id", (F.col("depth") + F.col("shift")).alias("depth"), "key", "words", (F.col("upto") + F.col("more")).alias("upto"))
    heads = convs.select("conv_id", "head", F.posexplode("head").alias("k", "t")).select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "t.key", "t.words", total(F.slice("head", F.lit(1), F.col("k") + 1)).alias("upto"))
    return own.unionByName(heads), convs.select("conv_id", "n_turns", "n_words")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, depth, first, ids): the ids of each node in this sorted partition as text, PIECE bytes or little more a row."""
    names = ["node", "depth", "first", "ids"]
    at, first, held, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held).encode()], pa.binary())], names)

    for b in batches:
        for node, depth, conv in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if at != (node, depth) or size >= PIECE:
                if held:
                    yield row()
                at, first, held, size = (node, depth), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, depth, sha): of each node's pieces, which come in order."""
    at, h = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([h.hexdigest()])], ["node", "depth", "sha"])

    for b in batches:
        for node, depth, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if at == (node, depth):
                h.update(b",")
            else:
                if at is not None:
                    yield row()
                at, h = (node, depth), hashlib.sha256()
            h.update(ids)
    if at is not None:
        yield row()


def ends_digest(ends: DataFrame, few: int = FEW_ENDS) -> DataFrame:
    """(node, depth, sha): SHA-256 of the decimal conv_ids of each (node, depth), ascending and joined by commas."""
    keys = ["node", "depth"]
    many = ends.groupBy(*keys).count().filter(F.col("count") > few).select(*keys)
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    small = ends.join(many, keys, "left_anti").groupBy(*keys).agg(F.sha2(joined, 256).alias("sha"))
    order = [*keys, "conv_id"]
    n = shuffle_partitions(ends.sparkSession)
    large = materialize(ends.join(many, keys, "left_semi").select(*order), "many-ends")
    packed = large.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_packed, "node long, depth long, first long, ids binary")
    return small.unionByName(packed.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(_digests, "node long, depth long, sha string"))


def _branching(turns: DataFrame, live: DataFrame, depth: int) -> int:
    """The largest depth to which all live conversations of each node go on alike."""
    rest = turns.filter(F.col("depth") > depth).join(live.select("conv_id", "node"), "conv_id")
    rest = rest.groupBy("node", "depth").agg(F.count("*").alias("n"), (F.min("key") == F.max("key")).alias("alike"))
    whole = live.groupBy("node").agg(F.count("*").alias("all"))
    first = rest.join(whole, "node").filter(~F.col("alike") | (F.col("n") < F.col("all"))).agg(F.min("depth")).first()[0]
    return depth if first is None else first - 1


def prefix_trie(turns: DataFrame, convs: DataFrame, few_ends: int = FEW_ENDS, skip_from: int = 6) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, depth from 1, key, words, upto); convs: (conv_id, n_turns, n_words), also those without turns.
    skip_from: the depth from which it is looked how far live groups go on without branching.
    """
    spark = turns.sparkSession
    # In order of depth, so that a round reads the part of the files that holds its own.
    turns = materialize(turns.repartitionByRange(shuffle_partitions(spark), "depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "turns-by-depth")
    signed = turns.groupBy("conv_id").agg(*(F.bit_xor(F.xxhash64(F.lit(s), F.col("depth"), F.col("key"))).alias(f"sign{s}") for s in (1, 2)))
    live = materialize(convs.join(signed, "conv_id", "left").fillna(0, ["sign1", "sign2"]), "live")
    top = live.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    live = live.withColumn("node", F.lit(top["conv_id"]).cast("long"))

    steps: list[tuple[int, int, DataFrame]] = []  # (depth above, depth, groups at that depth, or the live nodes between the two)
    ends: list[DataFrame] = []
    rounds: list[DataFrame] = []
    depth = 0
    while True:
        if depth >= skip_from and (to := _branching(turns, live, depth)) > depth:
            steps.append((depth, to, materialize(live.groupBy("node").agg(F.count("*").alias("n")), f"run-{depth}")))
            depth = to
        here = turns.filter(F.col("depth") == depth + 1).select("conv_id", "key", "words", "upto")
        rows = materialize(live.join(here, "conv_id", "left"), f"level-{depth}")
        ends.append(rows.filter(F.col("key").isNull()).select("node", F.lit(depth).cast("long").alias("depth"), "conv_id"))
        level = rows.filter(F.col("key").isNotNull())
        alike = reduce(Column.__and__, (F.min(c) == F.max(c) for c in ("sign1", "sign2", "n_turns")))
        groups = materialize(
            level.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.max("words").alias("words"), alike.alias("chain"), F.max("n_turns").alias("last"), F.max(F.col("n_words") - F.col("upto")).alias("tail")),
            f"groups-{depth}",
        )
        depth += 1
        steps.append((depth - 1, depth, groups))
        slot = F.struct("node", "key").alias("slot")
        shared = groups.filter(F.col("n") > 1).select(slot, "n", "child", "chain")
        members = joined_to_groups(level.select("conv_id", "n_turns", "n_words", "sign1", "sign2", slot), shared, "slot")
        members = materialize(members.select("conv_id", F.col("child").alias("node"), "chain", "n_turns", "n_words", "sign1", "sign2"), f"members-{depth}")
        ends.append(members.filter("chain").select("node", F.col("n_turns").alias("depth"), "conv_id"))
        rounds += [rows, members]
        live = members.filter(~F.col("chain")).drop("chain")
        if live.isEmpty():
            break
    ended = materialize(reduce(DataFrame.unionByName, ends), "ends")
    for table in rounds:
        discard(table)

    long = lambda x: F.lit(x).cast("long")
    kids: DataFrame | None = None
    made: list[DataFrame] = []
    for above, depth, groups in reversed(steps):
        if "child" in groups.columns:
            groups = groups.withColumn("own", (F.col("n") - 1) * F.col("words"))
            nodes = groups.filter("chain").select(F.col("child").alias("conv_id"), long(depth).alias("depth"), F.col("node").alias("parent_conv_id"), "n", (F.col("last") > depth).cast("long").alias("n_children"), long(1).alias("n_leaves"), (F.col("own") + (F.col("n") - 1) * F.col("tail")).alias("saved_tokens"), "chain", "last")
            if kids is not None:
                inner = groups.filter(~F.col("chain")).join(kids, F.col("child") == F.col("of"))
                inner = inner.select(F.col("child").alias("conv_id"), long(depth).alias("depth"), F.col("node").alias("parent_conv_id"), "n", "n_children", "n_leaves", (F.col("own") + F.col("saved")).alias("saved_tokens"), "chain", "last")
                nodes = nodes.unionByName(inner)
        else:
            run = turns.filter(F.col("depth").between(above + 1, depth)).join(groups.join(kids, F.col("node") == F.col("of")), F.col("conv_id") == F.col("node"))
            foot = turns.filter(F.col("depth") == depth).select(F.col("conv_id").alias("of"), F.col("upto").alias("foot"))
            run = run.join(foot, "of")
            saved = F.col("saved") + (F.col("n") - 1) * (F.col("foot") - F.col("upto") + F.col("words"))
            nodes = run.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n", F.when(F.col("depth") == depth, F.col("n_children")).otherwise(long(1)).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.lit(False).alias("chain"), long(None).alias("last"))
        nodes = materialize(nodes, f"nodes-{depth}")
        made.append(nodes)
        tops = nodes.filter(F.col("depth") == above + 1)
        kids = tops.groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))

    zero, one = long(0), long(1)
    sums = kids.agg(F.coalesce(F.sum("n_children"), zero).alias("n_children"), F.coalesce(F.sum("n_leaves"), one).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    root = sums.select(long(top["conv_id"]).alias("conv_id"), zero.alias("depth"), long(None).alias("parent_conv_id"), long(top["n"]).alias("n"), "n_children", "n_leaves", "saved_tokens", F.lit(False).alias("ends_alone"))
    tops = reduce(DataFrame.unionByName, made)
    chains = tops.filter(F.col("chain") & (F.col("last") > F.col("depth"))).select("conv_id", F.col("depth").alias("above"), "n", "last")
    below = turns.join(chains, "conv_id").filter(F.col("depth") > F.col("above"))
    # Of a chain, upto and tail only differ by what stands above: words from here to the end.
    end = convs.select("conv_id", "n_words")
    below = below.join(end.join(chains.filter(F.col("n") > 1).select("conv_id"), "conv_id", "left_semi"), "conv_id", "left")
    left = F.when(F.col("n") > 1, (F.col("n") - 1) * (F.col("n_words") - F.col("upto") + F.col("words"))).otherwise(zero)
    below = below.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n", (F.col("depth") < F.col("last")).cast("long").alias("n_children"), one.alias("n_leaves"), left.alias("saved_tokens"), ((F.col("n") == 1) & (F.col("depth") == F.col("last"))).alias("ends_alone"))
    tops = tops.withColumn("ends_alone", F.col("chain") & (F.col("n") == 1) & (F.col("depth") == F.col("last"))).drop("chain", "last")
    nodes = tops.unionByName(below).unionByName(root)

    none = F.lit(hashlib.sha256(b"").hexdigest())
    # A node of one conversation needs no list; of the others, those where some conversation ends do.
    single = nodes.filter((F.col("n") == 1) & (F.col("depth") > 0)).withColumn("sha", F.when(F.col("ends_alone"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none))
    digests = ends_digest(ended, few_ends).withColumnRenamed("node", "conv_id")
    several = nodes.filter((F.col("n") > 1) | (F.col("depth") == 0)).join(digests, ["conv_id", "depth"], "left").withColumn("sha", F.coalesce("sha", none))
    return single.unionByName(several).withColumnsRenamed({"n": "n_convs", "sha": "ends_sha256"}).select(*NODES)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    turns, convs = rebuilt(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(turns, convs)


OP11_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: i::BIGINT)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384::BIGINT))) AS crc
  FROM (SELECT DISTINCT conv_id FROM c)),
h AS (SELECT conv_id, base, xor(crc, 4294967295::BIGINT) % 4 AS h FROM ids),
r AS (
  SELECT h.conv_id, 0 AS part, c.pos, c.role, c.text FROM h JOIN c ON c.conv_id = h.base AND c.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, c.pos, c.role, c.text FROM h JOIN c ON c.conv_id = h.conv_id AND c.pos > h.h),
l AS (
  SELECT h.conv_id, coalesce(x.turns, []) AS turns, x.words FROM h LEFT JOIN (
    SELECT conv_id, list(strlen(role)::VARCHAR || ':' || role || text ORDER BY part, pos) AS turns, list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY part, pos) AS words
    FROM r GROUP BY conv_id) x ON x.conv_id = h.conv_id),
p AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends, words[d] AS words FROM (SELECT conv_id, turns, words, unnest(range(len(turns) + 1)) AS d FROM l)),
n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * max(words) END AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY path, d),
k AS (SELECT a.path, count(b.path) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.path[1:a.d] = a.path GROUP BY a.path)
SELECT n.conv_id, n.d AS depth, parent.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN k ON k.path = n.path LEFT JOIN n parent ON n.d > 0 AND parent.path = n.path[1:n.d - 1] AND parent.d = n.d - 1
JOIN (
  SELECT a.path, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens
  FROM n a JOIN n b ON b.path[1:a.d] = a.path JOIN k ON k.path = b.path GROUP BY a.path) s ON s.path = n.path
"""
