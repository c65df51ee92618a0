"""A trie of conversations: which of them begin alike, and what is saved by keeping each common beginning once.

A node is a distinct sequence of first d turns (role, text); its name is (smallest member, d). Construction is by level:
live conversations are grouped by (node above, next turn), each group's smallest conv_id is the new node, and those whose
node has one member leave the live ones, since the rest of their turns is a chain that needs no grouping. The levels end
with the longest beginning that two conversations share. Then joins from the lowest level upwards sum leaves and savings.

Skew: texts become digests (SHA-256 over length-marked role and text) in the first pass and move no more. Turns are
numbered over ranges of (conv_id, turn), so a conversation of any length is many ranges. Groups are counted with partial
aggregation; members of the largest groups learn their node from a broadcast of at most HOT_SHARE rows, others by a merge
join. Ids of conversations that end at one node are joined into blocks by the tasks of a range sort; only blocks meet to be
hashed, in order. Every level is a written table, so a lost executor repeats one level.

Cases: rows without conv_id belong to no conversation and are left out; null role or text is empty; a null turn comes
first; rows of one conversation and turn go by role and text (their first 64 characters, then the digest), repeated rows
count each; an empty table gives no rows; remainders are those of SQL (toward zero) for negative ids; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlark.llm.common import bounded_batches, join_groups, written

#: Bytes of ids that are joined before they go to the task that hashes a node's block after block.
BLOCK = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


def digested(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, head, key, bytes): what stands for a turn from here on."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return convs.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.concat(role, F.lit("\0"), text), 1, 64).alias("head"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """(part, conv_id, n, key, bytes): n counts a conversation's turns inside one range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            begins = np.r_[True, ids[1:] != ids[:-1]]
            at = np.flatnonzero(begins)
            n = np.arange(len(ids)) - at[np.cumsum(begins) - 1] + 1
            if ids[0] == last:
                n[: at[1] if len(at) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(n[-1])
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(np.full(len(ids), part), pa.int32()), "conv_id": batch.column("conv_id"), "n": pa.array(n, pa.int64()), "key": batch.column("key"), "bytes": batch.column("bytes")}
            )

    bounded_batches(turns.sparkSession)
    order = ["conv_id", "turn", "head"]
    return turns.repartitionByRange(*order).sortWithinPartitions(*order, "key").mapInArrow(count, "part int, conv_id long, n long, key binary, bytes long")


@dataclass
class Turns:
    """``rows``: (conv_id, pos, key, bytes), pos from 1. ``convs``: (conv_id, len), turnless ones too."""

    rows: DataFrame
    convs: DataFrame


def in_order(convs: DataFrame) -> Turns:
    """Each conversation's turns, numbered from 1 over all ranges that hold some of them."""
    ranges = written(numbered(digested(convs)), "turn_ranges")
    parts = ranges.groupBy("conv_id", "part").agg(F.max("n").alias("n"))
    sums = written(parts.groupBy("conv_id").agg(F.sum("n").alias("len"), F.collect_list(F.struct("part", "n")).alias("parts")), "turn_counts")
    earlier = F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("part")), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    rows = ranges.join(sums.select("conv_id", "parts").hint("merge"), "conv_id").select("conv_id", (F.col("n") + earlier).alias("pos"), "key", "bytes")
    return Turns(written(rows, "turns"), sums.select("conv_id", "len"))


def rebuilt(turns: Turns, of: int = 5, most: int = 9) -> Turns:
    """Conversation c with its first h turns replaced by the first h of conversation c - c % of; h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    own = turns.convs.select("conv_id", "len", h, (F.col("conv_id") - F.col("conv_id") % of).alias("from_id"))
    lens = turns.convs.select(F.col("conv_id").alias("from_id"), F.col("len").alias("from_len"))
    taken = F.least("h", F.coalesce("from_len", F.lit(0)))
    both = own.join(lens, "from_id", "left").select("conv_id", "from_id", "h", taken.alias("taken"), (taken + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"))
    convs = written(both, "rebuilt_convs")
    first = turns.rows.filter((F.col("conv_id") % of == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "from_id")
    heads = first.join(convs.select("conv_id", "from_id", "h"), "from_id").filter("pos <= h").select("conv_id", "pos", "key", "bytes")
    tails = turns.rows.join(convs.select("conv_id", "h", "taken").hint("merge"), "conv_id").filter("pos > h")
    rows = heads.unionByName(tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "bytes"))
    return Turns(written(rows.sortWithinPartitions("pos"), "rebuilt_turns"), convs.select("conv_id", "len"))


@dataclass
class Trie:
    """``shared``: per depth, nodes of two or more members, and the root: (conv_id, parent_conv_id, n_convs, bytes).
    ``lone``: (conv_id, depth, parent_conv_id), the top of each chain of one member.
    ``ends``: (node, depth, conv_id), members of shared nodes that end there."""

    shared: list[DataFrame]
    lone: list[DataFrame]
    ends: list[DataFrame]


def build(turns: Turns) -> Trie | None:
    """The levels from the root downwards; None without conversations."""
    top = turns.convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = top.first()
    if not root.n_convs:
        return None
    none = F.lit(None).cast("long").alias("parent_conv_id")
    trie = Trie([top.select("conv_id", none, "n_convs", F.lit(0).cast("long").alias("bytes"))], [], [])
    node = F.lit(root.conv_id).cast("long").alias("node")
    trie.ends.append(turns.convs.filter("len = 0").select(node, F.lit(0).alias("depth"), "conv_id"))
    live, depth = turns.convs.filter("len > 0").select("conv_id", node, "len"), 1
    while True:
        step = written(live.join(turns.rows.filter(F.col("pos") == depth).drop("pos"), "conv_id"), "trie_step")
        groups = written(step.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n_convs"), F.max("bytes").alias("size")), "trie_groups")
        if not groups.take(1):
            return trie
        shared = groups.filter("n_convs > 1")
        placed = written(join_groups(step, shared, ["node", "key"], "n_convs").select("conv_id", F.col("child").alias("node"), "len"), "trie_members")
        trie.shared.append(shared.select(F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", F.col("size").alias("bytes")))
        trie.lone.append(groups.filter("n_convs = 1").select(F.col("child").alias("conv_id"), F.lit(depth).alias("depth"), F.col("node").alias("parent_conv_id")))
        trie.ends.append(placed.filter(F.col("len") == depth).select("node", F.lit(depth).alias("depth"), "conv_id"))
        live = placed.filter(F.col("len") > depth).select("conv_id", "node", "len")
        depth += 1


def rolled_up(trie: Trie) -> list[DataFrame]:
    """The shared nodes of each depth with (depth, n_children, n_leaves, saved_tokens), from the lowest level upwards."""
    out: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in reversed(range(len(trie.shared))):
        nodes, own = trie.shared[depth], (F.col("n_convs") - 1) * F.col("bytes")
        if depth < len(trie.lone):
            alone = trie.lone[depth].select("parent_conv_id", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
            children = below.select("parent_conv_id", "n_leaves", "saved_tokens").unionByName(alone)
            sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            nodes = nodes.join(sums, "conv_id", "left")
        else:
            nodes = nodes.withColumns({c: F.lit(None).cast("long") for c in ("n", "leaves", "saved")})
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        sums_up = {"n_children": F.coalesce("n", zero), "n_leaves": F.coalesce("leaves", one), "saved_tokens": own + F.coalesce("saved", zero)}
        below = written(nodes.select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", *[v.alias(k) for k, v in sums_up.items()]), "trie_level")
        out.append(below)
    return out


def joined(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the ids in numeric order, joined by commas: blocks first, then a hash over blocks."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, ids, size = None, None, [], 0

        def block() -> pa.RecordBatch:
            data = ",".join(ids).encode()
            return pa.RecordBatch.from_pydict({"node": pa.array([at[0]], pa.int64()), "depth": pa.array([at[1]], pa.int32()), "first": pa.array([first], pa.int64()), "ids": pa.array([data], pa.binary())})

        for batch in batches:
            for node, depth, c in zip(*(batch.column(k).to_pylist() for k in ("node", "depth", "conv_id")), strict=True):
                if ids and (at != (node, depth) or size >= BLOCK):
                    yield block()
                    ids, size = [], 0
                if not ids:
                    at, first = (node, depth), c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield block()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, out = None, None, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": pa.array([r[0] for r in out], pa.int64()), "depth": pa.array([r[1] for r in out], pa.int32()), "ends_sha256": pa.array([r[2] for r in out], pa.string())})

        for batch in batches:
            for node, depth, data in zip(*(batch.column(k).to_pylist() for k in ("node", "depth", "ids")), strict=True):
                if at == (node, depth):
                    now.update(b",")
                else:
                    if at:
                        out.append((*at, now.hexdigest()))
                    at, now = (node, depth), hashlib.sha256()
                now.update(data)
            if len(out) >= 1000:
                yield batch_of()
                out.clear()
        if at:
            out.append((*at, now.hexdigest()))
        yield batch_of()

    bounded_batches(ends.sparkSession)
    order = ["node", "depth", "conv_id"]
    found = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "node long, depth int, first long, ids binary")
    return found.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(hashes, "node long, depth int, ends_sha256 string")


def sha_of(c: Column) -> Column:
    return F.sha2(c.cast("string").cast("binary"), 256)


def nodes(turns: Turns) -> DataFrame | None:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    trie = build(turns)
    if trie is None:
        return None
    hashes = end_hashes(joined(trie.ends)).select(F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "ends_sha256")
    shared = joined(rolled_up(trie)).join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    if not trie.lone:
        return shared
    tops = joined(trie.lone).select("conv_id", F.col("depth").alias("top"), "parent_conv_id").join(turns.convs, "conv_id")
    chain = turns.rows.select("conv_id", "pos").join(tops.hint("merge"), "conv_id").filter("pos >= top")
    ends = F.col("pos") == F.col("len")
    lone = chain.select(
        "conv_id",
        F.col("pos").cast("long").alias("depth"),
        F.when(F.col("pos") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(ends, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(ends, sha_of(F.col("conv_id"))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    return shared.select(*lone.columns).unionByName(lone)


SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def op13_trie(spark: SparkSession, convs: DataFrame) -> DataFrame:
    found = nodes(rebuilt(in_order(convs)))
    return spark.createDataFrame([], SCHEMA) if found is None else found
