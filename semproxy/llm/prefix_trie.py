"""Prefix trie of conversations, built as a burst trie over suffix containers.

Equal sequences of turns become one weighted sequence first, so a group of copies is one string.
Containers hold the suffixes under one trie head, at first those with one first turn. A container with
too many turns and more than one sequence bursts: the levels all its sequences share become a chain of
nodes at once, and its suffixes go to new containers by the id of their next turn. Containers with one
sequence, however long, are chains and never leave the tables; the others are small, are dealt among
the shards by their head, and are sorted and swept into nodes there. Sums of the nodes above the
containers are added up burst by burst, the last one first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semproxy.llm.common import written
from semproxy.operators.prefix import running_totals

ROOT = ""
NOTHING = hashlib.sha256(b"").hexdigest()

# Turns per digest of a sequence, and per sum of a chain; bytes of ids per piece of a hash.
RUN, PIECE = 4096, 1 << 16

NODE = (
    "up string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends long"
)


@dataclass(frozen=True)
class Bursting:
    """Turns up to which a container is not burst but swept in a task."""

    container: int = 512


def turns_of(conversations: DataFrame) -> DataFrame:
    """Narrow rows ``(c, pos, len, tid, bytes)``: the place of every turn, from 0, the length of its
    conversation, and a 128-bit id of role and text. No text goes further.

    Places are running counts over ranges of (conversation, turn), so that a conversation with most
    of the rows is numbered by many tasks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("tid"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).alias("one"),
    )
    order = [F.col(name).asc() for name in ("known", "turn", "tid")]
    numbered = running_totals(rows, order, ["one"], ["c"], keep=["tid", "bytes"])
    return numbered.select("c", (F.col("run_one") - 1).alias("pos"), F.col("total_one").alias("len"), "tid", "bytes")


def shared_starts(turns: DataFrame, convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``(c, depth, tid, bytes)`` where conversation c starts with the first h turns of conversation
    c - c % group instead of its own first h, h being the CRC of its decimal id modulo ``most``."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).alias("h")
    base = F.col("c") % group == 0
    bases = turns.where(base & (F.col("pos") < most - 1)).withColumnRenamed("c", "b")
    borrowers = convs.where(~base).select("c", (F.col("c") - F.col("c") % group).alias("b"), h)
    lent = borrowers.join(bases, "b").where("pos < h").select("c", (F.col("pos") + 1).alias("depth"), "tid", "bytes")
    # Where the base is shorter than h, or absent, own turns move up.
    lengths = convs.where(base).select(F.col("c").alias("b"), F.col("len").alias("of_base"))
    moved = (
        borrowers.join(lengths, "b", "left")
        .select("c", F.greatest(F.lit(0), F.col("h") - F.coalesce("of_base", F.lit(0))).alias("up_by"))
        .where("up_by > 0")
    )
    own = turns.withColumn("h", h).where(base | (F.col("pos") >= F.col("h"))).join(moved, "c", "left")
    depth = (F.col("pos") + 1 - F.coalesce("up_by", F.lit(0))).alias("depth")
    return lent.unionByName(own.select("c", depth, "tid", "bytes"))


def classes(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """``(c, rep, n, len)`` of every conversation: the smallest one with the same turns, how many
    there are, and their length. Digests of runs are digested, so no whole sequence is gathered."""
    turn = F.struct("depth", "tid")
    runs = sequences.groupBy("c", F.floor(F.col("depth") / RUN).alias("run")).agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.hex(t["tid"])), ""), 256).alias("d"),
        F.count("*").alias("k"),
    )
    whole = F.transform(F.sort_array(F.collect_list(F.struct("run", "d"))), lambda r: r["d"])
    digests = runs.groupBy("c").agg(F.sha2(F.array_join(whole, ""), 256).alias("digest"), F.sum("k").alias("len"))
    zero = F.lit(0).cast("long")
    own = convs.select("c").join(digests, "c", "left").select("c", F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("len", zero).alias("len"))
    own = written(own, "trie-digests")
    found = own.groupBy("digest").agg(F.min("c").alias("rep"), F.count("*").alias("n"))
    return own.join(found, "digest").select("c", "rep", "n", "len")


def burst(big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chains of the ``big`` containers and their suffixes in new containers.

    A level is shared while all sequences of the container have it and agree on it, which one
    aggregate over (head, depth) tells; the first other level parts them."""
    levels = big.groupBy("head", "depth").agg(
        F.first("up").alias("up"),
        F.first("up_conv").alias("up_conv"),
        F.first("top").alias("top"),
        F.min("c").alias("conv"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.min("tid").alias("tid"),
        F.max("tid").alias("other"),
        F.min("bytes").alias("bytes"),
        F.min(F.when(F.col("depth") == F.col("len"), F.col("c"))).alias("ends"),
    )
    levels = written(levels, "trie-levels")
    whole = levels.where(F.col("depth") == F.col("top")).select("head", F.col("k").alias("all"), F.col("conv").alias("least"))
    parted = (F.col("tid") != F.col("other")) | (F.col("k") != F.col("all"))
    ends = (
        levels.join(whole, "head")
        .groupBy("head")
        .agg((F.min(F.when(parted, F.col("depth"))) - 1).alias("last"), F.first("least").alias("least"))
    )
    ends = written(ends, "trie-bursts")
    chains = levels.join(ends, "head").where(F.col("depth") <= F.col("last"))
    left = big.drop("up", "up_conv", "top").join(ends, "head").where(F.col("depth") > F.col("last"))
    next_turn = left.where(F.col("depth") == F.col("last") + 1).select(
        "c", F.md5(F.concat(F.col("head"), F.lit(":"), F.hex("tid"))).alias("new_head")
    )
    moved = left.join(next_turn, "c").select(
        F.col("new_head").alias("head"),
        F.col("head").alias("up"),
        F.col("least").alias("up_conv"),
        (F.col("last") + 1).alias("top"),
        "c", "n", "len", "depth", "tid", "bytes",
    )
    return written(chains, "trie-chains"), moved


class Node:
    __slots__ = ("bytes", "children", "conv", "depth", "ends", "leaves", "n", "parent", "saved")

    def __init__(self, parent: Node | None, depth: int, size: int) -> None:
        self.parent, self.depth, self.bytes = parent, depth, size
        self.conv = self.ends = None
        self.n = self.children = self.leaves = self.saved = 0


def sweep_container(rows: list[tuple]) -> list[Node]:
    """Nodes of one container from its rows ``(c, n, depth, tid, bytes)``: the suffixes are sorted
    and swept, each one closing the nodes it does not share with the one before."""
    suffixes: dict[int, list] = {}
    for c, n, depth, tid, size in sorted(rows):
        suffixes.setdefault(c, []).append((tid, size, depth, n))
    nodes: list[Node] = []
    path: list[Node] = []

    def close(keep: int) -> None:
        while len(path) > keep:
            node = path.pop()
            node.saved += (node.n - 1) * node.bytes
            node.leaves = node.leaves or 1
            if (parent := node.parent) is not None:
                parent.n += node.n
                parent.children += 1
                parent.leaves += node.leaves
                parent.saved += node.saved
                parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)

    before: list[bytes] = []
    for c, turns in sorted(suffixes.items(), key=lambda item: [turn[0] for turn in item[1]]):
        tids = [turn[0] for turn in turns]
        shared = 0
        while shared < min(len(before), len(tids)) and before[shared] == tids[shared]:
            shared += 1
        close(shared)
        for _, size, depth, _ in turns[shared:]:
            path.append(Node(path[-1] if path else None, depth, size))
            nodes.append(path[-1])
        path[-1].n += turns[0][3]
        path[-1].ends = c
        path[-1].conv = c if path[-1].conv is None else min(path[-1].conv, c)
        before = tids
    close(0)
    return nodes


def swept(small: DataFrame) -> DataFrame:
    """Nodes of the ``small`` containers, which are dealt by their heads."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 8]
        names = [field.split()[0] for field in NODE.split(", ")]
        now, held = None, []

        def finish() -> list[tuple]:
            _, up, up_conv = now
            return [
                (
                    up if node.parent is None else None, node.parent is None, node.conv, node.depth,
                    up_conv if node.parent is None else node.parent.conv,
                    node.n, node.children, node.leaves, node.saved, node.ends,
                )
                for node in sweep_container(held)
            ]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

        for batch in batches:
            found: list[tuple] = []
            for head, up, up_conv, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if now is None or now[0] != head:
                    if held:
                        found += finish()
                    now, held = (head, up, up_conv), []
                held.append(tuple(row))
            yield batch_of(found)
        if held:
            yield batch_of(finish())

    dealt = small.repartition("head").sortWithinPartitions("head")
    return dealt.select("head", "up", "up_conv", "c", "n", "depth", "tid", "bytes").mapInArrow(sweep, NODE)


def chain_nodes(single: DataFrame) -> DataFrame:
    """Nodes of the containers with one sequence. What the copies of a sequence save below a turn is
    a sum over the rest of it, taken over runs first, so that a long one is summed by many tasks."""
    run = F.floor(F.col("depth") / RUN)
    copies = single.where("n > 1").withColumn("run", run)
    below = Window.partitionBy("c").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("c", "run").orderBy(F.desc("depth"))
    sums = copies.groupBy("c", "run").agg(F.sum("bytes").alias("of_run"))
    sums = sums.select("c", "run", F.coalesce(F.sum("of_run").over(below), F.lit(0)).alias("below"))
    rest = copies.join(sums, ["c", "run"]).withColumn("rest", F.sum("bytes").over(inside) + F.col("below"))
    rows = rest.drop("run", "below").unionByName(single.where("n = 1").withColumn("rest", F.lit(0).cast("long")))
    first, last = F.col("depth") == F.col("top"), F.col("depth") == F.col("len")
    return rows.select(
        F.when(first, F.col("up")).alias("up"),
        first.alias("top"),
        F.col("c").alias("conv_id"),
        "depth",
        F.when(first, F.col("up_conv")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"),
        F.when(last, F.col("c")).alias("ends"),
    )


def sums_below(tops: DataFrame) -> DataFrame:
    """Children, leaves and savings under every burst node from the top nodes of its containers."""
    return tops.where("top").groupBy("up").agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )


def burst_nodes(chains: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of burst containers, given the top nodes of the containers they burst into."""
    joined = chains.join(sums_below(tops).withColumnRenamed("up", "head"), "head")
    own = (F.col("n") - 1) * F.col("bytes")
    upward = Window.partitionBy("head").orderBy(F.desc("depth"))
    first, last = F.col("depth") == F.col("top"), F.col("depth") == F.col("last")
    return joined.select(
        F.when(first, F.col("up")).alias("up"),
        first.alias("top"),
        F.col("least").alias("conv_id"),
        "depth",
        F.when(first, F.col("up_conv")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.sum(own).over(upward) + F.col("saved")).alias("saved_tokens"),
        "ends",
    )


def end_hashes(members: DataFrame) -> DataFrame:
    """``(ends, ends_sha256)``: the hash of the decimal ids of each class, ascending and joined by
    commas. Large classes are cut into ranges whose ids become strings first; only these are
    streamed through the hash in order."""
    alone = members.where("n = 1").select(F.col("rep").alias("ends"), F.sha2(F.col("c").cast("string"), 256).alias("ends_sha256"))

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for rep, c, part in zip(*(column.to_pylist() for column in batch.columns)):
                if held and (rep != now[0] or size > PIECE):
                    out.append((*now, number, ",".join(held)))
                    number, held, size = number + 1, [], 0
                now = (rep, part)
                held.append(str(c))
                size += len(held[-1]) + 1
            yield pieces_of(out)
            out = []
        if held:
            yield pieces_of([(*now, number, ",".join(held))])

    def pieces_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["rep", "part", "number", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            found = []
            for rep, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if rep != now:
                    if now is not None:
                        found.append((now, sha.hexdigest()))
                    now, sha = rep, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield hashes_of(found)
        if now is not None:
            yield hashes_of([(now, sha.hexdigest())])

    def hashes_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [(), ()]
        kinds = [pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["ends", "ends_sha256"])

    ranged = members.where("n > 1").select("rep", "c").repartitionByRange("rep", "c").sortWithinPartitions("rep", "c")
    pieces = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(join_ids, "rep long, part int, number long, ids string")
    ordered = pieces.repartition("rep").sortWithinPartitions("rep", "part", "number").select("rep", "ids")
    return alone.unionByName(ordered.mapInArrow(digest, "ends long, ends_sha256 string"))


def build_trie(sequences: DataFrame, convs: DataFrame, how: Bursting = Bursting()) -> DataFrame:
    """The nodes of the trie over ``sequences(c, depth, tid, bytes)``, depth from 1 without gaps;
    ``convs(c)`` also names those without turns."""
    members = written(classes(sequences, convs), "trie-classes")
    reps = members.where("c = rep").select("c", "n", "len")
    rows = sequences.join(reps, "c")
    heads = rows.where("depth = 1").select("c", F.hex("tid").alias("head"))
    total = members.agg(
        F.min("c").alias("least"), F.count("*").alias("convs"), F.min(F.when(F.col("len") == 0, F.col("rep"))).alias("turnless")
    ).first()
    least: Column = F.lit(total["least"]).cast("long")
    state = rows.join(heads, "c").select(
        "head", F.lit(ROOT).alias("up"), least.alias("up_conv"), F.lit(1).cast("long").alias("top"),
        "c", "n", "len", "depth", "tid", "bytes",
    )
    settled: list[list[DataFrame]] = []
    chains: list[DataFrame] = []
    while True:
        size = state.groupBy("head").agg(F.count("*").alias("turns"), (F.min("c") != F.max("c")).alias("several"))
        held = written(state.join(size, "head"), "trie-containers")
        big = (F.col("turns") > how.container) & F.col("several")
        settled.append(
            [
                chain_nodes(held.where(~F.col("several")).drop("turns", "several")),
                swept(held.where(~big & F.col("several"))),
            ]
        )
        bursting = held.where(big).drop("turns", "several")
        if bursting.isEmpty():
            break
        found, state = burst(bursting)
        chains.append(found)
    # From the last burst to the first: what stands below a burst is known before it.
    below = [written(reduce(DataFrame.unionByName, frames), "trie-nodes") for frames in settled]
    for number in range(len(chains) - 1, -1, -1):
        above = written(burst_nodes(chains[number], below[number + 1]), "trie-nodes")
        below[number] = below[number].unionByName(above)
    nodes = reduce(DataFrame.unionByName, below)

    under = sums_below(below[0]).first()
    children, leaves, saved = (under["children"], under["leaves"], under["saved"]) if under else (0, 1, 0)
    root = sequences.sparkSession.createDataFrame(
        [(None, False, total["least"], 0, None, total["convs"], children, leaves, saved, total["turnless"])]
        if total["convs"]
        else [],
        NODE,
    )
    hashed = nodes.unionByName(root).join(end_hashes(members), "ends", "left")
    return hashed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, how: Bursting = Bursting()) -> DataFrame:
    """The prefix trie of the conversations as they are: one row per node, see :func:`trie_report`."""
    turns = written(turns_of(conversations), "trie-turns")
    convs = turns.where("pos = 0").select("c", "len")
    return build_trie(turns.select("c", (F.col("pos") + 1).alias("depth"), "tid", "bytes"), convs, how)


def trie_report(conversations: DataFrame, how: Bursting = Bursting()) -> DataFrame:
    """The prefix trie of ``conversations(conv_id, turn, role, text)`` rebuilt by
    :func:`shared_starts`, one row per node with its members, children, leaves, what sharing its
    subtree saves, and the hash of the conversations that end in it.

    Turns are ordered with null turns first, rows of one turn by a hash of role and text; null roles
    and texts are empty. Turns are equal if their 128-bit ids are. Rows without an id belong to no
    conversation. Conversations that have no turns once rebuilt end in the root. An empty table has
    no root and gives no rows; extra columns are ignored."""
    turns = written(turns_of(conversations), "trie-turns")
    convs = written(turns.where("pos = 0").select("c", "len"), "trie-conversations")
    return build_trie(written(shared_starts(turns, convs), "trie-sequences"), convs, how)
