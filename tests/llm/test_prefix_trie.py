"""The burst trie against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from semproxy.llm import prefix_trie as trie
from semproxy.llm.prefix_trie import Bursting

SCHEMA = "conv_id long, turn long, role string, text string"


def grouped(rows):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def expected(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    below, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves.get(node) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = saved.get(node, 0) + own
        if node:
            below[node[:-1]] = below.get(node[:-1], 0) + 1
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    found = []
    for node, ids in members.items():
        said = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(said.encode()).hexdigest()
        found.append((min(ids), len(node), parent, len(ids), below.get(node, 0), leaves[node], saved[node], sha))
    return sorted(found, key=repr)


def said(frame):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Shared starts, copies, conversations that continue others, ties, nulls and a long one."""
    rng = random.Random(12)
    texts = ["", "a", "Ünï", "hello there", None]
    found = []
    for conv in range(120):
        length = rng.randint(1, 10)
        found += [(conv, t, ("user", "assistant")[t % 2], rng.choice(texts)) for t in range(length)]
    for conv in range(130, 170):  # one common start, then copies and continuations
        for t in range(rng.choice([6, 6, 6, 7, 9])):
            found.append((conv, t, "user", f"common {t}" if t < 6 else rng.choice("xy")))
    found += [(c, t, "user", f"turn {t}") for c in (200, 205) for t in range(300)]  # two long copies
    found += [(210, t, "user", f"turn {t}") for t in range(290)]
    found += [(c, None, None, None) for c in (301, 302)] + [(303, 1, "b", "x"), (303, 1, "a", "x"), (303, None, "c", "x")]
    found += [(None, 1, "user", "nobody")]
    return found + found[5:7]


@pytest.mark.parametrize("container", [1, 20, 4096])
def test_rebuilt_against_brute_force(spark, rows, container, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 7)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({n: F.lit(1) for n in ("c", "pos", "head", "n")})
    ties = [r for r in rows if r[0] != 303 or r[1] is None]  # rows of one turn follow a hash
    frame = frame.where("NOT (conv_id <=> 303 AND turn <=> 1)")
    assert said(trie.trie_report(frame, Bursting(container))) == expected(rebuilt(grouped(ties)))


def test_as_they_are(spark, rows):
    kept = [r for r in rows if r[0] != 303]
    assert said(trie.conversation_trie(spark.createDataFrame(kept, SCHEMA))) == expected(grouped(kept))


def test_ties_do_not_depend_on_the_layout(spark, rows):
    frame = spark.createDataFrame([r for r in rows if r[0] == 303], SCHEMA)
    assert said(trie.conversation_trie(frame)) == said(trie.conversation_trie(frame.repartition(3)))


def test_large_classes_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 10)
    rows = [(c, 0, "user", "all alike") for c in range(1, 2000, 3)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert said(trie.conversation_trie(frame)) == expected(grouped(rows))


def test_empty_and_turnless(spark):
    assert trie.trie_report(spark.createDataFrame([], SCHEMA)).collect() == []
    lost = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(lost, 0, "user", "x")]
    assert said(trie.trie_report(spark.createDataFrame(rows, SCHEMA))) == expected(rebuilt(grouped(rows)))


def test_bursts_skip_what_all_share(spark):
    """A long common start costs one burst, not one a level."""
    rows = [(c, t, "user", f"{t}" if t < 50 else f"{c}") for c in range(30) for t in range(52)]
    turns = trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    state = turns.select(
        F.lit("h").alias("head"), F.lit("").alias("up"), F.lit(0).cast("long").alias("up_conv"), F.lit(1).cast("long").alias("top"),
        "c", F.lit(1).cast("long").alias("n"), "len", (F.col("pos") + 1).alias("depth"), "tid", "bytes",
    )
    chains, left = trie.burst(state)
    assert chains.count() == 50
    assert left.select("head").distinct().count() == 30 and left.agg(F.min("depth")).first()[0] == 51
