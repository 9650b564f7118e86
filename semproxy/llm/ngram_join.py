"""Similarity join on word five-grams by MinHash banding, verified on the full n-gram sets.

Bands and rows per band follow from the wanted recall at the threshold. Documents are shuffled on
their band hashes; every bucket links its texts to its smallest one, and the connected texts form
blocks, a superset of the true classes. Blocks are verified on full n-gram sets: a block of bounded
size in one task, a larger one in tiles of two parts, so that every pair of texts in a block meets
in exactly one task, none of which holds more than a tile. Tasks count links and return a spanning
forest of them, never all pairs; exact copies are one text throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.llm.common import WordHashes, index_words, measured, text_bytes, written

MIX = np.uint64(0xD6E8FEB86659FD93)
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Join:
    """``recall`` is the probability that a pair exactly at ``threshold`` shares a band; ``hashes``
    bounds the signature. A tile holds at most ``tile_texts`` texts or ``tile_grams`` n-grams a
    side on average, which bounds a task's memory, not its results."""

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    hashes: int = 128
    seed: int = 42
    tile_texts: int = 1024
    tile_grams: int = 2_000_000

    @property
    def banding(self) -> tuple[int, int]:
        """The most selective ``(bands, rows)`` that keep the recall within the hashes."""
        for rows in range(self.hashes, 0, -1):
            miss = 1 - self.threshold**rows
            if self.threshold**rows > 0 and miss > 0:
                bands = math.ceil(math.log(1 - self.recall) / math.log(miss))
                if bands * rows <= self.hashes:
                    return bands, rows
        return self.hashes, 1


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX
    return values ^ (values >> np.uint64(29))


def text_grams(text: bytes, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams; a shorter text with words is one n-gram."""
    hashes = words.of(index_words(text))
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    grams = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        grams = mixed(grams * MIX + hashes[i : len(hashes) - size + 1 + i] + np.uint64(i + 1))
    return np.unique(grams)


def permutations(join: Join) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(join.seed)
    bands, rows = join.banding
    factors = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 1 << 32, bands * rows, np.uint32)


def band_hashes(grams: np.ndarray, banding: tuple, factors: np.ndarray, offsets: np.ndarray):
    """One 64-bit hash per band of the MinHash signature."""
    bands, rows = banding
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 1024):
        values = short[start : start + 1024, None] * factors + offsets
        np.minimum(least, values.min(0), out=least)
    hashes = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        hashes = mixed(hashes * MIX + column)
    return hashes


def _fields(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(id, digest, text)``: null ids come last, copies share a digest."""
    data = text_bytes(F.col(text))
    return df.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.unhex(F.md5(data)).alias("digest"),
        data.alias("text"),
    )


def signatures(rows: DataFrame, join: Join) -> DataFrame:
    """``(id, digest, n_grams, bands)`` of every row; texts without words have no bands."""

    banding, (factors, offsets) = join.banding, permutations(join)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, signed = [], []
            for text in batch.column(2).to_pylist():
                grams = text_grams(text, join.n, words)
                sizes.append(len(grams))
                hashes = band_hashes(grams, banding, factors, offsets)
                signed.append(hashes.view(np.int64) if len(grams) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(signed, pa.list_(pa.int64()))],
                names=["id", "digest", "n_grams", "bands"],
            )

    return rows.mapInArrow(sign, "id long, digest binary, n_grams long, bands array<long>")


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node of its component, for all nodes of ``edges(a, b)``.

    Alternates two steps until nothing changes: every node sends its larger neighbours to the
    smallest node it knows, then every node sends itself and its smaller neighbours there. A round
    is grouped minima and joins; its edges are written, so a lost executor repeats one round."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), "links")
    seen = None
    while True:
        marks = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)")))
        state = tuple(marks.first())
        if state == seen:
            break
        seen = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.join(least, "a").where("b > a")
        larger = larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        roots = larger.groupBy("a").agg(F.min("b").alias("m"))
        sent = larger.join(roots, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = written(sent.where("a <> b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _overlaps(grams: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with all sets.

    N-grams of one set only cannot add to one; the others become columns of 0/1 matrices, which
    are multiplied in slices of bounded width."""
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    names, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    sizes = np.zeros((left, len(grams)), np.float32)
    for start in range(0, len(names), 2048):
        low, high = np.searchsorted(column, [start, start + 2048])
        present = np.zeros((len(grams), min(2048, len(names) - start)), np.float32)
        present[owner[low:high], column[low:high] - start] = 1.0
        sizes += present[:left] @ present.T
    return sizes


def verify(
    grams: list[np.ndarray], left: int, within: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs ``(i, j)``: i < j ``within`` the whole list, else i in the first ``left`` and j
    in the rest."""
    if len(grams) < 2 or not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(g) for g in grams])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    both = _overlaps(grams, left)
    for i in range(left):
        first = i + 1 if within else left
        shared = both[i, first:]
        union = lengths[i] + lengths[first:] - shared
        j = np.flatnonzero(shared >= threshold * union - 1e-6) + first
        found.append((np.full(len(j), i), j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(i: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of the links: as connected as all of them, with one edge less per tree."""
    parent = list(range(size))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = top(a), top(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def compare_tile(
    nodes: np.ndarray, part: np.ndarray, copies: np.ndarray, texts: list[bytes], within: bool, join: Join
) -> list[tuple[int, int, int]]:
    """Rows ``(a, b, 0)`` of a spanning forest and ``(a, a, links)`` of one tile."""
    order = np.lexsort((nodes, part))
    left = len(order) if within else int((part == part.min()).sum())
    if not within and left == len(order):
        return []
    words = WordHashes()
    grams = [text_grams(texts[i], join.n, words) for i in order]
    i, j = verify(grams, left, within, join.threshold)
    nodes, copies = nodes[order], copies[order]
    links = np.zeros(len(order), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    rows = [(int(nodes[a]), int(nodes[b]), 0) for a, b in forest(i, j, len(order))]
    return rows + [(int(nodes[a]), int(nodes[a]), int(links[a])) for a in np.flatnonzero(links)]


def classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``(digest, id, class_id, class_digest, n_copies, n_links, n_grams)`` per distinct text.

    ``class_id`` is the smallest id of the connected class and ``class_digest`` the text that has
    it; ``n_links`` counts the other documents at least as similar as the threshold, with copies."""
    data = text_bytes(F.col("text"))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.unhex(F.md5(data)).alias("digest"),
        data.alias("text"),
    )
    signed = written(signatures(rows, join), "join-signatures")
    texts = signed.groupBy("digest").agg(
        F.min("id").alias("id"),
        F.count("*").alias("copies"),
        F.first("n_grams").alias("n_grams"),
        F.first("bands").alias("bands"),
    )
    # The number of a text is fixed by writing it; results do not depend on the numbering.
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "join-texts")
    bands = texts.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = bands.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    candidates = bands.join(buckets.where("n > 1"), ["band", "hash"])
    candidates = candidates.select(F.col("node").alias("a"), F.col("least").alias("b"))
    links = written(_verified(rows, texts, connected(candidates), join), "join-links")

    in_class = connected(links.where("n = 0").select("a", "b"))
    linked = links.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    whole = (
        texts.select("node", "digest", "id", "copies", "n_grams")
        .join(in_class, "node", "left")
        .join(linked, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    whole = written(whole, "join-classes")
    # Classes of one text need no grouping.
    several = whole.join(in_class.select("root").distinct(), "root", "left_semi")
    firsts = several.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("first"))
    return whole.join(firsts, "root", "left").select(
        "digest",
        "id",
        F.coalesce(F.col("first.id"), F.col("id")).alias("class_id"),
        F.coalesce(F.col("first.digest"), F.col("digest")).alias("class_digest"),
        F.col("copies").alias("n_copies"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "n_grams",
    )


def _verified(rows: DataFrame, texts: DataFrame, blocks: DataFrame, join: Join) -> DataFrame:
    """``(a, b, n)``: links per text (a = b) and spanning forests of the links, per tile of the
    candidate blocks. Only texts in blocks of several are read again and travel."""
    known = texts.select("node", "id", "digest", "copies", "n_grams")
    inside = written(blocks.join(known, "node"), "join-blocks")
    sizes = inside.groupBy("root").agg(F.count("*").alias("members"), F.sum("n_grams").alias("grams"))
    parts = F.greatest(
        F.ceil(F.col("members") / join.tile_texts), F.ceil(F.col("grams") / join.tile_grams)
    )
    wanted = inside.join(sizes.select("root", parts.cast("int").alias("parts")), "root").select(
        "id", "digest", "node", "root", "copies", "parts",
        F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"),
    )
    wanted = measured(written(wanted, "join-wanted"), 200)
    # One row stands for all copies of a text; rows equal in id and text appear once.
    own = rows.join(wanted, ["id", "digest"]).dropDuplicates(["node"])
    tiles = F.expr(
        "transform(sequence(0, parts - 1), o -> struct(least(part, o) AS low, greatest(part, o) AS high))"
    )
    spread = own.select("node", "root", "part", "copies", "text", F.explode(tiles).alias("tile")).select(
        "root", "tile.low", "tile.high", "node", "part", "copies", "text"
    )

    def compare(group: pa.Table) -> pa.Table:
        found = compare_tile(
            group["node"].to_numpy(),
            group["part"].to_numpy(),
            group["copies"].to_numpy(),
            group["text"].to_pylist(),
            group["low"][0] == group["high"][0],
            join,
        )
        columns = list(zip(*found)) if found else [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    return spread.groupBy("root", "low", "high").applyInArrow(compare, "a long, b long, n long")


def join_report(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``(doc_id, class_id, n_links, n_copies, n_grams)`` of every row of ``docs(doc_id, text)``.

    Texts of fewer words than an n-gram are one n-gram; null and empty texts, and those without
    words, have none and are similar only to their own copies. Repeated rows are copies. Null ids
    come last (a class with null ids only shows the largest number). Extra columns are ignored; an
    empty table gives no rows."""
    found = written(classes(docs.select("doc_id", "text"), join), "join-found")
    own = docs.select("doc_id", F.unhex(F.md5(text_bytes(F.col("text")))).alias("digest"))
    return own.join(found, "digest").select("doc_id", "class_id", "n_links", "n_copies", "n_grams")


def keep_one_per_class(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The row of ``docs`` with the smallest id of each class, with all its columns.

    Of several rows with that id and text one stays. Nulls and ties as in :func:`join_report`."""
    found = written(classes(docs.select("doc_id", "text"), join), "join-found")
    first = found.where(F.col("digest") == F.col("class_digest"))
    first = first.select(F.col("digest").alias("kept_digest"), F.col("id").alias("kept_id"))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.unhex(F.md5(text_bytes(F.col("text")))).alias("digest"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("number"),
    )
    wanted = measured(written(first, "join-kept"), 100)
    same = (F.col("digest") == F.col("kept_digest")) & (F.col("number") == F.col("kept_id"))
    kept = packed.join(wanted, same)
    repeated = kept.groupBy("digest", "number").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if not repeated:
        kept = kept.dropDuplicates(["digest", "number"])
    return kept.select("row.*")
