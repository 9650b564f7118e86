"""Edit-aware token counts: a segment tree of pre-tokens per document.

A tokenizer cuts a text into pre-tokens and encodes each alone, so counts add up. The leaves of a
document's tree are runs of pre-tokens with their place and token count, the inner nodes are sums.
An edit touches few leaves: from the leaf that holds the third character before the white space
around the edit, the new text is cut again until a cut falls on an old leaf start beyond the edit. A
pre-token depends only on the text from its start on, so everything after that cut is unchanged; the
counts of the touched leaves are replaced and the sums above them updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed: how texts are cut before the byte pairs of this vocabulary are merged.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
LEAF = 64
REACH = 3

EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
TREE = "leaves array<int>, sums array<long>"


class Counter(dict):
    """Tokens per pre-token, remembered up to a bound."""

    LIMIT = 300_000

    def __init__(self, vocabulary: bytes):
        super().__init__()
        lines = (line.split() for line in vocabulary.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.pattern = regex.compile(PATTERN)
        self.encode = tiktoken.Encoding(
            "pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        count = self[piece] = len(self.encode(piece))
        return count

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and token count of every pre-token."""
        pieces = self.pattern.findall(text)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        return np.cumsum(lengths) - lengths, counts


@dataclass
class TokenTree:
    """``leaves[i]`` is where leaf i starts; ``sums`` is a binary heap: node n sums 2n and 2n + 1,
    leaf i is node ``len(leaves) + i``."""

    leaves: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, counter: Counter, text: str) -> TokenTree:
        starts, counts = counter.cut(text)
        if not len(starts):
            return cls(np.zeros(1, np.int64), np.zeros(2, np.int64))
        leaves = starts[::LEAF]
        sums = np.zeros(2 * len(leaves), np.int64)
        sums[len(leaves) :] = np.add.reduceat(counts, np.arange(0, len(counts), LEAF))
        for node in range(len(leaves) - 1, 0, -1):
            sums[node] = sums[2 * node] + sums[2 * node + 1]
        return cls(leaves, sums)

    @property
    def tokens(self) -> int:
        return int(self.sums[1])

    def put(self, leaf: int, count: int) -> None:
        """Set one leaf and the sums above it."""
        node = len(self.leaves) + leaf
        change = count - int(self.sums[node])
        while node and change:
            self.sums[node] += change
            node //= 2


def tidy_edits(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """Edits in text order, inside the text and without overlaps; a null text deletes."""
    tidy = []
    reached = 0
    known = [e for e in edits or [] if e is not None and e["start"] is not None]
    for edit in sorted(known, key=lambda e: e["start"]):
        start = min(max(edit["start"], reached), length)
        end = edit["start"] if edit["end"] is None else edit["end"]
        end = min(max(end, start), length)
        tidy.append((start, end, edit["text"] or ""))
        reached = end
    return tidy


def apply_edits(
    counter: Counter, text: str, tree: TokenTree, edits: list[tuple[int, int, str]]
) -> tuple[str, TokenTree, int]:
    """The edited text, its tree, and how many characters were cut and encoded again."""
    parts, at, shift = [], 0, 0
    # Per edit: the leaf to restart from, its end in the new text, new minus old place after it.
    marks = []
    for start, end, added in edits:
        parts += [text[at:start], added]
        at = end
        context = start
        while context and text[context - 1].isspace():
            context -= 1
        # Up to three characters before may be the start of a contraction that the edit completes.
        leaf = int(np.searchsorted(tree.leaves, max(context - REACH, 0), "right")) - 1
        marks.append((leaf, end + shift + len(added) - (end - start), shift + len(added) - (end - start)))
        shift = marks[-1][2]
    new_text = "".join([*parts, text[at:]])
    leaves, old_leaves = tree.leaves.copy(), tree.leaves
    tree = TokenTree(leaves, tree.sums.copy())
    n, done, recut, number = len(leaves), 0, 0, 0
    while number < len(marks):
        first = marks[number][0]
        moved = marks[number - 1][2] if number else 0
        begin = int(old_leaves[first]) + moved
        starts, counts = [], []
        last = first
        place = begin
        while True:
            match = counter.pattern.match(new_text, place)
            if match is None:
                last = n
                number = len(marks)
                break
            starts.append(place)
            counts.append(counter[match.group()])
            place = match.end()
            # Every edit this cut has passed or must be restarted inside it belongs to the region.
            while number + 1 < len(marks) and place >= int(old_leaves[marks[number + 1][0]]) + marks[number][2]:
                number += 1
            if place >= marks[number][1]:
                old = place - marks[number][2]
                last = int(np.searchsorted(old_leaves, old))
                if last < n and last > first and old_leaves[last] == old:
                    number += 1
                    break
        moved = marks[number - 1][2]
        recut += place - begin
        leaves[last:] = old_leaves[last:] + moved
        # The region keeps its number of leaves, so the shape of the tree stays.
        shares = np.array_split(np.arange(len(starts)), max(last - first, 1))
        for leaf, share in zip(range(first, max(last, first + 1)), shares):
            leaves[leaf] = starts[share[0]] if len(share) else place
            tree.put(leaf, sum(counts[i] for i in share))
    return new_text, tree, recut


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def build_trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``leaves`` and ``sums``, the segment tree of each row's text.

    ``vocabulary`` is the path of a rank file on the driver, which sends its content to the tasks.
    Null and empty texts have a tree of one empty leaf. Rows are counted each; columns called
    ``leaves`` or ``sums`` are replaced."""
    docs = docs.drop("leaves", "sums")
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    at = docs.columns.index("text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            trees = [TokenTree.build(counter, t or "") for t in batch.column(at).to_pylist()]
            leaves = pa.array([t.leaves for t in trees], pa.list_(pa.int32()))
            sums = pa.array([t.sums for t in trees], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, leaves, sums], names=[*batch.schema.names, "leaves", "sums"]
            )

    fields = [
        T.StructField("leaves", T.ArrayType(T.IntegerType())),
        T.StructField("sums", T.ArrayType(T.LongType())),
    ]
    return docs.mapInArrow(build, T.StructType([*docs.schema.fields, *fields]))


def edit_trees(trees: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of ``(doc_id, text, leaves, sums, edits)`` after their ``edits`` (see :data:`EDITS`).

    Places are code points of the old text. Only the touched regions are encoded. Returns the new
    text and tree, the tokens before and after, and the characters cut again. Null or empty edits
    change nothing; edits are clipped to the text and to the end of the one before."""
    shared = trees.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    kind = trees.schema["doc_id"].dataType.simpleString()

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            rows = []
            texts, edits = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            for row, text in enumerate(texts):
                tree = TokenTree(
                    batch.column(2)[row].values.to_numpy().astype(np.int64),
                    batch.column(3)[row].values.to_numpy(),
                )
                tidy = tidy_edits(edits[row], len(text or ""))
                new, edited, recut = apply_edits(counter, text or "", tree, tidy)
                rows.append((new, edited.leaves, edited.sums, tree.tokens, edited.tokens, recut))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "text", "leaves", "sums", "tokens_before", "tokens", "recut"],
            )

    return trees.select("doc_id", "text", "leaves", "sums", "edits").mapInArrow(
        edit,
        f"doc_id {kind}, text string, {TREE}, tokens_before long, tokens long, recut long",
    )


def review_edits(text: Column, note: Column) -> Column:
    """Three edits a reviewer might make: a note at the start, a cut, and an added end."""
    length = F.char_length(text).cast("long")
    third = F.floor(length / 3).cast("long")

    def one(start: Column, end: Column, added: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), added.alias("text"))

    return F.array(
        one(F.lit(0).cast("long"), F.lit(0).cast("long"), F.concat(F.coalesce(note, F.lit("")), F.lit(": "))),
        one(2 * third, 2 * third + 10, F.lit(None).cast("string")),
        one(length, length, F.lit("\nend of text")),
    )


def count_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Tokens of every row of ``docs(doc_id, text, source)`` before and after review edits."""
    trees = build_trees(docs.select("doc_id", "text", "source"), vocabulary)
    edited = edit_trees(
        trees.withColumn("edits", review_edits(F.coalesce("text", F.lit("")), F.col("source"))), vocabulary
    )
    return edited.select(
        "doc_id",
        "tokens_before",
        "tokens",
        "recut",
        F.size("leaves").cast("long").alias("n_leaves"),
        F.char_length("text").cast("long").alias("n_chars"),
    )
