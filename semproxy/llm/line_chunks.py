"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of the last lines decides after each line whether a chunk ends there,
once it has two lines with text, so the same run of lines is cut alike wherever it stands, and lines
put in before it shift nothing. Chunks whose hash is found again anywhere are compared byte by byte;
of equal ones the first by document id and place stays, and the lines of the others are removed.

Where a repeated passage begins or ends, its chunks also hold lines of their surroundings. With
``Chunking.edges`` the repeats are therefore extended: the pairs of neighbouring lines that lie not
wholly inside a removed chunk are compared in the same way, hash first and then bytes, which carries
every repeat line by line up to its edges and finds runs too short for a chunk. Every removed line has
an equal one that stays before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.llm.common import weighed, written

MASK = (1 << 64) - 1
FACTOR = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Chunking:
    """``window`` lines feed the rolling hash; one line in ``spacing`` may end a chunk on average.

    ``edges`` extends repeated chunks to the edges of the repeated passages."""

    window: int = 2
    spacing: int = 3
    edges: bool = True


def chunk_lines(lines: list[bytes], how: Chunking) -> list[tuple[int, int]]:
    """``[first, end)`` of consecutive chunks that cover all lines."""
    if not lines:
        return []
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    rolling = np.zeros(len(lines), np.uint64)
    factor = 1
    for back in range(how.window):
        rolling[back:] += hashes[: len(lines) - back] * np.uint64(factor)
        factor = factor * FACTOR & MASK
    rolling ^= rolling >> np.uint64(29)
    ends = np.flatnonzero(rolling * np.uint64(FACTOR) >> np.uint64(33) < (1 << 31) // how.spacing) + 1
    full = np.cumsum([0, *(1 if line.strip() else 0 for line in lines)])
    edges = [0]
    for end in ends.tolist():
        # A chunk of one line with text goes on.
        if full[end] - full[edges[-1]] > 1:
            edges.append(end)
    if edges[-1] != len(lines):
        edges.append(len(lines))
    return list(zip(edges, edges[1:]))


def text_lines(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text else []


def repeatable(lines: list[bytes]) -> bool:
    """Several lines, two of them with more than white space."""
    return sum(1 for line in lines if line.strip()) > 1


def line_pairs(lines: list[bytes]) -> list[tuple[int, int]]:
    """``[first, end)`` of every two neighbouring lines with more than white space, and what is
    between them."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    return [(first, last + 1) for first, last in zip(full, full[1:])]


def open_pairs(lines: list[bytes], gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that do not lie wholly inside one of the ``gone`` runs."""
    pairs = line_pairs(lines)
    if not gone:
        return pairs
    run = [0] * len(lines)
    for number, (first, end) in enumerate(gone, 1):
        run[first:end] = [number] * (end - first)
    return [(a, b) for a, b in pairs if not run[a] or run[a] != run[b - 1]]


def cut_runs(lines: list[bytes], chunks: list[int] | None, how: Chunking, edges: bool) -> list[tuple[int, int]]:
    """The runs of lines that are looked for elsewhere: the chunks, or, for ``edges``, the pairs
    outside the removed ``chunks``."""
    cut = chunk_lines(lines, how)
    if not edges:
        return cut
    return open_pairs(lines, [cut[number] for number in chunks or ()])


def keyed(docs: DataFrame) -> DataFrame:
    """``(id, known, copy, text)``: null ids come last; ``copy`` tells apart texts under one id."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
        F.col("doc_id").isNotNull().alias("known"),
        F.xxhash64("text").alias("copy"),
        F.col("text").cast("binary").alias("text"),
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def run_hashes(rows: DataFrame, how: Chunking, edges: bool) -> DataFrame:
    """``(id, copy, run, hash)`` of all runs of ``rows(id, copy, text, chunks)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, hashes = [], [], []
            texts, gone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row, text in enumerate(texts):
                lines = text_lines(text)
                for run, (first, end) in enumerate(cut_runs(lines, gone[row], how, edges)):
                    if edges or repeatable(lines[first:end]):
                        owner.append(row)
                        number.append(run)
                        hashes.append(_signed(xxhash.xxh3_64_intdigest(b"\n".join(lines[first:end]))))
            taken = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken),
                 pa.array(number, pa.int32()), pa.array(hashes, pa.int64())],
                names=["id", "copy", "run", "hash"],
            )

    return rows.select("id", "copy", "text", "chunks").mapInArrow(cut, "id long, copy long, run int, hash long")


def repeated_runs(rows: DataFrame, how: Chunking, edges: bool) -> DataFrame:
    """``(id, copy, runs)``: numbers of the runs of a document to be removed.

    Hashes of all runs are counted before the shuffle; only the text of runs with a repeated hash
    travels to be compared, grouped by hash and bytes."""
    hashes = written(run_hashes(rows, how, edges), "run-hashes")
    repeated = hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    wanted = hashes.join(repeated, "hash", "left_semi")
    wanted = written(wanted.groupBy("id", "copy").agg(F.sort_array(F.collect_set("run")).alias("runs")), "run-wanted")
    texts = rows.join(weighed(wanted), ["id", "copy"]).select("id", "copy", "text", "chunks", "runs")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, starts, ends, found = [], [], [], [], []
            texts, gone, wanted = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for row, text in enumerate(texts):
                lines = text_lines(text)
                runs = cut_runs(lines, gone[row], how, edges)
                for run in wanted[row]:
                    first, end = runs[run]
                    owner.append(row)
                    number.append(run)
                    starts.append(first)
                    ends.append(end)
                    found.append(b"\n".join(lines[first:end]))
            taken = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken),
                 pa.array(number, pa.int32()), pa.array(starts, pa.int32()),
                 pa.array(ends, pa.int32()), pa.array(found, pa.binary())],
                names=["id", "copy", "run", "start", "end", "bytes"],
            )

    found = texts.mapInArrow(extract, "id long, copy long, run int, start int, end int, bytes binary")
    found = written(found.withColumn("hash", F.xxhash64("bytes")), "run-bytes")
    place = F.struct("id", "copy", "start", "end")
    first = found.groupBy("hash", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Runs that share lines with the first one are part of it.
    again = found.join(first.where("n > 1").select("hash", "bytes", "first"), ["hash", "bytes"]).where(
        "id != first.id OR copy != first.copy OR start >= first.end"
    )
    return written(again.groupBy("id", "copy").agg(F.sort_array(F.collect_set("run")).alias("runs")), "run-removed")


def dedup_lines(docs: DataFrame, how: Chunking = Chunking()) -> DataFrame:
    """``(doc_id, kept, n_lines, n_chunks, n_removed_chunks, n_removed_lines)`` of every row.

    ``kept`` is the remaining text as UTF-8. Null and empty texts have no lines and stay as they
    are (a null as empty). Rows equal in id and text count as one document: what the first holds
    stays in all of them; rows with one id and different texts are told apart. Null ids come last.
    Extra columns are ignored; an empty table gives no rows."""
    rows = keyed(docs)
    none = F.lit(None).cast("array<int>")
    removed = weighed(repeated_runs(rows.withColumn("chunks", none), how, False).withColumnRenamed("runs", "chunks"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.withColumn("doc_id", F.when(F.col("known"), F.col("id").cast(kind))).join(removed, ["id", "copy"], "left")
    pairs = joined.withColumn("runs", none)
    if how.edges:
        extended = weighed(repeated_runs(rows.join(removed, ["id", "copy"], "left"), how, True))
        pairs = joined.join(extended, ["id", "copy"], "left")
    joined = pairs.select("doc_id", "text", "chunks", "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, numbers, edges = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for text, chunks, runs in zip(texts, numbers, edges):
                lines = text_lines(text)
                cut = chunk_lines(lines, how)
                taken = [cut[number] for number in chunks or ()]
                if runs:
                    pairs = open_pairs(lines, taken)
                    taken = taken + [pairs[number] for number in runs]
                gone = {i for first, end in taken for i in range(first, end)}
                kept = [line for i, line in enumerate(lines) if i not in gone] if gone else lines
                n_removed = len(chunks or ())
                joined = b"\n".join(kept)
                rows.append((joined, len(lines), len(cut), n_removed, len(lines) - len(kept)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "kept", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines"],
            )

    return joined.mapInArrow(
        remove,
        f"doc_id {kind}, kept binary, n_lines long, n_chunks long, n_removed_chunks long, "
        "n_removed_lines long",
    )


def line_report(docs: DataFrame, how: Chunking = Chunking()) -> DataFrame:
    """Counts and a digest of the kept text of every row; odd rows as in :func:`dedup_lines`."""
    kept = dedup_lines(docs.select("doc_id", "text"), how)
    return kept.select("*", F.sha2("kept", 256).alias("kept_sha256")).drop("kept")
