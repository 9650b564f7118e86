"""Exact substring dedup by column-wise construction of a multi-document suffix order.

A 50-byte string is a repeat if it also starts in a document with a smaller id. Its sketch is its
minimizer: the least hashed 16-byte string inside it, which equal strings have at the same place. So

1. documents are packed into blocks; each block sends the minimizers of all its 50-byte strings,
   each once, to buckets of hash values, and learns which occur in a second document;
2. runs of strings around a repeated minimizer are cut out as short pieces and sent to the bucket of
   the minimizer, equal pieces of a block once and with their smallest id;
3. a bucket builds the suffix order of its pieces column by column. Pieces are aligned at their
   minimizer, so equal strings begin in the same column. Every round inserts one symbol per piece,
   from the last column to the first: a stable distribution by the new symbol moves the order of
   the suffixes one column on, and the common prefixes of neighbours are one more than the least
   common prefix between their old places, or none if the symbols differ. Where neighbours share 50
   bytes they are one string, and the smallest id of such a run is the string's owner;
4. owners go back to the blocks, which remove every byte under a string owned by a smaller id.

A round reads the order, the symbols and the prefixes in sequence; the arrays of a bucket are its
only state. A group of copies costs one piece per block, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.llm.common import written
from semproxy.session import shuffle_partitions

LENGTH = 50
GRAM = 16
STRINGS = LENGTH - GRAM + 1  # places a minimizer can have in a string
COLUMNS = 2 * LENGTH - GRAM
NO_ID = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LOW = np.uint64(0xFFFFFFFF)
KEY = np.uint64((1 << 48) - 1)

Pieces = dict[str, np.ndarray]


@dataclass(frozen=True)
class Sizes:
    """Bytes of text per block and, on average, per bucket: they bound the memory of a task."""

    block: int = 2 << 20
    bucket: int = 16 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.base = self.inverse = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.base) < n:
            steps = np.full(n, BASE, np.uint64)
            steps[0] = 1
            self.base = np.cumprod(steps)
            steps[1:] = INVERSE
            self.inverse = np.cumprod(steps)
        return self.base[:n], self.inverse[:n]


def find_pieces(data: np.ndarray, lengths: np.ndarray, powers: Powers) -> Pieces:
    """Runs of strings of one document that share a minimizer, over a block of texts.

    ``start`` is the first string's place, ``strings`` their number, ``place`` the minimizer's,
    ``key`` its hash, ``doc`` the document's row and ``content`` a hash of the piece's bytes."""
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        names = ("start", "strings", "place", "doc")
        return {name: empty for name in names} | {
            "key": empty.astype(np.uint64), "content": empty.astype(np.uint64)
        }
    base, inverse = powers.upto(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * base[:n], out=prefix[1:])
    grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n - GRAM + 1])
    # The least hash and, among equal ones, the first place, in one number.
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= STRINGS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = STRINGS - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    place = (least & LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = doc[: n - LENGTH + 1] == doc[LENGTH - 1 :]
    change = np.ones(len(place) + 1, bool)
    change[1:-1] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (doc[1 : len(place)] != doc[: len(place) - 1])
    edges = np.flatnonzero(change)
    start, strings = edges[:-1], np.diff(edges)
    real = inside[start]
    start, strings = start[real], strings[real]
    at = place[start]
    end = start + strings + LENGTH - 1
    content = mixed((prefix[end] - prefix[start]) * inverse[start])
    content = mixed(content ^ (strings.astype(np.uint64) << np.uint64(8)) ^ (at - start).astype(np.uint64))
    return {
        "start": start, "strings": strings, "place": at, "doc": doc[start],
        "key": grams[at] & KEY, "content": content,
    }


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key & LOW) % np.uint64(buckets)).astype(np.int64)


def block_keys(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Distinct minimizers of a block in order, and whether two of its documents have them."""
    order = np.argsort(pieces["key"], kind="stable")
    key, doc = pieces["key"][order], pieces["doc"][order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    last = np.concatenate([first[1:], [len(key)]]).astype(np.int64) - 1 if len(key) else order
    return key[first], doc[first] != doc[last]


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_records(records: np.ndarray) -> bytes:
    """Records field by field, numbers and ids as differences: both rise or repeat mostly."""
    fields = []
    for name in records.dtype.names:
        values = records[name]
        if values.dtype.itemsize > 1:
            values = np.diff(values.astype(np.int64), prepend=np.int64(0))
        fields.append(np.ascontiguousarray(values).tobytes())
    return pack(b"".join(fields))


def unpack_records(data: bytes, kind: np.dtype) -> np.ndarray:
    data = unpack(data)
    widths = [8 if kind[name].itemsize > 1 else 1 for name in kind.names]
    records = np.empty(len(data) // sum(widths), kind)
    at = 0
    for name, width in zip(kind.names, widths):
        values = np.frombuffer(data, np.int64 if width == 8 else np.uint8, len(records), at)
        records[name] = np.cumsum(values) if width == 8 else values
        at += width * len(records)
    return records


def owners(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per piece and string column, the smallest id of the pieces with the same 50 bytes there.

    ``rows`` has one piece a row, aligned, with symbols from 1 and 0 where a piece has none."""
    n = len(rows)
    order = np.arange(n)
    prefixes = np.zeros(n, np.uint8)
    owner = np.empty((n, STRINGS), np.int64)
    symbols = np.ascontiguousarray(rows.T)
    del rows
    for column in range(COLUMNS - 1, -1, -1):
        behind = symbols[column][order]
        moved = np.argsort(behind, kind="stable")
        symbol = behind[moved]
        # The least common prefix between two old places, from minima over powers of two.
        levels = [prefixes]
        while 2 << (len(levels) - 1) <= n:
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        left, right = moved[:-1] + 1, moved[1:]
        same = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)
        pairs = np.flatnonzero(same)
        left, right = left[pairs], right[pairs]
        level = np.log2(right - left + 1).astype(np.int64)
        between = np.empty(len(pairs), np.uint8)
        for number in np.unique(level).tolist():
            mine = np.flatnonzero(level == number)
            table = levels[number]
            between[mine] = np.minimum(table[left[mine]], table[right[mine] - (1 << number) + 1])
        prefixes = np.zeros(n, np.uint8)
        prefixes[pairs + 1] = np.minimum(between, LENGTH - 1) + 1
        order = order[moved]
        if column < STRINGS:
            first = np.flatnonzero(prefixes < LENGTH)
            run = np.minimum.reduceat(doc[order], first)
            owner[order, column] = np.repeat(run, np.diff(np.append(first, n)))
    return owner


def pack_blocks(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """Written rows ``(block, ids, known, lengths, n_bytes, texts)`` of documents packed as they are
    read; a longer text is a block of its own."""
    narrow = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    def block(held: list) -> pa.RecordBatch:
        ids = np.array([h[0] for h in held], np.int64)
        known = np.array([h[1] for h in held], np.uint8)
        lengths = np.array([len(h[2]) for h in held], np.int64)
        texts = pack(b"".join(h[2] for h in held))
        values = [ids.tobytes(), known.tobytes(), lengths.tobytes(), int(lengths.sum()), texts]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds)],
            names=["ids", "known", "lengths", "n_bytes", "texts"],
        )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and size + len(row[2]) > sizes.block:
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield block(held)

    blocks = narrow.mapInArrow(
        fill, "ids binary, known binary, lengths binary, n_bytes long, texts binary"
    )
    # The block's number is fixed by writing it.
    return written(blocks.withColumn("block", F.monotonically_increasing_id()), "dedup-blocks")


class Block:
    """A block's arrays, read back from its row."""

    def __init__(self, row: dict, powers: Powers):
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.text = unpack(row["texts"])
        self.data = np.frombuffer(self.text, np.uint8)
        self.pieces = find_pieces(self.data, self.lengths, powers)

    @cached_property
    def classes(self) -> np.ndarray:
        """For every piece the number of one with the same bytes. Hashes only tell which pieces to
        compare; one that differs from the first of its hash stands for itself."""
        p = self.pieces
        size = p["strings"].astype(np.int64) + LENGTH - 1
        order = np.argsort(p["content"], kind="stable")
        content = p["content"][order]
        fresh = np.concatenate([[True], content[1:] != content[:-1]]) if len(order) else np.zeros(0, bool)
        heads = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        classes = np.arange(len(order))
        again = np.flatnonzero(~fresh)
        columns = np.arange(int(size.max(initial=0)))
        for low in range(0, len(again), SLICE):
            mine = order[again[low : low + SLICE]]
            head = heads[again[low : low + SLICE]]
            alike = (size[mine] == size[head]) & ((p["place"] - p["start"])[mine] == (p["place"] - p["start"])[head])
            mine, head = mine[alike], head[alike]
            inside = columns < size[mine][:, None]
            a, b = (self.data[np.minimum(p["start"][x][:, None] + columns, len(self.data) - 1)] for x in (mine, head))
            same = ((a == b) | ~inside).all(1)
            classes[mine[same]] = head[same]
        return classes


def send_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, block, keys, several)`` of every block; ``several``: in two of its documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, powers)
                key, several = block_keys(block.pieces)
                bucket = bucket_of(key, buckets)
                order = np.argsort(bucket, kind="stable")
                key, several, bucket = key[order], several[order], bucket[order]
                used, first = np.unique(bucket, return_index=True)
                cuts = [*first.tolist(), len(key)]
                spans = list(zip(cuts, cuts[1:]))
                # 48 bits a key: the low 32 bits of all, then the high 16.
                low, high = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int64()),
                        pa.array(np.full(len(used), block.number), pa.int64()),
                        pa.array([low[a:b].tobytes() + high[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "several"],
                )

    return blocks.select("block", "ids", "known", "lengths", "texts").mapInArrow(
        send, "bucket long, block long, keys binary, several binary"
    )


def answer_keys(keys: DataFrame) -> DataFrame:
    """``(bucket, block, repeated)``: one bit per sent key, whether a second document has it."""

    def answer(group: pa.Table) -> pa.Table:
        sent, flags = group["keys"].to_pylist(), group["several"].to_pylist()
        counts = [len(s) // 6 for s in sent]
        key = np.concatenate(
            [
                np.frombuffer(s, np.uint32, n).astype(np.uint64)
                | (np.frombuffer(s, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))
                for s, n in zip(sent, counts)
            ]
        )
        several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(flags, counts)])
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        again = np.zeros(len(key) + 1, bool)
        again[1:-1] = ordered[1:] == ordered[:-1]
        repeated = np.empty(len(key), bool)
        repeated[order] = again[1:] | again[:-1]
        repeated |= several.astype(bool)
        cuts = np.cumsum([0, *counts]).tolist()
        bits = [np.packbits(repeated[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table(
            [group["bucket"], group["block"], pa.array(bits, pa.binary())],
            names=["bucket", "block", "repeated"],
        )

    return keys.groupBy("bucket").applyInArrow(answer, "bucket long, block long, repeated binary")


def chosen_pieces(block: Block, answers: list[dict], buckets: int) -> np.ndarray:
    """Which pieces have a repeated minimizer."""
    key, _ = block_keys(block.pieces)
    bucket = bucket_of(key, buckets)
    repeated = np.zeros(len(key), bool)
    for answer in answers:
        mine = np.flatnonzero(bucket == answer["bucket"])
        repeated[mine] = np.unpackbits(np.frombuffer(answer["repeated"], np.uint8), count=len(mine))
    return repeated[np.searchsorted(key, block.pieces["key"])]


# A sent piece: its number in the block, its smallest id, whether the block has it under several.
HEAD = np.dtype([("number", "<i8"), ("doc", "<i8"), ("strings", "u1"), ("offset", "u1"), ("several", "u1")])


def send_pieces(asked: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, block, heads, bytes)``: the distinct repeated pieces of every block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, powers)
                found = np.flatnonzero(chosen_pieces(block, row["answers"] or [], buckets))
                if not len(found):
                    continue
                p = {name: values[found] for name, values in block.pieces.items()}
                doc = block.ids[p["doc"]]
                # Equal pieces of the block once, with the smallest id.
                classes = block.classes[found]
                order = np.lexsort((doc, classes))
                content, ids = classes[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
                last = np.append(first[1:], len(content)) - 1
                kept, least, several = order[first], ids[first], ids[first] != ids[last]
                in_text = np.argsort(kept)
                kept = kept[in_text]
                head = np.zeros(len(kept), HEAD)
                head["number"], head["doc"], head["several"] = found[kept], least[in_text], several[in_text]
                head["strings"] = p["strings"][kept]
                head["offset"] = (p["place"] - p["start"])[kept]
                start, end = p["start"][kept], (p["start"] + p["strings"])[kept] + LENGTH - 1
                bucket = bucket_of(p["key"][kept], buckets)
                order = np.argsort(bucket, kind="stable")
                used, cut = np.unique(bucket[order], return_index=True)
                heads, bodies = [], []
                for part in np.split(order, cut[1:]):
                    spans = zip(start[part].tolist(), end[part].tolist())
                    heads.append(pack_records(head[part]))
                    bodies.append(pack(b"".join([block.text[a:b] for a, b in spans])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int64()),
                        pa.array(np.full(len(used), block.number), pa.int64()),
                        pa.array(heads, pa.binary()),
                        pa.array(bodies, pa.binary()),
                    ],
                    names=["bucket", "block", "heads", "bytes"],
                )

    return asked.mapInArrow(send, "bucket long, block long, heads binary, bytes binary")


# A run of strings of a piece that smaller ids own.
OWNED = np.dtype([("number", "<i8"), ("owner", "<i8"), ("first", "u1"), ("strings", "u1")])

# Pieces laid out at a time.
SLICE = 16_384


def aligned(head: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row per piece and one column per place around the minimizer: byte + 1, or 0."""
    sizes = head["strings"].astype(np.int64) + LENGTH - 1
    ends = np.cumsum(sizes)
    begin = STRINGS - 1 - head["offset"].astype(np.int64)
    rows = np.zeros((len(head), COLUMNS), np.uint16)
    for low in range(0, len(head), SLICE):
        part = slice(low, low + SLICE)
        origin = ends[low] - sizes[low]
        piece = np.repeat(np.arange(len(sizes[part])), sizes[part])
        shift = begin[part] - (ends[part] - sizes[part] - origin)
        column = np.arange(len(piece)) + shift[piece]
        rows[part][piece, column] = data[origin : origin + len(piece)].astype(np.uint16) + 1
    return rows


def find_owners(sent: DataFrame) -> DataFrame:
    """``(block, owned)``: for pieces that can lose bytes, runs of strings with their owner."""

    def build(group: pa.Table) -> pa.Table:
        heads = [unpack_records(h, HEAD) for h in group["heads"].to_pylist()]
        counts = [len(h) for h in heads]
        head = np.concatenate(heads)
        begin = STRINGS - 1 - head["offset"].astype(np.int64)
        rows = aligned(head, np.frombuffer(b"".join(map(unpack, group["bytes"].to_pylist())), np.uint8))
        owner = owners(rows, head["doc"])
        del rows
        # Runs of strings of a piece with one owner, where some document comes after the owner.
        strings = np.arange(STRINGS)[None, :]
        real = (strings >= begin[:, None]) & (strings < (begin + head["strings"])[:, None])
        useful = real & ((owner < head["doc"][:, None]) | (head["several"][:, None] > 0))
        start = useful.copy()
        start[:, 1:] &= ~useful[:, :-1] | (owner[:, 1:] != owner[:, :-1])
        end = useful.copy()
        end[:, :-1] &= ~useful[:, 1:] | (owner[:, 1:] != owner[:, :-1])
        at, first = np.nonzero(start)
        last = np.nonzero(end)[1]
        out = np.zeros(len(at), OWNED)
        out["number"], out["owner"] = head["number"][at], owner[at, first]
        out["first"], out["strings"] = first - begin[at], last - first + 1
        cuts = np.searchsorted(at, np.cumsum([0, *counts])).tolist()
        owned = [pack_records(out[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.table([group["block"], pa.array(owned, pa.binary())], names=["block", "owned"])

    return sent.groupBy("bucket").applyInArrow(build, "block long, owned binary")


def removed_bytes(block: Block, owned: list[bytes]) -> np.ndarray:
    """Whether each byte of the block goes."""
    runs = np.concatenate([unpack_records(o, OWNED) for o in owned] or [np.zeros(0, OWNED)])
    p = block.pieces
    # A run holds for all pieces of the block with the bytes of the sent one.
    content = block.classes[runs["number"]]
    order = np.argsort(content, kind="stable")
    runs, content = runs[order], content[order]
    low = np.searchsorted(content, block.classes, "left")
    count = np.searchsorted(content, block.classes, "right") - low
    piece = np.repeat(np.arange(len(low)), count)
    run = runs[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(piece))]
    loses = block.ids[p["doc"][piece]] > run["owner"]
    start = (p["start"][piece] + run["first"])[loses]
    edges = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + run["strings"][loses] + LENGTH - 1, -1)
    return np.cumsum(edges)[:-1] > 0


def remove_repeats(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``(doc_id, n_bytes, spans array<struct<start, end>>, kept)`` of every row of
    ``docs(doc_id, text)``: removed byte spans and the remaining bytes.

    A string belongs to the smallest id among the documents it starts in; documents with a larger
    id lose its bytes, those with the same id do not. Null ids come after all others and are one
    id. Null and empty texts have no bytes; texts under 50 bytes lose none. Extra columns are
    ignored; an empty table gives no rows."""
    blocks = pack_blocks(docs, sizes)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-total // sizes.bucket))
    answers = answer_keys(send_keys(blocks, buckets))
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "repeated")).alias("answers"))
    columns = ["block", "ids", "known", "lengths", "texts"]
    # Both joins with the blocks ask for the same exchange of their texts, which Spark reuses.
    asked = blocks.select(*columns).join(answers, "block", "left").select(*columns, "answers")
    owned = find_owners(send_pieces(asked, buckets))
    owned = owned.groupBy("block").agg(F.collect_list("owned").alias("owned"))
    ready = blocks.select(*columns).join(owned, "block", "left").select(*columns, "owned")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, powers)
                gone = removed_bytes(block, row["owned"] or [])
                spans, kept = [], []
                end = 0
                for length in block.lengths.tolist():
                    begin, end = end, end + length
                    mine = gone[begin:end]
                    edges = np.flatnonzero(np.diff(mine, prepend=False, append=False)).reshape(-1, 2)
                    spans.append([{"start": a, "end": b} for a, b in edges.tolist()])
                    kept.append(block.data[begin:end][~mine].tobytes() if len(edges) else block.text[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.ids, pa.int64(), mask=~block.known),
                        pa.array(block.lengths, pa.int64()),
                        pa.array(spans, span),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return ready.mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def repeat_report(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Removed bytes, spans and a digest of the rest for every row."""
    found = remove_repeats(docs.select("doc_id", "text"), sizes)
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    zero = F.lit(0).cast("long")
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, zero, lambda total, x: total + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
