"""Conversation structure repair: rank-convergence parallel Viterbi over chunks of conversations.

A repaired conversation has an optional system turn and then pairs of user and assistant. The cost
to finish from each of the four states (nothing yet, after system, user, assistant) is a vector that
goes backward over the rows. Rows are cut into chunks that start from a speculative vector at their
end; fix-up passes hand every chunk the vector its successor really has and rerun those whose vector
differed by more than a constant, each rerun only down to the row where old and new vectors agree up to
a constant. The stitched costs then drive the tracing of the least audit, chunk by chunk for every
state it may be entered in, so that a conversation with most of the rows is worked on by many tasks;
only what SHA-256 must read in order, streams through one.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semproxy.llm.common import written

# Fixed costs of the edits and of leaving a truncated text.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# Where a turn that is made user or assistant, or put in, leads.
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
DEAD = "bd"

# Turn numbers per bucket and rows per chunk.
BUCKET, CHUNK = 256, 256
NOBODY = " "
WHITE = " \t\n\x0b\x0c\r"

ORDER = ["known", "bucket", "turn", "tie", "copy"]
PLACE = ["known", "bucket", "part"]
CHUNKS = (
    "c string, known boolean, bucket long, part long, turn long, tie long, symbols string, turns long, "
    "lo long, hi long, live boolean, used array<long>, left array<long>, delta long"
)
DECIDED = "c string, known boolean, bucket long, turn long, tie long, chunk binary"
RESULT = (
    "c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)

Vector = tuple[int, int, int, int]


def closed(v: list[int]) -> list[int]:
    """Costs when turns may be put in before the next row."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant]


def before(v: Vector | list[int], symbol: str) -> list[int]:
    """The costs before a row of the two-letter ``symbol`` from those after it."""
    found = [DELETE + cost for cost in v]
    initial, fault = symbol
    if fault not in DEAD:
        extra = TRUNCATED if fault == "t" else 0
        for state in range(4):
            found[state] = min(found[state], extra + REROLE + v[MADE[state]])
            if state in KEPT.get(initial, ()):
                found[state] = min(found[state], extra + v[KEPT[initial][state]])
    return closed(found)


END: Vector = tuple(closed([0, NEVER, NEVER, 0]))


@lru_cache(100_000)
def shape_before(shape: Vector, symbol: str) -> tuple[Vector, int]:
    """A vector without its least cost, one row earlier, and that cost."""
    found = before(shape, symbol)
    least = min(found)
    return tuple(cost - least for cost in found), least


def pairs_of(symbols: str) -> list[str]:
    return [symbols[i : i + 2] for i in range(0, len(symbols), 2)]


def run_back(symbols: list[str], shape: Vector) -> tuple[Vector, int]:
    delta = 0
    for symbol in reversed(symbols):
        shape, more = shape_before(shape, symbol)
        delta += more
    return shape, delta


def rerun(symbols: list[str], old: Vector, new: Vector, left: Vector, delta: int) -> tuple[Vector, int]:
    """The chunk from the ``new`` vector at its end, given what the ``old`` one led to: only rows up
    to where both differ by a constant are run again."""
    shifted = 0
    for symbol in reversed(symbols):
        if old == new:
            break
        old, a = shape_before(old, symbol)
        new, b = shape_before(new, symbol)
        shifted += b - a
    else:
        return new, delta + shifted
    return left, delta + shifted


def trace(symbols: list[str], right: Vector, entries: tuple[int, ...]) -> dict[int, tuple[str, int]]:
    """The least audit and the state after the last row for each of the ``entries``."""
    costs = [list(right)]
    for symbol in reversed(symbols):
        costs.append(before(costs[-1], symbol))
    costs.reverse()
    found = {}
    for entry in entries:
        state, letters = entry, []
        for i, symbol in enumerate(symbols):
            now, after = costs[i], costs[i + 1]
            initial, fault = symbol
            while True:
                # In the order of their letters, the first edit on a cheapest way is taken.
                if now[state] == DELETE + after[state]:
                    letters.append("D")
                    break
                if now[state] == INSERT + now[MADE[state]]:
                    letters.append("I")
                    state = MADE[state]
                    continue
                extra = TRUNCATED if fault == "t" else 0
                kept = KEPT.get(initial, {}).get(state)
                if kept is not None and now[state] == extra + after[kept]:
                    letters.append("K")
                    state = kept
                else:
                    letters.append("R")
                    state = MADE[state]
                break
        found[entry] = ("".join(letters), state)
    return found


def internal(rows: DataFrame) -> DataFrame:
    """``(c, known, turn, tie, role, text)``: ids as strings, turns without nulls, and the order of
    rows with one turn."""
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(NOBODY)).alias("c"),
        F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.xxhash64("role", "text").alias("tie"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    return internal(rows).withColumn("copy", F.lit(0))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut off, repeated or given another role by the CRC of their key."""
    shown = F.when(F.col("known"), F.col("turn").cast("string")).otherwise(" ")
    fault = F.crc32(F.concat("c", F.lit(":"), shown).cast("binary")) % 20
    text = F.col("text")
    return (
        internal(rows)
        .withColumn("fault", fault)
        .where("fault != 0")
        .withColumn(
            "text",
            F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text),
        )
        .withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("fault")
    )


def bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.col("turn") / BUCKET))


def facts(rows: DataFrame) -> DataFrame:
    """Narrow rows ``(c, order, initial, fault)`` without their texts."""
    stripped = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    key = F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")))
    narrow = bucketed(rows).select(
        "c",
        *ORDER,
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.when(stripped == "", "b").when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), ".").otherwise("t").alias("fault"),
        key.alias("key"),
    )
    order = F.struct("known", "turn", "tie", "copy")
    repeated = (
        narrow.groupBy("c", "key")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    late = F.col("first").isNotNull() & (order > F.col("first"))
    marked = narrow.join(repeated, ["c", "key"], "left")
    return marked.select(
        "c", *ORDER, "initial", F.when(late & (F.col("fault") != "b"), "d").otherwise(F.col("fault")).alias("fault")
    )


def cut_chunks(narrow: DataFrame, chunk: int) -> DataFrame:
    """Chunks of at most ``chunk`` consecutive rows of a bucket, with their speculative pass."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        where = last = head = None
        part = turns = 0
        symbols: list[str] = []

        def finish() -> None:
            live = any(s[1] not in DEAD for s in symbols)
            left, delta = run_back(symbols, END) if live else (END, DELETE * len(symbols))
            known = where[1]
            lo, hi = (head[0], last[0]) if known else (None, None)
            out.append((*where, part, *head, "".join(symbols), turns, lo, hi, live, END, left, delta))

        for batch in batches:
            for c, known, bucket, turn, tie, copy, initial, fault in zip(*(col.to_pylist() for col in batch.columns)):
                key = (turn, tie, copy)
                if (c, known, bucket) != where:
                    if symbols:
                        finish()
                    where, part, symbols, turns, last = (c, known, bucket), 0, [], 0, None
                elif len(symbols) == chunk:
                    finish()
                    part, symbols, turns = part + 1, [], 0
                if not symbols:
                    head = (turn, tie)
                if last == key and fault != "b":
                    fault = "d"  # rows equal in all columns
                turns += bool(known and (last is None or last[0] != turn))
                symbols.append(initial + fault)
                last = key
            yield chunk_batch(out)
            out.clear()
        if symbols:
            finish()
        yield chunk_batch(out)

    placed = narrow.repartition("c", "known", "bucket").sortWithinPartitions("c", *ORDER)
    return placed.select("c", *ORDER, "initial", "fault").mapInArrow(cut, CHUNKS)


CHUNK_ARROW = pa.schema(
    [
        ("c", pa.string()), ("known", pa.bool_()), ("bucket", pa.int64()), ("part", pa.int64()),
        ("turn", pa.int64()), ("tie", pa.int64()), ("symbols", pa.string()), ("turns", pa.int64()),
        ("lo", pa.int64()), ("hi", pa.int64()), ("live", pa.bool_()), ("used", pa.list_(pa.int64())),
        ("left", pa.list_(pa.int64())), ("delta", pa.int64()),
    ]
)


def chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(CHUNK_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, CHUNK_ARROW)], schema=CHUNK_ARROW)


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """``right``: the vector after each chunk as its successor with live rows has it now (rows to be
    deleted anyway change every cost alike); ``first`` marks where a conversation begins."""
    order = Window.partitionBy("c").orderBy(*PLACE)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("live"), F.col("left")), ignorenulls=True).over(later)
    end = F.array(*[F.lit(v).cast("long") for v in END])
    return chunks.withColumn("right", F.coalesce(following, end)).withColumn("first", F.row_number().over(order) == 1)


def fix_up(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Passes until the vector every chunk was run from is, up to a constant, the one its successor
    has; every pass settles at least one more chunk of each conversation. Also the passes made."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                old, new = tuple(row["used"]), tuple(row.pop("right"))
                if row["live"] and old != new:
                    row["left"], row["delta"] = rerun(
                        pairs_of(row["symbols"]), old, new, tuple(row["left"]), row["delta"]
                    )
                    row["used"] = new
                rows.append(tuple(row.values()))
            yield chunk_batch(rows)

    passes = 0
    while True:
        joined = with_neighbours(chunks).drop("first")
        if joined.where(F.col("live") & (F.col("used") != F.col("right"))).isEmpty():
            return chunks, passes
        chunks = written(joined.mapInArrow(again, CHUNKS), "repair-chunks")
        passes += 1


def decide(chunks: DataFrame) -> DataFrame:
    """Per chunk the audits and end states for every state it may be entered in, packed for the
    stream of :func:`stitched` beside the counts of the chunk."""

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                symbols = pairs_of(row["symbols"])
                entries = (START,) if row["first"] else (START, SYSTEM, USER, ASSISTANT)
                traced = trace(symbols, tuple(row["right"]), entries)
                packed = pickle.dumps(
                    (row["symbols"], traced, row["turns"], row["lo"], row["hi"], row["live"], row["left"][START], row["delta"])
                )
                rows.append((row["c"], row["known"], row["bucket"], row["turn"], row["tie"], packed))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["c", "known", "bucket", "turn", "tie", "chunk"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

    return with_neighbours(chunks).mapInArrow(decided, DECIDED)


class Conversation:
    """What is kept of one conversation while its chunks and rows stream past."""

    def __init__(self, c: str) -> None:
        self.c, self.state, self.wide = c, START, START
        self.symbols = self.audit = None
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.illegal = self.cost = self.turns = 0
        self.lo = self.hi = self.last = None
        self.opened = False
        self.audits: list[str] = []
        self.edits: deque[str] = deque()
        self.sha, self.lines = hashlib.sha256(), 0

    def chunk(self, packed: bytes) -> None:
        import pickle

        symbols, traced, turns, lo, hi, live, left, delta = pickle.loads(packed)
        audit, self.state = traced[self.state]
        self.audits.append(audit)
        self.edits.extend(audit)
        initials = ([self.last] if self.last else []) + list(symbols[::2])
        self.illegal += sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        self.last = initials[-1]
        for fault in self.counts:
            self.counts[fault] += symbols[1::2].count(fault)
        self.turns += turns
        if lo is not None:
            self.lo, self.hi = (lo if self.lo is None else self.lo), hi
        # The costs before the first live chunk, less what the later chunks add up to.
        self.cost += delta
        if live and not self.opened:
            self.opened, self.cost = True, self.cost + left

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def put_in(self) -> None:
        self.wide = MADE[self.wide]
        self.line(ROLES[self.wide], "")

    def row(self, role: str, text: str) -> None:
        while (edit := self.edits.popleft()) == "I":
            self.put_in()
        if edit == "K":
            self.wide = KEPT[role[:1]][self.wide]
            self.line(role, text)
        elif edit == "R":
            self.wide = MADE[self.wide]
            self.line(ROLES[self.wide], text)

    def result(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.state = MADE[self.state]
            self.audits.append("I")
            self.put_in()
        gaps = self.hi - self.lo + 1 - self.turns if self.lo is not None else 0
        counts = (self.counts["b"], self.counts["d"], self.counts["t"])
        return (self.c, gaps, *counts, self.illegal, self.cost, "".join(self.audits), self.sha.hexdigest())


def stitched(rows: DataFrame, decided: DataFrame, ids: DataFrame) -> DataFrame:
    """One result per conversation of ``ids``. A chunk's decision sorts just before its rows, so its
    edits wait for them in a queue and nothing else of a conversation is held."""
    no = F.lit(None)
    wide = bucketed(rows).select("c", F.lit(1).alias("kind"), *ORDER, "role", "text", no.cast("binary").alias("chunk"))
    decisions = decided.select(
        "c", F.lit(1).alias("kind"), "known", "bucket", "turn", "tie", F.lit(-1).alias("copy"),
        no.cast("string").alias("role"), no.cast("string").alias("text"), "chunk",
    )
    marks = ids.select(
        "c", F.lit(0).alias("kind"), F.lit(False).alias("known"), *[F.lit(0).cast("long").alias(n) for n in ("bucket", "turn", "tie")],
        F.lit(0).alias("copy"), no.cast("string").alias("role"), no.cast("string").alias("text"), no.cast("binary").alias("chunk"),
    )
    stream = wide.unionByName(decisions).unionByName(marks)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        names = [field.split()[0] for field in RESULT.split(", ")]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

        for batch in batches:
            found = []
            for c, role, text, chunk in zip(*(col.to_pylist() for col in batch.columns)):
                if now is None or now.c != c:
                    if now is not None:
                        found.append(now.result())
                    now = Conversation(c)
                if chunk is not None:
                    now.chunk(chunk)
                elif role is not None:
                    now.row(role, text)
            yield batch_of(found)
        if now is not None:
            yield batch_of([now.result()])

    order = ["c", "kind", *ORDER]
    placed = stream.repartition("c").sortWithinPartitions(*order).select("c", "role", "text", "chunk")
    return placed.mapInArrow(stitch, RESULT)


def repaired(conversations: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(NOBODY)).alias("c")).distinct()
    chunks, _ = fix_up(written(cut_chunks(facts(rows), chunk), "repair-chunks"))
    found = stitched(rows, decide(chunks), ids)
    kind = conversations.schema["conv_id"].dataType
    id_: Column = F.when(F.col("c") != NOBODY, F.col("c").cast(kind)).alias("conv_id")
    return found.select(id_, *[name for name in found.columns if name != "c"])


def repair_conversations(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired turns of every conversation of
    ``conversations(conv_id, turn, role, text)``.

    Rows are ordered by turn, null turns first, rows of one turn by a hash of role and text; rows
    equal in all columns are duplicates. Null roles and texts count as one space, so such a text is
    blank and such a role has to be replaced or deleted, as every role that does not begin with s, u
    or a. Null ids are one conversation. Long conversations are cut into chunks of ``chunk`` rows;
    rows with the same 256 turn numbers pass through one task as a stream. Texts are never gathered.
    An empty table gives no rows, extra columns are ignored."""
    return repaired(conversations, undamaged(conversations), chunk)


def repair_report(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """:func:`repair_conversations` of the rows after :func:`damaged`, for every original id; a
    conversation that lost all rows has zeros, an empty audit and the hash of nothing."""
    return repaired(conversations, damaged(conversations), chunk)
