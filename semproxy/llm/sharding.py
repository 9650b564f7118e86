"""Histogram sort: shards of near equal bytes, their borders found by counting.

Rows are ordered by the key (60 bits of the text's md5, doc_id), so equal texts are neighbours. The
key is cut into digits. A pass counts the exact bytes and rows of every digit value inside the
intervals that still hold a wanted border, and so the exact bytes below every probe; the interval
around each border shrinks until the border is within its tolerance or one key is left. Then rows
are exchanged once: the borders of shards, and of equal parts inside them, say which task gets a
row, and the counted rows below them make the row numbers inside a shard gapless.

A group of equal texts is one hash. A border that falls into a group moves to the nearer edge of the
group if that is within the tolerance, so only groups too large for it are parted, by ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semproxy.llm.common import fresh, quoted, written
from semproxy.session import shuffle_partitions

HASH_BITS = 60
FIRST_BITS = 12
NEXT_BITS = 8
TOP = (1 << HASH_BITS) - 1
LARGEST = (1 << 63) - 1
SMALLEST = -(1 << 63)


# Bytes of text sorted together.
PART_BYTES = 256 * 1024 * 1024


@dataclass
class Cell:
    """An interval of keys: hashes ``[low, high]``, or ids ``[low, high]`` of one hash."""

    low: int
    high: int
    bytes_before: int
    rows_before: int
    size: int
    rows: int
    hash: int | None = None
    whole: bool = False  # all rows of one hash

    @property
    def last_key(self) -> tuple[int, int]:
        return (self.high, LARGEST) if self.hash is None else (self.hash, self.high)


@dataclass(frozen=True)
class Border:
    """Rows with a key up to ``key`` lie before the border; ``rows`` of them in all."""

    key: tuple[int, int]
    rows: int


@dataclass
class Search:
    """The cells around each target, refined pass by pass.

    ``slack`` holds, per target, the bytes by which the end of any cell and the edge of a group of
    equal texts may miss it."""

    total: int
    parts: int
    slack: dict[int, tuple[int, int]]
    cells: dict[int, Cell] = field(default_factory=dict)
    found: dict[int, Border] = field(default_factory=dict)

    def below(self, target: int, size: int) -> bool:
        """Whether ``size`` bytes do not reach the target's share of all bytes."""
        return size * self.parts < target * self.total

    def narrow(self, target: int, inside: list[Cell]) -> None:
        """Go on in the one cell of ``inside`` that crosses the target."""
        for cell in inside:
            if not self.below(target, cell.bytes_before):
                break
            crossing = cell
        short = target * self.total - crossing.bytes_before * self.parts
        long = crossing.size * self.parts - short
        loose, group = (bytes_ * self.parts for bytes_ in self.slack[target])
        at_edge = crossing.whole and min(short, long) <= group
        single = crossing.hash is not None and crossing.low == crossing.high
        if at_edge and short < long:
            self.found[target] = Border((crossing.hash - 1, LARGEST), crossing.rows_before)
        elif at_edge or single or long <= loose:
            self.found[target] = Border(crossing.last_key, crossing.rows_before + crossing.rows)
        else:
            self.cells[target] = crossing
            return
        self.cells.pop(target, None)


def size_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus one for the row itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def key_hash(text: Column) -> Column:
    """The first 15 hexadecimal digits of the md5 as a number; a null text counts as empty."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def key_id(doc_id: Column) -> Column:
    """Null ids come first."""
    return F.coalesce(doc_id.cast("long"), F.lit(SMALLEST))


def _histogram(keys: DataFrame, place: Column, *by: str) -> list:
    return (
        keys.groupBy(*by, place.alias("place"))
        .agg(
            F.sum("size").alias("size"),
            F.count("*").alias("rows"),
            F.min("h").alias("low_h"),
            F.max("h").alias("high_h"),
            F.min("d").alias("low_d"),
            F.max("d").alias("high_d"),
        )
        .orderBy(*by, "place")
        .collect()
    )


def _cells(rows: list, bits: int, around: Cell | None) -> list[Cell]:
    """Counted places in key order as cells; a cell of one hash goes on with its ids."""
    size_before = 0 if around is None else around.bytes_before
    rows_before = 0 if around is None else around.rows_before
    cells = []
    for row in rows:
        if around is not None and around.hash is not None:
            cell = Cell(row["low_d"], row["high_d"], 0, 0, 0, 0, around.hash)
        elif row["low_h"] == row["high_h"]:
            cell = Cell(row["low_d"], row["high_d"], 0, 0, 0, 0, row["low_h"], whole=True)
        else:
            cell = Cell(row["place"] << bits, ((row["place"] + 1) << bits) - 1, 0, 0, 0, 0)
        cell.bytes_before, cell.rows_before = size_before, rows_before
        cell.size, cell.rows = row["size"], row["rows"]
        size_before, rows_before = size_before + cell.size, rows_before + cell.rows
        cells.append(cell)
    return cells


def find_borders(keys: DataFrame, shards: int, parts: int, tolerance: float) -> list[Border]:
    """``parts - 1`` borders that cut ``keys(h, d, size)`` into parts of near equal bytes.

    ``parts`` is a multiple of ``shards``. A border of a shard may miss its share by ``tolerance``
    of a shard to keep a group of equal texts whole and is exact otherwise; one inside a shard may
    miss it by a twentieth of a part. The driver sees the counts of the
    probed intervals only: some hundreds per border and pass."""
    spark = keys.sparkSession
    first = _cells(
        _histogram(keys, F.shiftright("h", HASH_BITS - FIRST_BITS)), HASH_BITS - FIRST_BITS, None
    )
    if not first:
        return []
    total = sum(cell.size for cell in first)
    per_shard = parts // shards
    slack = {
        i: (0, int(tolerance * total / shards)) if i % per_shard == 0 else (total // parts // 20,) * 2
        for i in range(1, parts)
    }
    search = Search(total, parts, slack)
    for target in range(1, parts):
        search.narrow(target, first)
    while search.cells:
        distinct = {(c.hash, c.low, c.high): c for c in search.cells.values()}
        probes, numbered = [], list(distinct.values())
        for number, cell in enumerate(numbered):
            span = cell.high - cell.low + 1
            bits = max(span.bit_length() - 1 - NEXT_BITS, 0)
            by_hash = cell.hash is None
            low_h, high_h = (cell.low, cell.high) if by_hash else (cell.hash, cell.hash)
            low_d, high_d = (SMALLEST, LARGEST) if by_hash else (cell.low, cell.high)
            probes.append((number, by_hash, low_h, high_h, low_d, high_d, bits, low_h >> 48))
        # A cell lies inside one value of the first digit: an equality to join on.
        table = spark.createDataFrame(
            probes,
            "cell int, by_hash boolean, low_h long, high_h long, low_d long, high_d long, "
            "bits int, digit long",
        )
        place = F.when(F.col("by_hash"), F.expr("shiftright(h, bits)")).otherwise(
            F.expr("cast(floor((cast(d as decimal(20)) - low_d) / pow(2, bits)) as long)")
        )
        inside = (
            keys.join(F.broadcast(table), F.shiftright("h", HASH_BITS - FIRST_BITS) == F.col("digit"))
            .where(F.col("h").between(F.col("low_h"), F.col("high_h")))
            .where(F.col("d").between(F.col("low_d"), F.col("high_d")))
        )
        by_cell: dict[int, list] = {}
        for row in _histogram(inside, place, "cell"):
            by_cell.setdefault(row["cell"], []).append(row)
        refined = {
            (cell.hash, cell.low, cell.high): _cells(by_cell[number], probes[number][6], cell)
            for number, cell in enumerate(numbered)
        }
        for target, cell in list(search.cells.items()):
            search.narrow(target, refined[cell.hash, cell.low, cell.high])
    return [search.found[i] for i in range(1, parts)]


def shard_rows(docs: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (row number inside the shard, from 0).

    Shards hold near equal bytes (text plus one per row). A border lies at its exact share, that is
    before the first key with so many bytes before it, or at the nearer edge of the group of equal
    texts it falls into if that misses the share by at most ``tolerance`` of a shard. Null texts
    count as empty ones; null ids come first. Rows equal in text and id stay in one shard, in
    no fixed order. An empty table gives no rows. Existing columns named ``shard`` or ``slot`` are
    replaced, other columns are kept whatever their names."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    h, d, digit, place = fresh(docs.columns, "h", "d", "digit", "place")
    keys = written(
        docs.select(
            key_hash(F.col("text")).alias("h"),
            key_id(F.col("doc_id")).alias("d"),
            size_bytes(F.col("text")).alias("size"),
        ),
        "shard-keys",
    )
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(-(-shuffle_partitions(spark) // shards), -(-total // (shards * PART_BYTES)))
    parts = shards * per_shard
    borders = find_borders(keys, shards, parts, tolerance)
    keyed = docs.select(
        "*", key_hash(F.col("text")).alias(h), key_id(F.col("doc_id")).alias(d)
    ).withColumn(digit, F.shiftright(h, HASH_BITS - FIRST_BITS))
    if not borders:
        empty = keyed.where(F.lit(False)).select(
            *quoted(docs.columns), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")
        )
        return empty

    # One row per value of the first digit: the borders below it, and those inside it.
    inside: dict[int, list] = {}
    for border in borders:
        inside.setdefault(border.key[0] >> (HASH_BITS - FIRST_BITS), []).append(border.key)
    below, table = 0, []
    for value in range(1 << FIRST_BITS):
        table.append((value, below, inside.get(value, [])))
        below += len(inside.get(value, []))
    edges = spark.createDataFrame(table, f"{digit} long, below int, keys array<struct<h:long,d:long>>")
    passed = F.filter("keys", lambda k: k < F.struct(F.col(h).alias("h"), F.col(d).alias("d")))
    part = (F.col("below") + F.size(passed)).alias(place)
    placed = keyed.join(F.broadcast(edges), digit, "left").select(*quoted(docs.columns), h, d, part)

    starts = [0, *(border.rows for border in borders)]
    offsets = spark.createDataFrame(
        [(i, i // per_shard, starts[i] - starts[i // per_shard * per_shard]) for i in range(parts)],
        f"{place} int, shard int, start long",
    )
    window = Window.partitionBy(place).orderBy(h, d)
    numbered = placed.repartitionById(parts, F.col(place)).withColumn(
        "slot", F.row_number().over(window).cast("long") - 1
    )
    return numbered.join(F.broadcast(offsets), place).select(
        *quoted(docs.columns), "shard", (F.col("slot") + F.col("start")).alias("slot")
    )


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One narrow row per document: its size, the CRC of its text (null for a null text), its shard
    and slot. Only these columns are exchanged."""
    text = F.col("text")
    narrow = docs.select(
        "doc_id",
        "text",
        size_bytes(text).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_rows(narrow, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
