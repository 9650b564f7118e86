"""Records of quoted text files whose values may span lines, read in blocks of any place.

Whether a line break ends a record depends on all quotes before it, but only on whether their number
is odd. So every block of a file first tells the parity of its quotes and how many records it ends for
either parity before it; prefix sums over the blocks give the true parity and the number of the first
record of each block; and then every block cuts its lines into records from its first true record on.
The parts of a record that several blocks share are put together by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semproxy.operators.prefix import running_totals
from semproxy.session import BROADCAST_BYTES, small, written

QUOTE = '"'
BLOCKS = "file string, block long, odd int, ends_even long, ends_odd long, blank_even long, blank_odd long"
PARTS = "file string, block long, number long, earlier long, text string, whole boolean"

# White space of which a record that is skipped may consist.
BLANKS = "".join(map(chr, range(0x21)))

# Bytes of one row of the block table, file name included.
BLOCK_BYTES = 1000


def file_order(path: Column) -> list[Column]:
    """Files in the order of the numbers in their names: part-100000 comes after part-99999."""
    name = F.element_at(F.split(path, "/"), -1)
    digits = F.transform(F.regexp_extract_all(name, F.lit("([0-9]+)")), lambda d: F.lpad(d, 20, "0"))
    return [digits, path]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line)``: lines as they stand, in order within a block."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").alias("line"),
        )
    )


def count_blocks(lines: DataFrame) -> DataFrame:
    """One row per block: the parity of its quotes, and for an even and an odd number of quotes
    before it the records that end in it, and those of them that hold nothing but white space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        odd, ends, blank, filled = 0, [0, 0], [0, 0], [False, False]
        found: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            names = [field.split()[0] for field in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for file, block, line in zip(*(column.to_pylist() for column in batch.columns)):
                if (file, block) != now:
                    if now is not None:
                        found.append((*now, odd, *ends, *blank))
                    now, odd, ends, blank = (file, block), 0, [0, 0], [0, 0]
                    filled = [False, True]  # a record begun in an earlier block has its quote
                has_text = bool(line.strip(BLANKS))
                odd ^= line.count(QUOTE) & 1
                for before in (0, 1):
                    filled[before] |= has_text
                    if odd ^ before == 0:
                        ends[before] += 1
                        blank[before] += not filled[before]
                        filled[before] = False
            yield batch_of()
            found.clear()
        if now is not None:
            found.append((*now, odd, *ends, *blank))
        yield batch_of()

    return lines.mapInArrow(count, BLOCKS)


def numbered_blocks(blocks: DataFrame, heads: int) -> DataFrame:
    """``(file, block, inside, first, earlier)``: whether a block begins inside a quoted value, the
    number of its first record in the file, and the records of earlier files without the ``heads``
    first ones of each; records without text do not count.

    Prefix sums at two levels: over the blocks of a file, then over ranges of the files. A file with
    an odd number of quotes is an error."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before) % 2 == 1, F.lit(False))
    ends = F.when(F.col("inside"), F.col("ends_odd") - F.col("blank_odd")).otherwise(F.col("ends_even") - F.col("blank_even"))
    counted = blocks.withColumn("inside", inside).withColumn("records", ends)
    numbered = written(counted.withColumn("first", F.coalesce(F.sum("records").over(before), F.lit(0))), "blocks")
    files = numbered.groupBy("file").agg(
        (F.sum("odd") % 2).alias("odd"), F.greatest(F.sum("records") - heads, F.lit(0)).alias("rows")
    )
    uneven = files.where("odd = 1").limit(1).collect()
    if uneven:
        raise ValueError(f"a quoted value does not end in {uneven[0]['file']}")
    summed = running_totals(files.drop("odd"), file_order(F.col("file")), ["rows"])
    earlier = summed.select("file", (F.col("run_rows") - F.col("rows")).alias("earlier"))
    return written(numbered.join(earlier, "file").select("file", "block", "inside", "first", "earlier"), "blocks")


def cut_records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``(file, number, earlier, text)``: the records of the numbered blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, number, held, filled = None, 0, 0, [], False
        found: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            names = [field.split()[0] for field in PARTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

        def add(whole: bool) -> None:
            file, block, earlier = now
            found.append((file, block, number, earlier, "\n".join(held), whole))

        for batch in batches:
            for file, block, line, inside, first, earlier in zip(*(column.to_pylist() for column in batch.columns)):
                if now is None or (file, block) != now[:2]:
                    if held:
                        add(False)
                    now, odd, number, held = (file, block, earlier), int(inside), first, []
                    filled, begun = inside, inside
                filled |= bool(line.strip(BLANKS))
                held.append(line)
                odd ^= line.count(QUOTE) & 1
                if not odd:
                    held[-1] = held[-1].removesuffix("\r")
                    if filled:
                        add(not begun)
                        number += 1
                    held, filled, begun = [], False, False
            yield batch_of()
            found.clear()
        if held:
            add(False)
        yield batch_of()

    count = starts.count()
    numbered = lines.withColumn("line_number", F.monotonically_increasing_id())
    joined = numbered.join(small(starts, count, BLOCK_BYTES), ["file", "block"])
    if count * BLOCK_BYTES > BROADCAST_BYTES:  # a shuffle has mixed the lines
        joined = joined.repartition("file", "block").sortWithinPartitions("file", "block", "line_number")
    parts = joined.select("file", "block", "line", "inside", "first", "earlier").mapInArrow(cut, PARTS)
    parts = written(parts, "records")
    whole = parts.where("whole").select("file", "number", "earlier", "text")
    # Few records lie in several blocks; their parts follow each other by block.
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda part: part["text"])
    pieces = parts.where("NOT whole").groupBy("file", "number").agg(
        F.first("earlier").alias("earlier"), F.array_join(texts, "\n").alias("text")
    )
    return whole.unionByName(pieces)


def read_records(spark: SparkSession, path: str, heads: int = 1) -> DataFrame:
    """``(row_index, number, text)`` of every record: its 0-based place among those of all files in
    order, without the ``heads`` first records of each file, which have numbers below ``heads`` and
    no place."""
    lines = lines_of(spark, path)
    starts = numbered_blocks(count_blocks(lines), heads)
    records = cut_records(lines, starts)
    place = F.when(F.col("number") >= heads, F.col("earlier") + F.col("number") - heads)
    return records.select("file", place.alias("row_index"), "number", "text")
