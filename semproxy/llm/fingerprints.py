"""Document fingerprints: bottom-k sketches of hashed word shingles, DataFrame functions only.

A sketch is the sorted array of the k smallest hashes of a text's shingles (16 hexadecimal digits
each; fewer than k when the text has fewer shingles, and then it is the exact set). The k smallest
hashes of a union are among those of its parts, so sketches merge, across the parts of a text as well
as over whole groups of documents, and estimate resemblance, containment and distinct shingles.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semproxy.llm.common import fresh, written
from semproxy.llm.decontaminate import exact_places, not_empty
from semproxy.session import shuffle_partitions

# Hexadecimal digits of a hash, and of them those that a double holds exactly.
DIGITS, COUNTED = 16, 13

# Bytes of text that one part of the order by id holds.
PART_BYTES = 64 * 1024 * 1024
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Sketching:
    """Hashes kept per sketch, and words per shingle; a shorter text is one shingle."""

    k: int = 128
    words: int = 5


def sketch(text: Column, how: Sketching = Sketching()) -> Column:
    """The sketch of a text as ``array<string>``; null and wordless texts have an empty one.

    Words are as in the other operators on shingles: letters, digits and everything beyond ASCII,
    A-Z folded. Whole texts are read; repeated shingles count once."""

    def hashes(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - how.words + 1))
        shingles = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, how.words)))
        return F.when(F.size(words) > 0, F.transform(shingles, lambda s: F.substring(F.md5(s), 1, DIGITS)))

    # As the argument of a lambda the words are cut once and not once per use.
    cut = F.transform(F.array(not_empty(exact_places(text))), hashes)[0]
    return smallest(F.coalesce(cut, F.array().cast("array<string>")), how)


def smallest(hashes: Column, how: Sketching) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, how.k)


def merged(a: Column, b: Column, how: Sketching = Sketching()) -> Column:
    """The sketch of the union of what ``a`` and ``b`` were made of."""
    return smallest(F.concat(a, b), how)


def packed(hashes: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(hashes, "")


def unpacked(fingerprint: Column) -> Column:
    """The sketch in a string of :func:`packed`."""
    starts = F.sequence(F.lit(1), F.length(fingerprint) - DIGITS + 1, F.lit(DIGITS))
    pieces = F.transform(starts, lambda i: F.substring(fingerprint, i, F.lit(DIGITS)))
    return F.when(F.length(fingerprint) > 0, pieces).otherwise(F.array().cast("array<string>"))


def distinct_shingles(hashes: Column, how: Sketching = Sketching()) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    kth = F.conv(F.substring(hashes[how.k - 1], 1, COUNTED), 16, 10).cast("double")
    estimate = F.lit(how.k - 1.0) * F.lit(float(16**COUNTED)) / F.greatest(kth, F.lit(1.0))
    return F.when(F.size(hashes) < how.k, F.size(hashes).cast("double")).otherwise(estimate)


def shared(union: Column, a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(union, a), b))


def resemblance(a: Column, b: Column, how: Sketching = Sketching()) -> Column:
    """Estimated Jaccard likeness, 0 to 1: the share of the union's sketch that both hold. Two
    empty sketches are alike (1), an empty and another one are not (0)."""

    def share(union: Column) -> Column:
        return F.when(F.size(union) == 0, 1.0).otherwise(shared(union, a, b) / F.size(union))

    return F.transform(F.array(merged(a, b, how)), share)[0]


def containment(a: Column, b: Column, how: Sketching = Sketching()) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has as well, 0 to 1; an empty ``a`` is
    contained in everything."""

    def share(union: Column) -> Column:
        both = shared(union, a, b) / F.size(union) * distinct_shingles(union, how)
        return F.least(F.lit(1.0), both / distinct_shingles(a, how))

    return F.when(F.size(a) == 0, 1.0).otherwise(F.transform(F.array(merged(a, b, how)), share)[0])


def fingerprints(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """``docs`` with their ``fingerprint`` (a column of that name is replaced), one narrow pass.

    Null texts count as empty and have the empty fingerprint; equal texts have equal ones."""
    return docs.withColumn("fingerprint", packed(sketch(F.col("text"), how)))


def merge_groups(prints: DataFrame, groups: list[str], how: Sketching = Sketching()) -> DataFrame:
    """One ``fingerprint`` for each of the ``groups`` of a table with fingerprints.

    Repeated hashes of a group combine before and after one exchange by (group, hash), and each task
    passes on only its k smallest per group, so that a group with most of the rows stays spread.
    Null groups are groups; a null fingerprint counts as empty; other columns are ignored."""
    (name,) = fresh(groups, "h")
    hashes = prints.select(
        *groups, F.explode_outer(unpacked(F.coalesce("fingerprint", F.lit("")))).alias(name)
    ).distinct()
    ranked = hashes.withColumn(
        f"{name}_place", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(name).asc_nulls_last()))
    ).where(F.col(f"{name}_place") <= how.k)
    return ranked.groupBy(*groups).agg(packed(F.sort_array(F.collect_list(name))).alias("fingerprint"))


def order_key() -> Column:
    """Ascending where ids descend, null ids last; rows of one id in the order of a text hash."""
    falling = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(LAST))
    return F.struct(falling.alias("o"), F.xxhash64("text").alias("h"))


def first_keys(keys: DataFrame, parts: int) -> list[tuple[int, int]]:
    """The first key of every non-empty part of a range partitioning of the narrow ``keys``; rows
    of one key lie in one part."""
    ranged = keys.repartitionByRange(parts, "o", "h").select(
        F.struct("o", "h").alias("key"), F.spark_partition_id().alias("part")
    )
    found = ranged.groupBy("part").agg(F.min("key").alias("key")).collect()
    return sorted((row["key"]["o"], row["key"]["h"]) for row in found)


def passed(borders: list[tuple[int, int]], key: Column) -> Column:
    """How many ``borders`` are at or below ``key``: first among every g-th one, then among g."""
    g = max(1, round(len(borders) ** 0.5))
    groups = [[{"o": o, "h": h} for o, h in borders[i : i + g]] for i in range(0, len(borders), g)]
    listed = F.from_json(F.lit(json.dumps(groups)), "array<array<struct<o:long,h:long>>>")
    earlier = F.size(F.filter(listed, lambda group: group[0] <= key)) - 1
    inside = F.transform(
        F.array(F.get(listed, earlier)), lambda group: F.size(F.filter(group, lambda b: b <= key))
    )[0]
    return (earlier * g + F.coalesce(inside, F.lit(0))).cast("int")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``next_<c>`` for each of ``columns``: the value in the next
    document by descending ids, after the last one the first.

    The narrow keys are range partitioned first; the rows then go to the part of their key in one
    exchange, and the first rows of a part also to the part before it, so that no order spans parts."""
    spark = docs.sparkSession
    keys = written(
        docs.select(order_key().alias("key"), F.octet_length("text").alias("size")).select("key.*", "size"),
        "order-keys",
    )
    size = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    borders = first_keys(keys, parts)
    if not borders:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    n = len(borders)
    placed = docs.withColumn("_key", order_key()).withColumn("_part", passed(borders, F.col("_key")) - 1)
    starts = F.from_json(
        F.lit(json.dumps([{"o": o, "h": h} for o, h in borders])), "array<struct<o:long,h:long>>"
    )
    # The copy for the part before sorts after all rows of that part, in the last part too.
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("copy"))
    ahead = F.struct(((F.col("_part") + (n - 1)) % n).alias("part"), F.lit(1).alias("copy"))
    is_first = F.col("_key") == F.get(starts, F.col("_part"))
    dealt = placed.withColumn("_at", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))))
    dealt = dealt.withColumn("_bucket", F.col("_at.part")).repartitionById(n, F.col("_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_at.copy", "_key")
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(F.col("_at.copy") == 0).drop("_key", "_part", "_at", "_bucket")


def fingerprint_report(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, whose last third of code points is
    replaced by the first as many of the next document by descending ids (after the last the first).

    Null texts count as empty; an empty or wordless text has the empty fingerprint, which is like
    itself only. Texts of fewer than three code points stay as they are. Null ids come last, rows of
    one id are ordered by a hash of their text, equal rows follow each other. A table of one row is
    its own next document; an empty table gives no rows. Extra columns are ignored."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"), how)), ["text", "sketch"])
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), how))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sketch")).alias("fingerprint"),
        packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), how).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), how).alias("near_next"),
        distinct_shingles(F.col("sketch"), how).alias("n_shingles"),
    )
