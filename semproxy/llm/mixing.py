"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

All sources share the words of the table by weight. A source whose share passes ``max_epochs`` times
its own words is clamped there, and the excess is dealt again by weight to the others, until none is
above. Each source then takes every document a whole number of times, and the rest of its target
from its documents in a seeded order; the last document of that order is taken in part, so a source
meets its target to the word.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semproxy.llm.common import PLAIN_WORD, fresh, measured, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
# The seeded order of a source is cut into so many equal intervals of keys, those into as many.
PLACE_BITS = 8
KEY_BITS = 60
EXACT = "decimal(38,0)"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, with the white space before each word."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def seeded_order(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits that order the documents; rows without an id are told apart by their text."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def numbered_sources(sources: DataFrame) -> DataFrame:
    """``sources(source, source_size)`` with ``number``: 0, 1, ... by code point, null last.

    Rows are range partitioned and numbered inside their partition; the only window over all sees
    one row per partition."""
    order = F.col("source").asc_nulls_last()
    ranged = written(
        sources.repartitionByRange(order)
        .sortWithinPartitions(order)
        .withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    numbered = ranged.withColumn("inside", inside).join(offsets, "part")
    return numbered.select(
        "source", "source_size", (F.col("inside") + F.col("offset")).alias("number")
    )


def water_fill(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``sources`` with ``target``: its share of all words, nowhere above ``max_epochs`` times.

    Each pass is one aggregate: which sources are clamped follows from the words and weights still
    to be dealt, so only three numbers reach the driver."""
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = written(
        numbered_sources(sources).withColumn(
            "weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int"))
        ),
        "mix-weights",
    )
    cap = F.col("source_size") * max_epochs
    totals = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    everything = int(totals[0] or 0)
    words, weight, clamped = everything, int(totals[1] or 0), -1

    def above(words: int, weight: int) -> Column:
        left = F.col("weight").cast(EXACT) * F.lit(Decimal(words)).cast("decimal(30,0)")
        right = cap.cast("decimal(25,0)") * F.lit(Decimal(weight)).cast("decimal(13,0)")
        return left > right

    while True:
        over = above(words, weight)
        found = weighted.agg(
            F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)
        ).first()
        if found[2] == clamped:
            break
        clamped, words, weight = found[2], everything - int(found[0] or 0), int(found[1] or 0)
        if not weight:
            break
    share = F.col("weight") * F.lit(words).cast("double") / F.lit(max(weight, 1))
    target = F.when(above(words, weight), cap.cast("double")).otherwise(share)
    return weighted.select("source", "source_size", target.alias("target"))


def plan_mix(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One written row per source of ``sized(source, size, place)``: its target, the whole number
    of times it is taken, the interval of the seeded order in which the rest ends, and the words
    of the rest that are left for that interval."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0)
    filled = (
        water_fill(sources, weights, max_epochs)
        .withColumn("goal", goal)
        .withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.expr("goal - whole * source_size"))
    )
    filled = written(filled, "mix-targets")
    # First the coarse interval in which the rest ends, then the fine one inside it: no window
    # sees more than some hundred rows of a source.
    fine = written(sized.groupBy("source", "place").agg(F.sum("size").alias("words")), "mix-places")
    coarse = fine.groupBy("source", F.shiftright("place", PLACE_BITS).alias("place"))
    rest = filled.select(F.col("source").alias("of"), F.col("rest").alias("goal"))
    first = crossing_place(coarse.agg(F.sum("words").alias("words")), rest)
    inside = fine.join(
        first.select(F.col("of").alias("in_source"), F.col("place").alias("in_place")),
        F.col("source").eqNullSafe(F.col("in_source"))
        & (F.shiftright("place", PLACE_BITS) == F.col("in_place")),
    ).select("source", "place", "words")
    crossing = crossing_place(inside, first.select("of", F.col("left").alias("goal"))).select(
        "of", F.col("place").alias("last_place"), F.col("left").alias("left_words")
    )
    planned = filled.join(crossing, filled["source"].eqNullSafe(F.col("of")), "left").select(
        "source",
        "source_size",
        "target",
        "whole",
        F.coalesce("last_place", F.lit(-1)).alias("last_place"),
        F.coalesce("left_words", F.lit(0)).alias("left_words"),
    )
    return written(planned, "mix-plan")


def crossing_place(places: DataFrame, goals: DataFrame) -> DataFrame:
    """``(of, place, left)`` from ``places(source, place, words)`` and ``goals(of, goal)``: the place
    whose words carry the running total of the source to its goal, and the words still missing
    before it. A goal of no words has no place."""
    running = Window.partitionBy("source").orderBy("place")
    summed = places.withColumn("up_to", F.sum("words").over(running))
    joined = summed.join(measured(goals, 100), F.col("source").eqNullSafe(F.col("of")))
    before = F.col("up_to") - F.col("words")
    return joined.where((before < F.col("goal")) & (F.col("up_to") >= F.col("goal"))).select(
        "of", "place", (F.col("goal") - before).alias("left")
    )


def place_of(key: Column) -> Column:
    return F.shiftright(key, KEY_BITS - 2 * PLACE_BITS)


def apply_mix(rows: DataFrame, plan: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with the plan of their source and ``taken_part``: words beyond the whole times.

    ``names`` maps ``source, size, key, place, id`` to columns of ``rows``. Only rows in the one
    interval where the rest of their source ends are sorted."""
    source, size, place = names["source"], names["size"], names["place"]
    planned = plan.withColumnRenamed("source", "of_source")
    joined = rows.join(measured(planned, 200), F.col(source).eqNullSafe(F.col("of_source")))
    before_end = joined.where(F.col(place) != F.col("last_place")).withColumn(
        "taken_part", F.when(F.col(place) < F.col("last_place"), F.col(size)).otherwise(F.lit(0))
    )
    running = (
        Window.partitionBy(source)
        .orderBy(names["key"], names["id"], size)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum(size).over(running), F.lit(0))
    left = F.greatest(F.col("left_words") - before, F.lit(0))
    at_end = joined.where(F.col(place) == F.col("last_place")).withColumn(
        "taken_part", F.least(left, F.col(size))
    )
    return before_end.unionByName(at_end)


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Words, target and taken words of every row of ``docs(doc_id, source, text)``.

    Null and empty texts have no words and take none; null sources are one source, the last; null
    ids are ordered by their text. Repeated rows count and are taken each; which of several equal
    rows is the cut one is left open. Extra columns are ignored; an empty table gives no rows."""
    key = seeded_order(F.col("doc_id"), F.col("text"), seed)
    sized = written(
        docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("key"))
        .withColumn("place", place_of(F.col("key"))),
        "mix-sizes",
    )
    names = {"source": "source", "size": "size", "key": "key", "place": "place", "id": "doc_id"}
    mixed = apply_mix(sized, plan_mix(sized), names)
    taken = F.col("size") * F.col("whole") + F.col("taken_part")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them, with the same columns: one row per whole repetition, and
    the cut beginning of a document where a target ends inside it (``n_chars`` follows the cut).

    Nulls, ties and empty tables as in :func:`mix_report`; a document without words is left out."""
    size, key, place, piece = fresh(
        [*docs.columns, "of_source", "taken_part", "whole", "last_place", "left_words", "target",
         "source_size"],
        "size", "key", "place", "piece",
    )
    inner = {name: fresh_name for name, fresh_name in zip(docs.columns, fresh(
        ["of_source", "taken_part", "whole", "last_place", "left_words", "target", "source_size",
         size, key, place, piece], *[f"doc_{i}" for i in range(len(docs.columns))]))}
    rows = docs.select([F.col(f"`{name}`").alias(new) for name, new in inner.items()])
    text, doc_id, source = (F.col(inner[name]) for name in ("text", "doc_id", "source"))
    sized = rows.withColumn(size, count_words(text)).withColumn(
        key, seeded_order(doc_id, text, seed)
    ).withColumn(place, place_of(F.col(key)))
    narrow = written(
        sized.select(source.alias("source"), F.col(size).alias("size"), F.col(place).alias("place")),
        "mix-sizes",
    )
    names = {"source": inner["source"], "size": size, "key": key, "place": place, "id": inner["doc_id"]}
    mixed = apply_mix(sized, plan_mix(narrow), names)
    # A piece is a number of words; whole repetitions take all of them.
    whole = F.col("whole") + (F.col("taken_part") == F.col(size)).cast("long")
    cut = (F.col("taken_part") > 0) & (F.col("taken_part") < F.col(size))
    pieces = F.concat(
        F.array_repeat(F.col(size), whole.cast("int")),
        F.when(cut, F.array("taken_part")).otherwise(F.array().cast("array<bigint>")),
    )
    taken = mixed.where(F.col(size) > 0).withColumn(piece, F.explode(pieces))
    is_cut = F.col(piece) < F.col(size)
    out = []
    for name, new in inner.items():
        column = F.col(new)
        if name == "text":
            column = F.when(is_cut, first_words(text, F.col(piece))).otherwise(text)
        elif name == "n_chars":
            shorter = F.char_length(first_words(text, F.col(piece)))
            column = F.when(is_cut, shorter.cast(docs.schema[name].dataType)).otherwise(column)
        out.append(column.alias(name))
    return taken.select(out)
