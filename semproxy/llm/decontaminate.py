"""Benchmark decontamination over a distributed positional inverted index, DataFrame functions only.

Windows are ten consecutive words of a benchmark item, or all words of a shorter one. The corpus is
counted for the words of the benchmark; of every window whose words all occur, the two rarest places
are searched. Only the postings ``(term, document, place)`` of these terms are stored as the index.
A posting less its place in the item is the diagonal an occurrence would lie on; lists of the rarest
terms are intersected on (document, item, diagonal). Diagonals that pass are compared word by word,
which gives the exact windows; rare terms a few places off their distance are proximity matches.

Index and comparison cut words at the same places and fold the letters A to Z only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semproxy.llm.common import fresh, weighed, written

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Search:
    """Words per window, and how far a proximity match may be off the exact distance."""

    window: int = 10
    slop: int = 0


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exact_places(text: Column) -> Column:
    """Words in order, A-Z folded; an empty string may stand at either end."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)


def places(text: Column) -> Column:
    """:func:`exact_places`, with the quicker folding where a text is plain ASCII. Beyond ASCII it
    would not do: the lower case of some letters, as of a capital sigma, depends on their neighbours."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.octet_length(whole) == F.char_length(whole)
    return F.split(F.when(plain, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER)), SEPARATORS)


def not_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, id, copy, text)``: rows equal in id and text share a key and a result."""
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("copy"),
        "text",
    )


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """One written row per item with words; items of one id count as one in results."""
    text = F.col("text")
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        not_empty(places(text)).alias("words"),
    ).where(F.size("words") > 0)
    return written(items.distinct().withColumn("item", F.monotonically_increasing_id()), "items")


def searched_windows(items: DataFrame, rows: DataFrame, search: Search) -> DataFrame:
    """``(item, a, b)``: places in the item of the rarest and second rarest word of each window.

    Corpus counts combine before the shuffle; windows with a word the corpus lacks are left out."""
    terms = items.select("item", F.posexplode("words").alias("place", "term"))
    vocabulary = written(terms.select("term").distinct(), "vocabulary")
    found = rows.select(F.explode(places(F.col("text"))).alias("term"))
    counts = found.join(weighed(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    counted = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Every place belongs to the windows that begin up to a window before it.
    width = F.least(F.lit(search.window), F.col("size"))
    starts = F.sequence(
        F.greatest(F.lit(0), F.col("place") - width + 1), F.least(F.col("place"), F.col("size") - width)
    )
    windows = counted.join(items.select("item", F.size("words").alias("size")), "item").select(
        "item", "place", "n", F.explode(starts).alias("start")
    )
    ranked = F.sort_array(F.collect_list(F.struct("n", "place")))
    chosen = windows.groupBy("item", "start").agg(ranked.alias("r")).where(F.col("r")[0]["n"] > 0)
    second = F.get("r", F.least(F.lit(1), F.size("r") - 1))["place"]
    return written(chosen.select("item", F.col("r")[0]["place"].alias("a"), second.alias("b")).distinct(), "windows")


def stored_index(items: DataFrame, windows: DataFrame, rows: DataFrame, search: Search):
    """The written postings ``(term, id, copy, place)`` of the searched terms, and where each term
    is searched: ``(term, item, item_place, off)``."""
    first = windows.select("item", F.col("a").alias("item_place")).distinct()
    offsets = F.sequence(F.lit(-search.slop), F.lit(search.slop))
    wanted = (
        first.withColumn("off", F.explode(offsets))
        .union(windows.select("item", F.col("b").alias("item_place"), F.lit(0).alias("off")))
        .distinct()
    )
    terms = items.select("item", F.posexplode("words").alias("item_place", "term"))
    wanted = written(wanted.join(terms, ["item", "item_place"]), "searched")
    needed = written(wanted.select("term").distinct(), "searched-terms")
    postings = rows.select("id", "copy", F.posexplode(places(F.col("text"))).alias("place", "term"))
    return written(postings.join(weighed(needed), "term"), "postings"), wanted


def diagonals(index: DataFrame, wanted: DataFrame, windows: DataFrame) -> DataFrame:
    """``(id, copy, item, diagonal, exact, near)``: where the lists of a window's two rarest terms
    meet, on one diagonal or at most the slop apart."""
    shifted = index.join(weighed(wanted), "term").select(
        "id", "copy", "item",
        (F.col("place") - F.col("item_place") + F.col("off")).alias("diagonal"),
        F.struct("item_place", "off").alias("hit"),
    )
    grouped = shifted.groupBy("id", "copy", "item", "diagonal").agg(F.collect_set("hit").alias("hits"))
    # Lone hits cannot meet another one, but a window of one word is complete with it.
    pairs = written(windows.groupBy("item").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "pairs")

    def exact(pair: Column) -> Column:
        return F.exists("hits", lambda h: (h["item_place"] == pair["a"]) & (h["off"] == 0)) & F.exists(
            "hits", lambda h: (h["item_place"] == pair["b"]) & (h["off"] == 0)
        )

    def near(pair: Column) -> Column:
        return F.exists("hits", lambda h: h["item_place"] == pair["a"]) & F.exists(
            "hits", lambda h: (h["item_place"] == pair["b"]) & (h["off"] == 0)
        )

    met = grouped.join(weighed(pairs), "item").select(
        "id", "copy", "item", "diagonal",
        F.exists("pairs", exact).alias("exact"), F.exists("pairs", near).alias("near"),
    )
    return written(met.where("near"), "diagonals")


def exact_matches(met: DataFrame, items: DataFrame, rows: DataFrame, search: Search) -> DataFrame:
    """``(id, copy, matches array<struct<item_id, starts, width>>)`` of documents that contain a
    window: the diagonals are compared with the words of the text."""
    listed = (
        met.where("exact")
        .join(weighed(items.select("item", "item_id", "words")), "item")
        .groupBy("id", "copy")
        .agg(F.collect_list(F.struct("item_id", "diagonal", "words")).alias("listed"))
    )
    listed = weighed(written(listed, "listed"))
    texts = rows.join(listed, ["id", "copy"]).dropDuplicates(["id", "copy"])

    def compare(words: Column) -> Column:
        return F.transform(
            "listed",
            lambda c: F.struct(
                c["item_id"].alias("item_id"),
                c["diagonal"].alias("diagonal"),
                F.transform(c["words"], lambda w, i: F.get(words, c["diagonal"] + i).eqNullSafe(w)).alias("equal"),
            ),
        )

    # The words are an argument of the lambda, so a text is cut once and not once per diagonal.
    compared = F.transform(F.array(places(F.col("text"))), compare)[0]

    def starts(c: Column) -> Column:
        width = F.least(F.lit(search.window), F.size(c["equal"]))
        whole = F.filter(
            F.sequence(F.lit(0), F.size(c["equal"]) - width),
            lambda s: F.forall(F.slice(c["equal"], s + 1, width), lambda x: x),
        )
        return F.struct(
            c["item_id"].alias("item_id"),
            F.transform(whole, lambda s: s + c["diagonal"]).alias("starts"),
            width.alias("width"),
        )

    found = texts.select("id", "copy", compared.alias("compared")).select(
        "id", "copy", F.filter(F.transform("compared", starts), lambda m: F.size(m["starts"]) > 0).alias("matches")
    )
    return written(found.where(F.size("matches") > 0), "matches")


def searched(docs: DataFrame, benchmark: DataFrame, search: Search):
    """The keyed documents, the items and the written diagonals on which rare terms meet."""
    rows = keyed(docs)
    items = benchmark_items(benchmark)
    windows = searched_windows(items, rows, search)
    index, wanted = stored_index(items, windows, rows, search)
    return rows, items, diagonals(index, wanted, windows)


def find_matches(docs: DataFrame, benchmark: DataFrame, search: Search) -> DataFrame:
    """The written exact matches ``(id, copy, matches)`` per document that has any. Rows equal in id
    and text share one; null and empty texts, and items without words, match nothing; empty tables
    give no rows. Extra columns are ignored."""
    rows, items, met = searched(docs, benchmark, search)
    return exact_matches(met, items, rows, search)


def near_items(docs: DataFrame, benchmark: DataFrame, search: Search = Search(slop=2)) -> DataFrame:
    """Proximity matches ``(doc_id, item_id)``: the two rarest words of a window of the item stand
    in the document at their distance or at most ``slop`` places off it. Nulls, empty texts, repeated
    rows and extra columns as in :func:`contamination_report`."""
    _, items, met = searched(docs, benchmark, search)
    pairs = met.join(weighed(items.select("item", "item_id")), "item")
    own = keyed(docs).select("doc_id", "id", "copy")
    return own.join(pairs.select("id", "copy", "item_id").distinct(), ["id", "copy"]).select("doc_id", "item_id")


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, search: Search = Search()
) -> DataFrame:
    """Hit words and items of every row of ``docs(doc_id, text)`` against
    ``benchmark(item_id, text)``.

    Null and empty texts have no words, items without words no windows; an empty benchmark hits
    nothing. Rows are judged each; rows equal in id and text get equal results. Items that share an
    id count once, null ids as the empty one. Extra columns are ignored."""
    matches = find_matches(docs, benchmark, search)
    covered = F.transform(
        "matches", lambda m: F.flatten(F.transform(m["starts"], lambda s: F.sequence(s, s + m["width"] - 1)))
    )
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hits = matches.select(
        "id",
        "copy",
        F.size(F.array_distinct(F.flatten(covered))).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(ids, ",").alias("ids"),
    )
    own = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("copy"),
        count_words(F.col("text")).alias("n_words"),
    )
    joined = own.join(weighed(written(hits, "hits")), ["id", "copy"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark window, with all their columns, whatever their
    names. Null and empty texts stay, repeated rows stay or go together, null ids are judged by their
    texts; an empty benchmark keeps everything."""
    matches = find_matches(docs.select("doc_id", "text"), benchmark, search)
    id_, copy = fresh(docs.columns, "id", "copy")
    hit = matches.select(F.col("id").alias(id_), F.col("copy").alias(copy))
    own = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        copy, F.xxhash64("text")
    )
    return own.join(weighed(hit), [id_, copy], "left_anti").drop(id_, copy)
