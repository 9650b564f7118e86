"""Quality rules whose cutoffs come with a bound on the good documents they reject.

Every rule scores a document; the rule rejects scores above its cutoff. Per stratum (language) and
rule, candidate cutoffs of a fixed grid are tested in order, from the one that rejects least, on the
labelled good documents: the exact binomial probability of seeing so few false rejections, were
their rate above the allowed share, must stay below the error level. The first cutoff that fails
ends the sequence, so the grid needs no further correction; rules and strata share the error level
(Bonferroni) and the rules of a stratum share the allowed rate. With probability ``1 - delta`` no
stratum loses more than ``alpha`` of its good documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semproxy.llm.common import WHITE_SPACE, fresh, measured, plain_words, quoted, text_bytes, written

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8
FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class RiskControl:
    """``alpha``: allowed share of good documents lost per stratum; ``delta``: error level. Both are
    set before the labels are seen, which the bound needs."""

    alpha: float = 0.01
    delta: float = 0.05


# Scores per hundred words or lines; grids from the mildest cutoff to the sharpest.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("100 * n_symbols / greatest(n_words, 1)", (80, 60, 50, 40, 30, 25, 20, 15, 10, 8, 5)),
    "duplicate lines": ("100 * n_dup_lines / greatest(n_lines, 1)", (80, 70, 60, 50, 40, 30, 20)),
    "repeated words": ("100 * n_repeat_words / greatest(n_words, 1)", (25, 20, 15, 10, 8, 5)),
    "long words": ("word_chars / greatest(n_words, 1)", (40, 30, 25, 20, 18, 16, 14, 12)),
    "short words": ("-word_chars / greatest(n_words, 1)", (-1.5, -2, -2.25, -2.5, -2.75, -3, -3.25, -3.5)),
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that stand at least twice in the text."""
    if len(words) <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    named = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    # Names of windows of 2, 4 and 8 words, each from the names of its halves.
    for half in (1, 2, 4):
        pairs = named[:-half] * (int(named.max()) + 1) + named[half:]
        _, named = np.unique(pairs, return_inverse=True)
    again = np.flatnonzero(np.bincount(named)[named] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_features(text: bytes) -> tuple[int, ...]:
    words = plain_words(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, CONTINUATION + WHITE_SPACE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def features(text: Column) -> Column:
    """The counts of :data:`FEATURES` as one struct; a null text has no words."""
    names = [field.split()[0] for field in FEATURES.split(", ")]

    @F.arrow_udf(f"struct<{FEATURES.replace(' long', ':bigint')}>")
    def count(texts: pa.Array) -> pa.Array:
        rows = [text_features(text) for text in texts.to_pylist()]
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return count(text_bytes(text))


def base_failed() -> Column:
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def binomial_tail(k: int, n: int, p: float) -> float:
    """``P(X <= k)`` for ``X ~ Binomial(n, p)``, from the logarithms of its terms."""
    if k >= n:
        return 1.0
    i = np.arange(k)
    steps = np.log(n - i) - np.log(i + 1) + np.log(p) - np.log1p(-p)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def choose_cutoff(grid: tuple[float, ...], above: list[int], n: int, alpha: float, level: float):
    """The sharpest cutoff of the sequence whose tests all pass, else None.

    ``above[i]`` counts the good documents that ``grid[i]`` would reject, of ``n``."""
    chosen = None
    for cutoff, rejected in zip(grid, above):
        if binomial_tail(rejected, n, alpha) > level:
            break
        chosen = float(cutoff)
    return chosen


def scores() -> Column:
    """One array entry per rule: how many cutoffs of its grid the document is above."""
    entries = []
    for rule, (score, grid) in RULES.items():
        passed = sum((F.expr(score) > F.lit(float(c))).cast("int") for c in grid)
        entries.append(F.struct(F.lit(rule).alias("rule"), passed.alias("passed")))
    return F.array(*entries)


def cutoffs(counted: DataFrame, labels: DataFrame, control: RiskControl) -> DataFrame:
    """``(stratum, cutoffs map<rule, cutoff>)`` from all labelled good documents.

    ``counted`` has ``doc_id, stratum`` and the features. Only counts per stratum, rule and grid
    place leave the tasks. A document labelled more than once is good if any label says so."""
    good = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )
    places = (
        counted.where(~base_failed())
        .join(good, "doc_id", "left_semi")
        .select("stratum", F.explode(scores()).alias("score"))
        .groupBy("stratum", "score.rule", "score.passed")
        .agg(F.count("*").alias("n"))
    )
    places = written(places, "quality-places")
    tests = max(places.select("stratum", "rule").distinct().count(), 1)
    level, alpha = control.delta / tests, control.alpha / len(RULES)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        stratum, rule = group["stratum"].iloc[0], group["rule"].iloc[0]
        grid = RULES[rule][1]
        above = [int(group.loc[group["passed"] > i, "n"].sum()) for i in range(len(grid))]
        cutoff = choose_cutoff(grid, above, int(group["n"].sum()), alpha, level)
        return pd.DataFrame({"stratum": [stratum], "rule": [rule], "cutoff": [cutoff]})

    chosen = places.groupBy("stratum", "rule").applyInPandas(
        choose, "stratum string, rule string, cutoff double"
    )
    entries = F.map_from_entries(F.collect_list(F.struct("rule", "cutoff")))
    return chosen.where("cutoff IS NOT NULL").groupBy("stratum").agg(entries.alias("cutoffs"))


def verdict() -> Column:
    """True unless the base rules or a chosen cutoff reject the document."""
    kept = ~base_failed()
    for rule, (score, _) in RULES.items():
        cutoff = F.col("cutoffs")[rule]
        kept = kept & F.coalesce(F.expr(score) <= cutoff, F.lit(True))
    return kept


def stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def quality_report(
    docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()
) -> DataFrame:
    """Counts and verdict of every row of ``docs(doc_id, text, lang)``.

    Null and empty texts have no words and fail the base rules; a null ``doc_id`` is never
    labelled; a null ``lang`` is a stratum of its own, the one of the empty string. Repeated rows
    are judged each. Strata without a passing cutoff, and all of them without labels, keep what
    the base rules keep. Extra columns are ignored."""
    counted = written(
        docs.select("doc_id", stratum(F.col("lang")).alias("stratum"), features(F.col("text")).alias("f"))
        .select("doc_id", "stratum", "f.*"),
        "quality-features",
    )
    chosen = written(cutoffs(counted, labels, control), "quality-cutoffs")
    judged = counted.join(measured(chosen, 1000), "stratum", "left")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        verdict().alias("kept"),
    )


def keep_quality(
    docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()
) -> DataFrame:
    """The rows of ``docs`` the rules keep, with all their columns, whatever their names.

    The text is read twice: once to choose the cutoffs, once to judge each row where it stands. Null
    and empty texts have no words and go; repeated rows are judged each; null languages are one
    stratum; without labels only the base rules reject. An empty table gives no rows."""
    counted = docs.select(
        "doc_id", stratum(F.col("lang")).alias("stratum"), features(F.col("text")).alias("f")
    ).select("doc_id", "stratum", "f.*")
    counted = written(counted, "quality-features")
    chosen = written(cutoffs(counted, labels, control), "quality-cutoffs")
    row, of = fresh(docs.columns, "row", "of")
    packed = docs.select(F.struct(*quoted(docs.columns)).alias(row), features(F.col("text")).alias(of))
    judged = packed.select(
        row, stratum(F.col(row)["lang"]).alias("stratum"), F.col(f"{of}.*")
    ).join(measured(chosen, 1000), "stratum", "left")
    return judged.where(verdict()).select(f"{row}.*")
