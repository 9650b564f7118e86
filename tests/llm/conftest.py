import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside; as columns of a caller's table they must not get in the way.
CLASHES = (
    "shard slot h d digit place size key piece of_source taken_part whole last_place target id copy "
    "row digest number license leaves sums edits stratum cutoffs kept block known"
).split()


def invented_words(rng, count, alphabet="abcdefghij"):
    return ["".join(rng.choices(alphabet, k=rng.randint(2, 6))) for _ in range(count)]


def invented_text(rng, words=60):
    parts = invented_words(rng, words)
    return "".join(w + ("\n" if rng.random() < 0.15 else " ") for w in parts).strip()


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, white space only."""
    rng = random.Random(11)
    passage = invented_text(rng, 40)
    rows = []
    for i in range(40):
        text = invented_text(rng, rng.randint(1, 120))
        if i % 4 == 0:
            text = f"{text}\n{passage}\n{invented_text(rng, 10)}"
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), len(text)))
    rows += [(100 + i, rows[3][1], "en", "a", 5) for i in range(6)]  # copies
    rows += [rows[5], rows[5]]  # repeated rows
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n ", "fr", "b", 4)]
    rows += [(None, rows[7][1], "en", "a", 1), (None, None, None, None, None), (None, "word", "en", "b", 4)]
    rows += [(203, invented_text(rng, 20_000), "en", "a", 9), (204, "Ünï çødé 漢字 \x00 x", "de", "é", 3)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS).repartition(5)
    return docs.withColumns({name: F.lit(f"extra {name}") for name in CLASHES}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1 if i % 5 else 0, 0) for i in range(0, 40)] + [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def original(rows):
    """Rows as comparable tuples of the plain columns."""
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)
