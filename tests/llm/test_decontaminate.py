import random
from hashlib import sha256

import pytest

from semproxy.llm import decontaminate
from tests.llm.conftest import invented_words, odd_rows
from tests.llm.test_licenses import plain_words


def plain(docs, items):
    """Every window looked for at every place."""
    result = []
    for i, text in docs:
        words = plain_words(text)
        hit, names = set(), set()
        for name, item in items:
            terms = plain_words(item)
            width = min(10, len(terms))
            for s in range(len(terms) - width + 1) if terms else ():
                for p in range(len(words) - width + 1):
                    if words[p : p + width] == terms[s : s + width]:
                        hit |= set(range(p, p + width))
                        names.add("" if name is None else str(name))
        said = sha256(",".join(sorted(names)).encode()).hexdigest()
        result.append((i, len(words), len(hit), len(names), said, bool(hit)))
    return sorted(result, key=repr)


def found(docs, items):
    columns = "doc_id n_words n_hit n_items items_sha256 contaminated".split()
    rows = decontaminate.contamination_report(docs, items).select(*columns).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    """Few different words, so that rare ones hardly exist; short, repeated and shifted items."""
    rng = random.Random(13)
    few = invented_words(rng, 12, "abc")
    items = [(i, " ".join(rng.choices(few, k=rng.randint(11, 30)))) for i in range(8)]
    items += [(20, "Ünï çødé"), (21, few[0]), (22, ""), (23, None), (None, "one two three"), (24, "Étude in ASCII"), (24, "a b")]
    docs = []
    for i in range(60):
        words = rng.choices(few, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            item = plain_words(rng.choice(items)[1])
            a = rng.randrange(len(item) + 1)
            words[rng.randrange(len(words) + 1) : 0] = item[a : a + rng.randint(5, 20)]
        docs.append((i, rng.choice([" ", "-", ", "]).join(words).upper() if i % 7 == 0 else " ".join(words)))
    docs += [(100, "étude in ascii"), (101, "étude IN ascii one two three"), (102, "Étude in ascii"), (103, "--a b"), (None, "a B"), (None, None), (104, ""), (5, docs[5][1])]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, id string, copy string")
    return docs, items, frame.repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_hits_match_brute_force(tables):
    docs, items, frame, benchmark = tables
    expected = plain(docs, items)
    assert sum(r[5] for r in expected) > 20
    assert found(frame, benchmark) == expected


@pytest.mark.parametrize("word", ["ΟΔΟΣ", "ΣΑΣ", "İΣ", "Aß"])
def test_capitals_whose_lower_case_depends_on_their_neighbours(spark, word):
    """In items and documents, before and after blanks, full stops and quotes."""
    start = "alpha beta gamma delta epsilon zeta eta theta iota"
    ends = ["", ".", "'", " ", ".Αβγ", "'Αβγ", " Αβγ", ":x", "-" + word]
    docs = [(i, f"{a}{start} {word}{end}") for i, (a, end) in enumerate((a, e) for a in ("", "Σ.", "Σ'", "Σ ") for e in ends)]
    items = [(0, f"{start} {word}"), (1, f"{start.upper()} {word}.Αβγ Σ'{word}"), (2, f"{word}'{word}.{word}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = plain(docs, items)
    assert all(r[5] for r in expected)
    assert found(frame, benchmark) == expected


def test_clean_rows_stay_with_all_columns(tables):
    docs, items, frame, benchmark = tables
    kept = decontaminate.keep_clean(frame, benchmark)
    assert kept.columns == frame.columns
    clean = sorted((r[0] for r in plain(docs, items) if not r[5]), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == clean
    assert {(r["id"], r["copy"]) for r in kept.collect()} == {("x", "y")}


def test_proximity_finds_an_inserted_word(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    filler = " ".join(["alpha delta"] * 5)
    near = item.replace("zeta", "zeta extra")
    docs = spark.createDataFrame([(1, f"{filler} {near}"), (2, f"{filler} {item}"), (3, filler)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    pairs = {tuple(r) for r in decontaminate.near_items(docs, benchmark).collect()}
    assert pairs == {(1, "7"), (2, "7")}
    assert [r["contaminated"] for r in decontaminate.contamination_report(docs, benchmark).orderBy("doc_id").collect()] == [False, True, False]


def test_odd_rows_and_empty_tables(odd, empty, tables):
    _, items, frame, benchmark = tables
    assert found(odd, benchmark) == plain([(i, t) for i, t, *_ in odd_rows()], items)
    assert decontaminate.contamination_report(empty, benchmark).count() == 0
    nothing = decontaminate.contamination_report(frame, benchmark.where("false"))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == frame.count()
    assert decontaminate.keep_clean(odd, benchmark.where("false")).count() == odd.count()


def test_no_python_runs_on_the_main_path(tables):
    _, _, frame, benchmark = tables
    plan = decontaminate.contamination_report(frame, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
