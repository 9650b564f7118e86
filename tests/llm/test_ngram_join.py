import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from semproxy.llm import ngram_join
from semproxy.llm.common import WordHashes
from tests.llm.conftest import invented_words, odd_rows, original

LAST = (1 << 63) - 1


def grams(text, n=5):
    words = [w for w in text.split()]
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def plain(rows, threshold=0.8):
    """Class and number of links of every row, from all pairs that share an n-gram."""
    texts = defaultdict(list)
    for i, text in rows:
        texts[text or ""].append(LAST if i is None else i)
    names = list(texts)
    sets = [grams(" ".join(w.decode() for w in ngram_join.index_words(t.encode()))) for t in names]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    parent, links = list(range(len(names))), Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for other, n in Counter(o for g in s for o in holders[g] if o > k).items():
            if n >= threshold * (len(s) + len(sets[other]) - n) - 1e-9:
                links[k] += len(texts[names[other]])
                links[other] += len(texts[names[k]])
                parent[top(k)] = top(other)
    least = {}
    for k, t in enumerate(names):
        least[top(k)] = min(least.get(top(k), LAST), *texts[t])
    return sorted(
        ((i, least[top(names.index(t or ""))], links[names.index(t or "")] + len(texts[t or ""]) - 1) for i, t in rows),
        key=repr,
    )


def found(docs, join=ngram_join.Join()):
    rows = ngram_join.join_report(docs, join).collect()
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def near(spark):
    """Copies with up to 16 changed words of 120, chains of them, exact copies, short texts."""
    rng = random.Random(21)
    rows = []
    for group in range(12):
        words = invented_words(rng, 120)
        for member in range(rng.randint(1, 9)):
            changed = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                changed[rng.randrange(120)] = "".join(rng.choices("xyz", k=5))
            rows.append((100 * group + member, " ".join(changed)))
            if rng.random() < 0.3:
                words = changed
    rows += [(5000 + i, "two words") for i in range(3)] + [(6000, "two"), (6001, "words"), (6002, "Two Words!")]
    return rows


def test_banding_reaches_its_recall():
    join = ngram_join.Join()
    bands, rows = join.banding
    assert bands * rows <= join.hashes
    assert 1 - (1 - 0.8**rows) ** bands >= join.recall
    assert ngram_join.Join(recall=0.9).banding[1] >= rows


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    join = ngram_join.Join()
    factors, offsets = ngram_join.permutations(join)
    hits = 0
    for _ in range(200):
        shared = rng.integers(0, 1 << 63, 400, np.uint64)
        a = np.concatenate([shared, rng.integers(0, 1 << 63, 50, np.uint64)])
        b = np.concatenate([shared, rng.integers(0, 1 << 63, 50, np.uint64)])
        hits += (ngram_join.band_hashes(a, join.banding, factors, offsets) == ngram_join.band_hashes(b, join.banding, factors, offsets)).any()
    assert hits >= 199


def test_links_and_classes_match_all_pairs(spark, near):
    docs = spark.createDataFrame(near, "doc_id long, text string").repartition(4)
    expected = plain(near)
    assert len({c for _, c, _ in expected}) < len(near) - 20
    assert found(docs) == expected
    # Tiles of a large block give the same links as one task.
    assert found(docs, ngram_join.Join(tile_texts=3)) == expected
    assert found(docs, ngram_join.Join(tile_grams=300)) == expected


def test_one_row_per_class_stays(spark, near):
    docs = spark.createDataFrame([(*r, "x", "y") for r in near], "doc_id long, text string, row string, number string")
    kept = ngram_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in plain(near)})


def test_a_large_group_of_near_copies_yields_no_pairs(spark):
    rng = random.Random(3)
    words = invented_words(rng, 80)
    rows = []
    for i in range(700):
        changed = list(words)
        changed[rng.randrange(80)] = f"w{i}"
        rows.append((i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    report = found(docs, ngram_join.Join(tile_texts=200))
    assert report == plain(rows)
    assert {c for _, c, _ in report} == {0}


def test_odd_rows(odd, empty):
    assert found(odd) == plain([(i, t) for i, t, *_ in odd_rows()])
    kept = ngram_join.keep_one_per_class(odd)
    assert kept.columns == odd.columns
    texts = [t for _, t in original(kept.collect())]
    assert len(texts) == len({t or "" for t in texts})
    assert ngram_join.join_report(empty).count() == 0 and ngram_join.keep_one_per_class(empty).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    edges = spark.createDataFrame(pairs, "a long, b long")
    roots = {r["node"]: r["root"] for r in ngram_join.connected(edges).collect()}
    assert roots == {x: top(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}


def test_words_share_the_index_folding():
    one = ngram_join.text_grams(b"One, two THREE four five six", 5, WordHashes())
    two = ngram_join.text_grams(b"one two three four five six", 5, WordHashes())
    assert (one == two).all() and len(one) == 2
