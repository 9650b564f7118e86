import random
import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semproxy.llm import mixing, quality
from semproxy.llm.common import written
from tests.llm import test_decontaminate, test_mixing, test_ngram_join, test_quality, test_sharding
from tests.llm.conftest import DOCS, invented_text, invented_words


def documents(rng):
    """Good and junk texts, near copies, benchmark passages, a hot source, nulls."""
    rows, labels = [], []
    items = [(i, " ".join(invented_words(rng, 25))) for i in range(4)]
    items.append((4, " ".join([*invented_words(rng, 9), "ΟΔΟΣ"])))  # its lower case depends on what follows
    for i in range(150):
        text = invented_text(rng, rng.randint(90 if i % 10 == 2 else 10, 120))
        kind = i % 10
        if kind == 1:
            text = "same words again " * 30
        elif kind == 2 and i > 10:
            words = rows[i - 10][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = f"{text} {rng.choice(items)[1]}{rng.choice([' ', '.', chr(39)])}{invented_text(rng, 10)}"
        elif kind == 4:
            text = " ".join(w + "#$" for w in text.split())
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", None])
        rows.append((i, text, rng.choice(["en", "fr"]), source, len(text)))
        if i % 2:
            labels.append((i, 0 if kind in (1, 4) else 1, 0))
    rows += [(200, None, None, None, None), (None, rows[5][1], "en", "a", 1), (201, rows[6][1], "en", "b", 1)]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels, items = documents(random.Random(31))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, labels, items


def kept_by_quality(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    judged = [(r, test_quality.plain(r[1])) for r in rows]
    passed = [(r, f) for r, f in judged if f[0] >= 20 and 100 * f[5] <= 30 * f[0]]

    def score(rule, f):
        n_words, chars, symbols, lines, dup, repeats = f
        return {
            "symbols": 100 * symbols / n_words, "duplicate lines": 100 * dup / max(lines, 1),
            "repeated words": 100 * repeats / n_words, "long words": chars / n_words, "short words": -chars / n_words,
        }[rule]

    strata = {r[2] or "" for r, _ in passed if r[0] in good}
    control = quality.RiskControl()
    level = control.delta / (len(strata) * len(quality.RULES))
    cuts = {}
    for stratum in strata:
        mine = [f for r, f in passed if r[0] in good and (r[2] or "") == stratum]
        for rule, (_, grid) in quality.RULES.items():
            above = [sum(score(rule, f) > c for f in mine) for c in grid]
            cuts[stratum, rule] = quality.choose_cutoff(grid, above, len(mine), control.alpha / len(quality.RULES), level)
    return [
        r for r, f in passed
        if all(cuts.get((r[2] or "", rule)) is None or score(rule, f) <= cuts[r[2] or "", rule] for rule in quality.RULES)
    ]


def mixed(rows):
    sizes, by_source = defaultdict(int), defaultdict(list)
    for i, text, _, source, _ in rows:
        n = len(test_mixing.words(text))
        sizes[source] += n
        name = str(i) if i is not None else md5((text or "").encode()).hexdigest()
        key = int(md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:15], 16)
        by_source[source].append((key, i, n, text))
    found = Counter()
    for source, target in test_mixing.fill(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS).items():
        goal = int(target + 0.5)
        whole, rest = divmod(goal, sizes[source]) if sizes[source] else (0, 0)
        for key, i, n, text in sorted(by_source[source], key=lambda x: x[0]):
            part = max(0, min(rest, n))
            rest -= n
            found[i, text] += whole + (part == n and n > 0)
            if 0 < part < n:
                end = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)][part - 1]
                found[i, text[:end]] += 1
    return Counter({k: n for k, n in found.items() if n})


def test_pipeline_matches_brute_force_stage_by_stage(spark, folder):
    path, rows, labels, items = folder
    first = kept_by_quality(rows, labels)
    classes = {i: c for i, c, _ in test_ngram_join.plain([(r[0], r[1]) for r in first])}
    second = [r for r in first if r[0] is not None and classes[r[0]] == r[0]]
    clean = {r[0] for r in test_decontaminate.plain([(r[0], r[1]) for r in second], items) if not r[5]}
    third = [r for r in second if r[0] in clean]
    assert len(rows) > len(first) > len(second) > len(third) > 50
    expected = mixed(third)

    found = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == expected
    shards = test_sharding.expected([k for k, n in expected.items() for _ in range(n)], 8)
    slots = defaultdict(list)
    for r in found:
        key = int(md5(r["text"].encode()).hexdigest()[:15], 16), r["doc_id"]
        assert r["shard"] == shards[key] and r["n_chars"] == len(r["text"])
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_return_the_columns_of_documents(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near copies", "benchmark passages", "mix to weights", "shards",
    ]
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), path)
        assert empty.columns[: len(docs.columns)] == docs.columns and empty.count() == 0


def test_stages_keep_extra_columns_of_any_name(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = ["a.b", "row", "stratum", "shard", "h", "odd name", "copy", "doc", "size"]
    wide = docs.select("*", *[F.lit(f"extra {name}").alias(name) for name in names])
    for name, stage in corpus_pipeline.STAGES:
        wide = written(stage(spark, wide, path), "wide")
        kept = [n for n in names if n != "shard" or name != "shards"]
        assert set(docs.columns) | set(kept) <= set(wide.columns)
        assert wide.select("`a.b`").distinct().collect() == [("extra a.b",)]
        assert wide.where(F.col("row") != "extra row").isEmpty()
    assert wide.count() > 50


