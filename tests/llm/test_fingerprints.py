"""Fingerprints against brute force, their estimates and merging."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from semproxy.llm import fingerprints as fp
from semproxy.llm.fingerprints import Sketching
from tests.llm.conftest import DOCS, invented_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(ASCII))
    if not words:
        return set()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def bottom(sets, k):
    return sorted(hashlib.md5(s.encode()).hexdigest()[:16] for s in sets)[:k]


def likeness(a, b, k):
    union = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def expected(rows, k):
    texts = [(i, t or "") for i, t in rows]
    found = []
    for place, (doc_id, text) in enumerate(texts):
        following = texts[(place + 1) % len(texts)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = (bottom(shingles(t), k) for t in (text, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        found.append((doc_id, len(text), sha, "".join(a), "".join(b), likeness(a, b, k), likeness(a, c, k)))
    return sorted(found, key=repr)


def said(frame):
    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("k", [4, 128])
def test_report_against_brute_force(spark, odd, k):
    one_per_id = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = ordered((r["doc_id"], r["text"]) for r in one_per_id.collect())
    assert said(fp.fingerprint_report(one_per_id, Sketching(k))) == expected(rows, k)


def test_rows_of_one_id_and_null_ids(odd):
    rows = fp.fingerprint_report(odd).collect()
    assert len(rows) == odd.count()
    by_text = {}
    for r in rows:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(prints) == 1 for key, prints in by_text.items() if key[0] is not None)
    assert said(fp.fingerprint_report(odd)) == said(fp.fingerprint_report(odd.repartition(13)))


def test_parts_do_not_matter(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i * 7 - 300, " ".join(invented_words(rng, rng.randint(0, 30))), "en", "a", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    want = expected(ordered((r[0], r[1]) for r in rows), 128)
    assert said(fp.fingerprint_report(docs)) == want
    monkeypatch.setattr(fp, "PART_BYTES", 100)
    assert said(fp.fingerprint_report(docs)) == want


def test_one_row_and_empty_table(spark, empty):
    assert fp.fingerprint_report(empty).collect() == []
    alone = spark.createDataFrame([(1, "abcdefghi", "en", "a", 9)], DOCS)
    assert said(fp.fingerprint_report(alone)) == expected([(1, "abcdefghi")], 128)


def test_estimates(spark):
    rng = random.Random(5)
    words = invented_words(rng, 4000, "abcdefghijklmnop")
    pairs = [(words[:3000], words[1000:]), (words[:1000], words), (words[:30], words[10:40]), ([], words[:9]), ([], [])]
    frame = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    how = Sketching(k=512)
    frame = frame.withColumn("sa", fp.sketch(F.col("a"), how)).withColumn("sb", fp.sketch(F.col("b"), how))
    rows = frame.select(
        "i",
        fp.resemblance(F.col("sa"), F.col("sb"), how).alias("j"),
        fp.containment(F.col("sa"), F.col("sb"), how).alias("c"),
        fp.distinct_shingles(F.col("sb"), how).alias("n"),
        (fp.unpacked(fp.packed(F.col("sa"))) == F.col("sa")).alias("round_trip"),
    ).orderBy("i").collect()
    for row, (a, b) in zip(rows, pairs):
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert row["round_trip"]
        assert row["j"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0, abs=0.08)
        assert row["c"] == pytest.approx(len(x & y) / len(x) if x else 1.0, abs=0.15)
        assert row["n"] == pytest.approx(len(y), rel=0.15)


def test_merging_parts_and_groups(spark, odd):
    how = Sketching(k=16)
    prints = fp.fingerprints(odd, how)
    groups = {r["source"]: r["fingerprint"] for r in fp.merge_groups(prints, ["source"], how).collect()}
    texts = {}
    for r in odd.select("source", "text").collect():
        texts.setdefault(r["source"], set()).update(shingles(r["text"]))
    assert groups == {source: "".join(bottom(sets, 16)) for source, sets in texts.items()}
    merged = prints.select(fp.packed(fp.merged(fp.unpacked("fingerprint"), fp.unpacked(F.lit(groups["a"])), how)).alias("m"), "text")
    for r in merged.collect():
        assert r["m"] == "".join(bottom(shingles(r["text"]) | texts["a"], 16))


def test_no_python_runs_on_the_main_path(odd):
    plan = fp.fingerprint_report(odd)._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow"))


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(i, "One and the same text, twice over" if i % 2 else f"text {i}", "en", "a", 1) for i in range(10)]
    found = fp.fingerprint_report(spark.createDataFrame(rows, DOCS)).where("doc_id % 2 = 1")
    assert found.select("fingerprint").distinct().count() == 1
