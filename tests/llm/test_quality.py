import math
import random
import re
from collections import Counter

from semproxy.llm import quality
from tests.llm.conftest import original


def plain(text):
    """Counts as the definition says them, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_counts_match_their_definition():
    rng = random.Random(5)
    alphabet = ["a", "b", "é", "漢", " ", " ", "\n", "\t", "#", "|", "\x0b", "\x1c", " ", "\r"]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 120)))
        assert quality.text_features(text.encode()) == plain(text), repr(text)
    text = " ".join(rng.choices(["x", "y"], k=500))
    assert quality.text_features(text.encode()) == plain(text)


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (40, 0.01), (200, 0.002)):
        for k in (0, 1, 5, n):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
            assert math.isclose(quality.binomial_tail(k, n, p), exact, rel_tol=1e-9)


def test_cutoffs_stop_at_the_first_failed_test():
    grid = (9, 8, 7, 6)
    # 2,000 good documents, an allowed rate of 1 %: up to 8 or so rejections are proof enough.
    assert quality.choose_cutoff(grid, [0, 3, 40, 0], 2000, 0.01, 0.01) == 8.0
    assert quality.choose_cutoff(grid, [30, 30, 30, 30], 2000, 0.01, 0.01) is None
    assert quality.choose_cutoff(grid, [0, 0, 0, 0], 20, 0.01, 0.01) is None


def test_guarantee_holds_over_many_draws():
    """Cutoffs whose true rate is above the allowed one pass in at most a delta of all draws."""
    rng = random.Random(3)
    passed = sum(
        quality.choose_cutoff((1,), [sum(rng.random() < 0.02 for _ in range(400))], 400, 0.02, 0.05) is not None
        for _ in range(400)
    )
    assert passed <= 400 * 0.05 + 3 * math.sqrt(400 * 0.05)


def test_learned_rules_reject_junk_and_keep_good(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(6000):
        junk = i % 6 == 0
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(4, 8))) for _ in range(40)]
        if junk:
            words = [w + "#*" for w in words]
        rows.append((i, " ".join(words), "en", None, None))
        if i % 2:
            marks.append((i, 0 if junk else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs, labels).collect()}
    assert all(kept[i] == (i % 6 != 0) for i in range(6000))
    assert sorted(r["doc_id"] for r in quality.keep_quality(docs, labels).collect()) == sorted(i for i in kept if kept[i])


def test_odd_rows(odd, empty, labels):
    rows = quality.quality_report(odd, labels).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for row in rows:
        if row["doc_id"] is not None:
            n_words, chars, symbols, _, dup, repeats = plain(texts[row["doc_id"]])
            found = row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]
            assert found == (n_words, chars, symbols, dup, repeats)
            failed = n_words < 20 or 100 * repeats > 30 * n_words
            assert row["base_failed"] == failed and not (failed and row["kept"])
    kept = quality.keep_quality(odd, labels)
    assert kept.columns == odd.columns
    assert sum(r["kept"] for r in rows) == kept.count()
    assert {r["stratum"] for r in kept.collect()} == {"extra stratum"}
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.quality_report(odd, labels.where("false")).where("not kept").count() == sum(
        r["base_failed"] for r in rows
    )
    assert original(kept.collect()) == original([r for r in odd.collect() if quality.text_features((r["text"] or "").encode())[0] >= 20])
