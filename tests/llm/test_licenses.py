import random
import re

from semproxy.llm import licenses
from semproxy.llm.common import index_words
from tests.llm.conftest import odd_rows

AUTOMATON = licenses.build_automaton()
RULES = licenses.Chaining()


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def phrase_places(words):
    found = []
    for number, phrase in enumerate(licenses.PHRASES):
        parts = phrase.split()
        found += [(number, i) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    return sorted(found)


def test_words_match_their_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("aZ09é漢 .-_\x00\x7f@[`{\n", k=40))
        assert [w.decode() for w in index_words(text.encode())] == plain_words(text)


def test_places_match_brute_force_on_pieces_of_templates():
    rng = random.Random(2)
    notices = [plain_words(t) for t in licenses.NOTICES.values()]
    phrases = [p.split() for p in licenses.PHRASES]
    for _ in range(1500):
        words = []
        for _ in range(rng.randint(0, 10)):
            source = rng.choice([phrases, notices])
            piece = rng.choice(source)
            i = rng.randrange(len(piece))
            words += piece[i : i + rng.randint(1, 12)] if rng.random() < 0.8 else ["zz"]
        n, places, _ = licenses.scan_text(AUTOMATON, " ".join(words).encode(), RULES)
        assert n == len(words) and sorted(places) == phrase_places(words)


def longest_suffix(words, end, substrings):
    return next((n for n in range(end + 1, 0, -1) if tuple(words[end + 1 - n : end + 1]) in substrings), 0)


def test_matching_statistics_are_the_longest_template_substrings():
    templates = [plain_words(t) for t in [*licenses.PHRASES, *licenses.NOTICES.values()]]
    substrings = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(4)
    vocabulary = sorted({w for t in templates for w in t})
    for _ in range(60):
        words = []
        while len(words) < 40:
            t = rng.choice(templates)
            i = rng.randrange(len(t))
            words += t[i : i + rng.randint(1, 10)] + rng.choices(vocabulary, k=rng.randint(0, 2))
        numbers = [AUTOMATON.words[w.encode()] for w in words]
        _, matches = AUTOMATON.run(numbers, 0, 1)
        ends = {start + length - 1: length for start, length, _ in matches}
        for end, length in ends.items():
            assert longest_suffix(words, end, substrings) == length


def test_changed_notices_are_found_and_texts_without_are_clean():
    for label, notice in licenses.NOTICES.items():
        words = plain_words(notice)
        words[len(words) // 2] = "changed"
        text = " ".join(["lorem"] * 30 + words + ["ipsum"] * 30)
        spans = licenses.scan_text(AUTOMATON, text.encode(), RULES)[2]
        best = max(spans, key=lambda s: s[3])
        assert AUTOMATON.labels[best[0]] == label and 0.6 <= best[3] < 1
        assert 30 <= best[1] <= 36 and best[2] <= 30 + len(words)
    assert licenses.scan_text(AUTOMATON, b"the terms of the house and the use of it " * 50, RULES)[1:] == ([], [])


def test_report_and_odd_rows(odd, empty, spark):
    rows = licenses.license_report(odd).collect()
    assert len(rows) == len(odd_rows())
    text = "Released under the MIT License. CC BY-NC 4.0, and once more: MIT license; " + licenses.NOTICES["bsd"]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.license_report(docs).collect()}
    assert found[1]["n_base"] == 3 and found[1]["first_word"] == 3 and found[1]["last_word"] == 13
    assert found[1]["base_labels"] == "cc-by,mit" and found[1]["labels"] == "bsd,cc-by,mit"
    assert found[1]["score"] == 1.0
    for i in (2, 3):
        assert found[i]["n_words"] == 0 and found[i]["labels"] == "" and found[i]["first_word"] is None
    assert licenses.license_report(empty).count() == 0
    assert "license" in licenses.scan_licenses(odd).columns
