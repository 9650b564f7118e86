import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from semproxy.llm import token_counts
from semproxy.llm.queries import VOCABULARY
from tests.llm.conftest import odd_rows


@pytest.fixture(scope="module")
def counter():
    with open(VOCABULARY, "rb") as file:
        return token_counts.Counter(file.read())


@pytest.fixture(scope="module")
def whole():
    """Counts by encoding whole texts."""
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    pattern = token_counts.PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
    encoding = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def edited(text, edits):
    parts, at = [], 0
    for start, end, added in edits:
        parts += [text[at:start], added]
        at = end
    return "".join([*parts, text[at:]])


def test_edits_give_the_counts_of_a_full_encoding(counter, whole, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 4)
    rng = random.Random(3)
    pieces = ["a", "b", "ab ", "  ", " ", "\n", "'s", "1", "23", "!", "é", "　", "\x1c", "  \n ", " x"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 60)))
        tree = token_counts.TokenTree.build(counter, text)
        assert tree.tokens == whole(text)
        edits = []
        for _ in range(rng.randint(0, 4)):
            start = rng.randint(-1, len(text) + 2)
            end = start + rng.choice([0, 0, 1, 3, 10])
            edits.append({"start": start, "end": end, "text": rng.choice([None, "", " ", "b b", "\n", rng.choice(pieces) * 3])})
        tidy = token_counts.tidy_edits(edits, len(text))
        new, changed, _ = token_counts.apply_edits(counter, text, tree, tidy)
        assert new == edited(text, tidy) and changed.tokens == whole(new), (text, tidy)
        n = len(changed.leaves)
        assert all(changed.sums[i] == changed.sums[2 * i] + changed.sums[2 * i + 1] for i in range(1, n))
        # A second round of edits starts from the updated tree.
        again = token_counts.tidy_edits([{"start": 5, "end": 6, "text": "zz"}], len(new))
        last, twice, _ = token_counts.apply_edits(counter, new, changed, again)
        assert twice.tokens == whole(last)


def test_small_edits_of_long_texts_encode_little(counter):
    text = "some words of a long text " * 20_000
    tree = token_counts.TokenTree.build(counter, text)
    _, _, recut = token_counts.apply_edits(counter, text, tree, [(250_000, 250_004, "other")])
    assert recut < 1000


def test_report_and_odd_rows(odd, empty, whole):
    found = token_counts.count_report(odd, VOCABULARY).collect()
    assert len(found) == len(odd_rows())
    expected = []
    for i, text, _, source, _ in odd_rows():
        text, third = text or "", len(text or "") // 3
        edits = [(0, 0, f"{source or ''}: "), (2 * third, 2 * third + 10, None), (len(text), len(text), "\nend of text")]
        tidy = token_counts.tidy_edits([dict(zip(("start", "end", "text"), e)) for e in edits], len(text))
        new = edited(text, tidy)
        expected.append((i, whole(text), whole(new), len(new)))
    rows = [(r["doc_id"], r["tokens_before"], r["tokens"], r["n_chars"]) for r in found]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    assert token_counts.count_report(empty, VOCABULARY).count() == 0


def test_trees_survive_a_table_and_null_edits(odd, whole, tmp_path):
    path = str(tmp_path / "trees")
    token_counts.build_trees(odd.select("doc_id", "text", "leaves"), VOCABULARY).write.parquet(path)
    trees = odd.sparkSession.read.parquet(path)
    none = F.lit(None).cast(token_counts.EDITS)
    for row in token_counts.edit_trees(trees.withColumn("edits", none), VOCABULARY).collect():
        assert row["tokens"] == row["tokens_before"] == whole(row["text"]) and row["recut"] == 0
        assert np.all(np.diff(row["leaves"]) >= 0)


def test_edits_complete_contractions_at_leaf_borders(counter, whole, monkeypatch):
    text = "a" + " b" * 62 + " we'l"
    for before, added in ((text, "l"), (text[:-1] + "r", "e"), (text[:-1] + "v", "e")):
        tree = token_counts.TokenTree.build(counter, before)
        new, changed, _ = token_counts.apply_edits(counter, before, tree, [(len(before), len(before), added)])
        assert new == before + added and changed.tokens == whole(new)
    monkeypatch.setattr(token_counts, "LEAF", 2)
    rng = random.Random(17)
    pieces = ["'", "r", "l", "e", "v", "'s", "a", " ", "  ", "1", "!", " we'l", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 40)))
        tree = token_counts.TokenTree.build(counter, text)
        start = rng.randint(0, len(text))
        edit = {"start": start, "end": start + rng.choice([0, 1, 1, 2]), "text": rng.choice(["", "l", "e", "ll", "'", " "])}
        tidy = token_counts.tidy_edits([edit], len(text))
        new, changed, _ = token_counts.apply_edits(counter, text, tree, tidy)
        assert new == edited(text, tidy) and changed.tokens == whole(new), (text, tidy)
