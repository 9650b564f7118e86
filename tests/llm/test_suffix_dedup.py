import random
from hashlib import sha256

import numpy as np
import pytest

from semproxy.llm import suffix_dedup
from semproxy.llm.suffix_dedup import LENGTH, Sizes
from tests.llm.conftest import odd_rows

LAST = (1 << 63) - 1


def plain(rows):
    """Every 50-byte string belongs to the smallest id that has it."""
    owner = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, text in texts:
        i = LAST if i is None else i
        for p in range(len(text) - LENGTH + 1):
            s = text[p : p + LENGTH]
            owner[s] = min(owner.get(s, LAST), i)
    result = []
    for i, text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - LENGTH + 1):
            if owner[text[p : p + LENGTH]] < (LAST if i is None else i):
                gone[p : p + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        kept = bytes(c for c, g in zip(text, gone) if not g)
        result.append((i, len(text), sum(gone), spans, sha256(kept).hexdigest()))
    return sorted(result, key=repr)


def found(docs, sizes=Sizes()):
    return sorted((tuple(r) for r in suffix_dedup.repeat_report(docs, sizes).collect()), key=repr)


@pytest.fixture(scope="module")
def repeats():
    """Passages cut, shifted, overlapping and repeated, in texts of few letters and of many."""
    rng = random.Random(17)
    letters = ["ab", "abcdefgh é\n", "a"]
    passages = ["".join(rng.choices(rng.choice(letters), k=rng.randint(40, 300))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 60))
            parts.append(p[a : a + rng.randint(30, 200)])
            parts.append("".join(rng.choices("abcdefgh ", k=rng.randint(0, 40))))
        rows.append((rng.randrange(10_000), "".join(parts)))
    return rows + [(i + 20_000, rows[0][1]) for i in range(30)] + [(7, "x" * 49), (8, "x" * 50), (9, "x" * 5000), (10, "x" * 51)]


def test_removed_bytes_match_brute_force(spark, repeats):
    docs = spark.createDataFrame(repeats, "doc_id long, text string").repartition(6)
    expected = plain(repeats)
    assert sum(r[2] for r in expected) > 10_000
    assert found(docs) == expected
    # Many blocks and buckets give the same bytes as one.
    assert found(docs.repartition(3), Sizes(block=400, bucket=700)) == expected


def test_odd_rows(odd, empty):
    assert found(odd) == plain(odd_rows())
    assert suffix_dedup.repeat_report(empty).count() == 0


def test_spans_cut_out_the_kept_text(spark, repeats):
    docs = spark.createDataFrame(repeats, "doc_id long, text string")
    texts = {}
    for i, text in repeats:
        texts.setdefault(i, set()).add(text.encode())
    for row in suffix_dedup.remove_repeats(docs).collect():
        for text in texts[row["doc_id"]]:
            kept, at = b"", 0
            for span in row["spans"]:
                kept, at = kept + text[at : span["start"]], span["end"]
            if kept + text[at:] == bytes(row["kept"]):
                break
        else:
            raise AssertionError(row["doc_id"])


def test_equal_strings_have_equal_minimizers():
    rng = random.Random(1)
    passage = "".join(rng.choices("abc ", k=120))
    powers = suffix_dedup.Powers()
    keys = []
    for _ in range(20):
        text = ("".join(rng.choices("abc ", k=rng.randint(0, 90))) + passage).encode()
        pieces = suffix_dedup.find_pieces(np.frombuffer(text, np.uint8), np.array([len(text)]), powers)
        begin = len(text) - 120
        owner = np.repeat(pieces["key"], pieces["strings"])
        places = np.repeat(pieces["place"], pieces["strings"])
        assert len(owner) == len(text) - LENGTH + 1
        keys.append((owner[begin:].tolist(), (places[begin:] - begin).tolist()))
        assert ((places >= np.arange(len(places))) & (places <= np.arange(len(places)) + LENGTH - suffix_dedup.GRAM)).all()
    assert all(k == keys[0] for k in keys)


def test_columns_find_the_owner_of_every_string():
    rng = np.random.default_rng(4)
    rows = rng.integers(1, 3, (300, suffix_dedup.COLUMNS)).astype(np.uint16)
    rows[:, 5:] = rows[rng.integers(0, 12, 300), 5:]
    rows[::7, 60:] = 0
    doc = rng.integers(0, 1000, 300)
    owner = suffix_dedup.owners(rows, doc)
    for column in range(suffix_dedup.STRINGS):
        least = {}
        for r in range(300):
            s = rows[r, column : column + LENGTH]
            if (s > 0).all():
                least[s.tobytes()] = min(least.get(s.tobytes(), 10**9), doc[r])
        for r in range(300):
            s = rows[r, column : column + LENGTH]
            if (s > 0).all():
                assert owner[r, column] == least[s.tobytes()]


def test_equal_hashes_alone_remove_nothing(repeats):
    """With one hash for all pieces, classes still hold equal bytes only."""
    powers = suffix_dedup.Powers()
    texts = [t.encode() for _, t in repeats[:60]]
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    block = object.__new__(suffix_dedup.Block)
    block.data, block.pieces = data, suffix_dedup.find_pieces(data, lengths, powers)
    size = block.pieces["strings"].astype(int) + LENGTH - 1

    def said():
        bodies = [bytes(data[a : a + n]) for a, n in zip(block.pieces["start"].tolist(), size.tolist())]
        return [(bodies[i], bodies[head]) for i, head in enumerate(block.classes.tolist())]

    assert all(a == b for a, b in said())
    assert len(set(block.classes.tolist())) == len({a for a, _ in said()}) < len(size)
    del block.classes
    block.pieces["content"] = np.zeros_like(block.pieces["content"])
    assert all(a == b for a, b in said())

