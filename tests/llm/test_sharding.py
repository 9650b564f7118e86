import zlib
from collections import defaultdict
from hashlib import md5

import pytest

from semproxy.llm import sharding
from tests.llm.conftest import odd_rows


def expected(rows, shards, tolerance=0.02):
    """Shard of each key by byte shares in the order of (hash, id); borders inside a group of equal
    texts move to its nearer edge if that is near enough."""
    sizes = defaultdict(int)
    for i, t, *_ in rows:
        text = (t or "").encode()
        sizes[int(md5(text).hexdigest()[:15], 16), -(1 << 63) if i is None else i] += len(text) + 1
    total, before, groups, first = sum(sizes.values()), 0, {}, {}
    for key in sorted(sizes):
        first[key] = before
        low, _ = groups.get(key[0], (before, 0))
        before += sizes[key]
        groups[key[0]] = (low, before)
    marks = []
    for border in range(1, shards):
        share = border * total
        low, high = next(g for g in groups.values() if g[0] * shards < share <= g[1] * shards)
        short, long = share - low * shards, high * shards - share
        near = int(tolerance * total / shards) * shards
        marks.append(share if min(short, long) > near else low * shards if short < long else high * shards)
    return {key: sum(first[key] * shards >= mark for mark in marks) for key in sizes}


@pytest.mark.parametrize("shards, tolerance", [(3, 0.0), (8, 0.0), (3, 0.3), (8, 0.02)])
def test_borders_meet_their_shares_and_slots_have_no_gaps(odd, shards, tolerance):
    rows = sharding.shard_rows(odd, shards, tolerance).collect()
    assert len(rows) == odd.count()
    exact = expected(odd_rows(), shards, tolerance)
    slots = defaultdict(list)
    for row in rows:
        h = int(md5((row["text"] or "").encode()).hexdigest()[:15], 16)
        key = h, -(1 << 63) if row["doc_id"] is None else row["doc_id"]
        assert row["shard"] == exact[key]
        slots[row["shard"]].append((row["slot"], key))
        assert row["h"] == "extra h" and row["size"] == "extra size"
    for found in slots.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found)))
        assert [k for _, k in found] == sorted(k for _, k in found)


def test_tolerance_lets_borders_miss_by_a_share(odd):
    rows = sharding.shard_report(odd, 2).collect()
    sizes = sum(r["size"] for r in rows)
    loose = sharding.shard_rows(odd.select("doc_id", "text"), 2, tolerance=0.2).collect()
    parts = [sum(len((r["text"] or "").encode()) + 1 for r in loose if r["shard"] == s) for s in (0, 1)]
    assert sum(parts) == sizes
    longest = max(r["size"] for r in rows)
    assert abs(parts[0] - sizes / 2) <= max(0.2 * sizes / 2, longest)


def test_small_groups_of_equal_texts_stay_whole(spark):
    rows = [(i, f"a text of group {i // 5}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["shard"] for r in sharding.shard_report(docs, 8).collect()}
    assert all(found[i] == found[i - i % 5] for i in range(5000)) and len(set(found.values())) == 8


def test_one_text_with_most_rows_is_parted_by_id(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = defaultdict(int)
    for row in sharding.shard_report(docs, 8).collect():
        sizes[row["shard"]] += row["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 60


def test_report_columns_and_empty_table(odd, empty):
    rows = sharding.shard_report(odd).collect()
    for row in rows:
        assert row["law"] == "bytes" and row["grown_shard"] is None
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[200]["size"] == 1 and by_id[200]["text_crc32"] is None
    assert by_id[201]["size"] == 1 and by_id[201]["text_crc32"] == 0
    text = next(t for i, t, *_ in odd_rows() if i == 204)
    assert by_id[204]["text_crc32"] == zlib.crc32(text.encode())
    assert sharding.shard_report(empty).count() == 0
    assert sharding.shard_rows(empty, 8).columns[-2:] == ["shard", "slot"]
