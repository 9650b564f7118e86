import re
from collections import defaultdict

from semproxy.llm import mixing
from tests.llm.conftest import odd_rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fill(sizes, weights, cap):
    """Targets by dealing out again until no source is above its cap."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[n] for n in clamped)
        share = sum(weight[n] for n in names if n not in clamped)
        targets = {n: cap * sizes[n] if n in clamped else left * weight[n] / share for n in names}
        above = {n for n in names if n not in clamped and targets[n] > cap * sizes[n]}
        if not above:
            return targets
        clamped |= above


def test_sources_meet_their_targets_to_the_word(odd):
    sizes = defaultdict(int)
    for _, text, _, source, _ in odd_rows():
        sizes[source] += len(words(text))
    targets = fill(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == len(odd_rows())
    taken, seen = defaultdict(int), defaultdict(set)
    for row in rows:
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[row["source_size"], row["target"]] += row["taken"]
    for source, target in targets.items():
        seen[sizes[source], target].add(source)
    assert set(taken) == {(sizes[s], float(t)) for s, t in targets.items()}
    for key, sources in seen.items():
        assert abs(taken[key] - key[1] * len(sources)) <= len(sources) * 0.5 + 1e-6
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_report(odd.repartition(3)).collect()))


def test_a_small_source_is_clamped_and_the_excess_dealt_again(spark):
    rows = [(0, "a b", None, "s1", 0), (1, "c " * 50, None, "s2", 0), (2, "d " * 48, None, "s3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    assert found[0]["target"] == 6.0 and found[0]["taken"] == 6
    assert found[1]["target"] == 94 * 2 / 3 and found[1]["taken"] == 63
    assert found[2]["taken"] == 31


def test_documents_repeat_whole_and_are_cut_once_per_source(odd, empty):
    report = {}
    for row in mixing.mix_report(odd).collect():
        report[row["doc_id"]] = report.get(row["doc_id"], 0) + row["taken"]
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    taken, texts = defaultdict(int), {i: t for i, t, *_ in odd_rows()}
    cut = defaultdict(int)
    for row in mixed.collect():
        taken[row["doc_id"]] += len(words(row["text"]))
        assert row["whole"] == "extra whole"
        if row["doc_id"] is not None and row["text"] != texts[row["doc_id"]]:
            assert texts[row["doc_id"]].startswith(row["text"])
            assert row["n_chars"] == len(row["text"])
            cut[row["source"]] += 1
    assert dict(taken) == {i: n for i, n in report.items() if n}
    assert all(n == 1 for n in cut.values())
    assert mixing.mix_documents(empty).count() == 0 and mixing.mix_report(empty).count() == 0


def test_no_python_runs_on_the_main_path(odd):
    plan = mixing.mix_report(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
