import random
from collections import defaultdict
from hashlib import sha256

from semproxy.llm import line_chunks
from tests.llm.conftest import odd_rows

HOW = line_chunks.Chunking(edges=False)


def plain(rows, how=HOW):
    """Chunks compared as texts: the first one by (id, copy, number) stays."""
    keys, places = {}, defaultdict(set)
    for i, text, *_ in rows:
        lines = line_chunks.text_lines((text or "").encode())
        key = ((1 << 63) - 1 if i is None else i, text)
        keys[key] = lines
        for number, (a, b) in enumerate(line_chunks.chunk_lines(lines, how)):
            if line_chunks.repeatable(lines[a:b]):
                places[b"\n".join(lines[a:b])].add((key[0], key[1] or "", number))
    counted = defaultdict(int)
    for i, text, *_ in rows:
        counted[(1 << 63) - 1 if i is None else i, text or ""] += 1
    gone = {p for found in places.values() for p in found if p != min(found)}
    result = []
    for i, text, *_ in rows:
        lines = keys[(1 << 63) - 1 if i is None else i, text]
        kept = []
        for number, (a, b) in enumerate(line_chunks.chunk_lines(lines, how)):
            if ((1 << 63) - 1 if i is None else i, text or "", number) not in gone:
                kept += lines[a:b]
        result.append((i, len(lines), len(lines) - len(kept), sha256(b"\n".join(kept)).hexdigest()))
    return result


def found(docs, how=HOW):
    rows = line_chunks.line_report(docs, how).collect()
    return [(r["doc_id"], r["n_lines"], r["n_removed_lines"], r["kept_sha256"]) for r in rows]


def test_chunks_cover_the_lines_and_resist_shifts():
    rng = random.Random(7)
    lines = [f"line {rng.random()}".encode() for _ in range(400)]
    chunks = line_chunks.chunk_lines(lines, HOW)
    assert [a for a, _ in chunks] == [0, *(b for _, b in chunks[:-1])] and chunks[-1][1] == 400
    assert 3 < 400 / len(chunks) < 6 and min(b - a for a, b in chunks[:-1]) == 2
    texts = {b"\n".join(lines[a:b]) for a, b in chunks}
    moved = [b"new first", *lines[:200], b"new middle", *lines[200:]]
    again = {b"\n".join(moved[a:b]) for a, b in line_chunks.chunk_lines(moved, HOW)}
    assert len(texts - again) <= 4
    assert line_chunks.chunk_lines([], HOW) == [] and line_chunks.chunk_lines([b"x"], HOW) == [(0, 1)]


def test_repeated_chunks_go_and_the_first_stays(odd, empty):
    # Ids are distinct per text here except for null ids, whose order among themselves is by hash.
    rows = [r for r in odd_rows() if r[0] is not None]
    docs = odd.where("doc_id IS NOT NULL")
    assert sorted(found(docs)) == sorted(plain(rows))
    assert sum(r[2] for r in plain(rows)) > 10
    assert len(found(odd)) == len(odd_rows())
    assert line_chunks.line_report(empty).count() == 0


def test_many_copies_and_a_common_passage(spark):
    rng = random.Random(2)
    passage = "\n".join(f"a line of the passage {rng.random()}" for _ in range(30))
    rows = [(i, f"own line {i}\n{passage}\nlast line {i}") for i in range(200)] + [(500 + i, passage) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(found(docs)) == sorted(plain(rows))
    removed = {r[0]: r[2] for r in found(docs)}
    assert removed[0] == 0 and all(removed[i] >= 15 for i in range(1, 200))


def test_whole_passages_go_up_to_their_edges(spark):
    rng = random.Random(9)
    rows, passages = [], []
    for length in (2, 2, 3, 4, 5, 9, 10, 30):
        passages.append([f"passage {rng.random()}" for _ in range(length)])
    for i in range(300):
        lines = [f"own {i} {k} {rng.random()}" for k in range(rng.randint(2, 6))]
        at = rng.randint(0, len(lines))
        rows.append((i, "\n".join(lines[:at] + passages[i % 8] + lines[at:])))
    rows.append((900, "one\n\none\none\none"))
    rows.append((901, "passage alone\nlast"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    result = line_chunks.dedup_lines(docs).collect()
    kept = {r["doc_id"]: r["kept"].decode().split("\n") for r in result}
    assert sum(r["n_removed_chunks"] for r in result) > 100
    first = set()
    for i, text in rows[:300]:
        wanted = text.split("\n")
        if i % 8 in first:
            wanted = [line for line in wanted if line.startswith("own")]
        first.add(i % 8)
        assert kept[i] == wanted
    assert kept[901] == ["passage alone", "last"]
    # The pair of lines 2 and 3 is the first; the one after it shares a line with it.
    assert kept[900] == ["one", "", "one", "one", "one"]


def test_whole_runs_found_by_all_pairs(odd):
    """What all pairs of lines find repeated goes; beside it only blank lines in removed chunks."""
    rows = [r for r in odd_rows() if r[0] is not None]
    texts = sorted({(r[0], r[1] or "") for r in rows})
    # Copies of one id are told apart by hashes, so only ids with one text say which is first.
    ids = [i for i, _ in texts]
    single = [(i, t) for i, t in texts if ids.count(i) == 1]
    docs = odd.where("doc_id IS NOT NULL").where(f"doc_id IN ({','.join(str(i) for i, _ in single)})")
    seen, wanted, whole = {}, {}, {}
    for i, text in single:
        lines, gone = line_chunks.text_lines(text.encode()), set()
        for a, b in line_chunks.line_pairs(lines):
            at = seen.setdefault(tuple(lines[a:b]), (i, b))
            if at[0] != i or a >= at[1]:
                gone.update(range(a, b))
        wanted[i] = [x for k, x in enumerate(lines) if k not in gone and x.strip()]
        whole[i] = lines
    found = line_chunks.dedup_lines(docs).collect()
    kept = {r["doc_id"]: line_chunks.text_lines(bytes(r["kept"])) for r in found}
    assert {i: [x for x in lines if x.strip()] for i, lines in kept.items()} == wanted
    assert sum(len(whole[i]) - len(lines) for i, lines in kept.items()) > 20


def test_every_removed_line_has_an_equal_one_before_it(spark):
    rng = random.Random(21)
    few = [f"line {i}" for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(few, k=rng.randint(1, 25)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"].decode().split("\n") for r in line_chunks.dedup_lines(docs).collect()}
    stayed = set()
    for i, text in rows:
        stayed.update(kept[i])
        assert {line for line in text.split("\n") if line.strip()} <= stayed


def test_chunks_do_the_bulk_of_the_work(spark):
    """Of long passages, only lines at the edges are left to the pairs."""
    rng = random.Random(4)
    passage = "\n".join(f"a line of the passage {rng.random()}" for _ in range(40))
    rows = [(i, f"own {i}\n{passage}\nlast {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = {r["doc_id"]: r["n_removed_lines"] for r in line_chunks.dedup_lines(docs, HOW).collect()}
    both = {r["doc_id"]: r["n_removed_lines"] for r in line_chunks.dedup_lines(docs).collect()}
    assert all(chunks[i] >= 30 and both[i] == 40 for i in range(1, 50)) and both[0] == 0
