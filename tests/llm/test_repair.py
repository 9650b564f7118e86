"""Conversation repair against a brute-force search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from semproxy.llm import repair
from semproxy.llm.common import written

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
LEGAL = {"su", "ua", "au"}


def classify(rows):
    seen, faults = set(), []
    for role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        if not stripped:
            faults.append("b")
        elif (role, text) in seen:
            faults.append("d")
        else:
            faults.append("." if stripped[-1] in ".!?" else "t")
        seen.add((role, text))
    return faults


def cheapest(rows, faults):
    """Best (cost, audit, lines) per prefix of rows and last two output letters, forward."""

    def follow(state, letter):
        after = state + letter
        if letter == "s":
            return "s" if state == "" else None
        if letter == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if letter == "a" and after == "ua" else None

    def spread(table):
        work = list(table.items())
        while work:
            state, (cost, audit, lines) = work.pop()
            for letter, role in (("u", "user"), ("a", "assistant")):
                new = follow(state, letter)
                option = (cost + 3, audit + "I", lines + (f"{role}:",))
                if new and (new not in table or option[:2] < table[new][:2]):
                    table[new] = option
                    work.append((new, option))
        return table

    table = spread({"": (0, "", ())})
    for (role, text), fault in zip(rows, faults):
        fresh = {}

        def offer(state, option):
            if state is not None and (state not in fresh or option[:2] < fresh[state][:2]):
                fresh[state] = option

        for state, (cost, audit, lines) in table.items():
            offer(state, (cost + 4, audit + "D", lines))
            if fault in "bd":
                continue
            extra = 3 if fault == "t" else 0
            offer(follow(state, role[:1]), (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
            for letter, made in (("u", "user"), ("a", "assistant")):
                offer(follow(state, letter), (cost + extra + 3, audit + "R", lines + (f"{made}:{text}",)))
        table = spread(fresh)
    return min((table[state] for state in ("", "a") if state in table), key=lambda x: x[:2])


def expected(conv, rows):
    """``rows`` are (turn, role, text) in order, nulls already replaced in role and text."""
    said = [(role, text) for _, role, text in rows]
    faults = classify(said)
    initials = [role[:1] for role, _ in said]
    cost, audit, lines = cheapest(said, faults)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    counts = tuple(faults.count(f) for f in "bdt")
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def by_conversation(rows, ids):
    found = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        found[conv].append((turn, role, text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in found.items()}


def invented(rng, conv, n, roles=("system", "user", "assistant", "user", "assistant", "tool", "")):
    texts = ["Yes.", "no", "Well!", "", " \n", "Why? ", "a. b", "Ünï?", "end.\x0b"]
    return [(conv, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}.") for t in range(n)]


def said(frame):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    found = []
    for conv in range(60):
        found += invented(rng, conv, rng.randint(1, 12))
    for conv in range(100, 140):
        found += invented(rng, conv, rng.randint(1, 12), ("user", "assistant"))
    found += [(200, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(900)]  # many chunks
    found += invented(rng, 201, 700)
    found += [(202, t, "user", "same.") for t in range(600)]  # all but one deleted
    found += [(203, t * 1000, "user", f"sparse {t}.") for t in range(40)]
    found += [(204, None, None, None), (204, 3, None, "x."), (204, 5, "user", None)]
    found += [(None, 0, "user", "nobody."), (None, 1, "assistant", "here")]
    found += [(205, -5, "user", "early."), (205, 2**40, "assistant", "late.")]
    found += [(206, 0, "user", "long " * 100_000 + ".")]
    return found


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_damaged_against_brute_force(spark, rows, chunk):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({n: F.lit(1) for n in ("c", "chunk", "kind", "known")})
    groups = by_conversation(damage(rows), {r[0] for r in rows})
    assert said(repair.repair_report(frame, chunk)) == sorted((expected(c, r) for c, r in groups.items()), key=repr)


def test_undamaged_and_equal_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "a?"), (1, 1, "user", "a?"), (1, 1, "user", "a?"), (1, 2, "assistant", "b.")]
    result = said(repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert result == [expected(1, [r[1:] for r in rows])]
    assert result[0][7] == "KKDDK"


def test_rows_of_one_turn_count_once_each(spark):
    rng = random.Random(2)
    rows = [(1, rng.choice([None, 1, 2]), rng.choice(["user", "assistant"]), f"{i}.") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    first = said(repair.repair_conversations(frame, 5))
    assert first == said(repair.repair_conversations(frame.repartition(9), 256))
    assert first[0][1:5] == (0, 0, 0, 0) and first[0][7].count("D") + first[0][7].count("K") + first[0][7].count("R") == 40


def test_empty_table_and_lost_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(empty).collect() == []
    lost = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    frame = spark.createDataFrame([(lost, 0, "user", "x.")], SCHEMA)
    assert said(repair.repair_report(frame)) == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_fix_up_passes_are_needed_and_end(spark):
    """One-row chunks depend on their successors: speculation alone would give other costs."""
    rng = random.Random(4)
    frame = spark.createDataFrame(invented(rng, 1, 80, ("user", "assistant", "system")), SCHEMA)
    chunks = written(repair.cut_chunks(repair.facts(repair.undamaged(frame)), 1), "chunks")
    settled, passes = repair.fix_up(chunks)
    assert 0 < passes < 40
    was = {(r["bucket"], r["part"]): r["left"] for r in chunks.collect()}
    assert any(was[r["bucket"], r["part"]] != r["left"] for r in settled.collect())


@pytest.mark.parametrize("seed", range(40))
def test_rerun_equals_a_full_run(seed):
    rng = random.Random(seed)
    symbols = [rng.choice("suao") + rng.choice("..tbd") for _ in range(30)]
    shapes = [repair.run_back([rng.choice("suao") + "." for _ in range(5)], repair.END)[0] for _ in range(2)]
    left, delta = repair.run_back(symbols, shapes[0])
    assert repair.rerun(symbols, shapes[0], shapes[1], left, delta) == repair.run_back(symbols, shapes[1])


def test_audits_are_legal_and_least():
    """All edit sequences of short conversations, without any dynamic programme."""
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{rng.random()}."])) for _ in range(3)]
        faults = classify(rows)
        options = []
        for puts in itertools.product(["", "u", "a", "ua", "au"], repeat=4):
            for edits in itertools.product("DKua", repeat=3):
                letters, audit, cost = puts[0], "I" * len(puts[0]), 3 * len("".join(puts))
                for (role, _), fault, edit, put in zip(rows, faults, edits, puts[1:]):
                    if edit != "D" and fault in "bd":
                        break
                    cost += 4 if edit == "D" else (3 if fault == "t" else 0) + (0 if edit == "K" else 3)
                    letters += "" if edit == "D" else role[0] if edit == "K" else edit
                    audit += edit if edit in "DK" else "R"
                    letters, audit = letters + put, audit + "I" * len(put)
                else:
                    if PATTERN.fullmatch(letters):
                        options.append((cost, audit))
        assert min(options) == cheapest(rows, faults)[:2]
