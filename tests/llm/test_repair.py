"""Repair of conversations, against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sourceline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, n string"


def plain_rows():
    rng = random.Random(11)
    texts = ["Fine.", "Yes!", "Why?", "cut off", "", " \n", "Fine.", "a. b", "ok.  \t", "É."]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool", "", "us"]), rng.choice(texts)) for conv in range(60) for turn in range(rng.randrange(1, 8)) if rng.random() < 0.9]
    rows += [(conv, rng.choice([None, 1, 5, 9]), None if rng.random() < 0.2 else "user", None if rng.random() < 0.2 else f"t{rng.randrange(3)}.") for conv in (100, None, -7) for _ in range(6)]
    return rows + [rows[0], rows[0], (200, None, None, None), (201, 3, "user", "w. " * 30_000)]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's damaged rows: every automaton path, by plain relaxation over single rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults, keep = set(), Counter(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        keep.append({"": 0, "truncated": 5}.get(fault))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heads = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
    best = {"": (0, "", ())}  # by what has been written so far, in normal form: "", s, su, sua, u, ua

    def put(table, form, value):
        if re.fullmatch("(s?(ua)*u?)", form):
            form = re.sub("^(s?)(ua)+(?=.)", r"\1", form) if len(form) > 3 else form
            if form not in table or value < table[form]:
                table[form] = value

    def inserted(table):
        for _ in range(4):
            for form, (cost, audit, lines) in list(table.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    put(table, form + c, (cost + 5, audit + "I", (*lines, f"{name}:")))
        return table
    best = inserted(best)
    for (_, _, role, text), k in zip(rows, keep, strict=True):
        after = {}
        for form, (cost, audit, lines) in best.items():
            put(after, form, (cost + 2, audit + "D", lines))
            if k is not None:
                if role[:1] in ("s", "u", "a"):
                    put(after, form + role[:1], (cost + k, audit + "K", (*lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    put(after, form + c, (cost + 1 + k, audit + "R", (*lines, f"{name}:{text}")))
        best = inserted(after)
    cost, audit, lines = min(v for form, v in best.items() if re.fullmatch("(s?(ua)+)?", form))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def expected(rows):
    groups = defaultdict(list)
    for row in damage(rows):
        groups[row[0]].append(row)
    return {conv: plain_repair(groups[conv]) for conv in {r[0] for r in rows}}


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, "odd", "odd") for r in plain_rows()], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("chunk", [repair.LONG, 2])
def test_repairs_equal_a_plain_search(conversations, chunk):
    got = repair.repair_summaries(repair.damaged(conversations), chunk).collect()
    want = expected(plain_rows())
    assert {r.conv_id: tuple(r)[1:] for r in got} == {conv: summary for conv, (summary, _) in want.items()} and len(got) == len(want)
    assert all(sum(edit in s[6] for s, _ in want.values()) > 3 for edit in "KRD")


@pytest.mark.parametrize("chunk", [repair.LONG, 3])
def test_repaired_turns(conversations, chunk):
    lines = defaultdict(list)
    for r in repair.repaired_turns(conversations, chunk).orderBy("conv_id", "place").collect():
        assert r.place == len(lines[r.conv_id]) and r.edit in "KRI"
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    groups = defaultdict(list)
    for conv, turn, role, text in plain_rows():
        groups[conv].append((conv, turn, *(" " if x is None else x for x in (role, text))))
    want = {conv: list(plain_repair(rows)[1]) for conv, rows in groups.items()}
    assert dict(lines) == {conv: found for conv, found in want.items() if found}


def test_a_conversation_of_any_length(spark):
    """Many chunks, with a run of copies longer than a chunk."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c?", f"{t}.", f"{t}!", ""])) for t in range(400)] + [(1, 77, "user", "same.")] * 300 + [(2, 0, "user", "x.")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_summaries(repair.damaged(df), 16).collect()}
    assert got == {conv: summary for conv, (summary, _) in expected(rows).items()}


def test_no_conversations(conversations):
    assert repair.repair_summaries(repair.damaged(conversations.limit(0))).count() == 0
    assert repair.repaired_turns(conversations.limit(0), 1).count() == 0


def test_derivations_equal_relaxation():
    """The agenda against relaxation of all deductions until nothing gets lighter."""
    rng, inserted = random.Random(2), 0
    for _ in range(300):
        steps = [repair.Step(rng.choice("suat"), rng.choice([0, 5, None])) for _ in range(rng.randrange(6))]
        for start in repair.STATES:
            best, changed = {(0, start): (0, "")}, True
            while changed:
                changed = False
                for (i, state), (cost, audit) in list(best.items()):
                    found = [(i, *d) for d in repair.insertions(state)] + ([(i + 1, *d) for d in repair.deductions(steps[i], state)] if i < len(steps) else [])
                    for j, to, more, edit in found:
                        weight = cost + more, audit + edit
                        if weight < best.get((j, to), (10 ** 9, "")):
                            best[j, to], changed = weight, True
            want = {q: w for (i, q), w in best.items() if i == len(steps)}
            assert repair.derivations(steps, start, repair.STATES) == want
            inserted += sum("I" in audit for _, audit in want.values())
    assert inserted > 100


def test_a_run_of_deletions_equals_its_rows():
    rng = random.Random(4)
    for _ in range(100):
        steps = [repair.Step(rng.choice("sua"), rng.choice([0, 5, None]), 1) for _ in range(rng.randrange(1, 5))]
        runs = [s._replace(n=3) if s.keep is None else s for s in steps]
        single = [s for s in steps for _ in range(3 if s.keep is None else 1)]
        for start in repair.STATES:
            assert repair.derivations(runs, start, repair.STATES) == repair.derivations(single, start, repair.STATES)
