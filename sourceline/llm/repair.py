"""Repair of the turn structure of conversations by Knuth's lightest-derivation agenda.

A repaired conversation has role initials ``(s?(ua)+)?``. Items say "the first i rows are consumed and the
automaton of that form is in state q"; deductions combine an item with the row after it by Keep, Rerole or
Delete, or take it alone by Insert. An item weighs (cost, audit), the audit being the initials of its
edits. Every deduction adds to the cost or extends the audit, so it is monotone and superior: items popped from the
agenda in the order of their weights are final, and the first goal popped is the cheapest repair
with the least audit.

A conversation of up to ``LONG`` rows and ``BYTES`` of text is solved in the task that its rows are shuffled
to, once and sorted. A longer one never meets whole: its rows are numbered by ranges, cut into chunks of ``LONG``
rows, and every chunk gives the lightest derivation from each state to each state; the
same agenda then runs over chunks instead of rows. Only the digest of a repaired long conversation is made in one
task, as a digest must be, and there texts stream by.

Rows are faulty as blank (no character but ASCII white space), else duplicate (role and text of an earlier row), else
truncated (the last other character is none of ``.!?``). Blank and duplicate rows must be deleted.

Defined cases: rows lie by turn, null turns first, then by role and text in code point order; rows equal in all of
that are neighbours; a null role or text is one space, and a null conv_id is a conversation of its own; a role
is known by its first character, and an empty role has none; turns are whole numbers; a
conversation without rows after damage has zeros, an empty audit and the digest of nothing; an audit is one
string, so it must fit a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush
from itertools import groupby, tee
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import stored
from ..plans.ranking import number_ordered

# Costs of edits, white space, ends of sentences.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE, ENDS = " \t\n\x0b\f\r", ".!?"
# End of fixed values.
LONG, BYTES = 1024, 1 << 26
#: States of the automaton of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; the initials each reads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES, ACCEPTING = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

Weight = tuple[int, str]


class Step(NamedTuple):
    """``n`` rows: one that may be kept at ``keep``, or such as must all be deleted (``keep`` None)."""

    initial: str
    keep: int | None
    n: int = 1


def deductions(step: Step, state: int) -> Iterator[tuple[int, int, str]]:
    """``state, cost, audit`` after a row."""
    yield state, DELETE * step.n, "D" * step.n
    if step.keep is not None:
        if step.initial in STEPS[state]:
            yield STEPS[state][step.initial], KEEP + step.keep, "K"
        for initial in ROLES:
            if initial in STEPS[state]:
                yield STEPS[state][initial], REROLE + step.keep, "R"


def insertions(state: int) -> Iterator[tuple[int, int, str]]:
    for initial in ROLES:
        if initial in STEPS[state]:
            yield STEPS[state][initial], INSERT, "I"


def agenda(n: int, start: int, goals: Sequence[int], rules: object, first: bool) -> dict[int, Weight]:
    """Weights of the items ``(n, q)`` for ``q`` in ``goals`` that can be derived from ``(0, start)``; only
    the lightest, if ``first``. ``rules(i, q)`` yields ``i, q, cost, audit`` of deductions."""
    heap, final, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n and state in goals:
            found[state] = cost, audit
            if first or len(found) == len(goals):
                return found
        for j, to, more, edits in rules(i, state):
            if (j, to) not in final:
                heappush(heap, (cost + more, audit + edits, j, to))
    return found


def derivations(steps: Sequence[Step], start: int, goals: Sequence[int], first: bool = False) -> dict[int, Weight]:
    """The lightest derivations of ``steps`` from ``start`` to ``goals``."""
    def rules(i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        for to, cost, audit in insertions(state):
            yield i, to, cost, audit
        if i < len(steps):
            for to, cost, audit in deductions(steps[i], state):
                yield i + 1, to, cost, audit
    return agenda(len(steps), start, goals, rules, first)


def joined(chunks: Sequence[dict[tuple[int, int], Weight]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and start and audit of every chunk, of the lightest derivation of all chunks together."""
    def rules(i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        if i < len(chunks):
            for to in STATES:
                if (state, to) in chunks[i]:
                    yield i + 1, to, *chunks[i][state, to]
    cost, audit = next(iter(agenda(len(chunks), 0, ACCEPTING, rules, True).values()))
    plan, state, at = [], 0, 0
    for left, chunk in zip(range(len(chunks) - 1, -1, -1), chunks, strict=True):
        # a chunk's edits are read off the audit: whatever begins it and takes all rows of the chunk is part of this derivation
        to, edits = next((q, w[1]) for (p, q), w in chunk.items() if p == state and audit.startswith(w[1], at) and (left or at + len(w[1]) == len(audit)))
        plan.append((state, edits))
        state, at = to, at + len(edits)
    return cost, plan


def replay(initials: Iterable[str], start: int, audit: str) -> Iterator[tuple[str, str | None, bool]]:
    """``edit, role, taken`` of every edit: the new role, None for a kept or deleted row; whether it takes a row."""
    state, rows = start, iter(initials)
    for edit in audit:
        initial = next(rows) if edit != "I" else None
        if edit == "D":
            yield edit, None, True
            continue
        if edit != "K":
            initial = next(i for i in ROLES if i in STEPS[state])
        state = STEPS[state][initial]
        yield edit, ROLES[initial] if edit != "K" else None, edit != "I"


def keep_cost(blank: bool, duplicate: bool, cut: bool) -> int | None:
    return None if blank or duplicate else TRUNCATED * cut


class Summary(NamedTuple):
    gaps: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    audit: str = ""


def repaired(rows: Sequence[tuple[int | None, str, str]]) -> tuple[Summary, list[tuple[str, str, str]]]:
    """Summary and ``edit, role, text`` of the repaired turns of one conversation's ``turn, role, text`` in order."""
    steps, seen, faults = [], set(), [0, 0, 0]
    for _, role, text in rows:
        solid = text.strip(SPACE)
        blank, duplicate, cut = not solid, (role, text) in seen, solid[-1:] not in ENDS
        seen.add((role, text))
        faults[0 if blank else 1 if duplicate else 2] += blank or duplicate or cut
        steps.append(Step(role[:1], keep_cost(blank, duplicate, cut)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a.initial + b.initial not in LEGAL for a, b in zip(steps, steps[1:], strict=False))
    cost, audit = next(iter(derivations(steps, 0, ACCEPTING, True).values()))
    lines, at = [], iter(rows)
    for edit, role, taken in replay([s.initial for s in steps], 0, audit):
        _, old, text = next(at) if taken else (None, None, "")
        if edit != "D":
            lines.append((edit, role or old, text))
    return Summary(gaps, *faults, illegal, cost, audit), lines


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: rows after the damage of the contract, ``n`` times each."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("_hit") <= 1, "").when(F.col("_hit") == 2, F.translate("_text", ENDS, "")).otherwise(F.col("_text"))
    return (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("_role"), blank("text").alias("_text"), hit.alias("_hit"))
            .select("conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"),
                    F.when(F.col("_hit") == 0, 0).when(F.col("_hit") == 3, 2).otherwise(1).alias("n")))


def intact(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n`` of rows as they are."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), F.lit(1).alias("n"))


LINES = "place long, edit string, role string, text string"
COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _digest(lines: Iterable[tuple[str, str]]) -> str:
    held = hashlib.sha256()
    for i, (role, text) in enumerate(lines):
        held.update(("\n" if i else "").encode() + role.encode() + b":" + text.encode())
    return held.hexdigest()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, at_once: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(columns: str, id_type: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([("conv_id", id_type), *[(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))]])


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations that a task holds one at a time."""
    columns = LINES if turns else f"{COLUMNS}, repaired_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return

        def solved() -> Iterator[tuple]:
            every = _rows(b for part in ([head], batches) for b in part)
            for conv, group in groupby(every, itemgetter(0)):
                summary, lines = repaired([r[1:4] for r in group for _ in range(r[4])])
                if turns:
                    yield from ((conv, i, *line) for i, line in enumerate(lines))
                else:
                    yield conv, *summary, _digest(line[1:] for line in lines)

        yield from _batches(solved(), _arrow(columns, head.schema.field("conv_id").type))

    placed = rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")])
    return placed.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, {columns}")


def _features(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: ``conv, row, turn, role, tie, n, blank, cut, duplicate``.

    ``row`` names a row; ``tie`` orders rows of one turn and role by text.
    """
    named = rows.select(F.struct("conv_id").alias("conv"), F.struct("conv_id", "turn", "role", F.sha2("text", 256).alias("sha")).alias("row"), "n", "text")
    solid = F.btrim("text", F.lit(SPACE))
    slim = stored(named.select("conv", "row", "n", (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(*ENDS)).alias("cut"))
                  .groupBy("conv", "row").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")), "conversation-features")
    turn = F.struct(F.col("row.turn").isNotNull().alias("known"), F.col("row.turn").alias("turn"))
    firsts = (slim.groupBy(F.struct("row.conv_id", "row.role", "row.sha").alias("same")).agg(F.min(turn).alias("first"))
              .select(F.struct("same.conv_id", "first.turn", "same.role", "same.sha").alias("row"), F.lit(False).alias("duplicate")))
    spot = F.struct("row.conv_id", "row.turn", "row.role").alias("spot")
    shared = slim.groupBy(spot).agg(F.count("*").alias("rows")).where("rows > 1").select("spot")
    ties = number_ordered(named.select("row", "text", spot).dropDuplicates(["row"]).join(shared, "spot", "left_semi"), ["spot"], ["text"], "tie").select("row", "tie")
    return (slim.join(firsts, "row", "left").join(ties, "row", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))
            .withColumn("tie", F.coalesce("tie", F.lit(0))).withColumns({"turn": F.col("row.turn"), "role": F.col("row.role")}))


def _steps(rows: pd.DataFrame) -> Iterator[tuple[Step, int]]:
    """Steps of distinct rows in order, and the row each is of: a row that may be kept, then its copies."""
    for i, (role, n, blank, duplicate, cut) in enumerate(zip(rows["role"], rows["n"], rows["blank"], rows["duplicate"], rows["cut"], strict=True)):
        keep = keep_cost(blank, duplicate, cut)
        if keep is None:
            yield Step(role[:1], None, int(n)), i
        else:
            yield Step(role[:1], keep), i
            if n > 1:
                yield Step(role[:1], None, int(n) - 1), i


def _long(rows: DataFrame, turns: bool, chunk: int) -> DataFrame:
    """Conversations of any length, by chunks."""
    kind, rows = dict(rows.dtypes)["conv_id"], rows.where("n > 0")
    numbered = number_ordered(_features(rows), ["conv"], ["turn", "role", "tie"], "place")
    numbered = stored(numbered.withColumn("chunk", F.floor((F.col("place") - 1) / chunk)), "conversation-rows")
    slim = numbered.select(F.struct("conv", "chunk").alias("part"), "conv.conv_id", "chunk", "place", "role", "n", "blank", "duplicate", "cut")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        n, blank, heads = group["n"].to_numpy(), group["blank"].to_numpy(bool), [role[:1] for role in group["role"]]
        again, cut = group["duplicate"].to_numpy(bool) & ~blank, group["cut"].to_numpy(bool)
        fine = ~blank & ~again
        known = {"blank": n[blank].sum(), "duplicate": n[again].sum() + (n[fine] - 1).sum(), "truncated": (fine & cut).sum(),
                 "illegal": (n - 1).sum() + sum(a + b not in LEGAL for a, b in zip(heads, heads[1:], strict=False)), "head": heads[0], "tail": heads[-1]}
        steps = [s for s, _ in _steps(group)]
        return pd.DataFrame([{"conv_id": group["conv_id"].iloc[0], "chunk": group["chunk"].iloc[0], "start": p, "stop": q, "cost": cost, "audit": audit, **known}
                             for p in STATES for q, (cost, audit) in derivations(steps, p, STATES).items()])

    counts = "blank long, duplicate long, truncated long, illegal long"
    parts = stored(slim.groupBy("part").applyInPandas(
        solve, f"conv_id {kind}, chunk long, start int, stop int, cost long, audit string, {counts}, head string, tail string"), "conversation-chunks")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        chunks = [part for _, part in group.groupby("chunk")]
        cost, plan = joined([{(r.start, r.stop): (r.cost, r.audit) for r in part.itertuples()} for part in chunks])
        ones = pd.DataFrame([part.iloc[0] for part in chunks]).assign(cost=cost, start=[p for p, _ in plan], audit=[a for _, a in plan])
        between = [a + b not in LEGAL for a, b in zip(ones["tail"], ones["head"].iloc[1:], strict=False)]
        return ones.assign(illegal=ones["illegal"] + [*between, 0])[["conv_id", "chunk", "start", "cost", "audit", "blank", "duplicate", "truncated", "illegal"]]

    plan = stored(parts.groupBy(F.struct("conv_id").alias("conv")).applyInPandas(
        join, f"conv_id {kind}, chunk long, start int, cost long, audit string, {counts}"), "conversation-plans")

    def edits(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        rows, out, one = rows.sort_values("place"), [], plan.iloc[0]
        ahead, at = tee((s.initial, i) for s, i in _steps(rows) for _ in range(s.n))
        roles, places = rows["role"].tolist(), rows["place"].tolist()
        for k, (edit, role, taken) in enumerate(replay((initial for initial, _ in ahead), int(one["start"]), one["audit"])):
            i = next(at)[1] if taken else None
            if edit != "D":
                out.append((one["conv_id"], one["chunk"], k, edit, role or roles[i], places[i] if taken else 0))
        return pd.DataFrame(out, columns=["conv_id", "chunk", "k", "edit", "role", "place"])

    kept = slim.groupBy("part").cogroup(plan.withColumn("part", F.struct(F.struct("conv_id").alias("conv"), "chunk")).groupBy("part")).applyInPandas(
        edits, f"conv_id {kind}, chunk long, k long, edit string, role string, place int")
    kept = kept.withColumn("spot", F.struct(F.struct("conv_id").alias("conv"), "place"))
    texts = rows.select(F.struct("conv_id", "turn", "role", F.sha2("text", 256).alias("sha")).alias("row"), "text").dropDuplicates(["row"])
    taken = kept.where("place > 0").join(numbered.select(F.struct("conv", "place").alias("spot"), "row"), "spot").join(texts, "row")
    columns = ["conv_id", "chunk", "k", "edit", "role", "text"]
    lines = taken.select(*columns).unionByName(kept.where("place = 0").withColumn("text", F.lit("")).select(*columns))
    if turns:
        at = number_ordered(lines.withColumn("conv", F.struct("conv_id")), ["conv"], ["chunk", "k"], "place")
        return at.select("conv_id", (F.col("place") - 1).cast("long").alias("place"), "edit", "role", "text")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is not None:
            every = _rows(b for part in ([head], batches) for b in part)
            found = ((conv, _digest((r[1], r[2]) for r in group)) for conv, group in groupby(every, itemgetter(0)))
            yield from _batches(found, _arrow("repaired_sha256 string", head.schema.field("conv_id").type))

    digests = (lines.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "k").select("conv_id", "role", "text")
               .mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string"))
    total = plan.groupBy(F.struct("conv_id").alias("conv")).agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.first("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    places = numbered.select("conv", "turn").distinct().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    nothing = hashlib.sha256().hexdigest()
    return (total.join(places, "conv").join(digests.select(F.struct("conv_id").alias("conv"), "repaired_sha256"), "conv", "left")
            .select("conv.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))


def _both(rows: DataFrame, turns: bool, chunk: int) -> DataFrame:
    size = rows.groupBy(F.struct("conv_id").alias("conv")).agg(F.sum("n").alias("rows"), F.sum(F.octet_length("text") * F.col("n").cast("long")).alias("bytes"))
    long = stored(size.where((F.col("rows") > chunk) | (F.col("bytes") > BYTES)).select("conv"), "long-conversations")
    if long.isEmpty():
        return _short(rows, turns)
    part = lambda how: rows.withColumn("conv", F.struct("conv_id")).join(long, "conv", how).drop("conv")
    return _short(part("left_anti"), turns).unionByName(_long(part("left_semi"), turns, chunk))


def repaired_turns(rows: DataFrame, chunk: int = LONG) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired conversations of ``rows(conv_id, turn, role, text)``."""
    return _both(intact(rows), True, chunk)


def repair_summaries(rows: DataFrame, chunk: int = LONG) -> DataFrame:
    """``conv_id``, faults, ``cost, audit, repaired_sha256`` of ``rows(conv_id, turn, role, text, n)``, a row for each conversation."""
    return _both(rows, False, chunk)
