"""Product quantisation of vectors by Lloyd rounds on cover trees.

Components become whole numbers, vectors are cut into ``PARTS`` equal parts, and each part position has a
codebook of ``ENTRIES`` entries. Blocks of vectors are indexed once: for every part position a cover tree,
whose levels are nested nets at halving scales. A level is a prefix of the farthest-first order of the points:
its centres are further apart than the scale and cover all points within it, and each centre hangs below the nearest
centre of the level above. Points are stored in tree order, so the points below a node are one run, with
their sum as the difference of two cumulative sums and the largest distance to the centre as radius.

A round walks every tree from its root. Entries further from a node's centre than the nearest one by more
than twice the radius can own no point below and go out. A node with one entry left, or with all points
equal, gives its whole sum and count to its entry; other nodes hand their entries down, and only points of
the last level that are still open are compared exactly. Tasks add up their blocks, so a round
moves a few hundred rows per task and the driver sees one codebook.

All distances are exact whole numbers, ties go to the lower index, and sums are integers: the result does
not depend on how rows lie in tasks or blocks.

Defined cases: a row whose vector is null or holds a null or non-finite component is dropped; vectors
shorter than the longest kept one, and lengths that are no multiple of ``PARTS``, count as padded with zeros;
components are held at +-``limit``, far beyond unit vectors (2^27 for 64 dimensions, x = 32,768), so
that every error fits a long; the first entries are of the smallest vec_ids, null last, of equal ids the
smaller vector first; fewer than ``ENTRIES`` kept rows make a smaller codebook; null labels count as equal; a
label_error beyond a long is null; rows that repeat an id are rows like any other; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors and components of a block, and points to a centre of the last level: bounds of what a task holds.
BLOCK, VALUES, LEAF = 4096, 1 << 22, 8
#: A label with more than one row in so many is hot: there are fewer than ``HOT`` of them.
HOT = 1000
SLACK = 1e-6


def limit(width: int) -> int:
    """The largest magnitude of components at which ``PARTS`` squared distances of ``width`` still add up to a long."""
    return 1 << ((60 - (PARTS * max(1, width) - 1).bit_length()) // 2)


def whole(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as integers, rows of ``PARTS * width``."""
    out, top = np.zeros((len(vectors), PARTS * width), np.int64), limit(width)
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    row, place = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        out[row, place] = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * SCALE), -top, top)
    return out


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each point."""
    p, e = points.astype(np.int64), entries.astype(np.int64)
    most = max(int(np.abs(p).max(initial=0)), int(np.abs(e).max(initial=0)))
    if 4 * p.shape[1] * most * most < 1 << 53:
        p, e = p.astype(np.float64), e.astype(np.float64)  # exact, and a fast product
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    return np.stack([((p - row) ** 2).sum(1) for row in e], 1) if len(e) else np.zeros((len(p), 0), np.int64)


class Tree(NamedTuple):
    """A cover tree. ``order``: rows in tree order; nodes level by level: run of points, centre (a place
    in the order), radius and run of children; ``last`` is the first node of the last level."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    after: np.ndarray
    last: int


def _nets(points: np.ndarray, most: int) -> tuple[list[int], list[np.ndarray]]:
    """Farthest-first centres, and for each level the nearest centre of every point among its prefix."""
    centres, near = [0], np.zeros(len(points), np.int32)
    far = ((points - points[0]) ** 2).sum(1)
    levels, scale, at = [near.copy()], far.max() / 4, int(far.argmax())
    while len(centres) < most and far[at] > 0:
        if far[at] <= scale:
            levels.append(near.copy())
            while far[at] <= scale:
                scale /= 4
        d = ((points - points[at]) ** 2).sum(1)
        closer = d < far
        far[closer], near[closer] = d[closer], len(centres)
        centres.append(at)
        at = int(far.argmax())
    return centres, [*levels, near]


def plant(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of ``points``."""
    exact = points.astype(np.float64)
    centres, levels = _nets(exact, max(1, len(points) // leaf))
    # each point's centre at a level is the one above the centre it hangs below
    place = np.array(centres)
    up = [levels[-1]]
    for near in reversed(levels[:-1]):
        up.append(near[place[up[-1]]])
    paths = up[::-1]
    order = np.lexsort(paths[::-1])
    where = np.empty(len(points), np.int64)
    where[order] = np.arange(len(points))
    nodes, count = [], 0
    for path in paths:
        run = path[order]
        start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        stop = np.r_[start[1:], len(points)]
        gap = np.sqrt(((exact[order] - exact[place[run]]) ** 2).sum(1))
        nodes.append((start, stop, where[place[run[start]]], np.maximum.reduceat(gap, start)))
        count += len(start)
    first, after, at = [], [], len(nodes[0][0])
    for (start, stop, *_), (below, *_) in zip(nodes, nodes[1:], strict=False):
        first.append(at + np.searchsorted(below, start))
        after.append(at + np.searchsorted(below, stop))
        at += len(below)
    leaves = len(nodes[-1][0])
    parts = [np.concatenate(x) for x in zip(*nodes, strict=True)]
    ends = [np.concatenate([*x, np.zeros(leaves, np.int64)]) for x in (first, after)]
    return Tree(order.astype(np.int32), *(x.astype(np.int32) for x in parts[:3]), parts[3], *(x.astype(np.int32) for x in ends), count - leaves)


def _runs(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the runs, and for each the run it is of."""
    size = after - first
    owner = np.repeat(np.arange(len(first)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[owner], owner


def walk(tree: Tree, points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``entry, start, stop``: runs of ``points`` (in tree order) and the entry nearest to all of a run."""
    node, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(node):
        exact = squared(points[tree.centre[node]], entries)
        gap = np.sqrt(exact)
        best = exact.argmin(1)
        reach = gap[np.arange(len(node)), best] + 2 * tree.radius[node]
        open_ &= gap <= (reach + SLACK + reach * 1e-12)[:, None]
        done = (open_.sum(1) == 1) | (tree.radius[node] == 0)
        yield best[done], tree.start[node[done]], tree.stop[node[done]]
        node, open_ = node[~done], open_[~done]
        leaf = node >= tree.last
        if leaf.any():
            at, _ = _runs(tree.start[node[leaf]], tree.stop[node[leaf]])
            yield squared(points[at], entries).argmin(1), at, at + 1
        node, open_ = node[~leaf], open_[~leaf]
        node, owner = _runs(tree.first[node], tree.after[node])
        open_ = open_[owner]


def moments(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Count and sums of the points nearest to each entry, from cumulative sums."""
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), points.cumsum(0)])
    out = np.zeros((len(entries), 1 + points.shape[1]), np.int64)
    for entry, start, stop in walk(tree, points, entries):
        np.add.at(out[:, 0], entry, stop - start)
        np.add.at(out[:, 1:], entry, total[stop] - total[start])
    return out


def codes(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each point, in tree order."""
    code = np.zeros(len(points), np.int64)
    for entry, start, stop in walk(tree, points, entries):
        at, owner = _runs(start.astype(np.int64), stop.astype(np.int64))
        code[at] = entry[owner]
    return code, ((points - entries[code]) ** 2).sum(1)


def _packed(values: np.ndarray, trees: list[Tree]) -> bytes:
    held = io.BytesIO()
    small = values.astype(np.int32) if np.abs(values).max(initial=0) < 1 << 31 else values
    np.savez(held, values=small, **{f"{i}_{k}": v for i, tree in enumerate(trees) for k, v in tree._asdict().items()})
    return held.getvalue()


def _unpacked(data: bytes) -> tuple[np.ndarray, list[Tree]]:
    held = np.load(io.BytesIO(data))
    return held["values"].astype(np.int64), [Tree(*(held[f"{i}_{k}"] for k in Tree._fields[:-1]), int(held[f"{i}_last"])) for i in range(PARTS)]


def planted(rows: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """``vec_id, label, trees``: blocks of ``rows(vec_id, label, v)`` with a cover tree for every part position."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held = batch.slice(at, block)
                values = whole(held.column("v"), width)
                trees = [plant(values[:, i * width:(i + 1) * width]) for i in range(PARTS)]
                lists = [pa.array([held.column(c).to_pylist()], pa.list_(held.schema.field(c).type)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([_packed(values, trees)], pa.binary())], ["vec_id", "label", "trees"])

    kinds, block = dict(rows.dtypes), max(1, min(block, VALUES // max(1, PARTS * width)))
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, trees binary")


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> np.ndarray:
    """Count and component sums for every part position and entry, over all blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries, whatever the table

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), 1 + b.shape[1]), np.int64) for b in shared.value]
        for batch in batches:
            for data in batch.column("trees"):
                values, trees = _unpacked(data.as_py())
                width = values.shape[1] // PARTS
                for i, (tree, book) in enumerate(zip(trees, shared.value, strict=True)):
                    total[i] += moments(tree, values[tree.order, i * width:(i + 1) * width], book)
        flat = np.concatenate([t.ravel() for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "n"])

    sums = blocks.select("trees").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(sum(b.size + len(b) for b in books), np.int64)
    out[sums["at"].to_numpy()] = sums["n"].to_numpy()
    ends = np.cumsum([0, *(b.size + len(b) for b in books)])
    return [out[a:b].reshape(len(book), -1) for a, b, book in zip(ends, ends[1:], books, strict=False)]


def train(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of Lloyd's algorithm from ``books``."""
    for _ in range(rounds):
        books = [np.where(total[:, :1] > 0, total[:, 1:] // np.maximum(total[:, :1], 1), book) for total, book in zip(_sums(blocks, books), books, strict=True)]
    return books


def encoded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` of every vector in the blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    kinds = {c: t[len("array<"):-1] for c, t in blocks.dtypes if c != "trees"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values, trees = _unpacked(batch.column("trees")[row].as_py())
                width, code, error = values.shape[1] // PARTS, np.zeros((len(values), PARTS), np.uint8), np.zeros(len(values), np.int64)
                for i, (tree, book) in enumerate(zip(trees, shared.value, strict=True)):
                    entry, gap = codes(tree, values[tree.order, i * width:(i + 1) * width], book)
                    code[tree.order, i] = entry
                    error[tree.order] += gap
                names = [c.tobytes().hex() for c in code]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[row].values, batch.column("label")[row].values, pa.array(names, pa.string()), pa.array(error)],
                                                 ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over equal labels.

    Labels that hold more than one row in ``hot`` are fewer than ``hot``: their sums are broadcast, and
    the join of all others has no large key.
    """
    sums = stored(rows.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("sum")), "label-errors")
    named = sums.select(F.struct("label").alias("key"), "sum", (F.col("n") * hot > (sums.agg(F.sum("n")).first()[0] or 0)).alias("hot"))
    few, rest = F.broadcast(named.where("hot")), named.where("not hot")
    tagged = rows.select(F.struct(*rows.columns).alias("row")).withColumn("key", F.struct("row.label")).join(few.withColumnRenamed("sum", "few"), "key", "left")
    large = tagged.where("hot").select("row.*", F.col("few").alias("label_error"))
    return large.unionByName(tagged.where("hot is null").select("row", "key").join(rest, "key").select("row.*", F.col("sum").alias("label_error")))


def compressed(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``vectors(vec_id, embedding, label)``."""
    fine = F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    kept = vectors.where(fine).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    width = -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    first = whole(pa.array([r.v for r in start], pa.list_(pa.float64())), width)
    books = [first[:, i * width:(i + 1) * width] for i in range(PARTS)]
    blocks = stored(planted(kept, width, block), "cover-trees")
    books = train(blocks, books) if start else books
    rows = stored(encoded(blocks, books), "vector-codes")
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = ["""kept as materialized (select row_number() over (order by vec_id nulls last, embedding) rn, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0)""",
             f"w as (select cast(ceil(max(len(embedding)) / {PARTS}.0) as bigint) w from kept)",
             f"""v as materialized (select rn, i // w part, i % w j, cast(floor({SCALE} * coalesce(cast(embedding[i + 1] as double), 0)) as bigint) x
  from kept, w, unnest(range({PARTS} * w)) t(i))""",
             f"c0 as materialized (select part, rn - 1 entry, j, x from v where rn <= {ENTRIES})"]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} as materialized (select rn, part, min(struct_pack(d := d, entry := entry)) best from (
  select rn, part, entry, cast(sum((v.x - c.x) * (v.x - c.x)) as bigint) d from v join c{k} c using (part, j) group by all) group by all)""")
        if k < ROUNDS:
            steps.append(f"""c{k + 1} as materialized (select part, entry, j, case when n is null then x else (s - ((s % n) + n) % n) // n end x from c{k} left join (
  select part, best.entry entry, j, cast(sum(x) as bigint) s, count(*) n from v join a{k} using (rn, part) group by all) using (part, entry, j))""")
    return f"""with {", ".join(steps)},
codes as (select rn, string_agg(printf('%02x', best.entry), '' order by part) code, cast(sum(best.d) as bigint) error from a{ROUNDS} group by rn)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, j)) from c{ROUNDS}) codebooks_sha256 from codes join kept using (rn)"""


ORACLE = _oracle()
