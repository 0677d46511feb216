"""Lloyd rounds on cover trees, against plain rounds over all rows."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sourceline.llm import cover_tree


def plain(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    top = cover_tree.limit(width)
    values = [[max(-top, min(top, math.floor(4096 * x))) for x in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    codes, errors, flat = [[] for _ in kept], [0] * len(kept), []
    for part in range(8):
        points = np.array([v[part * width:(part + 1) * width] for v in values], object).reshape(len(values), width)
        book = points[:16].copy()

        def assign(points=points):
            gap = np.array([[sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in book] for p in points], object).reshape(len(points), len(book))
            return [min(range(len(book)), key=lambda k: (row[k], k)) for row in gap], gap
        for _ in range(6):
            nearest, _ = assign()
            for k in range(len(book)):
                mine = [p for p, n in zip(points, nearest, strict=True) if n == k]
                if mine:
                    book[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if width else []
        nearest, gap = assign()
        for i, k in enumerate(nearest):
            codes[i].append(k)
            errors[i] += gap[i][k]
        flat += [str(x) for e in book for x in e]
    labels = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(flat).encode()).hexdigest()
    return [(i, bytes(c).hex(), e, labels[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)]


def key(rows):
    return sorted(rows, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "odd", "odd") for r in rows], "vec_id long, embedding array<double>, label int, trees string, n string")


def odd(seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 20)) / 4
    rows = [(i, (centres[i % 9] + rng.normal(size=20) / 16).round(2).tolist(), [0, 0, 1, None][i % 4]) for i in range(300)]
    rows += [(1000 + i, rows[4][1], 2) for i in range(60)] + [rows[2], rows[2], (None, rows[9][1], 0), (None, rows[8][1], 1), (3, rows[8][1], 0)]
    return rows + [(400, None, 0), (401, [float("nan")] * 20, 0), (402, [None] + [1.0] * 19, 0), (403, [float("-inf")] * 20, 1), (404, [], 5), (405, [1.0], 5), (406, [-3.0] * 17, None)]


@pytest.mark.parametrize("block", [cover_tree.BLOCK, 7])
def test_codes_equal_plain_rounds(spark, block):
    rows = odd()
    got = cover_tree.compressed(frame(spark, rows).repartition(4), block).collect()
    assert key(map(tuple, got)) == key(plain(rows)) and len(got) == len(rows) - 4


def test_every_number_of_parts(spark):
    for rows in ([], [(0, None, 0)], [(0, [], 0), (1, [], None)], [(5, [0.5] * 3, 1)], [(i, [i / 7] * 16, 0) for i in range(5)],
                 [(i, [float((-9) ** (i % 4)) * 1e30, 1e-40, -1e300] + [-0.0] * 13, i % 2) for i in range(20)]):
        assert key(map(tuple, cover_tree.compressed(frame(spark, rows)).collect())) == key(plain(rows)), rows


def test_hot_labels_and_others(spark):
    rows = [(i, "x", i % 7 if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "error long, label_error_was string, label int")
    totals = defaultdict(int)
    for e, _, label in rows:
        totals[label] += e
    for hot in (0, 1, 5, 10 ** 6):
        got = cover_tree.with_label_error(df, hot).collect()
        assert key((r.error, r.label, r.label_error) for r in got) == key((e, label, totals[label]) for e, _, label in rows)


@pytest.mark.parametrize("kind", ["even", "clusters", "same", "line"])
def test_trees_are_cover_trees(kind):
    rng = np.random.default_rng(1)
    points = {"even": rng.integers(-900, 900, (500, 4)), "same": np.full((50, 4), 3), "line": np.arange(400)[:, None] ** 2 * np.ones((1, 2), int),
              "clusters": rng.integers(-9, 9, (600, 4)) + rng.integers(-5, 5, (1, 4)) + 4000 * (np.arange(600) % 5)[:, None]}[kind]
    tree = cover_tree.plant(points)
    held = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    level, scale = np.array([0]), None
    while len(level):
        assert tree.start[level].tolist() == [0, *tree.stop[level][:-1]] and tree.stop[level][-1] == len(points)
        for node in level:
            inside = held[tree.start[node]:tree.stop[node]]
            gaps = np.sqrt(((inside - held[tree.centre[node]]) ** 2).sum(1))
            assert abs(gaps.max() - tree.radius[node]) < 1e-9 and tree.start[node] <= tree.centre[node] < tree.stop[node]
        centres = held[tree.centre[level]]
        apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[np.triu_indices(len(level), 1)]
        assert not len(apart) or scale is None or apart.min() > 0
        scale = apart.min() if len(apart) else None
        if level[0] >= tree.last:
            break
        below, owner = cover_tree._runs(tree.first[level], tree.after[level])
        assert set(owner.tolist()) == set(range(len(level))) and below.tolist() == list(range(below[0], below[0] + len(below)))
        # nesting: every centre stays a centre below
        assert set(tree.centre[level].tolist()) <= set(tree.centre[below].tolist())
        level = below


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, (16, 8))
    points = centres[np.arange(4000) % 16] + rng.integers(-20, 20, (4000, 8))
    tree = cover_tree.plant(points)
    runs = [(e, a, b) for entry, start, stop in cover_tree.walk(tree, points[tree.order], centres) for e, a, b in zip(entry, start, stop, strict=True)]
    assert sum(b - a for _, a, b in runs) == 4000 and len(runs) < 200
    sums = cover_tree.moments(tree, points[tree.order], centres)
    nearest = cover_tree.squared(points, centres).argmin(1)
    for k in range(16):
        assert sums[k].tolist() == [(nearest == k).sum(), *points[nearest == k].sum(0)]


def test_components_become_whole_numbers():
    column = pa.array([[0.0001, -0.0001, 1.0], [], [-0.5]], pa.list_(pa.float64()))
    assert cover_tree.whole(column, 1).tolist() == [[0, -1, 4096, 0, 0, 0, 0, 0], [0] * 8, [-2048, 0, 0, 0, 0, 0, 0, 0]]
    big = np.array([[2 ** 27, -2 ** 27], [5, 7]])
    assert cover_tree.squared(big, np.array([[-2 ** 27, 2 ** 27], [0, 0]])).tolist() == [[2 ** 57, 2 ** 55], [(2 ** 27 + 5) ** 2 + (2 ** 27 - 7) ** 2, 74]]
