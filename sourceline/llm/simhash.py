"""SimHash near-duplicates by a self-join of binary tries.

Distinct fingerprints of 64 bits are joined at ``BUDGET`` or fewer differing bits. Two such
fingerprints agree wholly in one of four blocks of 16 bits, so they stand in one trie rotated by that
block below one node of depth 16, where no error is spent yet. From there node pairs go down together:
each step splits both nodes by the next bit, adds one error to the crossed pairs and drops a pair once
its errors exceed the budget. A task holds the fingerprints of its nodes as one sorted array, on which
a node is a range and a level of all pairs is a few numpy steps. A node of more than ``NODE``
fingerprints is first taken apart by the same traversal as joins of node tables, bit pair by bit pair,
so no task holds an unbounded node.

A task returns a spanning forest of the links that it finds, not the links, so dense groups cost no
more rows than fingerprints. Copies share a fingerprint and are joined once.

Defined cases: a text without words, null or empty, has fingerprint zero and links like any other;
rows that repeat a doc_id are rows like any other; a null doc_id is larger than any id, and a group of
nothing else has a null component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.materialize import stored
from .common import KEY, keyed, united

SHINGLE, SEED, BUDGET = 3, 42, 3
BLOCKS, BLOCK_BITS = 4, 16
NODE = 1 << 18
#: Fingerprints joined at once and node pairs held at once in a task; more are taken one after another.
BATCH, FRONTIER = 1 << 18, 1 << 18
HASHES = 1 << 17


def fingerprint(words: list[bytes]) -> int:
    """Majority bits of the hashes of all 3-word shingles; of the whole sequence, if it is shorter."""
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else [b" ".join(words)]
    ones, n = np.zeros(64, np.int64), 0
    digest, held = xxhash.xxh64_intdigest, []
    for gram in grams:
        held.append(digest(gram, SEED))
        if len(held) == HASHES:
            ones, n, held = ones + _ones(held), n + len(held), []
    if held:
        ones, n = ones + _ones(held), n + len(held)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _ones(hashes: list[int]) -> np.ndarray:
    flat = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(flat, axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``fp``, the fingerprint as a signed long."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t.lower().split()) if t else 0 for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(values.view(np.int64))], [*keep, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, fp long")


def trie_links(values: np.ndarray, pairs: np.ndarray, depth: int, parent: np.ndarray) -> np.ndarray:
    """Join ``values`` (unsigned, sorted inside each node) along node pairs.

    ``pairs`` has a row ``a_low, a_high, b_low, b_high, errors`` for each pair of nodes at ``depth``; a
    node with itself stands as equal ranges. Returns ``parent`` with all links united.
    """
    todo = [(depth, pairs)]
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > FRONTIER:
            todo += [(depth, pairs[:len(pairs) // 2]), (depth, pairs[len(pairs) // 2:])]
            continue
        a0, a1, b0, b1, used = pairs.T
        own = a0 == b0
        product = (a1 - a0) * (b1 - b0)
        small = (product <= 32) | (depth == 64)
        few = small & ~(own & (a1 - a0 == 1))
        if few.any():
            n = product[few]
            if n.sum() > 32 * FRONTIER and few.sum() > 1:
                todo += [(depth, pairs[:len(pairs) // 2]), (depth, pairs[len(pairs) // 2:])]
                continue
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat((b1 - b0)[few], n)
            i, j = np.repeat(a0[few], n) + at // width, np.repeat(b0[few], n) + at % width
            close = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= BUDGET)
            parent = united(parent, i[close], j[close])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        a0, a1, b0, b1, used = pairs.T
        own = a0 == b0
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        down = [np.stack(x, 1) for x in ((a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0, am, bm, b1, used + 1))]
        down.append(np.stack((am, a1, b0, bm, used + 1), 1)[~own])
        down = np.concatenate(down)
        down = down[(down[:, 4] <= BUDGET) & (down[:, 1] > down[:, 0]) & (down[:, 3] > down[:, 2])]
        if len(down):
            todo.append((depth + 1, down))
    return parent


def _forest(values: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return pd.DataFrame({"a": values[child].view(np.int64), "b": values[parent[child]].view(np.int64)})


def _unrotate(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    shift = (block * BLOCK_BITS).astype(np.uint64)
    return (values >> shift) | np.where(shift > 0, values << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))


def _rotated(fp: Column, block: int) -> Column:
    """``fp`` with block ``block`` in front."""
    bits = block * BLOCK_BITS
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _whole_nodes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (task, v), cut so that a node's rows stay together."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= BATCH:
            rows = pd.concat(held, ignore_index=True)
            last = rows["task"].iloc[-1]
            cut = int(np.flatnonzero((rows["task"] == last).to_numpy())[0])
            if cut:
                yield rows.iloc[:cut]
            held, n = [rows.iloc[cut:]], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _join_nodes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each task is a node of depth 16, ``(block, first 16 bits of v)``, joined with itself."""
    for rows in _whole_nodes(batches):
        if len(rows):
            values, task = rows["v"].to_numpy(np.int64).view(np.uint64), rows["task"].to_numpy()
            order = np.lexsort((values, task))
            values, task = values[order], task[order]
            low = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            high = np.append(low[1:], len(task))
            pairs = np.stack([low, high, low, high, np.zeros_like(low)], 1)[high - low > 1]
            parent = trie_links(values, pairs, BLOCK_BITS, np.arange(len(values)))
            yield _forest(_unrotate(values, task >> BLOCK_BITS), parent)


def _join_pairs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each task is a pair of nodes below depth 16, ``side`` 0 and 1, or one node with itself."""
    for rows in _whole_nodes(batches):
        for _, group in rows.groupby("task", sort=False):
            group = group.drop_duplicates(["side", "v"])
            first = np.sort(group.loc[group["side"] == 0, "v"].to_numpy(np.int64).view(np.uint64))
            second = np.sort(group.loc[group["side"] == 1, "v"].to_numpy(np.int64).view(np.uint64))
            values = np.concatenate([first, second])
            n, m, depth, used = len(first), len(second), int(group["depth"].iloc[0]), int(group["used"].iloc[0])
            pair = [0, n, n, n + m, used] if m else [0, n, 0, n, used]
            parent = trie_links(values, np.array([pair]), depth, np.arange(n + m))
            yield _forest(_unrotate(values, np.full(n + m, int(group["block"].iloc[0]))), parent)


def _prefix(v: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(v), 64 - depth)


def _split_nodes(big: DataFrame, node: int) -> DataFrame:
    """Tasks ``task, block, depth, used, side, v`` for nodes too large for one task.

    The same traversal on tables: node pairs go down two bits at a time until both nodes together have
    at most twice ``node`` fingerprints.
    """
    big = stored(big, "trie-large")
    pairs = big.select("block", _prefix("v", BLOCK_BITS).alias("a")).distinct().select("block", "a", F.col("a").alias("b"), F.lit(0).alias("used"))
    ready, depth = None, BLOCK_BITS
    while True:
        depth += 2
        nodes = big.groupBy("block", _prefix("v", depth).alias("c")).agg(F.count("*").alias("n")).withColumn("up", F.shiftrightunsigned("c", 2))
        left, right = (nodes.select("block", F.col("up").alias(s), F.col("c").alias(f"{s}2"), F.col("n").alias(f"{s}n")) for s in "ab")
        down = (pairs.join(left, ["block", "a"]).join(right, ["block", "b"]).where("a < b or a2 <= b2")
                .withColumn("used", F.col("used") + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit(3)))).where(F.col("used") <= BUDGET))
        down = stored(down.select("block", F.col("a2").alias("a"), F.col("b2").alias("b"), "used", ((F.col("an") + F.col("bn") > 2 * node) & F.lit(depth < 64)).alias("more")), "trie-pairs")
        done = down.where("not more").withColumn("task", F.concat_ws(":", "block", F.lit(depth), "a", "b"))
        rows = big.withColumn("c", _prefix("v", depth))
        for side, name in enumerate("ab"):
            part = (rows.join(done.where("a <> b") if side else done, (rows["block"] == done["block"]) & (rows["c"] == done[name]))
                    .select("task", rows["block"], F.lit(depth).alias("depth"), "used", F.lit(side).alias("side"), "v"))
            ready = part if ready is None else ready.unionByName(part)
        pairs = down.where("more").drop("more")
        if pairs.isEmpty():
            return ready


def trie_join(fps: DataFrame, node: int = NODE) -> DataFrame:
    """``a, b``: enough links between distinct fingerprints ``fp`` to connect all that are linked."""
    turned = fps.select(F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _rotated(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("x")).select("x.*")
    turned = turned.withColumn("task", F.col("block") * (1 << BLOCK_BITS) + _prefix("v", BLOCK_BITS))
    turned = stored(turned, "trie-fingerprints")
    sizes = turned.groupBy("task").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > node).select("task"), "trie-nodes")
    usual = turned if large.isEmpty() else turned.join(large, "task", "left_anti")
    links = (usual.select("task", "v").repartition("task").sortWithinPartitions("task").mapInPandas(_join_nodes, "a long, b long"))
    if not large.isEmpty():
        tasks = _split_nodes(turned.join(large, "task", "left_semi").select("block", "v"), node)
        links = links.unionByName(tasks.repartition("task").sortWithinPartitions("task").mapInPandas(_join_pairs, "a long, b long"))
    return links


def near_duplicates(docs: DataFrame, ident: str = "doc_id", more: tuple[str, ...] = (), node: int = NODE) -> DataFrame:
    """``ident, *more, fp, first``: ``first`` is the smallest ``struct<ident, *more>`` of the component."""
    keys = [ident, *more]
    rows = stored(fingerprints(docs, keys), "fingerprints")
    key = F.struct(F.col(ident).isNull().alias("_null"), *keys)
    groups = stored(rows.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-groups")
    links = stored(trie_join(groups.select("fp"), node), "fingerprint-links")
    parts = connected_components(links, "a", "b").select(F.col("node").alias("fp"), "component")
    named = groups.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    named = stored(named.select("fp", "component").join(firsts, "component").select("fp", "first"), "fingerprint-classes")
    return rows.join(named, "fp")


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row for each row of ``docs``."""
    return near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of every component, with the columns of ``docs``.

    Rows that repeat id and text are one document.
    """
    rows = keyed(docs)
    near = near_duplicates(rows.select(*KEY, "doc.text"), KEY[0], (*KEY[1:],))
    same = reduce(Column.__and__, [F.col(f"first.{k}") == F.col(k) for k in KEY])
    return rows.join(near.where(same).select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY).select("doc.*")
