"""Near-duplicate vectors by sorted projection passes.

In a pass every vector gets the signs of its products with random directions, written one after the
other as one number; vectors of a label are sorted by that number and each is compared with its next
``NEIGHBOURS``. Pairs with a cosine of at least ``COSINE``, in double precision, are links, and links of
all passes are united to components. Signs are taken of the differences to the centre of the label, as a
direction that all vectors share would put too many under one prefix.

Passes come in batches of ``AT_ONCE``, for each label by itself. The size of a label and the mean distance to its centre
give the passes after which a pair right at ``COSINE``, seen from there, has met with probability ``RECALL`` if the
label is spread evenly. Labels that crowd around several centres show it by going on to merge: a label stops only
once it has had these passes and a whole batch has united no two of its components. Pairs that meet with probability p in a
pass and are still apart then number about 1 / (``AT_ONCE`` p), however many there were.

The window bounds candidates; the rest is exact: inside a component all links are counted anew. A
component of up to ``DENSE`` vectors is one product. In a larger one, vectors within half the angle of
``COSINE`` of its centre are all linked with each other, which needs no comparison; the others are
compared with all members block by block. Equal vectors of a label stand for one from the start.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component, and one
with a null label, links with nothing, and is its own component; vectors of different length do not
link; rows that repeat a vec_id are rows like any other; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.materialize import stored
from .common import united

COSINE, NEIGHBOURS, RECALL, MARGIN_BITS = 0.93, 32, 0.999, 2
LEAST_SEEN = 0.5
BITS, AT_ONCE, DENSE, BLOCK, SEED = 62, 8, 512, 2048, 2024


def passes_for(n: Column, spread: Column, neighbours: int = NEIGHBOURS, cosine: float = COSINE, recall: float = RECALL) -> Column:
    """Passes after which two of ``n`` vectors at ``cosine`` have been neighbours with probability ``recall``.

    They are within the window once they share about ``log2(n / neighbours)`` leading signs, and are seen from a centre
    from which the mean squared distance is ``spread``.
    """
    seen = F.when((spread > 0) & (spread < 1), F.greatest(F.lit(min(LEAST_SEEN, cosine)), 1 - (1 - cosine) / spread)).otherwise(cosine)
    bits = F.greatest(F.lit(0.0), F.log2(F.greatest(n, F.lit(1)) / F.lit(neighbours))) + MARGIN_BITS
    return F.greatest(F.lit(1), F.ceil(log(1 - recall) / F.log(1 - F.pow(1 - F.acos(seen) / pi, bits)))).cast("int")


def unit(vectors: Iterable) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as ``vec_id, key``, key null for a vector that links with nothing, and distinct vectors as
    ``key, label, dim, v, n, first``; ``first`` is the smallest vec_id."""
    fine = F.size("embedding") > 0
    fine &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine &= F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    text = F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string")))
    rows = stored(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
        .withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.sha2(F.concat_ws("|", F.col("label").cast("string"), text), 256))), "vectors")
    groups = (rows.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("embedding").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("first")))
    return rows.select("vec_id", "key"), stored(groups.withColumn("dim", F.size("v")).withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")


def _close(x: np.ndarray, cosine: float, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` at most ``neighbours`` apart with at least ``cosine``."""
    left, right = [], []
    for at in range(0, len(x), 256):
        near = x[at:at + 256] @ x[at:at + 256 + neighbours].T >= cosine
        i, j = np.nonzero(near)
        band = (j > i) & (j - i <= neighbours)
        left.append(i[band] + at)
        right.append(j[band] + at)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def label_centres(reps: DataFrame) -> DataFrame:
    """``label, dim, size, spread, centre``: the mean of the unit vectors, and their mean squared distance to it."""
    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, dim), rows in batch.groupby(["label", "dim"]):
                yield pd.DataFrame({"label": [label], "dim": [dim], "n": [len(rows)], "x": [unit(rows["v"]).sum(0).tolist()]})

    kind = reps.schema["label"].dataType.simpleString()
    parts = reps.select("label", "dim", "v").mapInPandas(sums, f"label {kind}, dim int, n long, x array<double>")
    means = (parts.select("label", "dim", "n", F.posexplode("x").alias("i", "x")).groupBy("label", "dim", "i")
             .agg(F.sum("n").alias("size"), (F.sum("x") / F.sum("n")).alias("x")))
    centres = means.groupBy("label", "dim").agg(F.max("size").alias("size"), (1 - F.sum(F.col("x") * F.col("x"))).alias("spread"),
                                                F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    return stored(centres, "vector-centres")


def pass_links(reps: DataFrame, centres: DataFrame, numbers: range, cosine: float, neighbours: int) -> DataFrame:
    """``a, b``: a spanning forest of the links found in the passes ``numbers``, batch by batch."""
    def project(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                x = unit(rows["v"]) - np.array(rows["centre"].tolist())
                for number in numbers:
                    planes = np.random.default_rng([SEED, number, int(dim)]).normal(size=(int(dim), BITS))
                    signs = (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield rows.assign(turn=number, order=signs)[["turn", "label", "dim", "order", "rep", "v"]]

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            for _, run in rows.groupby(["turn", "label", "dim"], sort=False):
                i, j = _close(unit(run["v"]), cosine, neighbours)
                rep, parent = run["rep"].to_numpy(), united(np.arange(len(run)), i, j)
                child = np.flatnonzero(parent != np.arange(len(run)))
                yield pd.DataFrame({"a": rep[child], "b": rep[parent[child]]})
            tail = rows.iloc[-neighbours:]

    kind = reps.schema
    columns = f"turn int, label {kind['label'].dataType.simpleString()}, dim int, order long, rep long, v array<double>"
    order = ["turn", "label", "dim", "order", "rep"]
    return (reps.select("label", "dim", "rep", "v").join(centres.select("label", "dim", "centre"), ["label", "dim"]).mapInPandas(project, columns).repartitionByRange(*order)
            .sortWithinPartitions(*order).mapInPandas(compare, "a long, b long").distinct())


def _runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One component at a time from rows sorted by component."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = rows["component"].iloc[-1] if len(rows) else None
        for name, run in rows.groupby("component", sort=False):
            if name != last:
                yield run
        held = rows[rows["component"] == last] if len(rows) else None
    if held is not None and len(held):
        yield held


def _count(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cosine: float) -> np.ndarray:
    """For each row of ``x``, the weight of rows of ``y`` at ``cosine`` or closer."""
    step = max(1, (1 << 22) // max(1, len(y)))
    return np.concatenate([(x[i:i + step] @ y.T >= cosine) @ weight for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _small(members: DataFrame, cosine: float) -> DataFrame:
    """Exact ``rep, near`` in components that one task holds; ``near`` counts all rows within ``cosine``, itself too."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches):
            x, n = unit(rows["v"]), rows["n"].to_numpy(np.int64)
            own = (np.einsum("ij,ij->i", x, x) < cosine) * n
            yield pd.DataFrame({"rep": rows["rep"].to_numpy(), "near": _count(x, x, n, cosine) + own})
    return members.repartition("component").sortWithinPartitions("component").mapInPandas(run, "rep long, near long")


def _large(members: DataFrame, cosine: float) -> DataFrame:
    """Exact ``rep, near`` in components that no task holds: a core around the centre, then blocks."""
    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("component"):
                yield pd.DataFrame({"component": [name], "centre": [unit(rows["v"]).sum(0).tolist()]})

    centres = (members.select("component", "v").mapInPandas(sums, "component long, centre array<double>")
               .select("component", F.posexplode("centre").alias("i", "x")).groupBy("component", "i").agg(F.sum("x").alias("x"))
               .groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre")))

    def cores(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = acos(cosine) / 2 - 1e-7
        for batch in batches:
            for _, rows in batch.groupby("component"):
                centre = np.asarray(rows["centre"].iloc[0])
                size = np.linalg.norm(centre)
                angle = np.arccos(np.clip(unit(rows["v"]) @ centre / size, -1, 1)) if size > 0 else np.full(len(rows), pi)
                yield rows.drop(columns="centre").assign(core=angle <= half)

    label = members.select("component", "rep", "n", "v")
    marked = stored(label.join(centres, "component").mapInPandas(cores, "component long, rep long, n long, v array<double>, core boolean"), "vector-cores")
    blocks = marked.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("all"), F.ceil(F.count_if(~F.col("core")) / BLOCK).cast("int").alias("rest"),
                                             F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"))
    placed = marked.join(blocks, "component").withColumn("at", F.xxhash64("rep"))
    column = F.pmod("at", F.col("all")).cast("int")
    row = F.pmod("at", F.greatest("rest", F.lit(1))).cast("int")
    right = placed.where("rest > 0").select("component", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("row"), column.alias("column"), F.lit(1).alias("side"), "rep", "n", "v", "core")
    left = placed.where("not core").select("component", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("column"), F.lit(0).alias("side"), "rep", "n", "v", "core")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64")})
        x, y, core = unit(a["v"]), unit(b["v"]), b["core"].to_numpy()
        out = [pd.DataFrame({"rep": a["rep"].to_numpy(), "near": _count(x, y, b["n"].to_numpy(np.int64), cosine)})]
        if core.any():
            out.append(pd.DataFrame({"rep": b["rep"].to_numpy()[core], "near": _count(y[core], x, a["n"].to_numpy(np.int64), cosine)}))
        return pd.concat(out, ignore_index=True)

    crossed = left.unionByName(right).groupBy("component", "row", "column").applyInPandas(compare, "rep long, near long")
    return placed.where("core").select("rep", F.col("core_n").alias("near")).unionByName(crossed).groupBy("rep").agg(F.sum("near").alias("near"))


def vector_parts(reps: DataFrame, cosine: float = COSINE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``rep, label, dim, component`` of all distinct vectors: batches of passes until a label has merged nothing more."""
    active, done = label_centres(reps).withColumn("needed", passes_for(F.col("size"), F.col("spread"), neighbours, cosine)), 0
    parts = reps.select("rep", "label", "dim", F.col("rep").alias("component"))
    while not active.isEmpty():
        found = stored(pass_links(reps, active, range(done, done + AT_ONCE), cosine, neighbours), "vector-links")
        done += AT_ONCE
        a = parts.select(F.col("rep").alias("a"), "label", "dim", F.col("component").alias("ca"))
        b = parts.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
        edges = stored(found.join(a, "a").join(b, "b").where("ca <> cb").select("label", "dim", "ca", "cb").distinct(), "vector-merges")
        merging = edges.select("label", "dim", F.lit(True).alias("merging")).distinct()
        if not edges.isEmpty():
            joined = connected_components(edges, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("to"))
            parts = stored(parts.join(joined, "component", "left").select("rep", "label", "dim", F.coalesce("to", "component").alias("component")), "vector-parts")
        active = stored(active.join(merging, ["label", "dim"], "left").where((F.col("needed") > done) | F.col("merging")).drop("merging"), "vector-labels")
    return parts


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, neighbours: int = NEIGHBOURS, dense: int = DENSE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``vectors(vec_id, embedding, label)``."""
    rows, reps = distinct_vectors(vectors)
    parts = vector_parts(reps, cosine, neighbours)
    shared = parts.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select("component")
    members = stored(reps.join(parts.join(shared, "component").select("rep", "component"), "rep").select("component", "rep", "n", "v", "first"), "vector-components")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.min("first").alias("component_id"))
    sizes = stored(sizes, "vector-sizes")
    near = _small(members.join(sizes.where(F.col("size") <= dense).select("component"), "component", "left_semi"), cosine)
    large = sizes.where(F.col("size") > dense).select("component")
    if not large.isEmpty():
        near = near.unionByName(_large(members.join(large, "component", "left_semi"), cosine))
    known = members.select("component", "rep").join(sizes, "component").join(near, "rep").select("rep", "component_id", "near")
    named = reps.join(known, "rep", "left").select("key", (F.coalesce("near", F.col("n")) - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    return (rows.join(named, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
