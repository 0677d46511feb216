"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of ``LEAST`` or more.

Equal sets stand for one from the start. ``BANDS`` keys, each of ``ROWS`` MinHash values, say which sets can
have a copy at all: a pair right at ``LEAST`` shares a key with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.99993,
more similar pairs with more. Links, those of fingerprints too, are counted exactly on stored sets of shingle hashes.

First the tries of :mod:`.simhash` link the fingerprints of the texts, and linked sets that are similar are united. Then
each set is compared with a leader of each of its keys, in ``LEADERS`` rounds, which unites dense
groups at one comparison a set. Sets that still share a key with a set of another component then meet in an exact prefix-filter
join, which needs no all-pairs step: a set's shingles are ordered by the number of open sets that have them, rarest first, and
two sets are a candidate only if a shingle lies so early in both that enough of either is left for a
similarity of ``LEAST``. Shingles of one set alone can't match and only push the others back, so sets
that differ in too much of their own name no shared shingle at all. A set looks for
smaller ones by class of size, as the less similar the sizes are, the fewer shingles need to be looked at. Shingles that
many sets name are split by their counts, and shingles whose sets all lie in one component are left out.

Defined cases: words are lower-cased ASCII-wise and split at ASCII white space; a text of fewer than
five words is one shingle; texts without words, null or empty, are copies of each other; rows that
repeat id and text are one document; a null id is an id of its own and comes last; an empty table gives no rows; other columns, of whatever name,
are kept and not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.materialize import stored
from .common import KEY, keyed
from .simhash import fingerprint, trie_join

SHINGLE, SEED = 5, 42
#: The least similarity as a fraction: 4 / 5.
PART, WHOLE = 4, 5
LEAST = PART / WHOLE
BANDS, ROWS, LEADERS = 24, 5, 2
#: MinHash values taken at once; growth from one class of sizes to the next; sets that one task holds of a shingle.
STEP, CLASS, SLICE = 2048, 1.05, 4096
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_MIX[0] |= np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of all 5-word shingles in order; of the whole sequence, if it is shorter."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """``BANDS`` keys of a set, as signed longs; none of the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[at:at + STEP] * _MIX[0] + _MIX[1]).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sketches(docs: DataFrame) -> DataFrame:
    """``KEY, node, fp, bands``: ``node`` is a digest of the set of shingles, ``fp`` the SimHash of the text as a signed long."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets = [shingles(t) for t in texts]
            nodes = pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string())
            fps = np.array([fingerprint((t or b"").lower().split()) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), nodes, pa.array(fps.view(np.int64)), pa.array(map(band_keys, sets), pa.list_(pa.int64()))],
                                             [*KEY, "node", "fp", "bands"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*KEY).schema)
    return docs.select(*KEY, "text").mapInArrow(run, f"{kinds}, node string, fp long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """``node, n, hashes`` of ``texts(node, text)``: the distinct hashes of every text's shingles."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingles(t).view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(map(len, sets), pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "hashes"])
    return texts.select("node", "text").mapInArrow(run, "node string, n int, hashes array<long>")


def _needed(n: Column, m: Column) -> Column:
    """The least number of common shingles of sets of ``n`` and ``m`` at a similarity of ``LEAST``."""
    return F.ceil(PART * (n + m) / F.lit(PART + WHOLE) - 1e-9).cast("int")


def _sizes_fit(n: Column, m: Column) -> Column:
    return WHOLE * F.least(n, m) >= PART * F.greatest(n, m)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``ca, cb``: components joined by those of ``pairs(a, b, ca, cb)`` that are similar, counted on their sets."""
    left, right = (sets.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("hashes").alias(f"h{s}")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b").where(_sizes_fit(F.col("na"), F.col("nb")))
    return both.where((PART + WHOLE) * F.size(F.array_intersect("ha", "hb")) >= PART * (F.col("na") + F.col("nb"))).select("ca", "cb").distinct()


def _near_fingerprints(sketches: DataFrame) -> DataFrame:
    """``a, b, ca, cb``: every set with the head of its fingerprint, the smallest set that has it, and the heads of
    fingerprints that the tries link."""
    heads = stored(sketches.groupBy("fp").agg(F.min("node").alias("head")), "copies-fingerprints")
    own = sketches.select("fp", "node").distinct().join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    first, second = (heads.select(F.col("fp").alias(f), F.col("head").alias(s)) for f, s in (("x", "a"), ("y", "b")))
    linked = trie_join(heads.select("fp")).toDF("x", "y").join(first, "x").join(second, "y").select("a", "b")
    return own.unionByName(linked).where("a <> b").distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """``key, node, n, component`` of sets under keys that several components share."""
    placed = members.join(parts, "node")
    kinds = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return placed.join(kinds.where("low <> high").select("key"), "key")


def _with_leaders(placed: DataFrame, turn: int) -> DataFrame:
    """``a, b, ca, cb``: every set with a leader of each of its keys, another one each turn."""
    lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), "node", "component", "n")).alias("x")
    pairs = placed.join(placed.groupBy("key").agg(lead), "key").where((F.col("component") != F.col("x.component")) & _sizes_fit(F.col("n"), F.col("x.n")))
    return pairs.select(F.col("node").alias("a"), F.col("x.node").alias("b"), F.col("component").alias("ca"), F.col("x.component").alias("cb")).distinct()


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(CLASS)) + 1e-9).cast("int")


def prefix_pairs(sets: DataFrame, held: int = SLICE) -> DataFrame:
    """``a, b, ca, cb``: all pairs of ``sets(node, n, component, hashes)`` of different components that can
    be similar, judged by the place of a common shingle in both."""
    tokens = sets.select("node", "n", "component", F.explode("hashes").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("f"), F.min("component").alias("low"), F.max("component").alias("high")).where("f > 1")
    shared = tokens.join(counts.select("token", "f", (F.col("low") != F.col("high")).alias("mixed")), "token")
    ordered = shared.groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("f", "token", "mixed"))).alias("order"))
    n, place = F.col("n"), F.col("place")
    placed = stored(ordered.select("node", "n", "component", F.size("order").alias("known"), F.posexplode("order").alias("i", "t"))
                    .select("node", "n", "component", "t.token", "t.mixed", (F.col("i") + n - F.col("known")).alias("place"))
                    .where(F.col("mixed") & (place <= n - _needed(n, F.ceil(n * LEAST - 1e-9).cast("int")))).drop("mixed"), "copies-prefixes")
    index = placed.where(place <= n - _needed(n, n)).select("token", _class(n).alias("class"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb"), F.col("place").alias("j"))
    slices = stored(index.groupBy("token", "class").agg(F.ceil(F.count("*") / held).cast("int").alias("slices")), "copies-slices")
    least = F.ceil(n * LEAST - 1e-9)
    lowest = F.greatest(least, F.ceil(F.pow(F.lit(CLASS), F.col("class") - 1e-6))).cast("int")
    probe = (placed.withColumn("class", F.explode(F.sequence(_class(least), _class(n)))).where(place <= n - _needed(n, lowest))
             .join(slices, ["token", "class"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))))
    index = index.join(slices.where("slices > 1"), ["token", "class"], "left").withColumn("slice", F.pmod(F.xxhash64("b"), F.coalesce("slices", F.lit(1))).cast("int"))
    m, common = F.col("m"), _needed(n, F.col("m"))
    smaller = (m < n) | ((m == n) & (F.col("b") < F.col("node")))
    fits = smaller & _sizes_fit(n, m) & (F.col("component") != F.col("cb")) & (place <= n - common) & (F.col("j") <= m - common)
    return (probe.join(index.drop("slices"), ["token", "class", "slice"]).where(fits)
            .select(F.col("node").alias("a"), "b", F.col("component").alias("ca"), "cb").distinct())


def firsts(rows: DataFrame) -> DataFrame:
    """``KEY`` of the first document of every component of ``rows(KEY, text)``."""
    sketches = stored(_sketches(rows), "copies-sketches")
    groups = stored(sketches.groupBy("node").agg(F.min(F.struct(*KEY)).alias("first"), F.first("bands").alias("bands")), "copies-sets")
    buckets = groups.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(buckets.join(shared, "key"), "copies-members")
    near = stored(_near_fingerprints(sketches), "copies-fingerprint-pairs")
    known = members.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = groups.join(known, "node").select("node", "first.*")
    sets = stored(_sets(rows.join(wanted, KEY).select("node", "text").dropDuplicates(["node"])), "copies-hashes")
    parts = sets.select("node", "n", F.col("node").alias("component"))
    for turn in range(-1, LEADERS + 1):
        if turn < 0:
            pairs = near
        elif turn < LEADERS:
            pairs = stored(_with_leaders(_open(members, parts), turn), "copies-pairs")
        else:
            pairs = stored(prefix_pairs(_open(members, parts).select("node", "component").distinct().join(sets, "node")), "copies-pairs")
        links = stored(_links(pairs, sets), "copies-links")
        if not links.isEmpty():
            joined = connected_components(links, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("to"))
            parts = stored(parts.join(joined, "component", "left").select("node", "n", F.coalesce("to", "component").alias("component")), "copies-parts")
    named = groups.select("node", "first").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.groupBy("component").agg(F.min("first").alias("first")).select("first.*")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of every component of near copies, with the columns of ``docs``.

    Rows that repeat id and text are one document.
    """
    rows = keyed(docs)
    first = firsts(rows.select(*KEY, F.col("doc.text").alias("text")))
    return rows.join(first, KEY, "left_semi").dropDuplicates(KEY).select("doc.*")
