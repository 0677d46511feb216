"""Contiguous shards of near equal bytes: the smallest feasible capacity over ordered atomic groups.

Documents stand in the order of a hash of their text, so equal texts are neighbours and any stretch
of the order is a fair sample. The order is cut into 2^20 equal stretches of hash values; a stretch
is never divided, so equal texts stay in one shard. Only the stretches' sizes, at most 2^20 numbers
at any scale, reach the driver. A binary search finds the smallest capacity for which a greedy pass
needs no more shards than there are, and that pass's cuts are taken. A stretch above the capacity
(a text copied so often that it fills more than a shard's share) gets a shard of its own; the
capacity is the smallest for the rest.

Defined cases: a null text has no bytes, crc32 0 and a group of its own; a size is the text's bytes
plus 8; rows that repeat a doc_id are rows like any other; with fewer groups than shards the last
shards stay empty; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import stored
from .common import numbered

SHARDS = 24
ROW_BYTES = 8
STRETCH_BITS = 20


def smallest_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The capacity, and the first index of every shard but the first.

    ``sizes`` are positive. Each group above the capacity stands alone; the others fill shards in order
    up to the capacity.
    """
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n = len(sizes)

    def cuts(capacity: int) -> list[int] | None:
        large, starts, at = np.flatnonzero(sizes > capacity), [], 0
        if len(large) > shards:
            return None
        while at < n:
            starts.append(at)
            if len(starts) > shards:
                return None
            stop = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
            at = min(max(stop, at + 1), n)
        return starts

    low, high = max(1, -(-int(ends[-1]) // (shards * 1024))), max(1, int(ends[-1]))
    while low < high:
        middle = (low + high) // 2
        if cuts(middle) is None:
            low = middle + 1
        else:
            high = middle
    return high, (cuts(high) or [0])[1:]


def _stretch(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - STRETCH_BITS).cast("int")


def shard_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, a row for each row of ``docs``.

    ``slot`` numbers the rows of a shard from 0. Rows are dealt by range of (hash, doc_id), so copies
    of one text spread over tasks, and numbered inside (task, shard) after a count of those pairs.
    """
    sized = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("key"))
    # the order of hashes as unsigned numbers, as the stretches are cut
    sized = sized.withColumn("stretch", _stretch(F.col("key")))
    placed = stored(sized.repartitionByRange("stretch", "key", "doc_id").withColumn("task", F.spark_partition_id()), "shard-rows")
    groups = placed.groupBy("stretch").agg(F.sum("size").alias("size")).toPandas().sort_values("stretch")
    found = groups["stretch"].to_numpy()
    _, starts = smallest_cuts(groups["size"].to_numpy(np.int64), shards) if len(groups) else (0, [])
    bounds = F.array(*[F.lit(int(found[s])) for s in starts]) if starts else F.array().cast("array<int>")
    numbered = placed.withColumn("shard", F.size(F.filter(bounds, lambda first: first <= F.col("stretch"))))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = (numbered.groupBy("shard", "task").agg(F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("shard", "task").orderBy("stretch", "key", "doc_id")
    return (numbered.withColumn("at", F.row_number().over(inside) - 1).join(counts, ["shard", "task"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, which replace columns of these names.

    Rows meet their place by a row number that a written table keeps, so repeated ids stay apart.
    """
    rows = stored(numbered(docs.drop("shard", "slot")), "shard-documents")
    places = shard_bytes(rows.select(F.col("row").alias("doc_id"), "doc.text"), shards)
    return rows.join(places.select(F.col("doc_id").alias("row"), "shard", "slot"), "row").select("doc.*", "shard", "slot")
