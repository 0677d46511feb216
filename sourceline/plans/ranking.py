"""Ranking that does not gather a group in one task.

A plain ``row_number() over (partition by deck)`` sorts a whole deck in one task, which
fails when one deck holds a third of the corpus. The helpers here cut a group into
order-preserving buckets, count the buckets (map-side combined), prefix-sum the counts and
rank inside each bucket only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import stored

Order = Sequence[Column | str]


def top_n(df: DataFrame, partition: Sequence[str], order: Order, n: int, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..n per group. The rank filter lets Spark keep only n rows per group and
    map task before the shuffle (window group limit)."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_per_group(df: DataFrame, partition: Sequence[str], order: Order) -> DataFrame:
    return top_n(df, partition, order, 1, "_first").drop("_first")


def _bucket_offsets(df: DataFrame, group: Sequence[str], descending: bool = False) -> DataFrame:
    """``group, _bucket, _before``: rows of the group in earlier buckets."""
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def number_rows(df: DataFrame, group: Sequence[str], order: str, out: str,
                ties: Sequence[str] = (), width: int = 1 << 16) -> DataFrame:
    """``row_number() over (partition by group order by order, ties)`` for an integer order
    column, at most ``width`` distinct order values per task."""
    keyed = df.withColumn("_bucket", F.floor(F.col(order) / width))
    local = Window.partitionBy(*group, "_bucket").orderBy(F.col(order), *[F.col(t) for t in ties])
    ranked = keyed.withColumn("_local", F.row_number().over(local))
    return (ranked.join(_bucket_offsets(keyed, group), [*group, "_bucket"])
            .withColumn(out, (F.col("_local") + F.col("_before")).cast("int"))
            .drop("_bucket", "_local", "_before"))


def number_ordered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``row_number() over (partition by group order by order)`` for any sortable columns.

    Rows are dealt by range of (group, order), so a group of any size spreads by measured counts; a
    task numbers its rows of a group and adds the rows of that group in earlier tasks.
    """
    placed = stored(df.repartitionByRange(*group, *order).withColumn("_task", F.spark_partition_id()), "numbered")
    counts = placed.groupBy(*group, "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*group, "_task").orderBy(*order)
    return (placed.withColumn("_local", F.row_number().over(local)).join(offsets, [*group, "_task"])
            .withColumn(out, (F.col("_local") + F.col("_before")).cast("int")).drop("_task", "_local", "_before"))


def ranks_of(scored: DataFrame, wanted: DataFrame, group: str, ident: str, score: str,
             bucket: Callable[[Column], Column], out: str = "rank") -> DataFrame:
    """Exact rank (score descending, id ascending) of a few wanted rows among all scored rows.

    Only the buckets that hold a wanted row are ranked; the rest are just counted.
    """
    keyed = scored.withColumn("_bucket", bucket(F.col(score)))
    offsets = _bucket_offsets(keyed, [group], descending=True)
    mine = wanted.select(group, ident).join(keyed, [group, ident])
    touched = mine.select(group, "_bucket").distinct()
    local = Window.partitionBy(group, "_bucket").orderBy(F.col(score).desc(), F.col(ident))
    ranked = (keyed.join(touched, [group, "_bucket"], "left_semi")
              .withColumn("_local", F.row_number().over(local)))
    return (wanted.select(group, ident).join(ranked, [group, ident])
            .join(offsets, [group, "_bucket"])
            .select(group, ident, score, (F.col("_local") + F.col("_before")).cast("int").alias(out)))


def exact_index(df: DataFrame, group: Sequence[str], value: str,
                positions: dict[str, Callable[[Column], Column]], width: float = 1.0) -> DataFrame:
    """Values at exact zero-based positions of the sorted group, one column per position.

    Equal values are counted together first. A bucket is ``width`` wide, so the ordering
    windows see bucket totals and the distinct values of single buckets, never a group.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
              .withColumn("_bucket", F.floor(F.col(value) / width)))
    totals = counts.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_total"))
    running = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = totals.withColumn("_end", F.sum("_total").over(running))
    sizes = totals.groupBy(*group).agg(F.sum("_total").alias("_size"))
    targets = sizes.select(*group, F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), at(F.col("_size")).cast("bigint").alias("at"))
        for name, at in positions.items()])).alias("_t"))
    keys = list(group)
    hit = ((F.col("_t.at") >= F.col("_end") - F.col("_total")) & (F.col("_t.at") < F.col("_end")))
    buckets = (ends.join(targets, keys).where(hit) if keys else ends.join(targets, hit)).select(
        *keys, "_bucket", F.col("_t.name").alias("_name"), F.col("_t.at").alias("_at"),
        (F.col("_end") - F.col("_total")).alias("_before"))
    inside = Window.partitionBy(*keys, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = (counts.join(buckets, [*keys, "_bucket"])
             .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
             .where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n"))))
    return found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in positions])


def median_high(n: Column) -> Column:
    return F.floor(n / 2)


def at_share(share: float) -> Callable[[Column], Column]:
    """Position ``min(n - 1, int(n * share))``."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(share)))
