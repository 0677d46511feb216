"""Mixing sources to target weights by a low-discrepancy schedule.

Sources share the words of all documents by weight, none above ``max_repeat`` times its own. Slots
of the mix are dealt to sources by golden-ratio points mapped through the cumulative targets, so any
stretch of the mix holds each source in proportion. A source's documents stand in a shuffled order,
their words cut into blocks of equal length, to a word; its k-th slot takes its k-th block, starting over when
the source is used up.

Everything is DataFrame operations. A source is never in one task: running sums go over hash
buckets of its documents and chunks of its slots; segments meet slots on ``(source, slot)``.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; rows that
repeat a doc_id count each by itself; documents without words are never taken; when no document
has a word every target is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import stored
from .common import WORD, numbered

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 1024
#: Golden-ratio points on a lattice of 2^31: i * GOLDEN mod 2^31, exact in long arithmetic.
LATTICE, GOLDEN = 1 << 31, 1327217885
BUCKETS, CHUNK, CELLS = 4096, 4096, 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, source, size`` as a written table: the texts are read once and row ids stay."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source",
                              word_count("text").alias("size")), "mix-sizes")


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``src, source, source_size, target, length``, one row per source.

    With sources in the order of cap / weight, the level ``(words left) / (weight left)`` rises while
    sources are capped and falls after, so its maximum is the level at which nobody is above a cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (rows.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("src", F.row_number().over(by_name))
            .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") - 1) % len(weights) + 1))
            .withColumn("cap", F.col("source_size") * max_repeat)
            .withColumn("total", F.sum("source_size").over(every))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
                        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
            .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")))
            .select("src", "source", "source_size", "target", F.round("target").cast("long").alias("length"), "total"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, src, k``: the k-th slot of source ``src`` is slot number ``slot`` of the mix.

    A source with a target but without a point gets one slot after all others.
    """
    spark = sources.sparkSession
    total = sources.agg(F.max("total")).first()[0] or 0
    n = -(-total // block)
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    cut = sources.where("target > 0").withColumn("high", F.sum("target").over(upto)).withColumn("low", F.col("high") - F.col("target"))
    whole = F.max("high").over(Window.partitionBy())
    cut = cut.select("src", (F.col("low") / whole).alias("low"), F.when(F.col("high") == whole, 1.0).otherwise(F.col("high") / whole).alias("high"))
    cells = cut.select("src", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(LATTICE)) * F.lit(GOLDEN), F.lit(LATTICE)) / F.lit(float(LATTICE))
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    dealt = points.join(cells, "cell").where("low <= point and point < high").select("slot", "src", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    dealt = stored(dealt, "mix-slots")
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = dealt.groupBy("src", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = (dealt.withColumn("k", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1)
              .join(chunks, ["src", "chunk"]).select("slot", "src", (F.col("k") + F.col("before")).alias("k")))
    missing = (sources.where("length > 0").join(dealt.select("src").distinct(), "src", "left_anti")
               .select((F.lit(n) + F.row_number().over(Window.orderBy("src")) - 1).alias("slot"), "src", F.lit(0).cast("long").alias("k")))
    return ranked.unionByName(missing)


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``row_id, doc_id, src, size, source_size, length, start``: where a document's words begin among
    those of its source in shuffled order."""
    keyed = (rows.join(sources.drop("total"), rows["source"].eqNullSafe(sources["source"])).drop("source")
             .withColumn("order", F.xxhash64("doc_id", "size")).withColumn("bucket", F.shiftrightunsigned("order", 52)))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
               .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("src", "bucket").orderBy("order", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    return (keyed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, ["src", "bucket"]).withColumn("start", F.col("start") + F.col("before"))
            .drop("before", "order", "bucket"))


def _epochs(docs: DataFrame) -> DataFrame:
    """A row for each time that the mix reaches a document; ``low``, ``high``: words of the source's stream."""
    last = F.when(F.col("length") > 0, F.floor((F.col("length") - 1) / F.greatest("source_size", F.lit(1)))).otherwise(-1)
    turns = docs.withColumn("last", last).where("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return (turns.withColumn("low", F.col("epoch") * F.col("source_size") + F.col("start"))
            .withColumn("high", F.least(F.col("low") + F.col("size"), F.col("length"))).where("low < length"))


def mixture(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: ``slot, src, row_id, doc_id, epoch, low, high, first_word``, a row for each piece of a
    document in a slot. ``low`` orders the pieces of a slot; a piece has ``high - low`` words."""
    slots = schedule(sources, block)
    counts = slots.groupBy("src").agg(F.count("*").alias("slots"))
    turns = _epochs(placed(rows, sources).join(counts, "src")).where("low < high")
    n, length = F.col("slots"), F.col("length")

    def begin(k: Column) -> Column:
        return F.when(k >= n, length).otherwise(F.floor(k * length.cast("double") / n))

    def near(word: Column) -> Column:
        return F.floor(word.cast("double") * n / length)

    # a slot more on either side, for words at a border; empty pieces fall away
    reach = F.sequence(F.greatest(near(F.col("low")) - 1, F.lit(0)), F.least(near(F.col("high")) + 1, n - 1))
    pieces = (turns.withColumn("k", F.explode(reach))
              .withColumn("from", F.greatest("low", begin(F.col("k"))))
              .withColumn("to", F.least("high", begin(F.col("k") + 1))).where("from < to"))
    return (pieces.join(slots, ["src", "k"])
            .select("slot", "src", "row_id", "doc_id", "epoch", F.col("from").alias("low"), F.col("to").alias("high"),
                    (F.col("from") - F.col("low")).alias("first_word")))


def mixed_words(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, a row for each row of ``docs``."""
    rows = sized(docs)
    sources = stored(targets(rows, weights, max_repeat), "mix-sources")
    taken = mixture(rows, sources, block).groupBy("row_id").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    named = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(rows["row_id"], "doc_id", "size", "source_size", "target")
    return named.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` repeated as the mix begins them: 0 to ``max_repeat`` times each, with the same columns."""
    numbers = stored(numbered(docs), "mix-documents")
    rows = stored(numbers.select(F.col("row").alias("row_id"), "doc.doc_id", "doc.source", word_count("doc.text").alias("size")), "mix-sizes")
    sources = stored(targets(rows, weights, max_repeat), "mix-sources")
    starts = mixture(rows, sources).where("first_word = 0").select(F.col("row_id").alias("row"))
    return numbers.join(starts, "row").select("doc.*")
