"""Benchmark decontamination by winnowing.

Of the hashes of all k-word grams, the smallest in every stretch of ``GUARANTEE - k + 1`` grams is
kept, in documents as in items; so two texts that share ``GUARANTEE`` words in a row keep a common
hash at the same place of that span. Document hashes that no item keeps are thrown out by a bit map
of fixed size while they are still inside the document's row. The rest, a few per cent, is extended
to the windows of ``GUARANTEE`` words around it, and windows are joined as text, so every hit is exact.
Items below ``GUARANTEE`` words are one window of their own length ``n``: for every such length the
hash of all n-word grams is kept (a stretch of one), and the rest is the same.

DataFrame functions only. A document is never exploded into its words; only surviving windows are.

Defined cases: a null text has no words; a document without words has no hit and is not
contaminated; an item without words has no window; an item without an id still marks words but is
not listed; rows that repeat a doc_id are judged each by itself, items that repeat an id count once;
empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import stored
from .common import KEY, ascii_lower, keyed

WINDOW = 13
K = 5
#: Bits of the map that drops document hashes; a fuller map lets more candidates through, never fewer.
MAP_BITS = 18
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 20


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def _grams(w: str, k: int) -> Column:
    """31 bits of each k-gram's hash above its position, which is below 2^32."""
    def gram(at: Column) -> Column:
        hashed = F.xxhash64(*[F.get(F.col(w), at + i) for i in range(k)])
        return F.shiftleft(hashed.bitwiseAND(F.lit((1 << 31) - 1)), 32) + at
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), gram)).otherwise(F.array().cast("array<bigint>"))


def _winnowed(df: DataFrame, w: str, k: int, stretch: int, out: str) -> DataFrame:
    """``out``: the kept grams, a value of :func:`_grams` each."""
    df = df.withColumn(out, _grams(w, k))
    if stretch == 1:
        return df
    last = F.size(out) - stretch + 1
    least = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.array_min(F.slice(out, at, stretch)))
    return df.withColumn(out, F.when(last >= 1, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>")))


def _hash(value: Column) -> Column:
    return F.shiftright(value, 32)


class Benchmark:
    """Windows and kept hashes of the items, written once."""

    def __init__(self, items: DataFrame, window: int = WINDOW, k: int = K) -> None:
        self.window, self.k = window, k
        worded = stored(items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0), "benchmark-words")
        length = F.least(F.size("w"), F.lit(window))
        grams = worded.select("item_id", length.alias("len"), F.explode(F.transform(
            F.sequence(F.lit(1), F.size("w") - length + 1), lambda at: F.concat_ws(" ", F.slice("w", at, length)))).alias("gram"))
        self.windows = stored(grams.groupBy("gram", "len").agg(F.collect_set("item_id").alias("items")), "benchmark-windows")
        # at most window - 1 numbers
        self.short = sorted(r[0] for r in worded.where(F.size("w") < window).select(F.size("w")).distinct().collect())
        kept = [_winnowed(worded.where(F.size("w") >= window), "w", k, window - k + 1, "f").select(F.explode("f").alias("v"))]
        kept += [_winnowed(worded.where(F.size("w") == n), "w", n, 1, "f").select(F.explode("f").alias("v")) for n in self.short]
        at = _hash(F.col("v")).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
        cells = (reduce(DataFrame.unionByName, kept).groupBy(F.shiftright(at, 6).cast("int").alias("cell"))
                 .agg(F.bit_or(F.expr(f"shiftleft(1L, cast((shiftright(v, 32) & {(1 << MAP_BITS) - 1}) & 63 as int))")).alias("bits")).collect())
        bits = [0] * (1 << MAP_BITS - 6)
        for cell, value in cells:
            bits[cell] = value
        self.map = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")

    def candidates(self, df: DataFrame, w: str, out: str) -> DataFrame:
        """``out``: windows of ``w`` around grams that an item may have kept, ``struct<start, len, gram>``."""
        def may_match(v: Column) -> Column:
            at = _hash(v).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
            bits = F.get(self.map, F.shiftright(at, 6).cast("int"))
            return F.getbit(bits, at.bitwiseAND(F.lit(63)).cast("int")) == 1

        def around(length: int, k: int):
            def windows(v: Column) -> Column:
                at = v.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
                first, last = F.greatest(at - (length - k), F.lit(0)), F.least(at, F.size(w) - length)
                return F.transform(F.sequence(first, last), lambda s: F.struct(
                    s.alias("start"), F.lit(length).alias("len"), F.concat_ws(" ", F.slice(w, s + 1, length)).alias("gram")))
            return windows

        parts = []
        for i, (length, k, stretch) in enumerate([(self.window, self.k, self.window - self.k + 1), *((n, n, 1) for n in self.short)]):
            df = _winnowed(df, w, k, stretch, f"_kept{i}")
            df = df.withColumn(f"_kept{i}", F.filter(f"_kept{i}", may_match))
            parts.append(F.flatten(F.transform(f"_kept{i}", around(length, k))))
        return df.withColumn(out, F.array_distinct(F.concat(*parts))).drop(*[f"_kept{i}" for i in range(len(parts))])


def hits(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """All rows of ``docs`` as ``row_id, *keep, n_words``, and for rows with hits ``row_id, spans,
    items``: the windows that occur as ``struct<start, len>`` in order, and the items they are from."""
    bench = Benchmark(items, window, k)
    worded = docs.select(F.monotonically_increasing_id().alias("row_id"), *keep, words(F.col("text")).alias("_w"))
    found = stored(bench.candidates(worded, "_w", "_windows").select("row_id", *keep, F.size("_w").cast("long").alias("n_words"), "_windows"), "contamination")
    matched = (found.select("row_id", F.explode("_windows").alias("x")).select("row_id", "x.start", "x.len", "x.gram")
               .join(bench.windows, ["gram", "len"]))
    spans = matched.groupBy("row_id").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"),
                                          F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return found.drop("_windows"), spans


def _covered(spans: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"])).cast("long")).alias("n"),
                        F.greatest(acc["end"], end).alias("end"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row for each row of ``docs``.

    ``keep`` names the columns to return instead of ``doc_id``.
    """
    keep = ["doc_id"] if keep is None else keep
    rows, spans = hits(docs, items, keep)
    ids = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string")))
    judged = rows.join(spans, "row_id", "left").select(
        *keep, "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"))
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, with their own columns."""
    rows = keyed(docs)
    bad = contamination(rows.select(*KEY, "doc.text"), items, KEY).where("contaminated").select(*KEY).distinct()
    return rows.join(bad, KEY, "left_anti").select("doc.*")


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (
  select distinct item_id, least(len(w), 13) n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') gram
  from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) s from b where len(w) > 0)),
dw as (
  select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') gram
  from (select *, unnest(range(1, len(w) - n + 2)) s from d, (select distinct n from bw) where len(w) >= n)),
hit as (select doc_id, s, dw.n, item_id from dw join bw using (gram, n)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from hit) group by 1),
its as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids
        from (select distinct doc_id, cast(item_id as varchar) i from hit) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
