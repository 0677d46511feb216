"""Lexical index tables.

Documents are placed by id once; everything after that (term counts per document, score
sums per document and query) keys on the document id first, so it needs no further shuffle
of postings. Only tiny tables travel: term statistics and the best hits per query.

At rest an index is two tables: postings in folders by bucket of the term, and the statistics of every
term. A search reads the folders of its terms and counts nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_words, lexical_tokens
from ..plans.materialize import stored

DOC = ""    # pseudo term: one posting per document, so corpus size comes out of the same pass
BUCKETS = 64    # folders of postings at rest
FEW_TERMS = 1 << 20     # terms that are sent to where texts are counted
TASK_CHARS = 8 << 20    # characters of text that one task cuts into terms and counts


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """``postings(scope..., id, dl, term, tf)``; ``scope`` separates independent corpora."""
    postings: DataFrame
    scope: tuple[str, ...] = ()
    placed: bool = True      # postings are hash-partitioned by id
    counted: DataFrame | None = None    # statistics kept with the index; postings at rest then have a bucket
    texts: DataFrame | None = None      # scope..., id, tokens: what the postings are counted from

    def about(self, terms: DataFrame) -> "Index":
        """Only the postings of the given terms (and the document counters)."""
        keys = [*self.scope, "term"]
        wanted = terms.select(*keys).where(F.col("term") != DOC).distinct()
        if "bucket" in self.postings.columns:
            kept = self.postings.join(wanted.withColumn("bucket", _bucket(F.col("term"))), [*keys, "bucket"], "left_semi")
            sizes = self.counted.where(F.col("term") == DOC)
            return Index(kept, self.scope, self.placed, self.counted.join(wanted, keys, "left_semi").unionByName(sizes))
        counters = self.postings.where(F.col("term") == DOC)
        kept = self.postings.where(F.col("term") != DOC).join(wanted, keys, "left_semi")
        return Index(kept.unionByName(counters), self.scope, self.placed)

    def counts(self) -> DataFrame:
        """``scope..., term, df, _len``, with the pseudo term."""
        if self.counted is not None:
            return self.counted
        return self.postings.groupBy(*self.scope, "term").agg(F.count("*").alias("df"), F.sum("dl").alias("_len"))

    def term_stats(self) -> DataFrame:
        """``scope..., term, df, idf``, without the pseudo term."""
        return _with_idf(self.counts(), self.scope)


def _with_idf(grouped: DataFrame, scope: Sequence[str]) -> DataFrame:
    size = grouped.where(F.col("term") == DOC).select(
        *scope, F.col("df").alias("n_docs"), (F.col("_len") / F.col("df")).alias("avgdl"))
    terms = grouped.where(F.col("term") != DOC).drop("_len")
    if scope:
        joined = terms.join(size, list(scope))
    else:
        joined = (terms.withColumn("n_docs", size.select("n_docs").scalar())
                  .withColumn("avgdl", size.select("avgdl").scalar()))
    return joined.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _placed(texts: DataFrame) -> DataFrame:
    """Rows of ``id, _text`` dealt by id to tasks of a bounded size, which stays as it is however the shuffle compresses."""
    chars = texts.agg(F.sum(F.length("_text"))).first()[0] or 0
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(max(least, -(-chars // TASK_CHARS)), "id")


def build_index(docs: DataFrame, ident: str = "id", text: str = "text", scope: Sequence[str] = (),
                tokens: Callable[[Column], Column] = lexical_tokens) -> Index:
    placed = _placed(docs.select(*scope, F.col(ident).alias("id"), F.col(text).alias("_text")))
    exploded = (placed.withColumn("_tok", tokens(F.coalesce(F.col("_text"), F.lit(""))))
                .select(*scope, "id", F.size("_tok").alias("dl"),
                        F.explode(F.concat("_tok", F.array(F.lit(DOC)))).alias("term")))
    texts = docs.select(*scope, F.col(ident).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    return Index(exploded.groupBy(*scope, "id", "dl", "term").agg(F.count("*").alias("tf")), tuple(scope), texts=texts)


def write_index(index: Index, path: str) -> None:
    """Postings and term statistics at rest.

    A bucket of terms is a folder, dealt by id to as many files as the shuffle has partitions for it, so
    a term that most documents have never meets in one task. Rows are in order of their term.
    """
    spark = index.postings.sparkSession
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    placed = index.postings.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.hash("id"), F.lit(parts)))
    placed.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    Index(spark.read.parquet(f"{path}/postings"), index.scope).counts().write.mode("overwrite").parquet(f"{path}/terms")


def read_index(spark: SparkSession, path: str, scope: Sequence[str] = ()) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), tuple(scope), False, spark.read.parquet(f"{path}/terms"))


def counts_of_terms(index: Index, terms: DataFrame, few: int = FEW_TERMS) -> DataFrame:
    """``scope..., term, df, _len`` as :meth:`Index.counts`, of the given ``terms(scope..., term)`` and the pseudo term.

    Texts are counted where they are read. Equal ids of one length are one document, so the rows of the few ids that
    come again meet first; if many do, postings are counted.
    """
    scope, texts = list(index.scope), index.texts
    keys = [*scope, "term"]
    terms = stored(terms.select(*keys).distinct(), "wanted-terms")
    again = stored(texts.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id")), "repeated-ids")
    repeated = again.count()
    if repeated > few:
        counts = index.counts()
    else:
        found = lambda df: df.select(*scope, "id", F.size("tokens").alias("dl"), F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(DOC)))).alias("term"))
        rows, same = found(texts), F.col("id").eqNullSafe(F.col("_id"))
        if repeated:
            rows = found(texts.join(F.broadcast(again), same, "left_anti")).unionByName(
                found(texts.join(F.broadcast(again), same, "left_semi")).distinct())
        if terms.count() <= few:
            # the pseudo term belongs to every scope, so it is kept by its name
            rows = rows.join(F.broadcast(terms.withColumn("_asked", F.lit(True))), keys, "left").where(
                F.col("_asked") | (F.col("term") == DOC))
        counts = rows.groupBy(*keys).agg(F.count("*").alias("df"), F.sum("dl").alias("_len"))
    wanted = terms.withColumn("_wanted", F.lit(True))
    return counts.join(wanted, keys, "left").where(F.col("_wanted") | (F.col("term") == DOC)).drop("_wanted")


def index_summary(index: Index) -> DataFrame:
    """``scope..., n_docs, avgdl, n_terms, n_postings``."""
    counters = index.postings.where(F.col("term") == DOC).groupBy(*index.scope).agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    terms = (index.postings.where(F.col("term") != DOC).groupBy(*index.scope, "term").agg(F.count("*").alias("df"))
             .groupBy(*index.scope).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings")))
    if index.scope:
        return counters.join(terms, list(index.scope))
    return (counters.withColumn("n_terms", terms.select("n_terms").scalar())
            .withColumn("n_postings", terms.select("n_postings").scalar()))


def vocabulary(docs: DataFrame, ident: str = "id", text: str = "text", scope: Sequence[str] = (),
               words: Callable[[Column], Column] = content_words) -> DataFrame:
    """``scope..., word, df, idf`` with idf = ln(1 + N/df) over distinct content words per
    document. N counts every document of the scope, wordless ones too."""
    per_doc = docs.select(*scope, F.explode(F.array_distinct(
        F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.lower(w)))).alias("word"))
    terms = per_doc.groupBy(*scope, "word").agg(F.count("*").alias("df")).where(F.col("word") != DOC)
    # counted by itself: the texts of the documents are cut into words once
    size = docs.groupBy(*scope).agg(F.count("*").alias("n_docs"))
    joined = terms.join(size, list(scope)) if scope else terms.withColumn("n_docs", size.select("n_docs").scalar())
    return joined.withColumn("idf", F.log(1 + F.col("n_docs") / F.col("df")))
