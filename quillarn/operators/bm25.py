"""A BM25 index as tables, and ranked retrieval from it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillarn.functions.text import search_terms
from quillarn.sources.sinks import digest

# English words the index leaves out.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Folders of a stored index; a search reads those of its terms.
BUCKETS = 256


def asked_terms(queries: DataFrame, limit: int = 600, stopwords: bool = False) -> DataFrame:
    """(query_id, term, n): the terms in the first ``limit`` characters of each query and how often it has them."""
    terms = search_terms(F.col("text"), limit)
    if stopwords:
        terms = F.filter(terms, lambda t: ~t.isin(STOPWORDS))
    return queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, k1: float = 1.5, b: float = 0.75, only: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, score) of documents (doc_id, text), with idf = ln(1 + (N - df + .5) / (df + .5)); of the terms of
    ``only`` (a table with a column ``term``) if that is given, which drops all others before anything is shuffled. N and
    the mean length are one row, sent to all; term statistics join on the term."""
    terms = docs.select("doc_id", F.filter(search_terms(F.col("text")), lambda t: ~t.isin(STOPWORDS)).alias("t"))
    whole = terms.agg(F.count("*").cast("double").alias("docs"), F.avg(F.coalesce(F.size("t"), F.lit(0))).alias("mean"))
    each = terms.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    tf = each.groupBy("term", "doc_id").agg(F.count("*").cast("double").alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return tf.join(df, "term").crossJoin(F.broadcast(whole)).select("term", "doc_id", (idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))).alias("score"))


def bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str) -> None:
    """Store the index of documents in folders by the hash of the term, with the documents' digest; a path that is there
    raises."""
    rows = postings(docs).withColumn("bucket", bucket("term"))
    rows.repartition("bucket").sortWithinPartitions("term", "doc_id").write.partitionBy("bucket").mode("errorifexists").parquet(path)
    digest(docs.select("doc_id", "text")).write.mode("errorifexists").json(f"{path}/_documents")


def validate(spark: SparkSession, path: str, docs: DataFrame) -> None:
    """Raise unless a stored index is whole and of these documents: their digest is the stored one, and each document with a
    term has postings."""
    stored = spark.read.schema("rows bigint, digest string").json(f"{path}/_documents").first()
    if stored != digest(docs.select("doc_id", "text")).first():
        raise ValueError("the index is of other documents")
    with_terms = docs.where(F.exists(search_terms(F.col("text")), lambda t: ~t.isin(STOPWORDS))).select("doc_id")
    if with_terms.join(spark.read.parquet(path).select("doc_id").distinct(), "doc_id", "left_anti").limit(1).count():
        raise ValueError("the index isn't whole")


def search_stored(spark: SparkSession, path: str, queries: DataFrame, k: int, limit: int = 600) -> DataFrame:
    """As ``search``, on a stored index: only the folders of the asked terms are read."""
    asked = asked_terms(queries, limit).withColumn("bucket", bucket("term"))
    return ranked(spark.read.parquet(path).join(asked, ["bucket", "term"]), k)


def ranked(met: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of each query by the sums of what its terms score, ties by document."""
    if k <= 0:
        raise ValueError("k must be positive")
    sums = met.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("score") * F.col("n")), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return sums.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int, limit: int = 600) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (query_id, text), ties by document. A term
    counts as often as the query has it. The queries meet the index on the term; sums are partial before the shuffle."""
    return ranked(index.join(asked_terms(queries, limit), "term"), k)


def search_once(docs: DataFrame, queries: DataFrame, k: int, limit: int = 600) -> DataFrame:
    """As ``search`` over documents without an index: of their terms only those asked for become postings."""
    asked = asked_terms(queries, limit)
    return ranked(postings(docs, only=asked).join(asked, "term"), k)


def texts(hits: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """``hits`` with columns of their documents; documents that aren't hit drop out before the join."""
    wanted = docs.select("doc_id", *columns).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return hits.join(wanted, "doc_id")


def contexts(docs: DataFrame, queries: DataFrame, k: int = 3, chars: int = 450) -> DataFrame:
    """(query_id, passages): the first ``chars`` characters of the k best documents of each query, in order; blank queries
    and those without a hit have none."""
    asked = asked_terms(queries, stopwords=True)
    hits = ranked(postings(docs, only=asked).join(asked, "term"), k)
    rows = texts(hits, docs, "text").select("query_id", "rank", F.substring("text", 1, chars).alias("t"))
    lists = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("passages"))
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("passages", F.array().cast("array<string>")).alias("passages"))


def other_titles(hits: DataFrame, docs: DataFrame, sources: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, place, doc_id, score): the first ``n`` hits whose title isn't that of the query's source (query_id, title);
    queries with fewer are left out. A document hit twice by a query raises."""
    once = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("_n"), F.min("rank").alias("rank"), F.min("score").alias("score"))
    score = F.when(F.col("_n") == 1, F.col("score")).otherwise(F.raise_error(F.lit("a document is hit twice")).cast("double"))
    rows = texts(once.withColumn("score", score), docs, "title").join(sources.select("query_id", F.col("title").alias("_own")), "query_id").where(~F.col("title").eqNullSafe(F.col("_own")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    first = rows.withColumn("place", place).where(F.col("place") <= n).select("query_id", "place", "doc_id", "score")
    return first.join(first.where(F.col("place") == n).select("query_id"), "query_id", "left_semi")
