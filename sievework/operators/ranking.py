"""BM25 over a whole corpus or per group, freshness, deduplication and diversity of results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.rows import exploded
from sievework.sources.shared import shared_dir, written

K1, B = 1.5, 0.75
BROADCAST_TERMS = 200_000


def term_counts(docs: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys, term, tf``: one row per document and term."""
    return exploded(docs, keys, T.tokens(text), "term").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, term, times`` of queries (column ``query``): a repeated word counts as often as it occurs."""
    keys = keys or []
    return exploded(queries, keys, T.tokens(F.col("query")), "term").groupBy(*keys, "term").agg(F.count("*").alias("times"))


def _idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def _part(tf: Column, dl: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _small(terms: DataFrame) -> DataFrame:
    """Terms of queries are broadcast if they are few enough, else joined by a shuffle."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def bm25(docs: DataFrame, key: str, text: str, query: DataFrame) -> DataFrame:
    """Adds ``score`` by one query to ``docs`` (every row stays, 0 without a match)."""
    asked = query.select(F.lit(0).alias("qid"), "query")
    scores = bm25_scores(docs, key, text, asked, "qid").select(key, F.col("score").alias("__score"))
    return docs.join(scores, key, "left").withColumn("score", F.coalesce("__score", F.lit(0.0))).drop("__score")


def bm25_scores(docs: DataFrame, key: str, text: str, queries: DataFrame, qid: str) -> DataFrame:
    """``qid, key, score`` for each query and document that share a term, by statistics of all documents.

    Only terms of some query are exploded: the filter runs before any shuffle. Counts of one
    document and term meet once, however many queries ask for it.
    """
    words = docs.select(F.col(key).alias("__k"), T.tokens(F.col(text)).alias("__w")).select("__k", F.size("__w").alias("__dl"), "__w")
    stats = words.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"))
    asked = query_terms(queries, [qid])
    hits = exploded(words, ["__k", "__dl"], "__w", "term").join(_small(asked.select("term").distinct()), "term")
    tf = hits.groupBy("__k", "__dl", "term").agg(F.count("*").alias("__tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("__df"))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats)).select(qid, "term", (F.col("times") * _idf(F.col("__n"), F.col("__df"))).alias("__idf"), "__avg")
    weighted = F.broadcast(weighted) if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else weighted  # no more rows than asked for
    scored = tf.join(weighted, "term").select(qid, "__k", (F.col("__idf") * _part(F.col("__tf"), F.col("__dl"), F.col("__avg"))).alias("__s"))
    return scored.groupBy(qid, F.col("__k").alias(key)).agg(F.sum("__s").alias("score"))


def top_of_query(scores: DataFrame, qid: str, key: str, most: int, digits: int = 4) -> DataFrame:
    """The best ``most`` of each query with their ``rank``: rows beyond are dropped before a query's rows meet."""
    rounded = scores.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), key))
    return rounded.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)


def bm25_own(rows: DataFrame, qid: str, key: str, text: str, queries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``qid, key, keep, score``: each row by the query it belongs to, with statistics of that query's rows (every row stays).

    Texts are read once: of each row its length and the counts of its query's terms are written, and all else is made of these.
    """
    keep = keep or []
    few = queries.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    of_query = query_terms(queries, [qid]).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("__terms"))
    asked = rows.join(F.broadcast(of_query) if few else of_query, qid, "left")
    words = asked.select(qid, key, *keep, T.tokens(F.col(text)).alias("__w"), F.coalesce("__terms", F.array().cast("array<struct<term:string,times:bigint>>")).alias("__terms"))
    tf = F.transform("__terms", lambda t: F.size("__w") - F.size(F.array_remove("__w", t["term"])))
    counted = words.select(qid, key, *keep, F.size("__w").alias("__dl"), tf.alias("__tf"), F.transform("__terms", lambda t: t["times"]).alias("__times"))
    counted = written(counted, f"{shared_dir(rows.sparkSession)}/bm25-own-{uuid.uuid4().hex}")
    df = exploded(counted, [qid], "__tf", "tf", "j").groupBy(qid, "j").agg(F.count_if(F.col("tf") > 0).alias("df"))
    df = df.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "df"))), lambda x: x["df"]).alias("__df"))
    stats = counted.groupBy(qid).agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg")).join(df, qid, "left")
    met = counted.join(F.broadcast(stats) if few else stats, qid)
    one = lambda x: F.when(x["__tf"] > 0, x["__times"] * _idf(F.col("__n"), x["__df"]) * _part(x["__tf"], F.col("__dl"), F.col("__avg"))).otherwise(0.0)
    score = F.aggregate(F.arrays_zip("__tf", "__times", "__df"), F.lit(0.0), lambda a, x: a + one(x))
    return met.select(qid, key, *keep, F.coalesce(score, F.lit(0.0)).alias("score"))


def best_passages(docs: DataFrame, passages: str, terms: str, most: int, digits: int = 4) -> DataFrame:
    """The columns of ``docs`` but ``passages`` and ``terms``, with ``rank, pos, score, chunk`` of each document's best passages.

    ``passages``: array<string>; ``terms``: array<struct<term, times>> of the document's query. All statistics
    are those of the document's own passages, so a document is scored inside its row: no shuffle.
    """
    names = [c for c in docs.columns if c not in (passages, terms)]
    words = F.transform(passages, T.tokens)
    counts = F.transform(words, lambda w: F.struct(F.size(w).alias("dl"), F.transform(terms, lambda t: F.size(w) - F.size(F.array_remove(w, t["term"]))).alias("tf")))
    counted = docs.withColumn("__c", counts)
    n = F.size("__c")
    average = F.when(n > 0, F.aggregate("__c", F.lit(0), lambda a, c: a + c["dl"]) / n)
    weights = F.transform(terms, lambda t, j: t["times"] * _idf(n, F.size(F.filter("__c", lambda c: F.get(c["tf"], j) > 0))))
    counted = counted.withColumns({"__avg": average, "__i": weights})

    def score(c: Column) -> Column:
        return F.aggregate(F.zip_with("__i", c["tf"], lambda i, tf: F.when(tf > 0, i * _part(tf, c["dl"], F.col("__avg"))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)

    ordered = F.slice(F.array_sort(F.transform("__c", lambda c, i: F.struct((-F.round(score(c), digits)).alias("neg"), i.alias("pos")))), 1, most)
    best = exploded(counted, [*names, passages], ordered, "x", "__k")
    return best.select(*names, (F.col("__k") + 1).alias("rank"), F.col("x.pos").cast("bigint").alias("pos"), (-F.col("x.neg")).alias("score"), F.get(passages, F.col("x.pos")).alias("chunk"))


def freshness(date: Column, as_of: Column) -> Column:
    """1 / 0.8 / 0.5 / 0.2 by age in days (either side of ``as_of``), 0.5 without a date."""
    age = F.abs(F.unix_timestamp(as_of) - F.unix_timestamp(date)) / 86400
    return F.when(date.isNull(), 0.5).when(age <= 1, 1.0).when(age <= 7, 0.8).when(age <= 30, 0.5).otherwise(0.2)


# Where results keep their date, in the order they are tried.
DATE_FIELDS = ("published_date", "publishedDate", "date", "pubdate")


def result_date(*fields: Column) -> Column:
    """The first date that can be read: with zone, without (UTC), or the day that a text begins with."""

    def read(x: Column) -> Column:
        day = F.when(F.regexp_like(x, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.substring(x, 1, 10))
        return F.when(F.contains(x, F.lit("T")) | F.endswith(x, F.lit("Z")), F.try_to_timestamp(x)).otherwise(F.try_to_timestamp(day))

    return F.coalesce(*map(read, fields))


def dedup_results(results: DataFrame) -> DataFrame:
    """Of results (``rid, url, score``) with one url (trailing slashes apart) the best stays, at the place of the first."""
    keyed = results.withColumn("key", F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", "")).where("key <> ''")
    w = Window.partitionBy("key")
    ranked = keyed.withColumn("n", F.row_number().over(w.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "rid"))).withColumn("position", F.min("rid").over(w))
    return ranked.where("n = 1").drop("n", "key")


def diverse_select(chunks: DataFrame, source: str, score: str, order: str, per_source: int = 3, total: int = 15) -> DataFrame:
    """Greedy selection in input order in closed form: at most ``per_source`` of a source, ``total`` in all, later ones of a source discounted."""
    nth = F.row_number().over(Window.partitionBy(source).orderBy(order))
    few = chunks.withColumn("nth", nth).where(F.col("nth") <= per_source)
    best = few.orderBy(order).limit(max(total, 1))
    return best.withColumn("adjusted", F.col(score) * (1 - (F.col("nth") - 1) / (per_source + 1)))
