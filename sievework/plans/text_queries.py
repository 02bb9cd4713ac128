"""Queries over documents: tokens, BM25, sentences, chunks, pages, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.rows import exploded
from sievework.operators import ranking
from sievework.operators.inverted_index import FORMAT, InvertedIndex
from sievework.plans.registry import query
from sievework.session import table
from sievework.sources.shared import fingerprint, shared_dir

TOKENS_SQL = r"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: NOT regexp_full_match(w, '\p{{Nd}}+'))"
DOC_TOKENS = TOKENS_SQL.format(t="text")


@query("tokenize", f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents)")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("w")
    return table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("w")).select(
        "doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"), F.md5(F.array_join(w, " ")).alias("digest")
    )


TERMS_SQL = f"SELECT doc_id, unnest({DOC_TOKENS}) AS term FROM documents"


@query("bm25_tf", f"SELECT doc_id, term, count(*) AS tf FROM ({TERMS_SQL}) GROUP BY ALL")
def bm25_tf(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.term_counts(table(spark, sf, "documents"), ["doc_id"], F.col("text"))


@query("bm25_df", f"SELECT term, count(DISTINCT doc_id) AS df FROM ({TERMS_SQL}) GROUP BY term")
def bm25_df(spark: SparkSession, sf: str) -> DataFrame:
    words = exploded(table(spark, sf, "documents"), [], F.array_distinct(T.tokens(F.col("text"))), "term")
    return words.groupBy("term").agg(F.count("*").alias("df"))


#: The queries of the ranking queries: the first five words of each benchmark item (a query is short by nature), numbered by ``slot``.
QUERIES_SQL = "SELECT item_id AS qid, row_number() OVER (ORDER BY item_id) - 1 AS slot, array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:5], ' ') AS query FROM benchmark"
TERMS_OF_QUERIES = f"qs AS ({QUERIES_SQL}), q AS (SELECT qid, slot, term, count(*) AS times FROM (SELECT qid, slot, unnest({TOKENS_SQL.format(t='query')}) AS term FROM qs) GROUP BY ALL)"
#: Documents and results that belong to one query each are dealt over the queries.
SLOT_SQL = "{x} % (SELECT count(*) FROM benchmark)"
BM25_PART = "times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    """``qid, slot, query``; the table of questions is small by nature, so one task numbers it."""
    words = F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 1, 5)
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("slot"), F.array_join(words, " ").alias("query"))


def dealt(df: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """Adds ``qid`` and what else ``queries`` has to the rows: each belongs to one query."""
    n = queries.count()
    few = F.broadcast(queries) if n <= ranking.BROADCAST_TERMS else queries
    return df.withColumn("slot", (F.col(key) % max(n, 1)).cast("int")).join(few, "slot").drop("slot")


BM25_SQL = f"""
WITH d AS (SELECT doc_id, {DOC_TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), {TERMS_OF_QUERIES},
x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT qid, doc_id, round(sum({BM25_PART}), 4) AS score FROM tf JOIN q USING (term) JOIN df USING (term), s GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc QUALIFY rank <= 20
"""


def index_of(spark: SparkSession, sf: str) -> InvertedIndex:
    """The stored index of the documents, built when a state of the table is first asked for."""
    docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")
    index = InvertedIndex(spark, f"{shared_dir(spark)}/bm25-{FORMAT}-{fingerprint(docs)}")
    index.append(table(spark, sf, "documents"), "doc_id", "text", "all")
    return index


@query("bm25_index", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS most, min(dl) AS shortest FROM (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, {DOC_TOKENS} AS w FROM documents)) GROUP BY ALL) GROUP BY term")
def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index of the documents, term by term: the dictionary, and what the blocks say of the bounds."""
    index = index_of(spark, sf)
    bounds = index.blocks().groupBy("term").agg(F.max("tf").cast("bigint").alias("most"), F.min("dl").cast("bigint").alias("shortest"))
    return index.frequencies().join(bounds, "term").select("term", "df", "total", "most", "shortest")


@query("bm25_rank", BM25_SQL)
def bm25_rank(spark: SparkSession, sf: str) -> DataFrame:
    """For each query the twenty documents that fit best (a top-k report), by statistics of all documents: a search of the stored index."""
    found = index_of(spark, sf).search(queries_of(spark, sf), "qid", 20)
    return found.select("qid", "rank", F.col("key").alias("doc_id"), "score")


def _sql_protected() -> str:
    t = "text"
    for a in T.ABBREVIATIONS:
        t = f"regexp_replace({t}, '\\b{a.replace('.', chr(92) + '.')}\\.\\s+', '{a}__DOT__ ', 'gi')"
    return t


SENTENCES_SQL = rf"""
s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace({_sql_protected()}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)),
  lambda p: trim(regexp_replace(replace(p, '__DOT__', '.'), '\s+', ' ', 'g'))), lambda p: p <> '') AS raw FROM documents),
s1 AS (SELECT doc_id, raw, list_reduce(raw, lambda a, s: CASE WHEN len(string_split(s, ' ')) < 5 AND len(a) > 0 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' ' || s) ELSE list_append(a, s) END, []::VARCHAR[]) AS sents FROM s0)
"""


def sentence_frame(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, raw, sents`` of each document."""
    raw = table(spark, sf, "documents").select("doc_id", T.raw_sentences(F.col("text")).alias("raw"))
    return raw.select("doc_id", "raw", T.merge_short(F.col("raw")).alias("sents"))


@query("split_sentences", f"WITH {SENTENCES_SQL} SELECT doc_id, unnest(range(len(raw))) AS pos, unnest(raw) AS sentence FROM s1")
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(sentence_frame(spark, sf), ["doc_id"], "raw", "sentence", "pos")


@query("merge_short_sentences", f"WITH {SENTENCES_SQL} SELECT doc_id, unnest(range(len(sents))) AS pos, unnest(sents) AS sentence FROM s1")
def merge_short_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(sentence_frame(spark, sf), ["doc_id"], "sents", "sentence", "pos")


def _chunks_sql(size: int, overlap: int) -> str:
    carry = (
        f"a.cur[len(a.cur) - greatest(1, len(list_filter(range(1, len(a.cur) + 1), lambda j: list_sum(list_transform(a.cur[len(a.cur) - j + 1:], lambda y: length(y) + 1)) - 1 <= {overlap}))) + 1:]"
    )
    return f"""
c0 AS (SELECT doc_id, list_reduce(sents, lambda a, s: CASE WHEN a.sz + length(s) > {size} AND len(a.cur) > 0
  THEN {{'done': list_append(a.done, array_to_string(a.cur, ' ')), 'cur': list_append({carry}, s), 'sz': CAST(list_sum(list_transform({carry}, lambda y: length(y) + 1)) + length(s) + 1 AS BIGINT)}}
  ELSE {{'done': a.done, 'cur': list_append(a.cur, s), 'sz': a.sz + length(s) + 1}} END, {{'done': []::VARCHAR[], 'cur': []::VARCHAR[], 'sz': 0::BIGINT}}) AS a FROM s1),
c1 AS (SELECT doc_id, CASE WHEN len(a.cur) > 0 THEN list_append(a.done, array_to_string(a.cur, ' ')) ELSE a.done END AS chunks FROM c0),
ch AS (SELECT doc_id, unnest(range(len(chunks))) AS pos, unnest(chunks) AS chunk FROM c1)
"""


def chunk_frame(spark: SparkSession, sf: str, size: int, overlap: int) -> DataFrame:
    """``doc_id, pos, chunk``."""
    packed = sentence_frame(spark, sf).select("doc_id", T.chunks(F.col("sents"), size, overlap).alias("c"))
    return exploded(packed, ["doc_id"], "c", "chunk", "pos")


@query("chunk_text", f"WITH {SENTENCES_SQL}, {_chunks_sql(1000, 200)} SELECT doc_id, pos, chunk FROM ch")
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_frame(spark, sf, 1000, 200)


PAGE_TOPK_SQL = f"""
WITH {SENTENCES_SQL}, {_chunks_sql(500, 50)}, {TERMS_OF_QUERIES},
d AS (SELECT doc_id, {SLOT_SQL.format(x='doc_id')} AS slot, pos, chunk, {TOKENS_SQL.format(t='chunk')} AS w FROM ch), s AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS avgdl FROM d GROUP BY doc_id),
x AS (SELECT doc_id, slot, pos, len(w) AS dl, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, pos, dl, x.term, times, count(*) AS tf FROM x JOIN q USING (slot, term) GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT doc_id, pos, sum({BM25_PART}) AS score FROM tf JOIN df USING (doc_id, term) JOIN s USING (doc_id) GROUP BY ALL),
r AS (SELECT qid, doc_id, pos, round(coalesce(score, 0.0), 4) AS score, chunk FROM d JOIN qs USING (slot) LEFT JOIN sc USING (doc_id, pos))
SELECT qid, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank, pos, score, chunk FROM r QUALIFY rank <= 5
"""


@query("page_query_topk", PAGE_TOPK_SQL)
def page_query_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A page is fetched for a query: the five passages of each document that fit its query best, by statistics of the document's own passages."""
    packed = sentence_frame(spark, sf).select("doc_id", T.chunks(F.col("sents"), 500, 50).alias("c"))
    queries = queries_of(spark, sf)
    terms = ranking.query_terms(queries, ["qid"]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("terms"))
    none = F.array().cast("array<struct<term:string,times:bigint>>")
    asked = dealt(packed, "doc_id", queries.join(terms, "qid", "left").select("slot", "qid", F.coalesce("terms", none).alias("terms")))
    return ranking.best_passages(asked, "c", "terms", 5).select("qid", "doc_id", "rank", "pos", "score", "chunk")


SMALL_SQL = f"""
WITH {SENTENCES_SQL}, {_chunks_sql(300, 0)},
m AS (SELECT doc_id, list_reduce(list(chunk ORDER BY pos), lambda a, c: CASE WHEN len(a) > 0 AND length(a[len(a)]) < 200 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' ' || c) ELSE list_append(a, c) END, []::VARCHAR[]) AS chunks FROM ch GROUP BY doc_id)
SELECT doc_id, unnest(range(len(chunks))) AS pos, unnest(chunks) AS chunk FROM m
"""


@query("merge_small_chunks", SMALL_SQL)
def merge_small_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of fewer than 200 characters take in the next one of their document."""
    packed = sentence_frame(spark, sf).select("doc_id", T.chunks(F.col("sents"), 300, 0).alias("c"))
    merged = packed.select("doc_id", T.merge_small(F.col("c"), 200).alias("c"))
    return exploded(merged, ["doc_id"], "c", "chunk", "pos")


PAGINATE_SQL = """
WITH p AS (SELECT doc_id, list_reduce(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda a, x: CASE WHEN a.sz + length(x) + 2 > 1000 AND len(a.cur) > 0
  THEN {'done': list_append(a.done, array_to_string(a.cur, chr(10))), 'cur': [x], 'sz': length(x) + 2}
  ELSE {'done': a.done, 'cur': list_append(a.cur, x), 'sz': a.sz + length(x) + 2} END, {'done': []::VARCHAR[], 'cur': []::VARCHAR[], 'sz': 0::BIGINT}) AS a FROM documents)
SELECT doc_id, unnest(range(len(pages))) AS page, unnest(pages) AS content FROM (SELECT doc_id, CASE WHEN len(a.cur) > 0 THEN list_append(a.done, array_to_string(a.cur, chr(10))) ELSE a.done END AS pages FROM p)
"""


@query("paginate", PAGINATE_SQL)
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs packed into pages of about 1000 characters."""
    paragraphs = F.filter(F.split("text", "\n"), lambda x: x != "")
    packed = table(spark, sf, "documents").select("doc_id", T.pages(paragraphs, 1000).alias("p"))
    return exploded(packed, ["doc_id"], "p", "content", "page")


SEMANTIC_SQL = r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(h, '\n(#+ )', chr(1) || '\1', 'g'), chr(1))) AS sec, generate_subscripts(string_split(regexp_replace(h, '\n(#+ )', chr(1) || '\1', 'g'), chr(1)), 1) AS k
  FROM (SELECT doc_id, regexp_replace(text, '(^|\n)([A-Z][a-z]+ )', '\1# \2', 'g') AS h FROM documents)),
t AS (SELECT doc_id, k, regexp_replace(sec, '^\s+|\s+$', '', 'g') AS sec FROM s),
u AS (SELECT doc_id, k, CASE WHEN length(sec) <= 400 THEN [sec] ELSE list_transform(range(0, length(sec), 400), lambda i: sec[i + 1:i + 400]) END AS parts FROM t WHERE sec <> ''),
v AS (SELECT doc_id, k, unnest(parts) AS chunk, generate_subscripts(parts, 1) AS j FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS pos, chunk FROM v
"""


@query("semantic_chunk", SEMANTIC_SQL)
def semantic_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Sections begin at headings; sections without paragraph breaks that exceed 400 characters are cut. Line starts are made headings here."""
    headed = F.regexp_replace("text", r"(^|\n)([A-Z][a-z]+ )", "$1# $2")
    sections = F.filter(F.transform(F.split(headed, r"\n(?=#+ )"), T.strip_outer), lambda s: s != "")
    cut = F.flatten(F.transform(sections, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 400).cast("int")), lambda i: F.substr(s, i * 400 + 1, F.lit(400)))))
    out = table(spark, sf, "documents").select("doc_id", cut.alias("c"))
    return exploded(out, ["doc_id"], "c", "chunk", "pos")


@query("estimate_tokens", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("truncate_simple", "SELECT doc_id, CASE WHEN length(text) // 4 > 100 THEN text[1:CAST(floor(length(text) * (100.0::DOUBLE / (length(text) // 4))) AS BIGINT)] ELSE text END AS text FROM documents")
def truncate_simple(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.truncate_simple(F.col("text"), 100).alias("text"))


SMART = r"CASE WHEN length(text) // 4 > 100 THEN array_to_string(string_split(text, chr(10))[1:greatest(1, CAST(floor(len(string_split(text, chr(10))) * (100.0::DOUBLE / (length(text) // 4))) AS BIGINT))], chr(10)) ELSE text END"


@query("truncate_smart", f"SELECT doc_id, {SMART} AS text FROM documents")
def truncate_smart(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs are lines here."""
    return table(spark, sf, "documents").select("doc_id", T.truncate_smart(F.col("text"), 100, "\n", "\n").alias("text"))


@query("optimize_content", f"SELECT doc_id, length(text) // 4 AS original_tokens, length({SMART}) // 4 AS truncated_tokens, length(text) // 4 > 100 AS truncated FROM documents")
def optimize_content(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    short = T.truncate_smart(t, 100, "\n", "\n")
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(t).alias("original_tokens"), T.estimate_tokens(short).alias("truncated_tokens"), (T.estimate_tokens(t) > 100).alias("truncated"))


@query("sanitize_text", r"SELECT doc_id, left(regexp_replace(regexp_replace(text || chr(7) || '<b>x</b>', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '<[^>]+>', '', 'g'), 10000) AS text FROM documents")
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.sanitize(F.concat("text", F.lit("\x07<b>x</b>"))).alias("text"))


MD5_SQL = r"md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')))"


@query("exact_dup_counts", f"SELECT {MD5_SQL} AS digest, count(*) AS n FROM documents GROUP BY ALL")
def exact_dup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(T.normal_md5(F.col("text")).alias("digest")).agg(F.count("*").alias("n"))


@query("exact_dedup", f"SELECT min(doc_id) AS doc_id, {MD5_SQL} AS digest FROM documents GROUP BY digest")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each normalised text."""
    return table(spark, sf, "documents").groupBy(T.normal_md5(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("content_id_hash", "SELECT doc_id, sha256(text)[1:16] AS content_id FROM documents")
def content_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_id"))
