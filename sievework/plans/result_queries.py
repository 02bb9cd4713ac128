"""Queries over search results, URLs, citations, facts and categories, made from the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import taxonomy
from sievework.functions import text as T
from sievework.functions.rows import exploded
from sievework.operators import keywords, ranking
from sievework.plans.registry import query
from sievework.plans.text_queries import BM25_PART, SLOT_SQL, TERMS_OF_QUERIES, TOKENS_SQL, dealt, queries_of
from sievework.session import table
from sievework.sources import transactional
from sievework.sources.shared import shared_dir, written

RESULTS_SQL = """r AS (SELECT doc_id AS rid, 'https://' || source || '.example/' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END AS url, source, lang,
  left(text, 40) AS title, text AS snippet, ((doc_id * 37) % 101) / 10.0::DOUBLE AS score,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE DATE '2026-05-07' - CAST(doc_id % 60 AS INTEGER) END AS published FROM documents)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as search results: ``rid, url, source, lang, title, snippet, score, published``."""
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        i.alias("rid"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), (i % 50).cast("string"), F.when(i % 2 == 0, "/").otherwise("")).alias("url"),
        "source", "lang", F.substring("text", 1, 40).alias("title"), F.col("text").alias("snippet"),
        (((i * 37) % 101) / 10).alias("score"),
        F.when(i % 5 != 0, F.date_sub(F.lit("2026-05-07").cast("date"), (i % 60).cast("int"))).alias("published"),
    )


@query("dedup_results", f"WITH {RESULTS_SQL} SELECT rid, url, score, min(rid) OVER (PARTITION BY rtrim(url, '/')) AS position FROM r QUALIFY row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY score DESC, rid) = 1")
def dedup_results(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.dedup_results(results(spark, sf).select("rid", "url", "score"))


@query("multi_query_union", f"WITH {RESULTS_SQL}, b AS (SELECT lang AS qid, rid, url, score FROM r UNION ALL SELECT source, rid, url, score FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY score DESC, rid, qid) AS n FROM b) SELECT url, rid, qid, score FROM k WHERE n = 1")
def multi_query_union(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two branches joined as a bag, then one per url."""
    r = results(spark, sf)
    both = r.select(F.col("lang").alias("qid"), "rid", "url", "score").unionByName(r.select(F.col("source").alias("qid"), "rid", "url", "score"))
    w = Window.partitionBy(F.regexp_replace("url", "/+$", "")).orderBy(F.desc("score"), "rid", "qid")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select("url", "rid", "qid", "score")


@query("provider_cascade", f"WITH {RESULTS_SQL}, p AS (SELECT *, rid % 3 AS provider_rank FROM r) SELECT source, rid, url, provider_rank FROM p QUALIFY provider_rank = min(provider_rank) OVER (PARTITION BY source)")
def provider_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """For each query the rows of the first provider that has any."""
    p = results(spark, sf).withColumn("provider_rank", F.col("rid") % 3)
    best = p.groupBy("source").agg(F.min("provider_rank").alias("provider_rank"))
    return p.join(best, ["source", "provider_rank"], "left_semi").select("source", "rid", "url", "provider_rank")


@query("any_meaningful", f"WITH {RESULTS_SQL} SELECT source, bool_or(score > 0 OR snippet <> '') AS meaningful FROM r GROUP BY source")
def any_meaningful(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy("source").agg(F.bool_or((F.col("score") > 0) | (F.col("snippet") != "")).alias("meaningful"))


@query("parse_date", f"WITH {RESULTS_SQL} SELECT rid, coalesce(strftime(published, '%Y-%m-%d'), 'Unknown') AS date FROM r")
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format("published", "yyyy-MM-dd'T'00:00:00'Z'")
    return results(spark, sf).select("rid", F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), F.lit("Unknown")).alias("date"))


AS_OF = "2026-05-07"
_DATES_SQL = "strftime(DATE '2026-05-07' - CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d')"


@query("result_dates", f"SELECT doc_id AS rid, CASE doc_id % 6 WHEN 5 THEN NULL WHEN 3 THEN {_DATES_SQL} || ' 10:30:00' WHEN 1 THEN {_DATES_SQL} || ' 08:30:00' ELSE {_DATES_SQL} || ' 00:00:00' END AS date FROM documents")
def result_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of results, written in one of four fields and in several ways; the first that can be read counts."""
    i = F.col("doc_id")
    day = F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), (i % 60).cast("int")), "yyyy-MM-dd")
    m = i % 6
    written = table(spark, sf, "documents").select(
        i.alias("rid"),
        F.when(m == 0, day).when(m == 1, F.concat(day, F.lit("T10:30:00+02:00"))).otherwise(F.lit("soon")).alias("published_date"),
        F.when(m == 2, F.concat(day, F.lit(" at noon"))).alias("publishedDate"),
        F.when(m == 3, F.concat(day, F.lit("T10:30:00Z"))).otherwise("").alias("date"),
        F.when(m == 4, day).when(m == 5, "2026-13-45").alias("pubdate"),
    )
    found = ranking.result_date(*(F.col(c) for c in ranking.DATE_FIELDS))
    return written.select("rid", F.date_format(found, "yyyy-MM-dd HH:mm:ss").alias("date"))


FRESH_SQL = "CASE WHEN published IS NULL THEN 0.5 WHEN abs(DATE '2026-05-07' - published) <= 1 THEN 1.0 WHEN abs(DATE '2026-05-07' - published) <= 7 THEN 0.8 WHEN abs(DATE '2026-05-07' - published) <= 30 THEN 0.5 ELSE 0.2 END::DOUBLE"


def _fresh():
    return ranking.freshness(F.col("published").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))


@query("freshness", f"WITH {RESULTS_SQL} SELECT rid, {FRESH_SQL} AS fresh FROM r")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("rid", _fresh().alias("fresh"))


RERANK_SQL = f"""
WITH {RESULTS_SQL}, {TERMS_OF_QUERIES}, t AS (SELECT *, {SLOT_SQL.format(x='rid')} AS slot, title || ' ' || title || ' ' || snippet AS body FROM r), d AS (SELECT rid, slot, {TOKENS_SQL.format(t='body')} AS w FROM t),
s AS (SELECT slot, count(*) AS n, avg(len(w)) AS avgdl FROM d GROUP BY slot),
x AS (SELECT rid, slot, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT rid, slot, dl, x.term, times, count(*) AS tf FROM x JOIN q USING (slot, term) GROUP BY ALL),
df AS (SELECT slot, term, count(*) AS df FROM tf GROUP BY ALL), sc AS (SELECT rid, sum({BM25_PART}) AS sc FROM tf JOIN df USING (slot, term) JOIN s USING (slot) GROUP BY rid),
k AS (SELECT qid, rid, round(coalesce(sc, 0.0), 4) AS bm25_score, {FRESH_SQL} AS fresh FROM t JOIN qs USING (slot) LEFT JOIN sc USING (rid)),
m AS (SELECT qid, CASE WHEN max(bm25_score) = 0 THEN 1 ELSE max(bm25_score) END AS best FROM k GROUP BY qid)
SELECT qid, rid, bm25_score, fresh, round(bm25_score / best * 0.85 + fresh * 0.15, 4) AS combined_score FROM k JOIN m USING (qid)
"""


@query("rerank_freshness", RERANK_SQL)
def rerank_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """The results of each query: BM25 among them (the title counts twice) normalised by the best, mixed with freshness."""
    queries = queries_of(spark, sf)
    r = dealt(results(spark, sf), "rid", queries.drop("query")).select("qid", "rid", F.concat_ws(" ", "title", "title", "snippet").alias("body"), _fresh().alias("fresh"))
    scores = ranking.bm25_own(r, "qid", "rid", "body", queries, ["fresh"]).withColumn("bm25_score", F.round("score", 4))
    scores = written(scores.select("qid", "rid", "fresh", "bm25_score"), f"{shared_dir(spark)}/rerank-{uuid.uuid4().hex}")
    best = scores.groupBy("qid").agg(F.max("bm25_score").alias("m")).select("qid", F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")).alias("m"))
    mixed = F.round(F.col("bm25_score") / F.col("m") * 0.85 + F.col("fresh") * 0.15, 4)
    few = queries.count() <= ranking.BROADCAST_TERMS
    return scores.join(F.broadcast(best) if few else best, "qid").select("qid", "rid", "bm25_score", "fresh", mixed.alias("combined_score"))


# ---- markdown. The templates of these renderings must come out to the letter.

MARKDOWN_SQL = f"""
WITH {RESULTS_SQL}, k AS (SELECT source, rid, url, title, score, coalesce(strftime(published, '%Y-%m-%d'), 'Unknown') AS date, trim(regexp_replace(regexp_replace(snippet, '<[^<]+?>', '', 'g'), '\\s+', ' ', 'g')) AS body,
  count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY score DESC, rid) AS n FROM r)
SELECT source, '# Search Results for: "' || source || '"' || chr(10) || '**Total Results:** ' || any_value(total) || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  string_agg('### Result #' || n || ' (Score: ' || printf('%.2f', score) || ')' || chr(10) || '**Source:** [' || title || '](' || url || ')  ' || chr(10) || '**Published:** ' || date || '  ' || chr(10) || '**Engine:** Unknown  ' || chr(10) || chr(10) ||
  '#### Key Findings' || chr(10) || body || chr(10) || chr(10) || '[End of Result #' || n || ']' || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY n) AS markdown FROM k WHERE n <= 5 GROUP BY source
"""


def _best(r: DataFrame, n: int) -> DataFrame:
    """The best results of each source; totals by an aggregation, so that the limit is applied before rows meet."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "rid"))
    return r.withColumn("n", nth).where(F.col("n") <= n)


@query("results_markdown", MARKDOWN_SQL)
def results_markdown(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf)
    k = _best(r, 5)
    date = F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("Unknown"))
    part = F.format_string(
        "### Result #%d (Score: %.2f)\n**Source:** [%s](%s)  \n**Published:** %s  \n**Engine:** Unknown  \n\n#### Key Findings\n%s\n\n[End of Result #%d]\n\n---\n\n",
        F.col("n"), F.col("score"), F.col("title"), F.col("url"), date, T.strip_tags(F.col("snippet")), F.col("n"),
    )
    body = k.select("source", F.struct("n", part.alias("p")).alias("x")).groupBy("source").agg(F.array_sort(F.collect_list("x")).alias("x"))
    totals = r.groupBy("source").agg(F.count("*").alias("total"))
    head = F.format_string('# Search Results for: "%s"\n**Total Results:** %d\n\n---\n\n', F.col("source"), F.col("total"))
    return body.join(totals, "source").select("source", F.concat(head, F.array_join(F.col("x.p"), "")).alias("markdown"))


@query("brave_markdown", f"WITH {RESULTS_SQL} SELECT source, string_agg('### ' || title || chr(10) || url || chr(10) || chr(10) || trim(regexp_replace(regexp_replace(snippet, '<[^<]+?>', '', 'g'), '\\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY rid) AS markdown FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY rid) <= 10) GROUP BY source")
def brave_markdown(spark: SparkSession, sf: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("source").orderBy("rid"))
    k = results(spark, sf).withColumn("n", nth).where("n <= 10")
    part = F.concat(F.lit("### "), "title", F.lit("\n"), "url", F.lit("\n\n"), T.strip_tags(F.col("snippet")))
    return k.select("source", F.struct("n", part.alias("p")).alias("x")).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "\n\n").alias("markdown"))


# ---- citations

CHUNKS_SQL = f"""{RESULTS_SQL}, c0 AS (SELECT rid, source, url, snippet, row_number() OVER (PARTITION BY source ORDER BY score DESC, rid) AS ord FROM r),
f AS (SELECT *, min(ord) OVER (PARTITION BY source, url) AS first_ord FROM c0), g AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY first_ord) AS idx FROM f)"""


def _numbered_urls(spark: SparkSession, sf: str) -> DataFrame:
    """``source, url, idx``: a url's number follows its best passage. Passages meet per url first; what a source then has to order are urls."""
    best = results(spark, sf).groupBy("source", "url").agg(F.min(F.struct((-F.col("score")).alias("neg"), "rid")).alias("best"))
    return best.select("source", "url", F.row_number().over(Window.partitionBy("source").orderBy("best")).cast("bigint").alias("idx"))


@query("citation_sources", f"WITH {CHUNKS_SQL} SELECT DISTINCT source, idx, url FROM g")
def citation_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered_urls(spark, sf).select("source", "idx", "url")


PART_LEN = "length('[' || idx || '] ' || snippet) + 2"
CONTEXT_CHARS, LEAST_PART = 5000, len("[1] ") + 2


@query("citation_context", f"WITH {CHUNKS_SQL}, k AS (SELECT source, ord, idx, {PART_LEN} AS part_len, sum({PART_LEN}) OVER (PARTITION BY source ORDER BY ord) AS cum FROM g) SELECT source, ord, idx, part_len, CAST(cum AS BIGINT) AS cum FROM k WHERE cum <= {CONTEXT_CHARS}")
def citation_context(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that fit a budget of 5000 characters, with their numbers.

    No more passages can fit than the shortest ones: rows beyond are dropped before a source's rows meet.
    """
    w = Window.partitionBy("source").orderBy(F.desc("score"), "rid")
    first = results(spark, sf).select("source", "url", "score", "rid", F.length("snippet").alias("n")).withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= CONTEXT_CHARS // LEAST_PART)
    c = first.join(_numbered_urls(spark, sf), ["source", "url"]).withColumn("part_len", (F.col("n") + F.length(F.col("idx").cast("string")) + len("[] ") + 2).cast("bigint"))
    c = c.withColumn("cum", F.sum("part_len").over(Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    return c.where(F.col("cum") <= CONTEXT_CHARS).select("source", F.col("ord").cast("bigint").alias("ord"), "idx", "part_len", "cum")


@query("format_sources", f"WITH {CHUNKS_SQL}, u AS (SELECT DISTINCT source, idx, url FROM g) SELECT source, string_agg('[' || idx || '] ' || url || chr(10) || '    ' || url, chr(10) || chr(10) ORDER BY idx) AS sources FROM u GROUP BY source")
def format_sources(spark: SparkSession, sf: str) -> DataFrame:
    u = _numbered_urls(spark, sf)
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), "url", F.lit("\n    "), "url")
    grouped = u.select("source", F.struct("idx", line.alias("l")).alias("x")).groupBy("source").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select("source", F.array_join(F.col("x.l"), "\n\n").alias("sources"))


#: Each document with three citation markers; sources 1..4 are available.
MARKED_SQL = "m AS (SELECT doc_id, text || ' [' || (doc_id % 7) || '] and [' || (doc_id % 4 + 1) || '] see https://' || source || '.example/' || doc_id || ' [' || (doc_id % 11) || ']' AS t FROM documents), n AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)) AS nums FROM m)"
MAX_SOURCE = 4


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat("text", F.lit(" ["), (i % 7).cast("string"), F.lit("] and ["), (i % 4 + 1).cast("string"), F.lit("] see https://"), "source", F.lit(".example/"), i.cast("string"), F.lit(" ["), (i % 11).cast("string"), F.lit("]"))
    m = table(spark, sf, "documents").select("doc_id", text.alias("t"))
    return m.select("doc_id", "t", F.transform(F.regexp_extract_all("t", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint")).alias("nums"))


@query("validate_citations", f"WITH {MARKED_SQL} SELECT doc_id, len(list_filter(nums, lambda x: x < 1 OR x > {MAX_SOURCE})) = 0 AS valid, len(list_filter(nums, lambda x: x < 1 OR x > {MAX_SOURCE})) AS invalid_count, array_to_string(list_filter(nums, lambda x: x < 1 OR x > {MAX_SOURCE}), ',') AS invalid, array_to_string(list_filter(range(1, {MAX_SOURCE + 1}), lambda x: NOT list_contains(nums, x)), ',') AS missing FROM n")
def validate_citations(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.filter("nums", lambda x: (x < 1) | (x > MAX_SOURCE))
    missing = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.lit(MAX_SOURCE).cast("bigint")), F.col("nums"))
    return _marked(spark, sf).select("doc_id", (F.size(bad) == 0).alias("valid"), F.size(bad).cast("bigint").alias("invalid_count"), F.array_join(bad.cast("array<string>"), ",").alias("invalid"), F.array_join(missing.cast("array<string>"), ",").alias("missing"))


def _renumbered(text, mapping):
    """The text with each marker's number replaced; ``mapping``: number -> string. All markers change at once."""
    gaps = F.split(text, r"\[\d+\]", -1)
    nums = F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(nums)).alias("g"), nums.alias("k")), lambda z: F.concat(z["g"], F.lit("["), mapping(z["k"].cast("bigint")), F.lit("]"))), ""), F.element_at(gaps, -1))


def _renumber_sql(mapping: str) -> str:
    """As ``_renumbered``; ``mapping`` in terms of ``x``."""
    return (
        f"WITH {MARKED_SQL}, p AS (SELECT doc_id, nums, string_split_regex(t, '\\[\\d+\\]') AS gaps FROM n), "
        f"s AS (SELECT *, list_sort(list_distinct(nums)) AS srt, list_sort(list_distinct(list_filter(nums, lambda y: y BETWEEN 1 AND {MAX_SOURCE}))) AS ok FROM p) "
        f"SELECT doc_id, array_to_string(list_transform(range(1, len(nums) + 1), lambda i: gaps[i] || '[' || {mapping.replace('{x}', 'nums[i]')} || ']'), '') || gaps[len(gaps)] AS text FROM s"
    )


@query("citations_renumber", _renumber_sql(f"CASE WHEN {{x}} BETWEEN 1 AND {MAX_SOURCE} THEN CAST({{x}} AS VARCHAR) ELSE '?' END"))
def citations_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", _renumbered(F.col("t"), lambda x: F.when(x.between(1, MAX_SOURCE), x.cast("string")).otherwise("?")).alias("text"))


@query("citations_normalize", _renumber_sql("CAST(list_position(srt, {x}) AS VARCHAR)"))
def citations_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers become dense from 1, all at once."""
    ordered = F.array_sort(F.array_distinct("nums"))
    return _marked(spark, sf).withColumn("o", ordered).select("doc_id", _renumbered(F.col("t"), lambda x: F.array_position(F.col("o"), x).cast("string")).alias("text"))


@query("citations_fix", _renumber_sql("CASE WHEN {x} BETWEEN 1 AND 4 THEN CAST(list_position(ok, {x}) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"))
def citations_fix(spark: SparkSession, sf: str) -> DataFrame:
    """The k-th smallest valid number becomes the k-th source, all at once; others stay."""
    ok = F.array_sort(F.array_distinct(F.filter("nums", lambda x: x.between(1, MAX_SOURCE))))
    return _marked(spark, sf).withColumn("o", ok).select("doc_id", _renumbered(F.col("t"), lambda x: F.when(x.between(1, MAX_SOURCE), F.array_position(F.col("o"), x).cast("string")).otherwise(x.cast("string"))).alias("text"))


@query("extract_urls", f"WITH {MARKED_SQL} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, 'https?://[^\\s<>\"{{}}|\\\\^`\\[\\]]+'))), ' ') AS urls FROM n")
def extract_urls(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("t", F.lit(r'https?://[^\s<>"{}|\\^`\[\]]+'), F.lit(0))
    return _marked(spark, sf).select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("urls"))


# ---- knowledge

KEYWORDS = f"SELECT doc_id, lower('https://' || source || '.example/' || ' ' || left(text, 40) || ' ' || text) AS t FROM documents"
CLASSIFY_SQL = f"WITH d AS ({KEYWORDS}), s AS (SELECT doc_id, category, priority, ord, len(list_filter(keywords, lambda k: contains(t, k))) AS score FROM d, {taxonomy.categories_sql()}) SELECT doc_id, category, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority, ord) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5"


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of each document by the number of their keywords it contains: one pass over each text for all keywords."""
    combined = F.lower(F.concat(F.lit("https://"), "source", F.lit(".example/ "), F.substring("text", 1, 40), F.lit(" "), "text"))
    words = taxonomy.categories(spark).select("ord", F.explode("keywords").alias("word"))
    found = keywords.with_groups(table(spark, sf, "documents").select("doc_id", combined.alias("t")), F.col("t"), words, "word", "ord").select("doc_id", "groups")
    # the taxonomy's rows by their number: a document has a row for each category found, so the five best are chosen in its row
    named = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(o).alias("ord"), F.lit(n).alias("category")) for o, n, p, _ in taxonomy.CATEGORIES))
    scores = F.transform("groups", lambda x: F.struct((-x["n"]).alias("neg"), *(F.get(named, x["g"])[c].alias(c) for c in ("priority", "ord", "category"))))
    best = F.slice(F.array_sort(scores), 1, 5)
    return exploded(found, ["doc_id"], best, "x", "k").select("doc_id", "x.category", (-F.col("x.neg")).cast("bigint").alias("score"), (F.col("k") + 1).alias("rank"))


@query("classify_topic", CLASSIFY_SQL)
def classify_topic(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf)


#: Documents are dealt over the hinted domains.
DOMAIN_LIST = [d for d, _ in taxonomy.HINTS]
RELEVANT_SQL = f"""
WITH cls AS ({CLASSIFY_SQL}), u AS (SELECT doc_id, {DOMAIN_LIST!r}[CAST(doc_id % 15 AS BIGINT) + 1] AS host FROM documents),
h AS (SELECT doc_id, h.category, c.ord FROM u JOIN {taxonomy.hints_sql()} ON contains(host, domain) JOIN {taxonomy.categories_sql()} ON c.category = h.category),
a AS (SELECT doc_id, category, 0 AS src, ord AS o FROM h UNION ALL SELECT doc_id, category, 1, rank FROM cls),
b AS (SELECT doc_id, category, min(src * 100 + o) AS k FROM a GROUP BY ALL)
SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rank FROM b
"""


@query("relevant_categories", RELEVANT_SQL)
def relevant_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Hints by domain first, then what the text suggests; a category occurs once."""
    names = F.array(*(F.lit(d) for d in DOMAIN_LIST))
    u = table(spark, sf, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 15).cast("int")).alias("host"))
    order = taxonomy.categories(spark).select("category", "ord")
    hinted = keywords.with_groups(u, F.col("host"), taxonomy.hints(spark).join(order, "category"), "domain", "ord")
    h = exploded(hinted, ["doc_id"], "groups", "x").select("doc_id", F.col("x.g").alias("ord")).join(F.broadcast(order), "ord").select("doc_id", "category", F.col("ord").cast("bigint").alias("k"))
    both = h.unionByName(_classified(spark, sf).select("doc_id", "category", (F.col("rank") + 100).alias("k")))
    first = both.groupBy("doc_id", "category").agg(F.min("k").alias("k"))
    return first.select("doc_id", "category", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")).cast("bigint").alias("rank"))


@query("categories_by_name", f"SELECT category, priority FROM {taxonomy.categories_sql()} WHERE lower(category) IN ('api', 'database', 'tooling')")
def categories_by_name(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([("API",), ("Database",), ("tooling",)], "name string").select(F.lower("name").alias("category"))
    return taxonomy.categories(spark).join(wanted, "category", "left_semi").select("category", "priority")


TOPICS = "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'what is ' ELSE '' END || CASE item_id % 3 WHEN 0 THEN 'comprehensive ' ELSE '' END || array_to_string(string_split(replace(lower(text), chr(10), ' '), ' ')[1:CAST(item_id % 6 + 1 AS BIGINT)], ' ') AS topic FROM benchmark"


@query("topic_width", f"SELECT item_id, topic, len(string_split(trim(topic), ' ')) > 5 AS too_wide, regexp_matches(topic, '\\b(what is|how to|introduction to)\\b|\\b(comprehensive|extensive|massive)\\b') AS broad, CASE WHEN regexp_matches(topic, '\\b(what is|how to|introduction to)\\b') THEN trim(regexp_replace(topic, '\\b(what is|how to|introduction to)\\s+', '', 'g')) WHEN regexp_matches(topic, '\\b(comprehensive|complete|full)\\b') THEN trim(regexp_replace(topic, '\\b(comprehensive|complete|full)\\s+', '', 'g')) END AS narrower FROM ({TOPICS})")
def topic_width(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    words = F.slice(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " "), F.lit(1), (i % 6 + 1).cast("int"))
    topic = F.concat(F.when(i % 4 == 0, "what is ").otherwise(""), F.when(i % 3 == 0, "comprehensive ").otherwise(""), F.array_join(words, " "))
    t, asks, wide = F.col("topic"), r"\b(what is|how to|introduction to)\b", r"\b(comprehensive|complete|full)\b"
    narrower = F.when(F.regexp_like("topic", F.lit(asks)), F.trim(F.regexp_replace(t, asks + r"\s+", ""))).when(F.regexp_like("topic", F.lit(wide)), F.trim(F.regexp_replace(t, wide + r"\s+", "")))
    return table(spark, sf, "benchmark").select("item_id", topic.alias("topic")).select(
        "item_id", "topic", (F.size(F.split(F.trim("topic"), " ")) > 5).alias("too_wide"), F.regexp_like("topic", F.lit(asks + r"|\b(comprehensive|extensive|massive)\b")).alias("broad"), narrower.alias("narrower")
    )


FACTS_SQL = "f AS (SELECT doc_id, text, (doc_id % 10) / 10.0::DOUBLE AS confidence, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'https://' || source || '.example/' END AS source_url, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS category FROM documents)"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", "text", ((i % 10) / 10).alias("confidence"),
        F.when(i % 3 != 0, F.concat(F.lit("https://"), "source", F.lit(".example/"))).alias("source_url"), F.when(i % 4 != 0, F.col("lang")).alias("category"),
    )


@query("parse_facts", f"WITH {FACTS_SQL} SELECT doc_id, text, coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE confidence END, 0.8) AS confidence, category FROM f WHERE length(text) >= 10 AND coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE confidence END, 0.8) >= 0.5")
def parse_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Replies are built as prose around JSON, then parsed: the outermost brackets, a default confidence, length and confidence limits."""
    f = _facts(spark, sf)
    item = F.struct("text", F.when(F.col("doc_id") % 7 != 0, F.col("confidence")).alias("confidence"), "category")
    reply = f.select("doc_id", F.concat(F.lit("Facts: "), F.to_json(F.array(item)), F.lit(" done")).alias("reply"))
    found = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), "array<struct<text:string,confidence:double,category:string>>")
    rows = exploded(reply, ["doc_id"], F.slice(found, 1, 20), "x").select("doc_id", "x.*")
    return rows.select("doc_id", "text", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), "category").where("length(text) >= 10 and confidence >= 0.5")


@query("fact_quality", f"WITH {FACTS_SQL} SELECT count(*) AS total, round(avg(confidence), 4) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, count(source_url) AS with_source, count(category) AS with_category, count(*) FILTER (length(text) < 20) AS short_facts, avg(confidence) >= 0.5 AND count(*) FILTER (length(text) < 20) <= count(*) * 0.3 AND count(source_url) >= count(*) * 0.5 AS valid FROM f")
def fact_quality(spark: SparkSession, sf: str) -> DataFrame:
    short = F.count_if(F.length("text") < 20)
    return _facts(spark, sf).agg(
        F.count("*").alias("total"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"),
        F.count("source_url").alias("with_source"), F.count("category").alias("with_category"), short.alias("short_facts"),
        ((F.avg("confidence") >= 0.5) & (short <= F.count("*") * 0.3) & (F.count("source_url") >= F.count("*") * 0.5)).alias("valid"),
    )


@query("fact_memory_rows", f"WITH {FACTS_SQL} SELECT doc_id, text || ' [Source: ' || coalesce(source_url, '') || ']' AS memory, coalesce(category, '') AS category FROM f")
def fact_memory_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Facts as the memory holds them: written by a batch that is seen whole or not at all, and read back."""
    where = f"{shared_dir(spark)}/memory-{uuid.uuid4().hex}"
    rows = _facts(spark, sf).select("doc_id", F.concat("text", F.lit(" [Source: "), F.coalesce("source_url", F.lit("")), F.lit("]")).alias("memory"), F.coalesce("category", F.lit("")).alias("category"))
    transactional.write_batch(rows, where, "facts")
    return transactional.read_batches(spark, where, "doc_id bigint, memory string, category string")


@query("collection_status", f"WITH {FACTS_SQL} SELECT coalesce(category, 'uncategorized') AS category, count(*) AS n, count(DISTINCT source_url) AS sources FROM f GROUP BY ALL")
def collection_status(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count("*").alias("n"), F.count_distinct("source_url").alias("sources"))


@query("gather_summary", f"WITH {FACTS_SQL} SELECT count(*) AS searched, count(source_url) AS fetched, count(*) FILTER (length(text) >= 10) AS extracted, count(DISTINCT lower(trim(text))) FILTER (length(text) >= 10) AS stored FROM f")
def gather_summary(spark: SparkSession, sf: str) -> DataFrame:
    long = F.length("text") >= 10
    return _facts(spark, sf).agg(F.count("*").alias("searched"), F.count("source_url").alias("fetched"), F.count_if(long).alias("extracted"), F.count_distinct(F.when(long, F.lower(F.trim("text")))).alias("stored"))
