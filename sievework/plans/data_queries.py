"""Queries over embeddings, events, conversations, pages and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import zones
from sievework.functions.rows import exploded
from sievework.operators import ranking, replay, vectors
from sievework.operators.cells import CellIndex
from sievework.operators.embed_cache import EmbeddingCache
from sievework.operators.quantiles import exact_quantiles
from sievework.plans import providers
from sievework.plans.registry import query
from sievework.plans.text_queries import BM25_SQL, QUERIES_SQL, TOKENS_SQL, bm25_rank, queries_of
from sievework.session import table
from sievework.sources import event_files, responses
from sievework.sources.shared import fingerprint, shared_dir

# ---- vectors

VEC = "CAST(embedding AS DOUBLE[])"


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


@query("vector_topk", f"SELECT vec_id, round(list_cosine_similarity({VEC}, (SELECT {VEC} FROM embeddings WHERE vec_id = 0)), 4) AS sim FROM embeddings ORDER BY list_cosine_similarity({VEC}, (SELECT {VEC} FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest to one query vector (a top-k report)."""
    e = _emb(spark, sf)
    q = F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("q")))
    sim = vectors.cosine(F.col("v"), F.col("q"))
    return e.crossJoin(q).select("vec_id", sim.alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 4).alias("sim"))


PAIRS_SQL = f"SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query("semantic_pairs", f"SELECT a, b, round(sim, 4) AS sim FROM ({PAIRS_SQL}) WHERE sim >= 0.4")
def semantic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return CellIndex(_emb(spark, sf), "vec_id", "v").similar_pairs(0.4).select("a", "b", F.round("sim", 4).alias("sim"))


@query("semantic_dedup", f"WITH p AS (SELECT a, b FROM ({PAIRS_SQL}) WHERE sim >= 0.35), adj AS (SELECT vec_id, coalesce(list(a), []::BIGINT[]) FILTER (a IS NOT NULL) AS n FROM embeddings LEFT JOIN p ON b = vec_id GROUP BY vec_id), o AS (SELECT list({{'v': vec_id, 'n': coalesce(n, []::BIGINT[])}} ORDER BY vec_id) AS l FROM adj), k AS (SELECT list_reduce(l, lambda acc, x: CASE WHEN list_has_any(acc, x.n) THEN acc ELSE list_append(acc, x.v) END, []::BIGINT[]) AS kept FROM o) SELECT unnest(kept) AS vec_id FROM k".replace("coalesce(list(a), []::BIGINT[]) FILTER (a IS NOT NULL)", "list(a) FILTER (a IS NOT NULL)"))
def semantic_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A vector stays unless it is similar to an earlier one that stays."""
    return vectors.semantic_dedup(_emb(spark, sf), "vec_id", "v", 0.35)


@query("vector_topk_many", f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity({VEC.replace('embedding', 'q.embedding')}, {VEC.replace('embedding', 'e.embedding')}), 4) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank, vec_id, sim FROM s QUALIFY rank <= 10")
def vector_topk_many(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, among all vectors (a top-k report of many queries)."""
    e = _emb(spark, sf)
    found = CellIndex(e, "vec_id", "v").nearest(e.where("vec_id % 50 = 0"), "vec_id", "v", 10)
    return found.select(F.col("vec_id").alias("query_id"), "rank", F.col("key").alias("vec_id"), "sim")


SCORED = "SELECT vec_id, label, vec_id + 1 AS ord, ((vec_id * 31) % 97) / 10.0::DOUBLE AS score FROM embeddings"


@query("diverse_select", f"WITH s AS ({SCORED}), a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ord) AS nth FROM s QUALIFY nth <= 3) SELECT vec_id, label, round(score * (1 - (nth - 1) / 4.0), 4) AS adjusted FROM a ORDER BY ord LIMIT 15")
def diverse_select(spark: SparkSession, sf: str) -> DataFrame:
    s = _emb(spark, sf).select("vec_id", "label", (F.col("vec_id") + 1).alias("ord"), (((F.col("vec_id") * 31) % 97) / 10).alias("score"))
    return ranking.diverse_select(s, "label", "score", "ord").select("vec_id", "label", F.round("adjusted", 4).alias("adjusted"))


@query("diversity_step", "SELECT vec_id, CASE least(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1, 3) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.0 END::DOUBLE AS step FROM embeddings")
def diversity_step(spark: SparkSession, sf: str) -> DataFrame:
    """What a chunk loses by those of its source before it. Only the first three of a source differ: they are found by a limit, the others have nothing to be ordered for."""
    e = _emb(spark, sf).select("vec_id", "label")
    first = e.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n <= 3")
    step = F.get(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.3)), F.col("n") - 1)
    return e.join(first.select("vec_id", step.alias("step")), "vec_id", "left").select("vec_id", F.coalesce("step", F.lit(0.0)).alias("step"))


@query("hash_embed", r"SELECT doc_id, CAST('0x' || md5(term)[1:8] AS BIGINT) % 64 AS bucket, count(*) AS weight FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda w: NOT regexp_full_match(w, '\p{Nd}+'))) AS term FROM documents) GROUP BY ALL")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Offline stand-in for an embedding model: counts of hashed words."""
    words = exploded(table(spark, sf, "documents"), ["doc_id"], T.tokens(F.col("text")), "term")
    bucket = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % 64
    return words.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("weight"))


_BUCKETS = f"list_transform({TOKENS_SQL.format(t='text')}, lambda w: CAST('0x' || md5(w)[1:8] AS BIGINT) % 64)"


@query("embedding_cache_join", f"WITH c AS (SELECT DISTINCT sha256(text)[1:16] AS h FROM documents WHERE doc_id % 2 = 0), d AS (SELECT doc_id, sha256(text)[1:16] AS h, {_BUCKETS} AS b FROM documents) SELECT doc_id, c.h IS NOT NULL AS hit, array_to_string(list_transform(range(64), lambda k: len(list_filter(b, lambda x: x = k))), ',') AS vector FROM d LEFT JOIN c USING (h)")
def embedding_cache_join(spark: SparkSession, sf: str) -> DataFrame:
    """All texts embedded through a cache that knows half of them: what it doesn't know is computed once and stored."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = EmbeddingCache(spark, f"{shared_dir(spark)}/embedding-cache-md5x64-{fingerprint(spark.read.parquet(f'{sf}/documents.parquet'))}", providers.md5_words, 64)
    cache.fill(docs.where("doc_id % 2 = 0"), "text", "even")
    whole = F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",")
    return cache.embed(docs, "text", "all").select("doc_id", "hit", whole.alias("vector"))


# ---- events: metrics and state

@query("search_metrics", "WITH l AS (SELECT round(avg(value), 1) AS avg_latency FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 100)) SELECT event_type AS provider, count(*) FILTER (value <= 400) AS ok, count(*) FILTER (value > 400) AS failed, round(count(*) FILTER (value <= 400) / (SELECT count(*) FROM events), 3) AS success_rate, any_value(avg_latency) AS avg_latency FROM events, l GROUP BY event_type")
def search_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per provider, successes over all queries; the mean of the last hundred latencies (a limit of the feature)."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    last = F.broadcast(e.orderBy(F.desc("event_id")).limit(100).agg(F.round(F.avg("value"), 1).alias("avg_latency")))
    total = F.broadcast(e.agg(F.count("*").alias("total")))
    per = e.groupBy(F.col("event_type").alias("provider")).agg(F.count_if(F.col("value") <= 400).alias("ok"), F.count_if(F.col("value") > 400).alias("failed"))
    return per.crossJoin(total).crossJoin(last).select("provider", "ok", "failed", F.round(F.col("ok") / F.col("total"), 3).alias("success_rate"), "avg_latency")


INSTANCE_SQL = "SELECT user_id AS instance, CASE WHEN count(*) < 3 THEN 1.0 ELSE round(count(*) FILTER (event_type <> 'error') / count(*) * greatest(0.1, 1 - (avg(value * 10) - 500) / 4500), 4) END AS score FROM events GROUP BY user_id"


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    ok, n = F.count_if(F.col("event_type") != "error"), F.count("*")
    speed = F.greatest(F.lit(0.1), 1 - (F.avg(F.col("value") * 10) - 500) / 4500)
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("instance")).agg(F.when(n < 3, 1.0).otherwise(F.round(ok / n * speed, 4)).alias("score"))


@query("instance_score", INSTANCE_SQL)
def instance_score(spark: SparkSession, sf: str) -> DataFrame:
    return _instances(spark, sf)


@query("instance_topk", f"SELECT instance, score FROM ({INSTANCE_SQL}) ORDER BY score DESC, instance LIMIT 3")
def instance_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _instances(spark, sf).orderBy(F.desc("score"), "instance").limit(3)


@query("instance_filter_topk", "SELECT user_id AS instance, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 2) AS success, median(value) AS latency FROM events GROUP BY user_id HAVING success >= 80 ORDER BY latency, instance LIMIT 20")
def instance_filter_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("instance"), "event_type", "value")
    g = e.groupBy("instance").agg(F.round(100 * F.count_if(F.col("event_type") != "error") / F.count("*"), 2).alias("success"))
    latency = exact_quantiles(e, "instance", F.col("value"), {"latency": 0.5})
    return g.where("success >= 80").join(latency, "instance", "left").select("instance", "success", "latency").orderBy(F.asc_nulls_last("latency"), "instance").limit(20)


@query("health_metrics", "SELECT count(*) FILTER (event_type <> 'view') AS requests, round(count(*) FILTER (event_type = 'view') / count(*), 4) AS cache_hit_rate FROM events")
def health_metrics(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.count_if(F.col("event_type") == "view")
    return table(spark, sf, "events").agg((F.count("*") - hits).alias("requests"), F.round(hits / F.count("*"), 4).alias("cache_hit_rate"))


EPOCH = "epoch_us(ts) / 1000000.0"
RATE_SQL = f"WITH u AS (SELECT user_id, list({{'id': event_id, 't': {EPOCH}}} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id), f AS (SELECT list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a.q, lambda y: x.t - y < 86400)) < 2 THEN {{'q': list_append(list_filter(a.q, lambda y: x.t - y < 86400), x.t), 'out': list_append(a.out, {{'id': x.id, 'ok': true}})}} ELSE {{'q': list_filter(a.q, lambda y: x.t - y < 86400), 'out': list_append(a.out, {{'id': x.id, 'ok': false}})}} END, {{'q': []::DOUBLE[], 'out': []::STRUCT(id BIGINT, ok BOOLEAN)[]}}) AS a FROM u), o AS (SELECT unnest(a.out) AS x FROM f) SELECT x.id AS event_id, x.ok AS allowed FROM o"


@query("rate_limit", RATE_SQL)
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Two requests a user in any day; refused ones don't count."""
    e = table(spark, sf, "events").select("event_id", "user_id", replay.seconds("ts").alias("t"))
    return replay.replay(e, "user_id", ["t", "event_id"], "allowed", "boolean", ["t"], replay.rate_limiter(2, 86400.0)).select("event_id", "allowed")


LRU_FOLD = f"""
WITH u AS (SELECT user_id, list({{'id': event_id, 't': {EPOCH}, 'k': event_type, 'op': CASE WHEN event_id % 2 = 0 THEN 'get' WHEN event_id % 10 = 5 THEN 'delete' ELSE 'set' END}} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(l, lambda a, x: CASE
  WHEN x.op = 'get' AND len(list_filter(a.c, lambda y: y.k = x.k AND x.t <= y.e)) > 0 THEN {{'c': list_concat(list_filter(a.c, lambda y: y.k <> x.k), list_filter(a.c, lambda y: y.k = x.k)), 'out': list_append(a.out, {{'id': x.id, 'hit': true}})}}
  WHEN x.op = 'get' THEN {{'c': list_filter(a.c, lambda y: y.k <> x.k), 'out': list_append(a.out, {{'id': x.id, 'hit': false}})}}
  WHEN x.op = 'delete' THEN {{'c': list_filter(a.c, lambda y: y.k <> x.k), 'out': list_append(a.out, {{'id': x.id, 'hit': len(list_filter(a.c, lambda y: y.k = x.k)) > 0}})}}
  WHEN len(list_filter(a.c, lambda y: y.k = x.k)) > 0 THEN {{'c': list_append(list_filter(a.c, lambda y: y.k <> x.k), {{'k': x.k, 'e': x.t + 172800}}), 'out': a.out}}
  WHEN len(a.c) >= 3 THEN {{'c': list_append(a.c[2:], {{'k': x.k, 'e': x.t + 172800}}), 'out': a.out}}
  ELSE {{'c': list_append(a.c, {{'k': x.k, 'e': x.t + 172800}}), 'out': a.out}} END,
  {{'c': []::STRUCT(k VARCHAR, e DOUBLE)[], 'out': []::STRUCT(id BIGINT, hit BOOLEAN)[]}}) AS a FROM u)
"""


def _cache_log(spark: SparkSession, sf: str) -> DataFrame:
    """Even events read, of the odd ones every fifth deletes, the others write."""
    i = F.col("event_id")
    op = F.when(i % 2 == 0, "get").when(i % 10 == 5, "delete").otherwise("set")
    return table(spark, sf, "events").select("event_id", "user_id", replay.seconds("ts").alias("t"), F.col("event_type").alias("k"), op.alias("op"))


@query("lru_replay", LRU_FOLD + "SELECT x.id AS event_id, x.hit AS hit FROM (SELECT unnest(a.out) AS x FROM f)")
def lru_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A cache of three entries a user, which live two days: what reads and deletes find."""
    done = replay.replay(_cache_log(spark, sf), "user_id", ["t", "event_id"], "hit", "boolean", ["op", "k", "t"], replay.lru_cache(3, 172800.0))
    return done.where("op <> 'set'").select("event_id", "hit")


@query("cache_stats", LRU_FOLD + "SELECT user_id, CAST(len(a.c) AS BIGINT) AS size, 3 AS max_size FROM f")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What each user's cache holds in the end."""
    sizes = replay.replay(_cache_log(spark, sf), "user_id", ["t", "event_id"], "size", "bigint", ["op", "k", "t"], replay.lru_size(3, 172800.0))
    last = sizes.groupBy("user_id").agg(F.max_by("size", F.struct("t", "event_id")).alias("size"))
    return last.select("user_id", "size", F.lit(3).alias("max_size"))


@query("backoff_schedule", "SELECT CAST(a AS BIGINT) AS attempt, pow(2, a)::DOUBLE AS delay, 0.75 * pow(2, a) AS least, 1.25 * pow(2, a) AS most FROM range(5) t(a)")
def backoff_schedule(spark: SparkSession, sf: str) -> DataFrame:
    d = F.pow(F.lit(2.0), F.col("id"))
    return spark.range(5).select(F.col("id").alias("attempt"), d.alias("delay"), (0.75 * d).alias("least"), (1.25 * d).alias("most"))


@query("ttl_cleanup", "SELECT ts < TIMESTAMP '2024-01-16' AS removed, count(*) AS n FROM events GROUP BY ALL")
def ttl_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Records older than 15 days at the end of the month go; without a time they stay."""
    old = F.coalesce(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(False))
    return table(spark, sf, "events").groupBy(old.alias("removed")).agg(F.count("*").alias("n"))


@query("blacklist_ttl", "WITH b AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = e.user_id AND e.ts >= b.t AND e.ts < b.t + INTERVAL 300 SECOND) GROUP BY user_id")
def blacklist_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Events outside the 300 seconds after their user's last error."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_type")
    b = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("t"))
    blocked = F.coalesce((F.col("ts") >= F.col("t")) & (F.col("ts") < F.col("t") + F.expr("interval 300 seconds")), F.lit(False))
    return e.join(b, "user_id", "left").where(~blocked).groupBy("user_id").agg(F.count("*").alias("n"))


@query("store_live_entries", "SELECT event_id, user_id FROM events WHERE event_id % 10 = 0 OR ts + INTERVAL 10 DAY >= TIMESTAMP '2024-01-31'")
def store_live_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that never expire (every tenth) or whose ten days aren't over."""
    ends = F.col("ts") + F.expr("interval 10 days")
    return table(spark, sf, "events").where((F.col("event_id") % 10 == 0) | (ends >= F.lit("2024-01-31").cast("timestamp_ntz"))).select("event_id", "user_id")


# Words of errors after which a connection is worth another try.
RETRYABLE_WORDS = ("connection", "timeout", "refused", "reset", "closed", "network", "dns", "resolve")
ERRORS = ("HTTP {c} from server", "Connection reset by peer", "certificate has expired", "DNS lookup failed, HTTP {c}", "request TIMEOUT", "bad record")
STATUSES = (200, 403, 404, 429, 500, 503, 301)
_STATUS_SQL = f"{list(STATUSES)!r}[CAST(event_id % {len(STATUSES)} AS BIGINT) + 1]"
_RETRY_SQL = "({x} >= 500 AND {x} < 600 OR {x} IN (403, 429))"


def retryable_status(code):
    """Whether a status is worth another try; an unknown one isn't."""
    return F.coalesce(code.between(500, 599) | code.isin(403, 429), F.lit(False))


def retryable_error(message):
    return F.exists(F.array(*(F.lit(w) for w in RETRYABLE_WORDS)), lambda w: F.contains(F.lower(message), w))


def status_in(message):
    """The status code that an error message names, else null."""
    found = F.regexp_extract(message, r"HTTP (\d{3})", 1)
    return F.when(found != "", found.cast("int"))


def failure_response(status, results):
    """Whether a searcher's response is a failure: refused, or without results."""
    return (status == 429) | results.isNull() | (F.size(results) == 0)


def is_pdf(content_type):
    return F.coalesce(F.startswith(F.trim(F.lower(content_type)), F.lit("application/pdf")), F.lit(False))


@query("response_classify", f"SELECT event_id, status, CASE WHEN {_RETRY_SQL.format(x='status')} THEN 'retry' WHEN status = 200 THEN 'ok' ELSE 'fail' END AS class, status = 429 OR r IS NULL OR r = 0 AS failure FROM (SELECT event_id, {_STATUS_SQL} AS status, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS r FROM events)")
def response_classify(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    codes = F.array(*(F.lit(c) for c in STATUSES))
    results = F.when(i % 5 != 0, F.array_repeat(F.col("event_type"), (i % 3).cast("int")))
    e = table(spark, sf, "events").select("event_id", F.get(codes, (i % len(STATUSES)).cast("int")).alias("status"), results.alias("results"))
    kind = F.when(retryable_status(F.col("status")), "retry").when(F.col("status") == 200, "ok").otherwise("fail")
    return e.select("event_id", "status", kind.alias("class"), failure_response(F.col("status"), F.col("results")).alias("failure"))


_ERROR_SQL = f"replace({list(ERRORS)!r}[CAST(event_id % {len(ERRORS)} AS BIGINT) + 1], '{{c}}', CAST({_STATUS_SQL} AS VARCHAR))"


@query("error_classify", f"SELECT event_id, code, coalesce({_RETRY_SQL.format(x='code')}, false) AS retry_status, regexp_matches(lower(m), '{'|'.join(RETRYABLE_WORDS)}') AS retry_error FROM (SELECT event_id, m, TRY_CAST(regexp_extract(m, 'HTTP (\\d{{3}})', 1) AS INTEGER) AS code FROM (SELECT event_id, {_ERROR_SQL} AS m FROM events))")
def error_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of a fetch: the status they name, and whether the status or the words make another try worthwhile."""
    i = F.col("event_id")
    code = F.get(F.array(*(F.lit(c) for c in STATUSES)), (i % len(STATUSES)).cast("int")).cast("string")
    message = F.replace(F.get(F.array(*(F.lit(e) for e in ERRORS)), (i % len(ERRORS)).cast("int")), F.lit("{c}"), code)
    e = table(spark, sf, "events").select("event_id", message.alias("m")).withColumn("code", status_in(F.col("m")))
    return e.select("event_id", "code", retryable_status(F.col("code")).alias("retry_status"), retryable_error(F.col("m")).alias("retry_error"))


CONTENT_TYPES = ("application/pdf", " Application/PDF; charset=binary", "text/html", "application/x-pdf", "", "application/pdf+x")


@query("pdf_content_type", f"SELECT event_id, coalesce(starts_with(trim(lower(t)), 'application/pdf'), false) AS pdf FROM (SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE {list(CONTENT_TYPES)!r}[CAST(event_id % 7 AS BIGINT) + 1] END AS t FROM events)")
def pdf_content_type(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*(F.lit(t) for t in CONTENT_TYPES)), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf, "events").select("event_id", is_pdf(kind).alias("pdf"))


#: Zones with their offset (minutes) and short name in summer and winter, for the SQL: those of the events' zones.
ZONES = ["UTC", "Asia/Tokyo", "Asia/Kolkata", "America/Phoenix", "America/New_York", "Europe/Berlin", "Nowhere/Else"]
_ZONE_SQL = f"""z AS (SELECT event_id, ts, {ZONES!r}[CAST(event_id % 7 AS BIGINT) + 1] AS zone FROM events),
l AS (SELECT *, CASE zone WHEN 'UTC' THEN 0 WHEN 'Asia/Tokyo' THEN 540 WHEN 'Asia/Kolkata' THEN 330 WHEN 'America/Phoenix' THEN -420
  WHEN 'America/New_York' THEN CASE WHEN summer_us THEN -240 ELSE -300 END WHEN 'Europe/Berlin' THEN CASE WHEN summer_eu THEN 120 ELSE 60 END END AS m
 FROM (SELECT *, ts >= us_from AND ts < us_to AS summer_us, ts >= eu_from AND ts < eu_to AS summer_eu FROM (SELECT *,
   make_date(year(ts), 3, 14) - CAST(dayofweek(make_date(year(ts), 3, 14)) AS INTEGER) + INTERVAL 7 HOUR AS us_from,
   make_date(year(ts), 11, 7) - CAST(dayofweek(make_date(year(ts), 11, 7)) AS INTEGER) + INTERVAL 6 HOUR AS us_to,
   make_date(year(ts), 3, 31) - CAST(dayofweek(make_date(year(ts), 3, 31)) AS INTEGER) + INTERVAL 1 HOUR AS eu_from,
   make_date(year(ts), 10, 31) - CAST(dayofweek(make_date(year(ts), 10, 31)) AS INTEGER) + INTERVAL 1 HOUR AS eu_to FROM z))),
n AS (SELECT *, ts + to_minutes(m) AS t, CASE zone WHEN 'UTC' THEN 'UTC' WHEN 'Asia/Tokyo' THEN 'JST' WHEN 'Asia/Kolkata' THEN 'IST' WHEN 'America/Phoenix' THEN 'MST'
  WHEN 'America/New_York' THEN CASE WHEN m = -240 THEN 'EDT' ELSE 'EST' END WHEN 'Europe/Berlin' THEN CASE WHEN m = 120 THEN 'CEST' ELSE 'CET' END END AS name FROM l)"""


@query("datetime_formats", f"WITH {_ZONE_SQL} SELECT event_id, CASE WHEN m IS NULL THEN 'Error: no time zone found with key ' || zone ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(t, '.%f') ELSE '' END || CASE WHEN m < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs(m) // 60, abs(m) % 60) END AS iso, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS unix, CASE WHEN m IS NULL THEN 'Error: no time zone found with key ' || zone ELSE strftime(t, '%A, %B %d, %Y at %I:%M:%S %p ') || name END AS readable FROM n")
def datetime_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's time in a zone (one in seven is unknown), in the three forms."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.get(F.array(*map(F.lit, ZONES)), (F.col("event_id") % 7).cast("int")).alias("zone"))
    return e.select("event_id", *(c.alias(n) for n, c in zones.told(F.col("ts"), F.col("zone"), ZONES[:-1]).items()))


@query("message_id", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'notify:' || event_type ELSE CAST(event_id AS VARCHAR) END AS message_id FROM events")
def message_id(spark: SparkSession, sf: str) -> DataFrame:
    """The id of a JSON message, or its method if it has none."""
    body = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("id"), F.col("event_type").alias("method")))
    m = table(spark, sf, "events").select("event_id", body.alias("m"))
    return m.select("event_id", F.coalesce(F.get_json_object("m", "$.id"), F.concat(F.lit("notify:"), F.get_json_object("m", "$.method"))).alias("message_id"))


@query("sse_decode", "SELECT event_id, event_type AS content FROM events WHERE event_id % 4 <> 3")
def sse_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Stream lines ``data: {json}``; every fourth line is a comment and is skipped."""
    data = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("event_type").alias("content"))))
    lines = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 3, ": ping").otherwise(data).alias("line"))
    return lines.select("event_id", event_files.event_content(F.col("line"))["content"].alias("content")).where("content is not null")


# ---- an encyclopedia's responses, made of the tables, read as one table of variants

def _wiki(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    d, s, p = (table(spark, sf, t) for t in ("documents", "supplier", "part"))
    body = lambda x: F.to_json(x).alias("body")
    hit = F.struct(F.col("source").alias("title"), F.concat(F.lit("A/"), F.col("doc_id").cast("string")).alias("path"), F.substring("text", 1, 50).alias("snippet"), (F.col("doc_id") % 10 / 2).alias("score"))
    of_docs = lambda kind, x: d.select(F.lit(kind).alias("kind"), F.col("doc_id").alias("id"), F.lit("wiki").alias("book"), body(x))
    bodies = of_docs("search", F.struct(F.when(F.col("doc_id") % 5 != 0, F.array(hit, F.struct(F.lit(None).cast("string").alias("title"), F.lit("B").alias("path"), F.lit("").alias("snippet"), F.lit(None).cast("double").alias("score")))).alias("results")))
    bodies = bodies.unionByName(of_docs("suggest", F.create_map(F.when(F.col("doc_id") % 4 == 0, "other").otherwise("wiki"), F.array(hit))))
    bodies = bodies.unionByName(of_docs("content", F.struct(F.when(F.col("doc_id") % 3 != 0, F.substring("text", 1, 100)).alias("content"), F.col("lang"))))
    bodies = bodies.unionByName(s.select(F.lit("catalog").alias("kind"), F.col("s_suppkey").alias("id"), F.lit("wiki").alias("book"), body(F.array(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("entries"))))))
    bodies = bodies.unionByName(p.select(F.lit("random").alias("kind"), F.col("p_partkey").alias("id"), F.lit("wiki").alias("book"), body(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("path")))))
    return responses.wiki_fields(responses.wiki_table(bodies).where(F.col("kind") == kind), kind).drop("book").withColumn("pos", F.col("pos").cast("bigint"))


_WIKI_SQL = {
    "search": "SELECT doc_id AS id, pos, CASE pos WHEN 0 THEN source ELSE '' END AS title, CASE pos WHEN 0 THEN 'A/' || doc_id ELSE 'B' END AS url, CASE pos WHEN 0 THEN left(text, 50) ELSE '' END AS content, CASE pos WHEN 0 THEN (doc_id % 10) / 2 ELSE 0 END::DOUBLE AS score, '' AS zim FROM documents, (VALUES (0::BIGINT), (1::BIGINT)) v(pos) WHERE doc_id % 5 <> 0",
    "suggest": "SELECT doc_id AS id, 0::BIGINT AS pos, source AS title, 'A/' || doc_id AS url FROM documents WHERE doc_id % 4 <> 0",
    "content": "SELECT doc_id AS id, 0::BIGINT AS pos, CASE WHEN doc_id % 3 <> 0 THEN left(text, 100) ELSE '' END AS content FROM documents",
    "catalog": "SELECT s_suppkey AS id, 0::BIGINT AS pos, s_name AS name, '' AS title, '' AS description, '' AS language, '' AS file, CAST(s_nationkey AS BIGINT) AS entries FROM supplier",
    "random": "SELECT p_partkey AS id, 0::BIGINT AS pos, p_name AS title, p_type AS path FROM part",
}
for _kind, _sql in _WIKI_SQL.items():
    query(f"wiki_{_kind}", _sql)(lambda spark, sf, kind=_kind: _wiki(spark, sf, kind))


@query("flatten_struct", "SELECT event_id, 'event_type' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 'at_user', CAST(user_id AS VARCHAR) FROM events")
def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    """Nested fields as (path, value) rows, names joined by underscores."""
    nested = table(spark, sf, "events").select("event_id", F.struct(F.col("event_type"), F.struct(F.col("user_id").alias("user")).alias("at")).alias("s"))
    leaves = F.array(F.struct(F.lit("event_type").alias("path"), F.col("s.event_type").alias("value")), F.struct(F.lit("at_user").alias("path"), F.col("s.at.user").cast("string").alias("value")))
    return nested.select("event_id", F.inline(leaves))


# ---- memory

@query("memory_list", "SELECT conv_id, count(*) AS n, string_agg((turn + 1) || '. ' || coalesce(text, ''), chr(10) ORDER BY turn) AS listing FROM conversations GROUP BY conv_id")
def memory_list(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.coalesce("text", F.lit("")))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    return g.select("conv_id", "n", F.array_join(F.col("x.l"), "\n").alias("listing"))


@query("memory_clear", "SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def memory_clear(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after all records of one type are deleted."""
    return table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn")


MEMORY_SQL = f"SELECT q.vec_id AS query_id, m.vec_id AS memory_id, round(list_cosine_similarity({VEC.replace('embedding', 'm.embedding')}, {VEC.replace('embedding', 'q.embedding')}), 4) AS sim FROM embeddings q JOIN embeddings m ON q.label = m.label AND q.vec_id <> m.vec_id WHERE q.vec_id % 20 = 0"


@query("memory_search", f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, memory_id) AS rank, memory_id, sim FROM ({MEMORY_SQL}) QUALIFY rank <= 10")
def memory_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten memories of the same user (here: label) nearest to each query (here: every twentieth vector; a top-k report)."""
    e = _emb(spark, sf)
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "label")
    found = vectors.nearest_within(e.withColumnRenamed("vec_id", "memory_id"), queries, "label", "memory_id", "query_id", 10)
    return found.select("query_id", "rank", "memory_id", "sim")


# ---- language-model stand-ins

@query("expand_query", "SELECT item_id, q || ' site:wikipedia.org OR define ' || q || ' OR ' || q || ' tutorial OR best ' || q || ' guide' AS expanded FROM (SELECT item_id, string_split(text, ' ')[1] AS q FROM benchmark)")
def expand_query(spark: SparkSession, sf: str) -> DataFrame:
    q = F.get(F.split("text", " "), F.lit(0))
    return table(spark, sf, "benchmark").select("item_id", F.concat_ws(" OR ", F.concat(q, F.lit(" site:wikipedia.org")), F.concat(F.lit("define "), q), F.concat(q, F.lit(" tutorial")), F.concat(F.lit("best "), q, F.lit(" guide"))).alias("expanded"))


SUBS = "list_filter(list_transform(string_split('1. ' || w[1] || chr(10) || '- ' || w[2] || chr(10) || chr(10) || '* ' || w[1], chr(10)), lambda l: trim(regexp_replace(trim(l), '^([1-5]\\.|[-*•] )\\s*', ''))), lambda l: l <> '')"


def _subqueries(text):
    w = F.split(text, " ")
    reply = F.concat(F.lit("1. "), F.get(w, F.lit(0)), F.lit("\n- "), F.get(w, F.lit(1)), F.lit("\n\n* "), F.get(w, F.lit(0)))
    lines = F.transform(F.split(reply, "\n"), lambda line: F.trim(F.regexp_replace(F.trim(line), r"^([1-5]\.|[-*•] )\s*", "")))
    return F.filter(lines, lambda line: line != "")


@query("parse_subqueries", f"SELECT item_id, array_to_string({SUBS}, '|') AS parts FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def parse_subqueries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(_subqueries(F.col("text")), "|").alias("parts"))


@query("query_variants", f"SELECT item_id, replace(w[1] || chr(10) || w[2], chr(10), chr(124)) AS variants FROM (SELECT item_id, string_split(text, chr(32)) AS w FROM benchmark) WHERE w[1] <> w[2]")
def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct variants in order of their first occurrence."""
    w = F.split("text", " ")
    return table(spark, sf, "benchmark").where(F.get(w, F.lit(0)) != F.get(w, F.lit(1))).select("item_id", F.array_join(F.array_distinct(_subqueries(F.col("text"))), "|").alias("variants"))


@query("parse_relevance", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 5.0 ELSE least(10.0, CAST(CAST(item_id % 13 AS VARCHAR) || '.5' AS DOUBLE)) END AS relevance FROM benchmark")
def parse_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """The first number of a reply, within 0 and 10; 5 if there is none."""
    reply = F.when(F.col("item_id") % 5 == 0, "no idea").otherwise(F.concat(F.lit("Score: "), (F.col("item_id") % 13).cast("string"), F.lit(".5 of ten")))
    number = F.regexp_extract(reply, r"\d+\.?\d*", 0)
    return table(spark, sf, "benchmark").select("item_id", F.when(number == "", 5.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.try_to_number(number, F.lit("99.9")).cast("double")))).alias("relevance"))


_QUERY_WORDS = f"list_distinct({TOKENS_SQL.format(t='query')})"
_RERANK_SQL = f"""
WITH b AS ({BM25_SQL}), c AS (SELECT b.qid, b.rank AS first_rank, b.doc_id, {_QUERY_WORDS} AS q, list_distinct({TOKENS_SQL.format(t='left(text, 500)')}) AS w FROM b JOIN ({QUERIES_SQL}) USING (qid) JOIN documents USING (doc_id)),
s AS (SELECT *, CASE WHEN len(q) = 0 THEN 5.0 ELSE round(10.0 * len(list_intersect(q, w)) / len(q), 4) END::DOUBLE AS score FROM c)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_rank) AS rank, doc_id, score FROM s QUALIFY rank <= 10
"""


@query("llm_rerank", _RERANK_SQL)
def llm_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Of each query's first twenty documents a scorer (the offline stand-in: shared words of the first 500 characters, as the scorer is shown) picks ten."""
    best = bm25_rank(spark, sf).select("qid", F.col("rank").alias("first_rank"), "doc_id")
    texts = table(spark, sf, "documents").select("doc_id", "text")
    few = queries_of(spark, sf).count() * 20 <= ranking.BROADCAST_TERMS  # twenty each at most
    candidates = texts.join(F.broadcast(best) if few else best, "doc_id").join(queries_of(spark, sf).select("qid", "query"), "qid")
    return providers.rerank(candidates, "qid", "query", "text", "first_rank", 10).select("qid", "rank", "doc_id", "score")


# ---- charts

def _chart(name: str, sql: str, build):
    query(name, sql)(build)


def _orders(spark, sf):
    return table(spark, sf, "orders").select("*", F.date_format("o_orderdate", "yyyy-MM").alias("month"))


MONTH = "strftime(o_orderdate, '%Y-%m')"
_chart("chart_line", f"SELECT o_orderstatus AS series, {MONTH} AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY ALL", lambda s, d: _orders(s, d).groupBy(F.col("o_orderstatus").alias("series"), F.col("month").alias("x")).agg(F.round(F.sum("o_totalprice"), 2).alias("y")))
_chart("chart_bar", "SELECT c_mktsegment AS x, count(*) AS y FROM customer GROUP BY ALL", lambda s, d: table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("x")).agg(F.count("*").alias("y")))
_chart("chart_scatter", "SELECT s_suppkey AS id, s_nationkey AS x, s_acctbal AS y FROM supplier", lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("x"), F.col("s_acctbal").alias("y")))
_chart("chart_pie", "SELECT o_orderpriority AS label, count(*) AS y, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY ALL", lambda s, d: table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("y")).withColumn("share", F.round(F.col("y") / F.sum("y").over(Window.partitionBy()), 4)))
_chart("chart_area", f"SELECT series, x, y, CAST(sum(y) OVER (PARTITION BY x ORDER BY series) AS BIGINT) AS top FROM (SELECT o_orderstatus AS series, {MONTH} AS x, count(*) AS y FROM orders GROUP BY ALL)", lambda s, d: _orders(s, d).groupBy(F.col("o_orderstatus").alias("series"), F.col("month").alias("x")).agg(F.count("*").alias("y")).withColumn("top", F.sum("y").over(Window.partitionBy("x").orderBy("series"))))
_chart("chart_histogram", "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS y FROM lineitem, m GROUP BY ALL", lambda s, d: table(s, d, "lineitem").crossJoin(F.broadcast(table(s, d, "lineitem").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")))).groupBy(F.least(F.floor((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9)).cast("bigint").alias("bin")).agg(F.count("*").alias("y")))
_chart("chart_box", "SELECT l_returnflag AS x, min(l_quantity) AS lo, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS q2, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS hi FROM lineitem GROUP BY ALL", lambda s, d: exact_quantiles(table(s, d, "lineitem").withColumnRenamed("l_returnflag", "x"), "x", F.col("l_quantity"), {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "hi": 1.0}))
_chart("chart_heatmap", "SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS z FROM lineitem GROUP BY ALL", lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y")).agg(F.count("*").alias("z")))
TREE = "SELECT n_name AS label, r_name AS parent, count(c_custkey) AS value FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"


def _tree(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("label"), F.col("r_name").alias("parent"), F.coalesce("k", F.lit(0)).alias("value"))


_chart("chart_treemap", TREE, _tree)
_chart("chart_sunburst", f"WITH t AS ({TREE}) SELECT label, parent, value FROM t UNION ALL SELECT parent, '', CAST(sum(value) AS BIGINT) FROM t GROUP BY parent", lambda s, d: _tree(s, d).unionByName(_tree(s, d).groupBy(F.col("parent").alias("label")).agg(F.sum("value").alias("value")).withColumn("parent", F.lit(""))))
_chart("chart_funnel", "SELECT event_type AS stage, count(DISTINCT user_id) AS value FROM events GROUP BY ALL", lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count_distinct("user_id").alias("value")))
_chart("chart_gauge", "SELECT round(avg(l_quantity), 4) AS value, 0.0::DOUBLE AS least, 50.0::DOUBLE AS most, 45.0::DOUBLE AS threshold FROM lineitem", lambda s, d: table(s, d, "lineitem").agg(F.round(F.avg("l_quantity"), 4).alias("value")).select("value", F.lit(0.0).alias("least"), F.lit(50.0).alias("most"), F.lit(45.0).alias("threshold")))
_chart("chart_indicator", f"SELECT x, y, y - lag(y) OVER (ORDER BY x) AS delta FROM (SELECT {MONTH} AS x, count(*) AS y FROM orders GROUP BY ALL)", lambda s, d: _orders(s, d).groupBy(F.col("month").alias("x")).agg(F.count("*").alias("y")).withColumn("delta", F.col("y") - F.lag("y").over(Window.orderBy("x"))))
_chart("chart_bubble", "SELECT c_mktsegment AS color, c_nationkey AS x, round(avg(c_acctbal), 6) AS y, count(*) AS size FROM customer GROUP BY ALL", lambda s, d: table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("color"), F.col("c_nationkey").alias("x")).agg(F.round(F.avg("c_acctbal"), 6).alias("y"), F.count("*").alias("size")))
