"""A stored inverted index: built once, appended to, searched for the best documents of many queries.

Documents of a segment are dealt into ranges of about ``RANGE`` documents of like length. A block is the
postings of one term in one range: places of documents in the range with their counts, and beside them (columns that are read
without the postings) how many there are, the largest count and the least length. BM25 grows with
the count and falls with the length, so these two bound every score of the block, whatever the averages
are by now: an append changes no stored block.

A search adds up the bounds of each query and range. The most promising ranges of a query are scored first, and the
score of its last place so far is what other ranges must be able to reach; only those are scored too. The result
is that of scoring everything. Of the folders it reads, a search keeps the blocks of asked terms; its steps read those.

An append moves each text once, to the task that has its range. There words become blocks, so no posting is moved or sorted alone.
A range's keys and lengths are stored once, as a row of their own (folder ``DOCUMENTS``); a search puts them to the asked blocks.

Blocks and the dictionary are partitioned by segment and a hash of the term, so a search reads the asked terms' folders. A segment counts
once its row stands in ``segments``, which is written last: a failed append leaves nothing visible, and
a batch that is appended again is left out. Keys are taken to be distinct; a null text has no terms, but counts as a document.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.rows import exploded
from sievework.operators import ranking
from sievework.sources.shared import shared_dir, written

RANGE = 64
#: Ranges of a slice: blocks of one bucket and slice are built in one task.
SLICE_RANGES = 8192
#: Ranges for each bucket (folder) of a segment, and buckets at most.
BUCKET_RANGES, MOST_BUCKETS = 8, 256
#: Stands in the names of stored indexes: one written by other code isn't read.
FORMAT = 4
#: A block: a term's postings in a range (``docs``: places in it; ``tfs``), how many there are, the largest count, the least length and the
#: sum of the counts. A range's row has no term, but the ``keys`` and ``lengths`` of its documents.
BLOCK = "term string, rng int, n int, tf int, dl int, total bigint, docs array<int>, tfs array<int>, keys array<{key}>, lengths array<int>"
#: The number that the folder of ranges' rows has among the buckets.
DOCUMENTS = -1
SEGMENTS = "segment string, docs bigint, total bigint, buckets int"


def _bin(text: Column) -> Column:
    """Documents of like length: four bins for each doubling."""
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1)).cast("double")) * 4).cast("int")


def term_runs(words: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of words: one sort, then the places where a run begins."""

    def runs(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.get(F.transform(F.array(places), lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf")))), F.lit(0))

    sorted_once = F.get(F.transform(F.array(F.sort_array(words)), lambda s: F.when(F.size(s) > 0, runs(s))), F.lit(0))
    return F.coalesce(sorted_once, F.array().cast("array<struct<term:string,tf:int>>"))


def _range_blocks(docs: pa.Table) -> pa.Table:
    """The blocks of one range, of its documents (``key, rng, w``): places of words are sorted as numbers, a block is a run of them."""
    docs = docs.sort_by("key").combine_chunks()
    w = docs["w"].combine_chunks()
    coded = w.flatten().dictionary_encode()
    dl = np.diff(w.offsets.to_numpy()).astype(np.int32)
    doc = np.repeat(np.arange(len(dl), dtype=np.int64), dl)
    met, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(dl) + doc, return_counts=True)
    code, doc = met // len(dl), met % len(dl)
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(begins, len(met)).astype(np.int32)
    tf, doc = tf.astype(np.int32), doc.astype(np.int32)
    each = (lambda f, x: f.reduceat(x, begins)) if len(met) else (lambda f, x: x[:0])
    kind = docs.schema.field("key").type
    columns = {
        "term": coded.dictionary.take(pa.array(code[begins])),
        "n": pa.array(np.diff(ends)),
        "tf": pa.array(each(np.maximum, tf)),
        "dl": pa.array(each(np.minimum, dl[doc])),
        "total": pa.array(each(np.add, tf.astype(np.int64))),
        "docs": pa.ListArray.from_arrays(pa.array(ends), pa.array(doc)),
        "tfs": pa.ListArray.from_arrays(pa.array(ends), pa.array(tf)),
        "keys": pa.nulls(len(begins), pa.list_(kind)),
        "lengths": pa.nulls(len(begins), pa.list_(pa.int32())),
    }
    whole = {"keys": docs["key"].combine_chunks(), "lengths": pa.array(dl)}
    # neighbours that differ in the term alone take few bytes
    alike = pa.array(np.lexsort((pc.binary_length(columns["term"]).to_numpy(), doc[begins], columns["tf"].to_numpy(), np.diff(ends))))
    for name, x in columns.items():  # the range's own row comes last
        last = pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), whole[name]) if name in whole else pa.nulls(1, x.type)
        columns[name] = pa.concat_arrays([x.take(alike), last])
    rng = pa.array(np.full(len(begins) + 1, docs["rng"][0].as_py(), np.int32))
    return pa.table({"term": columns.pop("term"), "rng": rng, **columns})


class InvertedIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def segments(self) -> list[Row]:
        """The segments that count: a row each, as many as there were appends."""
        if not self._exists("segments"):
            return []
        return self.spark.read.schema(SEGMENTS).parquet(f"{self.path}/segments").orderBy("segment").collect()

    def append(self, docs: DataFrame, key: str, text: str, batch: str) -> bool:
        """Adds the documents as the segment ``batch``; false if that has been appended before."""
        name = f"s-{batch}"
        if any(r["segment"] == name for r in self.segments()):
            return False
        source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("bin", _bin(F.col("text")))
        # as many numbers as there are bins: some hundred whatever the table
        sizes = {r["bin"]: r["n"] for r in source.groupBy("bin").agg(F.count("*").alias("n")).collect()}
        ranges, first = {}, 0
        for b in sorted(sizes):
            ranges[b] = (first, -(-sizes[b] // RANGE))
            first += ranges[b][1]
        buckets = max(1, min(MOST_BUCKETS, first // BUCKET_RANGES))
        start, many = (F.create_map(*(F.lit(x) for b, r in ranges.items() for x in (b, r[k]))) if ranges else F.lit(None) for k in (0, 1))
        of_bin = (F.element_at(start, F.col("bin")) + F.pmod(F.xxhash64("key", "text"), F.element_at(many, F.col("bin")))).cast("int") if ranges else F.lit(0)
        # texts move once, sorted before they become words: a range's documents meet, and its blocks are made where they are
        dealt = source.select("key", of_bin.alias("rng"), "text").repartition("rng").sortWithinPartitions("rng")
        words = dealt.select("key", "rng", T.tokens(F.col("text")).alias("w"))
        blocks = words.groupBy("rng").applyInArrow(_range_blocks, BLOCK.format(key=dict(source.dtypes)["key"]))
        bucket = F.when(F.col("term").isNull(), DOCUMENTS).otherwise(_bucket(F.col("term"), buckets))
        where, total = f"{self.path}/postings/segment={name}", 0
        # by bucket only, which are numbers: a search reads whole folders, so the order within says nothing
        stored = blocks.repartition(bucket, F.floor(F.col("rng") / SLICE_RANGES)).withColumn("bucket", bucket).sortWithinPartitions("bucket")
        stored.write.mode("overwrite").partitionBy("bucket").parquet(where)
        if sizes:  # the dictionary: how many documents have a term, how often it occurs
            terms = self.spark.read.parquet(where).where(F.col("bucket") != DOCUMENTS).groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))
            there = f"{self.path}/terms/segment={name}"
            terms.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(there)
            total = self.spark.read.parquet(there).agg(F.sum("total")).first()[0]
        row = self.spark.createDataFrame([(name, sum(sizes.values()), total or 0, buckets)], SEGMENTS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        return True

    def _folders(self, known: list[Row], terms: DataFrame) -> Column:
        """The folders that hold ``terms`` (a column ``term``): of each number of buckets as many numbers at most."""
        wanted = F.lit(False)
        for b in sorted({r["buckets"] for r in known}):
            hit = [r["b"] for r in terms.select(_bucket(F.col("term"), b).alias("b")).distinct().collect()]
            wanted = wanted | (F.col("segment").isin([r["segment"] for r in known if r["buckets"] == b]) & F.col("bucket").isin(hit))
        return wanted

    def _read(self, table: str, empty: str, known: list[Row]) -> DataFrame:
        filled = [r["segment"] for r in known if r["total"]]
        if not filled:
            return self.spark.createDataFrame([], f"{empty}, segment string, bucket int")
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("segment").isin(filled))

    def _postings(self, known: list[Row]) -> DataFrame:
        return self._read("postings", BLOCK.format(key="bigint"), known)

    def blocks(self, known: list[Row] | None = None) -> DataFrame:
        """All blocks of the segments that count (or of those ``known``)."""
        return self._postings(known or self.segments()).where(F.col("bucket") != DOCUMENTS).drop("keys", "lengths")

    def ranges(self, known: list[Row] | None = None) -> DataFrame:
        """``segment, rng, keys, lengths``: the documents of each range, in the order that blocks count them."""
        return self._postings(known or self.segments()).where(F.col("bucket") == DOCUMENTS).select("segment", "rng", "keys", "lengths")

    def frequencies(self) -> DataFrame:
        """``term, df, total``: documents that have a term, and how often it occurs, over all segments."""
        return self._read("terms", "term string, df bigint, total bigint", self.segments()).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))

    def _scored(self, blocks: DataFrame, wanted: DataFrame, qid: str, average: float) -> DataFrame:
        """``qid, key, score`` of all documents in the chosen ranges (``qid, segment, rng, term, w``)."""
        met = blocks.select("segment", "rng", "term", "postings").join(wanted, ["segment", "rng", "term"])
        each = exploded(met, [qid, "w"], "postings", "p")
        part = F.col("w") * ranking._part(F.col("p.tf"), F.col("p.dl"), F.lit(average))
        return each.groupBy(qid, F.col("p.key").alias("key")).agg(F.sum(part).alias("score"))

    def chosen_ranges(self, queries: DataFrame, qid: str, most: int, digits: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The ranges of each query with ``bound`` and ``step`` (1: scored first, 2: can reach the last place, null: left out), and the scores of both steps."""
        scratch = f"{shared_dir(self.spark)}/bm25-search-{uuid.uuid4().hex}"
        known = self.segments()
        n = sum(r["docs"] for r in known)
        average = sum(r["total"] for r in known) / max(n, 1)
        asked = written(ranking.query_terms(queries, [qid]), f"{scratch}/asked")
        each = asked.groupBy(qid).agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
        terms, longest = each["all"] or 0, each["most"] or 0
        few = lambda df, rows: F.broadcast(df) if rows <= ranking.BROADCAST_TERMS else df
        folders = self._folders(known, asked)
        # of the folders read, the asked terms' blocks: only these are kept for the steps, each of which reads them again
        blocks = self.blocks(known).where(folders).join(few(asked.select("term").distinct(), terms), "term", "left_semi")
        posting = lambda d, tf: F.struct(F.get("keys", d).alias("key"), tf.alias("tf"), F.get("lengths", d).alias("dl"))
        blocks = blocks.join(self.ranges(known), ["segment", "rng"]).select("segment", "term", "rng", "n", "tf", "dl", F.zip_with("docs", "tfs", posting).alias("postings"))
        blocks = written(blocks, f"{scratch}/blocks")
        df = self._read("terms", "term string, df bigint, total bigint", known).where(folders).select("term", "df")
        df = df.join(few(asked.select("term").distinct(), terms), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        weights = asked.join(df, "term").select(qid, "term", (F.col("times") * ranking._idf(F.lit(n), F.col("df"))).alias("w"))
        weights = written(weights, f"{scratch}/weights")
        best = F.col("w") * ranking._part(F.col("tf"), F.col("dl"), F.lit(average))
        heads = blocks.select("segment", "rng", "term", "n", "tf", "dl").join(few(weights, terms), "term")
        bounds = written(heads.groupBy(qid, "segment", "rng").agg(F.sum(best).alias("bound"), F.sum("n").alias("postings")), f"{scratch}/bounds")
        nth = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("bound"), "segment", "rng"))
        first = bounds.withColumn("nth", nth).where(F.col("nth") <= most).select(qid, "segment", "rng")
        wanted = first.join(weights, qid)
        scored = written(self._scored(blocks, few(wanted, terms * most), qid, average), f"{scratch}/scored")
        rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score")))
        # results are ranked by rounded scores: what rounds to the last place's score may still come before it
        reach = scored.withColumn("nth", rank).where(F.col("nth") == most).select(qid, (F.col("score") - 2 * 10.0**-digits).alias("reach"))
        told = bounds.join(first.withColumn("step", F.lit(1)), [qid, "segment", "rng"], "left").join(reach, qid, "left")
        step = F.coalesce("step", F.when(F.col("reach").isNull() | (F.col("bound") >= F.col("reach")), 2))
        told = told.select(qid, "segment", "rng", "bound", "postings", step.alias("step"))
        rest = told.where("step = 2").select(qid, "segment", "rng").join(weights, qid)
        return told, scored, self._scored(blocks, few(rest, bounds.count() * longest), qid, average)

    def search(self, queries: DataFrame, qid: str, most: int, digits: int = 4) -> DataFrame:
        """``qid, rank, key, score``: the best ``most`` documents of each query (ties by key)."""
        _, first, rest = self.chosen_ranges(queries, qid, most, digits)
        return ranking.top_of_query(first.unionByName(rest), qid, "key", most, digits).select(qid, "rank", "key", "score")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
