"""The corpus pipeline: stages over the documents table, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes what a stage returns to the
shared folder and reads it again, so that a later stage never repeats an earlier
one and lost executors cost no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, langid, mixing, ngram_join, pii
from sievework.llm.shared import Tables

#: Below this calibrated probability a document's language counts as unknown.
MIN_LANG_SCORE = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is unsure; ``lang`` becomes what was found.

    With no labelled document there is nothing to learn: then only documents without letters go.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit_langid(docs)
    if not model.langs:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    found = langid.identify(docs, model, lang_col="__lang", score_col="__score")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_LANG_SCORE)).select(
        "doc_id", "text", F.col("__lang").alias("lang"), "source", "n_chars"
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Documents with a null id or without words stay; of rows equal in id and text one stays. Rows
    that share an id are judged each by its own text, so they are told apart by a key of both.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    docs = docs.select(*COLUMNS)
    keyed = docs.where("doc_id is not null").select(key, "doc_id", "text")
    groups = ngram_join.jaccard_components(keyed, id_col="key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("part"))
    tables = Tables(spark, "near-duplicates")
    members = tables.write("members", groups.groupBy("key", "part").agg(F.count("*").alias("rows")).join(keyed.select("key", "doc_id").distinct(), "key"))
    # joined by keys, which are distinct, and not by groups, which may be large
    stays = members.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("best")).select("best.key")
    gone = tables.write("gone", members.join(stays, "key", "left_anti").select("key"))
    kept = docs.withColumn("key", F.when(F.col("doc_id").isNotNull(), key)).join(gone, "key", "left_anti").select(*COLUMNS)
    if not members.where("rows > 1").limit(1).count():
        return kept
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # no row without an id is another's copy
    return kept.withColumn("alone", alone).dropDuplicates(["doc_id", "text", "alone"]).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, be it with other numbers or names."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text."""
    found = pii.find_pii(docs.select(*COLUMNS), keep=("lang", "source"))
    return pii.redact(found).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, with pass, block and position in the mixture."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Learned decisions and hashed orders have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = tables.write(name, out)
        if k:
            tables.drop(STAGES[k - 1][0])
    return docs
