"""Many keywords sought in one pass over each text: containment, whatever the number of keywords.

Keywords are a table with the groups they belong to. They are compiled to a trie with failure links, which reads a text once
and meets every keyword that it contains. A compiled table has ``SHARD`` keywords at most, by count; a larger one is cut into
as many, by a hash, and each text is read once a shard. What comes back is small and stays in the text's row: no shuffle.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = 200_000
_COMPILED: dict[str, ahocorasick.Automaton] = {}
FOUND = "array<struct<g:int,n:int>>"


def compile_keywords(entries: list[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    trie = ahocorasick.Automaton()
    for k, (word, groups) in enumerate(entries):
        trie.add_word(word, (k, groups))
    trie.make_automaton()
    return trie


def groups_found(trie: ahocorasick.Automaton, text: str) -> list[tuple[int, int]]:
    """Groups with the number of their distinct keywords that the text contains."""
    hits = dict(hit for _, hit in trie.iter(text)) if len(trie) else {}
    return sorted(Counter(g for groups in hits.values() for g in groups).items())


def keyword_groups(keywords: DataFrame, word: str, group: str) -> list:
    """One column function a shard: text -> ``array<struct<g, n>>``. ``keywords`` has a row per keyword and group (a number); null and empty ones are left out."""
    spark = keywords.sparkSession
    pairs = keywords.where((F.length(word) > 0) & F.col(group).isNotNull()).select(F.col(word).alias("w"), F.col(group).cast("int").alias("g"))
    each = pairs.groupBy("w").agg(F.sort_array(F.collect_set("g")).alias("g"))
    shards = max(1, -(-each.count() // SHARD))
    out = []
    for shard in range(shards):
        # some hundred thousand words at most
        part = each if shards == 1 else each.where(F.pmod(F.xxhash64("w"), F.lit(shards)) == shard)
        entries = spark.sparkContext.broadcast([(r["w"], list(r["g"])) for r in part.collect()])
        out.append(_matcher(entries, uuid.uuid4().hex))
    return out


def _matcher(entries, name: str):
    @F.arrow_udf(FOUND)
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = _COMPILED.get(name)
        if trie is None:
            _COMPILED.clear()  # workers live on: the last table stays
            trie = _COMPILED[name] = compile_keywords(entries.value)
        for text in texts:
            got = [groups_found(trie, t) if t else [] for t in text.to_pylist()]
            yield pa.array([[{"g": g, "n": n} for g, n in row] for row in got], pa.list_(pa.struct([("g", pa.int32()), ("n", pa.int32())])))

    return found.asNondeterministic()  # so that no plan evaluates it twice


def with_groups(texts: DataFrame, text: Column, keywords: DataFrame, word: str, group: str, name: str = "groups") -> DataFrame:
    """``texts`` with ``name``: the groups of which a text contains keywords, ascending, each with the number ``n`` of those."""
    columns = [f(text) for f in keyword_groups(keywords, word, group)]
    names = [f"__found{k}" for k in range(len(columns))]
    out = texts.withColumns(dict(zip(names, columns, strict=True)))
    if len(columns) == 1:
        return out.withColumnRenamed(names[0], name)
    every = F.concat(*map(F.col, names))
    groups = F.array_sort(F.array_distinct(F.transform(every, lambda x: x["g"])))
    added = F.transform(groups, lambda g: F.struct(g.alias("g"), F.aggregate(F.filter(every, lambda x: x["g"] == g), F.lit(0), lambda a, x: a + x["n"]).alias("n")))
    return out.withColumn(name, added).drop(*names)
