"""Lists of domains and networks as tables: which entry, the longest, covers a host or an address.

A host is covered by a listed domain that is the host or ends it after a dot; so the host's suffixes are looked up. An address is
covered by a network whose leading bits it shares; so its prefixes, of those lengths that the table has, are looked up. Both
are equi-joins. A list of up to ``IN_ROW`` entries is tested within the row; a longer one is joined, after a Bloom filter of the
list has dropped nearly all look-ups that would find nothing, so that few of them are shuffled. Nothing is compared with all entries.

The filter has ``FILTER_WORDS`` words of 64 bits at most (some megabytes); beyond some millions of entries it lets more pass, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.rows import exploded

IN_ROW = 2_000
FILTER_WORDS = 1 << 18
HASHES = 3


def suffixes(host: Column) -> Column:
    """The host in lower case and what follows each of its dots, longest first; none for an empty one."""
    clean = F.rtrim(F.lower(host), F.lit("."))
    parts = F.split(clean, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))
    return F.when(clean != "", every).otherwise(F.array().cast("array<string>"))


def prefixes(address: Column, lengths: list[int]) -> Column:
    """``length/leading bits`` of a 32-bit address (a number) for each length."""
    one = lambda n: F.concat(F.lit(f"{n}/"), F.call_function("shiftright", address.cast("bigint"), F.lit(32 - n)).cast("string"))
    return F.array(*map(one, lengths)) if lengths else F.array().cast("array<string>")


def network_key(network: Column, length: Column) -> Column:
    """The key of a network, given any of its addresses as a number."""
    return F.concat(length.cast("string"), F.lit("/"), F.call_function("shiftright", network.cast("bigint"), 32 - length).cast("string"))


def _places(key: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(words * 64)) for k in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str, entries: int) -> tuple[DataFrame, int]:
    """One row ``bits``, an array of words, and their number: 16 bits an entry or fewer, pre-aggregated in each task."""
    words = max(1, min(FILTER_WORDS, entries // 4))
    at = keys.select(F.explode(F.array(*_places(F.col(key), words))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    filled = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(one).alias("b"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("w")).join(filled, "w", "left")
    pairs = F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))))
    return every.agg(F.transform(pairs, lambda x: x["b"]).alias("bits")), words


def _may_hold(bits: Column, key: Column, words: int) -> Column:
    out = F.lit(True)
    for at in _places(key, words):
        out = out & (F.call_function("shiftright", F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return out


def longest_match(rows: DataFrame, row_key: str, lookups: Column, listed: DataFrame, entry: str, in_row: int = IN_ROW) -> DataFrame:
    """``rows`` with ``match``: the first of the row's look-ups (longest first) that ``listed`` has, else null. ``row_key`` tells rows apart."""
    keys = listed.select(F.col(entry).alias("k")).where("k is not null").distinct()
    few = [r["k"] for r in keys.limit(in_row + 1).collect()]
    if len(few) <= in_row:
        hit = F.filter(lookups, lambda k: k.isin(few)) if few else F.array().cast("array<string>")
        return rows.withColumn("match", F.get(hit, F.lit(0)))
    bits, words = bloom_filter(keys, "k", keys.count())
    asked = exploded(rows.select(F.col(row_key).alias("r"), lookups.alias("ks")), ["r"], "ks", "k", "at")
    likely = asked.where(_may_hold(bits.scalar(), F.col("k"), words))
    found = likely.join(keys, "k").groupBy("r").agg(F.min_by("k", "at").alias("match"))
    return rows.join(found, F.col(row_key) == F.col("r"), "left").drop("r")
