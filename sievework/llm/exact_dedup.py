"""Exact deduplication: groups by a 128-bit content hash, bytes compared inside groups.

Only identifiers and hashes of all rows are shuffled. Texts travel for groups of two rows or more alone, and
there they are grouped by hash *and* text, so a group of very many copies is one row a task before the shuffle.
A group with one distinct text is one class. Where a hash stands for several texts (a collision), its
rows are told apart by their texts.

Up to ``BROADCAST_GROUPS`` groups of two or more are broadcast (counted first). Beyond that, groups of more rows than
``1 / HEAVY_KEYS`` of the table, of which there are at most ``HEAVY_KEYS`` whatever its size, still are, so that their rows never
meet in one task; all others are joined by their hash, which spreads evenly.

Defined cases: a null text is an empty one, and all empty texts are one group; of rows equal in text and id one is
kept; a null id is kept only if its group has no other, and then ``keep_id`` is null; very long texts count whole;
an empty table gives an empty result; other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import Tables

#: All groups are broadcast up to this number (some 100 bytes each).
BROADCAST_GROUPS = 250_000
#: Beyond it a group counts as heavy from ``rows / HEAVY_KEYS`` on, so at most so many are.
HEAVY_KEYS = 20_000
#: A group of fewer rows is never heavy.
HEAVY_ROWS = 500


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def content_hash(sha256: Column) -> Column:
    """The leading 128 bits of a digest in hexadecimal digits, as bytes."""
    return F.unhex(F.substring(sha256, 1, 32))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normal: Callable[[Column], Column] = ascii_lower,
    hash_of: Callable[[Column], Column] = content_hash,
    carry: list[str] | None = None,
) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` and the columns ``carry`` for each row.

    ``keep``: ``smallest`` or ``largest`` id of a group of equal texts. ``normal``: what is applied to texts before they
    are compared. ``hash_of``: the content hash, given the digest of a normalised text. Filtering by ``kept``
    deduplicates the table (with ``carry`` its texts).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    carry = carry or []
    tables = Tables(docs.sparkSession, "exact-dedup")
    text = normal(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    source = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), *(F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)))
    sha = F.sha2("__text", 256)
    hashed = source.withColumn("__sha", sha).withColumn("__h", hash_of(F.col("__sha")))
    # a number of its own tells rows apart that share their id; it stays as it is written
    rows = tables.write("rows", hashed.drop("__text").withColumn("__row", F.monotonically_increasing_id()))
    groups = tables.write("groups", _grouped(rows, ["__h"], keep).where("__n > 1"))
    few = groups.count() <= BROADCAST_GROUPS
    least = 0 if few else max(HEAVY_ROWS, -(-rows.count() // HEAVY_KEYS))
    heavy = F.col("__n") >= least if least else F.lit(True)
    groups = groups.withColumn("__heavy", heavy)

    # bytes: how many different texts has each hash that occurs twice?
    keys = groups.select("__h", "__heavy")
    texts = _joined(hashed.select("__h", "__text"), keys, "left_semi", few).distinct()
    clash = tables.write("clash", texts.groupBy("__h").agg(F.count("*").alias("__texts")).where("__texts > 1").select("__h"))
    sure, parts = groups, []
    if clash.limit(1).count():
        clashing = keys.join(clash, "__h", "left_semi")
        mixed = _joined(hashed, clashing, "left_semi", few).withColumn("__row", F.monotonically_increasing_id())
        mixed = tables.write("mixed", mixed)
        told = _grouped(mixed, ["__h", "__text"], keep).withColumn("__heavy", heavy)
        parts = [_report(mixed, tables.write("told", told), ["__h", "__text"], id_col, carry, few)]
        rows = _joined(rows, clashing, "left_anti", few)
        sure = groups.join(clash, "__h", "left_anti")
    out = _report(rows, sure, ["__h"], id_col, carry, few)
    for part in parts:
        out = out.unionByName(part)
    return out


def _grouped(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Size of each group, its kept id and the row that stays; longs only, so partial results combine in hash maps before the shuffle."""
    if keep == "largest":
        best, chosen = F.max("__id"), F.max_by("__row", F.struct(F.col("__id").isNotNull(), "__id"))
    else:
        best, chosen = F.min("__id"), F.min_by("__row", F.struct(F.col("__id").isNull(), "__id"))
    if dict(rows.dtypes)["__id"] in ("bigint", "int"):  # plain numbers need no struct, which would sort instead
        edge = F.lit(-(2**63) if keep == "largest" else 2**63 - 1)
        chosen = (F.max_by if keep == "largest" else F.min_by)("__row", F.coalesce("__id", edge))
    return rows.groupBy(*keys).agg(F.count("*").alias("__n"), best.alias("__best"), chosen.alias("__chosen"))


def _joined(rows: DataFrame, groups: DataFrame, how: str, few: bool, keys: list[str] | None = None) -> DataFrame:
    """Rows with their group: by broadcast if groups are ``few``; else heavy ones by broadcast, so that no row of theirs is shuffled, and the rest by key."""
    keys = keys or ["__h"]
    if few:
        return rows.join(F.broadcast(groups.drop("__heavy")), keys, how)
    heavy, light = F.broadcast(groups.where("__heavy").drop("__heavy")), groups.where("not __heavy").drop("__heavy")
    if how == "left_anti":
        return rows.join(heavy, keys, how).join(light, keys, how)
    if how == "left_semi":
        return rows.join(heavy, keys, how).unionByName(rows.join(light, keys, how))
    return rows.join(heavy, keys).unionByName(rows.join(heavy, keys, "left_anti").join(light, keys, how))


def _report(rows: DataFrame, groups: DataFrame, keys: list[str], id_col: str, carry: list[str], few: bool) -> DataFrame:
    met = _joined(rows, groups, "left", few, keys)
    alone = F.col("__n").isNull()
    return met.select(
        F.col("__id").alias(id_col),
        F.when(alone, F.col("__id")).otherwise(F.col("__best")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("__row") == F.col("__chosen"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
        *(F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)),
    )
