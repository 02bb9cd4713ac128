"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct k-word shingles (64-bit hashes). In a
common order of all shingles, two sets of Jaccard similarity >= t share one of
their first ``n - ceil(t n) + 1`` shingles, their prefixes; of prefixes longer by
4 they share 5, so documents that share fewer with others are done.

1. A count sketch over all shingles of all documents gives the order: shingles
   that many documents share come last, so that prefixes avoid them; among the
   others a hash decides. Any fixed order is exact; this one keeps lists short.
2. Equal sets become one class. Classes of equal prefix and size become one
   group; only groups are listed under their prefix shingles.
3. Groups that share a prefix shingle and have compatible sizes and positions
   are candidates; candidates are expanded to members and verified on whole sets.

The result is connectivity, so a list never emits all its pairs: in each round
the connected parts of a list send one member each to the list's largest part. What
those rounds link needs no more comparisons; what is left between different
parts is compared in full at the end, so no link between parts is missed.

Sets travel only for verification, as whole hashes: a pair's left set once per salted slice of
its partners, not once per pair. Long lists and large groups are joined in slices.

Defined cases: null or blank texts have the empty set, which links with nothing;
with fewer than k words the whole sequence is the one shingle; rows that share an
id are compared each by its own text; rows with a null id link with nothing and
have a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.bytesarrays import shingle_sets, text_chunks, trimmed
from sievework.llm.graph import components
from sievework.llm.shared import Tables

#: Texts are taken in parts of so many bytes (a longer text is one).
PART_BYTES = 256 << 10
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 16
#: A counter this many times the mean marks its shingles as shared by many.
HOT_TIMES, HOT_LEAST = 3.0, 48
ROUNDS = 3
#: A set is sent to at most so many slices of its partners.
SLICES = 256
#: Verification runs in so many parts, one after the other.
PARTS = 4
#: Pairs whose keys are broadcast at most (four times as many rows of two numbers).
BROADCAST_ROWS = 250_000
BEFORE = 8
#: Prefixes are so much longer that similar sets share this many of them.
EXTENDED = 5
#: A list's postings are joined in slices of so many.
SLICE = 2048
_U = np.uint64


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Level of each counter: 0 for usual ones, else the logarithm of its excess. Size fixed by SKETCH_BITS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), PART_BYTES):
                sets = shingle_sets(data, offsets, k)
                np.add.at(counts, _slot(np.concatenate(sets)), np.uint32(1))
        for b in range(0, 1 << SKETCH_BITS, SKETCH_BLOCK):
            part = counts[b : b + SKETCH_BLOCK]
            if part.any():
                part = part.astype(np.uint16) if part.max() < 1 << 16 else part
                yield pa.RecordBatch.from_arrays([pa.array([b // SKETCH_BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = raw.as_buffer()
                part = np.frombuffer(data, np.uint16 if data.size == 2 * SKETCH_BLOCK else np.uint32)
                sums[b] = sums[b] + part if b in sums else part.astype(np.uint64)
        for b, total in sums.items():
            # one byte a counter: the logarithm to a base of 2**(1/4)
            level = np.ceil(4 * np.log2(total + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["block", "level", "total"])

    parts = docs.mapInArrow(trimmed(count), "block int, counts binary").repartition(max(1, (1 << SKETCH_BITS) // SKETCH_BLOCK), "block")
    rows = parts.mapInArrow(trimmed(add), "block int, level binary, total bigint").collect()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        levels[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["level"], np.uint8)
    mean = sum(r["total"] for r in rows) / (1 << SKETCH_BITS)
    hot = np.ceil(4 * np.log2(max(HOT_LEAST, HOT_TIMES * mean) + 1.0))
    return np.where(levels > hot, levels, 0).astype(np.uint8)


def _prefix(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    n = len(shingles)
    size = n + (-percent * n) // 100 + EXTENDED
    level = levels[_slot(shingles)]
    if not level.any():
        return shingles[:size]
    return shingles[np.argsort(level, kind="stable")[:size]]


def _digest(s: np.ndarray) -> int:
    """A 63-bit digest of a list of hashes, in which their places matter."""
    if not len(s):
        return 0
    x = s * (np.arange(1, len(s) + 1, dtype=_U) * _U(2) + _U(1))
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return int(np.add.reduce(x) >> _U(1))


def _sets_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), PART_BYTES):
                sets = shingle_sets(data, offsets, k)
                wanted = batch.column(0).slice(a, b - a).to_pylist()
                hit = [(w, s.tobytes()) for w, s in zip(wanted, sets, strict=True) if _digest(s) == w]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in hit], pa.int64()), pa.array([s for _, s in hit], pa.binary())], names=["w", "s"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, tables: Tables, name: str) -> DataFrame:
    """The pairs whose whole sets are similar enough.

    Keys of up to BROADCAST_ROWS pairs are broadcast, so that sets are picked where they lie.
    More pairs are verified in PARTS jobs, so that the sets of only some pairs are on disk at a time.
    """
    light = pairs.count() <= BROADCAST_ROWS
    parts = [pairs] if light else [pairs.where(F.pmod(F.xxhash64("a"), F.lit(PARTS)) == k) for k in range(PARTS)]
    done = [tables.write(f"{name}-{k}", _verified_part(part, sets, percent, light)) for k, part in enumerate(parts)]
    return reduce(DataFrame.unionAll, done)


def _verified_part(pairs: DataFrame, sets: DataFrame, percent: int, light: bool) -> DataFrame:
    """Each slice of a set's partners streams past that set."""
    salted = pairs.withColumn("slice", F.pmod(F.hash("b"), F.lit(SLICES)))
    own = salted.select(F.col("a").alias("w"), "a", "slice", F.lit(None).cast("bigint").alias("b")).distinct()
    keys = own.unionAll(salted.select(F.col("b").alias("w"), "a", "slice", "b"))
    sent = (F.broadcast(keys) if light else keys).join(sets, "w").select("a", "slice", "b", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.empty(0, _U)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, part, b, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                other = np.frombuffer(raw.as_buffer(), _U)
                if b is None:
                    key, own = (a, part), other
                elif key == (a, part):
                    small, large = (own, other) if len(own) <= len(other) else (other, own)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    common = int((large[at] == small).sum())
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    placed = sent.repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    return placed.mapInArrow(trimmed(run), "a bigint, b bigint")


def _compatible(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _star_pairs(rows: DataFrame, r: int, percent: int) -> DataFrame:
    """For each list and band of sizes, one member of each part against one of the list's largest part: linear in the list."""
    band = F.floor(F.ln(F.col("n")) / math.log(100 / percent) + r / 2).alias("band")
    # later rounds choose anew for each shingle, so that a part meets many members of a large one
    order = F.xxhash64("w", "token", F.lit(r)) if r else F.col("w")
    chosen = rows.groupBy("token", band, "c").agg(F.min(F.struct(order.alias("o"), "w", "n")).alias("x"), F.count("*").alias("size"))
    lead = chosen.groupBy("token", "band").agg(F.max(F.struct("size", (-F.col("c")).alias("c"), "x")).alias("lead"), F.count("*").alias("parts")).where("parts > 1")
    both = chosen.join(lead, ["token", "band"]).where("c <> -lead.c")
    both = both.select(F.col("lead.x.w").alias("a"), F.col("x.w").alias("b"), F.col("lead.x.n").alias("n"), F.col("x.n").alias("m"))
    return both.where(_compatible("n", "m", percent)).select("a", "b")


def _plausible(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes share enough: what they share, and all behind the longer rest, must reach the overlap needed."""
    sides = [profiles.select(*(F.col(c).alias(f"{c}_{x}" if c != "w" else x) for c in profiles.columns)) for x in ("a", "b")]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    behind = lambda n: F.greatest(F.ceil(F.col(n) * percent / 100) - EXTENDED, F.lit(0))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return met.where((F.col("g_a") == F.col("g_b")) | (shared + F.greatest(behind("n_a"), behind("n_b")) >= need)).select("a", "b")


def _cross_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All candidates between different parts. ``rows``: postings of groups; ``nodes`` (w, n, g, c): all members with their parts."""
    members = nodes.select("g", "w", "c")
    open_groups = nodes.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"))
    # within groups of several parts
    split = nodes.select("g", "w", "c").join(open_groups.where("lo <> hi").select("g", "size"), "g")
    inner = _sliced(split, "g", "w").where("w < w2 and c <> c2").select(F.col("w").alias("a"), F.col("w2").alias("b"))
    # between groups: lists with more than one part
    ranged = rows.select("token", "n", "at", "g").join(open_groups.drop("size"), "g")
    mixed = ranged.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("size")).where("l <> h").select("token", "size")
    live = ranged.join(mixed, "token")
    # a pair is wanted once: not where one of the shingles shortly before is shared as well
    preceding = Window.partitionBy("g").orderBy("at").rowsBetween(-BEFORE, -1)
    live = live.withColumn("before", F.collect_list("token").over(preceding))
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    pairs = (
        _sliced(live, "token", "g")
        .where("(n < n2 or (n = n2 and g < g2)) and not (lo = hi and lo2 = hi2 and lo = lo2)")
        .where(_compatible("n", "n2", percent))
        .where(F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= need)
        .where(~F.arrays_overlap("before", "before2"))
        .select("g", "g2")
        .distinct()
    )
    between = pairs.join(members, "g").join(members.toDF("g2", "w2", "c2"), "g2").where("c <> c2").select(F.col("w").alias("a"), F.col("w2").alias("b"))
    return inner.unionAll(between)


def _sliced(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The rows joined with themselves by ``key``, the right side's columns marked by a 2: a key of ``size`` rows in as many tasks as it has slices."""
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    left = rows.withColumn("slice", F.pmod(F.xxhash64(member), slices).cast("int")).drop("size")
    right = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("size")
    return left.join(right.withColumnsRenamed({c: f"{c}2" for c in rows.columns if c not in (key, "size")}), [key, "slice"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row.

    Documents link when ``100 * intersection >= percent * union`` of their
    shingle sets; ``component_id`` is the smallest id reachable by links.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "ngram-join")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    levels = spark.sparkContext.broadcast(_sketch(texts.select("t"), k))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), PART_BYTES):
                sets = shingle_sets(data, offsets, k)
                heads = [_prefix(s, levels.value, percent) if len(s) else s for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in heads], pa.int64()),
                        pa.array([s.view(np.int64) for s in heads], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "w", "head", "prefix"],
                )

    seen = tables.write("seen", texts.mapInArrow(trimmed(prefixes), "id bigint, n bigint, w bigint, head bigint, prefix array<bigint>"))
    ids = seen.where("id is not null and n > 0")
    # classes of equal sets, known by the digest w; their group is the smallest class of equal prefix and size
    classes = ids.groupBy("w", "n", "head").agg(F.min("id").alias("id"))
    groups = classes.groupBy("head", "n").agg(F.min("w").alias("g"), F.count("*").alias("members"))
    nodes = tables.write("nodes", classes.join(groups, ["head", "n"]).select("w", "n", "id", "g", "members"))
    # one row stands for each listed group, and for each set; equal rows of one id are taken once
    repeated = ids.groupBy("id", "w").count().where("count > 1").limit(1).count() > 0
    once = (lambda df: df.dropDuplicates(["w"])) if repeated else (lambda df: df)
    listed = once(ids.join(nodes.where("w = g").select("id", "w"), ["id", "w"], "left_semi").select("w", "n", "prefix"))
    posted = listed.select("w", "n", F.posexplode("prefix").alias("at", "token"))
    several = posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    common = tables.write("common", posted.join(several, "token", "left_semi"))
    # a similar set has at least percent % of the size, and so on in turn: small sets can't share EXTENDED
    least = F.greatest(F.lit(1), F.least(F.lit(EXTENDED), F.floor(F.col("n") * percent * percent / 10_000)))
    enough = common.groupBy("w").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= least).select("w")
    lists = tables.write("lists", common.join(enough, "w", "left_semi"))
    slim = tables.write("slim", seen.drop("prefix", "head"))
    tables.drop("common", "seen")
    tokens = lists.groupBy(F.col("w").alias("g")).agg(F.collect_list("token").alias("tokens"))
    profiles = tables.write("profiles", nodes.where("members > 1").select("w", "n", "g").join(tokens, "g", "left").unionByName(nodes.where("members = 1").select("w", "n", "g").join(tokens, "g")))
    # whole sets of what may be compared: groups that share a shingle with another, and members of groups with several
    shared = lists.select(F.col("w").alias("g")).distinct()
    need = nodes.where("members > 1").select("w", "id").unionAll(nodes.where("members = 1").join(shared, "g", "left_semi").select("w", "id"))
    need = tables.write("need", need)
    light = need.count() <= 4 * BROADCAST_ROWS
    sets = tables.write("sets", once(texts.join(F.broadcast(need) if light else need, "id").select("w", "t").mapInArrow(trimmed(_sets_of(k)), "w bigint, s binary")))
    links = labels = tested = None
    for r in range(ROUNDS + 1):
        if labels is None:
            parted = nodes.withColumn("c", F.col("w"))
        else:
            parted = tables.write(f"parted{r}", nodes.join(labels, "w", "left").withColumn("c", F.coalesce("component", "w")).drop("component"))
        if r < ROUNDS:
            pairs = _star_pairs(lists.join(parted.select("w", "c"), "w") if r else lists.withColumn("c", F.col("w")), r, percent)
            if not r:  # members of a group against its first
                pairs = pairs.unionAll(nodes.where("w <> g").select(F.col("g").alias("a"), F.col("w").alias("b")))
        else:
            pairs = _cross_pairs(lists.withColumn("g", F.col("w")), parted, percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = tables.write(f"pairs{r}", _plausible(pairs, profiles, percent))
        if r and not pairs.limit(1).count():
            continue  # nothing that hasn't been compared: parts stay as they are
        tested = pairs if tested is None else tested.unionAll(pairs)
        found = _verified(pairs, sets, percent, tables, f"found{r}")
        if r and not found.limit(1).count():
            continue
        links = tables.write(f"links{r}", found if links is None else found.unionAll(links))
        labels = components(links, tables, f"cc{r}-").select(F.col("node").alias("w"), "component")
    tables.drop("lists", "sets", "profiles", *(f"{x}{r}" for x in ("pairs", "parted") for r in range(ROUNDS + 1)))
    parted = nodes.select("w", "id").join(labels, "w", "left").withColumn("c", F.coalesce("component", "w")).select("w", "id", "c")
    smallest = parted.groupBy("c").agg(F.min("id").alias("component_id"))
    found = tables.write("found", parted.join(smallest, "c").select("w", "component_id"))
    keyed = slim.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("w")).alias("w"))
    return keyed.join(found, "w", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
